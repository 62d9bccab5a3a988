"""Operators over documents: awkward rows, brute force and SQL."""

import hashlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import __spark_entry__ as entry
from check_queries import compare, connect
from scenequarry.llm import byte_bpe, exact_dedup, fingerprint, lm_score, mixing, simhash, substring_dedup, toxicity
from tests.llm import brute

SF_DIR = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables here")
BPE = (public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)

PASSAGE = " ".join(f"word{i}" for i in range(50))
LONG = " ".join(f"w{i * 7919 % 5003}" for i in range(6000))
# a null in every column, empty and long texts, repeated rows, one id twice, copies that differ in white space; names that clash
ROWS = [
    (1, "The cat sat on the mat.", "en", "a", 5, 1), (2, "The  cat sat\non the mat.", "en", "a", 5, 2), (3, "the cat sat on the mat.", "en", "b", 5, 3),
    (4, None, None, None, None, None), (5, "", "en", "b", 0, 5), (6, " \t\n", "en", None, 3, 6), (None, "No id here, only words.", "en", "c", 1, 7),
    (None, None, None, None, None, None), (7, "repeated row of text", "de", "a", 1, 8), (7, "repeated row of text", "de", "a", 1, 8),
    (7, "same id, another text", "de", "a", 1, 9), (8, f"before {PASSAGE} after one", "en", "b", 1, 1), (9, f"start {PASSAGE} end two", "en", "b", 1, 1),
    (10, LONG, "en", "a", 1, 1), (11, LONG + " tail", "en", "é", 1, 1), (12, "ÄÖ über 漢字   x", "de", "é", 1, 1), (13, "a\\b [INST] </s>", "en", "c", 1, 1),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int"


@pytest.fixture(scope="module")
def messy(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def squeezed(text):
    return (text or "").encode().translate(None, b" \t\n\x0b\x0c\r")


def test_exact_groups(messy, nothing):
    groups = defaultdict(list)
    for d, t, *_ in ROWS:
        groups[squeezed(t)].append((-len(t or ""), d is None, d or 0, d))
    want = Counter()
    for normal, rows in groups.items():
        rows.sort(key=lambda r: r[:3])
        for i, r in enumerate(rows):
            want[(r[3], rows[0][3], len(rows), i == 0, hashlib.sha256(normal).hexdigest())] += 1
    got = exact_dedup.exact_groups(messy).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert Counter(map(tuple, got.collect())) == want
    assert exact_dedup.exact_groups(nothing).count() == 0
    kept = exact_dedup.drop_copies(messy)
    assert kept.columns == messy.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(d for (d, _, _, k, _), n in want.items() if k for _ in range(n))
    assert exact_dedup.drop_copies(nothing).count() == 0


def test_group_of_copies_over_many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.range(2000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'the same text', concat('text ', id)) AS text")
        got = exact_dedup.exact_groups(docs).where("group_size > 1").selectExpr("count(*)", "min(keep_id)", "max(group_size)", "count_if(kept)").first()
        assert tuple(got) == (667, 0, 667, 1)
        assert exact_dedup.drop_copies(docs).count() == 2000 - 666
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_groups_cut_by_many_range_boundaries(spark):
    """Groups of one row up to whole partitions, some beginning and ending inside one, beside a grouping in Python."""
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "23"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rng = np.random.default_rng(2)
        sizes = [700, 300, 90, 90, 40, *[3] * 40, *[1] * 200]
        rows = [(int(rng.integers(0, 1 << 40)), " " * int(rng.integers(0, 3)) + f"start of a shared text {g}" + "\n" * int(rng.integers(0, 3)), g) for g, n in enumerate(sizes) for _ in range(n)]
        docs = spark.createDataFrame(rows, "doc_id bigint, text string, `__block` int").repartition(7)
        groups = defaultdict(list)
        for d, t, _ in rows:
            groups[squeezed(t)].append((-len(t), d))
        want = {d: (min(g)[1], len(g), (n, d) == min(g), hashlib.sha256(k).hexdigest()) for k, g in groups.items() for n, d in g}
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(docs).collect()}
        assert got == want
        kept = exact_dedup.drop_copies(docs)
        assert kept.columns == docs.columns
        assert sorted(map(tuple, kept.collect())) == sorted(r for r in rows if want[r[0]][2])
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_copies_among_clashing_columns(spark):
    names = ["doc_id", "text", "__keep", "__id", "__chars", "__text", "__lead", "__row", "__run", "__first", "__last", "__hash", "__start", "__best"]
    docs = spark.createDataFrame([(i, "same" if i < 4 else f"t{i}", *[i] * 12) for i in range(6)], names)
    assert sorted(map(tuple, exact_dedup.drop_copies(docs).collect())) == sorted(map(tuple, docs.where("doc_id in (0, 4, 5)").collect()))
    assert exact_dedup.exact_groups(docs).where("kept").count() == 3


def test_mixing(messy, nothing):
    mixed = mixing.mix(messy).collect()
    assert len(mixed) == len(ROWS)
    sizes = Counter()
    for _, t, _, s, *_ in ROWS:
        sizes[s] += len(brute.words(t))
    taken, target = Counter(), {}
    for r in mixed:
        assert r.size == len(brute.words(r.text)) and r.source_size == sizes[r.source] and 0 <= r.copies <= 2 and r.taken == r.copies * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(target[s] <= 2 * sizes[s] + 1e-9 for s in sizes)
    assert abs(sum(target.values()) - 1.5 * sum(sizes.values())) < 1e-6
    again = [(r.doc_id, r.size, r.taken) for r in mixing.mix(messy.repartition(5)).collect()]
    assert Counter(again) == Counter((r.doc_id, r.size, r.taken) for r in mixed)
    out = mixing.emitted(messy)
    assert out.columns == messy.columns and out.count() == sum(r.copies for r in mixed)
    assert mixing.mix(nothing).count() == 0 and mixing.emitted(nothing).count() == 0


def test_mix_meets_targets(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('x ', cast(1 + pmod(hash(id), 40) AS int)) AS text", "concat('s', id % 7) AS source")
    got = mixing.mix(docs).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= 2 * 40 for r in got)


def test_near_groups(messy, nothing):
    want = Counter(brute.near_groups([(d, t) for d, t, *_ in ROWS]))
    assert Counter(map(tuple, simhash.near_groups(messy).collect())) == want
    assert simhash.near_groups(nothing).count() == 0
    kept = simhash.drop_near_copies(messy)
    assert kept.columns == messy.columns
    assert kept.count() == len(set(brute.near_roots([brute.simhash(t) for _, t, *_ in ROWS])))


def test_links_in_small_and_long_lists():
    random = np.random.default_rng(3)
    for size in (5, 30, 33, 400):
        base = random.integers(0, 1 << 62, 6)
        fps = np.unique([int(base[random.integers(6)]) ^ sum(1 << int(b) for b in random.choice(62, random.integers(0, 5))) for _ in range(size)])
        a, b = simhash.list_links(np.zeros(len(fps), np.int64), fps.astype(np.int64))
        joined = {int(f): {int(f)} for f in fps}
        for x, y in zip(a, b):
            both = joined[int(x)] | joined[int(y)]
            for f in both:
                joined[f] = both
        real = {int(f): {int(f)} for f in fps}
        for x in fps:
            for y in fps:
                if (int(x) ^ int(y)).bit_count() <= 3:
                    both = real[int(x)] | real[int(y)]
                    for f in both:
                        real[f] = both
        assert joined == real


def test_keys_find_every_near_pair():
    for differing in [(0, 1, 2), (0, 4, 7), (5, 6, 7), (3, 4, 5), (1, 2, 6)]:
        assert any(not set(differing) & set(key) for key in simhash.POSITIONS)


def test_substring(messy, nothing):
    want = Counter((d, *r) for (d, *_), r in zip(ROWS, brute.repeats([r[1] for r in ROWS])))
    got = [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in substring_dedup.drop_repeats(messy).collect()]
    assert Counter(got) == want
    assert substring_dedup.drop_repeats(nothing).count() == 0


def test_substring_random(spark):
    random = np.random.default_rng(5)
    pool = [" ".join(f"p{i}q{j}" for j in range(random.integers(30, 60))) for i in range(6)]
    texts = [" ".join(str(random.choice(pool)) if random.random() < 0.3 else f"z{random.integers(10**9)}" for _ in range(random.integers(0, 60))) for _ in range(80)]
    texts += ["a b " * 40, "same " * 36, "same " * 35, "one " * 34]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in substring_dedup.drop_repeats(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute.repeats(texts)


def test_cover_meets_every_difference():
    cover = substring_dedup.COVER
    assert {(a - b) % substring_dedup.PERIOD for a in cover for b in cover} == set(range(substring_dedup.PERIOD))


def test_fingerprints(messy, nothing):
    got = fingerprint.edited_fingerprints(messy).collect()
    assert len(got) == len(ROWS)
    texts = defaultdict(set)
    for d, t, *_ in ROWS:
        texts[d].add(t or "")
    one = {d: next(iter(t)) for d, t in texts.items() if len(t) == 1}
    chain = {1: 2, 2: 3, 3: 4, 4: 5, 5: 6, 8: 9, 9: 10, 10: 11, 11: 12, 12: 13}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if r.doc_id in chain:
            own, after = one[r.doc_id], one[chain[r.doc_id]]
            edited = own[: len(own) - len(own) // 2] + after[: len(own) // 2]
            assert (r.n_chars, r.edited_sha256) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
    by_id = {r.doc_id: r for r in got}
    assert by_id[4].fingerprint == by_id[5].fingerprint and by_id[4].near_next == 1.0
    assert fingerprint.edited_fingerprints(nothing).count() == 0


def test_fingerprint_is_homomorphic(spark):
    docs = spark.createDataFrame([(1, "One two.\nThree four."), (2, "Three four. One two."), (3, "One two."), (4, "Three four.")], "k int, t string")
    v = {r.k: r.lanes for r in fingerprint.lanes(docs, ["k"], "t").collect()}
    assert v[1] == v[2] != v[3]
    sums = spark.createDataFrame([(v[3], v[4], v[1])], "a array<int>, b array<int>, c array<int>")
    both, rest = sums.select(fingerprint.combine(sums.a, sums.b), fingerprint.combine(sums.c, sums.a, -1)).first()
    assert both == v[1] and rest == v[4]


def test_likeness_of_a_paragraph_repeated_many_times(spark):
    # the lanes grow past 2^15, then past 2^16, and must keep their signs
    docs = spark.createDataFrame([(n, "One two.\n" * n) for n in (100, 40_000, 70_000)], "k int, t string")
    v = {r.k: r.lanes for r in fingerprint.lanes(docs, ["k"], "t").collect()}
    assert [x * 400 for x in v[100][: fingerprint.SIGNS]] == v[40_000][: fingerprint.SIGNS]
    pairs = spark.createDataFrame([(v[100], v[40_000]), (v[100], v[70_000])], "a array<int>, b array<int>")
    assert [r[0] for r in pairs.select(fingerprint.likeness(pairs.a, pairs.b)).collect()] == pytest.approx([1.0, 1.0])
    assert [len(r[0]) for r in pairs.select(fingerprint.as_text(pairs.b)).collect()] == [68 * 8] * 2


def test_byte_bpe(messy, nothing, spark):
    path, pattern = BPE
    words = byte_bpe.vocabulary(path, pattern)
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.ranks_of(path), special_tokens={})
    got = byte_bpe.decode(byte_bpe.encode(messy.select("doc_id", "text", "size"), path, pattern), path).collect()
    def ids(text):
        return np.array(library.encode_ordinary(text or ""), "<u4").tobytes()

    assert Counter((r.doc_id, bytes(r.token_ids), bytes(r.decoded)) for r in got) == Counter((d, ids(t), (t or "").encode()) for d, t, *_ in ROWS)
    assert byte_bpe.digests(nothing, path, pattern).count() == 0
    for piece in ("hello", "漢字かな", "xqzzyyqqx", "a" * 40):
        assert np.frombuffer(words.encode([piece]), "<u4").tolist() == brute.bpe(piece.encode(), byte_bpe.ranks_of(path))


def test_stitching_at_any_cut(monkeypatch):
    words = byte_bpe.vocabulary(*BPE)
    random = np.random.default_rng(1)
    for trial in range(800):
        monkeypatch.setattr(byte_bpe, "CHUNK", int(random.choice([16, 40, 64])))
        monkeypatch.setattr(byte_bpe, "OVERLAP", int(random.choice([5, 8, 12])))
        letters = ["ab 1'\n", "aé  \t\n'srell.,12", "a", " a", "   a"][trial % 5]
        text = "".join(random.choice(list(letters), random.integers(0, 300)))
        chunks = list(byte_bpe.chunks_of(text))
        cuts = [byte_bpe.cuts_of(words.pattern, c, i + 1 == len(chunks)) for i, c in enumerate(chunks)]
        assert byte_bpe.stitched(words.pattern, text, cuts) == words.pattern.findall(text)


def test_toxicity(spark, messy, nothing):
    rows = [(i, f"nice words number n{i} and {'idiot scum' if i % 9 == 0 else 'friend'}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 9 == 0)) for i in range(600)] + [(None, 1), (5, None)], "doc_id bigint, toxic int")
    got = toxicity.verdicts(docs, labels).collect()
    assert all(r.predicted == (r.doc_id % 9 == 0) == (r.score >= 0.3) for r in got)
    flipped = labels.withColumn("toxic", toxicity.held_out(labels.doc_id).cast("int").bitwiseXOR(labels.toxic))
    assert [tuple(r) for r in toxicity.verdicts(docs, flipped).orderBy("doc_id").collect()] == [tuple(r) for r in sorted(got)]
    odd = toxicity.verdicts(messy, labels).collect()
    assert len(odd) == len(ROWS) and not any(r.predicted for r in odd)
    assert toxicity.verdicts(nothing, labels).count() == 0 and toxicity.verdicts(messy, labels.limit(0)).count() == len(ROWS)
    assert toxicity.drop_toxic(messy, labels).columns == messy.columns
    assert toxicity.drop_toxic(docs, labels).count() == sum(i % 9 > 0 for i in range(600))


def test_toxicity_sample_of_an_id_with_many_texts(spark, monkeypatch):
    rows = [(i, f"nice words number n{i} and {'idiot scum' if i % 9 == 0 else 'friend'}") for i in range(600)]
    many = rows + [(1, f"other friend x{i % 400}") for i in range(3000)]
    labels = spark.createDataFrame([(i, int(i % 9 == 0)) for i in range(600)], "doc_id bigint, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "non_negative_fit", lambda positive, unlabelled, prior: seen.append((positive, unlabelled)))
    for docs in (rows, rows + rows, many):
        toxicity.fit(spark.createDataFrame(docs, "doc_id bigint, text string"), labels)
    assert seen[0] == seen[1] and seen[0][0] == seen[2][0]
    assert len(seen[2][1]) == len(seen[0][1]) - 1 + toxicity.TEXTS_PER_ID


def test_lm_score(spark, messy, nothing):
    good = [(i, f"alpha beta gamma delta g{i % 50} alpha beta gamma") for i in range(300)]
    bad = [(1000 + i, f"qq ww b{i % 50} zz qq ww zz qq") for i in range(300)]
    docs = spark.createDataFrame(good + bad, "doc_id bigint, text string")
    target = docs.where("doc_id < 150").select("doc_id")
    got = {r.doc_id: r for r in lm_score.cross_entropy_difference(docs, target).collect()}
    assert min(got[i].score for i in range(300)) > max(got[1000 + i].score for i in range(300))
    # by hand: the counts without the document's own
    texts = dict(good + bad)
    words, pairs, n = Counter(), Counter(), 0
    for d, t in texts.items():
        if d < 150:
            w = t.split()
            words.update(w)
            pairs.update(zip([None, *w], w))
            n += len(w)
    w = texts[200].split()
    vocabulary, loss = len({x for t in texts.values() for x in t.split()}), 0.0
    for before, word in zip([None, *w], w):
        uni = (words[word] + 1) / (n + vocabulary + 1)
        c2 = pairs[(before, word)]
        loss -= np.log((c2 + lm_score.SMOOTHING * uni) / (max(words[before], c2) + lm_score.SMOOTHING))
    assert got[200].target_loss == pytest.approx(loss / len(w), rel=1e-3)
    odd = lm_score.cross_entropy_difference(messy, target).collect()
    assert len(odd) == len(ROWS) and all(r.score == 0 for r in odd if not r.n_tokens)
    assert lm_score.cross_entropy_difference(nothing, target).count() == 0
    assert lm_score.cross_entropy_difference(messy, target.limit(0)).count() == len(ROWS)


def test_numbers_packed_by_bytes():
    for numbers in ([], [0], [1, 255, 256, 0], [2**64 - 1, 0, 7]):
        assert lm_score.unpacked(lm_score.packed(np.array(numbers, np.uint64))).tolist() == numbers


def test_lm_score_of_hot_ids_and_small_blocks(spark, messy, monkeypatch):
    """Where the documents lie changes no loss: many blocks and parts, and one id that a third of the rows have."""
    rows = [(i if i % 3 else 42, f"w{i % 17} w{i % 5} w{i % 3} common w{i}") for i in range(600)] + [(None, f"w{i} none") for i in range(50)]
    docs = spark.createDataFrame([(d, t, 1, "x", True) for d, t in rows], "doc_id bigint, text string, block int, n_tokens string, chosen boolean").repartition(5)
    target = spark.createDataFrame([(i,) for i in range(0, 300, 2)] + [(42,), (42,), (None,)], "id int")
    once = Counter(map(tuple, lm_score.cross_entropy_difference(docs, target).collect()))
    for name, value in (("BLOCK_ROWS", 40), ("PART_BYTES", 1000), ("HOT_ROWS", 20)):
        monkeypatch.setattr(lm_score, name, value)
    again = lm_score.cross_entropy_difference(docs, target).collect()
    near = lambda counts: sorted((str(d), n, *(round(x, 9) for x in rest)) for (d, n, *rest), k in counts.items() for _ in range(k))
    assert near(once) == near(Counter(map(tuple, again)))


def test_lm_score_counts_every_ngram_for_itself(spark):
    # so many distinct words and pairs that a table of 2^22 cells would mix up some of each text, in several blocks
    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 1 << 40, 2000)) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(10_000, "a b a b a"), (10_001, "b a b c"), (10_002, "a b a b a"), (10_003, ""), (10_004, None), (None, "c a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    target = docs.where("doc_id % 2 = 0").select("doc_id")
    got = {r.doc_id: r for r in lm_score.cross_entropy_difference(docs, target).collect()}
    assert len(got) == len(rows)
    assert all(r.n_tokens == len((t or "").split()) for d, t in rows for r in [got[d]])
    words, pairs, n = (Counter(), Counter()), (Counter(), Counter()), [0, 0]
    for d, t in rows:
        w = (t or "").split()
        for k in (0, 1) if d is not None and d % 2 == 0 else (1,):
            words[k].update(w)
            pairs[k].update(zip([None, *w], w))
            n[k] += len(w)
    for d, t in [*rows[:3], *rows[300:]]:
        w = (t or "").split()
        own, own2 = Counter(w), Counter(zip([None, *w], w))
        for k, name in enumerate(("target_loss", "background_loss")):
            out = k == 1 or (d is not None and d % 2 == 0)
            rate = 1.0 if k == 0 else n[0] / n[1]
            loss = 0.0
            for before, word in zip([None, *w], w):
                c2 = (pairs[k][before, word] - out * own2[before, word]) * rate
                c1, ch = ((words[k][x] - out * own[x]) * rate for x in (word, before))
                uni = (c1 + 1) / ((n[k] - out * len(w)) * rate + len(words[1]) + 1)
                loss -= np.log((c2 + lm_score.SMOOTHING * uni) / (max(ch, c2) + lm_score.SMOOTHING))
            assert got[d][name] == pytest.approx(loss / max(len(w), 1), rel=1e-9)


@needs_tables
@pytest.mark.parametrize("name", ["op1_mixing", "op2_exact_dedup", "op8_url_filter"])
def test_queries_match_sql(spark, name):
    ok, note = compare(entry.queries()[name](spark, SF_DIR), connect(SF_DIR), entry.oracle_sql()[name])
    assert ok, note
