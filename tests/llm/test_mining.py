"""Fertility rules, phrase collocations and ranked search against plain versions."""

import math
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from scenequarry.llm import fertility, phrases, ranked_search
from scenequarry.llm.byte_bpe import ranks_of
from tests.llm.brute import words

FILES = (public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
SCHEMA = "doc_id bigint, text string, lang string, n_words int, kept string, term bigint, f bigint, lang_ string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, g, 1, "x", 2, 3, "y") for d, t, g in rows], SCHEMA)


TEXTS = [
    (1, "one two three four five six one two three four five seven", "en"), (2, None, None), (3, "", "en"), (4, " \t\n \n", None),
    (5, "a line\n\na line\n  \na line \nb # $ %&|<>*\nb # $ %&|<>*", "en"), (5, "a line\n\na line\n  \na line \nb # $ %&|<>*\nb # $ %&|<>*", "en"),
    (None, "Привет мир, это русский текст из десяти слов и ещё двух", None), (7, "漢字 と かな の 文章 です 漢字 漢字 漢字 漢字", None), (8, "x" * 200_000 + " tail", "de"),
    (9, "word " * 60, "en"), (10, " ".join(f"w{i * i % 977}" for i in range(30_000)), None),
]


def plain_measures(text, pieces, ranks):
    w = words(text)
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    ids = [i for x in w for i in pieces.encode(x.decode())]
    counts = Counter(ids)
    entropy = -sum(c / len(ids) * math.log2(c / len(ids)) for c in counts.values())
    chars = sum(len(x.decode()) for x in w)
    return {
        "n_words": len(w), "word_chars": chars, "n_symbols": sum(c in "#*$%&|<>" for c in text or ""), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered), "n_tokens": len(ids), "token_entropy": entropy, "chars_per_token": chars / max(len(ids), 1),
        "byte_share": sum(pieces.is_byte(i) for i in ids) / max(len(ids), 1), "byte_chars_per_token": chars / max(sum(len(ranks.encode_ordinary(" " + x.decode())) for x in w), 1),
    }


def test_measures(spark):
    pieces = sentencepiece.SentencePieceProcessor(model_file=FILES[0])
    ranks = tiktoken.Encoding("plain", pat_str=FILES[2], mergeable_ranks=ranks_of(FILES[1]), special_tokens={})
    docs = frame(spark, TEXTS).repartition(2)
    got = fertility.judge(docs, *FILES, keep=["doc_id", "text", "kept"]).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        for name, value in plain_measures(r.text, pieces, ranks).items():
            assert r[name] == pytest.approx(value, abs=1e-9), (r.doc_id, name)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept is not r.base_failed            # groups of so few documents have no band
    assert {r.doc_id: r.language for r in got} | {} == {1: "en", 2: "other", 3: "en", 4: "other", 5: "en", None: "cyrillic", 7: "han", 8: "de", 9: "en", 10: "latin"}
    assert fertility.judge(docs.limit(0), *FILES).count() == 0
    assert fertility.measure(docs, *FILES, lang=None).where("doc_id = 1").first().language == "latin"


def test_bands_reject_what_strays(spark):
    rng = np.random.default_rng(5)
    good = ["the cat of a house and that dog in this wood was here for us".split()[i] for i in rng.integers(0, 14, 40 * 300)]
    rows = [(i, " ".join(good[40 * i : 40 * i + 40]), "en") for i in range(300)] + [(1000, " ".join("qzx#%jvk&w" for _ in range(7)) + " a b c d", "en")]
    rows += [(2000, " ".join(f"ᚠ{i}" for i in range(40)), "en")]
    got = fertility.judge(frame(spark, rows), *FILES)
    fine = {r.doc_id for r in got.where("kept").collect()}
    assert 2000 not in fine and len(fine & set(range(300))) >= 290 - sum(r.base_failed for r in got.where("doc_id < 300").collect())
    limits = fertility.bands(got)
    assert limits.count() >= 1
    none = fertility.judge(frame(spark, rows), *FILES, given=limits.limit(0))
    assert none.where("kept = base_failed").count() == 0


def plain_phrases(rows, least, top, longest=5):
    pieces = [(g or "und", [x for x in re.split(r"[\x20\x09]+", p) if x]) for _, t, g in rows for p in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]
    f, n = Counter(), Counter()
    for g, w in pieces:
        n[g] += len(w)
        f.update((g, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    chosen = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    out = {}
    for (g, w), a in chosen.items():
        if any(h == g and len(x) > len(w) and b >= a and any(x[i : i + len(w)] == w for i in range(len(x))) for (h, x), b in chosen.items()):
            continue
        score, k = min((1000 * a * n[g] // (f[g, w[:k]] * f[g, w[k:]]), k) for k in range(1, len(w)))
        out.setdefault(g, []).append((-score, -a, " ".join(w).encode(), f[g, w[:k]], f[g, w[k:]], n[g]))
    return {(g, i + 1, p.decode(), -a, l, r, m, -s) for g, found in out.items() for i, (s, a, p, l, r, m) in enumerate(sorted(found)[:top])}


PHRASES = [
    (1, "New York city. new york CITY, New\tYork city hall; the new york", "en"), (2, None, "en"), (3, "", None), (4, "a a a a a a a a", None), (4, "a a a a a a a a", "und"),
    (5, "ä Ä ä ä b\x0bä b ä b", "de"), (None, "new york city hall of new york city hall", "en"), (6, "." * 5000 + " x" * 3000, "en"), (7, "\x00 \x00 - - \x00 -", "fr"),
]


@pytest.mark.parametrize("least, top", [(1, 1000), (2, 1000), (3, 4)])
def test_phrases(spark, least, top):
    docs = frame(spark, PHRASES).repartition(3)
    got = phrases.collocations(docs, least, top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    rows = list(map(tuple, got.collect()))
    assert len(rows) == len(set(rows)) and set(rows) == plain_phrases(PHRASES, least, top)
    assert phrases.collocations(docs.limit(0)).count() == 0


def test_phrases_broadcast_only_totals(spark, monkeypatch):
    from scenequarry.operators import joins

    monkeypatch.setattr(joins, "BROADCAST_ROWS", 2)       # the parts of phrases are more, the totals of two languages are not
    rows = [(i, f"one two three four five w{i % 3} six seven", ("en", "de")[i % 2]) for i in range(60)]
    got = phrases.collocations(frame(spark, rows), 5, 50)
    assert set(map(tuple, got.collect())) == plain_phrases(rows, 5, 50)
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("BroadcastHashJoin") == 1


def test_filters_are_sent_as_bits():
    bits = np.random.default_rng(1).random(1 << 15) < 0.3
    hashes = np.random.default_rng(2).integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    packed = phrases._packed(bits)
    assert packed.nbytes == len(bits) // 8
    assert (phrases._passing(hashes, packed) == bits[(hashes % np.uint64(len(bits))).astype(np.int64)]).all()


def test_phrases_over_slices_and_saturated_filters(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(f"w{k}" for k in rng.zipf(1.4, 60) % 50), "en" if i % 3 else None) for i in range(200)]
    want = plain_phrases(rows, 5, 50)
    assert set(map(tuple, phrases.collocations(frame(spark, rows).repartition(4), 5, 50).collect())) == want
    monkeypatch.setattr(phrases, "_filter_of", lambda counts: np.ones(8, bool))      # a filter that lets all through changes nothing
    assert set(map(tuple, phrases.collocations(frame(spark, rows), 5, 50).collect())) == want


def test_scores_pass_64_bits(spark):
    big = spark.createDataFrame([("x", "a b", 2, 9 * 10**12), ("x", "a", 1, 9 * 10**12), ("x", "b", 1, 10**13)], "lang string, phrase string, size int, f bigint")
    totals = spark.createDataFrame([("x", 10**14)], "lang string, n bigint")
    saved, phrases.phrase_counts = phrases.phrase_counts, lambda *_: (big, totals)
    try:
        (row,) = phrases.collocations(spark.range(1)).collect()
    finally:
        phrases.phrase_counts = saved
    assert row.score == 1000 * 9 * 10**12 * 10**14 // (9 * 10**12 * 10**13)


def plain_search(docs, items, top=10):
    split = [(d, re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for d, t in docs]
    split = [(d, Counter(w), len(w)) for d, w in split if w]
    n_docs, n_terms, df = len(split), sum(n for *_, n in split), Counter(t for _, w, _ in split for t in w)
    out = []
    for item, text in items:
        terms = set(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))
        scored = []
        for d, w, n in split:
            m = 10 + 90 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * w[t] // (1000 * w[t] + 8 * m)) for t in terms if t in w)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, k + 1, r[3], -r[0]) for k, r in enumerate(sorted(scored, key=lambda r: r[:3])[:top])]
    return Counter(out)


def corpus(seed, n, vocabulary=400):
    rng = np.random.default_rng(seed)
    return [(int(i), " ".join(f"t{k}" for k in rng.zipf(1.2, rng.integers(1, 80)) % vocabulary)) for i in rng.permutation(n)]


AWKWARD = [(1, None), (2, ""), (3, "--- \x00"), (4, "Über ÜBER über"), (None, "über t1"), (5, "t1 t2"), (5, "t1 t2"), (6, "T1-t2_t3"), (7, "t1 " * 20_000)]


@pytest.mark.parametrize("top", [1, 10])
def test_search(spark, monkeypatch, top):
    docs = corpus(1, 700) + AWKWARD
    items = [(k, t) for k, t in corpus(2, 40)] + [(100, None), (101, "über t1 t1"), (101, "über t1 t1"), (None, "t2 T3"), (102, "nowhere")]
    table = spark.createDataFrame([(d, t, 1, "b") for d, t in docs], "doc_id bigint, text string, item bigint, rank string").repartition(3)
    asked = spark.createDataFrame([(t, k, 2) for k, t in items], "text string, item_id int, score int")
    want = plain_search(docs, items, top)
    assert Counter(map(tuple, ranked_search.search(table, asked, top).collect())) == want
    for name, value in (("BLOCK_ITEMS", 7), ("CHUNK_DOCS", 100)):
        monkeypatch.setattr(ranked_search, name, value)
    assert Counter(map(tuple, ranked_search.search(table, asked, top).collect())) == want
    assert ranked_search.search(table.limit(0), asked).count() == 0 and ranked_search.search(table, asked.limit(0)).count() == 0
    text_ids = ranked_search.search(table.where("doc_id = 6").withColumn("doc_id", table["doc_id"].cast("string")), asked.where("item_id = 101"))
    assert {r.doc_id for r in text_ids.collect()} == {"6"}


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 300), st.integers(1, 60))
def test_bounds_hold(seed, n_docs, n_items):
    """No document scores more than the bound of any pair of nodes above it and the item."""
    rng = np.random.default_rng(seed)
    size = 50
    doc, term = rng.integers(0, n_docs, 4 * n_docs), rng.integers(0, size, 4 * n_docs)
    doc, term = np.unique(np.stack([doc, term]), axis=1)
    score, weights = rng.integers(1, 10**6, len(doc)), rng.integers(0, 20_000, size)
    chunk = ranked_search.Chunk(doc, term, score, n_docs, weights)
    items = ranked_search.Items(list(range(n_items)), list(range(n_items)), [np.unique(rng.integers(0, size, rng.integers(0, 9))) for _ in range(n_items)], size)
    tree = ranked_search.item_tree(items, weights)
    full = np.zeros((n_docs, size), np.int64)
    full[doc, term] = score
    exact = np.array([full[:, t] @ weights[t] for t in items.terms])[:, chunk.order]
    stack = [tree]
    while stack:
        node = stack.pop()
        stack.extend(node.children)
        best = exact[node.items].max(axis=0)
        for level, maxima in enumerate(chunk.levels):
            span = ranked_search.BATCH * ranked_search.FAN**level
            bounds = chunk.bounds(level, np.arange(len(maxima)), node)
            assert all(bounds[k] >= best[k * span : (k + 1) * span].max() for k in range(len(maxima)))
    assert sorted(i for i in tree.items) == list(range(n_items))


def test_walk_skips_whole_batches():
    """Documents that share rare terms with few items: fewer than half of the pairs of item and batch are looked at, inner nodes and first ways down included."""
    rng = np.random.default_rng(0)
    n_docs, n_items, size = 2000, 256, 1000
    terms = [np.unique(np.r_[rng.integers(0, 10, 5), 10 + (np.arange(3) + 15 * (d % 60)) % (size - 10)]) for d in range(n_docs)]
    doc, term = np.repeat(np.arange(n_docs), [len(t) for t in terms]), np.concatenate(terms)
    weights = np.where(np.arange(size) < 10, 50, 9000)
    score = rng.integers(10**5, 10**6, len(doc))
    chunk = ranked_search.Chunk(doc, term, score, n_docs, weights)
    items = ranked_search.Items(list(range(n_items)), list(range(n_items)), [terms[int(i)] for i in rng.integers(0, n_docs, n_items)], size)
    best = ranked_search.Best(n_items, 10)
    walk = ranked_search.Walk(ranked_search.item_tree(items, weights), chunk, list(range(n_docs)), best, weights)
    walk.run()
    assert walk.looked < 0.5 * n_items * -(-n_docs // ranked_search.BATCH)
    full = np.zeros((n_docs, size), np.int64)
    full[doc, term] = score
    for i, t in enumerate(items.terms):
        total = full[:, t] @ weights[t]
        want = sorted((-int(s), d) for d, s in enumerate(total))[:10]
        assert [(r[0], r[3]) for r in best.found[i]] == want
