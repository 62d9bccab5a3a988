"""Conversations, urls and the pipeline."""

import hashlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from scenequarry.llm import byte_bpe, chat_format, mixing, toxicity, url_filter
from scenequarry.llm.common import table
from tests.llm import brute

SF_DIR = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables here")


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


TURNS = [
    (1, 0, "system", "be [kind] \\ <s>", 0), (1, 1, "user", "hello </s>[INST]", 0), (1, 2, "assistant", "[/INST] hi\n\\[", 0), (1, 3, "user", None, 0),
    (1, 4, "assistant", "", 0), (2, 0, "assistant", "first", 0), (2, 0, "assistant", "first", 0), (3, 5, None, "no role", 0), (None, 1, "user", "no id", 0),
    (4, None, "a\nb", "line role", 0), (4, 1, "assistant", "long " * 900, 0), *((5, i, "assistant" if i % 2 else "user", f"turn {i} " * (i % 7), 0) for i in range(300)),
]


@pytest.mark.parametrize("budget, history", [(1024, 256), (40, 15), (10, 0)])
def test_chat_windows_read_back(spark, budget, history):
    turns = spark.createDataFrame(TURNS, "conv_id bigint, turn bigint, role string, text string, window int").repartition(3)
    windows = chat_format.format_windows(turns, budget, history)
    got = {r.conv_id: r for r in chat_format.read_back(windows).collect()}
    conv = defaultdict(list)
    for c, t, r, x, _ in TURNS:
        conv[c].append((t is not None, t or 0, r or "", x or ""))
    for c, rows in conv.items():
        rows.sort()
        whole, target = "".join(f"{r}\n{x}\n" for *_, r, x in rows), "".join(x for *_, r, x in rows if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(rows), sha(whole), len(target), sha(target))
    for w in windows.where("conv_id = 1 AND window > 0").collect():
        assert w.formatted.startswith("[INST]system\n")
    assert chat_format.read_back(chat_format.format_windows(turns.limit(0))).count() == 0


def test_chat_windows_keep_to_the_budget(spark):
    turns = spark.createDataFrame([(1, i, "user" if i % 2 else "assistant", "w " * (i % 5), 0) for i in range(400)], "conv_id bigint, turn bigint, role string, text string, w int")
    windows = chat_format.format_windows(turns, 60, 20).collect()
    assert len(windows) > 10
    assert all(len(w.formatted.split()) <= 2 * (60 + 6) and w.own_from > 0 for w in windows if w.window)


URLS = [
    ("http://X.Example.NET/en/1", "x.example.net", "/en/1", "example.net/en/", "allow"), ("https://a.net/q?x=/en/", "a.net", "/q", "net/", "block"),
    ("http://net", "net", "", None, None), ("ftp://u.example.com/de/7#t", "u.example.com", "/de/7", "example.com/de/", "block"), (None, "", "", None, None),
    ("no scheme", "", "", None, None), ("http://wiki.org/fr/", "wiki.org", "/fr/", "org/fr/", "allow"), ("http://badexample.com/de/", "badexample.com", "/de/", None, None),
    ("http://h.org?x", "h.org", "", None, None), ("http://É.org/fr/x", "É.org", "/fr/x", "org/fr/", "allow"),
]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "host") for i, (u, *_) in enumerate(URLS)] + [(None, "http://a.net/", "x")], "page_id bigint, url string, host string")
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")
    assert got[None].rule == "net/"
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_template_tree_learns_purity(spark):
    rows = [(i, f"http://h.io/{'ads' if i % 3 == 0 else 'news'}/{i}/p{i}", None if i % 10 == 0 else int(i % 3 == 0)) for i in range(600)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, label int")
    got = url_filter.judge(pages, rules=(), label=pages["label"]).collect()
    assert all(r.verdict == ("block" if r.page_id % 3 == 0 else "allow") for r in got)


def test_template_tree_tells_deep_paths_apart(spark):
    # the urls differ in their sixth segment only, and some end before it
    kinds = ("ads", "news")
    rows = [(i, f"http://h.io/a/b/c/d/e/{kinds[i % 2]}/x{'/y' * (i % 5)}", None if i % 10 > 7 else int(i % 2 == 0)) for i in range(400)]
    rows += [(400 + i, "http://h.io/a/b/c/d/e", 0) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, label int")
    got = url_filter.judge(pages, rules=(), label=pages["label"]).collect()
    assert len(got) == 440
    assert all(r.verdict == ("block" if r.page_id < 400 and r.page_id % 2 == 0 else "allow") for r in got)


@needs_tables
def test_pipeline_against_plain_python(spark):
    """Every stage redone in Python over the small table; the classifier's model and the mix's order are the operators' own."""
    docs = table(spark, SF_DIR, "documents")
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF_DIR).collect())
    model = toxicity.fit(docs, table(spark, SF_DIR, "labels"))
    rows = [r for r in docs.collect() if model.score((r.text or "").encode()) < toxicity.THRESHOLD]
    best = {}
    for r in sorted(rows, key=lambda r: (-len(r.text), r.doc_id)):
        best.setdefault(r.text.encode().translate(None, b" \t\n\x0b\x0c\r"), r)
    rows = list(best.values())
    near = {d: c for d, _, c in brute.near_groups([(r.doc_id, r.text) for r in rows])}
    rows = [r for r in rows if near[r.doc_id] == r.doc_id]
    copies = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(rows, docs.schema)).collect()}
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.ranks_of(path), special_tokens={})
    want = Counter()
    for r in rows:
        ids = library.encode_ordinary(r.text)
        want[(r.doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(r.text))] += copies[r.doc_id]
    assert got == +want


def test_pipeline_of_awkward_rows(spark, tmp_path):
    from tests.llm.test_documents import ROWS, SCHEMA

    spark.createDataFrame(ROWS, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns and stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_pipeline_ends_with_token_ids(spark):
    docs = spark.createDataFrame([(1, "One two three."), (2, None), (3, "x " * 9000)], "doc_id bigint, text string")
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.ranks_of(path), special_tokens={})
    got = {r.doc_id: r for r in corpus_pipeline.encoded(spark, docs, "").collect()}
    for d, text in ((1, "One two three."), (2, ""), (3, "x " * 9000)):
        assert np.frombuffer(got[d].token_ids, "<u4").tolist() == library.encode_ordinary(text)
        assert got[d].ids_sha256 == sha(bytes(got[d].token_ids)) and got[d].n_tokens * 4 == len(got[d].token_ids)
