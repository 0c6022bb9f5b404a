import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.operators import chunking, evaluation, history, inventory, search


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab. \nż", max_size=400), st.integers(8, 60), st.integers(0, 7))
def test_chunks_are_bounded_and_hold_everything(text, size, overlap):
    got = chunking.split_text(text, size, overlap)
    assert all(c.strip() for c in got)
    assert all(len(c) <= size or not any(s in c.strip() for s in chunking.SEPARATORS) or max(map(len, c.split())) >= size - 2 for c in got)
    at = 0
    flat = "".join("".join(c.split()) for c in got)
    for ch in "".join(text.split()):  # every character appears, in order
        at = flat.index(ch, at) + 1
    assert (not got) == (not text.strip())


def test_chunk_table(spark):
    rows = [(1, "u", "legal_text", "słowo " * 300), (2, "u", None, "słowo " * 300), (3, "u", "x", None), (4, "u", "x", "  "), (5, "u", "x", "a" * 2000)]
    df = spark.createDataFrame(rows, "id long, url string, content_type string, page_content string").withColumn("chunk_index", F.lit(9))
    got = chunking.with_hash(chunking.chunk(df)).collect()
    by = {i: [r for r in got if r.id == i] for i in range(1, 6)}
    assert not by[3] and not by[4] and [len(r.page_content) for r in by[5]] == [2000]
    assert max(len(r.page_content) for r in by[1]) > 512 >= max(len(r.page_content) for r in by[2])
    assert all(sorted(r.chunk_index for r in v) == list(range(len(v))) and {r.chunk_total for r in v} <= {len(v)} for v in by.values())
    stored = chunking.with_hash(chunking.chunk(df.where("id = 1")))
    assert chunking.new_chunks(chunking.with_hash(chunking.chunk(df.where("id = 1"))), stored).count() == 0


def _brute_sparse(docs, questions):
    import re

    tok = lambda t: [w for w in re.findall(r"\w+", t.lower()) if len(w) > 1]
    d = {i: tok(t) for i, t in docs if t is not None}
    out = {}
    for q, text in questions:
        for i, ts in d.items():
            s = 0.0
            for w in set(tok(text)):
                df = sum(w in x for x in d.values())
                if w in ts:
                    s += math.log((len(d) - df + 0.5) / (df + 0.5) + 1) * ts.count(w) / len(ts)
            if s:
                out[q, i] = s
    return out


def test_sparse_scores_against_brute_force(spark):
    docs = [(1, "rata kredytu rośnie"), (2, "kredyt i rata, rata"), (3, None), (4, ""), (5, "obligacja bank")]
    questions = [(1, "Rata kredytu?"), (2, "x"), (3, "bank bank obligacja")]
    got = search.sparse_scores(spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(questions, "id long, q string"), "id", "text", "id", "q").collect()
    want = _brute_sparse(docs, questions)
    assert {(r.qid, r.id): pytest.approx(r.score) for r in got} == want


def test_dense_top_against_numpy(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(300, 8))
    m[7] = m[8]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(900, None), (901, []), (902, [0.0] * 8)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    for cfg in (search.SearchConfig(), search.SearchConfig(block=3)):
        got = {(r.qid, r.rank): r.id for r in search.dense_top(v, q, 5, cfg=cfg).collect()}
        n = m / np.linalg.norm(m, axis=1, keepdims=True)
        for i in range(0, 300, 50):
            order = sorted(range(300), key=lambda j: (-round(float(n[i] @ n[j]), 9), j))[:5]
            assert [got[i, k + 1] for k in range(5)] == order
    assert search.dense_top(v, q.limit(0), 5).count() == 0


def test_fusion_ties_and_empty_lists(spark):
    dense = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "qid long, id long, rank int")
    sparse = spark.createDataFrame([(1, 12, 1), (1, 11, 2), (2, 5, 1)], "qid long, id long, rank int")
    got = {(r.qid, r.rank): (r.id, r.score) for r in search.fuse(dense, sparse).collect()}
    assert got[1, 1] == (11, pytest.approx(1 / 62)) and got[1, 2][0] == 10 and got[1, 3][0] == 12 and got[2, 1] == (5, pytest.approx(0.4 / 61))
    tie = search.fuse(dense, dense.select("qid", (F.col("id") + 100).alias("id"), "rank"), search.SearchConfig(dense_weight=0.5, sparse_weight=0.5)).orderBy("rank").collect()
    assert [r.id for r in tie] == [10, 110, 11, 111]
    assert search.fuse(dense.limit(0), sparse.limit(0)).count() == 0


def test_rerank_hydrate_and_nulls(spark):
    ranked = spark.createDataFrame([(1, i, i) for i in range(1, 9)], "qid long, id long, rank int")
    docs = spark.createDataFrame([(i, "rata kredytu" if i in (5, 8) else None) for i in range(1, 8)] + [(8, "rata"), (8, "rata")], "doc_id long, text string")
    got = search.rerank(search.hydrate(ranked, docs, "doc_id", "text").withColumn("q", F.lit("rata kredytu")), search.overlap_score(F.col("q"), F.col("text"))).orderBy("rerank_rank").collect()
    assert [r.id for r in got] == [5, 8, 1, 2, 3, 4] and got[1].rerank_score == 0.5 and got[2].rerank_score == 0


def test_inventory(spark):
    rows = [("https://a.example/1", "s"), ("https://a.example/1", "s"), ("https://a.example/2/", None), (None, "t"), (None, None), ("bad", "")]
    df = spark.createDataFrame(rows, "url string, source string")
    got = {r.domain: (r.urls, r.chunks) for r in inventory.domain_inventory(df).collect()}
    assert got == {"a.example": (2, 3), "t": (0, 1), "unknown": (1, 2), None: (3, 6)}
    assert [(r.source, r.chunks) for r in inventory.source_counts(df).collect()] == [("s", 2), ("unknown", 2), ("", 1), ("t", 1)]
    asked = spark.createDataFrame([("https://a.example/2",), ("https://a.example/1//",), ("https://none.example",)], "asked string")
    assert sorted((r.asked[-4:], r.url) for r in inventory.lookup_url(df, asked).collect()) == [("/1//", "https://a.example/1")] * 2 + [("le/2", "https://a.example/2/")]
    assert inventory.unseen(df, df.where("source = 's'")).count() == 4
    graded = spark.createDataFrame([(1, 0.9, False), (1, 0.3, False), (2, 0.8, True), (3, None, None)], "q long, s double, t boolean")
    assert {r.q: (round(r.avg_score, 3), r.stale, r.retry) for r in inventory.grades(graded, "q", "s", "t").collect()} == {1: (0.6, False, False), 2: (0.8, True, True), 3: (0.0, False, True)}


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, 7, 1), (1, 8, 2), (2, 9, 1)], "qid long, id long, rank int")
    relevant = spark.createDataFrame([(1, 8), (1, 8), (1, 5), (2, 1), (3, 2)], "qid long, id long")
    m = evaluation.retrieval_metrics(ranked, relevant, 2)
    assert {r.qid: (r.recall, r.precision, r.reciprocal_rank) for r in m.collect()} == {1: (0.5, 0.5, 0.5), 2: (0, 0, 0), 3: (0, 0, 0)}
    assert evaluation.mean_metrics(m).first().passed is False and evaluation.mean_metrics(m.limit(0)).first().questions == 0


def test_history(spark):
    rows = [("a", i) for i in range(12)] + [("b", 1), ("c", None)]
    df = spark.createDataFrame(rows, "k string, n int")
    got = history.last_rows(df, "k", "n", 10)
    assert got.where("k = 'a'").count() == 10 and got.where("k = 'b' and back = 1").count() == 1
    t = spark.createDataFrame([([1, 2, 3],), ([],)], "x array<int>").select(history.tail(F.col("x"), 2)).collect()
    assert [r[0] for r in t] == [[2, 3], []]
    block = spark.range(1).select(history.context_block(F.lit(2), F.lit("s"), F.lit(None).cast("string"), F.lit(""), F.lit("t" * 80), F.lit("x" * 900))).first()[0]
    assert block == "[2] s | ? | ? | " + "t" * 60 + "\n" + "x" * 800
    assert spark.range(1).select(history.shortened(F.lit("abcdef"), 3)).first()[0] == "abc…"
