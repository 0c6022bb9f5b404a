"""Keyword, vector and hybrid search for many questions at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import text as tx
from millrace.sources import storage


@dataclass(frozen=True)
class SearchConfig:
    """Candidates per list, fused and after reranking; reciprocal-rank constants. ``block``: question vectors that a task
    compares at once (their size is bounded by it; more questions take more passes)."""

    dense: int = 12
    sparse: int = 12
    fused: int = 12
    reranked: int = 6
    rank_constant: int = 60
    dense_weight: float = 0.6
    sparse_weight: float = 0.4
    block: int = 4096


def term_frequencies(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, token, n, tf): occurrences and share of all tokens of the document. Null and wordless texts have none."""
    rows = documents.select(F.col(id_col).alias("id"), tx.tokens(F.col(text_col)).alias("ts")).where(F.size("ts") > 0)
    pieces = rows.select("id", F.size("ts").alias("len"), F.explode("ts").alias("token"))
    return pieces.groupBy("id", "len", "token").agg(F.count(F.lit(1)).alias("n")).select("id", "token", "n", (F.col("n") / F.col("len")).alias("tf"))


def idf(df: Column, total: Column) -> Column:
    """Inverse document frequency with the usual half-count smoothing."""
    return F.log((total - df + 0.5) / (df + 0.5) + 1)


def with_total(rows: DataFrame, total: DataFrame) -> DataFrame:
    """Rows with the columns of a table of one row: an equi-join on a constant whose right side is a single row."""
    return rows.withColumn("__one", F.lit(1)).join(F.broadcast(total.withColumn("__one", F.lit(1))), "__one").drop("__one")


def question_tokens(questions: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(qid, token): the distinct tokens of each question."""
    return questions.select(F.col(id_col).alias("qid"), F.explode(F.array_distinct(tx.tokens(F.col(text_col)))).alias("token")).distinct()


def sparse_scores(documents: DataFrame, questions: DataFrame, doc_id: str, doc_text: str, q_id: str, q_text: str) -> DataFrame:
    """(qid, id, score): sum of idf times length-normalised term frequency over shared tokens.

    Only postings of question tokens are shuffled: documents are cut to them before anything is grouped.
    """
    asked = question_tokens(questions, q_id, q_text)
    wanted = asked.select("token").distinct()
    rows = documents.where(F.col(doc_text).isNotNull()).select(F.col(doc_id).alias("id"), tx.tokens(F.col(doc_text)).alias("ts"))
    pieces = rows.where(F.size("ts") > 0).select("id", F.size("ts").alias("len"), F.explode("ts").alias("token")).join(wanted, "token", "left_semi")
    # statistics and scores both need the postings: texts are cut into tokens once
    tf = storage.materialise(pieces.groupBy("token", "id").agg((F.count(F.lit(1)) / F.first("len")).alias("tf")), "postings")
    total = documents.where(F.col(doc_text).isNotNull()).agg(F.count(F.lit(1)).alias("total"))
    stats = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    weighted = with_total(stats, total).select("token", idf(F.col("df"), F.col("total")).alias("idf"))
    return tf.join(weighted.join(asked, "token"), "token").groupBy("qid", "id").agg(F.sum(F.col("idf") * F.col("tf")).alias("score"))


def metadata_filter(documents: DataFrame, years: tuple[int, ...] = (), types: tuple[str, ...] = (), year: str = "year", kind: str = "content_type") -> DataFrame:
    """Documents of any of the years and of any of the types; an empty list asks for nothing. Nulls meet no list.

    Put before both lists of a hybrid search; the conditions reach the scan.
    """
    if years:
        documents = documents.where(F.col(year).isin(*years))
    return documents.where(F.col(kind).isin(*types)) if types else documents


def term_ids(frequencies: DataFrame) -> DataFrame:
    """(id, term, tf) of (id, token, tf): stored sparse vectors, with tokens as CRC-32 ids; tokens of one id are merged."""
    return frequencies.groupBy("id", tx.token_id(F.col("token")).alias("term")).agg(F.sum("tf").alias("tf"))


def top(scores: DataFrame, k: int, group: str = "qid", item: str = "id") -> DataFrame:
    """The ``k`` best of each group with ``rank`` from 1; scores equal to nine digits are ordered by id."""
    order = Window.partitionBy(group).orderBy(F.desc(F.round("score", 9)), item)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


_SLICE = 1024


def _largest(ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best of each row; scores equal to nine digits are ordered by id."""
    if score.shape[1] > k:
        # all that reach the k-th score stay until ids have decided between equal ones
        shown = np.round(score, 9)
        least = np.partition(shown, -k, axis=1)[:, -k]
        width = int((shown >= least[:, None]).sum(axis=1).max())
        some = np.argpartition(-shown, width - 1, axis=1)[:, :width] if width < score.shape[1] else np.broadcast_to(np.arange(score.shape[1]), score.shape)
        ids, score = np.take_along_axis(ids, some, axis=1), np.take_along_axis(score, some, axis=1)
    by = np.lexsort((ids, -np.round(score, 9)), axis=1)[:, :k]
    return np.take_along_axis(ids, by, axis=1), np.take_along_axis(score, by, axis=1)


def dense_top(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", cfg: SearchConfig = SearchConfig()) -> DataFrame:
    """(qid, id, score, rank): exact cosine neighbours of each query (columns ``qid`` and ``embedding``).

    Each batch of vectors meets the block of queries in matrix products; a task keeps one running list of the ``k`` best of
    each query and emits it once, so only k rows per query and task are shuffled. Null, empty and zero vectors match nothing.
    """
    found = None
    wanted = queries.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).select("qid", F.col("embedding").cast("array<double>").alias("v"))
    passes = max(1, -(-wanted.count() // cfg.block))
    rows = vectors.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    for n in range(passes):
        part = wanted if passes == 1 else wanted.where(F.pmod(F.xxhash64("qid"), F.lit(passes)) == n)
        got = part.orderBy("qid").toArrow()
        if not got.num_rows:
            continue
        block = vectors.sparkSession.sparkContext.broadcast((got.column("qid").to_numpy(), np.array(got.column("v").to_pylist())))

        def nearest(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            qids, q = block.value
            q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
            best_id, best = np.zeros((len(q), 0), dtype=np.int64), np.zeros((len(q), 0))
            for batch in batches:
                ids = batch.column(0).to_numpy()
                lens = np.diff(batch.column(1).offsets.to_numpy())
                fit = np.flatnonzero(lens == q.shape[1])
                m = np.array(batch.column(1).take(pa.array(fit)).flatten()).reshape(-1, q.shape[1])
                norm = np.linalg.norm(m, axis=1)
                good = norm > 0
                ids, m = ids[fit][good], m[good] / norm[good, None]
                for at in range(0, len(ids), _SLICE):
                    part = ids[at : at + _SLICE]
                    score = np.concatenate((best, q @ m[at : at + _SLICE].T), axis=1)
                    of = np.concatenate((best_id, np.broadcast_to(part, (len(q), len(part)))), axis=1)
                    best_id, best = _largest(of, score, k)
            rows_, cols = np.nonzero(np.ones(best.shape, dtype=bool))
            yield pa.RecordBatch.from_arrays([pa.array(qids[rows_]), pa.array(best_id[rows_, cols]), pa.array(best[rows_, cols])], ["qid", "id", "score"])

        now = rows.mapInArrow(nearest, "qid long, id long, score double")
        found = now if found is None else found.unionByName(now)
    if found is None:
        found = rows.select(F.lit(None).cast("long").alias("qid"), "id", F.lit(None).cast("double").alias("score")).limit(0)
    return top(found, k)


def fuse(dense: DataFrame, sparse: DataFrame, cfg: SearchConfig = SearchConfig()) -> DataFrame:
    """(qid, id, score, dense_rank, sparse_rank, rank): weighted reciprocal-rank fusion of two ranked lists.

    Equal scores keep the order in which they were first seen: the dense list's, then the sparse one's.
    """
    both = dense.select("qid", "id", F.col("rank").alias("d"), F.lit(None).cast("int").alias("s")).unionByName(sparse.select("qid", "id", F.lit(None).cast("int").alias("d"), F.col("rank").alias("s")))
    merged = both.groupBy("qid", "id").agg(F.min("d").alias("dense_rank"), F.min("s").alias("sparse_rank"))
    part = lambda w, r: F.coalesce(F.lit(w) / (F.lit(cfg.rank_constant) + F.col(r)), F.lit(0.0))
    scored = merged.withColumn("score", part(cfg.dense_weight, "dense_rank") + part(cfg.sparse_weight, "sparse_rank"))
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 12)), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cfg.fused)


def hydrate(ranked: DataFrame, documents: DataFrame, id_col: str, *columns: str) -> DataFrame:
    """Ranked ids with their documents' columns; ids without a document are dropped, the first row of a repeated id holds."""
    wanted = ranked.select("id").distinct()
    rows = documents.select(F.col(id_col).alias("id"), *columns).join(wanted, "id", "left_semi").dropDuplicates(["id"])
    return ranked.join(rows, "id")


def overlap_score(question: Column, text: Column) -> Column:
    """Share of the question's distinct tokens that the text holds, 0 for nulls: the default reranker and grader."""
    asked = F.array_distinct(tx.tokens(question))
    shared = F.size(F.array_intersect(asked, tx.tokens(text)))
    return F.coalesce(F.when(F.size(asked) > 0, shared / F.size(asked)), F.lit(0.0))


def rerank(candidates: DataFrame, score: Column, cfg: SearchConfig = SearchConfig()) -> DataFrame:
    """The best ``cfg.reranked`` of each question by a scorer; equal scores keep the fused order."""
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("rerank_score", 9)), "rank")
    return candidates.withColumn("rerank_score", score).withColumn("rerank_rank", F.row_number().over(order)).where(F.col("rerank_rank") <= cfg.reranked)


def source_filter(documents: DataFrame, question_type: Column, allowed: DataFrame, source_col: str = "source") -> DataFrame:
    """Documents that questions of a type may use: ``advice`` only the allowed sources, unless there are none."""
    names = allowed.select(F.col("source").alias("__source")).distinct()
    marked = documents.join(names, F.col(source_col) == F.col("__source"), "left")
    return marked.where((question_type != "advice") | F.col("__source").isNotNull()).drop("__source")
