"""Retrieval metrics of ranked lists against known answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Per question: recall@k, precision@k and reciprocal rank. Questions without relevant documents are left out."""
    rel = relevant.select("qid", "id").distinct()
    hits = ranked.where(F.col("rank") <= k).select("qid", "id", "rank").join(rel, ["qid", "id"])
    found = hits.groupBy("qid").agg(F.count(F.lit(1)).alias("hits"), F.min("rank").alias("first"))
    return (
        rel.groupBy("qid")
        .agg(F.count(F.lit(1)).alias("relevant"))
        .join(found, "qid", "left")
        .select(
            "qid",
            "relevant",
            (F.coalesce("hits", F.lit(0)) / F.col("relevant")).alias("recall"),
            (F.coalesce("hits", F.lit(0)) / F.lit(k)).alias("precision"),
            F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
        )
    )


def mean_metrics(metrics: DataFrame, least_recall: float = 0.8, least_precision: float = 0.75) -> DataFrame:
    """Means over all questions and whether both thresholds are met; one row, also for no questions."""
    row = metrics.agg(F.count(F.lit(1)).alias("questions"), F.avg("recall").alias("recall"), F.avg("precision").alias("precision"), F.avg("reciprocal_rank").alias("mrr"))
    return row.withColumn("passed", F.coalesce((F.col("recall") >= least_recall) & (F.col("precision") >= least_precision), F.lit(False)))


def answer_checks(answers: DataFrame, expected: DataFrame) -> DataFrame:
    """Per question: the answer holds all expected strings, none of the forbidden ones, and comes from an expected domain."""
    low = F.lower(F.coalesce("answer", F.lit("")))
    has = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda s: F.contains(low, F.lower(s)))
    return answers.join(expected, "qid").select(
        "qid",
        F.forall(has("expected_answer_contains"), lambda x: x).alias("contains_all"),
        (~F.exists(has("should_not_contain"), lambda x: x)).alias("contains_none"),
        F.coalesce(F.array_contains("expected_source_domains", F.col("source")), F.lit(False)).alias("domain_hit"),
    )
