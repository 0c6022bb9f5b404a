"""A stored keyword index: postings and token statistics, rebuilt or extended without touching the documents' vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import search


class KeywordIndex:
    """Parquet tables ``postings`` (token, id, tf; a folder for each hash bucket of the tokens) and ``documents`` (id).

    A search reads the folders of the questions' tokens only, and within them is ordered by token.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("token"), F.lit(self.buckets)).cast("int")

    def postings(self, tokens: DataFrame) -> DataFrame:
        """The postings of some distinct tokens."""
        wanted = [r.bucket for r in tokens.select(self._bucket().alias("bucket")).distinct().collect()]  # at most self.buckets
        stored = self.spark.read.schema("token string, id long, tf double, bucket int").parquet(f"{self.path}/postings")
        return stored.where(F.col("bucket").isin(wanted)).drop("bucket").join(tokens, "token", "left_semi")

    def rebuild(self, documents: DataFrame, id_col: str, text_col: str) -> KeywordIndex:
        """Recompute all postings; documents without text keep their place in the count of documents only if not null."""
        self._write(documents, id_col, text_col, "overwrite")
        return self

    def append(self, documents: DataFrame, id_col: str, text_col: str) -> KeywordIndex:
        """Add documents whose id the index doesn't hold."""
        known = self.spark.read.parquet(f"{self.path}/documents")
        self._write(documents.join(known, documents[id_col] == known["id"], "left_anti"), id_col, text_col, "append")
        return self

    def _write(self, documents: DataFrame, id_col: str, text_col: str, mode: str) -> None:
        rows = documents.where(F.col(text_col).isNotNull()).dropDuplicates([id_col])
        tf = search.term_frequencies(rows, id_col, text_col).select("token", "id", "tf")
        placed = tf.withColumn("id", F.col("id").cast("long")).withColumn("bucket", self._bucket())
        # a bucket with a frequent token is cut by document as well
        placed.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(4))).sortWithinPartitions("bucket", "token", "id").write.mode(mode).partitionBy("bucket").parquet(f"{self.path}/postings")
        rows.select(F.col(id_col).alias("id")).write.mode(mode).parquet(f"{self.path}/documents")

    def search(self, questions: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
        """(qid, id, score, rank): the statistics are taken from the postings as they are, so appends need no upkeep."""
        asked = search.question_tokens(questions, id_col, text_col)
        tf = self.postings(asked.select("token").distinct())
        total = self.spark.read.parquet(f"{self.path}/documents").agg(F.count(F.lit(1)).alias("total"))
        stats = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
        weighted = search.with_total(stats, total).select("token", search.idf(F.col("df"), F.col("total")).alias("idf"))
        scores = tf.join(weighted.join(asked, "token"), "token").groupBy("qid", "id").agg(F.sum(F.col("idf") * F.col("tf")).alias("score"))
        return search.top(scores, k)
