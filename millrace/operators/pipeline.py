"""Composed operators: which pages of a site to fetch next, and what an ingest run adds to a store of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import text as tx
from millrace.operators import chunking, inventory
from millrace.sources import records as src
from millrace.sources import storage


def discovered(pages: DataFrame, html_col: str = "page_content") -> DataFrame:
    """(source_id, page, url): the links of fetched pages, absolute, once for each source and page."""
    links = pages.select("source_id", F.col("url").alias("page"), F.explode(tx.links(F.col(html_col))).alias("link"))
    return links.select("source_id", "page", tx.absolute(F.col("page"), F.col("link")).alias("url")).distinct()


def to_fetch(candidates: DataFrame, seen: DataFrame, skip: list[str], limit: int = 0) -> DataFrame:
    """(source_id, url, n): candidates (source_id, page, url) on their page's host that hold no skipped pattern and weren't seen.

    Each URL of a source once, numbered from 1 in the order of URLs; ``limit`` of each source, 0 for all. Null URLs and
    candidates without a source are left out.
    """
    wanted = candidates.where(F.col("source_id").isNotNull() & tx.same_authority(F.col("page"), F.col("url")))
    for pattern in skip:
        wanted = wanted.where(~F.contains(F.col("url"), F.lit(pattern)))
    fresh = inventory.unseen(wanted.select("source_id", "url").distinct(), seen)
    ranked = fresh.withColumn("n", F.row_number().over(Window.partitionBy("source_id").orderBy("url")))
    return (ranked.where(F.col("n") <= limit) if limit else ranked).select("source_id", "url", "n")


def about_topics(records: DataFrame, title_col: str = "title", topics_col: str = "topics") -> DataFrame:
    """Records whose title names one of their topics; records without topics pass."""
    named = tx.contains_any(F.col(title_col), F.col(topics_col))
    return records.where((F.coalesce(F.size(topics_col), F.lit(0)) <= 0) | F.coalesce(named, F.lit(False)))


def ingest(records: DataFrame, store: str, dry_run: bool = False, least: int = 1, text_col: str = "page_content", cfg: chunking.ChunkConfig = chunking.ChunkConfig()) -> DataFrame:
    """Chunk records, leave out chunks that the store holds, append the rest; per source ``chunks``, ``new_chunks`` and ``duplicate_chunks``.

    Texts with fewer than ``least`` characters are left out. A dry run writes nothing and gives the same counts. Of equal
    chunks within the run one is new. An empty or missing store holds nothing.
    """
    long_enough = records.where(F.length(tx.strip(F.col(text_col))) >= least)
    chunks = chunking.with_hash(chunking.chunk(long_enough, text_col, cfg=cfg), text_col=text_col)
    spark = records.sparkSession
    known = spark.read.parquet(store).select("content_hash").distinct() if storage.exists(spark, store) else spark.createDataFrame([], "content_hash string")
    counted = chunks.groupBy("content_hash", F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    first = counted.withColumn("first", F.row_number().over(Window.partitionBy("content_hash").orderBy("source")) == 1)
    held = first.join(known.withColumn("known", F.lit(True)), "content_hash", "left")
    fresh = F.when(F.col("known").isNull() & F.col("first"), 1).otherwise(0)
    report = held.groupBy("source").agg(F.sum("n").alias("chunks"), F.sum(fresh).alias("new_chunks"), F.sum(F.col("n") - fresh).alias("duplicate_chunks"))
    if not dry_run:
        report = storage.materialise(report, "ingested")  # counted before the store changes
        src.append_new(chunks, store)
    return report
