"""What a corpus holds: counts by source and domain, URL lookups, and sets of keys seen before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import text as tx


def source_counts(chunks: DataFrame, source_col: str = "source") -> DataFrame:
    """Rows per source, most first; null sources are ``unknown``."""
    return chunks.groupBy(F.coalesce(F.col(source_col), F.lit("unknown")).alias("source")).agg(F.count(F.lit(1)).alias("chunks")).orderBy(F.desc("chunks"), "source")


def domain_inventory(chunks: DataFrame, url_col: str = "url", source_col: str = "source") -> DataFrame:
    """Distinct URLs and rows per domain and in total (``domain`` null); the total's URLs are the sum over domains.

    The domain is the URL's authority, else the source, else ``unknown``. URLs are made distinct before the counts, so a
    domain with a third of all rows is still counted in parallel.
    """
    domain = F.coalesce(tx.netloc(F.col(url_col)), F.nullif(F.col(source_col), F.lit("")), F.lit("unknown"))
    per_url = chunks.groupBy(domain.alias("domain"), F.col(url_col).alias("u")).agg(F.count(F.lit(1)).alias("n"))
    return per_url.rollup("domain").agg(F.count("u").alias("urls"), F.sum("n").alias("chunks"))


def lookup_url(chunks: DataFrame, urls: DataFrame) -> DataFrame:
    """Rows of each asked URL (column ``asked``): those without its final slashes, or else those with one."""
    bare = F.regexp_replace("asked", "/+$", "")
    tried = urls.select("asked", F.explode(F.array(F.struct(F.lit(0).alias("way"), bare.alias("url")), F.struct(F.lit(1).alias("way"), F.concat(bare, F.lit("/")).alias("url")))).alias("t")).select("asked", "t.way", "t.url").distinct()
    hits = chunks.join(tried, "url")
    best = hits.groupBy("asked").agg(F.min("way").alias("way"))
    return hits.join(best, ["asked", "way"]).drop("way")


def unseen(records: DataFrame, seen: DataFrame, key: str = "url") -> DataFrame:
    """Records whose key isn't in the store; null keys are never known."""
    return records.join(seen.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def manifest_hosts(manifest: DataFrame) -> DataFrame:
    """Distinct hosts of a manifest's URLs, empty ones left out."""
    return manifest.select(tx.host(F.col("url")).alias("host")).where("host <> ''").distinct()


def skip_counts(records: DataFrame, patterns: list[str], topics_col: str = "topics") -> DataFrame:
    """Per source: records whose URL holds a skipped pattern, whose title names none of the topics, and those kept."""
    skipped = F.lit(False)
    for p in patterns:
        skipped = skipped | F.contains(F.col("url"), F.lit(p))
    skipped = F.coalesce(skipped, F.lit(False))
    named = F.coalesce(tx.contains_any(F.col("title"), F.col(topics_col)), F.lit(False))
    return records.groupBy("source").agg(F.count_if(skipped).alias("skipped_url"), F.count_if(~skipped & ~named).alias("skipped_title"), F.count_if(~skipped & named).alias("kept"))


def first_hit(candidates: DataFrame, group: str, priority: str) -> DataFrame:
    """The candidate of the least priority in each group (sitemap paths, link kinds, extraction levels)."""
    return candidates.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(priority))).where("__n = 1").drop("__n")


def latest(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """The last non-null value of each group."""
    return rows.where(F.col(value).isNotNull()).groupBy(group).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))


def grades(rows: DataFrame, group: str, score: str, stale: str, least: float = 0.6, stale_least: float = 0.85) -> DataFrame:
    """Mean score, whether any row is stale, and whether the group needs another try. A null score counts as 0."""
    out = rows.groupBy(group).agg(F.avg(F.coalesce(F.col(score), F.lit(0.0))).alias("avg_score"), F.coalesce(F.bool_or(stale), F.lit(False)).alias("stale"))
    return out.withColumn("retry", (F.col("avg_score") < least) | (F.col("stale") & (F.col("avg_score") < stale_least)))
