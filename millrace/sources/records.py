"""Sources and sinks: JSON lines, manifests, sitemaps and feeds, tabular rows as documents, sliding windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources.storage import exists

WEB_RECORD = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("url", "source_id", "source", "author", "title", "date")]
    + [T.StructField("year", T.IntegerType())]
    + [T.StructField(n, T.StringType()) for n in ("language", "content_type", "scraped_at", "page_content")]
    + [T.StructField("topics", T.ArrayType(T.StringType()))]
)
PAGE_RECORD = T.StructType([*WEB_RECORD.fields, T.StructField("page", T.IntegerType()), T.StructField("page_total", T.IntegerType()), T.StructField("extraction_method", T.StringType())])


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType = WEB_RECORD) -> DataFrame:
    """Records of JSON-lines files; blank, truncated and non-object lines are dropped, no file gives no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def parse_json_lines(lines: DataFrame, line_col: str, schema: T.StructType) -> DataFrame:
    """The same for lines in a column, as a stream delivers them."""
    parsed = lines.select(F.from_json(line_col, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"), F.col(line_col).alias("__line"))
    good = parsed.where(F.trim("__line").startswith("{") & F.expr("try_parse_json(__line)").isNotNull())
    return good.select("r.*")


def read_manifest(spark: SparkSession, path: str, schema: str = "url string, author string, topics array<string>, notes string") -> DataFrame:
    """Entries of a JSON array; a missing file is an empty manifest."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def append_json_lines(records: DataFrame, path: str) -> None:
    """Append records as JSON lines."""
    records.write.mode("append").json(path)


_BUCKETS = 64


def append_new(records: DataFrame, store: str, key: str = "content_hash") -> int:
    """Append rows whose key isn't in a Parquet store; gives their number. Running it twice adds nothing.

    The store has a folder for each hash bucket of the keys; only keys of the batch's buckets are read. There may be one
    writer at a time.
    """
    spark = records.sparkSession
    bucket = F.pmod(F.xxhash64(key), F.lit(_BUCKETS)).cast("int").alias("bucket")
    fresh = records.dropDuplicates([key]).select("*", bucket)
    if exists(spark, store):
        touched = [r.bucket for r in fresh.select("bucket").distinct().collect()]  # at most _BUCKETS
        known = spark.read.parquet(store).where(F.col("bucket").isin(touched)).select(key)
        fresh = fresh.join(known, key, "left_anti")
    fresh = fresh.persist()
    try:
        n = fresh.count()
        if n:
            fresh.write.mode("append").partitionBy("bucket").parquet(store)
        return n
    finally:
        fresh.unpersist()


def ensure_table(spark: SparkSession, path: str, schema: T.StructType) -> list[str]:
    """Create an empty Parquet table unless there is one; gives the columns of ``schema`` that a table there lacks or holds otherwise."""
    if not exists(spark, path):
        spark.createDataFrame([], schema).write.parquet(path)
        return []
    have = {f.name: f.dataType for f in spark.read.parquet(path).schema}
    return [f.name for f in schema if have.get(f.name) != f.dataType]


def _clean_xml(xml: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(xml, "^\\uFEFF", ""), r"(?s)<!--.*?-->", ""), r"\sxmlns(:\w+)?\s*=\s*\"[^\"]*\"", "")


def sitemap_links(xml: Column) -> Column:
    """``kind`` (index or urls) and the locations of a sitemap; a byte-order mark and comments are tolerated."""
    clean = _clean_xml(xml)
    locations = F.transform(F.regexp_extract_all(clean, F.lit(r"(?s)<loc>\s*(.*?)\s*</loc>"), F.lit(1)), lambda u: F.regexp_replace(u, "&amp;", "&"))
    return F.struct(F.when(clean.contains("<sitemapindex"), "index").otherwise("urls").alias("kind"), locations.alias("locations"))


def feed_links(xml: Column) -> Column:
    """Links of the items of an RSS feed."""
    return F.regexp_extract_all(_clean_xml(xml), F.lit(r"(?s)<item\b.*?<link>\s*(.*?)\s*</link>"), F.lit(1))


def crawl_sitemaps(documents: DataFrame, roots: DataFrame, depth: int = 3) -> DataFrame:
    """(root, url): pages listed by each root sitemap and those it refers to, down to ``depth`` levels below; cycles end.

    ``documents`` holds (url, xml) of everything fetched; at most ``depth`` + 1 joins, whatever the number of sitemaps.
    """
    parsed = documents.select(F.col("url").alias("at"), sitemap_links(F.col("xml")).alias("s")).select("at", "s.kind", F.explode("s.locations").alias("to"))
    level = roots.select(F.col("url").alias("root"), F.col("url").alias("at")).distinct()
    seen, pages = level, None
    for _ in range(depth + 1):
        step = level.join(parsed, "at")
        now = step.where("kind = 'urls'").select("root", F.col("to").alias("url"))
        pages = now if pages is None else pages.unionByName(now)
        level = step.where("kind = 'index'").select("root", F.col("to").alias("at")).distinct().join(seen, ["root", "at"], "left_anti")
        seen = seen.unionByName(level)
    return pages.distinct()


def rows_as_text(df: DataFrame, columns: list[str], out: str = "page_content") -> DataFrame:
    """Tabular rows as sentences ``column: value, column: value``; null values are left out."""
    parts = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in columns]
    return df.withColumn(out, F.concat_ws(", ", *parts))


def sliding_windows(df: DataFrame, ts_col: str, length: str, step: str) -> DataFrame:
    """One row per row and window of ``length`` that it falls into, every ``step``: ``window_start`` and ``window_end``."""
    windowed = df.withColumn("__w", F.window(F.col(ts_col).cast("timestamp"), length, step))
    return windowed.withColumn("window_start", F.col("__w.start")).withColumn("window_end", F.col("__w.end")).drop("__w")


def union_all(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All rows of several record tables under one superset of columns."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first
