"""Lines repeated across one source's documents (problem 2).

Documents are numbered densely, those of a source next to each other, and every line's documents are kept as a compressed
bitmap per source: numbers are cut into containers of 32768; a container is a sorted array of 16-bit offsets while it is
small and a fixed 4 KB bit field once that is smaller. Bitmaps are stored per written form of a line, those of the forms
with the same letters are united by OR, the exact cardinalities are held against the thresholds, the bitmaps of the excessive
lines are stored, and a line is deleted where its bitmap holds the document.

The container is also what splits a hot line or source: however many documents carry it, one group holds at most
32768 of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.storage import materialise

CONTAINER_BITS = 15
#: An array of 16-bit offsets is as large as the bit field at this many entries.
DENSE_FROM = 1 << (CONTAINER_BITS - 4)


@dataclass(frozen=True)
class RepeatedLines:
    """A line is excessive in a source when at least ``min_records`` and ``min_share`` of its records hold it."""

    min_records: int = 5
    min_share: float = 0.05
    id_col: str = "record_id"
    source_col: str = "source_id"
    text_col: str = "page_content"


def line_key(line: Column) -> Column:
    """The letters of a line, in lower case."""
    return F.regexp_replace(F.lower(line), r"[^\p{L}]+", "")


def lines(records: DataFrame, cfg: RepeatedLines) -> DataFrame:
    """A written table of the lines that have letters: ``rid``, the document's number as ``container`` and ``low``, source,
    line_no (from 0), key hashes ``k1``/``k2`` and the form's hash ``form``.

    Rows with a null id, source or text have no lines. A ``\\r`` at the end of a line is no content.
    """
    rows = records.select(F.col(cfg.id_col).alias("rid"), F.col(cfg.source_col).alias("src"), F.col(cfg.text_col).alias("text")).where("rid is not null and src is not null and text is not null")
    # dense within each task, and written with the lines, so that it is drawn once
    numbered = rows.sortWithinPartitions("src").withColumn("doc", F.monotonically_increasing_id())
    split = numbered.select("rid", "src", "doc", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    keyed = split.select("rid", "src", "doc", "line_no", F.rtrim("line").alias("line"), line_key(F.col("line")).alias("key")).where("key <> ''")
    container, low = F.shiftright("doc", CONTAINER_BITS), F.col("doc").bitwiseAND((1 << CONTAINER_BITS) - 1).cast("smallint")
    return materialise(keyed.select("rid", "src", container.alias("container"), low.alias("low"), "line_no", F.xxhash64("key").alias("k1"), F.hash("key").alias("k2"), F.xxhash64("line").alias("form")), "lines")


LINE = ["src", "k1", "k2"]


def _bits(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Bit fields of rows that hold an offset each."""
    return rows.groupBy(*keys).agg(F.bitmap_construct_agg(F.col("low").cast("long")).alias("bits"))


def line_bitmaps(line_rows: DataFrame) -> DataFrame:
    """The stored bitmaps (src, k1, k2, form, container) of the documents with each written form: ``few`` or ``bits`` is null."""
    keys = [*LINE, "form", "container"]
    counts = line_rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    large = counts.where(F.col("n") > DENSE_FROM).drop("n")
    few = line_rows.join(large, keys, "left_anti").groupBy(*keys).agg(F.array_sort(F.collect_set("low")).alias("few"))
    bits = _bits(line_rows.join(large, keys, "left_semi"), keys)
    return materialise(few.withColumn("bits", F.lit(None).cast("binary")).unionByName(bits.withColumn("few", F.lit(None).cast("array<smallint>"))), "bitmaps")


def united(bitmaps: DataFrame) -> DataFrame:
    """The OR of the bitmaps of all forms of a line: (src, k1, k2, container) -> ``few`` or ``bits``, and the cardinality ``docs``."""
    keys = [*LINE, "container"]
    dense = bitmaps.groupBy(*keys).agg(F.coalesce(F.sum(F.size("few")), F.lit(0)).alias("n"), F.count("bits").alias("fields")).where(f"fields > 0 or n > {DENSE_FROM}").select(*keys)
    large = bitmaps.join(dense, keys, "left_semi")
    fields = large.where("bits is not null").select(*keys, "bits").unionByName(_bits(large.select(*keys, F.explode("few").alias("low")), keys))
    bits = fields.groupBy(*keys).agg(F.bitmap_or_agg("bits").alias("bits")).select(*keys, F.lit(None).cast("array<smallint>").alias("few"), "bits", F.bitmap_count("bits").alias("docs"))
    small = bitmaps.join(dense, keys, "left_anti").groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("few")))).alias("few"))
    return small.select(*keys, "few", F.lit(None).cast("binary").alias("bits"), F.size("few").cast("long").alias("docs")).unionByName(bits)


def excessive(records: DataFrame, line_rows: DataFrame, cfg: RepeatedLines = RepeatedLines()) -> DataFrame:
    """The stored bitmaps of the excessive lines: (src, k1, k2, container, few, bits).

    Cardinalities are exact and cover all records. An empty table has no excessive line.
    """
    per_source = (
        records.where(F.col(cfg.source_col).isNotNull() & F.col(cfg.text_col).isNotNull())
        .groupBy(F.col(cfg.source_col).alias("src"))
        .agg(F.count(F.lit(1)).alias("of"))
    )
    maps = united(line_bitmaps(line_rows))
    # the cardinalities of a line's containers are summed beside its bitmaps, which are computed once and stay apart
    counted = maps.withColumn("all", F.sum("docs").over(Window.partitionBy("src", "k1", "k2"))).where(F.col("all") >= cfg.min_records)
    over = counted.join(per_source, "src").where(F.col("all") >= F.lit(cfg.min_share) * F.col("of"))
    return materialise(over.select("src", "k1", "k2", "container", "few", "bits"), "excessive")


def _holds(low: Column) -> Column:
    """Whether the bitmap beside it holds the offset."""
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.shiftright(low, 3) + 1, F.lit(1))), 16, 10).cast("int")
    in_bits = F.getbit(byte, low.bitwiseAND(7).cast("int")) == 1
    return F.when(F.col("bits").isNull(), F.array_contains("few", low.cast("smallint"))).otherwise(in_bits)


def occurrences(records: DataFrame, cfg: RepeatedLines = RepeatedLines()) -> DataFrame:
    """Each occurrence of an excessive line: (id, line_no), found by looking its document up in the line's bitmap."""
    line_rows = lines(records, cfg)
    hit = line_rows.drop("form").join(excessive(records, line_rows, cfg), [*LINE, "container"]).where(_holds(F.col("low").cast("int")))
    return hit.select(F.col("rid").alias(cfg.id_col), "line_no")


def without_repeated_lines(records: DataFrame, cfg: RepeatedLines = RepeatedLines()) -> DataFrame:
    """Every record with its excessive lines removed from the text; other columns and null texts stay as they are.

    Rows that repeat an id are treated alike. A text that loses all its lines becomes empty.
    """
    drop = occurrences(records, cfg).groupBy(F.col(cfg.id_col).alias("__id")).agg(F.collect_set("line_no").alias("__drop"))
    kept = F.array_join(F.filter(F.split(cfg.text_col, "\n"), lambda line, i: ~F.array_contains("__drop", i)), "\n")
    joined = records.join(drop, F.col(cfg.id_col) == F.col("__id"), "left")
    return joined.withColumn(cfg.text_col, F.when(F.col("__drop").isNull(), F.col(cfg.text_col)).otherwise(kept)).select(*records.columns)
