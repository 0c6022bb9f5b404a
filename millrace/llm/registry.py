"""Registered corpus queries: name -> function of (spark, directory)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import incremental_dedup, leakage, main_content, mixing, quality, repeated_lines, scan_repair, splitting


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rejected record with the accepted one it repeats."""
    return incremental_dedup.duplicates(_table(spark, sf_dir, "web_records"))


def p1_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every accepted record of every batch; records without text are accepted."""
    records = _table(spark, sf_dir, "web_records")
    gone = incremental_dedup.duplicates(records).select(F.col("record_id_b").alias("record_id"))
    return records.select("record_id", "batch_no").join(gone, "record_id", "left_anti")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each occurrence of a line that is excessive within its source."""
    return repeated_lines.occurrences(_table(spark, sf_dir, "web_records"))


def p2_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every article without the lines that are excessive within its source."""
    records = _table(spark, sf_dir, "web_records").select("record_id", "source_id", "page_content")
    return repeated_lines.without_repeated_lines(records).select("record_id", "page_content")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that show text outside the main body of their page."""
    return main_content.furniture(_table(spark, sf_dir, "page_captures"))


def p3_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main body of every page."""
    return main_content.extract(_table(spark, sf_dir, "page_captures"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that the splitter had to cut."""
    return splitting.oversized(_table(spark, sf_dir, "page_records"), _table(spark, sf_dir, "chunk_limits"))


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all pages."""
    return splitting.split_oversized(_table(spark, sf_dir, "page_records"), _table(spark, sf_dir, "chunk_limits"))


def p4_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each page with text: whether it was cut, its pieces keep the limit, share the overlap asked for and together give the text."""
    records, limits = _table(spark, sf_dir, "page_records").select("record_id", "content_type", "page_content"), _table(spark, sf_dir, "chunk_limits")
    pieces = splitting.split_oversized(records, limits).groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("piece_no", "start", "end", "piece"))).alias("ps"))
    rows = splitting.with_limits(records, limits).join(pieces, "record_id")
    others = F.slice("ps", 2, F.greatest(F.lit(1), F.size("ps")))
    start = F.struct(F.element_at("ps", 1)["piece"].alias("text"), F.element_at("ps", 1)["end"].alias("end"), F.lit(True).alias("ok"))
    joined = F.aggregate(
        others,
        start,
        lambda done, p: F.struct(F.concat(done["text"], F.substring(p["piece"], done["end"] - p["start"] + 1, F.length(p["piece"]))).alias("text"), p["end"].alias("end"), (done["ok"] & (done["end"] - p["start"] == F.col("__limit.overlap_chars"))).alias("ok")),
    )
    checked = rows.withColumn("joined", joined)
    within = F.forall("ps", lambda p: F.length(p["piece"]) <= F.col("__limit.max_chars"))
    return checked.select("record_id", (F.size("ps") > 1).alias("cut"), within.alias("within"), F.col("joined.ok").alias("overlaps"), (F.col("joined.text") == F.col("page_content")).alias("whole"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of pages with broken or misread words, running headers and page numbers."""
    return scan_repair.defects(_table(spark, sf_dir, "page_records"))


def p5_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's text as continuous paragraphs."""
    return scan_repair.repaired(_table(spark, sf_dir, "page_records"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold an evaluation item's passage, whole or in part."""
    return leakage.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "golden_questions")).select("doc_id", "item_id")


def p6_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold twelve consecutive words of an item's passage."""
    found = leakage.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "golden_questions"))
    return found.where("exact").select("doc_id", "item_id")


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of every mix with their repeats."""
    return mixing.mix(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_targets"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that every mix reaches."""
    return mixing.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are for the most part no prose."""
    return quality.no_prose(_table(spark, sf_dir, "documents"))


def p8_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality statistics and label shares of every document."""
    return quality.statistics(_table(spark, sf_dir, "documents"))


def p8_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters and words of every document."""
    return quality.statistics(_table(spark, sf_dir, "documents")).select("doc_id", "n_chars", "n_words")


QUERIES: dict = {
    "p1_found": p1_found,
    "p1_accepted": p1_accepted,
    "p2_found": p2_found,
    "p2_clean": p2_clean,
    "p3_found": p3_found,
    "p3_main": p3_main,
    "p4_found": p4_found,
    "p4_pieces": p4_pieces,
    "p4_checks": p4_checks,
    "p5_found": p5_found,
    "p5_repaired": p5_repaired,
    "p6_found": p6_found,
    "p6_phrases": p6_phrases,
    "p7_mix": p7_mix,
    "p7_report": p7_report,
    "p8_found": p8_found,
    "p8_statistics": p8_statistics,
    "p8_counts": p8_counts,
}
