"""Splitting oversized texts at natural boundaries (problem 4).

Content-defined chunking: a rolling hash over the last ``WINDOW`` characters marks landmarks that depend on the
text around them only. A cut is the first landmark past a piece's least size, moved to the nearest natural boundary
(paragraph or line, else sentence, else word) within the piece's bounds. An edit therefore moves the cuts near it, and
the next landmark that both versions share brings the later pieces back to the same places.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 24
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LINE = re.compile(r"\n+[^\S\n]*")
_SENTENCE = re.compile(r"[.!?…][\"'”»)\]]*\s+")
_SPACE = re.compile(r"\s+")
PIECE = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def rolling_hash(text: str) -> np.ndarray:
    """For each position the hash of the ``WINDOW`` characters before it, as unsigned 64-bit numbers."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    total = np.zeros(len(codes) + 1, dtype=np.uint64)
    factor = np.uint64(1)
    with np.errstate(over="ignore"):
        for back in range(min(WINDOW, len(codes))):
            total[back + 1 :] += codes[: len(codes) - back] * factor
            factor = factor * _BASE
        total ^= total >> np.uint64(31)
        total *= np.uint64(0xBF58476D1CE4E5B9)
        total ^= total >> np.uint64(29)
    return total


def boundaries(text: str) -> list[np.ndarray]:
    """Sorted positions at which a piece may start: after line breaks, after sentences, after any white space."""
    return [np.fromiter((m.end() for m in rule.finditer(text)), dtype=np.int64) for rule in (_LINE, _SENTENCE, _SPACE)]


def _nearest(places: np.ndarray, low: int, high: int, to: int) -> int | None:
    """The place in [low, high] nearest to ``to``; the earlier of two equally near ones."""
    a, b = np.searchsorted(places, low), np.searchsorted(places, high, side="right")
    if a >= b:
        return None
    inside = places[a:b]
    return int(inside[np.argmin(np.abs(inside - to))])


def cuts(text: str, max_chars: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of ``text``: none longer than ``max_chars``; each starts ``overlap`` characters before the last one's end."""
    size = len(text)
    if size <= max_chars:
        return [(0, size)]
    overlap = max(0, min(overlap, max_chars - 1))
    step = max_chars - overlap  # new characters a later piece may add
    least = max(1, step // 2)
    marks = rolling_hash(text)
    every = np.uint64(max(2, step // 4))
    landmarks = np.flatnonzero(marks % every == 0)
    natural = boundaries(text)
    pieces, start, new = [], 0, 0  # new: where the piece's own characters begin
    while size - start > max_chars:
        low, high = new + least, start + max_chars
        at = np.searchsorted(landmarks, low)
        if at < len(landmarks) and landmarks[at] <= high:
            mark = int(landmarks[at])
        else:  # still a property of the content: the largest hash between the bounds
            mark = low + int(np.argmax(marks[low : high + 1]))
        cut = next((c for kind in natural if (c := _nearest(kind, low, high, mark)) is not None), mark)
        pieces.append((start, cut))
        start, new = cut - overlap, cut
    pieces.append((start, size))
    return pieces


def _limit_columns(limits: DataFrame) -> DataFrame:
    kind = F.lower(F.trim(F.regexp_replace("content_type", r"^\s+|\s+$", "")))
    return (
        limits.where("content_type is not null and max_chars is not null and max_chars > 0")
        .groupBy(kind.alias("__kind"))
        .agg(F.min(F.struct("max_chars", F.coalesce("overlap_chars", F.lit(0)).alias("overlap_chars"))).alias("__limit"))
    )


def with_limits(records: DataFrame, limits: DataFrame, type_col: str = "content_type", default: str = "default") -> DataFrame:
    """``records`` with ``__limit`` (max_chars, overlap_chars): by content type without case and outer spaces, else of ``default``.

    Of several rows for a type the smallest limit holds. Without a default row the limit of other types is null.
    """
    kind = F.lower(F.regexp_replace(F.coalesce(F.col(type_col), F.lit(default)), r"^\s+|\s+$", ""))
    by_type = _limit_columns(limits)
    fallback = by_type.where(F.col("__kind") == default).select(F.col("__kind").alias("__else"), F.col("__limit").alias("__other"))
    return (
        records.withColumn("__type", kind)
        .join(by_type, F.col("__type") == F.col("__kind"), "left")
        .withColumn("__miss", F.when(F.col("__kind").isNull(), F.lit(default)))
        .join(fallback, F.col("__miss") == F.col("__else"), "left")
        .withColumn("__limit", F.coalesce("__limit", "__other"))
        .drop("__type", "__kind", "__miss", "__else", "__other")
    )


@F.pandas_udf(PIECE)
def _cuts(text: pd.Series, max_chars: pd.Series, overlap: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else [{"start": a, "end": b} for a, b in cuts(t, int(m), int(o))] for t, m, o in zip(text, max_chars, overlap)])


def piece_bounds(text: Column, limit: Column) -> Column:
    """Array of (start, end) for a text; texts within the limit never reach Python."""
    over = F.length(text) > limit["max_chars"]
    found = _cuts(F.when(over, text), F.coalesce(limit["max_chars"], F.lit(0)), F.coalesce(limit["overlap_chars"], F.lit(0)))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length(text).alias("end")))
    return F.when(text.isNotNull(), F.coalesce(found, whole))


def split_oversized(records: DataFrame, limits: DataFrame, id_col: str = "record_id", text_col: str = "page_content", type_col: str = "content_type") -> DataFrame:
    """One row per piece: id, piece_no (from 0), piece_count, start, end and ``piece``.

    A text within its limit, an empty one too, is one piece; a null text has none; rows that repeat an id are split each
    for itself. Sizes count Unicode characters of the text as stored. Neighbours share exactly ``overlap_chars``.
    """
    rows = with_limits(records.select(F.col(id_col), F.col(text_col), F.col(type_col)), limits, type_col)
    bounds = rows.withColumn("__cuts", piece_bounds(F.col(text_col), F.col("__limit")))
    return bounds.select(id_col, text_col, F.size("__cuts").alias("piece_count"), F.posexplode("__cuts").alias("piece_no", "__at")).select(
        id_col,
        "piece_no",
        "piece_count",
        F.col("__at.start").alias("start"),
        F.col("__at.end").alias("end"),
        F.substring(F.col(text_col), F.col("__at.start") + 1, F.col("__at.end") - F.col("__at.start")).alias("piece"),
    )


def oversized(records: DataFrame, limits: DataFrame, id_col: str = "record_id", text_col: str = "page_content", type_col: str = "content_type") -> DataFrame:
    """Ids of the rows that the splitter cuts into more than one piece."""
    rows = with_limits(records.select(F.col(id_col), F.col(text_col), F.col(type_col)), limits, type_col)
    return rows.where(F.size(piece_bounds(F.col(text_col), F.col("__limit"))) > 1).select(id_col)
