"""Recursive text chunks with overlap, their hashes, and deduplication against stored ones."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as tx

SEPARATORS = ("\n\n", "\n", ". ", " ")


@dataclass(frozen=True)
class ChunkConfig:
    """Sizes in characters; ``long_types`` get the larger ones."""

    size: int = 512
    overlap: int = 64
    long_size: int = 1024
    long_overlap: int = 128
    long_types: tuple[str, ...] = ("legal_text",)


def _merge(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Join neighbouring pieces up to ``size``; each chunk begins with up to ``overlap`` characters of the last one's pieces."""
    chunks, window, total = [], [], 0
    for piece in pieces:
        if window and total + len(piece) > size:
            chunks.append("".join(window).strip())
            while window and (total > overlap or total + len(piece) > size):
                total -= len(window.pop(0))
        window.append(piece)
        total += len(piece)
    chunks.append("".join(window).strip())
    return [c for c in chunks if c]


def split_text(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters, cut at the first separator that occurs; what holds none stays whole."""
    at = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    separator, finer = separators[at], separators[at + 1 :]
    head, *tail = text.split(separator)
    out, small = [], []
    for piece in [p for p in [head, *(separator + t for t in tail)] if p]:
        if len(piece) < size:
            small.append(piece)
            continue
        out += _merge(small, size, overlap)
        small = []
        out += split_text(piece, size, overlap, finer) if finer else [piece]
    return out + _merge(small, size, overlap)


def chunk(documents: DataFrame, text_col: str = "page_content", type_col: str | None = "content_type", cfg: ChunkConfig = ChunkConfig()) -> DataFrame:
    """One row per chunk: the row's columns with ``text_col`` replaced by the chunk, ``chunk_index`` from 0 and ``chunk_total``.

    Null and blank texts give no chunk; every row is chunked for itself, so indexes begin anew for each page of a file.
    """
    rows = documents.drop("chunk_index", "chunk_total")
    kind = F.col(type_col) if type_col else F.lit(None).cast("string")
    long_ = F.coalesce(kind.isin(*cfg.long_types), F.lit(False))
    names = [c for c in rows.columns if c != text_col]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, longs = batch.column("__text").to_pylist(), batch.column("__long").to_pylist()
            lists = [[] if t is None else split_text(t, cfg.long_size, cfg.long_overlap) if big else split_text(t, cfg.size, cfg.overlap) for t, big in zip(texts, longs)]
            at = pa.array([i for i, c in enumerate(lists) for _ in c], pa.int64())
            cols = [batch.column(n).take(at) for n in names]
            cols += [pa.array([x for c in lists for x in c], pa.string()), pa.array([i for c in lists for i in range(len(c))], pa.int32()), pa.array([len(c) for c in lists for _ in c], pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, [*names, text_col, "chunk_index", "chunk_total"])

    shaped = rows.select(*names, F.col(text_col).alias("__text"), long_.alias("__long"))
    schema = rows.select(*names, F.col(text_col).cast("string").alias(text_col), F.lit(0).alias("chunk_index"), F.lit(0).alias("chunk_total")).schema
    return shaped.mapInArrow(cut, schema)


def with_hash(chunks: DataFrame, url_col: str = "url", text_col: str = "page_content") -> DataFrame:
    """``content_hash`` of URL, index and the first 100 characters."""
    return chunks.withColumn("content_hash", tx.chunk_hash(F.col(url_col), F.col("chunk_index"), F.col(text_col)))


def new_chunks(chunks: DataFrame, stored: DataFrame, within_batch: bool = True) -> DataFrame:
    """Chunks whose hash isn't stored yet; with ``within_batch`` equal hashes of the batch are kept once."""
    fresh = chunks.join(stored.select("content_hash"), "content_hash", "left_anti")
    return fresh.dropDuplicates(["content_hash"]) if within_batch else fresh


def dedup_counts(chunks: DataFrame, stored: DataFrame, source_col: str = "source") -> DataFrame:
    """New and duplicate chunks per source."""
    known = stored.select("content_hash").distinct().withColumn("__known", F.lit(True))
    return (
        chunks.join(known, "content_hash", "left")
        .groupBy(F.coalesce(F.col(source_col), F.lit("unknown")).alias("source"))
        .agg(F.count_if(F.col("__known").isNull()).alias("new_chunks"), F.count_if(F.col("__known").isNotNull()).alias("duplicate_chunks"))
    )
