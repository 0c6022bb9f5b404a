"""Table functions for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from millrace.operators.chunking import split_text


class _Chunks:
    def eval(self, text: str, size: int, overlap: int):
        pieces = [] if text is None else split_text(text, size, overlap)
        for i, piece in enumerate(pieces):
            yield i, len(pieces), piece


def register(spark: SparkSession) -> None:
    """``chunk_text(text, size, overlap)`` -> (chunk_index, chunk_total, chunk), for ``LATERAL`` joins in SQL."""
    spark.udtf.register("chunk_text", udtf(_Chunks, returnType="chunk_index int, chunk_total int, chunk string"))
