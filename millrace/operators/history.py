"""Last turns of keyed threads, and the blocks of text built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def last_rows(rows: DataFrame, key: str, order: str, n: int = 10) -> DataFrame:
    """The last ``n`` rows of each key by ``order``, with ``back`` counting from 1 for the latest."""
    return rows.withColumn("back", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("back") <= n)


def tail(items: Column, n: int) -> Column:
    """The last ``n`` items of an array, all of a shorter one."""
    return F.slice(items, F.greatest(F.size(items) - n + 1, F.lit(1)), F.lit(n))


def context_block(position: Column, source: Column, author: Column, date: Column, title: Column, text: Column) -> Column:
    """``[i] source | author | date | title`` and the beginning of the text; missing parts are ``?``."""
    known = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("?"))
    head = F.concat_ws(" | ", F.concat(F.lit("["), position.cast("string"), F.lit("] "), known(source)), known(author), known(date), F.substring(known(title), 1, 60))
    return F.concat(head, F.lit("\n"), F.substring(F.coalesce(text, F.lit("")), 1, 800))


def shortened(text: Column, most: int, mark: str = "…") -> Column:
    """Text cut to ``most`` characters with a mark where something is missing."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)
