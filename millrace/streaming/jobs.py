"""Structured Streaming: incremental ingestion, keyed state bounded to the last turns, windowed event counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.operators import chunking
from millrace.sources import records as src


def ingest_stream(records: DataFrame, store: str, checkpoint: str, text_col: str = "page_content", cfg: chunking.ChunkConfig = chunking.ChunkConfig()):
    """Chunk arriving records and append the chunks that the store doesn't hold; a restart repeats nothing."""

    def batch(df: DataFrame, _epoch: int) -> None:
        src.append_new(chunking.with_hash(chunking.chunk(df, text_col, cfg=cfg), text_col=text_col), store)

    return records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def thread_history(turns: DataFrame, keep: int = 10) -> DataFrame:
    """(thread, turns, history): after each batch, the last ``keep`` turns of every thread it touched, in turn order.

    ``turns``: thread long, turn long, text string. State per thread is bounded by ``keep`` whatever its length.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, kept = state.get if state.exists else (0, [])
        kept = [tuple(x) for x in kept]
        for pdf in batches:
            total += len(pdf)
            kept += list(zip(pdf["turn"].tolist(), pdf["text"].tolist()))
            kept = sorted(kept, key=lambda x: (x[0], x[1] or ""))[-keep:]
        state.update((total, kept))
        yield pd.DataFrame({"thread": [key[0]], "turns": [total], "history": [[t for _, t in kept]]})

    return turns.groupBy("thread").applyInPandasWithState(
        update, "thread long, turns long, history array<string>", "turns long, kept array<struct<turn:long,text:string>>", "update", GroupStateTimeout.NoTimeout
    )


def event_windows(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events per type and window; windows close once the watermark has passed."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return (
        timed.groupBy(F.window("ts", length), "event_type")
        .agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value"))
        .select(F.col("window.start").alias("window_start"), "event_type", "events", "value")
    )


def run_to_table(spark: SparkSession, stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process all that is there, write it to a Parquet table and read it back."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
