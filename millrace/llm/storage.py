"""Tables that operators write between stages, in the folder all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from millrace.sources.storage import exists, materialise, new_path as new_table, shared_dir

__all__ = ["exists", "materialise", "new_table", "shared_dir", "spread"]


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a table with fewer files than there are cores, dealt out to all of them; other tables as they are.

    Python stages over one small file would otherwise run in one task. Large tables have many splits and are not shuffled.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
