"""How rows are dealt over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Tasks at least that rows are dealt over, whatever the session's number of shuffle partitions.
LEAST_TASKS = 64


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys over ``spark.sql.shuffle.partitions`` tasks, which aren't merged into one per core again.

    Merging goes by the compressed size of a shuffle, and a task then sorts or hashes many times that in memory.
    """
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), LEAST_TASKS), *keys)
