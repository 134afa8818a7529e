"""Joins with lookup tables, and rows dealt to tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = 100_000
#: Estimated bytes that rows brought together by a key have in one partition, more or less.
KEYED_BYTES = 16 << 20


def small(table: DataFrame, most: int = MOST) -> DataFrame:
    """``table`` marked to be broadcast if it is found to have at most ``most`` rows; else as it is, so that it is shuffled."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` in as many partitions as the cores need, whatever the files or shuffles before had: a small file of many rows is one
    split, and small shuffled partitions are put together, so that a costly step would run on a few cores only."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism))


def keyed(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt by their keys to partitions whose number grows with the planner's estimate of their size.  Shuffles that Spark adds
    itself are put together by compressed size, and short rows that compress well then fill a task's memory when they are sorted."""
    spark = rows.sparkSession
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    return rows.repartition(max(least, min(size // KEYED_BYTES, 20_000)), *keys)
