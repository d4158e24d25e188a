"""Reading tables for work that is heavy on the processor."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes for each core up to which a table counts as small.
SMALL_BYTES = 32 << 20

#: Bytes, as Spark takes them to be in files, for each task that drops repeated rows; in memory they are many times that.
PART_BYTES = 4 << 20

#: Tasks to which rows are dealt at most, and bytes from which on Spark's estimate of a table says that it has none.
MOST_PARTITIONS, NO_ESTIMATE = 1 << 15, 1 << 62


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out to all cores if it is small.

    A small file is one row group, so one task would do all the work.  A table
    of more than ``SMALL_BYTES`` a core has row groups enough and stays where it
    is; the size is that which Spark's own statistics give.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = _bytes(df._jdf.queryExecution().optimizedPlan())
    return df.repartition(cores) if size <= SMALL_BYTES * cores else df


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df``, dealt by its ``keys`` to partitions that grow with it in number
    and not in size, so that what a task holds of it is bounded.  Grouping by
    the keys then needs no further shuffle.

    Spark takes a join to be as large as the product of its sides, and rows
    that come from an RDD to be larger than any table.  Where its figure would
    ask for more than ``MOST_PARTITIONS``, those of the tables that are read
    and that it knows are added up instead."""
    spark, plan = df.sparkSession, df._jdf.queryExecution().optimizedPlan()
    parts = -(-_bytes(plan) // PART_BYTES)
    if parts > MOST_PARTITIONS:
        leaves = plan.collectLeaves()
        known = [size for i in range(leaves.size()) if (size := _bytes(leaves.apply(i))) < NO_ESTIMATE]
        parts = min(-(-sum(known) // PART_BYTES), MOST_PARTITIONS)
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), parts), *keys)


def _bytes(plan) -> int:
    return int(plan.stats().sizeInBytes())
