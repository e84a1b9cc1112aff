"""Window helpers that stay parallel when one group is huge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Give CPU-heavy per-row work at least one partition per core.

    A cluster scan over many files already yields thousands of splits and is
    left alone; a small single-file table (one parquet row group) would
    otherwise run its Python kernel on one core. ``partitions`` deals the rows out to so
    many whatever the scan yields: a split or a merged shuffle partition of 64 MB can hold
    millions of short rows, which is hours of a slow kernel in one task.
    """
    if df.isStreaming:   # micro-batches are sized by the source options instead
        return df
    if partitions:
        return df.repartition(partitions)
    spark = SparkSession.getActiveSession()
    want = spark.sparkContext.defaultParallelism if spark else 8
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want)


def tasks_for(spark: SparkSession, rows: int, rows_per_task: int = 50_000) -> int:
    """How many tasks a slow kernel over so many rows should have: enough for the cores, none with very many rows."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // rows_per_task))


def exclusive_running_total(df: DataFrame, part: Sequence[str], order: str, value: str,
                            out: str, block: int = 4096) -> DataFrame:
    """``sum(value)`` over earlier rows of the same ``part`` ordered by ``order``.

    Two-level prefix sum: rows are grouped into blocks of ``order div block``;
    block totals get a running sum per ``part`` (``block``x fewer rows), and the
    within-block running sum is partitioned by ``(part, block)``. A group holding
    a third of all rows is thus split over many tasks instead of one.
    ``order`` must be an integer ordinal (e.g. a message turn) unique in ``part``.
    """
    part = list(part)
    b = F.floor(F.col(order) / F.lit(block)).alias("_blk")
    d = df.withColumn("_blk", b)
    totals = d.groupBy(*part, "_blk").agg(F.sum(value).alias("_bsum"))
    wb = Window.partitionBy(*part).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_boff", F.coalesce(F.sum("_bsum").over(wb), F.lit(0))).drop("_bsum")
    wi = Window.partitionBy(*part, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_ioff", F.coalesce(F.sum(value).over(wi), F.lit(0)))
    return (d.join(totals, [*part, "_blk"])
            .withColumn(out, (F.col("_boff") + F.col("_ioff")).cast("long"))
            .drop("_blk", "_boff", "_ioff"))
