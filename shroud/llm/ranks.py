"""Ranks of rows within groups of any size, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shroud.llm.storage import stored


def ranked(df: DataFrame, group: str, order: list, name: str) -> DataFrame:
    """Adds ``rank`` (from 0) of each row in its group by ``order``, and the group's ``total``.

    Rows are sorted into ranges of (group, order), so a hot group spans many of them; a
    rank is the place in the range plus the rows of the group in earlier ranges. ``group``
    must not be null; rows that are equal in ``order`` get their ranks in any order, and
    a range cannot be cut between them.
    """
    placed = df.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = stored(placed.select("*", F.spark_partition_id().alias("_range"), at.alias("_at")), name)
    counts = placed.groupBy(group, "_range").agg(F.min("_at").alias("_low"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(group)                            # as many rows as ranges, whatever the group's size
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(group, "_range", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_low")).alias("_shift"), F.sum("_n").over(whole).alias("total"))
    return placed.join(counts, [group, "_range"]).withColumn("rank", F.col("_at") + F.col("_shift")).drop("_range", "_at", "_shift")
