"""Ranks and order statistics of groups of any size: no group is one task's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.staging import settle


def ordered_counts(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, value, equal (rows that have it), below (rows of the group under it), total: a stored row for each different value of a group; null values are left out.

    Values are counted, which combines before the shuffle, and dealt by ranges of (by, value), so a group of many values lies in many ranges. A first pass counts the rows of each group in each range and sums
    these in order (a row a range and group); a second numbers the values within a range and adds what stands before it. A hot value is one row."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("equal"))
    dealt = settle(counts.repartitionByRange(parts, *by, value).withColumn("_part", F.spark_partition_id()), "ordered-ranges")
    per = dealt.groupBy(*by, "_part").agg(F.sum("equal").alias("_n"))
    ahead = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select(*by, "_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(*by)).alias("total"))
    within = Window.partitionBy("_part", *by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    inner = dealt.withColumn("_within", F.coalesce(F.sum("equal").over(within), F.lit(0)))
    same = [inner[c].eqNullSafe(starts[c]) for c in (*by, "_part")]
    joined = inner.join(starts, same)
    return settle(joined.select(*[inner[c] for c in by], inner[value], "equal", (F.col("_before") + F.col("_within")).alias("below"), "total"), "ordered-counts")


def order_statistic(value: str, place: Column) -> Column:
    """Over ordered_counts of a group: the value at a place, counted from 0."""
    return F.max(F.when((F.col("below") <= place) & (place < F.col("below") + F.col("equal")), F.col(value)))


def quantile(value: str, share: float) -> Column:
    """Over ordered_counts of a group: the exact quantile, interpolated between the values beside its place."""
    place = (F.col("total") - 1) * F.lit(share)
    low, high = order_statistic(value, F.floor(place)), order_statistic(value, F.ceil(place))
    part = F.max(place - F.floor(place))
    return F.when(low == high, low).otherwise(low * (1 - part) + high * part)


def previous(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """by, order, previous: for each different order of a group the greatest value at the order before it (null at the first). Null groups and orders are left out.

    A row a group and order is dealt by ranges of both, so a group of any size lies in many ranges; within one the row before is beside, and the last row of each range and group is carried to the next one that has the group."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    steps = rows.where(F.col(by).isNotNull() & F.col(order).isNotNull()).groupBy(by, order).agg(F.max(value).alias("_value"))
    dealt = settle(steps.repartitionByRange(parts, by, order).withColumn("_part", F.spark_partition_id()), "order-ranges")
    ends = dealt.groupBy(by, "_part").agg(F.max_by("_value", order).alias("_end"))
    carried = ends.select(by, "_part", F.lag("_end").over(Window.partitionBy(by).orderBy("_part")).alias("_carried"))
    beside = F.lag("_value").over(Window.partitionBy("_part", by).orderBy(order))
    return dealt.withColumn("_beside", beside).join(carried, [by, "_part"]).select(by, order, F.coalesce("_beside", "_carried").alias("previous"))
