"""Statistics over groups as DataFrame compositions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ordering import ordered_counts, quantile


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def mid_rank_percentiles(rows: DataFrame, by: list[str], value: str, *, tails: float = 0.01) -> DataFrame:
    """rows (of which the value and by are never null) with low, high, population and percentile: (below + (equal - 1) / 2) / (n - 1) * 100 of the value clamped to its group's tails; 50 alone.

    Values are counted and numbered over ranges (functions/ordering.py), so neither the ranks nor the bounds of a group are one task's. Clamping moves only what lies beyond the bounds, so the ranks between them are those of the
    unclamped values, and the two ends are counted beside the bounds."""
    counts = ordered_counts(rows, by, value)
    bounds = counts.groupBy(*by).agg(quantile(value, tails).alias("low"), quantile(value, 1 - tails).alias("high"))
    ends = counts.join(bounds, by)
    ends = ends.groupBy(*by, "low", "high").agg(F.sum(F.when(F.col(value) <= F.col("low"), F.col("equal")).otherwise(0)).alias("_lows"), F.sum(F.when(F.col(value) < F.col("high"), F.col("equal")).otherwise(0)).alias("_under"))
    at_low, at_high, n = F.col(value) <= F.col("low"), F.col(value) >= F.col("high"), F.col("total")
    # Where both bounds are one value all are equal.
    below = F.when(at_low, 0).when(at_high, F.col("_under")).otherwise(F.col("below"))
    equal = F.when(at_low, F.col("_lows")).when(at_high, n - F.col("_under")).otherwise(F.col("equal"))
    flat = F.col("low") == F.col("high")
    share = F.when(n <= 1, 50.0).otherwise((F.when(flat, 0).otherwise(below) + (F.when(flat, n).otherwise(equal) - 1) / 2) / F.when(n > 1, n - 1) * 100)
    ranked = counts.join(ends, by).select(*by, value, "low", "high", n.alias("population"), share.alias("percentile"))
    return rows.join(ranked, [*by, value])
