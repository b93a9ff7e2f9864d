"""Loading a history piece by piece: what is published is checked and not loaded again, and progress only moves forward."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.artifacts import manifest, validate_artifacts, write_artifacts
from tidemark.sources.commits import commit, committed
from tidemark.sources.staging import settle


def completed(spark: SparkSession, path: str, period: str) -> DataFrame | None:
    """Published periods, or None before there is one."""
    return manifest(spark, path) if committed(spark, f"{path}/commits") else None


def progress(spark: SparkSession, path: str) -> str | None:
    """The last completed period. Each record of the checkpoint is beyond the one before it, and a run only adds."""
    return max(committed(spark, f"{path}/progress").values(), default=None)


def backfill(wanted: DataFrame, source: DataFrame, path: str, period: str, issue: Column) -> DataFrame:
    """Publish the wanted periods of source that aren't there yet, up to the first that can't be: period, status (COMPLETED before, PUBLISHED now, FAILED, NOT_REACHED) and reason.

    wanted: period, in any order, repeats count once, null is no period. issue: a reason over source's rows why their period can't be published (null: none); a period without rows fails too. Periods
    are compared as text (dates and months as ISO). All that is pending is loaded at once and the first failure is found as a minimum, instead of period after period. What is
    published is validated first: damaged artifacts raise MARKET_CHECKPOINT_ARTIFACT_INVALID. Rows of completed periods aren't read: source meets only pending ones."""
    spark = wanted.sparkSession
    days = settle(wanted.select(period).where(F.col(period).isNotNull()).distinct(), "wanted")
    done = completed(spark, path, period)
    there = days.limit(0) if done is None else settle(days.join(done.select(period).distinct(), period, "left_semi"), "done")
    if done is not None:
        claimed = done.join(there, period, "left_semi")
        if not claimed.isEmpty() and not validate_artifacts(spark, path, [period], listed=claimed).where("issue IS NOT NULL").isEmpty():
            raise ValueError("MARKET_CHECKPOINT_ARTIFACT_INVALID")
    pending = settle(days.join(there, period, "left_anti"), "pending")
    rows = source.join(pending, period, "left_semi")
    per = rows.groupBy(period).agg(F.min(issue).alias("reason"), F.lit(True).alias("_there"))
    judged = settle(pending.join(per, period, "left").select(period, F.when(F.col("_there").isNull(), "MARKET_DATA_MISSING").otherwise(F.col("reason")).alias("reason")), "judged")
    first = judged.where("reason IS NOT NULL").agg(F.min(F.col(period).cast("string"))).first()[0]
    reached = F.lit(True) if first is None else F.col(period).cast("string") < first
    if not judged.where(reached).isEmpty():
        write_artifacts(rows.where(reached), path, [period])
    last = days.where(reached).agg(F.max(F.col(period).cast("string"))).first()[0]
    now = progress(spark, path)
    if last is not None and (now is None or last > now):
        commit(spark, f"{path}/progress", f"to-{last}", last)
    failed = F.lit(False) if first is None else F.col(period).cast("string") == first
    status = F.when(reached, "PUBLISHED").when(failed, "FAILED").otherwise("NOT_REACHED")
    return judged.select(period, status.alias("status"), F.when(failed, F.col("reason")).alias("reason")).union(there.select(period, F.lit("COMPLETED"), F.lit(None).cast("string")))
