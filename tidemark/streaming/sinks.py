"""Sinks that store each batch of a stream once, and a check of versions against those that came before.

A batch is published under its number (sources/artifacts.py), so a stream that dies after the sink and before its checkpoint may run the batch again: what is published stays as it is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.reasons import first_reason
from tidemark.sources.artifacts import read_artifacts, write_artifacts
from tidemark.sources.commits import commit, committed
from tidemark.sources.staging import new_path, remove, settle

Sink = Callable[[DataFrame, int], None]


def once(path: str, by: list[str]) -> Sink:
    """For foreachBatch: the batch's rows in groups of batch and by. An empty batch stores nothing."""

    def store(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            write_artifacts(batch.withColumn("batch", F.lit(number).cast("long")), path, ["batch", *by], attempt=f"batch-{number:012d}")

    return store


def stored(spark: SparkSession, path: str, by: list[str]) -> DataFrame:
    """All that once() has published, with the number of its batch."""
    return read_artifacts(spark, path, ["batch", *by])


def judge_versions(rows: DataFrame, last: DataFrame, key: str, version: str, order: str) -> DataFrame:
    """rows with accepted and reason: a version is late if its order isn't beyond the greatest order of its key so far (last: key, last), a repeat if another of its batch with the same order comes first by version, and refused
    if its key or order is null.

    What an accepted version must beat is the greatest order of all before it, accepted or not, so no row waits for the verdict on another: rows meet one number a key and those of their own order."""
    first = F.row_number().over(Window.partitionBy(key, order).orderBy(F.col(version).asc_nulls_last()))
    met = rows.withColumn("_first", first).join(last.select(F.col(key).alias("_key"), "last"), F.col(key) == F.col("_key"), "left")
    reason = first_reason({"VERSION_KEY_MISSING": F.col(key).isNull(), "VERSION_ORDER_MISSING": F.col(order).isNull(), "VERSION_LATE": F.col(order) <= F.col("last"), "VERSION_REPEATED": F.col("_first") > 1})
    return met.select(*rows.columns, reason.isNull().alias("accepted"), reason.alias("reason"))


def next_state(rows: DataFrame, last: DataFrame, key: str, order: str, seen: str | None = None, keep: str | None = None) -> DataFrame:
    """key, last (greatest order), seen (greatest time) after a batch: maxima, which combine before the shuffle, so a hot key costs a task one row. Keys not seen for longer than keep before the newest
    time are forgotten; an old version of theirs would be accepted again."""
    time = F.col(seen) if seen else F.lit(None).cast("timestamp")
    new = rows.where(F.col(key).isNotNull() & F.col(order).isNotNull()).groupBy(key).agg(F.max(order).alias("last"), F.max(time).alias("seen"))
    both = last.unionByName(new).groupBy(key).agg(F.max("last").alias("last"), F.max("seen").alias("seen"))
    if not (seen and keep):
        return both
    newest = both.agg(F.max("seen").alias("_newest"))
    return both.join(F.broadcast(newest), F.col("seen") >= F.col("_newest") - F.expr(f"INTERVAL {keep}")).drop("_newest")


def versions(path: str, key: str, version: str, order: str, *, seen: str | None = None, keep: str | None = None) -> Sink:
    """For foreachBatch: stores each batch's rows with their verdict under path/rows (see stored), and the state after it, a row a key, under path/state.

    The state of a batch comes from that of the batch before it and is committed first; a batch that runs again finds both as they were."""

    def store(batch: DataFrame, number: int) -> None:
        spark, log = batch.sparkSession, f"{path}/states"
        batch, known = settle(batch, "version-batch"), committed(spark, log)
        schema = f"{key} {batch.schema[key].dataType.simpleString()}, last {batch.schema[order].dataType.simpleString()}, seen timestamp"
        before = known.get(f"state-{number - 1:012d}")
        last = spark.read.schema(schema).parquet(before) if before else spark.createDataFrame([], schema)
        mine = f"state-{number:012d}"
        if mine not in known:
            at = new_path(spark, "version-state")
            next_state(batch, last, key, order, seen, keep).write.parquet(at)
            if not commit(spark, log, mine, at):
                remove(spark, at)
        once(f"{path}/rows", [])(judge_versions(batch, last, key, version, order), number)
        # The state before the last isn't needed again: its batch has ended.
        if old := known.get(f"state-{number - 2:012d}"):
            remove(spark, old)

    return store


def run_once(source: DataFrame, sink: Sink, checkpoint: str) -> None:
    """Give a stream's new batches to a sink and end; what the sink raises is raised."""
    source.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
