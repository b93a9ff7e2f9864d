"""Tables between the steps of one job, in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset in local mode (tests), a new temporary folder. On a cluster there must be one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(base)
    return str(base).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str, *, bucket: str | None = None, keep: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts the lineage, and lost executors don't matter.

    bucket: a column by which the rows are written in as many buckets as shuffles have partitions, so that joins on it don't move them again. keep: the table outlives the passing() block it is written in."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    if not keep and (held := _held.get()) is not None:
        held.append(path)
    if bucket is None:
        df.write.parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
        out._settled_at = path
        return out
    # Only the catalog knows of buckets. The name goes again at once: the files are outside the warehouse and stay.
    entry = f"settled_{uuid.uuid4().hex}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), bucket).option("path", path).saveAsTable(entry, format="parquet")
    out = spark.table(entry).select("*")
    spark.sql(f"DROP TABLE {entry}")
    out._settled_at = path
    return out


#: What is settled inside a passing() block of this thread.
_held: ContextVar[list[str] | None] = ContextVar("held", default=None)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, by Spark's own file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of jobs that have ended. Spark deletes them once the driver has collected what refers to them, which it does for want of memory only; a job of many steps would keep those of all its steps on disk."""
    gc.collect()
    spark._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Delete settled tables whose last reader has ended, before their passing() block does. Other tables are left alone."""
    for path, df in ((vars(df).get("_settled_at"), df) for df in tables):
        if path is None:
            continue
        remove(df.sparkSession, path)
        if (held := _held.get()) is not None and path in held:
            held.remove(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables settled inside are deleted at the end, but for those to be kept: what the block leaves must not read the others any more."""
    token = _held.set(paths := [])
    try:
        yield
    finally:
        _held.reset(token)
        for path in paths:
            remove(spark, path)
