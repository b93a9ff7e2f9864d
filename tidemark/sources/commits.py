"""A log of commits in a shared folder: what an attempt has written counts from the moment that its record is there, and an attempt has one record."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def committed(spark: SparkSession, log: str) -> dict[str, str]:
    """Attempt and value of every commit; an attempt is one call or one batch, so these are few."""
    at = _path(spark, log)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return {}
    names = [f.getPath().getName() for f in fs.listStatus(at)]
    return dict(n.split("@", 1) for n in (fs_name(spark, fs, f"{log}/{n}") for n in names if not n.startswith((".", "_"))))


def fs_name(spark: SparkSession, fs, path: str) -> str:
    """The record of a commit: its attempt and value."""
    stream = fs.open(_path(spark, path))
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def commit(spark: SparkSession, log: str, attempt: str, value: str) -> bool:
    """Record an attempt; False if it had been recorded before, by whomever, and then nothing changes.

    The record is written under another name and renamed without overwriting, as streams do with their own checkpoints: it is there whole or not at all."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder, final = _path(spark, log), _path(spark, f"{log}/{attempt}")
    fs = folder.getFileSystem(conf)
    fs.mkdirs(folder)
    if fs.exists(final):
        return False
    hidden = _path(spark, f"{log}/.{attempt}-{uuid.uuid4().hex}")
    out = fs.create(hidden, False)
    try:
        out.write(f"{attempt}@{value}".encode())
    finally:
        out.close()
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(hidden), fs.makeQualified(final), options)
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in str(e.java_exception):
            raise
        fs.delete(hidden, False)
        return False
    return True
