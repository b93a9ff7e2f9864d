"""Expressions and storage that several corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.staging import discard, new_path, passing, settle

__all__ = ["SPACE_RUN", "WORD", "discard", "hash60", "n_of", "new_path", "passing", "settle", "table", "whole_text", "words"]

#: Space, tab, line feed, vertical tab, form feed and carriage return separate words.
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: The same for Python's re.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def words(text: Column) -> Column:
    """Array of the runs of characters outside SPACE_RUN."""
    return F.array_remove(F.split(text, SPACE_RUN), "")


def n_of(text: Column, runs: str) -> Column:
    """How many of text's characters are in runs of a pattern."""
    return F.length(text) - F.length(F.regexp_replace(text, runs, ""))


def hash60(c: Column, salt: str) -> Column:
    """60 hash bits of a column's string form (null: empty) that SQL engines agree on: the first 15 hex digits of MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.coalesce(c.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")
