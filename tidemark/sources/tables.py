"""File sources and content-addressed sinks."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.canonical import stable_hash

MASTER_COLUMNS = ("ts_code", "symbol", "name", "exchange", "board", "currency", "list_date", "security_type")
#: Limits of archive members: files, bytes of one, bytes of all, ratio of compression.
ARCHIVE_LIMITS = (5_000, 64 << 20, 512 << 20, 100)


def read_master(spark: SparkSession, path: str) -> DataFrame:
    """A security master CSV: header, byte order mark allowed, extra columns allowed, strict dates."""
    rows = spark.read.csv(path, header=True)
    names = {c.lstrip("﻿").strip(): c for c in rows.columns}
    if missing := [c for c in MASTER_COLUMNS if c not in names]:
        raise ValueError(f"SECURITY_MASTER_COLUMNS_INVALID: {', '.join(missing)}")
    return rows.select(*[F.trim(F.col(f"`{names[c]}`")).alias(c) for c in MASTER_COLUMNS if c != "list_date"], strict_date(F.col(f"`{names['list_date']}`"), "yyyyMMdd").alias("list_date"))


def strict_date(text: Column, form: str = "yyyy-MM-dd") -> Column:
    """The date, or null unless writing it again gives the same text."""
    d = F.try_to_date(text, form)
    return F.when(F.date_format(d, form) == text, d)


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of dates as sorted distinct rows."""
    text = spark.read.text(path, wholetext=True)
    days = text.select(F.explode(F.from_json("value", "array<string>")).alias("d"))
    return days.select(strict_date(F.col("d")).alias("trade_date")).where("trade_date IS NOT NULL").distinct().orderBy("trade_date")


POLICIES = "source_id string, source_name string, allowed_domains array<string>, allowed_schemes array<string>, allowed_purposes array<string>, rate_limit_per_minute int, review_status string, enabled boolean"


def read_policies(spark: SparkSession, path: str) -> DataFrame:
    """Source policies from a JSON array. A file that isn't one, or a policy that lacks or mistypes a field, is SOURCE_POLICIES_INVALID; a source listed twice is SOURCE_POLICIES_DUPLICATE_SOURCE_ID."""
    rows = spark.read.schema(POLICIES + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path, multiLine=True).cache()
    try:
        wrong = F.col("_bad").isNotNull() | (F.col("rate_limit_per_minute") <= 0)
        for c in rows.columns[:-1]:
            wrong = wrong | F.col(c).isNull()
        if rows.isEmpty() or not rows.where(wrong).isEmpty():
            raise ValueError("SOURCE_POLICIES_INVALID")
        if not rows.groupBy("source_id").count().where("count > 1").isEmpty():
            raise ValueError("SOURCE_POLICIES_DUPLICATE_SOURCE_ID")
    finally:
        rows.unpersist()
    return rows.drop("_bad")


def archive_members(files: DataFrame) -> DataFrame:
    """path, member, size (bytes inflated), reason of the members of ZIP files (a binaryFile table). Every member is inflated and its checksum taken; a damaged or unsafe archive, or one beyond ARCHIVE_LIMITS, gives one row with its reason."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    rows += [(path, name, size, None) for name, size in _inflated_members(content or b"")]
                except _Refused as e:
                    rows.append((path, None, None, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.string()))], names=["path", "member", "size", "reason"])

    return files.select("path", "content").mapInArrow(members, "path string, member string, size long, reason string")


class _Refused(ValueError):
    """An archive that isn't taken, and why."""


def _inflated_members(content: bytes) -> list[tuple[str, int]]:
    """Names and inflated sizes of an archive's files, read through so that sizes and checksums are what they say."""
    most, one, every, ratio = ARCHIVE_LIMITS
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except (zipfile.BadZipFile, ValueError, NotImplementedError):
        raise _Refused("FINANCIAL_ARCHIVE_INVALID") from None
    infos = archive.infolist()
    names = [i.filename.replace("\\", "/") for i in infos]
    if any(n.startswith("/") or ":" in n.split("/")[0] or ".." in n.split("/") or i.external_attr >> 28 == 0xA for n, i in zip(names, infos)) or len({n.casefold() for n in names}) < len(names):
        raise _Refused("FINANCIAL_ARCHIVE_UNSAFE_PATH")
    if len(infos) > most or any(i.file_size > one or i.file_size > ratio * max(1, i.compress_size) for i in infos) or sum(i.file_size for i in infos) > every:
        raise _Refused("FINANCIAL_ARCHIVE_LIMIT_EXCEEDED")
    found, left = [], every
    for i in infos:
        size = 0
        try:
            with archive.open(i) as f:
                while piece := f.read(1 << 20):
                    size, left = size + len(piece), left - len(piece)
                    if size > one or left < 0:
                        raise _Refused("FINANCIAL_ARCHIVE_LIMIT_EXCEEDED")
        except (zipfile.BadZipFile, zlib.error, EOFError, RuntimeError, NotImplementedError):
            raise _Refused("FINANCIAL_ARCHIVE_INVALID") from None
        if size != i.file_size:
            raise _Refused("FINANCIAL_ARCHIVE_INVALID")
        if not i.is_dir():
            found.append((i.filename, size))
    return found


def archive_totals(members: DataFrame) -> DataFrame:
    """path, files, bytes, reason of each archive."""
    return members.groupBy("path").agg(F.count("member").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.max("reason").alias("reason"))


def row_hash(columns: list[str]) -> Column:
    """SHA-256 of a row's values as text, null and empty told apart."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in columns]), 256)


def digest_of(parts: Column) -> Column:
    """SHA-256 of a group's parts in sorted order."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(parts)), ","), 256)


def content_digest(rows: DataFrame, by: list[str], columns: list[str], *, copies: bool = True) -> DataFrame:
    """by, n, digest: a digest of each group's rows that doesn't depend on their order.

    It is a tree. Rows are hashed, and equal ones counted; hashes that share their first eight digits make a leaf, leaves that share four a branch, and the branches of a group its digest, each of them the hash of
    its sorted parts. So the rows of one group are dealt over 65,536 branches, no list is longer than that or a leaf of some thousand rows of 10**13, and what reaches the group's own task are its branches."""
    # Hashes travel as their 32 bytes; as text, with branch and leaf beside it, they were most of a job's disk.
    hashed = rows.select(*by, F.unhex(row_hash(columns)).alias("_b"), F.lit(1).cast("long").alias("_n"))
    if copies:
        hashed = hashed.groupBy(*by, "_b").agg(F.sum("_n").alias("_n"))
    dealt = hashed.withColumn("_two", F.substring("_b", 1, 2)).repartition(*by, "_two")
    dealt = dealt.groupBy(*by, "_two", "_b").agg(F.sum("_n").alias("_c")).withColumn("_h", F.lower(F.hex("_b")))
    # What is dealt by branch is together by leaf too.
    leaves = dealt.groupBy(*by, "_two", F.substring("_h", 1, 8).alias("_leaf")).agg(F.sum("_c").alias("_c"), digest_of(F.concat_ws(":", "_h", "_c")).alias("_d"))
    leaves = leaves.withColumn("_branch", F.substring("_leaf", 1, 4))
    branches = leaves.groupBy(*by, "_two", "_branch").agg(F.sum("_c").alias("_c"), digest_of(F.concat_ws(":", "_leaf", "_d")).alias("_d"))
    return branches.groupBy(*by).agg(F.sum("_c").alias("n"), digest_of(F.concat_ws(":", "_branch", "_d")).alias("digest"))


def digest_sql(table: str, by: str, row: str) -> str:
    """content_digest in SQL. row: an expression for the hash of a row."""
    return f"""SELECT {by}, sum(c)::BIGINT AS n, sha256(string_agg(branch || ':' || d, ',' ORDER BY branch)) AS digest FROM (
  SELECT {by}, branch, sum(c) AS c, sha256(string_agg(leaf || ':' || d, ',' ORDER BY leaf)) AS d FROM (
    SELECT {by}, h[1:4] AS branch, h[1:8] AS leaf, sum(c) AS c, sha256(string_agg(h || ':' || c, ',' ORDER BY h || ':' || c)) AS d FROM (
      SELECT {by}, {row} AS h, count(*) AS c FROM {table} GROUP BY ALL) GROUP BY ALL) GROUP BY ALL) GROUP BY {by}"""


def put_objects(new: DataFrame, known: DataFrame, events: DataFrame, payload: str) -> tuple[DataFrame, DataFrame]:
    """Objects of new payloads that known (content_hash) lacks, and provenance events (event_hash) that events lacks: one for each source, address, time and content that was seen. new: source_id, source_url, collected_at and the payload."""
    rows = new.withColumn("content_hash", F.sha2(F.coalesce(payload, F.lit("")), 256))
    objects = rows.groupBy("content_hash").agg(F.first(payload).alias(payload)).join(known.select("content_hash"), "content_hash", "left_anti")
    seen = {c: F.col(c).cast("string") for c in ("source_id", "source_url", "collected_at", "content_hash")}
    told = rows.select("source_id", "source_url", "collected_at", "content_hash", stable_hash(seen).alias("event_hash")).dropDuplicates(["event_hash"])
    return objects, told.join(events.select("event_hash"), "event_hash", "left_anti")


def dedupe_objects(rows: DataFrame, payload: str, key: str) -> DataFrame:
    """content_hash, first (least key), copies."""
    return rows.groupBy(F.sha2(F.coalesce(payload, F.lit("")), 256).alias("content_hash")).agg(F.min(key).alias("first"), F.count("*").alias("copies"))


def last_wins(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Upsert as a new table: of each key the row of greatest order; new rows win ties."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in old.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(order, "_new")).alias("r")).select(key, "r.*")


def compare_and_set(rows: DataFrame, changes: DataFrame, key: str, field: str) -> tuple[DataFrame, DataFrame]:
    """rows after changes (key, expected, value), and the changes refused because the field didn't hold what they expected. Of several changes of a key none is taken."""
    one = changes.groupBy(key).agg(F.count("*").alias("_n"), F.max("expected").alias("_expected"), F.max("value").alias("_value"))
    met = rows.join(one, key, "left").withColumn("_taken", F.coalesce((F.col("_n") == 1) & F.col(field).eqNullSafe(F.col("_expected")), F.lit(False)))
    after = met.withColumn(field, F.when(F.col("_taken"), F.col("_value")).otherwise(F.col(field))).select(rows.columns)
    return after, changes.join(met.where("_taken").select(key), key, "left_anti")


def insert_missing(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.unionByName(new.join(old.select(key), key, "left_anti"))
