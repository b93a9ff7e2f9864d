"""Content-addressed tables: each group of rows is stored under its own digest, once, and read back only if it still has it.

A group is a day's bars, a filing's facts, or one security's returns of one algorithm. Publication has two phases. An attempt writes its rows to a folder of its own, by Spark's partitioned writer and all groups of a call at a
time, and a manifest that lists every file and how many rows it has; then one record in the commit log makes it count. Readers take the files of committed manifests and no others, so an
attempt that dies anywhere before leaves nothing that is read, its rerun writes new files, and tasks that are lost or run twice change nothing. Of one content that several attempts have committed the first by name is read."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.canonical import json_of_map, map_of_json
from tidemark.functions.reasons import first_reason
from tidemark.sources.commits import commit, committed
from tidemark.sources.staging import release, settle
from tidemark.sources.tables import content_digest


def mixed_groups(rows: DataFrame, group: str, same: list[str]) -> DataFrame:
    """The groups whose rows differ in columns that a group must have in common."""
    per = rows.groupBy(group).agg(*[F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\0"))).alias(c) for c in same])
    return per.where(" OR ".join(f"`{c}` > 1" for c in same)).select(group)


def stored_form(rows: DataFrame, maps: list[str]) -> DataFrame:
    """rows with maps as canonical JSON, in which equal maps are equal text."""
    return rows.withColumns({c: json_of_map(F.col(c)) for c in maps})


def write_artifacts(rows: DataFrame, path: str, by: list[str], *, maps: tuple[str, ...] = (), group: str | None = None, same: tuple[str, ...] = (), mixed: str = "ARTIFACT_MIXED", attempt: str | None = None) -> DataFrame:
    """Store each group of rows (by: its partition columns) under its digest; gives by, n, digest of what this call has published.

    rows are read twice, for their digests and to be written: rows that are dear to compute should be settled before. Groups that are stored already with the same content are left alone. group, same: columns that all rows of a group must share; the error mixed is raised otherwise. No rows: ValueError.
    attempt: a name under which the call publishes once, however often it is made (such as a batch of a stream)."""
    spark = rows.sparkSession
    if attempt is not None and attempt in committed(spark, f"{path}/commits"):
        return manifest(spark, path, attempt).select(*by, "n", "digest")
    if group and not mixed_groups(rows, group, list(same)).isEmpty():
        raise ValueError(mixed)
    stored = stored_form(rows, list(maps))
    found = settle(content_digest(stored, by, sorted(stored.columns), copies=False), "digests")
    release(spark)
    if found.isEmpty():
        raise ValueError("ARTIFACT_EMPTY")
    # The digest is over the partition columns too, so it tells a group by itself.
    new = found.join(manifest(spark, path).select("digest"), "digest", "left_anti") if committed(spark, f"{path}/commits") else found
    new, token = settle(new.select(*found.columns), "new-artifacts"), f"a-{uuid.uuid4().hex}"
    if new.isEmpty() and attempt is None:
        return new
    write_rows(stored, new, f"{path}/rows/attempt={token}", by)
    list_files(spark, new, f"{path}/rows/attempt={token}", by, token).write.parquet(f"{path}/manifests/{token}")
    commit(spark, f"{path}/commits", attempt or token, token)
    return spark.read.parquet(f"{path}/manifests/{committed(spark, f'{path}/commits')[attempt or token]}").select(*by, "n", "digest")


def write_rows(stored: DataFrame, new: DataFrame, folder: str, by: list[str]) -> None:
    """First phase: the rows of new groups, a folder a group. Partition columns also stay in the rows, in which the digest is taken; values of folders are text that nothing takes for a number."""
    key = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in by]), {"ignoreNullFields": "false"})
    keyed = stored.withColumn("_key", key).join(new.select(key.alias("_key"), F.concat(F.lit("sha256-"), "digest").alias("artifact")), "_key")
    keyed = keyed.withColumns({f"p_{c}": F.concat(F.lit("v"), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in by})
    # A group is one task's unless it is large: adaptive execution splits those and puts small ones together.
    keyed.hint("rebalance", "_key").sortWithinPartitions("_key").drop("_key").write.partitionBy(*[f"p_{c}" for c in by], "artifact").parquet(folder)
    release(stored.sparkSession)


def list_files(spark: SparkSession, new: DataFrame, folder: str, by: list[str], token: str) -> DataFrame:
    """new with attempt and files (artifact, name, n) as they lie in the folder. ARTIFACT_WRITE_INCOMPLETE if these don't have the rows of their groups."""
    names = ["artifact", "name", "n"]
    if new.isEmpty():
        return new.select(*new.columns, F.lit(token).alias("attempt"), F.array().cast("array<struct<artifact:string,name:string,n:bigint>>").alias("files"))
    held = spark.read.parquet(folder).groupBy("artifact", F.col("_metadata.file_name").alias("name")).agg(F.count("*").alias("n"))
    per = held.groupBy("artifact").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("files"), F.sum("n").alias("_n"))
    listed = settle(new.join(per, F.concat(F.lit("sha256-"), "digest") == F.col("artifact"), "left").select(*new.columns, F.lit(token).alias("attempt"), "files", "_n"), "listed-files")
    if not listed.where("_n IS NULL OR _n <> n").isEmpty():
        raise ValueError("ARTIFACT_WRITE_INCOMPLETE")
    return listed.drop("_n")


def manifest(spark: SparkSession, path: str, attempt: str | None = None) -> DataFrame:
    """by, n, digest, attempt, files of what is published, or what one attempt has. A group that was stored in several contents has several rows."""
    tokens = committed(spark, f"{path}/commits")
    if not tokens:
        raise ValueError("ARTIFACT_NOT_FOUND")
    rows = spark.read.parquet(*[f"{path}/manifests/{t}" for a, t in sorted(tokens.items()) if attempt in (None, a)])
    first = rows.groupBy("digest").agg(F.min_by(F.struct(*rows.columns), "attempt").alias("r"))
    return first.select("r.*")


def listed_rows(spark: SparkSession, path: str, listed: DataFrame) -> DataFrame:
    """The rows of the files that a manifest lists, with its _claimed digest; whole attempts and groups that aren't listed are pruned by their folders."""
    files = listed.select("attempt", F.col("digest").alias("_claimed"), F.explode("files").alias("f")).select("attempt", "_claimed", F.col("f.artifact").alias("artifact"), F.col("f.name").alias("_file"))
    rows = spark.read.parquet(f"{path}/rows")
    return rows.withColumn("_file", F.col("_metadata.file_name")).join(files, ["attempt", "artifact", "_file"]).drop("_file", "artifact", "attempt")


def validate_artifacts(spark: SparkSession, path: str, by: list[str], *, listed: DataFrame | None = None) -> DataFrame:
    """by, digest, issue of every listed artifact: files that aren't there, rows missing or too many, rows of another partition, content that doesn't have its digest any more. issue is null where all is well.

    listed: a manifest, or a part of one; all that is published by default."""
    listed = manifest(spark, path) if listed is None else listed
    rows = listed_rows(spark, path, listed)
    parts = [f"p_{c}" for c in by]
    columns = sorted(c for c in rows.columns if c not in ("_claimed", *parts))
    again = content_digest(rows, ["_claimed"], columns, copies=False).select("_claimed", F.col("n").alias("_n"), F.col("digest").alias("_digest"))
    # A group has one value of each of its columns, and so have its rows.
    found = [F.min(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(f"_lo_{c}") for c in by] + [F.max(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(f"_hi_{c}") for c in by]
    met = listed.join(again, F.col("digest") == F.col("_claimed"), "left").drop("_claimed").join(rows.groupBy("_claimed").agg(*found), F.col("digest") == F.col("_claimed"), "left")
    strange = F.lit(False)
    for c in by:
        own = F.coalesce(F.col(c).cast("string"), F.lit(""))
        strange = strange | (F.col(f"_lo_{c}") != own) | (F.col(f"_hi_{c}") != own)
    issue = first_reason({"ARTIFACT_MISSING": F.col("_n").isNull(), "ARTIFACT_COUNT": F.col("_n") != F.col("n"), "ARTIFACT_PARTITION": strange, "ARTIFACT_CONTENT": F.col("_digest") != F.col("digest")})
    return met.select(*by, "digest", issue.alias("issue"))


def read_artifacts(spark: SparkSession, path: str, by: list[str], *, where: Column | None = None, maps: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> DataFrame:
    """The published rows, maps decoded, in order. where: over by. A group that is stored in several contents is an error, since none of them is the one that holds."""
    listed = manifest(spark, path) if where is None else manifest(spark, path).where(where)
    if not listed.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise ValueError("MULTIPLE_ARTIFACTS")
    out = listed_rows(spark, path, listed).drop("_claimed", *[f"p_{c}" for c in by]).withColumns({c: map_of_json(F.col(c)) for c in maps})
    return out.orderBy(*order) if order else out


def has_documents(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def write_documents(documents: DataFrame, path: str) -> None:
    """Immutable documents (id, document, hash), a folder an id and hash. The same document again changes nothing; another under a known id is an error."""
    spark = documents.sparkSession
    new = documents.select("id", "document", "hash")
    if has_documents(spark, path):
        known = spark.read.schema(new.schema).parquet(f"{path}/manifest")
        if not new.join(known.select("id", F.col("hash").alias("_known")), "id").where("hash <> _known").isEmpty():
            raise ValueError("REPORT_IMMUTABILITY_CONFLICT")
        new = new.join(known.select("id", "hash"), ["id", "hash"], "left_anti")
    new.write.mode("append").parquet(f"{path}/manifest")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """id, document, hash, issue: REPORT_ARTIFACT_INVALID where a document doesn't have its hash or isn't JSON of its own id."""
    # A document that was written twice is one.
    rows = spark.read.parquet(f"{path}/manifest").dropDuplicates(["id", "hash"])
    good = (F.sha2("document", 256) == F.col("hash")) & (F.get_json_object("document", "$.report_id") == F.col("id").cast("string"))
    return rows.withColumn("issue", F.when(~F.coalesce(good, F.lit(False)), "REPORT_ARTIFACT_INVALID"))
