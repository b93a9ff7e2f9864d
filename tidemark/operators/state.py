"""State kept as tables: runs, stored objects, published reports and what may be shown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.reasons import first_reason


def runs_of_type(runs: DataFrame, path: str, kind: str | None = None) -> DataFrame:
    """runs (run_id, payload as JSON, updated_at) of one kind, or all, in order of update. path: where in the payload the kind is."""
    found = runs if kind is None else runs.where(F.get_json_object("payload", path) == kind)
    return found.orderBy("updated_at", "run_id")


def stored_objects(wanted: DataFrame, objects: DataFrame, legacy: DataFrame, payload: str) -> DataFrame:
    """content_hash, place, issue of wanted hashes: found in objects, else in legacy, else missing. A hash that isn't one, or content that doesn't have it, is RAW_PAYLOAD_INTEGRITY_ERROR."""
    old = legacy.select("content_hash", F.col(payload).alias("_old"), F.lit(True).alias("_there_old")).dropDuplicates(["content_hash"])
    rows = wanted.select("content_hash").distinct().join(objects.select("content_hash", F.col(payload).alias("_new"), F.lit(True).alias("_there")), "content_hash", "left").join(old, "content_hash", "left")
    place = F.when(F.col("_there"), "objects").when(F.col("_there_old"), "legacy")
    content = F.when(F.col("_there"), F.col("_new")).otherwise(F.col("_old"))
    wrong = ~F.col("content_hash").rlike("^[0-9a-f]{64}$") | place.isNull() | (F.sha2(F.coalesce(content, F.lit("")), 256) != F.col("content_hash"))
    return rows.select("content_hash", place.alias("place"), F.when(wrong, "RAW_PAYLOAD_INTEGRITY_ERROR").alias("issue"))


def document_rows(extracted: DataFrame, key: str, names: list[str]) -> DataFrame:
    """A document per extracted text: facts as a map of the names that it has, and units as a map that tells how they were normalised."""
    entries = F.filter(F.array(*[F.struct(F.lit(n).alias("k"), F.col(n).alias("v")) for n in names]), lambda e: e["v"].isNotNull())
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("UNKNOWN"))
    currency = F.when(F.col("currency_unit").isNotNull(), "CNY").otherwise("UNKNOWN")
    times = F.coalesce(F.col("multiplier").cast("bigint").cast("string"), F.lit("UNKNOWN"))
    units = F.create_map(F.lit("currency"), currency, F.lit("currency_unit"), text("currency_unit"), F.lit("normalized_unit"), F.lit("CNY"), F.lit("unit_multiplier"), times)
    return extracted.select(key, F.map_from_entries(entries).alias("facts"), units.alias("units"))


def report_status(reports: DataFrame, pointers: DataFrame, runs: DataFrame) -> DataFrame:
    """channel, report_id, shown: what a channel's pointer gives (only published reports are shown) and CURRENT, STALE_PREVIOUS_REPORT (the last run failed) or NO_REPORT. pointers: channel, report_id or null; runs: channel, succeeded."""
    good = reports.where(F.col("status").isin("PUBLISHED", "PUBLISHED_PARTIAL")).select("report_id", F.lit(True).alias("_good"))
    rows = pointers.join(runs, "channel", "left").join(good, "report_id", "left")
    failed = ~F.coalesce("succeeded", F.lit(False)) & F.col("report_id").isNotNull()
    shown = F.coalesce(first_reason({"STALE_PREVIOUS_REPORT": failed, "CURRENT": F.col("report_id").isNotNull()}), F.lit("NO_REPORT"))
    return rows.select("channel", F.when(F.col("_good"), F.col("report_id")).alias("report_id"), shown.alias("shown"))
