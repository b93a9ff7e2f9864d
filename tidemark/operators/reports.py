"""Gates and lineage checks before a report is published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.canonical import canonical_json
from tidemark.functions.reasons import first_reason

READY = ("VALID", "DERIVED")


def blocked_domains(domains: DataFrame) -> DataFrame:
    """report_date and the sorted list of its domains that aren't ready."""
    return domains.where(~F.col("status").isin(*READY)).groupBy("report_date").agg(F.array_join(F.array_sort(F.collect_set("domain")), ",").alias("blocked"))


def unresolved_sources(details: DataFrame, sources: DataFrame) -> DataFrame:
    """Referenced source ids without a record. details: source_record_ids."""
    used = details.select(F.explode("source_record_ids").alias("record_id")).distinct()
    return used.join(sources.select("record_id"), "record_id", "left_anti")


def cutoff_violations(details: DataFrame, sources: DataFrame) -> DataFrame:
    """candidate, record_id, reason where a source is later than the candidate that uses it. An equality join with the time test as its residual."""
    used = details.select("candidate", "as_of", "known_at", F.explode("source_record_ids").alias("record_id"))
    late = used.join(sources, "record_id").withColumn("reason", first_reason({"REPORT_SOURCE_AFTER_CANDIDATE_CUTOFF": F.col("published_at") > F.col("as_of"), "REPORT_SOURCE_NOT_KNOWN_TO_CANDIDATE": F.col("valid_from") > F.col("known_at")}))
    return late.where("reason IS NOT NULL").select("candidate", "record_id", "reason")


def source_gate(sources: DataFrame, cutoff: str, generated_at: str) -> DataFrame:
    """record_id, reason of sources that block a report: listed twice, later than the report, of bad quality. Null times of publication and effect block nothing."""
    cut, made = F.lit(cutoff).cast("date"), F.lit(generated_at).cast("date")
    twice = sources.groupBy("record_id").agg(F.count("*").alias("_n"))
    late = (F.greatest("published_at", "effective_at") > cut) | (F.greatest("collected_at", "valid_from") > made)
    reason = first_reason({"REPORT_SOURCE_RECORD_DUPLICATE": F.col("_n") > 1, "REPORT_SOURCE_CUTOFF_VIOLATION": F.coalesce(late, F.lit(False)), "REPORT_SOURCE_QUALITY_BLOCKED": ~F.col("quality_status").isin(*READY)})
    return sources.join(twice, "record_id").select("record_id", reason.alias("reason")).where("reason IS NOT NULL")


def pool_gate(candidates: DataFrame, cutoff: str, generated_at: str) -> DataFrame:
    """pool, candidates, reason: the first thing wrong with a pool of candidates: a candidate of another strategy, of another day, or later than the report. candidates: pool, strategy, report_date, wanted_date, data_cutoff_at, known_at."""
    late = (F.col("data_cutoff_at") > F.lit(cutoff).cast("date")) | (F.col("known_at") > F.lit(generated_at).cast("date"))
    per = candidates.groupBy("pool").agg(F.count("*").alias("candidates"), F.bool_or(F.col("strategy") != F.col("pool")).alias("mixed"), F.bool_or(F.col("report_date") != F.col("wanted_date")).alias("other"), F.bool_or(late).alias("late"))
    return per.select("pool", "candidates", first_reason({"REPORT_STRATEGY_POOL_MIXED": F.col("mixed"), "REPORT_CANDIDATE_DATE_MISMATCH": F.col("other"), "REPORT_CANDIDATE_CUTOFF_VIOLATION": F.col("late")}).alias("reason"))


def evidence_gate(evidence: DataFrame, versions: DataFrame, pools: DataFrame) -> DataFrame:
    """strategy, reason: why the evidence of a run can't carry its pool. The three tables have a row a strategy: evidence (version, input, insufficient, published, completed), versions (expected), pools (candidates; no row: none).

    No evidence, or no version, is incomplete; what doesn't agree is a mismatch; then a run that didn't end, had no input, or lacked data for all of it."""
    rows = versions.join(evidence, "strategy", "full").join(pools, "strategy", "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))
    c = F.col
    reason = first_reason({
        "REPORT_STRATEGY_EVIDENCE_INCOMPLETE": c("input").isNull() | c("expected").isNull(),
        "REPORT_STRATEGY_EVIDENCE_MISMATCH": (c("version") != c("expected")) | (c("published") != c("candidates")),
        "REPORT_STRATEGY_EVALUATION_INCOMPLETE": ~c("completed"),
        "REPORT_STRATEGY_EVALUATION_EMPTY": c("input") == 0,
        "REPORT_STRATEGY_ALL_DATA_INSUFFICIENT": (c("candidates") == 0) & (c("insufficient") == c("input")),
    })
    return rows.select("strategy", reason.alias("reason"))


def versions_of(pools: DataFrame, supplied: DataFrame) -> DataFrame:
    """strategy, version, issue: the version that was supplied must be that of every candidate. pools: strategy, version a candidate; supplied: strategy, version."""
    found = pools.groupBy("strategy").agg(F.min("version").alias("_lo"), F.max("version").alias("_hi"))
    rows = found.join(supplied, "strategy", "full")
    wrong = (F.col("_lo") != F.col("_hi")) | (F.col("_lo") != F.col("version"))
    return rows.select("strategy", "version", first_reason({"REPORT_STRATEGY_VERSION_SET_INCOMPLETE": F.col("version").isNull(), "REPORT_STRATEGY_VERSION_INVALID": wrong}).alias("issue"))


def manifest(head: DataFrame, pools: DataFrame, domains: DataFrame, sources: DataFrame) -> DataFrame:
    """report_id, document, manifest_hash of each report: canonical JSON of its head, its pools by strategy with their candidates by rank, its domains and its sources, all sorted.

    A report holds its pools (POOL candidates a strategy), domains and cited sources; each is gathered in one row because the document is one."""
    lists = {
        "candidate_pools": (pools, ["strategy", "rank", "code", "score"]),
        "data_domain_statuses": (domains, ["domain", "status"]),
        "source_records": (sources, ["record_id"]),
    }
    rows, fields = head, {c: F.col(c) for c in head.columns}
    for name, (part, columns) in lists.items():
        each = part.groupBy("report_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
        rows = rows.join(each, "report_id", "left")
        fields[name] = F.coalesce(name, F.array())
    document = canonical_json(fields)
    return rows.select("report_id", document.alias("document"), F.sha2(document, 256).alias("manifest_hash"))


def universe_summary(members: DataFrame) -> DataFrame:
    """One row: as_of (the least time that a component was collected), component_count, security_count and the components as JSON. members: source_id, version, collected_at a security; components are few."""
    parts = members.groupBy("source_id", "version").agg(F.min("collected_at").alias("collected_at"), F.count("*").alias("n"))
    listed = F.array_sort(F.collect_list(F.struct("source_id", "version")))
    return parts.agg(F.min("collected_at").alias("as_of"), F.count("*").alias("component_count"), F.sum("n").alias("security_count"), F.to_json(listed).alias("components"))


def event_gate(events: DataFrame, as_of: str | Column) -> DataFrame:
    """event_id, reason of events that block a report. as_of: a moment, or a column that holds it."""
    cut = F.lit(as_of) if isinstance(as_of, str) else as_of
    reason = first_reason({"REPORT_EVENT_CUTOFF_VIOLATION": F.col("published_at") > cut.cast("timestamp_ntz"), "REPORT_EVENT_QUALITY_BLOCKED": ~F.col("quality_status").isin(*READY)})
    return events.select("event_id", reason.alias("reason")).where("reason IS NOT NULL")


def memberships(pools: DataFrame) -> DataFrame:
    """code and the sorted strategies whose pools hold it."""
    return pools.groupBy("code").agg(F.array_join(F.array_sort(F.collect_set("strategy")), ",").alias("strategies"), F.count("*").alias("n"))


def places_of(pools: DataFrame, code) -> DataFrame:
    """The rows of pools that hold a security, by strategy and rank; the condition reaches the scan."""
    return pools.where(F.col("code") == code).orderBy("strategy", "rank")


def policy_decision(requests: DataFrame, policies: DataFrame, hosts: DataFrame | None = None) -> DataFrame:
    """requests with decision: ALLOWED or the first reason to deny. policies: source_id, approved, enabled, schemes, domains, purposes, http_hosts. hosts: source_id, host of allowed hosts as rows, in place of the array domains."""
    scheme, host = F.lower(F.try_parse_url(F.col("url"), F.lit("PROTOCOL"))), F.lower(F.try_parse_url(F.col("url"), F.lit("HOST")))
    rows = requests.join(policies, "source_id", "left").withColumns({"_scheme": scheme, "_host": host})
    if hosts is not None:
        rows = rows.join(hosts.select("source_id", F.lower("host").alias("_host")).distinct().withColumn("_listed", F.lit(True)), ["source_id", "_host"], "left")
    listed = F.coalesce(F.array_contains("domains", F.col("_host")) if hosts is None else F.col("_listed"), F.lit(False))
    denied = first_reason({
        "SOURCE_POLICY_MISSING": F.col("approved").isNull(),
        "SOURCE_REVIEW_REQUIRED": ~F.col("approved"),
        "SOURCE_DISABLED": ~F.col("enabled"),
        "HTTP_ENDPOINT_NOT_ALLOWED": (F.col("_scheme") == "http") & ~F.coalesce(F.array_contains("http_hosts", F.col("_host")), F.lit(False)),
        "SCHEME_NOT_ALLOWED": F.col("_scheme").isNull() | F.col("_host").isNull() | ~F.array_contains("schemes", F.col("_scheme")),
        "DOMAIN_NOT_ALLOWED": ~listed,
        "PURPOSE_NOT_ALLOWED": ~F.array_contains("purposes", F.col("purpose")),
    })
    return rows.select(*requests.columns, F.coalesce(denied, F.lit("ALLOWED")).alias("decision"))


def rate_slots(calls: DataFrame, per_minute: int, *, block: float = 3600.0) -> DataFrame:
    """source_id, call_id, slot: the second at which each call may go: next = max(asked, previous + 60 / rate).

    With calls in order, slot_n = gap * n + max over k <= n of (asked_k - gap * k): a running maximum instead of a sequential walk. Calls are ordered within blocks of time, and
    counts and maxima of blocks are summed up after, so a source with most of the calls is many tasks' work."""
    gap = 60.0 / per_minute
    key = ["source_id", "_block"]
    inner, before = Window.partitionBy(*key).orderBy("asked", "call_id"), Window.partitionBy("source_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    rows = calls.withColumn("_block", F.floor(F.col("asked") / block)).withColumn("_k", F.row_number().over(inner).cast("long"))
    # asked - gap * k of a block's calls becomes that of all calls when gap * (calls before the block) is taken off.
    rows = rows.withColumn("_lead", F.max(F.col("asked") - gap * F.col("_k")).over(inner))
    blocks = calls.groupBy("source_id", F.floor(F.col("asked") / block).alias("_block")).agg(F.count("*").alias("_n"))
    offset = F.coalesce(F.sum("_n").over(before), F.lit(0))
    tops = rows.groupBy(*key).agg(F.max("_lead").alias("_top")).join(blocks.select(*key, offset.alias("_offset")), key)
    tops = tops.select(*key, "_offset", F.max(F.col("_top") - gap * F.col("_offset")).over(before).alias("_past"))
    n = F.col("_offset") + F.col("_k")
    lead = F.greatest(F.col("_lead") - gap * F.col("_offset"), F.col("_past"))
    return rows.join(tops, key).select("source_id", "call_id", (lead + gap * n).alias("slot"))
