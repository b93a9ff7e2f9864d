"""Literal cases of the quality of facts: each filing is one case."""

import datetime as dt
import hashlib
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.operators import quality

FACT = "filing_id string, fact_id string, fact_identity_hash string, value string, decimals string, raw_qname string, canonical_name string, mapping_status string, entity_scheme string, entity_identifier string, period_start date, period_end date, instant date, unit_signature string, currency string, dimensions array<struct<axis:string,member:string>>, consolidation_scope string, report_period date, report_type string, quality_status string, _extra string"
DAY = dt.date(2025, 12, 31)


def fact(filing, fid, name, value, *, raw=None, identity=None, decimals="0", dims=(), unit="CNY"):
    mapped = name is not None
    return (filing, fid, identity or f"h-{fid}", value, decimals, raw or f"q:{name}", name, "MAPPED" if mapped else "UNMAPPED", "urn:s", "600000", None, None, DAY, f"u-{unit}", unit, list(dims), "UNKNOWN", DAY, "ANNUAL", "VALID" if mapped else "UNVERIFIED", "x")


def balance(filing, assets="100", liabilities="40", equity="60", **more):
    return [fact(filing, f"{filing}-{n}", n, v, **more) for n, v in (("assets", assets), ("liabilities", liabilities), ("equity", equity))]


CASES = [
    *balance("ok"), *balance("rounded", equity="61.5"), *balance("uneven", equity="61.6"), *balance("exact", equity="61", decimals=None), *balance("thousands", equity="1000", decimals="-3"),
    *balance("duplicate"), fact("duplicate", "duplicate-zz", "assets", "100.00", identity="h-duplicate-assets", decimals="INF"),
    *balance("clash"), fact("clash", "clash-a2", "assets", "101", identity="h-clash-assets"),
    *balance("alias"), fact("alias", "alias-z", "assets", "100.0", raw="q:other"),
    *balance("aliasclash"), fact("aliasclash", "aliasclash-z", "assets", "99", raw="q:other"),
    *balance("dimension"), fact("dimension", "dimension-z", "assets", "99", raw="q:other", dims=[("b", "2"), ("a", "1")]), fact("dimension", "dimension-y", "assets", "99", raw="q:third", dims=[("a", "1"), ("b", "2")]),
    *balance("unmapped"), fact("unmapped", "unmapped-2", None, "5"), fact("unmapped", "unmapped-1", None, "6"),
    *balance("partly")[:2], *balance("twice"), fact("twice", "twice-z", "assets", "100"),
    fact("unit", "unit-a", "assets", "1", unit="CNY"), fact("unit", "unit-b", "equity", "1", unit="USD"), fact("odd", "odd-a", "revenue", "not a number"), fact("unlisted", "x", "assets", "1"),
]
LISTED = sorted({f[0] for f in CASES} - {"unlisted"}) + ["none"]


@pytest.fixture(scope="module")
def result(spark):
    filings = spark.createDataFrame([(f, DAY, "clash") for f in LISTED], "filing_id string, collected_at date, fact_id string")
    return quality.validate_facts(filings, spark.createDataFrame(CASES, FACT).repartition(3))


def test_status(result):
    got = {r.filing_id: (r.quality_status, r.fact_count, r.conflict_count) for r in result.status.collect()}
    assert got == {
        "ok": ("VALID", 3, 0), "rounded": ("VALID", 3, 0), "uneven": ("CONFLICT", 3, 0), "exact": ("CONFLICT", 3, 0), "thousands": ("VALID", 3, 0), "duplicate": ("VALID", 3, 0), "clash": ("CONFLICT", 4, 1), "alias": ("VALID", 3, 0), "aliasclash": ("CONFLICT", 4, 1),
        "dimension": ("PARTIAL", 4, 0), "unmapped": ("PARTIAL", 5, 0), "partly": ("PARTIAL", 2, 0), "twice": ("VALID", 4, 0), "unit": ("PARTIAL", 2, 0), "odd": ("VALID", 1, 0), "none": ("PARTIAL", 0, 0)}


def test_issues(result):
    got = {}
    for r in quality.issues_in_order(result.issues).collect():
        got.setdefault(r.filing_id, []).append((r.code.removeprefix("FINANCIAL_"), r.about, r.fact_ids))
    assert got == {
        "uneven": [("BALANCE_EQUATION_CONFLICT", "context", ["uneven-assets", "uneven-equity", "uneven-liabilities"])],
        "exact": [("BALANCE_EQUATION_CONFLICT", "context", ["exact-assets", "exact-equity", "exact-liabilities"])],
        "duplicate": [("FACT_DUPLICATE", "identity", ["duplicate-assets", "duplicate-zz"])],
        # Conflicting facts leave the equation, which then lacks a part.
        "clash": [("BALANCE_COMPONENT_MISSING", "context", ["clash-equity", "clash-liabilities"]), ("FACT_CONFLICT", "identity", ["clash-a2", "clash-assets"])],
        "alias": [("FACT_ALIAS_DUPLICATE", "canonical", ["alias-assets", "alias-z"])],
        "aliasclash": [("BALANCE_COMPONENT_MISSING", "context", ["aliasclash-equity", "aliasclash-liabilities"]), ("FACT_CONFLICT", "canonical", ["aliasclash-assets", "aliasclash-z"])],
        "dimension": [("BALANCE_COMPONENT_MISSING", "context", ["dimension-y"]), ("FACT_ALIAS_DUPLICATE", "canonical", ["dimension-y", "dimension-z"])],
        "unmapped": [("FACT_UNMAPPED", "filing", ["unmapped-1", "unmapped-2"])],
        "partly": [("BALANCE_COMPONENT_MISSING", "context", ["partly-assets", "partly-liabilities"])],
        "unit": [("BALANCE_COMPONENT_MISSING", "context", ["unit-a"]), ("BALANCE_COMPONENT_MISSING", "context", ["unit-b"])],
        "none": [("NUMERIC_FACTS_MISSING", "filing", [])],
    }


def test_retained_facts(result):
    assert result.facts.columns == [c.split()[0] for c in FACT.split(", ")] + ["fact_value"]
    rows = quality.facts_in_order(result.facts).collect()
    got = {r.fact_id: r.quality_status for r in rows}
    assert len(rows) == len(got) == len(CASES) - 1 - 3 and [r.fact_id for r in rows] == sorted(got)
    assert {k for k, v in got.items() if v == "CONFLICT"} == {"clash-assets", "clash-a2", "aliasclash-assets", "aliasclash-z", *[f"{c}-{n}" for c in ("uneven", "exact") for n in quality.EQUATION]}
    assert {k for k, v in got.items() if v == "UNVERIFIED"} == {"unmapped-1", "unmapped-2"} and not {"duplicate-zz", "alias-z", "dimension-z"} & set(got)


def test_conflicts(result):
    rows = quality.conflicts_in_order(result.conflicts).collect()
    assert [r.conflict_id for r in rows] == sorted(r.conflict_id for r in rows) and {r.detected_at for r in rows} == {DAY}
    got = {r.filing_id: r for r in rows}
    assert set(got) == {"clash", "aliasclash"}
    key = ["assets", "urn:s", "600000", "", "", "2025-12-31", "u-CNY", "CNY", [], "UNKNOWN", "2025-12-31", "ANNUAL"]
    dump = lambda x: hashlib.sha256(json.dumps(x, separators=(",", ":"), sort_keys=True).encode()).hexdigest()
    alias = got["aliasclash"]
    assert alias.fact_identity_hash == dump(key) and alias.conflict_type == "CANONICAL_VALUE_MISMATCH" and got["clash"].conflict_type == "VALUE_MISMATCH"
    for r in rows:
        assert r.conflict_id == dump({"filing_id": r.filing_id, "fact_identity_hash": r.fact_identity_hash, "fact_ids": r.competing_fact_ids})


def test_no_filings_and_no_facts(spark):
    filings = spark.createDataFrame([("a", DAY)], "filing_id string, collected_at date")
    none = spark.createDataFrame([], FACT)
    assert [x.count() for x in quality.validate_facts(filings.limit(0), none)] == [0, 0, 0, 0]
    assert quality.validate_facts(filings, none).status.select("quality_status").first()[0] == "PARTIAL"


def test_rounding(spark):
    rows = spark.createDataFrame([("0",), ("-3",), ("2",), ("INF",), (None,), ("x",)], "d string")
    assert [None if r[0] is None else float(r[0]) for r in rows.select(quality.rounding(F.col("d"))).collect()] == [0.5, 500.0, 0.005, 0.0, 0.0, None]


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning") + plan.count("Exchange shufflepartition")


def test_facts_are_dealt_once_and_stored_nowhere(spark):
    stored = set(Path(spark.conf.get("spark.checkpoint.dir")).iterdir())
    filings = spark.createDataFrame([(f, DAY) for f in LISTED], "filing_id string, collected_at date")
    found = quality.validate_facts(filings, spark.createDataFrame(CASES, FACT))
    assert [exchanges(x) for x in found] == [2, 2, 2, 2]
    assert [x.count() for x in found] == [len(CASES) - 1 - 3, 2, 15, len(LISTED)]
    assert set(Path(spark.conf.get("spark.checkpoint.dir")).iterdir()) == stored


def test_hashes_are_sorted_as_bytes(spark):
    ids = spark.range(300).select(F.concat(F.lit("fact-"), F.sha2(F.col("id").cast("string"), 256)).alias("fact_id"), "id")
    want = [r.fact_id for r in ids.orderBy("fact_id").collect()]
    rows = ids.select(quality.id_bytes(F.col("fact_id")).alias("b"), "id")
    got = quality.in_hash_order(rows, "b", "id")
    assert [r[0] for r in got.select(quality.id_text(F.col("b"))).collect()] == want
    # No pass over the rows to sample ranges, and every task has some.
    assert "rangepartitioning" not in got._jdf.queryExecution().executedPlan().toString() and got.select(F.spark_partition_id()).distinct().count() == 4
