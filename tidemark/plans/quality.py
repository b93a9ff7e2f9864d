"""Registered queries on the quality of facts: one operator from normalised facts to what is kept, conflicts, issues and status."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import normalise, quality
from tidemark.plans.further import normalised, raw_sql
from tidemark.plans.registry import query, table

#: Two raw names for assets and two for liabilities, two names without a mapping; small round values, so that repeats, aliases and balances happen.
_MAPPING = [("q1", "assets", "BALANCE", "MONETARY"), ("q2", "liabilities", "BALANCE", "MONETARY"), ("q3", "equity", "BALANCE", "MONETARY"), ("q4", "assets", "BALANCE", "MONETARY"), ("q7", "liabilities", "BALANCE", "MONETARY")]
_LINES = """SELECT DISTINCT l_orderkey AS filing_id, 'q' || l_linenumber AS raw_qname, ((l_quantity::INT // 20) * 1000)::VARCHAR AS value, CASE WHEN l_tax > 0.06 THEN 'INF' WHEN l_tax > 0.04 THEN '-3' WHEN l_tax > 0.02 THEN '0' END AS decimals,
  'c' || CASE WHEN l_orderkey % 5 = 0 THEN 2 ELSE 0 END AS context_id, 'u1' AS unit_id FROM lineitem"""
_FACTS = raw_sql(_LINES, _MAPPING) + """, f AS MATERIALIZED (SELECT *, value::DECIMAL(38, 10) AS v, 'fact-' || sha256(to_json({'decimals': decimals, 'fact_identity_hash': fact_identity_hash, 'fact_value': value})) AS fact_id FROM i),
filing AS (SELECT o_orderkey AS filing_id FROM orders UNION ALL SELECT -o_orderkey - 1 FROM orders WHERE o_orderkey % 11 = 0),
g AS MATERIALIZED (SELECT filing_id, fact_identity_hash, count(DISTINCT v) > 1 AS clash, count(*) AS n, list(fact_id ORDER BY fact_id) AS ids FROM f GROUP BY ALL),
r1 AS MATERIALIZED (SELECT f.*, g.clash FROM f JOIN g USING (filing_id, fact_identity_hash) QUALIFY g.clash OR row_number() OVER (PARTITION BY filing_id, fact_identity_hash ORDER BY fact_id) = 1),
k AS (SELECT *, '[' || trim(to_json([canonical_name, entity_scheme, entity_identifier, coalesce(period_start, ''), coalesce(period_end, ''), coalesce(instant, ''), coalesce(unit_signature, ''), coalesce(currency, '')])::VARCHAR, '[]') || ',' || to_json(dimensions) || ',' || trim(to_json(['UNKNOWN', report_period, report_type])::VARCHAR, '[]') || ']' AS key
  FROM r1 WHERE NOT clash AND canonical_name IS NOT NULL),
a AS MATERIALIZED (SELECT filing_id, sha256(key) AS hash, list(fact_id ORDER BY fact_id) AS ids, count(DISTINCT v) = 1 AS equal FROM k GROUP BY filing_id, key HAVING count(DISTINCT raw_qname) > 1),
m AS (SELECT filing_id, unnest(ids) AS fact_id, equal, generate_subscripts(ids, 1) > 1 AS later FROM a),
r2 AS MATERIALIZED (SELECT r1.* EXCLUDE (clash), r1.clash OR coalesce(NOT m.equal, false) AS clash FROM r1 LEFT JOIN m USING (filing_id, fact_id) WHERE NOT coalesce(m.equal AND m.later, false)),
e0 AS (SELECT filing_id, list(fact_id ORDER BY fact_id) AS ids, count(*) FILTER (canonical_name = 'assets') AS na, count(*) FILTER (canonical_name = 'liabilities') AS nl, count(*) FILTER (canonical_name = 'equity') AS ne,
  abs(sum(CASE canonical_name WHEN 'assets' THEN v ELSE -v END)) > sum(CASE WHEN decimals IS NULL OR decimals = 'INF' THEN 0 ELSE 0.5 * power(10, -decimals::INT) END) AS uneven
  FROM r2 WHERE NOT clash AND canonical_name IN ('assets', 'liabilities', 'equity') GROUP BY filing_id, instant, unit_signature, currency, dimensions),
e AS MATERIALIZED (SELECT filing_id, ids, CASE WHEN least(na, nl, ne) = 0 THEN 'FINANCIAL_BALANCE_COMPONENT_MISSING' WHEN greatest(na, nl, ne) = 1 AND uneven THEN 'FINANCIAL_BALANCE_EQUATION_CONFLICT' END AS code FROM e0),
issue AS MATERIALIZED (
  SELECT filing_id, CASE WHEN clash THEN 'FINANCIAL_FACT_CONFLICT' ELSE 'FINANCIAL_FACT_DUPLICATE' END AS code, ids, 'identity' AS about FROM g WHERE clash OR n > 1
  UNION ALL SELECT filing_id, CASE WHEN equal THEN 'FINANCIAL_FACT_ALIAS_DUPLICATE' ELSE 'FINANCIAL_FACT_CONFLICT' END, ids, 'canonical' FROM a
  UNION ALL SELECT filing_id, 'FINANCIAL_FACT_UNMAPPED', list(fact_id ORDER BY fact_id), 'filing' FROM r2 WHERE canonical_name IS NULL GROUP BY filing_id
  UNION ALL SELECT filing_id, code, ids, 'context' FROM e WHERE code IS NOT NULL
  UNION ALL SELECT filing_id, 'FINANCIAL_NUMERIC_FACTS_MISSING', [], 'filing' FROM filing WHERE filing_id NOT IN (SELECT filing_id FROM f)),
kept AS MATERIALIZED (SELECT r2.filing_id, r2.fact_id, CASE WHEN clash OR u.fact_id IS NOT NULL THEN 'CONFLICT' WHEN canonical_name IS NULL THEN 'UNVERIFIED' ELSE 'VALID' END AS quality_status
  FROM r2 LEFT JOIN (SELECT filing_id, unnest(ids) AS fact_id FROM e WHERE code = 'FINANCIAL_BALANCE_EQUATION_CONFLICT') u ON u.filing_id = r2.filing_id AND u.fact_id = r2.fact_id)
"""


def _result(spark, d):
    k, q = F.col("l_linenumber"), F.col("l_quantity").cast("int")
    decimals = F.when(F.col("l_tax") > 0.06, "INF").when(F.col("l_tax") > 0.04, "-3").when(F.col("l_tax") > 0.02, "0")
    raw = normalise.dealt(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("filing_id"), F.concat(F.lit("q"), k).alias("raw_qname"), ((q - q % 20) / 20 * 1000).cast("int").cast("string").alias("value"), decimals.alias("decimals"), F.when(F.col("l_orderkey") % 5 == 0, "c2").otherwise("c0").alias("context_id"), F.lit("u1").alias("unit_id"))).distinct()
    key = F.col("o_orderkey")
    filings = table(spark, d, "orders").select(F.explode(F.when(key % 11 == 0, F.array(key, -key - 1)).otherwise(F.array(key))).alias("filing_id"), F.lit("1999-01-01").cast("date").alias("collected_at"))
    return quality.validate_facts(filings, normalised(spark, d, raw, _MAPPING))


@query(_FACTS + """SELECT filing_id, CASE WHEN bool_or(code IN ('FINANCIAL_FACT_CONFLICT', 'FINANCIAL_BALANCE_EQUATION_CONFLICT')) THEN 'CONFLICT' WHEN bool_or(code IN ('FINANCIAL_NUMERIC_FACTS_MISSING', 'FINANCIAL_FACT_UNMAPPED', 'FINANCIAL_BALANCE_COMPONENT_MISSING')) THEN 'PARTIAL' ELSE 'VALID' END AS quality_status,
  any_value(coalesce(c.n, 0)) AS fact_count, count(*) FILTER (code = 'FINANCIAL_FACT_CONFLICT') AS conflict_count FROM filing LEFT JOIN issue USING (filing_id) LEFT JOIN (SELECT filing_id, count(*) AS n FROM kept GROUP BY 1) c USING (filing_id) GROUP BY filing_id""", "facts")  # fmt: skip
def fact_quality_result(spark, d):
    return _result(spark, d).status


@query(_FACTS + "SELECT filing_id, code, about, array_to_string(ids, ',') AS fact_ids FROM issue", "facts")
def fact_quality_issues(spark, d):
    rows = _result(spark, d).issues.withColumn("fact_ids", F.transform("fact_ids", quality.id_bytes))
    return quality.issues_in_order(rows).select("filing_id", "code", "about", F.array_join(F.transform("fact_ids", quality.id_text), ",").alias("fact_ids"))


@query(_FACTS + """SELECT sha256(to_json({'fact_identity_hash': hash, 'fact_ids': ids, 'filing_id': filing_id::VARCHAR})) AS conflict_id, filing_id, hash AS fact_identity_hash, array_to_string(ids, ',') AS fact_ids, kind AS conflict_type, DATE '1999-01-01' AS detected_at FROM (
  SELECT filing_id, fact_identity_hash AS hash, ids, 'VALUE_MISMATCH' AS kind FROM g WHERE clash UNION ALL SELECT filing_id, hash, ids, 'CANONICAL_VALUE_MISMATCH' FROM a WHERE NOT equal)""", "facts")  # fmt: skip
def fact_quality_conflicts(spark, d):
    found = _result(spark, d).conflicts.select(F.unhex("conflict_id").alias("id"), "filing_id", F.unhex("fact_identity_hash").alias("of"), F.transform("competing_fact_ids", quality.id_bytes).alias("ids"), "conflict_type", "detected_at")
    hashed = lambda c: F.lower(F.hex(c))
    return quality.in_hash_order(found, "id").select(hashed("id").alias("conflict_id"), "filing_id", hashed("of").alias("fact_identity_hash"), F.array_join(F.transform("ids", quality.id_text), ",").alias("fact_ids"), "conflict_type", "detected_at")


@query(_FACTS + "SELECT filing_id, fact_id, quality_status FROM kept", "facts")
def fact_quality_facts(spark, d):
    rows = _result(spark, d).facts.select("filing_id", quality.id_bytes(F.col("fact_id")).alias("id"), "quality_status")
    return quality.in_hash_order(rows, "id", "filing_id").select("filing_id", quality.id_text(F.col("id")).alias("fact_id"), "quality_status")
