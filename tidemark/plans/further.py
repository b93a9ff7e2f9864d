"""More registered queries: normalised facts, gates before use and before publication, artifacts, and windows of events."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.functions.canonical import canonical_json, day_end, json_of_map, map_of_json, utc_text
from tidemark.operators import facts, filings, market, metrics, normalise, reports, returns, scoring, state
from tidemark.plans.catalogue import _FOLD, _SCREEN, _label_text, _score_sql, _screened
from tidemark.plans.registry import AS_OF, KNOWN_AT, query, table
from tidemark.plans.views import view
from tidemark.sources import artifacts, instances, labelled_text, tables
from tidemark.sources.staging import new_path, settle
from tidemark.streaming.windows import event_sessions, event_windows, stream_once

CNY, SHARE = normalise.CURRENCIES + "CNY", normalise.SHARES
_CUT, _KNOWN = f"DATE '{AS_OF}'", f"DATE '{KNOWN_AT}'"


def _day(x):
    return F.lit(x).cast("date")


# --- Facts -------------------------------------------------------------------------------------------------------------------

_MAPPING = [("q1", "assets", "BALANCE", "MONETARY"), ("q2", "liabilities", "BALANCE", "PER_SHARE"), ("q3", "equity", "BALANCE", "SHARES"), ("q5", "net_profit", "INCOME", "MONETARY")]
_LINES = """SELECT DISTINCT l_orderkey AS filing_id, 'q' || l_linenumber AS raw_qname, l_extendedprice::DECIMAL(18, 2)::VARCHAR AS value, CASE WHEN l_tax > 0.04 THEN '0' END AS decimals,
  'c' || CASE WHEN l_partkey % 97 = 0 THEN 9 ELSE l_linenumber % 3 END AS context_id, CASE WHEN l_linenumber % 4 <> 0 THEN 'u' || l_linenumber % 4 END AS unit_id FROM lineitem"""


def raw_sql(lines: str, mapping: list[tuple]) -> str:
    """SQL for normalised facts (i) of raw ones."""
    return f"""+raw AS ({lines}),
ctx AS (SELECT o_orderkey AS filing_id, 'c' || k AS context_id, 'urn:s' AS entity_scheme, 'E' || (o_custkey + CASE WHEN o_orderkey % 31 = 0 THEN 1 ELSE 0 END) AS entity_identifier,
  CASE WHEN k = 1 THEN (o_orderdate::DATE - 364)::VARCHAR END AS period_start, CASE WHEN k = 1 THEN o_orderdate::DATE::VARCHAR END AS period_end, CASE WHEN k <> 1 THEN o_orderdate::DATE::VARCHAR END AS instant,
  CASE WHEN k = 2 THEN [['axis:a', o_orderstatus], ['axis:b', o_orderpriority]] ELSE [] END AS dimensions FROM orders, unnest([0, 1, 2]) u(k)),
owner AS (SELECT 'E' || c_custkey AS entity_identifier, c_custkey % 41 = 0 AS shared, c_custkey AS owner FROM customer),
unit AS (SELECT * FROM (VALUES ('u1', ['{CNY}'], []::VARCHAR[], 'CNY', 'MONETARY', '{CNY}'), ('u2', ['{CNY}'], ['{SHARE}'], NULL, 'PER_SHARE', '{CNY}/{SHARE}'), ('u3', ['{SHARE}'], []::VARCHAR[], NULL, 'SHARES', '{SHARE}')) v(unit_id, over_, under_, currency, kind, unit)),
map AS (SELECT * FROM (VALUES {", ".join(map(str, mapping))}) v(raw_qname, canonical_name, statement_type, expected)),
j AS (SELECT r.*, c.* EXCLUDE (filing_id, context_id), u.* EXCLUDE (unit_id), m.* EXCLUDE (raw_qname), o_custkey AS code, o_orderdate::DATE::VARCHAR AS report_period, o_orderstatus AS report_type, w.owner, w.shared, c.context_id IS NULL AS dangling,
  CASE WHEN u.unit_id IS NOT NULL THEN sha256(to_json({{'currency': u.currency, 'denominator_measures': under_, 'numerator_measures': over_}})) END AS unit_signature
  FROM raw r JOIN orders o ON r.filing_id = o_orderkey LEFT JOIN ctx c ON r.filing_id = c.filing_id AND r.context_id = c.context_id LEFT JOIN unit u ON r.unit_id = u.unit_id LEFT JOIN map m ON r.raw_qname = m.raw_qname LEFT JOIN owner w ON c.entity_identifier = w.entity_identifier),
h AS (SELECT *, {{'instant': instant, 'period_end': period_end, 'period_start': period_start}} AS period FROM j),
i AS (SELECT *, sha256(to_json({{'dimensions': dimensions, 'entity_identifier': entity_identifier, 'entity_scheme': entity_scheme, 'filing_id': filing_id::VARCHAR, 'period': period, 'raw_qname': raw_qname, 'unit_signature': unit_signature}})) AS fact_identity_hash,
  sha256(to_json({{'consolidation_scope': 'UNKNOWN', 'dimensions': dimensions, 'entity_identifier': entity_identifier, 'entity_scheme': entity_scheme, 'period': period, 'raw_qname': raw_qname, 'report_period': report_period, 'report_type': report_type, 'unit_signature': unit_signature}})) AS comparison_identity_hash,
  sha256(to_json({{'dimensions': dimensions, 'entity_identifier': entity_identifier, 'entity_scheme': entity_scheme, 'period': period}})) AS context_signature,
  CASE WHEN dangling THEN 'FINANCIAL_XBRL_PARSE_ERROR' WHEN canonical_name IS NULL THEN NULL WHEN shared IS NULL OR shared OR owner <> code THEN 'FINANCIAL_ENTITY_MISMATCH' WHEN coalesce(kind, 'NONE') <> expected THEN 'FINANCIAL_UNIT_KIND_MISMATCH' END AS issue FROM h)
"""


_RAW = raw_sql(_LINES, _MAPPING)


def _raw_facts(spark, d):
    k, lines = F.col("l_linenumber"), table(spark, d, "lineitem")
    rows = lines.select(F.col("l_orderkey").alias("filing_id"), F.concat(F.lit("q"), k).alias("raw_qname"), F.col("l_extendedprice").cast("decimal(18,2)").cast("string").alias("value"), F.when(F.col("l_tax") > 0.04, "0").alias("decimals"),
                       F.concat(F.lit("c"), F.when(F.col("l_partkey") % 97 == 0, 9).otherwise(k % 3)).alias("context_id"), F.when(k % 4 != 0, F.concat(F.lit("u"), k % 4)).alias("unit_id"))
    return normalise.dealt(rows).distinct()


def normalised(spark, d, raw, mapping):
    orders = table(spark, d, "orders").repartition("o_orderkey")
    day = F.col("o_orderdate").cast("date")
    pair = lambda a, m: F.struct(F.lit(a).alias("axis"), F.col(m).alias("member"))
    none = F.array().cast("array<struct<axis:string,member:string>>")
    contexts = orders.withColumn("k", F.explode(F.array(*map(F.lit, range(3))))).select(
        F.col("o_orderkey").alias("filing_id"), F.concat(F.lit("c"), "k").alias("context_id"), F.lit("urn:s").alias("entity_scheme"), F.concat(F.lit("E"), F.col("o_custkey") + F.when(F.col("o_orderkey") % 31 == 0, 1).otherwise(0)).alias("entity_identifier"),
        F.when(F.col("k") == 1, F.date_sub(day, 364)).alias("period_start"), F.when(F.col("k") == 1, day).alias("period_end"), F.when(F.col("k") != 1, day).alias("instant"),
        F.when(F.col("k") == 2, F.array(pair("axis:b", "o_orderpriority"), pair("axis:a", "o_orderstatus"))).otherwise(none).alias("dimensions"))
    kinds = spark.createDataFrame([("u1", [CNY], []), ("u2", [CNY], [SHARE]), ("u3", [SHARE], [])], "unit_id string, over array<string>, under array<string>")
    units = orders.select(F.col("o_orderkey").alias("filing_id")).crossJoin(F.broadcast(kinds))
    rows = orders.select(F.col("o_orderkey").alias("filing_id"), F.col("o_custkey").alias("code"), day.alias("report_period"), F.col("o_orderstatus").alias("report_type"), F.lit("f1").alias("filing_version"), F.lit("p1").alias("parser_version"))
    c = F.col("c_custkey")
    registry = table(spark, d, "customer").select(F.lit("urn:s").alias("entity_scheme"), F.concat(F.lit("E"), c).alias("entity_identifier"), F.explode(F.when(c % 41 == 0, F.array(c, c + 1)).otherwise(F.array(c, c))).alias("code"))
    mapping = spark.createDataFrame(mapping, "raw_qname string, canonical_name string, statement_type string, expected_kind string")
    return normalise.normalise_facts(raw, contexts, units, rows, mapping, normalise.owners_of(registry))


def _normalised(spark, d):
    return normalised(spark, d, _raw_facts(spark, d), _MAPPING)


@query(_RAW + """SELECT filing_id, raw_qname, 'fact-' || sha256(to_json({'decimals': decimals, 'fact_identity_hash': fact_identity_hash, 'fact_value': value})) AS fact_id, fact_identity_hash, comparison_identity_hash, context_signature,
  CASE WHEN canonical_name IS NULL THEN 'UNMAPPED' ELSE 'MAPPED' END AS mapping_status, CASE WHEN canonical_name IS NULL THEN 'UNVERIFIED' ELSE 'VALID' END AS quality_status, coalesce(statement_type, 'OTHER') AS statement_type, unit, issue, 'f1:p1:1' AS version FROM i""", "facts")
def fact_normalised(spark, d):
    return _normalised(spark, d).select("filing_id", "raw_qname", "fact_id", "fact_identity_hash", "comparison_identity_hash", "context_signature", "mapping_status", "quality_status", "statement_type", "unit", "issue", "version")


@query(_RAW + "SELECT coalesce(kind, 'NONE') AS unit_kind, issue, count(*) AS n FROM i GROUP BY ALL", "facts")
def fact_unit_kind(spark, d):
    return _normalised(spark, d).groupBy(F.coalesce("unit_kind", F.lit("NONE")).alias("unit_kind"), "issue").agg(F.count("*").alias("n"))


@query("SELECT filing_id, raw_name, count(*) AS n, count(DISTINCT value) AS values FROM facts GROUP BY ALL HAVING count(DISTINCT value) > 1", "facts")
def fact_conflicts(spark, d):
    return facts.identity_groups(view(spark, d, "facts"), "filing_id", "raw_name").where("status = 'FINANCIAL_FACT_CONFLICT'").select("filing_id", "raw_name", "n", "values")


@query("SELECT filing_id, 'FINANCIAL_FACT_UNMAPPED' AS code, count(*) AS n, string_agg(fact_id, ',' ORDER BY fact_id) AS fact_ids FROM facts WHERE name IS NULL GROUP BY filing_id", "facts")
def fact_unmapped_issues(spark, d):
    return facts.unmapped_issues(view(spark, d, "facts"))


@query("""+g AS (SELECT filing_id, raw_name, count(*) AS n, count(DISTINCT value) AS v, min(fact_id) AS kept FROM facts GROUP BY ALL)
SELECT f.filing_id, f.fact_id, CASE WHEN g.v > 1 THEN 'CONFLICT' WHEN f.name IS NULL THEN 'UNVERIFIED' ELSE f.quality_status END AS quality_status FROM facts f JOIN g ON f.filing_id = g.filing_id AND f.raw_name = g.raw_name WHERE g.v > 1 OR f.fact_id = g.kept""", "facts")  # fmt: skip
def fact_retained(spark, d):
    return facts.retained(view(spark, d, "facts"), "filing_id", "raw_name").select("filing_id", "fact_id", "quality_status")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, to_json({'a': l_returnflag, 'b': l_linestatus, 'c': l_partkey::VARCHAR}) AS dimensions, l_linestatus AS b FROM lineitem""")
def fact_dimensions(spark, d):
    """Dimensions as a map, stored as canonical JSON and decoded again."""
    rows = table(spark, d, "lineitem").withColumn("m", F.create_map(F.lit("c"), F.col("l_partkey").cast("string"), F.lit("b"), F.col("l_linestatus"), F.lit("a"), F.col("l_returnflag")))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", json_of_map(F.col("m")).alias("dimensions")).withColumn("b", map_of_json(F.col("dimensions"))["b"])


@query("SELECT o_orderkey, strftime(o_orderdate::DATE + INTERVAL '15:59:59', '%Y-%m-%dT%H:%M:%S.000000Z') AS effective_at FROM orders")
def effective_times(spark, d):
    return table(spark, d, "orders").select("o_orderkey", utc_text(day_end(F.col("o_orderdate").cast("date"))).alias("effective_at"))


_NAMES = ("equity", "assets", "net_profit")


@query(f"""/*RECURSE*/+seen AS (SELECT * FROM filings WHERE published_at <= {_CUT} AND valid_from <= {_KNOWN}),
walk AS (SELECT entity, filing_id, 1 AS depth FROM seen WHERE supersedes_id IS NULL UNION ALL SELECT s.entity, s.filing_id, w.depth + 1 FROM seen s JOIN walk w ON s.supersedes_id = w.filing_id AND s.entity = w.entity),
picked AS (SELECT t.entity, r.leaf FROM (SELECT entity, count(*) AS n, count(*) FILTER (supersedes_id IS NULL) AS roots FROM seen GROUP BY entity) t JOIN (SELECT entity, count(*) AS n, max(depth) AS depth, max_by(filing_id, depth) AS leaf FROM walk GROUP BY entity) r ON t.entity = r.entity AND t.n = r.n AND t.n = r.depth AND t.roots = 1)
SELECT p.entity, f.name, f.fact_id, f.value FROM picked p JOIN filings g ON g.filing_id = p.leaf AND g.quality_status NOT IN ('CONFLICT', 'REJECTED', 'UNVERIFIED') JOIN facts f ON f.filing_id = p.leaf WHERE f.quality_status = 'VALID' AND f.name IN {_NAMES} AND p.entity BETWEEN 100 AND 900""", "filings", "facts")
def asof_fact_query(spark, d):
    found = filings.query_facts(view(spark, d, "facts"), view(spark, d, "filings"), AS_OF, KNOWN_AT, names=_NAMES, where=F.col("entity").between(100, 900))
    return found.select("entity", "name", "fact_id", "value")


@query("""WITH old AS (SELECT o_custkey AS code, o_orderpriority AS kind, o_orderkey, o_orderdate FROM orders WHERE o_orderstatus <> 'P'), new AS (SELECT o_custkey AS code, o_orderpriority AS kind, o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'P')
SELECT n.o_orderkey AS filing_id, max_by(o.o_orderkey, {'d': o.o_orderdate, 'k': o.o_orderkey}) FILTER (o.o_orderdate < n.o_orderdate) AS supersedes_id, count(o.o_orderkey) FILTER (o.o_orderdate < n.o_orderdate) > 0 AS is_restated,
  CASE WHEN count(o.o_orderkey) FILTER (o.o_orderdate >= n.o_orderdate) > 0 THEN 'FINANCIAL_BACKFILL_UNSUPPORTED' END AS issue FROM new n LEFT JOIN old o ON n.code = o.code AND n.kind = o.kind GROUP BY n.o_orderkey""")
def candidate_filings(spark, d):
    rows = table(spark, d, "orders").select(F.lit("s").alias("source_id"), F.col("o_custkey").alias("code"), F.lit("p").alias("report_period"), F.col("o_orderpriority").alias("report_type"), F.col("o_orderkey").alias("filing_id"), F.col("o_orderdate").alias("published_at"),
                                            F.col("o_orderkey").alias("ordinal"), F.when(F.col("o_orderstatus") != "P", "PUBLISHED").otherwise("STAGED").alias("artifact_status"))
    return normalise.candidate_filings(rows.where("artifact_status = 'STAGED'"), rows).select("filing_id", "supersedes_id", "is_restated", "issue")


@query("SELECT o_orderkey AS request, u.place::INT AS place, u.id AS taxonomy_id, n_name AS payload, n_name IS NULL AS missing FROM (SELECT o_orderkey, [o_custkey % 30, o_orderkey % 25] AS ids FROM orders) o, LATERAL (SELECT unnest(ids) AS id, generate_subscripts(ids, 1) - 1 AS place) u LEFT JOIN nation ON n_nationkey = u.id")
def taxonomy_requests(spark, d):
    ids = table(spark, d, "orders").select(F.col("o_orderkey").alias("request"), F.array(F.col("o_custkey") % 30, F.col("o_orderkey") % 25).alias("ids"))
    registry = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("taxonomy_id"), F.col("n_name").alias("payload"))
    return normalise.requested(ids, registry).select("request", "place", "taxonomy_id", "payload", "missing")


@query("""+g AS (SELECT filing_id, raw_name, count(DISTINCT value) > 1 AS clash FROM facts GROUP BY ALL), c AS (SELECT filing_id, count(*) FILTER (clash) AS conflict_count FROM g GROUP BY 1), n AS (SELECT filing_id, count(*) AS fact_count FROM facts GROUP BY 1)
SELECT filing_id, CASE WHEN conflict_count > 0 THEN 'CONFLICT' ELSE 'VALID' END AS quality_status, conflict_count, fact_count, DATE '1999-01-01' AS valid_from FROM c JOIN n USING (filing_id) JOIN filings USING (filing_id)""", "facts", "filings")
def filings_finalised(spark, d):
    rows = view(spark, d, "facts")
    groups = facts.identity_groups(rows, "filing_id", "raw_name").groupBy("filing_id").agg(F.count_if(F.col("status") == "FINANCIAL_FACT_CONFLICT").alias("conflict_count"))
    status = groups.withColumn("quality_status", F.when(F.col("conflict_count") > 0, "CONFLICT").otherwise("VALID"))
    return normalise.finalise(view(spark, d, "filings"), rows, status, _day("1999-01-01"))[0].select("filing_id", "quality_status", "conflict_count", "fact_count", "valid_from")


# --- Instances, attachments and archives -------------------------------------------------------------------------------------


def _orders(spark, d):
    """Orders dealt over all tasks: a file of some megabytes is one task's else, and with it the parsing of a million instances."""
    return table(spark, d, "orders").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")


def _files(spark, d):
    """A tagged instance of each order as XML."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    head = ('<?xml version="1.0"?><x:xbrl xmlns:x="http://www.xbrl.org/2003/instance" xmlns:i="http://www.xbrl.org/2003/iso4217" xmlns:d="http://xbrl.org/2006/xbrldi" xmlns:t="urn:t" xmlns:n="http://www.w3.org/2001/XMLSchema-instance">')
    entity = F.concat(F.lit('<x:entity><x:identifier scheme="urn:s">'), F.col("o_custkey"), F.lit("</x:identifier></x:entity>"))
    xml = F.concat(F.lit(head), F.lit('<x:context id="a">'), entity, F.lit("<x:period><x:instant>"), day, F.lit('</x:instant></x:period><x:scenario><d:explicitMember dimension="t:axis">t:'), F.col("o_orderstatus"), F.lit('</d:explicitMember></x:scenario></x:context><x:context id="b">'), entity, F.lit("<x:period><x:startDate>1990-01-01</x:startDate><x:endDate>"), day,
                   F.lit('</x:endDate></x:period></x:context><x:unit id="u"><x:measure>i:CNY</x:measure></x:unit><t:Assets contextRef="a" unitRef="u" decimals="0">'), F.round("o_totalprice").cast("long"), F.lit('</t:Assets><t:Tuple><t:Revenue contextRef="b" unitRef="u">'), F.col("o_orderkey"), F.lit("</t:Revenue></t:Tuple>"),
                   F.when(F.col("o_orderkey") % 3 == 0, F.lit('<t:Assets contextRef="a" unitRef="u" n:nil="true"/>')).otherwise(""), F.lit('<t:Note contextRef="b">text</t:Note>'), F.when(F.col("o_orderkey") % 101 == 0, "").otherwise(F.lit("</x:xbrl>")))
    return _orders(spark, d).select(F.col("o_orderkey").cast("string").alias("path"), F.encode(xml, "UTF-8").alias("content"))


def _instances(spark, d):
    return instances.read_instances(_files(spark, d))


@query("""SELECT o_orderkey::VARCHAR AS path, k AS context_id, o_custkey::VARCHAR AS entity_identifier, CASE WHEN k = 'b' THEN DATE '1990-01-01' END AS period_start, CASE WHEN k = 'b' THEN o_orderdate::DATE END AS period_end, CASE WHEN k = 'a' THEN o_orderdate::DATE END AS instant,
  CASE WHEN k = 'a' THEN '[{"axis":"{urn:t}axis","member":"{urn:t}' || o_orderstatus || '"}]' ELSE '[]' END AS dimensions FROM orders, unnest(['a', 'b']) u(k) WHERE o_orderkey % 101 <> 0""")
def xbrl_contexts(spark, d):
    rows = instances.contexts_of(_instances(spark, d))
    return rows.select("path", "context_id", "entity_identifier", "period_start", "period_end", "instant", F.to_json("dimensions").alias("dimensions"))


@query("""SELECT o_orderkey::VARCHAR AS path, q AS raw_qname, CASE WHEN q = '{urn:t}Assets' THEN round(o_totalprice)::BIGINT::VARCHAR ELSE o_orderkey::VARCHAR END AS value, CASE WHEN q = '{urn:t}Assets' THEN '0' END AS decimals, CASE WHEN q = '{urn:t}Assets' THEN 'a' ELSE 'b' END AS context_id, 'u' AS unit_id
  FROM orders, unnest(['{urn:t}Assets', '{urn:t}Revenue']) u(q) WHERE o_orderkey % 101 <> 0""")
def xbrl_facts(spark, d):
    # Settled, for a sort reads its rows twice and they are parsed once; by path, for all files have the same two names.
    rows = settle(instances.facts_of(_instances(spark, d)).where("issue IS NULL").select("path", "raw_qname", "value", "decimals", "context_id", "unit_id"), "instance-facts")
    return normalise.in_order(rows, "path").select("path", "raw_qname", "value", "decimals", "context_id", "unit_id")


@query("SELECT CASE WHEN o_orderkey % 101 = 0 THEN 'FINANCIAL_XBRL_PARSE_ERROR' END AS issue, count(*) AS files, sum(CASE WHEN o_orderkey % 101 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS nil_facts, sum(CASE WHEN o_orderkey % 101 <> 0 THEN 1 END)::BIGINT AS text_facts FROM orders GROUP BY 1")
def xbrl_diagnostics(spark, d):
    return _instances(spark, d).groupBy("issue").agg(F.count("*").alias("files"), F.sum("nil_facts").alias("nil_facts"), F.sum("text_facts").alias("text_facts"))


@query("SELECT CASE WHEN o_orderkey < 0 THEN 'unsafe-' ELSE '' END || o_orderkey AS path, CASE WHEN o_orderkey < 0 THEN 'FINANCIAL_XML_UNSAFE' WHEN o_orderkey % 101 = 0 THEN 'FINANCIAL_XBRL_PARSE_ERROR' ELSE '' END AS codes FROM (SELECT o_orderkey FROM orders UNION ALL SELECT -o_orderkey - 1 FROM orders WHERE o_orderkey % 13 = 0)")
def instance_codes(spark, d):
    """The diagnostic codes of every instance; some more have a document type with an entity."""
    key = _orders(spark, d).where("o_orderkey % 13 = 0").select((-F.col("o_orderkey") - 1).alias("k"))
    more = key.select(F.concat(F.lit("unsafe-"), "k").alias("path"), F.encode(F.lit('<?xml version="1.0"?><!DOCTYPE x [<!ENTITY a "77">]><x>&a;</x>'), "UTF-8").alias("content"))
    found = instances.read_instances(_files(spark, d).union(more))
    return instances.instance_codes(found).select("path", F.array_join("codes", ",").alias("codes"))


@query("""SELECT page_id, CASE WHEN page_id % 6 = 5 OR (page_id % 6 = 4 AND page_id % 2 = 0) THEN 'FINANCIAL_ATTACHMENT_TYPE_INVALID' WHEN regexp_matches(html, '^[ \\t\\r\\n]*<') AND regexp_matches(html, '(?i)<!(doctype|entity)') THEN 'FINANCIAL_XML_UNSAFE' WHEN NOT regexp_matches(html, '^[ \\t\\r\\n]*<') THEN 'FINANCIAL_ATTACHMENT_TYPE_INVALID' END AS reason FROM pages""")
def attachment_reasons(spark, d):
    k = F.col("page_id")
    path = F.concat(k.cast("string"), F.when(k % 6 == 5, ".zip").when(k % 6 == 4, ".TXT").otherwise(".Xml"))
    files = table(spark, d, "pages").select("page_id", path.alias("path"), F.encode("html", "UTF-8").alias("content"), F.when(k % 6 == 5, "application/zip").otherwise("Text/XML; charset=utf-8").alias("content_type"))
    return instances.attachment_reason(files).select("page_id", "reason")


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for k, html in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist()):
            data = io.BytesIO()
            with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("../page.html" if k % 17 == 0 else "page.html", html)
                z.writestr("notes/id.txt", str(k))
            out.append(data.getvalue()[: -30 if k % 13 == 0 else None])
        yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.string()), pa.array(out, pa.binary())], names=["path", "content"])


@query("""SELECT page_id::VARCHAR AS path, CASE WHEN page_id % 13 = 0 OR page_id % 17 = 0 THEN 0 ELSE 2 END::BIGINT AS files, CASE WHEN page_id % 13 = 0 OR page_id % 17 = 0 THEN 0 ELSE octet_length(encode(html)) + length(page_id::VARCHAR) END::BIGINT AS bytes,
  CASE WHEN page_id % 13 = 0 THEN 'FINANCIAL_ARCHIVE_INVALID' WHEN page_id % 17 = 0 THEN 'FINANCIAL_ARCHIVE_UNSAFE_PATH' END AS reason FROM pages""")
def archive_inventory(spark, d):
    files = table(spark, d, "pages").select("page_id", "html").mapInArrow(_zipped, "path string, content binary")
    return tables.archive_totals(tables.archive_members(files))


# --- Market data and the universe --------------------------------------------------------------------------------------------


@query("SELECT trade_date, 2::BIGINT AS files FROM (SELECT DISTINCT trade_date, code % 2 AS p FROM bars) GROUP BY trade_date HAVING count(*) = 2", "bars")
def bars_multi_artifact_guard(spark, d):
    bars, path = view(spark, d, "bars").select("code", "trade_date", "close"), new_path(spark, "two-artifacts")
    for p in (0, 1):
        bars.where(F.col("code") % 2 == p).repartition("trade_date").write.mode("append").parquet(path)
    return market.single_artifact_guard(spark.read.parquet(path)).select("trade_date", "files")


_PROVIDED = """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber = 7 THEN '1996013' ELSE strftime(l_shipdate, '%Y%m%d') END AS t, l_partkey || CASE l_partkey % 3 WHEN 0 THEN '.SH' WHEN 1 THEN '.SZ' ELSE '.BJ' END AS ts_code, l_partkey % 19 = 0 AS nan, l_suppkey % 23 = 0 AS low, year(l_shipdate) <> 1996 AS other FROM lineitem)
"""


def _provided(spark, d):
    """Provider rows as text. The requested day is that of the row, but for rows outside 1996."""
    k = F.col("l_partkey")
    t = F.when(F.col("l_linenumber") == 7, "1996013").otherwise(F.date_format("l_shipdate", "yyyyMMdd"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", t.alias("trade_date"), F.concat(k.cast("string"), F.when(k % 3 == 0, ".SH").when(k % 3 == 1, ".SZ").otherwise(".BJ")).alias("ts_code"), F.col("l_shipdate").cast("date").alias("_d"),
                                              *[F.lit("10.5").alias(c) for c in ("open", "high", "close", "pre_close", "vol")], F.when(F.col("l_suppkey") % 23 == 0, "11").otherwise("10").alias("low"), F.when(k % 19 == 0, "NaN").otherwise("1e3").alias("amount"))
    requested = F.when(F.year("_d") == 1996, F.col("_d")).otherwise(F.date_add("_d", 1))
    return rows, requested


@query(_PROVIDED + "SELECT CASE WHEN length(t) <> 8 THEN 'TUSHARE_TRADE_DATE_INVALID' WHEN other THEN 'TUSHARE_TRADE_DATE_MISMATCH' WHEN nan OR low THEN 'TUSHARE_ROW_INVALID' END AS issue, count(*) AS n, min(CASE WHEN length(t) = 8 THEN ts_code || '-' || t || '-abcdefabcdef' END) AS first_id FROM r GROUP BY 1")
def provider_bars(spark, d):
    rows, requested = _provided(spark, d)
    bars = market.provider_bars(rows, requested, F.lit("abcdef" * 10), F.lit("1998-01-01").cast("timestamp"))
    return bars.groupBy("issue").agg(F.count("*").alias("n"), F.min("record_id").alias("first_id"))


@query(_PROVIDED + """, day AS (SELECT ts_code FROM r WHERE t = '19960315')
SELECT ts_code, 'MARKET_DAILY_DUPLICATE_TS_CODE' AS issue FROM day GROUP BY ts_code HAVING count(*) > 1 UNION ALL SELECT DISTINCT ts_code, 'MARKET_DAILY_OUT_OF_SCOPE' FROM day WHERE ts_code NOT LIKE '%.BJ' AND split_part(ts_code, '.', 1)::BIGINT % 5 = 0""")
def daily_bar_issues(spark, d):
    day = _provided(spark, d)[0].where("trade_date = '19960315'")
    approved = table(spark, d, "part").where("p_partkey % 5 <> 0").select(F.concat(F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 3 == 0, ".SH").when(F.col("p_partkey") % 3 == 1, ".SZ").otherwise(".BJ")).alias("ts_code"))
    return market.daily_bars(day, approved)[1]


@query("SELECT code, CASE WHEN code % 17 = 0 THEN 'SECURITY_MASTER_ROW_INVALID' WHEN NOT ((code % 2 = 0 AND venue IN ('MAIN_SH', 'STAR')) OR (code % 2 = 1 AND venue IN ('MAIN_SZ', 'CHINEXT'))) THEN 'SECURITY_MASTER_SOURCE_MISMATCH' END AS issue FROM master", "master")
def master_violations(spark, d):
    c, sse = F.col("code"), F.col("code") % 2 == 0
    rows = view(spark, d, "master").select("code", F.when(sse, "sse").otherwise("szse").alias("source_id"), F.when(sse, "SSE").otherwise("SZSE").alias("exchange"), F.concat(c.cast("string"), F.when(sse, ".SH").otherwise(".SZ")).alias("ts_code"), F.col("venue").alias("board"), c.cast("string").alias("symbol"),
                                           F.when(c % 17 == 0, "").otherwise("n").alias("name"), "currency", "security_type", F.lit("19960101").alias("list_date"))
    return market.master_violations(rows).select("code", "issue")


@query("SELECT min(d) AS as_of, count(*) AS component_count, sum(n)::BIGINT AS security_count, to_json(list({'source_id': s, 'version': v} ORDER BY s, v)) AS components FROM (SELECT o_orderpriority AS s, o_orderstatus AS v, min(o_orderdate)::DATE AS d, count(*) AS n FROM orders GROUP BY ALL)")
def snapshot_asof_min(spark, d):
    return reports.universe_summary(table(spark, d, "orders").select(F.col("o_orderpriority").alias("source_id"), F.col("o_orderstatus").alias("version"), F.col("o_orderdate").cast("date").alias("collected_at")))


@query("SELECT snapshot_id, n AS members FROM (SELECT o_custkey, max(o_orderkey) AS snapshot_id FROM orders GROUP BY 1) s JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) m ON l_orderkey = snapshot_id")
def snapshot_members(spark, d):
    last = market.latest_per(table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("snapshot_id")), "o_custkey", "snapshot_id")
    return table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "snapshot_id").join(last, "snapshot_id").groupBy("snapshot_id").agg(F.count("*").alias("members"))


@query("SELECT count(*) FILTER (d <= DATE '1995-06-30') AS completed, max(d) FILTER (d <= DATE '1995-06-30') AS last_trade_date FROM (SELECT DISTINCT trade_date AS d FROM bars)", "bars")
def checkpoint_progress(spark, d):
    done = F.col("trade_date") <= _day("1995-06-30")
    return view(spark, d, "bars").select("trade_date").distinct().agg(F.count_if(done).alias("completed"), F.max(F.when(done, F.col("trade_date"))).alias("last_trade_date"))


# --- Gates before values are used --------------------------------------------------------------------------------------------


def _action_rows(spark, d):
    c = F.col("code")
    late = F.date_add("ex_date", ((c % 40) - 60).cast("int"))
    return view(spark, d, "actions").withColumns({"published_at": F.when(c % 53 != 0, late), "valid_from": F.date_add(late, (c % 300).cast("int")), "quality_status": F.when(c % 7 == 0, "CONFLICT").otherwise("VALID"), "ordinal": F.col("record_id")})


@query(f"""+a AS (SELECT code, record_id, CASE WHEN code % 53 = 0 OR ex_date + (code % 40 - 60)::INT > {_CUT} THEN 'CORPORATE_ACTION_PUBLICATION_AFTER_CUTOFF' WHEN ex_date + (code % 40 - 60 + code % 300)::INT > {_KNOWN} THEN 'CORPORATE_ACTION_NOT_KNOWN_AT_CUTOFF' WHEN code % 7 = 0 THEN 'CORPORATE_ACTION_QUALITY_BLOCKED' END AS reason FROM actions)
SELECT code, min_by(reason, record_id) AS reason FROM a WHERE reason IS NOT NULL GROUP BY code""", "actions")
def total_return_actions(spark, d):
    return returns.blocked_actions(_action_rows(spark, d), AS_OF, KNOWN_AT)


@query(f"""+per AS (SELECT code, ex_date, list({{'k': record_id, 't': action_type, 'r': ratio::DOUBLE, 'p': price::DOUBLE, 's': 1.0::DOUBLE, 'c': 0.0::DOUBLE, 'x': 0.0::DOUBLE}} ORDER BY record_id) AS acts FROM actions WHERE action_status <> 'CANCELLED' GROUP BY code, ex_date),
folded AS (SELECT b.code, b.trade_date, b.close, {_FOLD} AS f FROM bars b LEFT JOIN per a ON a.code = b.code AND a.ex_date = b.trade_date),
steps AS (SELECT *, lag(close) OVER (PARTITION BY code ORDER BY trade_date) AS before FROM folded)
SELECT code, trade_date, round(product(CASE WHEN before IS NULL THEN 1 ELSE (close * f.s + f.c - f.x) / before END) OVER (PARTITION BY code ORDER BY trade_date), 6) AS index FROM steps""", "bars", "actions")
def total_return_first_actions(spark, d):
    """Every action is reported again later, with another ratio, which changes nothing."""
    once = view(spark, d, "actions").withColumn("ordinal", F.lit(1))
    both = once.unionByName(once.withColumns({"ordinal": F.lit(2), "ratio": F.col("ratio") * 3}))
    return returns.total_return(view(spark, d, "bars"), returns.first_actions(both)).select("code", "trade_date", F.round("index", 6).alias("index"))


@query(f"""+b AS (SELECT code, trade_date, CASE WHEN trade_date > {_CUT} OR trade_date + (code % 3)::INT > {_CUT} THEN 'MARKET_BAR_AFTER_CUTOFF' WHEN greatest(trade_date + (code % 40)::INT, trade_date + (code % 90)::INT) > {_KNOWN} THEN 'MARKET_BAR_NOT_KNOWN_AT_CUTOFF' WHEN code % 31 = 0 THEN 'MARKET_BAR_QUALITY_BLOCKED' END AS reason FROM bars WHERE trade_date < DATE '1997-08-01')
SELECT code, min_by(reason, trade_date) AS reason FROM b WHERE reason IS NOT NULL GROUP BY code""", "bars")
def total_return_bar_gates(spark, d):
    plus = lambda k: F.date_add("trade_date", (F.col("code") % k).cast("int"))
    bars = view(spark, d, "bars").where("trade_date < DATE '1997-08-01'").withColumns({"effective_at": plus(3), "collected_at": plus(40), "valid_from": plus(90), "quality_status": F.when(F.col("code") % 31 == 0, "MISSING").otherwise("DERIVED")})
    return returns.blocked_series(bars, AS_OF, KNOWN_AT, effective="effective_at", collected="collected_at")


@query(f"""+x AS (SELECT f.filing_id, fact_id, f.quality_status, published_at, valid_from, row_number() OVER (PARTITION BY f.filing_id, name ORDER BY fact_id) AS nth FROM facts f JOIN filings g ON f.filing_id = g.filing_id WHERE name IS NOT NULL),
r AS (SELECT filing_id, fact_id, CASE WHEN published_at > {_CUT} THEN 'FINANCIAL_INPUT_AFTER_CUTOFF' WHEN valid_from > {_KNOWN} THEN 'FINANCIAL_INPUT_NOT_KNOWN_AT_CUTOFF' WHEN quality_status IN ('CONFLICT', 'REJECTED', 'UNVERIFIED') THEN 'FINANCIAL_INPUT_QUALITY_BLOCKED' WHEN nth > 1 THEN 'FINANCIAL_INPUT_DUPLICATE' END AS reason FROM x)
SELECT filing_id, min_by(reason, fact_id) FILTER (reason IS NOT NULL) AS reason FROM r GROUP BY filing_id""", "facts", "filings")
def metrics_input_gates(spark, d):
    rows = view(spark, d, "facts").where("name IS NOT NULL").join(view(spark, d, "filings").select("filing_id", "published_at", "valid_from"), "filing_id")
    return metrics.input_gate(rows, "filing_id", AS_OF, KNOWN_AT)


@query(f"SELECT p_partkey, CASE WHEN DATE '1997-01-01' + (p_partkey % 240)::INT > {_CUT} THEN 'MARKET_VALUATION_AFTER_CUTOFF' WHEN DATE '1997-01-01' + (p_partkey % 240 + greatest(p_size, p_partkey % 80))::INT > {_KNOWN} THEN 'MARKET_VALUATION_NOT_KNOWN_AT_CUTOFF' WHEN p_size % 5 = 0 THEN 'MARKET_VALUATION_QUALITY_BLOCKED' END AS reason FROM part")
def metrics_valuation_gate(spark, d):
    day = F.date_add(_day("1997-01-01"), (F.col("p_partkey") % 240).cast("int"))
    values = table(spark, d, "part").withColumns({"effective_at": day, "collected_at": F.date_add(day, F.col("p_size")), "valid_from": F.date_add(day, (F.col("p_partkey") % 80).cast("int")), "quality_status": F.when(F.col("p_size") % 5 == 0, "REJECTED").otherwise("VALID")})
    return metrics.valuation_gate(values, AS_OF, KNOWN_AT).select("p_partkey", "reason")


# --- Strategies --------------------------------------------------------------------------------------------------------------


def _factor_rows(spark, d, strategy):
    """Long factor rows with quality, sources and times. Stand-ins: the six numbers for the strategy's factors in order; a factor of a security has the times of its code."""
    c = F.col("code")
    wide = view(spark, d, "factors").join(view(spark, d, "master").select("code", "industry"), "code")
    each = F.array(*[F.struct(F.lit(i).alias("k"), F.lit(f).alias("factor"), F.round(F.col(f"f{i}").cast("double"), 9).alias("value")) for i, (f, _, _) in enumerate(scoring.STRATEGIES[strategy], 1)])
    rows = wide.select("code", "industry", F.explode(each).alias("x")).select("code", "industry", "x.*").where((c + F.col("k")) % 29 != 0)
    day = F.date_add(_day("1997-06-01"), ((c * 7 + F.col("k")) % 32).cast("int"))
    return rows.withColumns({"quality_status": F.when((c + F.col("k")) % 23 == 0, "CONFLICT").when(c % 2 == 0, "VALID").otherwise("DERIVED"), "source_record_ids": F.array(F.concat_ws("-", c, "k")), "published_at": day, "effective_at": F.date_sub(day, 1), "collected_at": F.date_add(day, 40), "valid_from": F.date_add(day, ((c % 3) * 15).cast("int"))})


def _factor_rows_sql(strategy):
    spec = scoring.STRATEGIES[strategy]
    long = " UNION ALL ".join(f"SELECT f.code, industry, {i} AS k, '{f}' AS factor, {w}::DOUBLE AS weight, {c} AS critical, round(f{i}::DOUBLE, 9) AS value FROM factors f JOIN master m ON f.code = m.code WHERE (f.code + {i}) % 29 <> 0" for i, (f, w, c) in enumerate(spec, 1))
    return f"""all_rows AS MATERIALIZED ({long}),
timed AS MATERIALIZED (SELECT *, CASE WHEN (code + k) % 23 = 0 THEN 'CONFLICT' WHEN code % 2 = 0 THEN 'VALID' ELSE 'DERIVED' END AS quality_status, value IS NOT NULL AND (code + k) % 23 <> 0 AND DATE '1997-06-01' + ((code * 7 + k) % 32)::INT <= {_CUT} AND DATE '1997-06-01' + ((code * 7 + k) % 32 + 40)::INT <= {_KNOWN} AND DATE '1997-06-01' + ((code * 7 + k) % 32 + (code % 3) * 15)::INT <= {_KNOWN} AS available FROM all_rows)"""


@query(f"+{_factor_rows_sql('quality-growth-v1')} SELECT code, factor, available FROM timed", "factors", "master")
def factor_availability(spark, d):
    return _factor_rows(spark, d, "quality-growth-v1").select("code", "factor", scoring.available(AS_OF, KNOWN_AT).alias("available"))


def _details_sql(strategy):
    spec = scoring.STRATEGIES[strategy]
    # The scores' own SQL over the rows that are available.
    body = _score_sql(strategy)
    start = body.index(", fit AS")
    long = f"+{_factor_rows_sql(strategy)}, long AS MATERIALIZED (SELECT code, industry, factor, weight, critical, CASE WHEN available THEN value END AS value FROM timed)"
    every = ", ".join(f"({i}, '{f}', {w}::DOUBLE)" for i, (f, w, _) in enumerate(spec))
    return f"""{long}{body[start:]}, det AS (SELECT fit.code, e.ordinal, e.factor, CASE WHEN s.percentile IS NOT NULL THEN t.value END AS raw_value, s.percentile AS normalized, e.weight, s.percentile * e.weight AS weighted, CASE WHEN s.percentile IS NOT NULL THEN t.quality_status ELSE 'MISSING' END AS quality_status,
  CASE WHEN t.code IS NULL THEN 'missing-input' ELSE t.code || '-' || t.k END AS sources, coalesce(s.scope, 'unavailable') AS scope, coalesce(s.fallback, false) AS fallback
  FROM fit CROSS JOIN (VALUES {every}) e(ordinal, factor, weight) LEFT JOIN timed t ON t.code = fit.code AND t.factor = e.factor LEFT JOIN s ON s.code = fit.code AND s.factor = e.factor)"""


@query(_details_sql("deep-value-v1") + " SELECT code, ordinal, factor, raw_value, round(normalized, 6) AS normalized, weight, round(weighted, 6) AS weighted, quality_status, sources, scope, fallback FROM det", "factors", "master")
def factor_details(spark, d):
    rows = _factor_rows(spark, d, "deep-value-v1").withColumn("available", scoring.available(AS_OF, KNOWN_AT))
    out = scoring.factor_details(rows, "deep-value-v1")
    return out.select("code", "ordinal", "factor", "raw_value", F.round("normalized", 6).alias("normalized"), "weight", F.round("weighted", 6).alias("weighted"), "quality_status", F.array_join("source_record_ids", ",").alias("sources"), "scope", "fallback")


@query(_details_sql("quality-growth-v1") + """, per AS (SELECT code, round(sum(weighted), 9) AS score, round(sum(weight) FILTER (normalized IS NOT NULL), 2) AS confidence, string_agg(factor || ':' || scope, ',' ORDER BY ordinal) AS details FROM det GROUP BY code)
SELECT row_number() OVER (ORDER BY score DESC, code) AS rank, code, confidence, details FROM per ORDER BY score DESC, code LIMIT 30""", "factors", "master")
def candidate_rows(spark, d):
    rows = _factor_rows(spark, d, "quality-growth-v1").withColumn("available", scoring.available(AS_OF, KNOWN_AT))
    out = scoring.candidates(rows, "quality-growth-v1")
    return out.select("rank", "code", "confidence", F.array_join(F.transform("factor_details", lambda x: F.concat_ws(":", x["factor"], x["scope"])), ",").alias("details"))


_LOWER = [(f, w, c, f != "valuation_attractiveness") for f, w, c in scoring.STRATEGIES["quality-growth-v1"]]


@query(_score_sql("quality-growth-v1") + """, per AS (SELECT code, round(sum(weight * CASE WHEN factor = 'valuation_attractiveness' THEN 100 - percentile ELSE percentile END), 6) AS s, round(sum(weight), 2) AS completeness FROM s GROUP BY code)
SELECT row_number() OVER (ORDER BY s DESC, code) AS rank, code, s AS score, completeness, CASE WHEN s >= 60 THEN 'CANDIDATE' ELSE 'WATCH' END AS status FROM per ORDER BY s DESC, code LIMIT 30""", "factors", "master")
def rank_lower_is_better(spark, d):
    """A strategy given by its factors, one of which counts the other way round."""
    wide = view(spark, d, "factors").join(view(spark, d, "master").where("code % 13 <> 0").select("code", "industry"), "code")
    each = F.array(*[F.struct(F.lit(f[0]).alias("factor"), F.round(F.col(f"f{i}").cast("double"), 9).alias("value")) for i, f in enumerate(_LOWER, 1)])
    values = wide.select("code", "industry", F.explode(each).alias("x")).select("code", "industry", "x.*")
    return scoring.ranked_pool(values, _LOWER).select("rank", "code", F.round("exact_score", 6).alias("score"), "completeness", "status")


@query(_SCREEN + ", div AS (SELECT code, bool_and(action_status = 'ANNOUNCED') AS only_announced FROM actions WHERE action_type = 'CASH' GROUP BY code) SELECT hf.code, reasons <> '' AS any_strategy FROM hf LEFT JOIN div ON hf.code = div.code WHERE reasons <> '' OR NOT coalesce(only_announced, false)", "bars", "master", "actions")
def strategy_exclusions(spark, d):
    """Who is left out of stable dividends, by the hard filters and by the dividends themselves, and who of every strategy."""
    cash = view(spark, d, "actions").where("action_type = 'CASH'").groupBy("code").agg(F.bool_and(F.col("action_status") == "ANNOUNCED").alias("announced_dividend_only"))
    rows = _screened(spark, d).select("code", (F.size("reasons") == 0).alias("hard_filter_passed")).join(cash, "code", "left")
    both = scoring.strategy_excluded(rows, "stable-dividend-v1").join(scoring.strategy_excluded(rows, "deep-value-v1").withColumn("any_strategy", F.lit(True)), "code", "left")
    return both.select("code", F.coalesce("any_strategy", F.lit(False)).alias("any_strategy"))


# --- Gates before publication ------------------------------------------------------------------------------------------------

_POOLS = """WITH c AS (SELECT l_suppkey % 40 AS pool, CASE WHEN l_suppkey % 40 = 7 AND l_linenumber = 7 THEN -1 ELSE l_suppkey % 40 END AS strategy, l_partkey AS code, DATE '1998-12-01' AS wanted, CASE WHEN l_suppkey % 40 IN (7, 11) THEN DATE '1998-12-02' ELSE DATE '1998-12-01' END AS report_date, l_shipdate::DATE AS cut, l_shipdate::DATE + (l_suppkey % 40)::INT AS known FROM lineitem)
"""


def _candidates(spark, d):
    k, day = F.col("l_suppkey") % 40, F.col("l_shipdate").cast("date")
    return table(spark, d, "lineitem").select(k.alias("pool"), F.when((k == 7) & (F.col("l_linenumber") == 7), -1).otherwise(k).alias("strategy"), F.col("l_partkey").alias("code"), _day("1998-12-01").alias("wanted_date"), F.when(k.isin(7, 11), _day("1998-12-02")).otherwise(_day("1998-12-01")).alias("report_date"), day.alias("data_cutoff_at"), F.date_add(day, k.cast("int")).alias("known_at"))


@query(_POOLS + "SELECT pool, count(*) AS candidates, CASE WHEN bool_or(strategy <> pool) THEN 'REPORT_STRATEGY_POOL_MIXED' WHEN bool_or(report_date <> wanted) THEN 'REPORT_CANDIDATE_DATE_MISMATCH' WHEN bool_or(cut > DATE '1999-01-01' OR known > DATE '1998-12-20') THEN 'REPORT_CANDIDATE_CUTOFF_VIOLATION' END AS reason FROM c GROUP BY pool")
def report_pool_gate(spark, d):
    return reports.pool_gate(_candidates(spark, d), "1999-01-01", "1998-12-20")


@query("SELECT l_returnflag AS strategy, count(DISTINCT l_partkey) AS candidates, bool_and(l_linestatus = 'F') AS ready FROM lineitem GROUP BY 1")
def report_pool_counts(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("strategy")).agg(F.count_distinct("l_partkey").alias("candidates"), F.bool_and(F.col("l_linestatus") == "F").alias("ready"))


@query("SELECT l_returnflag AS strategy, l_linenumber AS rank, l_orderkey AS report_id FROM lineitem WHERE l_partkey = 7")
def security_report(spark, d):
    """Where one security stands, over all pools of all reports."""
    pools = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("report_id"), F.col("l_returnflag").alias("strategy"), F.col("l_linenumber").alias("rank"), F.col("l_partkey").alias("code"))
    return reports.places_of(pools, 7).select("strategy", "rank", "report_id")


@query("""WITH s AS (SELECT s_suppkey AS k, DATE '1996-01-01' + (s_suppkey % 290)::INT AS p, s_suppkey % 19 = 0 AS twice, s_suppkey % 5 = 0 AS bad FROM supplier)
SELECT k AS record_id, CASE WHEN twice THEN 'REPORT_SOURCE_RECORD_DUPLICATE' WHEN p > DATE '1996-09-01' OR p + (k % 30)::INT > DATE '1996-08-15' THEN 'REPORT_SOURCE_CUTOFF_VIOLATION' ELSE 'REPORT_SOURCE_QUALITY_BLOCKED' END AS reason
FROM s, range(CASE WHEN twice THEN 2 ELSE 1 END) WHERE twice OR p > DATE '1996-09-01' OR p + (k % 30)::INT > DATE '1996-08-15' OR bad""")
def report_source_gate(spark, d):
    k = F.col("s_suppkey")
    day = F.date_add(_day("1996-01-01"), (k % 290).cast("int"))
    rows = table(spark, d, "supplier").select(k.alias("record_id"), day.alias("published_at"), F.lit(None).cast("date").alias("effective_at"), day.alias("collected_at"), F.date_add(day, (k % 30).cast("int")).alias("valid_from"), F.when(k % 5 == 0, "PARTIAL").otherwise("VALID").alias("quality_status"))
    return reports.source_gate(rows.union(rows.where("record_id % 19 = 0")), "1996-09-01", "1996-08-15")


@query("""WITH p AS (SELECT c_nationkey AS strategy, count(*) AS candidates FROM customer WHERE c_nationkey <> 3 GROUP BY 1), e AS (SELECT s_nationkey AS strategy, CASE WHEN s_nationkey = 5 THEN 'v0' ELSE 'v1' END AS version, CASE WHEN s_nationkey = 6 THEN 0 ELSE count(*) END AS input, CASE WHEN s_nationkey = 3 THEN count(*) ELSE 0 END AS insufficient, s_nationkey <> 8 AS completed FROM supplier WHERE s_nationkey <> 9 GROUP BY 1)
SELECT n_nationkey AS strategy, CASE WHEN e.input IS NULL THEN 'REPORT_STRATEGY_EVIDENCE_INCOMPLETE' WHEN e.version <> 'v1' THEN 'REPORT_STRATEGY_EVIDENCE_MISMATCH' WHEN NOT completed THEN 'REPORT_STRATEGY_EVALUATION_INCOMPLETE' WHEN e.input = 0 THEN 'REPORT_STRATEGY_EVALUATION_EMPTY' WHEN p.candidates IS NULL AND insufficient = e.input THEN 'REPORT_STRATEGY_ALL_DATA_INSUFFICIENT' END AS reason
FROM nation LEFT JOIN e ON n_nationkey = e.strategy LEFT JOIN p ON n_nationkey = p.strategy""")
def report_evidence_gate(spark, d):
    k = F.col("s_nationkey")
    pools = table(spark, d, "customer").where("c_nationkey <> 3").groupBy(F.col("c_nationkey").alias("strategy")).agg(F.count("*").alias("candidates"))
    runs = table(spark, d, "supplier").where(k != 9).groupBy(k.alias("strategy")).agg(F.count("*").alias("n"))
    s = F.col("strategy")
    evidence = runs.join(pools, "strategy", "left").select("strategy", F.when(s == 5, "v0").otherwise("v1").alias("version"), F.when(s == 6, 0).otherwise(F.col("n")).alias("input"), F.when(s == 3, F.col("n")).otherwise(0).alias("insufficient"), F.coalesce("candidates", F.lit(0)).alias("published"), (s != 8).alias("completed"))
    versions = table(spark, d, "nation").select(F.col("n_nationkey").alias("strategy"), F.lit("v1").alias("expected"))
    return reports.evidence_gate(evidence, versions, pools)


@query("SELECT o_orderpriority AS strategy, 'v1' AS version, CASE WHEN bool_or(o_custkey % 40 = 0) THEN 'REPORT_STRATEGY_VERSION_INVALID' END AS issue FROM orders WHERE o_orderkey % 5 = 0 OR o_custkey % 40 <> 0 GROUP BY 1")
def report_versions(spark, d):
    rows = table(spark, d, "orders").where("o_orderkey % 5 = 0 OR o_custkey % 40 <> 0").select(F.col("o_orderpriority").alias("strategy"), F.when(F.col("o_custkey") % 40 == 0, "v0").otherwise("v1").alias("version"))
    return reports.versions_of(rows, rows.select("strategy").distinct().withColumn("version", F.lit("v1")))


@query("""WITH p AS (SELECT l_suppkey AS report_id, list({'strategy': l_returnflag, 'rank': l_linenumber, 'code': l_partkey, 'score': l_orderkey} ORDER BY l_returnflag, l_linenumber, l_partkey, l_orderkey) AS c FROM lineitem GROUP BY 1),
s AS (SELECT l_suppkey AS report_id, list({'record_id': k} ORDER BY k) AS c FROM (SELECT DISTINCT l_suppkey, l_partkey AS k FROM lineitem) GROUP BY 1), d AS (SELECT s_suppkey AS report_id, [{'domain': s_name, 'status': 'VALID'}] AS c FROM supplier WHERE s_suppkey % 3 = 0),
m AS (SELECT s_suppkey AS report_id, to_json({'candidate_pools': coalesce(p.c, []), 'data_domain_statuses': coalesce(d.c, []), 'nation': s_nationkey, 'report_id': s_suppkey, 'source_records': coalesce(s.c, [])}) AS document FROM supplier LEFT JOIN p ON s_suppkey = p.report_id LEFT JOIN s ON s_suppkey = s.report_id LEFT JOIN d ON s_suppkey = d.report_id)
SELECT report_id, sha256(document) AS manifest_hash FROM m""")
def report_manifest(spark, d):
    lines, supplier = table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "report_id"), table(spark, d, "supplier").withColumnRenamed("s_suppkey", "report_id")
    pools = lines.select("report_id", F.col("l_returnflag").alias("strategy"), F.col("l_linenumber").alias("rank"), F.col("l_partkey").alias("code"), F.col("l_orderkey").alias("score"))
    domains = supplier.where("report_id % 3 = 0").select("report_id", F.col("s_name").alias("domain"), F.lit("VALID").alias("status"))
    sources = lines.select("report_id", F.col("l_partkey").alias("record_id")).distinct()
    return reports.manifest(supplier.select("report_id", F.col("s_nationkey").alias("nation")), pools, domains, sources).select("report_id", "manifest_hash")


@query("""WITH t AS (SELECT o_orderkey AS key, round(o_totalprice)::BIGINT AS n, CASE o_orderkey % 3 WHEN 0 THEN 10000.0::DOUBLE ELSE 1.0::DOUBLE END AS m, o_orderdate::DATE AS d FROM orders WHERE o_orderkey % 3 <> 2),
v AS (SELECT key, unnest(['total_assets', 'revenue']) AS name, unnest([n * 1000 * m, 77 * m]) AS text_value, unnest([CASE WHEN key % 2 = 0 THEN n * 1000 * m ELSE n END, 77 * m]) AS tagged_value, d FROM t)
SELECT key, name, tagged_value, text_value FROM v WHERE tagged_value <> text_value AND d <= DATE '1997-06-30' AND d + (key % 90)::INT <= DATE '1997-08-31'""")
def xbrl_pdf_conflict(spark, d):
    """Names that a tagged and a text document of one key both give, with different values. Only documents that were visible count."""
    text = labelled_text.extract_facts(_label_text(spark, d)).where("multiplier IS NOT NULL")
    pairs = F.explode(F.create_map(F.lit("total_assets"), F.col("total_assets"), F.lit("revenue"), F.col("revenue")))
    mine = text.select("key", pairs).toDF("key", "name", "value")
    o = table(spark, d, "orders")
    days = o.select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").cast("date").alias("published_at"), F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 90).cast("int")).alias("valid_from"))
    seen = filings.visible(days, AS_OF, KNOWN_AT)
    tagged = text.join(o.select(F.col("o_orderkey").alias("key"), F.round("o_totalprice").alias("n")), "key").select("key", F.explode(F.create_map(F.lit("total_assets"), F.when(F.col("key") % 2 == 0, F.col("total_assets")).otherwise(F.col("n")), F.lit("revenue"), F.col("revenue"), F.lit("equity"), F.lit(0.0)))).toDF("key", "name", "value")
    return labelled_text.source_conflicts(tagged.join(seen.select("key"), "key", "left_semi"), mine)


# --- Artifacts and state -----------------------------------------------------------------------------------------------------


@query("SELECT strftime(trade_date, '%Y-%m') AS month, count(*) AS n, NULL::VARCHAR AS issue FROM bars GROUP BY 1", "bars")
def bars_artifacts(spark, d):
    """The bars, stored a month an artifact, written twice (the second time nothing is new), validated, and read back."""
    bars, path = view(spark, d, "bars").withColumn("month", F.date_format("trade_date", "yyyy-MM")), new_path(spark, "bar-artifacts")
    artifacts.write_artifacts(bars, path, ["month"])
    artifacts.write_artifacts(bars, path, ["month"])
    good = artifacts.validate_artifacts(spark, path, ["month"]).select("month", "issue")
    return artifacts.read_artifacts(spark, path, ["month"]).groupBy("month").agg(F.count("*").alias("n")).join(good, "month")


@query("""+f AS (SELECT f.*, year(published_at) AS report_year, o_orderpriority AS report_type FROM facts f JOIN filings g ON f.filing_id = g.filing_id JOIN orders ON o_orderkey = f.filing_id)
SELECT report_year, report_type, count(*) AS n, count(DISTINCT filing_id) AS filings, count(*) FILTER (name = 'assets') AS assets FROM f GROUP BY ALL""", "facts", "filings")
def fact_artifacts(spark, d):
    """Facts with their dimensions, stored an artifact a year and type, and read back with the map decoded."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("filing_id"), F.year("o_orderdate").alias("report_year"), F.col("o_orderpriority").alias("report_type"))
    rows = view(spark, d, "facts").join(o, "filing_id").withColumn("dimensions", F.create_map(F.lit("n"), F.coalesce("name", F.lit("")), F.lit("d"), F.col("decimals").cast("string")))
    path, by = new_path(spark, "fact-artifacts"), ["report_year", "report_type"]
    artifacts.write_artifacts(rows, path, by, maps=("dimensions",), group="filing_id", same=("report_year", "report_type"), mixed="FINANCIAL_FACTS_MIXED_FILING")
    back = artifacts.read_artifacts(spark, path, by, maps=("dimensions",))
    return back.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct("filing_id").alias("filings"), F.count_if(F.col("dimensions")["n"] == "assets").alias("assets"))


@query("SELECT content_hash, count(*) AS events FROM (SELECT DISTINCT sha256(coalesce(text, '')) AS content_hash, source, lang FROM documents) GROUP BY 1")
def object_provenance(spark, d):
    """Objects and provenance events of documents, half of which had been put before; putting them again adds nothing."""
    rows = table(spark, d, "documents").select(F.col("source").alias("source_id"), F.col("lang").alias("source_url"), F.lit("1998-01-01").cast("timestamp").alias("collected_at"), "text")
    none = spark.createDataFrame([], "content_hash string, event_hash string")
    objects, events = tables.put_objects(rows.where("source_id < 'm'"), none, none, "text")
    more, later = tables.put_objects(rows, objects, events, "text")
    return events.union(later).groupBy("content_hash").agg(F.count("*").alias("events")).join(objects.union(more).select("content_hash"), "content_hash")


@query("SELECT s_suppkey, CASE WHEN s_nationkey % 2 = 0 AND s_suppkey % 3 <> 0 THEN -1 ELSE s_nationkey END AS s_nationkey FROM supplier")
def state_compare_and_set(spark, d):
    """Suppliers of even nations move to -1, where the change expected the nation that is there."""
    rows = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    changes = rows.where("s_nationkey % 2 = 0").select("s_suppkey", (F.col("s_nationkey") + F.when(F.col("s_suppkey") % 3 == 0, 1).otherwise(0)).alias("expected"), F.lit(-1).alias("value"))
    return tables.compare_and_set(rows, changes, "s_suppkey", "s_nationkey")[0]


@query("SELECT o_orderkey, to_json({'a': o_orderstatus, 'k': o_custkey, 'z': NULL}) AS payload FROM orders")
def canonical_payloads(spark, d):
    return table(spark, d, "orders").select("o_orderkey", canonical_json({"z": F.lit(None).cast("string"), "k": F.col("o_custkey"), "a": F.col("o_orderstatus")}).alias("payload"))


# --- Windows of events -------------------------------------------------------------------------------------------------------


@query("SELECT w AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS value FROM (SELECT event_type, value, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS w FROM events) GROUP BY ALL")
def events_sliding_windows(spark, d):
    return event_windows(table(spark, d, "events"), "2 hours", slide="1 hour")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n, round(sum(value), 2) AS value FROM s GROUP BY user_id, k""")
def events_sessions(spark, d):
    return event_sessions(table(spark, d, "events"))


@query("SELECT window_start, event_type, n, value FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY ALL) WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events)")
def events_stream_replay(spark, d):
    """The events as a stream, run twice over one checkpoint: windows are given once, when the watermark has passed them."""
    source, sink, check = (new_path(spark, f"stream-{x}") for x in ("in", "out", "check"))
    events = table(spark, d, "events")
    events.write.parquet(source)
    for _ in range(2):
        stream_once(spark, source, events.schema, sink, check).awaitTermination()
    return spark.read.parquet(sink)


# --- Files and state ---------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey::VARCHAR || '.SH' AS ts_code, p_name AS name, CASE WHEN p_size = 50 THEN NULL ELSE DATE '1990-01-01' + p_size END AS list_date FROM part WHERE p_partkey % 3 <> 0")
def master_file(spark, d):
    """A security master written as CSV with a column too many, and read back: dates that aren't dates are null."""
    path, c = new_path(spark, "master"), F.col("p_partkey")
    day = F.when(F.col("p_size") == 50, "19900230").otherwise(F.date_format(F.date_add(_day("1990-01-01"), F.col("p_size")), "yyyyMMdd"))
    rows = table(spark, d, "part").select(F.concat(c.cast("string"), F.when(c % 3 == 0, ".SZ").otherwise(".SH")).alias("ts_code"), c.cast("string").alias("symbol"), F.col("p_name").alias("name"), F.lit("SSE").alias("exchange"), F.lit("MAIN_SH").alias("board"), F.lit("CNY").alias("currency"), day.alias("list_date"), F.lit("A_SHARE").alias("security_type"), F.lit("x").alias("more"))
    rows.write.csv(path, header=True)
    return tables.read_master(spark, path).where("ts_code LIKE '%.SH'").select("ts_code", "name", "list_date")


@query("SELECT DISTINCT trade_date FROM bars WHERE day(trade_date) <> 13", "bars")
def calendar_file(spark, d):
    """The trading days as a JSON array, with repeats and a day that isn't one, read back sorted and once each."""
    path = new_path(spark, "calendar")
    days = view(spark, d, "bars").select("trade_date").distinct().where("day(trade_date) <> 13").select(F.explode(F.array(F.col("trade_date").cast("string"), F.col("trade_date").cast("string"))).alias("d"))
    one = days.agg(F.to_json(F.concat(F.collect_list("d"), F.array(F.lit("1996-02-30"), F.lit("1996-1-2")))).alias("value"))
    one.write.text(path)
    return tables.read_calendar(spark, path)


@query("""WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%-m-%-d') WHEN 2 THEN '1995-02-29' ELSE strftime(o_orderdate, '%Y%m%d') END AS d FROM orders)
SELECT o_orderkey, CASE WHEN d SIMILAR TO '[0-9]{4}-[0-9]{2}-[0-9]{2}' THEN try_cast(d AS DATE) END AS day FROM t""")
def strict_dates(spark, d):
    k, day = F.col("o_orderkey") % 4, F.col("o_orderdate")
    text = F.when(k == 0, F.date_format(day, "yyyy-MM-dd")).when(k == 1, F.date_format(day, "yyyy-M-d")).when(k == 2, "1995-02-29").otherwise(F.date_format(day, "yyyyMMdd"))
    return table(spark, d, "orders").select("o_orderkey", tables.strict_date(text).alias("day"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 AND s_nationkey > 10 THEN s_name || '!' ELSE s_name END AS s_name FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 = 0")
def state_upsert(spark, d):
    """Rows of even keys, then rows of keys divisible by 3, of which those that are later win."""
    rows = table(spark, d, "supplier").select("s_suppkey", "s_name", F.lit(10).alias("t"))
    old = rows.where("s_suppkey % 2 = 0")
    new = table(spark, d, "supplier").where("s_suppkey % 3 = 0").select("s_suppkey", F.when(F.col("s_nationkey") > 10, F.concat("s_name", F.lit("!"))).otherwise(F.col("s_name")).alias("s_name"), F.when(F.col("s_nationkey") > 10, 11).otherwise(9).alias("t"))
    return tables.last_wins(old, new, "s_suppkey", "t").select("s_suppkey", "s_name")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'old' ELSE 'new' END AS origin FROM supplier")
def state_insert_missing(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey")
    return tables.insert_missing(rows.where("s_suppkey % 2 = 0").withColumn("origin", F.lit("old")), rows.withColumn("origin", F.lit("new")), "s_suppkey")


@query("SELECT event_id AS run_id, ts AS updated_at FROM events WHERE json_extract_string(props, '$.k') = '7'")
def runs_by_type(spark, d):
    runs = table(spark, d, "events").select(F.col("event_id").alias("run_id"), F.col("props").alias("payload"), F.col("ts").alias("updated_at"))
    return state.runs_of_type(runs, "$.k", "7").select("run_id", "updated_at")


@query("SELECT sha256(coalesce(text, '')) AS content_hash, CASE WHEN bool_or(source < 'm') THEN 'objects' ELSE 'legacy' END AS place, NULL::VARCHAR AS issue FROM documents GROUP BY 1")
def object_lookup(spark, d):
    """Documents by their hash, of which some are in the new store and the rest in the old one."""
    rows = table(spark, d, "documents").select("source", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))
    return state.stored_objects(rows, rows.where("source < 'm'").dropDuplicates(["content_hash"]), rows.where("source >= 'm'"), "text")


@query("""SELECT o_orderkey AS key, concat_ws(',', 'equity', CASE WHEN o_orderkey % 2 = 0 THEN 'operating_cash_flow' END, 'total_assets') AS names, CASE o_orderkey % 3 WHEN 0 THEN 'CNY' WHEN 1 THEN 'CNY' ELSE 'UNKNOWN' END AS currency, CASE o_orderkey % 3 WHEN 0 THEN '10000' WHEN 1 THEN '1' ELSE 'UNKNOWN' END AS unit_multiplier FROM orders""")
def text_documents(spark, d):
    rows = state.document_rows(labelled_text.extract_facts(_label_text(spark, d)), "key", ["total_assets", "equity", "operating_cash_flow"])
    return rows.select("key", F.array_join(F.array_sort(F.map_keys("facts")), ",").alias("names"), F.col("units")["currency"].alias("currency"), F.col("units")["unit_multiplier"].alias("unit_multiplier"))


@query("""SELECT c_custkey AS channel, CASE WHEN o.o_orderstatus IN ('F', 'O') THEN o.o_orderkey END AS report_id, CASE WHEN o.o_orderkey IS NULL THEN 'NO_REPORT' WHEN c_custkey % 4 = 0 THEN 'STALE_PREVIOUS_REPORT' ELSE 'CURRENT' END AS shown
FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS k FROM orders GROUP BY 1) l ON o_custkey = c_custkey LEFT JOIN orders o ON o.o_orderkey = l.k""")
def report_display(spark, d):
    orders, channels = table(spark, d, "orders"), table(spark, d, "customer").select(F.col("c_custkey").alias("channel"))
    pointers = channels.join(orders.groupBy(F.col("o_custkey").alias("channel")).agg(F.max("o_orderkey").alias("report_id")), "channel", "left")
    stored = orders.select(F.col("o_orderkey").alias("report_id"), F.when(F.col("o_orderstatus") == "F", "PUBLISHED").when(F.col("o_orderstatus") == "O", "PUBLISHED_PARTIAL").otherwise("DRAFT").alias("status"))
    return state.report_status(stored, pointers, channels.select("channel", (F.col("channel") % 4 != 0).alias("succeeded")))


@query("SELECT s_suppkey AS id, NULL::VARCHAR AS issue FROM supplier")
def report_documents(spark, d):
    """Manifests stored as immutable documents, twice, and read back under their hashes."""
    supplier, path = table(spark, d, "supplier").withColumnRenamed("s_suppkey", "report_id"), new_path(spark, "documents")
    none = spark.createDataFrame([], "report_id long, strategy string, rank int, code long, score long, domain string, status string, record_id long")
    made = reports.manifest(supplier.select("report_id", "s_name"), none, none, none).select(F.col("report_id").alias("id"), "document", F.col("manifest_hash").alias("hash"))
    artifacts.write_documents(made, path)
    artifacts.write_documents(made, path)
    return artifacts.read_documents(spark, path).select("id", "issue")
