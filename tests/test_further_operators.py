"""Literal cases of normalisation, gates, artifacts, instances, archives and streams."""

import datetime as dt
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.functions import canonical
from tidemark.operators import backfill, filings, market, metrics, normalise, reports, returns, scoring, state
from tidemark.plans import warehouse
from tidemark.sources import artifacts, commits, instances, responses, staging, tables
from tidemark.streaming import sinks
from tidemark.streaming.windows import event_sessions, stream_once

D = dt.date
CNY, SHARE = normalise.CURRENCIES + "CNY", normalise.SHARES
INSTANCE = b"""<?xml version="1.0"?><xbrl xmlns="http://www.xbrl.org/2003/instance" xmlns:c="http://www.xbrl.org/2003/iso4217" xmlns:s="http://www.xbrl.org/2003/instance" xmlns:t="urn:t" xmlns:n="http://www.w3.org/2001/XMLSchema-instance">
<context id="i"><entity><identifier scheme="urn:s"> 699999.SH </identifier></entity><period><instant>2025-12-31</instant></period></context>
<context id="d"><entity><identifier scheme="urn:s">699999.SH</identifier></entity><period><startDate>2025-01-01</startDate><endDate>2025-12-31</endDate></period></context>
<unit id="u"><measure>c:CNY</measure></unit><unit id="p"><divide><unitNumerator><measure>c:CNY</measure></unitNumerator><unitDenominator><measure>s:shares</measure></unitDenominator></divide></unit>
<t:Assets contextRef="i" unitRef="u" decimals="0">1000</t:Assets><t:Tuple><t:Revenue contextRef="d" unitRef="u" decimals="0">2000</t:Revenue></t:Tuple>
<t:Assets contextRef="i" unitRef="u" n:nil="true"/><t:Note contextRef="d">text</t:Note></xbrl>"""


def test_instance(spark):
    files = spark.createDataFrame([("a", bytearray(INSTANCE)), ("b", bytearray(b"<x")), ("c", None), ("d", bytearray(INSTANCE.replace(b"<instant>2025-12-31</instant>", b"")))], "path string, content binary")
    rows = instances.read_instances(files)
    assert {r.path: r.issue for r in rows.collect()} == {"a": None, "b": "FINANCIAL_XBRL_PARSE_ERROR", "c": "FINANCIAL_XBRL_PARSE_ERROR", "d": "FINANCIAL_XBRL_PARSE_ERROR"}
    assert rows.where("path = 'a'").select("nil_facts", "text_facts").first() == (1, 1)
    assert [(r.context_id, r.entity_identifier, r.period_start, r.period_end, r.instant) for r in instances.contexts_of(rows).orderBy("context_id").collect()] == [("d", "699999.SH", D(2025, 1, 1), D(2025, 12, 31), None), ("i", "699999.SH", None, None, D(2025, 12, 31))]
    assert [(r.unit_id, r.over, r.under) for r in instances.units_of(rows).orderBy("unit_id").collect()] == [("p", [CNY], [SHARE]), ("u", [CNY], [])]
    assert [(r.raw_qname, r.value, r.context_id) for r in normalise.in_order(instances.facts_of(rows)).collect()] == [("{urn:t}Assets", "1000", "i"), ("{urn:t}Revenue", "2000", "d")]


def test_facts_are_moved_once(spark):
    pairs = "array<struct<axis:string,member:string>>"
    facts = spark.createDataFrame([(1, "q", "5", "0", "c", "u"), (1, "q", "6", None, "gone", "u"), (2, "r", "7", "0", "c", None), (2, "q", "8", "0", "c", "gone"), (3, "q", "9", "0", "c", "u"), (4, "q", "1", "0", "c", "u")], "filing_id int, raw_qname string, value string, decimals string, context_id string, unit_id string")
    contexts = spark.createDataFrame([(1, "c", "s", "a", None, None, D(2025, 12, 31), []), (2, "c", "s", "b", None, None, D(2025, 12, 31), [("x", "m")]), (3, "c", "s", "z", None, None, D(2025, 1, 1), []), (3, "c", "s", "a", None, None, D(2025, 1, 2), [])], f"filing_id int, context_id string, entity_scheme string, entity_identifier string, period_start date, period_end date, instant date, dimensions {pairs}")
    units = spark.createDataFrame([(1, "u", [CNY], []), (3, "u", [CNY], [])], "filing_id int, unit_id string, over array<string>, under array<string>")
    filings_ = spark.createDataFrame([(k, 10 if k != 2 else 20, D(2025, 12, 31), "A", "f", "p") for k in (1, 2, 3)], "filing_id int, code int, report_period date, report_type string, filing_version string, parser_version string")
    mapping = spark.createDataFrame([("q", "assets", "BALANCE", "MONETARY")], "raw_qname string, canonical_name string, statement_type string, expected_kind string")
    registry = spark.createDataFrame([("s", "a", 10), ("s", "b", 20), ("s", "b", 21)], "entity_scheme string, entity_identifier string, code int")
    rows = normalise.normalise_facts(facts, contexts, units, filings_, mapping, normalise.owners_of(registry))
    # An id that is there twice gives two rows, facts of filings that aren't listed none.
    got = sorted((r.filing_id, r.value, r.issue, r.owners, str(r.instant), r.currency) for r in rows.collect())
    parse, entity, day = "FINANCIAL_XBRL_PARSE_ERROR", "FINANCIAL_ENTITY_MISMATCH", "2025-12-31"
    assert got == sorted([(1, "5", None, [10], day, "CNY"), (1, "6", parse, None, "None", "CNY"), (2, "7", None, [20, 21], day, None), (2, "8", parse, [20, 21], day, None), (3, "9", entity, None, "2025-01-01", "CNY"), (3, "9", None, [10], "2025-01-02", "CNY")], key=lambda r: r[:2] + r[4:5])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.split("\n") if "Exchange hashpartitioning(filing_id" in x]
    assert len(dealt) == 6 and all("REPARTITION_BY_COL" in x or "ENSURE" not in x for x in dealt)


@pytest.mark.parametrize(("over", "under", "kind"), [([CNY], [], "MONETARY"), ([normalise.CURRENCIES], [], "OTHER"), ([CNY], [SHARE], "PER_SHARE"), ([SHARE], [], "SHARES"), ([normalise.PURE], [], "PURE"), ([CNY, CNY], [], "OTHER"), (None, None, "NONE")])
def test_unit_kinds(spark, over, under, kind):
    rows = spark.createDataFrame([(over, under)], "over array<string>, under array<string>")
    assert rows.select(normalise.measured_kind(F.col("over"), F.col("under"))).first()[0] == kind


def test_attachments(spark):
    utf16 = "\ufeff<a><!DOCTYPE x></a>".encode("utf-16-le")
    rows = [("a.XML", b"<a/>", "Text/XML; charset=utf-8", None), ("a.xml", b"\xef\xbb\xbf \n<a/>", "text/xml", None), ("a.xml", b"<!eNtItY>", "text/xml", "FINANCIAL_XML_UNSAFE"), ("a.xml", utf16, "text/xml", "FINANCIAL_XML_UNSAFE"), ("a.xml", b"x<a/>", "text/xml", "FINANCIAL_ATTACHMENT_TYPE_INVALID"),
            ("a.zip", b"PK..", "application/zip", None), ("a.zip", b"<a/>", "application/zip", "FINANCIAL_ATTACHMENT_TYPE_INVALID"), ("a.txt", b"<a/>", "text/xml", "FINANCIAL_ATTACHMENT_TYPE_INVALID"), ("a.xml", b"<a/>", "application/zip", "FINANCIAL_ATTACHMENT_TYPE_INVALID")]
    files = spark.createDataFrame([(p, bytearray(c), t, r) for p, c, t, r in rows], "path string, content binary, content_type string, want string")
    assert [(r.reason, r.want) for r in instances.attachment_reason(files).collect() if r.reason != r.want] == []


def test_archives_are_inflated(spark, monkeypatch):
    def zipped(*members):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w", zipfile.ZIP_STORED) as z:
            for n, x in members:
                z.writestr(n, x)
        return data.getvalue()

    good = zipped(("a/b.xml", "hello"), ("c.xml", "x"))
    bad = good.replace(b"hello", b"hellO")
    rows = [("good", good), ("crc", bad), ("twice", zipped(("a.xml", "1"), ("A.XML", "2"))), ("drive", zipped(("c:/a", "1"))), ("none", None), ("many", zipped(*[(f"{i}.xml", "") for i in range(5001)]))]
    files = spark.createDataFrame([(p, c and bytearray(c)) for p, c in rows], "path string, content binary")
    got = {r.path: (r["files"], r.bytes, r.reason) for r in tables.archive_totals(tables.archive_members(files)).collect()}
    assert got == {"good": (2, 6, None), "crc": (0, 0, "FINANCIAL_ARCHIVE_INVALID"), "twice": (0, 0, "FINANCIAL_ARCHIVE_UNSAFE_PATH"), "drive": (0, 0, "FINANCIAL_ARCHIVE_UNSAFE_PATH"), "none": (0, 0, "FINANCIAL_ARCHIVE_INVALID"), "many": (0, 0, "FINANCIAL_ARCHIVE_LIMIT_EXCEEDED")}


def test_policies(spark, tmp_path):
    one = {"source_id": "a", "source_name": "A", "allowed_domains": ["x.org"], "allowed_schemes": ["https"], "allowed_purposes": ["p"], "rate_limit_per_minute": 6, "review_status": "APPROVED", "enabled": True, "more": 1}
    cases = {"good": [one, one | {"source_id": "b"}], "twice": [one, one], "typed": [one | {"enabled": "maybe"}], "less": [{k: v for k, v in one.items() if k != "review_status"}], "none": [], "rate": [one | {"rate_limit_per_minute": 0}]}
    for name, rows in cases.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(rows))
    assert tables.read_policies(spark, str(tmp_path / "good.json")).count() == 2
    for name in ("twice", "typed", "less", "none", "rate"):
        with pytest.raises(ValueError, match="DUPLICATE_SOURCE_ID" if name == "twice" else "SOURCE_POLICIES_INVALID"):
            tables.read_policies(spark, str(tmp_path / f"{name}.json"))


BAR = {"ts_code": "1.SH", "trade_date": "20260720", "open": "10", "high": "11", "low": "9", "close": "10.5", "pre_close": "10", "vol": "1000", "amount": "10500"}


@pytest.mark.parametrize(("change", "issue"), [({}, None), ({"trade_date": "2026072"}, "TUSHARE_TRADE_DATE_INVALID"), ({"trade_date": None}, "TUSHARE_TRADE_DATE_INVALID"), ({"trade_date": "20260721"}, "TUSHARE_TRADE_DATE_MISMATCH"), ({"vol": "NaN"}, "TUSHARE_ROW_INVALID"), ({"vol": None}, "TUSHARE_ROW_INVALID"), ({"high": "10.2"}, "TUSHARE_ROW_INVALID"), ({"amount": "-1"}, "TUSHARE_ROW_INVALID"), ({"ts_code": None}, "TUSHARE_ROW_INVALID")])
def test_provider_rows(spark, change, issue):
    rows = spark.createDataFrame([BAR | change], ", ".join(f"{c} string" for c in BAR))
    got = market.provider_bars(rows, F.lit("2026-07-20").cast("date"), F.lit("0123456789abcdef"), F.lit("2026-07-20").cast("timestamp")).first()
    assert got.issue == issue
    if not issue:
        assert got.record_id == "1.SH-20260720-0123456789ab" and got.version == "daily-20260720-0123456789ab" and str(got.volume) == "1000.0000000000"


def test_daily_bars(spark):
    bars = spark.createDataFrame([("1.SH",), ("1.SH",), ("2.BJ",), ("2.BJ",), ("3.SZ",), ("4.SZ",)], "ts_code string")
    kept, wrong = market.daily_bars(bars, spark.createDataFrame([("1.SH",), ("3.SZ",)], "ts_code string"))
    assert sorted(r.ts_code for r in kept.collect()) == ["1.SH", "1.SH", "3.SZ", "4.SZ"]
    assert sorted(map(tuple, wrong.collect())) == [("1.SH", "MARKET_DAILY_DUPLICATE_TS_CODE"), ("2.BJ", "MARKET_DAILY_DUPLICATE_TS_CODE"), ("4.SZ", "MARKET_DAILY_OUT_OF_SCOPE")]


def test_artifacts(spark, tmp_path):
    path, schema = str(tmp_path / "a"), "day date, code int, tags map<string,string>"
    rows = [(D(2026, 1, 1), 1, {"b": "2", "a": "1"}), (D(2026, 1, 1), 2, {}), (D(2026, 1, 2), 1, None)]
    bars = spark.createDataFrame(rows, schema)
    assert artifacts.write_artifacts(bars, path, ["day"], maps=("tags",)).count() == 2
    assert artifacts.write_artifacts(bars.orderBy(F.desc("code")), path, ["day"], maps=("tags",)).count() == 0
    assert [r.issue for r in artifacts.validate_artifacts(spark, path, ["day"]).collect()] == [None, None]
    got = artifacts.read_artifacts(spark, path, ["day"], maps=("tags",), order=("day", "code"), where=F.col("day") == F.lit("2026-01-01").cast("date"))
    assert [(r.day, r.code, r.tags) for r in got.collect()] == [tuple(r) for r in rows[:2]]
    with pytest.raises(ValueError, match="ARTIFACT_EMPTY"):
        artifacts.write_artifacts(bars.limit(0), path, ["day"], maps=("tags",))
    with pytest.raises(ValueError, match="TOTAL_RETURN_PARTITION_MIXED"):
        artifacts.write_artifacts(bars, path, ["day"], maps=("tags",), group="code", same=("day",), mixed="TOTAL_RETURN_PARTITION_MIXED")
    # Other content of a day is another artifact, and then none of the two holds.
    artifacts.write_artifacts(spark.createDataFrame([(D(2026, 1, 2), 7, None)], schema), path, ["day"], maps=("tags",))
    with pytest.raises(ValueError, match="MULTIPLE_ARTIFACTS"):
        artifacts.read_artifacts(spark, path, ["day"])
    assert artifacts.read_artifacts(spark, path, ["day"], where=F.col("day") == F.lit("2026-01-01").cast("date")).count() == 2
    # Files that no manifest lists aren't read.
    listed = artifacts.manifest(spark, path).where("day = '2026-01-01'").first()
    folder = f"{path}/rows/attempt={listed.attempt}/p_day=v2026-01-01/artifact=sha256-{listed.digest}"
    spark.read.parquet(folder).where("code = 1").withColumn("code", F.lit(5)).write.mode("append").parquet(folder)
    assert {str(r.day): r.issue for r in artifacts.validate_artifacts(spark, path, ["day"]).collect()}["2026-01-01"] is None
    # A file that is lost is seen.
    jvm = spark._jvm
    jvm.java.io.File(f"{folder}/{listed.files[0].name}").delete()
    assert {str(r.day): r.issue for r in artifacts.validate_artifacts(spark, path, ["day"]).collect()}["2026-01-01"] in ("ARTIFACT_MISSING", "ARTIFACT_COUNT")


def test_prefixes_mean_what_they_mean_there():
    """A prefix that is bound again inside, and again outside of that; names without a prefix; a prefix that ended."""
    unit = b'<unit id="%s"%s><measure>%s</measure></unit>'
    text = b'<xbrl xmlns="http://www.xbrl.org/2003/instance" xmlns:p="urn:one"><group xmlns:p="urn:two">' + unit % (b"a", b"", b"p:x") + unit % (b"b", b' xmlns:p="urn:three"', b"p:x") + unit % (b"c", b"", b"p:x") + b"</group>" + unit % (b"d", b"", b"p:x") + unit % (b"e", b' xmlns=""', b"y") + b"</xbrl>"
    text = text.replace(b'<unit id="e" xmlns=""><measure>y</measure>', b'<unit id="e"><measure xmlns:q="urn:q">y</measure>')
    got = {u["unit_id"]: u["over"] for u in instances.parse_instance(text)["units"]}
    assert got == {"a": ["{urn:two}x"], "b": ["{urn:three}x"], "c": ["{urn:two}x"], "d": ["{urn:one}x"], "e": ["{http://www.xbrl.org/2003/instance}y"]}
    with pytest.raises(ValueError):
        instances.parse_instance(b'<xbrl xmlns="http://www.xbrl.org/2003/instance"><a xmlns:z="urn:z"/><unit id="u"><measure>z:x</measure></unit></xbrl>')


def test_scopes_are_told_only_where_they_differ(monkeypatch):
    inner = INSTANCE.replace(b"<measure>c:CNY</measure></unit>", b'<measure xmlns:c="urn:other">c:CNY</measure></unit>')
    assert instances.parse_instance(inner)["units"][0]["over"] == ["{urn:other}CNY"]
    wide = INSTANCE.decode().replace("?>", ' encoding="UTF-16"?>', 1).encode("utf-16")
    want = instances.parse_instance(INSTANCE)
    assert instances.parse_instance(wide) == want and [u["over"] for u in want["units"]] == [[CNY], [CNY]]

    def slow(*_, **__):
        raise AssertionError

    monkeypatch.setattr(instances.ElementTree, "iterparse", slow)
    assert instances.parse_instance(INSTANCE) == want


def test_codes_of_files_are_found_in_one_pass(spark):
    files = spark.createDataFrame([("a", bytearray(INSTANCE)), ("b", bytearray(b"<x")), ("c", bytearray(INSTANCE.replace(b">1000<", b">none<"))), ("d", bytearray(b"<!DOCTYPE x><x/>")), ("d", bytearray(b"<x"))], "path string, content binary")
    rows = instances.read_instances(files)
    got = instances.instance_codes(rows)
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    want = {"a": [], "b": ["FINANCIAL_XBRL_PARSE_ERROR"], "c": ["FINANCIAL_XBRL_PARSE_ERROR"], "d": ["FINANCIAL_XBRL_PARSE_ERROR", "FINANCIAL_XML_UNSAFE"]}
    assert {r.path: r.codes for r in got.collect()} == want == {r.path: r.codes for r in instances.diagnostics(rows, instances.facts_of(rows)).collect()}


def test_document_types_are_refused(spark):
    bad = '<?xml version="1.0" encoding="%s"?><!DOCTYPE xbrl [<!ENTITY a "77">]><xbrl xmlns="http://www.xbrl.org/2003/instance">&a;</xbrl>'
    files = [("a", bytearray((bad % "UTF-8").encode())), ("b", bytearray((bad % "UTF-16").encode("utf-16"))), ("c", bytearray(INSTANCE)), ("d", bytearray(b"<!DOCTYPE x SYSTEM 'file:///etc/passwd'><x/>")), ("e", bytearray(b""))]
    rows = instances.read_instances(spark.createDataFrame(files, "path string, content binary"))
    assert {r.path: r.codes for r in instances.diagnostics(rows, instances.facts_of(rows)).collect()} == {"a": ["FINANCIAL_XML_UNSAFE"], "b": ["FINANCIAL_XML_UNSAFE"], "c": [], "d": ["FINANCIAL_XML_UNSAFE"], "e": ["FINANCIAL_XBRL_PARSE_ERROR"]}


def test_responses_of_a_provider(spark, tmp_path):
    names = list(responses.DAILY_FIELDS)
    row = ["600000.SH", "20260720", 10.10, 11, 9.5, 10.1234567891, "10", 1000, None]
    bodies = {
        "20260720": [{"data": {"fields": names, "items": [row, [*row[:2], "x", *row[3:]]]}}, {"data": {"fields": names[::-1], "items": [row[::-1]]}}, {"data": {"fields": names[:-1], "items": []}}, {"data": {"fields": [*names[:-1], "z"], "items": []}}, {"data": {"fields": [*names[:-1], 1], "items": []}},
                     {"data": {"fields": names, "items": [row[:-1]]}}, {"data": {"fields": names, "items": 3}}, {"data": None}, [1], "text"],
        "20260721": [{"data": {"fields": names, "items": [row, [row[0], "2026-07-21", *row[2:]]]}}, {"data": {"fields": names, "items": []}}],
    }
    for day, files in bodies.items():
        (tmp_path / f"requested=d{day}").mkdir()
        for i, body in enumerate(files):
            (tmp_path / f"requested=d{day}" / f"{i}.json").write_text(json.dumps(body))
    judged = responses.judge_responses(responses.landed(spark, str(tmp_path)))
    got = {(r.requested[-2:], r.file[-6]): (r.issue and r.issue.split("_")[1], r.missing, r.unknown) for r in judged.collect()}
    assert got == {("20", "0"): (None, [], []), ("20", "1"): (None, [], []), ("20", "2"): ("FIELDS", ["amount"], []), ("20", "3"): ("FIELDS", ["amount"], ["z"]), ("20", "4"): ("FIELDS", ["amount"], ["1"]), ("20", "5"): ("ROW", [], []), ("20", "6"): ("ROW", [], []),
                   ("20", "7"): ("FIELDS", sorted(names), []), ("20", "8"): ("RESPONSE", sorted(names), []), ("20", "9"): ("RESPONSE", sorted(names), []), ("21", "0"): (None, [], []), ("21", "1"): (None, [], [])}
    rows = sorted((r.requested[-2:], str(r.open), str(r.close), r.issue) for r in responses.daily_bars(judged).collect())
    number = ("10.1000000000", "10.1234567891")
    assert rows == sorted([("20", *number, None), ("20", *number, None), ("20", "None", number[1], "TUSHARE_VALUE_INVALID"), ("21", *number, "TUSHARE_TRADE_DATE_MISMATCH"), ("21", *number, "TUSHARE_TRADE_DATE_INVALID")])
    plan = responses.landed(spark, str(tmp_path)).where("requested = '20260721'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(requested" in plan


def test_responses_come_in_pages(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    monkeypatch.setattr(warehouse, "_PAGE", 50)
    whole, paged = (warehouse._responses(spark, d, p).where("issue IS NULL") for p in (False, True))
    size = lambda x: F.max(F.size("items")).alias(x)
    # No file grows with the number of codes, and together they have the same rows.
    assert 2 * paged.agg(size("n")).first().n < whole.agg(size("n")).first().n and paged.count() > 2 * whole.count()
    one, two = (responses.daily_bars(x).drop("file") for x in (whole, paged))
    assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


def test_a_writer_that_dies_leaves_nothing(spark, tmp_path, monkeypatch):
    """The case that doubled rows: rows are written, the job dies before they count, and the call is made again."""
    path, rows = str(tmp_path / "a"), spark.createDataFrame([(1, "x"), (2, "x"), (3, None)], "code int, day string")
    for name in ("list_files", "commit"):
        with monkeypatch.context() as m, pytest.raises(RuntimeError):
            m.setattr(artifacts, name, lambda *a, **k: (_ for _ in ()).throw(RuntimeError("dead")))
            artifacts.write_artifacts(rows, path, ["day"])
    with pytest.raises(ValueError, match="ARTIFACT_NOT_FOUND"):
        artifacts.manifest(spark, path)
    assert artifacts.write_artifacts(rows, path, ["day"]).count() == 2
    assert artifacts.write_artifacts(rows, path, ["day"]).count() == 0
    assert sorted(r.code for r in artifacts.read_artifacts(spark, path, ["day"]).collect()) == [1, 2, 3]
    assert [r.issue for r in artifacts.validate_artifacts(spark, path, ["day"]).collect()] == [None, None]
    # Rows that a lost task has left out are seen before anything counts.
    with monkeypatch.context() as m, pytest.raises(ValueError, match="ARTIFACT_WRITE_INCOMPLETE"):
        write = artifacts.write_rows
        m.setattr(artifacts, "write_rows", lambda stored, *a: write(stored.where("code <> 7"), *a))
        artifacts.write_artifacts(rows.union(spark.createDataFrame([(7, "x")], rows.schema)), path, ["day"])
    assert artifacts.manifest(spark, path).count() == 2


def test_hashes_are_moved_once_and_as_bytes(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 1), ("b", None)], "g string, x int")
    one, two = (tables.content_digest(rows, ["g"], ["x"], copies=c) for c in (False, True))
    # Branches of a group meet once more; of rows there is one move, or two where copies are counted before.
    assert [x._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") for x in (one, two)] == [2, 3]
    assert sorted(one.collect()) == sorted(two.collect()) and [(r.g, r.n) for r in one.orderBy("g").collect()] == [("a", 3), ("b", 2)]


def test_an_attempt_counts_once(spark, tmp_path):
    log = str(tmp_path / "log")
    assert commits.committed(spark, log) == {}
    assert commits.commit(spark, log, "a", "1") and not commits.commit(spark, log, "a", "2") and commits.commit(spark, log, "b", "x@y")
    assert commits.committed(spark, log) == {"a": "1", "b": "x@y"}
    path, rows = str(tmp_path / "a"), spark.createDataFrame([(1,)], "code int")
    one = artifacts.write_artifacts(rows, path, ["code"], attempt="batch-1")
    again = artifacts.write_artifacts(rows.withColumn("code", F.lit(9)), path, ["code"], attempt="batch-1")
    assert one.collect() == again.collect() and artifacts.manifest(spark, path).count() == 1


def test_versions_expire_and_run_again(spark, tmp_path):
    path, T = str(tmp_path / "v"), lambda day: dt.datetime(2026, 1, day)
    batch = lambda rows: spark.createDataFrame(rows, "k string, v int, o long, at timestamp")
    sink = sinks.versions(path, "k", "v", "o", seen="at", keep="5 days")
    first = batch([("a", 1, 5, T(1)), ("a", 2, 5, T(1)), ("a", 3, None, T(1)), (None, 4, 1, T(1)), ("b", 5, 7, T(1)), ("a", 6, 9, T(2)), ("a", None, 9, T(2))])
    sink(first, 0)
    sink(batch([("b", 7, 7, T(3)), ("b", 8, 8, T(3)), ("c", 9, 1, T(20))]), 1)
    sink(batch([("a", 10, 1, T(21)), ("c", 11, 1, T(21))]), 2)
    sink(batch([("a", 10, 1, T(21)), ("c", 11, 1, T(21))]), 2)
    sink(batch([]), 3)
    got = {(r.batch, r.v): r.reason for r in sinks.stored(spark, f"{path}/rows", []).collect()}
    assert got == {(0, 1): None, (0, 2): "VERSION_REPEATED", (0, 3): "VERSION_ORDER_MISSING", (0, 4): "VERSION_KEY_MISSING", (0, 5): None, (0, 6): None, (0, None): "VERSION_REPEATED", (1, 7): "VERSION_LATE", (1, 8): None, (1, 9): None, (2, 10): None, (2, 11): "VERSION_LATE"}


def test_backfill_goes_on(spark, tmp_path):
    path, days = str(tmp_path / "b"), spark.createDataFrame([("2026-01-0%d" % i,) for i in (3, 1, 2, 2, 5)], "day string")
    bars = spark.createDataFrame([("2026-01-0%d" % i, i, "BAD" if i == 3 else None) for i in (1, 2, 3, 4, 5)], "day string, close int, issue string")
    run = lambda source: {r.day[-1]: (r.status, r.reason) for r in backfill.backfill(days, source, path, "day", F.col("issue")).collect()}
    assert run(bars) == {"1": ("PUBLISHED", None), "2": ("PUBLISHED", None), "3": ("FAILED", "BAD"), "5": ("NOT_REACHED", None)} and backfill.progress(spark, path) == "2026-01-02"
    assert run(bars.where("close = 3")) == {"1": ("COMPLETED", None), "2": ("COMPLETED", None), "3": ("FAILED", "BAD"), "5": ("NOT_REACHED", None)}
    assert run(bars.withColumn("issue", F.when(F.col("close") < 3, "READ_AGAIN"))) == {"1": ("COMPLETED", None), "2": ("COMPLETED", None), "3": ("PUBLISHED", None), "5": ("PUBLISHED", None)}
    assert backfill.progress(spark, path) == "2026-01-05" and artifacts.read_artifacts(spark, path, ["day"]).count() == 4
    listed = artifacts.manifest(spark, path).where("day = '2026-01-01'").first()
    spark._jvm.java.io.File(f"{path}/rows/attempt={listed.attempt}/p_day=v2026-01-01/artifact=sha256-{listed.digest}/{listed.files[0].name}").delete()
    with pytest.raises(ValueError, match="MARKET_CHECKPOINT_ARTIFACT_INVALID"):
        run(bars)


def test_documents_are_immutable(spark, tmp_path):
    path, made = str(tmp_path / "d"), lambda t: spark.createDataFrame([("r1", t)], "id string, document string").withColumn("hash", F.sha2("document", 256))
    artifacts.write_documents(made('{"report_id":"r1"}'), path)
    artifacts.write_documents(made('{"report_id":"r1"}'), path)
    assert [(r.id, r.issue) for r in artifacts.read_documents(spark, path).collect()] == [("r1", None)]
    with pytest.raises(ValueError, match="REPORT_IMMUTABILITY_CONFLICT"):
        artifacts.write_documents(made('{"report_id":"r1","x":1}'), path)
    spark.createDataFrame([("r2", '{"report_id":"r1"}', "0")], "id string, document string, hash string").write.mode("append").parquet(f"{path}/manifest")
    assert {r.id: r.issue for r in artifacts.read_documents(spark, path).collect()} == {"r1": None, "r2": "REPORT_ARTIFACT_INVALID"}


def test_actions_block_and_repeat(spark):
    rows = [("a", 1, "r1", D(2026, 1, 1), D(2026, 1, 1), "VALID"), ("a", 2, "r1", D(2026, 9, 1), D(2026, 1, 1), "VALID"), ("b", 1, "r2", None, D(2026, 1, 1), "VALID"), ("c", 1, "r3", D(2026, 1, 1), D(2026, 9, 1), "VALID"), ("d", 1, "r4", D(2026, 1, 1), D(2026, 1, 1), "MISSING"), ("e", 1, "r5", D(2026, 1, 1), D(2026, 1, 1), "PARTIAL")]
    actions = spark.createDataFrame(rows, "code string, ordinal int, record_id string, published_at date, valid_from date, quality_status string")
    assert {r.code: r.reason.rsplit("ACTION_")[1] for r in returns.blocked_actions(actions, "2026-05-01", "2026-05-01").collect()} == {"a": "PUBLICATION_AFTER_CUTOFF", "b": "PUBLICATION_AFTER_CUTOFF", "c": "NOT_KNOWN_AT_CUTOFF", "d": "QUALITY_BLOCKED"}
    assert {r.ordinal for r in returns.first_actions(actions).collect()} == {1}


def test_inputs_that_come_twice(spark):
    rows = [("f1", 1, "assets", "VALID"), ("f2", 1, "assets", "VALID"), ("f3", 1, "equity", "CONFLICT"), ("f4", 2, "assets", "VALID")]
    facts = spark.createDataFrame(rows, "fact_id string, key int, name string, quality_status string").withColumns({"published_at": F.lit("2026-01-01").cast("date"), "valid_from": F.lit("2026-01-01").cast("date")})
    assert {r.key: r.reason for r in metrics.input_gate(facts, "key", "2026-02-01", "2026-02-01").collect()} == {1: "FINANCIAL_INPUT_DUPLICATE", 2: None}


def test_details_of_missing_factors(spark):
    spec = [("a", 0.5, True, True), ("b", 0.3, False, False), ("c", 0.2, False, True)]
    rows = [(i, "i", "a", float(i), True) for i in range(25)] + [(i, "i", "b", float(i), True) for i in range(25)] + [(0, "i", "c", 1.0, False), (99, "i", "b", 1.0, True)]
    values = spark.createDataFrame(rows, "code int, industry string, factor string, value double, available boolean").withColumns({"quality_status": F.lit("VALID"), "source_record_ids": F.array(F.lit("s"))})
    got = {(r.code, r.factor): r for r in scoring.factor_details(values, spec).collect()}
    assert len(got) == 75 and (99, "b") not in got
    assert got[0, "c"].quality_status == "MISSING" and got[0, "c"].source_record_ids == ["s"] and got[0, "c"].scope == "unavailable" and got[0, "c"].raw_value is None
    assert got[1, "c"].source_record_ids == ["missing-input"] and got[24, "a"].normalized == 100 and got[24, "b"].normalized == 0 and got[0, "b"].normalized == 100
    best = scoring.candidates(values, spec).orderBy("rank").first()
    assert [x.factor for x in best.factor_details] == ["a", "b", "c"] and best.confidence == pytest.approx(0.8)


def test_evidence(spark):
    evidence = spark.createDataFrame([("a", "v1", 5, 0, 2, True), ("b", "v2", 5, 0, 0, True), ("c", "v1", 5, 0, 0, False), ("d", "v1", 0, 0, 0, True), ("e", "v1", 5, 5, 0, True), ("g", "v1", 1, 0, 0, True)], "strategy string, version string, input int, insufficient int, published int, completed boolean")
    versions = spark.createDataFrame([(s, "v1") for s in "abcdef"], "strategy string, expected string")
    pools = spark.createDataFrame([("a", 2)], "strategy string, candidates int")
    got = {r.strategy: r.reason and r.reason.removeprefix("REPORT_STRATEGY_") for r in reports.evidence_gate(evidence, versions, pools).collect()}
    assert got == {"a": None, "b": "EVIDENCE_MISMATCH", "c": "EVALUATION_INCOMPLETE", "d": "EVALUATION_EMPTY", "e": "ALL_DATA_INSUFFICIENT", "f": "EVIDENCE_INCOMPLETE", "g": "EVIDENCE_INCOMPLETE"}


def test_finalise_and_order(spark):
    f = spark.createDataFrame([(1, "UNVERIFIED", 0, 0, None)], "filing_id int, quality_status string, fact_count int, conflict_count int, valid_from date")
    facts = spark.createDataFrame([(1, "a", None), (1, "b", None)], "filing_id int, fact_id string, valid_from date")
    done, stamped = normalise.finalise(f, facts, spark.createDataFrame([(1, "VALID", 3)], "filing_id int, quality_status string, conflict_count int"), F.lit("2026-01-01").cast("date"))
    assert (done.first().fact_count, done.first().quality_status, done.first().conflict_count) == (2, "VALID", 3) and {r.valid_from for r in stamped.collect()} == {D(2026, 1, 1)}
    v = spark.createDataFrame([(1, D(2026, 1, 2), D(2026, 1, 2), 1), (2, D(2026, 1, 1), D(2026, 1, 3), 2), (3, D(2026, 1, 1), D(2026, 1, 3), 1)], "filing_id int, published_at date, valid_from date, ordinal int")
    assert [r.filing_id for r in filings.versions_in_order(v).collect()] == [3, 2, 1]


def test_report_status(spark):
    reports_ = spark.createDataFrame([(1, "PUBLISHED"), (2, "DRAFT")], "report_id int, status string")
    pointers = spark.createDataFrame([("a", 1), ("b", 1), ("c", None), ("d", 2)], "channel string, report_id int")
    runs = spark.createDataFrame([("a", True), ("b", False), ("c", True), ("d", True)], "channel string, succeeded boolean")
    assert {r.channel: (r.report_id, r.shown) for r in state.report_status(reports_, pointers, runs).collect()} == {"a": (1, "CURRENT"), "b": (1, "STALE_PREVIOUS_REPORT"), "c": (None, "NO_REPORT"), "d": (None, "CURRENT")}


def test_canonical_forms(spark):
    row = spark.range(1).select(canonical.canonical_json({"b": F.lit(None).cast("string"), "a": F.lit("é/")}).alias("j"), canonical.utc_text(F.lit("2026-01-01 08:00:00").cast("timestamp")).alias("u"), canonical.day_end(F.lit("2026-01-01").cast("date")).cast("long").alias("e"), canonical.json_of_map(F.create_map(F.lit("z"), F.lit("1"), F.lit("a"), F.lit("2"))).alias("m")).first()
    assert row.j == '{"a":"é/","b":null}' and row.u == "2026-01-01T08:00:00.000000Z" and row.e == 1767283199 and row.m == '{"a":"2","z":"1"}'


def test_sessions_of_a_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream_once(spark, str(tmp_path / "in"), events.schema, str(tmp_path / "out"), str(tmp_path / "check"), "30 minutes", windows=event_sessions).awaitTermination()
    got, want = ({tuple(r) for r in x.collect()} for x in (spark.read.parquet(str(tmp_path / "out")), event_sessions(events)))
    last = events.agg(F.max("ts")).first()[0]
    assert got == {w for w in want if w[2] <= last} and got


def test_staged_tables_go(spark):
    with staging.passing(spark):
        gone, kept = staging.settle(spark.range(3), "gone"), staging.settle(spark.range(4), "kept", keep=True)
        assert gone.count() == 3
    assert kept.count() == 4 and not spark._jvm.java.io.File(gone.inputFiles()[0].removeprefix("file://")).exists()
