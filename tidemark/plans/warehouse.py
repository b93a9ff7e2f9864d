"""Registered queries on publication: artifacts of all kinds, whole and damaged, crashes, streams that are stored once, and histories that are loaded in several runs."""

from __future__ import annotations

import contextlib

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.operators import returns
from tidemark.operators.backfill import backfill, progress
from tidemark.plans.registry import query, table
from tidemark.plans.views import view
from tidemark.sources import artifacts, responses
from tidemark.sources.staging import new_path, release, settle
from tidemark.streaming import sinks

_MONTHS = "SELECT strftime(trade_date, '%Y-%m') AS month, count(*) AS n, row_number() OVER (ORDER BY strftime(trade_date, '%Y-%m')) AS k FROM bars GROUP BY 1"
_CASES = {1: "ARTIFACT_COUNT", 2: "ARTIFACT_COUNT", 3: "ARTIFACT_PARTITION", 4: "ARTIFACT_CONTENT", 5: "ARTIFACT_MISSING"}


def _bars(spark, d):
    return view(spark, d, "bars").withColumn("month", F.date_format("trade_date", "yyyy-MM"))


def _once(rows, name):
    """rows that are read several times, computed once."""
    out = settle(rows, name)
    release(rows.sparkSession)
    return out


@query(f"+m AS ({_MONTHS}) SELECT month, CASE k % 7 {' '.join(f'''WHEN {k} THEN '{c}' ''' for k, c in _CASES.items())} END AS issue FROM m", "bars")
def bars_artifacts_damaged(spark, d):
    """Of every seven months of stored bars, one has lost a row, one has a row too many, one has the rows of another month, one other content than its digest, and one no files; two are well."""
    path = new_path(spark, "damaged-artifacts")
    artifacts.write_artifacts(_once(_bars(spark, d), "bars"), path, ["month"])
    listed = artifacts.manifest(spark, path)
    place = listed.groupBy().agg(F.array_sort(F.collect_list("month")).alias("months"))
    k = F.array_position("months", F.col("month")) % 7
    # Months 3 of seven are read from the files of the month before; a digest is told wrong by turning it round.
    before = listed.select(F.date_format(F.add_months(F.to_date(F.concat("month", F.lit("-01"))), 1), "yyyy-MM").alias("month"), F.col("files").alias("_files"), F.col("n").alias("_n"))
    cases = listed.crossJoin(F.broadcast(place)).join(before, "month", "left").withColumn("k", k)
    cases = cases.withColumn("n", F.when(F.col("k") == 1, F.col("n") + 1).when(F.col("k") == 2, F.col("n") - 1).when(F.col("k") == 3, F.col("_n")).otherwise(F.col("n")))
    cases = cases.withColumn("digest", F.when(F.col("k") == 4, F.reverse("digest")).otherwise(F.col("digest")))
    gone = F.transform("files", lambda f: f.withField("name", F.concat(F.lit("gone-"), f["name"])))
    cases = cases.withColumn("files", F.when(F.col("k") == 5, gone).when(F.col("k") == 3, F.col("_files")).otherwise(F.col("files")))
    return artifacts.validate_artifacts(spark, path, ["month"], listed=cases.select(listed.columns)).select("month", "issue")


@query(f"+m AS ({_MONTHS}) SELECT month, n, NULL::VARCHAR AS issue FROM m", "bars")
def bars_artifacts_after_crash(spark, d):
    """The writer dies after its rows and before its commit; then it runs again, and another writer commits the same content at the same time: every row is there once."""
    bars, path, real = _once(_bars(spark, d), "bars"), new_path(spark, "crashed-artifacts"), artifacts.commit
    lost = _once(artifacts.content_digest(bars, ["month"], sorted(bars.columns), copies=False), "lost")
    artifacts.write_rows(bars, lost, f"{path}/rows/attempt=a-dead", ["month"])
    artifacts.write_artifacts(bars, path, ["month"], attempt="first")
    other = artifacts.settle(lost.where("month >= '1995'"), "other-writer")
    artifacts.write_rows(bars, other, f"{path}/rows/attempt=a-other", ["month"])
    artifacts.list_files(spark, other, f"{path}/rows/attempt=a-other", ["month"], "a-other").write.parquet(f"{path}/manifests/a-other")
    real(spark, f"{path}/commits", "second", "a-other")
    good = artifacts.validate_artifacts(spark, path, ["month"]).select("month", "issue")
    return artifacts.read_artifacts(spark, path, ["month"]).groupBy("month").agg(F.count("*").alias("n")).join(good, "month")


@query("+p AS (SELECT code, count(*) AS n FROM bars GROUP BY 1) SELECT algorithm, code % 16 AS slice, sum(n)::BIGINT AS n, count(*) AS codes, NULL::VARCHAR AS issue FROM p, (VALUES ('total-return-v1'), ('total-return-v2')) a(algorithm) GROUP BY ALL", "bars", "actions")
def return_artifacts(spark, d):
    """Total returns by algorithm version and slice of securities, stored in two calls of which the second holds both versions, validated and read back."""
    series = _once(returns.total_return(view(spark, d, "bars"), view(spark, d, "actions")).withColumn("slice", F.col("code") % 16), "returns")
    path, by = new_path(spark, "return-artifacts"), ["algorithm", "slice"]
    first = series.withColumn("algorithm", F.lit("total-return-v1"))
    artifacts.write_artifacts(first, path, by)
    artifacts.write_artifacts(first.union(series.withColumn("algorithm", F.lit("total-return-v2"))), path, by)
    good = artifacts.validate_artifacts(spark, path, by).select(*by, "issue")
    return artifacts.read_artifacts(spark, path, by).groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct("code").alias("codes")).join(good, by)


class _Killed(Exception):
    """Stands for a driver that dies."""


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1")
def events_stored_once(spark, d):
    """Events as a stream of four batches. The first run dies after a batch was published and before its checkpoint was written; the second runs that batch again: each event is stored once."""
    source, path, check = (new_path(spark, f"once-{x}") for x in ("in", "out", "check"))
    events = table(spark, d, "events")
    for k in range(4):
        events.where(F.col("event_id") % 4 == k).coalesce(1).write.mode("append").parquet(source)
    sink = sinks.once(path, [])

    def dies(batch, number):
        sink(batch, number)
        if number == 1:
            raise _Killed

    for each in (dies, sink):
        with contextlib.suppress(PySparkException):
            sinks.run_once(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source), each, check)
    return sinks.stored(spark, path, []).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))


@query("""WITH e AS (SELECT user_id, event_id, event_id % 2 AS batch, CASE WHEN event_id % 50 <> 0 THEN round(value * 100)::BIGINT END AS place FROM events), first AS (SELECT user_id, max(place) AS top FROM e WHERE batch = 0 GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, batch, place ORDER BY event_id) AS nth FROM e),
v AS (SELECT r.user_id, event_id, CASE WHEN place IS NULL THEN 'VERSION_ORDER_MISSING' WHEN batch = 1 AND place <= top THEN 'VERSION_LATE' WHEN nth > 1 THEN 'VERSION_REPEATED' END AS reason FROM r LEFT JOIN first ON r.user_id = first.user_id)
SELECT user_id, event_id, reason IS NULL AS accepted, reason FROM v""")
def events_late_versions(spark, d):
    """Versions of a user as a stream of two batches, some without a place: what isn't beyond the last version is refused, with its reason."""
    source, path, check = (new_path(spark, f"versions-{x}") for x in ("in", "out", "check"))
    rows = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_id") % 50 != 0, F.round(F.col("value") * 100).cast("long")).alias("place"))
    for batch in (0, 1):
        rows.where(F.col("event_id") % 2 == batch).write.mode("append").parquet(source)
        sinks.run_once(spark.readStream.schema(rows.schema).parquet(source), sinks.versions(path, "user_id", "event_id", "place"), check)
    return sinks.stored(spark, f"{path}/rows", []).select("user_id", "event_id", "accepted", "reason")


@query(f"""+m AS ({_MONTHS}), w AS (SELECT month, n, k FROM m UNION ALL SELECT '2099-01', NULL, NULL), top AS (SELECT max(k) // 2 AS half FROM m)
SELECT month, CASE WHEN k IS NULL THEN 'FAILED' WHEN k <= half THEN 'COMPLETED' ELSE 'PUBLISHED' END AS status, CASE WHEN k IS NULL THEN 'MARKET_DATA_MISSING' END AS reason, n FROM w, top""", "bars")
def bars_backfill(spark, d):
    """A history of months in two runs: the first stops at a month whose bars aren't good, the second, with that month mended and the completed ones poisoned, goes on from there to a month that has no bars."""
    bars, path = _bars(spark, d), new_path(spark, "backfill")
    months = bars.select("month").distinct()
    half = months.agg(F.array_sort(F.collect_list("month")).alias("m")).select(F.get("m", F.floor(F.size("m") / 2).cast("int")).alias("half"))
    wanted = months.union(months).union(spark.createDataFrame([("2099-01",), (None,)], "month string"))
    flagged = bars.crossJoin(F.broadcast(half))
    first = flagged.withColumn("bad", F.when((F.col("month") == F.col("half")) & (F.col("code") % 5 == 0), "MARKET_BAR_QUALITY_BLOCKED")).drop("half")
    backfill(wanted, first, path, "month", F.col("bad"))
    second = flagged.withColumn("bad", F.when(F.col("month") < F.col("half"), "READ_AGAIN")).drop("half")
    status = backfill(wanted, second, path, "month", F.col("bad"))
    counts = artifacts.read_artifacts(spark, path, ["month"]).groupBy("month").agg(F.count("*").alias("n"))
    assert progress(spark, path) is not None
    return status.join(counts, "month", "left")


_FIELDS = list(responses.DAILY_FIELDS)


#: Codes of a page: some 6,000 bars of a month, as many rows as the provider gives at once.
_PAGE = 16_000


def _responses(spark, d, paged=False):
    """A month's bars as the provider's response to a request for its first day (paged: in responses of some 6,000 rows, so that a file doesn't grow with the number of codes), in every third month with the fields in another order; in July a second file has a field too many and in August one too few, in September one is no JSON."""
    path, day = new_path(spark, "responses"), F.trunc("trade_date", "month")
    number = [F.col(c).cast("string") for c in ("open", "high", "low", "close", "open", "volume", "amount")]
    cells = F.array(F.format_string('"%s.SH"', "code"), F.format_string('"%s"', F.date_format(day, "yyyyMMdd")), *number)
    page = F.floor(F.col("code") / _PAGE) if paged else F.lit(0)
    rows = view(spark, d, "bars").select(F.date_format(day, "yyyyMMdd").alias("day"), F.month(day).alias("m"), page.alias("page"), cells.alias("cells"))
    rows = rows.withColumn("cells", F.when(F.col("m") % 3 == 0, F.reverse("cells")).otherwise(F.col("cells")))
    items = rows.groupBy("day", "m", "page").agg(F.array_join(F.collect_list(F.concat(F.lit("["), F.array_join("cells", ","), F.lit("]"))), ",").alias("items"))
    names = lambda fs: F.lit(",".join(f'"{f}"' for f in fs))
    body = lambda fs, rows: F.concat(F.lit('{"code":0,"data":{"fields":['), fs, F.lit('],"items":['), rows, F.lit("]}}"))
    good = items.select("day", "page", body(F.when(F.col("m") % 3 == 0, names(_FIELDS[::-1])).otherwise(names(_FIELDS)), F.col("items")).alias("value"))
    odd = F.when(F.col("m") == 7, body(names([*_FIELDS, "extra"]), F.lit(""))).when(F.col("m") == 8, body(names(_FIELDS[:-1]), F.lit(""))).when(F.col("m") == 9, F.lit("{"))
    more = rows.select("day", "m").distinct().select("day", F.lit(0).alias("page"), odd.alias("value")).where("value IS NOT NULL")
    for part in (good, more):
        part.repartition("day", "page").select(F.concat(F.lit("d"), "day").alias("requested"), "value").write.mode("append").option("maxRecordsPerFile", 1).partitionBy("requested").text(path)
    return responses.judge_responses(responses.landed(spark, path))


@query("SELECT strftime(trade_date, '%Y%m') || '01' AS requested, code || '.SH' AS ts_code, open, high, low, close, volume::DOUBLE AS vol, amount, NULL::VARCHAR AS issue FROM bars", "bars")
def provider_bars(spark, d):
    rows = responses.daily_bars(_responses(spark, d, paged=True))
    return rows.select("requested", "ts_code", *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "vol", "amount")], "issue")


@query("""+m AS (SELECT DISTINCT strftime(trade_date, '%Y%m') || '01' AS requested, month(trade_date) AS m FROM bars)
SELECT requested, NULL::VARCHAR AS issue, '' AS missing, '' AS unknown FROM m UNION ALL SELECT requested, CASE WHEN m = 9 THEN 'TUSHARE_RESPONSE_INVALID' ELSE 'TUSHARE_FIELDS_INVALID' END, CASE m WHEN 8 THEN 'amount' WHEN 9 THEN 'amount,close,high,low,open,pre_close,trade_date,ts_code,vol' ELSE '' END, CASE m WHEN 7 THEN 'extra' ELSE '' END FROM m WHERE m IN (7, 8, 9)""", "bars")
def provider_responses(spark, d):
    return _responses(spark, d).select("requested", "issue", F.array_join("missing", ",").alias("missing"), F.array_join("unknown", ",").alias("unknown"))
