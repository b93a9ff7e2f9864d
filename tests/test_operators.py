"""Literal cases of the research operators."""

import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.functions import ordering
from tidemark.functions.statistics import mid_rank_percentiles
from tidemark.operators import facts, filings, market, metrics, reports, returns
from tidemark.sources import labelled_text, tables
from tidemark.streaming.windows import event_windows, stream_once

D = dt.date


def test_total_return_applies_actions_in_order(spark):
    bars = spark.createDataFrame([(1, D(2026, 7, 17), 10.0), (1, D(2026, 7, 20), 8.0)], "code long, trade_date date, close double")
    acts = [(1, D(2026, 7, 20), "a", "STOCK", 0.2, 0.0, "ANNOUNCED"), (1, D(2026, 7, 20), "b", "RIGHTS", 0.3, 8.0, "ANNOUNCED"), (1, D(2026, 7, 20), "c", "CASH", 9.0, 0.0, "CANCELLED"), (1, D(2026, 7, 17), "d", "CASH", 9.0, 0.0, "ANNOUNCED")]
    actions = spark.createDataFrame(acts, "code long, ex_date date, record_id string, action_type string, ratio double, price double, action_status string")
    got = [r["index"] for r in returns.total_return(bars, actions).orderBy("trade_date").collect()]
    assert got == pytest.approx([1.0, (8 * 1.5 - 2.4) / 10])


CHAIN = "entity long, filing_id long, supersedes_id long, published_at date, valid_from date, quality_status string"


@pytest.mark.parametrize(("rows", "selected", "blocked"), [
    ([(1, 10, None, D(2026, 4, 1), D(2026, 4, 2), "VALID"), (1, 11, 10, D(2026, 4, 30), D(2026, 5, 1), "VALID")], 11, None),
    ([(1, 10, None, D(2026, 4, 1), D(2026, 4, 2), "VALID"), (1, 11, 10, D(2026, 6, 30), D(2026, 7, 1), "VALID")], 10, None),
    ([(1, 10, None, D(2026, 4, 1), D(2026, 4, 2), "VALID"), (1, 11, 10, D(2026, 4, 30), D(2026, 5, 1), "CONFLICT")], None, "FINANCIAL_RESTATEMENT_UNUSABLE"),
    ([(1, 10, None, D(2026, 4, 1), D(2026, 4, 2), "UNVERIFIED")], None, None),
    ([(1, 10, None, D(2026, 4, 1), D(2026, 4, 2), "VALID"), (1, 12, None, D(2026, 4, 3), D(2026, 4, 4), "VALID")], None, "FINANCIAL_RESTATEMENT_UNUSABLE"),
    ([(1, 10, None, D(2026, 4, 1), D(2026, 4, 2), "VALID"), (1, 11, 10, D(2026, 4, 3), D(2026, 4, 4), "VALID"), (1, 12, 10, D(2026, 4, 3), D(2026, 4, 4), "VALID")], None, "FINANCIAL_RESTATEMENT_UNUSABLE"),
    ([(1, 10, 9, D(2026, 4, 1), D(2026, 4, 2), "VALID")], None, "FINANCIAL_RESTATEMENT_UNUSABLE"),
    ([(1, 9, None, D(2026, 4, 1), D(2026, 4, 2), "VALID"), (1, 10, 11, D(2026, 4, 1), D(2026, 4, 2), "VALID"), (1, 11, 10, D(2026, 4, 1), D(2026, 4, 2), "VALID")], None, "FINANCIAL_RESTATEMENT_UNUSABLE"),
])
def test_version_selection(spark, rows, selected, blocked):
    got = filings.select_versions(spark.createDataFrame(rows, CHAIN), "2026-05-15", "2026-05-15").collect()
    assert [(r.selected, r.blocked_reason) for r in got] == [(selected, blocked)]


def test_chain_depths_leave_cycles_without_root(spark):
    rows = [(1, 1, None, D(2026, 1, 1), D(2026, 1, 1), "VALID"), (1, 2, 1, D(2026, 1, 1), D(2026, 1, 1), "VALID"), (1, 3, 4, D(2026, 1, 1), D(2026, 1, 1), "VALID"), (1, 4, 3, D(2026, 1, 1), D(2026, 1, 1), "VALID")]
    got = {r.filing_id: (r.root_id, r.depth) for r in filings.chain_depths(spark.createDataFrame(rows, CHAIN)).collect()}
    assert got == {1: (1, 0), 2: (1, 1), 3: (None, None), 4: (None, None)}


def test_chains_of_any_length_have_their_root(spark):
    rows = [(1, i, i - 1 if i else None, D(2026, 1, 1), D(2026, 1, 1), "VALID") for i in range(700)] + [(1, i, 1000 + (i + 1) % 3, D(2026, 1, 1), D(2026, 1, 1), "VALID") for i in range(1000, 1003)]
    got = {r.filing_id: (r.root_id, r.depth) for r in filings.chain_depths(spark.createDataFrame(rows, CHAIN)).collect()}
    assert got == {i: (0, i) if i < 700 else (None, None) for i in [*range(700), *range(1000, 1003)]}


def test_metric_reasons(spark):
    names = ", ".join(f"{n} double" for n in metrics.INPUTS)
    row = (1, 100.0, 40.0, 60.0, 40.0, 200.0, 0.0, -5.0, 30.0, None, 7.0, None, 2400.0)
    got = {r.metric: (r.value, r.reason) for r in metrics.metrics(spark.createDataFrame([row], f"id long, {names}, market_cap double"), "id").collect()}
    assert got["roe"] == (-0.1, None) and got["debt_ratio"] == (0.4, None) and got["pb"] == (40.0, None)
    assert got["revenue_growth"] == (None, "DENOMINATOR_MISSING_OR_ZERO") and got["roic"] == (None, "DENOMINATOR_MISSING_OR_ZERO")
    assert got["pe"] == (None, "NON_POSITIVE_EARNINGS") and got["free_cash_flow"] == (None, "INPUT_MISSING") and got["fcf_yield"] == (None, "INPUT_MISSING")


def test_balance_tolerance(spark):
    rows = [("a", 1, "assets", 100.0, 0), ("b", 1, "liabilities", 40.0, 0), ("c", 1, "equity", 61.5, 0), ("d", 2, "assets", 100.0, 0), ("e", 2, "liabilities", 40.0, 0), ("f", 2, "equity", 61.6, 0), ("g", 3, "assets", 1.0, 0), ("h", 4, "assets", 1.0, None), ("i", 4, "assets", 2.0, None), ("j", 4, "equity", 1.0, None), ("k", 4, "liabilities", 0.0, None)]
    got = {r.filing_id: r.status for r in facts.balance(spark.createDataFrame(rows, "fact_id string, filing_id long, name string, value double, decimals int"), "filing_id").collect()}
    assert got == {1: "BALANCED", 2: "FINANCIAL_BALANCE_EQUATION_CONFLICT", 3: "FINANCIAL_BALANCE_COMPONENT_MISSING", 4: "SKIPPED"}


def test_mid_ranks_with_ties_and_alone(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 3.0), ("b", 5.0)], "g string, v double")
    got = sorted((r.g, round(r.percentile, 3)) for r in mid_rank_percentiles(rows, ["g"], "v", tails=0.0).collect())
    assert got == [("a", 25.0), ("a", 25.0), ("a", 100.0), ("b", 50.0)]


def test_ranks_of_a_group_over_many_ranges(spark):
    """One group with most rows and ties, over twenty ranges, against the definition."""
    import random
    from bisect import bisect_left, bisect_right

    R = random.Random(1)
    groups = {"a": [R.choice((R.gauss(0, 9), 1.5, 1.5, -2.0)) for _ in range(3000)], "b": [R.random() for _ in range(50)], "c": [4.0] * 9, "d": [1.0], None: [3.0, 1.0, 2.0]}
    rows = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None)], "g string, v double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 20)
    try:
        counts = ordering.ordered_counts(rows, ["g"], "v").collect()
        for r in counts:
            vs = sorted(groups[r.g])
            assert (r.below, r.below + r.equal, r.total) == (bisect_left(vs, r.v), bisect_right(vs, r.v), len(vs))
        got = {}
        for r in mid_rank_percentiles(rows.where("v IS NOT NULL AND g IS NOT NULL"), ["g"], "v", tails=0.05).collect():
            got.setdefault(r.g, []).append((r.v, r.low, r.high, r.population, r.percentile))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)

    def quantile(vs, share):
        place = (len(vs) - 1) * share
        i = int(place)
        return vs[i] + (place - i) * ((vs[i + 1] if i + 1 < len(vs) else vs[i]) - vs[i])

    for g, found in got.items():
        vs = sorted(groups[g])
        low, high = quantile(vs, 0.05), quantile(vs, 0.95)
        held = sorted(min(max(v, low), high) for v in vs)
        for v, lo, hi, n, share in found:
            x = min(max(v, lo), hi)
            want = 50.0 if n == 1 else (bisect_left(held, x - 1e-12) + (bisect_right(held, x + 1e-12) - bisect_left(held, x - 1e-12) - 1) / 2) / (n - 1) * 100
            assert (lo, hi, n) == (pytest.approx(low), pytest.approx(high), len(vs)) and share == pytest.approx(want)


def test_predecessors_of_a_large_entity(spark):
    import random

    R = random.Random(3)
    rows = [(i, "hot" if i % 3 else f"e{i % 40}", D(2020, 1, 1) + dt.timedelta(R.randrange(400))) for i in range(1500)] + [(9001, None, D(2020, 1, 1)), (9002, "hot", None)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 25)
    try:
        got = {r.filing_id: r.predecessor for r in filings.predecessors(spark.createDataFrame(rows, "filing_id int, entity string, published_at date")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for i, e, day in rows:
        earlier = [(d, j) for j, x, d in rows if e and day and x == e and d and d < day]
        assert got[i] == (max(earlier)[1] if earlier else None)


def test_exact_index_equals_pythons_decimals(spark):
    """5,000 bars with 1,100 actions, a security with actions each day, one of a single bar, one without actions."""
    import random
    from decimal import Decimal as X

    R, bars, actions = random.Random(1), [], []
    for code, n, every in ((1, 5000, 9), (2, 50, 1), (3, 1, 1), (4, 300, 10**9)):
        close = X(10)
        for i in range(n):
            close = max((close * X(str(round(R.uniform(0.97, 1.031), 4)))).quantize(X("0.0001")), X("0.5"))
            day = D(2000, 1, 1) + dt.timedelta(i)
            bars.append((code, day, close))
            for k in range(R.randint(1, 3) if i % every == 0 else 0):
                kind = R.choice(["CASH", "STOCK", "SPLIT", "RIGHTS"])
                ratio = {"CASH": X("0.05"), "STOCK": X("0.02"), "SPLIT": R.choice([X("1.05"), X("0.95")]), "RIGHTS": X("0.03")}[kind]
                actions.append((code, day, kind, f"{code}-{i}-{k}", ratio, (close * X("0.9")).quantize(X("0.0000001")), "CANCELLED" if R.random() < 0.1 else "ANNOUNCED"))
    out = returns.exact_total_return(spark.createDataFrame(bars, "code int, trade_date date, close decimal(18,7)"), spark.createDataFrame(actions, "code int, ex_date date, action_type string, record_id string, ratio decimal(12,6), price decimal(18,7), action_status string"))
    got, days, index, before = {(r.code, r.trade_date): (r["index"], r.actions_used) for r in out.collect()}, {}, {}, {}
    for a in actions:
        if a[6] != "CANCELLED":
            days.setdefault(a[:2], []).append(a)
    for code, day, close in bars:
        mine, shares, cash, cost = sorted(days.get((code, day), []) if code in before else [], key=lambda a: a[3]), X(1), X(0), X(0)
        for _, _, kind, _, ratio, price, _ in mine:
            shares = shares * (1 + ratio) if kind == "STOCK" else shares * ratio if kind == "SPLIT" else shares + ratio if kind == "RIGHTS" else shares
            cash, cost = cash + (ratio if kind == "CASH" else 0), cost + (ratio * price if kind == "RIGHTS" else 0)
        index[code] = index[code] * (close * shares + cash - cost) / before[code] if code in before else X(1)
        before[code] = close
        value, used = got[code, day]
        assert used == len(mine) and abs(value - index[code]) <= X("0.5e-10") + index[code] * X("1e-12")


def test_exact_index_is_rounded_once_with_whole_prices(spark):
    """A value just under a tie at six places that ten places make a tie, and a price of rights whose digits after the seventh decide."""
    bars = [(1, D(2020, 1, 1), 10.0), (1, D(2020, 1, 2), 9.0), (2, D(2020, 1, 1), 1.0), (2, D(2020, 1, 2), 1.0)]
    actions = [(1, D(2020, 1, 2), "CASH", "a", 0.004594999999, None, "ANNOUNCED"), (2, D(2020, 1, 2), "RIGHTS", "b", 0.1, 0.99999504, "ANNOUNCED")]
    schemas = "code int, trade_date date, close double", "code int, ex_date date, action_type string, record_id string, ratio double, price double, action_status string"
    frames = [spark.createDataFrame(rows, s) for rows, s in zip((bars, actions), schemas)]
    six, floats = (dict(df.where("trade_date > DATE '2020-01-01'").select("code", F.round("index", 6).cast("double")).collect()) for df in (returns.exact_total_return(*frames, places=6), returns.total_return(*frames)))
    assert six == floats == {1: 0.900459, 2: 1.0}


def test_rate_slots(spark):
    calls = spark.createDataFrame([("s", i, t) for i, t in enumerate((0.0, 1.0, 2.0, 100.0))], "source_id string, call_id long, asked double")
    assert [r.slot for r in reports.rate_slots(calls, 6).orderBy("call_id").collect()] == [0.0, 10.0, 20.0, 100.0]


def test_policy_ladder(spark):
    policies = spark.createDataFrame([("a", True, True, ["https"], ["x.org"], ["RESEARCH"], []), ("b", False, True, ["https"], ["x.org"], ["RESEARCH"], [])], "source_id string, approved boolean, enabled boolean, schemes array<string>, domains array<string>, purposes array<string>, http_hosts array<string>")
    urls = [("a", "https://x.org/1", "RESEARCH"), ("a", "http://x.org/1", "RESEARCH"), ("a", "https://y.org/1", "RESEARCH"), ("a", "https://x.org/1", "OTHER"), ("a", "ftp://x.org", "RESEARCH"), ("b", "https://x.org", "RESEARCH"), ("z", "https://x.org", "RESEARCH")]
    got = [r.decision for r in reports.policy_decision(spark.createDataFrame(urls, "source_id string, url string, purpose string").coalesce(1), policies).collect()]
    assert sorted(got) == sorted(["ALLOWED", "HTTP_ENDPOINT_NOT_ALLOWED", "DOMAIN_NOT_ALLOWED", "PURPOSE_NOT_ALLOWED", "SCHEME_NOT_ALLOWED", "SOURCE_REVIEW_REQUIRED", "SOURCE_POLICY_MISSING"])


def test_labelled_text(spark):
    text = "报告期：2025-12-31\n货币单位: 万元\n资产总计｜1,000\n负债合计 | 400\n所有者权益合计 | 600\n营业收入 | 2,000.5\n净利润 | (100)\n经营活动产生的现金流量净额 | 50"
    got = labelled_text.extraction_issues(labelled_text.extract_facts(spark.createDataFrame([(text,), ("",)], "text string"))).collect()
    assert got[0].total_assets == 1e7 and got[0].net_profit == -1e6 and got[0].issues == []
    assert got[1].issues == ["PDF_REPORT_PERIOD_MISSING", "PDF_CURRENCY_MISSING", "PDF_UNIT_MULTIPLIER_MISSING", "PDF_REQUIRED_FACTS_MISSING"]


def test_amounts_as_written(spark):
    cases = {"1,000": 1000, "1000": 1000, "+12.5": 12.5, "-12.50": -12.5, "(1,234,567.8)": -1234567.8, "0": 0, "1,2,3": None, "(5": None, "5)": None, "12,34": None, "1234,567": None, "1,000,": None, "": None, "1.": None, ".5": None, "-(5)": None, "(-5)": None, "1e5": None, "n/a": None, "1.2.3": None, "12 3": None}
    rows = spark.createDataFrame([(k,) for k in cases], "cell string")
    assert {r.cell: r.v for r in rows.select("cell", labelled_text.amount_of(F.col("cell")).alias("v")).collect()} == cases
    text = "净利润 | 1,2,3\n其他净利润 | 5\n营业收入\u3000：\u30007\n报告期: 2025-13-01\n货币单位：箱\n资产总计 5"
    got = labelled_text.extract_facts(spark.createDataFrame([(text,)], "text string")).first()
    assert (got.revenue, got.net_profit, got.unreadable, got.report_period, got.currency_unit, got.total_assets) == (7, None, ["net_profit"], None, None, None)


def test_digest_ignores_order_and_sees_nulls(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    b = spark.createDataFrame([(2, None), (1, "x")], "k int, v string")
    c = spark.createDataFrame([(2, ""), (1, "x")], "k int, v string")
    one = [tables.content_digest(x.withColumn("g", F.lit(0)), ["g"], ["k", "v"]).first().digest for x in (a, b, c)]
    assert one[0] == one[1] != one[2]


def test_digest_is_a_tree(spark):
    import hashlib

    def tree(parts, depth=(8, 4)):
        """Digests of parts that share their first digits, and then of these."""
        sha = lambda x: hashlib.sha256(",".join(sorted(x)).encode()).hexdigest()
        for digits in depth:
            groups = {}
            for p in parts:
                groups.setdefault(p[:digits], []).append(p)
            parts = [f"{g}:{sha(x)}" for g, x in groups.items()]
        return sha(parts)

    rows = spark.range(50_000).select(F.when(F.col("id") % 5 < 4, F.concat(F.lit("g"), F.col("id") % 5)).alias("g"), (F.col("id") % 9_000).alias("k"))
    got = tables.content_digest(rows, ["g"], ["k"])
    assert got.schema["n"].dataType.typeName() == "long"
    want = {}
    for i in range(50_000):
        counts = want.setdefault(f"g{i % 5}" if i % 5 < 4 else None, {})
        h = hashlib.sha256(f"={i % 9000}".encode()).hexdigest()
        counts[h] = counts.get(h, 0) + 1
    assert {r.g: (r.n, r.digest) for r in got.collect()} == {g: (sum(c.values()), tree([f"{h}:{n}" for h, n in c.items()])) for g, c in want.items()}
    # All rows of one group are dealt over many tasks.
    parts = spark.range(20_000).select((F.col("id") % 1).alias("g"), "id")
    plan = tables.content_digest(parts, ["g"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "_branch" in plan and plan.count("Exchange hashpartitioning") == 3


def test_sources(spark, tmp_path):
    (tmp_path / "m.csv").write_bytes("﻿ts_code,symbol,name,exchange,board,currency,list_date,security_type,more\n1.SH,1,n,SSE,MAIN_SH,CNY,20200131,A_SHARE,z\n2.SH,2,n,SSE,MAIN_SH,CNY,20201331,A_SHARE,z\n".encode())
    assert [r.list_date for r in tables.read_master(spark, str(tmp_path / "m.csv")).collect()] == [D(2020, 1, 31), None]
    (tmp_path / "d.json").write_text('["2026-01-02", "2026-01-01", "2026-01-02", "2026-1-3"]')
    assert [r.trade_date for r in tables.read_calendar(spark, str(tmp_path / "d.json")).collect()] == [D(2026, 1, 1), D(2026, 1, 2)]
    good, bad = io.BytesIO(), io.BytesIO()
    zipfile.ZipFile(good, "w").writestr("a/b.xml", "x")
    with zipfile.ZipFile(bad, "w") as z:
        z.writestr("../b.xml", "x")
    zipfile.ZipFile(good, "a").close()
    with zipfile.ZipFile(good, "w") as z:
        z.writestr("a/b.xml", "x")
    files = spark.createDataFrame([("g", bytearray(good.getvalue())), ("u", bytearray(bad.getvalue())), ("n", bytearray(b"no"))], "path string, content binary")
    got = {r.path: (r.member, r.reason) for r in tables.archive_members(files).collect()}
    assert got == {"g": ("a/b.xml", None), "u": (None, "FINANCIAL_ARCHIVE_UNSAFE_PATH"), "n": (None, "FINANCIAL_ARCHIVE_INVALID")}


def test_upsert_and_guard(spark, tmp_path):
    old = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "k int, t int, v string")
    new = spark.createDataFrame([(1, 1, "c"), (2, 4, "d"), (3, 1, "e")], "k int, t int, v string")
    assert sorted((r.k, r.v) for r in tables.last_wins(old, new, "k", "t").collect()) == [(1, "c"), (2, "b"), (3, "e")]
    assert sorted(r.v for r in tables.insert_missing(old, new, "k").collect()) == ["a", "b", "e"]
    bars = spark.createDataFrame([(1, D(2026, 1, 1)), (2, D(2026, 1, 1)), (3, D(2026, 1, 2))], "code int, trade_date date")
    bars.where("code = 1").write.parquet(str(tmp_path / "b"))
    bars.where("code > 1").coalesce(1).write.mode("append").parquet(str(tmp_path / "b"))
    assert [r.trade_date for r in market.single_artifact_guard(spark.read.parquet(str(tmp_path / "b"))).collect()] == [D(2026, 1, 1)]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.orderBy("ts").repartition(3).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream_once(spark, str(tmp_path / "in"), events.schema, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {tuple(r) for r in event_windows(events).collect()}
    # Append mode gives a window when the watermark has passed it, so the last one is still open.
    last = max(w[0] for w in want)
    assert got == {w for w in want if w[0] < last}
