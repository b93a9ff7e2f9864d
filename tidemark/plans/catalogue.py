"""The registered queries over the provided tables, each with its SQL equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import ordering
from tidemark.operators import facts, filings, market, metrics, reports, returns, scoring, screening
from tidemark.plans.registry import AS_OF, DAY, KNOWN_AT, query, table
from tidemark.plans.views import view
from tidemark.sources import labelled_text, tables
from tidemark.streaming.windows import event_windows

_RULE_NAMES = ("assets", "liabilities", "equity", "revenue", "net_profit", "operating_cash_flow")


@query(f"SELECT * FROM bars WHERE trade_date = DATE '{DAY}'", "bars")
def bars_by_date(spark, d):
    return view(spark, d, "bars").where(F.col("trade_date") == F.lit(DAY).cast("date")).orderBy("code")


@query("SELECT trade_date, count(*) AS n FROM bars GROUP BY trade_date", "bars")
def bars_count(spark, d):
    return view(spark, d, "bars").groupBy("trade_date").agg(F.count("*").alias("n"))


@query("""SELECT code, trade_date, CASE WHEN least(open, high, low, close) < 0 THEN 'NEGATIVE_PRICE' ELSE '' END || CASE WHEN high < greatest(open, close, low) THEN 'HIGH_TOO_LOW' ELSE '' END || CASE WHEN low > least(open, close, high) THEN 'LOW_TOO_HIGH' ELSE '' END AS violations
  FROM (SELECT code, trade_date, close, low, volume, amount, high - 20 AS high, open FROM bars WHERE code % 3 = 0 UNION ALL SELECT code, trade_date, close, low, volume, amount, high, open FROM bars WHERE code % 3 <> 0)
  WHERE high < greatest(open, close, low) OR low > least(open, close, high)""", "bars")  # fmt: skip
def bars_constraint_violations(spark, d):
    bars = view(spark, d, "bars").withColumn("high", F.when(F.col("code") % 3 == 0, F.col("high") - 20).otherwise(F.col("high")))
    return market.bar_violations(bars).select("code", "trade_date", F.array_join("violations", "").alias("violations"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return market.duplicate_keys(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT code, industry, venue FROM master WHERE security_type = 'A_SHARE' AND venue IN ('MAIN_SH', 'STAR', 'MAIN_SZ', 'CHINEXT') AND currency = 'CNY'", "master")
def universe_scope(spark, d):
    return market.universe(view(spark, d, "master")).select("code", "industry", "venue")


@query("SELECT code, count(*) AS bars FROM bars WHERE code NOT IN (SELECT code FROM master WHERE security_type = 'A_SHARE' AND venue <> 'BSE' AND currency = 'CNY') GROUP BY code", "bars", "master")
def universe_out_of_scope(spark, d):
    return market.outside_universe(view(spark, d, "bars"), market.universe(view(spark, d, "master"))).groupBy("code").agg(F.count("*").alias("bars"))


@query("SELECT code, n FROM (SELECT code, count(*) AS n FROM (SELECT code FROM master WHERE venue IN ('MAIN_SH', 'STAR') UNION ALL SELECT code FROM master WHERE venue IN ('STAR', 'MAIN_SZ')) GROUP BY code) WHERE n > 1", "master")
def universe_union_duplicates(spark, d):
    m = view(spark, d, "master")
    return market.duplicate_keys(m.where("venue IN ('MAIN_SH', 'STAR')").select("code").unionByName(m.where("venue IN ('STAR', 'MAIN_SZ')").select("code")), "code")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def latest_snapshot_per_source(spark, d):
    return market.latest_per(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"), "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


_FOLD = """list_reduce(list_prepend({'k': '', 't': '', 'r': 0.0::DOUBLE, 'p': 0.0::DOUBLE, 's': 1.0::DOUBLE, 'c': 0.0::DOUBLE, 'x': 0.0::DOUBLE}, coalesce(a.acts, [])), lambda acc, e: {'k': '', 't': '', 'r': 0.0::DOUBLE, 'p': 0.0::DOUBLE,
  's': CASE e.t WHEN 'STOCK' THEN acc.s * (1 + e.r) WHEN 'SPLIT' THEN acc.s * e.r WHEN 'RIGHTS' THEN acc.s + e.r ELSE acc.s END, 'c': acc.c + CASE WHEN e.t = 'CASH' THEN e.r ELSE 0 END, 'x': acc.x + CASE WHEN e.t = 'RIGHTS' THEN e.r * e.p ELSE 0 END})"""


_INDEX = f"""+per AS (SELECT code, ex_date, list({{'k': record_id, 't': action_type, 'r': ratio::DOUBLE, 'p': price::DOUBLE, 's': 1.0::DOUBLE, 'c': 0.0::DOUBLE, 'x': 0.0::DOUBLE}} ORDER BY record_id) AS acts FROM actions WHERE action_status <> 'CANCELLED' GROUP BY code, ex_date),
folded AS (SELECT b.code, b.trade_date, b.close, len(coalesce(a.acts, [])) AS n, {_FOLD} AS f FROM bars b LEFT JOIN per a ON a.code = b.code AND a.ex_date = b.trade_date),
steps AS (SELECT *, lag(close) OVER (PARTITION BY code ORDER BY trade_date) AS before FROM folded)
SELECT code, trade_date, CASE WHEN before IS NULL THEN 0 ELSE n END::BIGINT AS actions_used, round(product(CASE WHEN before IS NULL THEN 1 ELSE (close * f.s + f.c - f.x) / before END) OVER (PARTITION BY code ORDER BY trade_date), 6) AS index FROM steps"""  # fmt: skip


@query(_INDEX, "bars", "actions")
def total_return_index(spark, d):
    return returns.total_return(view(spark, d, "bars"), view(spark, d, "actions")).withColumn("index", F.round("index", 6))


@query(_INDEX, "bars", "actions")
def total_return_exact(spark, d):
    """The same in decimal arithmetic; six places of it are those of the floating product."""
    return returns.exact_total_return(view(spark, d, "bars"), view(spark, d, "actions"), places=6).withColumn("index", F.col("index").cast("double"))


@query(f"""+late AS (SELECT code, trade_date, CASE WHEN trade_date > DATE '{AS_OF}' THEN 'MARKET_BAR_AFTER_CUTOFF' WHEN trade_date + (code % 90)::INT > DATE '{KNOWN_AT}' THEN 'MARKET_BAR_NOT_KNOWN_AT_CUTOFF' WHEN code % 31 = 0 THEN 'MARKET_BAR_QUALITY_BLOCKED' END AS reason FROM bars)
SELECT code, min_by(reason, trade_date) AS reason FROM late WHERE reason IS NOT NULL GROUP BY code""", "bars")  # fmt: skip
def total_return_blocked(spark, d):
    bars = view(spark, d, "bars").withColumns({"valid_from": F.date_add("trade_date", (F.col("code") % 90).cast("int")), "quality_status": F.when(F.col("code") % 31 == 0, "REJECTED").otherwise("VALID")})
    return returns.blocked_series(bars, AS_OF, KNOWN_AT)


_CHAIN = f"""/*RECURSE*/+seen AS (SELECT * FROM filings WHERE published_at <= DATE '{AS_OF}' AND valid_from <= DATE '{KNOWN_AT}'),
walk AS (SELECT entity, filing_id, 1 AS depth FROM seen WHERE supersedes_id IS NULL UNION ALL SELECT s.entity, s.filing_id, w.depth + 1 FROM seen s JOIN walk w ON s.supersedes_id = w.filing_id AND s.entity = w.entity),
reached AS (SELECT entity, count(*) AS n, max(depth) AS depth, max_by(filing_id, depth) AS leaf FROM walk GROUP BY entity),
total AS (SELECT entity, count(*) AS n, count(*) FILTER (supersedes_id IS NULL) AS roots FROM seen GROUP BY entity),
picked AS (SELECT t.entity, t.roots = 1 AND t.n = coalesce(r.n, 0) AND t.n = coalesce(r.depth, 0) AS good, s.filing_id, s.supersedes_id, s.quality_status IN ('CONFLICT', 'REJECTED', 'UNVERIFIED') AS unusable FROM total t LEFT JOIN reached r ON t.entity = r.entity LEFT JOIN seen s ON s.filing_id = r.leaf)
"""


@query(_CHAIN + """SELECT entity, CASE WHEN good AND NOT unusable THEN filing_id END AS selected, CASE WHEN NOT good OR (unusable AND supersedes_id IS NOT NULL) THEN 'FINANCIAL_RESTATEMENT_UNUSABLE' END AS blocked_reason FROM picked""", "filings")
def asof_filing_selection(spark, d):
    return filings.select_versions(view(spark, d, "filings"), AS_OF, KNOWN_AT)


@query(_CHAIN + "SELECT entity, f.filing_id, fact_id, name, value FROM picked p JOIN facts f ON f.filing_id = p.filing_id WHERE good AND NOT unusable AND f.quality_status = 'VALID'", "filings", "facts")
def asof_facts(spark, d):
    return filings.facts_as_of(view(spark, d, "facts"), view(spark, d, "filings"), AS_OF, KNOWN_AT).select("entity", "filing_id", "fact_id", "name", "value")


@query(_CHAIN + "SELECT CASE WHEN NOT good OR (unusable AND supersedes_id IS NOT NULL) THEN 'FINANCIAL_RESTATEMENT_UNUSABLE' END AS blocked_reason, count(*) AS n FROM picked GROUP BY 1", "filings")
def asof_blocked_reasons(spark, d):
    return filings.select_versions(view(spark, d, "filings"), AS_OF, KNOWN_AT).groupBy("blocked_reason").agg(F.count("*").alias("n"))


@query("""/*RECURSE*/+walk AS (SELECT filing_id, filing_id AS root_id, 0 AS depth FROM filings WHERE supersedes_id IS NULL UNION ALL SELECT f.filing_id, w.root_id, w.depth + 1 FROM filings f JOIN walk w ON f.supersedes_id = w.filing_id)
SELECT filing_id, root_id, depth::BIGINT AS depth FROM walk""", "filings")
def version_chain_depths(spark, d):
    return filings.chain_depths(view(spark, d, "filings"))


@query("SELECT a.filing_id, max_by(b.filing_id, struct_pack(x := b.published_at, y := b.filing_id)) AS predecessor FROM filings a LEFT JOIN filings b ON a.entity = b.entity AND b.published_at < a.published_at GROUP BY a.filing_id", "filings")
def filing_predecessor(spark, d):
    return filings.predecessors(view(spark, d, "filings"))


@query("""SELECT fact_id, coalesce(m.mapped, 'UNMAPPED') AS mapped, CASE raw_name % 4 WHEN 0 THEN 'NONE' WHEN 1 THEN 'MONETARY' WHEN 2 THEN 'PER_SHARE' ELSE 'SHARES' END AS kind
  FROM facts LEFT JOIN (VALUES (1, 'assets'), (2, 'liabilities'), (3, 'equity'), (4, 'revenue'), (5, 'net_profit')) m(raw, mapped) ON raw_name = m.raw""", "facts")  # fmt: skip
def fact_mapping(spark, d):
    registry = spark.createDataFrame(list(enumerate(_RULE_NAMES[:5], 1)), "raw_name int, mapped string")
    rows = view(spark, d, "facts").join(F.broadcast(registry), "raw_name", "left")
    kind = F.col("raw_name") % 4
    none = F.array().cast("array<string>")
    over = F.when(kind == 0, none).when(kind == 3, F.array(F.lit("xbrli:shares"))).otherwise(F.array(F.lit("iso4217:CNY")))
    under = F.when(kind == 2, F.array(F.lit("xbrli:shares"))).otherwise(none)
    currency = F.when(kind.isin(1, 2), "CNY")
    return rows.select("fact_id", F.coalesce("mapped", F.lit("UNMAPPED")).alias("mapped"), facts.unit_kind(over, under, currency).alias("kind"))


@query("SELECT fact_id, sha256(concat_ws('|', '=' || filing_id, '=' || raw_name, coalesce('=' || name, '~'), '=' || decimals)) AS identity FROM facts", "facts")
def fact_identity_hash(spark, d):
    return view(spark, d, "facts").select("fact_id", facts.identity_hash(F.col("filing_id"), F.col("raw_name"), F.col("name"), F.col("decimals")).alias("identity"))


@query("""SELECT f.fact_id, o.m AS supersedes_fact FROM facts f JOIN filings g ON f.filing_id = g.filing_id LEFT JOIN (SELECT filing_id, raw_name, max(fact_id) AS m FROM facts GROUP BY ALL) o ON o.filing_id = g.supersedes_id AND o.raw_name = f.raw_name""", "facts", "filings")
def correction_links(spark, d):
    return facts.correction_links(view(spark, d, "facts"), view(spark, d, "filings"))


@query("""SELECT filing_id, raw_name, count(*) AS n, min(fact_id) AS kept, string_agg(fact_id, ',' ORDER BY fact_id) AS fact_ids, CASE WHEN count(*) = 1 THEN 'UNIQUE' WHEN count(DISTINCT value) = 1 THEN 'FINANCIAL_FACT_DUPLICATE' ELSE 'FINANCIAL_FACT_CONFLICT' END AS status FROM facts GROUP BY filing_id, raw_name""", "facts")
def fact_duplicates(spark, d):
    return facts.identity_groups(view(spark, d, "facts"), "filing_id", "raw_name").drop("values")


@query("""SELECT filing_id, grp, count(DISTINCT raw_name) AS raw_names, CASE WHEN count(DISTINCT value) = 1 THEN 'FINANCIAL_FACT_ALIAS_DUPLICATE' ELSE 'CANONICAL_VALUE_MISMATCH' END AS status FROM (SELECT *, raw_name % 3 AS grp FROM facts) GROUP BY filing_id, grp HAVING count(DISTINCT raw_name) > 1""", "facts")
def fact_alias_conflicts(spark, d):
    return facts.alias_conflicts(view(spark, d, "facts").withColumn("grp", F.col("raw_name") % 3), "filing_id", "grp").drop("values")


_BALANCE = """b AS (SELECT filing_id, count(*) FILTER (name = 'assets') AS na, count(*) FILTER (name = 'liabilities') AS nl, count(*) FILTER (name = 'equity') AS ne,
  round(abs(max(value) FILTER (name = 'assets') - max(value) FILTER (name = 'liabilities') - max(value) FILTER (name = 'equity')), 4) AS gap, round(sum(0.5 * pow(10.0, -decimals)), 6) AS allowed FROM {} WHERE name IN ('assets', 'liabilities', 'equity') GROUP BY filing_id),
balanced AS (SELECT filing_id, gap, allowed, CASE WHEN least(na, nl, ne) = 0 THEN 'FINANCIAL_BALANCE_COMPONENT_MISSING' WHEN greatest(na, nl, ne) > 1 THEN 'SKIPPED' WHEN gap > allowed THEN 'FINANCIAL_BALANCE_EQUATION_CONFLICT' ELSE 'BALANCED' END AS status FROM b)
"""


@query("+" + _BALANCE.format("facts") + "SELECT * FROM balanced", "facts")
def balance_equation(spark, d):
    return facts.balance(view(spark, d, "facts"), "filing_id")


@query("+g AS (SELECT filing_id, raw_name, min(fact_id) AS kept, count(DISTINCT value) > 1 AS clash FROM facts GROUP BY ALL), k AS (SELECT f.* FROM facts f JOIN g ON f.fact_id = g.kept WHERE NOT clash),"
       + _BALANCE.format("k") + """, c AS (SELECT filing_id, bool_or(clash) AS clash FROM g GROUP BY ALL), u AS (SELECT filing_id, bool_or(name IS NULL) AS unmapped FROM facts GROUP BY ALL)
SELECT c.filing_id, CASE WHEN clash OR coalesce(status, '') = 'FINANCIAL_BALANCE_EQUATION_CONFLICT' THEN 'CONFLICT' WHEN unmapped OR coalesce(status, '') = 'FINANCIAL_BALANCE_COMPONENT_MISSING' THEN 'PARTIAL' ELSE 'VALID' END AS quality_status
FROM c JOIN u ON c.filing_id = u.filing_id LEFT JOIN balanced ON balanced.filing_id = c.filing_id""", "facts")  # fmt: skip
def filing_quality_status(spark, d):
    return facts.filing_status(view(spark, d, "facts"))


def _metric_rows(spark, d):
    rows = view(spark, d, "facts").join(view(spark, d, "filings").select("filing_id", "entity"), "filing_id")
    wide = rows.groupBy("entity").agg(*[F.round(F.sum(F.when(F.col("name") == n, F.col("value"))), 2).alias(n) for n in _RULE_NAMES], F.round(F.sum(F.when(F.col("decimals") == 0, F.col("value"))), 2).alias("prior_revenue"))
    n = F.col("entity") % 5
    net = F.when(n == 0, -F.col("net_profit")).otherwise(F.col("net_profit"))
    return wide.withColumns({"net_profit": net, "beginning_equity": F.when(n == 1, F.col("equity") - 100), "capital_expenditure": F.when(n != 2, F.col("revenue") / 10), "nopat": F.col("net_profit"), "invested_capital": F.when(n == 3, 0.0).otherwise(F.col("assets")), "market_cap": F.when(n != 4, F.col("assets") * 2)})


_METRICS = """+w0 AS (SELECT entity, """ + ", ".join(f"round(sum(value) FILTER (name = '{n}'), 2) AS {n}" for n in _RULE_NAMES) + """, round(sum(value) FILTER (decimals = 0), 2) AS prior_revenue FROM facts JOIN filings ON facts.filing_id = filings.filing_id GROUP BY entity),
w AS (SELECT entity, assets, liabilities, equity, revenue, operating_cash_flow, prior_revenue, CASE WHEN entity % 5 = 0 THEN -net_profit ELSE net_profit END AS net_profit, CASE WHEN entity % 5 = 1 THEN equity - 100 END AS beginning_equity, CASE WHEN entity % 5 <> 2 THEN revenue / 10 END AS capital_expenditure,
  net_profit AS nopat, CASE WHEN entity % 5 = 3 THEN 0.0 ELSE assets END AS invested_capital, CASE WHEN entity % 5 <> 4 THEN assets * 2 END AS market_cap FROM w0),
"""


def _metric_sql() -> str:
    def frac(a: str, b: str, less: str = "") -> tuple[str, str]:
        return f"{a} / nullif({b}, 0){less}", f"CASE WHEN {a} IS NULL THEN 'INPUT_MISSING' WHEN {b} IS NULL OR {b} = 0 THEN 'DENOMINATOR_MISSING_OR_ZERO' END"

    base = "(CASE WHEN beginning_equity IS NOT NULL THEN (beginning_equity + equity) / 2 ELSE equity END)"
    fcf = "(operating_cash_flow - capital_expenditure)"
    poor = "CASE WHEN net_profit IS NULL THEN 'INPUT_MISSING' WHEN net_profit <= 0 THEN 'NON_POSITIVE_EARNINGS' WHEN market_cap IS NULL THEN 'INPUT_MISSING' END"
    found = {
        "roe": (f"net_profit / nullif({base}, 0)", f"CASE WHEN net_profit IS NULL OR equity IS NULL THEN 'INPUT_MISSING' WHEN {base} = 0 THEN 'DENOMINATOR_MISSING_OR_ZERO' END"),
        "roic": frac("nopat", "invested_capital"), "revenue_growth": frac("revenue", "prior_revenue", " - 1"), "cash_flow_quality": frac("operating_cash_flow", "net_profit"), "debt_ratio": frac("liabilities", "assets"),
        "free_cash_flow": (fcf, f"CASE WHEN {fcf} IS NULL THEN 'INPUT_MISSING' END"), "pe": (f"CASE WHEN ({poor}) IS NULL THEN market_cap / net_profit END", poor), "pb": frac("market_cap", "equity"), "fcf_yield": frac(fcf, "market_cap"),
    }
    return _METRICS + "m AS (" + " UNION ALL ".join(f"SELECT entity, '{n}' AS metric, round({v}, 6) AS value, {r} AS reason FROM w" for n, (v, r) in found.items()) + ")\n"


@query(_metric_sql() + "SELECT entity, metric, CASE WHEN reason IS NULL THEN value END AS value, reason FROM m", "facts", "filings")
def metrics_ratio_set(spark, d):
    return metrics.metrics(_metric_rows(spark, d), "entity")


@query(_metric_sql() + "SELECT metric, reason, count(*) AS n FROM m WHERE reason IS NOT NULL GROUP BY metric, reason", "facts", "filings")
def metrics_missing_reasons(spark, d):
    return metrics.metrics(_metric_rows(spark, d), "entity").where("reason IS NOT NULL").groupBy("metric", "reason").agg(F.count("*").alias("n"))


@query(f"""+g AS (SELECT entity, fact_id, CASE WHEN published_at > DATE '{AS_OF}' THEN 'FINANCIAL_INPUT_AFTER_CUTOFF' WHEN valid_from > DATE '{KNOWN_AT}' THEN 'FINANCIAL_INPUT_NOT_KNOWN_AT_CUTOFF' WHEN f.quality_status = 'CONFLICT' THEN 'FINANCIAL_INPUT_QUALITY_BLOCKED' END AS r FROM facts f JOIN filings g ON f.filing_id = g.filing_id)
SELECT entity, min_by(r, fact_id) FILTER (r IS NOT NULL) AS reason FROM g GROUP BY entity""", "facts", "filings")  # fmt: skip
def metrics_blocked(spark, d):
    rows = view(spark, d, "facts").join(view(spark, d, "filings").select("filing_id", "entity", "published_at", "valid_from"), "filing_id")
    return metrics.input_gate(rows, "entity", AS_OF, KNOWN_AT, unique=False)


@query("SELECT code, trade_date, count(*) OVER w AS amount_days, round(avg(amount) OVER w, 6) AS amount_mean FROM bars WINDOW w AS (PARTITION BY code ORDER BY trade_date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)", "bars")
def liquidity_window(spark, d):
    return screening.liquidity(view(spark, d, "bars"), 10).withColumn("amount_mean", F.round("amount_mean", 6))


_LIMITS = screening.HardFilters(listing_days=365, liquidity_days=10, average_amount=20_000, completeness=0.85, age_days=550)


def _screened(spark, d):
    last = view(spark, d, "bars").groupBy("code").agg(F.max("trade_date").alias("trade_date"), F.count("*").alias("amount_days"), F.round(F.avg("amount"), 2).alias("amount_mean"))
    c = F.col("code")
    flags = {
        "in_scope": market.in_scope(F.col("security_type"), F.col("venue"), F.col("currency")), "delisting_risk": c % 37 == 0, "st_status": F.when(c % 41 == 0, "ST"), "report_date": F.lit("1998-10-01").cast("date"),
        "is_suspended": c % 43 == 0, "is_trading": c % 47 != 0, "list_date": F.date_sub(F.lit("1998-10-01").cast("date"), (F.col("p_size") * 30).cast("int")), "audit_standard": c % 53 != 0, "investigation_open": c % 59 == 0,
        "completeness": F.col("p_size") / 50.0, "return_quality": F.when(c % 61 == 0, "VALID").otherwise("DERIVED"), "publication_known": c % 67 != 0, "age_days": (c % 600).cast("int")}
    rows = view(spark, d, "master").join(last, "code").withColumns(flags).withColumn("trade_date", F.when(c % 71 == 0, F.col("trade_date")).otherwise(F.col("report_date")))
    return screening.hard_filter_reasons(rows, _LIMITS).select("code", "reasons")


_SCREEN = """+last AS (SELECT code, max(trade_date) AS trade_date, count(*) AS days, round(avg(amount), 2) AS mean FROM bars GROUP BY code),
hf AS (SELECT m.code, concat_ws(',', CASE WHEN NOT (security_type = 'A_SHARE' AND venue <> 'BSE' AND currency = 'CNY') THEN 'HF-01' END, CASE WHEN m.code % 37 = 0 THEN 'HF-02' END, CASE WHEN m.code % 41 = 0 THEN 'HF-03' END,
  CASE WHEN (m.code % 71 = 0 AND trade_date <> DATE '1998-10-01') OR m.code % 43 = 0 OR m.code % 47 = 0 THEN 'HF-04' END, CASE WHEN p_size * 30 < 365 THEN 'HF-05' END, CASE WHEN days < 10 OR mean < 20000 THEN 'HF-06' END, CASE WHEN m.code % 53 = 0 THEN 'HF-07' END,
  CASE WHEN m.code % 59 = 0 THEN 'HF-08' END, CASE WHEN p_size / 50.0::DOUBLE < 0.85 THEN 'HF-09' END, CASE WHEN m.code % 61 = 0 THEN 'HF-10' END, CASE WHEN m.code % 67 = 0 THEN 'HF-11' END, CASE WHEN m.code % 600 > 550 THEN 'HF-12' END) AS reasons FROM master m JOIN last ON m.code = last.code)
"""


@query(_SCREEN + "SELECT code, reasons FROM hf", "bars", "master")
def hard_filter_reasons(spark, d):
    return _screened(spark, d).withColumn("reasons", F.array_join("reasons", ","))


@query(_SCREEN + "SELECT unnest(string_split(reasons, ',')) AS reason, count(*) AS n FROM hf WHERE reasons <> '' GROUP BY 1 UNION ALL SELECT 'PASSED', count(*) FROM hf WHERE reasons = ''", "bars", "master")
def hard_filter_pass_count(spark, d):
    rows = _screened(spark, d)
    each = rows.select(F.explode(F.when(F.size("reasons") == 0, F.array(F.lit("PASSED"))).otherwise(F.col("reasons"))).alias("reason"))
    return each.groupBy("reason").agg(F.count("*").alias("n"))


def _factor_values(spark, d, strategy):
    """Long factor values of the securities that aren't excluded; the six numbers stand for the strategy's factors in order."""
    wide = view(spark, d, "factors").join(view(spark, d, "master").where("code % 13 <> 0").select("code", "industry"), "code")
    each = F.array(*[F.struct(F.lit(f).alias("factor"), F.round(F.col(f"f{i}").cast("double"), 9).alias("value")) for i, (f, _, _) in enumerate(scoring.STRATEGIES[strategy], 1)])
    return wide.select("code", "industry", F.explode(each).alias("x")).select("code", "industry", "x.*")


def _score_sql(strategy: str) -> str:
    spec = scoring.STRATEGIES[strategy]
    long = " UNION ALL ".join(f"SELECT f.code, industry, '{f}' AS factor, {w}::DOUBLE AS weight, {c} AS critical, round(f{i}::DOUBLE, 9) AS value FROM factors f JOIN master m ON f.code = m.code WHERE f.code % 13 <> 0" for i, (f, w, c) in enumerate(spec, 1))
    need = sum(c for _, _, c in spec)
    rank = "round(CASE WHEN n <= 1 THEN 50 ELSE (below + (equal - 1) / 2.0) / (n - 1) * 100 END::DOUBLE, 9)"
    return f"""+long AS MATERIALIZED ({long}), fit AS (SELECT code FROM long WHERE critical AND value IS NOT NULL GROUP BY code HAVING count(*) = {need}),
pool AS (SELECT * FROM long WHERE value IS NOT NULL AND code IN (SELECT code FROM fit)),
mb AS (SELECT factor, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM pool GROUP BY factor),
ib AS (SELECT factor, industry, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM pool WHERE industry IS NOT NULL GROUP BY factor, industry),
mc AS (SELECT p.*, least(greatest(value, lo), hi) AS v FROM pool p JOIN mb ON p.factor = mb.factor), ic AS (SELECT p.code, p.factor, p.industry, least(greatest(value, lo), hi) AS v FROM pool p JOIN ib ON p.factor = ib.factor AND p.industry = ib.industry),
mr AS (SELECT *, {rank} AS market FROM (SELECT *, rank() OVER (PARTITION BY factor ORDER BY v) - 1 AS below, count(*) OVER (PARTITION BY factor, v) AS equal, count(*) OVER (PARTITION BY factor) AS n FROM mc)),
ir AS (SELECT code, factor, n AS peers, {rank} AS own FROM (SELECT *, rank() OVER (PARTITION BY factor, industry ORDER BY v) - 1 AS below, count(*) OVER (PARTITION BY factor, industry, v) AS equal, count(*) OVER (PARTITION BY factor, industry) AS n FROM ic)),
s AS (SELECT mr.code, mr.industry, mr.factor, mr.weight, CASE WHEN mr.industry IS NULL AND mr.n >= 20 THEN 'industry:UNKNOWN' WHEN coalesce(peers, 0) >= 20 THEN 'industry:' || mr.industry ELSE 'market' END AS scope,
  NOT (mr.industry IS NULL AND mr.n >= 20) AND coalesce(peers, 0) < 20 AS fallback, CASE WHEN coalesce(peers, 0) >= 20 THEN own ELSE market END AS percentile FROM mr LEFT JOIN ir ON mr.code = ir.code AND mr.factor = ir.factor)
"""


def _rank_sql(strategy: str) -> str:
    return _score_sql(strategy) + f""", per AS (SELECT code, round(sum(weight * percentile), 6) AS s, round(sum(weight), 2) AS completeness, bool_or(factor = 'cycle_position') AS cycle FROM s GROUP BY code)
SELECT row_number() OVER (ORDER BY s DESC, code) AS rank, code, s AS score, completeness, CASE WHEN s >= 60 AND ({str(strategy != 'deep-value-v1').lower()} OR cycle) THEN 'CANDIDATE' ELSE 'WATCH' END AS status FROM per ORDER BY s DESC, code LIMIT 30"""


def _pool(spark, d, strategy):
    return scoring.ranked_pool(_factor_values(spark, d, strategy), strategy).select("rank", "code", F.round("exact_score", 6).alias("score"), "completeness", "status")


@query(_score_sql("quality-growth-v1") + "SELECT code, factor, scope, fallback, round(percentile, 6) AS percentile FROM s", "factors", "master")
def factor_percentiles(spark, d):
    values = _factor_values(spark, d, "quality-growth-v1").where("value IS NOT NULL")
    fit = scoring.sufficient(values, "quality-growth-v1")
    return scoring.factor_scores(values.join(fit, "code", "left_semi")).select("code", "factor", "scope", "fallback", F.round("percentile", 6).alias("percentile"))


@query(_score_sql("deep-value-v1") + "SELECT factor, scope = 'market' AS market, fallback, count(*) AS n FROM s GROUP BY ALL", "factors", "master")
def factor_scope_fallback(spark, d):
    values = _factor_values(spark, d, "deep-value-v1").where("value IS NOT NULL")
    rows = scoring.factor_scores(values.join(scoring.sufficient(values, "deep-value-v1"), "code", "left_semi"))
    return rows.groupBy("factor", (F.col("scope") == "market").alias("market"), "fallback").agg(F.count("*").alias("n"))


@query("SELECT industry, round(quantile_cont(f3, 0.01), 6) AS low, round(quantile_cont(f3, 0.99), 6) AS high FROM factors f JOIN master m ON f.code = m.code WHERE f3 IS NOT NULL GROUP BY industry", "factors", "master")
def factor_winsor_bounds(spark, d):
    rows = view(spark, d, "factors").where("f3 IS NOT NULL").join(view(spark, d, "master").select("code", "industry"), "code")
    counts = ordering.ordered_counts(rows, ["industry"], "f3")
    return counts.groupBy("industry").agg(F.round(ordering.quantile("f3", 0.01), 6).alias("low"), F.round(ordering.quantile("f3", 0.99), 6).alias("high"))


@query(_rank_sql("quality-growth-v1"), "factors", "master")
def rank_quality_growth(spark, d):
    return _pool(spark, d, "quality-growth-v1")


@query(_rank_sql("deep-value-v1"), "factors", "master")
def rank_deep_value(spark, d):
    return _pool(spark, d, "deep-value-v1")


@query(_rank_sql("stable-dividend-v1"), "factors", "master")
def rank_stable_dividend(spark, d):
    return _pool(spark, d, "stable-dividend-v1")


@query(_score_sql("deep-value-v1") + ", a AS (SELECT count(*) AS i, count(*) FILTER (f.code % 13 = 0) AS e FROM factors f JOIN master m ON f.code = m.code), q AS (SELECT count(*) AS q FROM fit) SELECT 'deep-value-v1' AS strategy, i AS input, e AS excluded, i - e - q AS insufficient, q AS qualified, least(q, 30) AS published FROM a, q", "factors", "master")
def strategy_evidence(spark, d):
    both = view(spark, d, "factors").select("code").join(view(spark, d, "master").select("code"), "code")
    return scoring.evidence(both, both.where("code % 13 = 0"), _factor_values(spark, d, "deep-value-v1"), "deep-value-v1")


def _details(spark, d):
    o = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("candidate")).agg(F.collect_set("l_suppkey").alias("source_record_ids"))
    day = F.date_add(F.lit("1996-01-01").cast("date"), (F.col("candidate") % 300).cast("int"))
    return o.withColumns({"as_of": day, "known_at": F.date_add(day, 20)})


def _sources(spark, d):
    day = F.date_add(F.lit("1996-01-01").cast("date"), (F.col("s_suppkey") % 290).cast("int"))
    return table(spark, d, "supplier").where("s_suppkey % 19 <> 0").select(F.col("s_suppkey").alias("record_id"), day.alias("published_at"), F.date_add(day, (F.col("s_suppkey") % 30).cast("int")).alias("valid_from"))


@query("SELECT DISTINCT l_suppkey AS record_id FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 19 <> 0)")
def lineage_unresolved(spark, d):
    return reports.unresolved_sources(_details(spark, d), _sources(spark, d))


@query("""WITH u AS (SELECT DISTINCT l_partkey AS candidate, l_suppkey AS record_id, DATE '1996-01-01' + (l_partkey % 300)::INT AS as_of FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier) AND l_suppkey % 19 <> 0),
r AS (SELECT candidate, record_id, CASE WHEN DATE '1996-01-01' + (record_id % 290)::INT > as_of THEN 'REPORT_SOURCE_AFTER_CANDIDATE_CUTOFF' WHEN DATE '1996-01-01' + (record_id % 290 + record_id % 30)::INT > as_of + 20 THEN 'REPORT_SOURCE_NOT_KNOWN_TO_CANDIDATE' END AS reason FROM u)
SELECT * FROM r WHERE reason IS NOT NULL""")
def lineage_cutoff_violations(spark, d):
    return reports.cutoff_violations(_details(spark, d), _sources(spark, d))


@query("SELECT o_orderdate::DATE AS report_date, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS blocked FROM orders WHERE o_orderstatus = 'P' GROUP BY 1")
def domain_gate(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("report_date"), F.col("o_orderpriority").alias("domain"), F.when(F.col("o_orderstatus") == "P", "PARTIAL").otherwise("VALID").alias("status"))
    return reports.blocked_domains(rows)


@query("SELECT event_id, CASE WHEN ts > (SELECT min(ts) + INTERVAL 20 DAY FROM events) THEN 'REPORT_EVENT_CUTOFF_VIOLATION' ELSE 'REPORT_EVENT_QUALITY_BLOCKED' END AS reason FROM events WHERE ts > (SELECT min(ts) + INTERVAL 20 DAY FROM events) OR value < 10")
def event_gate(spark, d):
    events = table(spark, d, "events")
    cut = events.agg((F.min("ts") + F.expr("INTERVAL 20 DAYS")).alias("cut"))
    rows = events.select("event_id", F.col("ts").alias("published_at"), F.when(F.col("value") < 10, "UNVERIFIED").otherwise("VALID").alias("quality_status"))
    return reports.event_gate(rows.crossJoin(F.broadcast(cut)), F.col("cut"))


@query("SELECT l_partkey AS code, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS strategies, count(DISTINCT l_returnflag) AS n FROM lineitem GROUP BY l_partkey")
def security_memberships(spark, d):
    return reports.memberships(table(spark, d, "lineitem").select(F.col("l_partkey").alias("code"), F.col("l_returnflag").alias("strategy")).distinct())


@query("""WITH r AS (SELECT page_id, url, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) AS scheme, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)) AS host FROM pages)
SELECT page_id, CASE WHEN page_id % 5 = 4 THEN 'SOURCE_POLICY_MISSING' WHEN page_id % 5 = 3 THEN 'SOURCE_REVIEW_REQUIRED' WHEN page_id % 5 = 2 THEN 'SOURCE_DISABLED' WHEN scheme = 'http' THEN 'HTTP_ENDPOINT_NOT_ALLOWED' WHEN host NOT LIKE '%.example.com' THEN 'DOMAIN_NOT_ALLOWED' WHEN page_id % 7 = 0 THEN 'PURPOSE_NOT_ALLOWED' ELSE 'ALLOWED' END AS decision FROM r""")
def policy_decision(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url", F.concat(F.lit("s"), F.col("page_id") % 5).alias("source_id"), F.when(F.col("page_id") % 7 == 0, "TRAIN").otherwise("RESEARCH").alias("purpose"))
    hosts = pages.select("source_id", F.lower(F.try_parse_url("url", F.lit("HOST"))).alias("host")).where("host LIKE '%.example.com'").distinct()
    rows = [("s0", True, True), ("s1", True, True), ("s2", True, False), ("s3", False, True)]
    policies = spark.createDataFrame([(*r, ["https"], ["RESEARCH"], []) for r in rows], "source_id string, approved boolean, enabled boolean, schemes array<string>, purposes array<string>, http_hosts array<string>")
    return reports.policy_decision(pages, policies, hosts).select("page_id", "decision")


@query("WITH n AS (SELECT event_type AS source_id, event_id AS call_id, epoch(ts) AS asked, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events) SELECT source_id, call_id, round(max(asked - 10.0 * n) OVER (PARTITION BY source_id ORDER BY n) + 10.0 * n, 3) AS slot FROM n")
def rate_slots(spark, d):
    calls = table(spark, d, "events").select(F.col("event_type").alias("source_id"), F.col("event_id").alias("call_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("asked"))
    return reports.rate_slots(calls, 6).withColumn("slot", F.round("slot", 3))


@query("SELECT sha256(coalesce(text, '')) AS content_hash, min(doc_id) AS first, count(*) AS copies FROM documents GROUP BY 1")
def raw_dedupe(spark, d):
    return tables.dedupe_objects(table(spark, d, "documents"), "text", "doc_id")


@query(tables.digest_sql("orders", "o_orderpriority", "sha256(concat_ws('|', '=' || o_orderkey, '=' || o_custkey, '=' || o_orderstatus))"))
def content_digest(spark, d):
    return tables.content_digest(table(spark, d, "orders"), ["o_orderpriority"], ["o_orderkey", "o_custkey", "o_orderstatus"])


def _label_text(spark, d):
    c, n = F.col("o_orderkey"), F.round("o_totalprice").cast("long")
    amount = F.when(c % 4 == 0, F.concat(F.lit("("), n.cast("string"), F.lit(")"))).otherwise(F.format_number(n * 1000, 0))
    unit = F.when(c % 3 == 0, "万元").when(c % 3 == 1, "元").otherwise("箱")
    text = F.concat(F.lit("报告期："), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("\n货币单位："), unit, F.lit("\n资产总计｜"), F.format_number(n * 1000, 0), F.lit("\n负债合计 | "), F.format_number((n - 5) * 1000, 0), F.lit("\n股东权益合计 | "), F.when(c % 5 == 0, "5,000").otherwise("9,000"), F.lit("\n营业收入 | 77\n净利润 | "), amount, F.when(c % 2 == 0, F.lit("\n经营活动产生的现金流量净额 | -12.5")).otherwise(F.lit("")))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), text.alias("text"))


_LABELLED = """WITH o AS (SELECT o_orderkey AS key, round(o_totalprice)::BIGINT AS n, o_orderdate::DATE AS p, CASE o_orderkey % 3 WHEN 0 THEN 10000.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE END AS m FROM orders),
x AS (SELECT key, p AS report_period, m AS multiplier, n * 1000 * coalesce(m, 1) AS total_assets, (n - 5) * 1000 * coalesce(m, 1) AS total_liabilities, CASE WHEN key % 5 = 0 THEN 5000 ELSE 9000 END * coalesce(m, 1) AS equity,
  CASE WHEN key % 4 = 0 THEN -n ELSE n * 1000 END * coalesce(m, 1) AS net_profit, CASE WHEN key % 2 = 0 THEN -12.5 * coalesce(m, 1) END AS operating_cash_flow FROM o)
"""


@query(_LABELLED + "SELECT key, report_period, multiplier, total_assets, total_liabilities, equity, net_profit, operating_cash_flow FROM x")
def text_label_extract(spark, d):
    return labelled_text.extract_facts(_label_text(spark, d)).select("key", "report_period", "multiplier", "total_assets", "total_liabilities", "equity", "net_profit", "operating_cash_flow")


_ISSUES = _LABELLED + """, i AS (SELECT key, concat_ws(',', CASE WHEN multiplier IS NULL THEN 'PDF_CURRENCY_MISSING,PDF_UNIT_MULTIPLIER_MISSING' END, CASE WHEN operating_cash_flow IS NULL THEN 'PDF_REQUIRED_FACTS_MISSING' END, CASE WHEN abs(total_assets - total_liabilities - equity) > greatest(abs(total_assets) * 0.001::DOUBLE, 1) THEN 'PDF_BALANCE_EQUATION_FAILED' END) AS issues FROM x)
"""


@query(_ISSUES + "SELECT key, issues FROM i")
def text_validation_issues(spark, d):
    return labelled_text.extraction_issues(labelled_text.extract_facts(_label_text(spark, d))).select("key", F.array_join("issues", ",").alias("issues"))


@query(_ISSUES + """, s AS (SELECT key, issues = '' AS good, o_orderstatus AS st FROM i JOIN orders ON key = o_orderkey)
SELECT key, CASE WHEN st = 'F' THEN 'XBRL' WHEN good THEN 'PDF' END AS chosen, CASE WHEN st = 'F' THEN CASE WHEN key % 2 = 0 THEN 'XBRL_PDF_FACT_CONFLICT' END WHEN NOT good THEN 'CNINFO_PDF_UNVERIFIED' END AS reason FROM s""")
def source_preference(spark, d):
    text = labelled_text.extraction_issues(labelled_text.extract_facts(_label_text(spark, d))).select("key", F.when(F.size("issues") == 0, "VALID").otherwise("UNVERIFIED").alias("text_status"))
    tagged = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderstatus") == "F", "VALID").otherwise("PARTIAL").alias("tagged_status"))
    return labelled_text.prefer_source(text.join(tagged, "key").withColumn("clash", F.col("key") % 2 == 0))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY ALL")
def events_stream_windows(spark, d):
    return event_windows(table(spark, d, "events"))
