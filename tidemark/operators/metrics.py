"""Financial metrics with reasons for what is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.reasons import first_reason, ratio

INPUTS = ("assets", "liabilities", "equity", "beginning_equity", "revenue", "prior_revenue", "net_profit", "operating_cash_flow", "capital_expenditure", "nopat", "invested_capital")
BLOCKED = ("CONFLICT", "REJECTED", "UNVERIFIED")


def pivot_inputs(facts: DataFrame, key: str) -> DataFrame:
    """A row per key with the sum of each named input, null where there is none: names are fixed, so no pass is needed to find them."""
    return facts.groupBy(key).agg(*[F.sum(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in INPUTS])


def input_gate(facts: DataFrame, key: str, as_of: str, known_at: str, *, unique: bool = True) -> DataFrame:
    """key, reason: the first failing gate of its inputs in order of fact id; a failure blocks all metrics of the key. With unique, a second fact of a name fails; other gates of the same fact come first."""
    nth = F.row_number().over(Window.partitionBy(key, "name").orderBy("fact_id")) if unique else F.lit(1)
    reason = first_reason({
        "FINANCIAL_INPUT_TIME_LINEAGE_MISSING": F.col("published_at").isNull() | F.col("valid_from").isNull(),
        "FINANCIAL_INPUT_AFTER_CUTOFF": F.col("published_at") > F.lit(as_of).cast("date"),
        "FINANCIAL_INPUT_NOT_KNOWN_AT_CUTOFF": F.col("valid_from") > F.lit(known_at).cast("date"),
        "FINANCIAL_INPUT_QUALITY_BLOCKED": F.col("quality_status").isin(*BLOCKED),
        "FINANCIAL_INPUT_DUPLICATE": F.col("_nth") > 1,
    })
    return facts.withColumn("_nth", nth).withColumn("_r", reason).groupBy(key).agg(F.min_by("_r", F.when(F.col("_r").isNotNull(), F.col("fact_id"))).alias("reason"))


def valuation_gate(values: DataFrame, as_of: str, known_at: str) -> DataFrame:
    """values (a market value a row) with reason: why it can't be used. It is asked after the inputs have passed."""
    reason = first_reason({
        "MARKET_VALUATION_AFTER_CUTOFF": F.col("effective_at") > F.lit(as_of).cast("date"),
        "MARKET_VALUATION_NOT_KNOWN_AT_CUTOFF": F.greatest("collected_at", "valid_from") > F.lit(known_at).cast("date"),
        "MARKET_VALUATION_QUALITY_BLOCKED": ~F.col("quality_status").isin("VALID", "DERIVED"),
    })
    return values.withColumn("reason", reason)


def metrics(rows: DataFrame, key: str, market_cap: str = "market_cap") -> DataFrame:
    """key, metric, value, reason: nine metrics of each row of INPUTS and a market value."""
    c = F.col
    base = F.when(c("beginning_equity").isNotNull(), (c("beginning_equity") + c("equity")) / 2).otherwise(c("equity"))
    roe_reason = first_reason({"INPUT_MISSING": c("net_profit").isNull() | c("equity").isNull(), "DENOMINATOR_MISSING_OR_ZERO": base == 0})
    growth, growth_reason = ratio(c("revenue"), c("prior_revenue"))
    fcf = c("operating_cash_flow") - c("capital_expenditure")
    poor = F.when(c("net_profit").isNull(), "INPUT_MISSING").when(c("net_profit") <= 0, "NON_POSITIVE_EARNINGS").when(c(market_cap).isNull(), "INPUT_MISSING")
    found = {
        "roe": (F.when(roe_reason.isNull(), F.try_divide(c("net_profit"), base)), roe_reason),
        "roic": ratio(c("nopat"), c("invested_capital")),
        "revenue_growth": (growth - 1, growth_reason),
        "cash_flow_quality": ratio(c("operating_cash_flow"), c("net_profit")),
        "debt_ratio": ratio(c("liabilities"), c("assets")),
        "free_cash_flow": (fcf, F.when(fcf.isNull(), "INPUT_MISSING")),
        "pe": (F.when(poor.isNull(), F.try_divide(c(market_cap), c("net_profit"))), poor),
        "pb": ratio(c(market_cap), c("equity")),
        "fcf_yield": ratio(fcf, c(market_cap)),
    }
    each = F.array(*[F.struct(F.lit(n).alias("metric"), F.round(v, 6).alias("value"), r.alias("reason")) for n, (v, r) in found.items()])
    return rows.select(key, F.explode(each).alias("m")).select(key, "m.*")
