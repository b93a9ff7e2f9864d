"""Factor scores, ranked pools and their evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.statistics import mid_rank_percentiles
from tidemark.sources.staging import settle

#: Strategy: factor, weight, critical. Fixed values.
STRATEGIES = {
    "quality-growth-v1": [("capital_return", 0.20, True), ("growth_quality", 0.20, True), ("cash_flow_quality", 0.20, True), ("profitability_stability", 0.10, False), ("balance_sheet_quality", 0.10, False), ("valuation_attractiveness", 0.20, True)],
    "deep-value-v1": [("absolute_valuation", 0.25, True), ("relative_valuation", 0.20, True), ("asset_quality", 0.20, True), ("cash_debt_quality", 0.15, True), ("cycle_position", 0.10, False), ("value_trap_safety", 0.10, True)],
    "stable-dividend-v1": [("dividend_yield", 0.25, True), ("dividend_continuity", 0.20, True), ("payout_sustainability", 0.15, True), ("cashflow_coverage", 0.20, True), ("balance_sheet_quality", 0.10, False), ("dividend_cut_safety", 0.10, True)],
}
PEERS, POOL, CANDIDATE = 20, 30, 60
USABLE = ("DERIVED", "VALID")


def available(as_of: str, known_at: str) -> Column:
    """Whether a factor row (value, quality_status, published_at, effective_at, collected_at, valid_from) can be used: there, of good quality, public and in effect by as_of, collected and valid by known_at."""
    cut, known = F.lit(as_of).cast("date"), F.lit(known_at).cast("date")
    good = F.col("value").isNotNull() & F.col("quality_status").isin(*USABLE) & (F.col("published_at") <= cut) & (F.col("effective_at") <= cut) & (F.col("collected_at") <= known) & (F.col("valid_from") <= known)
    return F.coalesce(good, F.lit(False))


def strategy_excluded(securities: DataFrame, strategy: str) -> DataFrame:
    """code of those that a strategy leaves out: hard filters failed or, for stable dividends, dividends not announced only. securities: code, hard_filter_passed, announced_dividend_only; null is false."""
    out = ~F.coalesce("hard_filter_passed", F.lit(False))
    if strategy.startswith("stable-dividend"):
        out = out | ~F.coalesce("announced_dividend_only", F.lit(False))
    return securities.where(out).select("code")


def factor_scores(values: DataFrame) -> DataFrame:
    """code, industry, factor, value -> with scope, fallback, percentile.

    A value is ranked within its industry if PEERS or more there have the factor, else in the whole market. A null industry is
    ranked in the market too, but counts as industry UNKNOWN, without fallback, if the market has PEERS values."""
    own = mid_rank_percentiles(values.where("industry IS NOT NULL"), ["factor", "industry"], "value").select("code", "factor", F.col("population").alias("peers"), F.col("percentile").alias("own"))
    market = mid_rank_percentiles(values, ["factor"], "value").select("code", "industry", "factor", "value", F.col("population").alias("everyone"), F.col("percentile").alias("market"))
    rows = market.join(own, ["code", "factor"], "left")
    unknown = F.col("industry").isNull() & (F.col("everyone") >= PEERS)
    enough = F.coalesce(F.col("peers") >= PEERS, F.lit(False))
    scope = F.when(unknown, "industry:UNKNOWN").when(enough, F.concat(F.lit("industry:"), "industry")).otherwise("market")
    return rows.select("code", "industry", "factor", "value", scope.alias("scope"), (~unknown & ~enough).alias("fallback"), F.when(enough, F.col("own")).otherwise(F.col("market")).alias("percentile"))


#: factor, weight, critical and, if given, whether a higher value is better.
Spec = Sequence[tuple]


def _spec(values: DataFrame, strategy: str | Spec) -> tuple[DataFrame, list[str]]:
    """The factors of a strategy, known or given, as a small table to be broadcast (a row a factor), and the critical ones."""
    spec = [(i, *f[:3], f[3] if len(f) > 3 else True) for i, f in enumerate(STRATEGIES[strategy] if isinstance(strategy, str) else strategy)]
    return values.sparkSession.createDataFrame(spec, "ordinal int, factor string, weight double, critical boolean, higher boolean"), [f[1] for f in spec if f[3]]


def sufficient(values: DataFrame, strategy: str | Spec) -> DataFrame:
    """Codes that have every critical factor. values: code, factor, value of the securities that weren't excluded."""
    _, need = _spec(values, strategy)
    have = values.where(F.col("value").isNotNull() & F.col("factor").isin(need))
    return have.groupBy("code").agg(F.count_distinct("factor").alias("n")).where(F.col("n") == len(need)).select("code")


def scored(values: DataFrame, strategy: str | Spec) -> DataFrame:
    """factor_scores of the strategy's factors among the sufficient securities, with ordinal, weight, and normalized: the percentile, or 100 less it where a lower value is better. The pool is settled once, since it is ranked and bounded in several ways."""
    spec, _ = _spec(values, strategy)
    mine = values.where(F.col("value").isNotNull()).join(F.broadcast(spec.select("factor")), "factor", "left_semi")
    pool = settle(mine.join(sufficient(values, strategy), "code", "left_semi").select("code", "industry", "factor", "value"), "factor-pool")
    rows = factor_scores(pool).join(F.broadcast(spec.drop("critical")), "factor")
    return rows.withColumn("normalized", F.when(F.col("higher"), F.col("percentile")).otherwise(100 - F.col("percentile"))).drop("higher")


def ranked_pool(values: DataFrame, strategy: str | Spec, *, cycle_needed: bool | None = None, scores: DataFrame | None = None) -> DataFrame:
    """rank, code, score (two places, half even), exact_score, completeness, status of the POOL best. Percentiles are taken among the sufficient only; status and order go by the unrounded score.

    strategy: one of STRATEGIES, or a list of factors. cycle_needed: only securities with a cycle position can be candidates (deep value). scores: scored(values, strategy), where it is there already."""
    cycle_needed = strategy == "deep-value-v1" if cycle_needed is None else cycle_needed
    scores = scored(values, strategy) if scores is None else scores
    per = scores.groupBy("code").agg(F.sum(F.col("weight") * F.col("normalized")).alias("s"), F.round(F.sum("weight"), 2).alias("completeness"), F.bool_or(F.col("factor") == "cycle_position").alias("cycle"))
    top = per.withColumn("s", F.round("s", 9)).orderBy(F.desc("s"), "code").limit(POOL)
    status = F.when((F.col("s") >= CANDIDATE) & (F.lit(not cycle_needed) | F.col("cycle")), "CANDIDATE").otherwise("WATCH")
    return top.select(F.row_number().over(Window.orderBy(F.desc("s"), "code")).cast("long").alias("rank"), "code", F.bround("s", 2).alias("score"), F.col("s").alias("exact_score"), "completeness", status.alias("status"))


def usable_values(values: DataFrame) -> DataFrame:
    return values.withColumn("value", F.when(F.col("available"), F.col("value")))


def factor_details(values: DataFrame, strategy: str | Spec, *, codes: DataFrame | None = None, scores: DataFrame | None = None) -> DataFrame:
    """A row per security and factor of the strategy: raw_value, normalized, weight, weighted, quality_status, sources, scope, fallback.

    values: code, industry, factor, value, quality_status, source_record_ids, available. What isn't available has no scores, quality MISSING, scope unavailable and the sources it has; where there is no row at all the source is missing-input.
    codes: the securities (a pool, few), all sufficient ones by default; scores: those of the usable values, where they are there already."""
    spec, _ = _spec(values, strategy)
    usable = usable_values(values)
    scores = (scored(usable, strategy) if scores is None else scores).select("code", "factor", "normalized", "scope", "fallback")
    wanted = sufficient(usable, strategy) if codes is None else codes
    if codes is not None:
        usable, scores = (x.join(F.broadcast(codes), "code", "left_semi") for x in (usable, scores))
    every = wanted.crossJoin(F.broadcast(spec.select("ordinal", "factor", "weight")))
    rows = every.join(usable.select("code", "factor", "value", "quality_status", "source_record_ids"), ["code", "factor"], "left").join(scores, ["code", "factor"], "left")
    there = F.col("normalized").isNotNull()
    return rows.select("code", "ordinal", "factor", F.when(there, F.col("value")).alias("raw_value"), "normalized", "weight", (F.col("normalized") * F.col("weight")).alias("weighted"), F.when(there, F.col("quality_status")).otherwise("MISSING").alias("quality_status"),
                       F.coalesce("source_record_ids", F.array(F.lit("missing-input"))).alias("source_record_ids"), F.coalesce("scope", F.lit("unavailable")).alias("scope"), F.coalesce("fallback", F.lit(False)).alias("fallback"))


def candidates(values: DataFrame, strategy: str | Spec) -> DataFrame:
    """ranked_pool with confidence and factor_details: an array of a candidate's details in the strategy's order (a row a factor, so it is short). The securities are scored once; details are made of the POOL best alone."""
    usable = usable_values(values)
    scores = settle(scored(usable, strategy), "scores")
    pool = settle(ranked_pool(usable, strategy, scores=scores), "pool")
    details = factor_details(values, strategy, codes=pool.select("code"), scores=scores)
    nested = details.groupBy("code").agg(F.array_sort(F.collect_list(F.struct(*[c for c in details.columns if c != "code"]))).alias("factor_details"))
    return pool.withColumn("confidence", F.col("completeness")).join(nested, "code")


def evidence(everything: DataFrame, excluded: DataFrame, values: DataFrame, strategy: str) -> DataFrame:
    """One row of counts: input, excluded, insufficient, qualified, published."""
    n = everything.agg(F.count("*").alias("input")).crossJoin(excluded.agg(F.count("*").alias("excluded"))).crossJoin(sufficient(values, strategy).agg(F.count("*").alias("qualified")))
    return n.select(F.lit(strategy).alias("strategy"), "input", "excluded", (F.col("input") - F.col("excluded") - F.col("qualified")).alias("insufficient"), "qualified", F.least(F.col("qualified"), F.lit(POOL)).alias("published"))
