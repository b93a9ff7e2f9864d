"""Financial facts: mapping, identity, duplicates, conflicts and the balance equation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unit_kind(numerators: Column, denominators: Column, currency: Column) -> Column:
    """MONETARY, PER_SHARE, SHARES, PURE, NONE or OTHER, from a unit's measures."""
    n, d = F.size(numerators), F.size(denominators)
    one, under = F.get(numerators, F.lit(0)), F.get(denominators, F.lit(0))
    kind = F.when((n == 0) & (d == 0), "NONE").when((n == 1) & (d == 0) & currency.isNotNull(), "MONETARY").when((n == 1) & (d == 1) & currency.isNotNull() & under.endswith("shares"), "PER_SHARE")
    return kind.when((n == 1) & (d == 0) & one.endswith("shares"), "SHARES").when((n == 1) & (d == 0) & one.endswith("pure"), "PURE").otherwise("OTHER")


def identity_hash(*parts: Column) -> Column:
    """SHA-256 of the parts in order; null and empty differ."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("~")) for p in parts]), 256)


def identity_groups(facts: DataFrame, *identity: str) -> DataFrame:
    """Per identity: n, values, kept (least fact id), status UNIQUE, FINANCIAL_FACT_DUPLICATE (equal values fold) or FINANCIAL_FACT_CONFLICT."""
    g = facts.groupBy(*identity).agg(F.count("*").alias("n"), F.count_distinct("value").alias("values"), F.min("fact_id").alias("kept"), F.array_join(F.array_sort(F.collect_list("fact_id")), ",").alias("fact_ids"))
    return g.withColumn("status", F.when(F.col("n") == 1, "UNIQUE").when(F.col("values") == 1, "FINANCIAL_FACT_DUPLICATE").otherwise("FINANCIAL_FACT_CONFLICT"))


def alias_conflicts(facts: DataFrame, *key: str) -> DataFrame:
    """Groups of one canonical name reported under several raw names: equal values fold, others conflict."""
    g = facts.groupBy(*key).agg(F.count_distinct("raw_name").alias("raw_names"), F.count_distinct("value").alias("values"))
    return g.where("raw_names > 1").withColumn("status", F.when(F.col("values") == 1, "FINANCIAL_FACT_ALIAS_DUPLICATE").otherwise("CANONICAL_VALUE_MISMATCH"))


def tolerance(decimals: Column) -> Column:
    """Half a unit in the last reported place; none where it is unknown."""
    return F.when(decimals.isNull(), 0.0).otherwise(0.5 * F.pow(F.lit(10.0), -decimals))


NAMES = ("assets", "liabilities", "equity")


def _balance_sums() -> list[Column]:
    """Sums over rows of name, value, decimals from which the balance equation is judged."""
    part = F.col("name").isin(*NAMES)
    counts = [F.count_if(F.col("name") == n).alias(f"n_{n}") for n in NAMES]
    values = [F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in NAMES]
    return [*counts, *values, F.round(F.sum(F.when(part, tolerance(F.col("decimals")))), 6).alias("allowed")]


def _balance_status() -> tuple[Column, Column]:
    """gap and status of such sums: COMPONENT_MISSING, SKIPPED (a component twice), CONFLICT or BALANCED."""
    gap = F.round(F.abs(F.col("assets") - F.col("liabilities") - F.col("equity")), 4)
    n = [f"n_{x}" for x in NAMES]
    return gap, F.when(F.least(*n) == 0, "FINANCIAL_BALANCE_COMPONENT_MISSING").when(F.greatest(*n) > 1, "SKIPPED").when(gap > F.col("allowed"), "FINANCIAL_BALANCE_EQUATION_CONFLICT").otherwise("BALANCED")


def balance(facts: DataFrame, *key: str) -> DataFrame:
    """key, gap, allowed, status of the balance equation, of keys that have a part of it."""
    gap, status = _balance_status()
    return facts.where(F.col("name").isin(*NAMES)).groupBy(*key).agg(*_balance_sums()).select(*key, gap.alias("gap"), "allowed", status.alias("status"))


def filing_status(facts: DataFrame) -> DataFrame:
    """filing_id, quality_status: CONFLICT before PARTIAL before VALID. Conflicting identities don't take part in the balance.

    Two aggregations: by identity, which folds duplicates into their least fact, and by filing."""
    kept = F.min(F.struct("fact_id", "name", "value", "decimals")).alias("kept")
    groups = facts.groupBy("filing_id", "raw_name").agg((F.min("value") != F.max("value")).alias("clash"), F.bool_or(F.col("name").isNull()).alias("unmapped"), kept)
    good = ~F.coalesce("clash", F.lit(False))
    rows = groups.select("filing_id", "clash", "unmapped", *[F.when(good, F.col(f"kept.{c}")).alias(c) for c in ("name", "value", "decimals")])
    per = rows.groupBy("filing_id").agg(F.coalesce(F.bool_or("clash"), F.lit(False)).alias("clash"), F.bool_or("unmapped").alias("unmapped"), *_balance_sums())
    even = F.when(F.greatest(*[f"n_{x}" for x in NAMES]) > 0, _balance_status()[1])
    bad = F.col("clash") | (F.coalesce(even, F.lit("")) == "FINANCIAL_BALANCE_EQUATION_CONFLICT")
    partial = F.col("unmapped") | (F.coalesce(even, F.lit("")) == "FINANCIAL_BALANCE_COMPONENT_MISSING")
    return per.select("filing_id", F.when(bad, "CONFLICT").when(partial, "PARTIAL").otherwise("VALID").alias("quality_status"))


def correction_links(facts: DataFrame, filings: DataFrame) -> DataFrame:
    """fact_id, supersedes_fact: the fact of the restated filing under the same comparison key; of several the greatest id."""
    old = facts.groupBy(F.col("filing_id").alias("supersedes_id"), "raw_name").agg(F.max("fact_id").alias("supersedes_fact"))
    new = facts.join(filings.select("filing_id", "supersedes_id"), "filing_id")
    return new.join(old, ["supersedes_id", "raw_name"], "left").select("fact_id", "supersedes_fact")


def unmapped_issues(facts: DataFrame) -> DataFrame:
    """One issue a filing that has facts without a name: its code, how many, and their sorted ids (a filing's facts are few)."""
    per = facts.where("name IS NULL").groupBy("filing_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("fact_id")), ",").alias("fact_ids"))
    return per.select("filing_id", F.lit("FINANCIAL_FACT_UNMAPPED").alias("code"), "n", "fact_ids")


def retained(facts: DataFrame, *identity: str) -> DataFrame:
    """facts without folded duplicates, those of a conflict all kept as CONFLICT, others without a name as UNVERIFIED."""
    groups = facts.groupBy(*identity).agg(F.count_distinct("value").alias("_values"), F.min("fact_id").alias("_kept"))
    rows = facts.join(groups, list(identity)).where((F.col("_values") > 1) | (F.col("fact_id") == F.col("_kept")))
    status = F.when(F.col("_values") > 1, "CONFLICT").when(F.col("name").isNull(), "UNVERIFIED").otherwise(F.col("quality_status"))
    return rows.withColumn("quality_status", status).drop("_values", "_kept")
