"""Hard filters: every reason is told, in a fixed order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.reasons import every_reason
from tidemark.operators.market import BOARDS


@dataclass(frozen=True)
class HardFilters:
    listing_days: int = 365
    liquidity_days: int = 60
    average_amount: float = 50_000_000
    completeness: float = 0.85
    age_days: int = 550


def hard_filter_reasons(rows: DataFrame, limits: HardFilters = HardFilters()) -> DataFrame:
    """rows with reasons (HF-01 to HF-12). Rows have in_scope, venue, delisting_risk, st_status, trade_date, report_date, is_suspended, is_trading, list_date, amount_days, amount_mean, audit_standard, investigation_open, completeness, return_quality, publication_known, age_days."""
    c = F.col
    rules = {
        "HF-01": ~c("in_scope") | ~c("venue").isin(BOARDS),
        "HF-02": c("delisting_risk"),
        "HF-03": c("st_status").isNotNull(),
        "HF-04": ~c("trade_date").eqNullSafe(c("report_date")) | c("is_suspended") | ~c("is_trading"),
        "HF-05": F.datediff("report_date", "list_date") < limits.listing_days,
        "HF-06": (c("amount_days") < limits.liquidity_days) | (c("amount_mean") < limits.average_amount),
        "HF-07": ~c("audit_standard"),
        "HF-08": c("investigation_open"),
        "HF-09": c("completeness") < limits.completeness,
        "HF-10": c("return_quality") != "DERIVED",
        "HF-11": ~c("publication_known"),
        "HF-12": c("age_days") > limits.age_days,
    }
    return rows.withColumn("reasons", every_reason(rules))


def liquidity(bars: DataFrame, days: int) -> DataFrame:
    """code, trade_date, amount_days, amount_mean over the last `days` bars of each security."""
    recent = Window.partitionBy("code").orderBy("trade_date").rowsBetween(1 - days, 0)
    return bars.select("code", "trade_date", F.count("*").over(recent).alias("amount_days"), F.avg("amount").over(recent).alias("amount_mean"))
