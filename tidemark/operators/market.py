"""Daily bars and the security universe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.reasons import every_reason, first_reason

BOARDS = ["MAIN_SH", "STAR", "MAIN_SZ", "CHINEXT"]


def bar_violations(bars: DataFrame) -> DataFrame:
    """Bars that break a constraint, with the constraints' names."""
    c = F.col
    rules = {
        "NEGATIVE_PRICE": F.least("open", "high", "low", "close") < 0,
        "HIGH_TOO_LOW": c("high") < F.greatest("open", "close", "low"),
        "LOW_TOO_HIGH": c("low") > F.least("open", "close", "high"),
        "NEGATIVE_VOLUME": c("volume") < 0,
        "NEGATIVE_AMOUNT": c("amount") < 0,
    }
    return bars.withColumn("violations", every_reason(rules)).where(F.size("violations") > 0)


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def in_scope(security_type: Column, venue: Column, currency: Column) -> Column:
    return (security_type == "A_SHARE") & venue.isin(BOARDS) & (currency == "CNY")


def universe(master: DataFrame) -> DataFrame:
    return master.where(in_scope(F.col("security_type"), F.col("venue"), F.col("currency")))


def outside_universe(bars: DataFrame, members: DataFrame) -> DataFrame:
    """Bars whose security isn't a member: an anti join, whose result must be empty before a day is published."""
    return bars.join(members.select("code"), "code", "left_anti")


def latest_per(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key by order, through one aggregation."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def single_artifact_guard(bars: DataFrame, date: str = "trade_date") -> DataFrame:
    """Dates whose rows come from more than one file."""
    files = bars.select(date, F.col("_metadata.file_path").alias("file"))
    return files.groupBy(date).agg(F.count_distinct("file").alias("files")).where("files > 1").withColumn("reason", F.lit("MARKET_PARQUET_MULTIPLE_ARTIFACTS"))


#: Fixed values of a provider's daily rows.
PROVIDER, PROVIDER_FIELDS = "tushare", ("open", "high", "low", "close", "pre_close", "vol", "amount")
#: Source of a security master: exchange, suffix of its codes, its boards.
MASTER_SOURCES = {"sse": ("SSE", ".SH", ("MAIN_SH", "STAR")), "szse": ("SZSE", ".SZ", ("MAIN_SZ", "CHINEXT"))}


def provider_bars(rows: DataFrame, requested: Column, content_hash: Column, collected_at: Column) -> DataFrame:
    """A provider's rows (ts_code, trade_date as yyyyMMdd, numbers as text) as bars, with issue where a row must be refused. Units aren't converted; vol is volume."""
    day = F.when(F.length("trade_date") == 8, F.try_to_date("trade_date", "yyyyMMdd"))
    numbers = {("volume" if f == "vol" else f): F.col(f).try_cast("decimal(38,10)") for f in PROVIDER_FIELDS}
    missing = F.col("ts_code").isNull()
    for n in numbers.values():
        missing = missing | n.isNull()
    low, high = F.least(numbers["open"], numbers["close"]), F.greatest(numbers["open"], numbers["close"])
    wrong = (F.least(*numbers.values()) < 0) | (numbers["low"] > low) | (numbers["high"] < high)
    issue = first_reason({"TUSHARE_TRADE_DATE_INVALID": day.isNull(), "TUSHARE_TRADE_DATE_MISMATCH": day != requested, "TUSHARE_ROW_INVALID": missing | wrong})
    stamp = F.concat(F.date_format(day, "yyyyMMdd"), F.lit("-"), F.substring(content_hash, 1, 12))
    return rows.select(F.concat("ts_code", F.lit("-"), stamp).alias("record_id"), F.concat(F.lit("daily-"), stamp).alias("version"), F.lit(PROVIDER).alias("source_id"), content_hash.alias("content_hash"), collected_at.alias("collected_at"), collected_at.alias("valid_from"),
                       F.lit("VALID").alias("quality_status"), "ts_code", day.alias("trade_date"), *[v.alias(k) for k, v in numbers.items()], issue.alias("issue"))


def daily_bars(bars: DataFrame, approved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The bars of a day without those of the Beijing board, and what is wrong (code, issue). Codes that come twice are told first, also those of the Beijing board; then codes that aren't approved."""
    twice = duplicate_keys(bars, "ts_code").select("ts_code", F.lit("MARKET_DAILY_DUPLICATE_TS_CODE").alias("issue"))
    kept = bars.where(~F.col("ts_code").endswith(".BJ"))
    strange = kept.select("ts_code").distinct().join(approved.select("ts_code"), "ts_code", "left_anti").select("ts_code", F.lit("MARKET_DAILY_OUT_OF_SCOPE").alias("issue"))
    return kept, twice.unionByName(strange)


def master_violations(rows: DataFrame, source: str = "source_id") -> DataFrame:
    """rows with issue: a blank required value, an exchange, suffix or board that isn't its source's."""
    blank = F.lit(False)
    for c in ("ts_code", "symbol", "name", "exchange", "board", "currency", "list_date", "security_type"):
        blank = blank | (F.coalesce(F.col(c).cast("string"), F.lit("")) == "")
    fits = F.lit(False)
    for s, (exchange, suffix, boards) in MASTER_SOURCES.items():
        fits = fits | ((F.col(source) == s) & (F.col("exchange") == exchange) & F.col("ts_code").endswith(suffix) & F.col("board").isin(*boards))
    return rows.withColumn("issue", first_reason({"SECURITY_MASTER_ROW_INVALID": blank, "SECURITY_MASTER_SOURCE_MISMATCH": ~F.coalesce(fits, F.lit(False))}))
