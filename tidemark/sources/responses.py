"""Rows of a market data provider from its responses, landed as JSON files in a folder a requested date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.reasons import first_reason
from tidemark.sources.tables import strict_date

#: The provider's daily fields; the reasons below are fixed too.
DAILY_FIELDS = ("ts_code", "trade_date", "open", "high", "low", "close", "pre_close", "vol", "amount")
AMOUNT = "decimal(38,10)"


def landed(spark: SparkSession, path: str) -> DataFrame:
    """requested (text of the date as its folder tells it: requested=d20260720), file, body (text). A filter on requested reaches the listing of folders, so other dates' files aren't opened."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.substring("requested", 2, 20).alias("requested"), F.col("_metadata.file_path").alias("file"), F.col("value").alias("body"))


def judge_responses(files: DataFrame, fields: tuple[str, ...] = DAILY_FIELDS) -> DataFrame:
    """files with names (its fields, in its order), items (an array of variants), missing and unknown (sorted), and issue: the first of TUSHARE_RESPONSE_INVALID (no JSON object), TUSHARE_FIELDS_INVALID (no data, not the fields asked for, each once), TUSHARE_ROW_INVALID
    (an item that isn't an array of as many values)."""
    v = F.try_parse_json("body")
    rows = files.withColumn("_v", v)
    get = lambda path, kind: F.try_variant_get("_v", path, kind)
    rows = rows.withColumns({"_object": F.schema_of_variant("_v").startswith("OBJECT"), "names": get("$.data.fields", "array<string>"), "items": get("$.data.items", "array<variant>"), "_kinds": F.schema_of_variant(get("$.data.fields", "variant"))})
    wanted = F.array(*[F.lit(f) for f in fields])
    good_names = (F.col("_kinds") == "ARRAY<STRING>") & (F.array_sort("names") == F.array_sort(wanted))
    sizes = F.exists("items", lambda x: F.coalesce(F.size(F.try_variant_get(x, "$", "array<variant>")) != len(fields), F.lit(True)))
    issue = first_reason({"TUSHARE_RESPONSE_INVALID": ~F.coalesce("_object", F.lit(False)), "TUSHARE_FIELDS_INVALID": ~F.coalesce(good_names, F.lit(False)), "TUSHARE_ROW_INVALID": F.col("items").isNull() | sizes})
    differ = {"missing": F.array_sort(F.array_except(wanted, F.coalesce("names", F.array()))), "unknown": F.array_sort(F.array_except(F.coalesce("names", F.array()), wanted))}
    return rows.withColumns(differ).withColumn("issue", issue).drop("_v", "_object", "_kinds")


def daily_bars(judged: DataFrame) -> DataFrame:
    """A row for each item of the good files, fields found by name whatever their order: file, requested, ts_code, trade_date, numbers (decimals, exactly as written; null where there is none), and issue: TUSHARE_TRADE_DATE_INVALID, TUSHARE_TRADE_DATE_MISMATCH (another date than was
    asked for) or TUSHARE_VALUE_INVALID (something that is no number)."""
    rows = judged.where("issue IS NULL").select("file", "requested", "names", F.explode("items").alias("_i"))
    rows = rows.withColumn("_m", F.map_from_arrays("names", F.try_variant_get("_i", "$", "array<variant>")))
    text = lambda c: F.try_variant_get(F.col("_m")[c], "$", "string")
    numbers = {c: F.try_variant_get(F.col("_m")[c], "$", AMOUNT) for c in DAILY_FIELDS[2:]}
    odd = F.lit(False)
    for c, n in numbers.items():
        odd = odd | (n.isNull() & text(c).isNotNull())
    day = strict_date(text("trade_date"), "yyyyMMdd")
    issue = first_reason({"TUSHARE_TRADE_DATE_INVALID": day.isNull(), "TUSHARE_TRADE_DATE_MISMATCH": text("trade_date") != F.col("requested"), "TUSHARE_VALUE_INVALID": odd | text("ts_code").isNull()})
    return rows.select("file", "requested", text("ts_code").alias("ts_code"), day.alias("trade_date"), *[n.alias(c) for c, n in numbers.items()], issue.alias("issue"))
