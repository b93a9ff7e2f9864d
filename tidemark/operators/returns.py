"""Total-return index of daily bars with corporate actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.reasons import first_reason


def fold_actions(actions: Column) -> Column:
    """shares, cash, cost of one share after a day's actions in the order given; the order matters."""

    def number(x: float) -> Column:
        return F.lit(x).cast("double")

    def step(acc: Column, a: Column) -> Column:
        kind, ratio = a["action_type"], a["ratio"]
        shares = F.when(kind == "STOCK", acc["shares"] * (1 + ratio)).when(kind == "SPLIT", acc["shares"] * ratio).when(kind == "RIGHTS", acc["shares"] + ratio).otherwise(acc["shares"])
        cash = acc["cash"] + F.when(kind == "CASH", ratio).otherwise(0.0)
        cost = acc["cost"] + F.when(kind == "RIGHTS", ratio * a["price"]).otherwise(0.0)
        return F.struct(shares.alias("shares"), cash.alias("cash"), cost.alias("cost"))

    none = F.array().cast("array<struct<record_id:string,action_type:string,ratio:double,price:double>>")
    return F.aggregate(F.coalesce(actions, none), F.struct(number(1).alias("shares"), number(0).alias("cash"), number(0).alias("cost")), step)


#: Qualities of an action that block its security.
BLOCKING = ("CONFLICT", "MISSING", "REJECTED", "UNVERIFIED")


def first_actions(actions: DataFrame, order: str = "ordinal") -> DataFrame:
    """Of each record id of a security the first row in order: repeats of a record change nothing."""
    rest = [c for c in actions.columns if c not in ("code", "record_id")]
    return actions.groupBy("code", "record_id").agg(F.min_by(F.struct(*rest), order).alias("_r")).select("code", "record_id", "_r.*").select(*actions.columns)


def blocked_actions(actions: DataFrame, as_of: str, known_at: str, order: str = "ordinal") -> DataFrame:
    """code and the first reason, in order of its actions, why they can't be used. Cancelled actions block too."""
    reason = first_reason({
        "CORPORATE_ACTION_PUBLICATION_AFTER_CUTOFF": F.col("published_at").isNull() | (F.col("published_at") > F.lit(as_of).cast("date")),
        "CORPORATE_ACTION_NOT_KNOWN_AT_CUTOFF": F.col("valid_from") > F.lit(known_at).cast("date"),
        "CORPORATE_ACTION_QUALITY_BLOCKED": F.col("quality_status").isin(*BLOCKING),
    })
    return actions.withColumn("_r", reason).where("_r IS NOT NULL").groupBy("code").agg(F.min_by("_r", order).alias("reason"))


def total_return(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """code, trade_date, index, actions_used. The first bar of a security is 1 and its own actions don't count; cancelled actions and those without a bar on their day have no effect."""
    per_day = actions.where("action_status <> 'CANCELLED'").groupBy("code", F.col("ex_date").alias("trade_date")).agg(F.sort_array(F.collect_list(F.struct("record_id", "action_type", "ratio", "price"))).alias("actions"))
    rows = bars.join(per_day, ["code", "trade_date"], "left").withColumn("f", fold_actions(F.col("actions")))
    by = Window.partitionBy("code").orderBy("trade_date")
    before = F.lag("close").over(by)
    step = F.when(before.isNull(), 1.0).otherwise((F.col("close") * F.col("f.shares") + F.col("f.cash") - F.col("f.cost")) / before)
    used = F.when(before.isNull(), 0).otherwise(F.coalesce(F.size("actions"), F.lit(0)))
    stepped = rows.select("code", "trade_date", step.alias("step"), used.cast("long").alias("actions_used"))
    return stepped.withColumn("index", F.product("step").over(by)).drop("step")


#: Closes; ratios, prices and amounts of actions, with all digits of a DOUBLE; a day's factor; the product of factors. A product or quotient below keeps 18 places or more before it is rounded, half up, to these.
CLOSE, RATIO, MONEY, FACTOR, PRODUCT = "decimal(18,7)", "decimal(24,18)", "decimal(29,18)", "decimal(26,20)", "decimal(28,20)"


def exact_fold(actions: Column) -> Column:
    """fold_actions in decimals: shares of up to 20 decimal places, cash and cost of 18."""

    def step(acc: Column, a: Column) -> Column:
        kind, ratio, price = a["action_type"], a["ratio"].cast(RATIO), a["price"].cast(MONEY)
        grown = (acc["shares"] * F.when(kind == "STOCK", (ratio + 1).cast(RATIO)).when(kind == "SPLIT", ratio).otherwise(F.lit(1).cast(RATIO))).cast(PRODUCT)
        shares = F.when(kind == "RIGHTS", (grown + ratio).cast(PRODUCT)).otherwise(grown)
        cash = (acc["cash"] + F.when(kind == "CASH", ratio).otherwise(F.lit(0).cast(RATIO))).cast(MONEY)
        cost = (acc["cost"] + F.when(kind == "RIGHTS", (ratio * price).cast(MONEY)).otherwise(F.lit(0).cast(MONEY))).cast(MONEY)
        return F.struct(shares.alias("shares"), cash.alias("cash"), cost.alias("cost"))

    start = F.struct(F.lit(1).cast(PRODUCT).alias("shares"), F.lit(0).cast(MONEY).alias("cash"), F.lit(0).cast(MONEY).alias("cost"))
    return F.aggregate(actions, start, step)


def times(a: Column, b: Column) -> Column:
    """A product of factors times another factor or product, rounded half up to 20 places."""
    return (a.cast(PRODUCT) * b.cast(PRODUCT)).cast(PRODUCT)


def exact_total_return(bars: DataFrame, actions: DataFrame, places: int = 10) -> DataFrame:
    """code, trade_date, index (DECIMAL, rounded once, half up, to so many places), actions_used: total_return in decimal arithmetic.

    Between two bars without actions the index only follows the close, so it is close / first close times the product of what the days with actions add: shares + (cash - cost) / close, rounded to 20 places. That
    running product has three steps, so that no series is one row or one task's fold: the factors of a security's year are multiplied in order, the years' products before a year are, and a day takes the second
    times the first up to its own. Each day with actions adds an error of 1e-20 to the product, relative to the factors it is multiplied by. Closes have 7 places. A factor has to be less than a million, a product of
    factors less than 1e8, a close less than 1e10 times the first; round the index here, not a rounded one again."""
    first = bars.groupBy("code").agg(F.min_by(F.struct("trade_date", "close"), "trade_date").alias("_first"))
    rows = bars.join(first, "code")
    per_day = actions.where("action_status <> 'CANCELLED'").groupBy("code", F.col("ex_date").alias("trade_date")).agg(F.sort_array(F.collect_list(F.struct("record_id", "action_type", "ratio", "price"))).alias("actions"))
    dated = per_day.join(rows.select("code", "trade_date", "close", "_first"), ["code", "trade_date"]).where(F.col("trade_date") > F.col("_first.trade_date"))
    folded = dated.withColumn("f", exact_fold(F.col("actions")))
    # A quotient of 29 digits by 18 keeps 20 places.
    paid = (F.col("f.cash") - F.col("f.cost")).cast(MONEY) / F.col("close").cast(CLOSE)
    factor = (F.col("f.shares") + paid.cast(PRODUCT)).cast(FACTOR)
    factors = folded.select("code", "trade_date", F.year("trade_date").alias("_year"), factor.alias("_f"), F.size("actions").cast("long").alias("actions_used"))
    one = F.lit(1).cast(PRODUCT)
    product = lambda xs, name: F.aggregate(F.transform(F.array_sort(xs), lambda x: x[name]), one, times)
    # Of a year: its product, and its days with the product up to each.
    years = factors.groupBy("code", "_year").agg(F.array_sort(F.collect_list(F.struct("trade_date", "_f", "actions_used"))).alias("days"))
    years = years.withColumn("_p", product(F.col("days"), "_f"))
    before = F.collect_list(F.struct("_year", "_p")).over(Window.partitionBy("code").orderBy("_year").rowsBetween(Window.unboundedPreceding, -1))
    years = years.withColumn("_before", product(before, "_p"))
    within = F.transform(F.col("days"), lambda d, i: F.struct(d["trade_date"].alias("day"), d["actions_used"].alias("used"), F.aggregate(F.transform(F.slice(F.col("days"), 1, i + 1), lambda x: x["_f"]), one, times).alias("w")))
    known = years.select("code", "_year", F.explode(within).alias("d"), "_before").select("code", F.col("d.day").alias("trade_date"), F.col("d.used").alias("actions_used"), times(F.col("_before"), F.col("d.w")).alias("_a"))
    # A day without actions has the product of the last one with them.
    last = F.coalesce(F.last("_a", ignorenulls=True).over(Window.partitionBy("code").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)), one)
    grown = F.col("close").cast(CLOSE) / F.col("_first.close").cast(CLOSE)
    out = rows.select("code", "trade_date", grown.cast("decimal(30,20)").alias("_grown")).join(known, ["code", "trade_date"], "left").withColumn("_a", last)
    index = F.round(F.col("_grown") * F.col("_a"), places).cast(f"decimal(28,{places})")
    return out.select("code", "trade_date", index.alias("index"), F.coalesce("actions_used", F.lit(0).cast("long")).alias("actions_used"))


def blocked_series(bars: DataFrame, as_of: str, known_at: str, effective: str = "trade_date", valid_from: str = "valid_from", quality: str = "quality_status", collected: str | None = None) -> DataFrame:
    """code and the first reason, by date, why a series can't be built. A null effective or collected time blocks nothing."""
    reason = first_reason({
        "MARKET_BAR_AFTER_CUTOFF": F.greatest("trade_date", effective) > F.lit(as_of).cast("date"),
        "MARKET_BAR_NOT_KNOWN_AT_CUTOFF": F.greatest(valid_from, collected or valid_from) > F.lit(known_at).cast("date"),
        "MARKET_BAR_QUALITY_BLOCKED": ~F.col(quality).isin("VALID", "DERIVED"),
    })
    return bars.withColumn("_r", reason).where("_r IS NOT NULL").groupBy("code").agg(F.min_by("_r", "trade_date").alias("reason"))
