"""Mixing sources to target weights by hash-threshold histograms.

Each row has 60 uniform hash bits. A source whose target is r times its size takes every row floor(r) times, and rows whose
hash is below a threshold once more. The threshold is found without sorting rows: tokens are summed by source and the 12
leading bits, the running sum gives the bucket in which the budget ends, and only that bucket is split by the next 12 bits,
until it holds one row. Histograms have at most 4096 rows a source and are combined before the shuffle, so a source with most
of the rows costs no more than others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import hash60, settle, table, whole_text, words

BITS, STEP = 60, 12


def source_targets(sized: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """_source, source_size, target. Sources get weights in turn by code point, null last; together they get share times all
    sizes, but none over most times its size: what is above goes to the rest by weight, until none is above. The windows here
    have one row a source."""
    per = sized.groupBy("_source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1
    per = per.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), F.pmod(place, len(weights)).cast("int") + 1).cast("double"))
    per = per.withColumn("_cap", most * F.col("source_size")).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    # The sources that fill up are those with the least ratio of cap to weight.
    by = Window.orderBy("_ratio", F.col("_source").asc_nulls_last())
    before = F.coalesce(F.sum("_cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("_w").over(by.rowsBetween(0, Window.unboundedFollowing))
    every = F.sum("source_size").over(Window.partitionBy())
    per = per.withColumn("_level", (share * every - before) / after)
    level = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", F.col("_source").isNull(), "_source", "_level"))).over(Window.partitionBy())["_level"]
    return per.select("_source", "source_size", F.coalesce(F.least("_cap", level * F.col("_w")), F.col("_cap")).alias("target"))


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """targets with _full (times that every row is taken) and _below: rows with _hash below it are taken once more."""
    ratio = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = targets.withColumn("_full", ratio.cast("long")).select("*", (F.col("target") - F.col("_full") * F.col("source_size")).alias("_rest"), F.lit(0).cast("long").alias("_prefix"), F.lit(0).cast("long").alias("_below"), F.lit(False).alias("_done"))
    state = settle(state, "mix-state")
    for used in range(0, BITS, STEP):
        left = BITS - used - STEP
        here = sized.join(state.where("NOT _done AND _rest > 0").select(F.col("_source").alias("_s"), "_prefix"), F.col("_source").eqNullSafe(F.col("_s")) & (F.shiftright("_hash", BITS - used) == F.col("_prefix")))
        hist = here.groupBy("_source", F.shiftright("_hash", left).alias("_bucket")).agg(F.sum("size").alias("_tokens"), F.count("*").alias("_rows"))
        hist = hist.withColumn("_upto", F.sum("_tokens").over(Window.partitionBy("_source").orderBy("_bucket"))).withColumnRenamed("_source", "_s")
        ends = state.join(hist, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_upto") > F.col("_rest")), "left").groupBy(*state.columns).agg(F.min(F.when(F.col("_bucket").isNotNull(), F.struct("_bucket", "_tokens", "_rows", "_upto"))).alias("_b"))
        rest = F.col("_rest") - (F.col("_b._upto") - F.col("_b._tokens"))
        last = (F.col("_b._rows") == 1) | F.lit(left == 0)
        # A bucket that isn't split is taken or left as a whole, whichever comes nearer.
        edge = F.shiftleft(F.col("_b._bucket") + F.when(rest > F.col("_b._tokens") - rest, 1).otherwise(0), left)
        open_ = F.col("_b").isNotNull()
        state = settle(ends.select("_source", "source_size", "target", "_full", F.when(open_, rest).otherwise(F.col("_rest")).alias("_rest"), F.when(open_, F.col("_b._bucket")).otherwise(F.col("_prefix")).alias("_prefix"), F.when(open_, edge).otherwise(F.col("_below")).alias("_below"), F.when(open_, last).otherwise(True).alias("_done")), "mix-state")
        if not state.where("NOT _done").limit(1).count():
            break
    return state.select("_source", "source_size", "target", "_full", "_below")


def mix_sources(docs: DataFrame, *, size, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0, key: str = "doc_id", source: str = "source", keep: Sequence[str] = ()) -> DataFrame:
    """One row per document: key, size, source_size, target, copies, taken = copies * size, and the columns in keep.

    Documents of size 0 are taken 0 times more than their source's full rounds and count nothing; a null source is a source of its own,
    sorted last; rows that share a key share a hash and are taken together; an empty table gives no rows. Reruns agree."""
    sized = settle(docs.select(F.col(key).alias("_key"), F.col(source).cast("string").alias("_source"), size.cast("long").alias("size"), hash60(F.col(key), "mix:").alias("_hash"), *[F.col(c).alias(f"_keep_{c}") for c in keep]), "mix-sizes")
    cut = thresholds(sized.select("_source", "size", "_hash"), source_targets(sized, weights, share, most))
    rows = sized.join(cut.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s")))
    copies = F.col("_full") + F.when(F.col("_hash") < F.col("_below"), 1).otherwise(0)
    return rows.select(F.col("_key").alias(key), "size", "source_size", F.round("target", 6).alias("target"), copies.alias("copies"), (copies * F.col("size")).alias("taken"), *[F.col(f"_keep_{c}").alias(c) for c in keep])


def mixed_documents(docs: DataFrame, *, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, its columns unchanged. Texts aren't shuffled: each row meets the threshold of its source."""
    row = lambda c: F.col("_row")[c]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    hashed = rows.select("_row", row(source).cast("string").alias("_source"), hash60(row(key), "mix:").alias("_hash"))
    sized = settle(hashed.select("_source", F.size(words(whole_text(row(text)))).cast("long").alias("size"), "_hash"), "mix-sizes")
    cut = thresholds(sized, source_targets(sized, weights, share, most)).select(F.col("_source").alias("_s"), "_full", "_below")
    copies = F.col("_full") + F.when(F.col("_hash") < F.col("_below"), 1).otherwise(0)
    placed = hashed.join(cut, F.col("_source").eqNullSafe(F.col("_s"))).select("_row", copies.cast("int").alias("_copies"))
    return placed.where("_copies > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix_sources(docs, size=F.size(words(whole_text("text")))).select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sized GROUP BY source),
weighed AS (SELECT *, [3, 1, 2][(place % 3 + 1)::INT]::DOUBLE AS w, 2.0 * source_size AS cap FROM per),
levels AS (
  SELECT *, cap::DOUBLE / w AS ratio,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap::DOUBLE) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
     / sum(w) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
lv AS (SELECT level AS l FROM levels WHERE level <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1),
goal AS (SELECT source, source_size, coalesce(least(cap::DOUBLE, (SELECT l FROM lv) * w), cap::DOUBLE) AS target FROM levels),
rest AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS fulls FROM goal),
rounds AS (SELECT *, target - fulls * source_size AS r FROM rest),
sums AS (SELECT source, h, sum(size) AS s FROM sized GROUP BY source, h),
upto AS (SELECT *, sum(s) OVER (PARTITION BY source ORDER BY h) AS upto FROM sums),
extra AS (
  SELECT u.source, u.h, CASE WHEN u.upto <= g.r THEN 1 WHEN u.upto - u.s <= g.r AND g.r - (u.upto - u.s) > u.upto - g.r THEN 1 ELSE 0 END AS more
  FROM upto u JOIN rounds g ON u.source IS NOT DISTINCT FROM g.source)
SELECT d.doc_id, d.size, g.source_size, round(g.target, 6) AS target, ((g.fulls + e.more) * d.size)::BIGINT AS taken
FROM sized d JOIN rounds g ON d.source IS NOT DISTINCT FROM g.source JOIN extra e ON d.source IS NOT DISTINCT FROM e.source AND d.h = e.h
"""
