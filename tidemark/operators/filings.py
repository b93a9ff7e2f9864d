"""Bitemporal filings: what was published and known at a moment, and which version of a chain holds then."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ordering import previous
from tidemark.sources.staging import passing, settle

UNUSABLE = ("CONFLICT", "REJECTED", "UNVERIFIED")


def visible(filings: DataFrame, as_of: str, known_at: str) -> DataFrame:
    return filings.where((F.col("published_at") <= F.lit(as_of).cast("date")) & (F.col("valid_from") <= F.lit(known_at).cast("date")))


def select_versions(filings: DataFrame, as_of: str, known_at: str, entity: str = "entity") -> DataFrame:
    """entity, selected (filing id or null), blocked_reason.

    The visible filings of an entity must be one path from a single root; its last version is selected. A broken chain, or a last version that
    isn't usable but restates another, blocks rather than falls back; an unusable first version gives neither."""
    seen = visible(filings, as_of, known_at).select(entity, "filing_id", "supersedes_id", "quality_status", F.struct("published_at", "filing_id").alias("_when"))
    parents = seen.select(F.col("filing_id").alias("supersedes_id"), F.col(entity).alias("_owner"), F.lit(1).alias("_found"), F.col("_when").alias("_before"))
    held = seen.join(parents, "supersedes_id", "left").withColumn("_found", F.when(F.col("_owner") == F.col(entity), 1))
    children = held.where("_found = 1").groupBy("supersedes_id").agg(F.count("*").alias("_children")).withColumnRenamed("supersedes_id", "filing_id")
    nodes = settle(held.join(children, "filing_id", "left").withColumn("_children", F.coalesce("_children", F.lit(0))), "versions")
    orphan = F.col("supersedes_id").isNotNull() & F.col("_found").isNull()
    leaf = F.struct("filing_id", "supersedes_id", "quality_status")
    per = nodes.groupBy(entity).agg(
        F.count("*").alias("n"), F.count_if(F.col("supersedes_id").isNull()).alias("roots"), F.count_if(orphan).alias("orphans"), F.max("_children").alias("widest"),
        F.count_if(F.col("_children") == 0).alias("leaves"), F.max(F.when(F.col("_children") == 0, leaf)).alias("leaf"), F.count_distinct("filing_id").alias("ids"))
    good = (F.col("roots") == 1) & (F.col("orphans") == 0) & (F.col("widest") <= 1) & (F.col("leaves") == 1) & (F.col("ids") == F.col("n"))
    # Counts don't see a cycle beside the path. On a cycle some filing isn't later than the one that it restates; only entities with such filings are walked.
    suspect = nodes.where((F.col("_found") == 1) & ~(F.col("_before") < F.col("_when"))).select(F.col(entity).alias("_suspect")).distinct()
    if not suspect.isEmpty():
        walked = nodes.join(suspect, nodes[entity].eqNullSafe(F.col("_suspect")), "left_semi")
        depth = chain_depths(walked.select("filing_id", F.when(F.col("_found") == 1, F.col("supersedes_id")).alias("supersedes_id")).distinct())
        cyclic = walked.join(depth.where("root_id IS NULL").select("filing_id"), "filing_id", "left_semi").select(F.col(entity).alias("_cyclic")).distinct()
        per = per.join(cyclic, per[entity].eqNullSafe(F.col("_cyclic")), "left")
        good = good & F.col("_cyclic").isNull()
    unusable = F.col("leaf.quality_status").isin(*UNUSABLE)
    reason = F.when(~good | (unusable & F.col("leaf.supersedes_id").isNotNull()), "FINANCIAL_RESTATEMENT_UNUSABLE")
    return per.select(entity, F.when(good & ~unusable, F.col("leaf.filing_id")).alias("selected"), reason.alias("blocked_reason"))


def chain_depths(filings: DataFrame) -> DataFrame:
    """filing_id, root_id, depth by pointer doubling, a settled table a round: the filings that know their root, and those that walk on. Filings on a cycle, or whose chain leads to one, have no root.

    After r rounds a walk is 2**r steps long. A chain without a cycle has no more steps than there are filings, so what still walks then is on a cycle."""
    start = filings.select("filing_id", F.col("supersedes_id").alias("up"), F.when(F.col("supersedes_id").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.coalesce("supersedes_id", "filing_id").alias("root_id"))
    with passing(filings.sparkSession):
        walk = settle(start, "walk")
        n, steps = walk.count(), 1
        while steps <= n and walk.where("up IS NOT NULL").limit(1).count():
            ahead = walk.select(F.col("filing_id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"), F.col("root_id").alias("_root"))
            step = walk.join(ahead, "up", "left").select("filing_id", F.col("_up").alias("up"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), F.coalesce("_root", "root_id").alias("root_id"))
            walk = settle(step, "walk")
            steps *= 2
        walk = settle(walk, "chain-depths", keep=True)
    return walk.select("filing_id", F.when(F.col("up").isNull(), F.col("root_id")).alias("root_id"), F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def predecessors(filings: DataFrame, entity: str = "entity") -> DataFrame:
    """filing_id, predecessor: the last filing of the entity published strictly earlier (ties within a day have the same predecessor, the greatest id of the day before). An entity's filings are dealt over ranges of days, however many there are."""
    days = previous(filings, entity, "published_at", "filing_id").select(F.col(entity).alias("_entity"), F.col("published_at").alias("_day"), "previous")
    met = filings.join(days, (F.col(entity) == F.col("_entity")) & (F.col("published_at") == F.col("_day")), "left")
    return met.select("filing_id", F.col("previous").alias("predecessor"))


def facts_as_of(facts: DataFrame, filings: DataFrame, as_of: str, known_at: str) -> DataFrame:
    """Valid facts of the selected versions."""
    chosen = select_versions(filings, as_of, known_at).where("selected IS NOT NULL").select("entity", F.col("selected").alias("filing_id"))
    return facts.where("quality_status = 'VALID'").join(chosen, "filing_id")


def query_facts(facts: DataFrame, filings: DataFrame, as_of: str, known_at: str, *, names: Sequence[str] | None = None, where: Column | None = None) -> DataFrame:
    """facts_as_of for some names and filings, by entity, name and fact id. where is over filings; both conditions reach the scans."""
    chosen = filings if where is None else filings.where(where)
    wanted = facts if names is None else facts.where(F.col("name").isin(*names))
    return facts_as_of(wanted, chosen, as_of, known_at).orderBy("entity", "name", "fact_id")


def versions_in_order(filings: DataFrame) -> DataFrame:
    """Versions by publication, validity and insert order."""
    return filings.orderBy("published_at", "valid_from", "ordinal")
