"""Sharding by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a prime-sized table (a start and a step, both hashed from its name). Shards take
turns, each claiming the first slot of its order that is still free, until the table is full: every shard gets the same number of slots, give
or take one, and adding or removing a shard moves few slots. A document's place is one look-up: slot = hash mod size. The table's
size is a fixed parameter, so its broadcast has a fixed bound however many documents there are."""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import hash60, table

SLOTS, SHARDS = 65537, 64


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """Shard number of each slot. slots must be prime and at least the number of shards."""
    if not shards or len(shards) > slots or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime and no less than the number of shards, of which there must be one")
    num = [int(md5(s.encode()).hexdigest(), 16) for s in shards]
    at, step = [n % slots for n in num], [(n >> 64) % (slots - 1) + 1 for n in num]
    owner, free = [-1] * slots, slots
    while free:
        for k in range(len(shards)):
            while owner[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % slots
            owner[at[k]] = k
            free -= 1
            if not free:
                break
    return owner


def assign_shards(docs: DataFrame, *, shards: list[str] | None = None, slots: int = SLOTS, key: str = "doc_id", slot_as: str = "slot", shard_as: str = "shard") -> DataFrame:
    """docs with slot_as and shard_as, replacing columns of these names; other columns may have any names. Rows of equal key (null counts as empty) share a shard; the rows are not shuffled; an empty table gives no rows."""
    names = shards or [f"shard-{i:05d}" for i in range(SHARDS)]
    owners = docs.sparkSession.createDataFrame(list(enumerate(lookup_table(names, slots))), "slot long, shard long")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.withColumn("slot", F.pmod(hash60(F.col("row")[key], "shard:"), F.lit(slots).cast("long"))).join(F.broadcast(owners), "slot")
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c not in (slot_as, shard_as)]
    return rows.select(*kept, F.col("slot").alias(slot_as), F.col("shard").alias(shard_as))


def write_shards(placed: DataFrame, path: str, *, files: int = 1, shard: str = "shard", key: str = "doc_id") -> None:
    """One folder a shard, each of `files` files at most per writing partition: the rows of a shard are dealt over files by hash, so that a large shard is not one task."""
    dealt = placed.withColumn("_file", F.pmod(F.xxhash64(key), F.lit(files))).repartition(shard, "_file").drop("_file")
    dealt.write.partitionBy(shard).parquet(path)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents").select("doc_id"))
