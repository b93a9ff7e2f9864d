"""SimHash near-duplicates by tiled exact comparison.

A fingerprint has a bit for each of 64 places: set if more than half of the text's shingle hashes have it set. Two fingerprints that differ in RADIUS bits or fewer
are linked. Equal fingerprints are one row from the start.

The population counts of a fingerprint's words (four of 16 bits) put it in a cell: a bit that differs changes one of these counts by one, so fingerprints within RADIUS
are in cells whose counts differ by RADIUS in sum at most. A cell is cut into tiles of about TILE fingerprints, and every pair of tiles whose cells lie within the radius
is one row: one numpy exclusive-or of all against all, and a bit count. All other pairs of tiles are skipped, and none that is compared is compared by sample.
A pair of tiles gives a spanning forest of its links, so a dense group gives no more rows than it has fingerprints in each pair."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import passing, settle, table, whole_text
from tidemark.llm.near_dedup import components

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Fingerprints in a tile, and in a block of the exclusive-or.
TILE, BLOCK = 4096, 1 << 20
#: Words whose bits are counted; from FINE fingerprints on 8, so that there are more, smaller cells.
WORDS, FINE = 4, 50_000_000
#: Shingles hashed at a time.
CHUNK = 1 << 16
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str) -> int:
    """Unsigned; 0 for a text without words."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    size = min(SHINGLE, len(words))
    n = len(words) - size + 1
    data = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    total, hash64 = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for lo in range(0, n, CHUNK):
        hi = min(n, lo + CHUNK)
        h = np.array([hash64(data[i:j], SEED) for i, j in zip(starts[lo:hi].tolist(), ends[lo + size - 1 : hi + size - 1].tolist())], np.uint64)
        total += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and fingerprint (its 64 bits as a long) of every row's whole text, null as empty. Other columns are left out."""
    rows = docs.select(F.col(f"`{key}`").alias("key"), whole_text(F.col(f"`{text}`")).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(bits.view(np.int64))], names=["key", "fingerprint"])

    return rows.mapInArrow(made, f"key {kind}, fingerprint long").select(F.col("key").alias(key), "fingerprint")


def cell(bits: Column, words: int) -> list[Column]:
    """Population counts of the words of a fingerprint."""
    width = 64 // words
    return [F.bit_count(F.shiftrightunsigned(bits, width * i).bitwiseAND(F.lit((1 << width) - 1))).cast("int") for i in range(words)]


def steps(words: int, radius: int) -> list[tuple[int, ...]]:
    """Differences of cells within the radius, one of each and its negative; the first is zero."""
    near = [d for d in product(range(-radius, radius + 1), repeat=words) if sum(map(abs, d)) <= radius]
    return sorted(d for d in near if d >= (0,) * words)


def forest(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Edges (least of a component, another of it) over the fingerprints of two tiles, so that what links join is joined. same: b is a."""
    both = np.concatenate([a, b])
    root = np.arange(len(both))
    other = 0 if same else len(a)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    rows = max(1, BLOCK // max(1, len(b)))
    for lo in range(0, len(a), rows):
        i, j = np.nonzero(np.bitwise_count(a[lo : lo + rows, None] ^ b[None, :]) <= radius)
        i, j = i + lo, j + other
        if same:
            i, j = i[i < j], j[i < j]
        # Pairs within one component tell nothing new, so most of a dense group goes here.
        while len(i):
            for x, y in set(zip(root[i[:4096]].tolist(), root[j[:4096]].tolist())):
                x, y = find(x), find(y)
                root[max(x, y)] = min(x, y)
            while (root[root] != root).any():
                root = root[root]
            left = root[i] != root[j]
            i, j = i[left], j[left]
    at = np.flatnonzero(root != np.arange(len(both)))
    return both[root[at]], both[at]


def links(bits: DataFrame, *, radius: int = RADIUS, tile: int = TILE, fine: int = FINE) -> DataFrame:
    """a, b: edges whose components are those of all links between the different fingerprints of bits (column fingerprint)."""
    words = WORDS if bits.count() < fine else 2 * WORDS
    counts = [f"c{i}" for i in range(words)]
    placed = bits.select("fingerprint", *[c.alias(n) for n, c in zip(counts, cell(F.col("fingerprint"), words))])
    cells = settle(placed.groupBy(*counts).agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles")), "simhash-cells")
    # Four words have 17 ** 4 = 83,521 cells at most.
    small = F.broadcast(cells) if words == WORDS else cells
    tiles = placed.join(small, counts).withColumn("tile", F.pmod(F.xxhash64("fingerprint"), "tiles").cast("int")).groupBy(*counts, "tile").agg(F.collect_list("fingerprint").alias("held"))
    tiles = settle(tiles.select(F.struct(*counts, "tile").alias("id"), "held"), "simhash-tiles")

    moves = F.explode(F.array(*[F.array(*map(F.lit, d)) for d in steps(words, radius)])).alias("d")
    near = cells.select("*", moves).select(*counts, F.col("tiles").alias("tiles_a"), "d", *[(F.col(c) + F.col("d")[i]).alias(f"{c}_") for i, c in enumerate(counts)])
    near = near.join(cells.select(*[F.col(c).alias(f"{c}_") for c in counts], F.col("tiles").alias("tiles_b")), [f"{c}_" for c in counts])
    first = F.explode(F.sequence(F.lit(0), F.col("tiles_a") - 1)).alias("ta")
    second = F.explode(F.sequence(F.when(F.exists("d", lambda x: x != 0), F.lit(0)).otherwise(F.col("ta")), F.col("tiles_b") - 1)).alias("tb")
    pairs = near.select("*", first).select("*", second).select(F.struct(*counts, F.col("ta").alias("tile")).alias("a"), F.struct(*[F.col(f"{c}_").alias(c) for c in counts], F.col("tb").alias("tile")).alias("b"))
    # Cells meet their tiles twice; tiles of a cell with many neighbours are a few kilobytes each.
    met = pairs.join(tiles.select(F.col("id").alias("a"), F.col("held").alias("p")), "a").join(tiles.select(F.col("id").alias("b"), F.col("held").alias("q")), "b").select((F.col("a") == F.col("b")).alias("same"), "p", "q")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            p, q = batch.column("p"), batch.column("q")
            for k, same in enumerate(batch.column("same").to_pylist()):
                x, y = (np.asarray(c[k].values).view(np.uint64) for c in (p, q))
                edges = forest(x, y, radius, same)
                if len(edges[0]):
                    found.append(edges)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).view(np.int64)) for c in zip(*found)], names=["a", "b"])

    return settle(met.mapInArrow(compare, "a long, b long"), "simhash-links")


def simhash_components(docs: DataFrame, *, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row: the least doc_id of all documents that chains of links reach from it, itself included.

    Texts without words (null, empty) have fingerprint zero and are linked like any other. Rows of equal id are each a document; null ids name a component only if all of its
    ids are null. Columns of docs other than doc_id and text don't matter, whatever their names. An empty table gives no rows."""
    spark = docs.sparkSession
    rows = settle(fingerprints(docs), "fingerprints", keep=True)
    with passing(spark):
        bits = settle(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
        group = components(links(bits, radius=radius))
        named = bits.join(group.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
        least = named.groupBy("component").agg(F.min("first").alias("component_id"))
        classes = settle(named.join(least, "component").select("fingerprint", "component_id"), "simhash-classes", keep=True)
    return rows.join(classes, "fingerprint").select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
