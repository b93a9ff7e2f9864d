"""Near-duplicate detection by order MinHash.

Texts are sequences of five-word shingles. For sketches and prefixes each is labelled with its occurrence number, so that no two of a text are equal.
For each of SKETCHES hash functions the two shingles of least hash, kept in text order, are one sketch value: texts agree in it if they share these
shingles in the same order. Texts that share a value are candidates, and a candidate pair is a link if an alignment of the shingle sequences, without
labels, matches at least SIMILARITY of them: matched / (n + m - matched). An alignment that good leaves at most
(1 - s) / (1 + s) * (n + m) shingles unmatched, so no match off the diagonal by more can be part of it: a band of that width loses nothing. It also
matches no more shingles than the texts share by label.

Equal texts (by MD5) are one text from the start, so a group of copies costs one row. In a bucket of up to SMALL texts all pairs are candidates. In a
larger one every text is compared with the one that shares most values with others, which makes one class of most groups. The texts of a large
bucket that still holds several classes are joined exactly: with the shingles of each text in a common order by frequency, the first that two texts
share has at least as many shingles from its place on in both as they must share, and two bitmaps in which each shingle turns one bit differ in no
more bits than there are shingles in one text alone. So a passage that leaves two texts under SIMILARITY brings none of them together: their own,
rarer shingles fill the places in which the passage would count. First every such text meets, for each of its first shingles, one text of the class that
has it most often, which joins most of them to their class; then every pair of different classes that these bounds leave is compared.

Rows of a hot key (a text that many meet, a shingle of many texts) are dealt over tasks, FAN to each, and what they are joined to is repeated."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import discard, passing, settle, table, whole_text
from tidemark.llm.decontaminate import NORMAL
from tidemark.llm.polyhash import mix, prefix_hashes, substring_hashes

SHINGLE, SIMILARITY = 5, 0.8
SKETCHES, KEPT = 12, 2
SMALL, FAN = 8, 10_000
#: The narrowest band of an alignment.
BAND = 64
#: Counters of shingle frequencies, at least and at most, between them two for each shingle: shingles that share one only stand later in the order. The most are 16 MB.
COUNTERS, PART = (1 << 18, 1 << 22), 1 << 14
#: Ratio of one block of sizes to the next, a little over 1 / SIMILARITY.
BLOCKS = 1.2501
#: 64-bit words of a bitmap.
BITMAP = 8
_LUT = np.frombuffer(NORMAL, np.uint8)
_SEEDS = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
_WORD = "[0-9A-Za-z\\x{80}-\\x{10FFFF}]"


def shingles(text: str) -> np.ndarray:
    """Hashes of the shingles in text order. Words are as in decontamination; a text of fewer words, but not none, is one shingle."""
    data = _LUT[np.frombuffer(text.encode(), np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], data != 32, [False]]).astype(np.int8)))
    if not len(edge):
        return np.empty(0, np.uint64)
    words = mix(substring_hashes(prefix_hashes(data), edge[::2], edge[1::2]))
    k = min(SHINGLE, len(words))
    h = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        h = mix(h + words[i : i + len(h)])
    return h


def labelled(h: np.ndarray) -> np.ndarray:
    """The shingles with their occurrence numbers, so that all differ."""
    if not len(h):
        return h
    order = np.argsort(h, kind="stable")
    run = h[order]
    first = np.concatenate([[True], run[1:] != run[:-1]])
    nth = np.empty(len(h), np.uint64)
    place = np.arange(len(h))
    nth[order] = place - np.maximum.accumulate(np.where(first, place, 0))
    return mix(h ^ mix(nth))


def sketch(h: np.ndarray) -> np.ndarray:
    """SKETCHES values of a text's labelled shingles, those of different functions never meant to be equal."""
    kept = min(KEPT, len(h))
    v = mix(h[None, :] ^ _SEEDS)
    at = np.sort(np.argpartition(v, kept - 1, axis=1)[:, :kept], axis=1)
    out = _SEEDS[:, 0].copy()
    for i in range(kept):
        out = mix(out + h[at[:, i]])
    return out


def matched(a: np.ndarray, b: np.ndarray, width: int, need: float) -> int:
    """Length of the longest common subsequence of two sequences, or less where it is below need or leaves the band of width."""
    order = np.argsort(b, kind="stable")
    run = b[order]
    low, high = np.searchsorted(run, a, "left"), np.searchsorted(run, a, "right")
    times = high - low
    if np.count_nonzero(times) < need:
        return 0
    total = int(times.sum())
    if total <= 4 * (len(a) + len(b)):
        # Pairs of equal places, in b from the last: the longest strictly increasing run of their places in b.
        i = np.repeat(np.arange(len(a)), times)
        j = order[np.repeat(high, times) - 1 - (np.arange(total) - np.repeat(np.cumsum(times) - times, times))]
        j = j[np.abs(i - j) <= width]
        if (np.diff(j) > 0).all():
            return len(j)
        tails: list[int] = []
        for x in j.tolist():
            k = bisect_left(tails, x)
            tails[k : k + 1] = [x]
        return len(tails)

    # Many repetitions: a band around the diagonal, widened until what is left unmatched fits inside it, so that no better alignment leaves it.
    band = min(BAND, width)
    while True:
        found = banded(len(a), low, high, order, band, need)
        left = max(len(a), len(b)) - found
        if band >= width or left <= band:
            return found
        band = min(8 * band, left, width)


def banded(n: int, low: np.ndarray, high: np.ndarray, order: np.ndarray, band: int, need: float) -> int:
    """Longest common subsequence of n shingles and others among pairs of places that differ by band at most; where that can't reach need and the band is the widest, any smaller number.

    Shingle i of one sequence stands at the places order[low[i]:high[i]] of the other. The rows of the band are integers with a bit a place, in which zeros count matches; a row is a few operations
    on 2 * band + 1 bits, and what leaves the band is counted for good."""
    wide = 2 * band + 1
    full = (1 << wide) - 1
    step = max(2048, wide)

    @lru_cache(2048)
    def places(lo: int, hi: int, part: int) -> int:
        """Bits of the places from band before part * step on, as far as rows of this part look."""
        spot = order[lo:hi] - (part * step - band)
        bits = np.zeros(step + wide, bool)
        bits[spot[(spot >= 0) & (spot < len(bits))]] = True
        return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")

    spots = order.tolist()
    v, done = full, 0
    for i, (lo, hi) in enumerate(zip(low.tolist(), high.tolist())):
        if i:
            done += not v & 1
            v = v >> 1 | 1 << 2 * band
        if lo < hi:
            if hi - lo > 16:
                here = places(lo, hi, i // step) >> i % step & full
            else:
                here = 0
                for j in spots[lo:hi]:
                    if -band <= j - i <= band:
                        here |= 1 << j - i + band
            u = v & here
            v = (v + u | v - u) & full
        if not i & 1023 and done + wide - v.bit_count() + n - i - 1 < need:
            return 0
    return done + wide - v.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """matched / (n + m - matched) of the best alignment of two shingle sequences; 0.0 where it is below least."""
    total = len(a) + len(b)
    if not len(a) or not len(b):
        return 0.0
    need = least / (1 + least) * total - 1e-9
    k = min(len(a), len(b))
    if k < need:
        return 0.0
    # Equal ends are part of a best alignment.
    differ = np.flatnonzero(a[:k] != b[:k])
    head = int(differ[0]) if len(differ) else k
    differ = np.flatnonzero(a[len(a) - k + head :] != b[len(b) - k + head :])
    tail = k - head - 1 - int(differ[-1]) if len(differ) else k - head
    n = head + tail
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if len(a) and len(b):
        n += matched(a, b, int((1 - least) / (1 + least) * total + 1e-9), need - n)
    return n / (total - n) if n >= need else 0.0


def _arrow(kinds: dict[str, pa.DataType], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values())], names=list(kinds))


def text_key(text: Column) -> Column:
    return F.md5(text)


def has_words(text: Column) -> Column:
    return text.rlike(_WORD)


def prefix(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles, with their places in the order by frequency, of which a text of SIMILARITY or more shares at least one; those that no other text has are left out."""
    n = counts[h & np.uint64(len(counts) - 1)]
    order = np.lexsort((h, n))[: len(h) - math.ceil(SIMILARITY * len(h) - 1e-9) + 1]
    place = np.flatnonzero(n[order] > 1)
    return h[order[place]], place


def bitmap(h: np.ndarray) -> np.ndarray:
    """BITMAP words of labelled shingles: a bit is set if an odd number of them turn it."""
    bit = mix(h + np.uint64(1)) & np.uint64(64 * BITMAP - 1)
    odd = np.bincount(bit.view(np.int64), minlength=64 * BITMAP) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def bucket_members(texts: DataFrame) -> DataFrame:
    """value, key, n (shingles), size (texts of the bucket) per text and sketch value that others share. texts: key (unique string), text."""

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"key": pa.string(), "n": pa.int32(), "sketch": pa.list_(pa.int64())}
        for batch in batches:
            rows = []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                h = labelled(shingles(text))
                if len(h):
                    rows.append((key, len(h), sketch(h).view(np.int64)))
            if rows:
                yield _arrow(kinds, list(zip(*rows)))

    sketched = settle(texts.mapInArrow(sketches, "key string, n int, sketch array<bigint>"), "sketches")
    rows = sketched.select("key", "n", F.explode("sketch").alias("value"))
    sizes = rows.groupBy("value").agg(F.count("*").alias("size")).where("size > 1")
    # Both sides grow with the corpus, so they are merged at every size.
    members = settle(rows.join(sizes.hint("merge"), "value"), "buckets")
    discard(sketched)
    return members


def similar_sizes(n: str, m: str) -> Column:
    return F.least(n, m) >= SIMILARITY * F.greatest(n, m) - 1e-9


def candidates(members: DataFrame) -> DataFrame:
    """a < b, near (no fewer than the texts that either of them meets in one group): all pairs of small buckets, and every text of a large one with its leader."""
    small = members.where(F.col("size") <= SMALL).select("value", "key", "n")
    other = small.select("value", F.col("key").alias("k2"), F.col("n").alias("n2"))
    pairs = small.join(other, "value").where((F.col("key") < F.col("k2")) & similar_sizes("n", "n2")).select(F.col("key").alias("a"), F.col("k2").alias("b"), F.lit(SMALL).cast("long").alias("near"))
    # The leader of a large bucket is found by sums and maxima that combine before the shuffle.
    score = members.groupBy("key").agg(F.sum("size").alias("score"))
    large = members.where(F.col("size") > SMALL)
    leader = large.join(score, "key").groupBy("value").agg(F.max(F.struct("score", "key", "n")).alias("l"))
    star = large.join(leader, "value").where((F.col("key") != F.col("l.key")) & similar_sizes("n", "l.n"))
    pairs = pairs.union(star.select(F.least("key", "l.key"), F.greatest("key", "l.key"), "size"))
    return settle(pairs.groupBy("a", "b").agg(F.max("near").alias("near")), "candidates")


def attach(pairs: DataFrame, texts: DataFrame, side: str, other: str, name: str) -> DataFrame:
    """pairs with the text in column side under name. The pairs of one text are dealt over tasks by the other text."""
    dealt = pairs.withColumn("_salt", F.pmod(F.xxhash64(other), 1 + F.floor(F.col("near") / FAN)))
    most = dealt.groupBy(F.col(side).alias("key")).agg(F.max("_salt").alias("_most"))
    held = texts.join(most, "key").select(F.col("key").alias(side), F.explode(F.sequence(F.lit(0).cast("long"), "_most")).alias("_salt"), F.col("text").alias(name))
    return dealt.join(held, [side, "_salt"]).drop("_salt")


def links(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, similarity of the pairs that are links. texts: key, text; pairs: a, b, near."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Pairs of one text follow each other. Texts are smaller than their shingles, so they are what moves.
        known = lru_cache(64)(shingles)
        for batch in batches:
            found = [similarity(known(x), known(y)) for x, y in zip(batch.column("p").to_pylist(), batch.column("q").to_pylist())]
            yield _arrow({"a": pa.string(), "b": pa.string(), "similarity": pa.float64()}, [batch.column("a"), batch.column("b"), found])

    # Texts lie in buckets by key, so only pairs and what is attached to them move. Pairs of a text that many meet are dealt over tasks.
    p, q = (texts.select(F.col("key").alias(k), F.col("text").alias(v)) for k, v in (("a", "p"), ("b", "q")))
    both = pairs.where(F.col("near") <= FAN).join(p, "a").join(q, "b").select("a", "b", "p", "q")
    hot = pairs.where(F.col("near") > FAN)
    if not hot.isEmpty():
        both = both.union(attach(attach(hot, texts, "a", "b", "p"), texts, "b", "a", "q").select("a", "b", "p", "q"))
    return settle(both.select("a", "b", "p", "q").mapInArrow(verify, "a string, b string, similarity double").where(F.col("similarity") >= SIMILARITY - 1e-9), "links")


def open_texts(members: DataFrame, group: DataFrame) -> DataFrame:
    """key, n, component of the texts of large buckets that hold several classes."""
    large = members.where(F.col("size") > SMALL).join(group.withColumnRenamed("node", "key"), "key", "left").select("value", "key", "n", F.coalesce("component", "key").alias("component"))
    several = large.groupBy("value").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).where("_lo <> _hi")
    return settle(large.join(several, "value", "left_semi").select("key", "n", "component").distinct(), "open-texts")


BITS = [f"m{i}" for i in range(BITMAP)]


def prefixes(texts: DataFrame, opened: DataFrame) -> DataFrame:
    """key, n, tokens and places (the prefix of its shingles), BITS of the texts in opened (key, n)."""
    own = settle(texts.join(opened.select("key"), "key", "left_semi").select("key", "text"), "opened")
    total = opened.agg(F.sum("n").alias("n")).first()["n"]
    least, most = COUNTERS
    counters = min(max(least, 1 << (2 * total).bit_length()), most)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(counters, np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                np.add.at(held, (labelled(shingles(text)) & np.uint64(counters - 1)).view(np.int64), 1)
        parts = held.reshape(-1, PART)
        used = np.flatnonzero(parts.any(axis=1))
        yield _arrow({"part": pa.int32(), "n": pa.binary()}, [used.astype(np.int32), [parts[i].tobytes() for i in used.tolist()]])

    def summed(group: pa.Table) -> pa.Table:
        n = sum(np.frombuffer(x, np.int64) for x in group.column("n").to_pylist())
        return pa.table({"part": group.column("part").slice(0, 1), "n": pa.array([np.minimum(n, (1 << 31) - 1).astype(np.int32).tobytes()], pa.binary())})

    # A row for PART counters, 4 bytes each: 16 MB at most reach the driver.
    counts = np.zeros(counters, np.int32)
    for r in own.select("text").mapInArrow(count, "part int, n binary").groupBy("part").applyInArrow(summed, "part int, n binary").toLocalIterator():
        counts[r.part * PART : (r.part + 1) * PART] = np.frombuffer(r.n, np.int32)
    shared = texts.sparkSession.sparkContext.broadcast(counts)
    kinds = {"key": pa.string(), "n": pa.int32(), "tokens": pa.list_(pa.int64()), "places": pa.list_(pa.int32())} | dict.fromkeys(BITS, pa.int64())

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                h = labelled(shingles(text))
                token, place = prefix(h, shared.value)
                rows.append((key, len(h), token.view(np.int64), place.astype(np.int32), *bitmap(h).tolist()))
            if rows:
                yield _arrow(kinds, list(zip(*rows)))

    made = settle(own.mapInArrow(first, "key string, n int, tokens array<bigint>, places array<int>, " + ", ".join(f"{b} long" for b in BITS)), "prefixes")
    discard(own)
    shared.unpersist()
    return made


def shared_tokens(firsts: DataFrame, group: DataFrame) -> DataFrame:
    """A row per text and shingle of its prefix that texts of several classes have, with near (how many texts have it) and main: whether the text is of the class that has it most often."""
    classed = firsts.join(group.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    rows = classed.select("key", "component", "n", *BITS, F.explode(F.arrays_zip("tokens", "places")).alias("t")).select("key", "component", "n", *BITS, F.col("t.tokens").alias("token"), F.col("t.places").alias("place"))
    largest = rows.groupBy("token", "component").agg(F.count("*").alias("c")).groupBy("token").agg(F.max(F.struct("c", "component")).alias("l"), F.sum("c").alias("near"), F.count("*").alias("classes")).where("classes > 1")
    return settle(rows.join(largest.hint("merge"), "token").withColumn("main", F.col("component") == F.col("l.component")).drop("l", "classes"), "shared-prefixes")


def may_link() -> Column:
    """Whether a row of shared_tokens and another (columns with _) at the same shingle leave room for a link: by sizes, by what follows in both, and by bitmaps."""
    need = SIMILARITY / (1 + SIMILARITY) * (F.col("n") + F.col("n_")) - 1e-9
    differ = sum((F.bit_count(F.col(b).bitwiseXOR(F.col(f"{b}_"))) for b in BITS), F.lit(0))
    return (F.col("component") != F.col("component_")) & similar_sizes("n", "n_") & (F.least(F.col("n") - F.col("place"), F.col("n_") - F.col("place_")) >= need) & (F.col("n") + F.col("n_") - differ >= 2 * need)


def met_pairs(met: DataFrame) -> DataFrame:
    """a < b, near of rows that met (key, key_, near), each pair once."""
    return settle(met.groupBy(F.least("key", "key_").alias("a"), F.greatest("key", "key_").alias("b")).agg(F.max("near").alias("near")), "open-pairs")


def other_side(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("token", *more, *[F.col(c).alias(f"{c}_") for c in ("key", "component", "n", "place", "main", *BITS)])


def token_leaders(rows: DataFrame) -> DataFrame:
    """Rows of texts that meet the leader of a shingle: of the class that has it most often, the text in which it stands first."""
    leader = other_side(rows.where("main").groupBy("token").agg(F.min(F.struct("place", "key", "n", "component", "main", *BITS)).alias("l")).select("token", "l.*"))
    return rows.where("NOT main").join(leader, "token").where(may_link()).select("key", "key_", "near")


def token_pairs(rows: DataFrame) -> DataFrame:
    """Rows of texts that meet in a shingle: those of its main class with those of others, and these with each other. A shingle of many texts is dealt over tasks, and texts meet only those whose number of
    shingles is in the same block of sizes or the next, as all that are similar enough are."""
    rows = rows.withColumn("salts", F.floor(F.col("near") / FAN)).withColumn("_block", F.floor(F.log("n") / math.log(BLOCKS)).cast("int"))
    # Of a pair, the text with fewer shingles shares 2s / (1 + s) of them at least, so its part of the prefix is shorter.
    short = rows.where(F.col("n") - F.col("place") >= 2 * SIMILARITY / (1 + SIMILARITY) * F.col("n") - 1e-9).withColumn("_salt", F.pmod(F.xxhash64("key"), F.col("salts") + 1)).withColumn("_block", F.explode(F.array(F.col("_block"), F.col("_block") + 1)))
    other = other_side(rows.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), "salts"))), "_salt", "_block")
    on, may = ["token", "_salt", "_block"], (F.struct("n", "key") < F.struct("n_", "key_")) & may_link()
    met = short.where("NOT main").join(other, on).where(may).union(short.where("main").join(other.where("NOT main_"), on).where(may))
    return met.select("key", "key_", "near")


def classes(texts: DataFrame) -> DataFrame:
    """node, component of the texts with links. texts: key (unique string), text."""
    with passing(texts.sparkSession):
        members = bucket_members(texts)
        pairs = candidates(members)
        found = links(texts, pairs)
        discard(pairs)
        group = components(found)
        discard(found)
        opened = open_texts(members, group)
        discard(members)
        if not opened.isEmpty():
            firsts = prefixes(texts, opened)
            for meet in (token_leaders, token_pairs):
                rows = shared_tokens(firsts, group)
                pairs = met_pairs(meet(rows))
                discard(rows)
                found = links(texts, pairs)
                discard(pairs)
                group = merged(group, found)
                discard(found)
        return settle(group, "classes", keep=True)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its least node) of every node of edges, by taking the least label of neighbours and then that label's own, until nothing changes."""
    both = settle(edges.select(F.col(a).alias("node"), F.col(b).alias("to")).union(edges.select(F.col(b), F.col(a))), "edges")
    labels = now = settle(both.groupBy("node").agg(F.least(F.col("node"), F.min("to")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("to"), "component"), "to").groupBy("node").agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        own = labels.select(F.col("node").alias("component"), F.col("component").alias("own"))
        new = settle(step.join(own, "component").select("node", "was", F.least("component", "own").alias("component")), "labels")
        discard(now)
        labels, now = new.select("node", "component"), new
        if new.where("was <> component").isEmpty():
            discard(both)
            return labels


def merged(group: DataFrame, more: DataFrame) -> DataFrame:
    """group (node, component) after more links (a, b): components of the components that they join."""
    of = lambda side: group.select(F.col("node").alias(side), F.col("component").alias(f"_{side}"))
    joined = more.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")).where("a <> b").distinct()
    joined = settle(joined, "joined-components")
    if joined.isEmpty():
        return group
    top = components(joined).withColumnRenamed("component", "_top").withColumnRenamed("node", "_node")
    old = group.join(top, F.col("component") == F.col("_node"), "left").select("node", F.coalesce("_top", "component").alias("component"))
    new = top.join(group.select(F.col("node").alias("_node")), "_node", "left_anti").select("_node", "_top")
    return settle(old.union(new), "labels")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, class_id, class_key per row of docs. class_id: the least doc_id of all documents whose texts are linked, directly or through others; class_key: a text key of the class (null: no words), the same for all of it and for no other.

    Equal texts are in one class. Texts without words (null, empty, marks alone) are compared with nothing: each such row's class is its own id. Null ids are in classes but don't name them where there is another id. An empty table gives no rows."""
    own = docs.select("doc_id", whole_text("text").alias("text"))
    rows = own.select("doc_id", text_key(F.col("text")).alias("text_key"), has_words(F.col("text")).alias("worded"))
    texts = own.where(has_words(F.col("text"))).select(text_key(F.col("text")).alias("key"), "text")
    # One text a key: the id decides nothing, so any of the equal texts does.
    texts = settle(texts.groupBy("key").agg(F.first("text").alias("text")), "texts", bucket="key")
    group = classes(texts)
    discard(texts)
    keys = rows.where("worded").groupBy("text_key").agg(F.min("doc_id").alias("first"))
    keys = keys.join(group, keys["text_key"] == group["node"], "left").drop("node")
    keys = keys.withColumn("component", F.coalesce("component", "text_key"))
    least = keys.groupBy("component").agg(F.min("first").alias("class_id"))
    keys = keys.join(least, "component").select("text_key", "class_id", F.col("component").alias("class_key"))
    classed = rows.where("worded").drop("worded").join(keys, "text_key").select("doc_id", "text_key", "class_id", "class_key")
    alone = rows.where("NOT worded").select("doc_id", "text_key", F.col("doc_id").alias("class_id"), F.lit(None).cast("string").alias("class_key"))
    return classed.union(alone)


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each class: that of its least doc_id (null last; of rows with equal id and text, one). Rows without words stay. Columns may have any names; an empty table gives no rows.

    Whole rows are shuffled once, where equal texts become one."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("text", whole_text(F.col("row")["text"]))
    rank = F.struct(F.col("row")["doc_id"].isNull(), F.col("row")["doc_id"])
    texts = rows.where(has_words(F.col("text"))).groupBy(text_key(F.col("text")).alias("key")).agg(F.min_by("row", rank).alias("row"))
    texts = settle(texts, "rows", bucket="key")
    group = classes(texts.select("key", F.col("row")["text"].alias("text")))
    ranked = texts.join(group, F.col("key") == F.col("node")).select("key", "component", F.struct(F.col("row")["doc_id"].isNull(), F.col("row")["doc_id"], "key").alias("rank"))
    gone = ranked.join(ranked.groupBy("component").agg(F.min("rank").alias("first")), "component").where("rank <> first")
    kept = texts.join(settle(gone.select("key"), "repeats"), "key", "left_anti").select("row.*")
    return kept.union(rows.where(~has_words(F.col("text"))).select("row.*"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")
