"""Exact removal of repeated byte strings by a bucketed, hash-compared suffix sort.

Which LENGTH-byte strings start at more than one place of the whole corpus? Every such string holds a sampled place, the GRAM-byte substring
of least hash among its own, and equal strings hold it at the same offset. So suffixes need sorting only against suffixes with the
same sample (their bucket) at the same offset. A sample whose whole context is equal to another's settles all of its suffixes at once, by two
64-bit hashes; one of each different context is kept to be compared. The suffixes of what is left are sorted by merging: two of them compare in a logarithmic
number of steps, by binary search for their common extension over prefix polynomial hashes. Neighbours in order that
agree in LENGTH bytes are repeats, verified byte by byte."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import settle, table, whole_text
from tidemark.llm.polyhash import mix, powers, prefix_hashes, substring_hashes

LENGTH, GRAM = 200, 100
#: Bytes of text that are hashed at a time; bytes of text per bucket.
PIECE, BUCKET_BYTES = 1 << 20, 4 << 20
#: Different contexts of one sample that are compared in one task; those of a more frequent sample are dealt over more tasks by a hash of each string.
HOT = 20_000
ANCHOR = np.dtype([("gram", "<u8"), ("context", "<u8"), ("doc", "<u4"), ("at", "<u4"), ("before", "u1"), ("count", "u1"), ("state", "u1")])
#: state: nothing known; settled but still to be compared with; settled only.
OPEN, SETTLED, DONE = 0, 1, 2


def anchors(pieces: list[tuple[int, int, bytes]]) -> np.ndarray:
    """ANCHOR rows of pieces (doc, offset of the piece in its text, bytes). before and count: the strings that this sample serves start at at - before and after."""
    data = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
    if len(data) < LENGTH:
        return np.empty(0, ANCHOR)
    sizes = np.array([len(p[2]) for p in pieces])
    starts = np.cumsum(sizes) - sizes
    s = prefix_hashes(data)
    here = np.arange(len(data) - GRAM + 1)
    gram = mix(substring_hashes(s, here, here + GRAM))
    best = gram >> np.uint64(32) << np.uint64(32) | here.astype(np.uint64)
    width, want = 1, LENGTH - GRAM + 1
    while 2 * width <= want:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    if want > width:
        best = np.minimum(best[: len(best) - (want - width)], best[want - width :])
    at = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
    piece = np.repeat(np.arange(len(pieces)), sizes)[: len(at)]
    inside = np.arange(len(at)) + LENGTH <= (starts + sizes)[piece]
    first = inside & np.concatenate([[True], (at[1:] != at[:-1]) | (piece[1:] != piece[:-1])])
    last = inside & np.concatenate([(at[1:] != at[:-1]) | (piece[1:] != piece[:-1]) | ~inside[1:], [True]])
    lo, hi = np.flatnonzero(first), np.flatnonzero(last)
    out = np.empty(len(lo), ANCHOR)
    out["gram"], out["context"] = gram[at[lo]], mix(substring_hashes(s, lo, hi + LENGTH) ^ np.uint64(0x5851F42D4C957F2D))
    p = piece[lo]
    out["doc"] = np.array([x[0] for x in pieces])[p]
    out["at"] = at[lo] - starts[p] + np.array([x[1] for x in pieces])[p]
    out["before"], out["count"], out["state"] = at[lo] - lo, hi - lo + 1, OPEN
    return out


def settle_copies(a: np.ndarray) -> np.ndarray:
    """Marks equal contexts: one of them SETTLED, the others DONE. Sorted by gram and context."""
    a = a[np.lexsort((a["state"] == DONE, a["context"], a["gram"]))]
    if not len(a):
        return a
    new = np.concatenate([[True], (a["gram"][1:] != a["gram"][:-1]) | (a["context"][1:] != a["context"][:-1])])
    group = np.cumsum(new) - 1
    many = np.bincount(group)[group] > 1
    a["state"] = np.where(many & ~new, DONE, np.where(many & new, SETTLED, a["state"]))
    return a


def _sample(buckets: int):
    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, pieces, held = [], [], 0
            for doc, text in enumerate(batch.column("text").to_pylist()):
                data = text.encode()
                for lo in range(0, max(1, len(data) - LENGTH + 1), PIECE):
                    part = data[lo : lo + PIECE + LENGTH - 1]
                    if len(part) >= LENGTH:
                        pieces.append((doc, lo, part))
                        held += len(part)
                    if held >= PIECE:
                        found.append(anchors(pieces))
                        pieces, held = [], 0
            found.append(anchors(pieces))
            a = settle_copies(np.concatenate(found))
            # Settled copies have no more to be compared with, so they go anywhere: a frequent string isn't gathered.
            bucket = np.where(a["state"] == DONE, a["doc"] * 7919 + a["at"], a["gram"] >> np.uint64(20)).astype(np.uint64) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            a, bucket = a[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            k1, k2 = (np.array(batch.column(c).to_pylist(), np.int64) for c in ("k1", "k2"))
            rows = []
            for part, b in zip(np.split(a, cuts), bucket[np.concatenate([[0], cuts])] if len(a) else ()):
                docs, part["doc"] = np.unique(part["doc"], return_inverse=True)
                rows.append((int(b), np.stack([k1[docs], k2[docs]]).tobytes(), part.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "docs", "anchors"])

    return sample


FOUND = "k1 long, k2 long, gram long, start int, before int, count int, state int, splits int"


def _match(group: pa.Table) -> pa.Table:
    """Of a bucket's samples, those that are settled and those with a sample of another context to be compared with, in so many splits."""
    keys, parts, at = [], [], 0
    for docs, raw in zip(group.column("docs").to_pylist(), group.column("anchors").to_pylist()):
        k, p = np.frombuffer(docs, np.int64).reshape(2, -1), np.frombuffer(raw, ANCHOR).copy()
        p["doc"] += at
        at += k.shape[1]
        keys.append(k)
        parts.append(p)
    k, a = np.concatenate(keys, axis=1), np.concatenate(parts)
    done, a = a[a["state"] == DONE], settle_copies(a[a["state"] != DONE])
    # What isn't DONE now is one sample of each context; those whose gram has no other context have nothing left to be compared with.
    rest = a[a["state"] != DONE]
    _, inverse, counts = np.unique(rest["gram"], return_inverse=True, return_counts=True)
    mixed = counts[inverse] > 1
    alone = rest[~mixed & (rest["state"] == SETTLED)]
    alone["state"] = DONE
    hot = counts[inverse][mixed]
    splits = np.where(hot > HOT, hot * (LENGTH - GRAM + 1) // HOT, 1)
    settled = [done, a[a["state"] == DONE], alone]
    splits = np.concatenate([np.ones(sum(map(len, settled)), np.int64), splits])
    a = np.concatenate([*settled, rest[mixed]])
    start = a["at"].astype(np.int64) - a["before"]
    cells = [k[0][a["doc"]], k[1][a["doc"]], np.ascontiguousarray(a["gram"]).view(np.int64), start.astype(np.int32), a["before"].astype(np.int32), a["count"].astype(np.int32), a["state"].astype(np.int32), splits.astype(np.int32)]
    return pa.table([pa.array(c) for c in cells], names=[x.split()[0] for x in FOUND.split(", ")])


class Suffixes:
    """The strings of LENGTH bytes in some contexts (padded rows), compared by prefix hashes."""

    def __init__(self, contexts: list[bytes]):
        self.data = np.zeros((len(contexts), max(map(len, contexts))), np.uint8)
        for i, c in enumerate(contexts):
            self.data[i, : len(c)] = np.frombuffer(c, np.uint8)
        self.up, down = powers(self.data.shape[1] + 1)
        self.sums = np.zeros((len(contexts), self.data.shape[1] + 1), np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * down[:-1], axis=1, out=self.sums[:, 1:])

    def common(self, r: np.ndarray, s: np.ndarray, q: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Length, up to LENGTH, in which row r from s and row q from t agree."""
        lo, hi = np.zeros(len(r), np.int64), np.full(len(r), LENGTH)
        a, b, ua, ub = self.sums[r, s], self.sums[q, t], self.up[s], self.up[t]
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            same = (self.sums[r, s + mid] - a) * ua == (self.sums[q, t + mid] - b) * ub
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def compare(self, r, s, q, t) -> np.ndarray:
        """-1, 0, 1."""
        n = self.common(r, s, q, t)
        at = np.minimum(n, LENGTH - 1)
        x, y = self.data[r, s + at].astype(np.int64), self.data[q, t + at].astype(np.int64)
        return np.where(n == LENGTH, 0, np.sign(x - y))

    def sort(self, segment: np.ndarray, r: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Order of the suffixes (r, s) within each run of equal segment, by a merge sort of all runs together."""
        n = len(r)
        order = np.arange(n)
        new = np.concatenate([[True], segment[1:] != segment[:-1]])
        head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        size = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1]
        t = np.arange(n) - head
        width = 1
        while width < size.max():
            block = t // width
            other = head + (block ^ 1) * width
            length = np.clip(head + size - other, 0, width)
            left = block % 2 == 0
            lo, hi = np.zeros(n, np.int64), length.copy()
            while (go := np.flatnonzero(lo < hi)).size:
                mid = (lo[go] + hi[go]) // 2
                mine, theirs = order[go], order[other[go] + mid]
                c = self.compare(r[theirs], s[theirs], r[mine], s[mine])
                # Equal suffixes of the left run stay before those of the right one.
                before = np.where(left[go], c < 0, c <= 0)
                lo[go], hi[go] = np.where(before, mid + 1, lo[go]), np.where(before, hi[go], mid)
            place = head + block // 2 * 2 * width + t % width + lo
            merged = np.empty(n, np.int64)
            merged[place] = order
            order = merged
            width *= 2
        return order

    def repeated(self, segment: np.ndarray, r: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Which suffixes agree in LENGTH bytes with another of their segment."""
        order = self.sort(segment, r, s)
        r2, s2 = r[order], s[order]
        near = np.flatnonzero(segment[1:] == segment[:-1])
        near = near[self.common(r2[near], s2[near], r2[near + 1], s2[near + 1]) == LENGTH]
        out, wrong = np.zeros(len(r), bool), []
        for lo in range(0, len(near), 20_000):
            i = near[lo : lo + 20_000]
            cells = np.arange(LENGTH)
            same = (self.data[r2[i][:, None], s2[i][:, None] + cells] == self.data[r2[i + 1][:, None], s2[i + 1][:, None] + cells]).all(axis=1)
            out[order[i[same]]] = out[order[i[same] + 1]] = True
            wrong.append(segment[i[~same]])
        for g in np.unique(np.concatenate(wrong)) if wrong else ():
            # A collision of hashes: this segment is looked at as bytes.
            mine = np.flatnonzero(segment == g)
            _, inverse, counts = np.unique(self.data[r[mine][:, None], s[mine][:, None] + np.arange(LENGTH)], axis=0, return_inverse=True, return_counts=True)
            out[mine] = counts[inverse.ravel()] > 1
        return out


RANGES = "k1 long, k2 long, start int, end int"


def _sorted_ranges(group: pa.Table) -> pa.Table:
    contexts = group.column("context").to_pylist()
    column = lambda c: np.array(group.column(c).to_pylist(), np.int64)
    gram, before, count, start, state, k1, k2 = map(column, ("gram", "before", "count", "start", "state", "k1", "k2"))
    r = np.repeat(np.arange(len(count)), count)
    s = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    offset = before[r] - s
    order = np.lexsort((offset, gram[r]))
    r, s, offset = r[order], s[order], offset[order]
    new = np.concatenate([[True], (gram[r][1:] != gram[r][:-1]) | (offset[1:] != offset[:-1])])
    segment = np.cumsum(new) - 1
    some = np.bincount(segment)[segment] > 1
    r, s, segment = r[some], s[some], segment[some]
    hit = np.flatnonzero(Suffixes(contexts).repeated(segment, r, s)) if len(r) else np.empty(0, np.int64)
    hit = hit[state[r[hit]] == OPEN]
    order = np.lexsort((s[hit], r[hit]))
    r, s = r[hit][order], s[hit][order]
    if len(r):
        new = np.concatenate([[True], (r[1:] != r[:-1]) | (s[1:] != s[:-1] + 1)])
        lo, hi = np.flatnonzero(new), np.concatenate([np.flatnonzero(new)[1:], [len(r)]]) - 1
        r, a, b = r[lo], s[lo], s[hi]
    else:
        a = b = s
    return pa.table([pa.array(k1[r]), pa.array(k2[r]), pa.array((start[r] + a).astype(np.int32)), pa.array((start[r] + b + LENGTH).astype(np.int32))], names=["k1", "k2", "start", "end"])


CONTEXTS = "k1 long, k2 long, gram long, split int, start int, before int, count int, state int, context binary"


def parts(data: bytes, count: int, splits: int) -> Iterator[tuple[int, int, int]]:
    """split, first, n: the runs of the context's strings that go to the same split. Equal strings go to the same."""
    if splits == 1:
        yield 0, 0, count
        return
    raw = np.frombuffer(data, np.uint8)
    at = np.arange(count)
    split = (mix(substring_hashes(prefix_hashes(raw), at, at + LENGTH)) % np.uint64(splits)).tolist()
    first = 0
    for i in range(1, count + 1):
        if i == count or split[i] != split[first]:
            yield split[first], first, i - first
            first = i


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, held = [], 0
        for k1, k2, text, found in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "text", "found"))):
            data = text.encode()
            for f in found:
                context = data[f["start"] : f["start"] + f["count"] - 1 + LENGTH]
                for split, first, n in parts(context, f["count"], f["splits"]):
                    out.append((k1, k2, f["gram"], split, f["start"] + first, f["before"] - first, n, f["state"], context[first : first + n - 1 + LENGTH]))
                    held += n + LENGTH
            if held > 8 << 20:
                yield _context_batch(out)
                out, held = [], 0
        if out:
            yield _context_batch(out)


def _context_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[x.split()[0] for x in CONTEXTS.split(", ")])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, spans, kept = [], [], []
        for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist()):
            data, merged = text.encode(), []
            for x in sorted((x["start"], x["end"]) for x in ranges or ()):
                if merged and x[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], x[1])
                else:
                    merged.append(list(x))
            edges = [0, *(y for x in merged for y in x), len(data)]
            removed.append(sum(b - a for a, b in merged))
            spans.append(len(merged))
            kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
        cells = [batch.column("row"), pa.array([len(t.encode()) for t in batch.column("text").to_pylist()], pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays(cells, names=["row", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """row (struct of docs' columns), n_bytes, n_removed, n_spans, kept (remaining bytes). Null texts are empty; repeated rows are repeats of each other; texts of fewer than LENGTH bytes stay; an empty table gives no rows."""
    spark = docs.sparkSession
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = whole_text(F.col("row")["text"])
    # A row's key: its id and a hash of both, so that different texts under one id stay apart.
    keyed = rows.select("row", F.coalesce(F.col("row")["doc_id"].cast("long"), F.lit(0).cast("long")).alias("k1"), F.xxhash64(F.col("row")["doc_id"], text).alias("k2"), text.alias("text"))
    size = keyed.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES)
    sampled = keyed.select("k1", "k2", "text").mapInArrow(_sample(buckets), "bucket int, docs binary, anchors binary")
    found = settle(sampled.groupBy("bucket").applyInArrow(_match, FOUND), "repeat-samples")
    settled = found.where(F.col("state") != OPEN).select("k1", "k2", "start", (F.col("start") + F.col("count") - 1 + LENGTH).alias("end"))
    mixed = found.where(F.col("state") != DONE).groupBy("k1", "k2").agg(F.collect_set(F.struct("gram", "start", "before", "count", "state", "splits")).alias("found"))
    own = keyed.join(mixed, ["k1", "k2"]).select("k1", "k2", "text", "found").mapInArrow(_contexts, CONTEXTS)
    ordered = own.groupBy(F.pmod(F.xxhash64("gram", "split"), F.lit(buckets)).alias("bucket")).applyInArrow(_sorted_ranges, RANGES)
    ranges = settled.union(ordered).groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "end")).alias("ranges"))
    cut = keyed.join(ranges, ["k1", "k2"], "left").select("row", "text", "ranges")
    return cut.mapInArrow(_cut, f"row {rows.schema['row'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary")


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
p AS MATERIALIZED (SELECT rid, i, md5_number(substr(x, (2 * i + 1)::INT, 400)) AS g FROM d, unnest(range(n - 199)) u(i) WHERE n >= 200),
twice AS (SELECT g FROM p GROUP BY g HAVING count(*) > 1),
hit AS (SELECT rid, i FROM p SEMI JOIN twice ON p.g = twice.g),
runs AS (SELECT rid, i, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS k FROM (SELECT rid, i, CASE WHEN i <= lag(i) OVER (PARTITION BY rid ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM hit)),
spans AS (SELECT rid, min(i) AS s, max(i) + 200 AS e FROM runs GROUP BY rid, k),
cut AS (SELECT rid, s, e, coalesce(lag(e) OVER (PARTITION BY rid ORDER BY s), 0) AS before FROM spans),
kept AS (SELECT c.rid, sum(e - s)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(x, (2 * before + 1)::INT, (2 * (s - before))::INT), '' ORDER BY s) || substr(any_value(x), (2 * max(e) + 1)::INT) AS k FROM cut c JOIN d ON c.rid = d.rid GROUP BY c.rid)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, x))) AS kept_sha256 FROM d LEFT JOIN kept ON d.rid = kept.rid
"""
