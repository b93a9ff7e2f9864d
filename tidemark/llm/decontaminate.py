"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, against which every text's word windows are scanned.

The set is arrays: sorted window hashes with the windows' places in the normalised text, made once and shared by all tasks of a worker. A window of a text
whose hash is in it is compared as text, so no two windows pass for each other; equal windows of many items are one. A set holds WINDOWS words at most, and with one set training text shuffles nowhere. A larger
benchmark is dealt over several sets, long items in pieces. The texts meet one set after the other where they are read, which leaves the hits alone, and these meet their texts once at the end."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.common import settle, table, whole_text
from tidemark.llm.polyhash import mix, prefix_hashes, substring_hashes

N = 10
#: Words of benchmark text in one set (32 bytes each and the text), and in one piece of an item, at most.
WINDOWS, PIECE = 2_000_000, 10_000
#: Bytes of words stay, A-Z in lower case; all others of the ASCII range separate.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD_BYTES = bytes(c if NORMAL[c] != 32 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(NORMAL).split()


class Words:
    """A normalised text: its words with one space between, where they start and end, and their hashes."""

    def __init__(self, text: str):
        self.data = b" ".join(words_of(text))
        raw = np.frombuffer(self.data, np.uint8)
        gaps = np.flatnonzero(raw == 32)
        self.start, self.end = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(raw)]])
        if not len(raw):
            self.start = self.end = np.empty(0, np.int64)
        self.hashes = mix(substring_hashes(prefix_hashes(raw), self.start, self.end))

    def windows(self, size: int) -> np.ndarray:
        """Hashes of the windows of size words."""
        at = np.arange(max(0, len(self.hashes) - size + 1))
        return mix(substring_hashes(prefix_hashes(self.hashes), at, at + size)) if len(at) else np.empty(0, np.uint64)


class GramSet:
    """Windows of n words of items (id, text); an item of fewer words, but not none, is one window."""

    def __init__(self, items: list[tuple[str | None, str]], n: int = N):
        self.items = [item for item, _ in items]
        parts: dict[int, list] = {}
        texts, at = [], 0
        for number, (_, text) in enumerate(items):
            w = Words(text)
            size = min(n, len(w.hashes))
            if size:
                k = len(w.hashes) - size + 1
                parts.setdefault(size, []).append((w.windows(size), w.start[:k] + at, w.end[size - 1 :] + at, np.full(k, number)))
                texts.append(w.data)
                at += len(w.data)
        self.text = b"".join(texts)
        self.windows = {}
        for size, columns in parts.items():
            h, start, end, number = (np.concatenate(c) for c in zip(*columns))
            order = np.argsort(h, kind="stable")
            h, start, end, number = h[order], start[order].astype(np.int32), end[order].astype(np.int32), number[order].astype(np.int32)
            # A table of low hash bits, most of them unset, tells most absent windows in one look.
            low = np.zeros(1 << max(10, int(8 * len(h)).bit_length()), bool)
            low[h & np.uint64(len(low) - 1)] = True
            self.windows[size] = (*self._unique(h, start, end, number), low)

    def _unique(self, h: np.ndarray, start: np.ndarray, end: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, ...]:
        """Hashes and places of the different windows, and of each where its items begin in owners and end. Windows of one hash are compared as text."""
        edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]]))
        kind = np.arange(len(h))
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
            if hi - lo > 1:
                first: dict[bytes, int] = {}
                kind[lo:hi] = [first.setdefault(self.text[start[i] : end[i]], i) for i in range(lo, hi)]
        order = np.lexsort((kind, h))
        at = np.flatnonzero(np.concatenate([[True], kind[order][1:] != kind[order][:-1]]))
        first = kind[order][at]
        return h[first], start[first], end[first], np.concatenate([at, [len(h)]]).astype(np.int32), number[order]

    def scan(self, words: Words) -> tuple[list[int], list]:
        """Places of the hit words, in order, and ids of the items found."""
        hit, found = np.zeros(len(words.hashes), bool), set()
        for size, (hashes, start, end, owners, number, low) in self.windows.items():
            h, seen = words.windows(size), set()
            at = np.flatnonzero(low[h & np.uint64(len(low) - 1)])
            first, last = np.searchsorted(hashes, h[at], "left"), np.searchsorted(hashes, h[at], "right")
            for i, lo, hi in zip(at.tolist(), first.tolist(), last.tolist()):
                mine = words.data[words.start[i] : words.end[i + size - 1]] if lo < hi else b""
                for j in range(lo, hi):
                    if self.text[start[j] : end[j]] == mine:
                        hit[i : i + size] = True
                        seen.add(j)
            for j in seen:
                found.update(self.items[k] for k in number[owners[j] : owners[j + 1]].tolist())
        return np.flatnonzero(hit).tolist(), [x for x in found if x is not None]


def without_words(text: str, places: list[int]) -> str:
    """text without the words at places and what stands between two that follow each other."""
    raw = text.encode()
    plain = raw.translate(WORD_BYTES)
    out, at, keep, gone, number = [], 0, 0, set(places), 0
    while at < len(raw):
        while at < len(raw) and plain[at] == 32:
            at += 1
        start = at
        while at < len(raw) and plain[at] != 32:
            at += 1
        if at > start:
            if number in gone:
                if number - 1 not in gone:
                    out.append(raw[keep:start])
                keep = at
            number += 1
    out.append(raw[keep:])
    return b"".join(out).decode()


def pieces(benchmark: DataFrame, n: int = N) -> DataFrame:
    """item, text, n_words: the normalised items, long ones in pieces that overlap by n - 1 words, so that every window is in one of them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                words = words_of(text)
                parts = [words[lo : lo + PIECE + n - 1] for lo in range(0, max(1, len(words) - n + 1), PIECE)]
                cells = [[item] * len(parts), [b" ".join(x).decode() for x in parts], [len(x) for x in parts]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.string(), pa.string(), pa.int64()))], names=["item", "text", "n_words"])

    return benchmark.select(F.col("item_id").cast("string").alias("item"), whole_text("text").alias("text")).mapInArrow(cut, "item string, text string, n_words long").where("n_words > 0")


COUNTED = ("n_words", pa.int64()), ("places", pa.list_(pa.int32())), ("items", pa.list_(pa.string())), ("cut", pa.string())


def scan_documents(docs: DataFrame, benchmark: DataFrame, *, n: int = N, windows: int = WINDOWS, cut: bool = False) -> DataFrame:
    """row (struct of docs' columns, whatever their names), n_words, places (array of the hit words' numbers), items (ids found, as strings), and with cut the text without the hit words (null: none hit).

    Null texts have no words; repeated rows are each scanned; items without words never hit; items of null id hit but are not listed; items of equal id count once; an empty table gives no rows.
    The driver makes the sets, one at a time, so it holds WINDOWS words of benchmark text and their hashes at most."""
    spark = docs.sparkSession
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    tests = settle(pieces(benchmark, n), "benchmark-pieces")
    slices = 1 + (tests.agg(F.sum("n_words").alias("n")).first()["n"] or 0) // windows
    if slices > 1:
        return _with_hits(rows, settle(_hits_of_slices(rows, tests, slices, n), "benchmark-hits"), cut)
    grams = spark.sparkContext.broadcast(GramSet([(r.item, r.text) for r in tests.toLocalIterator()], n))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, places, found, cuts = [], [], [], []
            for t in batch.column("text").to_pylist():
                words = Words(t)
                at, ids = grams.value.scan(words)
                counts.append(len(words.hashes))
                places.append(at)
                found.append(sorted(ids))
                cuts.append(without_words(t, at) if cut and at else None)
            cells = [pa.array(c, t) for c, (_, t) in zip((counts, places, found, cuts), COUNTED)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *cells], names=["row", *[c for c, _ in COUNTED]])

    out = rows.select("row", whole_text(F.col("row")["text"]).alias("text"))
    return out.mapInArrow(scan, _schema(rows))


def _hits_of_slices(rows: DataFrame, tests: DataFrame, slices: int, n: int) -> DataFrame:
    """text_key, places, items of the texts that hit a window, a part of the benchmark after the other. Equal texts have equal hits, so a text's key stands for its rows; only hits are stored."""
    spark, out = rows.sparkSession, None
    texts = rows.select(whole_text(F.col("row")["text"]).alias("text"))
    for k in range(slices):
        mine = tests.where(F.pmod(F.xxhash64("item", "text"), F.lit(slices)) == k)
        grams = spark.sparkContext.broadcast(GramSet([(r.item, r.text) for r in mine.toLocalIterator()], n))

        def scan(batches: Iterator[pa.RecordBatch], grams=grams) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(t, *grams.value.scan(Words(t))) for t in batch.column("text").to_pylist()]
                found = [x for x in found if x[1]]
                cells = [[md5(t.encode()).hexdigest() for t, _, _ in found], [p for _, p, _ in found], [i for _, _, i in found]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.string(), pa.list_(pa.int32()), pa.list_(pa.string())))], names=["text_key", "places", "items"])

        part = settle(texts.mapInArrow(scan, "text_key string, places array<int>, items array<string>").dropDuplicates(["text_key"]), "slice-hits")
        out = part if out is None else out.union(part)
        # So that a worker never holds two sets.
        grams.unpersist()
    merged = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return out.groupBy("text_key").agg(merged("places"), merged("items"))


def _with_hits(rows: DataFrame, hits: DataFrame, cut: bool) -> DataFrame:
    """rows with their hits, n_words and what is left of their texts."""
    met = rows.withColumn("text", whole_text(F.col("row")["text"])).withColumn("text_key", F.md5("text")).join(hits, "text_key", "left")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, places = batch.column("text").to_pylist(), [p or [] for p in batch.column("places").to_pylist()]
            cells = [[len(words_of(t)) for t in texts], places, [i or [] for i in batch.column("items").to_pylist()], [without_words(t, p) if cut and p else None for t, p in zip(texts, places)]]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(c, t) for c, (_, t) in zip(cells, COUNTED))], names=["row", *[c for c, _ in COUNTED]])

    return met.select("row", "text", "places", "items").mapInArrow(counted, _schema(rows))


def _schema(rows: DataFrame) -> StructType:
    kinds = {"n_words": "long", "places": "array<int>", "items": "array<string>", "cut": "string"}
    return rows.select("row", *[F.lit(None).cast(t).alias(c) for c, t in kinds.items()]).schema


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, remove: str = "documents", n: int = N) -> DataFrame:
    """docs without the documents that hold a benchmark window, or (remove="spans") with the hit words cut out of their texts. Columns may have any names."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove is documents or spans")
    found = scan_documents(docs, benchmark, n=n, cut=remove == "spans")
    if remove == "documents":
        return found.where(F.size("places") == 0).select("row.*")
    return found.select(F.col("row").withField("text", F.coalesce("cut", F.col("row")["text"])).alias("row")).select("row.*")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = F.size("places").cast("long")
    return found.select("row.doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP6_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS MATERIALIZED (SELECT item_id::VARCHAR AS item, {_WORDS} AS w, row_number() OVER () AS bid FROM benchmark),
bw AS MATERIALIZED (SELECT DISTINCT item, least(10, len(w)) AS size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS MATERIALIZED (SELECT rid, i, size, array_to_string(w[i:i + size - 1], ' ') AS g FROM d, sizes, unnest(range(1, len(w) - size + 2)) u(i) WHERE len(w) >= size),
h AS MATERIALIZED (SELECT rid, i, dw.size, item FROM dw JOIN bw ON dw.g = bw.g AND dw.size = bw.size),
n AS (SELECT rid, count(DISTINCT i + k) AS n FROM h, unnest(range(0, size)) u(k) GROUP BY rid),
t AS (SELECT rid, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM h GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items, sha256(coalesce(t.s, '')) AS items_sha256, coalesce(n.n, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON d.rid = n.rid LEFT JOIN t ON d.rid = t.rid
"""
