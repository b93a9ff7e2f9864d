"""Runs of repeated words by a suffix automaton with link-cut access.

A run is a stretch of words with a smallest period q (words q apart are equal) and at least MIN_WORDS and MIN_TIMES * q words, which no neighbouring word extends.

Words are appended to a suffix automaton whose suffix links are kept as a link-cut tree. Every preferred path of that tree has one colour: the place at which the strings of its
states last ended. Appending word r accesses the state of the whole prefix, which recolours the path to the root with r. Each segment of another colour t that the
path takes over says that the longest string of its lowest state, of hi words, ended at t before it ends at r: the hi + (r - t) words that end at r have
period r - t. With hi of at least r - t that is a square, with more a run; what a later word adds only moves its end. All accesses together take over O(n log n) segments.

Text that can't be in a run never reaches the automaton: every word of a run is in a window of WINDOW words that occurs twice in the stretch of such words around it.
Windows are compared by hashes there, so that a collision only lets more words through."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table, whole_text
from tidemark.llm.polyhash import mix

MIN_WORDS, MIN_TIMES = 24, 3
WINDOW = 8


class LastEnds:
    """The suffix automaton of the words appended so far, each state knowing where its strings last ended. State 1 is the empty string's; 0 is none."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}, {}]
        self.link, self.length = [0, 0], [0, 0]
        # The link-cut tree: splay trees over preferred paths, upper states to the left; colours stand at the roots of these.
        self.left, self.right, self.up, self.colour = [0, 0], [0, 0], [0, 0], [-1, -1]
        self.whole = 1

    def _state(self, length: int, after: dict[int, int]) -> int:
        for column, x in ((self.next, after), (self.link, 0), (self.length, length), (self.left, 0), (self.right, 0), (self.up, 0), (self.colour, -1)):
            column.append(x)
        return len(self.length) - 1

    def _splay(self, x: int) -> None:
        left, right, up, colour = self.left, self.right, self.up, self.colour
        while True:
            p = up[x]
            if not p:
                return
            if left[p] == x:
                x_left = True
            elif right[p] == x:
                x_left = False
            else:
                return
            g = up[p]
            if g and (left[g] == p or right[g] == p):
                # The parent first if both lean the same way, else x twice.
                turns = (p, x) if (left[g] == p) == x_left else (x, x)
            else:
                turns = (x,)
            for y in turns:
                q = up[y]
                h = up[q]
                if left[q] == y:
                    c = left[q] = right[y]
                    right[y] = q
                else:
                    c = right[q] = left[y]
                    left[y] = q
                if c:
                    up[c] = q
                if h and left[h] == q:
                    left[h] = y
                elif h and right[h] == q:
                    right[h] = y
                else:
                    colour[y] = colour[q]
                up[y], up[q] = h, y

    def append(self, word: int, at: int) -> list[tuple[int, int]]:
        """(t, hi) of each segment taken over: the suffix of hi words, and none longer, last ended at t."""
        following, link, length, left, right, up, colour = self.next, self.link, self.length, self.left, self.right, self.up, self.colour
        new = self._state(length[self.whole] + 1, {})
        p = self.whole
        while p and word not in following[p]:
            following[p][word] = new
            p = link[p]
        if not p:
            link[new] = 1
        else:
            q = following[p][word]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                # q's shorter strings get a state of their own, just above it on its preferred path.
                clone = self._state(length[p] + 1, dict(following[q]))
                self._splay(q)
                above = left[q]
                left[clone], left[q], up[clone] = above, clone, q
                if above:
                    up[above] = clone
                link[clone], link[q] = link[q], clone
                while p and following[p].get(word) == q:
                    following[p][word] = clone
                    p = link[p]
                link[new] = clone
        up[new] = link[new]
        self.whole = new
        found, below, x = [], new, link[new]
        while x:
            self._splay(x)
            if length[x]:
                found.append((colour[x], length[x]))
            if right[x]:
                colour[right[x]] = colour[x]
            right[x] = below
            below, x = x, up[x]
        colour[below] = at
        return found


def runs_within(ids: list[int], min_words: int = MIN_WORDS, min_times: int = MIN_TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence, by start and period."""
    ends, known = {}, LastEnds()
    for r, word in enumerate(ids):
        for t, hi in known.append(word, r):
            period = r - t
            if hi >= (min_times - 1) * period and hi + period >= min_words:
                ends[r - hi - period + 1, period] = r
    return sorted((start, end - start + 1, period) for (start, period), end in ends.items())


def stretches(ids: np.ndarray, window: int = WINDOW, least: int = MIN_WORDS) -> list[tuple[int, int]]:
    """Bounds of the stretches that may hold runs: all of their words are in windows that occur twice in the same stretch."""
    n = len(ids) - window + 1
    if len(ids) < least:
        return []
    h = mix(ids.astype(np.uint64) + np.uint64(1))
    size = 1
    while size < window:
        h = mix(h[:-size] * np.uint64(3) + h[size:])
        size *= 2
    bounds = [(0, len(ids))]
    while bounds:
        live, part = np.zeros(n, bool), np.zeros(n, np.uint64)
        for k, (lo, hi) in enumerate(bounds):
            live[lo : hi - window + 1] = True
            part[lo : hi - window + 1] = k
        at = np.flatnonzero(live)
        v = mix(h[at] + mix(part[at]))
        order = np.argsort(v, kind="stable")
        same = v[order][1:] == v[order][:-1]
        twice = at[order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]]
        turns = np.zeros(len(ids) + 1, np.int64)
        np.add.at(turns, twice, 1)
        np.add.at(turns, twice + window, -1)
        covered = np.concatenate([[False], np.cumsum(turns)[:-1] > 0, [False]])
        edges = np.flatnonzero(covered[1:] != covered[:-1])
        found = [(lo, hi) for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist()) if hi - lo >= least]
        if found == bounds:
            return bounds
        bounds = found
    return bounds


def runs_of(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a text's words, by start and period."""
    if len(words) < MIN_WORDS:
        return []
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    return [(lo + start, length, period) for lo, hi in stretches(ids) for start, length, period in runs_within(ids[lo:hi].tolist())]


def without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    turns = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        turns[start + period] += 1
        turns[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(turns)[:-1] == 0).tolist()]


RUN = "struct<start:bigint,length:bigint,period:bigint>"


def find_runs(docs: DataFrame, *, key: str = "doc_id", text: str = "text", prepare: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """key, n_words, runs (array of start, length, period, by start and period), best (the run of greatest length / period, the first of these; null: no runs) and collapsed (the text's words,
    joined by one space, without those that a run contains after its first period) of every row.

    Null and empty texts have no words; rows of equal key are each their own; a text is one row's work, in memory of some 500 bytes for each word that may be in a run. Columns other than key and
    text are left out, whatever their names. An empty table gives no rows. prepare(key, words) may give other words to look at."""
    rows = docs.select(F.col(f"`{key}`").alias("key"), whole_text(F.col(f"`{text}`")).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    run = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
    named = lambda r: dict(zip(("start", "length", "period"), r))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, runs, best, left = [], [], [], []
            for k, t in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                words = t.encode().split()
                words = prepare(k, words) if prepare else words
                mine = runs_of(words)
                counts.append(len(words))
                runs.append([named(r) for r in mine])
                best.append(named(max(mine, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))) if mine else None)
                left.append(b" ".join(without_repeats(words, mine)).decode())
            cells = [pa.array(counts, pa.int64()), pa.array(runs, pa.list_(run)), pa.array(best, run), pa.array(left, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *cells], names=["key", "n_words", "runs", "best", "collapsed"])

    return rows.mapInArrow(found, f"key {kind}, n_words long, runs array<{RUN}>, best {RUN}, collapsed string").withColumnRenamed("key", key)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The query's own repeats: of one document in ten, by the checksum of its id, the words from a place on are those of one period over and over. A null id plants none."""
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(table(spark, sf_dir, "documents"), prepare=planted)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = [F.col("best")[c].alias(c) for c in ("start", "length", "period")]
    exponent = F.expr("1000 * best.length div best.period").cast("long").alias("exponent_milli")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *best, exponent, F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
