"""Token-id files in Simple-8b word-aligned coding.

A file is Parquet, so that Spark's committers make it safe on any store and against lost executors; each row is a block of whole documents:
their ids and lengths, and the token ids in 64-bit words. The four high bits of a word select how many ids it holds and of how many bits.
Ids of 2**60 and more are escaped: the words hold 0 and the block lists place and value. A fresh word starts every GROUP ids and the
block lists these word offsets, so that groups decode with vector operations and can be reached on their own.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import new_path, settle, table, whole_text
from tidemark.llm.polyhash import mix

#: Fixed values of the coding: ids per word and bits per id, by selector.
PER_WORD = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
#: Bits per id of the narrowest selector that holds ids of so many bits.
_WIDTH = np.array([min((b for b in BITS.tolist() if b >= n), default=60) for n in range(62)])
GROUP, BLOCK = 1 << 14, 1 << 16
END = 2
BLOCKS = "shard int, block int, start long, doc_ids array<bigint>, lengths array<int>, words binary, offsets array<int>, escape_at array<int>, escape_ids array<bigint>"


def pack(ids: np.ndarray) -> tuple[bytes, list[int], list[int], list[int]]:
    """ids (uint64) as words, word offset of each group, places and values of escapes (as signed)."""
    ids = ids.astype(np.uint64)
    at = np.flatnonzero(ids >> np.uint64(60))
    held = ids
    if len(at):
        held = ids.copy()
        held[at] = 0
    # The exponent of a float is the number of bits; rounding only makes it larger where 60 bits are needed anyway.
    width = _WIDTH[np.frexp(held.astype(np.float64))[1]]
    words, heads = _pack_words(held, width)
    offsets = np.searchsorted(heads, np.arange(0, len(held), GROUP))
    return words.astype("<u8").tobytes(), offsets.tolist(), at.tolist(), ids[at].astype(np.int64).tolist()


def _pack_words(ids: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words, and the place of the first id of each. No word goes on into the next group."""
    n = len(ids)
    best, at, width = np.full(n, 15, np.int64), np.arange(n), width.astype(np.uint8)
    end = np.minimum(at // GROUP * GROUP + GROUP, n)
    for sel in range(14, -1, -1):
        # A selector of more and narrower ids fits only where that of fewer and wider ones does.
        at = at[at + PER_WORD[sel] <= end[at]]
        wide = np.concatenate([[0], np.cumsum(width > BITS[sel], dtype=np.int32)])
        at = at[wide[at + PER_WORD[sel]] == wide[at]]
        if not len(at):
            break
        best[at] = sel
    # Where words begin, from each word's length: 1, 2, 4, ... words ahead of every place, then all places that such jumps reach from the first.
    jumps = [np.append(np.arange(n) + PER_WORD[best], n)]
    while jumps[-1][0] < n:
        jumps.append(jumps[-1][jumps[-1]])
    heads = np.zeros(min(n, 1), np.int64)
    for jump in reversed(jumps):
        ahead = jump[heads]
        heads = np.concatenate([heads, ahead[ahead < n]])
    heads.sort()
    sels = best[heads]
    out = sels.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([ids, np.zeros(240, np.uint64)])
    for sel in np.unique(sels):
        if BITS[sel]:
            mine = np.flatnonzero(sels == sel)
            first, word = heads[mine], out[mine]
            for k in range(PER_WORD[sel]):
                word |= padded[first + k] << np.uint64(k * BITS[sel])
            out[mine] = word
    return out, heads


def unpack(words: bytes, n: int, offsets: list[int], escape_at: list[int], escape_ids: list[int]) -> np.ndarray:
    w = np.frombuffer(words, "<u8")
    out = np.zeros(n, np.uint64)
    for g, lo in enumerate(offsets):
        part = w[lo : offsets[g + 1] if g + 1 < len(offsets) else len(w)]
        sels = (part >> np.uint64(60)).astype(np.int64)
        heads = np.cumsum(PER_WORD[sels]) - PER_WORD[sels]
        ids = np.zeros(GROUP + 240, np.uint64)
        for sel in np.unique(sels):
            if BITS[sel]:
                mine = sels == sel
                for k in range(PER_WORD[sel]):
                    ids[heads[mine] + k] = part[mine] >> np.uint64(k * BITS[sel]) & np.uint64((1 << int(BITS[sel])) - 1)
        out[g * GROUP : (g + 1) * GROUP] = ids[: min(GROUP, n - g * GROUP)]
    out[escape_at] = np.array(escape_ids, np.int64).astype(np.uint64)
    return out


_LONG = 16
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class Encoder:
    """Token ids of whole texts by a tokenizer of the tokenizers library, each distinct word encoded once.

    The tokenizer's own pre-tokenizer never joins characters across white space, nor letters with the marks after them. So a text is
    the join of its white-space words, and a word of Latin-1 letters with marks behind is that of letters and marks. Texts with other
    spaces or control characters are encoded as they are. Each word is a pair of parts; words and parts are forgotten when there are WORDS or PARTS of them, which changes nothing but speed.

    Words are numbered all of some texts at a time: one of up to 16 bytes is two integers, by which it is found in a hash table of arrays; longer ones are looked up one by one."""

    WORDS, PARTS = 1_500_000, 1_200_000
    #: Letters and the marks after them, or anything else, a line each.
    CUT = re.compile(r"^(?:([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?*#%$&()-]*)|(.*))$", re.MULTILINE)
    ODD = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff]")

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True) + 1, bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.ends[i] = token.endswith("</w>")
        self.clear()

    def clear(self) -> None:
        """Forget all. Part 0 is empty."""
        self.parts = {"": 0}
        self.ids, self.starts = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64)
        self.clear_words()

    def clear_words(self) -> None:
        self.words, self.long = 0, {}
        self.low, self.high, self.pairs = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.uint64), np.zeros((1 << 16, 2), np.int32)
        self.table = np.full(1 << 18, -1, np.int32)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Numbers of short words, -1 for those not known."""
        slot = mix(low ^ mix(high)) & np.uint64(len(self.table) - 1)
        out, todo = np.full(len(low), -1, np.int32), np.arange(len(low))
        while len(todo):
            at = self.table[slot]
            same = (self.low[at] == low[todo]) & (self.high[at] == high[todo]) & (at >= 0)
            out[todo[same]] = at[same]
            on = ~same & (at >= 0)
            todo, slot = todo[on], (slot[on] + np.uint64(1)) & np.uint64(len(self.table) - 1)
        return out

    def enter(self, number: np.ndarray) -> None:
        """Put words into the table, each at the first free slot from its own."""
        slot = mix(self.low[number] ^ mix(self.high[number])) & np.uint64(len(self.table) - 1)
        while len(number):
            free = np.flatnonzero(self.table[slot] < 0)
            self.table[slot[free]] = number[free]
            on = self.table[slot] != number
            number, slot = number[on], (slot[on] + np.uint64(1)) & np.uint64(len(self.table) - 1)

    def number(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Number and start of every word of UTF-8 text. New ones are learnt."""
        raw = np.frombuffer(data + bytes(_LONG), np.uint8)
        space = (raw == 32) | (raw == 9) | (raw == 10) | (raw == 13) | (raw == 0)
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate([[0], edge])
        start, end = edge[::2], edge[1::2]
        size = end - start
        eight = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
        low, high = eight[start] & _MASKS[np.minimum(size, 8)], eight[start + 8 * (size > 8)] & _MASKS[np.clip(size - 8, 0, 8)]
        out, fresh = np.empty(len(start), np.int32), []
        long = np.flatnonzero(size > _LONG)
        short = np.flatnonzero(size <= _LONG)
        out[short] = self.find(low[short], high[short])
        new = short[out[short] < 0]
        if len(new):
            order = new[np.lexsort((high[new], low[new]))]
            first = np.concatenate([[True], (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])])
            kinds = order[first]
            self.room(len(kinds))
            number = self.words + np.arange(len(kinds), dtype=np.int32)
            out[order] = number[np.cumsum(first) - 1]
            self.low[number], self.high[number] = low[kinds], high[kinds]
            self.enter(number)
            fresh += [data[a:b].decode() for a, b in zip(start[kinds].tolist(), end[kinds].tolist())]
            self.words += len(kinds)
        for i, a, b in zip(long.tolist(), start[long].tolist(), end[long].tolist()):
            word = data[a:b]
            if (k := self.long.get(word)) is None:
                k = self.long[word] = self.words
                self.words += 1
                fresh.append(word.decode())
            out[i] = k
        if fresh:
            self.room(0)
            self.learn(fresh)
        return out, start

    def room(self, more: int) -> None:
        """Space for so many more words."""
        while self.words + more > len(self.low):
            self.low, self.high, self.pairs = (np.concatenate([x, np.zeros_like(x)]) for x in (self.low, self.high, self.pairs))
        if 2 * (self.words + more) > len(self.table):
            known = self.table[self.table >= 0]
            self.table = np.full(4 * len(self.table), -1, np.int32)
            self.enter(known)

    def direct(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def add(self, names: list[str], sizes: list[int], flat: np.ndarray | list[int]) -> None:
        """Parts, how many ids each has, and the ids."""
        n, end = len(self.parts), int(self.starts[len(self.parts)]) + len(flat)
        while end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(sizes) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.ids[end - len(flat) : end] = flat
        self.starts[n + 1 : n + 1 + len(sizes)] = self.starts[n] + np.cumsum(np.array(sizes, np.int64))
        self.parts.update(zip(names, range(n, n + len(sizes))))

    def learn(self, fresh: list[str]) -> None:
        """The parts of new words, which have the last numbers."""
        letters, marks, other = (list(x) for x in zip(*self.CUT.findall("\n".join(fresh))))
        letters = "\n".join(letters).lower().split("\n")
        known = self.parts
        plain = set(letters).difference(known)
        # ASCII letters pass normaliser and pre-tokenizer unchanged, so the model alone gives their ids.
        simple, tokenize = [x for x in plain if x.isascii()], self.tokenizer.model.tokenize
        sizes, flat = [], []
        for x in simple:
            found = tokenize(x)
            sizes.append(len(found))
            flat += [t.id for t in found]
        self.add(simple, sizes, flat)
        rest = [x for x in plain if not x.isascii()]
        for lo in range(0, len(rest), 1000):
            some = rest[lo : lo + 1000]
            ids = np.array(self.direct([" ".join(some)])[0], np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(some):
                self.add(some, np.diff(ends, prepend=0).tolist(), ids)
            else:
                each = self.direct(some)
                self.add(some, [len(x) for x in each], [i for x in each for i in x])
        rest = list((set(marks) | set(other)).difference(known))
        each = self.direct(rest)
        self.add(rest, [len(x) for x in each], [i for x in each for i in x])
        # A word is letters and marks, or it is other; what is empty is part 0.
        mine = slice(self.words - len(fresh), self.words)
        self.pairs[mine, 0] = np.fromiter(map(known.__getitem__, letters), np.int32, len(letters)) + np.fromiter(map(known.__getitem__, other), np.int32, len(other))
        self.pairs[mine, 1] = np.fromiter(map(known.__getitem__, marks), np.int32, len(marks))

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.parts) > self.PARTS:
            self.clear()
        if self.words > self.WORDS:
            self.clear_words()
        odd = [bool(self.ODD.search(t)) for t in texts]
        plain = [t.encode() for t, o in zip(texts, odd) if not o]
        others = iter(self.direct([t for t, o in zip(texts, odd) if o]))
        numbers, start = self.number(b"\n".join(plain))
        at = self.pairs[numbers].ravel()
        size = self.starts[at + 1] - self.starts[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.arange(ends[-1]) + np.repeat(self.starts[at] - ends[:-1], size)]
        # Where texts begin among the words, and so among the ids.
        bounds = np.cumsum([0] + [len(t) + 1 for t in plain])
        cuts = ends[2 * np.searchsorted(start, bounds)].tolist()
        each = iter([ids[a:b] for a, b in zip(cuts, cuts[1:])])
        return [np.array(next(others), np.uint32) if o else next(each) for o in odd]


_encoders: dict[str, Encoder] = {}


def _write_blocks(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    encode = _encoders[path] = _encoders.get(path) or Encoder(path)
    shard, block, start = TaskContext.get().partitionId(), 0, 0
    keys: list = []
    held: list[np.ndarray] = []
    size = 0

    def row() -> pa.RecordBatch:
        ids = np.concatenate(held)
        words, offsets, at, values = pack(ids)
        cells = ([shard], [block], [start], [keys], [[len(x) for x in held]], [words], [offsets], [at], [values])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, _BLOCK_TYPES)], names=_BLOCK_NAMES)

    for batch in batches:
        texts = batch.column("text").to_pylist()
        for lo in range(0, len(texts), 256):
            for key, ids in zip(batch.column("doc_id")[lo : lo + 256].to_pylist(), encode(texts[lo : lo + 256])):
                keys.append(key)
                held.append(np.append(ids, np.uint32(END)))
                size += len(held[-1])
                if size >= BLOCK:
                    yield row()
                    block, start = block + 1, start + size
                    keys, held, size = [], [], 0
    if held:
        yield row()


_BLOCK_NAMES = [x.split()[0] for x in BLOCKS.split(", ")]
_BLOCK_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]


def write_token_files(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Encode every whole text (null: empty), add END to each document, and write the ids in ascending order of doc_id (null first; equal ids by text hash), a file a partition.

    Texts are range-partitioned first and encoded after, in order, so each text is shuffled once and encoded once. An empty table writes no blocks; extra columns are ignored."""
    rows = docs.select("doc_id", whole_text("text").alias("text")).withColumn("_h", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h").select("doc_id", "text")
    ordered.mapInArrow(lambda batches: _write_blocks(tokenizer, batches), BLOCKS).write.parquet(path)


def _read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            ids = unpack(r["words"], sum(r["lengths"]), r["offsets"], r["escape_at"], r["escape_ids"]).astype("<u4")
            ends = np.cumsum(r["lengths"])
            crc = [zlib.crc32(x.tobytes()) for x in np.split(ids, ends[:-1])]
            cells = (r["doc_ids"], (ends - r["lengths"] + r["start"] + r["base"]).tolist(), r["lengths"], crc)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cells], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from the files. The running total is over one row a file; within a file blocks know their own start."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    sums = blocks.select("shard", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    # Written, so that Spark knows its size: up to spark.sql.autoBroadcastJoinThreshold it is broadcast and the words stay where they are read.
    base = settle(sums.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base")), "token-bases")
    return blocks.join(base, "shard").mapInArrow(_read_blocks, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(spark, path)
