"""Phrase collocation mining over sorted count streams.

Phrases of one, two and three words are counted one length after the other. Tasks sort and sum blocks of text, and only what can be frequent leaves them: both phrases inside it that are a word shorter must be frequent,
as a filter of fixed size says, which may let others through but holds none back. The counts are then exact sums of what came through.

The frequent phrases make two streams: prefix order (first word, second, third) and suffix order (last word, the one before, the first), each dealt by ranges and sorted within them. There a phrase stands
right before those that it begins (ends), so one scan in lockstep over the three lengths gives every phrase the counts of its first one and two words (last one and two), and every phrase of two words
the largest count of a phrase that extends it to the right (left). Both streams are merged on the phrase. No count is looked up by hash, and no range is bound to a word: where a range
ends within a word or phrase, the few counts that the next range needs are passed on as rows, three a range at most."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import discard, passing, settle, table, whole_text
from tidemark.llm.polyhash import mix

LEAST, TOP = 10, 2000
#: A phrase goes if one that holds it has this share of its count, in hundredths.
SHARE = 50
#: Words in a sorted block, about, and rows of one batch.
BLOCK, ROWS = 1 << 20, 1 << 16
#: Above the numbers that stand for a phrase.
NUMBERS = 1 << 63
#: Bits of a filter for each phrase, and of all at least and at most (16 MB).
BITS, FILTER = 16, (1 << 16, 1 << 27)
#: A-Z in lower case; the ends of pieces all as a full stop, which then is in no word.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else 46 if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))
GRAM = ("head", "second", "third")


def word_hashes(words: Iterable[bytes], lang: str) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(xxhash.xxh32_intdigest(lang.encode()))), np.uint64)


def phrase_hashes(words: list[np.ndarray]) -> np.ndarray:
    """Of phrases whose first, second and further words have these hashes."""
    h = mix(words[0])
    for w in words[1:]:
        h = mix(h * np.uint64(3) + w)
    return h


def bits_of(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash in a filter of size bits."""
    return h & np.uint64(size - 1), (h >> np.uint64(32)) & np.uint64(size - 1)


class Block:
    """Words of one language."""

    def __init__(self):
        self.texts: list[bytes] = []

    def add(self, text: str) -> int:
        """How many words it has, at most."""
        self.texts.append(text.encode().translate(_NORMAL).replace(b".", b" . ") + b" . .")
        return self.texts[-1].count(b" ") + self.texts[-1].count(b"\t")

    def numbered(self) -> tuple[pa.Array, np.ndarray]:
        """The words in order, and for each place the number of its word from 1, or 0 between pieces."""
        coded = pc.list_flatten(pc.ascii_split_whitespace(pa.array(self.texts, pa.large_string()))).dictionary_encode()
        at, found = np.asarray(coded.indices), coded.dictionary
        # White space at a text's beginning leaves an empty word.
        stop, empty = (pc.index(found, w).as_py() for w in (".", ""))
        if empty >= 0:
            at = at[at != empty]
        order = np.asarray(pc.array_sort_indices(found)).astype(np.int64)
        order = order[(order != stop) & (order != empty)]
        rank = np.zeros(len(found), np.int64)
        rank[order] = np.arange(1, len(order) + 1)
        return found.take(pa.array(order)), rank[at]

    def counts(self, lang: str, size: int, known: np.ndarray | None) -> pa.Table:
        """head (first word, tab, language) and further words, n of the phrases of size words, in order. known: the filter of those a word shorter."""
        words, at = self.numbered()
        parts = [at[i : len(at) - 2 + i] for i in range(size)]
        whole = np.logical_and.reduce([p > 0 for p in parts])
        parts = [p[whole] for p in parts]
        if known is not None:
            own = np.concatenate([np.zeros(1, np.uint64), word_hashes(words.cast(pa.large_binary()).to_numpy(zero_copy_only=False), lang)])
            for inner in (slice(None, -1), slice(1, None)):
                h = phrase_hashes([own[p] for p in parts[inner]])
                told = [known[b >> np.uint64(3)] >> (b & np.uint64(7)).astype(np.uint8) & 1 for b in bits_of(h, 8 * len(known))]
                kept = (told[0] & told[1]).astype(bool)
                parts = [p[kept] for p in parts]
        base = len(words) + 1
        if base**size <= NUMBERS:
            # All words of a phrase make one number.
            gram = parts[0]
            for p in parts[1:]:
                gram = gram * base + p
            values, n = np.unique(gram, return_counts=True)
            found = []
            for _ in range(size):
                values, last = np.divmod(values, base)
                found.insert(0, last)
        else:
            # The words so far make one number and that with the next word another, whatever the number of words.
            found, gram = [], np.zeros(len(parts[0]), np.int64)
            for p in parts:
                values, gram, n = np.unique(gram * base + p, return_inverse=True, return_counts=True)
                found = [f[values // base] for f in found] + [values % base]
        heads = pc.binary_join_element_wise(words, pa.scalar(lang, pa.large_string()), pa.scalar("\t", pa.large_string()))
        columns = [texts.take(pa.array(f - 1)).cast(pa.string()) for texts, f in zip((heads, words, words), found)]
        return pa.table([*columns, pa.array(n.astype(np.int32))], names=[*GRAM[:size], "n"])


def counts(docs: DataFrame, size: int, known: Broadcast | None = None) -> DataFrame:
    """head, second, third, f of the phrases of size words, of which those that a word shorter isn't in known may be left out. docs: lang, text."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, held = defaultdict(Block), 0
        bits = None if known is None else np.frombuffer(known.value, np.uint8)

        def summed() -> Iterator[pa.RecordBatch]:
            for lang, block in blocks.items():
                yield from block.counts(lang, size, bits).to_batches(ROWS)

        for batch in batches:
            # One text at a time is held as Python's.
            for lang, text in zip(batch.column("lang"), batch.column("text")):
                held += blocks[lang.as_py()].add(text.as_py())
                if held >= BLOCK:
                    yield from summed()
                    blocks, held = defaultdict(Block), 0
        yield from summed()

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), whole_text("text").alias("text")).mapInArrow(counted, ", ".join(f"{c} string" for c in GRAM[:size]) + ", n int")
    summed = rows.groupBy(*GRAM[:size]).agg(F.sum("n").alias("f"))
    return summed.select(*[F.col(c) if c in GRAM[:size] else F.lit("").alias(c) for c in GRAM], "f")


def filter_of(grams: DataFrame) -> bytes:
    """A bitmap in which both bits of every phrase are set: BITS for each, but no more than the most of FILTER, beyond which it lets more through."""
    least, most = FILTER
    size = min(max(least, 1 << max(0, BITS * grams.count() - 1).bit_length()), most)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, bool)
        for batch in batches:
            words, langs = [], []
            for head in batch.column("head").to_pylist():
                word, _, lang = head.partition("\t")
                words.append(word.encode())
                langs.append(lang)
            further = [[w.encode() for w in batch.column(c).to_pylist()] for c in GRAM[1:]]
            if not words:
                continue
            used = [words, *(f for f in further if f[0])]
            one = {lang: xxhash.xxh32_intdigest(lang.encode()) for lang in set(langs)}
            hashes = [np.fromiter((xxhash.xxh64_intdigest(w, one[x]) for w, x in zip(ws, langs)), np.uint64, len(ws)) for ws in used]
            for b in bits_of(phrase_hashes(hashes), size):
                held[b.astype(np.int64)] = True
        packed = np.packbits(held, bitorder="little").view("<i8")
        at = np.flatnonzero(packed)
        for lo in range(0, len(at), ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(at[lo : lo + ROWS]), pa.array(packed[at[lo : lo + ROWS]])], names=["place", "bits"])

    # At most a row for 64 bits of the largest filter: 2,097,152.
    rows = grams.select(*GRAM).mapInArrow(bits, "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size // 64, "<i8")
    out[np.asarray(rows["place"])] = np.asarray(rows["bits"])
    return out.tobytes()


def in_order(stream: DataFrame) -> DataFrame:
    """The stream dealt by ranges of (head, second, third) and sorted within them."""
    parts = int(stream.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stream.repartitionByRange(parts, *GRAM).sortWithinPartitions(*GRAM)


def _rows(batch: pa.RecordBatch, at: np.ndarray, k: int) -> list[pa.Array]:
    """The first k + 1 words of the rows at places, the others empty."""
    return [batch.column(name).take(pa.array(at)) if i <= k else pa.array([""] * len(at), pa.string()) for i, name in enumerate(GRAM)]


def frequent(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """head, second, third, f of the phrases of one to three words (the others empty) with f >= least, and lang, n: how many words each language has."""
    words = settle(counts(docs, 1), "words")
    total = settle(words.groupBy(F.expr("substr(head, instr(head, '\t') + 1)").alias("lang")).agg(F.sum("f").alias("n")), "words-of-languages")
    found = [settle(words.where(F.col("f") >= least), "frequent-phrases")]
    discard(words)
    for size in (2, 3):
        known = docs.sparkSession.sparkContext.broadcast(filter_of(found[-1]))
        found.append(settle(counts(docs, size, known).where(F.col("f") >= least), "frequent-phrases"))
        known.unpersist()
    return found[0].union(found[1]).union(found[2]), total


CONTEXT = "kind int, head string, second string, third string, f long, one long, two long, longer long"


def in_context(grams: DataFrame, name: str) -> DataFrame:
    """Of the phrases of two and three words in a stream: head, second, third, f, one and two (counts of their first one and two words), longer (the largest count of a phrase of three words
    that begins with one of two; 0: none)."""
    names = ["kind", *GRAM, "f", "one", "two", "longer"]

    def batch_of(kind, words, f, one, two, longer) -> pa.RecordBatch:
        numbers = [pa.array(x, pa.int64(), mask=m) for x, m in (f, one, two, longer)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(f[0]), kind, np.int32)), *words, *numbers], names=names)

    def single(kind: int, head: str, second: str, f: int | None, one: int | None, longer: int) -> pa.RecordBatch:
        cells = zip((kind, head, second, "", f, one, None, longer), (pa.int32(), *[pa.string()] * 3, *[pa.int64()] * 4))
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in cells], names=names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last phrase of one word; that of two words, which waits for those that it begins; and what came before any of two.
        word = pair = lead = None
        for batch in batches:
            if not batch.num_rows:
                continue
            f = np.asarray(batch.column("f"))
            has2, has3 = (np.asarray(pc.not_equal(batch.column(c), "")) for c in GRAM[1:])
            place = np.arange(len(f))
            at1 = np.maximum.accumulate(np.where(has2, -1, place))
            at2 = np.maximum.accumulate(np.where(has2 & ~has3, place, -1))
            one = np.where(at1 >= 0, f[at1], word[1] if word else 0)
            two = np.where(at2 >= 0, f[at2], pair["f"] if pair else 0)
            no_one, no_two = (at1 < 0) & (word is None), (at2 < 0) & (pair is None)
            # Phrases of three words after each other phrase, those at the beginning of the batch under -1.
            cuts = np.flatnonzero(~has3)
            longest = np.maximum.reduceat(np.where(has3, f, 0), cuts) if len(cuts) else cuts
            early = int(f[: cuts[0] if len(cuts) else len(f)].max(initial=0))
            if early and pair:
                pair["longer"] = max(pair["longer"], early)
            elif early:
                lead = (batch.column("head")[0].as_py(), batch.column("second")[0].as_py(), max(early, lead[2] if lead else 0))
            threes = np.flatnonzero(has3)
            if len(threes):
                yield batch_of(0, _rows(batch, threes, 2), (f[threes], None), (one[threes], no_one[threes]), (two[threes], no_two[threes]), (np.zeros(len(threes), np.int64), None))
            if len(cuts):
                if pair:
                    yield single(0, pair["head"], pair["second"], pair["f"], pair["one"], pair["longer"])
                    pair = None
                pairs = has2[cuts]
                told, of = cuts[pairs], longest[pairs]
                # The last phrase of two words waits.
                if len(told):
                    first, last = told[:-1], int(told[-1])
                    yield batch_of(0, _rows(batch, first, 1), (f[first], None), (one[first], no_one[first]), (f[first], np.ones(len(first), bool)), (of[:-1], None))
                    pair = {"head": batch.column("head")[last].as_py(), "second": batch.column("second")[last].as_py(), "f": int(f[last]), "one": None if no_one[last] else int(one[last]), "longer": int(of[-1])}
                ones = cuts[~pairs]
                if len(ones):
                    word = (batch.column("head")[int(ones[-1])].as_py(), int(f[ones[-1]]))
        if pair:
            yield single(0, pair["head"], pair["second"], pair["f"], pair["one"], pair["longer"])
            yield single(2, pair["head"], pair["second"], pair["f"], None, 0)
        if word:
            yield single(1, word[0], "", word[1], None, 0)
        if lead:
            yield single(3, lead[0], lead[1], None, None, lead[2])

    rows = settle(in_order(grams).mapInArrow(scan, CONTEXT), name)
    # What ranges pass on: three rows each at most, so these tables have a bound whatever the corpus.
    ones = F.broadcast(rows.where("kind = 1").select("head", F.col("f").alias("one_")))
    twos = F.broadcast(rows.where("kind = 2").select("head", "second", F.col("f").alias("two_")))
    leads = F.broadcast(rows.where("kind = 3").groupBy("head", "second").agg(F.max("longer").alias("longer_")))
    found = rows.where("kind = 0").join(ones, "head", "left").join(twos, ["head", "second"], "left").join(leads, ["head", "second"], "left")
    longer = F.when(F.col("third") == "", F.greatest("longer", F.coalesce("longer_", F.lit(0))))
    return found.select(*GRAM, "f", F.coalesce("one", "one_").alias("one"), F.coalesce("two", "two_").alias("two"), longer.alias("longer"))


def backwards(grams: DataFrame) -> DataFrame:
    """The phrases with their words turned round; turned twice they are as before."""
    words = F.array_remove(F.array(F.substring_index("head", "\t", 1), "second", "third"), "")
    lang = F.expr("substr(head, instr(head, '\t') + 1)")
    rest = [c for c in grams.columns if c not in GRAM]
    turned = grams.select(F.reverse(words).alias("w"), lang.alias("lang"), *rest)
    word = lambda i: F.coalesce(F.get("w", F.lit(i)), F.lit(""))
    return turned.select(F.concat(word(0), F.lit("\t"), "lang").alias("head"), word(1).alias("second"), word(2).alias("third"), *rest)


def scored(phrases: DataFrame) -> DataFrame:
    """head, second, third, a, l, r, score of the cut with the lowest score (the first of equal ones). phrases: the counts at both cuts."""
    exact = "CAST(1000000 AS DECIMAL(7,0)) * (CAST(f AS DECIMAL(15,0)) * CAST(f AS DECIMAL(15,0))) div (CAST({l} AS DECIMAL(15,0)) * CAST({r} AS DECIMAL(15,0)))"
    cut = lambda l, r: F.struct(F.expr(exact.format(l=l, r=r)).alias("score"), F.col(l).alias("l"), F.col(r).alias("r"))  # noqa: E731, E741
    two = phrases.where("third = ''").select(*GRAM, "f", cut("one", "one_").alias("c"))
    three = phrases.where("third <> ''").select(*GRAM, "f", cut("one", "two_").alias("c"), cut("two", "one_").alias("d")).select(*GRAM, "f", F.when(F.col("d.score") < F.col("c.score"), F.col("d")).otherwise(F.col("c")).alias("c"))
    return two.union(three).select(*GRAM, F.col("f").alias("a"), "c.l", "c.r", "c.score")


def collocations(docs: DataFrame, *, least: int = LEAST, top: int = TOP, share: int = SHARE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: of each language the first `top` phrases of two and three words that occur `least` times or more and stand for themselves.

    docs: lang (null: und), text (null: empty), other columns of any names. Repeated rows count as often as they occur; pieces never meet; texts of any length are counted whole, in blocks. A language without
    such phrases and an empty table give no rows."""
    spark = docs.sparkSession
    with passing(spark):
        grams, total = frequent(docs, least)
        right = in_context(grams, "prefix-order")
        left = backwards(in_context(backwards(grams), "suffix-order")).select(*GRAM, F.col("one").alias("one_"), F.col("two").alias("two_"), F.col("longer").alias("longer_"))
        both = right.join(left.hint("merge"), [*GRAM])
        kept = scored(both.where((F.col("third") != "") | (100 * F.greatest("longer", "longer_") < share * F.col("f"))))
        rows = kept.select(F.expr("substr(head, instr(head, '\t') + 1)").alias("lang"), F.concat_ws(" ", F.substring_index("head", "\t", 1), "second", F.when(F.col("third") != "", F.col("third"))).alias("phrase"), "a", "l", "r", "score")
        # First among a part of a language's phrases, then among the firsts of the parts, so that no task ranks all.
        order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
        part = F.pmod(F.xxhash64("phrase"), F.lit(64))
        firsts = rows.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
        ranked = firsts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
        return settle(ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations", keep=True)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = rf"""
WITH p AS MATERIALIZED (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(x, '[^\x20\x09]+') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS x FROM documents)),
g AS MATERIALIZED (SELECT lang, w[i:i + k - 1] AS g, count(*) AS f FROM p, unnest([1, 2, 3]) s(k), unnest(range(1, len(w) - k + 2)) u(i) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE len(g) = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT * FROM g WHERE len(g) > 1 AND f >= {LEAST}),
cuts AS (SELECT c.lang, c.g, c.f AS a, k, x.f AS l, y.f AS r, ((1000000::HUGEINT * c.f * c.f) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM c, unnest(range(1, len(c.g))) u(k) JOIN g x ON x.lang = c.lang AND x.g = c.g[1:k] JOIN g y ON y.lang = c.lang AND y.g = c.g[k + 1:]),
best AS (SELECT lang, g, any_value(a) AS a, arg_min(l, score * 10 + k) AS l, arg_min(r, score * 10 + k) AS r, min(score) AS score FROM cuts GROUP BY lang, g),
inside AS (SELECT DISTINCT b.lang, b.g FROM best b JOIN (SELECT lang, g, f, unnest([g[1:2], g[2:3]]) AS part FROM c WHERE len(g) = 3) t ON t.lang = b.lang AND t.part = b.g AND 100 * t.f >= {SHARE} * b.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score
  FROM (SELECT *, array_to_string(g, ' ') AS phrase FROM best ANTI JOIN inside USING (lang, g))) JOIN n USING (lang) WHERE rank <= {TOP}
"""
