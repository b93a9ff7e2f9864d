"""Collocations against DuckDB and brute force, with ranges that end within words and phrases."""

import random
import re
import sys
from collections import Counter

import duckdb
import numpy as np
import pytest

from tidemark.llm import collocations

DOCS = "doc_id long, text string, lang string, head string, n int"


def corpus():
    R = random.Random(2)
    words = ["the", "of", "New", "york", "\x01", "a\x01", "é", "ß-x", "the's", "z"]
    rows = []
    for i in range(120):
        text = "".join(R.choices(words, [9, 6, 3, 3, 1, 1, 2, 1, 1, 2])[0] + R.choices([" ", "\t", "  ", ". ", "\n", "!?", " ,"], [12, 2, 1, 1, 1, 1, 1])[0] for _ in range(R.randint(1, 80)))
        rows.append((i, text, R.choice(["en", "en", "fr", None, "und", "x\ty"]), "h", 1))
    rows += [(200, "new york city " * 30, "en", None, None), (201, None, "en", "", 0), (202, "", None, "", 0), (203, " .\t.", "de", "", 0), (None, "The Of the OF", "en", "", 0), rows[0], rows[0]]
    return rows


def slow(rows, least, top, share):
    counts, out = {}, []
    for _, text, lang, *_ in rows:
        c = counts.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            c.update(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    for lang, c in counts.items():
        n, found = sum(f for g, f in c.items() if len(g) == 1), []
        frequent = {g: f for g, f in c.items() if len(g) > 1 and f >= least}
        for g, a in frequent.items():
            if any(len(h) > len(g) and g in (h[:2], h[1:]) and 100 * f >= share * a for h, f in frequent.items()):
                continue
            score, _, l, r = min((1_000_000 * a * a // (c[g[:k]] * c[g[k:]]), k, c[g[:k]], c[g[k:]]) for k in range(1, len(g)))  # noqa: E741
            found.append((-score, -a, " ".join(g).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]  # noqa: E741
    return sorted(out)


@pytest.mark.parametrize(("parts", "batch", "block"), [(4, 10_000, 1 << 20), (40, 3, 200), (300, 10_000, 1)])
def test_ranges_end_anywhere(spark, monkeypatch, parts, batch, block):
    """Forty and more ranges over a few hundred phrases end within the phrases of a word and of two words."""
    monkeypatch.setattr(collocations, "BLOCK", block)
    docs = spark.createDataFrame(corpus(), DOCS).repartition(3)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        for least, top, share in ((2, 2000, 50), (1, 7, 80)) if parts < 300 else ((2, 2000, 50),):
            got = collocations.collocations(docs, least=least, top=top, share=share)
            assert sorted(map(tuple, got.collect())) == slow(corpus(), least, top, share)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("numbers", [1 << 63, 1])
def test_blocks_equal_counting(monkeypatch, numbers):
    """White space of any kind and place, with phrases as one number and as numbers of numbers."""
    monkeypatch.setattr(collocations, "NUMBERS", numbers)
    R, every = random.Random(4), np.full(1 << 13, 255, np.uint8)
    for _ in range(60):
        texts = ["".join(R.choices(["a", "B", "é", "\x1c", "\x1f", "\x85", "\xa0", "\0", *"  \t\t.,\n\x0b\x0c\r"], k=R.randint(0, 80))) for _ in range(R.randint(1, 4))]
        want = Counter()
        for text in texts:
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", text.replace("B", "b")):
                w = re.findall(r"[^\x20\x09]+", piece)
                want.update(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
        block = collocations.Block()
        assert sum(block.add(t) for t in texts) >= sum(f for g, f in want.items() if len(g) == 1)
        got = [tuple(r.values()) for k in (1, 2, 3) for r in block.counts("en", k, None if k == 1 else every).to_pylist()]
        assert [(g[0].removesuffix("\ten"), *g[1:-1], g[-1]) for g in got] == [(*g, f) for k in (1, 2, 3) for g, f in sorted((x for x in want.items() if len(x[0]) == k), key=lambda x: [w.encode() for w in x[0]])]


def test_blocks_hold_no_object_of_a_word():
    """Python objects a word, made and looked up three times, took most of a task's time."""
    texts = [" ".join(f"w{i}-{k}" for k in range(1000)) for i in range(20)]
    block = collocations.Block()
    before = sys.getallocatedblocks()
    assert sum(block.add(t) for t in texts) >= 20_000
    assert sys.getallocatedblocks() - before < 2000


def test_scores_pass_64_bits(spark):
    a, l, r = 4_000_000_000_003, 5_000_000_000_009, 6_000_000_000_011  # noqa: E741
    row = ("x\ten", "y", "", a, l, None, r, None)
    got = collocations.scored(spark.createDataFrame([row], "head string, second string, third string, f long, one long, two long, one_ long, two_ long"))
    assert got.first().score == 1_000_000 * a * a // (l * r)


def test_collocations_equal_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    got = collocations.op11_collocations(spark, "/root/testdata/sf0.01")
    want = con.execute(collocations.OP11_SQL)
    assert got.columns == [c[0] for c in want.description]
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(want.fetchall()) and any(" " in r[2] and r[2].count(" ") == 2 for r in rows)
