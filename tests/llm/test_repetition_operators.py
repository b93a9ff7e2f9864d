"""SimHash components and periodic runs against brute force, with nulls, empty and long texts, ties, repeated rows and clashing column names."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import periodic, simhash

DOCS = "doc_id long, text string, lang string, key string, fingerprint string, runs int"
DATA = "/root/testdata/sf0.001"
VOCAB = ["".join(random.Random(i).choices("abcdefghijklmnop", k=1 + i % 6)) for i in range(300)]


def prose(n, seed):
    return " ".join(random.Random(seed).choices(VOCAB, k=n))


def corpus():
    line = "one line of six words here\n"
    texts = [prose(300, 1), prose(300, 1), prose(300, 1).upper(), prose(299, 1) + " x", None, "", " \t\n ", "one", "ONE", "two words", line * 40, "a " * 90, prose(40, 2) + "\n" + (prose(11, 3) + " ") * 5 + prose(8, 4), "\x0b".join(VOCAB[:40] * 4), "é ü " * 30, prose(20_000, 5), "b b a " * 5000]
    rows = [(i, t, None if i % 4 else "en", "k", "f", 1) for i, t in enumerate(texts)]
    return rows + [rows[0], (None, prose(30, 9), "de", "", "", 2), (None, None, None, None, None, None), (7, "other text under this id", "en", "k", "f", 3)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(rows):
    """(doc_id, fingerprint, component) of (doc_id, fingerprint) rows, by comparing all."""
    todo, out = set(range(len(rows))), []
    while todo:
        group, edge = set(), [min(todo)]
        while edge:
            i = edge.pop()
            if i in todo:
                todo.remove(i)
                group.add(i)
                edge += [j for j in todo if (rows[i][1] ^ rows[j][1]).bit_count() <= 2]
        ids = [rows[i][0] for i in group if rows[i][0] is not None]
        out += [(rows[i][0], f"{rows[i][1]:016x}", min(ids, default=None)) for i in group]
    return sorted(out, key=repr)


def test_simhash_equals_brute_force(docs):
    got = simhash.simhash_components(docs)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect()), key=repr) == slow_components([(r[0], slow_fingerprint(r[1])) for r in corpus()])


def test_simhash_of_the_given_tables(spark):
    rows = [(r.doc_id, simhash.fingerprint(r.text)) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = sorted(map(tuple, simhash.op12_simhash(spark, DATA).collect()), key=repr)
    assert got == slow_components(rows) and len({r[2] for r in got}) < len(rows)


def test_long_texts_are_hashed_in_chunks(monkeypatch):
    text = prose(1000, 7)
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert simhash.fingerprint(text) == whole == slow_fingerprint(text)


@pytest.mark.parametrize(("fine", "tile"), [(10**9, 16), (1, 16), (10**9, 4096)])
def test_links_over_tiles_and_cells(spark, fine, tile):
    """Chains at the radius, a dense ball, and strangers: the same components whatever the cells and the tiles."""
    R = np.random.default_rng(3)
    bits = [int(x) for x in R.integers(0, 1 << 63, 150)]
    for x in bits[:20]:
        for _ in range(6):
            for b in R.choice(64, 2, replace=False):
                x ^= 1 << int(b)
            bits.append(x)
    bits += [bits[0] ^ (1 << i) ^ (1 << j) for i in range(16) for j in range(i)] + [0, 1, 3, 7, 31, (1 << 64) - 1]
    bits = sorted(set(bits))
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in bits]
    edges = simhash.links(spark.createDataFrame(signed, "fingerprint long"), fine=fine, tile=tile).collect()
    root = {x: x for (x,) in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    groups = {}
    for (x,) in signed:
        groups.setdefault(find(x), set()).add(x % (1 << 64))
    want = {}
    for x, _, c in slow_components([(x, x) for x in bits]):
        want.setdefault(c, set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_a_dense_pair_of_tiles_gives_a_forest():
    a = np.array([1 << i for i in range(64)], np.uint64)
    x, y = simhash.forest(a, a, 2, True)
    assert len(x) == 63 and not len(simhash.forest(a[:1], a[1:2] | np.uint64(0xFF00), 2, False)[0])


def slow_runs(words, least=24, times=3):
    """Every stretch by its periods, smallest first."""
    found = []
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i:
                n = j - i + q
                if n >= max(least, times * q) and not any(s <= i and s + m >= i + n and q % p == 0 for s, m, p in found):
                    found.append((i, n, q))
            i = j + 1 if j == i else j
    return sorted(found)


def slow_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = slow_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(1, 9), st.integers(1, 6)), max_size=12), st.integers(0, 99))
@settings(max_examples=150, deadline=None)
def test_runs_equal_brute_force(parts, seed):
    R, words = random.Random(seed), []
    for kinds, n, times in parts:
        block = words[-n:] if kinds == 0 and words else [R.randrange(1 + kinds) for _ in range(n)]
        words += block * times
    assert periodic.runs_of([b"%d" % w for w in words]) == slow_runs(words)
    assert periodic.runs_within(words, 2, 2) == slow_runs(words, 2, 2)


def test_periodic_rows(spark, docs, monkeypatch, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = periodic.op13_periodic_runs(spark, str(tmp_path))
    want = [slow_row(r[0], r[1]) for r in corpus() if r[1] is None or len(r[1]) < 20_000]
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    rows = sorted(map(tuple, got.collect()), key=repr)
    assert len(rows) == len(corpus()) and set(want) <= set(rows)
    long = {r[0]: r for r in rows if r[0] in (15, 16)}
    assert long[16][:6] == (16, 1, 0, 15_000, 3, 5_000_000)


def test_periodic_rows_of_the_given_tables(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").where(F.length("text") < 3000).collect()
    got = {r.doc_id: tuple(r) for r in periodic.op13_periodic_runs(spark, DATA).collect()}
    assert all(got[r.doc_id] == slow_row(r.doc_id, r.text) for r in rows)
    assert any(got[r.doc_id][1] for r in rows)


def test_runs_and_collapsed_text(spark):
    text = " ".join(["x y"] + ["a b c"] * 9 + ["z"])
    r = periodic.find_runs(spark.createDataFrame([(1, text)], "id long, body string"), key="id", text="body").first()
    assert r.n_words == 30 and r.runs == [(2, 27, 3)] == [r.best] and r.collapsed == "x y a b c z"


def test_repeats_far_apart_never_reach_the_automaton():
    words = prose(100, 1).split() + prose(50, 2).split() + prose(100, 1).split()
    assert periodic.stretches(np.array([VOCAB.index(w) for w in words])) == []
