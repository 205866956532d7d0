"""Ranked search against the scores of all documents, and bounds against scores."""

import math
import random
import re

import numpy as np
import pytest

from ferrule.llm import lexical_search, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    held = [(key, terms(text)) for key, text in docs if terms(text)]
    N, L = len(held), sum(len(t) for _, t in held)
    df = {}
    for _, t in held:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for key, t in held:
            m = 100 - 90 + ((90 * len(t) * N) // L)
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[x] + 1))) * ((1000000000 * t.count(x)) // (1000 * t.count(x) + 8 * m)) for x in set(terms(text)) if x in df)
            if s > 0:
                scored.append((-s, key is None, key))
        out += [(item, r + 1, key, -s) for r, (s, _, key) in enumerate(sorted(scored)[:k])]
    return out


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(40)] + ["Été", "été", "naïve", "中文", "x1y", "A-B", "don't", " "]
    text = lambda size: " ".join(words[min(len(words) - 1, int(rng.paretovariate(0.6)) - 1)] for _ in range(size))
    docs = [(k, text(rng.choice([1, 5, 30, 200]))) for k in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, " -- "), (None, docs[3][1]), (n + 3, docs[3][1]), docs[5], docs[5], (n + 4, "w7 " * 60_000 + "w30"), (n + 5, "z" * 200_000)]
    items = [(k, text(rng.choice([1, 3, 8]))) for k in range(12)] + [(20, None), (21, ""), (22, "nowhere"), (23, "w1 W1 w1"), (23, "w2"), (None, "Été 中文"), (24, docs[7][1])]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("small", [False, True])
def test_against_all_scores(spark, monkeypatch, seed, small):
    """Also with blocks of a few items and of a few documents."""
    if small:
        for name, value in {"BLOCK_ITEMS": 5, "ROWS": 3, "TEXT": 64}.items():
            monkeypatch.setattr(lexical_search, name, value)
    docs, items = corpus(seed)
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, key int, impacts string").repartition(3)
    asked = spark.createDataFrame([(*x, 0) for x in items], "item_id long, text string, rank int")
    got = lexical_search.search(df, asked, 4)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    want = sorted(brute(docs, items, 4), key=str)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_other_kinds_of_keys(spark):
    docs = spark.createDataFrame([("b", "one two"), ("a", "one two"), ("c", "two three")], "name string, body string")
    asked = spark.createDataFrame([("q", "two one")], "q string, words string")
    got = lexical_search.search(docs, asked, 2, "name", "body", "q", "words").orderBy("rank").collect()
    assert [(r.q, r["rank"], r.name) for r in got] == [("q", 1, "a"), ("q", 2, "b")]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    for d, i in ((docs, items), (some, items), (docs, asked)):
        assert lexical_search.search(d, i).collect() == []


def test_bytes_bound_impacts():
    rng = np.random.default_rng(1)
    tf, n = rng.integers(1, 10**6, 10_000), rng.integers(1, 10**6, 10_000)
    exact = lexical_search.impacts(tf, n, 10**9, 10**12)
    byte = -(-exact // lexical_search.STEP)
    assert (exact < 10**6).all() and (byte <= 255).all() and (exact <= byte * lexical_search.STEP).all() and (exact > (byte - 1) * lexical_search.STEP).all()


def test_query(spark):
    rows = queries.op11_lexical_search(spark, "/root/testdata/sf0.001").collect()
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted(map(tuple, rows)) == sorted(brute(docs, items, 10))
