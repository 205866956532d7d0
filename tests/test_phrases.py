"""Phrase tokens against a scan of each text, length by length."""

import random

import pytest

from ferrule.catalog import QUERIES
from ferrule.operators import phrases


def scanned(tokens, known, longest):
    """Longest phrases first, each length from the left; what is covered stays as it is."""
    out = [(t, False) for t in tokens]
    for n in range(longest, 1, -1):
        k = 0
        while k + n <= len(out):
            part = out[k : k + n]
            run = "_".join(t for t, _ in part)
            form = next((f for f in (run, run.lower()) if f in known), None)
            if form and not any(done for _, done in part):
                out[k : k + n] = [(form, True)]
            k += 1
    return [t for t, _ in out], sum(done for _, done in out)


def test_phrases_are_covered_longest_first(spark):
    rng = random.Random(4)
    words = ["a", "B", "c", "d", "New", "York", "x"]
    known = {"a_b", "b_c_d", "c_d", "new_york", "New_York_x", "a_a", "d_new_york_x", "a__b", "x_x_x_x_x_x"} | {"_".join(rng.choices("abcd", k=rng.randint(2, 4))) for _ in range(25)}
    rows = [(k, [rng.choice(words) for _ in range(rng.choice([0, 1, 2, 5, 40]))]) for k in range(150)] + [(900, None), (None, ["a", "b"]), (7, ["a", "B"]), (901, ["a"] * 20_000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "id long, tokens array<string>, row int").repartition(3)
    table = spark.createDataFrame([(p,) for p in [*known, "a_b", None]], "phrase string")
    good = {p for p in known if "__" not in p}
    for longest in (2, 4):
        got = sorted(str((r.id, r.tokens, r.n_phrases)) for r in phrases.phrase_tokens(docs, table, longest).collect())
        assert got == sorted(str((k, *scanned(t or [], good, longest))) for k, t in rows)
    assert phrases.phrase_tokens(docs.limit(0), table).collect() == []


def test_frequent_runs_of_documents(spark):
    folder = "/root/testdata/sf0.001"
    texts = [(r.doc_id, (r.text or "").split()) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    seen = {}
    for k, (_, t) in enumerate(texts):
        for n in (2, 3):
            for at in range(len(t) - n + 1):
                seen.setdefault("_".join(t[at : at + n]).lower(), set()).add(k)
    known = {p for p, rows in seen.items() if len(rows) >= 30}
    want = {k: scanned(t, known, 3) for k, t in texts}
    got = QUERIES["phrase_tokens"](spark, folder).collect()
    assert {r.id: (r.n_tokens, r.n_phrases) for r in got} == {k: (len(t), n) for k, (t, n) in want.items()} and sum(r.n_phrases for r in got) > 0


def test_many_phrases_are_not_broadcast_and_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(1, ["New", "York", "is", "New", "YORK"]), (2, ["is", "new"]), (3, ["New", "YORK"])], "id long, tokens array<string>")
    table = spark.createDataFrame([("New_York",), ("new_york",), ("is_new",)], "phrase string")
    few = phrases.phrase_tokens(docs, table, 3)
    assert {r.id: (r.tokens, r.n_phrases) for r in few.collect()} == {1: (["New_York", "is_new", "YORK"], 2), 2: (["is_new"], 1), 3: (["new_york"], 1)}
    monkeypatch.setattr(phrases, "BROADCAST_PHRASES", 0)
    assert sorted(phrases.phrase_tokens(docs, table, 3).collect()) == sorted(few.collect())


def test_runs_are_counted_without_moving_rows(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "A", "b"]), (2, ["a", "B"]), (3, ["a"]), (4, [])], "row long, tokens array<string>")
    found = phrases.frequent_phrases(docs, 3, 1)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert {r.phrase: r.n for r in found.collect()} == {"a_b": 2, "b_a": 1, "a_b_a": 1, "b_a_b": 1}


def test_rows_stay_where_phrases_are_few(spark, monkeypatch):
    """Rows are covered where they are, in slices; those with a null token or a separator in one meet the phrases by a join, with the same result."""
    monkeypatch.setattr(phrases, "AT_ONCE", 30)
    rows = [(1, ["New", "York", "is", "New", "YORK"]), (2, []), (3, None), (4, ["", "is", "new"]), (5, ["İs", "new", "york"])]
    odd = [(6, ["New_York", "is", "new"]), (7, ["is", None, "new"]), (8, ["a_b", None, "c"])]
    docs = lambda r: spark.createDataFrame(r, "id long, tokens array<string>")
    table = spark.createDataFrame([("New_York",), ("new_york",), ("is_new",), ("new_york_is",)], "phrase string")
    even = phrases.phrase_tokens(docs(rows), table, 3)
    assert "Exchange" not in even._jdf.queryExecution().executedPlan().toString()
    want = {1: (["new_york_is", "new_york"], 2), 2: ([], 0), 3: ([], 0), 4: (["", "is_new"], 1), 5: (["İs", "new_york"], 1)}
    assert {r.id: (r.tokens, r.n_phrases) for r in even.collect()} == want
    both = sorted(phrases.phrase_tokens(docs(rows + odd), table, 3).collect(), key=lambda r: r.id)
    monkeypatch.setattr(phrases, "BROADCAST_PHRASES", 0)
    assert both == sorted(phrases.phrase_tokens(docs(rows + odd), table, 3).collect(), key=lambda r: r.id)


@pytest.mark.parametrize("most", [0, 1000])
def test_only_runs_of_frequent_runs_are_counted(spark, monkeypatch, most):
    monkeypatch.setattr(phrases, "AT_ONCE", 200)
    monkeypatch.setattr(phrases, "BROADCAST_PHRASES", most)
    rng = random.Random(8)
    rows = [[rng.choice(["a", "A", "b", "c", "a_b", "b_c_a", "", None, "d", "D", "É"][: rng.choice([4, 11])]) for _ in range(rng.choice([0, 1, 3, 12]))] for _ in range(60)]
    seen = {}
    for k, t in enumerate(rows):
        for n in (2, 3, 4):
            for at in range(len(t) - n + 1):
                seen.setdefault("_".join(w for w in t[at : at + n] if w is not None).lower(), set()).add(k)
    found = phrases.frequent_phrases(spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "row long, tokens array<string>"), 4, 5)
    assert {r.phrase: r.n for r in found.collect()} == {p: len(k) for p, k in seen.items() if len(k) >= 5}
    counted = phrases._counted(spark.createDataFrame([("x_y_x_z", False)], "lower string, uneven boolean"), 2, spark.createDataFrame([("x",), ("y",)], "phrase string"), "_")
    assert {r.phrase for r in counted.collect()} == {"x_y", "y_x"}
