"""Sets inside sets against all pairs, with hot members in blocks."""

import random

import pytest
from pyspark.sql import functions as F

from ferrule.operators import comparison, subsets


def frame(spark, lists, name):
    return spark.createDataFrame([(x,) for x in lists], f"{name} array<string>").repartition(3)


@pytest.mark.parametrize("proper", [False, True])
def test_all_pairs(spark, monkeypatch, proper):
    monkeypatch.setattr(subsets, "BLOCK", 7)
    rng = random.Random(1)
    members = "hhhhhhhabcdefgijk"
    drawn = lambda n, most: [sorted(set(rng.choices(members, k=rng.randint(0, most)))) for _ in range(n)] + [["h"], [], None]
    small, large = drawn(120, 4) + [["z"], ["a", "z"]], drawn(150, 7)
    got = [(tuple(r.a_members), tuple(r.b_members)) for r in subsets.contained(frame(spark, small, "a_members"), frame(spark, large, "b_members"), proper).collect()]
    want = {(tuple(a), tuple(b)) for a in small for b in large if a is not None and b is not None and (set(a) < set(b) or (not proper and set(a) == set(b)))}
    assert len(got) == len(set(got)) and set(got) == want and any(not a for a, _ in want)
    some = [tuple(r.a_members) for r in subsets.covered(frame(spark, small, "a_members"), frame(spark, large, "b_members"), proper).collect()]
    assert len(some) == len(set(some)) and set(some) == {a for a, _ in want}


def test_sets_with_nulls_repeats_and_none(spark):
    found = frame(spark, [["b", "a", "b"], ["a", "b", "c"], ["d"], ["e", None, "d"], None, []], "attrs")
    assert sorted(r.attrs for r in comparison.maximal_sets(found).collect()) == [["a", "b", "c"], ["d", "e"]]
    truth = frame(spark, [["a", "c"], ["c", "d"], [], ["x"], ["c", "d", "d"], None], "attrs")
    assert sorted(r.attrs for r in comparison.uncovered_sets(truth, found).collect()) == [["c", "d"], ["x"]]
    assert {r.attr: (r.n_truth, r.n_uncovered) for r in comparison.recall_report(truth, found).collect()} == {"a": (1, 0), "c": (2, 1), "d": (1, 1), "x": (1, 1)}
    none = found.limit(0)
    assert comparison.maximal_sets(none).count() == 0 and comparison.uncovered_sets(none, found).count() == 0
    assert sorted(r.attrs for r in comparison.uncovered_sets(truth, none).collect()) == [[], ["a", "c"], ["c", "d"], ["x"]]


def test_rules_of_odd_values(spark):
    kind = "lhs array<struct<attr:string,value:string>>, rhs_attr string, rhs_value string"
    a = [([("a", None)], "r", None), ([("a", "_")], "r", None), ([("a", "x"), ("b", None)], "r", "v"), ([], "r", None)]
    b = [([("a", "_")], "r", None), ([("a", "x"), ("b", "y")], "r", "v"), ([("a", "x"), ("b", "y")], "r", None), ([("a", None), ("b", "y")], "r", "v")]
    covers = lambda g, s: all(any(p == q and v in (None, w) for q, w in s) for p, v in g)
    want = {(str(x), str(y)) for x in a for y in b if x[1:] == y[1:] and covers(x[0], y[0])}
    got = comparison.subsumed(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind)).collect()
    shown = lambda r, s: str(([tuple(i) for i in r[f"{s}_lhs"]], r[f"{s}_rhs_attr"], r[f"{s}_rhs_value"]))
    assert {(shown(r, "a"), shown(r, "b")) for r in got} == want and len(got) == len(want)
    assert comparison.subsumed(spark.createDataFrame([], kind), spark.createDataFrame(b, kind)).count() == 0


def test_short_and_long_sets_by_brute_force(spark):
    """Sets on both sides of the size up to which subsets are listed, with the empty set and NULL."""
    rng = random.Random(9)
    draw = lambda n: sorted({tuple(sorted(rng.sample("abcdefghijkl", rng.randint(0, 11)))) for _ in range(n)})
    for small, large in ((draw(150), draw(60)), ([(), ("a",)], [("a",)])):
        a = spark.createDataFrame([(list(x),) for x in small] + [(None,)], "a_members array<string>")
        b = spark.createDataFrame([(list(x),) for x in large] + [(None,)], "b_members array<string>")
        for proper in (False, True):
            expected = sorted(x for x in small if any(set(x) <= set(y) and not (proper and x == y) for y in large))
            assert sorted(tuple(r.a_members) for r in subsets.covered(a, b, proper).collect()) == expected


def test_a_common_member_makes_no_pairs(spark):
    """What the sets of few members are compared by grows with their subsets, not with the pairs that share a member."""
    sets = spark.range(4000).select(F.array(F.lit("a"), F.concat(F.lit("b"), "id"), F.concat(F.lit("c"), "id")).alias("attrs"))
    a, b = (sets.select(F.col("attrs").alias(f"{s}_members")) for s in "ab")
    levels = subsets._listed(b, a, False)
    plan = levels[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "array_except" not in plan and sum(x.count() for x in levels) == 4000
