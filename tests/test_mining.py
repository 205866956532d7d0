"""The miner against an enumeration of the definitions, on small random tables."""

import functools
import random
from itertools import combinations, product

import pytest

from ferrule.operators import mining
from ferrule.plans import jobs, lattice, partitions

A = ["a", "b", "c"]


def brute(rows, support, confidence, largest):
    rows = [{k: "NULL" if v is None else v for k, v in r.items()} for r in rows]
    rules = {}
    for size in range(1, largest + 1):
        for x in combinations(A, size):
            for rhs in set(A) - set(x):
                for pattern in product(*[[None, *sorted({r[c] for r in rows})] for c in x]):
                    covered = [r for r in rows if all(v is None or r[c] == v for c, v in zip(x, pattern, strict=True))]
                    if len(covered) < support:
                        continue
                    lhs = tuple(zip(x, pattern, strict=True))
                    if None in pattern:
                        if len({r[rhs] for r in covered}) < 2:
                            continue
                        groups = {}
                        for r in covered:
                            groups.setdefault(tuple(r[c] for c in x), []).append(r[rhs])
                        hits = sum(max(map(g.count, g)) for g in groups.values())
                        if hits >= confidence * len(covered):
                            rules[lhs, rhs, None] = (len(covered), hits)
                    else:
                        for value in {r[rhs] for r in covered}:
                            hits = sum(r[rhs] == value for r in covered)
                            if hits >= confidence * len(covered):
                                rules[lhs, rhs, value] = (len(covered), hits)

    def general(e, r):
        have = dict(r)
        return e != r and all(a in have and v in (None, have[a]) for a, v in e)

    return {k: m for k, m in rules.items() if not any(e[1:] == k[1:] and n == h and general(e[0], k[0]) for e, (n, h) in rules.items())}


def table(seed, nulls=False, constant=False, duplicate=False):
    rng = random.Random(seed)
    rows = [{c: rng.choice("xyz"[: 2 + (c != "a")]) for c in A} for _ in range(rng.randint(10, 40))]
    for r in rows:
        if nulls and rng.random() < 0.3:
            r["b"] = None
        if constant:
            r["c"] = "k"
        if duplicate:
            r["c"] = r["a"]
    return rows


@pytest.mark.parametrize(("seed", "kind"), [(1, {}), (2, {"nulls": True}), (3, {"constant": True}), (4, {"duplicate": True}), (5, {})])
@pytest.mark.parametrize("confidence", [0.5, 1.0])
def test_minimal_rules(spark, seed, kind, confidence):
    rows = table(seed, **kind)
    df = spark.createDataFrame([tuple(r[c] for c in A) for r in rows], "a string, b string, c string")
    found = {}
    for r in mining.mine(df, A, 2, confidence, 2).collect():
        found[tuple((i.attr, i.value) for i in r.lhs), r.rhs_attr, r.rhs_value] = (r.support, r.hits)
    assert found == brute(rows, 2, confidence, 2)


def test_strategies_agree_and_unknown_ones_fail(spark):
    df = spark.createDataFrame([("x", "y", "z")], "a string, b string, c string")
    assert len(mining.STRATEGIES) == 10
    with pytest.raises(ValueError, match="unknown strategy"):
        mining.mine(df, A, 1, strategy="guess")


def test_empty_table(spark):
    df = spark.createDataFrame([], "a string, b string, c string")
    assert mining.mine(df, A, 1).collect() == []


def wide(spark, columns, rows=300):
    rng = random.Random(7)
    names = [f"c{k:02}" for k in range(columns)]
    drawn = [rng.randrange(60) for _ in range(rows)]
    made = [tuple(str((v + rng.randrange(2) * (k % 4 == 1)) % (2 + k) if k % 3 else v // 7) for k in range(columns)) for v in drawn]
    return spark.createDataFrame(made, ", ".join(f"{c} string" for c in names)), names


def told(rules):
    return sorted(str((tuple((i.attr, i.value) for i in r.lhs), r.rhs_attr, r.rhs_value, r.kind, r.support, r.hits)) for r in rules.collect())


@pytest.mark.parametrize(("support", "confidence", "marked"), [(60, 0.9, 10_000), (30, 0.2, 10_000), (30, 0.2, 2), (2, 1.0, 10_000)])
def test_a_wide_table_has_the_rules_of_all_candidates(spark, monkeypatch, support, confidence, marked):
    """Partitions, grown patterns and the border beyond them, against classes of every candidate with all patterns. Right sides may be
    rare values, and attributes may have too many frequent ones to mark."""
    monkeypatch.setattr(partitions, "MARKED", marked)
    df, names = wide(spark, 6)
    all_rules = [f(df, names, 3, support, c) for f, c in ((mining.variable_rules, confidence), (mining.constant_rules, confidence))]
    want = sorted(x for r in all_rules for x in told(mining.minimal(r)))
    got = told(mining.mine(df, names, support, confidence, 3))
    assert got == want and len(got) > 5


def test_rules_within_sets(spark):
    """Sub-tables mined at once have the rules of each mined alone."""
    df, names = wide(spark, 7)
    sets = [names[:3], names[2:6], [names[0], names[5], names[6]], names[:3]]
    got = jobs.mine_sub_tables(df, sets, 40, 0.6, 2)
    for k, s in enumerate(sets):
        assert told(got.where(got.set_id == k + 1)) == told(mining.mine(df.select(*s), s, 40, 0.6, 2))
    small, large = (mining.mine(df, names, 40, 0.6, 2, within=x)._jdf.queryExecution().optimizedPlan().treeString().count("\n") for x in (sets[:1], sets * 20))
    assert large <= small * 1.2 + 20


def test_frequent_patterns_bound_the_rows_of_a_round(spark):
    """What a round keeps are patterns of frequent constants, whatever the masks."""
    df, names = wide(spark, 6)
    counts = lattice.compressed(df, names)
    for support in (20, 150):
        known = partitions.coded(counts, names, support)
        parts = partitions.levels(known, 4)
        frequent = functools.reduce(lambda x, y: x.unionByName(y), [p.where(p.n >= support) for p in parts]).selectExpr("set AS mask", "values AS codes", "n AS support").cache()
        asked = spark.createDataFrame([(r.set, (1 << 6) - 1 - r.set) for r in parts[2].select("set").distinct().collect()], "of long, open long")
        dirty = partitions.mistakes(parts[2], parts[3], asked, 6)
        found = partitions.pattern_mistakes(dirty, frequent, 6, 3).collect()
        itemsets = {(r.mask, tuple(r.codes)) for r in frequent.collect()}
        assert all((r.mask, tuple(r.codes)) in itemsets and r.support >= support for r in found)
        bare = {(r.set, r.rhs, r.mask, tuple(r.codes)) for r in found}
        assert len(bare) == len(found)


def test_candidates_need_all_smaller_ones():
    dirty = {(0b001, 3), (0b010, 3), (0b100, 3)}
    two = mining._open_next(dirty, 4, None)
    assert two == {(0b011, 3), (0b101, 3), (0b110, 3)}
    assert mining._open_next(two - {(0b101, 3)}, 4, None) == set()
    assert mining._open_next(two, 4, None) == {(0b111, 3)}
    assert mining._open_next(two, 4, [0b1011]) == set()
