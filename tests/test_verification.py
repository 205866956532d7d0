"""Rules met with rows against one rule and one row at a time, in a plan that doesn't grow with the rules."""

import random

import pytest

from ferrule.operators import verification

ROWS = "tid long, a string, b int, c string, d string"
RULES = "rule_id string, lhs array<struct<attr:string,value:string>>, rhs_attr string, rhs_value string"


def drawn(seed):
    rng = random.Random(seed)
    rows = [(k, rng.choice(["x", "x", "x", "y", None]), rng.choice([1, 2, None]), rng.choice("pq_"), "z") for k in range(80)]
    rules = [("same", [("a", "x")], "c", None), ("again", [("a", "x")], "c", None), ("empty", [], "b", None), ("null", [("a", "NULL")], "b", "NULL"), ("none", [("a", "absent")], "c", "p")]
    for k in range(40):
        attrs = sorted(rng.sample("abc", rng.randint(1, 2)))
        values = {"a": ["x", "y", None], "b": ["1", "2", None], "c": ["p", "_", None]}
        rules.append((f"r{k}", [(t, rng.choice(values[t])) for t in attrs], rng.choice([t for t in "abcd" if t not in attrs]), rng.choice([None, "p", "1"])))
    return rows, rules


def by_hand(rows, rules):
    out = []
    for name, lhs, rhs, value in rules:
        for tid, *cells in rows:
            row = {t: "NULL" if v is None else str(v) for t, v in zip("abcd", cells, strict=True)}
            if all(v is None or row[t] == v for t, v in lhs):
                out.append((name, tid, tuple(row[t] for t, v in lhs if v is None), row[rhs], value))
    return sorted(map(str, out))


@pytest.mark.parametrize("limit", [0, 100_000])
def test_every_rule_meets_its_rows(spark, monkeypatch, limit):
    monkeypatch.setattr(verification, "BROADCAST_RULES", limit)
    monkeypatch.setattr(verification, "PACK", 10)
    rows, rules = drawn(limit)
    table, given = spark.createDataFrame(rows, ROWS).repartition(3), spark.createDataFrame(rules, RULES)
    got = verification.matched(table, given, "tid").collect()
    assert sorted(str((r.rule_id, r.tid, tuple(r.key), r.rhs, r.rhs_value)) for r in got) == by_hand(rows, rules)
    assert verification.matched(table, given.limit(0), "tid").count() == 0 and verification.matched(table.limit(0), given, "tid").count() == 0
    with pytest.raises(ValueError, match="other"):
        verification.matched(table, spark.createDataFrame([("r", [("other", "1")], "a", None)], RULES), "tid")


def test_one_scan_for_many_kinds(spark, tmp_path):
    rows, rules = drawn(5)
    spark.createDataFrame(rows, ROWS).write.parquet(f"{tmp_path}/rows")
    table = spark.read.parquet(f"{tmp_path}/rows")
    plan = lambda some: verification.matched(table, spark.createDataFrame(some, RULES), "tid")._jdf.queryExecution().executedPlan().toString()
    few, many = plan(rules[:2]), plan(rules)
    assert many.count("FileScan parquet") == few.count("FileScan parquet") == 1
    assert len(many.splitlines()) == len(few.splitlines())
