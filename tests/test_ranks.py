"""Running sums and neighbours against a loop, over many partitions."""

import random

import pytest
from pyspark.sql import functions as F

from ferrule.plans.ranks import running


@pytest.mark.parametrize("n", [0, 1, 7, 500])
def test_running(spark, n):
    rng = random.Random(n)
    keys = rng.sample(range(10_000), n)
    rows = [(k, rng.choice([None, 1, 2, 5]), rng.choice("ab")) for k in keys]
    df = spark.createDataFrame(rows, "k long, v long, s string").repartition(3)
    got = running(df, [F.desc("k")], {"n": F.lit(1), "sum": F.col("v")}, before={"prior": "v"}, after={"next": "s"})
    assert got.columns == ["k", "v", "s", "n", "sum", "prior", "next"]
    ordered, want, total = sorted(rows, reverse=True), [], None
    for i, (k, v, s) in enumerate(ordered):
        total = v if total is None else total if v is None else total + v
        want.append((k, v, s, i + 1, total, ordered[i - 1][1] if i else None, ordered[i + 1][2] if i + 1 < n else None))
    assert sorted(map(tuple, got.collect()), reverse=True) == want


def test_no_window_over_all_rows(spark, capsys):
    df = spark.range(100).selectExpr("id AS k")
    running(df, ["k"], {"n": F.lit(1)}).explain()
    assert "windowspecdefinition(_part" in capsys.readouterr().out
