"""Deletion noise, schema statistics, ranks: odd inputs, and what a rerun gives."""

import pytest
from pyspark.sql import functions as F

from ferrule.operators import comparison, phrases, profiling


def test_deletion_noise(spark):
    texts = ["", None, "  ", "one", "a b c d e f g h " * 50, "same same same same", "x\ty\nz"]
    df = spark.createDataFrame([*enumerate(texts)], "id long, text string").repartition(3)
    thin = lambda ratio, seed: {r.id: r.t for r in df.select("id", phrases.thinned(F.col("text"), F.col("id"), ratio, seed).alias("t")).collect()}
    got = thin(0.6, 0)
    assert got == thin(0.6, 0) != thin(0.6, 1)
    assert (got[0], got[1], got[2], got[3]) == ("", None, "  ", "one")
    assert 100 < len(got[4].split()) < 220 and all(thin(0.99, s)[5] for s in range(3))
    words = iter(texts[4].split())
    assert all(w in words for w in got[4].split())  # in order
    assert thin(0.0, 0)[6] == "x y z"
    with pytest.raises(ValueError, match="ratio"):
        phrases.thinned(F.col("text"), F.col("id"), 1.0)


def test_statistics_of_nulls_and_none(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, None, "NULL"), (3, None, None)], "k int, n string, s string")
    got = {r.attr: (r.n_distinct, r.sign, r.largest) for r in profiling.schema_statistics(df, ["k", "n", "s"]).collect()}
    assert got == {"k": (3, True, 2), "n": (0, False, 2), "s": (2, True, 2)}
    assert profiling.schema_statistics(df.limit(0), ["k"]).count() == 0


def test_ranks_and_gaps(spark):
    df = spark.createDataFrame([(x,) for x in ["b"] * 30 + ["a"] * 30 + ["c"] * 2 + [None]], "v string").repartition(4)
    rows = profiling.ranked(df, "v")
    assert [tuple(r) for r in rows.orderBy("rank").collect()] == [("a", 30, 0), ("b", 30, 1), ("c", 2, 2), ("NULL", 1, 3)]
    assert profiling.gap_index(rows).first()["index"] == 1 and profiling.gap_index(rows, 0.99).first()["index"] == 4
    wanted = rows.where("item <> 'c'").withColumn("rank", 3 - F.col("rank"))
    assert comparison.rank_displacement(rows, wanted, 3).first().displacement == 3 + 1 + 4


def test_deletion_noise_draws_once(spark):
    df = spark.createDataFrame([(1, "a b")], "id long, text string")
    plan = df.select(phrases.thinned(F.col("text"), F.col("id")).alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1
