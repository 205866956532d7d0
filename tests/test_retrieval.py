"""Vector search by blocks against scores of all pairs, with copies, vectors of length 0 and of other lengths."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ferrule.catalog import QUERIES
from ferrule.operators import evaluation, retrieval

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = np.round(np.concatenate([rng.normal(0, 1, (90, 5)), np.repeat(rng.normal(0, 1, (2, 5)), 25, 0), 3 * np.repeat(rng.normal(0, 1, (1, 5)), 20, 0)]), 2)
    made = [(k, v) for k, v in enumerate(x.tolist())]
    made += [(500, [0.0] * 5), (501, None), (502, [1.0, 2.0]), (503, [2.0, 1.0]), (504, [1.0, None, 0.0, 0.0, 1.0])]
    return spark.createDataFrame(made, "id long, vector array<double>").repartition(3).cache()


def by_definition(queries, rows, k, similarity, places=None):
    scored = retrieval.all_scores(queries, rows, similarity)
    scored = scored if places is None else scored.withColumn("score", F.round("score", places))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "corpus_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


@pytest.mark.parametrize(("similarity", "places"), [("cosine", None), ("dot", None), ("cosine", 1), ("dot", 0), ("manhattan", 1)])
def test_nearest_of_all_pairs(spark, monkeypatch, rows, similarity, places):
    """The same doubles, ranks and ties, in blocks far smaller than the tables."""
    for name, value in {"BLOCK": 40, "AT_ONCE": 200, "AGAIN": 7}.items():
        monkeypatch.setattr(retrieval, name, value)
    asked = rows.where("id % 3 = 0 OR id >= 500")
    got = retrieval.semantic_search(asked, rows, 7, similarity, places).select("query_id", "corpus_id", "score", "rank").collect()
    want = by_definition(asked, rows, 7, similarity, places).select("query_id", "corpus_id", "score", "rank").collect()
    assert sorted(got) == sorted(want) and len(got) > 300


def test_search_makes_no_pair_in_spark(spark):
    """All pairs by a nested loop were what took the time."""
    for name in ("semantic_search", "dot_search", "pair_mining", "similarity_histogram_all_rows", "translation_accuracy_all_rows", "ir_metrics"):
        plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "zip_with" not in plan and "CartesianProduct" not in plan, name


def test_histogram_of_all_pairs(spark, monkeypatch, rows):
    monkeypatch.setattr(retrieval, "BLOCK", 40)
    monkeypatch.setattr(retrieval, "AT_ONCE", 200)
    for similarity, places in (("cosine", 6), ("cosine", 2), ("dot", 1)):
        want = retrieval.similarity_histogram(retrieval.all_scores(rows, rows, similarity).withColumn("score", F.round("score", places)))
        got = retrieval.all_similarities_histogram(rows, rows, places, similarity=similarity)
        assert sorted(got.collect()) == sorted(want.collect())


@pytest.mark.parametrize(("k", "most"), [(2, 10), (3, 60), (30, 400)])
def test_mined_pairs_of_all_pairs(spark, monkeypatch, rows, k, most):
    want = by_definition(rows, rows, 10_000, "cosine").where("query_id <> corpus_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "corpus_id")
    want = want.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    want = want.select(F.least("query_id", "corpus_id").alias("a"), F.greatest("query_id", "corpus_id").alias("b"), "score").distinct()
    want = want.orderBy(F.desc("score"), "a", "b").limit(most).collect()
    monkeypatch.setattr(retrieval, "BLOCK", 50)
    assert retrieval.mined_pairs(rows, k, most).collect() == want


def test_measures_by_sizes(spark):
    found = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 12, 1)], "query_id long, corpus_id long, rank int")
    every = spark.createDataFrame([(1, 11), (1, 12), (1, 13), (2, 10), (3, 10)], "query_id long, corpus_id long")
    sizes = every.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    only = every.join(found, ["query_id", "corpus_id"], "left_semi")
    assert evaluation.ranking_measures(found, only, 2, sizes).collect() == evaluation.ranking_measures(found, every, 2).collect()
