"""Vector measures see all scores, not the best of each query only."""

import math

from ferrule.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_backward_share_has_no_limit_of_targets(spark, tmp_path):
    """1,100 targets: the first one's best source is its own, which has 1,000 nearer targets."""
    angles = [(0, 0.0), (1, 0.5)]
    for k in range(1, 1100):
        angles += [(100 * k, math.pi - (1100 - k) / 10_000), (100 * k + 1, k / 10_000)]
    rows = [(i, [math.cos(a), math.sin(a)], 0) for i, a in angles]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["translation_accuracy"](spark, str(tmp_path)).first()
    assert round(got.backward * 1100) == 1


def test_translations_among_all_rows(spark, tmp_path):
    """A row that is neither a stated source nor a target comes before the translation."""
    rows = [(0, [1.0, 0.0], 0), (1, [1.0, 0.2], 0), (2, [1.0, 0.01], 0), (100, [0.0, 1.0], 0), (101, [0.0, 1.0], 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["translation_accuracy_all_rows"](spark, str(tmp_path)).first()
    assert (got.forward, got.backward, got.accuracy) == (0.5, 0.5, 0.5)
    assert QUERIES["translation_accuracy"](spark, str(tmp_path)).first().forward == 1.0


def test_histogram_counts_every_score(spark):
    n = spark.read.parquet(f"{FOLDER}/embeddings.parquet").selectExpr("count(*) * count_if(vec_id % 100 = 0) AS n").first().n
    bins = QUERIES["similarity_histogram_all_rows"](spark, FOLDER).collect()
    assert sum(r.n for r in bins) == n and any(r.bin < 0 for r in bins)
