"""The classifier's score by loops, and tables whose columns have the operator's own names."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrule.llm import toxicity


def by_loops(model, text):
    ids = toxicity.buckets(np.frombuffer(text.encode(), np.uint8))
    vectors = [sum(model.embedding[i].astype(float) for i in row) for row in ids]
    logit = model.bias
    for k, width in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            best = -math.inf
            for at in range(len(vectors) + 1):
                # places beyond the text are zero
                rest = [vectors[at + j] if at + j < len(vectors) else np.zeros(toxicity.SIZE) for j in range(width)]
                best = max(best, sum(float(v @ model.filters[k][j][:, f]) for j, v in enumerate(rest)))
            logit += max(0.0, best + model.biases[k][f] if best > -math.inf else 0.0) * model.weights[k * toxicity.FILTERS + f]
    return 1 / (1 + math.exp(-logit))


def test_score_by_loops():
    rng = np.random.default_rng(5)
    normal = lambda *shape: rng.normal(0, 0.5, shape).astype(np.float32)
    model = toxicity.Model(normal(toxicity.BUCKETS, toxicity.SIZE), [normal(w, toxicity.SIZE, toxicity.FILTERS) for w in toxicity.WIDTHS], [normal(toxicity.FILTERS) for _ in toxicity.WIDTHS], normal(len(toxicity.WIDTHS) * toxicity.FILTERS), 0.1)
    model.embedding[0] = 0
    texts = ["one two three four", "a b c", "Shouting words, and (quoted) ones", "x " * 500]
    got = model.score([toxicity.buckets(np.frombuffer(t.encode(), np.uint8)) for t in texts])
    for t, g in zip(texts, got, strict=True):
        assert g == pytest.approx(by_loops(model, t), abs=1e-4)
    alone = [model.score([toxicity.buckets(np.frombuffer(t.encode(), np.uint8))])[0] for t in texts]
    assert got == pytest.approx(alone, abs=1e-6)


def test_columns_with_the_operators_names(spark):
    rows = [(k, f"word{k % 7} zqx" if k % 3 == 0 else f"word{k % 7} fine", "en", k, "l", "o", 1.0) for k in range(60)] + [(99, "w " * 100_000, "en", 0, "l", "o", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, label long, `of` string, `order` string, score double")
    marks = spark.createDataFrame([(k, int(k % 3 == 0), "x") for k in range(60)], "doc_id long, toxic int, label string")
    got = toxicity.classify(df, marks).collect()
    plain = toxicity.classify(df.select("doc_id", "text", "lang"), marks.select("doc_id", "toxic")).collect()
    assert len(got) == 61 and sorted(map(str, got)) == sorted(map(str, plain))


def test_nothing_to_learn_from(spark, recwarn):
    df = spark.createDataFrame([(1, "a", "en"), (2, None, None)], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.classify(df, marks).collect()
    assert all(0 <= r.score <= 1 for r in got) and not [w for w in recwarn if "empty slice" in str(w.message)]


@pytest.mark.parametrize("shard", [1 << 21, 8000])
def test_all_labelled_documents_are_learnt_from(spark, monkeypatch, shard):
    """Those of label 1 have the largest hashes, beyond 8000 others; in one shard and in several."""
    monkeypatch.setattr(toxicity, "SHARD", shard)
    keys = spark.range(12_000).withColumnRenamed("id", "doc_id").where(toxicity.fold("doc_id") != 0)
    order = [r.doc_id for r in keys.orderBy(F.xxhash64("doc_id", F.lit("sample"))).collect()]
    assert len(order) > 9000
    bad = set(order[8000:])
    rows = [(k, f"word{k % 7} zqx vile" if k in bad else f"word{k % 7} fine day", "en") for k in order] + [(12_000, "word1 zqx vile", "en"), (12_001, "word1 fine day", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(k, int(k in bad)) for k in order], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.classify(df, marks).collect()}
    assert (got[12_000], got[12_001]) == (1, 0) and all(got[k] == (k in bad) for k in order)
