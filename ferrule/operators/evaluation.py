"""Measures of rankings, scores and classifications."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions.vectors import cosine, cosine_distance, dot, euclidean, manhattan
from ferrule.operators.clustering import components
from ferrule.plans.ranks import beside_one, running
from ferrule.plans.stages import written


def classification_curve(scored: DataFrame) -> DataFrame:
    """(cut, threshold, right, n, positives): after each distinct score but the last, highest first, as a
    cut. scored: (score, label 0/1). Rows of a score are summed first, so that ties make no difference."""
    by = scored.groupBy("score").agg(F.count("*").alias("rows"), F.sum("label").alias("ones"))
    at = running(by, [F.desc("score")], {"n": F.col("rows"), "right": F.col("ones")}, after={"next": "score"})
    at = beside_one(at, scored.agg(F.sum("label").alias("positives"), F.count("*").alias("total")))
    return at.where("next is not null").withColumn("threshold", (F.col("score") + F.col("next")) / 2)


def best_f1(scored: DataFrame) -> DataFrame:
    """(f1, precision, recall, threshold) of the best cut; ties: the highest threshold."""
    at = classification_curve(scored).where("right > 0").withColumn("precision", F.col("right") / F.col("n")).withColumn("recall", F.col("right") / F.col("positives"))
    at = at.withColumn("f1", 2 * F.col("right") / (F.col("n") + F.col("positives")))
    return at.agg(F.max(F.struct("f1", "threshold", "precision", "recall")).alias("best")).select("best.f1", "best.precision", "best.recall", "best.threshold")


def best_accuracy(scored: DataFrame) -> DataFrame:
    """(accuracy, threshold) of the best cut; ties: the highest threshold."""
    at = classification_curve(scored)
    right = F.col("right") + (F.col("total") - F.col("n")) - (F.col("positives") - F.col("right"))
    at = at.withColumn("accuracy", right / F.col("total"))
    return at.agg(F.max(F.struct("accuracy", "threshold")).alias("best")).select("best.accuracy", "best.threshold")


def average_precision(scored: DataFrame) -> DataFrame:
    """(ap): the sum over distinct scores of precision * growth of recall."""
    by = scored.groupBy("score").agg(F.count("*").alias("rows"), F.sum("label").alias("ones"))
    at = running(by, [F.desc("score")], {"n": F.col("rows"), "right": F.col("ones")}).withColumn("precision", F.col("right") / F.col("n"))
    return at.agg((F.sum(F.col("precision") * F.col("ones")) / F.sum("ones")).alias("ap"))


def ranking_measures(results: DataFrame, relevant: DataFrame, k: int, sizes: DataFrame | None = None) -> DataFrame:
    """(queries, accuracy, precision, recall, mrr, ndcg, map) at k. results: (query_id, corpus_id, rank from
    1); relevant: (query_id, corpus_id). Queries with a relevant row count, found or not. sizes: (query_id, n_relevant), if
    counted elsewhere; then `relevant` need hold only rows that are in `results`."""
    if sizes is None:
        sizes = relevant.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    hits = results.where(F.col("rank") <= k).join(relevant.withColumn("hit", F.lit(1)), ["query_id", "corpus_id"])
    order = Window.partitionBy("query_id").orderBy("rank")
    hits = hits.withColumn("nth", F.row_number().over(order))
    by = hits.groupBy("query_id").agg(F.count("*").alias("hits"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"), F.sum(F.col("nth") / F.col("rank")).alias("precisions"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    at = sizes.join(by, "query_id", "left").na.fill(0, ["hits"]).na.fill(0.0, ["dcg", "precisions"])
    return at.agg(
        F.count("*").alias("queries"),
        F.avg((F.col("hits") > 0).cast("double")).alias("accuracy"),
        F.avg(F.col("hits") / k).alias("precision"),
        F.avg(F.col("hits") / F.col("n_relevant")).alias("recall"),
        F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"),
        F.avg(F.col("dcg") / ideal).alias("ndcg"),
        F.avg(F.col("precisions") / F.least(F.col("n_relevant"), F.lit(k))).alias("map"),
    )


def rerank_measures(scored: DataFrame, k: int) -> DataFrame:
    """(queries, map, mrr) of scored (query_id, doc_id, score, label); queries without both labels are left out."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    at = scored.withColumn("rank", F.row_number().over(order))
    hits = at.withColumn("nth", F.sum("label").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    by = hits.groupBy("query_id").agg(F.sum("label").alias("ones"), F.count("*").alias("n"), F.min(F.when(F.col("label") == 1, F.col("rank"))).alias("first"), F.sum(F.when(F.col("label") == 1, F.col("nth") / F.col("rank"))).alias("precisions"))
    by = by.where("ones > 0 and ones < n")
    return by.agg(F.count("*").alias("queries"), F.avg(F.col("precisions") / F.col("ones")).alias("map"), F.avg(F.when(F.col("first") <= k, 1 / F.col("first")).otherwise(0.0)).alias("mrr"))


def correlations(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(pearson, spearman). Ranks are means over ties, from counts of distinct values."""

    def ranks(column: str, name: str) -> DataFrame:
        by = pairs.groupBy(F.col(column).alias(f"of_{name}")).agg(F.count("*").alias("n"))
        by = running(by, [f"of_{name}"], {"past": F.col("n")})
        return by.select(f"of_{name}", (F.col("past") - (F.col("n") - 1) / 2).alias(name))

    at = pairs.join(ranks(a, "ra"), F.col(a) == F.col("of_ra")).join(ranks(b, "rb"), F.col(b) == F.col("of_rb"))
    return at.agg(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("pearson"), F.corr("ra", "rb").alias("spearman"))


def similarity_correlations(pairs: DataFrame, a: str, b: str, label: str) -> DataFrame:
    """(measure, pearson, spearman) of a label with four scores of two vectors: cosine, dot and, negative, euclidean and manhattan."""
    u, v = F.col(a), F.col(b)
    scores = {"cosine": cosine(u, v), "dot": dot(u, v), "euclidean": -euclidean(u, v), "manhattan": -manhattan(u, v)}
    at = written(pairs.select(F.col(label).alias("label"), *[F.round(c, 6).alias(k) for k, c in scores.items()]), "scores")
    each = [correlations(at, k, "label").select(F.lit(k).alias("measure"), "pearson", "spearman") for k in scores]
    return reduce(DataFrame.unionByName, each)


def triplet_accuracy(triplets: DataFrame) -> DataFrame:
    """(cosine, euclidean, manhattan): shares of rows (anchor, positive, negative) whose positive is nearer."""
    nearer = lambda d: F.avg((d(F.col("anchor"), F.col("positive")) < d(F.col("anchor"), F.col("negative"))).cast("double"))
    return triplets.agg(nearer(cosine_distance).alias("cosine"), nearer(euclidean).alias("euclidean"), nearer(manhattan).alias("manhattan"))


def translation_accuracy(scores: DataFrame) -> DataFrame:
    """(forward, backward, accuracy): how often the best column of a row, and the best row of a column, is
    its own. scores: (source_id, target_id, score)."""

    def share(side: str, other: str, name: str) -> DataFrame:
        best = scores.groupBy(side).agg(F.min_by(other, F.struct((-F.col("score")).alias("s"), other)).alias("best"))
        return best.agg(F.avg((F.col(side) == F.col("best")).cast("double")).alias(name)).withColumn("one", F.lit(1))

    out = share("source_id", "target_id", "forward").join(share("target_id", "source_id", "backward"), "one").drop("one")
    return out.withColumn("accuracy", (F.col("forward") + F.col("backward")) / 2)


def label_accuracy(rows: DataFrame, scores: str, label: str) -> DataFrame:
    """(accuracy): how often the place of the greatest score (the first of equals) is the label."""
    best = F.array_position(F.col(scores), F.array_max(F.col(scores))) - 1
    return rows.agg(F.avg((best == F.col(label)).cast("double")).alias("accuracy"))


def mean_squared_error(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(mse): 100 times the mean squared difference over all places of two array columns."""
    squares = F.zip_with(F.col(a).cast("array<double>"), F.col(b).cast("array<double>"), lambda x, y: (x - y) * (x - y))
    total = F.sum(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))
    return rows.agg((100 * total / F.sum(F.size(F.col(a)))).alias("mse"))


def dcg(relevances: Column) -> Column:
    """Discounted cumulative gain of an array of relevances, best rank first."""
    parts = F.transform(relevances.cast("array<double>"), lambda r, i: r / F.log2(i + 2))
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)


def reduced(measures: Sequence[float], how: str = "last") -> float:
    """One number for several evaluations run in a row."""
    return {"last": lambda m: m[-1], "mean": lambda m: sum(m) / len(m), "max": max}[how](list(measures))


def paraphrase_measures(pairs: DataFrame, duplicates: DataFrame, transitive: bool = False) -> DataFrame:
    """(pairs, average_precision, f1, precision, recall, threshold) of mined pairs (a, b, score), the best first (ties:
    by a and b), against duplicates (a, b) in either order. The best cut is the first of the greatest f1, and its
    threshold the middle of its score and the next. transitive: what a chain of duplicates joins is one, too; then
    pairs are compared by component, and counted from sizes of components, never written out."""
    if transitive:
        member = components(duplicates.where("a <> b"))
        total = member.groupBy("component").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("total"))
        side = lambda s: member.select(F.col("id").alias(s), F.col("component").alias(f"of_{s}"))
        judged = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
        judged = judged.select("a", "b", "score", F.coalesce(F.col("of_a") == F.col("of_b"), F.lit(False)).cast("int").alias("hit"))
    else:
        known = duplicates.where("a <> b").select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct()
        total = known.agg(F.count("*").alias("total"))
        met = (F.least("a", "b") == F.col("low")) & (F.greatest("a", "b") == F.col("high"))
        judged = pairs.join(known, met, "left").select("a", "b", "score", F.col("low").isNotNull().cast("int").alias("hit"))
    at = running(judged, [F.desc("score"), "a", "b"], {"n": F.lit(1), "right": F.col("hit")}, after={"after": "score"})
    at = beside_one(at.withColumn("next", F.coalesce("after", "score")), total)
    precision, recall = F.col("right") / F.col("n"), F.col("right") / F.col("total")
    cut = F.struct((2 * F.col("right") / (F.col("n") + F.col("total"))).alias("f1"), (-F.col("n")).alias("before"), precision.alias("precision"), recall.alias("recall"), ((F.col("score") + F.col("next")) / 2).alias("threshold"))
    out = at.agg(F.count("*").alias("pairs"), (F.sum(F.when(F.col("hit") == 1, precision)) / F.max("total")).alias("average_precision"), F.max(F.when(F.col("hit") == 1, cut)).alias("best"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select("pairs", zero(F.col("average_precision")).alias("average_precision"), *[zero(F.col(f"best.{c}")).alias(c) for c in ("f1", "precision", "recall", "threshold")])
