"""Correlated attribute sets: which columns are worth mining together."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrule.plans.stages import written

#: Trees of a forest and bins of a predictor, as MLlib has them; cells (of all targets) up to which forests are fitted to cells.
TREES, BINS, CELLS = 20, 32, 1 << 17
#: Rows added up at once, and trees fitted at once.
SOME, AT_ONCE = 1 << 16, 8


def pearson_pairs(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r) for each pair a < b of numeric columns; one pass over the table."""
    pairs = list(combinations(sorted(columns), 2))
    row = table.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{k}") for k, (a, b) in enumerate(pairs)])
    each = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)]
    return row.select(F.explode(F.array(*each)).alias("p")).select("p.a", "p.b", "p.r")


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "r"))


def mean_correlation(pairs: DataFrame) -> DataFrame:
    """(attr, mean_r): each column's mean correlation with all columns, itself included."""
    n = F.count("*") + 1
    return both_ways(pairs).groupBy(F.col("a").alias("attr")).agg(((F.sum("r") + 1) / n).alias("mean_r"))


def top_correlated(pairs: DataFrame, k: int) -> DataFrame:
    """(attr, other, r, rank): each column's k nearest others by |r|; never itself."""
    order = Window.partitionBy("a").orderBy(F.desc(F.abs("r")), "b")
    top = both_ways(pairs).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.select(F.col("a").alias("attr"), F.col("b").alias("other"), "r", "rank")


def top_sets(pairs: DataFrame, k: int) -> DataFrame:
    """(attrs): each column with its k nearest others."""
    top = top_correlated(pairs, k)
    sets = top.groupBy("attr").agg(F.collect_list("other").alias("others"))
    return sets.select(F.array_sort(F.array_append("others", F.col("attr"))).alias("attrs")).distinct()


def _moments(table: DataFrame, columns: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and covariances: columns x columns numbers, from one pass."""
    ordered = list(columns)
    x = {c: F.col(c).cast("double") for c in ordered}
    pairs = [(a, b) for i, a in enumerate(ordered) for b in ordered[i:]]
    row = table.agg(F.count("*").alias("n"), *[F.avg(x[c]).alias(f"m{k}") for k, c in enumerate(ordered)], *[F.covar_samp(x[a], x[b]).alias(f"v{k}") for k, (a, b) in enumerate(pairs)]).first()
    cov = np.zeros((len(ordered), len(ordered)))
    for k, (a, b) in enumerate(pairs):
        i, j = ordered.index(a), ordered.index(b)
        cov[i, j] = cov[j, i] = row[f"v{k}"] or 0.0
    return row["n"], np.array([row[f"m{k}"] or 0.0 for k in range(len(ordered))]), cov


def principal_components(table: DataFrame, columns: Sequence[str], k: int) -> np.ndarray:
    """k unit vectors (as rows) of the columns' covariance, greatest variance first; in each the entry of
    greatest size is positive. The matrix is columns x columns, so it's solved on the driver."""
    _, _, cov = _moments(table, columns)
    values, vectors = np.linalg.eigh(cov)
    out = vectors[:, np.argsort(-values, kind="stable")[:k]].T
    signs = np.sign(out[np.arange(len(out)), np.abs(out).argmax(1)])
    return out * np.where(signs == 0, 1, signs)[:, None]


def _kernel(cov: np.ndarray, gamma: float) -> np.ndarray:
    """The Gaussian kernel between standardised columns; a constant one counts as uncorrelated with all, itself too."""
    sd = np.sqrt(np.diag(cov))
    sd = np.where(sd == 0, 1, sd)
    return np.exp(-gamma * (2 - 2 * cov / np.outer(sd, sd)))


def kernel_components(table: DataFrame, columns: Sequence[str], k: int, gamma: float = 0.5) -> np.ndarray:
    """k unit vectors of the centred Gaussian kernel between standardised columns. With r the correlation of
    two columns, their squared distance a row is 2 - 2r, so one pass gives the kernel."""
    _, _, cov = _moments(table, columns)
    kernel = _kernel(cov, gamma)
    centre = np.eye(len(columns)) - 1 / len(columns)
    values, vectors = np.linalg.eigh(centre @ kernel @ centre)
    out = vectors[:, np.argsort(-values, kind="stable")[:k]].T
    signs = np.sign(out[np.arange(len(out)), np.abs(out).argmax(1)])
    return out * np.where(signs == 0, 1, signs)[:, None]


def component_sets(components: np.ndarray, columns: Sequence[str], least: float = 0.1, near_zero: float = 0.05, longest: int | None = None) -> list[list[str]]:
    """For each component, its positive columns and its negative ones (beyond least in size, weakest first),
    each followed by the columns near zero; the last `longest` of each set of two or more."""
    out = []
    for weights in components:
        order = np.argsort(np.abs(weights), kind="stable")
        around = [columns[i] for i in order if abs(weights[i]) < near_zero]
        for sign in (1, -1):
            chosen = [columns[i] for i in order if sign * weights[i] > least] + around
            chosen = chosen[-longest:] if longest else chosen
            if len(chosen) > 1:
                out.append(chosen)
    return out


def ward(points: np.ndarray, clusters: int) -> list[int]:
    """Agglomerative clustering of a few points (columns) by least growth of variance; labels from 0 in
    order of first member."""
    groups = [[i] for i in range(len(points))]
    while len(groups) > clusters:
        best = None
        for i, j in combinations(range(len(groups)), 2):
            a, b = points[groups[i]], points[groups[j]]
            cost = len(a) * len(b) / (len(a) + len(b)) * float(((a.mean(0) - b.mean(0)) ** 2).sum())
            if best is None or cost < best[0] - 1e-12:
                best = (cost, i, j)
        groups[best[1]] += groups.pop(best[2])
    labels = [0] * len(points)
    for k, g in enumerate(sorted(groups, key=min)):
        for i in g:
            labels[i] = k
    return labels


def hierarchical_sets(table: DataFrame, columns: Sequence[str], clusters: int = 3) -> list[list[str]]:
    """Columns clustered by their rows of the correlation matrix."""
    _, _, cov = _moments(table, columns)
    sd = np.sqrt(np.diag(cov))
    labels = ward(cov / np.outer(np.where(sd == 0, 1, sd), np.where(sd == 0, 1, sd)), clusters)
    return [[c for c, k in zip(columns, labels, strict=True) if k == n] for n in range(max(labels) + 1)]


def _assembled(table: DataFrame, columns: Sequence[str], target: str) -> tuple[DataFrame, list[str]]:
    others = [c for c in columns if c != target]
    rows = table.select(*[F.col(c).cast("double").alias(c) for c in columns]).na.drop()
    return VectorAssembler(inputCols=others, outputCol="features").transform(rows), others


def lasso_weights(cov: np.ndarray, alpha: float, rounds: int = 10_000, settled: float = 1e-12) -> np.ndarray:
    """Row t: the weights of all columns in a lasso for column t (its own is 0), from the columns' covariances over n rows. The loss is
    half the mean squared error plus alpha times the sum of the weights' sizes, with a free intercept. Weights are improved in
    turn, for all targets at once, until no target's explained variance moves by more than a share of `settled`."""
    k = len(cov)
    weights = np.zeros((k, k))
    scale = np.diag(cov)
    for _ in range(rounds):
        moved = 0.0
        for j in range(k):
            if scale[j] <= 0:  # a constant column explains nothing
                continue
            left = cov[:, j] - weights @ cov[:, j] + weights[:, j] * scale[j]
            now = np.sign(left) * np.maximum(np.abs(left) - alpha, 0) / scale[j]
            now[j] = 0
            moved = max(moved, float(((now - weights[:, j]) ** 2 * scale[j] / np.where(scale > 0, scale, 1)).max()))
            weights[:, j] = now
        if moved <= settled**2:
            break
    return weights


def _strongest(weights: np.ndarray, columns: Sequence[str], k: int | None) -> list[list[str]]:
    out = []
    for t, row in enumerate(weights):
        order = sorted(np.flatnonzero(row), key=lambda i: (-abs(row[i]), columns[i]))
        out.append([*(columns[i] for i in order[: k - 1 if k else None]), columns[t]])
    return out


def _whole_rows(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    return table.select(*[F.col(c).cast("double").alias(c) for c in columns]).na.drop()


def lasso_sets(table: DataFrame, columns: Sequence[str], alpha: float = 0.1, k: int | None = None) -> list[list[str]]:
    """For each column the predictors with a weight in a lasso for it (or the k - 1 strongest), and itself. One pass over the rows
    without NULLs gives the covariances, from which all targets are fitted."""
    n, _, cov = _moments(_whole_rows(table, columns), columns)
    return _strongest(lasso_weights(cov * ((n - 1) / n) if n else cov, alpha), columns, k)


def kernel_lasso_sets(table: DataFrame, columns: Sequence[str], alpha: float = 0.1, k: int | None = None, gamma: float = 0.15) -> list[list[str]]:
    """As `lasso_sets`, of the Gaussian kernel between standardised columns, whose rows and columns are the table's columns.
    Their squared distance a row is 2 - 2r, so the same pass gives the kernel."""
    _, _, cov = _moments(_whole_rows(table, columns), columns)
    kernel = _kernel(cov, gamma)
    return _strongest(lasso_weights(np.atleast_2d(np.cov(kernel, rowvar=False, bias=True)), alpha), columns, k)


def _edges(rows: DataFrame, columns: Sequence[str]) -> list[np.ndarray]:
    """For each column the values that end its bins but the last: of up to BINS different values all, of more the quantiles."""
    at = [k / BINS for k in range(1, BINS)]
    found = rows.agg(*[F.approx_count_distinct(c) for c in columns], *[F.percentile_approx(c, at, 10_000) for c in columns]).first()
    out = []
    for k, c in enumerate(columns):
        edges = found[len(columns) + k] or []
        if found[k] <= 2 * BINS:
            values = sorted(r[0] for r in rows.select(c).distinct().limit(BINS + 1).collect())
            edges = values[:-1] if len(values) <= BINS else edges
        out.append(np.unique(edges))
    return out


def _cells(rows: DataFrame, columns: Sequence[str], edges: list[np.ndarray], seed: int) -> DataFrame:
    """(target, cell, w, s): for each target (a place in columns) the cells of the other columns' bins, and for each tree how
    often the cell's rows are drawn and the target's sum over them. A row is drawn for a tree as often as a Poisson number of mean 1
    says, as MLlib's forests do. One pass; a task holds its sums only."""
    sizes = [len(e) + 1 for e in edges]
    shapes = [[1 if k == t else n for k, n in enumerate(sizes)] for t in range(len(columns))]
    names = [f"{x}{k}" for x in "ws" for k in range(TREES)]

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        sums = [np.zeros((2 * TREES, int(np.prod(shape)))) for shape in shapes]

        def add(held: list[pa.RecordBatch]) -> None:
            x = [c.to_numpy() for c in pa.Table.from_batches(held).columns]
            bins = [np.searchsorted(e, v) for e, v in zip(edges, x, strict=True)]
            times = [rng.poisson(1.0, len(x[0])).astype(np.float64) for _ in range(TREES)]
            for t, shape in enumerate(shapes):
                cell = np.ravel_multi_index([np.zeros_like(b) if k == t else b for k, b in enumerate(bins)], shape)
                for k, w in enumerate(times):
                    sums[t][k] += np.bincount(cell, w, sums[t].shape[1])
                    sums[t][TREES + k] += np.bincount(cell, w * x[t], sums[t].shape[1])

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= SOME:
                add(held)
                held, n = [], 0
        if n:
            add(held)
        for t, both in enumerate(sums):
            cell = np.flatnonzero(both[:TREES].any(0))
            made = [pa.array(np.full(len(cell), t, np.int32)), pa.array(cell), *[pa.array(v[cell]) for v in both]]
            yield pa.RecordBatch.from_arrays(made, ["target", "cell", *names])

    each = rows.select(*columns).mapInArrow(drawn, "target int, cell long, " + ", ".join(f"{n} double" for n in names))
    return each.groupBy("target", "cell").agg(*[F.sum(n).alias(n) for n in names])


def _importances(rows: DataFrame, columns: Sequence[str], edges: list[np.ndarray], seed: int) -> list[np.ndarray]:
    """For each column the importance of the columns in a random forest for it (its own is 0).

    MLlib's trees see a predictor's bin only, and what a split gains is what it moves the bins' means apart. So a tree of the
    cells, each with its mean and how often its rows were drawn, is the tree of the rows: rows are read once for
    all trees of all targets, and trees are fitted to as many cells as bins make, however many rows there are."""
    sizes = [len(e) + 1 for e in edges]
    cells = written(_cells(rows, columns, edges, seed).coalesce(1), "cells")
    out = [np.zeros(len(columns)) for _ in columns]

    def fitted(job: tuple[int, int]) -> tuple[int, list[int], np.ndarray]:
        t, tree = job
        others = [k for k in range(len(columns)) if k != t]
        step = {k: int(np.prod([sizes[j] for j in others if j > k])) for k in others}
        bins = [((F.col("cell") / step[k]).cast("long") % sizes[k]).cast("double").alias(columns[k]) for k in others]
        each = cells.where((F.col("target") == t) & (F.col(f"w{tree}") > 0)).select(*bins, F.col(f"w{tree}").alias("_times"), (F.col(f"s{tree}") / F.col(f"w{tree}")).alias("_mean"))
        each = VectorAssembler(inputCols=[columns[k] for k in others], outputCol="_features").transform(each)
        forest = RandomForestRegressor(featuresCol="_features", labelCol="_mean", weightCol="_times", numTrees=1, featureSubsetStrategy="onethird", maxBins=BINS, seed=seed + tree)
        return t, others, forest.fit(each).featureImportances.toArray()

    with ThreadPoolExecutor(AT_ONCE) as pool:
        for t, others, found in pool.map(fitted, [(t, tree) for t in range(len(columns)) for tree in range(TREES)]):
            out[t][others] += found
    return out


def forest_sets(table: DataFrame, columns: Sequence[str], k: int, seed: int = 0) -> list[list[str]]:
    """For each column the k - 1 most important predictors in a random forest for it, and itself. Where the columns' bins make
    more than CELLS cells, forests are fitted to the rows, one after the other."""
    columns, out = list(columns), []
    rows = _whole_rows(table, columns)
    edges = _edges(rows, columns)
    sizes = [len(e) + 1 for e in edges]
    if len(columns) > 1 and sum(math.prod(sizes) // n for n in sizes) <= CELLS and not rows.isEmpty():
        for t, found in enumerate(_importances(rows, columns, edges, seed)):
            order = sorted((i for i in range(len(columns)) if i != t), key=lambda i: (-float(found[i]), columns[i]))
            out.append([*(columns[i] for i in order[: k - 1]), columns[t]])
        return out
    for target in columns:
        rows, others = _assembled(table, columns, target)
        fit = RandomForestRegressor(labelCol=target, seed=seed).fit(rows)
        order = sorted(range(len(others)), key=lambda i: (-float(fit.featureImportances[i]), others[i]))
        out.append([*(others[i] for i in order[: k - 1]), target])
    return out


def grown_sets(sets: Sequence[Sequence[str]], related: Sequence[Sequence[str]], size: int, most: int | None = None) -> list[list[str]]:
    """For each set and each related one of as many members or more: what they share, filled up from the related
    one to exactly size, in all ways; a smaller related set as it is. Distinct, in order, at most `most` of them."""
    out = set()
    for s in map(set, sets):
        for other in map(set, related):
            if len(other) < len(s):
                out.add(tuple(sorted(other)))
                continue
            shared = s & other
            if len(shared) <= size:
                out |= {tuple(sorted((*shared, *more))) for more in combinations(sorted(other - s), size - len(shared))}
    return [list(x) for x in sorted(out)][:most]
