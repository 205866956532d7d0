"""Vector search: exact, by blocks of queries against blocks of rows; neither side is collected.

A block's scores come from one product of matrices, which may differ from the score by definition (a sum from the first number
on, `functions/vectors.py`) by rounding. So it only says which pairs may count: those within its error of the k-th best.
Their scores are made again by definition, and these decide.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions.vectors import SIMILARITIES
from ferrule.plans.stages import written

#: Rows of a block (of 64 numbers: 16 MB), scores made at once, and pairs whose scores are made again at once.
BLOCK, AT_ONCE, AGAIN = 32_768, 1 << 20, 1 << 16
#: Blocks a side that small tables are cut into, and tasks at most.
LEAST, MOST_TASKS = 8, 1000
#: Queries (64 numbers each: 50 MB) up to which `all_scores` broadcasts them; beyond, Spark joins the two tables as it can.
BROADCAST_QUERIES = 100_000
#: Similarities by products of matrices; the others are scored pair by pair in Spark.
BY_PRODUCT = ("cosine", "dot")


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    flat = vectors.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _lengths(x: np.ndarray) -> np.ndarray:
    """Lengths, summed from the first number on."""
    total = np.zeros(len(x))
    for c in x.T:
        total += c * c
    return np.sqrt(total)


class _Pairs:
    """Scores of two blocks of vectors of one length."""

    def __init__(self, x: np.ndarray, y: np.ndarray, cosine: bool):
        self.x, self.y, self.cosine, self.nx, self.ny = x, y, cosine, _lengths(x), _lengths(y)
        rounding = 4 * (x.shape[1] + 8) * np.finfo(float).eps
        error = np.full(len(x), rounding) if cosine else rounding * self.nx * (self.ny.max() if len(y) else 0)
        self.error = np.where(np.isfinite(error), error, np.inf)
        # of unit vectors, so that no score is divided; places without a score are told by length
        self.u, self.v = (x / np.where(n == 0, 1, n)[:, None] if cosine else x for x, n in ((x, self.nx), (y, self.ny)))
        self.none = (self.nx == 0, self.ny == 0) if cosine else (np.zeros(len(x), bool), np.zeros(len(y), bool))
        self.odd = not (np.isfinite(self.nx).all() and np.isfinite(self.ny).all())

    def rough(self, rows: slice) -> np.ndarray:
        """Scores up to the error; -inf where there's none, inf for NaN, which Spark has above all."""
        out = self.u[rows] @ self.v.T
        if self.odd:
            out[np.isnan(out)] = np.inf
        out[self.none[0][rows]] = -np.inf
        if self.none[1].any():
            out[:, self.none[1]] = -np.inf
        return out

    def exact(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i))
        for lo in range(0, len(i), AGAIN):
            a, b = i[lo : lo + AGAIN], j[lo : lo + AGAIN]
            part, x, y = out[lo : lo + AGAIN], self.x[a], self.y[b]
            for at in range(x.shape[1]):
                part += x[:, at] * y[:, at]
            if self.cosine:
                part /= self.nx[a] * self.ny[b]
        return out

    def slices(self) -> Iterator[slice]:
        step = max(1, AT_ONCE // max(1, len(self.y)))
        return (slice(lo, min(lo + step, len(self.x))) for lo in range(0, len(self.x), step))


def _rounded(scores: np.ndarray, places: int) -> np.ndarray:
    """As Spark's round: half up, by the decimal digits of a number."""
    different, at = np.unique(scores, return_inverse=True)
    unit = Decimal(1).scaleb(-places)
    made = [float(Decimal(repr(s)).quantize(unit, ROUND_HALF_UP)) if math.isfinite(s) else s for s in different.tolist()]
    return np.array(made)[at] if made else scores


def _met(queries: DataFrame, corpus: DataFrame, made: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """What `made` gives for each block of queries and block of rows, for vectors of one length without null numbers."""
    # counts say only into how many blocks each side is dealt: up to LEAST for the sake of cores, then by size
    across, down = (max(1, -(-n // BLOCK), min(LEAST, -(-8 * n // BLOCK))) for n in (queries.count(), corpus.count()))
    tasks = min(MOST_TASKS, 4 * across * down)

    def dealt(side: DataFrame, own: str, own_blocks: int, other: str, others: int) -> DataFrame:
        rows = side.where(F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull()))
        kind = side.schema["vector"].dataType.simpleString()
        vector = F.col("vector") if kind == "array<float>" else F.col("vector").cast("array<double>")
        block, copies = F.pmod(F.xxhash64("id"), F.lit(own_blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        return rows.select("id", vector.alias("vector"), F.size("vector").alias("places"), block.alias(own), copies.alias(other))

    left = dealt(queries, "i", across, "j", down).repartition(tasks, "places", "i", "j").groupBy("places", "i", "j")
    right = dealt(corpus, "j", down, "i", across).repartition(tasks, "places", "i", "j").groupBy("places", "i", "j")
    return left.cogroup(right).applyInArrow(made, schema)


def _best(pairs: _Pairs, rows: slice, ids: np.ndarray, k: int, places: int | None, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, score) of the k best of each row, none below the floor; ties: the smallest id."""
    rough = pairs.rough(rows)
    wide = pairs.error[rows] + (0 if places is None else 10.0**-places)
    least = np.full(len(rough), floor)
    many = np.count_nonzero(rough >= floor - wide[:, None], axis=1) > k if math.isfinite(floor) else np.full(len(rough), rough.shape[1] > k)
    if many.any():
        least[many] = np.maximum(floor, np.partition(rough[many], -k, axis=1)[:, -k])
    bound = np.where(np.isfinite(wide), least - 2 * np.where(np.isfinite(wide), wide, 0), -np.inf)
    at, j = np.nonzero((rough >= bound[:, None]) & (rough > -np.inf))
    i = at + rows.start
    score = pairs.exact(i, j)
    if places is not None:
        score = _rounded(score, places)
    order = np.lexsort((ids[j], -score, ~np.isnan(score), i))
    i, j, score = i[order], j[order], score[order]
    new = np.r_[True, i[1:] != i[:-1]] if len(i) else np.zeros(0, bool)
    nth = np.arange(len(i)) - np.maximum.accumulate(np.where(new, np.arange(len(i)), 0))
    good = (nth < k) & ~(score < floor)
    return i[good], j[good], score[good]


def semantic_search(queries: DataFrame, corpus: DataFrame, k: int, similarity: str | Callable[[Column, Column], Column] = "cosine", places: int | None = None, floor: float | None = None) -> DataFrame:
    """(query_id, corpus_id, score, rank): each query's exact k nearest; ties: the smallest id. Both tables: (id, vector).

    places: scores are rounded before they're ranked. floor: pairs of lower scores are left out. A block of rows gives k
    rows for each query, so that these move and no others."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "corpus_id")
    if similarity not in BY_PRODUCT:
        scored = all_scores(queries, corpus, similarity)
        scored = scored if places is None else scored.withColumn("score", F.round("score", places))
        scored = scored if floor is None else scored.where(F.col("score") >= floor)
        return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[pa.Table] = []
        if len(left) and len(right):
            pairs = _Pairs(_matrix(left["vector"]), _matrix(right["vector"]), similarity == "cosine")
            ranks = np.argsort(np.argsort(right["id"].to_numpy(), kind="stable"), kind="stable")
            for rows in pairs.slices():
                i, j, score = _best(pairs, rows, ranks, k, places, -math.inf if floor is None else floor)
                out.append(pa.table([left["id"].take(pa.array(i)), right["id"].take(pa.array(j)), pa.array(score)], ["query_id", "corpus_id", "score"]))
        none = pa.table([left["id"].slice(0, 0), right["id"].slice(0, 0), pa.array([], pa.float64())], ["query_id", "corpus_id", "score"])
        return pa.concat_tables([none, *out])

    kinds = [s.schema["id"].dataType.simpleString() for s in (queries, corpus)]
    found = _met(queries, corpus, nearest, f"query_id {kinds[0]}, corpus_id {kinds[1]}, score double")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _nearest_others(vectors: DataFrame, corpus: DataFrame, k: int, similarity: str, floor: float | None = None) -> DataFrame:
    found = semantic_search(vectors, corpus, k + 1, similarity, floor=floor).where("query_id <> corpus_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "corpus_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mined_pairs(vectors: DataFrame, k: int, most: int, similarity: str = "cosine") -> DataFrame:
    """(a, b, score): the `most` best pairs a < b among each row's k nearest; a top-k report.

    All rows are met with all rows. What moves is kept small by a score that the report can't go below: if the rows of one block
    have 2 * most pairs (row, one of its k nearest in the block) of that score or more, all rows have as many, since a row's nearest of all
    are no farther than its nearest in the block; and a pair is named twice at most. It leaves out only what the report would."""
    floor = None
    if (n := vectors.count()) > BLOCK:
        some = written(vectors.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(-(-n // BLOCK))) == 0).select("id", "vector"), "some")
        named = _nearest_others(some, some, k, similarity).orderBy(F.desc("score")).limit(2 * most)
        seen = named.agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
        floor = seen.least if seen.n == 2 * most else None
    found = _nearest_others(vectors, vectors, k, similarity, floor)
    pairs = found.select(F.least("query_id", "corpus_id").alias("a"), F.greatest("query_id", "corpus_id").alias("b"), "score")
    return pairs.groupBy("a", "b").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "a", "b").limit(most)


def similarity_histogram(pairs: DataFrame, width: float = 0.02) -> DataFrame:
    """(bin, n) of scores."""
    return pairs.groupBy(F.floor(F.col("score") / width).alias("bin")).agg(F.count("*").alias("n"))


def all_similarities_histogram(queries: DataFrame, corpus: DataFrame, places: int = 6, width: float = 0.02, similarity: str = "cosine") -> DataFrame:
    """(bin, n) of the scores of each query and each row, rounded: `similarity_histogram` of `all_scores`, counted block by block."""

    def counted(left: pa.Table, right: pa.Table) -> pa.Table:
        total: dict[int, int] = {}
        if len(left) and len(right):
            pairs = _Pairs(_matrix(left["vector"]), _matrix(right["vector"]), similarity == "cosine")
            unit = 10.0**places
            for rows in pairs.slices():
                rough = pairs.rough(rows)
                whole = np.rint(rough * unit)
                # near the middle of two rounded numbers, or without a bound, the score by definition decides
                doubtful = ~(np.abs(np.abs(rough * unit - whole) - 0.5) > 1e-6 + unit * pairs.error[rows, None]) & (rough > -np.inf)
                with np.errstate(invalid="ignore"):
                    bins = np.floor(whole / unit / width)
                i, j = np.nonzero(doubtful)
                if len(i):
                    bins[i, j] = np.floor(_rounded(pairs.exact(i + rows.start, j), places) / width)
                held = bins[np.isfinite(bins)].astype(np.int64)
                least = held.min() if len(held) else 0
                for b, c in enumerate(np.bincount(held - least).tolist()) if len(held) and held.max() - least < AT_ONCE else zip(*(x.tolist() for x in np.unique(held - least, return_counts=True)), strict=True):
                    if c:
                        total[int(b + least)] = total.get(int(b + least), 0) + c
        return pa.table([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["bin", "n"])

    if similarity not in BY_PRODUCT:
        return similarity_histogram(all_scores(queries, corpus, similarity).withColumn("score", F.round("score", places)), width)
    return _met(queries, corpus, counted, "bin bigint, n bigint").groupBy("bin").agg(F.sum("n").alias("n"))


def all_scores(queries: DataFrame, corpus: DataFrame, similarity: str | Callable[[Column, Column], Column] = "cosine") -> DataFrame:
    """(query_id, corpus_id, score) of each query and each row, pair by pair in Spark: for few queries, and for
    similarities that aren't products of matrices."""
    score = SIMILARITIES[similarity] if isinstance(similarity, str) else similarity
    asked = queries.select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    if queries.count() <= BROADCAST_QUERIES:
        asked = F.broadcast(asked)
    met = corpus.select(F.col("id").alias("corpus_id"), "vector").join(asked, F.lit(True))
    return met.select("query_id", "corpus_id", score(F.col("query"), F.col("vector")).alias("score")).where("score is not null")
