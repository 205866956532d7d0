"""All pairs of points within a radius, exactly, without comparing all points.

A few points are pivots, and each point lives in the cell of its nearest one. A point within r of a point of a cell is at most
r + the cell's reach from its pivot, and, since both are nearest to their own pivots, at most 2r farther from that pivot than from
its own. So each point is copied as a guest into the cells for which both hold, and residents are compared with residents and
guests of their cell: each pair is met in the home of its first point. Cells are cut into blocks, so that a group has at
most two blocks, however full a cell is. Points with equal vectors are one point (`collapsed`).

In many dimensions nearly every point may be a guest of nearly every cell. Guests are counted before any is copied, and where
their copies would cost more than comparing all points, blocks of all points are compared: each point is then copied as often as there are blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.functions.vectors import normalised
from ferrule.plans.stages import written

#: Pivots at most (of 64 numbers: half a megabyte), points for each, and points of a block.
MOST_PIVOTS, PER_PIVOT, BLOCK = 1024, 256, 512
#: Points of a block where all are compared, distances made at once, and pairs or copies made at once.
WHOLE, AT_ONCE, SOME = 16_384, 1 << 20, 1 << 16
#: Points of a block where pairs are only counted, and of the tiles (of rows and columns) whose products stay in a core's cache.
COUNTED, TILE = 65_536, (64, 4096)
#: Blocks that few points are cut into, for the sake of cores, and tasks at most.
LEAST, MOST_TASKS = 8, 1000
#: What a copy of a point costs, in distances.
COPY = 100
#: What rounding may add to a distance, as a share of the largest length.
SLACK = 1e-7


def collapsed(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Different vectors as (id, vector, n), by the smallest of their ids, and (id, of) of every point. Null vectors are left out."""
    rows = points.where(F.col("vector").isNotNull()).select("id", F.col("vector").cast("array<double>").alias("vector"))
    different = written(rows.groupBy("vector").agg(F.min("id").alias("of"), F.count("*").alias("n")), "different")
    member = rows.join(different.select(F.col("vector").alias("same"), "of"), F.col("vector") == F.col("same")).select("id", "of")
    return different.select(F.col("of").alias("id"), "vector", "n"), member


def _lengths(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def matrix(vectors: pa.Array) -> np.ndarray:
    sizes = np.diff(np.asarray(vectors.offsets))
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors must be of one length")
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def _cells(points: DataFrame, radius: float) -> tuple[Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """A function that says for vectors which cells they are in and which is their own, and how many residents and members each cell has."""
    spark = points.sparkSession
    k = min(MOST_PIVOTS, max(1, points.count() // PER_PIVOT))
    chosen = points.orderBy(F.xxhash64("id"), "id").limit(k).select("vector").collect()  # MOST_PIVOTS at most
    sent = spark.sparkContext.broadcast(np.array([r.vector for r in chosen]))

    def farthest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = np.full(len(sent.value), -1.0)
        for batch in batches:
            if len(batch):
                d = _lengths(matrix(batch.column(0)), sent.value)
                np.maximum.at(reach, d.argmin(1), d.min(1))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(reach), dtype=np.int32)), pa.array(reach)], ["cell", "reach"])

    reach = np.full(k, -1.0)
    for r in points.select("vector").mapInArrow(farthest, "cell int, reach double").groupBy("cell").agg(F.max("reach").alias("reach")).collect():
        reach[r.cell] = r.reach

    def near(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pivots = sent.value
        d = _lengths(x, pivots)
        home = d.argmin(1)
        slack = SLACK * (1 + np.sqrt((x * x).sum(1).max()) + np.abs(pivots).max())
        out = (d <= reach[None] + radius + slack) & (d - d.min(1)[:, None] <= 2 * radius + slack) & (reach >= 0)[None]
        out[np.arange(len(x)), home] = True
        return out, home

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, k), np.int64)
        for batch in batches:
            if len(batch):
                inside, home = near(matrix(batch.column(0)))
                total += np.bincount(home, minlength=k), inside.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), *map(pa.array, total)], ["cell", "own", "all"])

    sizes = np.zeros((k, 2), np.int64)
    for r in points.select("vector").mapInArrow(counted, "cell int, own long, all long").groupBy("cell").agg(F.sum("own").alias("own"), F.sum("all").alias("all")).collect():
        sizes[r.cell] = r.own, r.all
    return near, sizes


def placed(points: DataFrame, radius: float) -> tuple[DataFrame, np.ndarray]:
    """(cell, resident, id, vector): each point in its own cell, and as a guest in those that it may have near points in;
    and how many residents and members each cell has."""
    near, sizes = _cells(points, radius)
    kind = points.schema["id"].dataType.simpleString()

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            inside, home = near(matrix(batch.column(1)))
            row, cell = np.nonzero(inside)
            for lo in range(0, len(row), SOME):
                r, c = row[lo : lo + SOME], cell[lo : lo + SOME]
                made = batch.take(pa.array(r))
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(home[r] == c), *made.columns], ["cell", "resident", "id", "vector"])

    return points.select("id", "vector").mapInArrow(dealt, f"cell int, resident boolean, id {kind}, vector array<double>"), sizes


def _nearest(i: np.ndarray, j: np.ndarray, distance: np.ndarray, most: int) -> np.ndarray:
    """Which pairs are among the `most` nearest of their i."""
    order = np.lexsort((j, distance, i))
    at = i[order]
    first = np.maximum.accumulate(np.where(np.r_[True, at[1:] != at[:-1]], np.arange(len(at)), 0)) if len(at) else at
    return order[np.arange(len(at)) - first < most]


def within(points: DataFrame, radius: float, most: int | None = None) -> DataFrame:
    """(a, b, distance) of all pairs a <> b of different points (id, vector) no farther apart than the radius (euclidean), each
    both ways. Ids are different; collapse equal vectors first, else all their pairs are written out.

    most: of each pair of blocks, only the `most` nearest of each a, so that the `most` nearest of all are there, and few more."""
    spark, kind = points.sparkSession, points.schema["id"].dataType.simpleString()
    if points.isEmpty():
        return spark.createDataFrame([], f"a {kind}, b {kind}, distance double")
    _, sizes = _cells(points, radius)
    n = int(sizes[:, 0].sum())
    blocks = np.maximum(1, -(-sizes // BLOCK))
    across = max(-(-n // WHOLE), min(LEAST, -(-LEAST * n // WHOLE)))
    cost = (sizes[:, 0] * (COPY * blocks[:, 1] + sizes[:, 1])).sum() + COPY * (sizes[:, 1] * (1 + blocks[:, 0])).sum()
    whole = cost > n * (2 * COPY * across + n)
    if whole:
        members, blocks = points.select(F.lit(0).alias("cell"), F.lit(True).alias("resident"), "id", F.col("vector").cast("array<double>").alias("vector")), np.array([[across, across]])
    else:
        members = written(placed(points, radius)[0], "members")
    told = spark.createDataFrame([(k, *b) for k, b in enumerate(blocks.tolist())], "of int, own_blocks int, all_blocks int")  # one row a pivot
    rows = members.join(F.broadcast(told), F.col("cell") == F.col("of"))
    own = rows.where("resident").select("cell", F.pmod(F.xxhash64("id"), F.col("own_blocks")).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("all_blocks") - F.lit(1).cast("long"))).alias("j"), F.lit(True).alias("first"), "id", "vector")
    met = rows.select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("own_blocks") - F.lit(1).cast("long"))).alias("i"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("all_blocks")).alias("j"), F.lit(False).alias("first"), "id", "vector")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(batches).select(["first", "id", "vector"])
        first = group["first"].to_numpy()
        left, right = (group.filter(pa.array(side)) for side in (first, ~first))
        if not len(left) or not len(right):
            return
        x, y = (matrix(side["vector"].combine_chunks()) for side in (left, right))
        a, b = left["id"].to_numpy(), right["id"].to_numpy()
        bound, step = radius + SLACK * (1 + np.abs(x).max() * x.shape[1] ** 0.5), max(1, AT_ONCE // len(y))
        for lo in range(0, len(x), step):
            i, j = np.nonzero(_lengths(x[lo : lo + step], y) <= bound)
            i += lo
            exact = np.empty(len(i))
            for at in range(0, len(i), SOME):
                part = slice(at, at + SOME)
                exact[part] = np.sqrt(((x[i[part]] - y[j[part]]) ** 2).sum(1))
            good = np.flatnonzero((exact <= radius) & (a[i] != b[j]))
            if most is not None:
                good = good[_nearest(i[good], j[good], exact[good], most)]
            made = [left["id"].take(pa.array(i[good])), right["id"].take(pa.array(j[good])), pa.array(exact[good])]
            yield from pa.table(made, ["a", "b", "distance"]).combine_chunks().to_batches()

    every = own.unionByName(met)
    if whole:  # few and equal groups, which would share tasks
        every = every.repartition(min(MOST_TASKS, 4 * across * across), "cell", "i", "j")
    return every.groupBy("cell", "i", "j").applyInArrow(compared, f"a {kind}, b {kind}, distance double")


def similar(points: DataFrame, least: float) -> DataFrame:
    """(a, b, score) of all pairs of cosine `least` or more, both ways: unit vectors within a radius. Vectors of length 0 have none."""
    unit = points.where(F.exists("vector", lambda x: x != 0)).select("id", normalised(F.col("vector")).alias("vector"))
    found = within(unit, float(max(0.0, 2 - 2 * least)) ** 0.5 + 1e-9)
    return found.select("a", "b", (1 - F.col("distance") * F.col("distance") / 2).alias("score")).where(F.col("score") >= least - 1e-12)


class Near:
    """Which rows of unit vectors x and y are of cosine `least` or more, by the same definition as `similar`: products in single
    precision say it of most pairs, and those too near to the bound are measured exactly."""

    def __init__(self, y: np.ndarray, least: float) -> None:
        self.y, self.single = y, np.ascontiguousarray(y.T, np.float32)
        self.least, self.radius = least, float(max(0.0, 2 - 2 * least)) ** 0.5 + 1e-9
        self.slack = np.float32(4e-7 * (8 + y.shape[1]))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        product = x.astype(np.float32) @ self.single
        maybe, out = product >= np.float32(self.least) - self.slack, product > np.float32(self.least) + self.slack
        if np.count_nonzero(maybe) > np.count_nonzero(out):
            i, j = np.divmod(np.flatnonzero(maybe ^ out), product.shape[1])
            for at in range(0, len(i), SOME):
                a, b = i[at : at + SOME], j[at : at + SOME]
                d = np.sqrt(((x[a] - self.y[b]) ** 2).sum(1))
                out[a, b] = (d <= self.radius) & (1 - d * d / 2 >= self.least - 1e-12)
        return out


class Close:
    """Which rows of x and y are no farther apart than the radius, by the same definition as `within`: products say it of most pairs, and
    those too near to the bound are measured exactly. In single precision where that decides nearly all."""

    def __init__(self, y: np.ndarray, radius: float) -> None:
        self.y, self.radius, self.middle = y, radius, y.mean(0)
        moved = y - self.middle
        self.square = (moved * moved).sum(1)
        self.single = bool(self.square.max(initial=0) < min(1e30, 1e3 * radius * radius))
        self.turned = np.ascontiguousarray(moved.T, np.float32 if self.single else np.float64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        moved = x - self.middle
        square = (moved * moved).sum(1)
        single = self.single and bool(square.max(initial=0) < 1e30)
        kind = np.float32 if single else np.float64
        d = (-2 * moved).astype(kind) @ self.turned
        d += square.astype(kind)[:, None]
        d += self.square.astype(kind)[None]
        slack = (8e-7 if single else 2e-15) * (8 + x.shape[1]) * (square.max(initial=0) + self.square.max(initial=0) + self.radius * self.radius)
        maybe, out = d <= kind(self.radius * self.radius + slack), d < kind(self.radius * self.radius - slack)
        if np.count_nonzero(maybe) > np.count_nonzero(out):
            i, j = np.divmod(np.flatnonzero(maybe ^ out), d.shape[1])
            for at in range(0, len(i), SOME):
                a, b = i[at : at + SOME], j[at : at + SOME]
                out[a, b] = np.sqrt(((x[a] - self.y[b]) ** 2).sum(1)) <= self.radius
        return out


def _trues(x: np.ndarray) -> np.ndarray:
    """How many of each row are true; eight bytes are added at once, up to 255 times."""
    n = x.shape[1] // 1024 * 1024
    by = x[:, :n].reshape(len(x), -1, 1024).view(np.uint64).sum(2, dtype=np.uint64)
    return by.view(np.uint8).sum(1, dtype=np.int64) + np.count_nonzero(x[:, n:], 1)


def _faced(asking: DataFrame, answering: DataFrame) -> DataFrame:
    """(i, j, first, id, vector, said) of both (id, vector, said), cut into blocks: each group i, j is a block of the first with one of the second."""
    many = [max(1, -(-n // COUNTED)) for n in (asking.count(), answering.count())]
    many[0] = max(many[0], -(-LEAST // many[1]))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    own = lambda k: F.pmod(F.xxhash64("id"), F.lit(k)).cast("int")
    left = asking.select(own(many[0]).alias("i"), every(many[1]).alias("j"), F.lit(True).alias("first"), "id", "vector", "said")
    right = answering.select(every(many[0]).alias("i"), own(many[1]).alias("j"), F.lit(False).alias("first"), "id", "vector", "said")
    return left.unionByName(right).repartition(min(MOST_TASKS, many[0] * many[1]), "i", "j")


def sides(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Table, pa.Table]:
    """The first ones of a group (first, id, vector, said), and the others."""
    group = pa.Table.from_batches(batches).select(["first", "id", "vector", "said"])
    first = group["first"].to_numpy()
    left, right = (group.filter(pa.array(side)).combine_chunks() for side in (first, ~first))
    return left, right


def around(asking: DataFrame, answering: DataFrame, least: float, near: type = Near, enough: int | None = None) -> DataFrame:
    """(id, n) of asking points (id, vector): the sum of n of the answering ones (id, vector, n) of cosine `least` or more, and of
    the same id. Unit vectors. Blocks of one are met with blocks of the other, and only sums come out, however many pairs there are.
    near: what says it (`Close`: no farther apart than `least`). enough: sums of so much or more may be any that are."""
    kind = asking.schema["id"].dataType.simpleString()
    rows = _faced(asking.withColumn("said", F.lit(0).cast("long")), answering.withColumn("said", F.col("n").cast("long")))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = sides(batches)
        if not len(left) or not len(right):
            return
        x, y = (matrix(side["vector"].combine_chunks()) for side in (left, right))
        weight = right["said"].to_numpy().astype(np.float64)
        alone = bool((weight == 1).all())
        _, mine, its = np.intersect1d(left["id"].to_numpy(), right["id"].to_numpy(), return_indices=True)
        same, sums = np.full(len(x), -1), np.zeros(len(x), np.int64)
        same[mine] = its
        rows, columns = TILE
        for at in range(0, len(y), columns):
            nearby = near(y[at : at + columns], least)
            todo = np.arange(len(x)) if enough is None else np.flatnonzero(sums < enough)
            for lo in range(0, len(todo), rows):
                some = todo[lo : lo + rows]
                met, own = nearby(x[some]), same[some] - at
                here = np.flatnonzero((own >= 0) & (own < columns))
                met[here, own[here]] = True
                sums[some] += _trues(met) if alone else (met @ weight[at : at + columns]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([left["id"].combine_chunks(), pa.array(sums)], ["id", "n"])

    return rows.groupBy("i", "j").applyInArrow(summed, f"id {kind}, n long").groupBy("id").agg(F.sum("n").alias("n"))


def least_around(asking: DataFrame, answering: DataFrame, least: float, near: type = Near) -> DataFrame:
    """(id, least) of asking points (id, vector): the smallest `said` of the answering ones (id, vector, said) that are near."""
    kind, type_ = (df.schema[c].dataType.simpleString() for df, c in ((asking, "id"), (answering, "said")))
    rows = _faced(asking.withColumn("said", F.lit(None).cast(type_)), answering)

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = sides(batches)
        if not len(left) or not len(right):
            return
        right = right.sort_by("said")
        x, y = (matrix(side["vector"].combine_chunks()) for side in (left, right))
        first, columns = np.full(len(x), -1), TILE[1]
        for at in range(0, len(y), columns):  # the first that is near has the smallest
            nearby, todo = near(y[at : at + columns], least), np.flatnonzero(first < 0)
            for lo in range(0, len(todo), TILE[0]):
                some = todo[lo : lo + TILE[0]]
                met = nearby(x[some])
                first[some] = np.where(met.any(1), met.argmax(1) + at, -1)
        good = np.flatnonzero(first >= 0)
        yield from pa.table([left["id"].take(pa.array(good)), right["said"].take(pa.array(first[good]))], ["id", "least"]).combine_chunks().to_batches()

    return rows.groupBy("i", "j").applyInArrow(smallest, f"id {kind}, least {type_}").groupBy("id").agg(F.min("least").alias("least"))


def joined(x: np.ndarray, y: np.ndarray, part: np.ndarray, least: float, near: type, inner: bool) -> np.ndarray:
    """Parts (0, 1, ...) of points after what is near is joined: of x with x (inner), or of x with y, whose parts follow those of x.

    Points of the largest part aren't compared with one another: whatever of them is near another part is met from there."""
    ends = [(x, 0, 0)] if inner else [(x, 0, len(x)), (y, len(x), 0)]
    cut = [[(at, near(other[at : at + TILE[1]], least)) for at in range(0, len(other), TILE[1])] for other in ([x] if inner else [y, x])]
    part, met = part.copy(), np.zeros(len(part), bool)
    # at the end all points outside the largest part, on both sides, have met all of the other
    while True:
        apart = (part != np.bincount(part).argmax()) & ~met
        for (mine, start, its), tiles in zip(ends, cut, strict=True):
            todo = np.flatnonzero(apart[start : start + len(mine)])[: TILE[0]]
            if not len(todo):
                continue
            met[start + todo] = True
            for at, nearby in tiles:
                found = nearby(mine[todo])
                theirs = part[its + at : its + at + found.shape[1]]  # a view: what is joined below is seen here
                for row in np.flatnonzero(found.any(1)):
                    has = theirs[found[row]]
                    own = part[start + todo[row]]
                    if (has != own).any():
                        both = np.zeros(part.max() + 1, bool)
                        both[has], both[own] = True, True
                        part[both[part]] = np.flatnonzero(both)[0]
            break
        else:
            return part
