"""Functions of numeric array columns. All sums are in double precision, from the first element on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _summed(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _summed(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector has length 0."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine(a, b)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_summed(F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column, b: Column) -> Column:
    return _summed(F.zip_with(_doubles(a), _doubles(b), lambda x, y: F.abs(x - y)))


def gaussian_kernel(a: Column, b: Column, gamma: float) -> Column:
    return F.exp(-gamma * _summed(F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y))))


def normalised(a: Column) -> Column:
    """A unit vector; a vector of length 0 stays as it is."""
    length = norm(a)
    return F.when(length > 0, F.transform(_doubles(a), lambda x: x / length)).otherwise(_doubles(a))


#: The pluggable similarities; distances are negated, so that more is nearer.
SIMILARITIES: dict[str, Callable[[Column, Column], Column]] = {
    "cosine": cosine,
    "dot": dot,
    "euclidean": lambda a, b: -euclidean(a, b),
    "manhattan": lambda a, b: -manhattan(a, b),
}


def _by_place(tokens: Column, start: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """An array of vectors merged place by place."""
    return F.aggregate(tokens, start, lambda acc, v: F.zip_with(acc, v, merge))


#: The ways of `pooled`.
POOLINGS = ("first", "max", "mean", "mean_sqrt_length", "weighted_mean", "last")


def pooled(tokens: Column, mask: Column, how: str, weights_sum: Column | None = None) -> Column:
    """One vector for an array of token vectors, by the tokens whose mask is 1 (but for first: the first token).

    weighted_mean weighs tokens by their place from 1. weights_sum takes the place of the number (or sum
    of weights) of tokens that means are divided by. last is the token before the first 0 of the mask; where no 0 is
    in the mask, or it comes first, it's the first token, masked too. max of no token is -1e9 everywhere."""
    if how not in POOLINGS:
        raise ValueError(f"unknown pooling {how!r}")
    vectors, mask = tokens.cast("array<array<double>>"), mask.cast("array<double>")
    places = F.sequence(F.lit(1), F.size(vectors[0]))
    zeros, masked = F.transform(places, lambda _: F.lit(0.0)), F.zip_with(vectors, mask, lambda v, m: F.transform(v, lambda x: x * m))
    if how == "first":
        return vectors[0]
    if how == "max":
        hidden = F.zip_with(vectors, mask, lambda v, m: F.transform(v, lambda x: F.when(m == 0, F.lit(-1e9)).otherwise(x)))
        return _by_place(hidden, F.transform(places, lambda _: F.lit(float("-inf"))), lambda a, x: F.greatest(a, x))
    if how == "last":
        return masked[F.greatest(F.array_position(mask, F.lit(0.0)).cast("int") - 2, F.lit(0))]
    weights = F.transform(mask, lambda m, i: m * (i + 1)) if how == "weighted_mean" else mask
    total = _by_place(F.zip_with(vectors, weights, lambda v, w: F.transform(v, lambda x: x * w)), zeros, lambda a, x: a + x)
    by = F.greatest(_summed(weights) if weights_sum is None else weights_sum.cast("double"), F.lit(1e-9))
    by = F.sqrt(by) if how == "mean_sqrt_length" else by
    return F.transform(total, lambda x: x / by)


def chunk_average(chunks: Column) -> Column:
    """The unit vector of the mean of chunks' vectors."""
    return normalised(pooled(chunks, F.transform(chunks, lambda _: F.lit(1)), "mean"))
