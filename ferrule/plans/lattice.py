"""Attribute sets as data: one plan counts all sets of a level.

The table is compressed to its distinct rows and their counts first. A candidate (LHS, RHS) is one number,
the bits of its left side and the place of its right side; a level is one literal array of them, so the plan has the
same size however many there are. Each compressed row is unfolded once for each candidate of the level, and the
whole level is one aggregation keyed by candidate and values.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.functions.text import as_text

#: Low bits of a candidate's number, which hold its right side; the others hold the left side.
RHS_BITS = 6
#: So many attributes fit a number.
MOST_ATTRIBUTES = 57


@dataclass(frozen=True)
class Candidate:
    lhs: tuple[str, ...]
    rhs: str


def candidates(attributes: Sequence[str], largest: int, smallest: int = 1) -> list[Candidate]:
    """All (LHS, RHS) with smallest to largest attributes on the left, in order of size."""
    ordered = sorted(attributes)
    return [Candidate(x, a) for k in range(smallest, largest + 1) for x in combinations(ordered, k) for a in ordered if a not in x]


def compressed(table: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """The distinct rows as text, with their count n. All mining reads this."""
    return table.select(*[as_text(F.col(a)).alias(a) for a in attributes]).groupBy(*attributes).agg(F.count("*").alias("n"))


def _ordered(counts: DataFrame) -> list[str]:
    names = sorted(c for c in counts.columns if c != "n")
    if len(names) > MOST_ATTRIBUTES:
        raise ValueError(f"{len(names)} attributes, at most {MOST_ATTRIBUTES} can be mined at once")
    return names


def number(candidate: Candidate, ordered: Sequence[str]) -> int:
    left = sum(1 << ordered.index(a) for a in candidate.lhs)
    return left << RHS_BITS | ordered.index(candidate.rhs)


def _numbers(numbers: Iterable[int]) -> Column:
    """A literal array, folded once, made from one string."""
    text = ",".join(map(str, numbers))
    empty = F.array().cast("array<bigint>")
    return F.split(F.lit(text), ",").cast("array<bigint>") if text else empty


def chosen(values: Column, bits: Column) -> Column:
    """The elements of values whose bits are set, in order."""
    return F.filter(values, lambda _, i: F.getbit(bits, i) == 1)


def unfolded(counts: DataFrame, level: Iterable[Candidate]) -> DataFrame:
    """(candidate, x, a, n): for each candidate, the counts of its values; x is parallel to its left side."""
    ordered = _ordered(counts)
    rows = counts.select(F.array(*[F.col(f"`{a}`") for a in ordered]).alias("row"), "n", F.explode(_numbers(number(c, ordered) for c in level)).alias("candidate"))
    place = F.col("candidate").bitwiseAND((1 << RHS_BITS) - 1).cast("int")
    values = rows.select("candidate", chosen(F.col("row"), F.shiftright("candidate", RHS_BITS)).alias("x"), F.col("row")[place].alias("a"), "n")
    return values.groupBy("candidate", "x", "a").agg(F.sum("n").alias("n"))


def unfolded_sets(counts: DataFrame, sets: Iterable[tuple[str, ...]]) -> DataFrame:
    """(attrs, x): the distinct values of each attribute set."""
    ordered = _ordered(counts)
    numbers = _numbers(sum(1 << ordered.index(a) for a in x) for x in sets)
    rows = counts.select(F.array(*[F.col(f"`{a}`") for a in ordered]).alias("row"), F.explode(numbers).alias("bits"))
    values = rows.select("bits", chosen(F.col("row"), F.col("bits")).alias("x")).distinct()
    return values.select(chosen(_names(ordered), F.col("bits")).alias("attrs"), "x")


def _names(ordered: Sequence[str]) -> Column:
    return F.array(*map(F.lit, ordered))


def named(found: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """found with lhs and rhs, the names of its candidate's attributes, in place of the candidate."""
    names = _names(sorted(attributes))
    place = F.col("candidate").bitwiseAND((1 << RHS_BITS) - 1).cast("int")
    rest = [c for c in found.columns if c != "candidate"]
    return found.select(chosen(names, F.shiftright("candidate", RHS_BITS)).alias("lhs"), names[place].alias("rhs"), *rest)


def classes(values: DataFrame) -> DataFrame:
    """(candidate, x, n, most, low, high): the rows of each class of LHS values, the count of its most
    frequent RHS value, and the least and greatest RHS value."""
    return values.groupBy("candidate", "x").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.min("a").alias("low"), F.max("a").alias("high"))


def patterns(grouped: DataFrame) -> DataFrame:
    """(candidate, pattern, support, hits, low, high): classes summed over all patterns of constants with a
    wildcard or more, which is NULL in pattern. This is GROUPING SETS over the classes of every candidate at once."""
    every = F.sequence(F.lit(0), F.expr("shiftleft(1, size(x)) - 2"))
    rows = grouped.withColumn("mask", F.explode(every))
    rows = rows.withColumn("pattern", F.transform("x", lambda v, i: F.when(F.getbit("mask", i) == 1, v)))
    return rows.groupBy("candidate", "pattern").agg(F.sum("n").alias("support"), F.sum("most").alias("hits"), F.min("low").alias("low"), F.max("high").alias("high"))
