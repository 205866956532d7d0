"""Which sets lie in which others.

Sets of up to `LISTED` members say all their subsets of the sizes that are asked for, member by member, each written once
for all the sets that have it; who asks meets them by equality. So work is the different subsets', which members of a fixed vocabulary bound, and
no key has more rows than sets that are equal to it.

Larger ones go through an inverted index: a set can only lie in sets that hold its rarest member, so it asks one posting list, that of
the member that the fewest larger sets hold; what is met there is compared by 64 bits of its members first, then whole. Only lists that are asked are written. A list longer than BLOCK is cut into blocks by
a hash of the set, and who asks it asks each block: no task holds a hot member's list whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.plans.stages import written

#: Sets of a posting list that one key holds, about, and members up to which a set says its subsets.
BLOCK, LISTED = 50_000, 8


def _bits(members: str) -> Column:
    """64 bits, one of them set for each member: a set has all bits of what lies in it."""
    each = F.transform(members, lambda m: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(m), F.lit(64)).cast("int")))
    return F.aggregate(each, F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(y))


def _met(small: DataFrame, large: DataFrame, proper: bool, how: str) -> DataFrame:
    asks, has = small.select("a_members").where("a_members is not null").distinct(), large.select("b_members").where("b_members is not null").distinct()
    counts = has.select(F.explode("b_members").alias("member")).groupBy("member").agg(F.count("*").alias("n"))
    each = asks.where(F.size("a_members") > 0).select("a_members", F.explode("a_members").alias("member")).join(counts, "member", "left")
    # a member that no set holds has no count: its set lies nowhere
    rarest = each.groupBy("a_members").agg(F.min(F.struct("n", "member")).alias("by"), F.count_if(F.col("n").isNull()).alias("unknown")).where("unknown = 0")
    probes = written(rarest.select("a_members", "by.member", F.ceil(F.col("by.n") / BLOCK).alias("blocks")), "probes")
    asked = probes.select(F.col("member").alias("of"), "blocks").distinct()
    probes = probes.select("a_members", _bits("a_members").alias("a_bits"), "member", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - F.lit(1).cast("long"))).alias("block"))
    lists = has.select("b_members", _bits("b_members").alias("b_bits"), F.explode("b_members").alias("of")).join(asked, "of")
    lists = lists.select("b_members", "b_bits", "of", F.pmod(F.xxhash64("b_members"), "blocks").alias("at"))
    inside = (F.col("member") == F.col("of")) & (F.col("block") == F.col("at")) & (F.col("a_bits").bitwiseAND(F.col("b_bits")) == F.col("a_bits"))
    if proper:
        inside = inside & (F.size("b_members") > F.size("a_members"))
    met = probes.join(lists, inside & (F.size(F.array_except("a_members", "b_members")) == 0), how)
    empty = asks.where(F.size("a_members") == 0).limit(1)  # there's one at most
    nothing = empty.join(has.where(F.size("b_members") > 0) if proper else has, F.lit(True), how)
    names = ["a_members"] if how == "left_semi" else ["a_members", "b_members"]
    return met.select(*names).unionByName(nothing.select(*names))


def contained(small: DataFrame, large: DataFrame, proper: bool = False) -> DataFrame:
    """(a_members, b_members): pairs of a different set of small (a_members) and a different set of large (b_members), arrays of strings
    without repeats and NULLs, sorted, where the first lies in the second; with proper, and isn't the same.

    A NULL set lies in none and holds none. An empty one lies in every set (with proper: that isn't empty)."""
    return _met(small, large, proper, "inner")


def _listed(sets: DataFrame, asks: DataFrame, proper: bool) -> list[DataFrame]:
    """(a_members) of asks that lie in sets of up to LISTED members, size by size from the largest: what lies in a set of n is
    the set itself, or lies in what is left of it without one member. All are distinct and not empty."""
    sizes = sets.agg(F.max(F.size("b_members"))).first()[0] or 0
    least = asks.where(F.size("a_members") > 0).agg(F.min(F.size("a_members"))).first()[0] or LISTED + 1
    out, below = [], None
    for size in range(sizes, least - 1, -1):
        here = sets.where(F.size("b_members") == size)
        every = here if below is None else here.unionByName(below).distinct()
        if size > least:
            every = written(every, "level")
        among = below if proper else every
        if among is not None:
            met = among.withColumnRenamed("b_members", "a_members")
            out.append(asks.where(F.size("a_members") == size).join(met, "a_members", "left_semi"))
        below = every.select(F.explode(F.transform("b_members", lambda m: F.array_remove(F.col("b_members"), m))).alias("b_members")).distinct()
    return out


def covered(small: DataFrame, large: DataFrame, proper: bool = False) -> DataFrame:
    """(a_members) of `contained`, each once, without writing its pairs: short sets of large say what lies in them, a set's search
    of a list of longer ones ends where it's found."""
    asks = written(small.select("a_members").where("a_members is not null").distinct(), "asks")
    has = written(large.select("b_members").where("b_members is not null").distinct(), "sets")
    met = _listed(has.where(F.size("b_members").between(1, LISTED)), asks, proper)
    long = has.where(F.size("b_members") > LISTED)
    # the empty set lies in any; what only short sets may have needn't ask the lists
    met.append(_met(asks.where("size(a_members) = 0") if long.isEmpty() else asks, long.unionByName(has.where(F.size("b_members") <= LISTED).orderBy(F.size("b_members").desc()).limit(1)), proper, "left_semi"))
    return reduce(DataFrame.unionByName, met).distinct()
