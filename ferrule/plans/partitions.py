"""Stripped partitions of a table by all its attribute sets, carried from level to level.

A set's classes are the groups of rows that agree on it; a stripped partition leaves out those of one row, which stay alone on
every larger set. Rows are carried as (set, values, rest, n): n rows of one class of the set that agree on
`rest` too, the values of the attributes after the set's last one, which are all that its larger sets will read. A level
is the last one's classes, each split by the values of one later attribute: every set is reached once, from the set
without its last attribute; rows that agree on what's left are merged before they are shuffled; the later the last attribute,
the fewer rows are left; and lone rows are dropped on the way.

A value is a 64-bit hash whose lowest bit says whether the value is frequent. `coded` looks for a seed by which no two values
of an attribute are the same, so values stand for themselves.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.plans.stages import written

#: Frequent values of an attribute up to which they are marked in its hashes; of more all are marked, which costs
#: rows of later aggregations, nothing else.
MARKED = 10_000


@dataclass
class Coded:
    rows: DataFrame  # (values, n): distinct rows; values in the order of attributes
    names: DataFrame  # (attr, code, value) of all values; attr is a place in attributes
    attributes: list[str]
    total: int


def bit(place: Column | str) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.col(place) if isinstance(place, str) else place)


def without(values: Column, at: Column) -> Column:
    """values without the one at a place, from 0."""
    return F.concat(F.slice(values, F.lit(1), at), F.slice(values, at + 2, F.size(values)))


def rank_in(mask: Column, place: Column) -> Column:
    """How many attributes of a set come before a place."""
    return F.bit_count(mask.bitwiseAND(bit(place) - F.lit(1).cast("long")))


def coded(counts: DataFrame, attributes: Sequence[str], least_support: int) -> Coded:
    """counts: distinct rows as text, with n. Attributes with more values come first, as they leave fewer rows to their
    larger sets; ties by name."""
    spread = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), *[F.approx_count_distinct(f"`{a}`").alias(f"d{k}") for k, a in enumerate(attributes)]).first()
    ordered = sorted(attributes, key=lambda a: (-spread[f"d{list(attributes).index(a)}"], a))
    pairs = counts.select("n", F.posexplode(F.array(*[F.col(f"`{a}`") for a in ordered])).alias("attr", "value"))
    values = written(pairs.groupBy("attr", "value").agg(F.sum("n").alias("n")), "values")
    seed = 0
    while True:
        held = values.groupBy("attr", _hash(F.col("value"), seed).alias("h")).agg(F.count("*").alias("values"), F.count_if(F.col("n") >= least_support).alias("often"))
        by = held.groupBy("attr").agg(F.max("values").alias("most"), F.sum("often").alias("often")).collect()
        if all(r.most == 1 for r in by):
            break
        seed += 1
    frequent = values.where(F.col("n") >= least_support)
    sizes = {r.attr: r.often for r in by if r.often}
    few = [k for k, n in sizes.items() if n <= MARKED]
    marked: dict[int, list[str]] = {k: [] for k in few}
    for r in frequent.where(F.col("attr").isin(few)).select("attr", "value").collect():  # at most MARKED an attribute
        marked[r.attr].append(r.value)

    def code(value: Column, place: int) -> Column:
        often = F.lit(False) if place not in sizes else F.lit(True) if place not in marked else value.isin(marked[place])
        return F.when(often, _hash(value, seed).bitwiseOR(F.lit(1).cast("long"))).otherwise(_hash(value, seed))

    rows = counts.select(F.array(*[code(F.col(f"`{a}`"), k) for k, a in enumerate(ordered)]).alias("values"), "n")
    often = (F.col("n") >= least_support) | F.col("attr").isin([k for k in sizes if k not in marked])
    names = values.select("attr", F.when(often, _hash(F.col("value"), seed).bitwiseOR(F.lit(1).cast("long"))).otherwise(_hash(F.col("value"), seed)).alias("code"), "value")
    return Coded(written(rows, "coded"), names, ordered, int(spread.total))


def _hash(value: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), value).bitwiseAND(F.lit(-2).cast("long"))


def inside(sets: Column, within: Sequence[int] | None) -> Column:
    """Whether a set of attributes is part of one of those given (as bits); of any, if none are."""
    if within is None:
        return F.lit(True)
    wholes = F.split(F.lit(",".join(map(str, within))), ",").cast("array<bigint>")  # one literal, folded once
    return F.exists(wholes, lambda w: sets.bitwiseAND(F.bitwise_not(w)) == 0)


def split(carried: DataFrame, width: int, within: Sequence[int] | None = None) -> DataFrame:
    """The next level of carried rows (set, values, rest, n), of a table of so many attributes: each class split by each
    attribute after its last one."""
    at = F.posexplode("rest").alias("at", "value")
    each = carried.select("set", "values", "rest", "n", at)
    place = F.lit(width) - F.size("rest") + F.col("at")
    larger = F.col("set").bitwiseOR(bit(place))
    return each.where(inside(larger, within)).select(larger.alias("set"), F.concat("values", F.array("value")).alias("values"), F.slice("rest", F.col("at") + 2, width).alias("rest"), "n")

def classes(carried: DataFrame) -> DataFrame:
    """(set, values, n): the classes of two rows or more."""
    return carried.groupBy("set", "values").agg(F.sum("n").alias("n")).where("n > 1")


def levels(table: Coded, largest: int, within: Sequence[int] | None = None) -> list[DataFrame]:
    """For k from 1 to largest, the stripped partitions (set, values, n) by all sets of k attributes, or by those that are
    part of one of `within`."""
    width = len(table.attributes)
    none = F.array().cast("array<bigint>")
    carried = table.rows.select(F.lit(0).cast("long").alias("set"), none.alias("values"), F.col("values").alias("rest"), "n")
    out = []
    largest = min(largest, width)
    for k in range(1, largest + 1):
        merged = split(carried, width, within)
        if k < largest:  # rows that agree are merged; the last level's are only counted
            merged = written(merged.groupBy("set", "values", "rest").agg(F.sum("n").alias("n")), f"level{k}")
        out.append(written(classes(merged), f"classes{k}"))
        stay = out[-1].select(F.col("set").alias("of"), F.col("values").alias("held"))
        met = (F.col("set") == F.col("of")) & (F.col("values") == F.col("held"))
        carried = merged.where(F.size("rest") > 0).join(stay, met, "left_semi")
    return out


def mistakes(left: DataFrame, both: DataFrame, open_ones: DataFrame, width: int) -> DataFrame:
    """(set, rhs, rest, err) of the classes of a left side whose rows differ in a right side: how many of them aren't of
    the class' most frequent value, summed over classes with the same frequent values; rest has 0 for others. left: a level's
    classes, both: the next one's, open_ones: (of, open), the bits of
    the right sides that are asked for. A class that isn't in `both` has one row."""
    asked = F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda a: F.col("open").bitwiseAND(bit(a)) != 0)
    wanted = F.broadcast(open_ones)  # one row a set, whatever the table's rows
    mine = left.join(wanted, F.col("set") == F.col("of")).select("set", F.explode(asked).alias("rhs"), "values", F.col("n").alias("n"), F.lit(0).cast("long").alias("most"))
    places = F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda a: F.col("set").bitwiseAND(bit(a)) != 0)
    cut = both.select("set", "values", "n", F.posexplode(places).alias("at", "rhs"))
    cut = cut.select(F.col("set").bitwiseXOR(bit("rhs")).alias("set"), "rhs", "at", "values", "n").join(wanted, F.col("set") == F.col("of")).where(F.col("open").bitwiseAND(bit("rhs")) != 0)
    theirs = cut.select("set", "rhs", without(F.col("values"), F.col("at")).alias("values"), F.lit(0).cast("long").alias("n"), F.col("n").alias("most"))
    met = mine.unionByName(theirs).groupBy("set", "rhs", "values").agg(F.max("n").alias("n"), F.max("most").alias("most"))
    wrong = met.select("set", "rhs", hidden(F.col("values")).alias("rest"), (F.col("n") - F.greatest("most", F.lit(1))).alias("err"), "n").where("n > 0 AND err > 0")
    return wrong.groupBy("set", "rhs", "rest").agg(F.sum("err").alias("err"))


def hidden(values: Column) -> Column:
    """Values with 0 for those that aren't frequent."""
    return F.transform(values, lambda v: F.when(v.bitwiseAND(F.lit(1).cast("long")) == 1, v).otherwise(F.lit(0).cast("long")))


def pattern_mistakes(dirty: DataFrame, frequent: DataFrame, width: int, largest: int) -> DataFrame:
    """(set, rhs, mask, codes, err, support) for every frequent pattern of constants (attributes mask, values codes) inside a set,
    at least one attribute left a wildcard, that meets a dirty class: the sum of their mistakes.

    dirty: (set, rhs, rest, err), as `mistakes` gives them; frequent: (mask, codes, support), all frequent itemsets. Patterns grow by one constant a
    round, in the order of attributes, and only those that are frequent go on: rows
    that agree on what may still be chosen are merged, and no round has more rows than classes have frequent patterns."""
    now = dirty.select("set", "rhs", F.lit(0).cast("long").alias("mask"), F.array().cast("array<bigint>").alias("codes"), "rest", "err")
    found = []
    for k in range(1, largest):
        # the places of a set's attributes; the rest are the last ones of them
        places = F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda a: F.col("set").bitwiseAND(bit(a)) != 0)
        each = now.select("set", "rhs", "mask", "codes", "rest", "err", F.slice(places, F.bit_count("set") - F.size("rest") + 1, width).alias("places"), F.posexplode("rest").alias("at", "code")).where("code <> 0")
        grown = each.select("set", "rhs", F.col("mask").bitwiseOR(bit(F.get("places", F.col("at")))).alias("mask"), F.concat("codes", F.array("code")).alias("codes"), F.slice("rest", F.col("at") + 2, width).alias("rest"), "err")
        grown = grown.where("mask <> set")
        known = frequent.where(F.size("codes") == k).select(F.col("mask").alias("of"), F.col("codes").alias("held"))
        alive = grown.join(known, (F.col("mask") == F.col("of")) & (F.col("codes") == F.col("held")), "left_semi")
        now = written(alive.groupBy("set", "rhs", "mask", "codes", "rest").agg(F.sum("err").alias("err")), f"patterns{k}")
        if now.isEmpty():
            break
        found.append(now.groupBy("set", "rhs", "mask", "codes").agg(F.sum("err").alias("err")))
    if not found:
        return frequent.select(F.col("mask").alias("set"), F.lit(0).alias("rhs"), "mask", "codes", F.lit(0).cast("long").alias("err"), "support").limit(0)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    known = frequent.select(F.col("mask").alias("of"), F.col("codes").alias("held"), "support")
    return out.join(known, (F.col("mask") == F.col("of")) & (F.col("codes") == F.col("held"))).drop("of", "held")
