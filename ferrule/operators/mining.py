"""Discovery of conditional functional dependencies.

A rule (X, pattern) -> A has as support the rows that match the pattern's constants, and as hits, with a
wildcard on the right, the rows that have their class's most frequent value of A; confidence is
hits / support. Rules with a wildcard on the right have one on the left too, and are skipped where A is
constant on the rows covered; rules with a constant on the right have only constants on the left.
A rule is minimal unless a strictly more general one with the same right side is exact (hits = support).

All ten search strategies of the literature give this one result; `STRATEGIES` keeps their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.operators.rules import COLUMNS, items
from ferrule.plans.lattice import MOST_ATTRIBUTES, Candidate, candidates, classes, compressed, named, patterns, unfolded, unfolded_sets
from ferrule.plans.partitions import Coded, bit, coded, levels, mistakes, pattern_mistakes, rank_in, without
from ferrule.plans.stages import written

#: Names of search strategies, accepted and equivalent here.
STRATEGIES = ("Integrated-BFS", "Integrated-DFS", "Itemset-First-BFS-bfs", "Itemset-First-BFS-dfs", "Itemset-First-DFS-bfs", "Itemset-First-DFS-dfs", "FD-First-BFS-bfs", "FD-First-BFS-dfs", "FD-First-DFS-bfs", "FD-First-DFS-dfs")


def _finished(rules: DataFrame, kind: str) -> DataFrame:
    return rules.select("lhs", F.col("rhs").alias("rhs_attr"), "rhs_value", F.lit(kind).alias("kind"), F.size("lhs").alias("lhs_size"), "support", "hits", (F.col("hits") / F.col("support")).alias("confidence"))


def fd_measures(table: DataFrame, attributes: Sequence[str], largest: int) -> DataFrame:
    """(lhs, rhs, n_classes, support, hits, error, confidence) of every plain dependency; error: g3 rows."""
    counts = compressed(table, attributes)
    plain = classes(unfolded(counts, candidates(attributes, largest))).groupBy("candidate")
    out = named(plain.agg(F.count("*").alias("n_classes"), F.sum("n").alias("support"), F.sum("most").alias("hits")), attributes)
    return out.withColumn("error", F.col("support") - F.col("hits")).withColumn("confidence", F.col("hits") / F.col("support"))


def _variable(values: DataFrame, attributes: Sequence[str], least_support: int, least_confidence: float) -> DataFrame:
    found = patterns(classes(values))
    found = found.where((F.col("support") >= least_support) & (F.col("low") != F.col("high")) & (F.col("hits") >= least_confidence * F.col("support")))
    return _finished(named(found, attributes).select(items(F.col("lhs"), F.col("pattern")).alias("lhs"), "rhs", F.lit(None).cast("string").alias("rhs_value"), "support", "hits"), "variable")


def _constant(values: DataFrame, attributes: Sequence[str], least_support: int, least_confidence: float) -> DataFrame:
    totals = classes(values).where(F.col("n") >= least_support).select("candidate", "x", F.col("n").alias("support"))
    found = values.join(totals, ["candidate", "x"]).where(F.col("n") >= least_confidence * F.col("support"))
    return _finished(named(found, attributes).select(items(F.col("lhs"), F.col("x")).alias("lhs"), "rhs", F.col("a").alias("rhs_value"), "support", F.col("n").alias("hits")), "constant")


def variable_rules(table: DataFrame, attributes: Sequence[str], largest: int, least_support: int, least_confidence: float = 0.0) -> DataFrame:
    """All rules with a wildcard on the right, minimal or not."""
    return _variable(unfolded(compressed(table, attributes), candidates(attributes, largest)), attributes, least_support, least_confidence)


def constant_rules(table: DataFrame, attributes: Sequence[str], largest: int, least_support: int, least_confidence: float = 1.0) -> DataFrame:
    """All rules of constants, minimal or not."""
    return _constant(unfolded(compressed(table, attributes), candidates(attributes, largest)), attributes, least_support, least_confidence)


def minimal(rules: DataFrame) -> DataFrame:
    """Rules without those that an exact, strictly more general one with the same right side implies.

    rules must hold, with each exact one, the rules between it and those it implies, as all that is mined does:
    what specialises an exact rule is exact. So it's enough to look for exact rules one step away, with one
    constant made a wildcard, or one wildcard (of constant rules, one constant) left out: a join by equality."""
    exact = rules.where("hits = support").select(F.col("lhs").alias("e_lhs"), F.col("rhs_attr").alias("e_rhs_attr"), F.col("rhs_value").alias("e_rhs_value"))
    wider = F.transform("lhs", lambda i, k: F.transform("lhs", lambda j, m: F.when((k == m) & (F.col("kind") == "variable"), F.struct(j.attr.alias("attr"), F.lit(None).cast("string").alias("value"))).otherwise(F.struct(j.attr.alias("attr"), j.value.alias("value")))))
    shorter = F.transform(F.filter("lhs", lambda i: (F.col("kind") == "constant") | i.value.isNull()), lambda i: F.filter("lhs", lambda j: j.attr != i.attr))
    steps = F.array_distinct(F.concat(wider, shorter))
    near = rules.select("lhs", "rhs_attr", "rhs_value", F.explode(steps).alias("step")).where(F.col("step") != F.col("lhs"))
    met = (F.col("e_rhs_attr") == F.col("rhs_attr")) & F.col("e_rhs_value").eqNullSafe(F.col("rhs_value")) & (F.col("e_lhs") == F.col("step"))
    implied = near.join(exact, met, "left_semi").select(F.col("lhs").alias("i_lhs"), F.col("rhs_attr").alias("i_rhs_attr"), F.col("rhs_value").alias("i_rhs_value"))
    same = (F.col("i_rhs_attr") == F.col("rhs_attr")) & F.col("i_rhs_value").eqNullSafe(F.col("rhs_value")) & (F.col("i_lhs") == F.col("lhs"))
    return rules.join(implied, same, "left_anti").select(*COLUMNS)


def free_left_sides(table: DataFrame, attributes: Sequence[str], largest: int) -> DataFrame:
    """Attribute sets (attrs, n_classes) that have more classes than each of their subsets."""
    sizes = class_counts(compressed(table, attributes), attributes, largest)
    smaller = sizes.select(F.col("attrs").alias("sub"), F.col("n_classes").alias("sub_classes"))
    subs = sizes.select("attrs", "n_classes", F.explode("attrs").alias("left")).select("attrs", "n_classes", F.array_remove("attrs", F.col("left")).alias("sub"))
    tied = subs.join(smaller, "sub").where("n_classes = sub_classes").select("attrs").distinct()
    return sizes.join(tied, "attrs", "left_anti")


def class_counts(counts: DataFrame, attributes: Sequence[str], largest: int) -> DataFrame:
    """(attrs, n_classes) of every attribute set: the size of its partition."""
    sets = [x for k in range(1, largest + 1) for x in combinations(sorted(attributes), k)]
    return unfolded_sets(counts, sets).groupBy("attrs").agg(F.count("*").alias("n_classes"))


def _part_of(x: int, a: int, within: Sequence[int] | None) -> bool:
    return within is None or any((x | 1 << a) & ~w == 0 for w in within)


def _open_next(dirty: set[tuple[int, int]], width: int, within: Sequence[int] | None) -> set[tuple[int, int]]:
    """Candidates (bits of the left side, right side) of the next size all of whose smaller ones are dirty: no left side that
    determines the attribute on all rows is grown for it."""
    grown = {(x | 1 << b, a) for x, a in dirty for b in range(x.bit_length(), width) if b != a and _part_of(x | 1 << b, a, within)}
    return {(x, a) for x, a in grown if all((x ^ 1 << b, a) in dirty for b in range(width) if x >> b & 1)}


def _levels_searched(parts: list[DataFrame], width: int, largest: int, spark: SparkSession, within: Sequence[int] | None) -> tuple[list[DataFrame], list[tuple[int, int]], list[tuple[int, int]]]:
    """Classes with mistakes of each level, and the candidates that have some, and that have none. Between levels only candidates come to the driver:
    as many as attributes make, whatever the rows."""
    found, dirty_ones, exact = [], [], []
    open_ones = {(1 << x, a) for x in range(width) for a in range(width) if x != a and _part_of(1 << x, a, within)}
    empty = parts[0].limit(0)
    for k in range(1, largest + 1):
        if not open_ones:
            break
        by_set: dict[int, int] = {}
        for x, a in open_ones:
            by_set[x] = by_set.get(x, 0) | 1 << a
        asked = spark.createDataFrame(sorted(by_set.items()), "of long, open long")
        both = parts[k] if k < len(parts) else empty
        found.append(written(mistakes(parts[k - 1], both, asked, width), f"mistakes{k}"))
        dirty = {(r.set, r.rhs) for r in found[-1].select("set", "rhs").distinct().collect()}
        dirty_ones += sorted(dirty)
        exact += sorted(open_ones - dirty)
        open_ones = _open_next(dirty, width, within)
    return found, dirty_ones, exact


def _negative_border(dirty: DataFrame, frequent: DataFrame, largest: int) -> DataFrame:
    """(set, rhs, mask, codes, support) of the exact rules with a constant and a wildcard whose every rule one step more
    general isn't exact. dirty: all (set, rhs, mask, codes) that have mistakes, those without constants
    included. Each is met from the one without its last constant."""
    last = F.floor(F.log2("mask")).cast("int")
    short = frequent.where(F.size("codes") < largest)  # a wildcard is left
    grown = short.select(F.col("mask").alias("new"), F.col("codes").alias("values"), "support", F.col("mask").bitwiseXOR(bit(last)).alias("of"), F.slice("codes", F.lit(1), F.size("codes") - 1).alias("held"))
    inside = (F.col("new").bitwiseAND(F.bitwise_not("set")) == 0) & (F.col("new") != F.col("set"))
    made = dirty.join(grown, (F.col("mask") == F.col("of")) & (F.col("codes") == F.col("held"))).where(inside)
    made = made.select("set", "rhs", F.col("new").alias("mask"), F.col("values").alias("codes"), "support")
    key = ["set", "rhs", "mask", "codes"]
    made = written(made.join(dirty, key, "left_anti"), "border")
    # an attribute that has one value on the rows covered has no rule
    alone = F.filter(F.sequence(F.lit(0), F.lit(61)), lambda a: F.col("mask").bitwiseAND(bit(a)) != 0)
    whole = frequent.select("mask", "codes", F.col("support").alias("same"), F.posexplode(alone).alias("at", "rhs"))
    whole = whole.select(F.col("mask").bitwiseXOR(bit("rhs")).alias("mask"), "rhs", without(F.col("codes"), F.col("at")).alias("codes"), F.col("same").alias("support"))
    made = made.join(whole, ["mask", "rhs", "codes", "support"], "left_anti")
    # one constant a wildcard, or one wildcard of two or more left out
    at = F.filter(F.sequence(F.lit(0), F.lit(61)), lambda a: F.col("set").bitwiseAND(bit(a)) != 0)
    each = made.withColumn("place", F.explode(at)).withColumn("constant", F.col("mask").bitwiseAND(bit("place")) != 0)
    each = each.where(F.col("constant") | (F.bit_count(F.col("set").bitwiseXOR(F.col("mask"))) > 1))
    wider = each.select(
        *[F.col(c).alias(f"_{c}") for c in key],
        F.when(F.col("constant"), F.col("set")).otherwise(F.col("set").bitwiseXOR(bit("place"))).alias("set"),
        "rhs",
        F.when(F.col("constant"), F.col("mask").bitwiseXOR(bit("place"))).otherwise(F.col("mask")).alias("mask"),
        F.when(F.col("constant"), without(F.col("codes"), rank_in(F.col("mask"), F.col("place")))).otherwise(F.col("codes")).alias("codes"),
    )
    blocked = wider.join(dirty, key, "left_anti").select(*[F.col(f"_{c}").alias(c) for c in key]).distinct()
    return made.join(blocked, key, "left_anti")


def _worded(rules: DataFrame, table: Coded, kind: str) -> DataFrame:
    """Rules (set, rhs, mask, codes, rhs_code, support, hits) with names and values for their numbers."""
    width = len(table.attributes)
    name = F.array(*map(F.lit, table.attributes))
    key = ["set", "rhs", "mask", "codes", "rhs_code", "support", "hits"]
    places = F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda a: F.col("set").bitwiseAND(bit(a)) != 0)
    each = rules.select(*key, F.explode(places).alias("place"))
    each = each.withColumn("code", F.when(F.col("mask").bitwiseAND(bit("place")) != 0, F.get("codes", rank_in(F.col("mask"), F.col("place")))))
    names = table.names.select("attr", F.col("code").alias("of"), "value")
    met = each.join(names, (F.col("attr") == F.col("place")) & (F.col("code") == F.col("of")), "left")
    item = F.struct(name[F.col("place")].alias("attr"), F.col("value").alias("value"))
    out = met.select(*key, item.alias("item")).groupBy(*key).agg(F.array_sort(F.collect_list("item")).alias("lhs"))
    rhs = table.names.select(F.col("attr").alias("r_attr"), F.col("code").alias("r_code"), F.col("value").alias("rhs_value"))
    out = out.join(rhs, (F.col("r_attr") == F.col("rhs")) & (F.col("r_code") == F.col("rhs_code")), "left") if kind == "constant" else out.withColumn("rhs_value", F.lit(None).cast("string"))
    return _finished(out.select("lhs", name[F.col("rhs")].alias("rhs"), "rhs_value", "support", "hits"), kind)


def mine(table: DataFrame, attributes: Sequence[str], least_support: int, least_confidence: float = 1.0, largest: int = 2, strategy: str = "FD-First-DFS-dfs", only_free: bool = False, within: Sequence[Sequence[str]] | None = None) -> DataFrame:
    """Minimal rules of both kinds. strategy must be one of STRATEGIES and makes no difference.

    Stripped partitions by all attribute sets up to `largest` + 1 are made level by level; the same tables hold the mistakes
    of each (left side, right side) by class, and, among their classes, all frequent itemsets. A left side that determines an
    attribute on all rows isn't grown for it. Rules with wildcards are patterns that mistakes are summed over, grown
    by frequent constants only, and the exact ones just beyond those; rules of constants are pairs of itemsets.
    only_free: only left sides in which no attribute follows from the others. within: attribute sets; only rules all of
    whose attributes are in one of them, at the cost of the sets' parts, each counted once however many sets it's in."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    counts = compressed(table, attributes)
    largest = min(largest, len(attributes) - 1)
    if len(attributes) > MOST_ATTRIBUTES:
        raise ValueError(f"{len(attributes)} attributes, at most {MOST_ATTRIBUTES} can be mined at once")
    if largest < 1:
        return _finished(table.sparkSession.createDataFrame([], "lhs array<struct<attr:string,value:string>>, rhs string, rhs_value string, support long, hits long"), "variable")
    counts = written(counts, "rows")
    known = coded(counts, attributes, least_support)
    width, spark = len(known.attributes), table.sparkSession
    wholes = None if within is None else [sum(1 << known.attributes.index(a) for a in x) for x in within]
    parts = levels(known, largest + 1, wholes)
    mistaken, dirty_ones, exact = _levels_searched(parts, width, largest, spark, wholes)
    frequent = reduce(DataFrame.unionByName, [p.where(F.col("n") >= least_support) for p in parts]).select(F.col("set").alias("mask"), F.col("values").alias("codes"), F.col("n").alias("support"))
    frequent = written(frequent, "frequent")
    dirty = reduce(DataFrame.unionByName, mistaken or [mistakes(parts[0].limit(0), parts[0].limit(0), spark.createDataFrame([], "of long, open long"), width)])
    none = F.array().cast("array<bigint>")
    plain = dirty.groupBy("set", "rhs").agg(F.sum("err").alias("err")).select("set", "rhs", F.lit(0).cast("long").alias("mask"), none.alias("codes"), "err", F.lit(known.total).cast("long").alias("support"))
    measured = written(plain.unionByName(pattern_mistakes(dirty, frequent, width, largest)), "measured")
    border = _negative_border(measured.select("set", "rhs", "mask", "codes"), frequent, largest)
    whole = spark.createDataFrame(exact, "set long, rhs int") if exact else border.select("set", "rhs").limit(0)
    constant = [r[0] for r in known.rows.select(F.posexplode("values").alias("at", "v")).groupBy("at").agg(F.min("v").alias("low"), F.max("v").alias("high")).where("low = high").select("at").collect()]
    whole = whole.where(~F.col("rhs").isin(constant)).select("set", "rhs", F.lit(0).cast("long").alias("mask"), none.alias("codes"), F.lit(known.total).cast("long").alias("support"))
    with_mistakes = measured.select("set", "rhs", "mask", "codes", "support", (F.col("support") - F.col("err")).alias("hits"))
    found = with_mistakes.unionByName(border.unionByName(whole).withColumn("hits", F.col("support")))
    found = found.where((F.col("support") >= least_support) & (F.col("hits") >= least_confidence * F.col("support")))
    variable = _worded(found.withColumn("rhs_code", F.lit(None).cast("long")), known, "variable").select(*COLUMNS)
    if least_confidence * least_support > 1:
        constants = _frequent_pairs(parts, frequent, known, largest, least_confidence)
    else:  # a hit may be a single row, which no stripped partition has
        searched = [Candidate(tuple(sorted(a for k, a in enumerate(known.attributes) if x >> k & 1)), known.attributes[r]) for x, r in dirty_ones + exact]
        constants = _constant(unfolded(counts, searched), attributes, least_support, least_confidence)
    rules = variable.unionByName(minimal(constants))
    if not only_free:
        return rules
    free = free_left_sides(table, attributes, largest).select(F.col("attrs").alias("free"))
    return rules.join(free, F.transform("lhs", lambda i: i.attr) == F.col("free"), "left_semi")


def _frequent_pairs(parts: list[DataFrame], frequent: DataFrame, known: Coded, largest: int, least_confidence: float) -> DataFrame:
    """All rules of constants: a frequent itemset, and it with one item more. Of more hits than one, so that itemset is in the partitions."""
    width = len(known.attributes)
    places = F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda a: F.col("set").bitwiseAND(bit(a)) != 0)
    both = reduce(DataFrame.unionByName, parts[1:]) if len(parts) > 1 else parts[0].limit(0)
    least = frequent.agg(F.min("support")).first()[0]
    if least is not None:  # what has fewer hits can't be confident enough
        both = both.where(F.col("n") >= least_confidence * least)
    cut = both.select("set", "values", "n", F.posexplode(places).alias("at", "rhs"))
    cut = cut.select(F.col("set").bitwiseXOR(bit("rhs")).alias("set"), "rhs", without(F.col("values"), F.col("at")).alias("codes"), F.get("values", F.col("at")).alias("rhs_code"), F.col("n").alias("hits"))
    met = cut.join(frequent.select("mask", F.col("codes").alias("held"), "support"), (F.col("set") == F.col("mask")) & (F.col("codes") == F.col("held"))).where(F.col("hits") >= least_confidence * F.col("support"))
    return _worded(met.select("set", "rhs", "mask", "codes", "rhs_code", "support", "hits"), known, "constant")


def generators(table: DataFrame, attributes: Sequence[str], largest: int, least_support: int) -> DataFrame:
    """(gen, support, closure): the minimal itemsets of their support, as arrays of `attr=value`, with all
    items that are in each of their rows. Itemsets have 1 to largest items."""
    counts = compressed(table, attributes)
    item = {a: F.concat(F.lit(f"{a}="), F.col(a)) for a in sorted(attributes)}
    sets = [x for k in range(1, largest + 1) for x in combinations(sorted(attributes), k)]
    each = [F.array(*[item[a] for a in x]) for x in sets]
    rows = counts.select("n", F.array(*item.values()).alias("all"), F.explode(F.array(*each)).alias("gen"))
    support = rows.groupBy("gen").agg(F.sum("n").alias("support")).where(F.col("support") >= least_support)
    inside = rows.select("gen", "n", F.explode("all").alias("item")).groupBy("gen", "item").agg(F.sum("n").alias("here"))
    closed = inside.join(support, "gen").where("here = support").groupBy("gen", "support").agg(F.array_sort(F.collect_set("item")).alias("closure"))
    smaller = closed.select(F.col("gen").alias("sub"), F.col("support").alias("sub_support"))
    sub = closed.select("gen", "support", F.explode("gen").alias("left")).select("gen", "support", F.array_remove("gen", F.col("left")).alias("sub"))
    same = sub.join(smaller, "sub").where("support = sub_support").select("gen").distinct()
    return closed.join(same, "gen", "left_anti")
