"""Rule sets and attribute sets against each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.functions.text import escaped, list_distance
from ferrule.operators.rules import canonical
from ferrule.operators.subsets import contained, covered
from ferrule.plans.stages import written

_RULE = ["lhs", "rhs_attr", "rhs_value"]


def _named(rules: DataFrame, side: str) -> DataFrame:
    return rules.select(canonical(F.col("lhs")).alias(f"{side}_lhs"), F.col("rhs_attr").alias(f"{side}_rhs_attr"), F.col("rhs_value").alias(f"{side}_rhs_value")).distinct()


def identical(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rules of both, whatever the order of their left sides."""
    parts = [r.select(canonical(F.col("lhs")).alias("lhs"), "rhs_attr", "rhs_value") for r in (first, second)]
    return parts[0].intersect(parts[1])


def _said(attr: Column, value: Column) -> Column:
    """An item as one string, of which different items have different ones."""
    return F.concat(escaped(attr), F.lit("="), F.coalesce(escaped(value), F.lit("_")))


def subsumed(first: DataFrame, second: DataFrame) -> DataFrame:
    """(a_*, b_*, distance): pairs where the first's rule a is as general as the second's b, or more; distance:
    items that b has more. A rule is the set of its items and its right side; one that may be covered holds, beside each item,
    its wildcard, so what it covers lies in it."""
    right = lambda s: F.concat(F.lit("> "), _said(F.col(f"{s}_rhs_attr"), F.col(f"{s}_rhs_value")))
    own = F.transform("a_lhs", lambda i: _said(i.attr, i.value))
    open_ = F.flatten(F.transform("b_lhs", lambda i: F.array(_said(i.attr, i.value), _said(i.attr, F.lit(None).cast("string")))))
    a = _named(first, "a").withColumn("a_members", F.array_sort(F.array_distinct(F.array_append(own, right("a")))))
    b = _named(second, "b").withColumn("b_members", F.array_sort(F.array_distinct(F.array_append(open_, right("b")))))
    out = a.join(contained(a, b), "a_members").join(b, "b_members").drop("a_members", "b_members")
    return out.withColumn("distance", F.size("b_lhs") - F.size("a_lhs"))


def embedded(first: DataFrame, second: DataFrame) -> DataFrame:
    """(lhs_a, rhs_attr, lhs_b, relation): plain dependencies inside the rules whose left attributes are
    "equal", or where the first's are a "subset"."""

    def plain(rules: DataFrame, s: str) -> DataFrame:
        out = rules.select(F.array_sort(F.transform("lhs", lambda i: i.attr)).alias(f"lhs_{s}"), F.col("rhs_attr").alias(f"rhs_{s}")).distinct()
        left = F.transform(f"lhs_{s}", lambda a: F.concat(F.lit("< "), a))
        return out.withColumn(f"{s}_members", F.array_sort(F.array_distinct(F.array_append(left, F.concat(F.lit("> "), F.col(f"rhs_{s}"))))))

    a, b = plain(first, "a"), plain(second, "b")
    out = a.join(contained(a, b), "a_members").join(b, "b_members").select("lhs_a", F.col("rhs_a").alias("rhs_attr"), "lhs_b")
    return out.withColumn("relation", F.when(F.col("lhs_a") == F.col("lhs_b"), "equal").otherwise("subset"))


def scores(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(n_found, n_truth, n_same, precision, recall)."""
    n = [df.select(canonical(F.col("lhs")).alias("lhs"), "rhs_attr", "rhs_value").distinct().agg(F.count("*").alias(c)) for df, c in ((found, "n_found"), (truth, "n_truth"))]
    same = identical(found, truth).agg(F.count("*").alias("n_same"))
    one = [x.withColumn("one", F.lit(1)) for x in (*n, same)]  # three rows of counts
    out = one[0].join(one[1], "one").join(one[2], "one").drop("one")
    return out.withColumn("precision", F.when(F.col("n_found") > 0, F.col("n_same") / F.col("n_found"))).withColumn("recall", F.when(F.col("n_truth") > 0, F.col("n_same") / F.col("n_truth")))


def _in_order(sets: DataFrame, column: str) -> DataFrame:
    """Distinct sets (attrs), sorted; NULL members are left out, NULL sets too."""
    return sets.where(F.col(column).isNotNull()).select(F.array_sort(F.array_distinct(F.array_compact(column))).alias("attrs")).distinct()


def maximal_sets(sets: DataFrame, column: str = "attrs") -> DataFrame:
    """Distinct sets of two or more that no larger one contains."""
    each = written(_in_order(sets, column).where(F.size("attrs") > 1), "sets")
    inside = covered(each.withColumnRenamed("attrs", "a_members"), each.withColumnRenamed("attrs", "b_members"), proper=True)
    return each.join(inside.select(F.col("a_members").alias("attrs")), "attrs", "left_anti")


def uncovered_sets(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Sets of truth that no set of found contains; an empty one is in any."""
    each = written(_in_order(truth, "attrs"), "truth")
    inside = covered(each.withColumnRenamed("attrs", "a_members"), _in_order(found, "attrs").withColumnRenamed("attrs", "b_members"))
    return each.join(inside.select(F.col("a_members").alias("attrs")), "attrs", "left_anti")


def recall_report(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(attr, n_truth, n_uncovered): how many sets of truth have each attribute, and how many of those no set of found contains."""
    each = written(_in_order(truth, "attrs"), "truth")
    every, missed = attribute_counts(each), attribute_counts(uncovered_sets(each, found))
    out = every.join(missed.select(F.col("attr").alias("of"), F.col("n").alias("missed")), F.col("attr") == F.col("of"), "left")
    return out.select("attr", F.col("n").alias("n_truth"), F.coalesce("missed", F.lit(0)).alias("n_uncovered"))


def attribute_counts(sets: DataFrame) -> DataFrame:
    """(attr, n): how many sets have each attribute."""
    return sets.select(F.explode("attrs").alias("attr")).groupBy("attr").agg(F.count("*").alias("n"))


def rank_displacement(found: DataFrame, expected: DataFrame, at: int) -> DataFrame:
    """(displacement): over the first `at` of found (item, rank from 0), the sum of |rank - expected rank|;
    an item that isn't expected counts at + 1."""
    wanted = expected.select("item", F.col("rank").alias("expected"))
    out = found.where(F.col("rank") < at).join(wanted, "item", "left")
    return out.agg(F.coalesce(F.sum(F.when(F.col("expected").isNull(), at + 1).otherwise(F.abs(F.col("rank") - F.col("expected")))), F.lit(0)).cast("long").alias("displacement"))


def row_differences(first: DataFrame, second: DataFrame, tid: str, columns: Sequence[str]) -> DataFrame:
    """(tid, side): rows that only the "first" or "second" table has, or whose columns differ ("both"). NULLs are
    equal. One full join on tid."""
    pack = lambda df, s: df.select(F.col(tid).alias(f"tid_{s}"), F.struct(*columns).alias(f"row_{s}"))
    met = pack(first, "a").join(pack(second, "b"), F.col("tid_a") == F.col("tid_b"), "full")
    side = F.when(F.col("tid_b").isNull(), "first").when(F.col("tid_a").isNull(), "second").otherwise("both")
    return met.where(~F.col("row_a").eqNullSafe(F.col("row_b"))).select(F.coalesce("tid_a", "tid_b").alias("tid"), side.alias("side"))


def distance_sums(sets: DataFrame, vocabulary: Sequence[str], most: int | None = None) -> DataFrame:
    """(attrs, total): for each distinct set, as an array in its order, the sum of its edit distances to all
    others; with most, the largest ones (a top-k report; ties: the greater array). Sets of attributes are a short table,
    and each is a stated query against all."""
    each = sets.select("attrs").distinct()
    met = each.join(F.broadcast(each.withColumnRenamed("attrs", "other")) if each.count() <= 10_000 else each.withColumnRenamed("attrs", "other"), F.lit(True))
    out = met.groupBy("attrs").agg(F.sum(list_distance(F.col("attrs"), F.col("other"), vocabulary)).alias("total"))
    return out if most is None else out.orderBy(F.desc("total"), F.desc("attrs")).limit(most)


def shortened(sets: DataFrame, size: int, ways: int, seed: int = 0) -> DataFrame:
    """Distinct sets of up to size members; of a longer one, `ways` subsets of size members, the same in each run."""
    each = sets.select(F.array_sort(F.array_distinct("attrs")).alias("attrs"))
    rank = lambda n: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("way").cast("string"), F.array_join("attrs", ","), n)).alias("h"), n.alias("n"))
    dealt = each.where(F.size("attrs") > size).withColumn("way", F.explode(F.sequence(F.lit(1), F.lit(ways))))
    chosen = F.slice(F.array_sort(F.transform("attrs", rank)), 1, size)
    short = dealt.select(F.array_sort(F.transform(chosen, lambda s: s.n)).alias("attrs"))
    return each.where(F.size("attrs") <= size).unionByName(short).distinct()
