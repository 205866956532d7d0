"""Checking given rules against a table: support, confidence, violating rows, supplementary samples.

The table is read once. Each row is written once for each kind of rule (which attributes of the left side are constants, which
wildcards, and the right side), with its values there; then rules of a kind meet rows by an equality join on their constants,
never one filter per rule. Kinds come in packs, as data, so the plan is the same for any number of rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions.text import as_text

#: Kinds of rules in one pack, which is an array of a row.
PACK = 1000
#: Rules, and characters of their constants, up to which they are broadcast; beyond, they are copied SALTS times and shuffled, so
#: that rows with one constant are spread.
BROADCAST_RULES, BROADCAST_CHARACTERS, SALTS = 100_000, 20_000_000, 32


def _in_kinds(rules: DataFrame, place: Column) -> DataFrame:
    """Rules with their kind: the places of constants, wildcards and right side among the table's attributes; and their constants."""
    at = lambda items: F.transform(items, lambda i: place[i.attr])
    constant, open_ = F.filter("lhs", lambda i: i.value.isNotNull()), F.filter("lhs", lambda i: i.value.isNull())
    kind = F.struct(at(constant).alias("constants"), at(open_).alias("wildcards"), place[F.col("rhs_attr")].alias("rhs"))
    return rules.select("rule_id", "rhs_value", kind.alias("kind"), F.transform(constant, lambda i: i.value).alias("values"))


def matched(table: DataFrame, rules: DataFrame, tid: str) -> DataFrame:
    """(rule_id, tid, key, rhs, rhs_value): every row that a rule's constants cover. key: the row's values
    of the wildcard attributes; rhs: its right side; rhs_value: the rule's. rules: rule_id, lhs, rhs_attr, rhs_value. Rules of
    the same items each have their rows. An empty left side, or one of wildcards alone, covers all rows; no rules give no rows."""
    items = F.array_append(F.transform("lhs", lambda i: i.attr), F.col("rhs_attr"))
    named = [r.attr for r in rules.select(F.explode(items).alias("attr")).distinct().limit(len(table.columns) + 1).collect()]
    if unknown := sorted(set(named) - set(table.columns)):
        raise ValueError(f"rules name attributes that the table lacks: {unknown}")
    attributes = sorted(named)
    place = F.create_map(*[x for k, a in enumerate(attributes) for x in (F.lit(a), F.lit(k))]) if attributes else F.create_map().cast("map<string,int>")
    mine = _in_kinds(rules, place)
    size = mine.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(F.array_join("values", ""))), F.lit(0)).alias("characters")).first()
    few = size.n <= BROADCAST_RULES and size.characters <= BROADCAST_CHARACTERS
    kinds = mine.select("kind").distinct()
    packs = kinds.groupBy(F.pmod(F.xxhash64("kind"), F.lit(size.n // PACK + 1)).alias("pack")).agg(F.collect_list("kind").alias("kinds")).select("kinds")
    cells = F.array(*[as_text(F.col(a)) for a in attributes]).cast("array<string>")
    each = table.select(F.col(tid).alias("tid"), cells.alias("cells")).join(F.broadcast(packs) if few else packs, F.lit(True)).select("tid", "cells", F.explode("kinds").alias("of"))
    read = lambda places: F.transform(places, lambda k: F.get("cells", k))
    rows = each.select("tid", "of", read("of.wildcards").alias("key"), F.get("cells", "of.rhs").alias("rhs"), read("of.constants").alias("found"))
    same = (F.col("of") == F.col("kind")) & (F.col("found") == F.col("values"))
    if few:
        met = rows.join(F.broadcast(mine), same)
    else:
        dealt = mine.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = rows.withColumn("salt", F.pmod(F.xxhash64("tid"), F.lit(SALTS)).cast("int")).join(dealt, same & (F.col("salt") == F.col("copy")))
    return met.select("rule_id", "tid", "key", "rhs", "rhs_value")


def measures(table: DataFrame, rules: DataFrame, tid: str) -> DataFrame:
    """(rule_id, support, hits, confidence) of each rule that covers a row."""
    counts = matched(table, rules, tid).groupBy("rule_id", "rhs_value", "key", "rhs").agg(F.count("*").alias("n"))
    each = counts.groupBy("rule_id", "rhs_value", "key").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.sum(F.when(F.col("rhs") == F.col("rhs_value"), F.col("n")).otherwise(0)).alias("equal"))
    hits = F.when(F.col("rhs_value").isNull(), F.col("most")).otherwise(F.col("equal"))
    out = each.groupBy("rule_id").agg(F.sum("n").alias("support"), F.sum(hits).alias("hits"))
    return out.withColumn("confidence", F.col("hits") / F.col("support"))


def precision(measured: DataFrame, least_support: int, least_confidence: float) -> DataFrame:
    """(rules, supported, valid, precision): how many rules reach the support, and also the confidence."""
    supported = F.col("support") >= least_support
    valid = supported & (F.col("confidence") >= least_confidence)
    out = measured.agg(F.count("*").alias("rules"), F.count_if(supported).alias("supported"), F.count_if(valid).alias("valid"))
    return out.withColumn("precision", F.when(F.col("supported") > 0, F.col("valid") / F.col("supported")))


def violations(table: DataFrame, rules: DataFrame, tid: str, against: str = "multiple") -> DataFrame:
    """(rule_id, tid) of rows that break a rule. Constant right sides: rows with another value. Wildcards, by
    against: "multiple": all rows of classes with several values; "mode": rows without their class's most
    frequent value (ties: the smallest); "first": rows without the value of their class's first row by tid.
    """
    rows = matched(table, rules, tid)
    constant = rows.where("rhs_value is not null and rhs <> rhs_value").select("rule_id", "tid")
    rows = rows.where("rhs_value is null")
    each = ["rule_id", "key"]
    if against == "multiple":
        broken = rows.groupBy(*each).agg(F.min("rhs").alias("low"), F.max("rhs").alias("high")).where("low <> high").select(*each)
        found = rows.join(broken, each, "left_semi")
    elif against == "mode":
        counts = rows.groupBy(*each, "rhs").agg(F.count("*").alias("n"))
        best = counts.groupBy(*each).agg(F.min(F.struct((-F.col("n")).alias("n"), "rhs")).alias("best"))
        found = rows.join(best, each).where(F.col("rhs") != F.col("best.rhs"))
    elif against == "first":
        first = rows.groupBy(*each).agg(F.min(F.struct("tid", "rhs")).alias("first"))
        found = rows.join(first, each).where(F.col("rhs") != F.col("first.rhs"))
    else:
        raise ValueError(f"unknown kind of violation {against!r}")
    return constant.unionByName(found.select("rule_id", "tid"))


def supplemented(sample: DataFrame, table: DataFrame, violating: DataFrame, tid: str) -> DataFrame:
    """The sample with the violating rows that it lacks."""
    more = table.join(violating.select(F.col("tid").alias(tid)).distinct(), tid, "left_semi").join(sample.select(tid), tid, "left_anti")
    return sample.unionByName(more.select(*sample.columns))


def running_violations(table: DataFrame, lhs: list[str], rhs: str, tid: str) -> DataFrame:
    """(tid, earlier): rows whose class had another right side before them, with how many rows before."""
    before = Window.partitionBy(*lhs).orderBy(tid).rowsBetween(Window.unboundedPreceding, -1)
    out = table.withColumn("low", F.min(rhs).over(before)).withColumn("high", F.max(rhs).over(before)).withColumn("earlier", F.count("*").over(before))
    return out.where((F.col("low") != F.col(rhs)) | (F.col("high") != F.col(rhs))).select(F.col(tid).alias("tid"), "earlier")


def expanded(table: DataFrame, rules: DataFrame, tid: str) -> DataFrame:
    """(rule_id, key, rhs): each rule with its wildcards replaced by values that occur together."""
    return matched(table, rules, tid).select("rule_id", "key", "rhs").distinct()
