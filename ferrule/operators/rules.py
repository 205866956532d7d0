"""Rules as rows: (lhs, rhs_attr, rhs_value, kind, lhs_size, support, hits, confidence).

lhs is an array of (attr, value) ordered by attr; a NULL value is a wildcard, and a NULL rhs_value too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.functions.text import escaped

COLUMNS = ["lhs", "rhs_attr", "rhs_value", "kind", "lhs_size", "support", "hits", "confidence"]


def items(attributes: Column, values: Column) -> Column:
    return F.zip_with(attributes, values, lambda a, v: F.struct(a.alias("attr"), v.alias("value")))


def covers(general: Column, special: Column) -> Column:
    """Whether each item of general is in special: a constant as the same one, a wildcard as any."""
    return F.forall(general, lambda g: F.exists(special, lambda s: (s.attr == g.attr) & (g.value.isNull() | g.value.eqNullSafe(s.value))))


def precedes(general: Column, special: Column) -> Column:
    """Whether general is a strictly more general left side than special."""
    return covers(general, special) & (general != special)


def rule_text(lhs: Column, rhs_attr: Column, rhs_value: Column) -> Column:
    """`(A=v, B=_) => C=_`, which parses back, whatever the values are."""
    value = lambda v: F.coalesce(escaped(v), F.lit("_"))
    left = F.transform(lhs, lambda i: F.concat(escaped(i.attr), F.lit("="), value(i.value)))
    return F.concat(F.lit("("), F.array_join(left, ", "), F.lit(") => "), escaped(rhs_attr), F.lit("="), value(rhs_value))


def constant_rule_text(lhs: Column, rhs_attr: Column, rhs_value: Column) -> Column:
    """`[A, B] => C, (a, b || c)`, which parses back, whatever the values are."""
    attrs, values = (F.array_join(F.transform(lhs, f), ", ") for f in (lambda i: escaped(i.attr), lambda i: escaped(i.value)))
    return F.concat(F.lit("["), attrs, F.lit("] => "), escaped(rhs_attr), F.lit(", ("), values, F.lit(" || "), escaped(rhs_value), F.lit(")"))


def canonical(lhs: Column) -> Column:
    return F.array_sort(F.array_distinct(lhs))


def presented(rules: DataFrame) -> DataFrame:
    """Rules as text with their measures."""
    return rules.select(rule_text(F.col("lhs"), F.col("rhs_attr"), F.col("rhs_value")).alias("rule"), "kind", "lhs_size", "support", "hits", "confidence")
