"""Rules, attribute sets and jobs as text. Parsing what was printed gives the rules back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.functions.text import escaped_parts, stripped, trimmed_list, unescaped
from ferrule.operators.rules import constant_rule_text, rule_text

#: A run of text without a character, but for those with a backslash before them.
_UP_TO = r"(?:[^\\{0}]|\\.)*".format
_GENERAL = rf"^\((.*)\) => ({_UP_TO('=')})=(.*)$"
_CONSTANT = rf"^\[(.*)\] => ({_UP_TO(',')}), \(({_UP_TO('|')})\|\|(.*)\)$"
_ITEM = rf"^({_UP_TO('=')})=(.*)$"


def parsed(lines: DataFrame, column: str = "value") -> DataFrame:
    """(rule_id, lhs, rhs_attr, rhs_value) of lines `(A=v, B=_) => C=w`; other lines are passed over.
    rule_id is the line. A backslash takes the meaning of the character after it."""
    rows = lines.select(stripped(F.col(column)).alias("rule_id")).where(F.col("rule_id").rlike(_GENERAL))
    parts = F.filter(escaped_parts(F.regexp_extract("rule_id", _GENERAL, 1)), lambda p: p != "")
    value = lambda v: F.when(v != "_", unescaped(v))
    item = F.transform(parts, lambda p: F.struct(unescaped(F.regexp_extract(p, _ITEM, 1)).alias("attr"), value(F.regexp_extract(p, _ITEM, 2)).alias("value")))
    return rows.select("rule_id", F.array_sort(item).alias("lhs"), unescaped(F.regexp_extract("rule_id", _GENERAL, 2)).alias("rhs_attr"), value(F.regexp_extract("rule_id", _GENERAL, 3)).alias("rhs_value"))


def parsed_constant(lines: DataFrame, column: str = "value") -> DataFrame:
    """The same of lines `[A, B] => C, (a, b || c)`."""
    rows = lines.select(stripped(F.col(column)).alias("rule_id")).where(F.col("rule_id").rlike(_CONSTANT))
    get = lambda k: F.regexp_extract("rule_id", _CONSTANT, k)
    lhs = F.zip_with(escaped_parts(get(1)), escaped_parts(get(3)), lambda a, v: F.struct(unescaped(a).alias("attr"), unescaped(v).alias("value")))
    return rows.select("rule_id", F.array_sort(lhs).alias("lhs"), unescaped(stripped(get(2))).alias("rhs_attr"), unescaped(stripped(get(4))).alias("rhs_value"))


def read_rules(spark: SparkSession, path: str, constant: bool = False) -> DataFrame:
    return (parsed_constant if constant else parsed)(spark.read.text(path))


def write_rules(rules: DataFrame, path: str, constant: bool = False) -> None:
    text = (constant_rule_text if constant else rule_text)(F.col("lhs"), F.col("rhs_attr"), F.col("rhs_value"))
    rules.select(text.alias("value")).write.text(path)


def read_sets(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """(attrs) of lines `a,b,c`."""
    return spark.read.text(path).where(F.trim("value") != "").select(trimmed_list(F.col("value"), separator).alias("attrs"))


def write_sets(sets: DataFrame, path: str) -> None:
    sets.select(F.array_join("attrs", ",").alias("value")).write.text(path)


def write_dependencies(sets: DataFrame, path: str) -> None:
    """Lines `{A, B} -> C` of (lhs array, rhs), by right side."""
    line = F.concat(F.lit("{"), F.array_join("lhs", ", "), F.lit("} -> "), F.col("rhs"))
    sets.orderBy("rhs", "lhs").select(line.alias("value")).coalesce(1).write.text(path)


@dataclass(frozen=True)
class Job:
    """Mine all rules of some sub-tables."""

    files: tuple[str, ...]
    least_support: int
    least_confidence: float = 1.0
    largest: int = 2
    strategy: str = "FD-First-DFS-dfs"


def parsed_job(text: str) -> Job:
    """Line 1: files, comma-separated; then support, confidence, largest left side and strategy; or, for
    constant rules only, support and largest left side."""
    lines = [x.strip() for x in text.strip().splitlines()]
    files = tuple(x.strip() for x in lines[0].split(","))
    if len(lines) == 3:
        return Job(files, int(lines[1]), largest=int(lines[2]))
    return Job(files, int(lines[1]), float(lines[2]), int(lines[3]), *lines[4:5])
