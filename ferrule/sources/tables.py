"""Tables as CSV, baskets and sub-tables."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.functions.text import as_text, short_number


def read_table(spark: SparkSession, path: str, separator: str = ",", header: bool = True, row_share: float = 1.0, column_share: float = 1.0, first_columns: int | None = None, seed: int = 0) -> DataFrame:
    """All columns as strings; an empty cell is an empty string. Ragged rows are dropped. A share of rows, and
    a random share of columns or the first ones, are kept at the source."""
    rows = spark.read.csv(path, sep=separator, header=header, mode="DROPMALFORMED", nullValue="\u0000", emptyValue="")
    if not header:
        rows = rows.toDF(*[f"Attr{k + 1}" for k in range(len(rows.columns))])
    names = rows.columns
    if first_columns is not None:
        names = names[:first_columns]
    if column_share < 1:
        kept = set(random.Random(seed).sample(names, int(len(names) * column_share)))
        names = [c for c in names if c in kept]
    rows = rows.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in names])
    return rows.sample(row_share, seed) if row_share < 1 else rows


def first_rows(table: DataFrame, rows: int, tid: str) -> DataFrame:
    """A prefix of a table in the order of its row numbers."""
    return table.orderBy(tid).limit(rows)


def read_baskets(spark: SparkSession, path: str, separator: str = " ") -> DataFrame:
    """(items): the distinct items of each line that has any."""
    parts = F.filter(F.split(F.col("value"), f"[{separator}]"), lambda x: x != "")
    return spark.read.text(path).select(F.array_sort(F.array_distinct(parts)).alias("items")).where(F.size("items") > 0)


def write_table(table: DataFrame, path: str, separator: str = ",") -> None:
    table.write.csv(path, sep=separator, header=True)


def write_rows(table: DataFrame, tids: DataFrame, tid: str, path: str, separator: str = ",") -> None:
    """The rows of a table whose number is in tids (tid), without the number."""
    wanted = tids.select(F.col("tid").alias("__wanted"))
    write_table(table.join(wanted, F.col(tid) == F.col("__wanted"), "left_semi").drop(tid), path, separator)


def encoded_like(table: DataFrame, other: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns as codes from 1 by another table's values (those of `encoded`); values that it hasn't are numbered
    on after its own, in order."""
    from ferrule.operators.profiling import domain

    known = domain(other, columns)
    sizes = known.groupBy("attr").agg(F.max("code").alias("size"))
    new = domain(table, columns).drop("code").join(known, ["attr", "value"], "left_anti").join(sizes, "attr", "left")
    order = Window.partitionBy("attr").orderBy("value")
    codes = known.unionByName(new.select("attr", "value", (F.row_number().over(order) + F.coalesce("size", F.lit(0))).alias("code")))
    out = table
    for k, c in enumerate(columns):
        one = codes.where(F.col("attr") == c).select(F.col("value").alias(f"__value{k}"), F.col("code").alias(f"__code{k}"))
        out = out.join(one, as_text(F.col(c)) == F.col(f"__value{k}"), "left")
    return out.select(*[F.col(f"__code{k}").alias(c) if (k := list(columns).index(c) if c in columns else -1) >= 0 else F.col(c) for c in table.columns])


def decoded(codes: DataFrame, dictionary: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Codes of columns back to values, by a dictionary (attr, value, code)."""
    out = codes
    for k, c in enumerate(columns):
        one = dictionary.where(F.col("attr") == c).select(F.col("code").alias(f"__code{k}"), F.col("value").alias(f"__value{k}"))
        out = out.join(one, F.col(c) == F.col(f"__code{k}"), "left")
    return out.select(*[F.col(f"__value{list(columns).index(c)}").alias(c) if c in columns else F.col(c) for c in codes.columns])


def encoded(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns as codes from 1, by value; (attr, value, code) order is the dictionary's."""
    from pyspark.ml.feature import StringIndexer

    text = table.select(*[F.col(c).cast("string").alias(c) for c in columns]).na.fill("NULL")
    coder = StringIndexer(inputCols=list(columns), outputCols=[f"{c}__code" for c in columns], stringOrderType="alphabetAsc")
    return coder.fit(text).transform(text).select(*[(F.col(f"{c}__code") + 1).cast("int").alias(c) for c in columns])


def formatted(table: DataFrame) -> DataFrame:
    """Fractions with two decimals at most."""
    numbers = {f.name for f in table.schema.fields if f.dataType.simpleString() in ("double", "float")}
    return table.select(*[(short_number(F.col(c)) if c in numbers else F.col(c)).alias(c) for c in table.columns])


def write_sub_tables(table: DataFrame, sets: Sequence[Sequence[str]], folder: str) -> list[str]:
    """One CSV folder part{i} for each attribute set, numbered from 1."""
    paths = []
    for k, columns in enumerate(sets):
        paths.append(f"{folder}/part{k + 1}")
        formatted(table.select(*columns)).write.csv(paths[-1], header=True)
    return paths


def one_hot(table: DataFrame, attributes: Sequence[str], tid: str) -> DataFrame:
    """A 0/1 column for each `column_value`, by pivot; for few distinct values."""
    each = F.explode(F.array(*[F.concat(F.lit(f"{a}_"), F.col(a).cast("string")) for a in attributes]))
    rows = table.select(F.col(tid).alias("tid"), each.alias("item"))
    return rows.groupBy("tid").pivot("item").agg(F.lit(1)).na.fill(0)


def without_last(table: DataFrame, tid: str, rows: int = 0, columns: int = 0) -> DataFrame:
    """A table without its last rows by tid, and without its last columns."""
    kept = table.columns[: len(table.columns) - columns]
    last = table.orderBy(F.desc(tid)).limit(rows).select(F.col(tid).alias("__tid"))
    return table.join(last, F.col(tid) == F.col("__tid"), "left_anti").select(*kept)


def complete(table: DataFrame, fill: str | None = None) -> DataFrame:
    """Rows without NULLs, or with NULLs filled."""
    return table.na.fill(fill) if fill is not None else table.na.drop()
