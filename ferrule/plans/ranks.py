"""Running sums, row numbers and neighbours in the order of a whole table, without a window over all of it.

The table is sorted by ranges, each partition adds up its own rows, and a row for each partition, its sums and its first and last
row, goes through the driver to say where the next one goes on.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ferrule.plans.stages import written


def running(df: DataFrame, order: Sequence[Column | str], sums: Mapping[str, Column] | None = None, before: Mapping[str, str] | None = None, after: Mapping[str, str] | None = None) -> DataFrame:
    """df with new columns: by `sums`, sums over the rows up to and with each one; by `before` and `after`, a column's value in
    the row before or after, NULL at the ends. Rows that are equal in the order come in any; a row number is a sum of ones.

    No rows give none. A range holds all rows of one place in the order, so an order with many equal rows needs more columns."""
    sums, before, after = dict(sums or {}), dict(before or {}), dict(after or {})
    parts = {f"_sum{k}": c for k, c in enumerate(sums.values())}
    sorted_rows = df.withColumns(parts).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(sorted_rows.withColumn("_at", F.monotonically_increasing_id()), "sorted").withColumn("_part", F.shiftright("_at", 33))
    beside = sorted({*before.values(), *after.values()})
    each = [F.sum(s).alias(s) for s in parts]
    each += [f(F.col(c), F.col("_at")).alias(f"{name}{k}") for k, c in enumerate(beside) for name, f in (("_first", F.min_by), ("_last", F.max_by))]
    ends = rows.groupBy("_part").agg(F.count("*").alias("_rows"), *each)
    found = sorted(ends.collect(), key=lambda r: r["_part"])  # a row a partition
    names = {s: f"_base{k}" for k, s in enumerate(parts)}
    fields = [StructField("_of", ends.schema["_part"].dataType)]
    fields += [StructField(names[s], ends.schema[s].dataType) for s in parts]
    fields += [StructField(f"{name}{k}", ends.schema[f"_first{k}"].dataType) for k in range(len(beside)) for name in ("_prior", "_next")]
    bases, so_far = [], dict.fromkeys(parts)
    for i, r in enumerate(found):
        row = [r["_part"], *(so_far[s] for s in parts)]
        for k in range(len(beside)):
            row += [found[i - 1][f"_last{k}"] if i else None, found[i + 1][f"_first{k}"] if i + 1 < len(found) else None]
        bases.append(row)
        so_far = {s: r[s] if so_far[s] is None else so_far[s] if r[s] is None else so_far[s] + r[s] for s in parts}
    told = df.sparkSession.createDataFrame(bases, StructType(fields))
    met = rows.join(F.broadcast(told), F.col("_part") == F.col("_of"))
    inside = Window.partitionBy("_part").orderBy("_at")  # a partition is one range
    here = inside.rowsBetween(Window.unboundedPreceding, 0)
    out = {}
    for name, s in zip(sums, parts, strict=True):
        own = F.sum(s).over(here)
        out[name] = F.when(F.col(names[s]).isNull(), own).when(own.isNull(), F.col(names[s])).otherwise(F.col(names[s]) + own)
    for wanted, step, edge in ((before, F.lag, "_prior"), (after, F.lead, "_next")):
        for name, c in wanted.items():
            none = step(F.lit(1)).over(inside).isNull()
            out[name] = F.when(none, F.col(f"{edge}{beside.index(c)}")).otherwise(step(c).over(inside))
    return met.select(*[F.col(f"`{c}`") for c in df.columns], *[c.alias(n) for n, c in out.items()])


def beside_one(df: DataFrame, one: DataFrame) -> DataFrame:
    """df with the columns of a table of one row."""
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(one.withColumn("_one", F.lit(1))), "_one").drop("_one")
