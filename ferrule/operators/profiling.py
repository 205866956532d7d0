"""Profiles of columns and of pairs of columns."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions.text import as_text
from ferrule.plans.ranks import beside_one, running


def item_frequencies(table: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """(attr, value, n). Rows are unfolded column by column and summed before the shuffle."""
    each = [F.struct(F.lit(a).alias("attr"), as_text(F.col(a)).alias("value")) for a in attributes]
    return table.select(F.explode(F.array(*each)).alias("i")).groupBy("i.attr", "i.value").agg(F.count("*").alias("n"))


def frequent_items(table: DataFrame, attributes: Sequence[str], least: int) -> DataFrame:
    return item_frequencies(table, attributes).where(F.col("n") >= least)


def column_profile(table: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """(attr, n_distinct, top, spread, entropy, shannon, simpson): top: the most frequent value's count;
    spread: n_distinct * top; entropy in bits, shannon in nats; simpson: 1 - the sum of squared shares."""
    counts = item_frequencies(table, attributes)
    # the rows are as many for each column, so shares need no join
    total = Window.partitionBy("attr")
    share = counts.withColumn("p", F.col("n") / F.sum("n").over(total))
    out = share.groupBy("attr").agg(F.count("*").alias("n_distinct"), F.max("n").alias("top"), F.sum(-F.col("p") * F.log2("p")).alias("entropy"), F.sum(-F.col("p") * F.ln("p")).alias("shannon"), (1 - F.sum(F.col("p") * F.col("p"))).alias("simpson"))
    return out.withColumn("spread", F.col("n_distinct") * F.col("top"))


def gini(table: DataFrame, column: str) -> DataFrame:
    """(gini) of a column's values: 1 - sum((R[i] + R[i-1]) * (v[i] - v[i-1])) / (2 * sum of values), with R the
    running share of the sum in order of value. Over distinct values with counts, so ties add nothing."""
    counts = table.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))
    whole = F.col("v") * F.col("n")
    at = running(counts.withColumn("whole", whole), ["v"], {"running": whole}, before={"prior": "v"})
    at = beside_one(at, counts.agg(F.sum(whole).alias("total")))
    first, last = F.col("running") - F.col("v") * (F.col("n") - 1), F.col("running") - F.col("whole")
    area = (first + last) / F.col("total") * (F.col("v") - F.col("prior"))
    return at.withColumn("area", area).agg((1 - F.coalesce(F.sum("area"), F.lit(0.0)) / (2 * F.max("total"))).alias("gini"))


def pair_scores(table: DataFrame, attributes: Sequence[str], least: int) -> DataFrame:
    """(attr, score): over all pairs with another column, the distinct values of the column that occur in a
    value pair counted least times or more. Columns without one are left out."""
    pairs = [(a, b) for a, b in combinations(sorted(attributes), 2)]
    each = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), as_text(F.col(a)).alias("x"), as_text(F.col(b)).alias("y")) for a, b in pairs]
    counts = table.select(F.explode(F.array(*each)).alias("p")).groupBy("p.a", "p.b", "p.x", "p.y").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    sides = counts.groupBy("a", "b").agg(F.count_distinct("x").alias("left"), F.count_distinct("y").alias("right"))
    one = F.explode(F.array(F.struct(F.col("a").alias("attr"), F.col("left").alias("n")), F.struct(F.col("b").alias("attr"), F.col("right").alias("n"))))
    return sides.select(one.alias("s")).groupBy("s.attr").agg(F.sum("s.n").alias("score"))


def frequent_pairs(table: DataFrame, attributes: Sequence[str], least: int) -> DataFrame:
    """(a, b, n_pairs): value pairs counted least times or more, for each pair of columns."""
    each = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), as_text(F.col(a)).alias("x"), as_text(F.col(b)).alias("y")) for a, b in combinations(sorted(attributes), 2)]
    counts = table.select(F.explode(F.array(*each)).alias("p")).groupBy("p.a", "p.b", "p.x", "p.y").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return counts.groupBy("a", "b").agg(F.count("*").alias("n_pairs"))


def columns_with_support(table: DataFrame, attributes: Sequence[str], least: int) -> DataFrame:
    """(attr, top) of columns whose most frequent value has least rows or more."""
    return item_frequencies(table, attributes).groupBy("attr").agg(F.max("n").alias("top")).where(F.col("top") >= least)


def sign_columns(table: DataFrame, attributes: Sequence[str], most: int = 10) -> DataFrame:
    """(attr, n_distinct) of columns with 2 to most values."""
    return item_frequencies(table, attributes).groupBy("attr").agg(F.count("*").alias("n_distinct")).where((F.col("n_distinct") > 1) & (F.col("n_distinct") <= most))


def factorised(table: DataFrame, column: str, tid: str) -> DataFrame:
    """(value, code): values numbered from 0 by their first row."""
    firsts = table.groupBy(as_text(F.col(column)).alias("value")).agg(F.min(tid).alias("first"))
    return running(firsts, ["first", "value"], {"n": F.lit(1)}).select("value", (F.col("n") - 1).cast("long").alias("code"))


def gap_index(numbers: DataFrame, drop: float = 0.9) -> DataFrame:
    """(index): of numbers (rank from 0, value), the first rank whose successor is smaller by more than a
    share of drop; else how many there are. Numbers are a short ranked list."""
    at = running(numbers, ["rank"], after={"next": "value"})
    return at.agg(F.coalesce(F.min(F.when((F.col("value") - F.col("next")) / F.col("value") > drop, F.col("rank"))), F.count("*")).cast("long").alias("index"))


def largest_left_side(columns: Sequence[str], share: float) -> int:
    """How many attributes a left side may have: under 15 columns, a share of them, rounded down, and one; else half."""
    return int(len(columns) * share) + 1 if len(columns) < 15 else len(columns) // 2


def schema_statistics(table: DataFrame, attributes: Sequence[str], share: float = 0.5, most: int = 10) -> DataFrame:
    """(attr, n_distinct, sign, largest): how many values but NULL each column has, whether they are 2 to most, and
    how many attributes a left side over these columns may have. One pass, summed before the shuffle."""
    each = [F.struct(F.lit(a).alias("attr"), F.col(a).cast("string").alias("value")) for a in attributes]
    values = table.select(F.explode(F.array(*each)).alias("i")).select("i.*").distinct()
    counts = values.groupBy("attr").agg(F.count("value").alias("n_distinct"))
    return counts.select("attr", "n_distinct", F.col("n_distinct").between(2, most).alias("sign"), F.lit(largest_left_side(attributes, share)).alias("largest"))


def ranked(table: DataFrame, column: str) -> DataFrame:
    """(item, value, rank): a column's values by how often they occur, ranked from 0; ties: the smaller text. NULL is a value."""
    counts = table.groupBy(as_text(F.col(column)).alias("item")).agg(F.count("*").alias("value"))
    return running(counts, [F.desc("value"), "item"], {"n": F.lit(1)}).select("item", "value", (F.col("n") - 1).cast("long").alias("rank"))


def domain(table: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """(attr, value, code): the values of each attribute, numbered from 1 in order of value."""
    values = item_frequencies(table, attributes).select("attr", "value")
    return values.withColumn("code", F.row_number().over(Window.partitionBy("attr").orderBy("value")))


def column_tokens(table: DataFrame, attributes: Sequence[str], tid: str, few: int = 10) -> DataFrame:
    """(attr, tid, token): each cell as `column_value`. Whole numbers, and texts of under `few` values, are numbered
    from 0 by their first row; other texts are trimmed."""
    kinds = dict(table.dtypes)
    whole = [a for a in attributes if kinds[a] in ("tinyint", "smallint", "int", "bigint")]
    texts = [a for a in attributes if kinds[a] == "string"]
    each = [F.struct(F.lit(a).alias("attr"), as_text(F.col(a)).alias("value"), F.lit(a in whole).alias("whole"), F.lit(a in texts).alias("text")) for a in attributes]
    cells = table.select(F.col(tid).alias("tid"), F.explode(F.array(*each)).alias("c")).select("tid", "c.*")
    firsts = cells.groupBy("attr", "value", "whole", "text").agg(F.min("tid").alias("first"))
    n = F.count("*").over(Window.partitionBy("attr"))
    coded = firsts.withColumn("n", n).where(F.col("whole") | (F.col("text") & (F.col("n") < few)))
    codes = coded.select("attr", "value", (F.row_number().over(Window.partitionBy("attr").orderBy("first")) - 1).alias("code"))
    out = cells.join(codes, ["attr", "value"], "left")
    shown = F.coalesce(F.col("code").cast("string"), F.when(F.col("text"), F.trim("value")).otherwise(F.col("value")))
    return out.select("attr", "tid", F.concat_ws("_", "attr", shown).alias("token"))


def column_sentences(table: DataFrame, attributes: Sequence[str], tid: str, few: int = 10) -> DataFrame:
    """(attr, sentence): a column's tokens in the order of tid, joined by blanks. A sentence is one value of one
    row, so this is for samples; `column_tokens` holds the same for tables of any size."""
    by = column_tokens(table, attributes, tid, few).groupBy("attr").agg(F.array_sort(F.collect_list(F.struct("tid", "token"))).alias("all"))
    return by.select("attr", F.array_join(F.transform("all", lambda t: t.token), " ").alias("sentence"))
