"""Mixing sources to target weights by entropy balancing.

Every document gets a rate (how many copies the mix takes of it). Among all rates that give each source
the words of its target, those closest in entropy to "one copy of each" are exponentially tilted in the
document's words: rate = min(cap, exp(tilt[source] * words / mean words of the source)). The tilts solve
a convex dual problem with one word constraint for each source; `solved` does so by Newton's method,
where each iteration is one aggregation in Spark, kept inside a bracket so that it can't run away.

Documents of one source and size have one rate, so all iterations read a histogram (source, words,
documents), not documents. `rounded` then turns the histogram's rates into whole copies, carrying the
words that are left over from larger sizes to smaller ones, and `mix` deals out those copies among the
documents of a size by the order of a hash.

Only one row for each source goes to the driver, like a table of weights.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.llm.shared import keep, spare

#: Documents of one source, size and rank bucket are ranked in one task: about so many.
BUCKET = 4096
#: Newton's method ends when every source is this near its target (a share of it), or after so many steps.
NEAR, STEPS = 1e-7, 60
SEPARATOR = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Runs of characters outside 0x20 and 0x09-0x0D; 0 for null."""
    parts = F.split(text, SEPARATOR)
    ends = F.when(F.element_at(parts, 1) == "", 1).otherwise(0) + F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return F.when(text.isNull(), 0).otherwise(F.size(parts) - ends).cast("long")


def cycled(sizes: dict[str | None, int], cycle: tuple[int, ...] = (3, 1, 2)) -> dict[str | None, float]:
    """Weights that repeat over the sources in code point order, null last."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    return {s: float(cycle[k % len(cycle)]) for k, s in enumerate(order)}


def targets(sizes: dict[str | None, int], weights: dict[str | None, float], share: float, cap: float) -> dict[str | None, float]:
    """share * all words, dealt by weight; a source stops at cap * its size and the others share the excess."""
    left, free, out = share * sum(sizes.values()), set(sizes), {}
    while free:
        total = sum(weights[s] for s in free)
        full = {s for s in free if left * weights[s] >= cap * sizes[s] * total}
        if not full:
            return out | {s: left * weights[s] / total for s in free}
        out |= {s: cap * sizes[s] for s in full}
        left -= sum(out[s] for s in full)
        free -= full
    return out


def solved(histogram: DataFrame, sizes: dict[str | None, int], documents: dict[str | None, int], wanted: dict[str | None, float], cap: float) -> dict[str | None, float]:
    """The tilt of each source; inf where the target is cap * the source's size."""
    spark = histogram.sparkSession
    tilt = {s: 0.0 if 0 < wanted[s] < cap * sizes[s] * (1 - 1e-12) else (math.inf if wanted[s] > 0 else -math.inf) for s in sizes}
    bracket = {s: (-math.inf, math.inf) for s in sizes}
    todo = {s for s in sizes if math.isfinite(tilt[s])}
    for _ in range(STEPS):
        if not todo:
            break
        state = spark.createDataFrame([(s, tilt[s], documents[s] / sizes[s]) for s in todo], "source string, tilt double, scale double")
        x = F.col("size") * F.col("scale")
        rate = F.exp(F.least(x * F.col("tilt"), F.lit(math.log(cap))))
        words = F.col("n") * F.col("size")
        inside = x * F.col("tilt") < math.log(cap)
        at = histogram.withColumnRenamed("source", "of").join(state, F.col("of").eqNullSafe(F.col("source")))
        found = at.groupBy("source").agg(F.sum(words * rate).alias("taken"), F.sum(F.when(inside, words * x * rate).otherwise(0.0)).alias("slope"))
        for s, taken, slope in found.collect():
            gap, (low, high) = taken - wanted[s], bracket[s]
            if abs(gap) <= NEAR * wanted[s]:
                todo.discard(s)
                continue
            low, high = (low, tilt[s]) if gap > 0 else (tilt[s], high)
            bracket[s] = (low, high)
            step = tilt[s] - gap / slope if slope > 0 else math.nan
            if not low < step < high:
                if math.isfinite(low) and math.isfinite(high):
                    step = (low + high) / 2
                else:
                    step = tilt[s] * 2 + math.copysign(1.0, -gap)
            tilt[s] = step
    return tilt


def rounded(cap: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """For one source's histogram: whole copies for each size, largest size first. What is left over in
    words is carried to the next size, so the source ends within about a small document of its target."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size", ascending=False, kind="stable")
        carried, copies = 0.0, []
        for size, n, rate in zip(rows["size"], rows["n"], rows["rate"], strict=True):
            if size == 0:
                copies.append(n)
                continue
            wanted = n * rate + carried / size
            made = min(max(math.floor(wanted + 0.5), 0), math.floor(cap * n))
            carried += (n * rate - made) * size
            copies.append(made)
        return rows.assign(copies=copies)[["source", "size", "n", "copies"]]

    return run


def mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: Callable[[dict], dict] = cycled, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(key, size, source, source_size, target, copies, taken) for every row of docs.

    size: words of the whole text (a null or empty text: 0; such a row has one copy and adds no words).
    copies is 0 to cap (a whole number then); taken = copies * size. Rows of null source are a source of
    their own. Repeated rows are rows like others; which one of several equal rows gets a copy more makes
    no difference to the result. Ties are broken by a hash of the key, so reruns agree. Columns other
    than the three named are not read. An empty table gives an empty one.
    A hot source or size is aggregated before any shuffle, and ranked in buckets of about BUCKET rows.
    A source's histogram, at most sqrt(2 * its words) rows, is rounded in one task.
    """
    sized = docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), word_count(F.col(text).cast("string")).alias("size"))
    sized = keep(sized, "sized")
    histogram = keep(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "histogram")
    whole = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size"), F.sum("n").alias("n")).collect()
    sizes, documents = {r.source: r["size"] for r in whole}, {r.source: r["n"] for r in whole}
    wanted = targets(sizes, weights(sizes), share, cap)
    tilt = solved(histogram, sizes, documents, wanted, cap)

    spark = docs.sparkSession
    rows = [(s, sizes[s], wanted[s], tilt[s], documents[s] / max(1, sizes[s])) for s in sizes]
    state = spark.createDataFrame(rows, "of string, source_size long, target double, tilt double, scale double")
    rate = F.when(F.col("tilt") == float("inf"), cap).when(F.col("tilt") == float("-inf"), 0.0).otherwise(F.exp(F.least(F.col("size") * F.col("scale") * F.col("tilt"), F.lit(math.log(cap)))))
    rated = histogram.join(state, F.col("of").eqNullSafe(F.col("source"))).select("source", "size", "n", rate.alias("rate"))
    dealt = keep(rated.groupBy("source").applyInPandas(rounded(cap), "source string, size long, n long, copies long"), "copies")
    dealt = dealt.select(F.col("source").alias("of"), F.col("size").alias("of_size"), F.floor(F.col("copies") / F.col("n")).alias("least"), (F.col("copies") % F.col("n")).alias("more"), F.ceil(F.col("n") / BUCKET).alias("buckets"))

    at = sized.join(dealt, F.col("of").eqNullSafe(F.col("source")) & (F.col("of_size") == F.col("size"))).drop("of", "of_size")
    at = at.withColumn("order", F.xxhash64(F.col("key").cast("string"), F.lit("copies")))
    at = at.withColumn("bucket", F.pmod(F.xxhash64("order"), F.col("buckets")))
    # ranks only where some documents of a size get one copy more than the others
    some = at.where("more > 0")
    group = ["source", "size", "bucket"]
    before = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = some.groupBy(*group).agg(F.count("*").alias("here")).withColumn("before", F.coalesce(F.sum("here").over(before), F.lit(0)))
    counts = counts.select(*[F.col(c).alias(f"of_{c}") for c in group], "before")
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in group]
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy("order", "key")))
    ranked = ranked.join(counts, same[0] & same[1] & same[2]).withColumn("copies", F.col("least") + F.when(F.col("rank") + F.col("before") <= F.col("more"), 1).otherwise(0))
    columns = ["key", "source", "size", "copies"]
    out = at.where("more = 0").withColumn("copies", F.col("least")).select(*columns).unionByName(ranked.select(*columns))
    out = out.join(state.select("of", "source_size", "target"), F.col("of").eqNullSafe(F.col("source")))
    return out.select(F.col("key").alias(key), "size", F.col("source").alias(source), "source_size", "target", F.col("copies").cast("long"), (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: Callable[[dict], dict] = cycled, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mix itself: the rows of docs, each as often as `mix` says, with its copy's number as the column
    `copy` (one of that name is replaced; all other names are free).

    key must tell the rows apart; of rows that share it (all null ones, say) each is taken as often as
    the copies of any of them say, the most.
    """
    of_key, n = spare(docs, "key", "copies")
    copies = mix(docs, share, cap, weights, key, source, text).groupBy(F.col(key).alias(of_key)).agg(F.max("copies").alias(n)).where(F.col(n) > 0)
    out = docs.join(copies, F.col(f"`{key}`").eqNullSafe(F.col(of_key)))
    copy = F.explode(F.sequence(F.lit(1), F.col(n).cast("int"))).alias("copy")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c != "copy"], copy)


__all__ = ["cycled", "mix", "mixed", "targets", "word_count"]
