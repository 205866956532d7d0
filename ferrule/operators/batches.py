"""Batches for training: no text twice in one, or labels a few at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.operators.sampling import order_key
from ferrule.plans.ranks import beside_one, running


def distinct_batches(rows: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """(id, batch) of all rows (id, text): batches of `size` rows at most, none with a text twice, all as full as each other to
    one row. There are as many as rows need, or as the most frequent text has copies, if that's more.

    Rows are numbered with equal texts side by side, and dealt to batches in turn: copies come to different ones, as there are
    at least as many batches. Which texts share a batch is by a hash of seed and text. A null text is an empty one."""
    told = rows.select("id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # texts stay here: their hash goes on
    short = told.select("id", order_key(F.lit(seed), "text").alias("of"), order_key(F.lit(seed), "id").alias("turn"))
    copies = short.groupBy("of").agg(F.count("*").alias("n"))
    needed = copies.agg(F.greatest(F.ceil(F.sum("n") / size), F.max("n")).alias("batches"))
    at = running(short, ["of", "turn", "id"], {"n": F.lit(1)})
    return beside_one(at, needed).select("id", ((F.col("n") - 1) % F.col("batches")).alias("batch"))


def label_batches(rows: DataFrame, size: int, each: int, seed: int = 0) -> DataFrame:
    """(id, label, batch) of all rows (id, label): batches of size div each groups of `each` rows of one label. Rows of a label are
    grouped, and groups dealt to batches, by hashes with the seed. What's left of a label after its whole groups has no
    batch (NULL); so has a null label."""
    if not 0 < each <= size:
        raise ValueError("a batch must hold a group")
    known = rows.where(F.col("label").isNotNull()).select("id", "label", order_key(F.lit(seed), "id").alias("turn"))
    at = running(known, ["label", "turn", "id"], {"n": F.lit(1)})
    starts = at.groupBy("label").agg(F.min("n").alias("first"), F.count("*").alias("rows")).withColumnRenamed("label", "of")
    at = at.join(starts, F.col("label") == F.col("of")).withColumn("part", F.floor((F.col("n") - F.col("first")) / each))
    whole = F.col("part") < F.floor(F.col("rows") / each)
    groups = at.where(whole).groupBy(F.col("label").alias("g_label"), F.col("part").alias("g_part")).agg(F.count("*").alias("held")).drop("held")
    groups = groups.withColumn("key", order_key(F.lit(seed), "g_label", "g_part"))
    dealt = running(groups, ["key", "g_label", "g_part"], {"k": F.lit(1)}).select("g_label", "g_part", F.floor((F.col("k") - 1) / (size // each)).alias("batch"))
    met = at.join(dealt, whole & (F.col("label") == F.col("g_label")) & (F.col("part") == F.col("g_part")), "left").select("id", "label", "batch")
    return met.unionByName(rows.where(F.col("label").isNull()).select("id", "label", F.lit(None).cast("long").alias("batch")))
