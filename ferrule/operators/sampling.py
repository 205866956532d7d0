"""Row samples that keep what the rules need."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions.text import as_text
from ferrule.plans.ranks import beside_one, running


def order_key(*parts: Column | str) -> Column:
    """A reproducible random order, the same in any engine: the md5 of the parts joined by `|`."""
    return F.md5(F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts]))


def signature_buckets(table: DataFrame, attributes: Sequence[str], tid: str, hashes: int = 4) -> DataFrame:
    """(tid, bucket): rows whose features `column_value` have the same min-hashes share a bucket."""
    features = F.array(*[F.concat(F.lit(f"{a}_"), as_text(F.col(a))) for a in attributes])
    salted = lambda k: F.transform(features, lambda f: F.md5(F.concat(F.lit(f"{k}:"), f)))
    least = [F.array_min(salted(k)) for k in range(hashes)]
    return table.select(F.col(tid).alias("tid"), F.md5(F.concat_ws("|", *least)).alias("bucket"))


def round_robin(buckets: DataFrame, rows: int) -> DataFrame:
    """(tid, bucket, round): one row from each bucket in turn, small buckets first, until there are so many.

    Each bucket's rows are numbered in md5 order. The limit keeps a bounded sample: it's the feature.
    """
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("size"))
    inside = Window.partitionBy("bucket").orderBy(order_key("tid"), "tid")
    numbered = buckets.withColumn("round", F.row_number().over(inside)).join(sizes, "bucket")
    return numbered.orderBy("round", "size", "bucket", "tid").limit(rows).select("tid", "bucket", "round")


def quotas(sizes: DataFrame, rows: int) -> DataFrame:
    """(cluster, size, quota): small clusters are taken whole, the rest share what is left equally, rounded
    up. sizes: (cluster, size)."""
    at = running(sizes, ["size", "cluster"], {"so_far": F.col("size"), "rank": F.lit(1)}).withColumn("before", F.col("so_far") - F.col("size"))
    at = beside_one(at, sizes.agg(F.count("*").alias("clusters")))
    # a cluster is whole if all smaller ones are, and its size is at most an equal share of the rest
    share = F.ceil((F.lit(rows) - F.col("before")) / (F.col("clusters") - F.col("rank") + 1))
    at = at.withColumn("share", F.greatest(share, F.lit(0))).withColumn("whole", F.col("size") <= F.col("share"))
    at = beside_one(at, at.agg(F.min(F.when(~F.col("whole"), F.struct("rank", "share"))).alias("cut")))
    quota = F.when(F.col("cut").isNull() | (F.col("rank") < F.col("cut.rank")), F.col("size")).otherwise(F.least(F.col("size"), F.col("cut.share")))
    return at.select("cluster", "size", quota.cast("long").alias("quota"))


def cluster_sample(members: DataFrame, rows: int) -> DataFrame:
    """(tid, cluster) of a sample that is proportional by quota. members: (tid, cluster)."""
    wanted = quotas(members.groupBy("cluster").agg(F.count("*").alias("size")), rows)
    inside = Window.partitionBy("cluster").orderBy(order_key("tid"), "tid")
    numbered = members.withColumn("n", F.row_number().over(inside))
    return numbered.join(wanted, "cluster").where("n <= quota").select("tid", "cluster")


def simple_sample(table: DataFrame, rows: int, tid: str) -> DataFrame:
    """Exactly so many rows (fewer if the table has fewer), in a reproducible random order."""
    return table.orderBy(order_key(tid), tid).limit(rows)


def scaled_support(support: int, sample_rows: int, table_rows: int) -> int:
    """The support that a rule of the table must have in a sample: rounded up."""
    return -(-support * sample_rows // table_rows)


def equal_parts(table: DataFrame, parts: int, tid: str) -> DataFrame:
    """(tid, part): a random partition by hash, parts of nearly equal size."""
    return table.select(F.col(tid).alias("tid"), F.pmod(F.xxhash64(order_key(tid)), F.lit(parts)).cast("int").alias("part"))
