"""Connected components by alternating stars, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.shared import keep, let_go


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b): component is the smallest node reachable.

    Each round points the neighbours of a node at its smallest neighbour, first those above the node
    (large star), then those below it (small star), and is written to the shared folder; the rounds grow
    with the logarithm of a path's length. The smallest neighbour is a partial aggregate, and the join
    with it has one row for each node on that side, so a hot node only makes a skewed join side, which
    Spark splits. Repeated edges, loops and null ends are ignored; no edges give an empty table.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and a <> b")
    now, state = keep(pairs.distinct(), "edges"), None
    while True:
        found = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if found == state or not found[0]:
            break
        state = found
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(below, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, now = now, keep(small.unionByName(below.select("u", F.col("m").alias("v"))).distinct(), "edges")
        let_go(last)
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
