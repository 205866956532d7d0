"""Chat formatting with a prefix tree.

Conversations that begin with the same turns share them: each distinct run of initial turns is a node of
a tree, and its last turn's text is emitted once, depth first. A node's row has where it stands in its
tree's sequence, the position ids of its characters (they count along the conversation, not along the
sequence), the part of it that is under the loss mask, and the intervals of the sequence that it may
attend to besides itself: those of its ancestors, adjacent ones merged.

A turn is `<|im_start|>ROLE` newline `TEXT<|im_end|>` newline. Inside roles and texts a backslash stands
before every backslash and after the first character of every string of `CONTROL`; a role's newlines
have one in front. Taking each backslash away, with the next character as it is, gives the text back.

The order: nodes are sorted by the smallest path that holds them, a path being the list of node numbers
from the root, and then by depth; which is depth first. Sequences are therefore a range-partitioned sort
with running sums, so that a tree of any size is spread over many tasks. Node numbers are 64-bit hashes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.llm.shared import keep

START, END = "<|im_start|>", "<|im_end|>"
#: The control strings of common chat templates; `<|` begins a whole family.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TRAINED = "assistant"


def escaped(text: Column) -> Column:
    marked = [(c, f"{c[0]}\\{c[1:]}") for c in CONTROL]
    return reduce(lambda t, x: F.replace(t, F.lit(x[0]), F.lit(x[1])), marked, F.replace(text, F.lit("\\"), F.lit("\\\\")))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def emitted(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The trees and the index of conversations.

    Trees, one row for each node: tree, node, parent, depth (from 1), start (in the tree's sequence),
    formatted, position (of its first character), loss_from and loss_to (in formatted; equal if nothing
    is trained on), attends (array of from, to in the sequence; all before start).
    Index: conv, leaf (node), turns.

    Rows of a conversation are ordered by turn (null first), role and text, so ties are defined; null
    roles and texts are empty; rows of null conv are one conversation; repeated rows are repeated turns.
    Other columns are not read. An empty table gives empty ones. Conversations of equal turns are one path,
    counted before the shuffle. One conversation's rows are sorted in one task, which may spill.
    """
    rows = conversations.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    along = Window.partitionBy("conv").orderBy("turn", "role", "text")
    rows = rows.withColumn("depth", F.row_number().over(along))
    so_far = Window.partitionBy("conv").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    hashes = [F.bit_xor(F.xxhash64(F.lit(seed), "depth", "role", "text")).over(so_far) for seed in (1, 2)]
    rows = rows.withColumn("node", F.xxhash64("depth", *hashes))
    head = F.concat(F.lit(START), F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))
    rows = rows.withColumn("head", F.length(head)).withColumn("formatted", F.concat(head, escaped(F.col("text")), F.lit(END + "\n")))
    before = Window.partitionBy("conv").orderBy("depth")
    rows = rows.withColumn("parent", F.lag("node").over(before)).withColumn("position", F.sum(F.length("formatted")).over(so_far) - F.length("formatted"))
    trained = F.when(F.col("role") == TRAINED, F.length("formatted") - len(END) - 1).otherwise(F.col("head"))
    rows = keep(rows.select("conv", "depth", "node", "parent", "formatted", "position", F.col("head").alias("loss_from"), trained.alias("loss_to")), "turns")

    paths = rows.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("depth", "node"))).alias("path"))
    paths = keep(paths.select("conv", F.transform("path", lambda x: x.node).alias("path")), "paths")
    index = paths.select("conv", F.element_at("path", -1).alias("leaf"), F.size("path").cast("long").alias("turns"))
    distinct = paths.select(F.element_at("path", -1).alias("leaf"), "path").distinct()
    steps = keep(distinct.select("leaf", "path", F.posexplode("path").alias("at", "node")).select("leaf", "path", (F.col("at") + 1).alias("depth"), "node"), "steps")

    owners = steps.groupBy("node").agg(F.min("path").alias("owner"))
    facts = [F.first(c).alias(c) for c in ("parent", "depth", "formatted", "position", "loss_from", "loss_to")]
    nodes = rows.groupBy("node").agg(*facts).join(owners, "node").withColumn("length", F.length("formatted").cast("long"))
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keep(nodes.repartitionByRange(parts, "owner", "depth").withColumn("part", F.spark_partition_id()), "ranged")
    base = ranged.groupBy("part").agg(F.sum("length").alias("sum"))
    base = base.select("part", F.coalesce(F.sum("sum").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("owner", "depth").rowsBetween(Window.unboundedPreceding, 0)
    # base has a row for each range partition
    placed = ranged.withColumn("end", F.sum("length").over(inside)).join(F.broadcast(base), "part")
    placed = placed.withColumn("end", F.col("end") + F.col("base")).withColumn("start", F.col("end") - F.col("length"))
    placed = keep(placed.select("node", "start", "end", F.element_at("owner", -1).alias("owner")), "placed")

    walk = Window.partitionBy("leaf").orderBy("depth")
    past = walk.rowsBetween(Window.unboundedPreceding, 0)
    at = steps.select("leaf", "depth", "node").join(placed, "node")
    at = at.withColumn("root", F.first("start").over(past)).withColumn("tree", F.first("node").over(past))
    at = at.withColumn("new", F.coalesce(F.col("start") != F.lag("end").over(walk), F.lit(True)))
    at = at.withColumn("run", F.last(F.when(F.col("new"), F.col("start")), ignorenulls=True).over(past))
    at = at.withColumn("closed", F.when(F.lead("new").over(walk), F.struct((F.col("run") - F.col("root")).alias("from"), (F.col("end") - F.col("root")).alias("to"))))
    earlier = F.collect_list("closed").over(walk.rowsBetween(Window.unboundedPreceding, -1))
    own = F.array(F.struct((F.col("run") - F.col("root")).alias("from"), (F.col("start") - F.col("root")).alias("to")))
    at = at.withColumn("attends", F.filter(F.concat(earlier, own), lambda x: x["from"] < x.to))
    at = at.where("leaf = owner").select("tree", "node", (F.col("start") - F.col("root")).alias("start"), "attends")
    trees = keep(at.join(ranged.select("node", "parent", "depth", "formatted", "position", "loss_from", "loss_to"), "node"), "trees")
    return trees, index.join(steps.select("leaf", "path").distinct(), "leaf")


def read_back(trees: DataFrame, index: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of every conversation, from
    the emitted texts and masks alone. Each distinct path is read once."""
    steps = index.select("leaf", "path").distinct().select("leaf", F.posexplode("path").alias("depth", "node"))
    at = steps.join(trees.select("node", "formatted", "loss_from", "loss_to"), "node")
    turn = r"(?s)^\Q" + START + r"\E((?:[^\\\n]|\\.)*)\n(.*)\Q" + END + r"\E\n$"
    said = F.concat(*[x for k in (1, 2) for x in (unescaped(F.regexp_extract("formatted", turn, k)), F.lit("\n"))])
    loss = unescaped(F.substring(F.col("formatted"), F.col("loss_from") + 1, F.col("loss_to") - F.col("loss_from")))
    at = at.select("leaf", F.struct("depth", said.alias("said"), loss.alias("loss"), F.length("formatted").cast("long").alias("chars")).alias("turn"))
    read = at.groupBy("leaf").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    joined = lambda name: F.array_join(F.transform("turns", lambda x: x[name]), "")
    read = read.select(
        "leaf",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined("said"), 256).alias("turns_sha256"),
        F.length(joined("loss")).cast("long").alias("loss_chars"),
        F.sha2(joined("loss"), 256).alias("loss_sha256"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda n, x: n + x.chars).alias("formatted_chars"),
    )
    return index.select(F.col("conv").alias(conv), "leaf").join(read, "leaf").drop("leaf")
