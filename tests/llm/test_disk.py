"""What is kept between steps goes when nothing reads it any more."""

import os

from pyspark.sql import functions as F

from ferrule.llm import components, shared


def test_rounds_of_components_are_let_go(spark):
    since = shared.mark()
    edges = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in components.connected(edges).collect()} == {0}
    assert shared.mark() - since == 1


def test_let_go_deletes_one_table(spark):
    one, two = shared.keep(spark.range(3), "one"), shared.keep(spark.range(4), "two")
    folder = one.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(folder)
    shared.let_go(one)
    assert not os.path.exists(folder) and two.count() == 4
    assert spark.conf.get(shared.CLEANUP) == "false"
