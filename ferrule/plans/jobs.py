"""Jobs: tables, attribute sets and parameters from files, rules to files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.operators.mining import mine
from ferrule.plans.stages import written
from ferrule.sources.rules import Job, read_rules, write_rules
from ferrule.sources.tables import read_table


def in_sets(rules: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """Rules with set_id, from 1, of each set that holds all their attributes; one in several sets comes once for each."""
    told = rules.sparkSession.createDataFrame([(k + 1, sorted(s)) for k, s in enumerate(sets)], "set_id int, attrs array<string>")
    used = F.array_distinct(F.concat(F.transform("lhs", lambda i: i.attr), F.array("rhs_attr")))
    # as many sets as the job names, whatever the rows
    return rules.join(F.broadcast(told), F.size(F.array_except(used, F.col("attrs"))) == 0).drop("attrs")


def mine_sub_tables(table: DataFrame, sets: Sequence[Sequence[str]], least_support: int, least_confidence: float = 1.0, largest: int = 2) -> DataFrame:
    """Minimal rules of each sub-table, with set_id from 1.

    A sub-table has all rows, so whether a rule holds, and is minimal, doesn't depend on which other attributes are
    there. So all sub-tables are mined at once, each part of a set once however many sets share it, and rules are
    dealt to the sets that hold them: the plan and the scans don't grow with the sets."""
    attributes = sorted({a for s in sets for a in s})
    rules = mine(table.select(*attributes), attributes, least_support, least_confidence, largest, within=sets)
    return in_sets(rules, sets)


def run_job(spark: SparkSession, job: Job, sets: Sequence[Sequence[str]] | None, folder: str, separator: str = ",") -> DataFrame:
    """Mine the tables of a job: (file, set_id, and the columns of rules), file from 1 in the job's order.

    The rules of each file are also written as text, `folder`/rules{file}. sets: the sub-tables to mine, all of one scan; without sets, whole tables. Files are read once and are never copied
    into sub-tables."""
    found = []
    for k, file in enumerate(job.files):
        table = read_table(spark, file, separator)
        if sets:
            rules = mine_sub_tables(table, sets, job.least_support, job.least_confidence, job.largest)
        else:
            rules = mine(table, table.columns, job.least_support, job.least_confidence, job.largest, job.strategy).withColumn("set_id", F.lit(1))
        found.append(written(rules.withColumn("file", F.lit(k + 1)), "rules"))
        write_rules(found[-1], f"{folder}/rules{k + 1}")
    return reduce(DataFrame.unionByName, found)


def read_back(spark: SparkSession, job: Job, folder: str) -> DataFrame:
    """(file, rule_id, lhs, rhs_attr, rhs_value) of what `run_job` wrote: each line once."""
    each = [read_rules(spark, f"{folder}/rules{k + 1}").distinct().withColumn("file", F.lit(k + 1)) for k in range(len(job.files))]
    return reduce(DataFrame.unionByName, each)
