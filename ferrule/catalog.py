"""All queries of the engine by name, and the SQL that each is checked against."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.catalog_sql import GEO, ORACLE_SQL, ORDER_GEO, PARTS, RULE_TEXTS, WIDE
from ferrule.functions.text import row_sentence, short_number, weighted_sentence
from ferrule.functions.vectors import POOLINGS, chunk_average, cosine, dot, euclidean, gaussian_kernel, manhattan, normalised, pooled
from ferrule.operators import batches, clustering, comparison, correlation, evaluation, mining, phrases, profiling, retrieval, sampling, verification
from ferrule.operators.rules import COLUMNS, constant_rule_text, presented, rule_text
from ferrule.plans import jobs
from ferrule.plans.lattice import compressed
from ferrule.plans.stages import shared_folder, until_exit
from ferrule.sources import examples
from ferrule.sources.rules import parsed, parsed_constant, parsed_job, read_sets, write_sets
from ferrule.sources.tables import first_rows, read_table, write_table

__all__ = ["ORACLE_SQL", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def geo(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with their nation and region; tid is the customer."""
    nations = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, folder, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("c_custkey").alias("tid"), *GEO)


def order_geo(spark: SparkSession, folder: str) -> DataFrame:
    customers = geo(spark, folder).select("tid", "c_mktsegment", "r_name").withColumnRenamed("tid", "customer")
    rows = table(spark, folder, "orders").join(customers, F.col("o_custkey") == F.col("customer"))
    return rows.select(F.col("o_orderkey").alias("tid"), *ORDER_GEO)


def parts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(F.col("p_partkey").alias("tid"), *PARTS)


def texts(spark: SparkSession, lines: tuple[str, ...]) -> DataFrame:
    return spark.createDataFrame([(x,) for x in lines], "value string")


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


LINES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

# counts and profiles


@query
def item_frequency(spark, folder):
    return profiling.item_frequencies(geo(spark, folder), GEO)


@query
def frequent_items(spark, folder):
    return profiling.frequent_items(parts(spark, folder), PARTS, 40)


@query
def column_profile(spark, folder):
    out = profiling.column_profile(parts(spark, folder), PARTS)
    return out.select("attr", "n_distinct", "top", "spread", *[F.round(c, 9).alias(c) for c in ("entropy", "shannon", "simpson")])


@query
def gini(spark, folder):
    return profiling.gini(table(spark, folder, "lineitem"), "l_quantity").select(F.round("gini", 9).alias("gini"))


@query
def pair_frequent_values(spark, folder):
    return profiling.pair_scores(parts(spark, folder), PARTS, 5)


@query
def frequent_pairs(spark, folder):
    return profiling.frequent_pairs(order_geo(spark, folder), ORDER_GEO, 50)


@query
def columns_with_support(spark, folder):
    return profiling.columns_with_support(parts(spark, folder), PARTS, 60)


@query
def sign_columns(spark, folder):
    return profiling.sign_columns(order_geo(spark, folder), ORDER_GEO)


@query
def factorised(spark, folder):
    return profiling.factorised(order_geo(spark, folder), "o_orderpriority", "tid")


# dependencies and rules


@query
def partition_count(spark, folder):
    sets = mining.class_counts(compressed(geo(spark, folder), GEO), GEO, 3)
    return sets.select(F.array_join("attrs", ",").alias("attrs"), "n_classes")


@query
def fd_error(spark, folder):
    out = mining.fd_measures(geo(spark, folder), GEO, 2)
    return out.select(F.array_join("lhs", ",").alias("lhs"), "rhs", "n_classes", "support", "error")


@query
def fd_confidence(spark, folder):
    out = mining.fd_measures(order_geo(spark, folder), ORDER_GEO, 2)
    return out.select(F.array_join("lhs", ",").alias("lhs"), "rhs", "confidence")


@query
def variable_cfds(spark, folder):
    return presented(mining.variable_rules(order_geo(spark, folder), ORDER_GEO, 2, 20, 0.3))


@query
def mixed_tableau(spark, folder):
    return presented(mining.variable_rules(geo(spark, folder), GEO, 3, 20))


@query
def constant_cfds(spark, folder):
    return presented(mining.constant_rules(geo(spark, folder), GEO, 2, 10, 1.0))


@query
def minimal_rules(spark, folder):
    return presented(mining.mine(geo(spark, folder), GEO, 10, 0.5, 2))


@query
def minimal_parts(spark, folder):
    return presented(mining.mine(parts(spark, folder), PARTS, 5, 0.6, 2, "Itemset-First-BFS-dfs"))


def wide(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with all columns of their nation and region but comments; many of these follow from others."""
    nations = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, folder, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("c_custkey").alias("tid"), *WIDE)


@query
def mine_wide(spark, folder):
    return presented(mining.mine(wide(spark, folder), WIDE, 20, 0.9, 3))


@query
def free_lhs_rules(spark, folder):
    return presented(mining.mine(wide(spark, folder), WIDE, 20, 0.3, 2, only_free=True))


@query
def free_sets(spark, folder):
    rows = geo(spark, folder)
    return mining.free_left_sides(rows, GEO, 3).select(F.array_join("attrs", ",").alias("attrs"), "n_classes")


@query
def closures(spark, folder):
    out = mining.generators(geo(spark, folder), GEO, 2, 10)
    return out.select(F.array_join("gen", ",").alias("gen"), "support", F.array_join("closure", ",").alias("closure"))


@query
def sub_table_rules(spark, folder):
    out = jobs.mine_sub_tables(geo(spark, folder), [("n_name", "r_name"), ("c_mktsegment", "r_name", "n_regionkey")], 10, 0.5, 2)
    return out.select("set_id", rule_text(F.col("lhs"), F.col("rhs_attr"), F.col("rhs_value")).alias("rule"), "support", "hits")


def filed(spark: SparkSession, table_: DataFrame, tag: str) -> str:
    """A table as CSV in the shared folder, as a job's input."""
    path = until_exit(spark, f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}")
    write_table(table_, path)
    return path


@query
def run_job(spark, folder):
    """From files to rules and back: a job's text names a CSV table, another file its sub-tables; rules are written as
    text, read again, and met with their measures."""
    path, home = filed(spark, geo(spark, folder).drop("tid"), "table"), until_exit(spark, f"{shared_folder(spark)}/job-{uuid.uuid4().hex}")
    write_sets(spark.createDataFrame([(["n_name", "r_name"],), (["c_mktsegment", "r_name", "n_regionkey"],)], "attrs array<string>").coalesce(1), f"{home}/sets")
    job = parsed_job(f"{path}\n10\n0.5\n2\n{mining.STRATEGIES[-1]}\n")
    named = [r.attrs for r in read_sets(spark, f"{home}/sets").collect()]  # as many as the job names
    found = jobs.run_job(spark, job, sorted(named, key=len), home)
    text = rule_text(F.col("lhs"), F.col("rhs_attr"), F.col("rhs_value"))
    back = jobs.read_back(spark, job, home).select("file", text.alias("rule"))
    return found.withColumn("rule", text).join(back, ["file", "rule"], "left_semi").select("file", "set_id", "rule", "support", "hits")


@query
def sampled_columns(spark, folder):
    """A CSV table's first columns, and its first rows by number: what is read of files."""
    rows = read_table(spark, filed(spark, parts(spark, folder), "parts"), first_columns=3)
    return first_rows(rows.withColumn("tid", F.col("tid").cast("long")), 1000, "tid")


# batches


@query
def distinct_text_batches(spark, folder):
    return batches.distinct_batches(table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text"), 32)


@query
def label_batches(spark, folder):
    rows = table(spark, folder, "labels").select(F.col("doc_id").alias("id"), (2 * F.col("quality") + F.col("toxic")).cast("int").alias("label"))
    return batches.label_batches(rows, 16, 4)


@query
def phrase_tokens(spark, folder):
    """Documents by words, with the runs of two and three words that thirty documents or more share as phrases."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), phrases.words(F.col("text")).alias("tokens"))
    known = phrases.frequent_phrases(docs.withColumn("row", F.monotonically_increasing_id()), 3, 30)
    return phrases.phrase_tokens(docs, known, 3).select("id", F.size("tokens").alias("n_tokens"), "n_phrases", F.md5(F.array_join("tokens", " ")).alias("digest"))


# checking rules


def rules(spark: SparkSession) -> DataFrame:
    return parsed(texts(spark, RULE_TEXTS))


@query
def rule_support_confidence(spark, folder):
    return verification.measures(order_geo(spark, folder), rules(spark), "tid")


@query
def rule_precision(spark, folder):
    return verification.precision(verification.measures(order_geo(spark, folder), rules(spark), "tid"), 100, 0.3)


@query
def constant_violations(spark, folder):
    constant = rules(spark).where("rhs_value is not null")
    return verification.violations(order_geo(spark, folder), constant, "tid")


@query
def fd_violations_multi(spark, folder):
    return verification.violations(order_geo(spark, folder), rules(spark).where("rhs_value is null"), "tid", "multiple")


@query
def fd_violations_mode(spark, folder):
    return verification.violations(order_geo(spark, folder), rules(spark).where("rhs_value is null"), "tid", "mode")


@query
def fd_violations_first(spark, folder):
    return verification.violations(order_geo(spark, folder), rules(spark).where("rhs_value is null"), "tid", "first")


@query
def running_violations(spark, folder):
    return verification.running_violations(geo(spark, folder), ["r_name", "c_mktsegment"], "n_name", "tid")


@query
def supplemented_sample(spark, folder):
    rows = order_geo(spark, folder)
    found = verification.violations(rows, rules(spark).where("rhs_value is not null"), "tid")
    return verification.supplemented(sampling.simple_sample(rows, 100, "tid"), rows, found, "tid")


@query
def expanded_rules(spark, folder):
    out = verification.expanded(order_geo(spark, folder), rules(spark).where("rhs_value is null"), "tid")
    return out.select("rule_id", F.array_join("key", ",").alias("key"), "rhs")


# comparing rules and sets


def two_rule_sets(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return tuple(mining.mine(geo(spark, folder), GEO, least, 0.5, 2) for least in (10, 60))


@query
def rule_intersect(spark, folder):
    out = comparison.identical(*two_rule_sets(spark, folder))
    return out.select(rule_text(F.col("lhs"), F.col("rhs_attr"), F.col("rhs_value")).alias("rule"))


@query
def rule_subsumption(spark, folder):
    mined, _ = two_rule_sets(spark, folder)
    every = mining.constant_rules(geo(spark, folder), GEO, 2, 60, 0.9).select(*COLUMNS)
    out = comparison.subsumed(mined, every)
    text = lambda s: rule_text(F.col(f"{s}_lhs"), F.col(f"{s}_rhs_attr"), F.col(f"{s}_rhs_value")).alias(s)
    return out.select(text("a"), text("b"), "distance")


@query
def embedded_fd_match(spark, folder):
    out = comparison.embedded(*two_rule_sets(spark, folder))
    return out.select(F.array_join("lhs_a", ",").alias("lhs_a"), "rhs_attr", F.array_join("lhs_b", ",").alias("lhs_b"), "relation")


@query
def rule_scores(spark, folder):
    found, truth = two_rule_sets(spark, folder)
    return comparison.scores(found, truth)


@query
def constant_rule_texts(spark, folder):
    found = mining.minimal(mining.constant_rules(geo(spark, folder), GEO, 2, 60, 1.0))
    again = parsed_constant(found.select(constant_rule_text(F.col("lhs"), F.col("rhs_attr"), F.col("rhs_value")).alias("value")))
    return again.select("rule_id", rule_text(F.col("lhs"), F.col("rhs_attr"), F.col("rhs_value")).alias("rule"))


def sets(spark: SparkSession, lists) -> DataFrame:
    return spark.createDataFrame([(list(x),) for x in lists], "attrs array<string>")


def brand_sets(spark: SparkSession, folder: str, status: str | None = None) -> DataFrame:
    """The brands of each order, or of those of one status: many sets, of few members, all of them common."""
    lines = table(spark, folder, "lineitem").join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    if status:
        lines = lines.join(table(spark, folder, "orders").where(F.col("o_orderstatus") == status), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("p_brand")).alias("attrs")).select("attrs")


def mined_sets(rules_: DataFrame) -> DataFrame:
    """The attributes of each mined rule."""
    return rules_.select(F.array_sort(F.array_append(F.transform("lhs", lambda i: i.attr), F.col("rhs_attr"))).alias("attrs"))


@query
def max_sets(spark, folder):
    return comparison.maximal_sets(brand_sets(spark, folder)).select(F.array_join("attrs", ",").alias("attrs"))


@query
def uncovered_sets(spark, folder):
    """Brands of fulfilled orders that no open order has together."""
    return comparison.uncovered_sets(brand_sets(spark, folder, "F"), brand_sets(spark, folder, "O")).select(F.array_join("attrs", ",").alias("attrs"))


@query
def recall_report(spark, folder):
    return comparison.recall_report(brand_sets(spark, folder, "F"), brand_sets(spark, folder, "O"))


@query
def attribute_counts(spark, folder):
    return comparison.attribute_counts(brand_sets(spark, folder))


# rows as text and numbers


@query
def row_sentence_of_parts(spark, folder):
    return parts(spark, folder).select("tid", row_sentence(PARTS).alias("sentence"))


@query
def weighted_row_sentence(spark, folder):
    return parts(spark, folder).select("tid", weighted_sentence(PARTS, {"p_brand": 2, "p_type": 1}).alias("sentence"))


@query
def sub_table(spark, folder):
    rows = table(spark, folder, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", short_number(F.col("l_discount")).alias("l_discount"), short_number(F.col("l_quantity")).alias("l_quantity"))


@query
def bag_of_words(spark, folder):
    return examples.bag_of_words(table(spark, folder, "benchmark"), "item_id", "text")


# samples


@query
def minhash_sample(spark, folder):
    return sampling.round_robin(sampling.signature_buckets(order_geo(spark, folder), ORDER_GEO, "tid"), 500).select("tid", "round")


@query
def cluster_quota(spark, folder):
    sizes = parts(spark, folder).groupBy(F.col("p_name").alias("cluster")).agg(F.count("*").alias("size"))
    return sampling.quotas(sizes, 700)


@query
def cluster_quota_sample(spark, folder):
    return sampling.cluster_sample(parts(spark, folder).select("tid", F.col("p_size").cast("string").alias("cluster")), 300)


@query
def simple_sample(spark, folder):
    return sampling.simple_sample(order_geo(spark, folder), 250, "tid")


# correlated columns


@query
def pearson_pairs(spark, folder):
    return correlation.pearson_pairs(table(spark, folder, "lineitem"), LINES).select("a", "b", F.round("r", 9).alias("r"))


@query
def mean_correlation(spark, folder):
    return correlation.mean_correlation(correlation.pearson_pairs(table(spark, folder, "lineitem"), LINES)).select("attr", F.round("mean_r", 9).alias("mean_r"))


@query
def topk_correlated(spark, folder):
    return correlation.top_correlated(correlation.pearson_pairs(table(spark, folder, "lineitem"), LINES), 2).select("attr", "other", F.round("r", 9).alias("r"), "rank")


@query
def lasso_sets(spark, folder):
    found = correlation.lasso_sets(table(spark, folder, "lineitem"), LINES, 0.01, 3)
    return sets(spark, found).select(F.array_join("attrs", ",").alias("attrs"))


@query
def kernel_lasso_sets(spark, folder):
    found = correlation.kernel_lasso_sets(table(spark, folder, "lineitem"), LINES, 0.0002, 3)
    return sets(spark, found).select(F.array_join("attrs", ",").alias("attrs"))


@query
def forest_sets(spark, folder):
    found = correlation.forest_sets(table(spark, folder, "lineitem"), LINES, 3)
    return sets(spark, found).select(F.array_join("attrs", ",").alias("attrs"))


@query
def pca_sets(spark, folder):
    found = correlation.principal_components(table(spark, folder, "lineitem"), LINES, 3)
    return sets(spark, correlation.component_sets(found, LINES)).select(F.array_join("attrs", ",").alias("attrs"))


@query
def kernel_pca_sets(spark, folder):
    found = correlation.kernel_components(table(spark, folder, "lineitem"), LINES, 3)
    return sets(spark, correlation.component_sets(found, LINES)).select(F.array_join("attrs", ",").alias("attrs"))


@query
def hierarchical_sets(spark, folder):
    return sets(spark, correlation.hierarchical_sets(table(spark, folder, "lineitem"), LINES, 2)).select(F.array_join("attrs", ",").alias("attrs"))


# vectors


def asked(spark: SparkSession, folder: str) -> DataFrame:
    """The search's stated queries: every vector whose id is divisible by 100."""
    return vectors(spark, folder).where(F.col("id") % 100 == 0)


@query
def semantic_search(spark, folder):
    out = retrieval.semantic_search(asked(spark, folder), vectors(spark, folder), 10)
    return out.select("query_id", "corpus_id", F.round("score", 6).alias("score"), "rank")


@query
def dot_search(spark, folder):
    out = retrieval.semantic_search(asked(spark, folder), vectors(spark, folder), 5, "dot")
    return out.select("query_id", "corpus_id", F.round("score", 6).alias("score"), "rank")


@query
def pair_mining(spark, folder):
    return retrieval.mined_pairs(vectors(spark, folder), 10, 100).select("a", "b", F.round("score", 6).alias("score"))


@query
def similarity_histogram(spark, folder):
    """Scores of each stated query's 50 nearest rows, as the SQL has them."""
    found = retrieval.semantic_search(asked(spark, folder), vectors(spark, folder), 50)
    return retrieval.similarity_histogram(found.withColumn("score", F.round("score", 6)))


@query
def similarity_histogram_all_rows(spark, folder):
    """Scores of the stated queries with all rows, those below 0 too."""
    return retrieval.all_similarities_histogram(asked(spark, folder), vectors(spark, folder), 6)


def vector_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Each vector with the next one by id, and whether they have one label."""
    rows = vectors(spark, folder)
    after = rows.select((F.col("id") - 1).alias("id"), F.col("vector").alias("other"), F.col("label").alias("other_label"))
    return rows.join(after, "id")


@query
def vector_functions(spark, folder):
    a, b = F.col("vector"), F.col("other")
    made = {"cosine": cosine(a, b), "dot": dot(a, b), "euclidean": euclidean(a, b), "manhattan": manhattan(a, b), "kernel": gaussian_kernel(a, b, 0.15), "first": normalised(a)[0]}
    return vector_pairs(spark, folder).select("id", *[F.round(c, 6).alias(k) for k, c in made.items()])


def scored_pairs(spark: SparkSession, folder: str) -> DataFrame:
    pairs = vector_pairs(spark, folder)
    return pairs.select(F.round(cosine(F.col("vector"), F.col("other")), 6).alias("score"), (F.col("label") == F.col("other_label")).cast("int").alias("label"))


@query
def binary_best_f1(spark, folder):
    return evaluation.best_f1(scored_pairs(spark, folder)).select(*[F.round(c, 9).alias(c) for c in ("f1", "precision", "recall", "threshold")])


@query
def binary_best_accuracy(spark, folder):
    return evaluation.best_accuracy(scored_pairs(spark, folder)).select(*[F.round(c, 9).alias(c) for c in ("accuracy", "threshold")])


@query
def average_precision(spark, folder):
    return evaluation.average_precision(scored_pairs(spark, folder)).select(F.round("ap", 9).alias("ap"))


@query
def ir_metrics(spark, folder):
    found = retrieval.semantic_search(asked(spark, folder), vectors(spark, folder), 11).where("query_id <> corpus_id")
    found = found.select("query_id", "corpus_id", (F.col("rank") - 1).alias("rank")).where("rank > 0")
    labels = vectors(spark, folder).select("id", "label")
    mine = labels.where(F.col("id") % 100 == 0).select(F.col("id").alias("query_id"), "label")
    # rows of a query's label but itself: counted by label, and written out only where found
    sizes = mine.join(labels.groupBy("label").agg((F.count("*") - 1).alias("n_relevant")), "label").where("n_relevant > 0")
    relevant = found.select("query_id", "corpus_id").join(mine, "query_id").join(labels.withColumnRenamed("id", "corpus_id"), ["corpus_id", "label"])
    return evaluation.ranking_measures(found, relevant.select("query_id", "corpus_id"), 10, sizes.select("query_id", "n_relevant")).select("queries", *[F.round(c, 9).alias(c) for c in ("accuracy", "precision", "recall", "mrr", "ndcg", "map")])


@query
def rerank_metrics(spark, folder):
    found = retrieval.semantic_search(asked(spark, folder), vectors(spark, folder), 20)
    labels = vectors(spark, folder).select("id", "label")
    at = found.join(labels.select(F.col("id").alias("query_id"), F.col("label").alias("mine")), "query_id").join(labels.select(F.col("id").alias("corpus_id"), "label"), "corpus_id")
    scored = at.select("query_id", F.col("corpus_id").alias("doc_id"), F.round("score", 6).alias("score"), (F.col("mine") == F.col("label")).cast("int").alias("label"))
    return evaluation.rerank_measures(scored, 10).select("queries", *[F.round(c, 9).alias(c) for c in ("map", "mrr")])


@query
def score_correlations(spark, folder):
    pairs = vector_pairs(spark, folder).select(F.round(cosine(F.col("vector"), F.col("other")), 6).alias("x"), (F.col("label") - F.col("other_label")).alias("y"))
    return evaluation.correlations(pairs, "x", "y").select(*[F.round(c, 9).alias(c) for c in ("pearson", "spearman")])


@query
def triplet_accuracy(spark, folder):
    rows = vectors(spark, folder)
    next_ = lambda k, name: rows.select((F.col("id") - k).alias("id"), F.col("vector").alias(name))
    at = rows.select("id", F.col("vector").alias("anchor")).join(next_(1, "positive"), "id").join(next_(2, "negative"), "id")
    return evaluation.triplet_accuracy(at)


@query
def translation_accuracy(spark, folder):
    """The stated sources among the stated targets, as the SQL has them; a target is named by its source."""
    targets = vectors(spark, folder).where(F.col("id") % 100 == 1).withColumn("id", F.col("id") - 1)
    found = retrieval.all_scores(asked(spark, folder), targets)
    return evaluation.translation_accuracy(found.select(F.col("query_id").alias("source_id"), F.col("corpus_id").alias("target_id"), F.round("score", 6).alias("score")))


@query
def translation_accuracy_all_rows(spark, folder):
    """The stated sources among all rows, and their targets among all rows; no row is its own translation."""
    rows = vectors(spark, folder)

    def best(k: int, name: str):
        found = retrieval.semantic_search(rows.where(F.col("id") % 100 == k), rows, 2, places=6).where("query_id <> corpus_id")
        first = found.groupBy("query_id").agg(F.min_by("corpus_id", "rank").alias("best"))
        return first.agg(F.avg((F.col("best") - F.col("query_id") == 1 - 2 * k).cast("double")).alias(name))

    return best(0, "forward").join(best(1, "backward"), F.lit(True)).withColumn("accuracy", (F.col("forward") + F.col("backward")) / 2)


@query
def label_accuracy(spark, folder):
    rows = vectors(spark, folder).select(F.slice("vector", 1, 10).alias("scores"), "label")
    return evaluation.label_accuracy(rows, "scores", "label")


@query
def vector_mse(spark, folder):
    return evaluation.mean_squared_error(vector_pairs(spark, folder), "vector", "other").select(F.round("mse", 6).alias("mse"))


@query
def cluster_means(spark, folder):
    rows = vectors(spark, folder)
    out = clustering.means(rows.select("id", "vector"), rows.select("id", F.col("label").alias("cluster")))
    return out.select("cluster", F.posexplode("vector").alias("at", "x")).select("cluster", "at", F.round("x", 6).alias("x"))


@query
def k_means_clusters(spark, folder):
    rows = vectors(spark, folder).select("id", "vector")
    centres = rows.where("id < 10").select(F.col("id").cast("int").alias("cluster"), F.col("vector").cast("array<double>").alias("vector"))
    return clustering.k_means_from(rows, centres, 3).select("id", "cluster")


DBSCAN_RADIUS, DBSCAN_LEAST = 1.13, 3


@query
def dbscan_clusters(spark, folder):
    return clustering.dbscan(vectors(spark, folder).select("id", "vector"), DBSCAN_RADIUS, DBSCAN_LEAST)


@query
def vector_communities(spark, folder):
    return clustering.communities(vectors(spark, folder).select("id", "vector"), 0.3, 5)


@query
def cosine_dbscan(spark, folder):
    """All rows by cosine distance, noise as a cluster of its own."""
    return clustering.dbscan(vectors(spark, folder).select("id", "vector"), 0.6, 3, "cosine", noise=True)


@query
def dbscan_k_means(spark, folder):
    """Means of density clusters, over all rows as the sample, as seeds of two of Lloyd's rounds over all rows."""
    rows = vectors(spark, folder).select("id", "vector")
    return clustering.density_seeded_k_means(rows, rows, DBSCAN_RADIUS, DBSCAN_LEAST, 2).select("id", "cluster")


@query
def community_centres(spark, folder):
    return clustering.centres(vectors(spark, folder).select("id", "vector"), 0.3, 5)


@query
def reduced_community_centres(spark, folder):
    """Centres by communities of 8 principal components."""
    return clustering.centres(vectors(spark, folder).select("id", "vector"), 0.8, 5, dimensions=8)


@query
def cluster_groups(spark, folder):
    out = clustering.groups(vectors(spark, folder).select("id", F.col("label").alias("cluster")))
    return out.select("cluster", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


@query
def pooled_vectors(spark, folder):
    """A label's vectors of ids 0 to 99 of each hundred as tokens; every third one is masked out."""
    rows = vectors(spark, folder).withColumn("text", F.floor(F.col("id") / 100).cast("long"))
    texts_ = rows.groupBy("text").agg(F.array_sort(F.collect_list(F.struct("id", "vector"))).alias("all"))
    tokens, mask = F.transform("all", lambda t: t.vector), F.transform("all", lambda t: (t.id % 3 != 2).cast("int"))
    made = [F.transform(pooled(tokens, mask, how), lambda x: F.round(x, 6)).alias(how) for how in POOLINGS]
    made.append(F.transform(chunk_average(tokens), lambda x: F.round(x, 6)).alias("chunks"))
    return texts_.select("text", *made).select("text", F.posexplode(F.arrays_zip(*POOLINGS, "chunks")).alias("at", "v")).select("text", "at", "v.*")


def mined_and_known(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The hundred best pairs, and rows next to each other of one label as duplicates."""
    pairs = retrieval.mined_pairs(vectors(spark, folder), 10, 100).withColumn("score", F.round("score", 6))
    after = vector_pairs(spark, folder).where("label = other_label")
    return pairs, after.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))


@query
def paraphrase_metrics(spark, folder):
    out = evaluation.paraphrase_measures(*mined_and_known(spark, folder))
    return out.select("pairs", *[F.round(c, 9).alias(c) for c in out.columns[1:]])


@query
def paraphrase_metrics_closed(spark, folder):
    pairs, _ = mined_and_known(spark, folder)
    known = pairs.where("(a + b) % 3 = 0").select("a", "b")
    out = evaluation.paraphrase_measures(pairs, known, transitive=True)
    return out.select("pairs", *[F.round(c, 9).alias(c) for c in out.columns[1:]])


# columns and rows


@query
def column_sentences(spark, folder):
    return profiling.column_sentences(geo(spark, folder), GEO, "tid")


@query
def column_tokens(spark, folder):
    return profiling.column_tokens(parts(spark, folder), PARTS, "tid")


@query
def value_codes(spark, folder):
    return profiling.domain(parts(spark, folder), PARTS)


@query
def row_differences(spark, folder):
    """Orders, and orders of which some are gone and others have another priority."""
    rows = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    other = rows.where("o_orderkey % 11 <> 0").withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 7 == 0, F.lit(None)).otherwise(F.col("o_orderpriority")))
    return comparison.row_differences(rows, other, "o_orderkey", ["o_orderstatus", "o_orderpriority"])


@query
def set_distances(spark, folder):
    """Attribute sets of the rules mined of customers, against each other."""
    found = mined_sets(two_rule_sets(spark, folder)[0])
    return comparison.distance_sums(found, GEO).select(F.array_join("attrs", ",").alias("attrs"), F.col("total").cast("long").alias("total"))


@query
def top_sets(spark, folder):
    pairs = correlation.pearson_pairs(table(spark, folder, "lineitem"), LINES)
    return correlation.top_sets(pairs, 2).select(F.array_join("attrs", ",").alias("attrs"))


@query
def cross_information(spark, folder):
    """Columns with the one nearest to each, filled up from those with the two nearest."""
    pairs = correlation.pearson_pairs(table(spark, folder, "lineitem"), LINES)
    ours, related = ([r.attrs for r in correlation.top_sets(pairs, k).collect()] for k in (1, 2))  # a set a column
    return sets(spark, correlation.grown_sets(ours, related, 2)).select(F.array_join("attrs", ",").alias("attrs"))


# small measures


@query
def schema_statistics(spark, folder):
    return profiling.schema_statistics(order_geo(spark, folder), ORDER_GEO)


@query
def gap_index(spark, folder):
    """Where the counts of brands in orders fall first by more than a fortieth."""
    lines = table(spark, folder, "lineitem").join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return profiling.gap_index(profiling.ranked(lines, "p_brand"), 0.025)


@query
def rank_displacement(spark, folder):
    """The ten brands of most ordered lines, against brands by their parts."""
    lines = table(spark, folder, "lineitem").join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return comparison.rank_displacement(profiling.ranked(lines, "p_brand"), profiling.ranked(table(spark, folder, "part"), "p_brand").where("rank < 15"), 10)


@query
def similarity_correlations(spark, folder):
    pairs = vector_pairs(spark, folder).withColumn("y", F.col("label") - F.col("other_label"))
    return evaluation.similarity_correlations(pairs, "vector", "other", "y").select("measure", *[F.round(c, 9).alias(c) for c in ("pearson", "spearman")])


@query
def deletion_noise(spark, folder):
    noisy = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), phrases.thinned(F.col("text"), F.col("doc_id")).alias("text"))
    return noisy.select("id", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


@query
def density_order(spark, folder):
    return clustering.density_order(vectors(spark, folder).select("id", "vector"), 1.2, 3).select("id", F.round("core_distance", 6).alias("core_distance"))
