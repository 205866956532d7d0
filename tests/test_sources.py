import pytest
from pyspark.sql import functions as F

from ferrule.functions import text, vectors
from ferrule.functions.text import short_number, trimmed_list
from ferrule.operators import clustering, comparison, correlation, evaluation, profiling, sampling
from ferrule.sources import examples, tables
from ferrule.sources import rules as rule_files
from ferrule.streaming import violations


def test_rules_round_trip(spark, tmp_path):
    lines = ["(a=1, b=_) => c=_", "(a=x y) => d=3", "not a rule"]
    rules = rule_files.parsed(spark.createDataFrame([(x,) for x in lines], "value string"))
    rule_files.write_rules(rules, str(tmp_path / "general"))
    again = rule_files.read_rules(spark, str(tmp_path / "general"))
    assert sorted(r.rule_id for r in again.collect()) == sorted(lines[:2])
    constant = spark.createDataFrame([("[a, b] => c, (1, 2 || 3)",)], "value string")
    row = rule_files.parsed_constant(constant).first()
    assert [tuple(i) for i in row.lhs] == [("a", "1"), ("b", "2")] and (row.rhs_attr, row.rhs_value) == ("c", "3")


ODD = ["x, y", "_", "a=b", "(c) => d", " ends ", "back\\", "\\_", "||", "[e], (f || g)", "", "plain", "\\ ", "a_b"]


def test_any_value_parses_back(spark):
    kind = "lhs array<struct<attr:string,value:string>>, rhs_attr string, rhs_value string"
    rows = [([("p", v), ("q=, r", None)], "s_t", w) for v in ODD for w in [*ODD, None]]
    df = spark.createDataFrame(rows, kind)
    text = rule_files.rule_text(F.col("lhs"), F.col("rhs_attr"), F.col("rhs_value"))
    again = rule_files.parsed(df.select(text.alias("value"))).collect()
    assert sorted(map(str, (([tuple(i) for i in r.lhs], r.rhs_attr, r.rhs_value) for r in again))) == sorted(map(str, rows))
    rows = [([("p", v), ("q=, r", w)], "s_t", w) for v in ODD for w in ODD]
    text = rule_files.constant_rule_text(F.col("lhs"), F.col("rhs_attr"), F.col("rhs_value"))
    again = rule_files.parsed_constant(spark.createDataFrame(rows, kind).select(text.alias("value"))).collect()
    assert sorted(map(str, (([tuple(i) for i in r.lhs], r.rhs_attr, r.rhs_value) for r in again))) == sorted(map(str, rows))


def test_tables(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    (tmp_path / "t.csv").write_text("a,b,c\n1,,x\n2,y,z\n3,y\n")
    df = tables.read_table(spark, path)
    assert sorted(map(tuple, df.collect())) == [("1", "", "x"), ("2", "y", "z")]
    assert tables.read_table(spark, path, first_columns=2).columns == ["a", "b"]
    assert len(tables.read_table(spark, path, column_share=0.67).columns) == 2
    assert tables.read_table(spark, path, header=False).columns == ["Attr1", "Attr2", "Attr3"]
    numbers = spark.createDataFrame([(1, 10.0, 0.25), (2, 1.5, 100.004)], "k int, x double, y double")
    paths = tables.write_sub_tables(numbers, [["k", "x"], ["y"]], str(tmp_path / "sub"))
    assert sorted(map(tuple, spark.read.csv(paths[0], header=True).collect())) == [("1", "10"), ("2", "1.5")]
    assert sorted(r.k for r in tables.without_last(numbers, "k", rows=1).collect()) == [1]
    hot = tables.one_hot(numbers, ["x"], "k")
    assert sorted(hot.columns) == ["tid", "x_1.5", "x_10.0"]


def test_baskets_sets_and_jobs(spark, tmp_path):
    (tmp_path / "b.txt").write_text("x y x\n\nz\n")
    assert sorted(r["items"] for r in tables.read_baskets(spark, str(tmp_path / "b.txt")).collect()) == [["x", "y"], ["z"]]
    (tmp_path / "s.txt").write_text("a, b,c\nd,e\n")
    sets = rule_files.read_sets(spark, str(tmp_path / "s.txt"))
    assert sorted(r.attrs for r in sets.collect()) == [["a", "b", "c"], ["d", "e"]]
    job = rule_files.parsed_job("p.csv, q.csv\n20\n0.9\n3\nFD-First-DFS-dfs\n")
    assert job == rule_files.Job(("p.csv", "q.csv"), 20, 0.9, 3)
    assert rule_files.parsed_job("p.csv\n20\n5\n").largest == 5


def test_text_functions(spark):
    row = spark.range(1).select(short_number(F.lit(10.0)).alias("a"), short_number(F.lit(1.5)).alias("b"), short_number(F.lit(0.256)).alias("c"), trimmed_list(F.lit("a, b ,c")).alias("d")).first()
    assert (row.a, row.b, row.c, row.d) == ("10", "1.5", "0.26", ["a", "b", "c"])


def test_examples(spark, tmp_path):
    (tmp_path / "l.tsv").write_text("pos\tgood\nneg\tbad\npos\tfine\n")
    assert sorted((r.text, r.code) for r in examples.labelled(spark, str(tmp_path / "l.tsv")).collect()) == [("bad", 0), ("fine", 1), ("good", 1)]
    (tmp_path / "v.txt").write_text("a 1 2\nb 3\nc 4 5\n")
    assert sorted((r.word, r.vector) for r in examples.word_vectors(spark, str(tmp_path / "v.txt"), 2).collect()) == [("a", [1, 2]), ("c", [4, 5])]
    (tmp_path / "p.tsv").write_text("hi\tsalut\tallo\nhi\tsalut\nlong sentence\tx\n")
    assert [tuple(r) for r in examples.parallel(spark, str(tmp_path / "p.tsv"), 6).collect()] == [("hi", ["allo", "salut"])]


@pytest.mark.parametrize(("sizes", "rows", "expected"), [([1, 2, 10, 20], 15, [1, 2, 6, 6]), ([5, 5], 100, [5, 5]), ([4, 4, 4], 6, [2, 2, 2])])
def test_quotas(spark, sizes, rows, expected):
    df = spark.createDataFrame([(f"c{k}", n) for k, n in enumerate(sizes)], "cluster string, size long")
    assert [r.quota for r in sampling.quotas(df, rows).orderBy("cluster").collect()] == expected
    assert sampling.scaled_support(10, 50, 1000) == 1


def test_clusters(spark):
    points = [(i, [float(i // 5) * 10 + i % 5 * 0.1, 0.0]) for i in range(10)] + [(99, [500.0, 0.0])]
    df = spark.createDataFrame(points, "id long, vector array<double>")
    found = {r.id: r.cluster for r in clustering.dbscan(df, 0.25, 3).collect()}
    assert found == {**dict.fromkeys(range(5), 0), **dict.fromkeys(range(5, 10), 5), 99: None}
    centres = spark.createDataFrame([(0, [0.0, 0.0]), (1, [10.0, 0.0])], "cluster int, vector array<double>")
    near = {r.id: r.cluster for r in clustering.k_means_from(df.where("id < 99"), centres, 2).collect()}
    assert near == {i: i // 5 for i in range(10)}
    angles = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.01]), (2, [0.0, 1.0]), (3, [0.01, 1.0]), (4, [0.0, 1.1])], "id long, vector array<double>")
    assert sorted(map(tuple, clustering.communities(angles, 0.9, 2).collect())) == [(0, 0), (0, 1), (2, 2), (2, 3), (2, 4)]


def test_correlation_helpers():
    assert correlation.component_sets([[0.9, -0.4, 0.01]], ["a", "b", "c"]) == [["a", "c"], ["b", "c"]]
    assert correlation.grown_sets([["a"]], [["a", "b", "c"]], 2) == [["a", "b"], ["a", "c"]]
    assert evaluation.reduced([1.0, 3.0], "mean") == 2.0


def test_streamed_class_counts(spark, tmp_path):
    folder = tmp_path / "in"
    rows = [("2024-01-01 00:00:01", "x", "1"), ("2024-01-01 00:00:02", "x", "2"), ("2024-01-01 00:00:03", "x", "1"), ("2024-01-01 01:00:00", "y", "1")]
    spark.createDataFrame(rows, "ts string, a string, b string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(folder))
    stream = spark.readStream.schema("ts timestamp, a string, b string").parquet(str(folder))
    counts = violations.class_counts(stream, ["a"], "b", "ts", "1 minute", "10 minutes")
    run = counts.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    out = violations.confidence(spark.table("counts"), ["a"]).collect()
    assert sorted((r.support, r.hits) for r in out) == [(1, 1), (3, 2)]


def test_pooling_and_list_distance(spark):
    df = spark.createDataFrame([([[1.0, -2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0], ["a", "bb", "c"], ["bb", "a"])], "t array<array<double>>, m array<int>, x array<string>, y array<string>")
    shown = lambda how: df.select(vectors.pooled(F.col("t"), F.col("m"), how).alias("v")).first().v
    assert {h: shown(h) for h in vectors.POOLINGS} == {"first": [1.0, -2.0], "max": [3.0, 4.0], "mean": [2.0, 1.0], "mean_sqrt_length": [4 / 2**0.5, 2 / 2**0.5], "weighted_mean": [7 / 3, 2.0], "last": [3.0, 4.0]}
    with pytest.raises(ValueError, match="unknown pooling"):
        shown("middle")
    words = ["a", "bb", "c"]
    assert df.select(text.list_distance(F.col("x"), F.col("y"), words).alias("d")).first().d == 2  # one left out, one replaced
    assert df.select(text.list_distance(F.col("x"), F.col("y"), ["a"]).alias("d")).first().d is None


def test_codes_of_another_table(spark, tmp_path):
    first = spark.createDataFrame([("x", "1"), ("z", "2")], "a string, b string")
    second = spark.createDataFrame([(1, "z", "2"), (2, "y", "2"), (3, "w", None)], "tid long, a string, b string")
    codes = tables.encoded_like(second, first, ["a", "b"])
    assert [tuple(r) for r in codes.orderBy("tid").collect()] == [(1, 2, 2), (2, 4, 2), (3, 3, 3)]
    back = tables.decoded(tables.encoded_like(first, first, ["a"]), profiling.domain(first, ["a"]), ["a"])
    assert sorted(map(tuple, back.collect())) == [("x", "1"), ("z", "2")]
    tables.write_rows(second, second.where("tid < 3").select("tid"), "tid", str(tmp_path / "rows"))
    assert sorted(map(tuple, tables.read_table(spark, str(tmp_path / "rows")).collect())) == [("y", "2"), ("z", "2")]


def test_short_sets_and_limits(spark):
    df = spark.createDataFrame([(list("abcdef"),), (["b", "a"],)], "attrs array<string>")
    short = [r.attrs for r in comparison.shortened(df, 3, 4).collect()]
    assert ["a", "b"] in short and all(len(x) <= 3 and x == sorted(x) for x in short) and len(short) > 1
    assert sorted(short) == sorted(r.attrs for r in comparison.shortened(df, 3, 4).collect())
    assert profiling.largest_left_side(list("abcd"), 0.5) == 3 and profiling.largest_left_side([str(k) for k in range(20)], 0.5) == 10


def test_centres_relax(spark):
    angles = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.01]), (2, [0.0, 1.0]), (3, [0.01, 1.0]), (4, [0.0, 1.1])], "id long, vector array<double>")
    for relax in ("score", "size"):
        assert clustering.centres(angles, 0.9, 4, relax).count() >= 1
    assert clustering.centres(angles.limit(0), 0.9, 4).count() == 0
    with pytest.raises(ValueError, match="relax"):
        clustering.centres(angles, 0.9, 4, "both")


def test_components_of_duplicates_are_counted(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.8), (4, 5, 0.7)], "a long, b long, score double")
    known = spark.createDataFrame([(2, 1), (2, 3)], "a long, b long")
    out = evaluation.paraphrase_measures(pairs, known, transitive=True).first()
    assert (out.pairs, out.average_precision, out.recall, out.precision) == (3, 2 / 3, 2 / 3, 1.0)
    none = evaluation.paraphrase_measures(pairs, known.limit(0)).first()
    assert (none.pairs, none.average_precision, none.f1) == (3, 0.0, 0.0)
