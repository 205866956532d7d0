"""Text examples: labelled sentences, pairs and triplets, parallel sentences, word vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _tsv(spark: SparkSession, path: str, columns: int) -> DataFrame:
    parts = F.split(F.col("value"), "\t", -1)
    return spark.read.text(path).where(F.size(parts) >= columns).select(*[parts[k].alias(f"c{k}") for k in range(columns)])


def labelled(spark: SparkSession, path: str) -> DataFrame:
    """(text, label, code): code numbers the labels from 0 in their order."""
    rows = _tsv(spark, path, 2).select(F.col("c1").alias("text"), F.col("c0").alias("label"))
    codes = rows.select("label").distinct().withColumn("code", F.row_number().over(Window.orderBy("label")) - 1)
    return rows.join(codes, "label").select("text", "label", "code")


def scored_pairs(spark: SparkSession, path: str, low: float = 0.0, high: float = 5.0) -> DataFrame:
    """(first, second, score): scores from low..high to 0..1."""
    rows = _tsv(spark, path, 3)
    return rows.select(F.col("c0").alias("first"), F.col("c1").alias("second"), ((F.col("c2").cast("double") - low) / (high - low)).alias("score"))


def triplets(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, 3).toDF("anchor", "positive", "negative")


def parallel(spark: SparkSession, path: str, longest: int) -> DataFrame:
    """(source, targets): distinct translations of each source; lines with a longer sentence are dropped."""
    parts = F.split(F.col("value"), "\t")
    rows = spark.read.text(path).select(parts.alias("s")).where(F.forall("s", lambda x: F.length(x) <= longest) & (F.size("s") > 1))
    rows = rows.select(F.col("s")[0].alias("source"), F.explode(F.slice("s", 2, 1_000_000)).alias("target"))
    return rows.groupBy("source").agg(F.array_sort(F.collect_set("target")).alias("targets"))


def word_vectors(spark: SparkSession, path: str, size: int) -> DataFrame:
    """(word, vector) of lines `word v1 ... vd`; lines of another width are dropped."""
    parts = F.split(F.trim("value"), " ")
    rows = spark.read.text(path).select(parts.alias("p")).where(F.size("p") == size + 1)
    return rows.select(F.col("p")[0].alias("word"), F.transform(F.slice("p", 2, size), lambda x: x.cast("double")).alias("vector"))


def tokens(text, stop_words: tuple[str, ...] = ()):
    """Words of a text column: split at blanks, without punctuation at the ends, lower case, no stop words."""
    words = F.transform(F.split(F.trim(text), r"\s+"), lambda w: F.lower(F.regexp_replace(w, r"^[\p{Punct}]+|[\p{Punct}]+$", "")))
    return F.filter(words, lambda w: (w != "") & ~w.isin(*stop_words) if stop_words else w != "")


def bag_of_words(rows: DataFrame, tid: str, text: str) -> DataFrame:
    """(tid, word, n)."""
    return rows.select(F.col(tid).alias("tid"), F.explode(tokens(F.col(text))).alias("word")).groupBy("tid", "word").agg(F.count("*").alias("n"))
