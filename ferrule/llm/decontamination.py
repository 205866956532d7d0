"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

Texts become templates, one token for each word: names, numbers and units stand as typed placeholders,
the rest is lower-cased and loses its punctuation. Windows of `WINDOW` template tokens are hash-joined
with those of the benchmark, so a question whose numbers or names were changed still meets its original.
A match counts only if its slots are consistent: along one alignment of document and item, each value of
the item is replaced by one and the same value of the document. A document is contaminated by an item
when the consistent alignments cover `COVERED` of the item's windows.

- A number is a word that begins with a digit; a unit a word of `UNITS` after a number; a name a word of
  a capital and small letters that follows one space after a letter, a digit, a comma or a semicolon.
- Windows with fewer than `LITERAL` words that aren't slots say too little and aren't used, unless an item has
  no others: then those with one such word are. An item of `SHORT` to `WINDOW` - 1 words has one window, the
  whole item, if it has a word that isn't a slot; its length's windows are taken of documents only where the
  benchmark has such items. Items of fewer words are never matched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.llm.shared import keep, spare

WINDOW, LITERAL, SHORT, COVERED = 8, 4, 4, 0.3
#: Rows (24 bytes each) of benchmark windows up to which they are broadcast; beyond, both sides are
#: shuffled. The same holds for the keys of the documents that have matches.
BROADCAST_ROWS = 1_000_000
#: Units of measurement and money.
UNITS = "mm cm m km in ft yd mi miles mile meters meter metres metre feet foot inches inch g kg mg lb lbs oz pounds pound ounces grams kilograms tons l ml liters liter litres litre gallons s sec secs seconds second min mins minutes minute h hr hrs hours hour days day weeks week months month years year mph kph dollars dollar cents euros euro usd eur gbp percent degrees degree"
_SPACE = r"[\x20\x09-\x0D]+"
_NAME, _NUMBER, _UNIT = "\u0001", "\u0002", "\u0003"


def slotted(text: Column) -> Column:
    """The words of a text as an array; a slot's word has its type's mark in front, and its value after it."""
    t = F.translate(text, _NAME + _NUMBER + _UNIT, "")
    t = F.regexp_replace(t, r"(?<=[\p{L}\p{N},;] )(\p{Lu}\p{Ll}+)", f"{_NAME}$1")
    t = F.regexp_replace(t, r"(?<![^\x20\x09-\x0D])([$€£]?[0-9])", f"{_NUMBER}$1")
    t = F.regexp_replace(t, rf"({_NUMBER}[^\x20\x09-\x0D]*{_SPACE})({'|'.join(UNITS.split())})(?![\p{{L}}\p{{N}}])", f"$1{_UNIT}$2")
    t = F.regexp_replace(F.lower(t), r"[^\p{L}\p{M}\p{N}\x09-\x0D\x20\x01-\x03]+", "")
    return F.filter(F.split(t, _SPACE), lambda w: w != "")


def template(slots: Column) -> Column:
    """The same words with slots reduced to their marks."""
    mark = F.array(F.lit(_NAME), F.lit(_NUMBER), F.lit(_UNIT))
    return F.transform(slots, lambda w: F.when(F.array_contains(mark, F.substring(w, 1, 1)), F.substring(w, 1, 1)).otherwise(w))


def window_hashes(words: Column, n: int = WINDOW) -> Column:
    """A hash for each run of n words; an empty array if there are fewer."""
    last = F.size(words) - n + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda k: F.xxhash64(F.slice(words, k, F.lit(n))))).otherwise(F.array().cast("array<bigint>"))


def some(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item_id, n_matched, n_windows, n_slots): a row for each document and benchmark item that it gives away.

    n_matched: the item's windows that consistent alignments hold; n_windows: all its windows in use;
    n_slots: slots within the aligned stretches. Null and empty texts match nothing. Rows that share a
    key are judged together; a null key is a key. Repeated items of one item_id are one item. Other
    columns are not read. Empty tables give an empty result.
    The documents' windows are never shuffled while the benchmark's number at most BROADCAST_ROWS.
    """
    items = benchmark.select(F.col(item).alias("item_id"), slotted(F.col(item_text).cast("string")).alias("item_slots")).dropDuplicates()
    items = items.withColumn("item_words", template(F.col("item_slots"))).withColumn("version", F.xxhash64("item_slots"))
    words = F.col("item_words")
    short = (F.size(words) >= SHORT) & (F.size(words) < WINDOW)
    hashes = F.when(short, F.array(F.xxhash64(words))).otherwise(window_hashes(words))
    grams = items.select("item_id", "version", "item_words", F.when(short, F.size(words)).otherwise(WINDOW).alias("width"), F.posexplode(hashes).alias("item_at", "hash"))
    literal = F.size(F.filter(F.slice("item_words", F.col("item_at") + 1, F.col("width")), lambda w: w > _UNIT))
    most = grams.withColumn("literal", literal).groupBy("item_id", "version").agg(F.max("literal").alias("most"))
    grams = grams.withColumn("literal", literal).join(most, ["item_id", "version"])
    grams = grams.where(F.col("literal") >= F.when(F.col("most") >= LITERAL, LITERAL).otherwise(1))
    grams = keep(grams.select("item_id", "version", "item_at", "hash", "width"), "grams")
    widths = sorted({r.width for r in grams.where(F.col("width") < WINDOW).select("width").distinct().collect()})
    totals = grams.groupBy("item_id", "version").agg(F.count("*").alias("n_windows"))

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    found = rows.select("key", template(slotted(F.col("text"))).alias("words"))
    windows = found.select("key", F.posexplode(window_hashes(F.col("words"))).alias("at", "hash")).withColumn("width", F.lit(WINDOW))
    for n in widths:  # WINDOW - SHORT of them at most
        windows = windows.unionByName(found.select("key", F.posexplode(window_hashes(F.col("words"), n)).alias("at", "hash")).withColumn("width", F.lit(n)))
    found = windows.join(some(grams), ["hash", "width"]).select("width", "key", "item_id", "version", "item_at", (F.col("at") - F.col("item_at")).alias("shift"))
    # one row for each alignment: its item windows as a count and the stretch that they span
    along = found.groupBy("key", "item_id", "version", "shift", "width").agg(F.collect_set("item_at").alias("held"))
    along = keep(along, "along")

    wanted = along.select(F.col("key").alias("of")).distinct()
    again = rows.join(some(wanted), F.col("key").eqNullSafe(F.col("of")), "left_semi").select("key", slotted(F.col("text")).alias("slots"))
    ends = along.withColumn("low", F.array_min("held")).withColumn("size", F.array_max("held") - F.array_min("held") + F.col("width"))
    ends = ends.withColumnRenamed("key", "of")
    at = again.join(ends, F.col("key").eqNullSafe(F.col("of"))).drop("of").join(items.select("item_id", "version", "item_slots"), ["item_id", "version"])
    at = at.withColumn("ours", F.slice("slots", F.col("low") + F.col("shift") + 1, F.col("size"))).withColumn("theirs", F.slice("item_slots", F.col("low") + 1, F.col("size")))
    both = F.zip_with("ours", "theirs", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    pairs = F.filter(both, lambda x: (x.a <= _UNIT + "￿") & (F.substring(x.a, 1, 1) == F.substring(x.b, 1, 1)))
    at = at.where(F.size("ours") == F.size("theirs")).withColumn("slots", pairs)
    one = F.size(F.array_distinct("slots")) == F.size(F.array_distinct(F.transform("slots", lambda x: x.b)))
    good = at.where(one).select("key", "item_id", "version", F.size("slots").alias("slots"), F.explode("held").alias("item_at"))
    held = good.groupBy("key", "item_id", "version").agg(F.count_distinct("item_at").alias("n_matched"), F.max("slots").cast("long").alias("n_slots"))
    held = held.join(totals, ["item_id", "version"]).where(F.col("n_matched") >= COVERED * F.col("n_windows"))
    best = held.groupBy("key", "item_id").agg(F.max(F.struct("n_matched", "n_windows", "n_slots")).alias("best"))
    return best.select(F.col("key").alias(key), F.col("item_id").alias(item), "best.n_matched", "best.n_windows", "best.n_slots")


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that give away no item, with all their columns."""
    (of_key,) = spare(docs, "key")
    gone = keep(contaminated(docs, benchmark, key, text).select(F.col(key).alias(of_key)).distinct(), "gone")
    return docs.join(some(gone), F.col(key).eqNullSafe(F.col(of_key)), "left_anti")
