"""Ranked lexical search over a two-level quantised index.

A term's impact in a document is the fraction (1000000000 * tf) div (1000 * tf + 8 * m), m being 10 and 90 times
the document's length over the mean. The first level of the index has impacts in steps of `STEP`, rounded upwards
into a byte; the second has lengths and occurrences. Sums of weighted bytes bound a score from above, and those of
the bytes less one from below. `search` reads the index twice: the first time each item's k-th best lower bound
is found, from the best k of each task; the second time every document whose upper bound reaches it is scored again in
integers, with nothing left out. So results are exact, whatever the step.

The index holds the terms that the items ask for. Items are a stated set of queries, asked in blocks of
`BLOCK_ITEMS` rows and `BLOCK_BYTES` of text: what goes to the executors and to the driver is bounded by a block, not
by the table. Documents are never exchanged: from tasks come only the best k of each item, so that neither a frequent
term nor a long document makes a group.

A term is known by 64 bits of hash, on both sides; among the terms of a block, one in 10^12 or so of the words of a corpus
of 10^7 different ones is taken for another.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrule.llm import words
from ferrule.llm.shared import importable, keep

BLOCK_ITEMS, BLOCK_BYTES = 16_384, 16 << 20
#: Steps of an impact, which is under a million, so that it fits a byte.
STEP = -(-1_000_000 // 255)
#: Documents and cells (terms by documents) that are bounded in one go, and bytes of text cut into terms.
ROWS, CELLS, TEXT = 1024, 1 << 25, 1 << 20

_SEPARATORS = bytes(c for c in range(128) if not chr(c).isalnum())


def runs(separators: bytes, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs without separators in texts that lie one after the other, never across
    the starts of texts (at, from 0, with the end)."""
    cut = np.zeros(256, bool)
    cut[list(separators)] = True
    inside = ~cut[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = at[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] |= inside[cuts]
    last[cuts - 1] |= inside[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def terms(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all terms of texts that lie one after the other, and the text of each: longest runs of ASCII
    letters and digits and of bytes above 127, A-Z as a-z."""
    at = at - at[0]
    starts, ends = runs(_SEPARATORS, data, at)
    return words.hashes(data, starts, ends), np.searchsorted(at, starts, "right") - 1


def blocks(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows (from, to) of about so many bytes, their bytes and starts; a longer text is a run of its own."""
    data, at = words.texts(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1]
        lo = hi


@dataclass
class Asked:
    """A block of items: their own values, and the places in `hashes` (sorted) of each one's terms."""

    ids: list
    places: list[np.ndarray]
    hashes: np.ndarray
    weights: np.ndarray | None = None
    reach: np.ndarray | None = None

    @staticmethod
    def of(rows: list[tuple]) -> Asked:
        found = []
        for _, text in rows:
            data = np.frombuffer((text or "").encode(), np.uint8)
            found.append(np.unique(terms(data, np.array([0, len(data)]))[0]) if len(data) else np.empty(0, np.uint64))
        hashes = np.unique(np.concatenate([*found, np.empty(0, np.uint64)]))
        return Asked([r[0] for r in rows], [np.searchsorted(hashes, x) for x in found], hashes)


def postings(docs: DataFrame, sent: Broadcast) -> DataFrame:
    """(key, n, terms, tfs) of each document with a term: its length, and the asked terms in it."""
    kind = docs.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = sent.value.hashes
        maybe = np.zeros(1 << 20, bool)  # most words are told apart by 20 bits
        maybe[(hashes >> np.uint64(44)).astype(np.int64)] = True
        for batch in batches:
            for lo, hi, data, at in blocks(batch.column(1), TEXT):
                said, row = terms(data, at)
                n = np.bincount(row, minlength=hi - lo)
                near = np.flatnonzero(maybe[(said >> np.uint64(44)).astype(np.int64)])
                place = np.minimum(np.searchsorted(hashes, said[near]), len(hashes) - 1)
                sure = hashes[place] == said[near] if len(hashes) else np.zeros(0, bool)
                pairs, tf = np.unique(row[near][sure] * np.int64(len(hashes)) + place[sure], return_counts=True)
                of, term = (pairs // len(hashes), pairs % len(hashes)) if len(hashes) else (pairs, pairs)
                ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=hi - lo))]).astype(np.int32)
                held = pa.array(n > 0)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))).filter(held) for x in (term, tf)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).filter(held), pa.array(n).filter(held), *lists], ["key", "n", "terms", "tfs"])

    return docs.mapInArrow(run, f"key {kind}, n bigint, terms array<int>, tfs array<int>")


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """A term's share of the score before its weight; tf and n are parallel, and may be 0."""
    m = 10 + 90 * n * documents // length
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def indexed(found: DataFrame, documents: int, length: int) -> DataFrame:
    """found with its first level: impacts, a byte for each of terms."""
    schema = found.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tf, n = batch.column(3), batch.column(1).to_numpy()
            sizes = np.diff(np.asarray(tf.offsets))
            exact = impacts(tf.flatten().to_numpy().astype(np.int64), np.repeat(n, sizes), documents, length)
            bytes_ = (-(-exact // STEP)).astype(np.uint8).tobytes()
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            level = pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(bytes_)])
            yield pa.RecordBatch.from_arrays([*batch.columns, level], [*batch.schema.names, "impacts"])

    return found.mapInArrow(run, f"key {schema['key'].dataType.simpleString()}, n bigint, terms array<int>, tfs array<int>, impacts binary")


def _parts(batch: pa.RecordBatch, wide: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of a batch with their dense first level (terms x documents), and the place of each posting in it."""
    rows = max(1, min(ROWS, CELLS // max(1, wide)))
    names = batch.schema.names
    for lo in range(0, len(batch), rows):
        part = batch.slice(lo, rows)
        lists = part.column(names.index("terms"))
        of = np.repeat(np.arange(len(part)), np.diff(np.asarray(lists.offsets)))
        term = lists.flatten().to_numpy()
        data, at = words.texts(part.column(names.index("impacts")))
        dense = np.zeros((wide, len(part)), np.uint8)
        dense[term, of] = data[at[0] : at[-1]]
        yield part, dense, term, of


def _upper(asked: Asked, i: int, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Upper and lower bounds of the scores of an item; doubles hold these whole numbers."""
    level = dense[asked.places[i]]
    w = asked.weights[asked.places[i]].astype(np.float64)
    upper = STEP * (w @ level)
    return upper, upper - STEP * (w @ (level > 0))


def lower_bounds(index: DataFrame, sent: Broadcast, k: int) -> DataFrame:
    """(item, bound): of each task, the k best lower bounds above 0 of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        best = np.zeros((len(asked.ids), k))
        for batch in batches:
            for _, dense, _, _ in _parts(batch, len(asked.hashes)):
                for i in range(len(asked.ids)):
                    if len(asked.places[i]):
                        low = _upper(asked, i, dense)[1]
                        low = low[low > best[i, 0]]
                        if len(low):
                            best[i] = np.sort(np.partition(np.concatenate([best[i], low]), -k)[-k:])
        item, rank = np.nonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(best[item, rank].astype(np.int64))], ["item", "bound"])

    return index.select("terms", "impacts").mapInArrow(run, "item int, bound bigint")


def rescored(index: DataFrame, sent: Broadcast, documents: int, length: int, k: int) -> DataFrame:
    """(item, key, score): of each task, the k best of all documents whose upper bound reaches the item's k-th lower one."""
    kind = index.schema["key"].dataType.simpleString()
    columns = ["key", "n", "terms", "tfs", "impacts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, best, typed = sent.value, {}, None
        order = lambda x: (-x[0], x[1] is None, x[1])
        for batch in batches:
            typed = batch.schema.field("key").type
            for part, dense, term, of in _parts(batch, len(asked.hashes)):
                occurrences = None
                for i in range(len(asked.ids)):
                    if not len(asked.places[i]):
                        continue
                    upper = _upper(asked, i, dense)[0]
                    near = np.flatnonzero((upper >= asked.reach[i]) & (upper > 0))
                    if not len(near):
                        continue
                    if occurrences is None:
                        occurrences = np.zeros(dense.shape, np.int32)
                        occurrences[term, of] = part.column(3).flatten().to_numpy()
                        n, keys = part.column(1).to_numpy(), part.column(0)
                    tf = occurrences[asked.places[i]][:, near].astype(np.int64)
                    score = asked.weights[asked.places[i]] @ impacts(tf, n[near], documents, length)
                    mine = best.setdefault(i, [])
                    mine += [(int(s), key) for s, key in zip(score, keys.take(pa.array(near)).to_pylist(), strict=True) if s > 0]
                    if len(mine) > ROWS:
                        best[i] = sorted(mine, key=order)[:k]
        made = [(i, *x) for i, mine in best.items() for x in sorted(mine, key=order)[:k]]
        if made:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in made], pa.int32()), pa.array([r[2] for r in made], typed), pa.array([r[1] for r in made], pa.int64())], ["item", "key", "score"])

    return index.select(*columns).mapInArrow(run, f"item int, key {kind}, score bigint")


def _block(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """(item, key, rank, score) of one block of items (item, text)."""
    spark = docs.sparkSession
    asked = Asked.of([tuple(r) for r in items.orderBy("item", "text").collect()])  # a block's bound
    found = keep(postings(docs, spark.sparkContext.broadcast(asked)), "postings")
    documents, length = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequency = np.zeros(len(asked.hashes), np.int64)
    for term, n in found.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # one row a term of the block
        frequency[term] = n
    asked.weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in frequency.tolist()], np.int64)
    index = keep(indexed(found, documents, max(1, length)), "index")
    order = Window.partitionBy("item").orderBy(F.desc("bound"))
    kth = lower_bounds(index, spark.sparkContext.broadcast(asked), k).withColumn("r", F.row_number().over(order)).where(F.col("r") == k)
    asked.reach = np.zeros(len(asked.ids))
    for item, bound in kth.select("item", "bound").collect():  # one row an item of the block
        asked.reach[item] = bound
    ranked = rescored(index, spark.sparkContext.broadcast(asked), documents, max(1, length), k)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("key").asc_nulls_last())
    ranked = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame(list(enumerate(asked.ids)), f"n int, of {items.schema['item'].dataType.simpleString()}")
    return ranked.join(names, F.col("item") == F.col("n")).select(F.col("of").alias("item"), "rank", "key", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item, rank, key, score): the k best documents of each row of items, all if fewer score above 0.

    Terms, weights and scores are those of the module's text; equal scores go by the key, nulls last. A null text has no
    terms: such a document is never found and isn't counted, such an item finds nothing. Repeated documents are
    ranked each; repeated items are answered each. Texts of any length are read whole. Extra columns are left
    out, whatever their names. Empty tables give an empty one."""
    importable(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    asked = items.select(F.col(item).alias("item"), F.col(item_text).cast("string").alias("text"))
    count, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n = max(1, -(-count // BLOCK_ITEMS), -(-size // BLOCK_BYTES))
    parts = [asked] if n == 1 else [asked.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b) for b in range(n)]
    out = reduce(DataFrame.unionByName, [_block(rows, part, k) for part in parts])
    return out.select(F.col("item").alias(item), "rank", F.col("key").alias(key), "score")
