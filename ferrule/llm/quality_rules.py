"""Quality rules: compression bands over whole documents and over fixed chunks.

Repetitive text compresses too well and random text too badly. How well ordinary prose compresses
depends on its length, so the limits do too: `BANDS` holds, by size in bytes, the least and the greatest
zstandard ratio (bytes / compressed bytes) of a document that is kept, and `CHUNK_BAND` the same for every
chunk of `CHUNK` bytes, so that one bad stretch inside a long good text is seen as well. The last chunk is
the text's last `CHUNK` bytes and overlaps the one before it, so that no byte of a longer text goes unjudged.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVEL = 3
#: (documents of fewer bytes than, least ratio, greatest ratio), about a tenth outside what prose shows.
BANDS = (
    (128, 0.0, 1.5),
    (256, 1.0, 1.8),
    (512, 1.15, 1.95),
    (1024, 1.3, 2.2),
    (2048, 1.45, 2.25),
    (4096, 1.55, 2.35),
    (8192, 1.65, 2.45),
    (16384, 1.75, 2.55),
    (65536, 1.8, 2.7),
    (float("inf"), 1.85, 2.9),
)
CHUNK, CHUNK_BAND = 2048, (1.5, 2.3)
#: The windows of the base rule, and its limits.
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20

_SYMBOLS, _FOLLOWING, _SPACES = b"#*$%&|<>", bytes(range(0x80, 0xC0)), b" \t\n\x0b\x0c\r"


def repeated_words(words: list[bytes], n: int = WINDOW) -> int:
    """How many words stand in a window of n words that occurs twice or more (all its places count)."""
    if len(words) <= n:
        return 0
    number = defaultdict(count().__next__)
    ids = np.array([number[w] for w in words], np.int64)
    keys, kinds = ids[: len(ids) - n + 1], len(number)
    bound = kinds
    for k in range(1, n):
        if bound >= (1 << 62) // kinds:  # renumber, so that keys stay exact
            found, keys = np.unique(keys, return_inverse=True)
            bound = len(found)
        keys = keys * kinds + ids[k : len(ids) - n + 1 + k]
        bound *= kinds
    order = np.sort(keys)
    again = order[1:][order[1:] == order[:-1]]
    if not len(again):
        return 0
    starts = np.isin(keys, again).astype(np.int64)
    covered = np.zeros(len(ids) + 1, np.int64)
    covered[: len(starts)] += starts
    covered[n : n + len(starts)] -= starts
    return int((np.cumsum(covered[:-1]) > 0).sum())


def duplicate_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line of the text."""
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def ratios(data: bytes, compressor: zstandard.ZstdCompressor) -> tuple[float, float, float]:
    """Of the whole text, and the least and the greatest of its chunks (of the whole, if it has none)."""
    if not data:
        return 0.0, 0.0, 0.0
    whole = len(data) / len(compressor.compress(data))
    if len(data) <= CHUNK:
        return whole, whole, whole
    parts = [data[min(k, len(data) - CHUNK) :][:CHUNK] for k in range(0, len(data), CHUNK)]
    chunks = [len(x) / len(compressor.compress(x)) for x in parts]
    return whole, min(chunks), max(chunks)


def in_bands(size: int, whole: float, least: float, greatest: float) -> bool:
    low, high = next((lo, hi) for most, lo, hi in BANDS if size < most)
    good = low <= whole <= high
    return good and (size <= CHUNK or CHUNK_BAND[0] <= least and greatest <= CHUNK_BAND[1])


_COLUMNS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, ratio double, chunk_least double, chunk_greatest double"


def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    compressor = zstandard.ZstdCompressor(level=LEVEL)
    names = [x.split()[0] for x in _COLUMNS.split(", ")]
    for batch in batches:
        out: list[tuple] = []
        for value in batch.column(batch.num_columns - 1).cast(pa.large_binary()):
            data = value.as_py() or b""
            words = data.split()
            solid = data.translate(None, _SPACES)
            repeated = repeated_words(words)
            failed = len(words) < LEAST_WORDS or 100 * repeated > MOST_REPEATED * len(words)
            found = ratios(data, compressor)
            out.append((len(words), len(solid.translate(None, _FOLLOWING)), len(data) - len(data.translate(None, _SYMBOLS)), duplicate_lines(data), repeated, failed, not failed and in_bands(len(data), *found), *found))
        columns = list(zip(*out, strict=True)) or [()] * len(names)
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 3
        made = [pa.array(x, k) for x, k in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*batch.schema.names[:-1], *names])


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A verdict for every row of docs, over its whole text: key, counts, base_failed, kept, ratios.

    A null or empty text has no words, so it fails the base rule. Very long texts need memory in
    proportion to the one text. Rows are independent: repeated rows and null keys come back as they are,
    other columns are left out, an empty table gives an empty one. No shuffle.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(judged, f"key {kind}, {_COLUMNS}").withColumnRenamed("key", key)


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that `quality` keeps, with all their columns. No shuffle and no join: the verdict
    is taken in the same pass. Columns may have any name."""
    names = docs.columns
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)], F.col(f"`{text}`").cast("string").alias("judged"))
    fields = ", ".join(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(docs.schema.fields))
    kept = rows.mapInArrow(judged, f"{fields}, {_COLUMNS}").where("kept")
    return kept.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)])
