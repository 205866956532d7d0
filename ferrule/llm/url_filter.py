"""URL filter: a memory-mapped array of sorted digests, with the strings beside it.

A rule is a host and a path prefix (`example.net/en/`). The index file holds the 64-bit xxhash of every
rule, sorted, and the rules' strings in the same order. A url's candidates are its host's suffixes at
label ends, each with its path cut to every length that some rule has. Their hashes are looked up by one
binary search over a whole batch; each hit is confirmed on the stored string, so that a collision of
hashes can't decide. The longest rule that fits wins; of equal rules, block does.

The file is written to the shared folder and handed to executors by `addFile`: each maps its own copy,
and an executor that is started anew fetches it again. `MOST_BYTES` bounds it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm.shared import shared_folder

#: Executors map the index; this is the largest that is made (over 100 million rules of 60 bytes).
MOST_BYTES = 8 << 30
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without `://`."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    rest = rest.partition("?")[0].partition("#")[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


def packed(rules: Iterable[tuple[str, str]]) -> bytes:
    """The index file of (rule, verdict) pairs."""
    verdicts: dict[str, str] = {}
    for rule, verdict in rules:
        if verdict not in ("allow", "block") or "/" not in rule:
            raise ValueError(f"not a rule: {rule!r}, {verdict!r}")
        verdicts[rule] = "block" if "block" in (verdict, verdicts.get(rule)) else "allow"
    order = sorted((xxhash.xxh64_intdigest(r), r) for r in verdicts)
    strings = [r.encode() for _, r in order]
    lengths = sorted({len(r) - r.index("/") for _, r in order})
    head = np.array([len(order), len(lengths)], np.int64)
    ends = np.cumsum([0, *map(len, strings)], dtype=np.int64)
    blocked = np.array([verdicts[r] == "block" for _, r in order], np.uint8)
    keys = np.array([k for k, _ in order], np.uint64)
    data = b"".join([head.tobytes(), np.array(lengths, np.int64).tobytes(), keys.tobytes(), ends.tobytes(), blocked.tobytes(), *strings])
    if len(data) > MOST_BYTES:
        raise ValueError(f"an index of {len(data)} bytes; MOST_BYTES is {MOST_BYTES}")
    return data


class Index:
    """The mapped file."""

    def __init__(self, path: str) -> None:
        data = np.memmap(path, np.uint8, "r")
        n, kinds = (int(x) for x in data[:16].view(np.int64))
        at = 16 + 8 * kinds
        self.lengths = [int(x) for x in data[16:at].view(np.int64)]
        self.keys, at = data[at : at + 8 * n].view(np.uint64), at + 8 * n
        self.ends, at = data[at : at + 8 * (n + 1)].view(np.int64), at + 8 * (n + 1)
        self.blocked, self.strings = data[at : at + n], data[at + n :]

    def candidates(self, host: str, path: str) -> list[str]:
        """The rule strings that would fit, longest host first."""
        out = []
        while host:
            out += [host + path[:k] for k in self.lengths if k <= len(path)]
            host = host.partition(".")[2]
        return out

    def judged(self, urls: list[tuple[str, str]]) -> list[tuple[str | None, bool | None]]:
        """For each (host, path) the longest rule that fits and whether it blocks; (None, None) if none does."""
        asked = [(k, c) for k, (host, path) in enumerate(urls) for c in self.candidates(host, path)]
        out: list[tuple[str | None, bool | None]] = [(None, None)] * len(urls)
        if not asked or not len(self.keys):
            return out
        keys = np.array([xxhash.xxh64_intdigest(c) for _, c in asked], np.uint64)
        at = np.searchsorted(self.keys, keys)
        hit = self.keys[np.minimum(at, len(self.keys) - 1)] == keys
        for k in np.flatnonzero(hit):
            url, text = asked[k]
            stored, place = text.encode(), int(at[k])
            while place < len(self.keys) and self.keys[place] == keys[k]:
                if self.strings[self.ends[place] : self.ends[place + 1]].tobytes() == stored:
                    best = out[url][0]
                    if best is None or len(text) > len(best):
                        out[url] = (text, bool(self.blocked[place]))
                    break
                place += 1
        return out


@lru_cache(maxsize=4)
def mapped(name: str) -> Index:
    return Index(SparkFiles.get(name))


def publish(spark: SparkSession, data: bytes) -> str:
    """Write the file to the shared folder and hand it to the executors; its name there."""
    name = f"urls-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}")
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    for k in range(0, len(data), 1 << 20):
        stream.write(bytearray(data[k : k + (1 << 20)]))
    stream.close()
    spark.sparkContext.addFile(path.toString())
    return name


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str]], otherwise: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict) for every row of pages; verdict is otherwise where no rule fits.

    A null url, or one without `://`, has an empty host and path, which no rule fits. Rows are
    independent: repeated rows and null keys come back as they are, other columns are not read, an empty
    table gives an empty one. No shuffle; a hot host needs no care.
    """
    name = publish(pages.sparkSession, packed(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = mapped(name)
        for batch in batches:
            split = [split_url(u) for u in batch.column(1).to_pylist()]
            found = index.judged(split)
            verdicts = [otherwise if b is None else "block" if b else "allow" for _, b in found]
            made = [[h for h, _ in split], [p for _, p in split], [r for r, _ in found], verdicts]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.string()) for x in made)], ["key", "host", "path", "rule", "verdict"])

    rows = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, host string, path string, rule string, verdict string").withColumnRenamed("key", key)
