"""Token counts by byte-pair merging with a heap over a linked list.

A word starts as a list of symbols, one for each byte, the last one marked as the word's end. The heap
holds the adjacent pairs that the vocabulary merges, lowest rank and then leftmost first. Each merge
takes one symbol away, so a word has (symbols - merges) tokens, and no identifier is ever made.

The count of each word that white space bounds is remembered by the Python worker, in a table of at
most twice `REMEMBERED` words, the older half of which goes when it is full: the memory needed doesn't
grow with the corpus.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REMEMBERED, SHORT = 500_000, 64

# The printable stand-ins of the 256 bytes that byte-level vocabularies use.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def _stand_ins() -> dict[int, str]:
    rest = [b for b in range(256) if b not in _PRINTABLE]
    return {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Counter(dict):
    """word -> tokens, for one vocabulary file; words that are missing are merged and remembered."""

    def __init__(self, path: str) -> None:
        super().__init__()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, splitter = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or splitter["behavior"] != "Removed":
            raise ValueError(f"{path}: expected a lower-casing word-level BPE vocabulary")
        ids, end = model["vocab"], model["end_of_word_suffix"] or ""
        stand_in = _stand_ins()
        self.inner = [ids[stand_in[b]] for b in range(256)]
        self.final = [ids[stand_in[b] + end] for b in range(256)]
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        #: Rank by pair (the left symbol shifted, plus the right one), and the symbol made by rank.
        self.rank = {ids[a] << 20 | ids[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.made = [ids[a + b] for a, b in pairs]
        self.older: dict[bytes, int] = {}
        #: The library's white space is Unicode's, without the control characters that Python adds.
        self.piece = regex.compile(splitter["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        special = [regex.escape(x["content"]) for x in spec["added_tokens"]]
        self.special = regex.compile("|".join(special)) if special else None

    def __missing__(self, word: bytes) -> int:
        if (count := self.older.get(word)) is None:
            count = self.count(word.decode("utf-8", "replace"))
        if len(word) <= SHORT:
            if len(self) >= REMEMBERED:  # words in use come over again
                self.older = dict(self)
                self.clear()
            self[word] = count
        return count

    def count(self, text: str) -> int:
        """Tokens of a text; strings of special tokens are one token each, as by the library's default."""
        if self.special is None or "<" not in text:
            return self._plain(text)
        return sum(map(self._plain, self.special.split(text))) + len(self.special.findall(text))

    def _plain(self, text: str) -> int:
        if text.isascii():
            text = text.lower()
        else:
            text = unicodedata.normalize("NFC", text)
            # one by one where it matters: the library knows no final sigma
            text = "".join([c.lower() for c in text]) if "Σ" in text else text.lower()
        if text.isalpha() and text.isascii():
            return self._merged(text.encode())
        return sum([self._merged(m.encode()) for m in self.piece.findall(text)])

    def _merged(self, word: bytes) -> int:
        inner, rank, made = self.inner, self.rank, self.made
        symbols = [inner[b] for b in word]
        symbols[-1] = self.final[word[-1]]
        end = len(symbols)
        heap = [rank[pair] << 32 | at for at in range(end - 1) if (pair := symbols[at] << 20 | symbols[at + 1]) in rank]
        if not heap:
            return end
        heapify(heap)
        before, after, count = list(range(-1, end - 1)), list(range(1, end + 1)), end
        while heap:
            top = heappop(heap)
            at = top & 0xFFFFFFFF
            right = after[at]
            if right >= end or symbols[at] < 0:
                continue
            now, new = rank.get(symbols[at] << 20 | symbols[right]), made[top >> 32]
            if now is None or made[now] != new:  # a neighbour has changed since
                continue
            symbols[at], symbols[right] = new, -1
            after[at] = right = after[right]
            if right < end:
                before[right] = at
                if (found := rank.get(new << 20 | symbols[right])) is not None:
                    heappush(heap, found << 32 | at)
            left = before[at]
            if left >= 0 and (found := rank.get(symbols[left] << 20 | new)) is not None:
                heappush(heap, found << 32 | left)
            count -= 1
        return count


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One for each worker process and vocabulary."""
    return Counter(path)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for every row of docs, over its whole text.

    vocabulary: path of a word-level BPE file, present on every executor. limit: over_limit is
    n_tokens > limit. A null text counts as an empty one: 0 bytes, 0 tokens. Rows are independent:
    repeated rows and null keys come back as they are, other columns are left out, an empty table
    gives an empty one. No shuffle; nothing is broadcast.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(vocabulary)
        for batch in batches:
            sizes, counts = [], []
            for value in batch.column(1).cast(pa.large_binary()):
                data = value.as_py() or b""
                sizes.append(len(data))
                counts.append(sum(map(tokens.__getitem__, data.split())))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], ["key", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(counted, f"key {kind}, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
