"""Words of UTF-8 texts, found and hashed a block at a time with numpy.

A word is a longest run of bytes outside 0x20 and 0x09-0x0D; all other bytes, those of multi-byte
characters included, belong to words. A null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SEPARATORS = b" \t\n\x0b\x0c\r"
#: Bytes hashed in one go, and the length from which a single word is hashed by xxhash instead.
BLOCK, LONG = 1 << 20, 1 << 12

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[list(SEPARATORS)] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BASE = 0x9E3779B97F4A7C15
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64))
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]  # A-Z as a-z
with np.errstate(over="ignore"):
    _POWER = np.cumprod(np.full(BLOCK + LONG + 1, _BASE, np.uint64))
    _INVERSE = np.cumprod(np.full(BLOCK + LONG + 1, pow(_BASE, -1, 1 << 64), np.uint64))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and where each row's start and the last one's end; nulls are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8), at


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of one text."""
    inside = np.empty(len(data) + 2, np.int8)
    inside[0] = inside[-1] = 0
    np.logical_not(_SEPARATOR[data], out=inside[1:-1].view(bool))
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each word; with fold, A-Z count as a-z. Depends on nothing but the word's bytes."""
    out = np.empty(len(starts), np.uint64)
    table, lengths = (_FOLDED if fold else _BYTE), ends - starts
    long = np.flatnonzero(lengths > LONG)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            lo = starts[i]
            j = max(i + 1, int(np.searchsorted(starts, lo + BLOCK)))
            hi = min(ends[j - 1], lo + BLOCK + LONG)
            sums = np.empty(hi - lo + 1, np.uint64)
            sums[0] = 0
            np.cumsum(table[data[lo:hi]] * _POWER[: hi - lo], out=sums[1:])
            s, e = starts[i:j] - lo, np.minimum(ends[i:j], hi) - lo
            out[i:j] = (sums[e] - sums[s]) * _INVERSE[s]
            i = j
        for k in long:
            word = data[starts[k] : ends[k]].tobytes()
            out[k] = xxhash.xxh64_intdigest(word.lower() if fold else word)
        return mixed(out + lengths.astype(np.uint64))


def windows(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of n words; of the whole sequence if there are fewer (none: no hash)."""
    if not len(words):
        return words
    n = min(n, len(words))
    with np.errstate(over="ignore"):
        x = words[: len(words) - n + 1].copy()
        for k in range(1, n):
            x = mixed(x * np.uint64(_BASE) + np.uint64(k)) + words[k : len(words) - n + 1 + k]
        return mixed(x)


def rows(column: pa.Array) -> Iterator[np.ndarray]:
    """The bytes of each text."""
    data, at = texts(column)
    for k in range(len(at) - 1):
        yield data[at[k] : at[k + 1]]
