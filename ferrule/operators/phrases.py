"""Tokens with phrases: runs of words that a table of phrases has become one token, the longest first."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.plans.stages import written


#: Phrases up to which they are broadcast (of 20 letters: about 100 MB).
BROADCAST_PHRASES = 1_000_000
#: Letters of the rows that are read together, by which a worker's memory is bounded.
AT_ONCE = 1 << 22
#: Separators of one letter beside which a word in lower case is the same as within a longer text.
PLAIN = ("_", " ")


def words(text: Column) -> Column:
    """The words between white space; none of a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def thinned(text: Column, key: Column, ratio: float = 0.6, seed: int = 0) -> Column:
    """The text with about a share `ratio` of its words left out, one word at least kept, joined by blanks: deletion noise. Which
    ones is said by a hash of seed, key and place, so reruns agree. A text without words stays as it is, and a null one null."""
    if not 0 <= ratio < 1:
        raise ValueError(f"the ratio {ratio} isn't from 0 to below 1")
    least = f"{int(ratio * 2**32):08x}"
    # what is bound to a lambda's variable is made once, whatever reads it
    bound = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)
    drawn = F.transform(words(text), lambda w, i: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"), (i + 1).cast("string"))).alias("h"), i.alias("i"), w.alias("w")))
    kept = lambda d: bound(F.filter(d, lambda x: F.substring(x.h, 1, 8) >= least), lambda k: F.when(F.size(k) == 0, F.array(F.array_max(d))).otherwise(k))
    return bound(drawn, lambda d: F.when(F.size(d) == 0, text).otherwise(F.array_join(F.transform(kept(d), lambda x: x.w), " ")))


def runs(docs: DataFrame, longest: int, separator: str = "_") -> DataFrame:
    """(row, at, n, run) of docs (row, tokens): every run of 2 to `longest` tokens, joined."""
    heads = docs.select("row", F.posexplode(F.transform("tokens", lambda t, i: F.slice(F.col("tokens"), i + 1, longest))).alias("at", "head"))
    each = heads.where(F.size("head") > 1).select("row", "at", "head", F.explode(F.sequence(F.lit(2), F.size("head"))).alias("n"))
    return each.select("row", "at", "n", F.array_join(F.slice("head", F.lit(1), F.col("n")), separator).alias("run"))


def _lined(docs: DataFrame, separator: str) -> DataFrame:
    """docs (tokens) with the tokens as one text, null if there's none, in `line`, the same in lower case in `lower`, and whether that can't say
    them, since one is null or holds the separator, in `uneven`."""
    line, parts = F.array_join("tokens", separator), F.size(F.array_compact("tokens"))
    longer = F.length(line) - F.length(F.replace(line, F.lit(separator))) != F.size("tokens") - 1
    out = docs.withColumn("line", F.when(F.size("tokens") > 0, line))
    return out.withColumn("lower", F.lower("line")).withColumn("uneven", (F.size("tokens") > 0) & ((parts != F.size("tokens")) | longer))


class _Line:
    """The tokens of some rows in one line: their codes, the different ones, the row of each, and how many there are up to its end."""

    def __init__(self, lines: pa.Array, separator: str) -> None:
        tokens = pc.split_pattern(lines, separator)
        flat, sizes = tokens.flatten().dictionary_encode(), np.diff(np.asarray(tokens.offsets))
        self.code, self.words, self.separator = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.dictionary.to_pylist(), separator
        self.row = np.repeat(np.arange(len(sizes)), sizes)
        self.left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(self.code))

    def longer(self, n: int, at: np.ndarray, ids: np.ndarray, *texts: tuple[list[str], list[str]]) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
        """Places, ids and texts of the runs of n tokens, from places and ids of runs of n - 1; texts: of those by id, and of words by code."""
        fits = self.left[at] >= n
        at = at[fits]
        ids, made = pd.factorize(ids[fits] * len(self.words) + self.code[at + n - 1])
        before, last = (x.tolist() for x in np.divmod(made, max(1, len(self.words))))
        return at, ids, [[run[i] + self.separator + word[k] for i, k in zip(before, last, strict=True)] for run, word in texts]


def _slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Batches of AT_ONCE letters of a column, or of one row."""
    for batch in batches:
        ends, lo = np.r_[0, np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))], 0
        while lo < len(batch):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + AT_ONCE, "right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


class _Known:
    """Phrases, and by length the heads in lower case that longer ones have."""

    def __init__(self, phrases: Sequence[str], lower: Sequence[str], longest: int, separator: str) -> None:
        self.phrases, self.heads = set(), [set() for _ in range(longest)]
        for phrase, low in zip(phrases, lower, strict=True):
            words = low.split(separator)
            if len(words) <= longest:
                self.phrases.add(phrase)
                for k in range(1, len(words)):
                    self.heads[k].add(separator.join(words[:k]))

    def met(self, line: _Line, lower: list[str], longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[str | None]]]:
        """For each length from 1: places of runs, their ids, and by id the phrase that a run is, as it is or else in lower case. lower: of the words, by code."""
        at, ids, run, low = np.arange(len(line.code)), line.code, line.words, lower
        for n in range(1, longest + 1):
            if n > 1:
                on = np.fromiter((x in self.heads[n - 1] for x in low), bool, len(low))[ids] if len(ids) else np.zeros(0, bool)
                at, ids, (run, low) = line.longer(n, at[on], ids[on], (run, line.words), (low, lower))
            yield at, ids, [r if r in self.phrases else x if x in self.phrases else None for r, x in zip(run, low, strict=True)]


def _counted(rows: DataFrame, n: int, shorter: DataFrame | None, separator: str) -> DataFrame:
    """(phrase, rows, even) of the runs of n pieces between separators of rows (lower, uneven): how many rows have it, and how many of them aren't uneven.
    Only of runs both of whose shorter runs are known, if these (phrase) are said."""
    sent = None if shorter is None else rows.sparkSession.sparkContext.broadcast([r.phrase for r in shorter.select("phrase").collect()])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent and _Known(sent.value, sent.value, n, separator)
        for batch in _slices(batches, 0):
            line = _Line(batch.column(0), separator)
            at, ids, run = np.arange(len(line.code)), line.code, line.words
            if known:
                *_, (at, ids, phrase) = known.met(line, line.words, n - 1)
                good = np.array([p is not None for p in phrase], bool)[ids]
                at, ids, run = at[good], ids[good], phrase
                two = np.zeros(len(line.code) + 1, bool)
                two[at] = True
                at, ids = at[two[at + 1]], ids[two[at + 1]]
                at, ids, (run,) = line.longer(n, at, ids, ([r or "" for r in run], line.words))
            else:
                for k in range(2, n + 1):
                    at, ids, (run,) = line.longer(k, at, ids, (run, line.words))
            row, which = np.divmod(pd.unique(line.row[at] * max(1, len(run)) + ids), max(1, len(run)))
            even = ~batch.column(1).to_numpy(zero_copy_only=False)[row]
            yield pa.RecordBatch.from_arrays([pa.array(run, pa.string()), *(pa.array(np.bincount(x, minlength=len(run))) for x in (which, which[even]))], ["phrase", "rows", "even"])

    found = rows.select("lower", "uneven").mapInArrow(each, "phrase string, rows long, even long")
    return found.groupBy("phrase").agg(F.sum("rows").alias("rows"), F.sum("even").alias("even"))


def _all_runs(docs: DataFrame, longest: int, separator: str) -> DataFrame:
    """(phrase) of the different runs of each row of docs (tokens)."""
    head = lambda i: F.slice(F.col("tokens"), i + 1, longest)
    joined = lambda h: F.transform(F.sequence(F.lit(2), F.size(h)), lambda n: F.lower(F.array_join(F.slice(h, F.lit(1), n), separator)))
    each = F.transform("tokens", lambda t, i: F.when(F.size(head(i)) > 1, joined(head(i))).otherwise(F.array().cast("array<string>")))
    # a row's runs are made different in the row itself: no run moves with its row
    return docs.select(F.explode(F.array_distinct(F.flatten(each))).alias("phrase"))


def frequent_phrases(docs: DataFrame, longest: int, least: int, separator: str = "_") -> DataFrame:
    """(phrase, n) of the runs of 2 to `longest` tokens, A-Z as a-z, that are in `least` rows or more of docs (row, tokens).

    A run is in no more rows than its shorter runs: words are counted first, and of each length only runs both of whose shorter ones
    are in enough rows (up to BROADCAST_PHRASES of them; beyond, all are counted). Rows with a null token or the separator within one count
    by their pieces for that, and all their runs are made."""
    if separator not in PLAIN:
        found = _all_runs(docs, longest, separator).withColumn("n", F.lit(1).cast("long"))
    else:
        rows = _lined(docs.select("tokens").where(F.size("tokens") > 0), separator)
        rows = written(rows.select("lower", "uneven", F.when(F.col("uneven"), F.col("tokens")).alias("tokens")), "lines")
        found = _all_runs(rows.where("uneven"), longest, separator).withColumn("n", F.lit(1).cast("long"))
        shorter = None
        for n in range(1, longest + 1):
            some = written(_counted(rows, n, shorter, separator).where(F.col("rows") >= least), "runs")
            shorter = some if some.count() <= BROADCAST_PHRASES else None
            if n > 1:
                found = found.unionByName(some.where("even > 0").select("phrase", F.col("even").alias("n")))
    return found.groupBy("phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _covered(tokens: list[str], matches: list[dict], separator: str) -> tuple[list[str], int]:
    """Tokens with the matches (longest first, then from the left) that don't overlap an earlier one, and how many."""
    free, first = bytearray(b"\x01") * len(tokens), {}
    for m in matches:
        lo, hi = m["at"], m["at"] - m["shorter"]
        if all(free[lo:hi]):
            free[lo:hi] = bytes(hi - lo)
            first[lo] = separator.join(t for t in tokens[lo:hi] if t is not None) if m["phrase"] is None else m["phrase"]
    return [first.get(k, t) for k, t in enumerate(tokens) if free[k] or k in first], len(first)


def _laid(line: _Line, lower: list[str], known: _Known, longest: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The line's tokens covered by phrases, the row of each, and the rows of the phrases."""
    free, laid, words = np.ones(len(line.code), bool), line.code.copy(), list(line.words)
    for n, (at, ids, phrase) in reversed([*enumerate(known.met(line, lower, longest), 1)][1:]):
        is_one = np.array([p is not None for p in phrase], bool)[ids] if len(ids) else np.zeros(0, bool)
        is_one &= np.logical_and.reduce([free[at + k] for k in range(n)])
        at, ids = at[is_one], ids[is_one]
        after, taken, k = np.searchsorted(at, at + n).tolist(), [], 0
        while k < len(at):
            taken.append(k)
            k = after[k]
        at, ids = at[taken], ids[taken]
        for k in range(n):
            free[at + k] = False
            laid[at + k] = -1
        laid[at] = len(words) + ids
        words += phrase
    kept = laid >= 0
    return pa.array(words, pa.string()).take(pa.array(laid[kept])), line.row[kept], line.row[kept & ~free]


def phrase_tokens(docs: DataFrame, phrases: DataFrame, longest: int = 5, separator: str = "_") -> DataFrame:
    """docs (id, tokens) with `tokens` covered by phrases (phrase: words joined by the separator), and `n_phrases`.

    A run of up to `longest` tokens is a phrase as it is or, failing that, in lower case; in each row
    longer matches come before shorter ones, and of one length the left one before those that overlap it. Up to BROADCAST_PHRASES phrases are
    broadcast, and no row moves; beyond that, and for rows with a null token or the separator within one, all runs meet the phrases by
    hash, and only matches' places move. Phrases with an empty word, or of
    more words, aren't used; repeated ones count once. Repeated and null ids come back as they are; null tokens are none."""
    rows = docs.select("id", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))
    known = written(phrases.select("phrase").where(F.col("phrase").isNotNull() & ~F.array_contains(F.split("phrase", separator, -1), "")).distinct(), "phrases")
    few = known.count() <= BROADCAST_PHRASES
    if not few or separator not in PLAIN:
        return _joined(rows, known, few, longest, separator)
    rows = written(_lined(rows, separator).select("id", "line", "lower", "uneven", F.when(F.col("uneven"), F.col("tokens")).alias("tokens")), "lines")
    found = known.select("phrase", F.lower("phrase").alias("lower")).collect()  # BROADCAST_PHRASES at most
    sent = rows.sparkSession.sparkContext.broadcast(([r.phrase for r in found], [r.lower for r in found]))

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said = _Known(*sent.value, longest, separator)
        for batch in _slices(batches, 1):
            line = _Line(batch.column(1), separator)
            place = np.zeros(len(line.words), np.int64)
            place[line.code] = np.arange(len(line.code))
            lower = pc.split_pattern(batch.column(2), separator).flatten().take(pa.array(place)).to_pylist()
            tokens, row, starts = _laid(line, lower, said, longest)
            ends = np.r_[0, np.cumsum(np.bincount(row, minlength=len(batch)))].astype(np.int32)
            count = np.bincount(starts, minlength=len(batch)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), tokens), pa.array(count)], ["id", "tokens", "n_phrases"])

    kind = docs.schema["id"].dataType.simpleString()
    even = rows.where(~F.col("uneven")).select("id", "line", "lower").mapInArrow(cover, f"id {kind}, tokens array<string>, n_phrases bigint")
    uneven = rows.where("uneven").select("id", "tokens")
    return even if uneven.isEmpty() else even.unionByName(_joined(uneven, known, few, longest, separator))


def _joined(docs: DataFrame, known: DataFrame, few: bool, longest: int, separator: str) -> DataFrame:
    """What `phrase_tokens` returns, by a join of all runs with the phrases, which are broadcast if few."""
    rows = written(docs.withColumn("row", F.monotonically_increasing_id()), "tokens")
    few = F.broadcast if few else lambda df: df
    found = runs(rows.select("row", "tokens"), longest, separator)
    # a run that is a phrase as it is can be read from its row again, so its words don't move
    found = found.join(few(known.select(F.col("phrase").alias("same"))), F.col("run") == F.col("same"), "left")
    found = found.join(few(known.select(F.col("phrase").alias("lower"))), F.col("same").isNull() & (F.lower("run") == F.col("lower")), "left")
    found = found.where(F.col("same").isNotNull() | F.col("lower").isNotNull()).select("row", "at", "n", F.when(F.col("same").isNull(), F.col("lower")).alias("phrase"))
    matches = found.groupBy(F.col("row").alias("of")).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("shorter"), "at", "phrase"))).alias("matches"))
    met = rows.join(matches, F.col("row") == F.col("of"), "left").select("id", "tokens", "matches")

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_covered(t, m or [], separator) for t, m in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            tokens, count = [x[0] for x in made], [x[1] for x in made]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.list_(pa.string())), pa.array(count, pa.int64())], ["id", "tokens", "n_phrases"])

    kind = docs.schema["id"].dataType.simpleString()
    return met.mapInArrow(cover, f"id {kind}, tokens array<string>, n_phrases bigint")
