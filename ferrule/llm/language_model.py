"""Scores of texts by a causal self-attention model over subword ids (`attention`).

A text is its words, A-Z as a-z, and one end. Each word is spelt in ids of a byte-level vocabulary, with a space before it,
so that ids say which words they are of. The model gives each id a probability from the ids before it; a word's is
their product, mixed with the word's share of the learnt text (`SHARE_OF_COUNTS` of that), where, as in the
base score, all words not learnt from count as one: what is learnt from the corpus isn't only the weights,
but all its words, and a score is at least the base score less -log10(SHARE_OF_COUNTS) a word.

One pass over the documents to learn from counts words and ids, and keeps the windows of ids, of all of them. Weights are fitted
to all windows in `ROUNDS`, each window in one of them: those of a round are dealt to shards of about `SHARD`, each is a task
that goes on from the same weights, and their mean, taken `MERGED` at a time, starts the next round.

Words of the largest counts, at most `COMMON`, go to the executors; the others meet their counts in a join, so that
nothing that is broadcast grows with the corpus. A word is known by 64 bits of hash.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.llm import words
from ferrule.llm.attention import BATCH, CONTEXT, STRIDE, WINDOW, Scorer, Shape, steps
from ferrule.llm.lexical_search import blocks, runs
from ferrule.llm.shared import importable, keep, let_go

FOLDS, HELD_OUT = 7, 2
INPUTS, HEAD, SHARE_OF_COUNTS = 4096, 159, 0.6
SHARD, ROUNDS, MERGED, START = 32_768, 4, 64, 1e-3
#: A shard of fewer windows than PASSED is gone over again, up to so many times.
PASSED, MOST_PASSES = 16_384, 20
COMMON = 1 << 20
#: Bytes of text taken at once, ids remembered by a worker, and letters from which a word is spelt in pieces.
BLOCK, REMEMBERED, PIECE = 4 << 20, 3 << 20, 64
#: Windows written at once.
SOME = 1 << 15
#: Codes besides the vocabulary's ids: a word's end of text, before a text, after a text.
END, BEFORE, AFTER, CODES = 65_533, 65_535, 65_534, 65_536


class Subwords:
    """Ids of words, remembered by their hashes; what is remembered is bounded."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        if max(ranks.values()) >= END:
            raise ValueError(f"{path}: ids must be under {END}")
        self.encoding = tiktoken.Encoding("subwords", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.forget()

    def forget(self) -> None:
        self.place: dict[int, int] = {}
        self.pool, self.used = np.array([END] * 1024, np.uint16), 1
        self.spans, self.count = np.array([[0, 1]] * 1024, np.int64), 1  # start and size; the first is the end of a text

    def spelt(self, word: bytes) -> list[int]:
        text = word.lower().decode("utf-8", "replace")
        return [i for k in range(0, len(text), PIECE) for i in self.encoding.encode_ordinary((" " if k == 0 else "") + text[k : k + PIECE])]

    def places(self, data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where each of these (different) words is remembered."""
        found = list(map(self.place.get, hashes.tolist()))
        for k in [k for k, at in enumerate(found) if at is None]:
            ids = self.spelt(data[starts[k] : ends[k]].tobytes())
            if self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), np.uint16)])
            if self.count == len(self.spans):
                self.spans = np.concatenate([self.spans, self.spans])
            self.pool[self.used : self.used + len(ids)] = ids
            found[k] = self.place[int(hashes[k])] = self.count
            self.spans[self.count] = self.used, len(ids)
            self.used += len(ids)
            self.count += 1
        return np.array(found, np.int64)


@lru_cache(maxsize=1)
def subwords(path: str, pattern: str) -> Subwords:
    return Subwords(path, pattern)


@dataclass
class Said:
    """Texts as words and ids, all in a row. Each text ends in a word of its own, the end."""

    hashes: np.ndarray  # of the different words
    which: np.ndarray  # of each word in order: its place in hashes, or -1 for the end
    words: np.ndarray  # of each text: where its words start, and where the last one's end
    ids: np.ndarray
    at: np.ndarray  # of each word: where its ids start
    texts: np.ndarray  # of each text: where its ids start, and where the last one's end

    @staticmethod
    def of(data: np.ndarray, at: np.ndarray, known: Subwords) -> Said:
        if known.used > REMEMBERED:
            known.forget()
        at = at - at[0]
        starts, ends = runs(words.SEPARATORS, data, at)
        counts = np.bincount(np.searchsorted(at, starts, "right") - 1, minlength=len(at) - 1)
        h = words.hashes(data, starts, ends)
        codes, hashes = pd.factorize(h)
        first = np.zeros(len(hashes), np.int64)
        first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        place = known.places(data, hashes, starts[first], ends[first])
        stops = np.cumsum(counts)
        which = np.insert(codes.astype(np.int64), stops, -1)
        remembered = np.where(which < 0, 0, place[which] if len(place) else 0)
        start, size = known.spans[remembered].T
        word_at = np.concatenate([[0], np.cumsum(size)])
        ids = known.pool[np.repeat(start - word_at[:-1], size) + np.arange(word_at[-1])]
        bounds = np.concatenate([[0], np.cumsum(counts + 1)])
        return Said(hashes, which, bounds, ids, word_at[:-1], word_at[bounds])

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(windows of WINDOW ids and the one after, how many a text has, where each text's first output is)."""
        n = np.diff(self.texts)
        count = -(-n // STRIDE)
        base = np.concatenate([[0], np.cumsum(CONTEXT + 1 + STRIDE * count)])
        line = np.full(base[-1], AFTER, np.uint16)
        line[(base[:-1, None] + np.arange(CONTEXT + 1)).reshape(-1)] = BEFORE
        line[np.arange(len(self.ids)) + np.repeat(base[:-1] + CONTEXT + 1 - self.texts[:-1], n)] = self.ids
        outputs = np.concatenate([[0], np.cumsum(count)])
        start = np.repeat(base[:-1] - STRIDE * outputs[:-1], count) + STRIDE * np.arange(outputs[-1])
        return np.lib.stride_tricks.sliding_window_view(line, WINDOW + 1)[start] if len(start) else np.empty((0, WINDOW + 1), np.uint16), count, outputs[:-1] * STRIDE


def gathered(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(kind, a, n, ids) of docs (text): for each block, its words a and their counts n (kind 0); for each task, its
    ids a and their counts n (kind 1); and all windows (kind 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = subwords(path, pattern), np.zeros(CODES, np.int64)

        def rows(kind: int, a: np.ndarray, n: np.ndarray, ids: list[bytes] | None = None) -> pa.RecordBatch:
            made = [pa.array(np.full(len(a), kind, np.int8)), pa.array(a.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(ids or [None] * len(a), pa.binary())]
            return pa.RecordBatch.from_arrays(made, ["kind", "a", "n", "ids"])

        for batch in batches:
            for lo, hi, data, at in blocks(batch.column(0), BLOCK):
                said = Said.of(data, at, known)
                inner = said.which[said.which >= 0]
                yield rows(0, said.hashes.view(np.int64), np.bincount(inner, minlength=len(said.hashes)))
                seen += np.bincount(said.ids, minlength=CODES)
                windows, _, _ = said.windows()
                for lo in range(0, len(windows), SOME):
                    part = windows[lo : lo + SOME]
                    yield rows(2, np.zeros(len(part)), np.ones(len(part)), [w.tobytes() for w in part])
        used = np.flatnonzero(seen)
        yield rows(1, used, seen[used])

    return docs.mapInArrow(run, "kind tinyint, a bigint, n bigint, ids binary")


@dataclass
class Codes:
    """What an id (or code) is as an input and as an output, and the share it has of its output's class."""

    slot: np.ndarray
    kind: np.ndarray
    share: np.ndarray
    shares: np.ndarray

    @staticmethod
    def of(seen: np.ndarray) -> Codes:
        """Ids by count. Every id has one more than its count."""
        possible = np.arange(CODES) <= END
        order = np.lexsort((np.arange(CODES), -np.where(possible, seen, -1)))
        rank = np.empty(CODES, np.int64)
        rank[order] = np.arange(CODES)
        slot = np.minimum(rank, INPUTS - 2)
        slot[[BEFORE, AFTER]] = INPUTS - 1
        kind = np.minimum(rank, HEAD)
        kind[[BEFORE, AFTER]] = -1
        more = np.where(possible, seen + 1.0, 0.0)
        rest = more[kind == HEAD].sum()
        share = np.zeros(CODES, np.float32)
        share[kind == HEAD] = np.log(more[kind == HEAD] / rest)
        shares = np.bincount(kind[possible], more[possible], HEAD + 1)
        return Codes(slot.astype(np.int32), kind.astype(np.int32), share, shares / shares.sum())


def dealt(windows: DataFrame, shards: int) -> DataFrame:
    """(ids, shard, turn): every window in one shard of one round."""
    at = windows.select("ids", F.monotonically_increasing_id().alias("at"))
    return at.select("ids", F.pmod("at", F.lit(shards)).alias("shard"), F.pmod(F.floor(F.col("at") / shards), F.lit(ROUNDS)).alias("turn"))


def fitted(windows: DataFrame, codes: Codes) -> np.ndarray:
    """Weights from windows (ids), by rounds of shards and their means. Only means come to the driver."""
    spark = windows.sparkSession
    shape = Shape(INPUTS, HEAD)
    flat = np.concatenate([shape.start(codes.shares), np.full(shape.length(), START, np.float32)])
    shards = max(1, -(-windows.count() // (SHARD * ROUNDS)))
    rows = dealt(windows, shards)

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values("shard")
        weight = rows["n"].to_numpy(np.float64)
        both = np.average(np.stack([np.frombuffer(w, np.float32) for w in rows["weights"]]), axis=0, weights=weight)
        return pd.DataFrame({"shard": [rows["shard"].iloc[0] // MERGED], "n": [int(weight.sum())], "weights": [both.astype(np.float32).tobytes()]})

    def learning(sent: Broadcast) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def learnt(group: pd.DataFrame) -> pd.DataFrame:
            flat, codes = sent.value
            both = flat.copy()
            ids = np.stack([np.frombuffer(b, np.uint16) for b in sorted(group["ids"])])
            passes = min(MOST_PASSES, max(1, PASSED // len(ids)))
            half, targets = len(both) // 2, codes.kind[ids[:, 1:]]
            targets[:, :CONTEXT] = -1  # the window before has them
            steps(both[:half], both[half:], shape, codes.slot[ids[:, :-1]], targets, passes)
            return pd.DataFrame({"shard": group["shard"].iloc[:1], "n": [len(ids)], "weights": [both.tobytes()]})

        return learnt

    for turn in range(ROUNDS):
        schema, n = "shard bigint, n bigint, weights binary", shards
        out = rows.where(F.col("turn") == turn).drop("turn").groupBy("shard").applyInPandas(learning(spark.sparkContext.broadcast((flat, codes))), schema)
        while n > MERGED:
            out = out.withColumn("over", F.expr(f"shard div {MERGED}")).groupBy("over").applyInPandas(lambda g: merged(g.drop(columns="over")), schema)
            n = -(-n // MERGED)
        out = keep(out, "means")  # a round's shuffle goes when it's written
        means = out.toPandas()
        let_go(out)
        if len(means):
            flat = np.frombuffer(merged(means)["weights"].iloc[0], np.float32).copy()
    return flat[: shape.length()]


@dataclass
class Learnt:
    weights: np.ndarray
    codes: Codes
    common: np.ndarray  # words of large counts, sorted, and their counts
    counts: np.ndarray
    ends: int  # documents learnt from
    tokens: int
    distinct: int


def learn(docs: DataFrame, path: str, pattern: str) -> tuple[Learnt, DataFrame]:
    """What is learnt from docs (text), and the counts (word, n) of all words."""
    found = keep(gathered(docs, path, pattern), "gathered")
    counts = keep(found.where("kind = 0").groupBy(F.col("a").alias("word")).agg(F.sum("n").alias("n")), "words")
    seen = np.zeros(CODES, np.int64)
    for a, n in found.where("kind = 1").groupBy("a").agg(F.sum("n")).collect():  # the vocabulary's size at most
        seen[a] = n
    ends = int(seen[END])
    distinct, tokens = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # the smallest count from which there are no more than COMMON words, in steps of an eighth of a doubling
    step = F.floor(8 * F.log2("n"))
    by = sorted(((s, n) for s, n in counts.groupBy(step.alias("s")).count().collect()), reverse=True)
    least, total = None, 0
    for s, n in by:
        total += n
        if total > COMMON:
            break
        least = s
    common = counts.where(step >= least).toArrow() if least is not None else counts.limit(0).toArrow()
    names = common.column("word").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(names)
    codes = Codes.of(seen)
    weights = fitted(found.where("kind = 2").select("ids"), codes)
    learnt = Learnt(weights, codes, names[order], common.column("n").to_numpy()[order], ends, int(tokens) + ends, int(distinct) + (ends > 0))
    return learnt, counts


def _log10_mixed(base: np.ndarray, model: np.ndarray) -> np.ndarray:
    return np.log10(SHARE_OF_COUNTS * base + (1 - SHARE_OF_COUNTS) * 10.0**model)


def scored(docs: DataFrame, learnt: Learnt, path: str, pattern: str) -> DataFrame:
    """(key, held_out, n_tokens, n_known, base_score, score, rare) of docs (key, held_out, text): sums over the words in `common`
    and the end, and the others as (word, log10 probability by the model)."""
    kind = docs.schema["key"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(learnt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learnt, known = sent.value, subwords(path, pattern)
        codes, scorer = learnt.codes, Scorer(learnt.weights, Shape(INPUTS, HEAD))
        size = learnt.tokens + learnt.distinct + 1
        for batch in batches:
            for lo, hi, data, at in blocks(batch.column(2), BLOCK):
                said = Said.of(data, at, known)
                windows, count, first = said.windows()
                told = scorer(codes.slot[windows[:, :-1]], np.maximum(codes.kind[windows[:, CONTEXT + 1 :]], 0)).reshape(-1)
                n = np.diff(said.texts)
                told = told[np.arange(len(said.ids)) + np.repeat(first - said.texts[:-1], n)].astype(np.float64) + codes.share[said.ids]
                model = np.add.reduceat(told, said.at) / np.log(10)
                place = np.minimum(np.searchsorted(learnt.common, said.hashes), max(0, len(learnt.common) - 1))
                sure = learnt.common[place] == said.hashes if len(learnt.common) else np.zeros(len(said.hashes), bool)
                held = np.append(np.where(sure, learnt.counts[place] if len(learnt.common) else 0, 0), learnt.ends)
                there = np.append(sure, True)[said.which]
                c = held[said.which]
                share = (c + 1) / size
                zero = lambda x: np.add.reduceat(np.where(there, x, 0), said.words[:-1])
                rare = np.flatnonzero(~there)
                ends = np.concatenate([[0], np.cumsum(np.add.reduceat((~there).astype(np.int32), said.words[:-1]))]).astype(np.int32)
                pairs = pa.StructArray.from_arrays([pa.array(said.hashes[said.which[rare]].view(np.int64)), pa.array(model[rare])], ["word", "model"])
                columns = [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(np.diff(said.words)), pa.array(zero(c > 0).astype(np.int64)), pa.array(zero(np.log10(share))), pa.array(zero(_log10_mixed(share, model))), pa.ListArray.from_arrays(pa.array(ends), pairs)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"])

    return docs.mapInArrow(run, f"key {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double, rare array<struct<word:bigint,model:double>>")


def fold(key: str) -> Column:
    """True where crc32 of the key as text, modulo FOLDS, is HELD_OUT; false for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def score(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs, over its whole text.

    path, pattern: a byte-level vocabulary in tiktoken's form, present on every executor, and how it cuts words. base_score:
    sum over tokens (words and the end) of log10((c + 1) / (N + V + 1)); score: the model's log10 probability of the text, see
    the module. A null text is an empty one: its only token is the end. Rows with a null key are learnt from. Rows are
    scored each by itself: repeated ones alike. Other columns are left out, whatever their names. An empty table
    gives an empty one. Words of any length are read whole; beyond PIECE letters they are spelt in pieces."""
    importable(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), fold(key).alias("held_out"), F.col(text).cast("string").alias("text"))
    learnt, counts = learn(rows.where(~F.col("held_out")).select("text"), path, pattern)
    done = keep(scored(rows, learnt, path, pattern).withColumn("row", F.monotonically_increasing_id()), "scored")
    size = F.lit(float(learnt.tokens + learnt.distinct + 1))
    rare = done.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.model")
    met = rare.join(counts, "word", "left").select("row", F.coalesce("n", F.lit(0)).alias("c"), "model")
    share = (F.col("c") + 1) / size
    mixed = F.log10(SHARE_OF_COUNTS * share + (1 - SHARE_OF_COUNTS) * F.pow(F.lit(10.0), F.col("model")))
    sums = met.groupBy(F.col("row").alias("of")).agg(F.sum((F.col("c") > 0).cast("long")).alias("known"), F.sum(F.log10(share)).alias("base"), F.sum(mixed).alias("more"))
    out = done.drop("rare").join(sums, F.col("row") == F.col("of"), "left")
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return out.select(F.col("key").alias(key), "held_out", "n_tokens", plus("n_known", "known").alias("n_known"), F.lit(learnt.tokens).cast("long").alias("train_tokens"), plus("base_score", "base").alias("base_score"), F.round(plus("score", "more"), 6).alias("score"))
