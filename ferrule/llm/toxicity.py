"""Toxicity by a convolutional classifier over hashed words, trained in numpy.

A text's words, A-Z folded and without punctuation at their ends, are embedded by hashing: a word's vector
is the sum of three of `BUCKETS` rows, by the whole word and by its first `STEMS` bytes, so that unseen
forms of a stem are known by it. Filters of each of `WIDTHS` words run over the whole text, are rectified and pooled by their
maximum, and a logistic layer reads the maxima: score. It sees words and nothing else.

All labelled documents are learnt from; a fifth of them, by a hash of the key, choose the number of rounds and the thresholds.
The others are dealt to shards of about `SHARD` words. In a round each shard is a task that goes on from the same weights, and
their mean, taken `MERGED` at a time, starts the next round. Rows met in fewer than `LEAST_DOCUMENTS` documents are zero. The scores are shifted so
that 0.5 is the best threshold for all languages together. `thresholds` then has the best one for each
language, for the additional column `flagged`; a language seen in fewer than `LEAST_LANGUAGE` of them
with a label of 1 keeps 0.5. The language is no input of a score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.llm import words
from ferrule.llm.shared import importable, keep, let_go

BUCKETS, WIDTHS, FILTERS, SIZE = 1 << 15, (1, 2, 3), 8, 8
STEMS = (4, 6)
LEAST_DOCUMENTS, LEAST_LANGUAGE, SHARD, MERGED, DIGITS = 3, 20, 1 << 21, 8, 5
PASSES, PATIENCE, STEPS, BATCH, RATE, SEED = 10, 4, 500, 64, 0.1, 7
#: Bytes of text scored in one go; a longer text is a block of its own.
BLOCK = 1 << 20

_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def buckets(data: np.ndarray) -> np.ndarray:
    """The words of one text, each as three rows of the embedding, 1 to BUCKETS - 1; row 0 is padding."""
    starts, ends = words.spans(data)
    for _ in range(4):
        ends = ends - (_PUNCTUATION[data[ends - 1]] & (ends - starts > 1))
        starts = starts + (_PUNCTUATION[data[starts]] & (ends - starts > 1))
    cuts = [ends, *(np.minimum(ends, starts + n) for n in STEMS)]
    salts = [words.mixed(np.array([k], np.uint64)) for k in range(len(cuts))]
    rows = [(words.hashes(data, starts, e) ^ salt) % np.uint64(BUCKETS - 1) for e, salt in zip(cuts, salts, strict=True)]
    return np.stack(rows, 1).astype(np.int32) + 1


def padded(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in a row, each with as much padding after it as the widest filter, and where each starts."""
    pad = np.zeros((max(WIDTHS), 1 + len(STEMS)), np.int32)
    starts = np.cumsum([0, *(len(t) + len(pad) for t in texts[:-1])])
    return np.concatenate([x for t in texts for x in (t, pad)]), np.asarray(starts, np.int64)


@dataclass
class Model:
    embedding: np.ndarray
    filters: list[np.ndarray]  # for each width: width x SIZE x FILTERS
    biases: list[np.ndarray]
    weights: np.ndarray
    bias: float = 0.0
    thresholds: dict[str | None, float] = field(default_factory=dict)

    def vectors(self, ids: np.ndarray) -> np.ndarray:
        x = self.embedding[ids[:, 0]]
        for k in range(1, ids.shape[1]):
            x += self.embedding[ids[:, k]]
        return x

    def convolved(self, x: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
        """The filters of the k-th width at each place; nothing where they would reach into the next text."""
        z = x @ self.filters[k][0]
        for j in range(1, WIDTHS[k]):
            z[:-j] += x[j:] @ self.filters[k][j]
        for j in range(1, max(WIDTHS)):
            z[ends - j] = -np.inf
        return z

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """Scores of texts (as buckets)."""
        if not texts:
            return np.empty(0)
        ids, starts = padded(texts)
        x, ends = self.vectors(ids), np.append(starts[1:], len(ids))
        logits = np.full(len(texts), self.bias)
        for k in range(len(WIDTHS)):
            pooled = np.maximum(np.maximum.reduceat(self.convolved(x, ends, k), starts) + self.biases[k], 0)
            logits += pooled @ self.weights[k * FILTERS : (k + 1) * FILTERS]
        return 1 / (1 + np.exp(-logits))


def _cut(flat: np.ndarray) -> list[np.ndarray]:
    """The parameters as views of one vector: the embedding, filters, their biases, weights, and the bias."""
    shapes = [(BUCKETS, SIZE), *((w, SIZE, FILTERS) for w in WIDTHS), *((FILTERS,) for _ in WIDTHS), (len(WIDTHS) * FILTERS,), (1,)]
    ends = np.cumsum([int(np.prod(s)) for s in shapes])
    return [part.reshape(s) for part, s in zip(np.split(flat[: ends[-1]], ends[:-1]), shapes, strict=True)]


def _model(flat: np.ndarray) -> Model:
    embedding, *rest = _cut(flat)
    k = len(WIDTHS)
    return Model(embedding, rest[:k], rest[k : 2 * k], rest[2 * k], float(rest[-1][0]))


def _start(known: np.ndarray, share: float) -> np.ndarray:
    """Small random weights, zero for rows that aren't known; the bias says the share of label 1."""
    rng = np.random.default_rng(SEED)
    normal = lambda *shape, sd=0.3: rng.normal(0, sd, shape).astype(np.float32)
    parts = [normal(BUCKETS, SIZE, sd=0.03) * known[:, None], *(normal(w, SIZE, FILTERS) for w in WIDTHS), *(np.zeros(FILTERS, np.float32) for _ in WIDTHS), normal(len(WIDTHS) * FILTERS)]
    return np.concatenate([*(p.reshape(-1) for p in parts), np.array([np.log(share / (1 - share))], np.float32)])


def steps(flat: np.ndarray, state: np.ndarray, texts: list[np.ndarray], labels: np.ndarray, known: np.ndarray, passes: int, rng: np.random.Generator) -> None:
    """Passes of Adagrad over texts (as buckets), in place."""
    model, order = _model(flat), np.arange(len(texts))
    states, bias, k_widths = _cut(state), _cut(flat)[-1], len(WIDTHS)

    def step(p: np.ndarray, s: np.ndarray, g: np.ndarray) -> None:
        s += g * g
        p -= RATE * g / np.sqrt(s)

    for _ in range(passes):
        rng.shuffle(order)
        for at in range(0, len(order), BATCH):
            picked = order[at : at + BATCH]
            ids, starts = padded([texts[i] for i in picked])
            ends = np.append(starts[1:], len(ids))
            x = model.vectors(ids)
            pooled, where = [], []
            for k in range(k_widths):
                z = model.convolved(x, ends, k)
                first = np.stack([s + z[s:e].argmax(0) for s, e in zip(starts, ends, strict=True)])
                where.append(first)
                pooled.append(np.maximum(np.take_along_axis(z, first, 0) + model.biases[k], 0))
            hidden = np.concatenate(pooled, 1)
            p = 1 / (1 + np.exp(-(hidden @ model.weights + bias)))
            slope = ((p - labels[picked]) / len(picked)).astype(np.float32)
            back = slope[:, None] * model.weights * (hidden > 0)
            rows, grads = [], []
            for k, width in enumerate(WIDTHS):
                g = back[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(width):
                    place = np.minimum(where[k] + j, len(ids) - 1)
                    part = x[place]  # documents x FILTERS x SIZE
                    rows.append(ids[place].reshape(-1, ids.shape[1]))
                    grads.append((g[:, :, None] * model.filters[k][j].T[None]).reshape(-1, SIZE))
                    step(model.filters[k][j], states[1 + k][j], np.einsum("df,dfs->sf", g, part))
                step(model.biases[k], states[1 + k_widths + k], g.sum(0))
            step(model.weights, states[-2], hidden.T @ slope)
            step(bias, states[-1], slope.sum(keepdims=True))
            rows, grads = np.concatenate(rows), np.concatenate(grads)
            touched, inverse = np.unique(rows, return_inverse=True)
            sums = np.zeros((len(touched), SIZE), np.float32)
            for k in range(rows.shape[1]):
                np.add.at(sums, inverse.reshape(rows.shape)[:, k], grads)
            sums *= known[touched][:, None]
            states[0][touched] += sums * sums
            model.embedding[touched] -= RATE * sums / np.sqrt(states[0][touched])


def best_threshold(scores: np.ndarray, right: np.ndarray, n: np.ndarray) -> float:
    """The middle of the cut with the best F1 score, of different scores with n rows each, `right` of them with label 1;
    0.5 if one of the labels is missing."""
    if not 0 < right.sum() < n.sum():
        return 0.5
    order = np.argsort(-scores, kind="stable")
    s, found = scores[order], np.cumsum(right[order])
    at = int(np.argmax(2 * found / (np.cumsum(n[order]) + found[-1])))
    return float((s[at] + (s[at + 1] if at + 1 < len(s) else 0.0)) / 2)


def labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, lang: str, label: str) -> DataFrame:
    """(of, order, label, lang, held, n, ids) for every labelled document: its words' rows as bytes, how many words, and whether it is one of the
    fifth that choose. Null labels and keys are left out; of several labels or texts of a key, the greatest and the smallest count."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("of")).agg(F.max(label).cast("int").alias("label"))
    said = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"))
    found = said.join(known, F.col("key") == F.col("of")).groupBy("of", "label").agg(F.min(F.struct("text", "lang")).alias("said"))
    order = F.xxhash64("of", F.lit("sample"))
    rows = found.select("of", order.alias("order"), "label", "said.lang", (F.pmod(F.shiftright(order, 7), F.lit(5)) == 0).alias("held"), "said.text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [buckets(data).astype(np.uint16) for data in words.rows(batch.column(5))]
            columns = [*batch.columns[:5], pa.array([len(m) for m in made], pa.int64()), pa.array([m.tobytes() for m in made], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["of", "order", "label", "lang", "held", "n", "ids"])

    kind = rows.schema["of"].dataType.simpleString()
    return rows.mapInArrow(run, f"of {kind}, order bigint, label int, lang string, held boolean, n bigint, ids binary")


def _texts(ids: Iterable[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(b, np.uint16).reshape(-1, 1 + len(STEMS)).astype(np.int32) for b in ids]


def _seen(texts: list[np.ndarray]) -> np.ndarray:
    """How many of the texts hold each row."""
    seen = np.zeros(BUCKETS, np.int64)
    for t in texts:
        seen[np.unique(t)] += 1
    return seen


def _merged(group: pd.DataFrame) -> pd.DataFrame:
    """The mean of shards' weights and states: a row of the embedding weighs by the documents of a shard that hold it, all else by its documents."""
    rows = group.sort_values("shard")
    n, seen = rows["n"].to_numpy(np.float64), np.stack([np.frombuffer(b, np.int64) for b in rows["seen"]])
    both = np.stack([np.frombuffer(b, np.float32) for b in rows["weights"]])
    share = n / max(1, n.sum())
    by_row = np.where(seen.sum(0) > 0, seen / np.maximum(1, seen.sum(0)), share[:, None])
    half, inner = both.shape[1] // 2, BUCKETS * SIZE
    out = np.empty(both.shape[1], np.float32)
    for lo in (0, half):
        out[lo : lo + inner] = np.einsum("sb,sbk->bk", by_row, both[:, lo : lo + inner].reshape(len(rows), BUCKETS, SIZE)).reshape(-1)
        out[lo + inner : lo + half] = share @ both[:, lo + inner : lo + half]
    return pd.DataFrame({"shard": [rows["shard"].iloc[0] // MERGED], "n": [int(n.sum())], "seen": [seen.sum(0).tobytes()], "weights": [out.tobytes()], "loss": [rows["loss"].sum()], "judged": [rows["judged"].sum()]})


def trained(rows: DataFrame) -> Model:
    """A model of all rows (as `labelled`, kept) that aren't held, by rounds of shards and their means; the round is chosen by the loss of those
    that are. Only the mean of all shards comes to the driver."""
    spark = rows.sparkSession

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            seen += _seen(_texts(batch.column(0).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen)), pa.array(seen[seen > 0])], ["row", "n"])

    known = np.zeros(BUCKETS, bool)
    counts = rows.where("not held").select("ids").mapInArrow(counted, "row bigint, n bigint").groupBy("row").agg(F.sum("n").alias("n"))
    for row, _ in counts.where(F.col("n") >= LEAST_DOCUMENTS).collect():  # BUCKETS at most
        known[row] = True
    known[0] = False
    learnt, right, held, total = rows.agg(F.count_if(~F.col("held")), F.count_if(~F.col("held") & (F.col("label") == 1)), F.count_if("held"), F.coalesce(F.sum("n"), F.lit(0))).first()
    flat = _start(known, float(np.clip(right / max(1, learnt), 1e-3, 1 - 1e-3)))
    if not learnt + held:
        return _model(flat)
    shards = max(1, -(-total // SHARD))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("of", F.lit("shard")), F.lit(shards)))
    passes = -(-max(PASSES, -(-STEPS * BATCH // max(1, learnt))) // PASSES)
    schema = "shard bigint, n bigint, seen binary, weights binary, loss double, judged bigint"

    def learning(sent: Broadcast, turn: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def run(group: pd.DataFrame) -> pd.DataFrame:
            both, known = sent.value
            both, shard = both.copy(), int(group["shard"].iloc[0])
            group = group.sort_values(["order", "of"])
            texts, labels, check = _texts(group["ids"]), group["label"].to_numpy(), group["held"].to_numpy(bool)
            judged = np.flatnonzero(check if held else ~check)
            loss, half = 0.0, len(both) // 2
            for lo in range(0, len(judged), BATCH):
                some = judged[lo : lo + BATCH]
                p = np.clip(_model(both).score([texts[i] for i in some]), 1e-6, 1 - 1e-6)
                loss -= float(np.where(labels[some] == 1, np.log(p), np.log(1 - p)).sum())
            mine = [t for t, c in zip(texts, check, strict=True) if not c]
            if turn < PASSES:
                steps(both[:half], both[half:], mine, labels[~check], known, passes, np.random.default_rng([SEED, turn, shard]))
            return pd.DataFrame({"shard": [shard], "n": [len(mine)], "seen": [_seen(mine).tobytes()], "weights": [both.tobytes()], "loss": [loss], "judged": [len(judged)]})

        return run

    both, best, least, worse = np.concatenate([flat, np.full_like(flat, 1e-4)]), flat, np.inf, 0
    for turn in range(PASSES + 1):  # the last one only judges
        sent, n = spark.sparkContext.broadcast((both, known)), shards
        out = dealt.groupBy("shard").applyInPandas(learning(sent, turn), schema)
        while n > 1:
            out = out.withColumn("over", F.expr(f"shard div {MERGED}")).groupBy("over").applyInPandas(lambda g: _merged(g.drop(columns="over")), schema)
            n = -(-n // MERGED)
        out = keep(out, "means")  # a round's shuffle goes when it's written
        mean = _merged(out.toPandas()).iloc[0]
        let_go(out)
        loss = mean["loss"] / max(1, mean["judged"])
        if turn and loss < least:
            best, least, worse = both[: len(flat)], loss, 0
        elif turn and (worse := worse + 1) >= PATIENCE:
            break
        both = np.frombuffer(mean["weights"], np.float32).copy()
        sent.destroy()
    return _model(best.copy())


def judged(rows: DataFrame, model: Model) -> DataFrame:
    """(lang, score, right, n) of rows (as `labelled`): scores to DIGITS digits, how many have them, and how many of these label 1."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch.column(2).to_pylist())
            scores = np.concatenate([sent.value.score(texts[lo : lo + BATCH]) for lo in range(0, len(texts), BATCH)]) if texts else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(np.round(scores, DIGITS))], ["lang", "label", "score"])

    made = rows.select("lang", "label", "ids").mapInArrow(run, "lang string, label int, score double")
    return made.groupBy("lang", "score").agg(F.count_if(F.col("label") == 1).alias("right"), F.count("*").alias("n"))


def fitted(rows: DataFrame) -> Model:
    """A model of rows (as `labelled`, kept), its scores shifted and its thresholds calibrated on all that are held."""
    model = trained(rows)
    chosen = rows.where("held")
    if chosen.isEmpty():
        chosen = rows
    whole = judged(chosen, model).groupBy("score").agg(F.sum("right").alias("right"), F.sum("n").alias("n")).toPandas()  # 10**DIGITS + 1 rows at most
    cut = min(max(best_threshold(whole["score"].to_numpy(), whole["right"].to_numpy(), whole["n"].to_numpy()), 1e-4), 1 - 1e-4)
    model.bias -= float(np.log(cut / (1 - cut)))

    def by_language(group: pd.DataFrame) -> pd.DataFrame:
        found = best_threshold(group["score"].to_numpy(), group["right"].to_numpy(), group["n"].to_numpy())
        return pd.DataFrame({"lang": group["lang"].iloc[:1], "right": [int(group["right"].sum())], "threshold": [found]})

    found = judged(chosen, model).groupBy("lang").applyInPandas(by_language, "lang string, right bigint, threshold double")
    model.thresholds = {r.lang: r.threshold for r in found.where(F.col("right") >= LEAST_LANGUAGE).collect()}
    return model


def learn(docs: DataFrame, labels: DataFrame, key: str, text: str, lang: str, label: str) -> Model:
    """Fit on all labelled documents."""
    importable(docs.sparkSession)
    rows = keep(labelled(docs, labels, key, text, lang, label), "labelled")
    model = fitted(rows)
    let_go(rows)
    return model


def scored(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, score, predicted, threshold, flagged) for every row of docs, over its whole text.

    predicted: score >= 0.5; threshold: its language's, or 0.5; flagged: score >= threshold. A null or
    empty text has the score of no words. Rows are independent: repeated rows and null keys come back as
    they are, other columns are left out, an empty table gives an empty one. No shuffle; the model
    (1 MB whatever the corpus) goes to the executors once.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            scores, block, size = [], [], 0
            for data in words.rows(batch.column(2)):
                block.append(buckets(data))
                size += len(data)
                if size >= BLOCK:
                    scores.append(model.score(block))
                    block, size = [], 0
            scores = np.concatenate([*scores, model.score(block)]) if scores or block else np.empty(0)
            scores = np.round(scores, 6)  # the last digits depend on which texts are scored together
            cuts = np.array([model.thresholds.get(x or "", 0.5) for x in batch.column(1).to_pylist()])
            made = [pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(cuts), pa.array(scores >= cuts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["key", "score", "predicted", "threshold", "flagged"])

    rows = docs.select(F.col(key).alias("key"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, score double, predicted int, threshold double, flagged boolean").withColumnRenamed("key", key)


def fold(key: str) -> Column:
    """crc32 of the key as text, modulo 5; 1 for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5, F.lit(1))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "toxic") -> DataFrame:
    """`scored` with held_out: rows whose fold is 0 aren't learnt from."""
    model = learn(docs.where(fold(key) != 0), labels.where(fold(key) != 0), key, text, lang, label)
    out = scored(docs, model, key, text, lang).withColumn("held_out", fold(key) == 0)
    return out.select(key, "held_out", "score", "predicted", "threshold", "flagged")
