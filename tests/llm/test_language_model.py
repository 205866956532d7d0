"""The model against loops, its slopes against differences, counts and scores against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from ferrule.llm import attention, language_model, queries, words

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")), None]


def small(inputs=20, head=6):
    shape = attention.Shape(inputs, head, 4, 5)
    flat = shape.start(np.full(head + 1, 1 / (head + 1)))
    flat += np.random.default_rng(2).normal(0, 0.2, len(flat)).astype(np.float32)
    return shape, flat


def by_loops(flat, shape, x):
    """Log-probabilities of all classes after each place of one window."""
    e, qkv, bias, wo, w1, b1, w2, u, c = (p.astype(np.float64) for p in shape.cut(flat))
    d, out = shape.size, []
    proj = [e[i] @ qkv for i in x]
    for t in range(len(x)):
        weights = [math.exp(proj[t][:d] @ proj[s][d : 2 * d] / math.sqrt(d) + bias[t - s]) for s in range(t + 1)]
        seen = sum(w * proj[s][2 * d :] for s, w in enumerate(weights)) / sum(weights)
        h = e[x[t]] + seen @ wo
        h = h + np.maximum(h @ w1 + b1, 0) @ w2
        logits = h @ u + c
        out.append(logits - math.log(sum(map(math.exp, logits))))
    return np.array(out)


def test_scorer_is_the_model(monkeypatch):
    shape, flat = small()
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 20, (3, attention.WINDOW)), rng.integers(0, 7, (3, attention.STRIDE))
    got = attention.Scorer(flat, shape)(x, y)
    for k in range(3):
        want = by_loops(flat, shape, x[k])[attention.CONTEXT :]
        assert np.exp(want).sum(1) == pytest.approx(1)
        assert got[k] == pytest.approx(want[np.arange(attention.STRIDE), y[k]], abs=1e-4)


def test_what_comes_later_changes_nothing():
    shape, flat = small()
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 20, (1, attention.WINDOW)), rng.integers(0, 7, (1, attention.STRIDE))
    other = x.copy()
    other[:, 40:] = 3
    scorer, cut = attention.Scorer(flat, shape), 40 - attention.CONTEXT
    assert (scorer(x, y)[:, :cut] == scorer(other, y)[:, :cut]).all() and (scorer(x, y) != scorer(other, y)).any()


def test_slopes(monkeypatch):
    """A step from a fresh state shows the gradient: the state is its square. Held against differences of the loop's loss."""
    shape, flat = small()
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 20, (2, attention.WINDOW)), rng.integers(0, 7, (2, attention.WINDOW))
    y[0, :10] = -1
    state, moved = np.zeros_like(flat), flat.copy()
    with np.errstate(divide="ignore", invalid="ignore"):
        attention.steps(moved, state, shape, x, y, 1)

    def loss(v):
        return -np.mean([by_loops(v, shape, x[k])[t, y[k, t]] for k in range(2) for t in range(attention.WINDOW) if y[k, t] >= 0])

    for at in rng.choice(len(flat), 40, replace=False):
        plus, minus = flat.astype(np.float64), flat.astype(np.float64)
        plus[at] += 1e-4
        minus[at] -= 1e-4
        slope = (loss(plus) - loss(minus)) / 2e-4
        assert math.sqrt(state[at]) == pytest.approx(abs(slope), abs=2e-4)
        if abs(slope) > 1e-3:
            assert (moved[at] < flat[at]) == (slope > 0)


def test_texts_as_ids_and_windows():
    rng = random.Random(1)
    texts = ["", "Hello  WORLD", " \n", "naïve 中文 x" * 40, "z" * 300 + " end", *(" ".join(rng.choice(["ab", "the", "Été", "qzx"]) for _ in range(n)) for n in (1, 30, 31, 32, 33, 200))]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.cumsum([0, *(len(t.encode()) for t in texts)])
    known = language_model.Subwords(PATH, PATTERN)
    said = language_model.Said.of(data, at, known)
    windows, count, first = said.windows()
    row = 0
    for k, text in enumerate(texts):
        ids = said.ids[said.texts[k] : said.texts[k + 1]].tolist()
        assert ids[-1] == language_model.END
        lower = [w for w in tokens(text) if w is not None]
        assert known.encoding.decode(ids[:-1]) == "".join(" " + w for w in lower)
        line = [language_model.BEFORE] * (attention.CONTEXT + 1) + ids
        scored = []
        for w in windows[row : row + count[k]]:
            n = min(attention.STRIDE, len(ids) - len(scored))
            assert w[: attention.CONTEXT + 1 + n].tolist() == line[len(scored) : len(scored) + attention.CONTEXT + 1 + n]
            assert (w[attention.CONTEXT + 1 + n :] == language_model.AFTER).all()
            scored += w[attention.CONTEXT + 1 :][:n].tolist()
        assert scored == ids and first[k] == row * attention.STRIDE
        row += count[k]


def test_shares_of_ids_sum_to_one():
    seen = np.zeros(language_model.CODES, np.int64)
    seen[np.random.default_rng(1).integers(0, 50_000, 3000)] += 5
    codes = language_model.Codes.of(seen)
    assert codes.shares.sum() == pytest.approx(1)
    assert np.exp(codes.share[codes.kind == language_model.HEAD].astype(np.float64)).sum() == pytest.approx(1, abs=1e-4)
    assert np.bincount(codes.kind[codes.kind >= 0])[: language_model.HEAD].max() == 1


def corpus(seed, n=150):
    rng = random.Random(seed)
    letters = ["ka", "lo", "Mi", "zu", "été", "th"]
    vocabulary = ["".join(rng.choices(letters, k=rng.randint(1, 4))) for _ in range(200)]
    text = lambda size: " ".join(vocabulary[min(199, int(rng.paretovariate(0.7)))] for _ in range(size))
    rows = [(k, text(rng.choice([1, 4, 60, 200]))) for k in range(n)]
    return [*rows, (n, None), (n + 1, ""), (n + 2, "\n \x0b"), (None, "ka lo"), (None, None), (n + 3, rows[8][1]), rows[8], (n + 4, "word " * 20_000), (n + 5, "q" * 100_000), (n + 6, "naïve x A\x00b")]


@pytest.mark.parametrize("common", [1 << 20, 8])
def test_scores(spark, monkeypatch, common):
    """Base scores against brute force; scores are the mixture of its words; also with most words met in the join."""
    monkeypatch.setattr(language_model, "COMMON", common)
    rows = corpus(1)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, row int, score string").repartition(3)
    out = language_model.score(df, PATH, PATTERN)
    assert out.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 7 == 2
    counts = Counter(t for k, x in rows if not held(k) for t in tokens(x))
    total, distinct = sum(counts.values()), len(counts)
    want = sorted(((k, held(k), len(tokens(x)), sum(counts[t] > 0 for t in tokens(x)), total) for k, x in rows), key=str)
    got = out.collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == want
    base = {x: sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in tokens(x)) for _, x in rows}
    by_key = {k: x for k, x in rows if k is not None}
    scores = {}
    for r in got:
        if r.doc_id is not None:
            assert r.base_score == pytest.approx(base[by_key[r.doc_id]], rel=1e-9)
            assert base[by_key[r.doc_id]] + math.log10(language_model.SHARE_OF_COUNTS) * r.n_tokens - 0.01 < r.score < 0
            scores.setdefault(by_key[r.doc_id], set()).add(r.score)
    assert all(len(s) == 1 for s in scores.values())


def test_a_score_by_loops(spark):
    """The sum over words of one text, each id by the loop model."""
    rows = corpus(2, 60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    learnt, counts = language_model.learn(df.select("text"), PATH, PATTERN)
    text = next(x for _, x in rows if x and 50 < len(tokens(x)) < 100)
    got = language_model.scored(df.selectExpr("doc_id AS key", "true AS held_out", "text").where(df.text == text).limit(1), learnt, PATH, PATTERN).first()
    data = np.frombuffer(text.encode(), np.uint8)
    said = language_model.Said.of(data, np.array([0, len(data)]), language_model.Subwords(PATH, PATTERN))
    windows, _, _ = said.windows()
    shape, logs = attention.Shape(language_model.INPUTS, language_model.HEAD), []
    for w in windows:
        told = by_loops(learnt.weights, shape, learnt.codes.slot[w[:-1]])[attention.CONTEXT :]
        for place, i in enumerate(w[attention.CONTEXT + 1 :]):
            if i != language_model.AFTER:
                logs.append(told[place, learnt.codes.kind[i]] + learnt.codes.share[i])
    assert len(logs) == len(said.ids)
    seen = {r.word: r.n for r in counts.collect()}
    size, want = learnt.tokens + learnt.distinct + 1, 0.0
    bounds = [*said.at, len(said.ids)]
    for k, which in enumerate(said.which):
        c = learnt.ends if which < 0 else seen[int(said.hashes[which].view(np.int64))]
        share = language_model.SHARE_OF_COUNTS
        want += math.log10(share * (c + 1) / size + (1 - share) * math.exp(sum(logs[bounds[k] : bounds[k + 1]])))
    assert not got.rare and got.score == pytest.approx(want, abs=0.01)


def test_nothing_to_learn_from(spark):
    shape = "doc_id long, text string"
    assert language_model.score(spark.createDataFrame([], shape), PATH, PATTERN).collect() == []
    key = next(k for k in range(99) if zlib.crc32(str(k).encode()) % 7 == 2)
    row = language_model.score(spark.createDataFrame([(key, "a b")], shape), PATH, PATTERN).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (True, 3, 0, 0, 0.0) and row.score < 0


def test_held_out_texts_are_likelier_than_by_counts(spark):
    rows = [r for r in queries.op13_lm_scoring(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert sum(r.score > r.base_score for r in rows) > 0.7 * len(rows)


def test_hashes_tell_words_apart():
    data = np.frombuffer(b"ab AB ba", np.uint8)
    h = words.hashes(data, *words.spans(data))
    assert h[0] == h[1] != h[2]


def test_all_windows_are_learnt_from(spark):
    texts = [f"{'Some words ' * (k % 90)} end{k}" for k in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    known = language_model.Subwords(PATH, PATTERN)
    want = sum(-(-(1 + sum(len(known.spelt(w.encode())) for w in tokens(t) if w)) // attention.STRIDE) for t in texts)
    windows = language_model.gathered(df, PATH, PATTERN).where("kind = 2").select("ids")
    rows = language_model.dealt(windows, 5).collect()
    assert len(rows) == want and {r.turn for r in rows} == set(range(language_model.ROUNDS)) and {r.shard for r in rows} == set(range(5))


def test_places_before_the_first_target_are_only_read():
    """The slopes are those of all places, with nothing said about the first ones."""
    shape, flat = small()
    rng = np.random.default_rng(6)
    x, y = rng.integers(0, 20, (2, attention.WINDOW)), rng.integers(0, 7, (2, attention.WINDOW))
    y[:, : attention.CONTEXT] = -1
    state, moved = np.zeros_like(flat), flat.copy()
    with np.errstate(divide="ignore", invalid="ignore"):
        attention.steps(moved, state, shape, x, y, 1)

    def loss(v):
        return -np.mean([by_loops(v, shape, x[k])[t, y[k, t]] for k in range(2) for t in range(attention.CONTEXT, attention.WINDOW)])

    for at in [*rng.choice(len(flat), 20, replace=False), 90, 100, 130]:
        plus, minus = flat.astype(np.float64), flat.astype(np.float64)
        plus[at] += 1e-4
        minus[at] -= 1e-4
        assert math.sqrt(state[at]) == pytest.approx(abs(loss(plus) - loss(minus)) / 2e-4, abs=2e-4)


def test_a_window_scores_alike_at_every_place():
    shape = attention.Shape(4096, 159)
    rng = np.random.default_rng(0)
    flat = shape.start(np.full(160, 1 / 160))
    scorer = attention.Scorer(flat + rng.normal(0, 0.3, len(flat)).astype(np.float32), shape)
    x, y = rng.integers(0, 4096, (1, attention.WINDOW)), rng.integers(0, 160, (1, attention.STRIDE))
    out = scorer(np.repeat(x, 100, 0), np.repeat(y, 100, 0))
    assert (out == out[:1]).all()
