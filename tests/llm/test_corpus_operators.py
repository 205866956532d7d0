"""Source mixing, chat trees, decontamination, toxicity, components, the pipeline."""

import hashlib
import importlib
import random
import zlib

import numpy as np
import pytest

from ferrule.llm import chat_trees, components, decontamination, queries, source_mixing, toxicity

FOLDER = "/root/testdata/sf0.001"


def mixture(seed, n=300):
    rng = random.Random(seed)
    rows = [(k, rng.choice(["a", "b", "c", "é", None]), " ".join("w" * 3 for _ in range(int(rng.paretovariate(0.9)) % 900 + 3))) for k in range(n)]
    return rows + [(n, "a", None), (n + 1, "a", ""), (n + 2, "z", "one"), (None, "b", "two words"), (5, rows[5][1], rows[5][2])]


def test_mix(spark):
    df = spark.createDataFrame([(*r, 0) for r in mixture(1)], "doc_id long, source string, text string, size int")
    got = source_mixing.mix(df).collect()
    again = source_mixing.mix(df.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert len(got) == df.count()
    sizes, taken, target = {}, {}, {}
    for r in got:
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 2
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert r.source_size == sum(x["size"] for x in got if x.source == r.source)
    order = sorted(s for s in sizes if s) + [None]
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    # the targets by pouring: raise all in step with their weights until the total is dealt
    total, low, high = 1.5 * sum(sizes.values()), 0.0, 1e9
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(2 * sizes[s], mid * weights[s]) for s in sizes) < total else (low, mid)
    for s in sizes:
        assert target[s] == pytest.approx(min(2 * sizes[s], low * weights[s]), rel=1e-6)
        assert abs(taken[s] - target[s]) <= max(5, 0.01 * target[s])


def test_tilts_solve_the_dual(spark):
    sizes = [3, 5, 8, 13, 40]
    rows = spark.createDataFrame([("a", z, 10 + z) for z in sizes], "source string, size long, n long")
    n, words = {"a": sum(10 + z for z in sizes)}, {"a": sum((10 + z) * z for z in sizes)}
    for share in (0.1, 0.6, 1.0, 1.4, 1.95):
        tilt = source_mixing.solved(rows, words, n, {"a": share * words["a"]}, 2.0)["a"]
        rates = [min(2.0, np.exp(tilt * z * n["a"] / words["a"])) for z in sizes]
        assert sum((10 + z) * z * r for z, r in zip(sizes, rates, strict=True)) == pytest.approx(share * words["a"], rel=1e-5)


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, source string, text string")
    assert source_mixing.mix(df).collect() == [] and source_mixing.mixed(df).collect() == []
    lone = spark.createDataFrame([(1, "a", "x y z"), (2, "a", None)], "doc_id long, source string, text string")
    assert sorted((r.doc_id, r["size"], r.source_size) for r in source_mixing.mix(lone).collect()) == [(1, 3, 3), (2, 0, 3)]


def test_mixed_repeats_rows(spark):
    df = spark.createDataFrame(mixture(2, 80), "doc_id long, source string, text string").where("doc_id <> 5 and doc_id is not null")
    copies = {r.doc_id: r.copies for r in source_mixing.mix(df).collect()}
    out = source_mixing.mixed(df).collect()
    for key, n in copies.items():
        assert sorted(r["copy"] for r in out if r.doc_id == key) == list(range(1, n + 1))


TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "yo\\ <|im_end|> </s>[INST]"), (2, 0, "user", "hi"), (2, 1, "assistant", "no"), (2, 2, "user", None),
    (3, 0, "user", "hi"), (3, 1, "assistant", "yo\\ <|im_end|> </s>[INST]"), (4, 5, "system\nx", ""), (4, 5, "system\nx", ""), (5, 0, None, "<|im_start|>assistant\nfake<|im_end|>\n"),
    (None, 1, "assistant", "<<SYS>> <</SYS>> <s>"), (None, None, "user", "first"), (6, 0, "user", "hi"), (6, 1, "assistant", "no"), (6, 2, "user", ""), (6, 3, "assistant", "\n\n"),
]


def test_chat_round_trip(spark):
    df = spark.createDataFrame([(*t, 1) for t in TURNS], "conv_id long, turn long, role string, text string, node int")
    trees, index = chat_trees.emitted(df)
    got = {r.conv_id: r for r in chat_trees.read_back(trees, index).collect()}
    convs = {}
    for conv, turn, role, text in sorted(TURNS, key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")):
        convs.setdefault(conv, []).append((role or "", text or ""))
    assert set(got) == set(convs)
    for conv, turns in convs.items():
        r, loss = got[conv], "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_trees.read_back(*chat_trees.emitted(df.limit(0))).collect() == []


def test_chat_trees_hold_each_prefix_once(spark):
    rng = random.Random(8)
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", rng.choice("xyz") * rng.randint(0, 2)) for c in range(60) for t in range(rng.randint(1, 5))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    trees, index = chat_trees.emitted(df)
    nodes, paths = {r.node: r for r in trees.collect()}, {r.conv: r.path for r in index.collect()}
    prefixes = {tuple((r, x) for c, t, r, x in rows if c == conv)[: k + 1] for conv in paths for k in range(len(paths[conv]))}
    assert len(nodes) == len(prefixes)
    for path in paths.values():
        position = 0
        for k, node in enumerate(path):
            n = nodes[node]
            assert n.tree == path[0] and n.parent == (path[k - 1] if k else None) and n.position == position
            position += len(n.formatted)
            seen = {x for a in n.attends for x in range(a["from"], a["to"])}
            assert seen == {x for a in path[:k] for x in range(nodes[a].start, nodes[a].start + len(nodes[a].formatted))}
            assert all(a["to"] < b["from"] for a, b in zip(n.attends, n.attends[1:], strict=False))
    for tree in {n.tree for n in nodes.values()}:
        order = sorted((n for n in nodes.values() if n.tree == tree), key=lambda n: n.start)
        ends = np.cumsum([0, *(len(n.formatted) for n in order)])
        assert [n.start for n in order] == list(ends[:-1])
        stack = []
        for n in order:  # depth first: the parent is open
            while stack and stack[-1] != n.parent:
                stack.pop()
            assert n.parent is None or stack
            stack.append(n.node)


ITEM = "At the market Anna buys 12 apples for 3 dollars each, and then Anna gives 4 of the apples to Bert. How many apples are left with her?"


def test_contaminated(spark):
    changed = ITEM.replace("Anna", "Zoe").replace("Bert", "Carl").replace("12", "57").replace("3 dollars", "9 euros").replace("4 of", "8 of")
    mixed_up = ITEM.replace("Anna buys", "Zoe buys").replace("12", "57")
    docs = [(1, f"Some words come first. {ITEM} More words."), (2, f"other text, {changed.upper().lower()} end"), (3, f"Before that. {changed} After that."), (4, "Nothing of the kind is here, but 12 apples and 3 dollars."), (5, None), (6, ""), (7, ITEM[:60]), (3, "again"), (None, ITEM), (8, f"See: {mixed_up}")]
    df = spark.createDataFrame([(k, t, "i") for k, t in docs], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(10, ITEM), (10, ITEM), (11, "too short to tell"), (12, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontamination.contaminated(df, items).collect()}
    assert {(1, 10), (3, 10), (None, 10)} <= set(got)
    assert got[1, 10].n_matched == got[1, 10].n_windows and got[3, 10].n_slots >= 5
    assert not {4, 5, 6} & {k for k, _ in got}
    # Anna can't be Zoe in one place and Anna in the other within an alignment
    assert (8, 10) not in got
    kept = decontamination.clean(df, items)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} >= {4, 5, 6} and not {1, 3, None} & {r.doc_id for r in kept.collect()}
    assert decontamination.contaminated(df.limit(0), items).count() == 0 and decontamination.contaminated(df, items.limit(0)).count() == 0


def test_toxicity_learns_stems(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7)))
    docs, labels = [], []
    for k in range(700):
        bad = rng.random() < 0.3
        text = [word() for _ in range(rng.randint(5, 60))]
        for _ in range(2 * bad):
            text.insert(rng.randrange(len(text)), "zqxw" + word())
        docs.append((k, " ".join(text), "en", "s"))
        labels.append((k, int(bad)))
    docs += [(9001, None, None, "s"), (9002, "", "xx", "s"), (None, "zqxwab", "en", "s")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, score string")
    marks = spark.createDataFrame([*labels, (9001, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.classify(df, marks).collect()
    assert len(got) == len(docs)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in got)
    held = [(r.predicted, dict(labels)[r.doc_id]) for r in got if r.held_out and r.doc_id < 9000]
    assert np.mean([a == b for a, b in held]) > 0.95
    assert sorted(map(str, got)) == sorted(map(str, toxicity.classify(df.repartition(3), marks).collect()))
    assert toxicity.classify(df, marks.limit(0)).count() == len(docs) and toxicity.classify(df.limit(0), marks).count() == 0


def test_held_out_accuracy(spark):
    got = queries.op8_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.95


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(40)]
    parent = {x: x for e in edges for x in e if e[0] != e[1]}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    assert {r.node: r.component for r in components.connected(df).collect()} == {x: root(x) for x in parent}
    assert components.connected(df.limit(0)).collect() == []


def test_pipeline(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names, kept = docs.columns, docs
    seen = [docs.count()]
    for _, stage in pipeline.STAGES:
        kept = stage(spark, kept, FOLDER).cache()
        seen.append(kept.count())
    assert [s for s, _ in pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_join", "decontamination", "source_mixing"]
    assert all(b <= a for a, b in zip(seen, seen[1:-1], strict=False)) and kept.columns == [*names, "copy"]
    assert sorted(map(str, pipeline.run(spark, FOLDER).collect())) == sorted(map(str, kept.collect()))
