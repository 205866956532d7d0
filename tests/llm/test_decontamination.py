"""Decontamination against a plain version that tries every item at every place of every document."""

import random
import re
from collections import defaultdict

import pytest

from ferrule.llm import decontamination

W, LITERAL, SHORT, COVERED = decontamination.WINDOW, decontamination.LITERAL, decontamination.SHORT, decontamination.COVERED
UNITS = set(decontamination.UNITS.split())


def words_of(text):
    """(type, value) of each word: N a name, D a number, U a unit, or nothing."""
    out, last = [], ""
    for word in (text or "").split():
        plain = re.sub(r"\W|_", "", word.lower())
        if not plain:
            last = word
            continue
        if re.match(r"[$€£]?\d", word):
            kind = "D"
        elif out and out[-1][0] == "D" and re.sub(r"\W+$", "", word) in UNITS:
            kind = "U"
        elif re.match(r"[A-Z][a-z]+", word) and last and re.search(r"[\w,;]$", last):
            kind = "N"
        else:
            kind = ""
        out.append((kind, plain))
        last = word
    return out


def windows_of(item):
    n = len(item) if SHORT <= len(item) < W else W
    found = [(k, sum(not t for t, _ in item[k : k + n])) for k in range(len(item) - n + 1)]
    need = LITERAL if max((x for _, x in found), default=0) >= LITERAL else 1
    return n, [k for k, x in found if x >= need]


def brute(docs, items):
    shape = lambda words: [t or v for t, v in words]
    out = set()
    for key, text in docs:
        doc = words_of(text)
        for item_id, item_text in items:
            item = words_of(item_text)
            n, starts = windows_of(item)
            along = defaultdict(set)
            for k in starts:
                for at in range(len(doc) - n + 1):
                    if shape(doc[at : at + n]) == shape(item[k : k + n]):
                        along[at - k].add(k)
            held = set()
            for shift, ks in along.items():
                values = defaultdict(set)
                for k in range(min(ks), max(ks) + n):
                    if item[k][0] and doc[k + shift][0] == item[k][0]:
                        values[item[k]].add(doc[k + shift])
                if all(len(v) == 1 for v in values.values()):
                    held |= ks
            if starts and held and len(held) >= COVERED * len(starts):
                out.add((key, item_id, len(held), len(starts)))
    return out


def corpus(seed):
    rng = random.Random(seed)
    plain, names = "a the of cost buys sells more than each apples and then left in box how many".split(), ["Anna", "Bert", "Carl", "Dora"]

    def sentence(n):
        out = []
        for _ in range(n):
            x = rng.random()
            out += [rng.choice(names)] if x < 0.15 else [str(rng.randint(1, 9)), rng.choice(["kg", "miles"])] if x < 0.3 else [rng.choice(plain)]
        return " ".join(out)

    items = [(k, sentence(n)) for k, n in enumerate((3, 4, 5, 7, 9, 12, 20, 30, 40))] + [(90, "so 1 2 3 4 5 6 7 8 9"), (91, "1 2 3 4 5 6 7 8"), (92, None)]
    docs = [(100, None), (101, ""), (102, "Anna")]
    for k in range(60):
        text = rng.choice(items)[1] or ""
        if rng.random() < 0.6:
            old, new = rng.choice(names), rng.choice(names)
            text = text.replace(old, new) if rng.random() < 0.6 else text.replace(old, new, 1)
        if rng.random() < 0.5:
            text = re.sub(r"\d", lambda m: str(9 - int(m[0])), text)
        docs.append((k, f"{sentence(rng.randint(0, 12))} and {text} {sentence(rng.randint(0, 12))}"))
    return docs, items


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_every_place(spark, seed):
    docs, items = corpus(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = decontamination.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.n_matched, r.n_windows) for r in got} == brute(docs, items)


def test_short_items(spark):
    items = spark.createDataFrame([(1, "What is the capital of France"), (2, "too short here")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "they ask: what is the capital of France, again"), (2, "the capital is large"), (3, "too short here")], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, items).collect()] == [(1, 1)]
