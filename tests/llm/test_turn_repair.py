"""Repair of turns against an enumeration of all edits, and trees of matrices against one."""

import hashlib
import random
import re
import zlib

import pytest

from ferrule.llm import queries, turn_repair

FULL = re.compile(r"(s?(ua)+)?\Z")
BEGUN = re.compile(r"s?(ua)*u?\Z")


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute(rows):
    """(cost, audit, repaired) of the best of all edits, by trying them all on the automaton's language."""
    best = {"": (0, "", ())}  # by initials so far, the least; no initials but begun ones can end well
    insert = lambda states: {
        (i + r): min((c + 2, a + "I", (*t, f"{'user' if r == 'u' else 'assistant'}:")) for i2, (c, a, t) in states.items() if i2 == i)
        for i in states
        for r in "ua"
        if BEGUN.match(i + r)
    }

    def closed(states):
        now = dict(states)
        for _ in range(3):
            for i, x in insert(now).items():
                now[i] = min(x, now.get(i, x))
        return now

    for (_, role, text), fault in zip(rows, faults(rows), strict=True):
        new = {}

        def put(i, x, new=new):
            if BEGUN.match(i):
                new[i] = min(x, new.get(i, x))

        for i, (c, a, t) in closed(best).items():
            put(i, (c + 3, a + "D", t))
            if fault in ("", "truncated"):
                more = fault == "truncated"
                put(i + (role[:1] or "-"), (c + more, a + "K", (*t, f"{role}:{text}")))
                for r, name in (("u", "user"), ("a", "assistant")):
                    put(i + r, (c + 2 + more, a + "R", (*t, f"{name}:{text}")))
        best = new
    return min(x for i, x in closed(best).items() if FULL.match(i))


def expected(rows):
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: ((r[0] is not None, r[0] or 0), r[1].encode(), r[2].encode()))
    turns = [t for t, _, _ in rows if t is not None]
    kinds, initials = faults(rows), [r[:1] for _, r, _ in rows]
    cost, audit, said = brute(rows)
    counts = {k: kinds.count(k) for k in ("blank", "duplicate", "truncated")}
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return {"gaps": gaps, **counts, "illegal": illegal, "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(said).encode()).hexdigest()}


def conversations(seed, n=60):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", None, ""]
    texts = ["One.", "Two!", "three", " ", "", None, "Four?  ", " ", "fünf\n", "\n\t", "Six.\x0b"]
    return [(c, rng.choice([None, *range(6)]) if rng.random() < 0.9 else 9, rng.choices(roles, [5, 5, 2, 1, 1, 1])[0], rng.choice(texts)) for c in [*range(n), None] for _ in range(rng.randint(1, 5))]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize(("chunk", "fan"), [(1024, 32), (2, 2)])
def test_against_all_edits(spark, monkeypatch, seed, chunk, fan):
    """Also with chunks of two turns and trees of two branches, so that conversations cross many of both."""
    monkeypatch.setattr(turn_repair, "CHUNK", chunk)
    monkeypatch.setattr(turn_repair, "FAN", fan)
    rows = conversations(seed)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, conv string, pos int").repartition(5)
    ids = spark.createDataFrame([*{(r[0],) for r in rows}, (-5,)], "conv_id long")
    got = {r.conv_id: r.asDict() for r in turn_repair.summaries(df, ids).collect()}
    assert len(got) == 62
    for c in {r[0] for r in rows}:
        want = expected([r[1:] for r in rows if r[0] == c])
        assert {k: v for k, v in got[c].items() if k != "conv_id"} == want, [r for r in rows if r[0] == c]
    assert (got[-5]["cost"], got[-5]["audit"], got[-5]["repaired_sha256"]) == (0, "", hashlib.sha256(b"").hexdigest())


def test_long_conversation_over_many_chunks(spark):
    """9,000 turns of one conversation, some with long texts: the tree gives what one fold over the turns gives."""
    rng = random.Random(3)
    rows = [(7, k, rng.choice(["user", "assistant", "system"]), f"{k} " + "w" * (200_000 if k % 3000 == 5 else 3) + rng.choice([".", "", "!"])) for k in range(9000)]
    repaired, found = turn_repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    codes = [turn_repair.code(r[2][0], 0 if r[3][-1] in ".!" else 3) for r in rows]
    vector = [turn_repair.EMPTY, None, None, None]
    for c in codes:
        m = turn_repair.TURNS[c]
        vector = [turn_repair.least((v[0] + m[i][j][0], v[1] + m[i][j][1]) for i, v in enumerate(vector) if v and m[i][j]) for j in range(4)]
    cost, audit, _ = turn_repair.finish((tuple(vector), *[(None,) * 4] * 3))
    row = found.first()
    assert (row.cost, row.audit) == (cost, audit) and row["rows"] == 9000
    turns = repaired.orderBy("pos", "k").collect()
    assert FULL.match("".join(t.role[0] for t in turns)) and [t.edit for t in turns] == [e for e in audit if e != "D"]
    said = {k: r[3] for k, r in enumerate(rows)}
    assert all(t.text == (said[t.pos] if t.edit != "I" else "") for t in turns)


def test_products_are_associative():
    rng = random.Random(5)
    for _ in range(50):
        ms = [rng.choice(list(turn_repair.TURNS.values())) for _ in range(9)]
        left = ms[0]
        for m in ms[1:]:
            left = turn_repair.times(left, m)
        assert left == turn_repair.product(ms)
        assert turn_repair.times(turn_repair.CLOSURE, turn_repair.CLOSURE) == turn_repair.CLOSURE


def test_nothing_and_equal_rows(spark):
    shape = "conv_id long, turn long, role string, text string"
    none = spark.createDataFrame([], shape)
    assert turn_repair.summaries(none, none).collect() == []
    same = spark.createDataFrame([(1, None, "user", "Hi.")] * 50, shape)
    row = turn_repair.summaries(same, same).first()
    assert (row.duplicate, row.illegal, row.gaps, row.cost, row.audit) == (49, 49, 0, 49 * 3 + 2, "K" + "D" * 49 + "I")


def test_damage(spark):
    rows = [(c, t, "assistant", "Yes. No!") for c in range(9) for t in range(9)] + [(3, None, None, None), (None, 4, "user", "?.!")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = []
    for c, t, r, x in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        want += [] if k == 0 else [(c, t, "user" if k == 4 else r, x)] * (1 + (k == 3))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in turn_repair.damaged(df).collect())


def test_query(spark):
    rows = queries.op12_turn_repair(spark, "/root/testdata/sf0.001").collect()
    ids = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id").distinct().count()
    assert len(rows) == ids and all(r.cost >= 3 * (r.blank + r.duplicate) for r in rows)
