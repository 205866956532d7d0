"""Repair of the order of turns by a min-plus matrix scan.

A conversation is well formed if the first letters of its roles read `(s?(ua)+)?`: an automaton of four
states. Each turn is a 4x4 matrix over (cost, audit) elements: entry (i, j) is the cheapest way to read the
turn that leads from state i to state j, insertions before the turn included (their closure is multiplied
in), and the letters of its edits. Elements are added by taking the least and multiplied by summing costs
and joining audits. Of two audits of equal cost over the same turns neither is the beginning of the
other, as another letter would be an insertion and cost more; so the least of pairs keeps its order under
products, and products are associative.

Turns are numbered within their conversation by a range sort, cut into chunks of `CHUNK`, and the chunks'
products are multiplied `FAN` at a time, level by level: no task holds more than `FAN` matrices of one
conversation. On the way back each level hands the states in which the cheapest path enters and leaves
to the level below, until the chunks replay their own edits. What can't be split is the result's own
cells: the audit of a conversation is one string of a letter for each edit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ferrule.llm.shared import importable, keep

#: Turns of a chunk, and matrices that are multiplied in one group.
CHUNK, FAN = 1024, 32
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1

#: States: nothing yet, after system, after user, after assistant. Where a user or assistant turn may come
#: next it's always one of the two: NEXT has its letter and the state after it.
NEXT = (("u", 2), ("u", 2), ("a", 3), ("u", 2))
ACCEPTING = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
INITIALS, FAULTS = "sua-", ("", "blank", "duplicate", "truncated")

Element = tuple[int, str]
Matrix = tuple[tuple[Element | None, ...], ...]
EMPTY: Element = (0, "")
_ELEMENT = "array<struct<cost:bigint,audit:string>>"
_TALLY = "rows bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string"


def least(options: Iterable[Element | None]) -> Element | None:
    return min((x for x in options if x is not None), default=None)


def times(x: Matrix, y: Matrix) -> Matrix:
    """The min-plus product."""
    return tuple(tuple(least((a[0] + b[0], a[1] + b[1]) for a, b in zip(row, column, strict=True) if a and b) for column in zip(*y, strict=True)) for row in x)


def _closure() -> Matrix:
    """Any number of insertions: each state has one way on, and going round again only costs."""
    out: list[list[Element | None]] = [[None] * 4 for _ in range(4)]
    for i in range(4):
        at, made = i, EMPTY
        while out[i][at] is None:
            out[i][at] = made
            at, made = NEXT[at][1], (made[0] + INSERT, made[1] + "I")
    return tuple(map(tuple, out))


CLOSURE = _closure()


def code(initial: str, fault: int) -> str:
    return chr(65 + 4 * INITIALS.index(initial) + fault)


def _read(letter: str) -> tuple[str, int]:
    return INITIALS[(ord(letter) - 65) // 4], (ord(letter) - 65) % 4


def _turn(letter: str) -> Matrix:
    initial, fault = _read(letter)
    out: list[list[Element | None]] = [[None] * 4 for _ in range(4)]
    for i, (wanted, then) in enumerate(NEXT):
        out[i][i] = (DELETE, "D")
        if FAULTS[fault] in ("blank", "duplicate"):
            continue
        more = CUT_OFF if FAULTS[fault] == "truncated" else 0
        out[i][then] = least([out[i][then], (KEEP + more, "K") if initial == wanted else (REROLE + more, "R")])
        if initial == "s" and i == 0:
            out[i][1] = (KEEP + more, "K")
    return times(CLOSURE, tuple(map(tuple, out)))


TURNS = {code(i, f): _turn(code(i, f)) for i in INITIALS for f in range(4)}
UNIT: Matrix = tuple(tuple(EMPTY if i == j else None for j in range(4)) for i in range(4))


def product(matrices: Sequence[Matrix]) -> Matrix:
    """By halves, so that long audits are joined few times."""
    level = list(matrices) or [UNIT]
    while len(level) > 1:
        level = [times(*level[k : k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


def crossed(children: Sequence[Matrix], start: int, end: int) -> list[int]:
    """The states before, between and after the children on the cheapest path from start to end."""
    paths: dict[int, tuple[Element, tuple[int, ...]]] = {start: (EMPTY, (start,))}
    for m in children:
        new: dict[int, tuple[Element, tuple[int, ...]]] = {}
        for i, (so_far, path) in paths.items():
            for j in range(4):
                if (step := m[i][j]) is not None:
                    found = ((so_far[0] + step[0], so_far[1] + step[1]), (*path, j))
                    if j not in new or found < new[j]:
                        new[j] = found
        paths = new
    return list(paths[end][1])


def finish(m: Matrix) -> tuple[int, str, int]:
    """(cost, audit, last state before the closing insertions) of the cheapest repair."""
    ends = ((x[0] + y[0], x[1] + y[1], j) for j in range(4) for f in ACCEPTING if (x := m[0][j]) and (y := CLOSURE[j][f]))
    return min(ends)


def replay(codes: str, audit: str, state: int) -> list[tuple[int, str, str]]:
    """(turn, edit, role letter) of each edit of an audit; turns count from 0, an insertion has the number
    of the turn it comes before, and deleted and kept turns have the letter `-` and their own."""
    out, at = [], 0
    for edit in audit:
        letter = NEXT[state][0] if edit in "IR" else "-" if edit == "D" else _read(codes[at])[0]
        out.append((at, edit, letter))
        if edit != "D":
            state = 1 if letter == "s" else NEXT[state][1]
        at += edit != "I"
    return out


def tally(parts: Sequence[tuple]) -> tuple:
    """Counts of neighbouring parts (rows, blank, duplicate, truncated, illegal, first, last) as one."""

    def both(x: tuple, y: tuple) -> tuple:
        seam = int(x[6] + y[5] not in ("su", "ua", "au"))
        return (x[0] + y[0], x[1] + y[1], x[2] + y[2], x[3] + y[3], x[4] + y[4] + seam, x[5], y[6])

    return reduce(both, parts)


def _one(letter: str) -> tuple:
    initial, fault = _read(letter)
    return (1, *(int(fault == k) for k in (1, 2, 3)), 0, initial, initial)


def _stored(m: Matrix) -> list[dict | None]:
    return [x and {"cost": x[0], "audit": x[1]} for row in m for x in row]


def _loaded(cells: Sequence[dict | None]) -> Matrix:
    flat = [x and (x["cost"], x["audit"]) for x in cells]
    return tuple(tuple(flat[4 * i : 4 * i + 4]) for i in range(4))


def _rows(schema: str, f: Callable[[dict], Iterable[dict]]) -> Callable[[DataFrame], DataFrame]:
    """A row function as Arrow batches."""

    def run(df: DataFrame) -> DataFrame:
        shape = to_arrow_schema(StructType.fromDDL(schema))

        def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in stream:
                made = [r for row in batch.to_pylist() for r in f(row)]
                if made:
                    yield pa.RecordBatch.from_pylist(made, shape)

        return df.mapInArrow(batches, schema)

    return run


def _named(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """The four columns under names of their own; null roles and texts are one space."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))]
    return turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), *said)


def numbered(turns: DataFrame) -> DataFrame:
    """turns (conv, turn, role, text) with pos, from 0 within the conversation, by turn (nulls first), role and text.

    A range sort and a running sum over (conversation, partition) counts: a conversation of any length is
    spread over partitions. Equal rows may be numbered either way."""
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "tie"]
    tied = turns.withColumn("tie", F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    rows = keep(dealt.withColumn("at", F.monotonically_increasing_id()), "turns")
    part = F.shiftright("at", 33)
    starts = rows.groupBy("conv", part.alias("part")).agg(F.min("at").alias("since"), F.count("*").alias("n"))
    # a conversation has as many rows here as partitions, and seldom more than one
    before = F.coalesce(F.expr("sum(n) OVER (PARTITION BY conv ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"), F.lit(0))
    starts = starts.select(F.col("conv").alias("of"), "part", (F.col("since") - before).alias("zero"))
    met = F.col("conv").eqNullSafe(F.col("of")) & (part == F.col("part"))
    return rows.join(starts, met).select("conv", "turn", "role", "text", (F.col("at") - F.col("zero")).alias("pos"))


def coded(rows: DataFrame) -> DataFrame:
    """(conv, chunk, codes): the role's first letter and the first fault of each turn, a letter each."""
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1).isin(".", "!", "?")
    initial = F.substring("role", 1, 1)
    whole = F.struct("role", "text")
    small = rows.select("conv", "pos", F.xxhash64("role", "text").alias("h"), F.md5(F.to_json(whole)).alias("digest"), blank.alias("blank"), cut.alias("cut"), F.when(initial.isin("s", "u", "a"), initial).otherwise("-").alias("initial"))
    small = keep(small, "codes")
    repeated = small.groupBy("conv", "h", "digest").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1")
    repeated = repeated.select(F.col("conv").alias("of"), F.col("h").alias("rh"), F.col("digest").alias("rd"), "first")
    met = F.col("conv").eqNullSafe(F.col("of")) & (F.col("h") == F.col("rh")) & (F.col("digest") == F.col("rd"))
    judged = small.join(repeated, met, "left").select("conv", "pos", "initial", F.when(F.col("blank"), 1).when(F.col("pos") > F.col("first"), 2).when(F.col("cut"), 3).otherwise(0).alias("fault"))
    letter = F.char(65 + 4 * (F.instr(F.lit(INITIALS), F.col("initial")) - 1) + F.col("fault"))
    chunks = judged.groupBy("conv", F.expr(f"pos div {CHUNK}").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("pos", letter.alias("code")))).alias("turns"))
    return chunks.select("conv", "chunk", F.array_join(F.transform("turns", lambda t: t.code), "").alias("codes"))


def _gathered(nodes: DataFrame) -> DataFrame:
    """Nodes by FAN neighbours, in order: (conv, parent, children)."""
    children = F.struct("chunk", *[c for c in nodes.columns if c not in ("conv", "chunk")])
    return nodes.groupBy("conv", F.expr(f"chunk div {FAN}").alias("parent")).agg(F.array_sort(F.collect_list(children)).alias("children"))


def _node(row: dict) -> dict:
    t = tally([_one(c) for c in row["codes"]])
    return dict(zip(("rows", "blank", "duplicate", "truncated", "illegal", "first", "last"), t, strict=True), matrix=_stored(product([TURNS[c] for c in row["codes"]])))


def scan(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of chunks (conv, chunk, codes): a row for each conversation (conv, cost, audit, rows, blank, duplicate,
    truncated, illegal), and one for each chunk with its edits (conv, chunk, place, edit, role letter), as replayed."""
    kind = chunks.schema["conv"].dataType.simpleString()
    node = f"conv {kind}, chunk bigint, {_TALLY}, matrix {_ELEMENT}"

    def leaf(row: dict) -> Iterator[dict]:
        yield _node(row) | {"conv": row["conv"], "chunk": row["chunk"]}

    def joined(row: dict) -> Iterator[dict]:
        parts = row["children"]
        t = tally([tuple(p[k] for k in ("rows", "blank", "duplicate", "truncated", "illegal", "first", "last")) for p in parts])
        yield dict(zip(("rows", "blank", "duplicate", "truncated", "illegal", "first", "last"), t, strict=True), conv=row["conv"], chunk=row["parent"], matrix=_stored(product([_loaded(p["matrix"]) for p in parts])))

    def ended(row: dict) -> Iterator[dict]:
        cost, audit, last_state = finish(_loaded(row["matrix"]))
        yield row | {"cost": cost, "audit": audit, "start": 0, "end": last_state}

    levels = [keep(_rows(node, leaf)(chunks), "level")]
    while (levels[-1].agg(F.max("chunk")).first()[0] or 0) > 0:
        levels.append(keep(_rows(node, joined)(_gathered(levels[-1])), "level"))
    roots = keep(_rows(f"conv {kind}, chunk bigint, cost bigint, audit string, rows bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, start int, end int", ended)(levels[-1]), "roots")

    def handed(row: dict) -> Iterator[dict]:
        states = crossed([_loaded(p["matrix"]) for p in row["children"]], row["start"], row["end"])
        for p, start, end in zip(row["children"], states, states[1:], strict=False):
            yield {"conv": row["conv"], "chunk": p["chunk"], "start": start, "end": end}

    ways = roots.select("conv", "chunk", "start", "end")
    for level in reversed(levels[:-1]):
        above = ways.select(F.col("conv").alias("of"), F.col("chunk").alias("up"), "start", "end")
        down = _gathered(level.select("conv", "chunk", "matrix")).join(above, F.col("conv").eqNullSafe(F.col("of")) & (F.col("parent") == F.col("up")))
        ways = _rows(f"conv {kind}, chunk bigint, start int, end int", handed)(down.select("conv", "children", "start", "end"))
    ways = ways.select(F.col("conv").alias("of"), F.col("chunk").alias("up"), "start", "end")

    def replayed(row: dict) -> Iterator[dict]:
        audit = row["matrix"][4 * row["start"] + row["end"]]["audit"]
        for k, (at, edit, letter) in enumerate(replay(row["codes"], audit, row["start"])):
            yield {"conv": row["conv"], "pos": row["chunk"] * CHUNK + at, "k": k, "edit": edit, "letter": letter}

    bottom = levels[0].select(F.col("conv").alias("c"), F.col("chunk").alias("b"), "matrix")
    told = chunks.join(ways, F.col("conv").eqNullSafe(F.col("of")) & (F.col("chunk") == F.col("up"))).select("conv", "chunk", "codes", "start", "end")
    told = told.join(bottom, F.col("conv").eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("b"))).select("conv", "chunk", "codes", "start", "end", "matrix")
    edits = _rows(f"conv {kind}, pos bigint, k int, edit string, letter string", replayed)(told)

    def closing(row: dict) -> Iterator[dict]:
        state = row["end"]
        for k in range(len(row["audit"]) - len(row["audit"].rstrip("I"))):
            letter, state = NEXT[state]
            yield {"conv": row["conv"], "pos": row["rows"], "k": k, "edit": "I", "letter": letter}

    tails = _rows(f"conv {kind}, pos bigint, k int, edit string, letter string", closing)(roots.where(F.col("audit").endswith("I")).select("conv", "rows", "audit", "end"))
    return roots.drop("chunk", "start", "end"), edits.unionByName(tails)


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The repaired turns, and a row for each conversation.

    turns: conversations of any length, rows in any order; they count by turn, nulls first, then role and text.
    Faults, the first of each row: blank (no letter but white space), duplicate (role and text seen before),
    truncated (ends in none of `.!?`). Keeping costs 0, another role 2, deleting 3 (blank and duplicate turns must
    go), an empty turn inserted 2, and each truncated turn that stays 1.

    First table: (conv, pos, k, edit, role, text), in the order of (pos, k), of the turns that the repaired
    conversation has; edit is K, R or I. Second: (conv, cost, audit, rows, blank, duplicate, truncated, illegal, gaps).

    A null role or text is one space; a null turn is no gap; a null conversation is one of its own; repeated rows
    are duplicates; extra columns are left out, whatever their names; no rows give two empty tables. Texts are
    moved as they are and may be of any length."""
    importable(turns.sparkSession)
    rows = numbered(_named(turns, conv, turn, role, text))
    chunks = keep(coded(rows), "chunks")
    found, edits = scan(chunks)
    gaps = rows.groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps")).select(F.col("conv").alias("of"), "gaps")
    summary = found.join(gaps, F.col("conv").eqNullSafe(F.col("of"))).drop("of")
    edits = edits.where("edit <> 'D'").select(F.col("conv").alias("of"), F.col("pos").alias("at"), "k", "edit", "letter")
    said = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    # an insertion has no text and needs no row; the others meet theirs
    inserted = edits.where("edit = 'I'").select(F.col("of").alias("conv"), F.col("at").alias("pos"), "k", "edit", said[F.col("letter")].alias("role"), F.lit("").alias("text"))
    stay = rows.join(edits.where("edit <> 'I'"), F.col("conv").eqNullSafe(F.col("of")) & (F.col("pos") == F.col("at")))
    stay = stay.select("conv", "pos", "k", "edit", F.when(F.col("edit") == "R", said[F.col("letter")]).otherwise(F.col("role")).alias("role"), "text")
    return stay.unionByName(inserted), summary


def digests(repaired: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of `role:text` lines. A digest is one pass over its conversation, so a task reads it
    in order, a turn at a time, and holds no more than a batch."""
    kind = repaired.schema["conv"].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done, schema = None, None, [], None
        for batch in batches:
            schema = batch.schema.field("conv").type
            for conv, role, text in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        done.append((now, state.hexdigest()))
                    now, state = conv, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(role.as_py().encode("utf-8", "replace") + b":" + text.as_py().encode("utf-8", "replace"))
            if len(done) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], schema), pa.array([x[1] for x in done])], ["conv", "repaired_sha256"])
                done = []
        if state is not None:
            done.append((now, state.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], schema), pa.array([x[1] for x in done])], ["conv", "repaired_sha256"])

    sorted_turns = repaired.repartition("conv").sortWithinPartitions("conv", "pos", "k").select("conv", "role", "text")
    return sorted_turns.mapInArrow(hashed, f"conv {kind}, repaired_sha256 string")


def summaries(turns: DataFrame, ids: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each conversation of ids: (conv, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256). One without turns has zeros, an empty audit and the digest of an empty string; see `repair`."""
    repaired, found = repair(turns, conv, turn, role, text)
    made = digests(repaired).withColumnRenamed("conv", "of")
    found = found.withColumnRenamed("conv", "c")
    out = ids.select(F.col(conv).alias("conv")).distinct().join(found, F.col("conv").eqNullSafe(F.col("c")), "left").join(made, F.col("conv").eqNullSafe(F.col("of")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("conv").alias(conv), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def damaged(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turns with faults put in by crc32(`conv:turn`) % 20: 0 drops the row, 1 empties its text, 2 takes its `[.!?]`
    out, 3 repeats it, 4 makes its role user. Null roles and texts, and nulls in the hashed text, are one space first."""
    rows = _named(turns, conv, turn, role, text)
    mark = F.crc32(F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c else F.lit(":") for c in ("conv", "", "turn")]).cast("binary")) % 20
    rows = rows.withColumn("mark", mark).where("mark <> 0")
    said: Column = F.when(F.col("mark") == 1, "").when(F.col("mark") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times_ = F.when(F.col("mark") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    out = rows.select("conv", "turn", F.when(F.col("mark") == 4, "user").otherwise(F.col("role")).alias("role"), said.alias("text"), F.explode(times_).alias("copy"))
    return out.select(F.col("conv").alias(conv), F.col("turn").alias(turn), F.col("role").alias(role), F.col("text").alias(text))
