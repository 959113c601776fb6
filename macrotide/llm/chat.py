"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns in
alternation, ending with the assistant. For each turn the repair may keep it, merge it
into the turn before, relabel it, or first insert an empty turn; the cheapest sequence
is found by dynamic programming over the automaton of legal turns and rendered.

Costs: keep 0, merge 1 (3 with another role than the turn before has), relabel 2,
insert 3 for each empty turn. Of equally cheap repairs the first in the order keep,
merge, relabel, insert, insert and relabel wins at each turn, from the end backwards.

All rows are dealt over tasks by ranges of their order, so a conversation of any length,
and rows of one turn number or without one, are many tasks' work. In each range a
conversation is cut into blocks of ``BLOCK`` rows. While blocks are numbered, each is reduced
to its matrix of cheapest costs between the automaton's four states; the
matrices of a conversation, one per block, settle the states at its block borders;
then every block repairs and renders its own turns. So no task holds more than a block's
turns or one conversation's matrices. Rows of one turn and role whose texts agree in the first
``PREFIX`` characters are in one range, cut into blocks like others.

The order is by turn, role and text, nulls first, so repeated rows and turns are
neighbours and are repaired like other turns. A null or unknown role can only be
relabelled (cost 2) or merged; a null text renders as empty; a null turn comes first; a
null conv_id is a conversation. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialise

BLOCK = 4096
#: Characters of a text that count when rows are dealt over tasks.
PREFIX = 64
#: States: before the first turn, after a system, user or assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = (None, "system", "user", "assistant")
BEFORE = {SYSTEM: (START,), USER: (START, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
MERGE, MERGE_OTHER, RELABEL, INSERT = 1, 3, 2, 3
#: What is inserted at the end, and its cost, by the last state.
END = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}
NEVER = 1 << 60
_ORDER = ("keep", "merge", "relabel", "insert", "insert_relabel")


def _steps(role: int | None) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, action) for a turn of that role; None: unknown."""
    out = []
    for state in range(4):
        if state != START:
            out.append((state, state, MERGE if role == state else MERGE_OTHER, "merge"))
        for to, before in BEFORE.items():
            cost, word = (0, "keep") if to == role else (RELABEL, "relabel")
            if state in before:
                out.append((state, to, cost, word))
            elif to == USER and state == USER or to == ASSISTANT and state != USER:
                out.append((state, to, cost + INSERT, "insert" if word == "keep" else "insert_relabel"))
    return sorted(out, key=lambda x: (x[1], x[2], _ORDER.index(x[3]), x[0]))


STEPS = {role: _steps(role) for role in (SYSTEM, USER, ASSISTANT, None)}


def role_of(name: str | None) -> int | None:
    return {"system": SYSTEM, "user": USER, "human": USER, "assistant": ASSISTANT}.get((name or "").strip().lower())


def advance(costs: list[int], role: int | None) -> tuple[list[int], list[tuple[int, str] | None]]:
    """Cheapest cost of each state after a turn, and the state and action that lead there."""
    best, how = [NEVER] * 4, [None] * 4
    for state, to, cost, action in STEPS[role]:
        total = costs[state] + cost
        if total < best[to]:
            best[to], how[to] = total, (state, action)
    return best, how


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _runs(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Sorted rows, gathered while their first two columns stay the same."""
    some: list[tuple] = []
    for row in rows:
        if some and row[:2] != some[0][:2]:
            yield some
            some = []
        some.append(row)
    if some:
        yield some


_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}


def _batches(rows: Iterator[tuple], schema: str, weight=lambda row: 1, limit: int = 5000) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``limit`` weight."""
    fields = pa.schema([(name, _TYPES[kind]) for name, kind in (x.split(" ") for x in schema.split(", "))])
    out, held = [], 0
    for row in rows:
        out.append(row)
        held += weight(row)
        if held >= limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), fields, strict=True)], schema=fields)
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), fields, strict=True)], schema=fields)


def _size(at: int):
    """What a row with a text in column ``at`` weighs, of ``_TEXTS`` in a batch."""
    return lambda row: 200 + len(row[at] or "")


_TEXTS = 4 << 20
NUMBERED = "conv long, block long, place long, turn long, role string, text string, costs array<long>"
BORDERS = "conv long, block long, entry int, exit int, last boolean"
RENDERED = "conv_id long, turn long, role string, action string, role_out string, n_inserted long, rendered string"


def _numbered(block_rows: int):
    """Sorted turns with block and place, and behind each block's last turn one row with the block's 16 costs from entry to exit state."""

    def numbered(rows):
        block, conv, costs, place = TaskContext.get().partitionId() << 32, None, [], 0

        def closed():
            return conv, block, -1, None, None, None, [min(x, NEVER) for entry in costs for x in entry]

        for row in rows:
            if place and (row[0] != conv or place == block_rows):
                yield closed()
                block, place = block + 1, 0
            if not place:
                conv, costs = row[0], [[0 if s == entry else NEVER for s in range(4)] for entry in range(4)]
            costs = [advance(now, role_of(row[2]))[0] for now in costs]
            yield conv, block, place, *row[1:], None
            place += 1
        if place:
            yield closed()

    return lambda batches: _batches(numbered(_rows(batches)), NUMBERED, _size(5), _TEXTS)


def _settled(blocks: list[tuple]) -> Iterator[tuple]:
    """conv, block, entry and exit state on the cheapest way through a conversation's blocks, and whether the block is the last."""
    now, back = [0, NEVER, NEVER, NEVER], []
    for _, _, m in blocks:
        new = [min((now[a] + m[4 * a + b], a) for a in range(4)) for b in range(4)]
        back.append([a for _, a in new])
        now = [min(c, NEVER) for c, _ in new]
    state = min(range(4), key=lambda s: (now[s] + INSERT * len(END[s]), s))
    for k in range(len(blocks) - 1, -1, -1):
        entry = back[k][state]
        yield blocks[k][0], blocks[k][1], entry, state, k == len(blocks) - 1
        state = entry


def _borders(batches):
    def borders(rows):
        some: list[tuple] = []
        for row in rows:
            if some and row[0] != some[0][0]:
                yield from _settled(some)
                some = []
            some.append(row)
        if some:
            yield from _settled(some)

    return _batches(borders(_rows(batches)), BORDERS)


def repair(roles: list[int | None], entry: int, exit_: int) -> list[tuple[int, int, str]]:
    """(state before, state after, action) of each turn on the cheapest way from entry to exit."""
    now, ways = [0 if s == entry else NEVER for s in range(4)], []
    for role in roles:
        now, how = advance(now, role)
        ways.append(how)
    out, state = [], exit_
    for how in reversed(ways):
        before, action = how[state]
        out.append((before, state, action))
        state = before
    return out[::-1]


def _open(role: int) -> str:
    return f"<|im_start|>{ROLES[role]}\n"


_CLOSE = "<|im_end|>\n"


def _rendered(batches):
    """Each block begins with the row of its borders."""

    def rendered(rows):
        for block in _runs(rows):
            entry, exit_, last = block[0][6:]
            turns = [r[3:6] for r in block[1:]]
            steps = repair([role_of(role) for _, role, _ in turns], entry, exit_)
            for k, ((turn, role, text), (before, after, action)) in enumerate(zip(turns, steps, strict=True)):
                text, inserted = text or "", 0
                if action == "merge":
                    piece = "\n\n" + text
                else:
                    piece = _CLOSE if before != START else ""
                    if action.startswith("insert"):
                        inserted = 1
                        piece += _open(ASSISTANT if before == USER else USER) + _CLOSE
                    piece += _open(after) + text
                if last and k == len(turns) - 1:
                    piece += _CLOSE + "".join(_open(s) + _CLOSE for s in END[after])
                    inserted += len(END[after])
                yield block[0][0], turn, role, action, ROLES[after], inserted, piece

    return _batches(rendered(_rows(batches)), RENDERED, _size(6), _TEXTS)


def format_chats(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per turn: conv_id, turn, role, action, role_out, n_inserted (empty turns) and rendered.

    A conversation's text is its rows' ``rendered`` end to end, in the order of turn, role and text.
    """
    order = ["conv", "turn", "role", "text"]
    plain = turns.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), "role", "text")
    ranges = plain.repartitionByRange("conv", "turn", "role", F.substring("text", 1, PREFIX)).sortWithinPartitions(*order)
    blocks = materialise(ranges.mapInArrow(_numbered(block), NUMBERED))
    costs = blocks.filter("costs IS NOT NULL").select("conv", "block", "costs")
    borders = costs.repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(_borders, BORDERS)
    # the row of borders travels with its block and comes first in it, so texts are shuffled once more only
    border = F.lit(None).cast("struct<entry:int,exit:int,last:boolean>").alias("border")
    turns_ = blocks.filter("costs IS NULL").select("conv", "block", "place", "turn", "role", "text", border)
    first = borders.select("conv", "block", F.lit(-1).cast("long").alias("place"), F.struct("entry", "exit", "last").alias("border"))
    both = turns_.unionByName(first, allowMissingColumns=True).select("conv", "block", "place", "turn", "role", "text", "border.entry", "border.exit", "border.last")
    ready = both.repartition("conv", "block").sortWithinPartitions("conv", "block", "place")
    return ready.mapInArrow(_rendered, RENDERED)
