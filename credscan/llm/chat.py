"""Minimum-cost repair and rendering of chat transcripts (operator 10).

Legal transcripts: an optional system turn, then user and assistant in turn, user first, assistant
last. A source turn keeps its role or is relabelled, and either starts a turn or is merged into
the one before; empty turns may be inserted. Dynamic programming over the automaton of legal turns
finds the cheapest repair. Steps are min-plus products and so associative: turns are range-sorted
over partitions, a conversation that spans several is reduced to one 4 x 4 matrix in each, the
matrices fix the states at the borders, and each partition then repairs its part by itself. No
task holds a whole conversation unless it fits a partition.

The result has one row per source turn and per inserted turn; ``rendered`` of a conversation's rows
in order of ``place`` is its text.

Results in edge cases: rows with a null conv_id form one conversation. Null turns come first; ties
follow role and text, and equal rows are turns of their own. Null and unknown roles are relabelled
at a lower cost. Null texts count as empty and empty turns are kept. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credscan.llm.cluster import cut, partitions

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: Turns that may follow a state, and states that may end.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
ENDS = (ASSISTANT,)
MERGE, INSERT, RELABEL, NAME = 1, 2, 3, 1
NEVER = 1 << 40
HEAD, TAIL, JOINT = "<|{}|>\n", "<|end|>\n", "\n"


@cache
def between(state: int, then: int) -> tuple[int, ...] | None:
    """The fewest turns to insert after ``state`` so that turn ``then`` may follow; None if never."""
    seen, paths = {state}, [(state, ())]
    for here, path in paths:
        if then in NEXT[here]:
            return path
        for turn in NEXT[here]:
            if turn not in seen:
                seen.add(turn)
                paths.append((turn, (*path, turn)))
    return None


@cache
def closing(state: int) -> tuple[int, ...]:
    """The turns to insert after the last one."""
    if state in ENDS:
        return ()
    return min(((*between(state, e), e) for e in ENDS if between(state, e) is not None), key=len)


def place_cost(before: int, after: int) -> tuple[int, bool]:
    """Cost of a source turn in state ``after``, and whether it is merged into the turn before."""
    if before == after:
        return MERGE, True
    path = between(before, after)
    return (NEVER, False) if path is None else (INSERT * len(path), False)


def role_cost(role: str | None, state: int) -> int:
    if role not in ROLES:
        return NAME
    return 0 if ROLES[state - 1] == role else RELABEL


@cache
def step(costs: tuple[int, ...], role: str | None) -> tuple[tuple[int, ...], int, tuple[int, ...]]:
    """Least costs after one more turn, less their minimum; the minimum; the state before each."""
    new, back = [NEVER], [START]
    for after in STATES[1:]:
        best = min((costs[b] + place_cost(b, after)[0], b) for b in STATES)
        new.append(min(NEVER, best[0] + role_cost(role, after)))
        back.append(best[1])
    least = min(new)
    return tuple(min(NEVER, c - least) if c < NEVER else NEVER for c in new), least, tuple(back)


def _from(state: int) -> tuple[int, ...]:
    return tuple(0 if s == state else NEVER for s in STATES)


def run_costs(roles: list[str | None], start: int) -> list[int]:
    """Cost of reaching each state over ``roles`` from ``start``."""
    costs, total = _from(start), 0
    for role in roles:
        costs, least, _ = step(costs, role if role in ROLES else None)
        total += least
        if least >= NEVER:
            return [NEVER] * len(STATES)
    return [min(NEVER, c + total) for c in costs]


def states(roles: list[str | None], start: int = START, end: int | None = None) -> list[int]:
    """The state of each turn on the cheapest way from ``start`` to ``end``, or to a legal end."""
    costs, backs, total = _from(start), [], 0
    for role in roles:
        costs, least, back = step(costs, role if role in ROLES else None)
        backs.append(back)
    if end is None:
        end = min(STATES[1:], key=lambda s: costs[s] + INSERT * len(closing(s)))
    found = [end]
    for back in reversed(backs[1:]):
        found.append(back[found[-1]])
    return found[::-1]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple]]]:
    """Conversation id and rows (place, turn, role, text) of each run of equal ids."""
    rows = (
        row for batch in batches
        for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "turn", "role", "text")), strict=True)
    )
    for conv, own in groupby(rows, key=lambda r: r[0]):
        yield conv, [r[1:] for r in own]


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition's first and last conversation: the cost of every way through its part here."""
    first = last = None
    for conv, rows in _runs(batches):
        roles = [r[2] for r in rows]
        # between its ends a partition's conversations are whole
        last = (conv, rows[0][0], [c for s in STATES for c in run_costs(roles, s)])
        first = first or last
    if first:
        own = [first] if first is last else [first, last]
        yield pa.record_batch(
            [pa.array([x[0] for x in own], pa.int64()), pa.array([x[1] for x in own], pa.int64()), pa.array([x[2] for x in own], pa.list_(pa.int64()))],
            ["conv_id", "place", "costs"],
        )


def through(parts: list[list[int]]) -> list[tuple[int, int]]:
    """State before and after each part of a conversation on its cheapest legal way."""
    costs, backs = list(_from(START)), []
    for part in parts:
        ways = [[(min(NEVER, costs[a] + part[4 * a + b]), a) for a in STATES] for b in STATES]
        costs, backs = [min(w)[0] for w in ways], [*backs, [min(w)[1] for w in ways]]
    state = min(STATES[1:], key=lambda s: costs[s] + INSERT * len(closing(s)))
    out = []
    for back in reversed(backs):
        out.append((back[state], state))
        state = back[state]
    return out[::-1]


def _repair(borders: dict[int, tuple[int, int, bool]]) -> Callable:
    """``borders``: by a part's first place, its state before and after, and whether it is the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for conv, rows in _runs(batches):
            before, end, last = borders.get(rows[0][0], (START, None, True))
            found = states([r[2] for r in rows], before, end)
            for (place, turn, role, text), state in zip(rows, found, strict=True):
                merged = place_cost(before, state)[1]
                new = () if merged else between(before, state)
                opening = TAIL if before != START else ""
                for k, extra in enumerate(new):
                    name = ROLES[extra - 1]
                    out.append((conv, place * 8 + k, None, name, "insert", "", opening + HEAD.format(name)))
                    opening = TAIL
                name = ROLES[state - 1]
                action = ("keep" if name == role else "relabel") if not merged else ("merge" if name == role else "relabel and merge")
                lead = JOINT if merged else opening + HEAD.format(name)
                out.append((conv, place * 8 + len(new), turn, name, action, text or "", lead + (text or "")))
                before = state
            if last:
                for k, extra in enumerate(closing(before)):
                    name = ROLES[extra - 1]
                    out.append((conv, rows[-1][0] * 8 + 4 + k, None, name, "insert", "", TAIL + HEAD.format(name)))
                out[-1] = (*out[-1][:-1], out[-1][-1] + TAIL)
            if len(out) > 4096:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    return run


_KINDS = {"conv_id": pa.int64(), "place": pa.int64(), "turn": pa.int64(), "role": pa.string(), "action": pa.string(), "text": pa.string(), "rendered": pa.string()}


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS.values(), strict=True)], list(_KINDS))


def repaired(conversations: DataFrame) -> DataFrame:
    """conv_id, place, turn, role, action, text, rendered of ``conversations`` (conv_id, turn, role, text)."""
    spark = conversations.sparkSession
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    keys = ["conv_id", "turn", "role", "text"]
    ordered = cut(
        turns.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys)
        .withColumn("place", F.monotonically_increasing_id())
    )
    parts = ordered.select("conv_id", "place", "turn", "role", F.lit("").alias("text")).mapInArrow(
        _borders, "conv_id long, place long, costs array<long>"
    )
    borders: dict[int, tuple[int, int, bool]] = {}
    listed = sorted(parts.collect(), key=lambda r: r["place"])  # two rows a partition at most
    for _, own in groupby(listed, key=lambda r: r["conv_id"]):
        rows = list(own)
        ways = through([r["costs"] for r in rows])
        for r, (a, b) in zip(rows, ways, strict=True):
            borders[r["place"]] = (a, b, r is rows[-1])
    return ordered.mapInArrow(
        _repair(borders), "conv_id long, place long, turn long, role string, action string, text string, rendered string"
    )
