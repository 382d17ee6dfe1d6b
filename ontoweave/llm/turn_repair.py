"""Repair of conversation structure by generalised LR parsing with weighted edits.

The role grammar is  C -> empty | P T,  P -> empty | s,  T -> u a | T u a  over the initials of system, user and assistant.
Stacks are a graph: tops share the nodes below them, and all derivations that reach one top after the same rows are
merged into the one with the least (cost, audit). At each row a top goes on by keeping, reroling or deleting the row, and
between rows by inserting a turn; the audit is the edits' initials in order.

Conversations are streamed, sorted, through a task: what is held is one frontier of at most five tops, each with the
SHA-256 state of its repaired text, so a conversation of any length needs memory for its audit alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

# The LR automaton. States: 0 start, 1 after P, 2 after P u, 3 after P T, 4 after P T u; 5 to 7 are reduced at once.
SHIFT = {(0, "s"): 7, (1, "u"): 2, (2, "a"): 5, (3, "u"): 4, (4, "a"): 6}
#: state: (symbol, number of nodes popped). The empty P is reduced in state 0 when a user turn follows.
REDUCE = {5: ("T", 2), 6: ("T", 3), 7: ("P", 1)}
EMPTY = {(0, "u"): "P"}
GOTO = {(0, "P"): 1, (1, "T"): 3}
ACCEPT = (0, 3)
NAMES = {"u": "user", "a": "assistant"}
PIECE = 4096


class Stack(NamedTuple):
    """A node of the stack graph: an LR state on the node below it."""

    state: int
    below: Stack | None


BOTTOM = Stack(0, None)


def advance(stack: Stack, symbol: str) -> Stack | None:
    """The stack after a turn of this initial, all reductions done; None where the grammar allows no such turn."""
    while (empty := EMPTY.get((stack.state, symbol))) is not None:
        stack = Stack(GOTO[stack.state, empty], stack)
    to = SHIFT.get((stack.state, symbol))
    if to is None:
        return None
    stack = Stack(to, stack)
    while stack.state in REDUCE:
        name, popped = REDUCE[stack.state]
        for _ in range(popped):
            stack = stack.below
        stack = Stack(GOTO[stack.state, name], stack)
    return stack


#: Tops are few and their stacks are determined by them, so each step is worked out once.
STEPS: dict[tuple[int, str], Stack | None] = {}


def step(stack: Stack, symbol: str) -> Stack | None:
    if (stack.state, symbol) not in STEPS:
        STEPS[stack.state, symbol] = advance(stack, symbol)
    return STEPS[stack.state, symbol]


class Path(NamedTuple):
    """The best derivation of a top: its cost and audit, and the hash of the turns that it leaves.

    The audit is ``piece``, after the pieces in ``before``. Audits compare as (rank, since): ``rank`` orders their parts up
    to the last ranking, ``since`` is what came after.
    """

    cost: int
    rank: int
    since: str
    before: tuple | None
    piece: str
    turns: int
    digest: object

    def key(self) -> tuple:
        return self.cost, self.rank, self.since


def extended(path: Path, letter: str, cost: int, turn: bytes | None) -> Path:
    before, piece = (path.before, path.piece) if len(path.piece) < PIECE else ((path.before, path.piece), "")
    if turn is None:
        return Path(path.cost + cost, path.rank, path.since + letter, before, piece + letter, path.turns, path.digest)
    digest = path.digest.copy()
    digest.update(b"\n" + turn if path.turns else turn)
    return Path(path.cost + cost, path.rank, path.since + letter, before, piece + letter, path.turns + 1, digest)


def ranked(frontier: dict[Stack, Path]) -> dict[Stack, Path]:
    """The same frontier with short ``since``: an audit that continues another one keeps that one's rank and its own rest."""
    order = sorted({(p.rank, p.since) for p in frontier.values()})
    at: dict[tuple[int, str], tuple[int, str]] = {}
    root, number = None, -1
    for rank, since in order:
        if root is None or rank != root[0] or not since.startswith(root[1]):
            root, number = (rank, since), number + 1
        at[rank, since] = (number, since[len(root[1]) :])
    return {s: p._replace(rank=at[p.rank, p.since][0], since=at[p.rank, p.since][1]) for s, p in frontier.items()}


class Weights(NamedTuple):
    keep: int = 0
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


class Parser:
    """The frontier of one conversation."""

    def __init__(self, weights: Weights = Weights()):
        self.weights = weights
        self.frontier = {BOTTOM: Path(0, 0, "", None, "", 0, hashlib.sha256())}
        self._insert()

    def _offer(self, found: dict, stack: Stack | None, path: Path, letter: str, cost: int, turn: bytes | None) -> None:
        """Merges an edit into the tops found so far; the text is hashed only for edits that stand."""
        if stack is None:
            return
        other = found.get(stack)
        if other is None or (path.cost + cost, path.rank, path.since + letter) < other[0]:
            found[stack] = ((path.cost + cost, path.rank, path.since + letter), path, letter, cost, turn)

    def _settled(self, found: dict) -> dict[Stack, Path]:
        return {s: extended(path, letter, cost, turn) for s, (_, path, letter, cost, turn) in found.items()}

    def _insert(self) -> None:
        """Adds what inserted turns lead to. Each inserts at a positive cost, so a top is final once no cheaper one is open."""
        open_, done = dict(self.frontier), {}
        while open_:
            stack = min(open_, key=lambda s: open_[s].key())
            path = done[stack] = open_.pop(stack)
            for symbol, name in NAMES.items():
                to = step(stack, symbol)
                if to is not None and to not in done:
                    key = (path.cost + self.weights.insert, path.rank, path.since + "I")
                    if to not in open_ or key < open_[to].key():
                        open_[to] = extended(path, "I", self.weights.insert, f"{name}:".encode())
        self.frontier = done

    def row(self, role: bytes, text: bytes, fault: str | None) -> None:
        w, found = self.weights, {}
        initial, worse = role[:1].decode("ascii", "replace"), w.truncated if fault == "truncated" else 0
        for stack, path in self.frontier.items():
            self._offer(found, stack, path, "D", w.delete, None)
            if fault in ("blank", "duplicate"):
                continue
            self._offer(found, step(stack, initial), path, "K", w.keep + worse, role + b":" + text)
            for symbol, name in NAMES.items():
                if symbol != initial:
                    self._offer(found, step(stack, symbol), path, "R", w.rerole + worse, name.encode() + b":" + text)
        self.frontier = self._settled(found)
        self._insert()
        if any(len(p.since) > 32 for p in self.frontier.values()):
            self.frontier = ranked(self.frontier)

    def best(self) -> tuple[int, str, str]:
        """(cost, audit, hash of the repaired turns)."""
        path = min((p for s, p in self.frontier.items() if s.state in ACCEPT), key=Path.key)
        pieces, before = [path.piece], path.before
        while before:
            before, piece = before
            pieces.append(piece)
        return path.cost, "".join(reversed(pieces)), path.digest.hexdigest()


LEGAL = (b"su", b"ua", b"au")


class Conversation:
    """Counts and parse of the rows of one conversation, as they come."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.parser = conv_id, Parser()
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.turns, self.least, self.most, self.last_turn = 0, None, None, None
        self.illegal, self.last = 0, None

    def add(self, turn: int | None, role: bytes, text: bytes, fault: str | None) -> None:
        if turn is not None:
            self.turns += turn != self.last_turn or self.least is None
            self.least, self.most, self.last_turn = turn if self.least is None else self.least, turn, turn
        if fault:
            self.counts[fault] += 1
        initial = first_character(role)
        if self.last is not None:
            self.illegal += self.last + initial not in LEGAL
        self.last = initial
        self.parser.row(role, text, fault)

    def result(self) -> tuple:
        cost, audit, digest = self.parser.best()
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return (self.conv_id, gaps, *self.counts.values(), self.illegal, cost, audit, digest)


def first_character(role: bytes) -> bytes:
    """The first character of a UTF-8 text."""
    n = 1
    while n < len(role) and role[n] & 0xC0 == 0x80:
        n += 1
    return role[:n]


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of rows (conv_id, turn, role, text, gone).

    Rows that are ``gone`` only keep their conversation in the result. Null roles and texts count as one space; rows of
    equal turn are ordered by role and text, so repeated rows are neighbours; rows with a null conv_id form one conversation;
    other columns are left out; no rows give no row. One shuffle by conversation serves the search for repeated rows (sorted
    by digest), the order of turns and the stream.
    """
    space = lambda c: F.coalesce(c, F.lit(" "))
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), space(F.col("role")).alias("role"), space(F.col("text")).alias("text"), "gone")
    rows = rows.withColumn("same", F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)).repartition("conv_id")
    earlier = Window.partitionBy("conv_id", "gone", "same").orderBy(F.asc_nulls_first("turn"))
    rows = rows.withColumn("fault", first_fault(F.col("text"), F.row_number().over(earlier) > 1)).drop("same")
    rows = rows.sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (c.split() for c in RESULT.split(", "))])
        current, started, out = None, False, []
        for batch in batches:
            for conv_id, turn, role, text, gone, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not started or conv_id != current.conv_id:
                    if started:
                        out.append(current.result())
                    current, started = Conversation(conv_id), True
                if not gone:
                    current.add(turn, role, text, fault)
            if len(out) >= 256:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), types, strict=True)], schema=types)
                out = []
        if started:
            out.append(current.result())
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), types, strict=True)], schema=types)

    return rows.select("conv_id", "turn", F.col("role").cast("binary"), F.col("text").cast("binary"), "gone", "fault").mapInArrow(run, RESULT)


def first_fault(text: Column, repeated: Column) -> Column:
    visible = r"[^\x20\x09-\x0D]"
    return (
        F.when(~text.rlike(visible), "blank").when(repeated, "duplicate")
        .when(~text.rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
    )


def damaged(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) damaged by the checksum of their place, as (conv_id, turn, role, text, gone).

    Of twenty residues 0 drops a row, 1 empties its text, 2 removes its stops, 3 repeats it, 4 gives it to the user.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")), F.lit(20))
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), times.alias("time")).drop("time")


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged(table(spark, sf_dir, "conversations")))
