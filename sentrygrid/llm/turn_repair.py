"""Conversation structure repair by a dynamic program over retained turns (operator 11).

A conversation's turns are edited, at least cost, until the initials of their roles read ``(s?(ua)+)?``: a turn is
kept, gets another role or is deleted, and empty turns are inserted.  The program chooses the *retained* turns only:

* ``best[q]`` is the running minimum, over the turns behind the current one, of the cost of retaining such a turn in
  state q (s, u or a) and of all that follows it, less the prefix sum of deletions up to it.  With the current prefix sum
  it prices the gap between the current turn and the next retained one in one step;
* the states at both ends of a gap say which turns must be inserted into it (``INSERTS``);
* of equal costs the audit least in ASCII wins (D < I < K < R), which is the longer gap, then the one with more
  insertions, then the kept turn: audits differ at that letter, so they need not be compared as strings.

Turns travel once, to one partition a conversation.  There Spark sorts them, on disk where they are many; one Arrow
pass from the last turn to the first writes beside each turn which retained turn follows it, and one from the first to
the last follows these.  Both hold a few numbers a conversation, however long it is.  A digest of a whole conversation
is one stream, so the work of one task, in bounded memory; texts, faults and duplicates are found before, by columns.

Defined results: null roles and texts are one space; null turns come first, rows of the same turn follow by role and
text; rows without an id are one conversation; a conversation of which no row is left has an empty audit; repeated
rows are duplicates; very long texts are hashed as they pass; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Costs of the edits, and what an undeleted truncated turn adds.
REROLE, DELETE, INSERT, UNFINISHED = 1, 2, 5, 5
START, S, U, A, END = range(5)
ROLE = {U: "user", A: "assistant"}
#: Turns that must be inserted between two retained states; states that are not here cannot follow each other.
INSERTS = {
    (START, S): [], (START, U): [], (START, A): [U], (START, END): [],
    (S, U): [], (S, A): [U], (S, END): [U, A],
    (U, A): [], (U, U): [A], (U, END): [A],
    (A, U): [], (A, A): [U], (A, END): [],
}
#: A turn's first fault.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
NOT_WS = r"[^\x20\x09-\x0D]"


# ---------------------------------------------------------------- by columns
def turns_of(rows: DataFrame) -> DataFrame:
    """Only what the operator uses: extra columns, whatever their names, never meet its own."""
    space = lambda c: F.coalesce(rows[c].cast("string"), F.lit(" ")).alias(c)
    return rows.select(rows["conv_id"], rows["turn"].cast("long").alias("turn"), space("role"), space("text"), F.lit(False).alias("gone"))


def damage(rows: DataFrame) -> DataFrame:
    """Turns damaged by a checksum of ``conv_id:turn``; those that it drops stay, marked ``gone``, so that no conversation is lost."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    turns = turns_of(rows).withColumn("fate", F.pmod(F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")), F.lit(20)))
    fate = F.col("fate")
    text = F.when(fate == 1, "").when(fate == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(fate == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(fate == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), (fate == 0).alias("gone"), times).drop("copy")


def _state(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first == "s", S).when(first == "u", U).when(first == "a", A).otherwise(START)


def with_faults(turns: DataFrame) -> DataFrame:
    """Each turn's first fault; all turns of a conversation in one partition, so that window and sorts need no further exchange."""
    last = F.regexp_extract("text", rf"({NOT_WS})[\x20\x09-\x0D]*\z", 1)
    flagged = turns.withColumn("blank", ~F.col("text").rlike(NOT_WS)).withColumn("open", ~last.isin(".", "!", "?")).withColumn("digest", F.sha2("text", 256))
    seen = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "digest").orderBy("turn"))
    fault = F.when(F.col("blank"), BLANK).when(seen > 1, DUPLICATE).when(F.col("open"), TRUNCATED).otherwise(SOUND)
    return flagged.repartition("conv_id").select("conv_id", "turn", "role", "text", "gone", _state(F.col("role")).alias("state"), fault.alias("fault"))


# ---------------------------------------------------------------- the program, from the last turn to the first
class Option(NamedTuple):
    """What may follow; the least one is taken."""

    cost: int
    row: int  # turns behind it; -1 for the end: the later one leaves the longer gap
    inserts: int  # negative: the more, the less in ASCII
    letter: str
    state: int


class Program:
    """One conversation's running minima over the turns seen so far, the last turn first."""

    def __init__(self) -> None:
        self.rows = 0
        self.best = {END: (0, -1, "")}  # state -> cost less deletions up to that turn, turns behind it, letter

    def following(self, state: int) -> Option:
        deleted = DELETE * self.rows
        return min(Option(cost + deleted + INSERT * len(INSERTS[state, q]), row, -len(INSERTS[state, q]), letter, q) for q, (cost, row, letter) in self.best.items() if (state, q) in INSERTS)

    def add(self, initial: int, fault: int) -> list[int]:
        """Take the turn in front of those seen; returns the codes of what follows it retained as s, u and a, and of the start if it is the first turn."""
        nexts = {q: self.following(q) for q in (S, U, A)}
        if fault not in (BLANK, DUPLICATE):
            for q, then in nexts.items():
                if q == initial or q in ROLE:
                    cost = then.cost + (0 if q == initial else REROLE) + UNFINISHED * (fault == TRUNCATED) - DELETE * (self.rows + 1)
                    if q not in self.best or cost < self.best[q][0]:
                        self.best[q] = (cost, self.rows, "K" if q == initial else "R")
        self.rows += 1
        return [o.row * 8 + o.state for o in (*nexts.values(), self.following(START))]


CODES = ["place", "after_s", "after_u", "after_a", "first"]


def _backward(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    program, conversation = Program(), object()
    for batch in batches:
        out = []
        for conv, gone, state, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "gone", "state", "fault")), strict=True):
            if conv != conversation:
                program, conversation = Program(), conv
            out.append([-2] * 5 if gone else [program.rows, *program.add(state, fault)])
        columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 5
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *CODES])


# ---------------------------------------------------------------- from the first turn to the last
class Edit(NamedTuple):
    conv_id: object
    turn: int | None
    role: str
    text: str
    edit: str  # K, R, D or I; empty for a row that had gone before
    fault: int
    state: int  # of the role before the edit
    was: str  # the role before the edit


def _edits(batches: Iterable[pa.RecordBatch]) -> Iterator[Edit]:
    """Follow the choices of ``_backward``."""
    conversation, state, target, goal = object(), START, -2, START

    def inserted() -> Iterator[Edit]:
        for q in INSERTS[state, goal]:
            yield Edit(conversation, None, ROLE[q], "", "I", SOUND, q, ROLE[q])

    for batch in batches:
        names = ["conv_id", "turn", "role", "text", "gone", "state", "fault", *CODES]
        for conv, turn, role, text, gone, initial, fault, place, *after in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if conv != conversation:
                if target == -1:
                    yield from inserted()
                conversation, state, target, goal = conv, START, -2, START
            if gone:
                yield Edit(conv, turn, role, text, "", fault, initial, role)
                continue
            if target == -2:
                target, goal = divmod(after[3], 8)
            if place != target:
                yield Edit(conv, turn, role, text, "D", fault, initial, role)
                continue
            yield from inserted()
            kept = goal == initial
            yield Edit(conv, turn, role if kept else ROLE[goal], text, "K" if kept else "R", fault, initial, role)
            state = goal
            target, goal = divmod(after[state - S], 8)
    if target == -1:
        yield from inserted()


def _planned(turns: DataFrame) -> DataFrame:
    order = [F.col("conv_id"), F.desc_nulls_last("turn"), F.desc("role"), F.desc("text")]
    found = with_faults(turns)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in found.schema.fields)}, {', '.join(f'{c} long' for c in CODES)}"
    planned = found.sortWithinPartitions(*order).mapInArrow(_backward, schema)
    return planned.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")


def repair(turns: DataFrame) -> DataFrame:
    """All turns (as of ``turns_of`` or ``damage``) with their edits, inserted ones among them: ``position`` numbers what a conversation keeps; deleted turns have none."""
    kind = turns.schema["conv_id"].dataType

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, conversation, position = [], object(), 0
        names = ["conv_id", "position", "turn", "role", "text", "edit", "fault"]
        types = [arrow_kind, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32()]
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        held = 0
        for e in _edits(batches):
            if e.conv_id != conversation:
                conversation, position = e.conv_id, 0
            if e.edit:
                stays = e.edit != "D"
                rows.append((e.conv_id, position if stays else None, e.turn, e.role, e.text, e.edit, e.fault))
                position, held = position + stays, held + len(e.text)
                if len(rows) >= 5000 or held > 8 << 20:
                    yield made()
                    rows, held = [], 0
        if rows:
            yield made()

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_kind = to_arrow_type(kind)
    return _planned(turns).mapInArrow(run, f"conv_id {kind.simpleString()}, position long, turn long, role string, text string, edit string, fault int")


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
LEGAL = {(S, U), (U, A), (A, U)}


class _Report:
    def __init__(self) -> None:
        self.faults, self.illegal, self.cost, self.audit, self.sha, self.lines = [0] * 4, 0, 0, [], hashlib.sha256(), 0
        self.low = self.high = self.turn = self.before = None
        self.turns = 0

    def add(self, e: Edit) -> None:
        if not e.edit:
            return
        self.audit.append(e.edit)
        self.cost += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[e.edit]
        if e.edit != "I":
            self.faults[e.fault] += 1
            self.cost += UNFINISHED * (e.fault == TRUNCATED and e.edit != "D")
            self.illegal += self.before is not None and (self.before, e.state) not in LEGAL
            self.before = e.state
            if e.turn is not None:
                self.low, self.high, self.turns = e.turn if self.low is None else self.low, e.turn, self.turns + (e.turn != self.turn)
                self.turn = e.turn
        if e.edit != "D":
            self.sha.update(f"{chr(10) if self.lines else ''}{e.role}:{e.text}".encode())
            self.lines += 1

    def row(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest())


def report(turns: DataFrame) -> DataFrame:
    """One row a conversation: its gaps and faults, the cost of the cheapest repair, its audit, and the digest of what is left."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = turns.schema["conv_id"].dataType
    arrow_kind = to_arrow_type(kind)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", *(x.split()[0] for x in REPORT.split(", "))]
        types = [arrow_kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        rows: list[tuple] = []
        conversation, now = None, None
        for e in _edits(batches):
            if now is None or e.conv_id != conversation:
                if now is not None:
                    rows.append((conversation, *now.row()))
                    if len(rows) >= 2000:
                        yield made()
                        rows = []
                conversation, now = e.conv_id, _Report()
            now.add(e)
        if now is not None:
            rows.append((conversation, *now.row()))
            yield made()

    return _planned(turns).mapInArrow(run, f"conv_id {kind.simpleString()}, {REPORT}")
