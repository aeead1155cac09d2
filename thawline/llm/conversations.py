"""Repair of conversation structure by a run-length dynamic program.

A conversation is its rows by turn (null turns first; rows of one turn by role,
then by the SHA-256 of the text). Faults of a row, the first one counts: blank (no character but
``[\\x20\\x09-\\x0D]``), duplicate (role and text seen earlier), truncated (its last
such character is not ``[.!?]``). Edits: Keep (0), Rerole to user or assistant (1),
Delete (2; the only edit of blank and duplicate rows), Insert an empty row of user
or assistant anywhere (5); a truncated row that stays costs 5 more. The cheapest
edits that leave role initials ``(s?(ua)+)?`` are chosen, among equally cheap ones
those whose initials D, I, K, R are least as a string.

Four states say what the repaired part ends with (nothing, s, u, a), so a row is a
4 x 4 min-plus matrix that depends on its symbol only: role initial and fault.

1. Rows become symbols; equal rows are counted before any shuffle, and a text is
   represented by its SHA-256.
2. Rows are range-partitioned by (conversation, order), so that a conversation with a
   third of all rows is many blocks. A block is collapsed to runs of equal symbols;
   a run of n is advanced by the cached binary powers of its matrix.
3. A conversation inside one partition is solved there. The others exchange one matrix
   a block: products from the end give the costs behind each block, and each block is
   unrolled for its four possible entry states. A run is unrolled by halves.
4. Texts are moved once, to their conversation: the audits of the blocks come in front
   of their rows, and the repaired rows leave as they are read. The digest of a repaired
   conversation is a chain over its text, so its rows pass one task, in order and in
   bounded memory (one audit of a block and one Arrow batch).

Defined cases: null roles and texts are one space; null conversation ids are one
conversation; null turns come first and are ignored by the gaps; a role's initial
is its first character, an empty role has none and cannot be kept; a conversation
without rows has zeros, an empty audit and the digest of the empty string; an empty
table gives an empty result; extra columns are ignored; rows that repeat everything are
duplicates of the first one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored

INF = 1 << 60
#: After nothing, s, u, a: the state after writing an initial.
AFTER = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
#: The state after the only useful insertion or rerole, and its role.
TURN = (2, 2, 3, 2)
WRITTEN = ("user", "user", "assistant", "user")
#: Insertions behind the last row that make a state a legal end.
CLOSE = (0, 2, 1, 0)
INSERTED = ((0, INF, 5, 10), (INF, 0, 5, 10), (INF, INF, 0, 5), (INF, INF, 5, 0))
END = tuple(5 * n for n in CLOSE)
#: Symbols: 0 has to go; 1-4 are the initials, 5-8 the same truncated.
INITIALS = "sua"
#: Solved run lists and unrolled runs that a task remembers, and the longest such run.
CACHE, SHORT = 100_000, 64

BLOCK = ("conv_id long, known boolean, turn long, role string, digest binary, blank long, duplicate long, truncated long, "
         "block long, symbols binary, lengths array<long>, matrix array<long>, audits array<string>, exits array<int>")
REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
ROWS = "conv_id long, place long, role string, text string, edit string"


# ------------------------------------------------------------------ min-plus algebra
def _times(a: tuple, b: tuple) -> tuple:
    return tuple(tuple(min(INF, min(x + b[k][j] for k, x in enumerate(row))) for j in range(4)) for row in a)


def _apply(a: tuple, v: tuple) -> tuple:
    return tuple(min(INF, min(x + y for x, y in zip(row, v))) for row in a)


def _edits(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(initial, cost, next state) of the edits of one row, least initial first."""
    out = [("D", 2, state)]
    if symbol:
        more, initial = (5 if symbol > 4 else 0), (INITIALS + "-")[(symbol - 1) % 4]
        if initial in AFTER and AFTER[initial][state] is not None:
            out.append(("K", more, AFTER[initial][state]))
        out.append(("R", 1 + more, TURN[state]))
    return out


class Solver:
    """Powers of the symbols' matrices and remembered unrolled runs."""

    def __init__(self) -> None:
        self.powers: list[list[tuple]] = []
        for symbol in range(9):
            one = [[INF] * 4 for _ in range(4)]
            for state in range(4):
                for _, cost, after in _edits(symbol, state):
                    one[state][after] = min(one[state][after], cost)
            self.powers.append([_times(INSERTED, tuple(map(tuple, one)))])
        self.known: dict = {}
        self.solved: dict = {}

    def _bits(self, symbol: int, n: int) -> Iterator[tuple]:
        powers, k = self.powers[symbol], 0
        while n:
            if k == len(powers):
                powers.append(_times(powers[-1], powers[-1]))
            if n & 1:
                yield powers[k]
            n, k = n >> 1, k + 1

    def before(self, symbol: int, n: int, after: tuple) -> tuple:
        """Costs in front of a run from those behind it."""
        for power in self._bits(symbol, n):
            after = _apply(power, after)
        return after

    def matrix(self, runs: list[tuple[int, int]]) -> tuple:
        out = tuple(tuple(0 if i == j else INF for j in range(4)) for i in range(4))
        for symbol, n in runs:
            for power in self._bits(symbol, n):
                out = _times(out, power)
        return out

    def unroll(self, symbol: int, n: int, state: int, after: tuple) -> tuple[str, int]:
        """The least audit of a run from ``state``, and the state behind it."""
        least = min(after)
        key = (symbol, n, state, tuple(x - least if x < INF else INF for x in after))
        if key in self.known:
            return self.known[key]
        if n == 1:
            here, audit, found = _apply(self.powers[symbol][0], after), "", None
            while found is None:
                choices = [(e, after[s] + c, s) for e, c, s in _edits(symbol, state)] + [("I", 5 + here[TURN[state]], None)]
                edit, _, found = next(x for x in sorted(choices, key=lambda x: x[0]) if x[1] == here[state])
                audit += edit
                state = TURN[state] if found is None else found
            out = audit, found
        else:
            half = n // 2
            head, state = self.unroll(symbol, half, state, self.before(symbol, n - half, after))
            tail, state = self.unroll(symbol, n - half, state, after)
            out = head + tail, state
        if n <= SHORT:
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[key] = out
        return out

    def audit(self, runs: tuple[tuple[int, int], ...], state: int = 0, after: tuple = END) -> tuple[str, int]:
        key = (runs, state, after) if len(runs) <= SHORT else None
        if key in self.solved:
            return self.solved[key]
        costs = [after]
        for symbol, n in reversed(runs[1:]):
            costs.append(self.before(symbol, n, costs[-1]))
        parts = []
        for (symbol, n), behind in zip(runs, reversed(costs)):
            part, state = self.unroll(symbol, n, state, behind)
            parts.append(part)
        out = "".join(parts), state
        if key is not None:
            if len(self.solved) >= CACHE:
                self.solved.clear()
            self.solved[key] = out
        return out


# ------------------------------------------------------------------ blocks of rows
class _Block:
    def __init__(self, head: tuple) -> None:
        self.head, self.runs, self.counts = head, [], [0, 0, 0]

    def add(self, symbol: int, n: int) -> None:
        if self.runs and self.runs[-1][0] == symbol:
            self.runs[-1][1] += n
        else:
            self.runs.append([symbol, n])

    def take(self, n: int, role: str, fault: int, seen: bool) -> None:
        if not n:
            return
        if fault == 2:
            self.counts[0] += n
            self.add(0, n)
            return
        self.counts[1] += n if seen else n - 1
        self.counts[2] += fault == 1 and not seen
        if not seen:
            at = INITIALS.find(role[0]) if role else -1
            self.add((at if at >= 0 else 3) + 1 + (4 if fault else 0), 1)
        if seen or n > 1:
            self.add(0, n if seen else n - 1)


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of one range partition to blocks; the first and the last conversation may go on elsewhere."""
    names = [c.split(" ")[0] for c in BLOCK.split(", ")]
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(),
             pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32())]
    solver, part = Solver(), TaskContext.get().partitionId()
    out, block, closed = [], None, 0

    def close(b: _Block, number: int | None) -> None:
        runs = tuple(map(tuple, b.runs))
        if number is None:
            audit, state = solver.audit(runs)
            out.append((*b.head, *b.counts, None, None, None, None, [audit], [state]))
        else:
            out.append((*b.head, *b.counts, number, bytes(s for s, _ in runs), [n for _, n in runs], [x for row in solver.matrix(runs) for x in row], None, None))

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out)) or [[]] * len(names)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(columns, types)], names=names)
    for rows in batches:
        columns = [rows.column(c).to_pylist() for c in ("conv_id", "known", "turn", "role", "digest", "n", "fault", "seen")]
        for *head, n, fault, seen in zip(*columns):
            if block is None or head[0] != block.head[0]:
                if block is not None:
                    close(block, None if closed else 2 * part)
                    closed += 1
                block = _Block(tuple(head))
            block.take(n, head[3], fault, seen)
        yield batch()
    if block is not None:
        close(block, 2 * part + 1 if closed else 2 * part)
    yield batch()


def _behind(blocks: pd.DataFrame) -> pd.DataFrame:
    """Costs behind each block of one conversation."""
    after, out = END, []
    for b in blocks.sort_values("block", ascending=False).itertuples(index=False):
        out.append((b.block, list(after)))
        after = _apply(tuple(tuple(b.matrix[4 * k:4 * k + 4].tolist()) for k in range(4)), after)
    return pd.DataFrame(out, columns=["block", "after"])


def _unrolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audits and exits of the blocks for each entry state."""
    solver = Solver()
    for rows in batches:
        audits, exits = [], []
        for symbols, lengths, after in zip(*(rows.column(c).to_pylist() for c in ("symbols", "lengths", "after"))):
            found = [solver.audit(tuple(zip(symbols, lengths)), state, tuple(after)) for state in range(4)]
            audits.append([a for a, _ in found])
            exits.append([s for _, s in found])
        yield pa.RecordBatch.from_arrays([rows.column("block"), pa.array(audits, type=pa.list_(pa.string())), pa.array(exits, type=pa.list_(pa.int32()))],
                                         names=["block", "audits", "exits"])


# ------------------------------------------------------------------ repaired rows
class _Repair:
    """One conversation, read in order."""

    def __init__(self, conv_id: int | None, sink) -> None:
        self.conv_id, self.sink = conv_id, sink
        self.state, self.entry, self.queue, self.at = 0, 0, "", 0
        self.audit, self.cost, self.counts, self.illegal = [], 0, [0, 0, 0], 0
        self.last, self.turns, self.low, self.high = None, 0, None, None

    def block(self, audits: list[str], exits: list[int], counts: list[int]) -> None:
        k = self.entry if len(audits) > 1 else 0
        self.queue, self.at, self.entry = audits[k], 0, exits[k]
        self.audit.append(audits[k])
        self.counts = [a + b for a, b in zip(self.counts, counts)]

    def write(self, edit: str, role: str, text: str) -> None:
        self.sink(self.conv_id, role, text, edit)

    def insert(self) -> None:
        self.cost += 5
        self.write("I", WRITTEN[self.state], "")
        self.state = TURN[self.state]

    def row(self, turn: int | None, role: str, text: str, n: int, fault: int) -> None:
        initial = role[:1]
        self.illegal += n - 1 + (self.last is not None and self.last + initial not in ("su", "ua", "au"))
        self.last = initial
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        for _ in range(n):
            while self.queue[self.at] == "I":
                self.insert()
                self.at += 1
            edit = self.queue[self.at]
            self.at += 1
            self.cost += {"D": 2, "K": 0, "R": 1}[edit] + (5 if fault and edit != "D" else 0)
            if edit == "K":
                self.write("K", role, text)
                self.state = AFTER[initial][self.state]
            elif edit == "R":
                self.write("R", WRITTEN[self.state], text)
                self.state = TURN[self.state]

    def end(self) -> tuple:
        for _ in range(CLOSE[self.state]):
            self.insert()
            self.audit.append("I")
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv_id, gaps, *self.counts, self.illegal, self.cost, "".join(self.audit)


def _stream(emit_rows: bool):
    """Audits and rows of whole conversations, sorted, to reports or to repaired rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in (ROWS if emit_rows else REPORT).split(", ")]
        types = ([pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()] if emit_rows
                 else [*[pa.int64()] * 7, pa.string(), pa.string()])
        out, now, digest, place = [], None, None, 0

        def sink(conv_id, role, text, edit):
            nonlocal place
            if emit_rows:
                out.append((conv_id, place, role, text, edit))
            else:
                digest.update((("\n" if place else "") + role + ":" + text).encode())
            place += 1

        def close():
            line = now.end()
            if not emit_rows:
                out.append((*line, digest.hexdigest()))

        def batch():
            columns = list(zip(*out)) or [[]] * len(names)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(columns, types)], names=names)
        wanted = ("conv_id", "turn", "role", "text", "n", "fault", "audits", "exits", "blank", "duplicate", "truncated")
        for rows in batches:
            for conv_id, turn, role, text, n, fault, audits, exits, *counts in zip(*(rows.column(c).to_pylist() for c in wanted)):
                if now is None or conv_id != now.conv_id:
                    if now is not None:
                        close()
                    now, digest, place = _Repair(conv_id, sink), hashlib.sha256(), 0
                if audits is not None:
                    now.block(audits, exits, counts)
                else:
                    now.row(turn, role, text, n, fault)
            yield batch()
        if now is not None:
            close()
        yield batch()
    return run


# ------------------------------------------------------------------ the operator
def damaged(rows: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) with planted faults, drawn by crc32 of ``conv_id:turn``: of 20 draws, 0 drops
    the row, 1 empties its text, 2 removes its ``[.!?]``, 3 repeats it, 4 makes its role user; ``copies`` says how often it stands there."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(draw == 1, F.lit("")).when(draw == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    return rows.select("conv_id", "turn", F.when(draw == 4, F.lit("user")).otherwise(blank("role")).alias("role"), text.alias("text"),
                       F.when(draw == 0, 0).when(draw == 3, 2).otherwise(1).alias("copies"))


def _keyed(rows: DataFrame, copies: str | None) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = (F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), 2).when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), 1).otherwise(0))
    n = F.col(copies).cast("long") if copies else F.lit(1).cast("long")
    return (rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").isNotNull().alias("known"), F.col("turn").cast("long").alias("turn"),
                        blank("role").alias("role"), blank("text").alias("text"), n.alias("n"))
            .select("conv_id", "known", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), "text", "n", fault.alias("fault")))


ORDER = ["conv_id", "known", "turn", "role", "digest"]


def _audited(rows: DataFrame) -> DataFrame:
    """Blocks with audits for one or four entry states."""
    keys = stored(rows.groupBy(*ORDER).agg(F.sum("n").alias("n"), F.min("fault").alias("fault")), "turns")
    here = F.struct("known", "turn")
    first = (keys.filter("n > 0 and fault < 2").groupBy("conv_id", "role", "digest").agg(F.count("*").alias("m"), F.min(here).alias("first"))
             .filter("m > 1").drop("m"))
    same: Column = F.expr("k.conv_id <=> f.conv_id and k.role = f.role and k.digest = f.digest")
    marked = keys.alias("k").join(first.alias("f"), same, "left").select("k.*", F.expr("f.first is not null and struct(k.known, k.turn) > f.first").alias("seen"))
    ordered = marked.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    blocks = stored(ordered.mapInArrow(_collapse, BLOCK), "blocks")
    parted = blocks.filter("block is not null")
    behind = parted.select("conv_id", "block", "matrix").groupBy("conv_id").applyInPandas(_behind, "block long, after array<long>")
    found = parted.select("block", "symbols", "lengths").join(behind, "block").mapInArrow(_unrolled, "block long, audits array<string>, exits array<int>")
    return blocks.filter("block is null").unionByName(parted.drop("audits", "exits").join(found, "block"))


def _streamed(rows: DataFrame, copies: str | None, emit_rows: bool) -> DataFrame:
    small_batches(rows.sparkSession)
    keyed = _keyed(rows, copies)
    blocks = _audited(keyed).select(*ORDER, F.lit(0).alias("tag"), F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("fault"),
                                    "audits", "exits", "blank", "duplicate", "truncated")
    none = {"audits": "array<string>", "exits": "array<int>", "blank": "long", "duplicate": "long", "truncated": "long"}
    texts = keyed.filter("n > 0").select(*ORDER, F.lit(1).alias("tag"), "text", "n", "fault", *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    both = blocks.unionByName(texts).repartition("conv_id").sortWithinPartitions(*ORDER, "tag")
    return both.mapInArrow(_stream(emit_rows), ROWS if emit_rows else REPORT)


def repaired(rows: DataFrame, copies: str | None = None) -> DataFrame:
    """The repaired conversations: (conv_id, place, role, text, edit), edit K, R or I.

    ``copies`` names a column that says how often a row stands there; 0 keeps only its conversation's id."""
    return _streamed(rows, copies, True)


def report(rows: DataFrame, copies: str | None = None) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    return _streamed(rows, copies, False)
