"""Conversation structure repair by secondary-sorted streaming: rows are dealt by conversation and sorted by turn,
and one pass per partition walks each conversation with a small table of best costs, carried across Arrow batches.

The roles of a repaired conversation read ``(s?(ua)+)?`` by their initials. Four states tell what may come next;
for each row and state the cheapest way there is kept, with one byte of back pointer per state. A conversation's rows
and back pointers go to the shared folder in chunks once it is long (``HELD`` bytes stay in memory), so neither the
rows nor the pointers of a giant conversation are ever in memory at once: the pointers are read backwards, chunk by
chunk, to decide the edits, then the rows forwards to apply them. One conversation stays one stream, as an edit may
depend on any earlier one; its rows meet in one task by the nature of the result, but never in one memory.

Rows without a turn come first; rows that share a turn are taken by role and text. A null role or text counts as one
blank; a null conversation id is a conversation. Empty tables give empty results.
"""
from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from stallkeeper.llm.common import Spill, packed, scratch_path

KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5  # costs; CUT is added for a truncated row that stays
CHUNK = 4096         # rows written at a time
HELD = 8 << 20       # bytes of rows that a conversation holds in memory
BLANKS = " \t\n\x0b\x0c\r"
START, S, U, A = range(4)
NEXT = {START: "user", S: "user", U: "assistant", A: "user"}
_AFTER = {"user": U, "assistant": A}
_FAR = 1 << 60


def _moves() -> dict[tuple[str, bool], list[tuple]]:
    """By initial and whether the row has to go: (from, inserts, edit, to, cost, order of the token, stays)."""
    tokens = sorted("I" * m + x for m in range(3) for x in "DKR")
    table: dict[tuple[str, bool], list[tuple]] = {}
    for initial in ("s", "u", "a", ""):
        for must_go in (False, True):
            moves = []
            for state in range(4):
                at = state
                for m in range(3):
                    if m:
                        at = _AFTER[NEXT[at]]
                    ways = [("D", at, DELETE)]
                    if not must_go:
                        ways.append(("R", _AFTER[NEXT[at]], REROLE))
                        if initial == "s" and at == START:
                            ways.append(("K", S, KEEP))
                        if initial == NEXT[at][0]:
                            ways.append(("K", _AFTER[NEXT[at]], KEEP))
                    moves += [(state, m, x, to, cost + m * INSERT, tokens.index("I" * m + x), x != "D")
                              for x, to, cost in ways]
            table[initial, must_go] = moves
    return table


MOVES = _moves()


class Walk:
    """One conversation: its faults, the cheapest costs by state, and what is needed to retrace them."""

    def __init__(self, folder: str):
        self.cost, self.rank = [0, _FAR, _FAR, _FAR], [0, 0, 0, 0]
        self.rows, self.back = [], bytearray()
        self.row_chunks, self.back_chunks = Spill(folder, HELD), Spill(folder, HELD)
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.before = None

    def add(self, turn: int | None, role: str, text: str, repeated: bool) -> None:
        if turn is not None:
            if self.high is None or turn != self.high:
                self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        initial = role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        shown = text.rstrip(BLANKS)
        blank = not shown
        repeated = repeated and not blank
        cut = not blank and not repeated and shown[-1] not in ".!?"
        self.blank += blank
        self.duplicate += repeated
        self.truncated += cut
        self._step(MOVES[initial if initial in ("s", "u", "a") else "", blank or repeated], CUT if cut else 0)
        self.rows.append((role, text))
        if len(self.rows) >= CHUNK:
            self._flush()

    def _step(self, moves: list[tuple], cut: int) -> None:
        cost, rank = self.cost, self.rank
        best: list[tuple | None] = [None] * 4
        for state, m, edit, to, price, token, stays in moves:
            total = cost[state] + price + (cut if stays else 0)
            if total < _FAR:
                way = (total, rank[state], token, state, m, edit)
                if best[to] is None or way < best[to]:
                    best[to] = way
        # Among texts of equally many tokens none begins another, so the earlier rank decides, then the token.
        order = sorted((way[1], way[2], to) for to, way in enumerate(best) if way)
        self.cost = [way[0] if way else _FAR for way in best]
        for place, (_, _, to) in enumerate(order):
            rank[to] = place
        self.back += bytes([way[3] | way[4] << 2 | "DKR".index(way[5]) << 4 if way else 0 for way in best])

    def _flush(self) -> None:
        self.row_chunks.append(pickle.dumps(self.rows, protocol=5))
        self.back_chunks.append(bytes(self.back))
        self.rows, self.back = [], bytearray()

    def finish(self) -> tuple[int, Iterator[tuple[str, str, str]]]:
        """The least cost, and (edit, role, text) in order."""
        if self.rows:
            self._flush()
        ends = [(self.cost[q] + m * INSERT, self.rank[q], q, m) for q, m in ((START, 0), (S, 2), (U, 1), (A, 0))]
        total, _, state, tail = min(ends)
        chosen = Spill(self.back_chunks.folder, HELD)
        at = state
        for i in range(len(self.back_chunks) - 1, -1, -1):
            back = self.back_chunks[i]
            codes = bytearray(len(back) // 4)
            for k in range(len(codes) - 1, -1, -1):
                codes[k] = back[4 * k + at]
                at = codes[k] & 3
            chosen.append(bytes(codes))
        return total, self._edits(chosen, tail)

    def _edits(self, chosen: Spill, tail: int) -> Iterator[tuple[str, str, str]]:
        at, n = START, len(chosen)
        for i in range(n):
            for (role, text), code in zip(pickle.loads(self.row_chunks[i]), chosen[n - 1 - i]):
                for _ in range(code >> 2 & 3):
                    yield "I", NEXT[at], ""
                    at = _AFTER[NEXT[at]]
                edit = "DKR"[code >> 4]
                if edit == "R":
                    role = NEXT[at]
                yield edit, role, text
                if edit == "R" or edit == "K" and role[0] != "s":
                    at = _AFTER[NEXT[at]]
                elif edit == "K":
                    at = S
        for _ in range(tail):
            yield "I", NEXT[at], ""
            at = _AFTER[NEXT[at]]
        for spill in (chosen, self.row_chunks, self.back_chunks):
            spill.clear()

    def gaps(self) -> int:
        return 0 if self.high is None else min(self.high - self.low + 1 - self.turns, (1 << 63) - 1)


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _out(conv_type: pa.DataType) -> pa.Schema:
    return pa.schema([("conv_id", conv_type), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()),
                      ("text", pa.string()), *((c, pa.int64()) for c in _COUNTS)])


def _repair(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = conv = None
        schema, buffer, size = None, [], 0

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*buffer), schema)], schema=schema)
            buffer.clear()
            return out

        def ended() -> Iterator[pa.RecordBatch]:
            nonlocal size
            cost, edits = walk.finish()
            buffer.append((conv, None, None, None, None, walk.gaps(), walk.blank, walk.duplicate, walk.truncated,
                           walk.illegal, cost))
            for place, (edit, role, text) in enumerate(edits):
                buffer.append((conv, place, edit, role, text, *[None] * len(_COUNTS)))
                size += len(text) + 64
                if size > 1 << 22:
                    size = 0
                    yield flush()

        for batch in batches:
            if schema is None:
                schema = _out(batch.schema.field("conv_id").type)
            for cid, gone, turn, role, text, repeated in zip(*(batch.column(c).to_pylist() for c in (
                    "conv_id", "gone", "turn", "role", "text", "repeated"))):
                if walk is None or cid != conv:
                    if walk is not None:
                        yield from ended()
                    walk, conv = Walk(folder), cid
                if not gone:
                    walk.add(turn, role, text, repeated)
        if walk is not None:
            yield from ended()
        if buffer:
            yield flush()
    return run


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults put in by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row (it stays here with
    ``gone`` set, so that its conversation is known), 1 empties its text, 2 takes its sentence ends away, 3 repeats it,
    4 makes it the user's. Columns: conv_id, gone, turn, role, text, place (struct that orders rows of one turn)."""
    r = packed(rows)
    conv, turn = F.col("row.conv_id"), F.col("row.turn").cast("bigint")
    role, text = (F.coalesce(F.col(f"row.{c}").cast("string"), F.lit(" ")) for c in ("role", "text"))
    blank_for_null = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    key = F.concat(blank_for_null(conv), F.lit(":"), blank_for_null(turn))
    code = F.col("_code")
    return (r.select(conv.alias("conv_id"), turn.alias("turn"), role.alias("_role"), text.alias("_text"),
                     (F.crc32(key) % 20).alias("_code"))
            .withColumn("_copy", F.explode(F.when(code == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
            .select("conv_id", (code == 0).alias("gone"), "turn",
                    F.when(code == 4, "user").otherwise(F.col("_role")).alias("role"),
                    F.when(code == 1, "").when(code == 2, F.regexp_replace("_text", "[.!?]", ""))
                    .otherwise(F.col("_text")).alias("text"),
                    F.struct("_role", "_text", "_copy").alias("place")))


def undamaged(rows: DataFrame) -> DataFrame:
    """The same columns for conversations as they are."""
    r = packed(rows)
    role, text = (F.coalesce(F.col(f"row.{c}").cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))
    return r.select(F.col("row.conv_id").alias("conv_id"), F.lit(False).alias("gone"),
                    F.col("row.turn").cast("bigint").alias("turn"), role, text).withColumn(
        "place", F.struct(F.col("role").alias("_role"), F.col("text").alias("_text"), F.lit(0).alias("_copy")))


def _first(order: list[Column]) -> Column:
    """Whether a row repeats role and text of an earlier row of its conversation. The window needs no exchange of its
    own: rows dealt by conversation are dealt well enough for it."""
    return F.row_number().over(W.partitionBy("conv_id", "role", "text", "gone").orderBy(*order)) > 1


def repair(rows: DataFrame) -> DataFrame:
    """Edits that make each conversation of ``damaged`` or ``undamaged`` rows regular at the least cost.

    Keep costs 0, Rerole (to user or assistant) 1, Delete 2 (a must for blank and repeated rows), Insert (an empty
    text of user or assistant) 5; a truncated row that stays adds 5. Of equally cheap ways the one whose edits read
    first by their initials is taken. One row per conversation with the counts and cost (``place`` null) and, behind
    it in the same partition, one row per edit: place, edit (initial), role and text after it (a deleted row's own).
    """
    order = [F.col("turn").asc_nulls_first(), F.col("place")]
    dealt = (rows.repartition("conv_id").withColumn("repeated", _first(order))
             .sortWithinPartitions("conv_id", *order).select("conv_id", "gone", "turn", "role", "text", "repeated"))
    kind = rows.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", kind), T.StructField("place", T.LongType()),
                           *(T.StructField(c, T.StringType()) for c in ("edit", "role", "text")),
                           *(T.StructField(c, T.LongType()) for c in _COUNTS)])
    return dealt.mapInArrow(_repair(scratch_path(rows.sparkSession)), schema)


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations themselves: conv_id, turn (from 0, no gaps), role, text."""
    return repair(rows).where("edit IN ('K', 'R', 'I')").select(
        "conv_id", (F.row_number().over(W.partitionBy("conv_id").orderBy("place")) - 1).cast("bigint").alias("turn"),
        "role", "text")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits in order, each conversation headed by its counts, as one row per conversation."""
    head, audit, sha, lines = None, [], None, 0
    schema = None

    def row() -> tuple:
        return (*head, "".join(audit), sha.hexdigest())

    for batch in batches:
        if schema is None:
            schema = pa.schema([batch.schema.field("conv_id"), *((c, pa.int64()) for c in _COUNTS),
                                ("audit", pa.string()), ("repaired_sha256", pa.string())])
        done = []
        for conv, place, edit, role, text, *counts in zip(*(c.to_pylist() for c in batch.columns)):
            if place is None:
                if head is not None:
                    done.append(row())
                head, audit, sha, lines = (conv, *counts), [], hashlib.sha256(), 0
                continue
            audit.append(edit)
            if edit != "D":
                sha.update(("\n" * (lines > 0) + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                lines += 1
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
    if head is not None:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(row()), schema)], schema=schema)


def report(rows: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, the counts and cost, audit (initials of the edits), repaired_sha256 of the
    repaired ``role:text`` lines. Read off the edits as they stream by."""
    edits = repair(rows)
    schema = T.StructType([edits.schema["conv_id"], *(T.StructField(c, T.LongType()) for c in _COUNTS),
                           T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    return edits.mapInArrow(_digest, schema)
