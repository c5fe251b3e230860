"""Conversation repair against an exhaustive plain version, and on odd rows."""
from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from stallkeeper.llm import conversations as C, queries
from stallkeeper.llm.common import Spill

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
SF = "/root/testdata/sf0.01"


def faults(rows):
    out, seen = [], set()
    for role, text in rows:
        core = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not core else "duplicate" if (role, text) in seen else
                   "truncated" if core[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows):
    """Best first over (cost, edits): the first goal met has the least cost and, of that, the least text."""
    bad = faults(rows)
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, lines = heapq.heappop(heap)
        if (i, last) in done:
            continue
        # A state is left at its first visit: cost, then edits, come out of the heap in order.
        done.add((i, last))
        if i == len(rows) and last in ("", "a"):
            return cost, audit, lines
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, last, lines))
            if bad[i] not in ("blank", "duplicate"):
                more = 5 if bad[i] == "truncated" else 0
                if role[:1] and role[0] in follow[last]:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[0], (*lines, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if new[0] in follow[last]:
                        heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, new[0], (*lines, f"{new}:{text}")))
        for new in ("user", "assistant"):
            if new[0] in follow[last]:
                heapq.heappush(heap, (cost + 5, audit + "I", i, new[0], (*lines, f"{new}:")))


def damage(rows):
    out = defaultdict(list)
    text = lambda v: " " if v is None else str(v)
    for conv, turn, role, words in rows:
        out[conv]  # known even if nothing is left
        code = zlib.crc32(f"{text(conv)}:{text(turn)}".encode()) % 20
        role, words = text(role), text(words)
        key = (turn is not None, turn or 0, role, words)
        if code == 1:
            new = (role, "")
        elif code == 2:
            new = (role, re.sub(r"[.!?]", "", words))
        elif code == 4:
            new = ("user", words)
        else:
            new = (role, words)
        out[conv] += [(key, turn, *new)] * (0 if code == 0 else 2 if code == 3 else 1)
    return {conv: [(t, r, x) for _, t, r, x in sorted(v, key=lambda z: z[0])] for conv, v in out.items()}


def plain(rows):
    result = {}
    for conv, seq in damage(rows).items():
        turns = [t for t, _, _ in seq if t is not None]
        said = [(r, x) for _, r, x in seq]
        bad = faults(said)
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(said, said[1:])]
        cost, audit, lines = cheapest(said)
        result[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, bad.count("blank"),
                        bad.count("duplicate"), bad.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs),
                        cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return result


def found(df):
    rows = df.collect()
    out = {r["conv_id"]: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    assert found(queries.op13_conversations(spark, SF)) == plain(rows)


def _random_rows(seed):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(120), None]:
        for turn in range(rng.randrange(12)):
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, 2, None]),
                         rng.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]),
                         rng.choice(["Yes.", "No!", "cut off", " \n", "", None, "é?", f"text {turn}.", f"open {turn}"])))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_random_conversations(spark, seed):
    rows = _random_rows(seed)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("gone", F.lit("clash")).withColumn("place", F.lit(1)).repartition(5)
    assert found(C.report(C.damaged(df))) == plain(rows)


def test_long_conversations_spill(spark, monkeypatch):
    monkeypatch.setattr(C, "CHUNK", 7)
    monkeypatch.setattr(C, "HELD", 100)
    rng = random.Random(9)
    said = [(rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "cut", "", "Fine!", "So?"]) * rng.randrange(3))
            for _ in range(400)]
    from stallkeeper.llm.common import scratch_path
    walk, seen = C.Walk(scratch_path(spark)), set()
    for turn, (role, text) in enumerate(said):
        walk.add(turn, role, text, (role, text) in seen)
        seen.add((role, text))
    cost, edits = walk.finish()
    assert walk.row_chunks.store is not None
    edits = list(edits)
    cost_too, audit, lines = cheapest(said)
    assert (cost, "".join(e for e, _, _ in edits)) == (cost_too, audit)
    assert tuple(f"{r}:{t}" for e, r, t in edits if e != "D") == lines


def test_spill(spark):
    from stallkeeper.llm.common import scratch_path
    spill = Spill(scratch_path(spark), 4)
    for part in (b"abc", b"defg", b"", b"h"):
        spill.append(part)
    assert [spill[i] for i in range(len(spill))] == [b"abc", b"defg", b"", b"h"]
    spill.clear()
    assert len(spill) == 0


def test_giant_conversation_and_long_text(spark):
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.concat(F.lit("line "), "id", F.lit(".")).alias("text"))
    one = found(C.report(C.undamaged(rows)))
    assert len(one) == 20_000
    assert one[5][5] == one[5][6].count("R") + 2 * one[5][6].count("D") + 5 * one[5][6].count("I")
    long = spark.createDataFrame([(1, 0, "user", "word " * 100_000 + "."), (1, 1, "assistant", "Ok.")], SCHEMA)
    assert found(C.report(C.undamaged(long)))[1][5:7] == (0, "KK")


def test_empty_table_and_repaired_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert C.report(C.damaged(none)).collect() == []
    rows = spark.createDataFrame([(1, 3, "assistant", "A."), (1, 1, "system", "S."), (1, 2, "assistant", "B.")], SCHEMA)
    out = sorted(tuple(r) for r in C.repaired(C.undamaged(rows)).collect())
    assert out == [(1, 0, "system", "S."), (1, 1, "user", "B."), (1, 2, "assistant", "A.")]
