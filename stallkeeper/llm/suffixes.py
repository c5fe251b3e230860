"""Suffix-array dedup by external induced sorting: every byte covered by a string of ``LENGTH`` bytes that starts
somewhere else too is removed.

Equal strings of ``LENGTH`` bytes have the same least gram of ``GRAM`` bytes at the same place, so the windows of a
text are grouped by that gram, the anchor, and only windows of one anchor group need a common order. A group is a
part of the suffix array of its own; groups are the shards, dealt to tasks by anchor. What is sorted is one piece of
text per distinct surrounding of an anchor, with the number of its copies; anchors that occur once send nothing.

Sorting is induced. The suffixes that begin at anchors take the part of the sampled suffixes: Spark's external sorter
orders them, and neighbours are compared for their common prefix. From the order of all suffixes at distance o before
their anchors, the order at distance o + 1 follows by dealing them to the lane of the byte before them, first come
first served; the common prefix of two neighbours in a lane is one more than the least met between them. The lanes are
the priority queue: tuples carry the bytes still to come, the common prefix and the marks found so far, so nothing is
looked up anywhere, and lanes go to the shared folder beyond ``HELD`` bytes. Two neighbours with a common prefix of
``LENGTH`` bytes are equal windows.

A group of more than ``CROWD`` pieces is not sorted as one: its windows are halved by their distance to the anchor,
and each half is grouped anew by all bytes its windows must share, which is more than the anchor. That ends with
windows of one distance, grouped by the whole window, which are only counted.

Texts are taken as UTF-8 bytes, whole, and matches stay inside one row. A null text is empty; texts shorter than a
window stay as they are. Equal rows are copies of each other whatever their ids. Texts and pieces are named by two
64-bit hashes; equal names are taken as equal texts. Empty tables give empty results.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from stallkeeper.llm.common import Spill, packed, scratch_path, stored
from stallkeeper.llm.lines import SIEVE, sieve

LENGTH = 200         # bytes of a string that must not repeat
GRAM = 48            # bytes of an anchor
REACH = LENGTH - GRAM + 1  # distances of a window from its anchor: 0 to REACH - 1
BLOCK = 1 << 20      # bytes hashed at a time
CROWD = 1 << 14      # pieces of a group that are sorted as one
ROWS = 1 << 15       # tuples taken from the queue at a time
HELD = 96 << 20      # bytes of tuples in memory
SEEN = 400_000       # texts a task remembers so as not to cut them twice
_BITS = 21
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _join(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    z = x * _A + y
    z ^= z >> np.uint64(32)
    z *= _B
    z ^= z >> np.uint64(29)
    return z


def anchors(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end (at most ``2 ** 21`` bytes): anchor names, anchor places, first windows and number of
    windows, in order of the windows."""
    n = len(data)
    some = ends - begins >= LENGTH
    begins, ends = begins[some], ends[some]
    if not len(begins):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    padded = np.concatenate([data, np.zeros(2 * LENGTH, np.uint8)])
    with np.errstate(over="ignore"):
        eight = np.ndarray((n + LENGTH,), "<u8", padded, 0, (1,)) * _C
        eight ^= eight >> np.uint64(31)
        sixteen = _join(eight[:-8], eight[8:])
        gram = _join(sixteen[:-16], sixteen[16:])
        gram = _join(gram[:n], sixteen[32:n + 32])
        low = np.uint64((1 << _BITS) - 1)
        least = gram & ~low | np.arange(n, dtype=np.uint64)
        width = 1
        while 2 * width <= REACH:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < REACH:
            least = np.minimum(least[:len(least) - (REACH - width)], least[REACH - width:])
        change = np.zeros(n + 1, np.int8)
        change[begins] = 1
        change[ends - LENGTH + 1] -= 1
        start = np.flatnonzero(np.cumsum(change[:-1], dtype=np.int8))
        place = (least[start] & low).astype(np.int64)
        new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)])
        at = place[new]
        name = gram[at] * _C
        name ^= name >> np.uint64(32)
    return name.view(np.int64), at, start[new], np.diff(np.append(new, len(start)))


def _chunks(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, begins and ends of up to BLOCK bytes of text, with the number of each one's row and its offset in it. A
    longer text comes in parts that overlap by a window less one byte, so that each window is in one of them."""
    parts, size = [], 0

    def out():
        lengths = np.array([b - a for _, a, b in parts])
        ends = np.cumsum(lengths)
        data = np.frombuffer(b"".join(texts[i][a:b] for i, a, b in parts), np.uint8)
        return (data, ends - lengths, ends, np.array([i for i, _, _ in parts]), np.array([a for _, a, _ in parts]))

    for i, text in enumerate(texts):
        step = BLOCK - LENGTH
        for a in range(0, max(1, len(text) - LENGTH + 1), step):
            b = min(len(text), a + step + LENGTH - 1)
            if size + b - a > BLOCK and parts:
                yield out()
                parts, size = [], 0
            parts.append((i, a, b))
            size += b - a
    if parts:
        yield out()


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of all texts with how often they occur."""
    for batch in batches:
        for data, begins, ends, _, _ in _chunks(_texts(batch)):
            name, count = np.unique(anchors(data, begins, ends)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(count)], ["h", "c"])


def _pieces(repeated):
    """Places of the anchors that the bit map lets through, with a hash of the piece around each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest
        bits = repeated.value
        for batch in batches:
            dk, dk2 = batch.column("dk").to_numpy(), batch.column("dk2").to_numpy()
            for data, begins, ends, row, offset in _chunks(_texts(batch)):
                name, at, first, n = anchors(data, begins, ends)
                low = name & (SIEVE - 1)
                good = np.flatnonzero(bits[low >> 6] >> (low & 63) & 1)
                name, at, first, n = name[good], at[good], first[good], n[good]
                part = np.searchsorted(begins, first, "right") - 1
                # Empty parts share their begin with the next one: the last of them is the one with bytes.
                raw = data.tobytes()
                ph = np.fromiter((xxh3_64_intdigest(raw[a:b], x) for a, b, x in zip(
                    first.tolist(), (first + n - 1 + LENGTH).tolist(), (at - first).tolist())), np.uint64, len(at))
                shift = offset[part] - begins[part]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name), pa.array(ph.view(np.int64)), pa.array((at - first).astype(np.int16)),
                     pa.array(n.astype(np.int16)), pa.array(dk[row[part]]), pa.array(dk2[row[part]]),
                     pa.array((at + shift).astype(np.int32))], ["a", "ph", "high", "n", "dk", "dk2", "at"])
    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of wanted pieces: those before the anchor, nearest first, and those from the anchor on."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        out: list[list] = [[] for _ in range(7)]
        size = 0
        for text, dk, dk2, wanted in zip(batch.column("text").cast(pa.binary()), batch.column("dk").to_pylist(),
                                         batch.column("dk2").to_pylist(), batch.column("wanted")):
            if (dk, dk2) in seen:
                continue
            if len(seen) >= SEEN:
                seen.clear()
            seen.add((dk, dk2))
            text = text.as_py()
            for w in wanted.as_py():
                at, high, low = w["at"], w["high"], w["high"] - w["n"] + 1
                row = (w["a"], w["ph"], w["c"], low, high, text[at - high:at][::-1], text[at:at - low + LENGTH])
                for column, value in zip(out, row):
                    column.append(value)
                size += LENGTH
            if size > 1 << 22:
                yield _piece_rows(out)
                out, size = [[] for _ in range(7)], 0
        yield _piece_rows(out)


_PIECE = pa.schema([("a", pa.int64()), ("ph", pa.int64()), ("c", pa.int64()), ("low", pa.int16()), ("high", pa.int16()),
                    ("left", pa.binary()), ("right", pa.binary())])


def _piece_rows(columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECE)], schema=_PIECE)


# ---------------------------------------------------------------- the queue

TUPLE = np.dtype([("a", "<i8"), ("ph", "<i8"), ("many", "u1"), ("low", "u1"), ("high", "u1"), ("lcp", "u1"),
                  ("left", "u1", REACH), ("marks", "u1", (REACH + 7) // 8)])


class Lanes:
    """A priority queue of tuples by lane (a byte), first in first out in each; beyond a size on disk."""

    def __init__(self, folder: str, limit: int):
        self.lanes: list[list] = [[] for _ in range(256)]
        self.limit, self.held, self.spill = limit, 0, Spill(folder, 0)

    def push(self, lane: int, rows: np.ndarray) -> None:
        if self.held + rows.nbytes <= self.limit:
            self.held += rows.nbytes
            self.lanes[lane].append(rows)
        else:
            self.lanes[lane].append(len(self.spill))
            self.spill.append(rows.tobytes())

    def pop(self) -> Iterator[np.ndarray]:
        """All tuples in order, in blocks."""
        block, n = [], 0
        for lane in range(256):
            parts, self.lanes[lane] = self.lanes[lane], []
            for part in parts:
                rows = np.frombuffer(self.spill[part], TUPLE) if isinstance(part, int) else part
                block.append(rows)
                n += len(rows)
                if n >= ROWS:
                    yield np.concatenate(block)
                    block, n = [], 0
        if block:
            yield np.concatenate(block)
        self.spill.clear()


def range_min(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Least value of each range from start to stop, both included."""
    table, width = [values], 1
    longest = int((stop - start).max(initial=0)) + 1
    while 2 * width <= longest:
        table.append(np.minimum(table[-1][:-width], table[-1][width:]))
        width *= 2
    out = np.empty(len(start), values.dtype)
    level = np.frexp((stop - start + 1).astype(np.float64))[1] - 1
    for k in np.unique(level):
        here = level == k
        out[here] = np.minimum(table[k][start[here]], table[k][stop[here] - (1 << int(k)) + 1])
    return out


class Step:
    """Deals suffixes at one distance, given in order, to the lanes of the distance after it."""

    def __init__(self, distance: int, lanes: Lanes):
        self.distance, self.lanes = distance, lanes
        self.since = np.full(256, 255, np.uint8)  # least common prefix met since a lane's last tuple
        self.used = np.zeros(256, bool)

    def take(self, rows: np.ndarray, equal_after: bool) -> np.ndarray:
        """Marks windows that equal a neighbour, passes the tuples on, and returns those that are done.
        ``equal_after``: whether the tuple behind the last one has a window equal to it."""
        o = self.distance
        lcp = rows["lcp"]
        equal = lcp >= LENGTH
        twice = (equal | np.append(equal[1:], equal_after) | (rows["many"] > 0)) & (rows["low"] <= o)
        rows["marks"][:, o >> 3] |= twice.astype(np.uint8) << np.uint8(o & 7)
        more = np.flatnonzero(rows["high"] > o)
        if len(more):
            lane = rows["left"][more, o]
            order = np.argsort(lane, kind="stable")
            where, lane = more[order], lane[order]
            head = np.r_[True, lane[1:] != lane[:-1]]
            before = np.where(head, -1, np.r_[-1, where[:-1]])
            least = range_min(lcp, before + 1, where)
            least[head] = np.minimum(least[head], self.since[lane[head]])
            new = np.minimum(least.astype(np.int16) + 1, LENGTH).astype(np.uint8)
            new[head & ~self.used[lane]] = 0
            passed = rows[where]
            passed["lcp"] = new
            begin = np.flatnonzero(head)
            end = np.append(begin[1:], len(where))
            present = lane[begin]
            self.since = np.minimum(self.since, lcp.min())
            last = where[end - 1]
            tail = np.append(lcp, np.uint8(255))
            self.since[present] = range_min(tail, last + 1, np.full(len(last), len(lcp)))
            self.used[present] = True
            for c, a, b in zip(present.tolist(), begin.tolist(), end.tolist()):
                self.lanes.push(c, passed[a:b])
        else:
            self.since = np.minimum(self.since, lcp.min())
        return rows[rows["high"] == o]


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Tuples at their anchors from rows sorted by group and the bytes from the anchor on."""
    group = tail = tail_size = None
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.zeros(batch.num_rows, TUPLE)
        for field in ("a", "ph", "low", "high"):
            rows[field] = batch.column(field).to_numpy()
        rows["many"] = batch.column("c").to_numpy() > 1
        rows["left"] = _matrix(batch.column("left"), REACH)[0]
        right, size = _matrix(batch.column("right"), LENGTH)
        g = batch.column("g").to_numpy()
        above = np.concatenate([right[:1] if tail is None else tail, right[:-1]])
        size_above = np.concatenate([size[:1] if tail is None else tail_size, size[:-1]])
        same_group = np.concatenate([[group is not None and group == g[0]], g[1:] == g[:-1]])
        differ = right != above
        common = np.where(differ.any(1), differ.argmax(1), LENGTH)
        rows["lcp"] = np.where(same_group, np.minimum(common, np.minimum(size, size_above)), 0)
        group, tail, tail_size = g[-1], right[-1:], size[-1:]
        held.append(rows)
        n += len(rows)
        if n >= ROWS:
            yield np.concatenate(held)
            held, n = [], 0
    if held:
        yield np.concatenate(held)


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings of at most ``width`` bytes as rows, filled up with zeros, and their lengths."""
    column = column.cast(pa.binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset:column.offset + len(column) + 1]
    data = np.concatenate([np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8),
                           np.zeros(width, np.uint8)])
    size = np.diff(at)
    span = np.arange(width)
    return np.where(span < size[:, None], data[at[:-1, None] + span], 0).astype(np.uint8), size


def _ahead(blocks: Iterator[np.ndarray]) -> Iterator[tuple[np.ndarray, bool]]:
    """Each block with whether the tuple behind it equals its last one."""
    last = None
    for block in blocks:
        if last is not None:
            yield last, bool(block["lcp"][0] >= LENGTH)
        last = block
    if last is not None:
        yield last, False


def _induce(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, lanes = _seeds(batches), None
        for distance in range(REACH):
            lanes = Lanes(folder, HELD)
            step, any_block = Step(distance, lanes), False
            for rows, equal_after in _ahead(blocks):
                any_block = True
                done = step.take(rows, equal_after)
                done = done[done["marks"].any(1)]
                if len(done):
                    marks = pa.FixedSizeBinaryArray.from_buffers(
                        pa.binary(done["marks"].shape[1]), len(done), [None, pa.py_buffer(done["marks"].tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array(done["a"].copy()), pa.array(done["ph"].copy()),
                                                      marks.cast(pa.binary())], ["a", "ph", "marks"])
            if not any_block:
                break
            blocks = lanes.pop()
    return run


# ---------------------------------------------------------------- crowded groups

def _halve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces cut at the middle distance of their group, each half named by what all its windows must hold."""
    from xxhash import xxh3_64_intdigest
    for batch in batches:
        rows = {k: [] for k in ("g", "from", "to", *_PIECE.names)}
        for r in batch.to_pylist():
            middle = (r["from"] + r["to"] + 1) // 2
            for lo, hi in ((r["from"], middle - 1), (middle, r["to"])):
                low, high = max(r["low"], lo), min(r["high"], hi)
                if low > high:
                    continue
                must = r["left"][:lo][::-1] + r["right"][:LENGTH - hi]
                g = xxh3_64_intdigest(must, (r["a"] ^ lo * 1009 ^ hi * 9176) & (1 << 64) - 1) - (1 << 63)
                new = {**r, "g": g, "from": lo, "to": hi, "low": low, "high": high, "left": r["left"][:high],
                       "right": r["right"][:LENGTH - low]}
                for k, column in rows.items():
                    column.append(new[k])
        types = {"g": pa.int64(), "from": pa.int32(), "to": pa.int32()}
        yield pa.RecordBatch.from_arrays([pa.array(v, types.get(k) or _PIECE.field(k).type) for k, v in rows.items()],
                                         list(rows))


def _marks_at(distance: str):
    """A mark at one distance, as the queue writes it."""
    each = [(1 << d).to_bytes((REACH + 7) // 8, "little") for d in range(REACH)]
    return F.element_at(F.array(*map(F.lit, each)), F.col(distance) + 1)


_PIECE_SQL = "a bigint, ph bigint, c bigint, low smallint, high smallint, left binary, right binary"


def _marks(pieces: DataFrame, crowd: int) -> DataFrame:
    """(a, ph, marks): which windows of a piece start elsewhere too, by distance from the anchor; crowded groups are
    halved until they are small."""
    names = ["g", "from", "to", *_PIECE.names]
    pieces = pieces.select(F.col("a").alias("g"), F.lit(0).alias("from"), F.lit(REACH - 1).alias("to"), *_PIECE.names)
    sorted_later, counted = [], []
    while True:
        groups = pieces.groupBy("g").agg(F.count(F.lit(1)).alias("_n"), F.sum("c").alias("_all")).where(F.col("_n") > crowd)
        groups = stored(groups)
        if groups.limit(1).count() == 0:
            sorted_later.append(pieces)
            break
        sorted_later.append(pieces.join(groups, "g", "left_anti"))
        hot = pieces.join(groups, "g")
        # Windows of one distance that share all they must hold are equal; such a group has two members or more.
        counted.append(hot.where("`from` = `to`").select("a", "ph", _marks_at("from").alias("marks")))
        halves = stored(hot.where("`from` < `to`").select(*names).mapInArrow(
            _halve, f"g bigint, `from` int, `to` int, {_PIECE_SQL}"))
        alone = halves.groupBy("g").agg(F.sum("c").alias("_all")).where("_all < 2")
        pieces = stored(halves.join(alone, "g", "left_anti"))
    queue = sorted_later[0]
    for part in sorted_later[1:]:
        queue = queue.unionByName(part)
    dealt = queue.select("g", *_PIECE.names).repartition("g").sortWithinPartitions("g", "right")
    marks = dealt.mapInArrow(_induce(scratch_path(pieces.sparkSession)), "a bigint, ph bigint, marks binary")
    for part in counted:
        marks = marks.unionAll(part)
    return marks


# ---------------------------------------------------------------- the operator

def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Maximal removed runs of each text and the bytes that are left."""
    for batch in batches:
        spans, kept = [], []
        for text, found in zip(batch.column("text").cast(pa.binary()), batch.column("found")):
            text, found = text.as_py(), found.as_py()
            if not found:
                spans.append([])
                kept.append(text)
                continue
            marks = np.frombuffer(b"".join(f["marks"] for f in found), np.uint8).reshape(len(found), -1)
            row, distance = np.nonzero(np.unpackbits(marks, axis=1, bitorder="little"))
            start = np.array([f["at"] for f in found], np.int64)[row] - distance
            change = np.bincount(start, minlength=len(text) + 1) - np.bincount(start + LENGTH, minlength=len(text) + 1)
            gone = np.cumsum(change)[:-1] > 0
            edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
            spans.append([{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()])
            kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([len(t.as_py()) for t in batch.column(
            "text").cast(pa.binary())], pa.int64()), pa.array(spans, pa.list_(span)), pa.array(kept, pa.binary())],
            ["row", "n_bytes", "spans", "kept"])


def repeats(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(dk, dk2, at, marks): for each text (named by two hashes) its anchors whose windows repeat."""
    texts = _keyed(docs).select("dk", "dk2", "text").where(F.octet_length("text") >= LENGTH)
    often = texts.select("text").mapInArrow(_names, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))
    entries = texts.mapInArrow(_pieces(sieve(often.where("c > 1").select("h"))),
                               "a bigint, ph bigint, high smallint, n smallint, dk bigint, dk2 bigint, at int")
    entries = stored(entries.groupBy("a", "ph", "high", "n", "dk", "dk2", "at").agg(F.count(F.lit(1)).alias("c")))
    distinct = stored(entries.groupBy("a", "ph", "high", "n").agg(
        F.sum("c").alias("c"), F.min(F.struct("dk", "dk2", "at")).alias("one")))
    alone = distinct.groupBy("a").agg(F.sum("c").alias("_all")).where("_all > 1").select("a")
    wanted = (distinct.join(alone, "a", "left_semi").groupBy("one.dk", "one.dk2")
              .agg(F.collect_list(F.struct("a", "ph", "c", "high", "n", F.col("one.at").alias("at"))).alias("wanted")))
    pieces = stored(texts.join(wanted.hint("shuffle_hash"), ["dk", "dk2"]).select("text", "dk", "dk2", "wanted")
                    .mapInArrow(_cut, _PIECE_SQL))
    marks = stored(_marks(pieces, crowd))
    return entries.join(marks, ["a", "ph"]).select("dk", "dk2", "at", "marks")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    return packed(docs).select(text.alias("text"), F.xxhash64(text).alias("dk"), F.xxhash64(F.lit(7), text).alias("dk2"),
                               F.col("row").dropFields("text").alias("row"))


def dedup(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """One row per row of ``docs``: row (its other columns), n_bytes, spans (removed runs, start and end in bytes),
    kept (the bytes that are left; a cut may fall inside a character)."""
    found = repeats(docs, crowd).groupBy("dk", "dk2").agg(F.collect_set(F.struct("at", "marks")).alias("found"))
    both = _keyed(docs).join(found.hint("shuffle_hash"), ["dk", "dk2"], "left").select("row", "text", "found")
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    return both.mapInArrow(_keep, T.StructType([
        both.schema["row"], T.StructField("n_bytes", T.LongType()), T.StructField("spans", T.ArrayType(span)),
        T.StructField("kept", T.BinaryType())]))


def report(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of ``docs``."""
    return dedup(docs, crowd).select(
        F.col("row.doc_id").alias("doc_id"), "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
