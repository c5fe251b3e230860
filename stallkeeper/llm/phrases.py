"""Phrase collocation mining by direct-address tiling.

Words are counted first. The most frequent items (``1 << RANKED`` of them) then have a number by frequency, so a
pair of neighbours is a cell of a square that is cut into tiles of ``1 << SIDE`` numbers a side. Each task counts the
cells of crowded tiles in dense arrays with ``bincount``, the others and the pairs of rarer items as sorted COO runs;
cells of all tasks are summed by key, so no tile meets in one task. Frequent pairs are the items of the next round:
ranked again, and two that overlap in all but one word make a phrase of one word more. An item that is too rare cannot
be part of a frequent phrase; a bit map of fixed size (see ``lines.sieve``) keeps most of those from being counted,
and what it lets through by chance is dropped by its count.

Items are named by 64-bit hashes of language and words; equal hashes are taken as equal items. Everything is per
language; a null language is ``und``, a null text is empty. Repeated rows count as often as they occur, whatever their
ids; the text is read whole. Empty tables give empty results.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stallkeeper.llm.common import packed, stored
from stallkeeper.llm.lines import SIEVE, sieve

LEAST = 10           # occurrences of a phrase
SHARE = 50           # percent of a phrase's occurrences inside a longer one that make it a part of that one
TOP = 2000           # phrases reported for each language
RANKED = 16          # items with a number: 1 << RANKED
SIDE = 10            # numbers along a side of a tile: 1 << SIDE
CROWDED = 1 << 16    # pairs of one block that make a tile dense
DENSE = 12           # dense tiles of a task, 8 MB each
HELD = 1 << 21       # pairs a task sorts at a time
BLOCK = 1 << 22      # bytes of text taken at a time (a longer text is taken alone)
_SLOTS = 1 << 21
_CLASS = np.zeros(256, np.uint8)  # 0: part of a word
_CLASS[[0x20, 0x09]] = 1
_CLASS[np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8)] = 2
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Names of the items made of the items ``x`` and ``y`` (signed 64-bit)."""
    with np.errstate(over="ignore"):
        z = x.view(np.uint64) * _A + (y.view(np.uint64) ^ (y.view(np.uint64) >> np.uint64(29))) * _B
        z ^= z >> np.uint64(31)
        z *= _C
        z ^= z >> np.uint64(32)
    return z.view(np.int64)


def words(lang: str, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]:
    """Keys of all words in order, whether each is in one piece with the next, and the lowered bytes with each word's
    start and end in them."""
    from xxhash import xxh3_64_intdigest
    data = b"\n".join(texts).lower()  # of bytes: A-Z alone
    padded = np.frombuffer(data + bytes(8), np.uint8)
    kind = _CLASS[padded[:-8]]
    edge = np.diff(np.concatenate([[0], (kind == 0).view(np.int8), [0]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    piece = np.cumsum(kind == 2, dtype=np.int32)[start] if len(start) else start
    together = np.zeros(len(start), bool)
    together[:-1] = piece[1:] == piece[:-1]
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    key = np.full(len(start), xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass")), np.uint64)
    size = end - start
    todo, at = np.arange(len(start)), 0
    with np.errstate(over="ignore"):
        while len(todo):
            part = eight[start[todo] + at] & _MASK[np.minimum(size[todo] - at, 8)]
            h = (key[todo] ^ part) * _A
            h ^= h >> np.uint64(32)
            key[todo] = h * _B
            at += 8
            todo = todo[size[todo] > at]
        key ^= key >> np.uint64(29)
        key = (key + size.astype(np.uint64)) * _C
        key ^= key >> np.uint64(32)
    return key.view(np.int64), together, data, start, end


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Texts by language, up to BLOCK bytes at a time."""
    for batch in batches:
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary())):
            text = text.as_py()
            if size.get(lang, 0) + len(text) > BLOCK and lang in held:
                yield lang, held.pop(lang)
                size[lang] = 0
            held.setdefault(lang, []).append(text)
            size[lang] = size.get(lang, 0) + len(text)
        yield from held.items()


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, and where each key begins in it."""
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(keys[order]) != 0]) if len(keys) else np.zeros(0, np.int64)
    return order, first


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for lang, texts in _blocks(batches):
        key, _, data, start, end = words(lang, texts)
        order, first = _runs(key)
        one = order[first]
        size = (end - start)[one]
        offset = np.concatenate([[0], np.cumsum(size)])
        take = np.repeat(start[one] - offset[:-1], size) + np.arange(offset[-1])
        text = pa.StringArray.from_buffers(len(one), pa.py_buffer(offset.astype(np.int32)),
                                           pa.py_buffer(np.frombuffer(data, np.uint8)[take]))
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(one), pa.string()), pa.array(key[one]), text,
             pa.array(np.diff(np.append(first, len(key))))], ["lang", "key", "word", "c"])


class Tiles:
    """Counts of pairs of neighbouring items, as far as one task sees them."""

    def __init__(self, ranked: np.ndarray):
        self.ranked = ranked  # keys by rank
        self.slots = np.full(_SLOTS, -1, np.int32)
        # The more frequent of two items that share a slot has it; the other counts as unranked.
        self.slots[(ranked & (_SLOTS - 1))[::-1]] = np.arange(len(ranked), dtype=np.int32)[::-1]
        self.dense: dict[int, np.ndarray] = {}
        self.cells: list[np.ndarray] = []
        self.rest: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_cells = self.n_rest = 0

    def rank(self, keys: np.ndarray) -> np.ndarray:
        number = self.slots[keys & (_SLOTS - 1)]
        return np.where((number >= 0) & (self.ranked[number] == keys), number, -1) if len(self.ranked) else number

    def add(self, x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b = self.rank(x), self.rank(y)
        both = (a >= 0) & (b >= 0)
        if not both.all():
            self.rest.append((x[~both], y[~both]))
            self.n_rest += len(self.rest[-1][0])
        a, b = a[both].astype(np.int64), b[both].astype(np.int64)
        low = (1 << SIDE) - 1
        tile = (a >> SIDE) << (RANKED - SIDE) | b >> SIDE
        cell = (a & low) << SIDE | b & low
        many = np.bincount(tile, minlength=1) if len(tile) else np.zeros(0, np.int64)
        for t in np.argsort(many)[::-1]:
            if many[t] < CROWDED or len(self.dense) >= DENSE:
                break
            self.dense.setdefault(int(t), np.zeros(1 << 2 * SIDE, np.int64))
        for t, counts in self.dense.items():
            here = tile == t
            if here.any():
                counts += np.bincount(cell[here], minlength=len(counts))
                tile, cell = tile[~here], cell[~here]
        self.cells.append(tile << 2 * SIDE | cell)
        self.n_cells += len(cell)
        if self.n_cells >= HELD:
            yield self._sparse_cells()
        if self.n_rest >= HELD:
            yield self._rest()

    def _out(self, x: np.ndarray, y: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(c.astype(np.int64))], ["x", "y", "c"])

    def _named(self, code: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        low = (1 << SIDE) - 1
        tile, cell = code >> 2 * SIDE, code & ((1 << 2 * SIDE) - 1)
        a = tile >> (RANKED - SIDE) << SIDE | cell >> SIDE
        b = (tile & ((1 << (RANKED - SIDE)) - 1)) << SIDE | cell & low
        return self._out(self.ranked[a], self.ranked[b], c)

    def _sparse_cells(self) -> pa.RecordBatch:
        code = np.sort(np.concatenate(self.cells))
        self.cells, self.n_cells = [], 0
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        return self._named(code[first], np.diff(np.append(first, len(code))))

    def _rest(self) -> pa.RecordBatch:
        x, y = (np.concatenate(part) for part in zip(*self.rest))
        self.rest, self.n_rest = [], 0
        order, first = _runs(mix(x, y))
        one = order[first]
        return self._out(x[one], y[one], np.diff(np.append(first, len(x))))

    def flush(self) -> Iterator[pa.RecordBatch]:
        for t, counts in self.dense.items():
            cell = np.flatnonzero(counts)
            yield self._named(t << 2 * SIDE | cell, counts[cell])
        if self.n_cells:
            yield self._sparse_cells()
        if self.n_rest:
            yield self._rest()


def _count_pairs(length: int, frequent, ranked):
    """Counts neighbouring items of ``length`` words each that pass the bit map ``frequent``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles, bits = Tiles(ranked.value), frequent.value
        for lang, texts in _blocks(batches):
            key, together, *_ = words(lang, texts)
            for _ in range(length - 1):  # an item begins at each word that has enough others behind it
                key, together = mix(key[:-1], key[1:]), together[:-1] & together[1:]
                # Items that run over the end of a piece are not items: they take no part below.
            if len(key) < 2:
                continue
            low = key & (SIEVE - 1)
            good = (bits[low >> 6] >> (low & 63) & 1).astype(bool)
            both = np.flatnonzero(together[:-1] & good[:-1] & good[1:])
            if len(both):
                yield from tiles.add(key[both], key[both + 1])
        yield from tiles.flush()
    return run


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = batch.column("x").to_numpy(), batch.column("y").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(mix(x, y)), *batch.columns], ["key", "x", "y", "f"])


def _ranked(items: DataFrame) -> np.ndarray:
    """Keys of the most frequent items, by rank: ``1 << RANKED`` at most reach the driver."""
    top = items.select("key", "f").orderBy(F.col("f").desc(), "key").limit(1 << RANKED).toArrow()
    return top.column("key").to_numpy()


def phrases(docs: DataFrame, longest: int = 3, least: int = LEAST) -> tuple[list[DataFrame], DataFrame]:
    """Frequent items by length (1 to ``longest`` words) and the number of word occurrences of each language.

    Items have: key, lang, phrase, last (its last word), f, heads and tails (occurrences of its first and last 1, 2,
    ... words, its own as the last entry), and from two words on x and y, the items it is made of.
    """
    rows = packed(docs).select(F.coalesce(F.col("row.lang").cast("string"), F.lit("und")).alias("lang"),
                               F.coalesce(F.col("row.text").cast("string"), F.lit("")).alias("text"))
    spark = docs.sparkSession
    counted = stored(rows.mapInArrow(_count_words, "lang string, key bigint, word string, c bigint")
                     .groupBy("lang", "key", "word").agg(F.sum("c").alias("f")))
    totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    items = [stored(counted.where(F.col("f") >= least).select(
        "key", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f",
        F.array("f").alias("heads"), F.array("f").alias("tails")))]
    for length in range(1, longest):
        have = items[-1]
        frequent = sieve(have.select(F.col("key").alias("h")))
        ranked = spark.sparkContext.broadcast(_ranked(have))
        pairs = (rows.mapInArrow(_count_pairs(length, frequent, ranked), "x bigint, y bigint, c bigint")
                 .groupBy("x", "y").agg(F.sum("c").alias("f")).where(F.col("f") >= least)
                 .mapInArrow(_names, "key bigint, x bigint, y bigint, f bigint"))
        left = have.select(F.col("key").alias("x"), "lang", F.col("phrase").alias("_begin"), F.col("heads").alias("_heads"))
        right = have.select(F.col("key").alias("y"), "last", F.col("tails").alias("_tails"))
        items.append(stored(pairs.join(left, "x").join(right, "y").select(
            "key", "lang", F.concat_ws(" ", "_begin", "last").alias("phrase"), "last", "f",
            F.concat("_heads", F.array("f")).alias("heads"), F.concat("_tails", F.array("f")).alias("tails"), "x", "y")))
    return items, totals


def weakest_cut(length: int) -> Column:
    """The cut with the least floor(1000000 a a / (l r)), of equals the first, as a struct score, k, l, r. Decimals of
    38 digits hold the products, and ``div`` cuts towards zero."""
    cuts = []
    for k in range(1, length):
        left, right = f"element_at(heads, {k})", f"element_at(tails, {length - k})"
        score = F.expr(f"cast(f AS decimal(19,0)) * cast(f AS decimal(19,0)) * cast(1000000 AS decimal(7,0)) "
                       f"div (cast({left} AS decimal(19,0)) * cast({right} AS decimal(19,0)))")
        cuts.append(F.struct(score.cast("bigint").alias("score"), F.lit(k).alias("k"), F.expr(left).alias("l"),
                             F.expr(right).alias("r")))
    return cuts[0] if length == 2 else F.least(*cuts)


def collocations(docs: DataFrame, longest: int = 3, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of 2 to ``longest`` words of each language: lang, rank, phrase, a (its occurrences), l and r
    (of the two parts at its weakest cut), n (word occurrences), score.

    A phrase goes if a longer frequent one around it has ``share`` percent of its occurrences; as a part never occurs
    less often than the whole, the phrases of one word more decide that.
    """
    items, totals = phrases(docs, longest, least)
    parts = []
    for length in range(2, longest + 1):
        here = items[length - 1]
        if length < longest:
            longer = items[length]
            around = (longer.select(F.col("x").alias("key"), "f").unionAll(longer.select(F.col("y").alias("key"), "f"))
                      .groupBy("key").agg(F.max("f").alias("_around")))
            here = here.join(around, "key", "left").where(
                F.coalesce(100 * F.col("_around") < share * F.col("f"), F.lit(True)))
        parts.append(here.select("lang", "phrase", F.col("f").alias("a"), weakest_cut(length).alias("cut")))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionAll(part)
    found = found.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = W.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    best = found.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
