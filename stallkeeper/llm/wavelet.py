"""Token files as wavelet matrices.

Documents are dealt into ascending id ranges, encoded with a public tokenizer, and written in shards of
about a million ids. A shard is one row with one blob: a wavelet matrix (bit planes from the highest bit
down, each stably partitioned by the one above, with running counts of ones), compressed with zstandard.
From the blob, ``access`` gives the id at a position, ``count`` the occurrences of an id in a range and
``locate`` the position of its k-th occurrence, each by rank and select on the planes.
"""
from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from stallkeeper.llm.common import Memo

END = 2                # closes every document
SHARD = 1 << 20        # ids of a shard; the document that reaches it is still taken whole
MAGIC = b"WVM1"
BLOCK = 512            # bits per running count
MEMO = 400_000         # recent words of a worker, in each of two generations
CHARS = 1 << 20        # characters cut into words at a time, if no document is longer
BLANK, LETTER, DIGIT, SYMBOL, ODD = range(5)  # kinds of characters
# Fixed by the tokenizer: these endings are words of their own where an apostrophe begins a word.
ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")
COMMON = [*range(0xA1, 0x250), *range(0x400, 0x530), *range(0x2010, 0x2028), *range(0x2030, 0x205F), *range(0x20A0, 0x20C0)]
PROBES = ("It's", "don't", "We'LL", "x86-64", "(a.b)", "100%", "~!@#$%^&*()_+{}|:<>?", "Word,word", "one\ttwo\r\n three", "''s's'rest'l", "12'ms 'dx",
          "L'\xc9T\xc9", "\u201cna\xefve\u201d\u20145\u20ac", "\u041c\u0438\u0440's")


class WaveletMatrix:
    """ids (unsigned, below 2**bits) with access, count and locate."""

    def __init__(self, planes: list[np.ndarray], zeros: list[int], ranks: list[np.ndarray], n: int):
        self.planes, self.zeros, self.ranks, self.n, self.bits = planes, zeros, ranks, n, len(planes)

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        planes, zeros, ranks, values = [], [], [], ids
        for level in range(bits - 1, -1, -1):
            one = values & ids.dtype.type(1 << level) != 0
            planes.append(np.packbits(one, bitorder="little"))
            ranks.append(cls.directory(planes[-1]))
            zeros.append(len(ids) - int(np.count_nonzero(one)))
            parted = np.empty_like(values)
            np.compress(one, values, out=parted[zeros[-1]:])
            np.compress(~one, values, out=parted[:zeros[-1]])
            values = parted
        return cls(planes, zeros, ranks, len(ids))

    @staticmethod
    def directory(plane: np.ndarray) -> np.ndarray:
        """Ones before each block."""
        size = BLOCK // 8
        ones = np.bitwise_count(np.pad(plane, (0, -len(plane) % size))).reshape(-1, size).sum(1, dtype=np.uint32)
        return np.r_[0, np.cumsum(ones)].astype(np.uint32)

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3]) >> (i & 7) & 1

    def _ones(self, level: int, i: int) -> int:
        """Ones of a plane before position i."""
        block = i // BLOCK
        part = self.planes[level][block * BLOCK // 8:i >> 3]
        rest = int(self.planes[level][i >> 3]) & ((1 << (i & 7)) - 1) if i & 7 else 0
        return int(self.ranks[level][block]) + int(np.bitwise_count(part).sum(dtype=np.int64)) + rest.bit_count()

    def _nth(self, level: int, k: int, bit: int) -> int:
        """Position of the k-th (from 0) one or zero of a plane."""
        before = self.ranks[level].astype(np.int64)
        if not bit:
            before = np.arange(len(before)) * BLOCK - before
        block = int(np.searchsorted(before, k, "right")) - 1
        bits = np.unpackbits(self.planes[level][block * BLOCK // 8:(block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def access(self, i: int) -> int:
        value = 0
        for level in range(self.bits):
            bit, ones = self._bit(level, i), self._ones(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, value: int, lo: int, hi: int) -> tuple[int, int]:
        for level in range(self.bits):
            a, b = self._ones(level, lo), self._ones(level, hi)
            if value >> (self.bits - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, value: int, lo: int = 0, hi: int | None = None) -> int:
        if value >> self.bits:
            return 0
        a, b = self._range(value, lo, self.n if hi is None else hi)
        return b - a

    def locate(self, value: int, k: int) -> int:
        """Position of the k-th occurrence (from 0), -1 if there are fewer."""
        if value >> self.bits:
            return -1
        lo, hi = self._range(value, 0, self.n)
        if not 0 <= k < hi - lo:
            return -1
        i = lo + k
        for level in range(self.bits - 1, -1, -1):
            if value >> (self.bits - 1 - level) & 1:
                i = self._nth(level, i - self.zeros[level], 1)
            else:
                i = self._nth(level, i, 0)
        return i

    def all(self) -> np.ndarray:
        """All ids in order: the partitions undone from the lowest plane up."""
        values = np.zeros(self.n, np.uint32 if self.bits > 16 else np.uint16)
        for level in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            above = np.empty_like(values)
            above[np.flatnonzero(~one)] = values[:self.zeros[level]]
            above[np.flatnonzero(one)] = values[self.zeros[level]:] | values.dtype.type(1 << (self.bits - 1 - level))
            values = above
        return values


def dump(matrix: WaveletMatrix, doc_ids: np.ndarray, known: np.ndarray, lengths: np.ndarray) -> bytes:
    """One compressed file: header, documents, planes with their counts."""
    import zstandard
    pack = zstandard.ZstdCompressor(level=1).compress
    parts = [pack(np.diff(doc_ids, prepend=0).astype("<i8").tobytes()), pack(known.astype(np.uint8).tobytes()),
             pack(lengths.astype("<i8").tobytes())]
    for plane, ranks in zip(matrix.planes, matrix.ranks):
        parts += [pack(plane.tobytes()), pack(ranks.astype("<u4").tobytes())]
    head = struct.pack(f"<4sIQQ{matrix.bits}Q{len(parts)}Q", MAGIC, matrix.bits, matrix.n, len(doc_ids),
                       *matrix.zeros, *map(len, parts))
    return head + b"".join(parts)


def load(blob: bytes) -> tuple[WaveletMatrix, np.ndarray, np.ndarray, np.ndarray]:
    """The matrix, document ids, whether each id is known (not null), and document lengths."""
    import zstandard
    magic, bits, n, _ = struct.unpack_from("<4sIQQ", blob)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at, count = struct.calcsize("<4sIQQ"), 3 + 2 * bits
    zeros = list(struct.unpack_from(f"<{bits}Q", blob, at))
    sizes = struct.unpack_from(f"<{count}Q", blob, at + 8 * bits)
    at += 8 * (bits + count)
    unpack, parts = zstandard.ZstdDecompressor().decompress, []
    for size in sizes:
        parts.append(unpack(blob[at:at + size]))
        at += size
    as_array = np.frombuffer
    planes = [as_array(p, np.uint8) for p in parts[3::2]]
    ranks = [as_array(p, "<u4") for p in parts[4::2]]
    return (WaveletMatrix(planes, zeros, ranks, n), np.cumsum(as_array(parts[0], "<i8")),
            as_array(parts[1], np.uint8).astype(bool), as_array(parts[2], "<i8"))


class Words:
    """Ids of texts by the ids of their words. The tokenizer drops white space and never joins across it. Runs between
    blanks of plain characters (printable ASCII, common letters and symbols that the tokenizer treats one by one) are
    cut by its own rule, for many texts at once, and its model splits each word once. Any other run, and any that
    holds the content of an added token in either case, goes through the whole tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.added = tuple({t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.bits = max(1, (max(self.tokenizer.get_vocab_size(), END + 1) - 1).bit_length())
        self.dtype = np.dtype("<u2" if self.bits <= 16 else "<u4")
        self.format = "H" if self.bits <= 16 else "I"
        self.kinds, self.low, self.mapped = self.common()
        plain = re.escape("".join(map(chr, np.flatnonzero(self.kinds != ODD))))
        self.odd = re.compile("|".join([f"[^{plain}]", *map("(?i:{})".format, map(re.escape, self.added))])).search
        self.words = Memo(self.word, MEMO)
        # The short cut holds for tokenizers that treat a probe alike either way.
        self.short = True
        if any(self.encode([x])[1].tolist() != self.whole(x).tolist() for x in PROBES):
            self.short = False
            self.kinds[self.kinds != BLANK] = ODD
            self.words.clear()

    def common(self) -> tuple[np.ndarray, np.ndarray, dict[int, str]]:
        """Kinds and lower cases of characters by their numbers (the last stands for all others), and what those beyond
        ASCII become for the model: letters and symbols that the tokenizer lower-cases as Python does and never
        joins with what stands beside them but into a word."""
        kinds, lower, mapped = np.full(COMMON[-1] + 2, ODD, np.uint8), np.arange(COMMON[-1] + 2, dtype=np.uint32), {}
        for i in range(ord("!"), ord("~") + 1):
            char = chr(i)
            kinds[i] = LETTER if char.isalpha() else DIGIT if char.isdigit() else SYMBOL
            lower[i] = ord(char.lower())
        kinds[[ord(x) for x in " \t\n\r"]] = BLANK
        normalizer, cutter = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        for i in COMMON if normalizer is not None and cutter is not None else ():
            low = chr(i).lower()
            if len(low) > 1 or normalizer.normalize_str(chr(i)) != low or unicodedata.category(low)[0] == "M":
                continue
            for side, kind in (("a", LETTER), ("!", SYMBOL)):
                pieces = [x for x, _ in cutter.pre_tokenize_str(side + low + side)]
                if len(pieces) == 1 and pieces[0][0] == pieces[0][-1] == side:
                    kinds[i], lower[i], mapped[ord(low)] = kind, ord(low), pieces[0][1:-1]
        return kinds, lower, mapped

    def whole(self, run: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(run, add_special_tokens=False).ids, self.dtype)

    def word(self, word: str) -> bytes:
        """Of a piece that ``cut`` gives."""
        if word[0] in " \t\n\r":
            return b""
        if not self.short or self.odd(word):
            return self.whole(word).tobytes()
        ids = [t.id for t in self.tokenizer.model.tokenize(word if word.isascii() else word.translate(self.mapped))]
        return struct.pack(f"<{len(ids)}{self.format}", *ids)

    def cut(self, text: str) -> tuple[np.ndarray, pa.Array]:
        """Where the pieces of a text begin: words in lower case, runs with odd characters as they are, and blanks."""
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
        known = np.minimum(codes, len(self.kinds) - 1)
        kind, low = self.kinds[known], np.where(codes < len(self.low), self.low[known], codes)
        odd = kind == ODD
        plain = low.tobytes().decode("utf-32-le")
        for token in self.added:
            at = plain.find(token)
            while at >= 0:
                odd[at] = True
                at = plain.find(token, at + 1)
        if odd.any():
            filled = kind != BLANK
            run = np.cumsum(np.diff(filled, prepend=False) & filled)
            whole = np.zeros(int(run[-1]) + 1, bool)
            whole[run[odd]] = True
            odd = whole[run] & filled
            kind[odd] = ODD
            low[odd] = codes[odd]
            plain = low.tobytes().decode("utf-32-le")
        begins = np.r_[kind[:1] >= 0, kind[1:] != kind[:-1], True]
        begins[:-1] |= kind == DIGIT
        # An apostrophe alone before a letter: the endings go with it.
        at = np.flatnonzero((low[:-1] == ord("'")) & (kind[:-1] == SYMBOL) & begins[:-2] & (kind[1:] == LETTER))
        after = np.r_[low, 0, 0]
        for ending in ENDINGS:
            found = at[np.logical_and.reduce([after[at + 1 + i] == ord(x) for i, x in enumerate(ending)])]
            begins[found + 1] = False
            begins[found + 1 + len(ending)] = True
        begins = np.flatnonzero(begins)
        data = plain.encode()
        places = begins
        if len(data) > len(low):
            places = np.r_[0, np.cumsum(1 + (low > 0x7F) + (low > 0x7FF) + (low > 0xFFFF))][begins]
        pieces = pa.Array.from_buffers(pa.large_string(), len(places) - 1,
                                       [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(data)])
        return begins[:-1], pieces

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text, and all ids in turn."""
        size = np.array([len(x) + 1 for x in texts])
        begins, pieces = self.cut("\n".join(texts) + "\n")
        pieces = pieces.dictionary_encode()
        found = [self.words[x] for x in pieces.dictionary.to_numpy(zero_copy_only=False).tolist()]
        ids = np.frombuffer(b"".join(found), self.dtype)
        length = np.array([len(x) for x in found]) // self.dtype.itemsize
        first, piece = np.cumsum(length) - length, pieces.indices.to_numpy()
        count = length[piece]
        upto = np.r_[0, np.cumsum(count)]
        ids = ids[np.arange(upto[-1]) + np.repeat(first[piece] - upto[:-1], count)]
        # Blanks have no ids, so it does not matter that those around the end of a text are one piece.
        return np.diff(upto[np.searchsorted(begins, np.r_[0, np.cumsum(size)])]), ids


@lru_cache(maxsize=2)
def words(path: str) -> Words:
    return Words(path)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], list[str]]]:
    """Documents of a batch, about CHARS characters at a time."""
    for batch in batches:
        ids, texts, held = [], [], 0
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            ids.append(doc_id)
            texts.append(text.as_py() or "")
            held += len(texts[-1])
            if held >= CHARS:
                yield ids, texts
                ids, texts, held = [], [], 0
        if ids:
            yield ids, texts


def _shards(path: str, shard: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, seq = TaskContext.get().partitionId(), 0
        table = words(path)
        end = np.array([END], table.dtype)
        ids, parts, sizes, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            values = np.concatenate(parts)
            known = np.array([x is not None for x in ids], bool)
            blob = dump(WaveletMatrix.build(values, table.bits), np.array([x or 0 for x in ids], np.int64), known,
                        np.array(sizes))
            return pa.RecordBatch.from_arrays(
                [pa.array([part]), pa.array([seq], pa.int64()), pa.array([len(values)], pa.int64()),
                 pa.array([len(ids)], pa.int64()), pa.array([blob], pa.binary())],
                ["part", "seq", "n_tokens", "n_docs", "blob"])

        for doc_ids, texts in _chunks(batches):
            lengths, values = table.encode(texts)
            for doc_id, n, upto in zip(doc_ids, lengths.tolist(), np.cumsum(lengths).tolist()):
                ids.append(doc_id)
                parts += [values[upto - n:upto], end]
                sizes.append(n + 1)
                held += n + 1
                if held >= shard:
                    yield close()
                    seq, ids, parts, sizes, held = seq + 1, [], [], [], 0
        if ids:
            yield close()
    return run


def write(docs: DataFrame, path: str, tokenizer: str, shard: int = SHARD) -> None:
    """Encode whole texts (null: empty) in ascending id order, null ids first, rows of one id by text hash.

    Files: part (id range), seq (shard in it), n_tokens, n_docs, blob.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    (rows.repartitionByRange(F.col("doc_id").asc_nulls_first())
     .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
     .mapInArrow(_shards(tokenizer, shard), "part bigint, seq bigint, n_tokens bigint, n_docs bigint, blob binary")
     .write.option("compression", "uncompressed").parquet(path))


def shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards with ``start``, the ids in all shards before."""
    files = spark.read.parquet(path)
    sizes = files.select("part", "seq", "n_tokens")
    upto = (W.unboundedPreceding, -1)
    parts = (sizes.groupBy("part").agg(F.sum("n_tokens").alias("_n"))  # one row per range
             .withColumn("_first", F.coalesce(F.sum("_n").over(W.orderBy("part").rowsBetween(*upto)), F.lit(0))))
    inside = F.coalesce(F.sum("n_tokens").over(W.partitionBy("part").orderBy("seq").rowsBetween(*upto)), F.lit(0))
    starts = (sizes.withColumn("_inside", inside).join(parts, "part")
              .select("part", "seq", (F.col("_first") + F.col("_inside")).alias("start")))
    return files.join(starts, ["part", "seq"])


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob, start in zip(batch.column("blob"), batch.column("start").to_pylist()):
            matrix, doc_ids, known, lengths = load(blob.as_py())
            values = matrix.all().astype("<u4")
            ends = np.cumsum(lengths)
            crc = [zlib.crc32(values[e - n:e].tobytes()) for e, n in zip(ends.tolist(), lengths.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64(), mask=~known), pa.array(start + ends - lengths, pa.int64()),
                 pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    return shards(spark, path).select("blob", "start").mapInArrow(
        _documents, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def _lookup(value: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, start in zip(batch.column("blob"), batch.column("start").to_pylist()):
                matrix = load(blob.as_py())[0]
                found = [start + matrix.locate(value, k) for k in range(matrix.count(value))]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["position"])
    return run


def occurrences(spark: SparkSession, path: str, value: int) -> DataFrame:
    """Positions of an id in the whole corpus, looked up in the planes."""
    return shards(spark, path).select("blob", "start").mapInArrow(_lookup(value), "position bigint")
