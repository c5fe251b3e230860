"""Byte-level BPE from a rank file, with a two-tier lookup, and its inverse.

A text is cut into pre-tokens by the public pattern. Tier one is a minimal perfect hash over the
vocabulary: one probe and one comparison tell whether a whole pre-token is a token. Tier two merges the
bytes of the others: the bytes are a linked list, neighbouring pairs wait in a heap by rank, and the
lowest, leftmost pair merges first, so a pre-token of n bytes costs O(n log n).
"""
from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stallkeeper.llm.common import Memo

MEMO = 250_000  # recent pre-tokens of a worker, in each of two generations
# White space of the Unicode property, spelled out because libraries differ on \s.
CROWDED = re.compile(r"^ | \s|\s | $").search
# Patterns whose matches begin with a blank only as its first character and never hold one inside.
ANCHORED = (r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""",)
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class PerfectHash:
    """Minimal perfect hash of byte strings to 0..n-1 (compress, hash and displace).

    Keys are dealt to n/4 buckets; buckets, largest first, search the displacement that puts all their
    keys on free slots. Buckets of one key name their slot outright.
    """

    def __init__(self, keys: list[bytes]):
        from xxhash import xxh3_64_intdigest
        self._hash, self.n = xxh3_64_intdigest, len(keys)
        self.buckets = max(1, self.n // 4)
        hashes = np.array([xxh3_64_intdigest(k) for k in keys], np.uint64)
        if len(np.unique(hashes)) < self.n:
            raise ValueError("repeated keys")
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        starts = np.cumsum(sizes) - sizes
        taken = np.zeros(self.n, bool)
        shift, self.keys = [0] * self.buckets, [b""] * self.n
        high = (hashes >> np.uint64(20)).astype(np.uint64)
        for b in np.argsort(-sizes, kind="stable").tolist():
            own = order[starts[b]:starts[b] + sizes[b]]
            if len(own) < 2:
                break
            for at in range(1, 1 << 22, 64):
                d = np.arange(at, at + 64, dtype=np.uint64)
                with np.errstate(over="ignore"):
                    slots = ((high[own][None, :] ^ (d[:, None] * np.uint64(0x9E3779B97F4A7C15))) *
                             np.uint64(0xD6E8FEB86659FD93) >> np.uint64(24)) % np.uint64(self.n)
                ordered = np.sort(slots, axis=1)
                good = ~taken[slots.astype(np.int64)].any(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
                if good.any():
                    first = int(np.argmax(good))
                    shift[b] = at + first
                    taken[slots[first].astype(np.int64)] = True
                    for i, s in zip(own.tolist(), slots[first].tolist()):
                        self.keys[s] = keys[i]
                    break
            else:
                raise ValueError("no displacement found")
        free = iter(np.flatnonzero(~taken).tolist())
        for b in np.flatnonzero(sizes == 1).tolist():
            slot = next(free)
            shift[b] = -1 - slot
            self.keys[slot] = keys[order[starts[b]]]
        self.shift = shift

    def slot(self, key: bytes) -> int:
        """Slot of a key, -1 for any other byte string."""
        h = self._hash(key)
        d = self.shift[h % self.buckets]
        if d < 0:
            at = -1 - d
        else:
            x = (h >> 20) ^ (d * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            at = ((x * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF) >> 24) % self.n
        return at if self.keys[at] == key else -1


class Encoder:
    """Texts to the little-endian ids of their tokens, and back."""

    def __init__(self, path: str, pattern: str):
        import regex
        with open(path, "rb") as f:
            pairs = [(base64.b64decode(a), int(b)) for a, b in (line.split() for line in f if line.strip())]
        self.find = regex.compile(explicit_space(pattern)).findall
        # The same matches for texts of ASCII only, by the quicker engine.
        self.find_ascii = re.compile(ascii_only(pattern), re.ASCII).findall
        self.anchors = pattern in ANCHORED
        self.table = PerfectHash([k for k, _ in pairs])
        rank = dict(pairs)
        self.rank = [rank[k] for k in self.table.keys]
        self.vocabulary = {r: k for k, r in pairs}
        self.byte = [rank[bytes([i])] for i in range(256)]
        # Neighbouring tokens that make a token: for the left one, the right one to the rank.
        self.joined: list[dict[int, int]] = [{} for _ in range(max(rank.values()) + 1)]
        for k, r in pairs:
            for i in range(1, len(k)):
                if k[:i] in rank and k[i:] in rank:
                    self.joined[rank[k[:i]]][rank[k[i:]]] = r
        self.pieces, self.words = Memo(self.piece, MEMO), Memo(self.word, MEMO)

    def rank_of(self, piece: bytes) -> int:
        at = self.table.slot(piece)
        return self.rank[at] if at >= 0 else -1

    def piece(self, piece: str) -> bytes:
        raw = piece.encode("utf-8", "surrogatepass")
        whole = self.rank_of(raw)
        return pack("<I", whole) if whole >= 0 else self.merge(raw)

    def merge(self, raw: bytes) -> bytes:
        n, joined = len(raw), self.joined
        token = [self.byte[b] for b in raw]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # the linked bytes
        # The heap holds rank * n + place: lowest rank first, then leftmost.
        heap = [r * n + i for i, (a, b) in enumerate(zip(token, token[1:])) if (r := joined[a].get(b)) is not None]
        heapify(heap)
        while heap:
            at = heappop(heap)
            r = at // n
            i = at - r * n
            left, right = token[i], after[i]
            if left < 0 or right >= n or joined[left].get(token[right]) != r:
                continue  # one of the two has changed since
            token[i], token[right] = r, -1
            right = after[i] = after[right]
            if right < n:
                before[right] = i
                if (more := joined[r].get(token[right])) is not None:
                    heappush(heap, more * n + i)
            if (left := before[i]) >= 0 and (more := joined[token[left]].get(r)) is not None:
                heappush(heap, more * n + left)
        ids = [t for t in token if t >= 0]
        return pack(f"<{len(ids)}I", *ids)

    def cut(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, (self.find_ascii if text.isascii() else self.find)(text)))

    def word(self, run: str) -> bytes:
        return self.cut(" " + run)

    def encode(self, text: str | None) -> bytes:
        """Where blanks stand alone between other characters, the pattern starts anew at each of them, so the
        ids of the runs between blanks can be remembered; other texts are cut as a whole."""
        if not text:
            return b""
        if self.anchors and not CROWDED(text):
            first, *rest = text.split(" ")
            return self.cut(first) + b"".join(map(self.words.__getitem__, rest))
        return self.cut(text)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def ascii_only(pattern: str) -> str:
    """The pattern for ASCII text in the standard engine, which has no Unicode classes."""
    for name, plain in ((r"\p{L}", "A-Za-z"), (r"\p{N}", "0-9")):
        out, inside = "", False
        for part in re.split(r"(\\p\{[LN]\}|[\[\]])", pattern):
            inside = (inside or part == "[") and part != "]"
            out += (plain if inside else f"[{plain}]") if part == name else part
        pattern = out
    return pattern


def explicit_space(pattern: str) -> str:
    """The pattern with every \\s and \\S written out as a class."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i:i + 2] if pattern[i] == "\\" else pattern[i]
        i += len(c)
        if c == r"\s":
            c = SPACE if inside else f"[{SPACE}]"
        elif c == r"\S":
            c = f"[^{SPACE}]"
        inside = (inside or c == "[") and c != "]"
        out.append(c)
    return "".join(out)


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def _digests(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for text in batch.column("text"):
                ids = enc.encode(text.as_py())
                counts.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(enc.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(ids_sha),
                 pa.array(text_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def _ids(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            ids = [np.frombuffer(enc.encode(t.as_py()), "<u4").astype(np.int32) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()),
                                              pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])
    return run


def _texts(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            texts = [enc.decode(np.array(x.as_py() or [], "<u4").tobytes()).decode("utf-8", "replace")
                     for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string())],
                                             ["doc_id", "text"])
    return run


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int) of every row; a null or empty text has no ids."""
    return _narrow(docs).mapInArrow(_ids(path, pattern), "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, text of every row of ids; a null list gives an empty text."""
    return encoded.select("doc_id", "ids").mapInArrow(_texts(path, pattern), "doc_id bigint, text string")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids (little-endian unsigned 32 bit) and of the decoded bytes.

    One pass without a shuffle; each row stands alone, so repeated rows and ids are no matter, and an empty
    table gives no rows. Null texts count as empty.
    """
    return _narrow(docs).mapInArrow(
        _digests(path, pattern), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
