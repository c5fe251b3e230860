"""SimHash near-duplicates: pigeonhole blocks find candidates, Hamming distances confirm them.

Fingerprints that differ in at most d bits agree on n - d of n blocks of bits, so close pairs share the key
of at least one choice of n - d blocks. Equal fingerprints are one node, named by the fingerprint. Keys that more than one node holds
are dealt to tasks; a key with many holders is cut into tiles of bounded size, each pair of chunks in one
task, so no task sees a whole hot key and every pair is still compared. A task reports links only as far
as they join nodes of its tile that were not joined yet, never all pairs of a group.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stallkeeper.llm.common import packed, stored
from stallkeeper.llm.components import connected

WORDS, BITS, DISTANCE, SEED = 4, 64, 4, 42
TILE = 2048      # nodes of a chunk
SMALL = 48       # groups up to this size are compared pair by pair


def shingle_hashes(text: str | None, words: int = WORDS) -> list[int]:
    """XXH64 of the word shingles of a text, A-Z in lower case, words between ASCII white space."""
    import xxhash

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return []
    joined, h = b" ".join(tokens), xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return [h(joined, SEED)]
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:len(tokens) - words + 1].tolist()
    return [h(joined[s:e], SEED) for s, e in zip(starts, ends[words - 1:].tolist())]


def fingerprint(hashes: list[int]) -> int:
    """Bit set where more than half of the hashes have it; signed 64 bit."""
    if not hashes:
        return 0
    raw = np.array(hashes, np.uint64)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(raw), 1 << 16):
        part = raw[at:at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(raw), bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [fingerprint(shingle_hashes(t.as_py())) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(prints, pa.int64())],
                                         ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(_fingerprints, "doc_id bigint, fp bigint")


def block_count(nodes: int, distance: int = DISTANCE) -> int:
    """Fewest blocks whose keys have enough bits for chance holders of a key to stay few. Results are the
    same for every choice; more blocks mean longer keys and more of them per node."""
    for blocks in range(distance + 1, 2 * distance + 4):
        if 2 ** ((blocks - distance) * BITS // blocks) >= 4 * nodes:
            return blocks
    return 2 * distance + 4


def block_keys(fp: Column, blocks: int, distance: int = DISTANCE) -> Column:
    """The keys of a fingerprint, one for every choice of blocks - distance blocks."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    part = [F.shiftrightunsigned(fp, edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1))
            for i in range(blocks)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - distance)):
        key = F.lit(number).cast("bigint")
        for i in chosen:
            key = F.shiftleft(key, edges[i + 1] - edges[i]).bitwiseOR(part[i])
        keys.append(key)
    assert len(keys) == comb(blocks, distance)
    return F.array(*keys)


def tile_links(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (positions) that join the nodes of one tile into its components."""
    n = len(fps)
    label = np.arange(n)
    near = np.empty((n, n), bool)
    for at in range(0, n, 256):
        near[at:at + 256] = np.bitwise_count(fps[at:at + 256, None] ^ fps[None, :]) <= distance
    while True:  # every round takes the smallest label in reach, then the label of that label
        low = np.array([label[row].min() for row in near])
        low = low[low]
        if (low == label).all():
            break
        label = low
    at = np.flatnonzero(label != np.arange(n))
    return at, label[at]


def _close(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "tile", "fp")]
            if left is not None:
                now = [np.concatenate(x) for x in zip(left, now)]
            last = np.flatnonzero((now[0] == now[0][-1]) & (now[1] == now[1][-1]))[0] if len(now[0]) else 0
            left = [x[last:] for x in now]
            if last:
                yield compare([x[:last] for x in now])
        if left is not None and len(left[0]):
            yield compare(left)

    def compare(rows: list[np.ndarray]) -> pa.RecordBatch:
        key, tile, node = rows
        fp = node.view(np.uint64)
        first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])])
        size = np.diff(np.r_[first, len(key)])
        group = np.repeat(np.arange(len(first)), size)
        small = size <= SMALL
        left, right = [], []
        for step in range(1, int(size[small].max(initial=1))):
            i = np.flatnonzero((group[step:] == group[:-step]) & small[group[step:]])
            i = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= distance]
            left.append(node[i])
            right.append(node[i + step])
        for g in np.flatnonzero(~small):
            own = slice(first[g], first[g] + size[g])
            a, b = tile_links(fp[own], distance)
            left.append(node[own][a])
            right.append(node[own][b])
        a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())],
                                          ["a", "b"])
    return run


def links(nodes: DataFrame, distance: int = DISTANCE, tile: int = TILE) -> DataFrame:
    """Links (a, b) that join distinct fingerprints (fp) within ``distance`` bits into components."""
    blocks = block_count(nodes.count(), distance)
    keys = nodes.select(F.explode(block_keys(F.col("fp"), blocks, distance)).alias("key"), "fp")
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / tile).cast("int")
    chunk = F.pmod(F.xxhash64("fp"), chunks).cast("int")
    # A chunk meets every other one in one tile; the tile number is the same from either side.
    other = F.explode(F.when(F.col("_chunks") == 1, F.array(F.lit(0))).otherwise(
        F.sequence(F.lit(0), F.col("_chunks") - 1)))
    dealt = (keys.join(shared, "key").select("key", "fp", chunks.alias("_chunks"), chunk.alias("_chunk"))
             .withColumn("_other", other)
             .select("key", (F.least("_chunk", "_other").cast("bigint") * F.col("_chunks")
                             + F.greatest("_chunk", "_other")).alias("tile"), "fp"))
    return (dealt.repartition("key", "tile").sortWithinPartitions("key", "tile", "fp")
            .mapInArrow(_close(distance), "a bigint, b bigint").distinct())


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, fp (signed 64 bit), component_id.

    Texts without words (null, empty, blank) have fingerprint 0 and link like any other. Documents with equal
    fingerprints are one node under their smallest id, so large groups of copies cost one node. Rows without
    an id get their fingerprint's component if another document has that fingerprint, else null. Repeated
    ids are rows of their own. An empty table gives no rows.
    """
    prints = stored(fingerprints(docs))
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("id")))
    known = nodes.where("id is not null")
    found = connected(links(known.select("fp"), distance))
    labelled = nodes.join(found, F.col("fp") == F.col("node"), "left").select(
        "fp", "id", F.coalesce("component", "fp").alias("root"))
    smallest = labelled.groupBy("root").agg(F.min("id").alias("component_id"))
    classes = labelled.join(smallest, "root").select(F.col("fp").alias("_fp"), "component_id")
    return prints.join(classes, F.col("fp") == F.col("_fp"), "left").select("doc_id", "fp", "component_id")


# ---------------------------------------------------------------- by similarity

VERIFY = 256         # bits on which candidates are compared
SPARE = 1.0          # standard deviations by which the bound on differing bits exceeds its mean at the similarity
_MIX = np.uint64(0x9E3779B97F4A7C15)


def agreement(similarity: float) -> float:
    """Chance that a bit agrees for two texts whose shingle sets have this Jaccard similarity: the angle between sets
    of equal size with cosine 2 s / (1 + s)."""
    return 1 - float(np.arccos(2 * similarity / (1 + similarity))) / np.pi


def bound(similarity: float) -> int:
    """Differing bits of VERIFY up to which two texts link."""
    q = 1 - agreement(similarity)
    return int(VERIFY * q + SPARE * np.sqrt(VERIFY * q * (1 - q)))


def layout(nodes: int, similarity: float, recall: float) -> tuple[int, int]:
    """Bits of a block and number of blocks: blocks are long enough for chance holders of a key to stay few, and as many
    as it takes for a pair at the similarity to share one with probability ``recall``."""
    bits = max(8, (max(nodes, 1) - 1).bit_length())
    return bits, int(np.ceil(np.log(1 - recall) / np.log(1 - agreement(similarity) ** bits)))


def wide(hashes: list[int], words64: int) -> np.ndarray:
    """``64 * words64`` fingerprint bits of a set of hashes, as words; no hashes: zeros."""
    if not hashes:
        return np.zeros(words64, np.uint64)
    raw = np.unique(np.array(hashes, np.uint64))
    counts = np.zeros((words64, BITS), np.int64)
    with np.errstate(over="ignore"):
        for at in range(0, len(raw), 1 << 14):
            part = raw[at:at + (1 << 14)]
            for i in range(words64):
                z = (part + np.uint64(i + 1) * _MIX) * np.uint64(0xBF58476D1CE4E5B9)
                z ^= z >> np.uint64(31)
                z *= np.uint64(0x94D049BB133111EB)
                z ^= z >> np.uint64(29)
                counts[i] += np.unpackbits(z.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
                    axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(raw), axis=1, bitorder="little").view("<u8").ravel()


def _keys(words: int, bits: int, blocks: int):
    """Per text: node (hash of its words), the compared bits, and one key per block."""
    size = VERIFY // 64 + -(-bits * blocks // 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        seen: set[int] = set()
        for batch in batches:
            node, prints, keys = [], [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                t = _node(text)
                if t in seen:
                    continue
                if len(seen) >= 400_000:
                    seen.clear()
                seen.add(t)
                w = wide(shingle_hashes(text, words), size)
                node.append(t)
                prints.append(w[:VERIFY // 64].tobytes())
                flat = np.unpackbits(w[VERIFY // 64:].view(np.uint8), bitorder="little")[:bits * blocks].reshape(blocks, bits)
                packed_bits = np.packbits(flat, axis=1)
                keys.append([xxhash.xxh3_64_intdigest(k.tobytes(), i) - (1 << 63) for i, k in enumerate(packed_bits)])
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(prints, pa.binary()),
                                              pa.array(keys, pa.list_(pa.int64()))], ["node", "print", "keys"])
    return run


def _node(text: str) -> int:
    from xxhash import xxh3_64_intdigest
    return xxh3_64_intdigest(b" ".join(text.encode("utf-8", "surrogatepass").lower().split())) - (1 << 63)


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("dk"), pa.array(
            [_node(t.as_py() or "") for t in batch.column("text")], pa.int64())], ["doc_id", "dk", "node"])


def joined(prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (positions) that join fingerprints (rows of words) within ``distance`` bits into their components."""
    n = len(prints)
    near = np.empty((n, n), bool)
    for at in range(0, n, 128):
        near[at:at + 128] = np.bitwise_count(prints[at:at + 128, None] ^ prints[None]).sum(2, dtype=np.int32) <= distance
    label = np.arange(n)
    while True:
        low = np.array([label[row].min() for row in near])
        low = low[low]
        if (low == label).all():
            break
        label = low
    at = np.flatnonzero(label != np.arange(n))
    return at, label[at]


def _near(distance: int):
    """Rows sorted by (key, tile): links that join the nodes of a tile."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, node, prints = None, [], []

        def links() -> tuple[list[int], list[int]]:
            if len(node) == 2:
                x, y = (np.frombuffer(p, np.uint64) for p in prints)
                return ([node[0]], [node[1]]) if int(np.bitwise_count(x ^ y).sum()) <= distance else ([], [])
            i, j = joined(np.frombuffer(b"".join(prints), np.uint64).reshape(len(node), -1), distance)
            return [node[x] for x in i], [node[x] for x in j]

        for batch in batches:
            a, b = [], []
            for key, tile, n, p in zip(*(batch.column(c).to_pylist() for c in ("key", "tile", "node", "print"))):
                if (key, tile) != at:
                    if len(node) > 1:
                        x, y = links()
                        a += x
                        b += y
                    at, node, prints = (key, tile), [], []
                node.append(n)
                prints.append(p)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        if len(node) > 1:
            a, b = links()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
    return run


def similar(docs: DataFrame, words: int = 5, similarity: float = 0.8, recall: float = 0.95, tile: int = TILE // 4) -> DataFrame:
    """One row per row of ``docs``: doc_id, dk (hash of the text), node (hash of its words), component (a node's name).

    Texts link whose shingle sets of ``words`` words are estimated at ``similarity`` or more, by the differing bits of a
    fingerprint of VERIFY bits; candidates share one of many blocks of further bits. ``recall`` is the share of pairs at
    that similarity with a block in common. Texts of the same words are one node. A key with many holders is cut into
    tiles; a tile reports only what joins its nodes.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .withColumn("dk", F.xxhash64("text"))
    named = stored(rows.select("doc_id", "dk", "text").mapInArrow(_nodes, "doc_id bigint, dk bigint, node bigint"))
    bits, blocks = layout(named.agg(F.approx_count_distinct("node")).first()[0], similarity, recall)
    prints = stored(rows.select("text").mapInArrow(_keys(words, bits, blocks), "node bigint, print binary, keys array<bigint>"))
    keyed = prints.select(F.explode("keys").alias("key"), "node", "print")
    shared = (keyed.select("key", "node").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("_low"),
                                                             F.max("node").alias("_high"))
              .where("n > 1 AND _low != _high").select("key", "n"))
    chunks = F.ceil(F.col("n") / tile).cast("int")
    chunk = F.pmod(F.xxhash64("node"), F.col("_chunks")).cast("int")
    other = F.explode(F.when(F.col("_chunks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    dealt = (keyed.join(shared, "key").withColumn("_chunks", chunks).withColumn("_chunk", chunk).withColumn("_other", other)
             .select("key", (F.least("_chunk", "_other").cast("bigint") * F.col("_chunks")
                             + F.greatest("_chunk", "_other")).alias("tile"), "node", "print"))
    links_ = dealt.repartition("key", "tile").sortWithinPartitions("key", "tile", "node").mapInArrow(
        _near(bound(similarity)), "a bigint, b bigint")
    found = connected(links_).select(F.col("node").alias("_node"), "component")
    return named.join(found, F.col("node") == F.col("_node"), "left").select(
        "doc_id", "dk", "node", F.coalesce("component", "node").alias("component"))


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8, recall: float = 0.95) -> DataFrame:
    """``docs`` with one row of each component of ``similar`` texts: the one with the smallest id (none: last), of equal
    ids the smallest hash of the text. Rows that repeat id and text are one document and stay once; rows without any
    word are copies of each other. Columns stay as they are; an empty table stays empty."""
    named = stored(similar(docs, words, similarity, recall))
    place = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), F.col("doc_id").isNull().alias("none"), "dk")
    first = named.groupBy("component").agg(F.min(place).alias("first")).select(
        F.col("first.id").alias("_id"), F.col("first.none").alias("_none"), F.col("first.dk").alias("_dk"))
    often = named.groupBy(place.alias("p")).agg(F.count(F.lit(1)).alias("_rows")).select(
        F.col("p.id").alias("_id"), F.col("p.none").alias("_none"), F.col("p.dk").alias("_dk"), "_rows")
    best = first.join(often, ["_id", "_none", "_dk"])
    rows = packed(docs).select(
        "row", F.coalesce(F.col("row.doc_id").cast("bigint"), F.lit((1 << 63) - 1)).alias("_id"),
        F.col("row.doc_id").isNull().alias("_none"), F.xxhash64(F.col("row.text").cast("string")).alias("_dk"))
    kept = rows.join(best, ["_id", "_none", "_dk"])
    once = kept.where("_rows = 1").select("row")
    again = kept.where("_rows > 1").dropDuplicates(["_id", "_none", "_dk"]).select("row")
    return once.unionAll(again).select("row.*")
