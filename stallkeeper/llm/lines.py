"""Fuzzy line dedup: MinHash signatures of character shingles, banding with high recall, exact Jaccard
verification, and distributed union-find; one line of each component stays.

Lines are compared in lower case with white space runs as one blank; blank lines are structure and stay.
Equal lines are one node. The holders of a band key are sorted, in ranges that may cut a hot key anywhere,
and each is paired with the first holder in its range; the first holders of a cut key are paired across
ranges. So a hot band costs one pair per holder. Pairs of holders that this leaves unseen matter only where
they would join components: in a second round such keys are cut into tiles of bounded size, each pair of
chunks in one task, where all intersections of shingle sets come from one matrix product.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from stallkeeper.llm.common import batches_of, packed, stored
from stallkeeper.llm.components import connected

SHINGLE = 8          # characters
SIMILAR = 0.8        # Jaccard of shingle sets
BANDS, ROWS = 10, 4  # a pair at 0.8 shares a band with probability 0.995, at 0.9 all but surely
CHUNK = 1 << 16      # characters hashed, or shingles compared, at a time
PAIRWISE = 8         # lines of a tile that are compared pair by pair
TILE = 256           # lines of a chunk of a key's holders in the second round
NARROW = 50_000      # rows of a few numbers that a worker takes at a time
COMPARED = 2_000     # pairs of lines, or lines, that are worth a task of their own
SIEVE = 1 << 26      # bits of the map that tells which lines are worth sending
SEEN = 400_000       # lines a task remembers so as not to hash them again
_MULTIPLIERS = (np.random.RandomState(5).randint(1, 1 << 31, BANDS * ROWS).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
_FILL = "\U0010ffff"  # lengthens lines below one shingle


def normal(line: str) -> str:
    line = line.lower()
    if line.isprintable() and "  " not in line:  # no white space but single blanks
        return line.strip(" ")
    return " ".join(line.split())


def line_hash(line: str) -> int:
    """Signed 64-bit hash of a normal line; equal hashes are taken as equal lines."""
    from xxhash import xxh3_64_intdigest
    return xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63)


def shingles(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all windows over the joined lines, and each line's first window and end."""
    lines = [x if len(x) >= SHINGLE else x.ljust(SHINGLE, _FILL) for x in lines]
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    with np.errstate(over="ignore"):
        two = codes[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[1:]
        two ^= two >> np.uint64(31)
        four = two[:-2] * np.uint64(0xBF58476D1CE4E5B9) + two[2:]
        four ^= four >> np.uint64(30)
        eight = four[:-4] * np.uint64(0x94D049BB133111EB) + four[4:]
        eight ^= eight >> np.uint64(32)
        eight *= np.uint64(0xD6E8FEB86659FD93)
    size = np.array([len(x) for x in lines])
    start = np.cumsum(size) - size
    return eight, start, start + size - SHINGLE + 1


def _across(end: np.ndarray) -> np.ndarray:
    """Windows that lie across two lines."""
    return (end[:-1, None] + np.arange(SHINGLE - 1)).ravel()


def shingle_sets(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The lines' shingle sets, each sorted, in one array, and where each begins and the last one ends."""
    windows, start, end = shingles(lines)
    for a, b in zip(start.tolist(), end.tolist()):
        windows[a:b].sort()
    new = np.r_[True, windows[1:] != windows[:-1]]
    new[start] = True
    new[_across(end)] = False
    return windows[new], np.r_[0, np.cumsum(np.add.reduceat(new, start, dtype=np.int64))]


def near(flat: np.ndarray, begin: np.ndarray, a: np.ndarray, b: np.ndarray, similar: float) -> np.ndarray:
    """Whether the Jaccard similarity of sets a and b (numbers in ``begin``) of each pair reaches ``similar``."""
    size = np.diff(begin)
    small, large = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
    good = small / large >= similar  # as if one held the other
    left = np.flatnonzero(good)
    upto = np.cumsum(small[left] + large[left])
    at = 0
    while at < len(left):  # CHUNK values at a time, or one pair
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CHUNK, "right")))
        pair = np.stack([a[left[at:stop]], b[left[at:stop]]], 1).ravel()
        ends = np.cumsum(size[pair])
        values = flat[np.arange(ends[-1]) + np.repeat(begin[pair] - (ends - size[pair]), size[pair])]
        first = np.r_[0, ends[1:-1:2]]
        for x, y in zip(first.tolist(), ends[1::2].tolist()):
            values[x:y].sort(kind="stable")  # two sorted parts
        same = np.r_[values[1:] == values[:-1], False]
        same[ends[1::2] - 1] = False
        both = np.add.reduceat(same, first, dtype=np.int64)
        good[left[at:stop]] = both / (size[pair[::2]] + size[pair[1::2]] - both) >= similar
        at = stop
    return good


def band_keys(lines: list[str]) -> np.ndarray:
    """(lines, BANDS) keys of the bands of the lines' MinHash signatures."""
    out, at = [], 0
    while at < len(lines):
        stop, chars = at, 0
        while stop < len(lines) and (stop == at or chars + len(lines[stop]) <= CHUNK):
            chars += max(SHINGLE, len(lines[stop]))
            stop += 1
        windows, start, end = shingles(lines[at:stop])
        short = (windows >> np.uint64(32)).astype(np.uint32)
        short[_across(end)] = np.repeat(short[start[:-1]], SHINGLE - 1)  # no new values, so the least ones stay
        sign = np.stack([np.minimum.reduceat(short * m, start) for m in _MULTIPLIERS], 1).astype(np.uint64)
        keys = np.empty((stop - at, BANDS), np.uint64)
        with np.errstate(over="ignore"):
            for b in range(BANDS):
                key = np.full(stop - at, b + 1, np.uint64)
                for r in range(ROWS):
                    key = (key ^ sign[:, b * ROWS + r]) * np.uint64(0x9E3779B97F4A7C15)
                    key ^= key >> np.uint64(29)
                keys[:, b] = key
        out.append(keys)
        at = stop
    return np.concatenate(out).view(np.int64) if out else np.empty((0, BANDS), np.int64)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for batch in batches:
        dids, dks = batch.column("doc_id").to_pylist(), batch.column("dk").to_pylist()
        texts = batch.column("text")
        for at in range(0, len(dids), 100):
            did, dk, size, number, hashes, fresh, where = [], [], [], [], [], [], []
            for i in range(at, min(at + 100, len(dids))):
                before = len(hashes)
                for k, line in enumerate((texts[i].as_py() or "").split("\n")):
                    if not (line := normal(line)):
                        continue
                    h = line_hash(line)
                    if h not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(h)
                        fresh.append(line)
                        where.append(len(hashes))
                    did.append(dids[i])
                    dk.append(dks[i])
                    number.append(k)
                    hashes.append(h)
                size += [len(hashes) - before] * (len(hashes) - before)
            keys = band_keys(fresh)
            count = np.zeros(len(hashes) + 1, np.int32)
            count[np.array(where, np.int64) + 1] = BANDS
            bands = pa.ListArray.from_arrays(pa.array(np.cumsum(count, dtype=np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes, pa.int64()), pa.array(did, pa.int64()), pa.array(dk, pa.int64()),
                 pa.array(size, pa.int32()), pa.array(number, pa.int32()), bands],
                ["h", "doc_id", "dk", "n_lines", "line", "bands"])


def sieve(hashes: DataFrame):
    """A bit map of fixed size (SIEVE bits) of the given hashes, made by the tasks and broadcast. It only passes
    over lines nobody asked for; what it lets through by chance, the join after it drops."""
    low = F.col("h").bitwiseAND(F.lit(SIEVE - 1))
    words = hashes.groupBy(F.shiftrightunsigned(low, 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits")).toArrow()  # SIEVE / 64 rows at most
    bits = np.zeros(SIEVE // 64, np.int64)
    bits[words.column("w").to_numpy()] = words.column("bits").to_numpy()
    return hashes.sparkSession.sparkContext.broadcast(bits)


def _texts(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        bits = shared.value
        for batch in batches:
            lines = [y for t in batch.column("text") for x in (t.as_py() or "").split("\n") if (y := normal(x))]
            h = np.fromiter(map(line_hash, lines), np.int64, len(lines))
            low = h & (SIEVE - 1)
            out: dict[int, str] = {}
            for i in np.flatnonzero(bits[low >> 6] >> (low & 63) & 1).tolist():
                if (x := int(h[i])) not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(x)
                    out[x] = lines[i]
            yield pa.RecordBatch.from_arrays([pa.array(out.keys(), pa.int64()), pa.array(out.values(), pa.string())],
                                             ["h", "text"])
    return run


def _holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: each holder with the first one of its key here; the first and last key of
    the range, which other ranges may share, also with their first holder alone (edge)."""
    key_now = rep_now = first = None

    def rows(key, h, rep, edge):
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(h, pa.int64()),
                                           pa.array(rep, pa.int64()), pa.array(edge, pa.bool_())],
                                          ["key", "h", "rep", "edge"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key, h = batch.column("key").to_numpy(), batch.column("h").to_numpy()
        begins = np.r_[key[0] != key_now, key[1:] != key[:-1]]
        group = np.cumsum(begins)
        heads = np.r_[np.int64(rep_now or 0), h[begins]]
        rep = heads[group]
        if first is None:
            first = (int(key[0]), int(h[0]))
        key_now, rep_now = int(key[-1]), int(rep[-1])
        other = h != rep
        yield rows(key[other], h[other], rep[other], np.zeros(int(other.sum()), bool))
    if first is not None:
        ends = [first] if first[0] == key_now else [first, (key_now, rep_now)]
        k, r = [x for x, _ in ends], [x for _, x in ends]
        yield rows(k, r, r, [True] * len(k))


def _verify(similar: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            text_a, text_b = batch.column("text_a"), batch.column("text_b")
            good, at = [], 0
            while at < len(a):  # pairs of lines of about CHUNK characters
                number: dict[int, int] = {}
                lines, chars, stop = [], 0, at
                while stop < len(a) and chars < CHUNK:
                    for h, text in ((a[stop], text_a), (b[stop], text_b)):
                        if h not in number:
                            number[h] = len(lines)
                            lines.append(text[stop].as_py())
                            chars += len(lines[-1])
                    stop += 1
                x, y = (np.array([number[h] for h in side[at:stop]]) for side in (a, b))
                good.append(near(*shingle_sets(lines), x, y, similar))
                at = stop
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(
                pa.array(np.concatenate(good) if good else np.zeros(0, bool)))
    return run


def _verified(pairs: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    left = texts.select(F.col("h").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("h").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(
        _verify(similar), "a bigint, b bigint")


def overlaps(flat: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sizes of all intersections of sets that stand in one array."""
    code = np.unique(flat, return_inverse=True)[1].ravel()
    line = np.repeat(np.arange(len(size)), size)
    shared = np.bincount(code) > 1  # a shingle of one line alone adds to no intersection
    number = np.cumsum(shared) - 1
    keep = shared[code]
    code, line = number[code[keep]], line[keep]
    both = np.zeros((len(size), len(size)), np.float32)
    order = np.argsort(code, kind="stable")
    code, line = code[order], line[order]
    for low in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(code, [low, low + 4096])
        part = np.zeros((len(size), min(4096, int(shared.sum()) - low)), np.float32)
        part[line[a:b], code[a:b] - low] = 1
        both += part @ part.T
    return both


def _tiles(similar: float):
    """Rows sorted by (key, tile): links between classes so far, of lines of a tile that are in different ones, as far
    as they join more. Small tiles are taken many at a time and compared pair by pair."""
    def alike(flat: np.ndarray, begin: np.ndarray, c: np.ndarray) -> Iterator[tuple[int, int]]:
        size = np.diff(begin)
        both = overlaps(flat, size)
        likely = both >= similar * (size[:, None] + size[None, :] - both) - 1e-3
        likely &= c[:, None] != c[None, :]
        for i, j in zip(*np.nonzero(np.triu(likely, 1))):
            if int(both[i, j]) / (int(size[i]) + int(size[j]) - int(both[i, j])) >= similar:
                yield i, j

    def compare(tiles: list[tuple[list[int], list[str]]]) -> tuple[list[int], list[int]]:
        flat, begin = shingle_sets([x for _, texts in tiles for x in texts])
        c = np.array([x for classes, _ in tiles for x in classes])
        ends = np.cumsum([len(classes) for classes, _ in tiles])
        first, second, found, at = [], [], [], 0
        for end in ends.tolist():
            if end - at <= PAIRWISE:
                i, j = np.triu_indices(end - at, 1)
                first.append(at + i)
                second.append(at + j)
            else:
                found += [(at + i, at + j) for i, j in alike(flat[begin[at]:begin[end]], begin[at:end + 1], c[at:end])]
            at = end
        if first:
            i, j = np.concatenate(first), np.concatenate(second)
            other = c[i] != c[j]
            i, j = i[other], j[other]
            good = near(flat, begin, i, j, similar)
            found += zip(i[good].tolist(), j[good].tolist())
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while up.get(x, x) != x:
                up[x] = x = up.get(up[x], up[x])
            return x

        a, b = [], []
        for i, j in found:
            x, y = root(int(c[i])), root(int(c[j]))
            if x != y:
                up[max(x, y)] = min(x, y)
                a.append(int(c[i]))
                b.append(int(c[j]))
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(tiles):
            a, b = compare(tiles)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        at, tiles, chars = None, [], 0
        for batch in batches:
            for key, tile, c, text in zip(*(batch.column(x).to_pylist() for x in ("key", "tile", "c", "text"))):
                if (key, tile) != at:
                    if chars >= CHUNK:
                        yield links(tiles)
                        tiles, chars = [], 0
                    at = (key, tile)
                    tiles.append(([], []))
                tiles[-1][0].append(c)
                tiles[-1][1].append(text)
                chars += len(text)
        if tiles:
            yield links(tiles)
    return run


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.xxhash64(F.col("text").cast("string")).alias("dk"))


def classes(lines: DataFrame, docs: DataFrame, similar: float) -> DataFrame:
    """(node, component) of line hashes that are near copies of other lines."""
    keys = lines.select(F.explode("bands").alias("key"), "h").repartitionByRange("key", "h").sortWithinPartitions("key")
    with batches_of(docs.sparkSession, NARROW):
        found = stored(keys.mapInArrow(_holders, "key bigint, h bigint, rep bigint, edge boolean"), BANDS * lines.count())
    ends = found.where("edge").select("key", "rep")
    low = ends.groupBy("key").agg(F.min("rep").alias("low"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    across = ends.join(low, "key").where("rep != low").select("key", F.col("rep").alias("h"), F.col("low").alias("rep"))
    held = stored(found.where("not edge").select("key", "h", "rep").unionAll(across), found.count())
    n_held = held.count()
    pairs = stored(held.select(F.least("h", "rep").alias("a"), F.greatest("h", "rep").alias("b")).distinct(), n_held)
    n_pairs = pairs.count()
    need = pairs.select(F.col("a").alias("h")).unionAll(pairs.select(F.col("b").alias("h"))).distinct()
    texts = stored(_keyed(docs).select("text").mapInArrow(_texts(sieve(need)), "h bigint, text string")
                   .join(need, "h", "left_semi").groupBy("h").agg(F.first("text").alias("text")), 2 * n_pairs, COMPARED)
    links = stored(_verified(pairs, texts, similar), n_pairs, COMPARED)
    n_links = links.count()
    first = stored(connected(links, rows=n_links), 2 * n_links)
    # Holders of one key that the first round left apart and did not compare with each other. Keys with the
    # same holders say the same, so one of them is enough.
    held = stored(held.select("key", "h").unionAll(held.select("key", F.col("rep").alias("h"))).distinct()
                  .join(first, F.col("h") == F.col("node"), "left")
                  .select("key", "h", F.coalesce("component", "h").alias("c")), 2 * n_held)
    mixed = (held.groupBy("key").agg(F.min("c").alias("_low"), F.max("c").alias("_high"), F.count(F.lit(1)).alias("n"),
                                     F.bit_xor(F.xxhash64("h")).alias("_who"))
             .where("_low != _high AND n > 2").groupBy("n", "_who").agg(F.min("key").alias("key")))
    chunks = F.ceil(F.col("n") / TILE).cast("int")
    dealt = (held.join(mixed, "key").withColumn("_chunks", chunks)
             .withColumn("_own", F.pmod(F.xxhash64("h"), F.col("_chunks")).cast("int"))
             .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
             .select("key", (F.least("_own", "_other").cast("bigint") * F.col("_chunks")
                             + F.greatest("_own", "_other")).alias("tile"), "h", "c")
             .join(texts, "h"))
    more = stored(dealt.repartition("key", "tile").sortWithinPartitions("key", "tile", "h").select(
        "key", "tile", "h", "c", "text").mapInArrow(_tiles(similar), "a bigint, b bigint"))
    # Only classes are joined: a class is named by its smallest line, so the smallest class names the union.
    n_more = more.count()
    second = stored(connected(more, rows=n_more), 2 * n_more)
    merged = second.select(F.col("node").alias("_class"), F.col("component").alias("_root"))
    alone = second.join(first, "node", "left_anti").select("node", "component")  # lines that were a class of their own
    return (first.join(merged, F.col("component") == F.col("_class"), "left")
            .select("node", F.coalesce("_root", "component").alias("component")).unionAll(alone))


def _place() -> Column:
    return F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc_id"), "line", "dk")


def _judged(docs: DataFrame, similar: float) -> tuple[DataFrame, DataFrame]:
    """Lines that are no blanks (h, doc_id, dk, n_lines of the document, line), and of those that stand in several
    places or have near copies: _h, component, keeper."""
    lines = stored(_keyed(docs).mapInArrow(
        _lines, "h bigint, doc_id bigint, dk bigint, n_lines int, line int, bands array<bigint>"))
    root = classes(lines, docs, similar)
    firsts = stored(lines.groupBy("h").agg(F.min(_place()).alias("first"), F.count(F.lit(1)).alias("n")), lines.count())
    copies = stored(firsts.join(root, F.col("h") == F.col("node")).select("h", "component", "first"), firsts.count())
    keepers = copies.groupBy("component").agg(F.min("first").alias("keeper"))
    alone = firsts.where("n > 1").join(copies, "h", "left_anti")
    return lines.drop("bands"), copies.join(keepers, "component").select(
        F.col("h").alias("_h"), "component", "keeper").unionAll(alone.select("h", "h", "first"))


def decisions(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """One row per line that is no blank: doc_id, dk (hash of the text), line (from 0), component (line hash
    that names the class), keeper (struct doc_id, line, dk of the line that stays), kept.

    Of a class, the line with the smallest document id stays, then the smallest line number; rows without an
    id come last. Rows that repeat id and text share one decision.
    """
    lines, judged = _judged(docs, similar)
    keeper = F.coalesce("keeper", _place())
    return lines.join(judged, F.col("h") == F.col("_h"), "left").select(
        "doc_id", "dk", "line", F.coalesce("component", "h").alias("component"), keeper.alias("keeper"),
        (_place() == keeper).alias("kept"))


def removed(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id, dk, n_lines (not blank), gone (sorted line numbers to remove) of documents with such lines."""
    lines, judged = _judged(docs, similar)
    gone = (lines.join(judged, F.col("h") == F.col("_h")).where(_place() != F.col("keeper"))
            .groupBy(F.col("doc_id").alias("_id"), F.col("dk").alias("_dk")).agg(F.array_sort(F.collect_set("line")).alias("gone")))
    sizes = lines.groupBy("doc_id", "dk").agg(F.max("n_lines").alias("n_lines"))
    return (sizes.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("dk") == F.col("_dk")), "left")
            .select("doc_id", "dk", "n_lines", F.coalesce("gone", F.array().cast("array<int>")).alias("gone")))


def report(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_removed, removed (line numbers, comma-joined)."""
    gone = removed(docs, similar).select(F.col("doc_id").alias("_id"), F.col("dk").alias("_dk"), "n_lines", "gone")
    rows = _keyed(docs).select("doc_id", "dk")
    none = F.lit(0)
    return (rows.join(gone, rows["doc_id"].eqNullSafe(F.col("_id")) & (rows["dk"] == F.col("_dk")), "left")
            .select("doc_id", F.coalesce("n_lines", none).cast("bigint").alias("n_lines"),
                    F.coalesce(F.size("gone"), none).cast("bigint").alias("n_removed"),
                    F.coalesce(F.array_join(F.col("gone").cast("array<string>"), ","), F.lit("")).alias("removed")))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, gone in zip(batch.column("text"), batch.column("gone")):
            drop = set(gone.as_py())
            texts.append("\n".join(x for i, x in enumerate(text.as_py().split("\n")) if i not in drop))
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "cut"])


def clean(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """``docs`` without the lines that repeat; columns as they are, ``n_chars`` (if there) counted anew.

    A document of which no word is left, though it had some, goes: all of it stands elsewhere. Documents
    without any line to compare (null, empty or blank texts) stay as they are.
    """
    gone = removed(docs, similar).where(F.size("gone") > 0).select(
        F.col("doc_id").alias("_id"), F.col("dk").alias("_dk"), "n_lines", "gone")
    rows = packed(docs)
    text = F.col("row.text").cast("string")
    both = rows.join(gone, F.col("row.doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_dk")), "left")
    untouched = both.where("gone is null").select("row.*")
    touched = both.where(F.size("gone") < F.col("n_lines")).select(
        F.col("row").dropFields("text").alias("row"), text.alias("text"), "gone")
    cut = touched.mapInArrow(_cut, T.StructType([touched.schema["row"], T.StructField("cut", T.StringType())]))
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    new = {"text": F.col("cut").cast(kinds["text"])}
    if "n_chars" in kinds:
        new["n_chars"] = F.char_length("cut").cast(kinds["n_chars"])
    return untouched.unionAll(cut.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns]))
