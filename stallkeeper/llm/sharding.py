"""Sharding by a k-d tree over document metadata.

The box of all documents is split again and again along its widest dimension at a weighted median of bytes,
until a leaf holds the bytes of one shard. A median is found by counting bytes in bins of the keys of all
boxes of a level at once, then in the bin that holds the median, and so on; only bounds and sums of each box
reach the driver, at most one row per shard. Keys carry a hash below the value, so a value that most
documents share can be split as well.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stallkeeper.llm.common import stored
from stallkeeper.llm.ranks import numbered_sources, running

SHARDS = 16
BINS = 14               # bits of a key that one pass resolves
EXACT = 0.0002          # a bin below this share of its box is not cut further
VALUE_BITS, HASH_BITS = 22, 40  # of a key; a hash of the row lies below the value
LIKE_BITS = 16          # of the hash, that tell rows apart which are alike in all columns
DIMENSIONS = ("source", "lang", "size", "doc_id")


def _category(rows: DataFrame, name: str) -> DataFrame:
    """(value, place in [0, 1]) of a text column, in code-point order, null last."""
    places = numbered_sources(rows.select(name).distinct(), "_n", F.col(name).asc_nulls_last())
    last = F.greatest(places.agg(F.max("_n").alias("m")).select("m").scalar(), F.lit(1))
    return places.select(F.col(name).alias("_value"), (F.col("_n") / last).alias("_place"))


def coordinates(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, a spread hash, and one key per dimension: the value in 2**22 steps of its
    range in the table, then 40 bits of the hash. Nulls lie at the upper end."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = stored(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
                              F.col("lang").cast("string").alias("lang"),
                              (F.octet_length(text) + 1).cast("bigint").alias("size"),
                              F.crc32(text.cast("binary")).alias("text_crc32"),
                              F.monotonically_increasing_id().alias("_number")))  # fixed by the store
    low, high, largest = rows.agg(F.min("doc_id"), F.max("doc_id"), F.max("size")).first()
    span, most = max((high or 0) - (low or 0), 1), max(largest or 2, 2)
    places: dict[str, Column] = {
        "size": F.log2(F.col("size").cast("double")) / F.log2(F.lit(float(most))),
        "doc_id": (F.col("doc_id").cast("double") - float(low or 0)) / float(span)}
    for name in ("source", "lang"):
        found = _category(rows, name).select(F.col("_value").alias(f"_{name}"), F.col("_place").alias(f"_at_{name}"))
        rows = rows.join(found, rows[name].eqNullSafe(F.col(f"_{name}"))).drop(f"_{name}")
        places[name] = F.col(f"_at_{name}")
    # Rows alike in all columns differ in the number the store gave them, so that cuts can part them.
    part = lambda c, bits: c.bitwiseAND(F.lit((1 << bits) - 1))
    spread = F.shiftleft(part(F.xxhash64("doc_id", "text_crc32", "size"), HASH_BITS - LIKE_BITS), LIKE_BITS).bitwiseOR(
        part(F.xxhash64("_number"), LIKE_BITS))
    steps = float((1 << VALUE_BITS) - 1)
    key = {d: F.shiftleft(F.floor(F.least(F.greatest(F.coalesce(p, F.lit(1.0)), F.lit(0.0)), F.lit(1.0)) * steps)
                          .cast("bigint"), HASH_BITS).bitwiseOR(F.col("spread")) for d, p in places.items()}
    rows = rows.withColumn("spread", spread)
    return stored(rows.select("doc_id", "size", "text_crc32", "spread", *[key[d].alias(f"k_{d}") for d in DIMENSIONS]))


def _with_boxes(rows: DataFrame, boxes: list[tuple], names: str) -> DataFrame:
    """Join facts of boxes (at most one row per shard) to the rows of the boxes."""
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(boxes, names)), "box")


def _cuts(rows: DataFrame, open_boxes: dict[int, int]) -> dict[int, tuple[str, int]]:
    """Dimension and last key of the lower part of every open box (box: shards in it)."""
    per_box = rows.groupBy("box").agg(
        F.sum("size").alias("bytes"), *[f(f"k_{d}").alias(f"{n}_{d}") for d in DIMENSIONS
                                        for n, f in (("lo", F.min), ("hi", F.max))]).collect()
    state = {}
    for r in per_box:
        if r["box"] in open_boxes:
            wide = max(DIMENSIONS, key=lambda d: (r[f"hi_{d}"] >> HASH_BITS) - (r[f"lo_{d}"] >> HASH_BITS))
            k = open_boxes[r["box"]]
            state[r["box"]] = {"dim": wide, "lo": r[f"lo_{wide}"], "hi": r[f"hi_{wide}"],
                               "need": r["bytes"] * (k // 2) / k, "enough": r["bytes"] * EXACT}
    cuts = {}
    while state:
        for s in state.values():
            s["shift"] = max(0, (s["hi"] - s["lo"]).bit_length() - BINS)
        facts = [(b, DIMENSIONS.index(s["dim"]), s["lo"], s["hi"], s["shift"], float(s["need"])) for b, s in state.items()]
        own = _with_boxes(rows, facts, "box int, dim int, lo bigint, hi bigint, shift int, need double")
        key = F.element_at(F.array(*[F.col(f"k_{d}") for d in DIMENSIONS]), F.col("dim") + 1)
        bins = (own.withColumn("key", key).where("key between lo and hi")
                .groupBy("box", F.expr("shiftright(key - lo, shift)").alias("bin")).agg(
                    F.sum("size").alias("w"), F.first("need").alias("need")))
        upto = W.partitionBy("box").orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)  # 2**BINS rows
        hit = (bins.withColumn("cum", F.sum("w").over(upto)).where(F.col("cum") >= F.col("need")).groupBy("box")
               .agg(F.min(F.struct("bin", "w", "cum")).alias("m")).select("box", "m.*").collect())
        for r in hit:
            s = state[r["box"]]
            before = r["cum"] - r["w"]
            lo = s["lo"] + (r["bin"] << s["shift"])
            hi = min(s["hi"], lo + (1 << s["shift"]) - 1)
            if s["shift"] == 0 or r["w"] <= s["enough"]:
                nearer = hi if r["cum"] - s["need"] <= s["need"] - before else lo - 1
                cuts[r["box"]] = (s["dim"], nearer)
                del state[r["box"]]
            else:
                s |= {"lo": lo, "hi": hi, "need": s["need"] - before}
        if not hit:  # only boxes without rows are left
            break
    return cuts


def shard(docs: DataFrame, shards: int = SHARDS, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of ``docs`` (doc_id, text, source, lang).

    Law ``bytes``: shards hold nearly equal sizes, where a size is the bytes of the text plus one (null text:
    one). ``target_bytes`` sets the number of shards by their wanted size instead. Slots count from 0 without
    a gap within a shard, in hash order. Rows alike in all columns are interchangeable; repeated or null ids
    are rows of their own. An empty table gives no rows; fewer rows than shards leave shards empty.
    """
    rows = coordinates(docs)
    if target_bytes:
        total = rows.agg(F.sum("size")).first()[0] or 0
        shards = max(1, -(-total // target_bytes))
    placed = rows.withColumn("box", F.lit(0)).withColumn("first", F.lit(0))
    leaves, firsts = {0: shards}, {0: 0}  # box: shards in it, number of its first one
    while any(k > 1 for k in leaves.values()):
        open_boxes = {b: k for b, k in leaves.items() if k > 1}
        cuts = _cuts(placed, open_boxes)
        facts, next_leaves, next_firsts = [], {}, {}
        for b, k in leaves.items():
            low = k // 2
            dim, cut = cuts.get(b, (DIMENSIONS[0], (1 << 62)))
            if k == 1:
                facts.append((b, 0, 1 << 62, firsts[b], firsts[b]))
                next_leaves[firsts[b]], next_firsts[firsts[b]] = 1, firsts[b]
                continue
            up = firsts[b] + low
            facts.append((b, DIMENSIONS.index(dim), cut, firsts[b], up))
            next_leaves |= {firsts[b]: low, up: k - low}
            next_firsts |= {firsts[b]: firsts[b], up: up}
        key = F.element_at(F.array(*[F.col(f"k_{d}") for d in DIMENSIONS]), F.col("dim") + 1)
        placed = (_with_boxes(placed, facts, "box int, dim int, cut bigint, lower int, upper int")
                  .withColumn("box", F.when(key <= F.col("cut"), F.col("lower")).otherwise(F.col("upper")))
                  .drop("dim", "cut", "lower", "upper"))
        leaves, firsts = next_leaves, next_firsts
    placed = stored(placed.select("doc_id", "size", "text_crc32", "spread", F.col("box").alias("shard"),
                                  F.lit(1).alias("one"), (F.col("spread") / float(1 << HASH_BITS)).alias("position")))
    order = [F.col(c) for c in ("spread", "doc_id", "text_crc32", "size")]
    return running(placed, ["shard"], "position", order, "one").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.col("before").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
