"""Mixing sources to target weights.

Every source gets a share of a word budget in proportion to its weight. Inside a source, documents are
ordered by Efraimidis-Spirakis sampling: an exponential key, scaled by the document's quality weight, is
drawn from a hash of the document id, and documents are taken in key order until the running sum of
their words reaches the source's budget. A budget above the source's own words first takes complete
epochs of all documents; only what is left over is sampled.

DataFrame functions only. A source may hold a third of all rows: its order is cut into cells
(``ranks.running``).
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from stallkeeper.llm.common import packed, stored, words_in
from stallkeeper.llm.ranks import numbered_sources, running

WEIGHTS = (5, 2, 1)
SHARE = 1.5   # words of the mix per word of the corpus
CAP = 2       # a source gives each of its words this often at most
SEED = 7
QUALITY = {1: 4.0, 0: 1.0}  # weight of a label; all weights are 1 or more
UNLABELLED = 2.0


def level(sources: DataFrame, share: float, cap: int) -> tuple[float, int]:
    """Words per unit of weight for sources below their cap, and all words.

    Sources over their cap stop there and free their excess, until none is above. One round per change;
    only exact integer sums reach the driver.
    """
    total, rate = None, None
    while True:
        capped = F.lit(False) if rate is None else F.col("weight") * F.lit(rate) > F.col("source_size") * cap
        row = sources.agg(
            F.sum("source_size").alias("total"), F.sum(F.when(capped, F.col("source_size") * cap)).alias("spent"),
            F.sum(F.when(~capped, F.col("weight"))).alias("weight")).first()
        total = row["total"] or 0
        now = (share * total - (row["spent"] or 0)) / row["weight"] if row["weight"] else rate or 0.0
        if now == rate or not row["weight"]:
            return now, total
        rate = now


def quality_weight(label: Column, labelled: dict[int, float] = QUALITY, otherwise: float = UNLABELLED) -> Column:
    out = F.lit(otherwise)
    for value, weight in labelled.items():
        out = F.when(label == value, F.lit(weight)).otherwise(out)
    return out


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in (0, 1) from the id, the same in every run and on every engine with MD5."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}"))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2 ** 52))


def mix(docs: DataFrame, labels: DataFrame | None = None, weights: Sequence[int] = WEIGHTS, share: float = SHARE,
        cap: int = CAP, seed: int = SEED) -> DataFrame:
    """Take of every document: doc_id, source, size, source_size, target, epochs, taken, row_key.

    ``docs`` needs doc_id, source, text; further columns are not read. ``labels`` (doc_id, quality) sets the
    sampling weights. Sources in code-point order, null last, take the ``weights`` in turn. ``taken`` counts
    words with repeats: whole epochs, then the words the fractional part takes; the document on which the
    budget ends gives only what is missing, so a source's words miss its target by less than one.
    Null texts and texts without words have size 0 and give nothing. Rows that repeat an id are documents of
    their own and draw equal keys; equal keys go by id, then size. A null id is an id like any other. Labels
    with several rows for an id count with the best one. An empty table gives no rows.
    ``row_key`` hashes the text, so that takes can be joined back to rows.
    """
    rows = docs.select("doc_id", "source", words_in("text").alias("size"), F.xxhash64("text").alias("row_key"))
    if labels is None:
        rows = rows.withColumn("_quality", F.lit(None).cast("int"))
    else:
        best = labels.groupBy("doc_id").agg(F.max("quality").alias("_quality"))
        rows = rows.join(best, "doc_id", "left")
    spread = -F.ln(uniform(F.col("doc_id"), seed)) / quality_weight(F.col("_quality"))
    # Weights are 1 or more, so keys are spread over the positions 1 - exp(-key) without a dense end.
    rows = stored(rows.select("doc_id", "source", "size", "row_key", spread.alias("_key"),
                              (1 - F.exp(-spread)).alias("_position")))
    sources = stored(numbered_sources(rows.groupBy("source").agg(F.sum("size").alias("source_size")),
                                      "place", F.col("source").asc_nulls_last())
                     .withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]),
                                                        (F.col("place") % len(weights) + 1).cast("int"))))
    rate, _ = level(sources, share, cap)
    limit = (F.col("source_size") * cap).cast("double")
    sources = (sources.withColumn("target", F.least(limit, F.col("weight") * F.lit(rate)))
               .withColumn("epochs", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("bigint"))
               .withColumn("_rest", F.floor(F.col("target")).cast("bigint") - F.col("epochs") * F.col("source_size"))
               .select(F.col("source").alias("_source"), "source_size", "target", "epochs", "_rest"))
    ordered = running(rows, ["source"], "_position", [F.col("_key"), F.col("doc_id"), F.col("size"), F.col("row_key")],
                      "size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("before")))
    return (ordered.join(sources, F.col("source").eqNullSafe(F.col("_source")))
            .select("doc_id", "source", "size", "source_size", "target", "epochs",
                    (F.col("epochs") * F.col("size") + part).cast("bigint").alias("taken"), "row_key"))


def mixed_documents(docs: DataFrame, labels: DataFrame | None = None, **options) -> DataFrame:
    """The mix as rows of ``docs`` (all columns): a document appears once per started epoch, whole; documents
    that give no words are left out. Rows alike in id, source and text share one decision each."""
    takes = (mix(docs, labels, **options).where(F.col("taken") > 0)
             .select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("row_key").alias("_k"),
                     F.ceil(F.col("taken") / F.col("size")).alias("_n"))
             .groupBy("_d", "_s", "_k").agg(F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_rows")))
    rows = packed(docs).withColumn("_key", F.xxhash64("row.text"))
    at = (F.col("row.doc_id").eqNullSafe(F.col("_d")) & F.col("row.source").eqNullSafe(F.col("_s"))
          & (F.col("_key") == F.col("_k")))
    repeats = F.ceil(F.col("_n") / F.col("_rows")).cast("int")
    return rows.join(takes, at).withColumn("_copy", F.explode(F.sequence(F.lit(1), repeats))).select("row.*")
