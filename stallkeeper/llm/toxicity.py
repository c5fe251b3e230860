"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios
(Wang and Manning, "Baselines and Bigrams").

Features are the hashed n-grams of the lower-cased words of a text, each word with its borders, present or
not. For a feature, r is the log ratio of its smoothed shares in toxic and in other documents; a logistic
regression learns one weight per feature on the values r. The model is one vector of fixed length, so it
travels with the tasks; scoring is one pass over the texts without a shuffle.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from stallkeeper.llm.common import packed, stored

SIZES = (3, 4, 5)
BITS = 20
PER_CLASS = 2000     # labelled documents of each class that the fit reads at most
THRESHOLD = 0.7
ROUNDS = 60
RIDGE = 0.02


def _mix(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
    h = (h ^ codes) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return h


def grams(text: str | None) -> np.ndarray:
    """Hashed n-grams of the distinct words of a whole text, repeats included; a border is part of its word."""
    words = set((text or "").lower().split())
    if not words:
        return np.empty(0, np.int32)
    codes = np.frombuffer(f" {' '.join(sorted(words))} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    blank = codes == 32
    found, h, inner = [], codes, np.zeros(len(codes), bool)
    with np.errstate(over="ignore"):
        for n in range(2, SIZES[-1] + 1):
            if len(codes) < n:
                break
            h = _mix(h[:-1], codes[n - 1:])
            if n > 2:  # windows with a blank inside belong to two words
                inner = inner[:-1] | blank[n - 2:-1]
            else:
                inner = inner[:-1]
            if n in SIZES:
                found.append((h[~inner] * np.uint64(0xBF58476D1CE4E5B9 + 2 * n)) >> np.uint64(64 - BITS))
    return np.concatenate(found).astype(np.int32) if found else np.empty(0, np.int32)


@dataclass
class Model:
    weights: np.ndarray  # of all hashed features, scaled
    bias: float

    def score(self, text: str | None) -> float:
        found = grams(text)
        telling = np.unique(found[self.weights[found] != 0])
        z = float(self.weights[telling].sum(dtype=np.float64)) + self.bias
        return float(1 / (1 + np.exp(-z))) if z > -700 else 0.0


def held_out(doc_id: Column) -> Column:
    """True for the third of ids that no fit may see."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.unique(grams(t.as_py())).tobytes() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.binary())], ["toxic", "features"])


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """(toxic, features) of at most ``per_class`` labelled documents of each class outside the held-out third,
    chosen by a hash of the id. An id counts once, however many label rows or documents carry it; ids without a
    document are passed over."""
    known = (labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy(F.col("doc_id").cast("bigint").alias("_id")).agg(F.max("toxic").cast("int").alias("toxic")))
    present = stored(known.join(docs.select(F.col("doc_id").alias("_id")).distinct(), "_id", "left_semi"))
    order = F.xxhash64(F.col("_id"), F.lit(11))
    chosen = present.where("toxic = 1").orderBy(order, "_id").limit(per_class).unionAll(
        present.where("toxic = 0").orderBy(order, "_id").limit(per_class))
    rows = (docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("text"))
            .join(F.broadcast(chosen), "_id"))  # at most two times per_class ids
    # Documents that share an id are one example: the one whose text has the smallest hash.
    one = rows.groupBy("_id").agg(F.min(F.struct(F.xxhash64("text").alias("_h"), "text", "toxic")).alias("one"))
    return one.select("one.text", "one.toxic").mapInArrow(_features, "toxic int, features binary")


def fit(rows: list[tuple[int, bytes]]) -> Model:
    """Ratios, then logistic regression by accelerated gradient steps. Without both classes every score is 0."""
    label = np.array([r[0] for r in rows], np.float64)
    if not 0 < label.sum() < len(label):
        return Model(np.zeros(1 << BITS, np.float32), -1000.0)
    docs = [np.frombuffer(r[1], np.int32) for r in rows]
    size = np.array([len(d) for d in docs])
    columns, of = np.concatenate(docs), np.repeat(np.arange(len(docs)), size)
    n1, n0 = label.sum(), (1 - label).sum()
    df1 = np.bincount(columns, label[of], 1 << BITS)
    df0 = np.bincount(columns, 1 - label[of], 1 << BITS)
    ratio = np.log((df1 + 1) / (n1 + 2)) - np.log((df0 + 1) / (n0 + 2))
    # A feature of one or two documents says nothing about others; a share within chance neither.
    df = df1 + df0
    share = df / (n1 + n0)
    sure = np.abs(df1 - n1 * share) / np.sqrt(np.maximum(n1 * share * (1 - share) * n0 / (n1 + n0), 1e-9))
    ratio[(df < 3) | (sure < 3)] = 0
    keep = ratio[columns] != 0
    columns, of = columns[keep], of[keep]
    used, at = np.unique(columns, return_inverse=True)
    value = ratio[used][at]
    balance = np.where(label == 1, len(label) / (2 * n1), len(label) / (2 * n0))
    w, bias, w_before, b_before = np.zeros(len(used)), 0.0, np.zeros(len(used)), 0.0
    norm = np.bincount(of, value * value, len(label))
    step = 4 / (norm.mean() + 1)
    for k in range(ROUNDS):
        look, look_b = w + k / (k + 3) * (w - w_before), bias + k / (k + 3) * (bias - b_before)
        z = np.bincount(of, value * look[at], len(label)) + look_b
        error = balance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label) / len(label)
        gradient = np.bincount(at, value * error[of], len(used)) + RIDGE * look / len(label)
        w_before, b_before = w, bias
        w, bias = look - step * gradient, look_b - step * error.sum()
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = w * ratio[used]
    return Model(weights, float(bias))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    rows = training_rows(docs, labels, per_class).collect()  # bounded: two times per_class
    return fit(sorted((r["toxic"], bytes(r["features"])) for r in rows))


def _scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            scores = [model.score(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(scores, pa.float64())], ["row", "score"])
    return run


def _scored(docs: DataFrame, model: Model) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: 2**BITS weights
    rows = packed(docs).withColumn("text", F.col("row.text").cast("string"))
    schema = T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_scores(shared), schema)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with the score of each row's text. A null or empty text has the score of no features.
    A column called ``name`` is replaced; all others, whatever they are called, are kept."""
    return _scored(docs, model).select(*[F.col(f"row.`{c}`") for c in docs.columns if c != name],
                                       F.col("score").alias(name))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with the columns of ``docs``."""
    return _scored(docs, train(docs, labels)).where(F.col("score") < threshold).select("row.*")
