"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text, present or not: its lower-cased words (ASCII punctuation separates), neighbouring pairs, and pairs
with one word between, hashed to 2 ** DIMS_LOG2 coordinates. Training is online with one learning rate a coordinate
and L1 shrinkage, so most weights are exactly zero; the others are what is broadcast.

Bound: the model is fitted on at most SAMPLE pairs of an id that has a document and a label, those with the smallest
hashes of their ids, in EPOCHS passes in a fixed order. Their features are shuffled once into a table sorted by that
order; one task scans it once a pass, in a stream, and holds three arrays of 2 ** DIMS_LOG2 numbers.

Texts that are null or empty have no feature and get the bias's score. Rows with a null label teach nothing; without
any label the score is 0.5. Of an id's texts the one with the smallest hash is learned from, once for each different
label; so repeated rows of either table change nothing. Only text is an input of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tileflow.llm.common import Memo, discard, map_batches, materialise, ready
from tileflow.llm.language_id import held_out

DIMS_LOG2, SAMPLE, EPOCHS = 20, 10_000, 6
ALPHA, BETA, L1, L2 = 2.0, 1.0, 15.0, 0.0
#: Weight of an example with label 1: such are the fewer.
POSITIVE = 8.0
THRESHOLD = 0.7

_PUNCTUATION = bytes(32 if b < 128 and not chr(b).isalnum() else b for b in range(256))
_PAIR, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Features:
    def __init__(self) -> None:
        self.word = Memo(lambda w: xxhash.xxh64_intdigest(w))

    def all(self, text: str | None) -> np.ndarray:
        """The coordinates of every feature occurrence, in no order and with repeats."""
        words = text.lower().encode().translate(_PUNCTUATION).split() if text else []
        h = np.fromiter(map(self.word.__getitem__, words), np.uint64, len(words))
        parts = [h, (h[:-1] * _PAIR) ^ (h[1:] >> np.uint64(1)), (h[:-2] * _SKIP) ^ (h[2:] >> np.uint64(1))]
        return (np.concatenate(parts) * _PAIR >> np.uint64(64 - DIMS_LOG2)).astype(np.int32)

    def present(self, text: str | None) -> np.ndarray:
        return np.unique(self.all(text))


class FTRL:
    """FTRL-proximal on sparse binary features; the bias isn't shrunk."""

    def __init__(self) -> None:
        self.z = np.zeros((1 << DIMS_LOG2) + 1)
        self.n = np.zeros((1 << DIMS_LOG2) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == 1 << DIMS_LOG2, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, features: np.ndarray, label: int) -> None:
        at = np.append(features, 1 << DIMS_LOG2)
        w = self.weights(at)
        g = (sigmoid(w.sum()) - label) * (POSITIVE if label else 1.0)
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -60, 60))))


@dataclass
class Model:
    at: np.ndarray  # coordinates of the weights that aren't zero
    weight: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << DIMS_LOG2)
        w[self.at] = self.weight
        return w


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic. Both are taken whole: leave out what isn't to be learned from."""
    ready(spark)
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit(17)).alias("order")
    taught = labels.where(F.col("toxic").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    few = taught.join(docs.select("doc_id"), "doc_id", "left_semi").select("doc_id", "toxic", order).orderBy("order", "doc_id", "toxic").limit(SAMPLE)

    def features():
        f, least = Features(), {}

        def one(b: pa.RecordBatch) -> pa.RecordBatch | None:
            """Only texts whose hash is the least so far in this task go on: few, however many rows share an id."""
            keep = []
            for k, (i, label, h) in enumerate(zip(*(b.column(c).to_pylist() for c in ("order", "toxic", "hash")), strict=True)):
                if h < least.get((i, label), 1 << 64):
                    least[i, label] = h
                    keep.append(k)
            b = b.take(pa.array(keep, pa.int64()))
            lists = [f.present(t) for t in b.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays([b.column("order"), b.column("toxic"), b.column("hash"), pa.array(lists, pa.list_(pa.int32()))], ["order", "toxic", "hash", "features"])

        return one

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, some = FTRL(), False
        for b in batches:
            values, offsets = b.column(1).flatten().to_numpy(), b.column(1).offsets.to_numpy()
            offsets = offsets - offsets[0]
            for k, label in enumerate(b.column(0).to_pylist()):
                model.learn(values[offsets[k] : offsets[k + 1]], int(label > 0))
                some = True
        if some:
            at = np.flatnonzero(np.abs(model.z) > L1)
            at = np.union1d(at, [1 << DIMS_LOG2]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(model.weights(at))], ["at", "weight"])

    text = F.col("text").cast("string").alias("text")
    found = docs.select("doc_id", text).join(F.broadcast(few), "doc_id").select("order", "toxic", F.xxhash64("text").alias("hash"), "text")
    examples = map_batches(found, features, "order long, toxic int, hash long, features array<int>")
    ordered = examples.repartition(1).groupBy("order", "toxic").agg(F.min_by("features", "hash").alias("features")).sortWithinPartitions("order", "toxic")
    once = materialise(spark, ordered.select("toxic", "features"), "ftrl-examples")
    # The passes are so many scans of the same table, one behind the other in one task: nothing is shuffled or held.
    weights = reduce(DataFrame.union, [once] * EPOCHS).coalesce(1).mapInArrow(train, "at long, weight double").toArrow()
    discard(spark, once)
    at, w = weights.column("at").to_numpy(), weights.column("weight").to_numpy()
    bias = w[at == 1 << DIMS_LOG2]
    inside = at < 1 << DIMS_LOG2
    return Model(at[inside].astype(np.int32), w[inside], float(bias[0]) if len(bias) else 0.0)


def score_documents(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    ready(spark)
    shared = spark.sparkContext.broadcast((model.at, model.weight, model.bias))

    def make():
        f, m = Features(), Model(*shared.value)
        dense, nonzero = m.dense(), np.zeros(1 << DIMS_LOG2, bool)
        nonzero[m.at] = True

        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            scores = []
            for text in b.column(2).to_pylist():
                found = f.all(text)
                scores.append(sigmoid(m.bias + dense[np.unique(found[nonzero[found]])].sum()))
            score = np.array(scores)
            return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

        return one

    return map_batches(docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string")), make, "doc_id long, held_out boolean, score double, predicted int")


def classify_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of every row of docs, learned from the labels of rows that aren't held out."""
    return score_documents(spark, docs, fit(spark, docs, labels.where(~held_out())))
