"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct hashed words, word pairs, and pairs with one word
between, of a whole text after lower-casing; words are runs of letters and digits.
Words, pairs and skip pairs have regions of their own in the hash space. Training
goes through a bounded, seeded sample of labelled documents, one document at a
time, with a learning rate for every coordinate and L1 shrinkage, which leaves
most weights at zero; the rest are broadcast.

Defined results: null and empty texts have the bias alone; labels other than 0 and 1
are left out; a model without training rows scores 0.5; repeated rows agree; an empty
table of documents gives an empty one; texts of any length are read whole; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import hashing as H

WORD_BITS, PAIR_BITS = 21, 20
SPACE = (1 << WORD_BITS) + 2 * (1 << PAIR_BITS)
#: Labelled documents to learn from: about so many of each label.
SAMPLE_ROWS = 5000
THRESHOLD = 0.3


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every word, pair and skip pair of a chunk, repeats included."""
    hashed, per_row = H.words(data, offsets, H.NOT_ALNUM)
    row = np.repeat(np.arange(len(per_row)), per_row)
    parts = [(row, (hashed >> np.uint64(64 - WORD_BITS)).astype(np.int64))]
    for gap in (1, 2):
        if len(hashed) > gap:
            same = row[gap:] == row[:-gap]
            both = H.mix(hashed[:-gap] * np.uint64(3) + hashed[gap:] + np.uint64(gap))
            start = (1 << WORD_BITS) + (gap - 1) * (1 << PAIR_BITS)
            parts.append((row[gap:][same], (both[same] >> np.uint64(64 - PAIR_BITS)).astype(np.int64) + start))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


class Ftrl:
    """Weights by coordinate; z and n as in McMahan and others, "Ad Click Prediction" (2013)."""

    def __init__(self, alpha: float = 1.0, beta: float = 1.0, l1: float = 10.0, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(SPACE + 1), np.zeros(SPACE + 1)  # the last is the bias

    def weights(self, i: np.ndarray) -> np.ndarray:
        z = self.z[i]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[i])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, i: np.ndarray, label: int) -> None:
        """i: distinct features of one document."""
        i = np.append(i, SPACE)
        w = self.weights(i)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[i] = n + g * g


class Model:
    """Sparse weights and bias."""

    def __init__(self, index: np.ndarray, weight: np.ndarray, bias: float):
        self.index, self.weight, self.bias = index.astype(np.int64), weight.astype(np.float64), bias
        self.dense: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"dense": None}

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.dense is None:
            self.dense = np.zeros(SPACE, np.int32)
            self.dense[self.index] = np.arange(1, len(self.index) + 1)
        logit = np.full(len(column), self.bias)
        for first, data, offsets in H.chunks(column):
            row, feature = features(data, offsets)
            known = self.dense[feature]
            hit = np.flatnonzero(known)
            pair = np.unique(row[hit] * (len(self.index) + 1) + known[hit])
            rows, at = np.divmod(pair, len(self.index) + 1)
            np.add.at(logit, first + rows, self.weight[at - 1])
        return 1 / (1 + np.exp(-np.clip(logit, -35, 35)))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, epochs: int = 5, seed: int = 11
) -> Model:
    """Model from whole texts of about sample_rows labelled documents with label 1 and twice as many with 0.

    The sample is drawn from the ids of labels, seeded, so that only its texts are
    gathered, and goes through one task in hash order; sample_rows bounds it, whatever
    the tables' sizes. The bias brings the sample's odds back to those of the labels.
    An id counts once: its largest label, its least text.
    """
    given = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id_")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    sizes = {r["label"]: r["count"] for r in given.groupBy("label").count().collect()}
    if not sizes:
        return Model(np.zeros(0), np.zeros(0), 0.0)
    share = min(1.0, sample_rows / max(1, sizes.get(1, 0))), min(1.0, 2 * sample_rows / max(1, sizes.get(0, 0)))
    u = F.pmod(F.xxhash64("id_", F.lit(seed)), F.lit(1_000_000))
    drawn = given.withColumn("u", u).filter(F.col("u") < F.when(F.col("label") == 1, share[0]).otherwise(share[1]) * 1_000_000)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    some = texts.join(F.broadcast(drawn), F.col("doc_id") == F.col("id_")).groupBy("id_", "label", "u").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, labels = [], []
        for b in batches:
            for _, data, offsets in H.chunks(b.column(0)):
                row, feature = features(data, offsets)
                pair = np.unique(row * SPACE + feature)
                ends = np.searchsorted(pair, np.arange(1, len(offsets)) * SPACE)
                docs += [(x % SPACE).astype(np.int32) for x in np.split(pair, ends[:-1])]
            labels += b.column(1).to_pylist()
        model, order = Ftrl(), np.random.default_rng(seed)
        for _ in range(epochs):
            for i in order.permutation(len(docs)):
                model.learn(docs[i], labels[i])
        used = np.flatnonzero(np.abs(model.z[:SPACE]) > model.l1)
        used = np.append(used, SPACE)
        yield pa.record_batch([pa.array(used, pa.int64()), pa.array(model.weights(used), pa.float64())], ["feature", "weight"])

    table = some.repartition(1).sortWithinPartitions("u", "id_").select("text", "label").mapInArrow(run, "feature long, weight double").toPandas()
    bias = table["feature"] == SPACE
    shift = float(np.log(share[1] / share[0])) if 1 in sizes and 0 in sizes else 0.0
    return Model(table["feature"][~bias].to_numpy(), table["weight"][~bias].to_numpy(), float(table["weight"][bias].sum()) + shift)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from the threshold on) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = shared.value.scores(b.column(1))
            yield pa.record_batch([b.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")
