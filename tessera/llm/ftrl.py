"""Logistic regression over hashed features, trained by follow-the-regularised-leader (FTRL-proximal).

Features are 64-bit hashes cut to ``BITS`` bits; a document has each feature
once.  A model keeps only its non-zero weights, sorted by feature.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.runtime import bound_batches

BITS = 28


@dataclass(frozen=True)
class Model:
    features: np.ndarray  # sorted
    weights: np.ndarray
    bias: float

    def scores(self, features: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probabilities of rows whose features are ``features[offsets[i]:offsets[i+1]]``."""
        total = np.full(len(offsets) - 1, self.bias)
        if len(self.features) and len(features):
            at = np.minimum(np.searchsorted(self.features, features), len(self.features) - 1)
            hit = self.features[at] == features
            rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            total += np.bincount(rows[hit], weights=self.weights[at[hit]], minlength=len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def to_features(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def distinct(features: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct features and their offsets."""
    key = np.unique((rows.astype(np.int64) << BITS) | features)
    return key & ((1 << BITS) - 1), np.searchsorted(key, np.arange(n_rows + 1) << BITS)


def train(docs: list[np.ndarray], labels: np.ndarray, epochs: int, alpha: float, beta: float, l1: float, l2: float, least_docs: int) -> Model:
    """FTRL-proximal over the documents in the order given."""
    if not docs:
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0)
    rate = float(np.clip(labels.mean(), 0.01, 0.99))
    bias = float(np.log(rate / (1 - rate)))
    names, seen = np.unique(np.concatenate(docs), return_counts=True)
    names = names[seen >= least_docs]
    if not len(names):
        return Model(names, np.zeros(0), bias)
    ids = []
    for d in docs:
        at = np.minimum(np.searchsorted(names, d), len(names) - 1)
        ids.append(at[names[at] == d].astype(np.int32))
    z, n = np.zeros(len(names)), np.zeros(len(names))
    zb, nb = 0.0, 0.0
    for _ in range(epochs):
        for x, y in zip(ids, labels, strict=True):
            zx, nx = z[x], n[x]
            w = np.where(np.abs(zx) <= l1, 0.0, -(zx - np.sign(zx) * l1) / ((beta + np.sqrt(nx)) / alpha + l2))
            b = bias - zb / ((beta + np.sqrt(nb)) / alpha)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -40, 40))) - y
            step = (np.sqrt(nx + g * g) - np.sqrt(nx)) / alpha
            z[x] = zx + g - step * w
            n[x] = nx + g * g
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / alpha * (b - bias)
            nb += g * g
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    keep = w != 0
    return Model(names[keep], w[keep], float(bias - zb / ((beta + np.sqrt(nb)) / alpha)))


Featurise = Callable[[pa.Array], Iterator[tuple[np.ndarray, np.ndarray]]]


def labelled_sample(labels: DataFrame, label: str, usable: Column, most: int) -> DataFrame:
    """At most ``most`` labelled ids, chosen by hash; (doc_id, y).  Of repeated labels the largest counts."""
    good = labels.filter(usable & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    one = good.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def fit(docs: DataFrame, sample: DataFrame, featurise: Featurise, **params) -> Model:
    """Train on the documents of a bounded sample of labels.

    The sample is broadcast: its rows are bounded by its limit.  Features of
    the sample's documents meet in one task, which trains.
    """

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for found, offsets in featurise(batch.column(2)):
                n = len(offsets) - 1
                part = batch.slice(at, n)
                at += n
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(found.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], ["doc_id", "y", "f"])

    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ys, rows = [], [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            ys += batch.column(1).to_pylist()
            rows += [np.asarray(x.values, dtype=np.int32) for x in batch.column(2)]
        order = np.random.default_rng(7).permutation(len(ids))[np.argsort(np.argsort(np.array(ids, dtype=np.int64), kind="stable"))] if ids else []
        order = np.argsort(order, kind="stable")
        model = train([rows[i] for i in order], np.array([ys[i] for i in order], dtype=float), **params)
        yield pa.RecordBatch.from_arrays(
            [pa.array([model.features.tolist()], pa.list_(pa.int64())), pa.array([model.weights.tolist()], pa.list_(pa.float64())), pa.array([model.bias])],
            ["features", "weights", "bias"],
        )

    bound_batches(docs.sparkSession)
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "y", "text")
    rows = chosen.mapInArrow(features, "doc_id long, y int, f array<int>").repartition(1)
    got = rows.mapInArrow(learn, "features array<long>, weights array<double>, bias double").collect()
    return Model(np.array(got[0]["features"], dtype=np.int64), np.array(got[0]["weights"]), got[0]["bias"]) if got else train([], np.zeros(0), 0, 1, 1, 1, 1, 1)


def score(docs: DataFrame, model: Model, featurise: Featurise) -> DataFrame:
    """doc_id and score of every row."""
    bound_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast((model.features, model.weights, model.bias))

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shipped.value)
        for batch in batches:
            got = [own.scores(found, offsets) for found, offsets in featurise(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(got) if got else np.zeros(0))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scored, "doc_id long, score double")


def with_score(docs: DataFrame, model: Model, featurise: Featurise, column: str = "score") -> DataFrame:
    """The rows with their score as a last column; nothing is shuffled."""
    bound_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast((model.features, model.weights, model.bias))
    names = [c for c in docs.columns if c != column]
    at = names.index("text")

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shipped.value)
        for batch in batches:
            got = [own.scores(found, offsets) for found, offsets in featurise(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(got) if got else np.zeros(0))], [*names, column])

    source = docs.select(*[F.col(f"`{c}`") for c in names])
    return source.mapInArrow(scored, T.StructType([*source.schema.fields, T.StructField(column, T.DoubleType())]))
