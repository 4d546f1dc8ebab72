"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text is the set of its words, pairs of neighbouring words and pairs with one word
between them, each hashed to one of 2^BITS places. Training runs on a bounded sample
of labelled rows, in one task at every size: FTRL-proximal (a rate of its own for
each coordinate, L1 and L2 penalties) meets all rows one after another, so that L1
weighs the same evidence however many rows there are. L1 leaves few weights other
than 0, and those alone go to the tasks that score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yieldscope.llm import texts

BITS = 20
#: Labelled rows to train on at most, and places of all their features, chosen by a hash of the id.
SAMPLE, PLACES = 32_000, 64_000_000
#: Bytes of text that are cut into features at once.
CHUNK = 1 << 18


@dataclass(frozen=True)
class Ftrl:
    """Settings of the learner; weights are 0 while |z| is at most ``l1``."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 16.0
    l2: float = 0.1
    epochs: int = 6


@dataclass(frozen=True)
class Model:
    """Non-zero weights by place (2^BITS is the constant), and the score of a text without evidence."""

    places: np.ndarray
    weights: np.ndarray
    prior: float = 0.0

    def dense(self) -> np.ndarray:
        out = np.zeros((1 << BITS) + 1)
        out[self.places] = self.weights
        return out


def _grams(offsets: np.ndarray, data: np.ndarray):
    """(text, place) arrays of all n-grams and skip-grams of a chunk, repeats included."""
    words = texts.Words(texts.lower_table()[data], offsets,
                        texts.byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)))
    h, room, shift = words.hashes, words.room(), np.uint64(64 - BITS)
    yield words.text, (h >> shift).astype(np.int64)
    for gap, salt in ((1, 0x632BE59BD9B4E019), (2, 0xD6E8FEB86659FD93)):
        n = max(0, len(h) - gap)
        ok = room[:n] > gap
        pair = texts.mix(h[:n] * np.uint64(salt) + h[gap:])[ok]
        yield words.text[:n][ok], (pair >> shift).astype(np.int64)


def _features() -> object:
    """Sorted distinct places of each text."""

    def work(offsets, data):
        places, bounds = [np.zeros(0, np.int32)], [0]
        for _, o, d in texts.chunks(offsets, data, CHUNK):
            parts = list(_grams(o, d))
            both = np.unique(np.concatenate([(t << BITS) | p for t, p in parts]))
            ends = np.searchsorted(both, np.arange(1, len(o)) << BITS)
            places.append((both & ((1 << BITS) - 1)).astype(np.int32))
            bounds.extend((bounds[-1] + ends).tolist())
        return [texts.lists(np.concatenate(places), np.array(bounds), pa.int32())]

    return work


def learn(rows: list[tuple[np.ndarray, int]], settings: Ftrl) -> tuple[np.ndarray, np.ndarray]:
    """The state (z, n) after all epochs over the rows, in their order."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    for _ in range(settings.epochs):
        for places, label in rows:
            at = np.append(places, 1 << BITS)
            w = weights(z[at], n[at], settings)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - label
            rate = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / settings.alpha
            z[at] += g - rate * w
            n[at] += g * g
    return z, n


def weights(z: np.ndarray, n: np.ndarray, settings: Ftrl) -> np.ndarray:
    """The closed-form FTRL weights of a state."""
    slack = np.abs(z) - settings.l1
    return np.where(slack > 0, -np.sign(z) * slack / ((settings.beta + np.sqrt(n)) / settings.alpha + settings.l2), 0)


def train(documents: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
          label: str = "toxic", sample: int = SAMPLE, settings: Ftrl = Ftrl()) -> Model:
    """A model of the labelled rows. Rows without id or label (0 or 1) take no part; of
    several labels of an id the largest holds. A text without evidence gets the share of label 1
    as its score, held under 0.5, since no evidence is no verdict; without any labels it is 0."""
    chosen = (labels.select(F.col(doc_id).alias("id__"), F.col(label).cast("int").alias("y__"))
              .where("id__ is not null and y__ in (0, 1)").groupBy("id__").agg(F.max("y__").alias("y__"))
              .orderBy(F.xxhash64("id__"), "id__").limit(sample))
    rows = texts.map_texts(
        documents.join(F.broadcast(chosen), F.col(f"`{doc_id}`") == F.col("id__")),
        [F.xxhash64("id__").alias("pick__"), F.reverse(F.col("id__").cast("string")).alias("order__"), F.col("y__")], F.col(f"`{text}`"), _features, "places array<int>")

    def fit(batches):
        places, order, y, size = [], [], [], 0
        for batch in batches:
            lengths = batch.column(3).value_lengths().to_numpy()
            ends = size + np.cumsum(lengths)
            n = int(np.searchsorted(ends, PLACES, side="right")) if len(places) else max(1, int(np.searchsorted(ends, PLACES, side="right")))
            # lists of Arrow stay as they are: rows are views of them
            places += np.split(batch.column(3).flatten().to_numpy(), np.cumsum(lengths)[:-1])[:n] if len(lengths) else []
            order += batch.column(1).to_pylist()[:n]
            y += batch.column(2).to_pylist()[:n]
            size = int(ends[-1]) if len(ends) else size
            if n < len(lengths):
                break
        if not y:
            return
        turn = sorted(range(len(y)), key=lambda i: (order[i], y[i]))
        z, n = learn([(places[i], y[i]) for i in turn], settings)
        # L1 is applied before anything comes to the driver; place -1 holds the share of label 1
        at = np.flatnonzero(np.abs(z) > settings.l1)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, at)), pa.array(np.append(sum(y) / len(y), z[at])),
                                          pa.array(np.append(0, n[at]))], names=["place", "z", "n"])
        del places, z, n
        texts.release()

    got = rows.repartition(1).sortWithinPartitions("pick__", "order__", "y__").mapInArrow(fit, "place bigint, z double, n double").toPandas()
    if not len(got):
        return Model(np.zeros(0, np.int64), np.zeros(0))
    share, got = float(got["z"].iloc[0]), got.iloc[1:]
    z, n = got["z"].to_numpy(float), got["n"].to_numpy(float)
    return Model(got["place"].to_numpy(np.int64), weights(z, n, settings), min(share, 0.49))


def score(documents: DataFrame, keep: list[Column], model: Model, *, text: str = "text") -> DataFrame:
    """The kept columns with a score from 0 to 1. Texts without evidence, as null and empty ones,
    get the share of label 1 that the model has seen, under 0.5."""
    places, values, prior = model.places, model.weights, model.prior

    def make():
        dense = Model(places, values).dense()

        def chunk(offsets, data):
            found = []
            for t, p in _grams(offsets, data):
                some = np.flatnonzero(dense[p])
                found.append((t[some] << BITS) | p[some])
            found = np.unique(np.concatenate(found))
            total = np.bincount(found >> BITS, dense[found & ((1 << BITS) - 1)], len(offsets) - 1)
            made = 1 / (1 + np.exp(-np.clip(total + dense[-1], -35, 35)))
            if dense[-1] == 0:  # texts in which no weight stands
                made[np.bincount(found >> BITS, minlength=len(made)) == 0] = prior
            return made

        def work(offsets, data):
            return [np.concatenate([np.zeros(0), *(chunk(o, d) for _, o, d in texts.chunks(offsets, data, CHUNK))])]

        return work

    return texts.map_texts(documents, keep, F.col(f"`{text}`"), make, "score double")
