"""A quality classifier: logistic regression over hashed word n-grams, trained with FTRL-proximal updates.

A word counts twice: as it is, in lower case, and by its shape (capitals, small letters, digits and signs,
runs counted once), each as a unigram and as a bigram with the word before. A feature's value is its count over
the square root of all counts, so that a score is one sparse dot product: a sum of looked-up weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import blocks_of, column_or, discard, materialize, utf8_views
from factloom.llm.words import mix, shape_hashes, word_hashes

BITS = 20
#: The labelled rows that a model is fitted on: those with the least hashes of their ids.
SAMPLE = 8000
#: The most features (a slot and its value) of all these rows together that reach the driver.
FEATURES = 16_000_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.5


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For blocks of rows: the slots of all features and the rows' n+1 offsets in them."""
    raw, offsets = utf8_views(column)
    shift = np.uint64(64 - BITS)
    for i, j in blocks_of(offsets):
        part = offsets[i : j + 1]
        words, rows = word_hashes(raw, part)
        shapes = shape_hashes(raw, part)
        kinds = [words, shapes]
        for k, hashes in enumerate((words, shapes)):
            before = np.roll(hashes, 1)
            before[rows[:-1][rows[:-1] < len(words)]] = 0
            kinds.append(mix(hashes * np.uint64(0xD6E8FEB86659FD93) + before + np.uint64(k)))
        again = words == np.roll(words, 1)
        again[rows[:-1][rows[:-1] < len(words)]] = False
        same = np.where(again, np.uint64(1), np.uint64(2))
        kinds.append(mix(same))  # a word said twice in a row
        slots = (np.stack(kinds, axis=1).ravel() >> shift).astype(np.int32)
        yield slots, rows * len(kinds)


class FollowTheLeader:
    """Per-coordinate FTRL-proximal for logistic loss, with a bias in the last slot."""

    def __init__(self, size: int) -> None:
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = self.z[at]
        flat = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, flat)

    def update(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def counted_features(column: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Each text's slots, once each, and their values: counts over the square root of all counts."""
    slots, values = [], []
    for flat, rows in features(column):
        for a, b in zip(rows[:-1], rows[1:], strict=True):
            s, c = np.unique(flat[a:b], return_counts=True)
            slots.append(s)
            values.append((c / np.sqrt(max(1, b - a))).astype(np.float32))
    return slots, values


def fit_quality(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = SAMPLE, most: int = FEATURES) -> np.ndarray:
    """Weights (2 ** BITS and a bias) from ``labels`` (doc_id, label) of rows of ``docs`` for which ``usable`` holds.

    The sample is bounded: of the ``sample`` labels with the least md5 of their doc_id, at most ``sample`` labelled texts
    in the same order (rows that agree in doc_id, label and text count once), and of these as many as have
    ``most`` features together. Features are made on the executors and only these reach the driver. Without any
    usable row all weights are 0.
    """
    order = [F.md5(F.col("doc_id").cast("string")), F.col("doc_id"), F.col("label")]
    picked = labels.where("label IN (0, 1)").where(usable).select("doc_id", F.col("label").cast("int").alias("label")).distinct().orderBy(*order).limit(sample)
    rows = docs.select("doc_id", "text").join(picked, "doc_id").select("doc_id", "label", "text", F.xxhash64("text").alias("h"))
    key = ["doc_id", "label", "h"]
    chosen = materialize(rows.select(*key).distinct().orderBy(*order, "h").limit(sample), "chosen")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots, values = counted_features(column_or(batch, "text"))
            columns = [column_or(batch, c) for c in key] + [pa.array([len(x) for x in slots], pa.int64()), pa.array(slots, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*key, "n", "slots", "vals"])

    rows = rows.join(chosen, key).dropDuplicates(key).select(*key, "text")
    counted = materialize(rows.mapInArrow(count, "doc_id long, label int, h long, n long, slots array<int>, vals array<float>"), "features")
    sizes = np.array([r["n"] for r in counted.select(*key, "n").orderBy(*order, "h").collect()], dtype=np.int64)
    enough = int(np.searchsorted(np.cumsum(sizes), most, side="right"))
    data = counted.orderBy(*order, "h").limit(enough).toArrow()
    discard(chosen, counted)
    model = FollowTheLeader(1 << BITS)
    label, h, slots, values = (data.column(c).combine_chunks() for c in ("label", "h", "slots", "vals"))
    passes = np.lexsort((h.to_numpy(), label.to_numpy(), mix(data.column("doc_id").to_numpy().astype(np.uint64))))
    for _ in range(EPOCHS):
        for k in passes:
            model.update(np.append(slots[k].values.to_numpy(), 1 << BITS), np.append(values[k].values.to_numpy(), 1.0), label[k].as_py())
    return model.weights().astype(np.float32)


def score_quality(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (score >= 0.5) of every row; null and empty texts get the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 4 MB, whatever the data

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            out = []
            for flat, rows in features(column_or(batch, "text")):
                sums = np.concatenate(([0.0], np.cumsum(weights[flat], dtype=np.float64)))
                sizes = np.diff(rows)
                out.append(weights[-1] + (sums[rows[1:]] - sums[rows[:-1]]) / np.sqrt(np.maximum(1, sizes)))
            logits = np.concatenate(out) if out else np.zeros(0)
            scores = 1 / (1 + np.exp(-np.clip(logits, -35, 35)))
            yield pa.RecordBatch.from_arrays([column_or(batch, "doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(score, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def classify_quality(docs: DataFrame, labels: DataFrame, held_out: Column, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs`` (doc_id, text).

    The model is fitted on ``labels`` (doc_id, label) of rows for which ``held_out`` (a column over doc_id) is
    not true. Null texts count as empty; rows with null, repeated or contradictory labels are used as they
    stand, null labels not. Repeated rows get equal scores, further columns are ignored, and an empty table
    gives an empty result.
    """
    weights = fit_quality(docs, labels, ~F.coalesce(held_out, F.lit(False)), sample)
    return score_quality(docs, weights).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")
