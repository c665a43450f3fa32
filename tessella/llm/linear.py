"""Sparse logistic regression by follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import learnable

Sparse = tuple[np.ndarray, np.ndarray]  # indices, each once, and their values


@dataclass
class Ftrl:
    """Per-coordinate FTRL-proximal: accumulated gradients give the weights when needed."""

    dimensions: int
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.1
    l2: float = 0.1

    def __post_init__(self) -> None:
        self.z, self.n = np.zeros(self.dimensions), np.zeros(self.dimensions)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def step(self, at: np.ndarray, gradient: np.ndarray) -> None:
        before = self.n[at]
        after = before + gradient * gradient
        self.z[at] += gradient - (np.sqrt(after) - np.sqrt(before)) / self.alpha * self.weights(at)
        self.n[at] = after

    def nonzero(self) -> Sparse:
        at = np.flatnonzero(np.abs(self.z) > self.l1)
        return at, self.weights(at)


def sigmoid(x: float | np.ndarray) -> float | np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def train(rows: list[tuple[Sparse, int]], twins: list[list[Sparse]], dimensions: int, epochs: int, penalty: float = 0.0, **settings: float) -> Sparse:
    """Weights after ``epochs`` passes. Dimension 0 is the bias and stands in every row.

    ``twins`` has, for each row, versions of it whose score should be the same; ``penalty``
    times the squared change of the margin is added to the loss.
    """
    model = Ftrl(dimensions, **settings)
    order = np.arange(len(rows))
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        rng.shuffle(order)
        for i in order:
            (at, x), y = rows[i]
            margin = float(model.weights(at) @ x)
            model.step(at, (sigmoid(margin) - y) * x)
            for twin_at, twin_x in twins[i] if penalty else ():
                both = np.union1d(at, twin_at)
                change = np.zeros(len(both))
                change[np.searchsorted(both, at)] += x
                change[np.searchsorted(both, twin_at)] -= twin_x
                keep = change != 0
                both, change = both[keep], change[keep]
                apart = float(model.weights(both) @ change)
                model.step(both, 2 * penalty * apart * change)
    return model.nonzero()


class Scorer:
    """Weights for sparse dot products; empty weights give one half."""

    def __init__(self, weights: Sparse) -> None:
        at, w = weights
        self.at, self.w = np.append(at, np.iinfo(np.int64).max), np.append(w, 0.0)

    def margin(self, row: Sparse) -> float:
        at, x = row
        place = np.searchsorted(self.at, at)
        return float(np.where(self.at[place] == at, self.w[place], 0.0) @ x)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, held: int, most: int) -> DataFrame:
    """``doc_id, text, y`` of at most ``most`` labelled rows that may be learned from.

    Only ids are ordered, by hash, to choose them; their texts come by a join with that list, one
    of each id, whatever repeats.
    """
    rated = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    may = rated.where(learnable(F.col("doc_id"), parts, held)).groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = may.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(most)
    return docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")


def fitted(sample: DataFrame, fit: Callable[[list[tuple[str, int]]], Sparse]) -> Sparse:
    """Weights that one task fits on the bounded ``sample``; the driver gets the weights alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())]
        rows.sort(key=lambda r: (r[0], r[1] or ""))
        at, w = fit([(t or "", y) for _, t, y in rows]) if rows else (np.zeros(0, np.int64), np.zeros(0))
        yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int64()), "w": pa.array(w, pa.float64())})

    found = sample.repartition(1).mapInArrow(run, "at long, w double").collect()
    return np.array([r["at"] for r in found], np.int64), np.array([r["w"] for r in found], np.float64)


def scored(docs: DataFrame, weights: Sparse, features: Callable[[str], Sparse]) -> DataFrame:
    """``doc_id, score`` of every row, texts scored whole."""
    weights_of = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(weights_of.value)
        for batch in batches:
            margins = np.array([scorer.margin(features(t or "")) for t in batch.column("text").to_pylist()], np.float64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(sigmoid(margins), pa.float64())})

    return docs.mapInArrow(run, "doc_id long, score double")
