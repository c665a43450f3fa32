"""Quality classifier: hashed word n-grams, logistic regression, FTRL updates."""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import learnable, two_columns
from tessella.llm.linear import Sparse, fitted, labelled_sample, scored, train
from tessella.plans.session import table

DIMENSIONS = 1 << 20
#: Labelled rows that the classifier is fitted on: the first this many by hashed id.
MOST_LABELLED = 6_000
EPOCHS = 4
KEEP_AT = 0.7
#: A word is a run of letters and digits, or a run of other signs.
WORDS = re.compile(r"\w+|[^\w\s]+")
MASK, MULTIPLIER = np.uint64(DIMENSIONS - 1), np.uint64(0x9E3779B97F4A7C15)
#: What a word that follows itself, and a line that was there before, count as.
AGAIN, LINE_AGAIN = np.uint64(1), np.uint64(2)
#: Slots of the bias and of five classes of length, in words.
SHORT = (0, 5, 20, 50, 200)
FIRST_HASHED = np.uint64(16)


def features(text: str) -> Sparse:
    """Shares of hashed 1- and 2-word n-grams, by the root of the number of words.

    Two equal words in a row are one n-gram whatever the word, and so is a line that repeats
    an earlier one, so that repetition is learned from few examples.
    """
    words = WORDS.findall(text)
    n = len(words)
    fixed = [0] + [3 + i for i, least in enumerate(SHORT) if n >= least]
    ones = np.ones(len(fixed))
    if not n:
        return np.array(fixed, np.int64), ones
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    pairs = (hashes[:-1] * MULTIPLIER) ^ (hashes[1:] >> np.uint64(1))
    slots = np.maximum((hashes * MULTIPLIER) >> np.uint64(44), FIRST_HASHED)
    pair_slots = np.where(hashes[:-1] == hashes[1:], AGAIN, np.maximum((pairs * MULTIPLIER) >> np.uint64(44), FIRST_HASHED))
    lines = [x for x in text.split("\n") if x]
    repeated = np.full(len(lines) - len(set(lines)), LINE_AGAIN)
    at, counts = np.unique(np.concatenate([slots, pair_slots, repeated]), return_counts=True)
    values = counts / np.sqrt(n)
    values[at == LINE_AGAIN] *= np.sqrt(n) / max(len(lines), 1)
    return np.concatenate([np.array(fixed, np.int64), at.astype(np.int64)]), np.concatenate([ones, values])


def _fit(rows: list[tuple[str, int]]) -> Sparse:
    examples = [(_sorted(features(t)), y) for t, y in rows]
    return train(examples, [[]] * len(examples), DIMENSIONS, EPOCHS, alpha=0.3, l1=0.3, l2=0.5)


def _sorted(row: Sparse) -> Sparse:
    order = np.argsort(row[0], kind="stable")
    return row[0][order], row[1][order]


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    Learns from labelled rows whose crc32 of the id isn't 2 modulo 4, at most
    ``MOST_LABELLED`` of them; only the text is an input of a score. Empty and null texts are
    scored as texts without words. Labels that are null or not 0 or 1 are skipped, and of an
    id's several labels the highest holds. Without labels every score is one half. Repeated
    ids are scored row by row. An empty table gives an empty result.
    """
    rows = two_columns(docs, id_col, text_col)
    weights = fitted(labelled_sample(rows, labels, "quality", 4, 2, MOST_LABELLED), _fit)
    out = scored(rows, weights, features)
    return out.select("doc_id", (~learnable(F.col("doc_id"), 4, 2)).alias("held_out"), "score", (F.col("score") >= KEEP_AT).cast("int").alias("predicted"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document."""
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
