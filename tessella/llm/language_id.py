"""Language ID by a string kernel, Nyström landmarks and kernel ridge regression.

Two texts are compared by the character n-grams of 1 to 3 that both hold (a blended spectrum
of presences), over the geometric mean of how many each holds. A bounded number of learned
documents are landmarks; a document's kernel values against them, through the inverse root of
the landmarks' own kernel, are its features, on which one ridge regression per language is
solved. Scoring a batch is two matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import learnable, small, two_columns
from tessella.plans.session import cut, table

UNDETERMINED = "und"
#: Dimensions into which n-grams are hashed, and the n-grams' lengths.
DIMENSIONS, LENGTHS = 1 << 14, (1, 2, 3)
#: Documents learned from: this many of each language at most, and this many in all, dealt in
#: turns so that every language has its share.
PER_LANGUAGE, MOST_LEARNED = 400, 20_000
#: Landmarks of each language, and of all (one of each language at least).
LANDMARKS_EACH, LANDMARKS = 24, 400
RIDGE = 1e-3
ROWS_AT_ONCE = 64
#: Lengths are told apart by powers of two. A length has a least score where this many learned
#: documents of the language are of that length or one beside it.
BANDS, BAND_DOCUMENTS = 32, 20
STEP = 1 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)


def presences(text: str) -> np.ndarray:
    """Which hashed n-grams the whole text holds, after lower-casing."""
    out = np.zeros(DIMENSIONS, bool)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    for at in range(0, len(points), STEP):
        part = points[at : at + STEP + max(LENGTHS) - 1].astype(np.uint64)
        hashed = np.zeros(len(part), np.uint64)
        for n in range(1, max(LENGTHS) + 1):
            if n > len(part):
                break
            hashed = (hashed[: len(part) - n + 1] + part[n - 1 :] + np.uint64(n)) * MIX
            hashed ^= hashed >> np.uint64(29)
            if n in LENGTHS:
                out[(hashed * MIX) >> np.uint64(50)] = True
    return out


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def kernel(rows: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Shared presences over the root of the product of the numbers of presences."""
    a, b = rows.astype(np.float32), landmarks.astype(np.float32)
    sizes = np.sqrt(np.maximum(a.sum(axis=1), 1))[:, None] * np.sqrt(np.maximum(b.sum(axis=1), 1))[None, :]
    return (a @ b.T) / sizes


def kernel_of(rows: Sequence[np.ndarray], landmarks: np.ndarray) -> np.ndarray:
    """Kernel values of any number of packed rows, a bounded number of them unpacked at once."""
    parts = [np.unpackbits(np.stack(rows[i : i + 256]), axis=1, count=DIMENSIONS) for i in range(0, len(rows), 256)]
    return np.concatenate([kernel(p, landmarks) for p in parts])


class Model:
    """Packed landmarks and the weights that turn kernel values into one margin per language."""

    def __init__(self, languages: list[str], packed: np.ndarray, weights: np.ndarray, offset: np.ndarray, least: np.ndarray | None = None) -> None:
        self.languages, self.packed, self.weights, self.offset = languages, packed, weights, offset
        self.least = np.zeros((len(languages), BANDS), np.float32) if least is None else least

    def prepared(self) -> "Model":
        self.landmarks = np.unpackbits(self.packed, axis=1, count=DIMENSIONS).astype(np.float32)
        return self

    def score(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best language of each row, and half of its margin plus one, within 0 and 1: over
        one half where that language's regression says yes."""
        margins = kernel(rows, self.landmarks) @ self.weights + self.offset
        best = margins.argmax(axis=1)
        return best, np.clip((margins[np.arange(len(best)), best] + 1) / 2, 0, 1)


def band(n_chars: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(n_chars, 1)).astype(np.int64), BANDS - 1)


def least_scores(model: Model, best: np.ndarray, score: np.ndarray, labels: list[str], n_chars: np.ndarray) -> np.ndarray:
    """Per language and length, the score below which a text is in none of the languages.

    It lies halfway between what a text gets that shares nothing with what was learned, and the
    lowest score of a learned document that was told right. Lengths of which too little was
    learned have none (0).
    """
    out = np.zeros((len(model.languages), BANDS), np.float32)
    at, right = band(n_chars), np.array(model.languages)[best] == np.array(labels)
    nothing = np.clip((model.offset + 1) / 2, 0, 1)
    for k in range(len(model.languages)):
        for b in range(BANDS):
            near = score[right & (best == k) & (np.abs(at - b) <= 1)]
            if len(near) >= BAND_DOCUMENTS:
                out[k, b] = max(0.0, (nothing[k] + near.min()) / 2)
    return out


def fit(packed: list[np.ndarray], labels: list[str], per_language: int = LANDMARKS_EACH, most: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """Kernel ridge regression, one language against the rest, in the landmarks' space.

    ``packed`` has the presences of each document, packed in bytes; every language weighs alike.
    """
    languages = sorted(set(labels))
    if not languages:
        return None
    names = np.array(labels)
    # Dealt in turns, so that every language has its share, and one at least.
    turns = sorted((turn, k, i) for k, x in enumerate(languages) for turn, i in enumerate(np.flatnonzero(names == x)[:per_language]))
    chosen = [i for _, i in sorted((k, i) for _, k, i in turns[: max(most, len(languages))])]
    marks = np.stack([packed[i] for i in chosen])
    landmarks = np.unpackbits(marks, axis=1, count=DIMENSIONS)
    among = kernel(landmarks, landmarks).astype(np.float64)
    values, vectors = np.linalg.eigh(among)
    root = vectors / np.sqrt(np.maximum(values, 1e-4))
    features = kernel_of(packed, landmarks) @ root
    targets = np.where(names[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    held = {x: (names == x).sum() for x in languages}
    balance = 1.0 / np.array([held[x] for x in labels])
    balance *= len(names) / balance.sum()
    mean_x, mean_y = np.average(features, axis=0, weights=balance), np.average(targets, axis=0, weights=balance)
    x, y = features - mean_x, targets - mean_y
    weights = np.linalg.solve((x * balance[:, None]).T @ x + ridge * len(packed) * np.eye(x.shape[1]), (x * balance[:, None]).T @ y)
    return Model(languages, marks, (root @ weights).astype(np.float32), (mean_y - mean_x @ weights).astype(np.float32))


def _packed_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        if texts:
            bits, lengths = [np.packbits(presences(t)).tobytes() for t in texts], [len(t) for t in texts]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "lang": batch.column("lang"), "bits": pa.array(bits, pa.binary()), "chars": pa.array(lengths, pa.int64())})


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted(row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("place", "lang", "bits", "chars"))))
    packed, labels = [np.frombuffer(bits, np.uint8) for _, _, bits, _ in rows], [lang for _, lang, _, _ in rows]
    model = fit(packed, labels)
    if model:
        model.prepared()
        told = [model.score(np.unpackbits(np.stack(packed[i : i + 256]), axis=1, count=DIMENSIONS)) for i in range(0, len(packed), 256)]
        least = least_scores(model, np.concatenate([b for b, _ in told]), np.concatenate([s for _, s in told]), labels, np.array([n for *_, n in rows]))
        arrays = [model.packed, model.weights, model.offset, least]
        yield pa.RecordBatch.from_pydict({"languages": pa.array([model.languages], pa.list_(pa.string()))} | {c: pa.array([x.tobytes()], pa.binary()) for c, x in zip(("packed", "weights", "offset", "least"), arrays)})


def _hashed(doc_id: Column) -> Column:
    return F.md5(doc_id.cast("string").cast("binary"))


def sample_of(rows: DataFrame) -> DataFrame:
    """``place, lang, bits, chars``: of each language, the documents whose hashed ids come first.

    ``rows`` has ``doc_id, lang, text`` of what may be learned from. Languages are counted
    first, and only ids whose hash is below a bound that four times as many documents as needed
    keep to are read any further, so that no language is sorted whole. Of rows that repeat an
    id, in a language, one is taken.
    """
    rows = rows.where("lang is not null and doc_id is not null")
    counts = small(rows.groupBy("lang").agg(F.count("*").alias("n")))
    share = F.conv(F.substring(_hashed(F.col("doc_id")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    near = rows.join(counts, "lang").where(share * F.col("n") < 4 * PER_LANGUAGE).select("doc_id", "lang", "text")
    packed = near.mapInArrow(_packed_features, "doc_id long, lang string, bits binary, chars long")
    packed = packed.groupBy("lang", "doc_id").agg(F.min(F.struct("bits", "chars")).alias("first")).select("lang", "doc_id", "first.*")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(_hashed(F.col("doc_id")), "doc_id"))
    return packed.withColumn("place", place).where(F.col("place") <= PER_LANGUAGE).orderBy("place", "lang").limit(MOST_LEARNED).select("place", "lang", "bits", "chars")


def learn(rows: DataFrame) -> Model | None:
    """Fits in one task on a bounded sample; the driver gets the model alone."""
    sample = cut(sample_of(rows))
    found = sample.repartition(1).mapInArrow(_fitted, "languages array<string>, packed binary, weights binary, offset binary, least binary").collect()
    if not found:
        return None
    r = found[0]
    languages = list(r.languages)
    arrays = [np.frombuffer(bytes(x), kind).reshape(shape) for x, kind, shape in ((r.packed, np.uint8, (-1, DIMENSIONS // 8)), (r.weights, np.float32, (-1, len(languages))), (r.offset, np.float32, (-1,)), (r.least, np.float32, (-1, BANDS)))]
    return Model(languages, *arrays)


def _predicted(model_of, carried: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of.value and model_of.value.prepared()
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            langs, scores, foreign = [UNDETERMINED] * len(texts), [0.0] * len(texts), [True] * len(texts)
            known = [i for i, t in enumerate(texts) if model and has_letter(t)]
            for at in range(0, len(known), ROWS_AT_ONCE):
                part = known[at : at + ROWS_AT_ONCE]
                best, score = model.score(np.stack([presences(texts[i]) for i in part]))
                least = model.least[best, band(np.array([len(texts[i]) for i in part]))]
                for i, b, s, low in zip(part, best, score, least):
                    langs[i], scores[i], foreign[i] = model.languages[b], float(s), bool(s < low)
            kept = {c: batch.column(c) for c in (("doc_id", "text", "carried") if carried else ("doc_id",))}
            yield pa.RecordBatch.from_pydict(kept | {"lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64()), "foreign": pa.array(foreign, pa.bool_())})

    return run


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, foreign`` of every row; with ``carry``, also ``text``
    and ``carried``, a struct of those columns. ``foreign`` says that the score is below what
    :func:`least_scores` asks for that language and length, or that there is no letter.

    Learns from text and language of the rows whose crc32 of the id isn't 2 modulo 4; ids and
    languages are no inputs of a prediction. At most ``PER_LANGUAGE`` documents of a language
    and ``MOST_LEARNED`` in all are learned from. A null text, or one without any letter, is
    ``und`` with score 0; so is everything if there is nothing to learn from. Rows that repeat
    an id are predicted one by one. An empty table gives an empty result.
    """
    rows = two_columns(docs, id_col, text_col, *carry)
    may = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("text"))
    model_of = docs.sparkSession.sparkContext.broadcast(learn(may.where(learnable(F.col("doc_id"), 4, 2))))
    kept = [f for f in rows.schema.fields if carry or f.name == "doc_id"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", lang_pred string, score double, foreign boolean"
    predicted = rows.mapInArrow(_predicted(model_of, bool(carry)), schema)
    return predicted.select("doc_id", (~learnable(F.col("doc_id"), 4, 2)).alias("held_out"), "lang_pred", "score", "foreign", *(["text", "carried"] if carry else []))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return identify_languages(table(spark, sf_dir, "documents")).drop("foreign")
