"""Models over tiles and features: Arrow batches in, named columns or vectors out."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.plans.session import bounded_batches, ship_package

Matrix = np.ndarray


#: Models by name: they turn a matrix of images (a row each) into one of vectors. ``register``
#: adds one.
MODELS: dict[str, Callable[[Matrix], Matrix]] = {"moments": lambda x: np.stack([x.mean(1), x.std(1), x.min(1), x.max(1)], axis=1)}


def register(name: str, model: Callable[[Matrix], Matrix]) -> None:
    """Makes a model known by a name."""
    if name in MODELS:
        raise ValueError(f"there is a model {name!r} already")
    MODELS[name] = resolve(model)


def resolve(model: str | Callable) -> Callable[[Matrix], Matrix]:
    """A model by registered name, by an ``encode_image`` method, or any callable."""
    found = MODELS.get(model) if isinstance(model, str) else getattr(model, "encode_image", model)
    if not callable(found):
        raise ValueError(f"unknown model {model!r}; known: {', '.join(MODELS)}")
    return found


def feature_extraction(images: DataFrame, model: str | Callable, key: str = "tile_id", image: str = "vec") -> DataFrame:
    """``key, vec``: the model's vector of every image."""
    encode = resolve(model)
    ship_package(images.sparkSession)
    bounded_batches(images.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = np.asarray(encode(np.array(batch.column(1).to_pylist(), np.float64)), np.float64)
                if out.ndim != 2 or len(out) != batch.num_rows:
                    raise ValueError(f"the model gave {out.shape} for {batch.num_rows} images")
                yield pa.RecordBatch.from_pydict({key: batch.column(0), "vec": pa.array(list(out), pa.list_(pa.float64()))})

    return images.select(F.col(key).cast("long").alias(key), image).mapInArrow(run, f"{key} long, vec array<double>")


def feature_prediction(features: DataFrame, predict: Callable[[Matrix], Mapping[str, np.ndarray]], names: tuple[str, ...], key: str = "tile_id", batch_size: int = 1000) -> DataFrame:
    """``key`` and one double column for each name that ``predict`` gives a matrix of vectors.

    Every batch must give exactly ``names``, each with a number for every row.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    if not names:
        raise ValueError("a predictor needs a name for its output")
    ship_package(features.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch_size):
                batch = whole.slice(at, batch_size)
                out = predict(np.array(batch.column(1).to_pylist(), np.float64))
                if not isinstance(out, Mapping) or set(out) != set(names):
                    raise ValueError(f"the predictor gave {sorted(out) if isinstance(out, Mapping) else type(out)}, not {sorted(names)}")
                columns = {n: np.asarray(out[n], np.float64).reshape(-1) for n in names}
                if any(len(c) != batch.num_rows for c in columns.values()):
                    raise ValueError("the predictor gave another number of rows than it got")
                yield pa.RecordBatch.from_pydict({key: batch.column(0)} | {n: pa.array(c) for n, c in columns.items()})

    return features.select(F.col(key).cast("long").alias(key), "vec").mapInArrow(run, f"{key} long, " + ", ".join(f"`{n}` double" for n in names))


def zero_shot_scores(aggregated: DataFrame, prompts: Mapping[str, list[float]], by: tuple[str, ...]) -> DataFrame:
    """Softmax over prompts of the cosine with each group's vector: ``by, prompt, p``."""
    from tessella.operators.graph import softmax

    spark = aggregated.sparkSession
    # The prompts are the caller's own list; every group meets each of them.
    rows = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in prompts.items()], "prompt string, pv array<double>")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    scored = aggregated.join(F.broadcast(rows)).withColumn("s", dot("vec", "pv") / F.sqrt(dot("vec", "vec") * dot("pv", "pv")))
    return scored.withColumn("p", softmax("s", by)).select(*by, "prompt", "p")


def _vectors(rows: DataFrame, make: Callable[[pa.RecordBatch], Mapping[str, list[np.ndarray]]], key: str, value: str, columns: tuple[str, ...]) -> DataFrame:
    """``key`` and one vector column for each of ``columns`` that ``make`` gives a batch of ``key, value``."""
    ship_package(rows.sparkSession)
    bounded_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            made = make(batch)
            if any(len(made[c]) != batch.num_rows for c in columns):
                raise ValueError("the model gave another number of rows than it got")
            out = {c: pa.array([np.asarray(v, np.float64).ravel() for v in made[c]], pa.list_(pa.float64())) for c in columns}
            yield pa.RecordBatch.from_pydict({key: batch.column(0)} | out)

    kind = dict(rows.dtypes)[key]
    return rows.select(key, value).mapInArrow(run, f"{key} {kind}, " + ", ".join(f"{c} array<double>" for c in columns))


def dense_features(images: DataFrame, model: Callable, pool: str = "cls", key: str = "tile_id", image: str = "vec") -> tuple[DataFrame, DataFrame]:
    """Vectors of tiles, and of the tokens of each tile, from a model of dense vectors.

    ``encode_image_dense`` (or the callable itself) gives ``(cls, tokens)`` for a matrix of
    images: a matrix, and a block of as many tokens for each. ``pool``: ``cls`` takes the first,
    ``cls_patch_mean`` puts the mean of the tokens behind it. The second table has ``key, token, vec``.
    """
    if pool not in ("cls", "cls_patch_mean"):
        raise ValueError(f"unknown pool {pool!r}: cls or cls_patch_mean")
    encode = getattr(model, "encode_image_dense", model)
    if not callable(encode):
        raise TypeError(f"{type(model).__name__} has no dense vectors")

    def make(batch: pa.RecordBatch) -> dict[str, list[np.ndarray]]:
        cls, tokens = (np.asarray(x, np.float64) for x in encode(np.array(batch.column(1).to_pylist(), np.float64)))
        if cls.ndim != 2 or tokens.ndim != 3:
            raise ValueError(f"a dense model gives a matrix and a block, not {cls.shape} and {tokens.shape}")
        pooled = cls if pool == "cls" else np.concatenate([cls, tokens.mean(1)], axis=1)
        return {"vec": list(pooled), "tokens": list(tokens), "width": [np.array([tokens.shape[2]])] * len(tokens)}

    made = _vectors(images, make, key, image, ("vec", "tokens", "width"))
    width = F.col("width")[0].cast("int")
    starts = F.sequence(F.lit(0), (F.size("tokens") / width).cast("int") - 1)
    each = F.transform(starts, lambda k: F.slice("tokens", k * width + 1, width))
    return made.select(key, "vec"), made.select(key, F.posexplode(each).alias("token", "vec"))


def tile_prediction(images: DataFrame, model: Callable, names: tuple[str, ...], tiles: DataFrame, key: str = "tile_id", transform: Callable[[Matrix], Matrix] | None = None) -> DataFrame:
    """The tiles with one more column for each name that the model's ``predict`` gives for their pictures.

    ``transform`` turns a matrix of pictures into what the model takes.
    """
    predict = getattr(model, "predict", model)
    if not callable(predict):
        raise TypeError(f"{type(model).__name__} has no method predict")
    found = feature_prediction(images, lambda x: predict(transform(x) if transform else x), names, key)
    return tiles.join(found, key, "left")


def slide_vectors(features: DataFrame, model: Callable, by: tuple[str, ...] = ("slide_id",), base_tile: int | None = None, most: int = 200_000) -> DataFrame:
    """``by, vec``: one vector of each group from all its tiles' vectors and places.

    ``encode_slide`` (or the callable) gets a matrix of vectors, a matrix of places, and
    ``base_tile`` if given. A model of whole slides needs a slide in one task; a group of more
    than ``most`` tiles is an error, as its memory would have no bound.
    """
    encode = getattr(model, "encode_slide", model)
    if not callable(encode):
        raise TypeError(f"{type(model).__name__} encodes no slides")
    largest = features.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > most:
        raise ValueError(f"a group has {largest} tiles; a slide encoder takes {most} at most")
    ship_package(features.sparkSession)
    more = {} if base_tile is None else {"base_tile_size": base_tile}

    def run(key: tuple[Any, ...], part: pd.DataFrame) -> pd.DataFrame:
        rows = part.sort_values("tile_id")
        vec = np.asarray(encode(np.array(rows.vec.tolist(), np.float64), rows[["x", "y"]].to_numpy(np.float64), **more), np.float64)
        if vec.ndim != 1:
            raise ValueError(f"a slide encoder gives one vector, not {vec.shape}")
        return pd.DataFrame([(*key, vec.tolist())], columns=[*by, "vec"])

    kinds = dict(features.dtypes)
    schema = ", ".join(f"{b} {kinds[b]}" for b in by) + ", vec array<double>"
    return features.select(*by, "tile_id", "x", "y", "vec").groupBy(*by).applyInPandas(run, schema)


def text_vectors(texts: DataFrame, model: Callable, key: str = "text_id", text: str = "text") -> DataFrame:
    """``key, vec`` of every text, by the model's ``encode_text`` or the callable; null counts as empty."""
    encode = getattr(model, "encode_text", model)
    if not callable(encode):
        raise TypeError(f"{type(model).__name__} encodes no texts")

    def make(batch: pa.RecordBatch) -> dict[str, list[np.ndarray]]:
        out = np.asarray(encode([t or "" for t in batch.column(1).to_pylist()]), np.float64)
        if out.ndim != 2:
            raise ValueError(f"a text encoder gives a matrix, not {out.shape}")
        return {"vec": list(out)}

    return _vectors(texts, make, key, text, ("vec",))


def scores(aggregated: DataFrame, model: Callable, prompts: list[str], by: tuple[str, ...]) -> DataFrame:
    """``by, prompt, p``: what the model's ``score(vectors, prompts)`` gives each group's vector.

    The scorer gets a matrix of vectors and the prompts, and gives a matrix of that shape.
    """
    score = getattr(model, "score", model)
    if not callable(score):
        raise TypeError(f"{type(model).__name__} is no scorer")
    if not prompts:
        raise ValueError("a scorer needs prompts")

    def make(batch: pa.RecordBatch) -> dict[str, list[np.ndarray]]:
        out = np.asarray(score(np.array(batch.column(1).to_pylist(), np.float64), prompts), np.float64)
        if out.shape != (batch.num_rows, len(prompts)):
            raise ValueError(f"the scorer gave {out.shape}, not {(batch.num_rows, len(prompts))}")
        return {"p": list(out)}

    keyed = aggregated.select(F.struct(*by).alias("key"), "vec")
    made = _vectors(keyed, make, "key", "vec", ("p",))
    named = F.arrays_zip(F.array(*map(F.lit, prompts)).alias("prompt"), F.col("p").alias("p"))
    return made.select("key.*", F.explode(named).alias("s")).select(*by, "s.prompt", "s.p")
