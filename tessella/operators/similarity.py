"""Scores of every tile's vector against text vectors: blocks of tiles meet blocks of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.plans.session import bounded_batches, ship_package

#: Texts of a block; one block is broadcast, several meet the tiles' blocks in a join.
TEXTS_AT_ONCE = 2_000


def _euclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0))


def _cosine_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    norms = np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))[None, :]
    return 1 - a @ b.T / np.maximum(norms, 1e-300)


#: ``dot`` is a similarity; the others are distances and are not negated.
SCORES: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {"dot": lambda a, b: a @ b.T, "euclidean": _euclidean, "cosine": _cosine_distance, "cityblock": lambda a, b: np.stack([np.abs(a - t).sum(1) for t in b], axis=1)}


def _packed(keys: list[str], norms: list[str]) -> Callable:
    """A row for each batch of tiles: their keys, norms and the matrix of their vectors, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                matrix = np.array(batch.column("vec").to_pylist(), np.float64)
                own, norm = ([batch.column(c).to_numpy(zero_copy_only=False).astype(kind).tobytes() for c in names] for names, kind in ((keys, np.int64), (norms, np.float64)))
                yield pa.RecordBatch.from_pydict({"own": pa.array([own], pa.list_(pa.binary())), "norm": pa.array([norm], pa.list_(pa.binary())), "matrix": pa.array([matrix.tobytes()], pa.binary()), "width": pa.array([matrix.shape[1]], pa.int32())})

    return run


def text_image_similarity(features: DataFrame, texts: DataFrame, scoring: str | Callable = "dot", normalize: bool = True, softmax: bool = False) -> DataFrame:
    """``tile_id, text_id, score`` of every tile and text, with ``slide_id`` if the tiles have one.

    ``features`` has ``tile_id, vec``, ``texts`` has ``text_id, vec``. ``normalize`` divides the
    tiles' vectors by their length, not the texts'. ``softmax`` is taken over all texts of a
    tile: scores are made twice, first for the sums of each tile, so that none is shuffled. ``scoring``: a name in ``SCORES``, or a function of a matrix of tiles and one of texts.
    """
    score = SCORES.get(scoring) if isinstance(scoring, str) else scoring
    if not callable(score):
        raise ValueError(f"unknown scoring {scoring!r}; known: {', '.join(SCORES)}")
    spark = features.sparkSession
    ship_package(spark)
    bounded_batches(spark)
    keys = [c for c in ("slide_id", "tile_id") if c in features.columns]
    at_once = int(spark.conf.get("spark.tessella.texts_at_once", None) or TEXTS_AT_ONCE)
    blocks = max(1, -(-texts.count() // at_once))
    block = F.pmod(F.hash("text_id"), F.lit(blocks))
    listed = texts.select(block.alias("block"), F.struct(F.col("text_id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec")).alias("t"))
    packed = listed.groupBy("block").agg(F.array_sort(F.collect_list("t")).alias("texts"))
    packed = F.broadcast(packed) if blocks == 1 else packed

    def scored(tiles: DataFrame, norms: list[str], of: Callable[[dict, np.ndarray, list[int]], dict], schema: str) -> DataFrame:
        rows = tiles.select(*[F.col(c).cast("long") for c in keys], *norms, "vec").mapInArrow(_packed(keys, norms), "own array<binary>, norm array<binary>, matrix binary, width int")
        pairs = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(packed, "block")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    a = np.frombuffer(r["matrix"], np.float64).reshape(-1, r["width"])
                    if normalize:
                        a = a / np.maximum(np.sqrt((a * a).sum(1)), 1e-12)[:, None]
                    ids = [t["id"] for t in r["texts"]]
                    s = score(a, np.array([t["vec"] for t in r["texts"]], np.float64))
                    if s.shape != (len(a), len(ids)):
                        raise ValueError(f"scoring gave {s.shape}, not {(len(a), len(ids))}")
                    yield pa.RecordBatch.from_pydict(of(r, s, ids))

        return pairs.select("own", "norm", "matrix", "width", "texts").mapInArrow(run, "".join(f"{c} long, " for c in keys) + schema)

    own = lambda r, n: {c: pa.array(np.repeat(np.frombuffer(x, np.int64), n)) for c, x in zip(keys, r["own"])}
    listed_out = lambda r, s, ids: own(r, len(ids)) | {"text_id": pa.array(ids * len(s), pa.int64()), "score": pa.array(s.ravel())}
    if not softmax:
        return scored(features, [], listed_out, "text_id long, score double")

    def sums(r: dict, s: np.ndarray, ids: list[int]) -> dict:
        top = s.max(axis=1)
        return own(r, 1) | {"top": pa.array(top), "total": pa.array(np.exp(s - top[:, None]).sum(axis=1))}

    def shares(r: dict, s: np.ndarray, ids: list[int]) -> dict:
        top, total = (np.frombuffer(x, np.float64)[:, None] for x in r["norm"])
        return listed_out(r, np.exp(s - top) / total, ids)

    parts = scored(features, [], sums, "top double, total double").withColumn("_top", F.max("top").over(Window.partitionBy(*keys)))
    norm = parts.groupBy(*keys, "_top").agg(F.sum(F.col("total") * F.exp(F.col("top") - F.col("_top"))).alias("_total"))
    same = [F.col(f"f.`{c}`").cast("long").eqNullSafe(F.col(f"n.`{c}`")) for c in keys]
    tiles = features.alias("f").join(norm.alias("n"), same).select(*[f"f.`{c}`" for c in keys], "vec", "_top", "_total")
    return scored(tiles, ["_top", "_total"], shares, "text_id long, score double")
