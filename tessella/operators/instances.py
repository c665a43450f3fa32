"""Instances of model maps, one row each: outlines, classes, probabilities, pooled tokens, owners.

A tile's map is in one row, so all that is known of an instance within its tile is found where the
model runs, without a shuffle. What takes several tiles (owners) or slides is joined afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.cells import BOX, tile_neighbours
from tessella.operators.polygons import RING, signed_area, trace
from tessella.plans.session import bounded_batches, ship_package

PARTS = f"array<struct<ring: {RING}, holes: array<{RING}>>>"
SCHEMA = f"slide_id long, tile_id long, x long, y long, instance long, pixels long, filled long, tx0 long, ty0 long, tx1 long, ty1 long, cx double, cy double, class_id long, prob double, parts {PARTS}, vec array<double>"


class CellMaps(NamedTuple):
    """What a model of cells gives for a batch of ``n`` tiles.

    ``instances`` is ``(n, h, w)``, 0 for background. ``probability`` is ``(n, h, w)``, or
    ``(n, classes, h, w)``; ``tokens`` is ``(n, dims, rows, columns)``.
    """

    instances: np.ndarray
    probability: np.ndarray | None = None
    tokens: np.ndarray | None = None


class _Objects:
    """The instances of one map: their numbers ``ids``, and ``which`` of them each pixel ``y, x`` is of."""

    def __init__(self, labels: np.ndarray) -> None:
        self.shape = labels.shape
        self.y, self.x = np.nonzero(labels > 0)
        self.ids, self.which = np.unique(labels[self.y, self.x], return_inverse=True)
        self.pixels = np.bincount(self.which, minlength=len(self.ids))

    def means(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.which, weights=values, minlength=len(self.ids)) / self.pixels

    def bounds(self) -> tuple[np.ndarray, ...]:
        """Least and greatest column and row of each."""
        order = np.argsort(self.which, kind="stable")
        first = np.searchsorted(self.which[order], np.arange(len(self.ids)))
        return tuple(f.reduceat(v[order], first) for f in (np.minimum, np.maximum) for v in (self.x, self.y))

    def rings(self) -> list[list[list[tuple[int, int]]]]:
        """The rings of each, traced along those sides of pixels where the instance ends."""
        own = np.full((self.shape[0] + 2, self.shape[1] + 2), -1)
        own[self.y + 1, self.x + 1] = self.which
        sides = []
        for dy, dx, corners in ((-1, 0, (0, 0, 1, 0)), (0, 1, (1, 0, 1, 1)), (1, 0, (1, 1, 0, 1)), (0, -1, (0, 1, 0, 0))):
            ends = own[self.y + 1 + dy, self.x + 1 + dx] != self.which
            x, y = self.x[ends], self.y[ends]
            sides.append(np.stack([self.which[ends], x + corners[0], y + corners[1], x + corners[2], y + corners[3]], axis=1))
        rows = np.concatenate(sides)
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        cuts = np.searchsorted(rows[:, 0], np.arange(1, len(self.ids)))
        return [trace(map(tuple, one[:, 1:].tolist())) for one in np.split(rows, cuts)]


def _inside(ring: list[tuple[int, int]], of: list[tuple[int, int]]) -> bool:
    """Whether the pixel at the first corner of ``ring`` is within ``of``; rings start at their upper left."""
    x, y = min(ring)
    crossed = sum(a[0] == b[0] and a[0] > x and min(a[1], b[1]) <= y < max(a[1], b[1]) for a, b in zip(of, of[1:]))
    return crossed % 2 == 1


def parts_of(rings: list[list[tuple[int, int]]], holes: bool) -> tuple[list[tuple[list, list]], int]:
    """Outer rings, each with its holes, and the area of all. Without ``holes``, holes are filled,
    and what lies in them is part of the whole around it."""
    outer = [r for r in rings if signed_area(r) > 0]
    if not holes:
        kept = [r for r in outer if not any(r is not o and _inside(r, o) for o in outer)] if len(outer) > 1 else outer
        return [(r, []) for r in kept], int(sum(map(signed_area, kept)))
    inner = [[] for _ in outer]
    for h in (r for r in rings if signed_area(r) < 0):
        around = [k for k, o in enumerate(outer) if _inside(h, o)] or range(len(outer))
        inner[min(around, key=lambda k: signed_area(outer[k]))].append(h)
    return list(zip(outer, inner)), int(sum(map(signed_area, rings)))


def pooled_tokens(labels: np.ndarray, tokens: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """One vector for each of ``ids``: the mean of the tokens whose place in the map is of it.

    A token's place is the pixel that is nearest to its share of the way from the first pixel to
    the last. An instance that holds no such place gets the token at its centroid, one that isn't
    in the map gets zeros.
    """
    dims, rows, columns = tokens.shape
    height, width = labels.shape
    at = np.ix_(*(np.round(np.linspace(0, n - 1, k)).astype(int) for n, k in ((height, rows), (width, columns))))
    places = labels[at].ravel()
    names, back = np.unique(np.asarray(ids), return_inverse=True)
    out = np.zeros((len(names), dims))
    if not len(names):
        return out
    slot = np.minimum(np.searchsorted(names, places), len(names) - 1)
    held = names[slot] == places
    hits = np.bincount(slot[held], minlength=len(names))
    for d, values in enumerate(np.asarray(tokens, np.float64).reshape(dims, -1)):
        out[:, d] = np.bincount(slot[held], weights=values[held], minlength=len(names)) / np.maximum(hits, 1)
    missed = np.flatnonzero(hits == 0)
    if len(missed):
        found = _Objects(np.where(np.isin(labels, names[missed]), labels, 0))
        low = lambda mean, n, k: np.minimum((mean * k / n).astype(int), k - 1)
        y, x = low(found.means(found.y), height, rows), low(found.means(found.x), width, columns)
        out[np.searchsorted(names, found.ids)] = tokens[:, y, x].T
    return out[back]


def _checked(maps: object, n: int, edge: int) -> CellMaps:
    maps = maps if isinstance(maps, CellMaps) else CellMaps(np.asarray(maps))
    if maps.instances is None:
        raise ValueError("cells take a model that gives instance maps")
    wrong = np.shape(maps.instances) != (n, edge, edge)
    p, t = maps.probability, maps.tokens
    wrong |= p is not None and (np.ndim(p) not in (3, 4) or np.shape(p)[0] != n or np.shape(p)[-2:] != (edge, edge))
    wrong |= t is not None and (np.ndim(t) != 4 or np.shape(t)[0] != n)
    if wrong:
        raise ValueError(f"the model gave {[np.shape(m) for m in maps if m is not None]} for {n} tiles of {edge}")
    return maps


def find_instances(images: DataFrame, model: Callable, edge: int, scale: int | float = 1, keep: Callable | None = None, holes: bool = False, tokens: bool = False) -> DataFrame:
    """Every instance of the maps that ``model`` gives for tiles: one row each.

    ``images`` has ``slide_id, tile_id, x, y, vec`` (``edge * edge`` values), a pixel of which is
    ``scale`` pixels of level 0. ``keep`` picks the instances of a map that go on. Columns:
    ``pixels``, ``filled`` (with holes unless ``holes`` asks for them), ``tx0, ty0, tx1, ty1``
    (first and last pixel in the tile), and at level 0 the centroid ``cx, cy`` and ``parts``, as an
    instance may fall into several. ``prob`` is the mean over its pixels, of the likeliest class,
    ``class_id``, where there are several, else 1. ``vec`` is the mean of its tokens
    (:func:`pooled_tokens`), if ``tokens`` are asked for and the model gives any.
    """
    run_model = getattr(model, "segment", model)
    if not callable(run_model):
        raise TypeError(f"{type(model).__name__} is neither callable nor has it a method segment")
    ship_package(images.sparkSession)
    bounded_batches(images.sparkSession)

    def one_tile(labels: np.ndarray, p: np.ndarray | None, t: np.ndarray | None, x0: int, y0: int) -> list[tuple]:
        o = _Objects(np.where(np.isin(labels, keep(labels)), labels, 0) if keep else labels)
        if not len(o.ids):
            return []
        classes, prob = [None] * len(o.ids), np.ones(len(o.ids))
        if p is not None and p.ndim == 3:
            by_class = np.stack([o.means(c[o.y, o.x]) for c in p])
            classes, prob = by_class.argmax(axis=0).tolist(), by_class.max(axis=0)
        elif p is not None:
            prob = o.means(p[o.y, o.x])
        vectors = pooled_tokens(labels, t, o.ids).tolist() if tokens and t is not None else [None] * len(o.ids)
        shapes = [parts_of(r, holes) for r in o.rings()]
        placed = lambda ring: [{"x": float(x0 + x * scale), "y": float(y0 + y * scale)} for x, y in ring]
        parts = [[{"ring": placed(r), "holes": [placed(h) for h in hs]} for r, hs in one] for one, _ in shapes]
        cx, cy = x0 + o.means(o.x) * scale, y0 + o.means(o.y) * scale
        left, top, right, bottom = o.bounds()
        return list(zip(o.ids.tolist(), o.pixels.tolist(), [a for _, a in shapes], left.tolist(), top.tolist(), right.tolist(), bottom.tolist(), cx.tolist(), cy.tolist(), classes, prob.tolist(), parts, vectors))

    fields = [c.split()[0] for c in SCHEMA.split(", ")[:15]] + ["parts", "vec"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches:
            if not batch.num_rows:
                continue
            pictures = np.array(batch.column("vec").to_pylist(), np.float64).reshape(-1, edge, edge)
            maps = _checked(run_model(pictures), len(pictures), edge)
            labels = np.asarray(maps.instances).astype(np.int64)
            if schema is None:
                number = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
                shape = pa.list_(pa.struct([("ring", number), ("holes", pa.list_(number))]))
                kinds = {"cx": pa.float64(), "cy": pa.float64(), "prob": pa.float64(), "parts": shape, "vec": pa.list_(pa.float64())}
                schema = pa.schema([(f, kinds.get(f, pa.int64())) for f in fields])
            for k, own in enumerate(batch.drop_columns("vec").to_pylist()):
                of_tile = lambda m: None if m is None else np.asarray(m[k])  # noqa: B023, E731
                rows = one_tile(labels[k], of_tile(maps.probability), of_tile(maps.tokens), own["x"], own["y"])
                if rows:
                    place = (own["slide_id"], own["tile_id"], own["x"], own["y"])
                    yield pa.RecordBatch.from_pylist([dict(zip(fields, (*place, *r))) for r in rows], schema=schema)

    return images.select(*[F.col(c).cast("long") for c in ("slide_id", "tile_id", "x", "y")], "vec").mapInArrow(run, SCHEMA)


def owned(found: DataFrame, tiles: DataFrame, cell: int = 1024) -> DataFrame:
    """Instances that their own tile owns: of the tiles that cover a centroid ``cx, cy``, borders
    included, the one with the nearest centre does; of several the smallest ``tile_id``.

    Only tiles are joined by place, once, each with those that touch it; their number is bounded
    by how tiles overlap. Instances of a tile that isn't in ``tiles`` stay.
    """
    boxes = tiles.select("slide_id", "tile_id", *BOX)
    near = tile_neighbours(tiles, cell).join(boxes.withColumnRenamed("tile_id", "neighbour"), ["slide_id", "neighbour"])
    rivals = near.groupBy("slide_id", "tile_id").agg(F.collect_list(F.struct(F.col("neighbour").alias("id"), *BOX)).alias("_rivals"))
    with_own = boxes.join(rivals, ["slide_id", "tile_id"], "left").select("slide_id", "tile_id", F.struct(F.col("tile_id").alias("id"), *BOX).alias("_own"), "_rivals")

    def far(t):
        dx, dy = F.col("cx") - (t["x0"] + t["x1"]) / 2, F.col("cy") - (t["y0"] + t["y1"]) / 2
        return dx * dx + dy * dy

    def better(t):
        covers = F.col("cx").between(t["x0"], t["x1"]) & F.col("cy").between(t["y0"], t["y1"])
        own = far(F.col("_own"))
        return covers & ((far(t) < own) | ((far(t) == own) & (t["id"] < F.col("_own.id"))))

    in_own = F.col("cx").between(F.col("_own.x0"), F.col("_own.x1")) & F.col("cy").between(F.col("_own.y0"), F.col("_own.y1"))
    lost = F.coalesce(in_own & F.exists(F.coalesce("_rivals", F.array().cast(rivals.schema["_rivals"].dataType)), better), F.lit(False))
    return found.join(with_own, ["slide_id", "tile_id"], "left").where(~lost).drop("_own", "_rivals")
