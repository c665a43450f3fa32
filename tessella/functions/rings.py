"""Arrow functions on polygon rings that column expressions can't state: clipping and hulls."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import planar


def _points(ring) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in ring], np.float64).reshape(-1, 2)


def _area(points: np.ndarray) -> float:
    x, y = points[:, 0], points[:, 1]
    return abs(float(x @ np.roll(y, -1) - y @ np.roll(x, -1))) / 2


def clip(points: np.ndarray, x0: float, y0: float, x1: float, y1: float) -> np.ndarray:
    """A polygon cut to a box, side by side; edges along the box may double, at no area."""
    for axis, bound, keep in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        if not len(points):
            break
        ahead = np.roll(points, -1, axis=0)
        d, e = keep * (points[:, axis] - bound), keep * (ahead[:, axis] - bound)
        crossing = (d < 0) != (e < 0)
        t = np.where(crossing, d / np.where(crossing, d - e, 1), 0)[:, None]
        cut = points + t * (ahead - points)
        both = np.stack([points, cut], axis=1)
        points = both[np.stack([d >= 0, crossing], axis=1)]
    return points


def _following(row: np.ndarray) -> np.ndarray:
    """The point that follows each in its row's ring, rows being in order."""
    first = np.ones(len(row), bool)
    first[1:] = row[1:] != row[:-1]
    starts = np.flatnonzero(first)
    after = np.arange(len(row)) + 1
    after[np.append(starts[1:], len(row))[: len(starts)] - 1] = starts
    return after


def clipped(points: np.ndarray, row: np.ndarray, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`clip` of many polygons at once, each to the box of its ``row``; points and their rows."""
    for axis, bound, keep in ((0, 0, 1), (0, 2, -1), (1, 1, 1), (1, 3, -1)):
        ahead = points[_following(row)]
        at = boxes[row, bound]
        d, e = keep * (points[:, axis] - at), keep * (ahead[:, axis] - at)
        crossing = (d < 0) != (e < 0)
        t = np.where(crossing, d / np.where(crossing, d - e, 1), 0)[:, None]
        both = np.stack([points, points + t * (ahead - points)], axis=1)
        stay = np.stack([d >= 0, crossing], axis=1)
        points, row = both[stay], np.repeat(row, stay.sum(axis=1))
    return points, row


@F.arrow_udf(T.DoubleType())
def _clipped_area(ring: pa.Array, x0: pa.Array, y0: pa.Array, x1: pa.Array, y1: pa.Array) -> pa.Array:
    rows = len(ring)
    o = planar.outlines(ring)
    boxes = np.stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in (x0, y0, x1, y1)], axis=1)
    points, row = clipped(np.stack([o.x, o.y], axis=1), np.repeat(o.owner, o.sizes), boxes)
    near = points - boxes[row, :2]
    ahead = near[_following(row)]
    cross = near[:, 0] * ahead[:, 1] - near[:, 1] * ahead[:, 0]
    real = np.bincount(row, minlength=rows) > 2
    return pa.array(np.where(real, np.abs(np.bincount(row, cross, rows)) / 2, 0.0))


def hull(points: np.ndarray) -> np.ndarray:
    """The convex hull, by the lower and upper chains of the sorted points."""
    sorted_points = np.unique(points, axis=0)
    if len(sorted_points) < 3:
        return sorted_points

    def chain(rows: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(sorted_points) + chain(sorted_points[::-1]))


def _hull_area(ring: pd.Series) -> pd.Series:
    return pd.Series([_area(h) if r is not None and len(h := hull(_points(r))) > 2 else 0.0 for r in ring], dtype="float64")


def clipped_area(ring, x0, y0, x1, y1) -> Column:
    """Area of a ring within a box."""
    return _clipped_area(ring, x0, y0, x1, y1)


def hull_area(ring) -> Column:
    """Area of the convex hull of a ring."""
    return F.pandas_udf(_hull_area, "double")(ring)
