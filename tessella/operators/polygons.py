"""Polygons: traced from masks, with holes, by class or instance; checked, exploded, met by points.

A polygon has a closed ``ring`` and a list of closed ``holes`` of points ``x, y``. Traced rings
run along the borders of pixels, so areas are numbers of pixels.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.boxes import ring_area
from tessella.operators.raster import mask_components
from tessella.plans.components import map_components
from tessella.plans.spatial_join import spatial_join

RING = "array<struct<x: double, y: double>>"


def _borders(parts: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The sides of pixels that no pixel of the same mask shares, with the inside to the right."""
    in_row = Window.partitionBy("image_id", *by, "y").orderBy("x")
    in_column = Window.partitionBy("image_id", *by, "x").orderBy("y")
    alone = lambda c, w, step: ~F.coalesce(F.lag(c, step).over(w) == F.col(c) - step, F.lit(False))
    open_sides = parts.withColumns({"left": alone("x", in_row, 1), "right": alone("x", in_row, -1)}).withColumns({"top": alone("y", in_column, 1), "bottom": alone("y", in_column, -1)})
    corners = {"top": (0, 0, 1, 0), "right": (1, 0, 1, 1), "bottom": (1, 1, 0, 1), "left": (0, 1, 0, 0)}
    x, y = F.col("x"), F.col("y")
    sides = [F.when(F.col(c), F.struct((x + a).alias("ax"), (y + b).alias("ay"), (x + d).alias("bx"), (y + e).alias("by_"))) for c, (a, b, d, e) in corners.items()]
    return open_sides.select("image_id", *by, "component", F.explode(F.array_compact(F.array(*sides))).alias("s")).select("image_id", *by, "component", "s.*")


def trace(sides: Iterable[tuple[int, int, int, int]]) -> list[list[tuple[int, int]]]:
    """Closed rings along directed sides, without points on straight lines.

    Where two pixels touch at a corner the way leads on to the other one, as neighbours at
    corners belong together. Rings around the inside have a positive area, holes a negative one.
    """
    after: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for ax, ay, bx, by in sides:
        after.setdefault((ax, ay), []).append((bx, by))
    rings = []
    for first in sorted(after):
        while after.get(first):
            at, ring, way = first, [], None
            while True:
                ways = after[at]
                turn = next((k for k, q in enumerate(ways) if way and (q[0] - at[0], q[1] - at[1]) == (way[1], -way[0])), 0)
                to = ways.pop(turn)
                step = (to[0] - at[0], to[1] - at[1])
                if step != way:
                    ring.append(at)
                at, way = to, step
                if at == first and (at[0] + way[1], at[1] - way[0]) not in after[at]:
                    break
            if len(ring) > 2:  # the start may lie on a straight line
                last = (ring[0][0] - ring[-1][0], ring[0][1] - ring[-1][1])
                ahead = (ring[1][0] - ring[0][0], ring[1][1] - ring[0][1])
                if (last[0] == 0) == (ahead[0] == 0) and last[0] * ahead[0] + last[1] * ahead[1] > 0:
                    ring = ring[1:]
            rings.append([*ring, ring[0]])
    return rings


def signed_area(ring: list[tuple[int, int]]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])) / 2


def mask_polygons(mask: DataFrame, by: tuple[str, ...] = (), least_area: float = 0, least_hole: float = 0, holes: bool = True) -> DataFrame:
    """Polygons of the pixels that aren't 0: ``image_id, *by, component, ring, holes, area`` and bounds.

    ``mask`` has ``image_id, y, x, v`` and the columns ``by`` (a class, an instance), within
    which pixels belong together; neighbours at corners do. Polygons of less than ``least_area``
    are left out, and holes of less than ``least_hole`` are filled; with ``holes`` false, all
    are. Only the borders of a component are gathered in one task, not its pixels.
    """
    borders = _borders(mask_components(mask, by), by)
    keys = ("image_id", *by, "component")

    def rings_of(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        new = np.ones(len(part), bool)
        new[1:] = np.logical_or.reduce([np.diff(pd.factorize(part[k], use_na_sentinel=False)[0]) != 0 for k in keys])
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(part)).tolist()
        sides = list(zip(*(part[c].to_list() for c in ("ax", "ay", "bx", "by_"))))
        for key, at, to in zip(zip(*(part[k].iloc[starts].to_list() for k in keys)), starts.tolist(), ends):
            rings = trace(sides[at:to])
            points = lambda r: [{"x": float(x), "y": float(y)} for x, y in r]
            sized = [(r, signed_area(r)) for r in rings]
            kept = [(r, -a) for r, a in sized if a < 0 and holes and -a >= least_hole]
            outer, size = max(sized, key=lambda s: s[1])
            out.append((*key, points(outer), [points(r) for r, _ in kept], float(size - sum(a for _, a in kept))))
        return pd.DataFrame(out, columns=[*keys, "ring", "holes", "area"])

    types = dict(borders.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + f", ring {RING}, holes array<{RING}>, area double"
    traced = map_components(borders, rings_of, schema, keys).where(F.col("area") >= least_area)
    side = lambda f, c: f(F.transform("ring", lambda p: p[c])).cast("long")
    return traced.withColumns({"x0": side(F.array_min, "x"), "y0": side(F.array_min, "y"), "x1": side(F.array_max, "x"), "y1": side(F.array_max, "y")})


def class_polygons(mask: DataFrame, names: dict[int, str] | None = None, ignore: tuple[int, ...] = (0,), **limits: float) -> DataFrame:
    """Polygons of a mask of class numbers ``v``, with the number as ``class_id`` and its ``class``.

    Classes in ``ignore`` are left out. A number without a name is named by itself.
    """
    rows = mask.where(~F.col("v").isin(*ignore)) if ignore else mask
    classed = rows.select("image_id", "y", "x", F.col("v").cast("long").alias("class_id"), F.lit(1).alias("v"))
    polygons = mask_polygons(classed, ("class_id",), **limits)
    number = F.col("class_id").cast("string")
    named = F.create_map(*[F.lit(x) for k, n in (names or {}).items() for x in (k, n)]) if names else None
    return polygons.withColumn("class", F.coalesce(F.try_element_at(named, F.col("class_id").cast("int")), number) if names else number)


def instance_polygons(mask: DataFrame, ignore: tuple[int, ...] = (0,), **limits: float) -> DataFrame:
    """Polygons of a mask of instance numbers ``v``: one for each connected part of an instance."""
    rows = mask.where(~F.col("v").isin(*ignore))
    return mask_polygons(rows.select("image_id", "y", "x", F.col("v").cast("long").alias("instance"), F.lit(1).alias("v")), ("instance",), **limits)


def check_mask(mask: DataFrame, kind: str) -> None:
    """Raises ``ValueError`` unless the mask's columns and values suit its kind.

    Kinds: ``binary`` (0 or 1), ``class`` and ``instance`` (whole numbers from 0), ``probability``
    (within 0 and 1), ``multilabel`` (a class column ``c``).
    """
    needed = {"image_id", "y", "x"} | ({"c"} if kind == "multilabel" else {"p"} if kind == "probability" else {"v"})
    missing = needed - set(mask.columns)
    if missing:
        raise ValueError(f"a {kind} mask needs the columns {', '.join(sorted(missing))}")
    wrong = {"binary": "v not in (0, 1)", "class": "v < 0 or v <> floor(v)", "instance": "v < 0 or v <> floor(v)", "probability": "p < 0 or p > 1 or isnan(p)", "multilabel": "c is null"}
    if kind not in wrong:
        raise ValueError(f"unknown kind {kind!r}; known: {', '.join(wrong)}")
    if not mask.where(wrong[kind]).isEmpty():
        raise ValueError(f"values that no {kind} mask has")


def valid_rings(df: DataFrame, ring: str = "ring") -> DataFrame:
    """Rows whose ring is closed, has four points or more, and holds an area."""
    r = F.col(ring)
    return df.where((F.size(r) >= 4) & (r[0] == F.element_at(r, -1)) & (F.abs(ring_area(r)) > 0))


def valid_boxes(df: DataFrame) -> DataFrame:
    """Boxes with a positive width and height."""
    return df.where("x1 > x0 and y1 > y0")


def in_ring(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point is inside a closed ring: a ray to the right crosses it an odd number of times."""
    sides = F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def crossed(s: Column) -> Column:
        a, b = s["a"], s["b"]
        spans = (a["y"] > y) != (b["y"] > y)
        return F.when(spans, (x < a["x"] + (y - a["y"]) * (b["x"] - a["x"]) / (b["y"] - a["y"])).cast("int")).otherwise(0)

    return F.aggregate(sides, F.lit(0), lambda n, s: n + crossed(s)) % 2 == 1


def points_in_polygons(points: DataFrame, polygons: DataFrame, cell: int = 256) -> DataFrame:
    """Points (``slide_id``, their columns, ``x, y``) with the columns of each polygon that they are
    in, prefixed ``r_``; those in a hole are outside. Polygons have bounds, ``ring`` and ``holes``."""
    boxed = points.withColumns({"x0": F.col("x"), "y0": F.col("y"), "x1": F.col("x"), "y1": F.col("y")})
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    pairs = spatial_join(boxed, polygons, cell).where(in_ring(F.col("r_ring"), x, y))
    if "holes" in polygons.columns:
        pairs = pairs.where(~F.exists("r_holes", lambda h: in_ring(h, x, y)))
    return pairs.drop("x0", "y0", "x1", "y1", "r_ring", "r_holes")


def exploded(df: DataFrame, parts: str = "parts") -> DataFrame:
    """One row for each part of a shape of several: ``part`` counts from 0, ``ring`` and ``holes`` are its own."""
    rows = df.select(*[c for c in df.columns if c != parts], F.posexplode(parts).alias("part", "_p"))
    return rows.withColumns({"ring": F.col("_p.ring"), "holes": F.col("_p.holes")}).drop("_p")
