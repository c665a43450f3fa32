"""Column functions on polygons: meeting, overlay, repair and buffers, in Arrow batches.

A polygon is a closed ``ring`` and a list of closed ``holes``; what comes out are ``parts``, each
a ring and its holes. Rings run with their area to the left, holes with it to the right, from
their lowest ``x``, then ``y``. A null ring is an empty shape.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import planar as P
from tessella.functions.boxes import ring_area

RING = T.ArrayType(T.StructType().add("x", "double").add("y", "double"))
PARTS = T.ArrayType(T.StructType().add("ring", RING).add("holes", T.ArrayType(RING)))
AREAS = T.StructType().add("a", "double").add("b", "double").add("both", "double")

#: What of two regions stays, by name.
KEPT = {
    "intersection": lambda a, b: a & b,
    "union": lambda a, b: a | b,
    "difference": lambda a, b: a & ~b,
    "symmetric_difference": lambda a, b: a ^ b,
}


def no_holes() -> Column:
    return F.array().cast(T.ArrayType(RING))


def _pair(ring_a: pa.Array, holes_a: pa.Array, ring_b: pa.Array, holes_b: pa.Array) -> tuple[P.Slabs, int]:
    a, b = P.oriented(P.outlines(ring_a, holes_a))[0], P.oriented(P.outlines(ring_b, holes_b))[0]
    group = np.repeat([0, 1], [len(a), len(b)])
    return P.slabs(P.Edges.of(a, b), group, len(ring_a)), len(ring_a)


@F.arrow_udf(T.BooleanType())
def _meet(ring_a: pa.Array, holes_a: pa.Array, ring_b: pa.Array, holes_b: pa.Array) -> pa.Array:
    return pa.array(P.meets(P.outlines(ring_a, holes_a), P.outlines(ring_b, holes_b)))


@F.arrow_udf(AREAS)
def _areas(ring_a: pa.Array, holes_a: pa.Array, ring_b: pa.Array, holes_b: pa.Array) -> pa.Array:
    s, rows = _pair(ring_a, holes_a, ring_b, holes_b)
    a, b = P.NONZERO(s.winds[0]), P.NONZERO(s.winds[1])
    return pa.StructArray.from_arrays([pa.array(P.areas(s, k, rows)) for k in (a, b, a & b)], names=["a", "b", "both"])


def _overlay(how: str):
    @F.arrow_udf(PARTS)
    def run(ring_a: pa.Array, holes_a: pa.Array, ring_b: pa.Array, holes_b: pa.Array) -> pa.Array:
        s, rows = _pair(ring_a, holes_a, ring_b, holes_b)
        return P.parts_of(P.outlined(s, KEPT[how](P.NONZERO(s.winds[0]), P.NONZERO(s.winds[1]))), rows)

    return run


@F.arrow_udf(PARTS)
def _repaired(ring: pa.Array, holes: pa.Array) -> pa.Array:
    o = P.outlines(ring, holes)
    return P.parts_of(P.simple(o), o.rows)


def _buffer(distance: float):
    @F.arrow_udf(PARTS)
    def run(ring: pa.Array, holes: pa.Array) -> pa.Array:
        o = P.outlines(ring, holes)
        return P.parts_of(P.buffered(P.simple(o), distance, o.rows), o.rows)

    return run


@F.arrow_udf(T.DoubleType())
def _parts_area(parts: pa.Array) -> pa.Array:
    flat, counts = P.lists(parts)
    o = P.outlines(flat.field("ring"), flat.field("holes"))
    size = np.abs(P.outline_areas(o)) * np.where(np.arange(len(o.owner)) < len(flat), 1.0, -1.0)
    part = np.bincount(o.owner, size, len(flat))
    return pa.array(np.bincount(np.repeat(np.arange(len(counts)), counts), part, len(counts)), pa.float64(), mask=parts.is_null().to_numpy(zero_copy_only=False))


def rings_meet(ring_a: Column, holes_a: Column, ring_b: Column, holes_b: Column) -> Column:
    """Whether two shapes have a point in common, borders included. Rings that aren't closed are
    lines, or points."""
    return _meet(ring_a, holes_a, ring_b, holes_b)


def overlap_areas(ring_a: Column, holes_a: Column, ring_b: Column, holes_b: Column) -> Column:
    """``a, b, both``: the areas of two polygons and of what they share."""
    return _areas(ring_a, holes_a, ring_b, holes_b)


def overlay(how: str, ring_a: Column, holes_a: Column, ring_b: Column, holes_b: Column) -> Column:
    """Parts of the ``intersection``, ``union``, ``difference`` or ``symmetric_difference``."""
    if how not in KEPT:
        raise ValueError(f"unknown overlay {how!r}; known: {', '.join(KEPT)}")
    return _overlay(how)(ring_a, holes_a, ring_b, holes_b)


def repaired(ring: Column, holes: Column) -> Column:
    """Valid parts of a polygon whose ring may cross itself or have spikes: what the ring winds
    around, without what a hole winds around. Empty where nothing has an area."""
    return _repaired(ring, holes)


def buffered(ring: Column, holes: Column, distance: float) -> Column:
    """Parts of all that is within ``distance`` of a polygon; below zero, of what is further than
    that from its border. Corners are rounded by arcs of ``planar.QUARTER`` sides a quarter."""
    return _buffer(float(distance))(ring, holes)


def outline_area(ring: Column, holes: Column) -> Column:
    """Area of a ring without its holes."""
    return ring_area(ring) - F.aggregate(holes, F.lit(0.0), lambda n, h: n + ring_area(h))


def parts_area(parts: Column) -> Column:
    """Area of parts, holes taken out; in Arrow, so that parts just made there don't come back."""
    return _parts_area(parts)


def with_bounds(df: DataFrame) -> DataFrame:
    """Bounds ``x0, y0, x1, y1`` of the column ``ring``."""
    side = lambda f, c: f(F.transform("ring", lambda p: p[c]))
    return df.withColumns({"x0": side(F.array_min, "x"), "y0": side(F.array_min, "y"), "x1": side(F.array_max, "x"), "y1": side(F.array_max, "y")})
