"""Column expressions on axis-aligned boxes ``x0, y0, x1, y1`` and on polygon rings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    """The four columns of a box, by prefix."""
    return tuple(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1"))


def area(b: Box) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def overlap(a: Box, b: Box) -> Column:
    """Area of the intersection; 0 where boxes are apart."""
    wide = F.greatest(F.lit(0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    return wide * F.greatest(F.lit(0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 where the union is empty."""
    both = overlap(a, b)
    return F.coalesce(both.cast("double") / F.nullif((area(a) + area(b) - both).cast("double"), F.lit(0.0)), F.lit(0.0))


def meets(a: Box, b: Box, touch: bool = True) -> Column:
    """True if the boxes intersect; ``touch``: a shared edge or corner counts."""
    if touch:
        return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])


def ring_of(b: Box) -> Column:
    """A box as a closed ring of points."""
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(corner(b[0], b[1]), corner(b[2], b[1]), corner(b[2], b[3]), corner(b[0], b[3]), corner(b[0], b[1]))


def _edges(ring: Column, of) -> Column:
    """Sum of ``of(p, q)`` over the edges of a closed ring."""
    ahead = F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0)))
    behind = F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0)))
    return F.aggregate(F.zip_with(behind, ahead, of), F.lit(0.0), lambda s, v: s + v)


def signed_area(ring: Column) -> Column:
    return _edges(ring, lambda p, q: (p["x"] * q["y"] - q["x"] * p["y"]) / 2)


def ring_area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def ring_length(ring: Column) -> Column:
    return _edges(ring, lambda p, q: F.sqrt((q["x"] - p["x"]) * (q["x"] - p["x"]) + (q["y"] - p["y"]) * (q["y"] - p["y"])))


def ring_centroid(ring: Column) -> tuple[Column, Column]:
    six = 6 * F.nullif(signed_area(ring), F.lit(0.0))
    cross = lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]
    return _edges(ring, lambda p, q: (p["x"] + q["x"]) * cross(p, q)) / six, _edges(ring, lambda p, q: (p["y"] + q["y"]) * cross(p, q)) / six


def ring_moments(ring: Column) -> dict[str, Column]:
    """Area moments up to order three, about the origin, by Green's theorem over the edges."""
    cross = lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]
    sign = F.signum(signed_area(ring))
    terms = {
        "m00": (2, lambda p, q: F.lit(1.0)),
        "m10": (6, lambda p, q: p["x"] + q["x"]),
        "m01": (6, lambda p, q: p["y"] + q["y"]),
        "m20": (12, lambda p, q: p["x"] * p["x"] + p["x"] * q["x"] + q["x"] * q["x"]),
        "m02": (12, lambda p, q: p["y"] * p["y"] + p["y"] * q["y"] + q["y"] * q["y"]),
        "m11": (24, lambda p, q: p["x"] * (2 * p["y"] + q["y"]) + q["x"] * (p["y"] + 2 * q["y"])),
        "m30": (20, lambda p, q: (p["x"] + q["x"]) * (p["x"] * p["x"] + q["x"] * q["x"])),
        "m03": (20, lambda p, q: (p["y"] + q["y"]) * (p["y"] * p["y"] + q["y"] * q["y"])),
        "m21": (60, lambda p, q: p["x"] * p["x"] * (3 * p["y"] + q["y"]) + 2 * p["x"] * q["x"] * (p["y"] + q["y"]) + q["x"] * q["x"] * (p["y"] + 3 * q["y"])),
        "m12": (60, lambda p, q: p["y"] * p["y"] * (3 * p["x"] + q["x"]) + 2 * p["y"] * q["y"] * (p["x"] + q["x"]) + q["y"] * q["y"] * (p["x"] + 3 * q["x"])),
    }

    def moment(over: int, of) -> Column:
        return sign * _edges(ring, lambda p, q: cross(p, q) * of(p, q)) / over

    return {name: moment(over, of) for name, (over, of) in terms.items()}


def inside(inner: Box, outer: Box) -> Column:
    """True if the first box lies in the second, edges allowed."""
    return (inner[0] >= outer[0]) & (inner[1] >= outer[1]) & (inner[2] <= outer[2]) & (inner[3] <= outer[3])


def shrunk(b: Box, by: int) -> Box:
    """A box that is smaller by ``by`` on each side."""
    return b[0] + by, b[1] + by, b[2] - by, b[3] - by
