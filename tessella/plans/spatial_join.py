"""Joins of boxes and polygons by a grid, where the plain predicate would be a nested loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.boxes import box, meets, ring_of
from tessella.functions.overlay import no_holes, rings_meet


def on_grid(df: DataFrame, cell: int) -> DataFrame:
    """One row for each grid cell of side ``cell`` that a box reaches: ``gx, gy``."""
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell)))
    return df.withColumn("gx", span("x0", "x1")).withColumn("gy", span("y0", "y1"))


def outline(df: DataFrame, prefix: str = "") -> tuple[Column, Column]:
    """Ring and holes of the rows of ``df``, whose box stands for those that have none."""
    ring = F.col(f"{prefix}ring") if f"{prefix}ring" in df.columns else ring_of(box(prefix))
    return ring, F.col(f"{prefix}holes") if f"{prefix}holes" in df.columns else no_holes()


def has_rings(*frames: DataFrame) -> bool:
    return any("ring" in df.columns for df in frames)


def spatial_join(left: DataFrame, right: DataFrame, cell: int, touch: bool = True, how: str = "inner", key: str = "slide_id", exact: bool = False) -> DataFrame:
    """Pairs of boxes that intersect. Columns of ``right`` come with the prefix ``r_``.

    Both sides are dealt out by ``key`` and the grid cells that they reach; a pair counts in
    the one cell that holds the corner ``(greatest x0, greatest y0)``, so no pair comes twice.
    ``how``: ``inner``, ``left`` (unmatched left rows with nulls) or ``left_semi``; rows of
    ``left`` that are equal, nulls included, fare alike. ``cell`` should be about a typical box.

    With ``exact``, pairs whose boxes meet are tested by their shapes, in Arrow batches, where a
    side has a ``ring`` (and ``holes``): areas, lines or points that have a point in common,
    borders included.
    """
    named = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    a = on_grid(left, cell)
    b = on_grid(right, cell).select(*[F.col(c).alias(f"r_{c}") for c in right.columns], F.col("gx").alias("r_gx"), F.col("gy").alias("r_gy"))
    owner = (F.floor(F.greatest("x0", "r_x0") / cell) == F.col("gx")) & (F.floor(F.greatest("y0", "r_y0") / cell) == F.col("gy"))
    same = (F.col(key) == F.col(f"r_{key}")) & (F.col("gx") == F.col("r_gx")) & (F.col("gy") == F.col("r_gy"))
    pairs = a.join(b, same & meets(box(), box("r_"), touch) & owner).select(*left.columns, *named.columns)
    if exact and has_rings(left, right):
        pairs = pairs.where(rings_meet(*outline(pairs), *outline(pairs, "r_")))
    if how == "inner":
        return pairs
    matched = pairs.select(*left.columns).distinct().alias("m")
    alike = [F.col(f"l.`{c}`").eqNullSafe(F.col(f"m.`{c}`")) for c in left.columns]
    if how == "left_semi":
        return left.alias("l").join(matched, alike, "left_semi").select(*[f"l.`{c}`" for c in left.columns])
    alone = left.alias("l").join(matched, alike, "left_anti").select(*[f"l.`{c}`" for c in left.columns])
    return pairs.unionByName(alone, allowMissingColumns=True)
