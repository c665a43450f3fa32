"""What a viewer asks for: what is in view, at which level, and counts on a canvas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

View = tuple[int, int, int, int]  # x0, y0, x1, y1


def in_view(boxes: DataFrame, view: View, touch: bool = False) -> DataFrame:
    """Boxes in view: tiles by open intervals, polygons (``touch``) with their edges."""
    x0, y0, x1, y1 = view
    if touch:
        return boxes.where((F.col("x0") <= x1) & (F.col("x1") >= x0) & (F.col("y0") <= y1) & (F.col("y1") >= y0))
    return boxes.where((F.col("x0") < x1) & (F.col("x1") > x0) & (F.col("y0") < y1) & (F.col("y1") > y0))


def grid_cells(tiles: DataFrame, view: View, step: int) -> DataFrame:
    """``gx, gy`` of every tile on a grid over the view, held to its last cell."""
    x0, y0, x1, y1 = view
    last = lambda a, b: max(1, (b - a) // step) - 1
    at = lambda c, o, n: F.least(F.greatest(F.floor((F.col(c) - o) / step), F.lit(0)), F.lit(n)).cast("long")
    return tiles.withColumns({"gx": at("x0", x0, last(x0, x1)), "gy": at("y0", y0, last(y0, y1))})


def canvas_counts(boxes: DataFrame, step: int, category: str | None = None) -> DataFrame:
    """How many box centres fall in each canvas cell of side ``step``, by category if given."""
    at = lambda a, b: F.floor((F.col(a) + F.col(b)) / 2 / step).cast("long")
    keys = ["slide_id", at("x0", "x1").alias("cx"), at("y0", "y1").alias("cy"), *([category] if category else [])]
    return boxes.groupBy(*keys).agg(F.count("*").alias("n"))


def level_for(levels: DataFrame, downsample: float, max_bytes: int | None = None) -> DataFrame:
    """Of each slide's levels, the coarsest that isn't coarser than ``downsample``; with
    ``max_bytes``, the finest from there on that fits. ``levels``: ``slide_id, level,
    downsample, height, width``."""
    fine = levels.groupBy("slide_id").agg(F.coalesce(F.max(F.when(F.col("downsample") <= downsample, F.col("level"))), F.min("level")).alias("start"), F.max("level").alias("last"))
    rows = levels.join(fine, "slide_id").where("level >= start")
    fits = F.lit(True) if max_bytes is None else F.col("height") * F.col("width") * 4 <= max_bytes
    return rows.groupBy("slide_id").agg(F.coalesce(F.min(F.when(fits, F.col("level"))), F.max("last")).alias("level"))


def zoom_view(view: View, x: tuple[float, float], y: tuple[float, float]) -> View:
    """The part of a view between two places each way: shares of it if all are within 0 and 1,
    pixels from its corner if all are over 1."""
    ends = (*x, *y)
    if x[0] >= x[1] or y[0] >= y[1]:
        raise ValueError("a range needs a beginning before its end")
    x0, y0, x1, y1 = view
    if all(0 <= e <= 1 for e in ends):
        w, h = x1 - x0, y1 - y0
        return int(x0 + x[0] * w), int(y0 + y[0] * h), int(x0 + x[1] * w), int(y0 + y[1] * h)
    if all(e > 1 for e in ends):
        return int(x0 + x[0]), int(y0 + y[0]), int(x0 + x[1]), int(y0 + y[1])
    raise ValueError("a range is in shares or in pixels, not in both")


def scatter_plan(tiles: DataFrame, view: View | None = None) -> DataFrame:
    """``slide_id, tile_id, x, y, size``: centres in view, and the markers' size, 12,000 over their number."""
    shown = tiles if view is None else in_view(tiles, view)
    number = shown.groupBy("slide_id").agg((12_000 / F.count("*")).alias("size"))
    centre = lambda a, b: ((F.col(a) + F.col(b)) / 2)
    return shown.join(number, "slide_id").select("slide_id", "tile_id", centre("x0", "x1").alias("x"), centre("y0", "y1").alias("y"), "size")


def panels(tissues: DataFrame, ids: None | int | str | list[int], colors: list[str]) -> DataFrame:
    """``slide_id, tissue_id, color, row, col`` of a grid of pictures: a row for each tissue, a
    column for each colour. ``ids``: None is the whole slide (a null tissue), ``all`` every one."""
    if isinstance(ids, str) and ids != "all":
        raise ValueError(f"tissues are None, a number, 'all' or a list, not {ids!r}")
    wanted = [ids] if isinstance(ids, int) else ids
    if wanted is None:
        rows = tissues.select("slide_id", F.lit(None).cast("long").alias("tissue_id")).distinct()
    else:
        rows = tissues.select("slide_id", "tissue_id").distinct()
        rows = rows if wanted == "all" else rows.where(F.col("tissue_id").isin(*wanted))
    placed = rows.withColumn("row", F.row_number().over(Window.partitionBy("slide_id").orderBy("tissue_id")) - 1)
    return placed.select("slide_id", "tissue_id", "row", F.posexplode(F.array(*map(F.lit, colors))).alias("col", "color"))
