"""Grids of tiles over boxes, over tissues, and within tiles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.boxes import area, box, overlap
from tessella.plans.spatial_join import spatial_join


@dataclass(frozen=True)
class TileSpec:
    """Sizes of tiles in level-0 pixels, from their size at a resolution.

    ``overlap`` in (0, 1) is a share of the tile, above 1 it is pixels; it excludes ``stride_px``.
    """

    tile_px: int
    stride_px: int | None = None
    overlap: float | None = None
    mpp: float | None = None
    slide_mpp: float | None = None

    def __post_init__(self) -> None:
        if self.stride_px is not None and self.overlap is not None:
            raise ValueError("give stride_px or overlap, not both")
        if self.mpp is not None and self.slide_mpp is None:
            raise ValueError("mpp needs the slide's own mpp")

    @property
    def downsample(self) -> float:
        return self.mpp / self.slide_mpp if self.mpp else 1.0

    @property
    def stride(self) -> int:
        if self.stride_px is not None:
            return self.stride_px
        if self.overlap is None:
            return self.tile_px
        return int(self.tile_px * (1 - self.overlap)) if self.overlap < 1 else int(self.tile_px - self.overlap)

    @property
    def base_tile(self) -> int:
        return int(self.tile_px * self.downsample)

    @property
    def base_stride(self) -> int:
        return int(self.stride * self.downsample)


def starts(origin: Column, length: Column, tile: int, stride: int, edge: bool) -> Column:
    """Where tiles begin along one side: one tile if the side is shorter than it; with
    ``edge`` one more if the last one ends before the side does."""
    n = F.floor((length - tile) / stride) + 1
    if edge:
        n = n + F.when((n - 1) * stride + tile < length, 1).otherwise(0)
    n = F.when(length < tile, F.lit(1)).otherwise(n)
    return F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1), lambda i: origin + i * stride)


def tiles_from_boxes(boxes: DataFrame, tile: int, stride: int | None = None, edge: bool = True) -> DataFrame:
    """The grid over the bounds ``x0, y0, x1, y1`` of every row, x outer and y inner.

    The row's other columns stay; the grid's boxes are ``x0, y0, x1, y1``, its rank ``place``.
    """
    stride = stride or tile
    others = [c for c in boxes.columns if c not in ("x0", "y0", "x1", "y1")]
    xs = starts(F.col("x0").cast("long"), (F.col("x1") - F.col("x0")).cast("long"), tile, stride, edge)
    ys = starts(F.col("y0").cast("long"), (F.col("y1") - F.col("y0")).cast("long"), tile, stride, edge)
    rows = boxes.select(*others, xs.alias("xs"), ys.alias("ys"))
    rows = rows.select(*others, F.size("ys").alias("ny"), "ys", F.posexplode("xs").alias("ix", "x0"))
    rows = rows.select(*others, "ny", "ix", "x0", F.posexplode("ys").alias("iy", "y0"))
    return rows.select(*others, "x0", "y0", (F.col("x0") + tile).alias("x1"), (F.col("y0") + tile).alias("y1"), (F.col("ix") * F.col("ny") + F.col("iy")).cast("long").alias("place"))


def tile_tissues(tissues: DataFrame, tile: int, stride: int | None = None, edge: bool = False, background_fraction: float | None = 0.3) -> DataFrame:
    """Tiles of every tissue's grid that hold enough of it.

    With a ``background_fraction`` a tile stays if its covered share is at least one less that
    fraction; with None every tile that touches its tissue stays. ``tile_id`` counts from 0
    in each slide by tissue, then along the grid. An empty table gives an empty result.
    """
    grid = tiles_from_boxes(tissues.select("slide_id", "tissue_id", "x0", "y0", "x1", "y1", *[F.col(c).alias(f"t_{c}") for c in ("x0", "y0", "x1", "y1")]), tile, stride, edge)
    covered = overlap(box(), box("t_")).cast("double") / area(box())
    if background_fraction is not None:
        grid = grid.where(covered >= 1 - background_fraction)
    # Tiles are counted by tissue, and numbered within theirs from what stands before it.
    before = Window.partitionBy("slide_id").orderBy("tissue_id").rowsBetween(Window.unboundedPreceding, -1)
    sizes = grid.groupBy("slide_id", "tissue_id").agg(F.count("*").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    sizes = sizes.select(F.col("slide_id").alias("of_slide"), F.col("tissue_id").alias("of_tissue"), "first")
    place = F.row_number().over(Window.partitionBy("slide_id", "tissue_id").orderBy("place")) - 1
    numbered = grid.withColumns({"coverage": covered, "here": place}).join(sizes, F.col("slide_id").eqNullSafe(F.col("of_slide")) & F.col("tissue_id").eqNullSafe(F.col("of_tissue")))
    return numbered.select("slide_id", (F.col("first") + F.col("here")).alias("tile_id"), "tissue_id", "x0", "y0", "x1", "y1", "coverage")


def tiles_over_tissues(tiles: DataFrame, tissues: DataFrame, cell: int = 1024, background_fraction: float | None = 0.3) -> DataFrame:
    """Pairs of given tiles and tissues, with the covered share of the tile: ``slide_id,
    tile_id, tissue_id, coverage``. Without a ``background_fraction``, touching is enough."""
    pairs = spatial_join(tiles.select("slide_id", "tile_id", "x0", "y0", "x1", "y1"), tissues.select("slide_id", "tissue_id", "x0", "y0", "x1", "y1"), cell)
    covered = overlap(box(), box("r_")).cast("double") / area(box())
    out = pairs.select("slide_id", "tile_id", F.col("r_tissue_id").alias("tissue_id"), covered.alias("coverage"))
    return out if background_fraction is None else out.where(F.col("coverage") >= 1 - background_fraction)


def subdivide_tiles(tiles: DataFrame, nx: int, ny: int) -> DataFrame:
    """Every tile cut into ``nx`` by ``ny`` parts, y outer and x inner, as tokens are ordered."""
    if nx < 1 or ny < 1:
        raise ValueError("a tile needs at least one part each way")
    cut = tiles.select("slide_id", "tissue_id", F.col("tile_id").alias("original_tile_id"), ((F.col("x1") - F.col("x0")) / nx).cast("long").alias("w"), ((F.col("y1") - F.col("y0")) / ny).cast("long").alias("h"), "x0", "y0", F.explode(F.sequence(F.lit(0), F.lit(nx * ny - 1))).alias("i"))
    x0 = F.col("x0") + F.expr(f"i % {nx}") * F.col("w")
    y0 = F.col("y0") + F.expr(f"i div {nx}") * F.col("h")
    rows = cut.select((F.col("original_tile_id") * (nx * ny) + F.col("i")).cast("long").alias("tile_id"), "original_tile_id", "slide_id", "tissue_id", x0.alias("x0"), y0.alias("y0"), "w", "h")
    return rows.select("tile_id", "original_tile_id", "slide_id", "tissue_id", "x0", "y0", (F.col("x0") + F.col("w")).alias("x1"), (F.col("y0") + F.col("h")).alias("y1"))
