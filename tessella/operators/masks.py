"""Masks as pixel rows: drawing boxes, changing between kinds, and turning them to regions.

Kinds: binary ``v`` 0 or 1; multiclass ``v`` a class number; multilabel one row for each class
``c`` that a pixel has; instance ``v`` a component's number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.boxes import box, inside, shrunk
from tessella.operators import raster


def draw(boxes: DataFrame, step: int, class_col: str) -> DataFrame:
    """``slide_id, y, x, c``: the canvas cells of side ``step`` that the boxes of a class reach."""
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / step), F.greatest(F.floor((F.col(hi) - 1) / step), F.floor(F.col(lo) / step))))
    rows = boxes.select("slide_id", F.col(class_col).alias("c"), "x0", "x1", span("y0", "y1").alias("y"))
    return rows.select("slide_id", "y", span("x0", "x1").alias("x"), "c").distinct()


def to_binary(multilabel: DataFrame) -> DataFrame:
    """Pixels that any class has."""
    return multilabel.select("slide_id", "y", "x").distinct().withColumn("v", F.lit(1).cast("long"))


def to_multiclass(multilabel: DataFrame, order: dict[str, int]) -> DataFrame:
    """One class a pixel: of several, that which comes last in ``order`` (numbers from 1)."""
    number = F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("c"))
    return multilabel.groupBy("slide_id", "y", "x").agg(F.max(number).cast("long").alias("v"))


def to_multilabel(multiclass: DataFrame) -> DataFrame:
    """One row for each class that isn't background."""
    return multiclass.where("v <> 0").select("slide_id", "y", "x", F.col("v").alias("c"))


def class_names(df: DataFrame, column: str, names: dict[int, str]) -> DataFrame:
    """``class`` for each class number; a number without a name gives null."""
    return df.withColumn("class", F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col(column).cast("int")))


def find_tissues(pixels: DataFrame, scale: int = 1, blur: int = 3, close: int = 3, least_area: int = 4) -> DataFrame:
    """Regions brighter than Otsu's threshold after a median blur and a closing:
    ``image_id, tissue_id, area`` and bounds at level 0. ``tissue_id`` counts from 0 by image."""
    smooth = raster.median_blur(pixels, blur).withColumn("v", F.col("v").cast("long"))
    mask = raster.morph_close(raster.binary(smooth, raster.otsu(smooth)), close)
    regions = raster.component_shapes(raster.mask_components(mask)).where(F.col("area") > least_area)
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("image_id").orderBy("component")) - 1
    scaled = [(F.col(c) * scale).alias(c) for c in ("x0", "y0", "x1", "y1")]
    return regions.select("image_id", number.cast("long").alias("tissue_id"), (F.col("area") * scale * scale).alias("area"), *scaled)


def off_edge(pairs: DataFrame, margin: int = 2) -> DataFrame:
    """Instances that don't cross the edge of their tile ``r_x0..r_y1`` made smaller by ``margin``:
    they lie strictly within it, or wholly outside of it."""
    tile = shrunk(box("r_"), margin)
    b = box()
    within = inside((b[0] - 1, b[1] - 1, b[2] + 1, b[3] + 1), tile)
    outside = (b[0] > tile[2]) | (b[2] < tile[0]) | (b[1] > tile[3]) | (b[3] < tile[1])
    return pairs.where(within | outside)


def in_frame(boxes: DataFrame, frame: tuple[float, float, float, float], ratio: float = 0.1) -> DataFrame:
    """Boxes that meet the slide's bounds scaled by ``1 - ratio`` about their middle."""
    x0, y0, x1, y1 = frame
    dx, dy = (x1 - x0) * ratio / 2, (y1 - y0) * ratio / 2
    return boxes.where((F.col("x0") <= x1 - dx) & (F.col("x1") >= x0 + dx) & (F.col("y0") <= y1 - dy) & (F.col("y1") >= y0 + dy))


def threshold_split(df: DataFrame, score: str, threshold: float) -> DataFrame:
    """``side``: positive above, negative below; rows at the threshold are in neither."""
    return df.withColumn("side", F.when(F.col(score) > threshold, "positive").when(F.col(score) < threshold, "negative")).where("side is not null")


def chunk_keys(df: DataFrame, size: int = 512) -> DataFrame:
    """``cy, cx``: the chunk of side ``size`` in which a box begins."""
    return df.withColumns({"cy": F.floor(F.col("y0") / size).cast("long"), "cx": F.floor(F.col("x0") / size).cast("long")})


def semantic_regions(probability: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Connected pixels over a threshold, with their mean probability: ``image_id, component,
    area``, bounds and ``prob``. ``probability`` has ``image_id, y, x, p``."""
    mask = probability.select("image_id", "y", "x", (F.col("p") > threshold).cast("long").alias("v"))
    parts = raster.mask_components(mask)
    return raster.component_shapes(parts).join(raster.region_probability(parts, probability), ["image_id", "component"])
