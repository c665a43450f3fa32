"""Raster algebra on pixel rows ``image_id, y, x, v``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators import halo
from tessella.plans.components import slide_components
from tessella.plans.session import cut


def otsu(pixels: DataFrame) -> DataFrame:
    """``image_id, threshold``: the grey value (of 256) after which the variance between the two
    classes is greatest; the lowest of several. A flat image has no split, and its value."""
    hist = pixels.groupBy("image_id", "v").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("image_id").orderBy("v")
    whole = Window.partitionBy("image_id")
    s = hist.select("image_id", "v", F.sum("n").over(upto).alias("w"), F.sum(F.col("v") * F.col("n")).over(upto).alias("m"), F.sum("n").over(whole).alias("wt"), F.sum(F.col("v") * F.col("n")).over(whole).alias("mt"))
    rest = F.nullif(F.col("wt") - F.col("w"), F.lit(0))
    gap = F.col("m") / F.col("w") - (F.col("mt") - F.col("m")) / rest
    between = F.round(F.coalesce(F.col("w") * rest * gap * gap, F.lit(-1.0)).cast("double"), 6)
    return s.select("image_id", "v", between.alias("b")).groupBy("image_id").agg(F.min_by("v", F.struct((-F.col("b")).alias("b"), "v")).alias("threshold"))


def binary(pixels: DataFrame, thresholds: DataFrame) -> DataFrame:
    """1 where a pixel is over its image's threshold, else 0."""
    return pixels.join(thresholds, "image_id").select("image_id", "y", "x", (F.col("v") > F.col("threshold")).cast("long").alias("v"))


def _swept(pixels: DataFrame, k: int, of: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Columns made over the k x k window of every pixel, along rows and then along columns.

    Windows slide over the pixels as they are, none is copied. Images are whole.
    """
    if k % 2 == 0:
        raise ValueError("a kernel needs an odd size")
    for across, along in (("y", "x"), ("x", "y")):
        near = Window.partitionBy("image_id", across).orderBy(along).rangeBetween(-(k // 2), k // 2)
        pixels = pixels.withColumns({name: f(F.col(name)).over(near) for name, f in of.items()})
    return pixels


def box_blur(pixels: DataFrame, k: int = 3) -> DataFrame:
    """Mean over the window, of the pixels that exist."""
    summed = _swept(pixels.select("image_id", "y", "x", "v", F.lit(1).cast("long").alias("n")), k, {"v": F.sum, "n": F.sum})
    return summed.select("image_id", "y", "x", (F.col("v") / F.col("n")).alias("v"))


def median_blur(pixels: DataFrame, k: int = 3) -> DataFrame:
    """Median over the window: the one filter here that doesn't go by rows and columns."""
    if k % 2 == 0:
        raise ValueError("a kernel needs an odd size")
    return halo.median(pixels, k)


def erode(pixels: DataFrame, k: int = 3) -> DataFrame:
    return _swept(pixels.select("image_id", "y", "x", "v"), k, {"v": F.min})


def dilate(pixels: DataFrame, k: int = 3) -> DataFrame:
    return _swept(pixels.select("image_id", "y", "x", "v"), k, {"v": F.max})


def morph_open(pixels: DataFrame, k: int = 3) -> DataFrame:
    return dilate(erode(pixels, k), k)


def morph_close(pixels: DataFrame, k: int = 3) -> DataFrame:
    return erode(dilate(pixels, k), k)


def artifact_heat(r: Column, g: Column, b: Column) -> Column:
    """Redness times blueness over green, held to 0..255."""
    return F.least(F.lit(255), F.greatest(r - g, F.lit(0)) * F.greatest(b - g, F.lit(0)))


def importance(dy: Column, dx: Column, size: int, mode: str = "gaussian", sigma_scale: float = 0.125) -> Column:
    """Weight of a pixel in its tile: constant, or a Gaussian that is 1 in the middle."""
    if mode == "constant":
        return F.lit(1.0)
    if mode != "gaussian":
        raise ValueError(f"unknown mode {mode!r}: constant or gaussian")
    mid, s = (size - 1) / 2, size * sigma_scale
    return F.exp(-((dy - mid) * (dy - mid) + (dx - mid) * (dx - mid)) / (2 * s * s))


def blend(weighted: DataFrame, normalize: str = "count") -> DataFrame:
    """Overlapping predictions as one map: sum of ``w * p`` over the count, or over the weights."""
    over = {"count": F.count("*").cast("double"), "weights": F.sum("w")}
    if normalize not in over:
        raise ValueError("normalize must be 'count' or 'weights'")
    return weighted.groupBy("image_id", "y", "x").agg((F.sum(F.col("w") * F.col("p")) / over[normalize]).alias("p"))


#: A pixel's number in its image: its row, then its column.
ROW = 1 << 32


def runs(mask: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``image_id, *by, y, x0, x1, run`` of every stretch of neighbours in a row of the pixels
    that aren't 0; ``run`` is the number of its first pixel."""
    keys = ["image_id", *by, "y"]
    row = Window.partitionBy(*keys).orderBy("x")
    on = mask.where("v <> 0").select(*keys, "x").distinct()
    fresh = on.withColumn("first", F.when(F.col("x") - F.lag("x").over(row) == 1, None).otherwise(F.col("x")))
    held = fresh.withColumn("x0", F.max("first").over(row))
    whole = held.groupBy(*keys, "x0").agg(F.max("x").alias("x1"))
    return whole.withColumn("run", F.col("y") * ROW + F.col("x0"))


def run_components(stretches: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The runs with the number of their 8-connected component, its first pixel's."""
    within = ("image_id", *by)
    ends = ["x0", "x1", "run"]
    below = stretches.select(*within, (F.col("y") - 1).alias("y"), *[F.col(c).alias(f"b_{c}") for c in ends])
    touching = (F.col("b_x0") <= F.col("x1") + 1) & (F.col("b_x1") >= F.col("x0") - 1)
    edges = stretches.join(below, [*within, "y"]).where(touching)
    parts = slide_components(edges, "run", "b_run", "run", within)
    return stretches.join(parts, [*within, "run"], "left").withColumn("component", F.coalesce("component", "run"))


def mask_components(mask: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """8-connected components of the pixels that aren't 0: ``image_id, *by, y, x, component``.

    Runs of pixels in a row are linked, not pixels. ``component`` is the number of its first
    pixel within the image, ``y * 2^32 + x``. With ``by``, pixels are linked within a class.
    """
    parts = run_components(cut(runs(mask, by)), by)
    return parts.select("image_id", *by, "y", F.explode(F.sequence("x0", "x1")).alias("x"), "component")


def component_shapes(parts: DataFrame) -> DataFrame:
    """``image_id, component, area`` and bounds of each component."""
    return parts.groupBy("image_id", "component").agg(F.count("*").alias("area"), F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"))


def region_probability(parts: DataFrame, probability: DataFrame) -> DataFrame:
    """Mean probability over each component's pixels."""
    return parts.join(probability.select("image_id", "y", "x", "p"), ["image_id", "y", "x"]).groupBy("image_id", "component").agg(F.avg("p").alias("prob"))


def image_measures(pixels: DataFrame) -> DataFrame:
    """``image_id, brightness, contrast, sobel``: mean, deviation, and mean gradient inside."""
    basic = pixels.groupBy("image_id").agg(F.avg("v").alias("brightness"), F.stddev_pop("v").alias("contrast"))
    taps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(gx).alias("gx"), F.lit(gy).alias("gy")) for dy, dx, gx, gy in ((-1, -1, 1, 1), (-1, 0, 0, 2), (-1, 1, -1, 1), (0, -1, 2, 0), (0, 1, -2, 0), (1, -1, 1, -1), (1, 0, 0, -2), (1, 1, -1, -1))])
    moved = pixels.select("image_id", "y", "x", "v", F.explode(taps).alias("t")).select("image_id", (F.col("y") + F.col("t.dy")).alias("y"), (F.col("x") + F.col("t.dx")).alias("x"), (F.col("v") * F.col("t.gx")).alias("gx"), (F.col("v") * F.col("t.gy")).alias("gy"))
    inside = moved.groupBy("image_id", "y", "x").agg(F.sum("gx").alias("gx"), F.sum("gy").alias("gy"), F.count("*").alias("n")).where("n = 8")
    edges = inside.join(pixels.select("image_id", "y", "x"), ["image_id", "y", "x"], "left_semi").groupBy("image_id").agg(F.avg(F.sqrt((F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).cast("double"))).alias("sobel"))
    return basic.join(edges, "image_id", "left")
