"""Image transforms that chain: colour channels, blurs, thresholds, morphology, foreground.

A transform is a small object with its parameters; called with pixel rows ``image_id, y, x``
and values, it returns pixel rows, or polygons where it is the last of a chain.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, replace
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators import halo, raster
from tessella.operators.polygons import mask_polygons

#: Light that haematoxylin, eosin and DAB take from red, green and blue (fixed values).
STAINS = ((0.65, 0.70, 0.29), (0.07, 0.99, 0.11), (0.27, 0.57, 0.78))
#: What Otsu's threshold of entropies is multiplied with in relaxed mode (a fixed value).
RELAXED = 0.85
FLIPPED_BORDER = 0.95


def grey(r: Column, g: Column, b: Column) -> Column:
    """Luma of red, green and blue (0 to 255), rounded."""
    return F.round(0.299 * r + 0.587 * g + 0.114 * b).cast("long")


def saturation(r: Column, g: Column, b: Column) -> Column:
    """Saturation of the HSV model, 0 to 255, rounded; black has none."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    return F.when(top == 0, F.lit(0)).otherwise(F.round((top - low) * 255 / top)).cast("long")


def hed(r: Column, g: Column, b: Column) -> list[Column]:
    """Amounts of haematoxylin, eosin and DAB in a pixel, at least zero each."""
    inverse = np.linalg.inv(np.array(STAINS))
    logs = [F.log(F.greatest(c / 255.0, F.lit(1e-6))) / float(np.log(1e-6)) for c in (r, g, b)]
    return [F.greatest(sum((x * float(inverse[i, k]) for i, x in enumerate(logs)), F.lit(0.0)), F.lit(0.0)) for k in range(3)]


def gaussian_blur(pixels: DataFrame, k: int = 3, sigma: float = 1.0) -> DataFrame:
    """Mean weighted by a Gaussian over a k x k window, of the pixels that exist.

    The window is taken along rows, then along columns.
    """
    if k % 2 == 0:
        raise ValueError("a kernel needs an odd size")
    if sigma <= 0:
        raise ValueError("sigma must be positive")
    return halo.weighted_mean(pixels, [float(np.exp(-i * i / (2 * sigma * sigma))) for i in range(-(k // 2), k // 2 + 1)])


def local_entropy(pixels: DataFrame, radius: int) -> DataFrame:
    """Entropy, in bits, of the values within ``radius`` of each pixel."""
    return halo.entropy(pixels, radius)


def otsu_of_doubles(pixels: DataFrame) -> DataFrame:
    """``image_id, threshold``: the middle of that of 256 equal bins after which Otsu's split is."""
    ends = pixels.groupBy("image_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    share = (F.col("v") - F.col("lo")) * 256 / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    binned = pixels.join(ends, "image_id").select("image_id", F.least(F.coalesce(F.floor(share), F.lit(0)), F.lit(255)).cast("long").alias("v"))
    middle = F.col("lo") + (F.col("threshold") + 0.5) * (F.col("hi") - F.col("lo")) / 256
    return raster.otsu(binned).join(ends, "image_id").select("image_id", middle.alias("threshold"))


def unflipped(mask: DataFrame) -> DataFrame:
    """The mask, turned round in images of which over 95 % of the border is foreground."""
    ends = mask.groupBy("image_id").agg(F.max("y").alias("my"), F.max("x").alias("mx"))
    border = mask.join(ends, "image_id").where("y = 0 or x = 0 or y = my or x = mx").groupBy("image_id").agg((F.avg("v") > FLIPPED_BORDER).alias("flip"))
    return mask.join(border, "image_id").select("image_id", "y", "x", F.when(F.col("flip"), 1 - F.col("v")).otherwise(F.col("v")).alias("v"))


class Transform:
    """What all transforms share: ``params``, and ``set_params`` for a changed copy."""

    @property
    def params(self) -> dict[str, Any]:
        return asdict(self)  # type: ignore[call-overload]

    def set_params(self, **changes: Any) -> Transform:
        unknown = set(changes) - set(self.params)
        if unknown:
            raise ValueError(f"{type(self).__name__} has no {', '.join(sorted(unknown))}")
        return replace(self, **changes)  # type: ignore[type-var]


@dataclass(frozen=True)
class _Window(Transform):
    kernel_size: int = 3

    def __post_init__(self) -> None:
        if self.kernel_size < 1 or self.kernel_size % 2 == 0:
            raise ValueError("a kernel needs an odd size")


class MedianBlur(_Window):
    def __call__(self, pixels: DataFrame) -> DataFrame:
        return raster.median_blur(pixels, self.kernel_size).withColumn("v", F.col("v").cast("long"))


class BoxBlur(_Window):
    def __call__(self, pixels: DataFrame) -> DataFrame:
        return raster.box_blur(pixels, self.kernel_size)


@dataclass(frozen=True)
class GaussianBlur(_Window):
    sigma: float = 1.0

    def __call__(self, pixels: DataFrame) -> DataFrame:
        return gaussian_blur(pixels, self.kernel_size, self.sigma)


@dataclass(frozen=True)
class Morphology(_Window):
    n_iterations: int = 1

    def repeated(self, step: Callable[[DataFrame, int], DataFrame], mask: DataFrame) -> DataFrame:
        for _ in range(self.n_iterations):
            mask = step(mask, self.kernel_size)
        return mask


class MorphOpen(Morphology):
    """As many erosions as dilations after them."""

    def __call__(self, mask: DataFrame) -> DataFrame:
        return self.repeated(raster.dilate, self.repeated(raster.erode, mask))


class MorphClose(Morphology):
    """As many dilations as erosions after them."""

    def __call__(self, mask: DataFrame) -> DataFrame:
        return self.repeated(raster.erode, self.repeated(raster.dilate, mask))


@dataclass(frozen=True)
class Channel(Transform):
    """One value of the columns ``r, g, b``: ``grey``, ``saturation`` or ``artifact``."""

    kind: str = "grey"

    def __call__(self, pixels: DataFrame) -> DataFrame:
        made = {"grey": grey, "saturation": saturation, "artifact": raster.artifact_heat}
        if self.kind not in made:
            raise ValueError(f"unknown channel {self.kind!r}; known: {', '.join(made)}")
        return pixels.select("image_id", "y", "x", made[self.kind](F.col("r"), F.col("g"), F.col("b")).alias("v"))


@dataclass(frozen=True)
class BinaryThreshold(Transform):
    """1 where a grey value is over ``threshold``, or over Otsu's without one; else 0."""

    threshold: float | None = None

    def __call__(self, pixels: DataFrame) -> DataFrame:
        if "v" not in pixels.columns:
            raise ValueError("a threshold needs grey values in the column v")
        if self.threshold is None:
            return raster.binary(pixels, raster.otsu(pixels))
        return pixels.select("image_id", "y", "x", (F.col("v") > self.threshold).cast("long").alias("v"))


@dataclass(frozen=True)
class ArtifactFilterThreshold(Transform):
    """Otsu's threshold of the heat of ``r, g, b``, which is low where pens and dyes are."""

    def __call__(self, pixels: DataFrame) -> DataFrame:
        heat = Channel("artifact")(pixels)
        return raster.binary(heat, raster.otsu(heat))


@dataclass(frozen=True)
class EntropyThreshold(Transform):
    """1 where the stains of ``r, g, b`` vary much within a disk; turned round if flipped.

    Stains are scaled together to 0..255. Relaxed: haematoxylin's and eosin's entropies, against
    0.85 of Otsu's threshold; else DAB's is subtracted, and the threshold holds as it is.
    """

    disk_radius: int = 4
    relaxed_threshold: bool = True
    invert_check: bool = True

    def __post_init__(self) -> None:
        if self.disk_radius < 1:
            raise ValueError("disk_radius must be at least 1")

    def __call__(self, pixels: DataFrame) -> DataFrame:
        stains = dict(zip("hed", hed(F.col("r"), F.col("g"), F.col("b"))))
        rows = pixels.select("image_id", "y", "x", *[c.alias(k) for k, c in stains.items()])
        ends = rows.groupBy("image_id").agg(F.min(F.least(*stains)).alias("lo"), F.max(F.greatest(*stains)).alias("hi"))
        scaled = rows.join(ends, "image_id")
        wide = F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
        byte = lambda c: F.coalesce(F.round((F.col(c) - F.col("lo")) / wide * 255), F.lit(0)).cast("long")
        signs = {"h": 1.0, "e": 1.0} if self.relaxed_threshold else {"h": 1.0, "e": 1.0, "d": -1.0}
        parts = [local_entropy(scaled.select("image_id", "y", "x", byte(c).alias("v")), self.disk_radius).withColumn("v", s * F.col("v")) for c, s in signs.items()]
        stacked = parts[0]
        for part in parts[1:]:
            stacked = stacked.unionByName(part)
        entropy = stacked.groupBy("image_id", "y", "x").agg(F.greatest(F.sum("v"), F.lit(0.0)).alias("v"))
        limit = otsu_of_doubles(entropy)
        factor = RELAXED if self.relaxed_threshold else 1.0
        mask = raster.binary(entropy, limit.withColumn("threshold", F.col("threshold") * factor))
        return unflipped(mask) if self.invert_check else mask


@dataclass(frozen=True)
class ForegroundDetection(Transform):
    """Polygons with holes; areas under 1 are shares of the image, others are pixels."""

    min_foreground_area: float = 0.01
    min_hole_area: float = 0.0001
    detect_holes: bool = True

    def __call__(self, mask: DataFrame) -> DataFrame:
        shapes = mask_polygons(mask, holes=self.detect_holes)
        size = mask.groupBy("image_id").agg(F.count("*").alias("pixels"))
        least = lambda limit: F.lit(float(limit)) * (F.col("pixels") if limit < 1 else F.lit(1))
        big = F.filter("holes", lambda h: _area(h) >= least(self.min_hole_area))
        rows = shapes.join(size, "image_id").withColumn("holes", big)
        rows = rows.withColumn("area", _area(F.col("ring")) - F.aggregate("holes", F.lit(0.0), lambda n, h: n + _area(h)))
        return rows.where(F.col("area") >= least(self.min_foreground_area)).drop("pixels")


def _area(ring: Column) -> Column:
    from tessella.functions.boxes import ring_area

    return ring_area(ring)


@dataclass(frozen=True)
class Compose(Transform):
    """Transforms one after the other."""

    steps: tuple[Callable[[DataFrame], DataFrame], ...]

    def __post_init__(self) -> None:
        for step in self.steps:
            if not callable(step):
                raise ValueError(f"{step!r} is no transform")

    def __call__(self, rows: DataFrame) -> DataFrame:
        for step in self.steps:
            rows = step(rows)
        return rows


def tissue_detection(use_saturation: bool = True, filter_artifacts: bool = False, threshold: float | None = None, blur: int = 17, morph: int = 7, n_iterations: int = 3, min_tissue_area: float = 0.01, min_hole_area: float = 0.0001, detect_holes: bool = True) -> Compose:
    """Polygons of tissue in ``r, g, b`` pixels of H&E slides."""
    if filter_artifacts:
        first = (ArtifactFilterThreshold(),)
    else:
        first = (Channel("saturation" if use_saturation else "grey"), MedianBlur(blur), BinaryThreshold(threshold))
    return Compose((*first, MorphClose(morph, n_iterations), ForegroundDetection(min_tissue_area, min_hole_area, detect_holes)))


def mask_to_polygons(min_area: float = 0, morph: int = 7, n_iterations: int = 3, min_tissue_area: float = 0.01, min_hole_area: float = 0.0001, detect_holes: bool = True) -> Compose:
    """Polygons of a mask that is closed first; those of less than ``min_area`` pixels are left out."""
    found = ForegroundDetection(min_tissue_area, min_hole_area, detect_holes)
    return Compose((MorphClose(morph, n_iterations), found, lambda polygons: polygons.where(F.col("area") >= min_area)))
