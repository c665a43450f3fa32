"""Segmentation runs: models over tile pictures, maps joined, polygons made, and prompts.

A model is any callable, or an object with ``segment``; it gets a batch of pictures and gives a
map for each. Spark deals the tiles out; what comes back is checked and goes on as rows.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators import cells, instances, masks, polygons, raster, regions, transforms
from tessella.plans.session import bounded_batches, cut, ship_package, written
from tessella.plans.spatial_join import spatial_join

#: Resolutions (micrometres a pixel) of the artifact model's variants, and its tiles (fixed values).
ARTIFACT_MPP, ARTIFACT_TILE = {"5x": 2.0, "7x": 1.5, "10x": 1.0}, 512
#: The artifact model's classes that aren't artifacts (fixed values).
CLEAN_CLASSES = ("Background", "Normal Tissue")


def thresholds(values: DataFrame, rule: str | float | Sequence[float], by: str = "prompt") -> DataFrame:
    """``by, threshold``: what scores of each ``by`` must exceed.

    ``rule``: ``otsu`` (of the 256 bins of its values), one number, or a list, one for each
    ``by`` in order. ``values`` has ``by`` and ``v``.
    """
    groups = values.select(by).distinct()
    if isinstance(rule, str):
        if rule != "otsu":
            raise ValueError(f"a threshold is 'otsu', a number or a list, not {rule!r}")
        if values.isEmpty():
            raise ValueError("there are no values for Otsu's threshold")
        rows = values.select(F.col(by).alias("image_id"), F.lit(0).alias("y"), F.lit(0).alias("x"), "v")
        return transforms.otsu_of_doubles(rows).withColumnRenamed("image_id", by)
    if isinstance(rule, bool) or not isinstance(rule, int | float | Sequence):
        raise ValueError(f"a threshold is 'otsu', a number or a list, not {type(rule).__name__}")
    if isinstance(rule, int | float):
        return groups.withColumn("threshold", F.lit(float(rule)))
    numbered = groups.withColumn("place", F.row_number().over(Window.orderBy(by)) - 1)
    if (groups.count() or 0) > len(rule):
        raise IndexError(f"{len(rule)} thresholds for more prompts than that")
    return numbered.select(by, F.get(F.array(*[F.lit(float(t)) for t in rule]), F.col("place")).alias("threshold"))


def segment_tiles(images: DataFrame, model: Callable, edge: int, keep: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """``slide_id, tile_id, x, y, py, px, v``: the model's map of every tile, as pixels over zero.

    ``images`` has ``slide_id, tile_id, x, y, vec`` (``edge * edge`` values). The model gives maps
    of the same number and size. ``keep`` picks the instances of a map that go on.
    """
    run_model = getattr(model, "segment", model)
    if not callable(run_model):
        raise TypeError(f"{type(model).__name__} is neither callable nor has it a method segment")
    ship_package(images.sparkSession)
    bounded_batches(images.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            pictures = np.array(batch.column("vec").to_pylist(), np.float64).reshape(-1, edge, edge)
            maps = np.asarray(run_model(pictures))
            if maps.shape != pictures.shape:
                raise ValueError(f"the model gave {maps.shape} for {pictures.shape}")
            if keep is not None:
                maps = np.stack([np.where(np.isin(m, keep(m)), m, 0) for m in maps])
            tile, y, x = np.nonzero(maps)
            own = {c: pa.array(batch.column(c).to_numpy(zero_copy_only=False)[tile], pa.int64()) for c in ("slide_id", "tile_id", "x", "y")}
            yield pa.RecordBatch.from_pydict(own | {"py": pa.array(y, pa.int64()), "px": pa.array(x, pa.int64()), "v": pa.array(maps[tile, y, x].astype(np.float64))})

    schema = "slide_id long, tile_id long, x long, y long, py long, px long, v double"
    return images.select(F.col("slide_id").cast("long"), F.col("tile_id").cast("long"), F.col("x").cast("long"), F.col("y").cast("long"), "vec").mapInArrow(run, schema)


def padded(images: DataFrame, edge: int, divider: int) -> tuple[DataFrame, int]:
    """Pictures with zeros around them, in the middle, up to a side that ``divider`` divides."""
    side = -(-edge // divider) * divider
    before = (side - edge) // 2

    def value(k: Column) -> Column:
        y, x = F.floor(k / side) - before, k % side - before
        inner = (y >= 0) & (y < edge) & (x >= 0) & (x < edge)
        return F.when(inner, F.get("vec", (y * edge + x).cast("int"))).otherwise(0.0)

    return images.withColumn("vec", F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), value)), before


def unpadded(pixels: DataFrame, edge: int, before: int) -> DataFrame:
    """Pixels of padded pictures, counted from the picture's own corner, without the padding."""
    moved = pixels.withColumns({"py": F.col("py") - before, "px": F.col("px") - before})
    return moved.where(F.col("py").between(0, edge - 1) & F.col("px").between(0, edge - 1))


class Runner(ABC):
    """A segmentation run: ``run`` makes polygons of tiles; ``tiler`` gives the tiles if none are given."""

    def tiler(self, tissues: DataFrame) -> DataFrame:
        raise NotImplementedError(f"{type(self).__name__} makes no tiles of its own")

    @abstractmethod
    def run(self, images: DataFrame) -> DataFrame: ...

    def __call__(self, images: DataFrame) -> DataFrame:
        return self.run(images)


class SemanticRunner(Runner):
    """Class polygons from overlapping tiles.

    The model gives the number of a class for each pixel. Where tiles overlap, votes are weighted
    by the importance map and the heaviest class wins; ``ignore`` is left out. For models that
    give probabilities there is :class:`ProbabilityRunner`.
    """

    def __init__(self, model: Callable, edge: int, names: dict[int, str], mode: str = "gaussian", ignore: int = 0, scale: int = 1, sigma_scale: float = 0.125) -> None:
        if mode not in ("constant", "gaussian"):
            raise ValueError(f"unknown mode {mode!r}: constant or gaussian")
        self.model, self.edge, self.names, self.mode, self.ignore, self.scale, self.sigma_scale = model, edge, names, mode, ignore, scale, sigma_scale

    def class_map(self, images: DataFrame) -> DataFrame:
        """``image_id, y, x, v``: the winning class of each pixel of the slide's map."""
        pixels = segment_tiles(images, lambda batch: np.asarray(getattr(self.model, "segment", self.model)(batch)) + 1, self.edge)
        weight = raster.importance(F.col("py"), F.col("px"), self.edge, self.mode, self.sigma_scale)
        at = [(F.expr(f"{a} div {self.scale}") + F.col(b)).alias(a) for a, b in (("y", "py"), ("x", "px"))]
        votes = pixels.select(F.col("slide_id").alias("image_id"), *at, (F.col("v") - 1).cast("long").alias("c"), weight.alias("w"))
        summed = votes.groupBy("image_id", "y", "x", "c").agg(F.round(F.sum("w"), 9).alias("w"))
        return summed.groupBy("image_id", "y", "x").agg(F.max_by("c", F.struct("w", (-F.col("c")).alias("low"))).alias("v"))

    def run(self, images: DataFrame) -> DataFrame:
        found = polygons.class_polygons(cut(self.class_map(images)), self.names, (self.ignore,))
        return found.withColumnRenamed("image_id", "slide_id")


#: Blended probabilities below this count as none (fixed value).
LEAST_PROBABILITY = 1e-3


def semantic_polygons(probability: DataFrame, names: dict[int, str], threshold: float = 0.5, ignore: tuple[int, ...] = (0,), buffer_px: float = 0, scale: float = 1, tissues: DataFrame | None = None, **limits: float) -> DataFrame:
    """Polygons of classes whose probability is over ``threshold``: ``slide_id, class, part, ring,
    holes, area``, bounds at level 0, and ``prob``.

    ``probability`` has ``slide_id, y, x, c, p``, in pixels of a map that is ``scale`` times
    smaller than level 0. Classes in ``ignore`` are left out; a pixel may be in several others.
    ``limits`` are those of :func:`polygons.mask_polygons`. What lies within twice the tolerance,
    the greater of one pixel and ``buffer_px`` pixels of the map, is dissolved; ``prob`` is then
    the highest mean probability of any polygon of the class. With ``tissues``, only polygons
    that meet one stay.
    """
    over = probability.where((F.col("p") > threshold) & (F.col("p") >= LEAST_PROBABILITY) & ~F.col("c").isin(*ignore))
    over = cut(over.select(F.col("slide_id").alias("image_id"), "y", "x", F.col("c").cast("long").alias("class_id"), F.lit(1).alias("v"), "p"))
    by = ["image_id", "class_id"]
    found = polygons.mask_polygons(over.drop("p"), ("class_id",), **limits)
    mean = raster.mask_components(over, ("class_id",)).join(over, [*by, "y", "x"]).groupBy(*by, "component").agg(F.avg("p").alias("prob"))
    larger = lambda ring: F.transform(ring, lambda q: F.struct((q["x"] * scale).alias("x"), (q["y"] * scale).alias("y")))
    named = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("class_id").cast("int")), F.col("class_id").cast("string"))
    at_level_0 = found.join(mean, [*by, "component"]).select(F.col("image_id").alias("slide_id"), named.alias("class"), "prob", larger(F.col("ring")).alias("ring"), F.transform("holes", larger).alias("holes"))
    done = regions.dissolve_polygons(at_level_0, ("slide_id", "class"), max(1.0, buffer_px * scale), "prob").drop("region")
    # The join reads its left side twice; unions aren't made twice for that.
    return done if tissues is None else spatial_join(written(done), tissues, 1024, how="left_semi", exact=True)


class ProbabilityRunner(Runner):
    """Class polygons from the probabilities that a model gives for every class of each pixel.

    The model gives ``classes`` maps for each tile. Where tiles overlap, probabilities times the
    importance map are added up and divided by the number of tiles, then made polygons as
    :func:`semantic_polygons` does.
    """

    def __init__(self, model: Callable, edge: int, names: dict[int, str], mode: str = "gaussian", scale: int = 1, sigma_scale: float = 0.125, **how: object) -> None:
        self.model, self.edge, self.names, self.mode, self.scale, self.sigma_scale, self.how = model, edge, names, mode, scale, sigma_scale, how

    def probability(self, images: DataFrame) -> DataFrame:
        """``slide_id, y, x, c, p`` of each pixel of the slide's map."""
        edge, run_model = self.edge, getattr(self.model, "segment", self.model)
        ship_package(images.sparkSession)
        bounded_batches(images.sparkSession)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                maps = np.asarray(run_model(np.array(batch.column("vec").to_pylist(), np.float64).reshape(-1, edge, edge)), np.float64)
                if maps.ndim != 4 or maps.shape[0] != batch.num_rows or maps.shape[2:] != (edge, edge):
                    raise ValueError(f"the model gave {maps.shape} for {batch.num_rows} tiles of {edge}")
                tile, c, y, x = (a.ravel() for a in np.indices(maps.shape))
                own = {n: pa.array(batch.column(n).to_numpy(zero_copy_only=False)[tile], pa.int64()) for n in ("slide_id", "x", "y")}
                yield pa.RecordBatch.from_pydict(own | {"c": pa.array(c, pa.int64()), "py": pa.array(y, pa.int64()), "px": pa.array(x, pa.int64()), "p": pa.array(maps.ravel())})

        schema = "slide_id long, x long, y long, c long, py long, px long, p double"
        pixels = images.select(F.col("slide_id").cast("long"), F.col("x").cast("long"), F.col("y").cast("long"), "vec").mapInArrow(run, schema)
        weight = raster.importance(F.col("py"), F.col("px"), edge, self.mode, self.sigma_scale)
        at = [(F.expr(f"{a} div {self.scale}") + F.col(b)).alias(a) for a, b in (("y", "py"), ("x", "px"))]
        return pixels.select("slide_id", *at, "c", (F.col("p") * weight).alias("p")).groupBy("slide_id", "y", "x", "c").agg(F.avg("p").alias("p"))

    def run(self, images: DataFrame, tissues: DataFrame | None = None) -> DataFrame:
        return semantic_polygons(self.probability(images), self.names, scale=self.scale, tissues=tissues, **self.how)


def artifact_runner(model: Callable, tile: int, mpp: float, overlap: int, names: dict[int, str], variant: str = "7x") -> SemanticRunner:
    """A semantic run of the artifact model; checks that tiles suit its variant."""
    if variant not in ARTIFACT_MPP:
        raise ValueError(f"unknown variant {variant!r}; known: {', '.join(ARTIFACT_MPP)}")
    if tile != ARTIFACT_TILE or abs(mpp - ARTIFACT_MPP[variant]) > 1e-6:
        raise ValueError(f"variant {variant} needs tiles of {ARTIFACT_TILE} pixels at {ARTIFACT_MPP[variant]} micrometres")
    return SemanticRunner(model, tile, names, "gaussian" if overlap else "constant")


def artifacts(regions: DataFrame) -> DataFrame:
    """Class polygons without background and normal tissue."""
    return regions.where(~F.col("class").isin(*CLEAN_CLASSES))


class CellRunner(Runner):
    """Cells from the instance maps of tiles, with outlines, classes, probabilities and vectors.

    The model gives instance maps, or :class:`instances.CellMaps`. With ``tiles`` (boxes at level
    0), an instance is kept by the tile that owns it alone. Instances that cross the edge of their
    tile (less ``margin``) go, as the neighbouring tile has them whole; then by ``size`` (area at
    level 0), by tissue, and by class, where ``names`` name classes and those in ``dropped`` go.
    ``cell_id`` counts through what is left of a slide, in the order of tiles and places. Last,
    of cells that overlap within a tissue the likeliest stays; cells of maps without probabilities
    are all as likely, so the first in order does.

    With ``features``, cells come with ``vec``, the mean of their tokens; those of tiles without
    tokens are left out, and none has one where the model gives none at all.
    """

    def __init__(
        self, model: Callable, edge: int, margin: int = 2, size: tuple[float, float] | None = None, keep: Callable | None = None, iou_threshold: float = 0.2,
        scale: int | float = 1, names: dict[int, str] | None = None, dropped: tuple[str, ...] = ("Background",), holes: bool = False, features: bool = False,
    ) -> None:
        self.model, self.edge, self.margin, self.size, self.keep, self.iou_threshold = model, edge, margin, size, keep, iou_threshold
        self.scale, self.names, self.dropped, self.holes, self.features = scale, names, dropped, holes, features

    def instances(self, images: DataFrame, tiles: DataFrame | None = None) -> DataFrame:
        """``slide_id, tile_id, instance, area``, bounds at level 0, ``cx, cy, class, prob, parts``
        and ``vec`` of every whole instance of a wanted size and class."""
        found = instances.find_instances(images, self.model, self.edge, self.scale, self.keep, self.holes, self.features)
        found = found if tiles is None else instances.owned(found, tiles)
        low, high = self.margin, self.edge - 1 - self.margin
        whole = found.where((F.col("tx0") > low) & (F.col("ty0") > low) & (F.col("tx1") < high) & (F.col("ty1") < high))
        at = lambda c, corner, more: (F.col(corner) + (F.col(c) + more) * self.scale).alias(c[1:])
        bounds = [at("tx0", "x", 0), at("ty0", "y", 0), at("tx1", "x", 1), at("ty1", "y", 1)]
        number = F.col("class_id").cast("string")
        named = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in self.names.items() for v in kv]), F.col("class_id").cast("int")), number) if self.names else number
        area = (F.col("filled") * (self.scale * self.scale)).alias("area")
        rows = whole.select("slide_id", "tile_id", "instance", area, *bounds, "cx", "cy", named.alias("class"), "prob", "parts", "vec")
        rows = rows.where(F.col("area").between(*self.size)) if self.size else rows
        return rows.where(F.col("class").isNull() | ~F.col("class").isin(*self.dropped)) if self.dropped else rows

    def run(self, images: DataFrame, tissues: DataFrame | None = None, tiles: DataFrame | None = None) -> DataFrame:
        found = written(self.instances(images, tiles))
        if tissues is not None:
            found = found.join(cells.first_tissue_of_parts(found, tissues, ("slide_id", "tile_id", "instance")), ["slide_id", "tile_id", "instance"])
        ordered = written(numbered(found))
        kept = cells.nms_parts(ordered, self.iou_threshold)
        if not self.features:
            return kept.drop("vec")
        return kept if ordered.where("vec is not null").isEmpty() else kept.where("vec is not null")


def numbered(found: DataFrame, block: int = 4096) -> DataFrame:
    """``cell_id``: a running number of a slide's rows by tile and place, from 0.

    Rows are counted by blocks of tiles, and numbered within a block from what stands before it.
    """
    order = ["tile_id", "y0", "x0", "y1", "x1", *[c for c in ("instance",) if c in found.columns]]
    dealt = found.withColumn("_block", F.expr(f"tile_id div {block}"))
    sizes = dealt.groupBy("slide_id", "_block").agg(F.count("*").alias("n"))
    starts = chunk_offsets(sizes, "_block").select("slide_id", "_block", "offset")
    place = F.row_number().over(Window.partitionBy("slide_id", "_block").orderBy(*order)) - 1
    return dealt.withColumn("_place", place).join(starts, ["slide_id", "_block"]).withColumn("cell_id", F.col("offset") + F.col("_place")).drop("_block", "_place", "offset")


def chunk_offsets(sizes: DataFrame, order: str) -> DataFrame:
    """``offset``: how many rows stand before each chunk of its slide; ``n`` is the chunk's own."""
    before = Window.partitionBy("slide_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))


def select_features(features: DataFrame, ids: DataFrame, key: str = "cell_id") -> DataFrame:
    """Of the wanted ids, those that have a vector, with it; and the others with null: ``found`` tells."""
    keys = [c for c in ("slide_id", key) if c in ids.columns and c in features.columns]
    return ids.select(*keys).distinct().join(features.select(*keys, "vec"), keys, "left").withColumn("found", F.col("vec").isNotNull())


def tiles_at(places: DataFrame, tiles: DataFrame) -> DataFrame:
    """``slide_id, x, y, tile_id`` of places that are the corner of a tile, by equality."""
    corners = tiles.select("slide_id", F.col("x0").alias("x"), F.col("y0").alias("y"), "tile_id")
    return places.join(corners, ["slide_id", "x", "y"])


def prompt_mask(tiles: DataFrame, width: int, height: int, step: int, blur: int = 7, sigma: float = 5.0) -> DataFrame:
    """``image_id, y, x, v``: tiles drawn on a canvas of cells of side ``step``, made smooth.

    A Gaussian blur, of which values of one half and more stay, an opening and a closing.
    """
    image = tiles.select(F.col("slide_id").alias("image_id")).distinct()
    span = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    canvas = image.withColumn("y", span(height)).withColumn("x", span(width))
    drawn = masks.draw(tiles.withColumn("_on", F.lit(1)), step, "_on").select(F.col("slide_id").alias("image_id"), "y", "x", F.lit(1).alias("on"))
    filled = canvas.join(drawn, ["image_id", "y", "x"], "left").select("image_id", "y", "x", F.coalesce("on", F.lit(0)).cast("long").alias("v"))
    soft = transforms.gaussian_blur(cut(filled), blur, sigma) if blur > 1 else filled
    hard = soft.select("image_id", "y", "x", (F.col("v") >= 0.5).cast("long").alias("v"))
    return raster.morph_close(raster.morph_open(hard, blur), blur) if blur > 1 else hard


def zero_shot_regions(tiles: DataFrame, scores: DataFrame, rule: str | float | Sequence[float], step: int, width: int, height: int, least_area: float = 0, blur: int = 1) -> DataFrame:
    """Polygons of the tiles whose score of a prompt exceeds its threshold.

    ``scores`` has ``slide_id, tile_id, prompt, v``. Returns ``slide_id, prompt, ring, holes,
    area`` and bounds, in level-0 pixels.
    """
    limits = thresholds(scores.select("prompt", "v"), rule)
    over = scores.join(F.broadcast(limits), "prompt").where("v > threshold").select("slide_id", "tile_id", "prompt")
    picked = over.join(tiles, ["slide_id", "tile_id"]).withColumn("slide_id", F.to_json(F.struct("slide_id", "prompt")))
    found = polygons.mask_polygons(prompt_mask(picked.select("slide_id", "x0", "y0", "x1", "y1"), width, height, step, blur), least_area=least_area)
    grown = lambda c: F.transform(c, lambda p: F.struct((p["x"] * step).alias("x"), (p["y"] * step).alias("y")))
    place = [(F.col(c) * step).alias(c) for c in ("x0", "y0", "x1", "y1")]
    found = found.withColumn("of", F.from_json("image_id", "slide_id long, prompt string"))
    return found.select("of.slide_id", "of.prompt", grown("ring").alias("ring"), F.transform("holes", grown).alias("holes"), (F.col("area") * step * step).alias("area"), *place)


def prompts_in(points: DataFrame, regions: DataFrame) -> DataFrame:
    """``region_id, positive, negative``: how many prompt points of each kind a region holds.

    ``points`` has ``slide_id, x, y`` and ``positive``; ``regions`` ``slide_id, region_id``, a
    ``ring``, ``holes`` and bounds. Regions without a point are left out.
    """
    met = polygons.points_in_polygons(points, regions)
    count = lambda yes: F.count(F.when(F.col("positive") == yes, 1))
    return met.groupBy("slide_id", F.col("r_region_id").alias("region_id")).agg(count(True).alias("positive"), count(False).alias("negative"))


def within_tissue(found: DataFrame, tissues: DataFrame, tissue_id: int) -> DataFrame:
    """Rows whose box meets the boxes of one tissue."""
    return spatial_join(found, tissues.where(F.col("tissue_id") == tissue_id), 1024, how="left_semi")
