"""Registered queries on images, masks, polygons, segmentation runs, palettes and models, each
beside the SQL that DuckDB answers alike. Doubles are rounded to six decimals on both sides."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.boxes import box, ring_area, ring_of
from tessella.operators import aggregate, annotations, cells, graph, instances, models, palette, polygons, segmentation, shapes, transforms, viewport
from tessella.operators.similarity import text_image_similarity
from tessella.queries import Query, r6
from tessella.sources import adapters, images
from tessella.sources.adapters import with_relations

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# --- scans of images -------------------------------------------------------------------------

_LEVELS = """, l1 AS (SELECT image_id, y // 2 AS y, x // 2 AS x, CAST(floor(avg(v)) AS BIGINT) AS v FROM mosaic GROUP BY ALL),
  l2 AS (SELECT image_id, y // 2 AS y, x // 2 AS x, CAST(floor(avg(v)) AS BIGINT) AS v FROM l1 GROUP BY ALL)"""


def _chunks(spark: SparkSession, sf: str, levels: int) -> DataFrame:
    return images.pyramid(adapters.mosaic(spark, sf), levels)


@query("image_levels", with_relations("mosaic", """SELECT image_id, level, (max(y) >> level) + 1 AS height, (max(x) >> level) + 1 AS width, 1::BIGINT << level AS downsample
  FROM mosaic, (SELECT unnest(range(3))::INTEGER AS level) GROUP BY image_id, level"""))
def image_levels(spark: SparkSession, sf: str) -> DataFrame:
    return images.level_table(_chunks(spark, sf, 3))


@query("level_image", with_relations("mosaic", _LEVELS + " SELECT image_id, y, x, v FROM l2"))
def level_image(spark: SparkSession, sf: str) -> DataFrame:
    return images.level_image(_chunks(spark, sf, 3), 2)


@query("image_region", with_relations("mosaic", _LEVELS + " SELECT image_id, y - 15 AS y, x - 20 AS x, v FROM l1 WHERE y BETWEEN 15 AND 54 AND x BETWEEN 20 AND 69"))
def image_region(spark: SparkSession, sf: str) -> DataFrame:
    return images.region(_chunks(spark, sf, 2), 40, 30, 50, 40, 1)


#: Tiles on the mosaic: twelve pixels wide, eight apart, so that they overlap and leave the image.
_BOXES = ", boxes AS (SELECT slide_id, tile_id, x0 // 32 + 3 AS x0, y0 // 32 + 3 AS y0 FROM tiles)"


def _boxes(spark: SparkSession, sf: str) -> DataFrame:
    rows = adapters.tiles(spark, sf).selectExpr("slide_id", "tile_id", "x0 div 32 + 3 as x0", "y0 div 32 + 3 as y0")
    return rows.withColumns({"x1": F.col("x0") + 12, "y1": F.col("y0") + 12})


@query("tile_images", with_relations("mosaic tiles", _BOXES + """ SELECT slide_id, tile_id, i * 6 + j AS at, coalesce(v, 0)::DOUBLE AS v
  FROM boxes, range(6) r(i), range(6) s(j) LEFT JOIN mosaic m ON m.image_id = slide_id AND m.y = y0 + 2 * i + 1 AND m.x = x0 + 2 * j + 1"""))
def tile_images(spark: SparkSession, sf: str) -> DataFrame:
    found = images.tile_images(_chunks(spark, sf, 1), _boxes(spark, sf), 6)
    return found.select("slide_id", "tile_id", F.posexplode("vec").alias("at", "v")).withColumn("at", F.col("at").cast("long"))


@query("tissue_images", with_relations("mosaic tissues", """SELECT slide_id, tissue_id, 1::BIGINT AS downsample, y - y0 // 60 AS y, x - x0 // 60 AS x, v
  FROM tissues JOIN mosaic ON image_id = slide_id AND y >= y0 // 60 AND y < y1 // 60 AND x >= x0 // 60 AND x < x1 // 60"""))
def tissue_images(spark: SparkSession, sf: str) -> DataFrame:
    small = adapters.tissues(spark, sf).selectExpr("slide_id", "tissue_id", "x0 div 60 as x0", "y0 div 60 as y0", "x1 div 60 as x1", "y1 div 60 as y1")
    return images.tissue_images(_chunks(spark, sf, 1), small)


# --- masks and polygons ----------------------------------------------------------------------


def _mask(spark: SparkSession, sf: str, least: int = 128) -> DataFrame:
    return adapters.pixels(spark, sf).withColumn("v", (F.col("v") >= least).cast("long"))


_PARTS = """, m AS (SELECT image_id, y, x, y * 8 + x AS p, v FROM pixels WHERE {where}),
  e AS (SELECT a.image_id, a.p AS a, b.p AS b FROM m a JOIN m b ON a.image_id = b.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 {also}),
  l0 AS (SELECT image_id, p, p AS root FROM m)""" + "".join(
    f", l{i + 1} AS (SELECT e.image_id, e.a AS p, min(l.root) AS root FROM e JOIN l{i} l ON l.image_id = e.image_id AND l.p = e.b GROUP BY ALL)" for i in range(32)
)
_SHAPES = """count(*)::DOUBLE AS area, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM l32 JOIN m USING (image_id, p) GROUP BY ALL"""


@query("mask_polygons", with_relations("pixels", _PARTS.format(where="v >= 128", also="") + f" SELECT image_id, root // 8 * 4294967296 + root % 8 AS component, {_SHAPES}"))
def mask_polygons(spark: SparkSession, sf: str) -> DataFrame:
    return polygons.mask_polygons(_mask(spark, sf)).drop("ring", "holes")


@query("mask_euler", with_relations("pixels", """, corners AS (SELECT image_id, y + a AS qy, x + b AS qx, y, x FROM pixels, range(2) r(a), range(2) s(b) WHERE v >= 128),
  quads AS (SELECT image_id, count(*) AS n, count(DISTINCT y) AS h, count(DISTINCT x) AS w FROM corners GROUP BY image_id, qy, qx)
  SELECT image_id, (count(*) FILTER (WHERE n = 1) - count(*) FILTER (WHERE n = 3) - 2 * count(*) FILTER (WHERE n = 2 AND h = 2 AND w = 2)) // 4 AS euler FROM quads GROUP BY image_id"""))
def mask_euler(spark: SparkSession, sf: str) -> DataFrame:
    """Polygons less holes of each image, which counting corners of pixels gives as well."""
    found = polygons.mask_polygons(_mask(spark, sf))
    return found.groupBy("image_id").agg((F.count("*") - F.sum(F.size("holes"))).alias("euler"))


@query("class_polygons", with_relations("pixels", _PARTS.format(where="v >= 64", also="AND a.v // 64 = b.v // 64") + f""" SELECT image_id, v // 64 AS class_id,
  CASE v // 64 WHEN 1 THEN 'stroma' WHEN 2 THEN 'tumour' ELSE '3' END AS class, root // 8 * 4294967296 + root % 8 AS component, {_SHAPES}"""))
def class_polygons(spark: SparkSession, sf: str) -> DataFrame:
    mask = adapters.pixels(spark, sf).withColumn("v", F.expr("v div 64"))
    return polygons.class_polygons(mask, {1: "stroma", 2: "tumour"}).drop("ring", "holes")


@query("instance_polygons", with_relations("pixels", "SELECT image_id, v // 32 AS instance, count(*)::DOUBLE AS area FROM pixels WHERE v >= 32 GROUP BY ALL"))
def instance_polygons(spark: SparkSession, sf: str) -> DataFrame:
    found = polygons.instance_polygons(adapters.pixels(spark, sf).withColumn("v", F.expr("v div 32")))
    return found.groupBy("image_id", "instance").agg(F.sum("area").alias("area"))


@query("foreground_detection", with_relations("pixels", _PARTS.format(where="v >= 128", also="") + f" SELECT * FROM (SELECT image_id, root // 8 * 4294967296 + root % 8 AS component, {_SHAPES}) WHERE area >= 6.4"))
def foreground_detection(spark: SparkSession, sf: str) -> DataFrame:
    """Components of a tenth of the image at least; no hole is filled."""
    return transforms.ForegroundDetection(0.1, 0)(_mask(spark, sf)).drop("ring", "holes")


_IN_BOX = "x >= x0 AND x < x1 AND y >= y0 AND y < y1"


@query("prompts_in_polygons", with_relations("cells tissues", f"""SELECT c.slide_id, tissue_id AS region_id, count(*) FILTER (WHERE positive) AS positive, count(*) FILTER (WHERE NOT positive) AS negative
  FROM (SELECT slide_id, x0 AS x, y0 AS y, prob > 0.5 AS positive FROM cells) c JOIN tissues t ON c.slide_id = t.slide_id AND {_IN_BOX} GROUP BY ALL"""))
def prompts_in_polygons(spark: SparkSession, sf: str) -> DataFrame:
    points = adapters.cells(spark, sf).select("slide_id", F.col("x0").alias("x"), F.col("y0").alias("y"), (F.col("prob") > 0.5).alias("positive"))
    regions = adapters.tissues(spark, sf).withColumnRenamed("tissue_id", "region_id").withColumn("ring", ring_of(box()))
    return segmentation.prompts_in(points, regions.withColumn("holes", F.array().cast("array<array<struct<x:double,y:double>>>")))


@query("valid_rings", with_relations("cells", "SELECT cell_id, (x1 - x0 - 30) * (y1 - y0)::DOUBLE AS area FROM cells WHERE x1 - x0 <> 30"))
def valid_rings(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes made narrower by thirty pixels: those without any width left are dropped."""
    rows = adapters.cells(spark, sf).withColumn("x1", F.col("x1") - 30).withColumn("ring", ring_of(box()))
    return polygons.valid_rings(rows).select("cell_id", ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).cast("double").alias("area"))


@query("valid_boxes", with_relations("cells", "SELECT cell_id FROM cells WHERE x1 - x0 > 30"))
def valid_boxes(spark: SparkSession, sf: str) -> DataFrame:
    return polygons.valid_boxes(adapters.cells(spark, sf).withColumn("x1", F.col("x1") - 30)).select("cell_id")


@query("explode_parts", with_relations("tissues", "SELECT tissue_id, part::INTEGER AS part, round((x1 - x0 + part) * (y1 - y0)::DOUBLE, 6) AS area FROM tissues, range(2) r(part)"))
def explode_parts(spark: SparkSession, sf: str) -> DataFrame:
    wide = (F.col("x0"), F.col("y0"), F.col("x1") + 1, F.col("y1"))
    part = lambda b: F.struct(ring_of(b).alias("ring"), F.array().cast("array<array<struct<x:double,y:double>>>").alias("holes"))
    rows = adapters.tissues(spark, sf).withColumn("parts", F.array(part(box()), part(wide)))
    return polygons.exploded(rows).select("tissue_id", "part", ring_area(F.col("ring")).alias("area"))


@query("load_annotations", with_relations("tissues tiles", """, a AS (SELECT tissue_id, x0 + 50 AS x0, y0 + 70 AS y0, x1 + 50 AS x1, y1 + 70 AS y1, tissue_id % 5 AS grade FROM tissues WHERE slide_id = 0 AND (x1 - x0) * (y1 - y0) > 300000)
  SELECT a.tissue_id, a.grade AS details_grade, t.tile_id AS r_tile_id FROM a LEFT JOIN tiles t ON t.slide_id = 0 AND a.x0 <= t.x1 AND t.x0 <= a.x1 AND a.y0 <= t.y1 AND t.y0 <= a.y1"""))
def load_annotations(spark: SparkSession, sf: str) -> DataFrame:
    rows = adapters.tissues(spark, sf).where("slide_id = 0").withColumns({"ring": ring_of(box()), "kind": F.lit("Polygon"), "details": F.to_json(F.struct((F.col("tissue_id") % 5).alias("grade")))})
    found = annotations.load_annotations(
        spark, rows.select("tissue_id", "kind", "ring", "details"), in_bounds=(50, 70), min_area=300_000, json_flatten={"details": {"grade": "bigint"}}, join_with=[adapters.tiles(spark, sf)],
    )
    return found.select("tissue_id", "details_grade", "r_tile_id")


@query("export_annotations", with_relations("tissues", """SELECT '{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[' || x0 || '.0,' || y0 || '.0],[' || x1 || '.0,' || y0 || '.0],[' || x1 || '.0,' || y1 || '.0],[' || x0 || '.0,' || y1 || '.0],[' || x0 || '.0,' || y0 || '.0]]]},"properties":{"slide_id":' || slide_id || ',"tissue_id":' || tissue_id || '}}' AS value FROM tissues"""))
def export_annotations(spark: SparkSession, sf: str) -> DataFrame:
    return annotations.export_annotations(adapters.tissues(spark, sf))


# --- colours, blurs, thresholds --------------------------------------------------------------

_INVERSE = np.linalg.inv(np.array(transforms.STAINS))
_LOGS = [f"ln(greatest({c} / 255.0::DOUBLE, 1e-6::DOUBLE)) / ln(1e-6::DOUBLE)" for c in "rgb"]
_HED = [" + ".join(f"{x} * {float(_INVERSE[i, k])!r}::DOUBLE" for i, x in enumerate(_LOGS)) for k in range(3)]


@query("colour_channels", with_relations("colours", f"""SELECT image_id, y, x, CAST(round(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b) AS BIGINT) AS grey,
  CAST(coalesce(round((greatest(r, g, b) - least(r, g, b)) * 255 / nullif(greatest(r, g, b), 0)::DOUBLE), 0) AS BIGINT) AS saturation,
  {", ".join(f"round(greatest({v}, 0), 6) AS {n}" for n, v in zip("hed", _HED))} FROM colours"""))
def colour_channels(spark: SparkSession, sf: str) -> DataFrame:
    c = [F.col(x) for x in "rgb"]
    stains = [F.round(v, 6).alias(n) for n, v in zip("hed", transforms.hed(*c))]
    return adapters.colours(spark, sf).select("image_id", "y", "x", transforms.grey(*c).alias("grey"), transforms.saturation(*c).alias("saturation"), *stains)


@query("gaussian_blur", with_relations("pixels", """SELECT p.image_id, p.y, p.x,
  round(sum(q.v * exp(-((p.y - q.y) * (p.y - q.y) + (p.x - q.x) * (p.x - q.x)) / 2.0::DOUBLE)) / sum(exp(-((p.y - q.y) * (p.y - q.y) + (p.x - q.x) * (p.x - q.x)) / 2.0::DOUBLE)), 6) AS v
  FROM pixels p JOIN pixels q ON p.image_id = q.image_id AND abs(p.y - q.y) <= 2 AND abs(p.x - q.x) <= 2 GROUP BY ALL"""))
def gaussian_blur(spark: SparkSession, sf: str) -> DataFrame:
    return transforms.GaussianBlur(5, 1.0)(adapters.pixels(spark, sf)).withColumn("v", r6("v"))


@query("local_entropy", with_relations("pixels", """, c AS (SELECT p.image_id, p.y, p.x, q.v // 64 AS v, count(*)::DOUBLE AS c FROM pixels p JOIN pixels q
  ON p.image_id = q.image_id AND (p.y - q.y) * (p.y - q.y) + (p.x - q.x) * (p.x - q.x) <= 4 GROUP BY ALL)
  SELECT image_id, y, x, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) AS v FROM c GROUP BY ALL"""))
def local_entropy(spark: SparkSession, sf: str) -> DataFrame:
    return transforms.local_entropy(adapters.pixels(spark, sf).withColumn("v", F.expr("v div 64")), 2).withColumn("v", F.round("v", 6))


@query("fixed_threshold", with_relations("colours", (
    "SELECT image_id, sum(CAST(round(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b) > 128 AS BIGINT))::BIGINT AS n FROM colours"
    " GROUP BY image_id"
)))
def fixed_threshold(spark: SparkSession, sf: str) -> DataFrame:
    chain = transforms.Compose((transforms.Channel("grey"), transforms.BinaryThreshold(128)))
    return chain(adapters.colours(spark, sf)).groupBy("image_id").agg(F.sum("v").alias("n"))


@query("entropy_threshold")
def entropy_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return transforms.EntropyThreshold(2)(adapters.colours(spark, sf)).withColumn("v", F.col("v").cast("long"))


@query("tissue_detection")
def tissue_detection(spark: SparkSession, sf: str) -> DataFrame:
    found = transforms.tissue_detection(use_saturation=False, blur=3, morph=3, n_iterations=1)(adapters.colours(spark, sf))
    return found.drop("ring", "holes")


# --- segmentation runs -----------------------------------------------------------------------

_SCORES = ", scores AS (SELECT tile_id // 500 AS slide_id, tile_id, 'p' || tile_id % 3 AS prompt, sum(v) AS v FROM features GROUP BY ALL)"


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    long = aggregate.long_form(adapters.features(spark, sf), "tile_id")
    return long.groupBy(F.expr("tile_id div 500").alias("slide_id"), "tile_id", F.expr("concat('p', tile_id % 3)").alias("prompt")).agg(F.sum("v").alias("v"))


@query("threshold_list", with_relations("features", _SCORES + " SELECT prompt, count(*) AS n FROM scores WHERE v > CASE prompt WHEN 'p0' THEN 0 WHEN 'p1' THEN 0.5 ELSE -0.5 END GROUP BY prompt"))
def threshold_list(spark: SparkSession, sf: str) -> DataFrame:
    rows = _scores(spark, sf)
    return rows.join(segmentation.thresholds(rows.select("prompt", "v"), [0, 0.5, -0.5]), "prompt").where("v > threshold").groupBy("prompt").agg(F.count("*").alias("n"))


@query("threshold_otsu")
def threshold_otsu(spark: SparkSession, sf: str) -> DataFrame:
    return segmentation.thresholds(_scores(spark, sf).select("prompt", "v"), "otsu").withColumn("threshold", r6("threshold"))


@query("prompt_mask", with_relations("tiles", """SELECT image_id, y, x, CAST(bool_or(tile_id IS NOT NULL) AS BIGINT) AS v FROM (SELECT DISTINCT slide_id AS image_id FROM tiles), range(40) r(y), range(50) s(x)
  LEFT JOIN (SELECT * FROM tiles WHERE tile_id % 3 = 0) t ON t.slide_id = image_id AND x0 // 128 <= x AND (x1 - 1) // 128 >= x AND y0 // 128 <= y AND (y1 - 1) // 128 >= y GROUP BY ALL"""))
def prompt_mask(spark: SparkSession, sf: str) -> DataFrame:
    tiles = adapters.tiles(spark, sf)
    empty = tiles.select("slide_id").distinct()
    drawn = segmentation.prompt_mask(tiles.where("tile_id % 3 = 0"), 50, 40, 128, blur=1)
    return empty.select(F.col("slide_id").alias("image_id")).join(drawn, "image_id")


@query("zero_shot_regions", with_relations("features tiles", _SCORES + """ SELECT s.slide_id, prompt, (count(*) * 65536)::DOUBLE AS area FROM scores s JOIN tiles USING (tile_id)
  WHERE v > CASE prompt WHEN 'p0' THEN 0 WHEN 'p1' THEN 0.5 ELSE -0.5 END GROUP BY ALL"""))
def zero_shot_regions(spark: SparkSession, sf: str) -> DataFrame:
    found = segmentation.zero_shot_regions(adapters.tiles(spark, sf), _scores(spark, sf), [0, 0.5, -0.5], 128, 50, 40)
    return found.groupBy("slide_id", "prompt").agg(F.sum("area").alias("area"))


def _pictures(spark: SparkSession, sf: str) -> DataFrame:
    return images.tile_images(_chunks(spark, sf, 1), _boxes(spark, sf), 12)


def _two_limits(batch: np.ndarray) -> np.ndarray:
    return (batch > 128).astype(int) + (batch > 150)


@query("semantic_run", with_relations("mosaic", """SELECT image_id AS slide_id, CASE WHEN v > 150 THEN 'dark' ELSE 'light' END AS class, count(*)::DOUBLE AS area
  FROM mosaic WHERE v > 128 AND x >= 3 AND y >= 3 GROUP BY ALL"""))
def semantic_run(spark: SparkSession, sf: str) -> DataFrame:
    found = segmentation.SemanticRunner(_two_limits, 12, {1: "light", 2: "dark"}, "constant")(_pictures(spark, sf))
    return found.groupBy("slide_id", "class").agg(F.sum("area").alias("area"))


def _shares(batch: np.ndarray) -> np.ndarray:
    """Two probabilities a pixel: of background, and of brightness."""
    return np.stack([1 - batch / 255, batch / 255], axis=1)


@query("semantic_probability", with_relations("mosaic tiles", _BOXES + """ SELECT slide_id, y, x, round(avg(v / 255.0 * exp(-((y - y0 - 5.5) ** 2 + (x - x0 - 5.5) ** 2) / 4.5)), 6) AS p
  FROM boxes JOIN mosaic ON image_id = slide_id AND x >= x0 AND x < x0 + 12 AND y >= y0 AND y < y0 + 12 GROUP BY ALL HAVING max(v) > 0"""))
def semantic_probability(spark: SparkSession, sf: str) -> DataFrame:
    runner = segmentation.ProbabilityRunner(_shares, 12, {1: "bright"})
    return runner.probability(_pictures(spark, sf)).where("c = 1 and p > 0").select("slide_id", "y", "x", r6("p"))


@query("semantic_polygons")
def semantic_polygons(spark: SparkSession, sf: str) -> DataFrame:
    """Bright regions, seams and gaps of two pixels closed, that meet a tissue."""
    runner = segmentation.ProbabilityRunner(_shares, 12, {1: "bright"}, "constant", threshold=0.65)
    found = runner.run(_pictures(spark, sf), adapters.tissues(spark, sf))
    return found.select("slide_id", "class", "part", F.size("holes").alias("holes"), r6("area"), r6("prob"))


@query("artifact_classes", with_relations("mosaic", "SELECT image_id AS slide_id, 'Fold' AS class, count(*)::DOUBLE AS area FROM mosaic WHERE v > 150 AND x >= 3 AND y >= 3 GROUP BY ALL"))
def artifact_classes(spark: SparkSession, sf: str) -> DataFrame:
    found = segmentation.SemanticRunner(_two_limits, 12, {1: "Normal Tissue", 2: "Fold"}, "constant")(_pictures(spark, sf))
    return segmentation.artifacts(found).groupBy("slide_id", "class").agg(F.sum("area").alias("area"))


@query("cell_instances", with_relations("mosaic tiles", _BOXES + """, p AS (SELECT slide_id, tile_id, v // 16 AS instance, x, y, x - x0 AS px, y - y0 AS py
    FROM boxes JOIN mosaic ON image_id = slide_id AND x >= x0 AND x < x0 + 12 AND y >= y0 AND y < y0 + 12 WHERE v // 16 IN (10, 11))
  SELECT slide_id, tile_id, instance, count(*) AS area, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM p GROUP BY ALL
  HAVING min(px) > 0 AND min(py) > 0 AND max(px) < 11 AND max(py) < 11 AND count(*) BETWEEN 2 AND 40"""))
def cell_instances(spark: SparkSession, sf: str) -> DataFrame:
    runner = segmentation.CellRunner(lambda batch: batch // 16, 12, 0, (2, 40), keep=lambda m: np.array([10, 11]), holes=True)
    return runner.instances(_pictures(spark, sf)).select("slide_id", "tile_id", "instance", "area", "x0", "y0", "x1", "y1")


#: Suppression as a walk: ``item`` has slides, tissues, cells and ``prob``, ``link`` cells that overlap.
_WALK = """, linked AS (SELECT slide_id, a, b FROM link UNION ALL SELECT slide_id, b, a FROM link UNION ALL SELECT slide_id, cell_id, cell_id FROM item),
  near AS (SELECT l.slide_id, l.a AS cell_id, list({'p': i.prob, 'low': -i.cell_id}) AS near FROM linked l JOIN item i ON i.slide_id = l.slide_id AND i.cell_id = l.b GROUP BY ALL),
  walk AS (
    SELECT slide_id, tissue_id, ids[2:] AS ids, ids[1] AS here, []::BIGINT[] AS gone, NULL::BIGINT AS kept FROM (SELECT slide_id, tissue_id, list(cell_id ORDER BY cell_id) AS ids FROM item GROUP BY ALL)
    UNION ALL
    SELECT slide_id, tissue_id, CASE WHEN best = here THEN rest[2:] ELSE rest END, CASE WHEN best = here THEN rest[1] ELSE best END, list_concat(gone, lost), best
    FROM (SELECT *, list_filter(ids, lambda i: NOT list_contains(lost, i)) AS rest FROM (SELECT *, list_filter(list_transform(alive, lambda n: -n.low), lambda i: i <> best) AS lost
      FROM (SELECT *, -(list_max(alive).low) AS best FROM (SELECT w.*, list_filter(n.near, lambda m: NOT list_contains(w.gone, -m.low)) AS alive
        FROM walk w JOIN near n ON n.slide_id = w.slide_id AND n.cell_id = w.here))))),
  stay AS (SELECT DISTINCT slide_id, tissue_id, kept AS cell_id FROM walk WHERE kept IS NOT NULL)"""


def _recursive(names: str, body: str) -> str:
    return with_relations(names, body).replace("WITH ", "WITH RECURSIVE ", 1)


def _cell_model(side: int):
    """Bright pixels of each square of a tile are a cell of one of three classes, with two tokens a
    third of the tile. Probabilities are binary fractions, so their means are exact in any order."""

    def run(batch: np.ndarray) -> instances.CellMaps:
        n, edge, _ = batch.shape
        square = np.arange(edge) // side
        labels = np.where(batch > 128, square[:, None] * (edge // side) + square + 1, 0)
        classes = np.stack([np.full(batch.shape, 11 / 16), batch / 256, batch * 7 % 256 / 256], axis=1)
        return instances.CellMaps(labels, classes, np.stack([batch[:, 1::4, 1::4], batch[:, 2::4, 1::4]], axis=1))

    return run


_CELL_NAMES = {0: "Background", 1: "bright", 2: "other"}


def _small_tissues(spark: SparkSession, sf: str) -> DataFrame:
    return adapters.tissues(spark, sf).select("slide_id", "tissue_id", *[F.expr(f"{c} div 50").alias(c) for c in ("x0", "y0", "x1", "y1")])


def _cells_sql(side: int) -> str:
    """Every pixel of a cell, and cells with their classes, in the squares of ``_cell_model``."""
    return _BOXES + f""", px AS (SELECT slide_id, tile_id, (y - y0) // {side} * {12 // side} + (x - x0) // {side} + 1 AS instance, x, y, y - y0 AS py, x - x0 AS px, v
    FROM boxes JOIN mosaic ON image_id = slide_id AND x >= x0 AND x < x0 + 12 AND y >= y0 AND y < y0 + 12 WHERE v > 128),
  cell AS (SELECT * FROM (SELECT slide_id, tile_id, instance, count(*) AS area, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1, avg(y) AS cy, avg(x) AS cx, avg(py) AS my, avg(px) AS mx,
    avg(v / 256) AS p1, avg(v * 7 % 256 / 256) AS p2 FROM px GROUP BY ALL) WHERE area BETWEEN 2 AND 40 AND greatest(p1, p2) > 0.6875)"""


@query("cell_run", _recursive("mosaic tiles tissues", _cells_sql(6) + """, home AS (SELECT c.*, t.tissue_id FROM cell c JOIN
    (SELECT p.slide_id, p.tile_id, p.instance, min(t.tissue_id) AS tissue_id FROM px p JOIN tissues t ON t.slide_id = p.slide_id
      AND p.x <= t.x1 // 50 AND p.x + 1 >= t.x0 // 50 AND p.y <= t.y1 // 50 AND p.y + 1 >= t.y0 // 50 GROUP BY ALL) t USING (slide_id, tile_id, instance)),
  item AS (SELECT *, greatest(p1, p2) AS prob, row_number() OVER (PARTITION BY slide_id ORDER BY tile_id, y0, x0, y1, x1, instance) - 1 AS cell_id FROM home),
  own AS (SELECT p.slide_id, x, y, cell_id, tissue_id, area FROM px p JOIN item USING (slide_id, tile_id, instance)),
  link AS (SELECT a.slide_id, a.cell_id AS a, b.cell_id AS b FROM own a JOIN own b USING (slide_id, tissue_id, x, y) WHERE a.cell_id < b.cell_id
    GROUP BY ALL HAVING count(*)::DOUBLE / (min(a.area) + min(b.area) - count(*)) > 0.2)""" + _WALK + """
  SELECT slide_id, tissue_id, cell_id, tile_id, instance, area, x0, y0, x1, y1, CASE WHEN p1 >= p2 THEN 'bright' ELSE 'other' END AS class, round(prob, 6) AS prob FROM item JOIN stay USING (slide_id, tissue_id, cell_id)"""))
def cell_run(spark: SparkSession, sf: str) -> DataFrame:
    """Tiles overlap, and all have the cells at their edges: suppression by outlines decides."""
    runner = segmentation.CellRunner(_cell_model(6), 12, -1, (2, 40), names=_CELL_NAMES, holes=True)
    found = runner.run(_pictures(spark, sf), _small_tissues(spark, sf))
    return found.select("slide_id", "tissue_id", "cell_id", "tile_id", "instance", "area", "x0", "y0", "x1", "y1", "class", r6("prob"))


@query("cell_features", with_relations("mosaic tiles", _cells_sql(4) + """, own AS (SELECT c.* FROM cell c JOIN boxes o ON o.slide_id = c.slide_id AND cx BETWEEN o.x0 AND o.x0 + 12 AND cy BETWEEN o.y0 AND o.y0 + 12
    GROUP BY ALL HAVING arg_min(o.tile_id, {'d': (cx - o.x0 - 6) ** 2 + (cy - o.y0 - 6) ** 2, 't': o.tile_id}) = c.tile_id),
  token AS (SELECT b.slide_id, tile_id, i, j, dim, coalesce(m.v, 0) AS v FROM boxes b, range(3) r(i), range(3) s(j), range(2) d(dim)
    LEFT JOIN mosaic m ON m.image_id = b.slide_id AND m.y = y0 + 4 * i + 1 + dim AND m.x = x0 + 4 * j + 1),
  hit AS (SELECT slide_id, tile_id, instance, dim, avg(t.v) AS v FROM px p JOIN token t USING (slide_id, tile_id) WHERE p.py = [0, 6, 11][t.i + 1] AND p.px = [0, 6, 11][t.j + 1] GROUP BY ALL)
  SELECT slide_id, tile_id, instance, class, area, dim, round(coalesce(h.v, t.v), 6) AS v FROM (SELECT slide_id, tile_id, instance, area, my, mx, CASE WHEN p1 >= p2 THEN 'bright' ELSE 'other' END AS class FROM own) c
  JOIN token t USING (slide_id, tile_id) LEFT JOIN hit h USING (slide_id, tile_id, instance, dim) WHERE t.i = least(floor(my * 3 / 12), 2) AND t.j = least(floor(mx * 3 / 12), 2)"""))
def cell_features(spark: SparkSession, sf: str) -> DataFrame:
    """Each cell of several tiles is kept by the one that owns it, with the mean of its tokens."""
    runner = segmentation.CellRunner(_cell_model(4), 12, -1, (2, 40), names=_CELL_NAMES, holes=True, features=True)
    found = runner.run(_pictures(spark, sf), tiles=_boxes(spark, sf))
    long = found.select("slide_id", "tile_id", "instance", "class", "area", F.posexplode("vec").alias("dim", "v"))
    return long.select("slide_id", "tile_id", "instance", "class", "area", F.col("dim").cast("long").alias("dim"), r6("v"))


@query("nms_by_tissue", _recursive("cells tissues", """, item AS (SELECT c.slide_id, cell_id, min(tissue_id) AS tissue_id, any_value(prob) AS prob, any_value(c.x0) AS x0, any_value(c.y0) AS y0, any_value(c.x1) AS x1, any_value(c.y1) AS y1
    FROM cells c JOIN tissues t ON c.slide_id = t.slide_id AND c.x0 <= t.x1 AND t.x0 <= c.x1 AND c.y0 <= t.y1 AND t.y0 <= c.y1 GROUP BY c.slide_id, cell_id),
  met AS (SELECT a.slide_id, a.cell_id AS a, b.cell_id AS b, (a.x1 - a.x0) * (a.y1 - a.y0) AS sa, (b.x1 - b.x0) * (b.y1 - b.y0) AS sb, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS s
    FROM item a JOIN item b ON a.slide_id = b.slide_id AND a.tissue_id = b.tissue_id AND a.cell_id < b.cell_id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1),
  link AS (SELECT slide_id, a, b FROM met WHERE s::DOUBLE / (sa + sb - s) > 0.2)""" + _WALK + " SELECT * FROM stay"))
def nms_by_tissue(spark: SparkSession, sf: str) -> DataFrame:
    found = cells.nms_by_tissue(adapters.cells(spark, sf), adapters.tissues(spark, sf))
    return found.select("slide_id", "cell_id", "tissue_id")


@query("running_cell_id", with_relations("cells", """SELECT slide_id, tile_id, y0, x0, y1, x1, row_number() OVER (PARTITION BY slide_id ORDER BY tile_id, y0, x0, y1, x1) - 1 AS cell_id
  FROM (SELECT *, cell_id % 500 AS tile_id FROM cells)"""))
def running_cell_id(spark: SparkSession, sf: str) -> DataFrame:
    rows = adapters.cells(spark, sf).withColumn("tile_id", F.expr("cell_id % 500")).drop("cell_id")
    return segmentation.numbered(rows, 16).select("slide_id", "tile_id", "y0", "x0", "y1", "x1", "cell_id")


@query("chunk_offsets", with_relations("tiles", """SELECT slide_id, tissue_id, n, CAST(coalesce(sum(n) OVER (PARTITION BY slide_id ORDER BY tissue_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
  FROM (SELECT slide_id, tissue_id, count(*) AS n FROM tiles GROUP BY ALL)"""))
def chunk_offsets(spark: SparkSession, sf: str) -> DataFrame:
    sizes = adapters.tiles(spark, sf).groupBy("slide_id", "tissue_id").agg(F.count("*").alias("n"))
    return segmentation.chunk_offsets(sizes, "tissue_id")


@query("select_features", with_relations("features", """SELECT i.tile_id, f.tile_id IS NOT NULL AS found FROM (SELECT DISTINCT tile_id * 2 AS tile_id FROM features) i
  LEFT JOIN (SELECT DISTINCT tile_id FROM features) f USING (tile_id)"""))
def select_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = adapters.features(spark, sf)
    return segmentation.select_features(rows, rows.select((F.col("tile_id") * 2).alias("tile_id")), "tile_id").select("tile_id", "found")


@query("tiles_at_places", with_relations("cells tiles", "SELECT c.cell_id, t.tile_id FROM cells c JOIN tiles t ON c.slide_id = t.slide_id AND c.x0 // 256 * 256 = t.x0 AND c.y0 // 256 * 256 = t.y0"))
def tiles_at_places(spark: SparkSession, sf: str) -> DataFrame:
    places = adapters.cells(spark, sf).selectExpr("slide_id", "cell_id", "x0 div 256 * 256 as x", "y0 div 256 * 256 as y")
    return segmentation.tiles_at(places, adapters.tiles(spark, sf)).select("cell_id", "tile_id")


@query("radius_join", with_relations("tiles", """SELECT a.slide_id, a.tile_id AS src, b.tile_id AS dst, round(sqrt(((a.x0 - b.x0) * (a.x0 - b.x0) + (a.y0 - b.y0) * (a.y0 - b.y0))::DOUBLE), 6) AS dist
  FROM tiles a JOIN tiles b ON a.slide_id = b.slide_id AND a.tile_id <> b.tile_id AND (a.x0 - b.x0) * (a.x0 - b.x0) + (a.y0 - b.y0) * (a.y0 - b.y0) <= 160000"""))
def radius_join(spark: SparkSession, sf: str) -> DataFrame:
    return graph.radius_pairs(graph.corner_points(adapters.tiles(spark, sf)), 400).withColumn("dist", r6("dist"))


@query("tissue_filter", with_relations("cells tissues", (
    "SELECT c.cell_id FROM cells c JOIN tissues t ON c.slide_id = t.slide_id AND c.x0 <= t.x1 AND t.x0 <= c.x1 AND c.y0 <= t.y1 AND t.y0 <= c.y1"
    " WHERE t.tissue_id = 1"
)))
def tissue_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = adapters.cells(spark, sf).select("slide_id", "cell_id", "x0", "y0", "x1", "y1")
    return segmentation.within_tissue(rows, adapters.tissues(spark, sf), 1).select("cell_id")


# --- suppression and matching where SQL can tell the answer -----------------------------------


@query("nms_cliques", with_relations("cells", "SELECT slide_id, arg_max(cell_id, prob) AS cell_id FROM cells GROUP BY slide_id, cell_id // 4"))
def nms_cliques(spark: SparkSession, sf: str) -> DataFrame:
    """Cells moved so that each four overlap one another and nothing else: the likeliest stays."""
    at = "cell_id div 4 % 100 * 200 + cell_id % 4 * 3", "cell_id div 400 * 200 + cell_id % 4 * 2"
    rows = adapters.cells(spark, sf).selectExpr("slide_id", "cell_id", "prob", f"{at[0]} as x0", f"{at[1]} as y0", f"{at[0]} + 60 as x1", f"{at[1]} + 60 as y1")
    return cells.nms(rows).select("slide_id", "cell_id")


_IOU = "(256 - tile_id % 4 * 20) / (256.0::DOUBLE + tile_id % 4 * 20)"


@query("tile_matching_scores", with_relations("tiles", f"""SELECT slide_id, count(*) FILTER (WHERE tile_id % 7 > 0) AS tp, 0::BIGINT AS fp, count(*) FILTER (WHERE tile_id % 7 = 0) AS fn,
  round(sum({_IOU}) FILTER (WHERE tile_id % 7 > 0) / count(*) FILTER (WHERE tile_id % 7 > 0), 6) AS mean_iou,
  round(sum({_IOU}) FILTER (WHERE tile_id % 7 > 0) / (count(*) FILTER (WHERE tile_id % 7 > 0) + count(*) FILTER (WHERE tile_id % 7 = 0) / 2.0::DOUBLE), 6) AS pq FROM tiles GROUP BY slide_id"""))
def tile_matching_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Tiles against tiles that are shifted by up to a quarter, every seventh left out."""
    gt = adapters.tiles(spark, sf).withColumnRenamed("tile_id", "id")
    moved = {c: F.col(c) + F.col("id") % 4 * 20 for c in ("x0", "x1")}
    pred = gt.where("id % 7 > 0").withColumns(moved)
    scored = cells.metrics(cells.instance_stats(gt, pred, cells.match_instances(gt, pred, 256)))
    return scored.select("slide_id", "tp", "fp", "fn", r6("mean_iou"), r6("pq"))


# --- scores over many instances --------------------------------------------------------------

_STATS = """SELECT l_suppkey AS slide_id, count(*) FILTER (WHERE l_quantity >= 25) AS tp, count(*) FILTER (WHERE l_quantity < 25) AS fp, count(*) FILTER (WHERE l_discount < 0.03) AS fn,
  count(*) FILTER (WHERE l_tax < 0.02) AS tn, sum(CASE WHEN l_quantity >= 25 THEN l_quantity / 50.0::DOUBLE ELSE 0 END) AS iou_sum FROM lineitem GROUP BY l_suppkey"""


@query("instance_scores", f"""WITH s AS ({_STATS}), r AS (SELECT *, tp / (tp + fp + 1e-8) AS p, tp / (tp + fn + 1e-8) AS r FROM s)
SELECT slide_id, round(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0)::DOUBLE, 0), 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall, round(r, 6) AS sensitivity,
  round(2 * p * r / (p + r + 1e-8), 6) AS f1_score, round(tn / (tn + fp + 1e-8), 6) AS specificity, round(2 * tp / (2 * tp + fp + fn + 1e-8), 6) AS dice,
  round(coalesce(iou_sum / nullif(tp, 0), 0), 6) AS mean_iou, round(CASE WHEN tp > 0 THEN iou_sum / (tp + fp / 2.0::DOUBLE + fn / 2.0::DOUBLE) ELSE 0 END, 6) AS pq FROM r""")
def instance_scores(spark: SparkSession, sf: str) -> DataFrame:
    """All scores, of an IoU for every row of the largest table."""
    from tessella.plans.session import table

    rows = table(spark, sf, "lineitem")
    count = lambda c, name: F.count(F.when(F.expr(c), 1)).alias(name)
    hits = F.sum(F.when(F.col("l_quantity") >= 25, F.col("l_quantity") / 50.0).otherwise(0.0)).alias("iou_sum")
    kinds = {"tp": "l_quantity >= 25", "fp": "l_quantity < 25", "fn": "l_discount < 0.03", "tn": "l_tax < 0.02"}
    stats = rows.groupBy(F.col("l_suppkey").alias("slide_id")).agg(*[count(c, n) for n, c in kinds.items()], hits)
    names = ("accuracy", "precision", "recall", "sensitivity", "f1_score", "specificity", "dice", "mean_iou", "pq")
    return cells.metrics(stats).select("slide_id", *map(r6, names))


# --- values that aren't numbers, and shapes --------------------------------------------------

_HOLED = ", holed AS (SELECT * FROM features WHERE NOT (dim % 7 = 0 AND tile_id % 5 = 0))"


def _holed(encoder: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        value = lambda v, i: F.when((i % 7 == 0) & (F.col("tile_id") % 5 == 0), F.lit(float("nan"))).otherwise(v)
        rows = adapters.features(spark, sf).withColumn("vec", F.transform("vec", value))
        return aggregate.feature_aggregation(rows, ("tissue_id",), encoder).withColumn("value", r6("value"))

    return run


for _name, _sql in {"nanmean": "avg(v)", "nanmedian": "quantile_cont(v, 0.5)", "nanptp": "max(v) - min(v)", "nanstd": "stddev_pop(v)", "nansum": "sum(v)", "nanmax": "max(v)"}.items():
    query(f"feature_agg_{_name}", with_relations("features", f"{_HOLED} SELECT tissue_id, dim, round({_sql}, 6) AS value FROM holed GROUP BY ALL"))(_holed(_name))


@query("hu_moments", with_relations("tissues", """SELECT tissue_id, round((w / h + h / w) / 12, 6) AS hu1, round((w / h - h / w) * (w / h - h / w) / 144, 6) AS hu2
  FROM (SELECT tissue_id, (x1 - x0)::DOUBLE AS w, (y1 - y0)::DOUBLE AS h FROM tissues)"""))
def hu_moments(spark: SparkSession, sf: str) -> DataFrame:
    return shapes.hu_moments(adapters.tissues(spark, sf).withColumn("ring", ring_of(box()))).select("tissue_id", r6("hu1"), r6("hu2"))


# --- projections -----------------------------------------------------------------------------


@query("column_slice", with_relations("features", "SELECT tile_id, dim, v FROM features WHERE dim BETWEEN 4 AND 11"))
def column_slice(spark: SparkSession, sf: str) -> DataFrame:
    part = adapters.features(spark, sf).withColumn("vec", F.slice("vec", 5, 8))
    return aggregate.long_form(part, "tile_id").withColumn("dim", F.col("dim") + 4)


@query("drop_columns", with_relations("cells", "SELECT slide_id, cell_id, class, value FROM cells"))
def drop_columns(spark: SparkSession, sf: str) -> DataFrame:
    return adapters.cells(spark, sf).drop("x0", "y0", "x1", "y1", "prob", "props")


@query("affine_to_level0", with_relations("tissues", "SELECT tissue_id, x0 // 4 * 4 + 10 AS x0, y0 // 4 * 4 + 20 AS y0, x1 // 4 * 4 + 10 AS x1, y1 // 4 * 4 + 20 AS y1 FROM tissues"))
def affine_to_level0(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes of a level four times smaller back at level 0, and moved to the tile's corner."""
    seen = adapters.tissues(spark, sf).selectExpr("tissue_id", "x0 div 4 * 4 as x0", "y0 div 4 * 4 as y0", "x1 div 4 * 4 as x1", "y1 div 4 * 4 as y1")
    return annotations.moved(seen, 10, 20)


@query("slice_limit", with_relations("tiles", "SELECT slide_id, tile_id FROM tiles WHERE tile_id % 500 BETWEEN 20 AND 59"))
def slice_limit(spark: SparkSession, sf: str) -> DataFrame:
    return adapters.tiles(spark, sf).where(F.expr("tile_id % 500").between(20, 59)).select("slide_id", "tile_id")


@query("id_set_semi_join", with_relations("features cells", "SELECT tile_id FROM (SELECT DISTINCT tile_id FROM features) WHERE tile_id IN (SELECT cell_id FROM cells WHERE prob > 0.5)"))
def id_set_semi_join(spark: SparkSession, sf: str) -> DataFrame:
    kept = adapters.cells(spark, sf).where("prob > 0.5").select(F.col("cell_id").alias("tile_id"))
    return adapters.features(spark, sf).select("tile_id").join(kept, "tile_id", "left_semi")


@query("stack_vectors", with_relations("features", (
    "SELECT tile_id, count(*) AS n, round(sum(v), 6) AS total FROM (SELECT tile_id, v FROM features UNION ALL SELECT tile_id, 2 * v"
    " FROM features) GROUP BY tile_id"
)))
def stack_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors beside their doubles, as one vector."""
    rows = adapters.features(spark, sf)
    double = rows.select("tile_id", F.transform("vec", lambda v: 2 * v).alias("more"))
    both = rows.join(double, "tile_id").select("tile_id", F.concat("vec", "more").alias("vec"))
    return both.select("tile_id", F.size("vec").cast("long").alias("n"), F.round(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v), 6).alias("total"))


@query("sorted_keys", with_relations("tiles", "SELECT slide_id, string_agg(DISTINCT tissue_id::VARCHAR, ',' ORDER BY tissue_id::VARCHAR) AS keys FROM tiles GROUP BY slide_id"))
def sorted_keys(spark: SparkSession, sf: str) -> DataFrame:
    return adapters.tiles(spark, sf).groupBy("slide_id").agg(F.array_join(F.array_sort(F.collect_set(F.col("tissue_id").cast("string"))), ",").alias("keys"))


# --- colours and plans of pictures -----------------------------------------------------------


def _case(pairs: dict[str, str]) -> str:
    return "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + " END"


_SEEN = "(SELECT class AS category, row_number() OVER (ORDER BY min(cell_id), class) - 1 AS place FROM cells GROUP BY class)"
_FEW = "[" + ", ".join(f"'{c}'" for c in palette.EXPORT_COLORS) + "]"


@query("palette_default", with_relations("cells", f"SELECT category, {_FEW}[place % 9 + 1] AS color FROM {_SEEN}"))
def palette_default(spark: SparkSession, sf: str) -> DataFrame:
    return palette.palette(adapters.cells(spark, sf), "class", "cell_id")


@query("palette_cycle", with_relations("cells", f"SELECT category, ['#000000', '#ff0000'][place % 2 + 1] AS color FROM {_SEEN}"))
def palette_cycle(spark: SparkSession, sf: str) -> DataFrame:
    return palette.palette(adapters.cells(spark, sf), "class", "cell_id", ["#000000", "#ff0000"])


@query("export_colors_sequence", with_relations("cells", f"""SELECT category AS class, '{{"name":"' || category || '","color":' || CASE place WHEN 0 THEN '[0,0,0]' WHEN 1 THEN '[255,0,16]' ELSE 'null' END || '}}' AS color FROM {_SEEN}"""))
def export_colors_sequence(spark: SparkSession, sf: str) -> DataFrame:
    """A list of colours isn't gone round: later classes have none."""
    return palette.class_colors(adapters.cells(spark, sf), "class", "cell_id", ["#000000", "#FF0010"])


@query("color_values", with_relations("features", "SELECT tile_id, round(v, 6) AS value FROM features WHERE dim = 7"))
def color_values(spark: SparkSession, sf: str) -> DataFrame:
    rows = adapters.features(spark, sf)
    return palette.color_values(adapters.tiles(spark, sf), "g7", rows, [f"g{i}" for i in range(64)]).withColumn("value", r6("value"))


@query("scatter_plan", with_relations("tiles", """SELECT slide_id, tile_id, (x0 + x1) / 2.0::DOUBLE AS x, (y0 + y1) / 2.0::DOUBLE AS y, round(12000.0::DOUBLE / count(*) OVER (PARTITION BY slide_id), 6) AS size
  FROM tiles WHERE x0 < 4000 AND x1 > 1000 AND y0 < 3000 AND y1 > 800"""))
def scatter_plan(spark: SparkSession, sf: str) -> DataFrame:
    return viewport.scatter_plan(adapters.tiles(spark, sf), (1000, 800, 4000, 3000)).withColumn("size", r6("size"))


@query("zoom_tiles", with_relations("tiles", "SELECT slide_id, tile_id FROM tiles WHERE x0 < 2500 AND x1 > 1750 AND y0 < 3000 AND y1 > 1900"))
def zoom_tiles(spark: SparkSession, sf: str) -> DataFrame:
    view = viewport.zoom_view((1000, 800, 4000, 3000), (0.25, 0.5), (0.5, 1.0))
    return viewport.in_view(adapters.tiles(spark, sf), view).select("slide_id", "tile_id")


@query("panel_grid", with_relations("tissues", """SELECT slide_id, tissue_id, "row", c AS col, ['area', 'class'][c + 1] AS color
  FROM (SELECT slide_id, tissue_id, row_number() OVER (PARTITION BY slide_id ORDER BY tissue_id) - 1 AS "row" FROM tissues WHERE tissue_id IN (2, 5, 7)), (SELECT unnest(range(2))::INTEGER AS c)"""))
def panel_grid(spark: SparkSession, sf: str) -> DataFrame:
    return viewport.panels(adapters.tissues(spark, sf), [2, 5, 7], ["area", "class"])


# --- models ----------------------------------------------------------------------------------


def _dense(batch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return batch.mean(1, keepdims=True), batch.reshape(len(batch), 4, 16)


@query("dense_tokens", with_relations("features", "SELECT tile_id, (dim // 16)::INTEGER AS token, round(sum(v), 6) AS total FROM features GROUP BY ALL"))
def dense_tokens(spark: SparkSession, sf: str) -> DataFrame:
    _, tokens = models.dense_features(adapters.features(spark, sf), _dense)
    return tokens.select("tile_id", "token", F.round(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v), 6).alias("total"))


@query("dense_pooled", with_relations("features", """SELECT tile_id, dim, round(v, 6) AS v FROM (SELECT tile_id, 0::BIGINT AS dim, avg(v) AS v FROM features GROUP BY tile_id
  UNION ALL SELECT tile_id, dim % 16 + 1, avg(v) FROM features GROUP BY tile_id, dim % 16)"""))
def dense_pooled(spark: SparkSession, sf: str) -> DataFrame:
    pooled, _ = models.dense_features(adapters.features(spark, sf), _dense, "cls_patch_mean")
    return aggregate.long_form(pooled, "tile_id").withColumn("v", r6("v"))


@query("tile_prediction", with_relations("features tiles", (
    "SELECT t.slide_id, t.tile_id, round(avg(v), 6) AS brightness, round(stddev_pop(v), 6) AS contrast FROM tiles t"
    " JOIN features f USING (tile_id) GROUP BY ALL"
)))
def tile_prediction(spark: SparkSession, sf: str) -> DataFrame:
    predict = lambda x: {"brightness": x.mean(1), "contrast": x.std(1)}
    found = models.tile_prediction(adapters.features(spark, sf), predict, ("brightness", "contrast"), adapters.tiles(spark, sf))
    return found.select("slide_id", "tile_id", r6("brightness"), r6("contrast"))


@query("slide_encoder", with_relations("features tiles", """SELECT slide_id, dim, round(sum(v * x0) / sum(x0), 6) AS v FROM features JOIN tiles USING (tile_id) GROUP BY ALL"""))
def slide_encoder(spark: SparkSession, sf: str) -> DataFrame:
    rows = adapters.features(spark, sf).join(adapters.tiles(spark, sf).select("slide_id", "tile_id", F.col("x0").alias("x"), F.col("y0").alias("y")), "tile_id")
    encoded = models.slide_vectors(rows, lambda f, places: (f * places[:, :1]).sum(0) / places[:, 0].sum())
    return aggregate.long_form(encoded, "slide_id").withColumn("v", r6("v"))


@query("text_embedding", with_relations("cells", "SELECT cell_id, length(class)::DOUBLE AS letters, (length(class) - length(replace(class, 'e', '')))::DOUBLE AS es FROM cells"))
def text_embedding(spark: SparkSession, sf: str) -> DataFrame:
    encode = lambda texts: [[len(t), t.count("e")] for t in texts]
    found = models.text_vectors(adapters.cells(spark, sf), encode, "cell_id", "class")
    return found.select("cell_id", F.get("vec", F.lit(0)).alias("letters"), F.get("vec", F.lit(1)).alias("es"))


@query("scorer", with_relations("features", """SELECT tissue_id, ['low', 'high'][k + 1] AS prompt, round(sum(v) * (k + 1), 6) AS p
  FROM (SELECT tissue_id, dim, avg(v) AS v FROM features GROUP BY ALL), range(2) r(k) GROUP BY tissue_id, k"""))
def scorer(spark: SparkSession, sf: str) -> DataFrame:
    grouped = aggregate.as_vectors(aggregate.feature_aggregation(adapters.features(spark, sf), ("tissue_id",)), ("tissue_id",))
    score = lambda f, prompts: f.sum(1)[:, None] * (np.arange(len(prompts)) + 1)
    return models.scores(grouped, score, ["low", "high"], ("tissue_id",)).withColumn("p", F.round("p", 6))


@query("custom_score", with_relations("features", "SELECT tile_id, k AS text_id, round(max(v) * (k + 1), 6) AS score FROM features, range(2) r(k) GROUP BY tile_id, k"))
def custom_score(spark: SparkSession, sf: str) -> DataFrame:
    texts = adapters.features(spark, sf).where("tile_id < 2").select(F.col("tile_id").alias("text_id"), F.transform("vec", lambda v, i: F.when(i == 0, F.col("tile_id") + 1.0).otherwise(0.0)).alias("vec"))
    largest = lambda a, b: a.max(1)[:, None] * b.sum(1)[None, :]
    return text_image_similarity(adapters.features(spark, sf), texts, largest, normalize=False).withColumn("score", r6("score"))
