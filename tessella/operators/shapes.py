"""Shape descriptors of tissues, dissolved regions and domains."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.boxes import ring_area, ring_centroid, ring_length, ring_moments
from tessella.functions.rings import clipped_area, hull_area
from tessella.operators.cells import tile_neighbours
from tessella.plans.components import slide_components
from tessella.plans.spatial_join import spatial_join


def tissue_props(df: DataFrame, ring: str = "ring", holes: str | None = None) -> DataFrame:
    """Descriptors of every ring: area, perimeter, bounds, centroid, extent, circularity. The area
    is without ``holes``, if that column is named; what else there is is of the ring alone."""
    a, p = ring_area(F.col(ring)), ring_length(F.col(ring))
    if holes:
        a = a - F.aggregate(holes, F.lit(0.0), lambda n, h: n + ring_area(h))
    cx, cy = ring_centroid(F.col(ring))
    side = lambda f, c: f(F.transform(ring, lambda q: q[c]))
    rows = df.withColumns({"area": a, "perimeter": p, "centroid_x": cx, "centroid_y": cy, "bx0": side(F.array_min, "x"), "by0": side(F.array_min, "y"), "bx1": side(F.array_max, "x"), "by1": side(F.array_max, "y")})
    box_area = (F.col("bx1") - F.col("bx0")) * (F.col("by1") - F.col("by0"))
    return rows.withColumns({"extent": F.col("area") / F.nullif(box_area, F.lit(0.0)), "circularity": 4 * 3.141592653589793 * F.col("area") / F.nullif(F.col("perimeter") * F.col("perimeter"), F.lit(0.0))})


def dissolve(tiles: DataFrame, by: str, cell: int = 256) -> DataFrame:
    """Touching tiles of one ``by`` as one region: ``slide_id, by, region, n_tiles, area`` and bounds.

    ``region`` is the smallest tile of it, in its slide. Tiles of a grid don't overlap, so areas add up.
    """
    label = tiles.select("slide_id", "tile_id", by)
    other = label.withColumnsRenamed({"tile_id": "neighbour", by: "other"})
    pairs = tile_neighbours(tiles, cell).join(label, ["slide_id", "tile_id"]).join(other, ["slide_id", "neighbour"]).where(F.col(by) == F.col("other"))
    parts = slide_components(pairs, "tile_id", "neighbour", "tile_id")
    rows = tiles.join(parts, ["slide_id", "tile_id"], "left").withColumn("region", F.coalesce("component", "tile_id"))
    size = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return rows.groupBy("slide_id", by, "region").agg(F.count("*").alias("n_tiles"), F.sum(size).alias("area"), *_bounds())


def _bounds() -> list[Column]:
    return [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]


def _reduced(features: DataFrame, keys: list[str], components: int) -> DataFrame:
    """``keys, pca``: scaled vectors' principal components."""
    rows = features.select(*keys, array_to_vector("vec").alias("raw"))
    scaled = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True).fit(rows).transform(rows)
    return PCA(k=components, inputCol="scaled", outputCol="pca").fit(scaled).transform(scaled).select(*keys, "pca")


def spatial_domain(features: DataFrame, k: int = 8, components: int = 16, seed: int = 7) -> DataFrame:
    """``tile_id, domain``: scaled vectors, principal components, seeded k-means."""
    reduced = _reduced(features, ["tile_id"], components)
    return KMeans(k=k, seed=seed, featuresCol="pca", predictionCol="domain").fit(reduced).transform(reduced).select("tile_id", "domain")


def bounds_of(df: DataFrame, *by: str) -> DataFrame:
    """Bounds of all boxes of a group."""
    return df.groupBy(*by).agg(*_bounds())


def ellipse_props(df: DataFrame, ring: str = "ring") -> DataFrame:
    """Axes, eccentricity and orientation of the ellipse of the same second moments, and the
    hull's area with solidity and convexity."""
    m = ring_moments(F.col(ring))
    rows = df.withColumns({k: m[k] for k in ("m00", "m10", "m01", "m20", "m02", "m11")})
    a = F.nullif(F.col("m00"), F.lit(0.0))
    u20 = F.col("m20") / a - F.pow(F.col("m10") / a, 2)
    u02 = F.col("m02") / a - F.pow(F.col("m01") / a, 2)
    u11 = F.col("m11") / a - F.col("m10") * F.col("m01") / (a * a)
    rows = rows.withColumns({"u20": u20, "u02": u02, "u11": u11})
    root = F.sqrt(4 * F.col("u11") * F.col("u11") + (F.col("u20") - F.col("u02")) * (F.col("u20") - F.col("u02")))
    total = F.col("u20") + F.col("u02")
    rows = rows.withColumns({"major_axis": 4 * F.sqrt((total + root) / 2), "minor_axis": 4 * F.sqrt(F.greatest((total - root) / 2, F.lit(0.0))), "orientation": 0.5 * F.atan2(2 * F.col("u11"), F.col("u20") - F.col("u02"))})
    rows = rows.withColumn("eccentricity", F.sqrt(F.greatest(1 - F.pow(F.col("minor_axis") / F.nullif(F.col("major_axis"), F.lit(0.0)), 2), F.lit(0.0))))
    rows = rows.withColumn("convex_area", hull_area(F.col(ring)))
    return rows.withColumns({"solidity": F.col("m00") / F.nullif(F.col("convex_area"), F.lit(0.0)), "convexity": F.col("convex_area") / a}).drop("u20", "u02", "u11")


def hu_moments(df: DataFrame, ring: str = "ring") -> DataFrame:
    """``hu1`` to ``hu7``: invariants of a ring's shape under moves, turns and scaling."""
    rows = df.withColumns({f"_{k}": v for k, v in ring_moments(F.col(ring)).items()})
    m = lambda k: F.col(f"_m{k}")
    a = F.nullif(m("00"), F.lit(0.0))
    cx, cy = m("10") / a, m("01") / a
    central = {
        "20": m("20") - cx * m("10"), "02": m("02") - cy * m("01"), "11": m("11") - cx * m("01"),
        "30": m("30") - 3 * cx * m("20") + 2 * cx * cx * m("10"), "03": m("03") - 3 * cy * m("02") + 2 * cy * cy * m("01"),
        "21": m("21") - 2 * cx * m("11") - cy * m("20") + 2 * cx * cx * m("01"), "12": m("12") - 2 * cy * m("11") - cx * m("02") + 2 * cy * cy * m("10"),
    }
    rows = rows.withColumns({f"_n{k}": v / F.pow(a, 1 + (int(k[0]) + int(k[1])) / 2) for k, v in central.items()})
    n20, n02, n11, n30, n03, n21, n12 = (F.col(f"_n{k}") for k in central)
    p, q = n30 + n12, n21 + n03
    s, t = n30 - 3 * n12, 3 * n21 - n03
    hu = [
        n20 + n02,
        (n20 - n02) * (n20 - n02) + 4 * n11 * n11,
        s * s + t * t,
        p * p + q * q,
        s * p * (p * p - 3 * q * q) + t * q * (3 * p * p - q * q),
        (n20 - n02) * (p * p - q * q) + 4 * n11 * p * q,
        t * p * (p * p - 3 * q * q) - s * q * (3 * p * p - q * q),
    ]
    return rows.select(*df.columns, *[h.alias(f"hu{i + 1}") for i, h in enumerate(hu)])


def polygon_coverage(tiles: DataFrame, polygons: DataFrame, cell: int = 512) -> DataFrame:
    """``slide_id, tile_id, tissue_id, coverage`` of tiles that meet a polygon's bounds.

    ``polygons`` has a ``ring`` and its bounds. Only tiles that meet the bounds are clipped.
    """
    pairs = spatial_join(tiles.select("slide_id", "tile_id", "x0", "y0", "x1", "y1"), polygons.select("slide_id", "tissue_id", "x0", "y0", "x1", "y1", "ring"), cell, touch=False)
    share = clipped_area("r_ring", "x0", "y0", "x1", "y1") / ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).cast("double")
    return pairs.select("slide_id", "tile_id", F.col("r_tissue_id").alias("tissue_id"), share.alias("coverage")).where("coverage > 0")


def dissolve_near(boxes: DataFrame, by: str, tolerance: int, cell: int = 128, id_col: str = "cell_id", prob_col: str = "prob") -> DataFrame:
    """Boxes of one class that are at most twice ``tolerance`` apart as one region: ``slide_id, by,
    region, n, prob`` (the highest) and bounds."""
    wide = boxes.select("slide_id", by, F.col(id_col).alias("id"), *[(F.col(c) - tolerance).alias(c) for c in ("x0", "y0")], *[(F.col(c) + tolerance).alias(c) for c in ("x1", "y1")])
    pairs = spatial_join(wide, wide, cell).where((F.col("id") < F.col("r_id")) & (F.col(by) == F.col(f"r_{by}")))
    parts = slide_components(pairs, "id", "r_id", id_col)
    rows = boxes.join(parts, ["slide_id", id_col], "left").withColumn("region", F.coalesce("component", F.col(id_col)))
    return rows.groupBy("slide_id", by, "region").agg(F.count("*").alias("n"), F.max(prob_col).alias("prob"), *_bounds())
