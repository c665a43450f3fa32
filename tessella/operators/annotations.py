"""Annotations: reading, filtering, joining with shapes, flattening JSON, exporting.

A shape has a ``kind`` (Point, LineString, Polygon, or Multi of these) and ``parts``, each a
``ring`` of points and its ``holes``; lines and points are rings that aren't closed.
"""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.boxes import area, box, ring_area, ring_of
from tessella.operators.palette import class_colors
from tessella.operators.polygons import exploded
from tessella.plans.spatial_join import spatial_join

Colors = None | str | Mapping[str, str] | Sequence[str]


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """``properties`` (JSON), ``kind`` and ``parts`` of the features of a GeoJSON collection."""
    rows = spark.read.schema("features array<struct<geometry:struct<type:string,coordinates:string>,properties:string>>").json(path, multiLine=True)
    shapes = rows.select(F.explode("features").alias("f")).select(F.col("f.properties").alias("properties"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("c"))
    deep = lambda n: F.from_json("c", "array<" * n + "double" + ">" * n)
    points = lambda line: F.transform(line, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    none = F.array().cast("array<array<struct<x:double,y:double>>>")
    part = lambda ring, holes=none: F.struct(ring.alias("ring"), holes.alias("holes"))
    polygon = lambda rings: part(points(rings[0]), F.transform(F.slice(rings, F.lit(2), F.size(rings)), points))
    made = {
        "Point": F.array(part(points(F.array(deep(1))))),
        "MultiPoint": F.transform(deep(2), lambda p: part(points(F.array(p)))),
        "LineString": F.array(part(points(deep(2)))),
        "MultiLineString": F.transform(deep(3), lambda line: part(points(line))),
        "Polygon": F.array(polygon(deep(3))),
        "MultiPolygon": F.transform(deep(4), polygon),
    }
    parts = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in made.items()])
    return shapes.withColumn("parts", parts).where("parts is not null").drop("c")


def with_bounds(df: DataFrame) -> DataFrame:
    """Bounds ``x0, y0, x1, y1`` and ``is_area`` of the column ``ring``."""
    side = lambda f, c: f(F.transform("ring", lambda p: p[c]))
    sides = {"x0": side(F.array_min, "x"), "y0": side(F.array_min, "y"), "x1": side(F.array_max, "x"), "y1": side(F.array_max, "y")}
    return df.withColumns(sides).withColumn("is_area", (F.size("ring") >= 4) & (ring_area(F.col("ring")) > 0))


def load_annotations(
    spark: SparkSession,
    annotations: str | DataFrame,
    explode: bool = True,
    in_bounds: tuple[float, float] | None = None,
    join_with: Sequence[DataFrame] = (),
    json_flatten: Mapping[str, Mapping[str, str]] | None = None,
    min_area: float = 100,
    slide_id: int = 0,
    **ndpa: float,
) -> DataFrame:
    """Annotations of one slide as rows with ``slide_id, kind, ring, holes`` and bounds.

    ``annotations``: a GeoJSON file, an NDPA file (with what :func:`read_ndpa` needs), or a frame
    with ``parts`` or a ``ring``. With ``explode``, shapes of several parts become rows, and
    areas must exceed ``min_area``; without, the first part stands for the shape. JSON columns
    become the fields named for them. ``in_bounds`` is the origin that is added to places.
    Joined with each frame of ``join_with``: a row for each shape that an annotation meets.
    """
    if isinstance(annotations, str):
        if annotations.lower().endswith(".ndpa"):
            rows = read_ndpa(spark, annotations, **ndpa)  # type: ignore[arg-type]
        else:
            rows = read_geojson(spark, annotations)
    elif isinstance(annotations, DataFrame):
        rows = annotations
    else:
        raise ValueError(f"annotations are a path or a frame, not {type(annotations).__name__}")
    if "parts" in rows.columns:
        if explode:
            rows = exploded(rows).withColumn("kind", F.regexp_replace("kind", "^Multi", ""))
        else:
            rows = rows.withColumns({"ring": F.col("parts")[0]["ring"], "holes": F.col("parts")[0]["holes"]}).drop("parts")
    elif "holes" not in rows.columns:
        rows = rows.withColumn("holes", F.array().cast("array<array<struct<x:double,y:double>>>"))
    if explode:
        net = ring_area(F.col("ring")) - F.aggregate("holes", F.lit(0.0), lambda n, h: n + ring_area(h))
        rows = rows.where((F.col("kind") != "Polygon") | (net > min_area))
    for column, fields in (json_flatten or {}).items():
        if column in rows.columns:
            rows = flatten_json(rows, column, dict(fields))
    if in_bounds:
        rows = moved_rings(rows, *in_bounds)
    out = with_bounds(rows.withColumn("slide_id", F.lit(slide_id).cast("long")))
    for shapes in join_with:
        out = annotations_with_shapes(out, shapes)
    return out


def moved_rings(df: DataFrame, dx: float, dy: float) -> DataFrame:
    """Rings and holes shifted."""
    shift = lambda ring: F.transform(ring, lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y")))
    return df.withColumns({"ring": shift(F.col("ring")), "holes": F.transform("holes", shift)})


NDPA_SCHEMA = "_id string, title string, details string, annotation struct<_type: string, _displayname: string, _color: string, closed: string, x: double, y: double, pointlist: struct<point: array<struct<x: double, y: double>>>>"


def read_ndpa(spark: SparkSession, path: str, mpp_x: float | None, mpp_y: float | None, x_offset: float | None, y_offset: float | None, width: int, height: int, mpp: float | None = None) -> DataFrame:
    """Annotations of an NDPA file in level-0 pixels: ``ndpa_id, title, details,
    annotation_type, display_name, color, closed, kind, ring``.

    Pins are points; lists of three or more points that are closed are polygons, others lines;
    annotations without a point are skipped. ``mpp`` stands in for a resolution that isn't given
    by direction.
    """
    mpp_x, mpp_y = (mpp if m is None else m for m in (mpp_x, mpp_y))
    if None in (mpp_x, mpp_y) or None in (x_offset, y_offset):
        raise ValueError("the slide gives no resolution or no offset, so coordinates can't be placed")
    rows = spark.read.format("xml").option("rowTag", "ndpviewstate").schema(NDPA_SCHEMA).load(path)
    at = lambda x, y: F.struct(ndpa_pixel(x, x_offset, mpp_x, width).alias("x"), ndpa_pixel(y, y_offset, mpp_y, height).alias("y"))
    a = F.col("annotation")
    listed = F.transform(a["pointlist"]["point"], lambda p: at(p["x"], p["y"]))
    points = F.when(F.size(listed) > 0, listed).when(a["x"].isNotNull() & a["y"].isNotNull(), F.array(at(a["x"], a["y"])))
    closed = F.coalesce(F.lower(F.trim(a["closed"])).isin("1", "true"), F.lit(False))
    out = rows.select(F.col("_id").alias("ndpa_id"), "title", "details", a["_type"].alias("annotation_type"), a["_displayname"].alias("display_name"), a["_color"].alias("color"), closed.alias("closed"), points.alias("points")).where("points is not null")
    kind = F.when(F.size("points") == 1, "Point").when(F.col("closed") & (F.size("points") >= 3), "Polygon").otherwise("LineString")
    ring = F.when(F.col("kind") == "Polygon", F.concat("points", F.slice("points", 1, 1))).otherwise(F.col("points"))
    return out.withColumn("kind", kind).withColumn("ring", ring).drop("points")


def ndpa_pixel(nm: Column, offset: float, mpp: float, size: int) -> Column:
    """Nanometres from the slide's centre as a pixel."""
    return (nm - offset) / (mpp * 1000) + size / 2


def min_area(shapes: DataFrame, least: float = 100) -> DataFrame:
    """Shapes that are no areas, and areas strictly over ``least``."""
    size = area(box())
    return shapes.where((size == 0) | (size > least))


def moved(shapes: DataFrame, dx: int, dy: int) -> DataFrame:
    """Boxes shifted: by the origin of the slide's bounds when loading, back when exporting."""
    return shapes.withColumns({"x0": F.col("x0") + dx, "x1": F.col("x1") + dx, "y0": F.col("y0") + dy, "y1": F.col("y1") + dy})


def annotations_with_shapes(annotations: DataFrame, shapes: DataFrame, cell: int = 1024) -> DataFrame:
    """Every annotation once for each shape that it intersects, or once with nulls.

    Rings and holes decide, on either side, where there are any; boxes else.
    """
    return spatial_join(annotations, shapes, cell, how="left", exact=True)


def shapes_with_annotations(shapes: DataFrame, annotations: DataFrame, id_col: str, annotation_id: str, cell: int = 1024) -> DataFrame:
    """Every shape once, with the sorted ids of the annotations that it intersects, by their
    outlines where there are any."""
    outlined = [c for c in ("ring", "holes") if c in annotations.columns]
    pairs = spatial_join(shapes, annotations.select("slide_id", annotation_id, "x0", "y0", "x1", "y1", *outlined), cell, exact=True)
    lists = pairs.groupBy("slide_id", id_col).agg(F.array_sort(F.collect_set(f"r_{annotation_id}")).alias("annotations"))
    return shapes.join(lists, ["slide_id", id_col], "left").withColumn("annotations", F.coalesce("annotations", F.array().cast("array<long>")))


def flatten_json(df: DataFrame, column: str, fields: dict[str, str]) -> DataFrame:
    """``{column}_{field}`` for each field of a JSON column, which goes; bad JSON gives nulls."""
    parsed = F.from_json(column, ", ".join(f"`{k}` {t}" for k, t in fields.items()))
    rows = df.withColumn("_parsed", parsed)
    return rows.select("*", *[F.col(f"_parsed.{k}").alias(f"{column}_{k}") for k in fields]).drop("_parsed", column)


def _coordinates(df: DataFrame) -> dict[str, Column]:
    """GeoJSON coordinates, as JSON text, of each kind of geometry, from ``parts``."""
    point = lambda p: F.array(p["x"].cast("double"), p["y"].cast("double"))
    line = lambda ring: F.transform(ring, point)
    polygon = lambda p: F.concat(F.array(line(p["ring"])), F.transform(p["holes"], line))
    parts = F.col("parts")
    first = parts[0]
    made = {
        "Point": point(first["ring"][0]),
        "MultiPoint": F.transform(parts, lambda p: point(p["ring"][0])),
        "LineString": line(first["ring"]),
        "MultiLineString": F.transform(parts, lambda p: line(p["ring"])),
        "Polygon": polygon(first),
        "MultiPolygon": F.transform(parts, polygon),
    }
    return {kind: F.to_json(c) for kind, c in made.items()}


def _with_parts(df: DataFrame) -> DataFrame:
    """``kind`` and ``parts`` of rows that have parts, a ring, or a box."""
    none = F.array().cast("array<array<struct<x:double,y:double>>>")
    if "parts" not in df.columns:
        ring = F.col("ring") if "ring" in df.columns else ring_of(box())
        holes = F.coalesce("holes", none) if "holes" in df.columns else none
        df = df.withColumn("parts", F.array(F.struct(ring.alias("ring"), holes.alias("holes"))))
    if "kind" not in df.columns:
        ring = F.col("parts")[0]["ring"]
        closed = (F.size(ring) >= 4) & (F.get(ring, F.lit(0)) == F.element_at(ring, -1))
        one = F.when(closed, "Polygon").when(F.size(ring) == 1, "Point").otherwise("LineString")
        df = df.withColumn("kind", F.concat(F.when(F.size("parts") > 1, "Multi").otherwise(""), one))
    return df


def export_annotations(df: DataFrame, path: str | None = None, classes: str | None = None, order: str | None = None, colors: Colors = None, in_bounds: tuple[float, float] | None = None, format: str = "qupath") -> DataFrame:
    """``value``: a GeoJSON feature of each row, written as text to ``path`` if given.

    Rows have a ``kind`` and ``parts``, a ``ring`` (and ``holes``), or a box; without a kind, the
    points tell it. All other columns, but bounds beside a ring, become properties. With
    ``classes`` there is a QuPath ``classification``, of a name and the colour that
    :func:`class_colors` gives. ``in_bounds`` is the origin that was added when loading, and is
    subtracted. A path in a folder that doesn't exist raises ``NotADirectoryError``.
    """
    if format != "qupath":
        raise ValueError(f"unknown format {format!r}; known: qupath")
    if not {"ring", "parts"} & set(df.columns) and not {"x0", "y0", "x1", "y1"} <= set(df.columns):
        raise ValueError("there is neither a ring nor a box to export")
    if classes and classes not in df.columns:
        raise ValueError(f"there is no column {classes!r}; known: {', '.join(df.columns)}")
    if path and "://" not in path and not os.path.isdir(os.path.dirname(os.path.abspath(path))):
        raise NotADirectoryError(f"there is no folder {os.path.dirname(os.path.abspath(path))!r}")
    rows = _with_parts(df)
    if in_bounds:
        shift = lambda ring: F.transform(ring, lambda p: F.struct((p["x"] - in_bounds[0]).alias("x"), (p["y"] - in_bounds[1]).alias("y")))
        rows = rows.withColumn("parts", F.transform("parts", lambda p: F.struct(shift(p["ring"]).alias("ring"), F.transform(p["holes"], shift).alias("holes"))))
    made = _coordinates(rows)
    coordinates = F.coalesce(*[F.when(F.col("kind") == kind, c) for kind, c in made.items()])
    shapes = {"kind", "parts", "ring", "holes", "is_area", "x0", "y0", "x1", "y1"}
    carried = [c for c in df.columns if c not in shapes]
    if classes:
        # One row for each class: a bound that the palette of classes has anyhow.
        named = class_colors(df, classes, order or classes, colors).withColumnRenamed("class", "_class")
        rows = rows.join(named.withColumnRenamed("color", "_color"), F.col(classes).eqNullSafe(F.col("_class")), "left")
    rows = rows.withColumn("_coordinates", coordinates)
    props = [F.col(c) for c in carried] + ([F.parse_json("_color").alias("classification")] if classes else [])
    # Properties keep their types; nulls are written, as readers tell columns by them.
    properties = F.to_json(F.struct(*props), {"ignoreNullFields": "false"}) if props else F.lit("{}")
    geometry = F.concat(F.lit('{"type":"'), F.col("kind"), F.lit('","coordinates":'), F.col("_coordinates"), F.lit("}"))
    out = rows.select(F.concat(F.lit('{"type":"Feature","geometry":'), geometry, F.lit(',"properties":'), properties, F.lit("}")).alias("value"))
    if path:
        out.write.mode("errorifexists").text(path)
    return out
