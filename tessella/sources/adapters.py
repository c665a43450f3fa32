"""Tiles, cells, tissues, features and pixels, derived from the tables of a data folder.

Every entity is keyed by ``slide_id`` and an id of its own. The rules are integer arithmetic,
so that ``SQL`` states the same relations for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.plans.session import table

TILE, TILES_PER_SLIDE, CELLS_PER_SLIDE, TISSUES_PER_SLIDE = 256, 500, 10_000, 100

_TILES = """SELECT vec_id // 500 AS slide_id, vec_id AS tile_id, CAST(label AS BIGINT) AS tissue_id,
  vec_id % 25 * 256 AS x0, vec_id % 500 // 25 * 256 AS y0, vec_id % 25 * 256 + 256 AS x1, vec_id % 500 // 25 * 256 + 256 AS y1 FROM embeddings"""
_CELLS = """SELECT event_id // 10000 AS slide_id, event_id AS cell_id, event_type AS class, value,
  (event_id * 53) % 2500 AS x0, (user_id * 131 + event_id * 7) % 2500 AS y0,
  (event_id * 53) % 2500 + 20 + CAST(floor(value / 20) AS BIGINT) AS x1, (user_id * 131 + event_id * 7) % 2500 + 20 + CAST(floor(value / 20) AS BIGINT) AS y1,
  CAST((event_id * 7919) % 1000003 AS DOUBLE) / 1000003 AS prob, props FROM events"""
_TISSUES = """SELECT s_suppkey // 100 AS slide_id, CAST(s_suppkey AS BIGINT) AS tissue_id, s_suppkey % 10 * 1000 AS x0, s_suppkey % 100 // 10 * 1000 AS y0,
  s_suppkey % 10 * 1000 + 300 + s_nationkey * 25 AS x1, s_suppkey % 100 // 10 * 1000 + 280 + s_suppkey % 7 * 90 AS y1 FROM supplier"""
_FEATURES = """SELECT vec_id AS tile_id, CAST(label AS BIGINT) AS tissue_id, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings"""
_PIXELS = """SELECT tile_id AS image_id, CAST(dim // 8 AS BIGINT) AS y, CAST(dim % 8 AS BIGINT) AS x,
  CAST(greatest(0, least(255, floor((v + 1) * 127.5))) AS BIGINT) AS v FROM features"""

_MOSAIC = """SELECT image_id // 500 AS image_id, image_id % 500 // 25 * 8 + y AS y, image_id % 25 * 8 + x AS x, v FROM pixels"""
_COLOURS = """SELECT image_id, y, x, v AS r, v * 7 % 256 AS g, v * 3 % 256 AS b FROM pixels"""

#: The relations in DuckDB SQL, each after those that it reads.
SQL = {"tiles": _TILES, "cells": _CELLS, "tissues": _TISSUES, "features": _FEATURES, "pixels": _PIXELS, "mosaic": _MOSAIC, "colours": _COLOURS}
_READS = {"pixels": ["features"], "mosaic": ["features", "pixels"], "colours": ["features", "pixels"]}


def with_relations(names: str, body: str) -> str:
    """``body`` with the named relations before it."""
    needed = list(dict.fromkeys(n for name in names.split() for n in (*_READS.get(name, []), name)))
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in needed) + "\n" + body


def _box(df: DataFrame, w: str, h: str) -> DataFrame:
    return df.withColumn("x1", F.col("x0") + F.expr(w)).withColumn("y1", F.col("y0") + F.expr(h))


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``slide_id, tile_id, tissue_id, x0, y0, x1, y1``: 25 x 20 tiles of 256 px a slide."""
    rows = table(spark, sf_dir, "embeddings").selectExpr("vec_id div 500 as slide_id", "vec_id as tile_id", "cast(label as bigint) as tissue_id", "vec_id % 25 * 256 as x0", "vec_id % 500 div 25 * 256 as y0")
    return _box(rows, "256", "256")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``slide_id, cell_id, class, value, x0, y0, x1, y1, prob, props``."""
    rows = table(spark, sf_dir, "events").selectExpr("event_id div 10000 as slide_id", "event_id as cell_id", "event_type as class", "value", "(event_id * 53) % 2500 as x0", "(user_id * 131 + event_id * 7) % 2500 as y0", "cast((event_id * 7919) % 1000003 as double) / 1000003 as prob", "props")
    side = "20 + cast(floor(value / 20) as bigint)"
    return _box(rows, side, side).select("slide_id", "cell_id", "class", "value", "x0", "y0", "x1", "y1", "prob", "props")


def tissues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``slide_id, tissue_id, x0, y0, x1, y1``."""
    rows = table(spark, sf_dir, "supplier").selectExpr("s_suppkey div 100 as slide_id", "cast(s_suppkey as bigint) as tissue_id", "s_suppkey % 10 * 1000 as x0", "s_suppkey % 100 div 10 * 1000 as y0", "s_nationkey", "s_suppkey % 7 as r")
    return _box(rows, "300 + s_nationkey * 25", "280 + r * 90").drop("s_nationkey", "r")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tile_id, tissue_id, vec``: one vector a tile, as doubles."""
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id as tile_id", "cast(label as bigint) as tissue_id", "cast(embedding as array<double>) as vec")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``image_id, y, x, v``: every vector as a picture of 8 x 8 grey values."""
    long = features(spark, sf_dir).select(F.col("tile_id").alias("image_id"), F.posexplode("vec").alias("dim", "f"))
    return long.selectExpr("image_id", "cast(dim div 8 as bigint) as y", "cast(dim % 8 as bigint) as x", "cast(greatest(0, least(255, floor((f + 1) * 127.5D))) as bigint) as v")


def mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``image_id, y, x, v``: all pictures of a slide side by side, as its tiles stand."""
    return pixels(spark, sf_dir).selectExpr("image_id div 500 as image_id", "image_id % 500 div 25 * 8 + y as y", "image_id % 25 * 8 + x as x", "v")


def colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``image_id, y, x, r, g, b``: pictures with three values a pixel."""
    return pixels(spark, sf_dir).selectExpr("image_id", "y", "x", "v as r", "v * 7 % 256 as g", "v * 3 % 256 as b")
