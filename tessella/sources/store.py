"""Slides as keyed tables on shared storage, and tables of slides."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.tiling import TileSpec

#: Ids in one bucket of stored vectors: what one task writes, and the least that a lookup reads.
VECTORS = 1 << 16


class SlideStore:
    """Named elements, each a Parquet table partitioned by ``slide_id``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def put(self, key: str, df: DataFrame, overwrite: bool = False) -> None:
        writer = df.write.mode("overwrite" if overwrite else "errorifexists")
        (writer.partitionBy("slide_id") if "slide_id" in df.columns else writer).parquet(f"{self.path}/{key}")

    def get(self, key: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{key}")

    def update(self, key: str, columns: DataFrame, on: list[str], to: str) -> DataFrame:
        """The element with more columns, joined by key, written as ``to``."""
        self.put(to, self.get(key).join(columns, on, "left"))
        return self.get(to)

    def put_tiles(self, key: str | None, tiles: DataFrame, spec: TileSpec) -> None:
        """Tiles, and beside them the sizes that they were made with; without a key, nothing is stored."""
        if key is None:
            return
        self.put(key, tiles)
        self.put(f"{key}_spec", self.spark.createDataFrame([tuple(asdict(spec).values())], "tile_px long, stride_px long, overlap double, mpp double, slide_mpp double"))

    def tile_spec(self, key: str) -> TileSpec:
        """The sizes of stored tiles: one row."""
        return TileSpec(**self.get(f"{key}_spec").first().asDict())

    def put_vectors(self, key: str, df: DataFrame, id_col: str = "cell_id", span: int = VECTORS, overwrite: bool = False) -> None:
        """``slide_id, id_col, vec``, in folders of a slide and of ``span`` ids each.

        Whatever the slide, a task writes the vectors of one bucket. Ids count within their slide;
        an id that is null or comes twice, or vectors that are null or not all of one length, are
        errors, and nothing is written then.
        """
        rows = df.select("slide_id", id_col, "vec")
        if not rows.groupBy("slide_id", id_col).count().where(f"count > 1 or {id_col} is null").isEmpty():
            raise ValueError(f"vectors need each {id_col} once")
        sizes = rows.agg(F.min(F.size("vec")).alias("low"), F.max(F.size("vec")).alias("high"), F.count_if(F.col("vec").isNull()).alias("none")).first()
        if sizes["none"] or sizes["low"] != sizes["high"]:
            raise ValueError("vectors need one length")
        dealt = rows.withColumn("bucket", F.expr(f"{id_col} div {span}")).repartition("slide_id", "bucket").sortWithinPartitions("slide_id", "bucket", id_col)
        dealt.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("slide_id", "bucket").parquet(f"{self.path}/{key}")

    def vectors(self, key: str, ids: DataFrame | None = None, id_col: str = "cell_id", span: int = VECTORS) -> DataFrame:
        """Stored vectors; with ``ids`` (``slide_id, id_col``), theirs alone, from their buckets.

        ``span`` must be that of the writer. Repeated ids give one row each.
        """
        held = self.get(key)
        if ids is None:
            return held.drop("bucket")
        wanted = ids.select(F.col("slide_id").cast(held.schema["slide_id"].dataType), id_col).distinct().withColumn("bucket", F.expr(f"cast({id_col} div {span} as int)"))
        return wanted.join(held.withColumn("bucket", F.col("bucket").cast("int")), ["slide_id", "bucket", id_col]).drop("bucket")

    def put_cells(self, key: str, cells: DataFrame) -> None:
        """Cells as ``key``; where they have vectors, those as ``key_features``, one for each cell."""
        self.put(key, cells.drop("vec"))
        if "vec" in cells.columns:
            self.put_vectors(f"{key}_features", cells.select("slide_id", "cell_id", "vec"))

    def tile_features(self, encoder: str, tile_key: str = "tiles") -> DataFrame:
        """The vectors of a model with all columns of their tiles; tiles without a vector are left out."""
        found, tiles = self.get(feature_key(encoder, tile_key)), self.get(tile_key)
        keys = [c for c in ("slide_id", "tile_id") if c in found.columns and c in tiles.columns]
        more = [c for c in found.columns if c in keys or c not in tiles.columns]
        return tiles.join(found.select(*more), keys)


def feature_key(encoder: str, tile_key: str = "tiles") -> str:
    """The key of a model's features on a tile table."""
    return encoder if encoder.endswith(f"_{tile_key}") else f"{encoder}_{tile_key}"


def cohort(spark: SparkSession, csv: str, column: str, root: str | None = None) -> DataFrame:
    """A table of slides from CSV, paths resolved against ``root``."""
    rows = spark.read.csv(csv, header=True, inferSchema=True)
    return rows.withColumn(column, F.when(F.col(column).rlike(r"^(/|[a-z0-9]+://)"), F.col(column)).otherwise(F.concat_ws("/", F.lit(root), column))) if root else rows


def pyramid(properties: DataFrame) -> DataFrame:
    """``slide_id, level, height, width, downsample`` from a column of ``levels``."""
    return properties.select("slide_id", F.explode("levels").alias("l")).select("slide_id", "l.*")
