"""Slides that arrive over time: per-slide means of tile vectors, kept up to date.

An extension: features that land as Parquet files in a folder are read as a stream, reduced by
slide and dimension, and written as a whole after each batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tessella.operators.aggregate import long_form


def stream_features(spark: SparkSession, folder: str, schema: StructType, files_a_batch: int = 100) -> DataFrame:
    """The stream of feature files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def running_means(features: DataFrame, *by: str) -> DataFrame:
    """``by, dim, value, n`` over all that has arrived."""
    return long_form(features, *by).groupBy(*by, "dim").agg(F.avg("v").alias("value"), F.count("*").alias("n"))


def write_means(means: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Replaces the table ``out`` after each batch; ends when the folder's files are read."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    return means.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
