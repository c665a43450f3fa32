"""Session helpers: table access, shared storage for cut lineage, and Arrow batch limits."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes that one Arrow batch may hold on its way to a Python worker.
ARROW_ROWS, ARROW_BYTES = 1000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder; any path that Spark can read."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what the cluster names in ``spark.checkpoint.dir``; only a session of one machine
    without that setting (a test, a laptop) gets a folder of its own.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Checkpoints ``df`` in the shared folder and returns it with its lineage cut."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Like :func:`cut`, as compressed columns: for text, or for what is read more than once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessella-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches small enough for rows with very long texts."""
    rows = spark.conf.get("spark.tessella.batch_rows", None) or str(ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable on the executors where no shared path provides it."""
    import pathlib
    import shutil

    root = str(pathlib.Path(__file__).resolve().parents[2])
    paths = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root in paths or os.path.realpath(os.getcwd()) == root or getattr(spark.sparkContext, "_tessella_shipped", False):
        return
    at = tempfile.mkdtemp(prefix="tessella-code-")
    pack = shutil.make_archive(f"{at}/tessella", "zip", root_dir=root, base_dir="tessella")
    spark.sparkContext.addPyFile(pack)
    spark.sparkContext._tessella_shipped = True
