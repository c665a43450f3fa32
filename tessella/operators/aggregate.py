"""Reducing tile vectors: by group, by dimension, and to the best of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Reducers by their numpy names; deviations are those of the population, as there.
ENCODERS: dict[str, Callable[[str], Column]] = {
    "mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "prod": F.product,
    "median": lambda c: F.percentile(c, F.lit(0.5)),
    "std": F.stddev_pop, "var": F.var_pop,
    "ptp": lambda c: F.max(c) - F.min(c),
}
#: The same without what isn't a number; a group of nothing else gives null.
ENCODERS |= {f"nan{k}": lambda c, f=f: f(F.nanvl(F.col(c), F.lit(None))) for k, f in list(ENCODERS.items())}


def long_form(features: DataFrame, *keys: str, vec: str = "vec") -> DataFrame:
    """``keys, dim, v``: one row for each number of each vector."""
    return features.select(*keys, F.posexplode(vec).alias("dim", "v")).withColumn("dim", F.col("dim").cast("long"))


def feature_aggregation(features: DataFrame, by: tuple[str, ...] = (), encoder: str = "mean", vec: str = "vec") -> DataFrame:
    """One value for each group and dimension: ``by, dim, value``; null keys are left out."""
    if encoder not in ENCODERS:
        raise ValueError(f"unknown encoder {encoder!r}; known: {', '.join(sorted(ENCODERS))}")
    rows = long_form(features.dropna(subset=list(by)) if by else features, *by, vec=vec)
    return rows.groupBy(*by, "dim").agg(ENCODERS[encoder]("v").alias("value"))


def as_vectors(aggregated: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The result of :func:`feature_aggregation` with one array a group: ``by, vec``."""
    pairs = F.array_sort(F.collect_list(F.struct("dim", "value")))
    return aggregated.groupBy(*by).agg(F.transform(pairs, lambda p: p["value"]).alias("vec"))


def topk_score(features: DataFrame, k: int = 5, agg_method: str = "max", key: str = "tile_id") -> DataFrame:
    """For each dimension, the reduction of its ``k`` largest values: ``dim, score``."""
    how = {"max": F.max, "mean": F.avg, "median": lambda c: F.percentile(c, F.lit(0.5)), "sum": F.sum}
    if agg_method not in how:
        raise ValueError(f"agg_method must be one of {', '.join(how)}")
    first = Window.partitionBy("dim").orderBy(F.desc("v"), F.asc(key))
    best = long_form(features, key).withColumn("place", F.row_number().over(first)).where(F.col("place") <= k)
    return best.groupBy("dim").agg(how[agg_method]("v").alias("score"))


def minmax_scaled(features: DataFrame, key: str = "tile_id") -> DataFrame:
    """Every dimension scaled to [-1, 1]; a constant one becomes -1."""
    rows = long_form(features, key)
    # One row a dimension: as many as a vector is long.
    bounds = rows.groupBy("dim").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    scaled = F.coalesce(2 * (F.col("v") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) - 1, F.lit(-1.0))
    return rows.join(F.broadcast(bounds), "dim").select(key, "dim", scaled.alias("v"))


def percentile_clip(features: DataFrame, low: float = 0.01, high: float = 0.999, key: str = "tile_id") -> DataFrame:
    """Every dimension clipped at two percentiles and stretched to 0..255."""
    rows = long_form(features, key)
    # One row a dimension: as many as a vector is long.
    bounds = rows.groupBy("dim").agg(F.percentile("v", F.array(F.lit(low), F.lit(high))).alias("p"))
    joined = rows.join(F.broadcast(bounds), "dim")
    lo, hi = F.col("p")[0], F.col("p")[1]
    clipped = F.least(F.greatest(F.col("v"), lo), hi)
    return joined.select(key, "dim", F.coalesce(255 * (clipped - lo) / F.nullif(hi - lo, F.lit(0.0)), F.lit(0.0)).alias("v"))
