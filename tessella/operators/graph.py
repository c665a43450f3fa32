"""Neighbour graphs of tiles as edge lists ``slide_id, src, dst, w``, and smoothing along them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.aggregate import long_form
from tessella.plans.session import cut


def _candidates(points: DataFrame, wanted: DataFrame, side: int, rings: int) -> DataFrame:
    """Pairs of a wanted point and every other within ``rings`` grid cells of it."""
    reach = F.sequence(F.lit(-rings), F.lit(rings))
    near = wanted.select("slide_id", F.col("id").alias("src"), F.col("x").alias("sx"), F.col("y").alias("sy"), F.explode(F.transform(reach, lambda d: F.floor(F.col("x") / side) + d)).alias("gx"), F.floor(F.col("y") / side).alias("cy"))
    near = near.select("slide_id", "src", "sx", "sy", "gx", F.explode(F.transform(reach, lambda d: F.col("cy") + d)).alias("gy"))
    placed = points.select("slide_id", F.col("id").alias("dst"), "x", "y", F.floor(F.col("x") / side).alias("gx"), F.floor(F.col("y") / side).alias("gy"))
    apart = F.sqrt(((F.col("sx") - F.col("x")) * (F.col("sx") - F.col("x")) + (F.col("sy") - F.col("y")) * (F.col("sy") - F.col("y"))).cast("double"))
    return near.join(placed, ["slide_id", "gx", "gy"]).where("src <> dst").select("slide_id", "src", "dst", apart.alias("dist"))


def knn(points: DataFrame, k: int, side: int, wanted: DataFrame | None = None) -> DataFrame:
    """The ``k`` nearest others of every point ``slide_id, id, x, y``: ``slide_id, src, dst, dist``.

    A point looks at the grid cells around its own, and is done if its k-th neighbour is no
    further than a cell's side: no nearer one can lie outside. The others look at a grid of
    twice the side, until a cell is as large as their slide; so each look is at nine cells.
    Slides of up to k + 1 points are done at once. Ties go to the smaller id; slides of up to k
    points give what there is. With ``wanted`` (``slide_id, src``) only those points get neighbours.
    """
    points = cut(points.select("slide_id", "id", "x", "y"))
    size = points.groupBy("slide_id").agg(F.count("*").alias("n"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("extent"))
    order = Window.partitionBy("slide_id", "src").orderBy("dist", "dst")
    asked = points if wanted is None else points.join(wanted.select("slide_id", F.col("src").alias("id")), ["slide_id", "id"], "left_semi")
    asked = cut(asked.join(size, "slide_id"))
    few = asked.where(F.col("n") <= k + 1).select("slide_id", F.col("id").alias("src"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    apart = F.sqrt(((F.col("sx") - F.col("x")) * (F.col("sx") - F.col("x")) + (F.col("sy") - F.col("y")) * (F.col("sy") - F.col("y"))).cast("double"))
    done = few.join(points.withColumnRenamed("id", "dst"), "slide_id").where("src <> dst").select("slide_id", "src", "dst", apart.alias("dist"))
    left = cut(asked.where(F.col("n") > k + 1).drop("n"))
    while not left.isEmpty():
        best = cut(_candidates(points, left, side, 1).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k))
        reach = best.groupBy("slide_id", "src").agg(F.max("dist").alias("last"), F.count("*").alias("n")).join(left.select("slide_id", F.col("id").alias("src"), "extent"), ["slide_id", "src"])
        ready = reach.where((F.col("extent") < side) | ((F.col("n") == k) & (F.col("last") <= side))).select("slide_id", "src")
        done = done.unionByName(best.join(ready, ["slide_id", "src"], "left_semi").select("slide_id", "src", "dst", "dist"))
        left = cut(left.join(ready.withColumnRenamed("src", "id"), ["slide_id", "id"], "left_anti"))
        side *= 2
    return done


def radius_pairs(points: DataFrame, radius: float, include_self: bool = False) -> DataFrame:
    """``slide_id, src, dst, dist`` of every two points at most ``radius`` apart."""
    if radius <= 0:
        raise ValueError("a radius must be positive")
    side = lambda c: F.floor(F.col(c) / radius)
    a = points.select("slide_id", F.col("id").alias("src"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    around = F.sequence(F.lit(-1), F.lit(1))
    a = a.withColumn("gx", F.explode(F.transform(around, lambda i: side("ax") + i))).withColumn("gy", F.explode(F.transform(around, lambda i: side("ay") + i)))
    b = points.select("slide_id", F.col("id").alias("dst"), "x", "y", side("x").alias("gx"), side("y").alias("gy"))
    apart = F.sqrt(F.pow(F.col("ax") - F.col("x"), 2) + F.pow(F.col("ay") - F.col("y"), 2))
    near = a.join(b, ["slide_id", "gx", "gy"]).withColumn("dist", apart).where(F.col("dist") <= radius)
    return near.where(F.lit(include_self) | (F.col("src") != F.col("dst"))).select("slide_id", "src", "dst", "dist")


def tile_graph(points: DataFrame, n_neighs: int = 6, n_rings: int = 1, side: int = 512, set_diag: bool = False, transform: str | None = None, delaunay: bool = False) -> DataFrame:
    """The neighbour graph of each slide: ``slide_id, src, dst, w, dist, euclid``.

    Directed edges to the ``n_neighs`` nearest that are nearer than 1.3 times the slide's median
    distance. ``dist`` is 1, or with several rings the number of steps; ``euclid`` is the
    distance itself, null beyond the first ring. ``transform``: None, ``spectral`` or ``cosine``.
    With ``delaunay`` the neighbours are those of the triangulation, at any distance.
    """
    if delaunay:
        from tessella.operators.delaunay import delaunay as triangulated

        ends = [points.select("slide_id", F.col("id").alias(e), F.col("x").alias(f"x{e}"), F.col("y").alias(f"y{e}")) for e in ("src", "dst")]
        long = F.sqrt(F.pow(F.col("xsrc") - F.col("xdst"), 2) + F.pow(F.col("ysrc") - F.col("ydst"), 2))
        pairs = triangulated(points, side).join(ends[0], ["slide_id", "src"]).join(ends[1], ["slide_id", "dst"])
        first = cut(pairs.select("slide_id", "src", "dst", long.alias("euclid")))
        return _finished(first, points, n_rings, set_diag, transform)
    edges = knn(points, n_neighs, side)
    limit = edges.groupBy("slide_id").agg((1.3 * F.percentile("dist", F.lit(0.5))).alias("limit"))
    first = cut(edges.join(limit, "slide_id").where("dist < limit").select("slide_id", "src", "dst", F.col("dist").alias("euclid")))
    return _finished(first, points, n_rings, set_diag, transform)


def _finished(first: DataFrame, points: DataFrame, n_rings: int, set_diag: bool, transform: str | None) -> DataFrame:
    """The graph of the first ring's edges: further rings, own edges, and a transform."""
    graph = first.select("slide_id", "src", "dst", F.lit(1.0).alias("w"), F.lit(1.0).alias("dist"), "euclid")
    if n_rings > 1:
        graph = rings(first, n_rings)
    if set_diag:
        own = points.select("slide_id", F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("w"), F.lit(0.0).alias("dist"), F.lit(0.0).alias("euclid"))
        graph = graph.where("src <> dst").unionByName(own)
    if transform in (None, "none"):
        return graph
    if transform == "spectral":
        return spectral(graph)
    if transform == "cosine":
        return cosine(graph)
    raise NotImplementedError(f"transform {transform!r}")


def rings(first: DataFrame, n_rings: int) -> DataFrame:
    """Everything within ``n_rings`` steps, with the number of steps as ``dist``."""
    reached = cut(first.select("slide_id", "src", "dst", F.lit(1).alias("hop"), "euclid"))
    frontier = reached
    step = first.select("slide_id", F.col("src").alias("dst"), F.col("dst").alias("next"))
    for hop in range(2, n_rings + 1):
        new = frontier.join(step, ["slide_id", "dst"]).where("src <> next").select("slide_id", "src", F.col("next").alias("dst")).distinct()
        frontier = cut(new.join(reached, ["slide_id", "src", "dst"], "left_anti").select("slide_id", "src", "dst", F.lit(hop).alias("hop"), F.lit(None).cast("double").alias("euclid")))
        reached = reached.unionByName(frontier)
    return reached.select("slide_id", "src", "dst", F.lit(1.0).alias("w"), F.col("hop").cast("double").alias("dist"), "euclid")


def spectral(graph: DataFrame) -> DataFrame:
    """Weights times the inverse roots of the column sums of both ends."""
    root = graph.groupBy("slide_id", F.col("dst").alias("v")).agg((1 / F.sqrt(F.sum("w"))).alias("d"))
    a = root.select("slide_id", F.col("v").alias("src"), F.col("d").alias("ds"))
    b = root.select("slide_id", F.col("v").alias("dst"), F.col("d").alias("dd"))
    joined = graph.join(a, ["slide_id", "src"], "left").join(b, ["slide_id", "dst"])
    return joined.select("slide_id", "src", "dst", (F.col("w") * F.coalesce("ds", F.lit(0.0)) * F.col("dd")).alias("w"), "dist", "euclid")


def cosine(graph: DataFrame) -> DataFrame:
    """Cosine similarity of the adjacency rows in place of the adjacency."""
    norm = graph.groupBy("slide_id", "src").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("n"))
    unit = graph.join(norm, ["slide_id", "src"]).select("slide_id", "src", F.col("dst").alias("via"), (F.col("w") / F.col("n")).alias("u"))
    other = unit.select("slide_id", F.col("src").alias("dst"), "via", F.col("u").alias("v"))
    return unit.join(other, ["slide_id", "via"]).groupBy("slide_id", "src", "dst").agg(F.sum(F.col("u") * F.col("v")).alias("w")).withColumns({"dist": F.lit(None).cast("double"), "euclid": F.lit(None).cast("double")})


def spatial_features(features: DataFrame, graph: DataFrame, points: DataFrame, normalize: str = "row") -> DataFrame:
    """Vectors smoothed along the graph: ``slide_id, id, dim, v``.

    With B the weights plus the identity, ``row`` gives ``sum_i B_ij / |B_i| X_i``: rows are
    normalised and then the transpose is taken. ``average`` gives ``sum_j B_ij X_j / |B_i|``.
    ``features`` without a ``slide_id`` must have tile ids that are unique over all slides.
    """
    if normalize not in ("row", "average"):
        raise ValueError("normalize must be 'row' or 'average'")
    own = points.select("slide_id", F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("w"))
    b = graph.select("slide_id", "src", "dst", "w").unionByName(own).groupBy("slide_id", "src", "dst").agg(F.sum("w").alias("w"))
    sums = b.groupBy("slide_id", "src").agg(F.sum(F.abs("w")).alias("of"))
    share = b.join(sums, ["slide_id", "src"]).withColumn("share", F.col("w") / F.col("of"))
    pull, give = ("src", "dst") if normalize == "row" else ("dst", "src")
    keys = [F.col("tile_id").alias(pull), *(["slide_id"] if "slide_id" in features.columns else [])]
    rows = long_form(features, *keys)
    return share.join(rows, [pull, *keys[1:]]).groupBy("slide_id", F.col(give).alias("id"), "dim").agg(F.sum(F.col("share") * F.col("v")).alias("v"))


def corner_points(tiles: DataFrame, id_col: str = "tile_id") -> DataFrame:
    """``slide_id, id, x, y`` of the top-left corners."""
    return tiles.select("slide_id", F.col(id_col).alias("id"), F.col("x0").alias("x"), F.col("y0").alias("y"))


def softmax(score: str, by: tuple[str, ...]) -> Column:
    """Softmax of a score among the rows of each ``by``."""
    within = Window.partitionBy(*by)
    top = F.exp(F.col(score) - F.max(score).over(within))
    return top / F.sum(top).over(within)
