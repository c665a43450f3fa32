"""Cells and other instances: owners, overlaps, suppression, matching and metrics."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.boxes import area, box, iou
from tessella.functions.overlay import buffered, outline_area, overlap_areas, repaired, with_bounds
from tessella.plans.components import by_size, map_components, roots, slide_components
from tessella.plans.session import cut, written
from tessella.plans.spatial_join import has_rings, outline, spatial_join

BOX = ("x0", "y0", "x1", "y1")
EPS = 1e-8
#: Boxes of which the bands are in one task.
BOXES = 100_000


def _shape(df: DataFrame) -> list[str]:
    """Box columns, and those of an outline where there are any."""
    return [*BOX, *[c for c in ("ring", "holes") if c in df.columns]]


def _overlap(pairs: DataFrame) -> Column:
    """IoU of a pair: of its polygons, where it has any, else of its boxes."""
    if not {"ring", "r_ring"} & set(pairs.columns):
        return iou(box(), box("r_"))
    s = overlap_areas(*outline(pairs), *outline(pairs, "r_"))
    return F.transform(F.array(s), lambda a: F.coalesce(a["both"] / F.nullif(a["a"] + a["b"] - a["both"], F.lit(0.0)), F.lit(0.0)))[0]


def iou_pairs(boxes: DataFrame, cell: int = 64, threshold: float = 0.0, id_col: str = "cell_id") -> DataFrame:
    """``slide_id, a, b, iou`` of each two boxes (``a < b``) whose IoU is over ``threshold``; of
    polygons, where there is a ``ring`` (and ``holes``)."""
    rows = boxes.select("slide_id", F.col(id_col).alias("id"), *_shape(boxes))
    pairs = spatial_join(rows, rows, cell).where("id < r_id")
    return pairs.select("slide_id", F.col("id").alias("a"), F.col("r_id").alias("b"), _overlap(pairs).alias("iou")).where(F.col("iou") > threshold)


def first_tissue(cells: DataFrame, tissues: DataFrame, cell: int = 1024) -> DataFrame:
    """``cell_id, tissue_id``: of the tissues that a cell intersects, the first; others are left out.

    Outlines count where there are any, else boxes."""
    pairs = spatial_join(cells.select("slide_id", "cell_id", *_shape(cells)), tissues.select("slide_id", "tissue_id", *_shape(tissues)), cell, exact=True)
    return pairs.groupBy("slide_id", "cell_id").agg(F.min("r_tissue_id").alias("tissue_id"))


def in_tissue(cells: DataFrame, tissues: DataFrame, cell: int = 1024) -> DataFrame:
    """Cells that intersect some tissue."""
    found = first_tissue(cells, tissues, cell).select("slide_id", "cell_id")
    return cells.join(found, ["slide_id", "cell_id"], "left_semi")


def owner_tile(cells: DataFrame, tiles: DataFrame, cell: int = 256) -> DataFrame:
    """``slide_id, cell_id, tile_id``: of the tiles that cover a cell's centre, edges included,
    the one with the nearest centre; ties go to the smaller id."""
    mid = cells.select("slide_id", "cell_id", ((F.col("x0") + F.col("x1")) / 2).alias("x0"), ((F.col("y0") + F.col("y1")) / 2).alias("y0"))
    points = mid.select("slide_id", "cell_id", "x0", "y0", F.col("x0").alias("x1"), F.col("y0").alias("y1"))
    pairs = spatial_join(points, tiles.select("slide_id", "tile_id", *BOX), cell)
    dx = F.col("x0") - (F.col("r_x0") + F.col("r_x1")) / 2
    dy = F.col("y0") - (F.col("r_y0") + F.col("r_y1")) / 2
    return pairs.groupBy("slide_id", "cell_id").agg(F.min_by("r_tile_id", F.struct((dx * dx + dy * dy).alias("d"), "r_tile_id")).alias("tile_id"))


def tile_neighbours(tiles: DataFrame, cell: int = 256) -> DataFrame:
    """``slide_id, tile_id, neighbour`` of tiles that touch or overlap."""
    rows = tiles.select("slide_id", "tile_id", *BOX)
    return spatial_join(rows, rows, cell).where("tile_id <> r_tile_id").select("slide_id", "tile_id", F.col("r_tile_id").alias("neighbour"))


def _greedy(ids: np.ndarray, probs: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ids that a walk in id order keeps.

    From each box that isn't suppressed the walk goes to the likeliest of those that overlap it,
    itself included, keeps that, suppresses the others, and goes on until a box is alone. What
    was kept once stays kept, though a later step may suppress it.
    """
    place = {i: k for k, i in enumerate(ids)}
    near: list[list[int]] = [[] for _ in ids]
    for x, y in zip(a, b):
        near[place[x]].append(place[y])
        near[place[y]].append(place[x])
    gone, kept = np.zeros(len(ids), bool), set()
    for at in range(len(ids)):
        while not gone[at]:
            group = [j for j in (at, *near[at]) if not gone[j]]
            best = max(group, key=lambda j: (probs[j], -j))
            kept.add(best)
            gone[[j for j in group if j != best]] = True
            if best == at:
                break
            at = best
    return ids[sorted(kept)]


def nms(boxes: DataFrame, iou_threshold: float = 0.2, cell: int = 64, id_col: str = "cell_id", prob_col: str = "prob") -> DataFrame:
    """Non-maximum suppression within each slide, greedy in id order. Returns the rows that stay.

    Boxes act on one another only along overlaps above the threshold, so each connected
    component of those is decided by itself; boxes without any stay at once.
    """
    return _suppressed(boxes, iou_pairs(boxes, cell, iou_threshold, id_col).select("slide_id", "a", "b"), id_col, prob_col)


def nms_polygons(polygons: DataFrame, iou_threshold: float = 0.2, buffer_px: float = 0, cell: int = 64, id_col: str = "cell_id", prob_col: str = "prob") -> DataFrame:
    """:func:`nms` of polygons (``ring, holes``), made valid, or widened by ``buffer_px``, to be compared.

    Polygons that have no area then go; those that stay come as they were. Of one that falls
    into several parts, overlaps of all parts count.
    """
    seen = buffered("ring", "holes", buffer_px) if buffer_px else repaired("ring", "holes")
    parts = polygons.select("slide_id", F.col(id_col).alias("whole"), F.posexplode(seen).alias("part", "p")).select("slide_id", "whole", "part", "p.ring", "p.holes")
    parts = written(with_bounds(parts))
    size = parts.groupBy("slide_id", "whole").agg(F.sum(outline_area(F.col("ring"), F.col("holes"))).alias("area"))
    pairs = spatial_join(parts, parts, cell).where("whole < r_whole")
    both = pairs.groupBy("slide_id", F.col("whole").alias("a"), F.col("r_whole").alias("b")).agg(F.sum(overlap_areas(*outline(pairs), *outline(pairs, "r_"))["both"]).alias("both"))
    sized = both.join(size.withColumnsRenamed({"whole": "a", "area": "sa"}), ["slide_id", "a"]).join(size.withColumnsRenamed({"whole": "b", "area": "sb"}), ["slide_id", "b"])
    near = sized.where(F.col("both") / (F.col("sa") + F.col("sb") - F.col("both")) > iou_threshold).select("slide_id", "a", "b")
    valid = polygons.join(size.select("slide_id", F.col("whole").alias(id_col)), ["slide_id", id_col], "left_semi")
    return _suppressed(valid, near, id_col, prob_col)


def first_tissue_of_parts(shapes: DataFrame, tissues: DataFrame, key: tuple[str, ...] = ("slide_id", "cell_id"), cell: int = 1024) -> DataFrame:
    """``key`` and ``tissue_id``: of the tissues that some part of a shape (``parts``) meets, the first."""
    parts = with_bounds(shapes.select(*key, F.explode("parts").alias("p")).select(*key, "p.ring", "p.holes"))
    pairs = spatial_join(parts, tissues.select("slide_id", "tissue_id", *_shape(tissues)), cell, exact=True)
    return pairs.groupBy(*key).agg(F.min("r_tissue_id").alias("tissue_id"))


def nms_parts(shapes: DataFrame, iou_threshold: float = 0.2, cell: int = 64, id_col: str = "cell_id", prob_col: str = "prob") -> DataFrame:
    """:func:`nms` of shapes of several ``parts``, whose own parts don't overlap, with their ``area``;
    where there is a ``tissue_id``, among the shapes of a tissue alone."""
    home = [c for c in ("tissue_id",) if c in shapes.columns]
    parts = shapes.select("slide_id", *home, F.col(id_col).alias("whole"), F.col("area").alias("size"), F.explode("parts").alias("p"))
    parts = written(with_bounds(parts.select("slide_id", *home, "whole", "size", "p.ring", "p.holes")))
    pairs = spatial_join(parts, parts, cell, touch=False).where("whole < r_whole")
    pairs = pairs.where("tissue_id = r_tissue_id") if home else pairs
    shared = overlap_areas(*outline(pairs), *outline(pairs, "r_"))["both"]
    both = pairs.groupBy("slide_id", F.col("whole").alias("a"), F.col("r_whole").alias("b"), "size", "r_size").agg(F.sum(shared).alias("both"))
    near = both.where(F.col("both") / (F.col("size") + F.col("r_size") - F.col("both")) > iou_threshold).select("slide_id", "a", "b")
    return _suppressed(shapes, near, id_col, prob_col)


def _suppressed(boxes: DataFrame, pairs: DataFrame, id_col: str, prob_col: str) -> DataFrame:
    """The boxes that suppression along ``pairs`` keeps; those without an area go."""
    boxes = boxes.where("x1 > x0 and y1 > y0") if "x0" in boxes.columns else boxes
    pairs = cut(pairs)
    parts = cut(slide_components(pairs, "a", "b", id_col))
    members = parts.join(boxes.select("slide_id", id_col, F.col(prob_col).cast("double").alias("prob")), ["slide_id", id_col])
    edges = pairs.join(parts.withColumnRenamed(id_col, "a"), ["slide_id", "a"]).select("slide_id", "component", "a", "b")
    nodes = members.select("slide_id", "component", F.col(id_col).alias("a"), F.lit(None).cast("long").alias("b"), "prob")
    rows = nodes.unionByName(edges.withColumn("prob", F.lit(None).cast("double")))

    def decide(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for slide, one in part.groupby("slide_id", sort=False):
            nodes = one[one.b.isna()].sort_values("a")
            links = one[one.b.notna()]
            kept = _greedy(nodes.a.to_numpy(), nodes.prob.to_numpy(), links.a.to_numpy(), links.b.to_numpy().astype(np.int64))
            out.append(pd.DataFrame({"slide_id": slide, id_col: kept}))
        return pd.concat(out)

    kept = map_components(rows, decide, f"slide_id long, {id_col} long")
    alone = boxes.join(parts.select("slide_id", id_col), ["slide_id", id_col], "left_anti")
    return alone.unionByName(boxes.join(kept, ["slide_id", id_col], "left_semi"))


def best_of_clusters(boxes: DataFrame, iou_threshold: float = 0.2, cell: int = 64, id_col: str = "cell_id", prob_col: str = "prob") -> DataFrame:
    """Components of overlapping boxes with their size, area-weighted probability, bounds and
    best member: ``slide_id, component, n, prob, x0, y0, x1, y1, best``."""
    parts = slide_components(iou_pairs(boxes, cell, iou_threshold, id_col), "a", "b", id_col)
    rows = boxes.join(parts, ["slide_id", id_col], "left").withColumn("component", F.coalesce("component", F.col(id_col)))
    size = area(box()).cast("double")
    return rows.groupBy("slide_id", "component").agg(
        F.count("*").alias("n"),
        (F.sum(F.col(prob_col) * size) / F.sum(size)).alias("prob"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.max_by(id_col, F.struct(prob_col, (-F.col(id_col)).alias("id"))).alias("best"),
    )


def nms_by_tissue(boxes: DataFrame, tissues: DataFrame, iou_threshold: float = 0.2, cell: int = 64, id_col: str = "cell_id", prob_col: str = "prob") -> DataFrame:
    """Suppression among the boxes of one tissue alone; boxes in no tissue go. With ``tissue_id``."""
    owned = boxes.join(first_tissue(boxes.withColumnRenamed(id_col, "cell_id"), tissues).withColumnRenamed("cell_id", id_col), ["slide_id", id_col])
    pairs = iou_pairs(owned, cell, iou_threshold, id_col)
    home = owned.select("slide_id", id_col, "tissue_id")
    here = pairs.join(home.withColumnsRenamed({id_col: "a", "tissue_id": "ta"}), ["slide_id", "a"]).join(home.withColumnsRenamed({id_col: "b", "tissue_id": "tb"}), ["slide_id", "b"])
    return _suppressed(owned, here.where("ta = tb").select("slide_id", "a", "b"), id_col, prob_col)


def _assignment(links: list[tuple[int, int, float]]) -> list[tuple[int, int]]:
    """Pairs of the one-to-one matching of greatest total gain, by shortest augmenting paths.

    ``links`` are left, right and gain over zero. Only they are held, so memory grows with their
    number. Every left vertex also has a partner of its own, worth nothing: to stay alone.
    """
    top = max(gain for _, _, gain in links)
    costs: dict[int, dict] = {}
    for a, b, gain in links:
        costs.setdefault(a, {(None, a): top})[b] = top - gain
    price_a, price_b = {a: 0.0 for a in costs}, {}
    owner: dict = {}
    partner: dict = {}
    for start in costs:
        dist, via, final, queue, pushed = {}, {}, {}, [], 0
        a, base = start, 0.0
        while True:
            for b, cost in costs[a].items():
                d = base + cost - price_a[a] - price_b.get(b, 0.0)
                if b not in final and d < dist.get(b, np.inf):
                    dist[b], via[b] = d, a
                    pushed += 1
                    heapq.heappush(queue, (d, pushed, b))
            base, _, b = heapq.heappop(queue)
            while b in final:
                base, _, b = heapq.heappop(queue)
            final[b] = base
            if b not in owner:
                break
            a = owner[b]
        for c, d in final.items():
            if c in owner:
                price_a[owner[c]] += base - d
            price_b[c] = price_b.get(c, 0.0) - (base - d)
        price_a[start] += base
        while True:
            a = via[b]
            before = partner.get(a)
            owner[b], partner[a] = a, b
            if a == start:
                break
            b = before
    return [(a, b) for a, b in partner.items() if not isinstance(b, tuple)]


def match_instances(gt: DataFrame, pred: DataFrame, cell: int = 64, iou_threshold: float = 0.5) -> DataFrame:
    """``slide_id, gt_id, pred_id, iou`` of the best one-to-one matching with IoU at or above
    the threshold. Pairs without overlap add nothing, so each connected component of overlaps
    is matched by itself, in memory that grows with its overlaps. Both inputs have ``slide_id,
    id`` and a box, and may have a ``ring`` and ``holes``; ids count within their slide."""
    rows = spatial_join(gt.select("slide_id", "id", *_shape(gt)), pred.select("slide_id", "id", *_shape(pred)), cell)
    pairs = cut(rows.select("slide_id", F.col("id").alias("gt_id"), F.col("r_id").alias("pred_id"), _overlap(rows).alias("iou")).where("iou > 0"))
    small, large = by_size(pairs, ("slide_id",))

    def match(part: pd.DataFrame) -> pd.DataFrame:
        return part.iloc[_matched(part.slide_id.to_numpy(), part.gt_id.to_numpy(), part.pred_id.to_numpy(), part.iou.to_numpy())][["slide_id", "gt_id", "pred_id", "iou"]]

    schema = "slide_id long, gt_id long, pred_id long, iou double"
    matched = map_components(small, match, schema, ("slide_id",))
    if large is not None:
        # Even numbers are truths, odd ones predictions.
        edges = large.select("slide_id", (2 * F.col("gt_id")).alias("src"), (2 * F.col("pred_id") + 1).alias("dst"))
        parts = slide_components(edges, "src", "dst", "vertex").where("vertex % 2 = 0").select("slide_id", F.expr("vertex div 2").alias("gt_id"), "component")
        matched = matched.unionByName(map_components(large.join(parts, ["slide_id", "gt_id"]), match, schema))
    return matched.where(F.col("iou") >= iou_threshold)


def _matched(slide: np.ndarray, gt: np.ndarray, pred: np.ndarray, iou: np.ndarray) -> np.ndarray:
    """Which pairs are in the matching of greatest total gain, of whole components.

    A pair that gains more than the next best pairs of its two ends together is in every best
    matching, for it could replace those; it is taken, with its ends, and others may then do so
    too. What is left is assigned component by component.
    """
    number = lambda ids: pd.MultiIndex.from_arrays([slide, ids]).factorize()[0]
    a, b = number(gt), number(pred)
    left, taken = np.arange(len(a)), []
    while len(left):
        p, q, gain = a[left], b[left], iou[left]
        sure = gain > _next_best(p, gain) + _next_best(q, gain)
        if not sure.any():
            break
        taken.append(left[sure])
        gone_a, gone_b = np.zeros(a.max() + 1, bool), np.zeros(b.max() + 1, bool)
        gone_a[p[sure]] = gone_b[q[sure]] = True
        left = left[~gone_a[p] & ~gone_b[q]]
    if len(left):
        p, q = np.unique(a[left], return_inverse=True)[1], np.unique(b[left], return_inverse=True)[1] + len(left)
        component = roots(2 * len(left), p, q)[p]
        order = np.lexsort([pred[left], gt[left], component])  # so that ties don't hang on the order of rows
        for rows in np.split(left[order], np.flatnonzero(np.diff(component[order])) + 1):
            at = {(x, y): k for k, x, y in zip(rows.tolist(), a[rows].tolist(), b[rows].tolist())}
            best = _assignment([(x, y, float(iou[k])) for (x, y), k in at.items()])
            taken.append(np.array([at[x, y] for x, y in best], np.int64))
    return np.concatenate(taken) if taken else np.zeros(0, np.int64)


def _next_best(end: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """For each pair the greatest gain of another pair at the same end, 0 if there is none."""
    order = np.lexsort([-gain, end])
    first = np.ones(len(order), bool)
    first[1:] = np.diff(end[order]) != 0
    best = np.flatnonzero(first)
    sizes = np.diff(np.append(best, len(order)))
    top = np.repeat(gain[order][best], sizes)
    second = np.repeat(np.where(sizes > 1, gain[order][np.minimum(best + 1, len(order) - 1)], 0.0), sizes)
    out = np.empty(len(order))
    out[order] = np.where(first, second, top)
    return out


def instance_stats(gt: DataFrame, pred: DataFrame, matched: DataFrame) -> DataFrame:
    """``slide_id, tp, fp, fn, tn, iou_sum`` by slide."""
    count = lambda df, name: df.groupBy("slide_id").agg(F.count("*").alias(name))
    hits = matched.groupBy("slide_id").agg(F.count("*").alias("tp"), F.sum("iou").alias("iou_sum"))
    rows = count(gt, "n_gt").join(count(pred, "n_pred"), "slide_id", "full").join(hits, "slide_id", "left").na.fill(0)
    return rows.select("slide_id", "tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_gt") - F.col("tp")).alias("fn"), F.lit(0).cast("long").alias("tn"), "iou_sum")


def semantic_stats(gt: DataFrame, pred: DataFrame, strip: int = 64) -> DataFrame:
    """Areas of the unions: ``slide_id, tp, fp, fn, tn``, cut to whole pixels.

    Boxes are cut at the borders of squares of side ``strip``. Within a square, cut again at the
    distinct edges of its pieces into bands, the covered length is the union of intervals,
    summed by a running maximum; nothing is compared beyond its square.
    """
    rows = gt.select("slide_id", F.lit("t").alias("kind"), *BOX).unionByName(pred.select("slide_id", F.lit("p").alias("kind"), *BOX)).where("x1 > x0 and y1 > y0")
    part = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / strip), F.floor((F.col(hi) - 1) / strip)))
    cells = rows.withColumn("gy", part("y0", "y1")).withColumn("gx", part("x0", "x1"))
    held = lambda c, g: F.least(F.greatest(F.col(c), F.col(g) * strip), (F.col(g) + 1) * strip).alias(c)
    square = ["slide_id", "gx", "gy"]
    # Bands are many times the pieces, so squares are dealt out once, by a count of boxes.
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // BOXES))
    pieces = cells.select("slide_id", "gx", "gy", "kind", held("x0", "gx"), held("x1", "gx"), held("y0", "gy"), held("y1", "gy")).repartition(tasks, *square).distinct()
    ys = pieces.groupBy(*square).agg(F.array_sort(F.array_union(F.collect_set("y0"), F.collect_set("y1"))).alias("ys"))
    bands = ys.select(*square, F.explode(F.transform(F.slice("ys", F.lit(1), F.size("ys") - 1), lambda y, i: F.struct(y.alias("lo"), F.get("ys", i + 1).alias("hi")))).alias("b")).select(*square, "b.lo", "b.hi")
    inside = pieces.join(bands, square).where("lo >= y0 and hi <= y1").select(*square, "kind", "lo", "hi", "x0", "x1")

    def covered(df: DataFrame, name: str) -> DataFrame:
        order = Window.partitionBy(*square, "lo", "hi").orderBy("x0", "x1").rowsBetween(Window.unboundedPreceding, -1)
        fresh = F.greatest(F.lit(0), F.col("x1") - F.greatest("x0", F.coalesce(F.max("x1").over(order), F.col("x0"))))
        return df.withColumn("fresh", fresh * (F.col("hi") - F.col("lo"))).groupBy("slide_id").agg(F.sum("fresh").alias(name))

    t, p, both = covered(inside.where("kind = 't'"), "t"), covered(inside.where("kind = 'p'"), "p"), covered(inside, "both")
    joined = both.join(t, "slide_id", "left").join(p, "slide_id", "left").na.fill(0)
    tp = F.col("t") + F.col("p") - F.col("both")
    return joined.select("slide_id", tp.cast("long").alias("tp"), (F.col("p") - tp).cast("long").alias("fp"), (F.col("t") - tp).cast("long").alias("fn"), F.lit(0).cast("long").alias("tn"))


def metrics(stats: DataFrame) -> DataFrame:
    """The scores of ``tp, fp, fn, tn``, and of ``iou_sum`` where there is one."""
    d = lambda c: F.col(c).cast("double")
    tp, fp, fn, tn = (d(c) for c in ("tp", "fp", "fn", "tn"))
    total = tp + fp + fn + tn
    p, r = tp / (tp + fp + EPS), tp / (tp + fn + EPS)
    scores = {
        "accuracy": F.coalesce((tp + tn) / F.nullif(total, F.lit(0.0)), F.lit(0.0)),
        "precision": p, "recall": r, "sensitivity": r, "f1_score": 2 * p * r / (p + r + EPS),
        "specificity": tn / (tn + fp + EPS), "dice": 2 * tp / (2 * tp + fp + fn + EPS),
    }
    if "iou_sum" in stats.columns:
        scores["mean_iou"] = F.coalesce(d("iou_sum") / F.nullif(tp, F.lit(0.0)), F.lit(0.0))
        scores["pq"] = F.when(tp > 0, d("iou_sum") / (tp + fp / 2 + fn / 2)).otherwise(0.0)
    else:
        scores["mean_iou"] = tp / (tp + fp + fn + EPS)
    return stats.select("*", *[v.alias(k) for k, v in scores.items()])


def magnification(mpp: Column) -> Column:
    """20x or 40x by resolution: unknown counts as 20x, other resolutions are errors."""
    return F.when(mpp.isNull() | mpp.between(0.4, 0.6), "20x").when(mpp.between(0.1, 0.3), "40x").otherwise(F.raise_error(F.lit("no magnification for this resolution")))


def postprocess_cells(cells: DataFrame, tissues: DataFrame, size: tuple[float, float] | None = None, dropped: tuple[str, ...] = ("Background",), iou_threshold: float = 0.2) -> DataFrame:
    """Model output to cells: by size, in tissue, by class, and without overlaps."""
    rows = cells.where(~F.col("class").isin(*dropped)) if dropped else cells
    if size:
        rows = rows.where(area(box()).between(*size))
    return nms(in_tissue(rows, tissues), iou_threshold)


def pooled_features(pixels: DataFrame, tokens: DataFrame) -> DataFrame:
    """Mean of the tokens under each instance: ``image_id, instance, dim, v``.

    ``pixels`` has ``image_id, y, x, instance`` (0 is background) and the token's place
    ``ty, tx``; ``tokens`` has ``image_id, ty, tx, vec``.
    """
    held = pixels.where("instance <> 0").select("image_id", "instance", "ty", "tx")
    long = tokens.select("image_id", "ty", "tx", F.posexplode("vec").alias("dim", "v"))
    return held.join(long, ["image_id", "ty", "tx"]).groupBy("image_id", "instance", "dim").agg(F.avg("v").alias("v"))
