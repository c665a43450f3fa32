"""Regions of polygons: valid parts, overlay, union of what belongs together, dissolve, areas.

Polygons have ``ring`` and ``holes``, and bounds ``x0..y1`` where they are joined. Results have
valid rings, and one row for each part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import planar as P
from tessella.functions.boxes import box, ring_of
from tessella.functions.overlay import PARTS, buffered, no_holes, outline_area, overlay, repaired, with_bounds
from tessella.plans.components import slide_components
from tessella.plans.session import bounded_batches, ship_package, written
from tessella.plans.spatial_join import on_grid, outline, spatial_join


def with_outline(df: DataFrame) -> DataFrame:
    """``ring`` and ``holes`` of every row; a box stands for a missing ring."""
    ring = F.col("ring") if "ring" in df.columns else ring_of(box())
    holes = F.coalesce("holes", no_holes()) if "holes" in df.columns else no_holes()
    return df.withColumns({"ring": ring, "holes": holes})


def part_rows(df: DataFrame, parts: str = "parts") -> DataFrame:
    """One row for each part: ``part`` counts from 0; ``ring, holes, area`` and bounds are its own."""
    others = [c for c in df.columns if c not in {parts, "ring", "holes", "area", "part", "x0", "y0", "x1", "y1"}]
    rows = df.select(*others, F.posexplode(parts).alias("part", "_p")).select(*others, "part", "_p.ring", "_p.holes")
    return with_bounds(rows).withColumn("area", outline_area(F.col("ring"), F.col("holes")))


def valid_polygons(df: DataFrame) -> DataFrame:
    """Every polygon as its valid parts; one that has no area goes.

    A ring that crosses itself is cut at its crossings, and what it winds around is kept; spikes
    go, and so does what holes cover beyond their ring.
    """
    rows = with_outline(df)
    return part_rows(rows.withColumn("parts", repaired("ring", "holes")))


def overlaid(left: DataFrame, right: DataFrame, how: str = "intersection", cell: int = 256) -> DataFrame:
    """Parts of the overlay of each two polygons that meet; columns of ``right`` are prefixed ``r_``."""
    pairs = spatial_join(with_outline(left), with_outline(right), cell, exact=True)
    return part_rows(pairs.withColumn("parts", overlay(how, *outline(pairs), *outline(pairs, "r_"))).drop("r_ring", "r_holes"))


def _starts(batch: pa.Table, keys: list[str]) -> np.ndarray:
    """Where a group of equal keys begins, in sorted rows."""
    columns = list(zip(*(batch.column(k).to_pylist() for k in keys)))
    return np.array([i for i in range(len(columns)) if i == 0 or columns[i] != columns[i - 1]], np.int64)


def _many_groups(rows: DataFrame, keys: list[str], of: Callable[[pa.Table, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """Applies a function to tables that hold many whole groups of equal ``keys``, and where each
    begins. A group is in one task.

    Groups are dealt into the session's number of partitions, which stay apart: rows are few for
    the work that they make, so their bytes don't tell how many tasks are worth while.
    """
    spark = rows.sparkSession
    ship_package(spark)
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = [batch.column(k)[batch.num_rows - 1] for k in keys]
            same_as_held = held and all(held[-1].column(k)[held[-1].num_rows - 1] == v for k, v in zip(keys, last))
            held.append(batch)
            if same_as_held and all(batch.column(k)[0] == v for k, v in zip(keys, last)):
                continue  # one group goes on
            table = pa.Table.from_batches(held)
            starts = _starts(table, keys)
            if len(starts) > 1:
                yield of(table.slice(0, int(starts[-1])), starts[:-1])
                held = table.slice(int(starts[-1])).to_batches()
        if held:
            table = pa.Table.from_batches(held)
            yield of(table, _starts(table, keys))

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def united(rows: DataFrame, keys: tuple[str, ...], grow: float = 0.0, shrink: float = 0.0) -> DataFrame:
    """``keys, parts``: the union of the polygons of each group, which may be widened by ``grow``
    before and narrowed by ``shrink`` afterwards.

    Many groups share a call; a group is in one task, and holds its edges there.
    """
    keys_list = list(keys)

    def merged(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        n, groups = table.num_rows, len(starts)
        group = np.searchsorted(starts, np.arange(n), "right") - 1
        ring, holes = (table.column(c).combine_chunks() for c in ("ring", "holes"))
        grown = P.buffered(P.simple(P.outlines(ring, holes)), grow, n)
        parts = P.parts_of(P.buffered(P.united(grown, group, groups), -shrink, groups), groups)
        first = table.select(keys_list).take(pa.array(starts))
        return pa.RecordBatch.from_pydict({k: first.column(k).combine_chunks() for k in keys_list} | {"parts": parts})

    types = dict(rows.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys_list) + f", parts {PARTS.simpleString()}"
    return _many_groups(rows.select(*keys_list, "ring", "holes"), keys_list, merged, schema)


def merge_connected(polygons: DataFrame, id_col: str = "cell_id", prob_col: str | None = None, buffer_px: float = 0.0, cell: int = 64) -> DataFrame:
    """Polygons that meet, directly or through others, as one: ``slide_id, component, n``, the mean
    probability by area where there is one, ``part, ring, holes, area`` and bounds.

    ``component`` is the smallest id. With ``buffer_px`` polygons are widened by it before, and
    the union is narrowed by it again.
    """
    rows = with_outline(polygons)
    keep = ["slide_id", F.col(id_col).alias("id")] + ([F.col(prob_col).cast("double").alias("prob")] if prob_col else [])
    seen = rows.select(*keep, F.posexplode(buffered("ring", "holes", buffer_px)).alias("part", "p"))
    seen = written(with_bounds(seen.select("slide_id", "id", *(["prob"] if prob_col else []), "p.ring", "p.holes")))
    pairs = spatial_join(seen.select("slide_id", "id", "ring", "holes", "x0", "y0", "x1", "y1"), seen.select("slide_id", "id", "ring", "holes", "x0", "y0", "x1", "y1"), cell, exact=True).where("id < r_id")
    parts = slide_components(pairs, "id", "r_id", "id")
    member = written(seen.join(parts, ["slide_id", "id"], "left").withColumn("component", F.coalesce("component", "id")))
    whole = united(member, ("slide_id", "component"), shrink=buffer_px)
    size = outline_area(F.col("ring"), F.col("holes"))
    told = member.groupBy("slide_id", "component").agg(F.countDistinct("id").alias("n"), *([(F.sum(F.col("prob") * size) / F.sum(size)).alias("prob")] if prob_col else []))
    return part_rows(whole.join(told, ["slide_id", "component"]))


def dissolve_polygons(polygons: DataFrame, by: tuple[str, ...], tolerance: float = 1.0, prob_col: str | None = None, cell: int = 128) -> DataFrame:
    """Polygons of equal ``by`` within twice ``tolerance`` of one another as one: ``by, region, part,
    ring, holes, area``, bounds, and the group's highest probability where there is one.

    Polygons are widened by the tolerance, united, and narrowed by it again, so seams and gaps
    close. ``by`` begins with ``slide_id``; ``region`` counts within it and is no stable number.
    """
    rows = with_outline(polygons)
    group = list(by)
    wide = rows.select(*group, F.monotonically_increasing_id().alias("id"), F.explode(buffered("ring", "holes", tolerance)).alias("p"))
    wide = written(with_bounds(wide.select(*group, "id", "p.ring", "p.holes")))
    pairs = spatial_join(wide, wide, cell, exact=True).where("id < r_id")
    for c in group[1:]:
        pairs = pairs.where(F.col(c) == F.col(f"r_{c}"))
    parts = slide_components(pairs, "id", "r_id", "id", within=(group[0],))
    member = wide.join(parts.withColumnRenamed("component", "region"), [group[0], "id"], "left").withColumn("region", F.coalesce("region", "id"))
    whole = part_rows(united(member, (*group, "region"), shrink=tolerance))
    if prob_col:
        whole = whole.join(rows.groupBy(*group).agg(F.max(prob_col).alias("prob")), group)
    return whole


def polygon_stats(gt: DataFrame, pred: DataFrame, strip: int = 512) -> DataFrame:
    """Areas of the unions of polygons: ``slide_id, tp, fp, fn, tn``, as doubles.

    Polygons are cut to squares of side ``strip``; within a square the windings of all pieces of
    either side tell what is covered, so a task holds no more than the pieces of a square.
    """
    kind = lambda df, k: with_outline(df).select("slide_id", "x0", "y0", "x1", "y1", "ring", "holes", F.lit(k).alias("kind"))
    cells = on_grid(kind(gt, 0).unionByName(kind(pred, 1)), strip)
    keys = ["slide_id", "gx", "gy"]

    def covered(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        square = np.searchsorted(starts, np.arange(table.num_rows), "right") - 1
        ring, holes = (table.column(c).combine_chunks() for c in ("ring", "holes"))
        left, top = (table.column(c).to_numpy() * float(strip) for c in ("gx", "gy"))
        whole, frame = (P.oriented(o)[0] for o in (P.outlines(ring, holes), P.boxed(left, top, left + strip, top + strip)))
        cut = P.slabs(P.Edges.of(whole, frame), np.repeat([0, 1], [len(whole), len(frame)]), table.num_rows)
        e, _ = P.rings_as_edges(P.outlined(cut, P.NONZERO(cut.winds[0]) & P.NONZERO(cut.winds[1])))
        group = table.column("kind").to_numpy()[e.row]
        e.row = square[e.row]
        s = P.slabs(e, group, len(starts))
        t, p = P.POSITIVE(s.winds[0]), P.POSITIVE(s.winds[1])
        areas = {c: pa.array(P.areas(s, k, len(starts))) for c, k in (("tp", t & p), ("fp", p & ~t), ("fn", t & ~p))}
        some = pa.array(np.bincount(e.row, minlength=len(starts)) > 0)  # borders alone hold nothing
        return pa.RecordBatch.from_pydict({"slide_id": table.column("slide_id").combine_chunks().take(pa.array(starts))} | areas).filter(some)

    slide = dict(cells.dtypes)["slide_id"]
    each = _many_groups(cells.select(*keys, "kind", "ring", "holes"), keys, covered, f"slide_id {slide}, tp double, fp double, fn double")
    return each.groupBy("slide_id").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).withColumn("tn", F.lit(0.0))


def drawn(polygons: DataFrame, value: str = "v", chunk: int = 512) -> DataFrame:
    """``image_id, y, x, value``: the pixels whose centres are inside of a polygon, holes taken out.

    Polygons (``image_id``, ``ring, holes``, bounds, and the column ``value``) are dealt out by the
    chunks of side ``chunk`` that they reach; each chunk is filled line by line between the places
    where a line of centres crosses edges, so a large polygon is many tasks' work. A pixel in two
    polygons comes twice.
    """
    ship_package(polygons.sparkSession)
    rows = with_outline(polygons).select("image_id", "x0", "y0", "x1", "y1", "ring", "holes", F.col(value).alias("value"))
    dealt = on_grid(rows, chunk).select("image_id", "value", "ring", "holes", F.col("gx").cast("long").alias("gx"), F.col("gy").cast("long").alias("gy"))
    kind = dict(dealt.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            gx, gy = batch.column("gx").to_numpy(), batch.column("gy").to_numpy()
            row, y, start, stop = _spans(P.edges_of(P.outlines(batch.column("ring"), batch.column("holes")), areas_only=True), gx * chunk, gy * chunk, chunk)
            take = pa.array(row)
            yield pa.RecordBatch.from_pydict({"image_id": batch.column("image_id").take(take), "value": batch.column("value").take(take), "y": pa.array(y), "from": pa.array(start), "to": pa.array(stop)})

    spans = dealt.repartition("image_id", "gx", "gy").mapInArrow(run, f"image_id {kind['image_id']}, value {kind['value']}, y long, `from` long, `to` long")
    return spans.select("image_id", "y", F.explode(F.sequence("from", "to")).alias("x"), F.col("value").alias(value))


def _spans(e: P.Edges, left: np.ndarray, top: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, line, first and last pixel of the stretches inside of rings, within each row's square.

    A line of centres crosses an edge whose ends lie on different sides of it; of the sorted
    crossings of a line, inside is between the first and the second, the third and the fourth.
    """
    lo = np.maximum(np.ceil(np.minimum(e.ay, e.by) - 0.5).astype(np.int64), top[e.row])
    hi = np.minimum(np.ceil(np.maximum(e.ay, e.by) - 0.5).astype(np.int64) - 1, top[e.row] + side - 1)
    number = np.maximum(hi - lo + 1, 0)
    at = np.repeat(np.arange(len(e)), number)
    y = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number) + np.repeat(lo, number)
    x = e.ax[at] + (y + 0.5 - e.ay[at]) * (e.bx[at] - e.ax[at]) / (e.by[at] - e.ay[at])
    row = e.row[at]
    order = np.lexsort([x, y, row])
    row, y, x = row[order][::2], y[order][::2], x[order]
    # Centres from the first crossing on, up to before the second.
    start = np.maximum(np.ceil(x[::2] - 0.5).astype(np.int64), left[row])
    stop = np.minimum(np.ceil(x[1::2] - 0.5).astype(np.int64) - 1, left[row] + side - 1)
    some = start <= stop
    return row[some], y[some], start[some], stop[some]
