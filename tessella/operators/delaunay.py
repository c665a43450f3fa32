"""Delaunay neighbours from local Voronoi cells."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.graph import knn
from tessella.plans.session import bounded_batches, cut, ship_package

#: Sides of a block, and of what it sees around it, as multiples of ``side``.
BLOCK, HALO = 8, 2
#: Nearest points that a cell is cut by at first; cells that reach too far get twice as many.
FIRST = 16
#: How many times a slide's size the bounds are in which cells of points on its outside end.
FAR = 10_000.0
EPS = 1e-9


@dataclass
class Cells:
    """Voronoi cells of many points, each at the origin among others around it: corners ``x, y``
    of which a row has ``n``, and whose edge leads from each to the next (-1 for the bounds)."""

    x: np.ndarray
    y: np.ndarray
    owner: np.ndarray
    n: np.ndarray

    @property
    def real(self) -> np.ndarray:
        return np.arange(self.x.shape[1]) < self.n[:, None]

    @property
    def reach(self) -> np.ndarray:
        """How far each cell's furthest corner is."""
        return np.where(self.real, np.hypot(self.x, self.y), 0).max(axis=1)

    @property
    def ahead(self) -> np.ndarray:
        """The corner that follows each."""
        k = np.arange(self.x.shape[1])
        return np.where(k + 1 < self.n[:, None], k + 1, 0) % self.x.shape[1]


def voronoi_cells(u: np.ndarray, v: np.ndarray, bounds: np.ndarray) -> Cells:
    """The cells, within ``bounds`` (rows of ``x0, y0, x1, y1``), of points with others at ``u, v``:
    a row each, nearest first, NaN behind the last. ``owner`` is the place of another in its row.

    All rows are cut by their nearest, then by the next; one is done when no further one reaches it.
    """
    rows = len(u)
    x, y = bounds[:, [0, 2, 2, 0]].astype(np.float64), bounds[:, [1, 1, 3, 3]].astype(np.float64)
    cells = Cells(x, y, np.full((rows, 4), -1), np.full(rows, 4))
    far = np.hypot(x, y).max(axis=1) if rows else np.zeros(0)
    half = (u * u + v * v) / 2
    active = np.arange(rows)
    for j in range(u.shape[1]):
        active = active[np.sqrt(2 * half[active, j]) < 2 * far[active] * (1 + 1e-9)]
        if not len(active):
            break
        h = half[active, j][:, None]
        side = h - cells.x[active] * u[active, j][:, None] - cells.y[active] * v[active, j][:, None]  # positive on this point's side
        real = np.arange(cells.x.shape[1]) < cells.n[active][:, None]
        hit = ((side < -EPS * h) & real).any(axis=1)
        which, side, h, real = active[hit], side[hit], h[hit], real[hit]
        if not len(which):
            continue
        old = Cells(cells.x[which], cells.y[which], cells.owner[which], cells.n[which])
        to = old.ahead
        keep = side > -EPS * h
        next_side, next_keep = np.take_along_axis(side, to, 1), np.take_along_axis(keep, to, 1)
        crossed = (keep != next_keep) & real
        t = np.where(crossed, side / np.where(crossed, side - next_side, 1), 0)
        own = np.stack([old.owner, np.where(keep, j, old.owner)], axis=2).reshape(len(which), -1)
        at = lambda c: np.stack([c, c + t * (np.take_along_axis(c, to, 1) - c)], axis=2).reshape(len(which), -1)  # noqa: B023, E731
        stay = np.stack([keep & real, crossed], axis=2).reshape(len(which), -1)
        place = np.cumsum(stay, axis=1) - 1
        n = place[:, -1] + 1
        wider = int(n.max()) - cells.x.shape[1]
        if wider > 0:
            more = lambda a: np.pad(a, ((0, 0), (0, wider)))  # noqa: B023, E731
            cells = Cells(more(cells.x), more(cells.y), more(cells.owner), cells.n)
        r, c = np.nonzero(stay)
        for held, new in ((cells.x, at(old.x)), (cells.y, at(old.y)), (cells.owner, own)):
            held[which[r], place[r, c]] = new[r, c]
        cells.n[which] = n
        far[which] = Cells(cells.x[which], cells.y[which], cells.owner[which], n).reach
    return cells


def _edges(cells: Cells, beyond: np.ndarray | None = None) -> np.ndarray:
    """Which of the cells' edges lie between two points; with ``beyond``, those that leave these
    bounds. Cells that meet in a corner alone are no neighbours."""
    to = cells.ahead
    ex, ey = np.take_along_axis(cells.x, to, 1), np.take_along_axis(cells.y, to, 1)
    least = 1e-6 * np.maximum(cells.reach if beyond is None else 1.0, 1.0) * np.ones(len(cells.n))
    edge = cells.real & (cells.owner >= 0) & (np.hypot(ex - cells.x, ey - cells.y) > least[:, None])
    if beyond is not None:
        x0, y0, x1, y1 = (beyond[:, [k]] for k in range(4))
        out = lambda x, y: (x < x0 - least[:, None]) | (x > x1 + least[:, None]) | (y < y0 - least[:, None]) | (y > y1 + least[:, None])
        edge &= out(cells.x, cells.y) | out(ex, ey)
    return edge


def _answer(slide: np.ndarray, ids: np.ndarray, certain: np.ndarray, cells: Cells, edge: np.ndarray, dst: np.ndarray) -> pa.RecordBatch:
    """``dst`` has the ids of each row's others, as ``u, v`` stood."""
    r, c = np.nonzero(edge)
    ends = np.concatenate([[0], np.cumsum(edge.sum(axis=1))]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(dst[r, cells.owner[r, c]], pa.int64()))
    open_cells = (cells.real & (cells.owner < 0)).any(axis=1)
    return pa.RecordBatch.from_pydict({"slide_id": pa.array(slide, pa.int64()), "id": pa.array(ids, pa.int64()), "certain": pa.array(certain), "open": pa.array(open_cells), "dst": lists})


def _sorted(row: np.ndarray, u: np.ndarray, v: np.ndarray, dst: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Others of each row side by side, nearest first; of equally near ones the smallest id first."""
    order = np.lexsort([dst, u * u + v * v, row])
    row = row[order]
    number = np.bincount(row, minlength=rows)
    place = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
    out = [np.full((rows, max(1, int(number.max()) if rows else 1)), np.nan) for _ in range(2)] + [np.zeros((rows, max(1, int(number.max()) if rows else 1)), np.int64)]
    for held, values in zip(out, (u, v, dst)):
        held[row, place] = values[order]
    return tuple(out)


#: Pairs of points that are held side by side at a time.
PAIRS_AT_ONCE = 1 << 20
#: Points of a block's small squares, on average; a point looks at nine of them.
IN_SQUARE = 16


def _block_cells(table: pa.Table, side: int, block: int) -> pa.Table:
    """Cells of a block's own points among all that are there: those of the block and around it."""
    get = lambda c: table.column(c).to_numpy()
    x, y, ids = get("x"), get("y"), get("id")
    left, top = get("gx")[0] * block, get("gy")[0] * block
    own = np.flatnonzero((x >= left) & (x < left + block) & (y >= top) & (y < top + block))
    halo = HALO * side
    square = min(halo, float(np.sqrt(IN_SQUARE * (block + 2 * halo) ** 2 / len(x))))
    sx, sy = np.floor((x - left + halo) / square).astype(np.int64) + 1, np.floor((y - top + halo) / square).astype(np.int64) + 1
    across = int(sy.max()) + 2
    key = sx * across + sy
    order = np.argsort(key, kind="stable")
    key = key[order]
    # Three columns of three squares each, which lie together.
    first = np.stack([np.searchsorted(key, (sx[own] + d) * across + sy[own] - 1) for d in (-1, 0, 1)], axis=1)
    last = np.stack([np.searchsorted(key, (sx[own] + d) * across + sy[own] + 1, "right") for d in (-1, 0, 1)], axis=1)
    size = (last - first).sum(axis=1)
    order_of_size = np.argsort(size, kind="stable")
    own, first, last, size = own[order_of_size], first[order_of_size], last[order_of_size], size[order_of_size]
    bx0, by0, bx1, by1, n = (get(c)[0] for c in ("bx0", "by0", "bx1", "by1", "n"))
    slide, out, at = get("slide_id"), [], 0
    while at < len(own):
        to = min(len(own), at + max(1, PAIRS_AT_ONCE // int(size[at])))
        while to > at + 1 and (to - at) * int(size[to - 1]) > PAIRS_AT_ONCE:
            to = (at + to) // 2
        me = own[at:to]
        number = (last - first)[at:to].ravel()
        other = order[np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number) + np.repeat(first[at:to].ravel(), number)]
        row = np.repeat(np.repeat(np.arange(len(me)), 3), number)
        real = ids[other] != ids[me[row]]
        row, other = row[real], other[real]
        u, v, dst = _sorted(row, x[other] - x[me[row]], y[other] - y[me[row]], ids[other], len(me))
        bounds = np.stack([bx0 - x[me] - 1, by0 - y[me] - 1, bx1 - x[me] + 1, by1 - y[me] + 1], axis=1)
        cells = voronoi_cells(u, v, bounds)
        certain = (np.bincount(row, minlength=len(me)) + 1 >= n) | (2 * cells.reach <= square)
        out.append(_answer(slide[me], ids[me], certain, cells, _edges(cells), dst))
        at = to
    empty = [_answer(slide[:0], ids[:0], np.zeros(0, bool), voronoi_cells(np.zeros((0, 1)), np.zeros((0, 1)), np.zeros((0, 4))), np.zeros((0, 4), bool), np.zeros((0, 1), np.int64))]
    return pa.Table.from_batches(out or empty)


def _cells(batches: Iterator[pa.RecordBatch], outside: bool) -> Iterator[pa.RecordBatch]:
    """``certain, open, dst`` of points with others near them. Inside their slide's bounds, or of
    points on the outside among each other and beyond those bounds."""
    for batch in batches:
        if not batch.num_rows:
            continue
        get = lambda c: batch.column(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
        x, y, ids = get("x"), get("y"), get("id")
        near = batch.column("near")
        others, row = near.flatten(), np.repeat(np.arange(len(x)), near.value_lengths().to_numpy())
        ou, ov, od = (others.field(c).to_numpy(zero_copy_only=False) for c in ("u", "v", "dst"))
        real = od != ids[row]
        row, od = row[real], od[real]
        u, v, dst = _sorted(row, ou[real] - x[row], ov[real] - y[row], od, len(x))
        number = np.bincount(row, minlength=len(x))
        bounds = np.stack([get("bx0") - x - 1, get("by0") - y - 1, get("bx1") - x + 1, get("by1") - y + 1], axis=1)
        if outside:
            far = FAR * np.maximum(np.maximum(get("bx1") - get("bx0"), get("by1") - get("by0")), 1.0)
            cells = voronoi_cells(u, v, np.stack([-far, -far, far, far], axis=1))
            yield _answer(get("slide_id"), ids, np.ones(len(x), bool), cells, _edges(cells, bounds), dst)
            continue
        cells = voronoi_cells(u, v, bounds)
        furthest = np.where(np.isnan(u), 0, np.hypot(u, v)).max(axis=1)
        certain = (get("n") <= number + 1) | ((number > 0) & (2 * cells.reach <= furthest))
        yield _answer(get("slide_id"), ids, certain, cells, _edges(cells), dst)


_SCHEMA = "slide_id long, id long, certain boolean, open boolean, dst array<long>"


def delaunay(points: DataFrame, side: int, first: int = FIRST) -> DataFrame:
    """``slide_id, src, dst``: pairs of ``slide_id, id, x, y`` whose Voronoi cells share an edge, both ways.

    Points are dealt out by blocks of ``BLOCK`` times ``side``, with those that are around a block.
    Within the bounds of the slide, a cell is certain once it reaches no further than half-way
    to what its point can't see; others are cut again by their ``first`` nearest points, then by
    twice as many, so no slide is ever in one task. ``side`` should be about twice the usual
    distance of neighbours. Beyond the bounds only cells that reach them meet, so edges there are
    found among the points of those cells alone, which are few: the outside of a slide. Of
    points at one place the smallest id has the place's neighbours; the others are neighbours
    of that one alone.
    """
    points = cut(points.select("slide_id", "id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))
    places = cut(points.groupBy("slide_id", "x", "y").agg(F.min("id").alias("id")).select("slide_id", "id", "x", "y"))
    bounds = places.groupBy("slide_id").agg(F.min("x").alias("bx0"), F.min("y").alias("by0"), F.max("x").alias("bx1"), F.max("y").alias("by1"), F.count("*").alias("n"))
    bounds = cut(bounds)
    slides, most = bounds.agg(F.count("*"), F.max("n")).first()
    at = places.join(F.broadcast(bounds) if slides <= 100_000 else bounds, "slide_id")
    other = places.select("slide_id", F.col("id").alias("dst"), F.col("x").alias("u"), F.col("y").alias("v"))
    place = F.struct("dst", "u", "v")

    ship_package(points.sparkSession)
    bounded_batches(points.sparkSession)
    block = BLOCK * side
    dealt = lambda c: F.explode(F.sequence(F.floor((F.col(c) - HALO * side) / block), F.floor((F.col(c) + HALO * side) / block)))
    seen = at.withColumn("gx", dealt("x")).withColumn("gy", dealt("y")).groupBy("slide_id", "gx", "gy")
    cells = cut(seen.applyInArrow(lambda table: _block_cells(table, side, block), _SCHEMA))
    k, found = first, [cells.where("certain")]
    open_ids = cells.where("not certain").select("slide_id", F.col("id").alias("src"))
    reaching = []
    while not open_ids.isEmpty():
        near = knn(places, k, side, open_ids)
        lists = near.join(other, ["slide_id", "dst"]).groupBy("slide_id", F.col("src").alias("id")).agg(F.collect_list(place).alias("near"))
        cells = cut(lists.join(at, ["slide_id", "id"]).mapInArrow(lambda rows: _cells(rows, False), _SCHEMA))
        found.append(cells.where("certain"))
        open_ids = cells.where("not certain").select("slide_id", F.col("id").alias("src"))
        if k >= (most or 0):
            break
        k *= 2
    for part in found:
        reaching.append(part.where("open").select("slide_id", "id"))
    edge = reaching[0]
    for part in reaching[1:]:
        edge = edge.unionByName(part)
    edge = cut(edge)
    around = other.join(edge.withColumnRenamed("id", "dst"), ["slide_id", "dst"], "left_semi").groupBy("slide_id").agg(F.collect_list(place).alias("near"))
    found.append(edge.join(at, ["slide_id", "id"]).join(around, "slide_id").mapInArrow(lambda rows: _cells(rows, True), _SCHEMA))
    pairs = points.join(places.withColumnRenamed("id", "dst"), ["slide_id", "x", "y"]).where("id <> dst").select("slide_id", F.col("id").alias("src"), "dst")
    for part in found:
        pairs = pairs.unionByName(part.select("slide_id", F.col("id").alias("src"), F.explode("dst").alias("dst")))
    pairs = cut(pairs)
    return pairs.unionByName(pairs.select("slide_id", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
