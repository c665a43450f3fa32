"""Planar geometry of many polygons at once, on flat arrays: what Arrow functions and tasks call.

A batch has rows; a row has rings, closed ones (areas, with holes) or open ones (lines, points).
Nothing here compares one row with another, and memory grows with what is in a batch.

* :func:`meets` tests boundaries edge by edge and, where none meet, whether one lies in the other.
* :func:`slabs` cuts the plane of each row at the heights of all corners and crossings. Between two
  such heights edges don't cross, so sorting them by place and adding up their directions tells how
  often each region winds around every trapezoid. Areas of any combination are sums of trapezoids,
  and :func:`outlined` walks along the borders of those that are kept.
* :func:`widened` lists the pieces (strips along edges, pies at corners) whose union with a polygon
  is all within a distance of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Share of the greatest coordinate below which two places are one.
CLOSE = 1e-9
#: Pairs of edges that are looked at in one go.
PAIRS_AT_ONCE = 1 << 21
#: Segments that stand for a quarter of a circle around a corner.
QUARTER = 16
#: Rows that are united at a time, and edges of a row up to which its buffer is made in one go.
FAN, FEW_EDGES = 8, 64

POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
RING = pa.list_(POINT)
PART = pa.struct([("ring", RING), ("holes", pa.list_(RING))])
PARTS = pa.list_(PART)


@dataclass
class Outlines:
    """Rings of many rows: points ``x, y``, where each ring ends, and the row that owns it."""

    x: np.ndarray
    y: np.ndarray
    ends: np.ndarray
    owner: np.ndarray
    rows: int

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.ends)

    @property
    def closed(self) -> np.ndarray:
        """Rings that bound an area: of four points or more, the last the first again."""
        first, last = self.ends[:-1], self.ends[1:] - 1
        some = self.sizes >= 4
        out = np.zeros(len(self.owner), bool)
        out[some] = (self.x[first[some]] == self.x[last[some]]) & (self.y[first[some]] == self.y[last[some]])
        return out


@dataclass
class Edges:
    ax: np.ndarray
    ay: np.ndarray
    bx: np.ndarray
    by: np.ndarray
    row: np.ndarray

    def __len__(self) -> int:
        return len(self.row)

    def __getitem__(self, which) -> "Edges":
        return Edges(*(a[which] for a in (self.ax, self.ay, self.bx, self.by, self.row)))

    @staticmethod
    def of(*many: "Edges") -> "Edges":
        return Edges(*(np.concatenate([getattr(e, c) for e in many]) for c in ("ax", "ay", "bx", "by", "row")))


def lists(array: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Values of all lists and how many each has; a null list has none."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    return array.flatten(), array.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def outlines(ring: pa.Array, holes: pa.Array | None = None) -> Outlines:
    """Outlines of Arrow columns of rings, and of lists of rings."""
    points, sizes = lists(ring)
    xs, ys, all_sizes, owners = [points], [points], [sizes], [np.arange(len(sizes))]
    if holes is not None:
        rings, counts = lists(holes)
        inner, inner_sizes = lists(rings)
        xs.append(inner)
        ys.append(inner)
        all_sizes.append(inner_sizes)
        owners.append(np.repeat(np.arange(len(counts)), counts))
    number = lambda parts, c: np.concatenate([p.field(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for p in parts])
    ends = np.concatenate([[0], np.cumsum(np.concatenate(all_sizes))])
    return Outlines(number(xs, "x"), number(ys, "y"), ends, np.concatenate(owners), len(sizes))


def outline_areas(o: Outlines) -> np.ndarray:
    """Signed area of each ring, as the sum over its points."""
    if not len(o.x):
        return np.zeros(len(o.owner))
    first = np.repeat(o.ends[:-1], o.sizes)
    px, py = o.x - o.x[first], o.y - o.y[first]
    inside = np.append(px[:-1] * py[1:] - px[1:] * py[:-1], 0.0)
    last = o.ends[1:][o.sizes > 0] - 1
    inside[last] = 0.0
    return np.bincount(np.repeat(np.arange(len(o.owner)), o.sizes), inside, len(o.owner)) / 2


def boxed(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> Outlines:
    """Boxes as outlines."""
    x, y = np.stack([x0, x1, x1, x0, x0], axis=1).ravel(), np.stack([y0, y0, y1, y1, y0], axis=1).ravel()
    return Outlines(x.astype(float), y.astype(float), np.arange(len(x0) + 1) * 5, np.arange(len(x0)), len(x0))


def edges_of(o: Outlines, areas_only: bool = False) -> Edges:
    """Edges of all rings; a ring of one point is an edge from it to itself."""
    keep = o.sizes > 0
    if areas_only:
        keep = o.closed
    starts, sizes, owner = o.ends[:-1][keep], o.sizes[keep], o.owner[keep]
    number = np.maximum(sizes - 1, 1)
    at = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number) + np.repeat(starts, number)
    to = np.minimum(at + 1, np.repeat(starts + sizes - 1, number))
    return Edges(o.x[at], o.y[at], o.x[to], o.y[to], np.repeat(owner, number))


def _near(a: Edges, b: Edges, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of edges of ``a`` and ``b`` in one row whose bounds meet, so many at a time.

    Edges of ``b`` lie sorted by row and lower end; an edge of ``a`` looks at those that begin no
    further below it than the row's longest reaches.
    """
    if not len(a) or not len(b):
        return
    low = lambda e: np.minimum(e.ay, e.by)
    high = lambda e: np.maximum(e.ay, e.by)
    least, most, tallest = np.full(rows, np.inf), np.full(rows, -np.inf), np.zeros(rows)
    for e in (a, b):
        np.minimum.at(least, e.row, low(e))
        np.maximum.at(most, e.row, high(e))
    np.maximum.at(tallest, b.row, high(b) - low(b))
    least, span = np.where(np.isfinite(least), least, 0), np.where(np.isfinite(most), most - np.where(np.isfinite(least), least, 0), 0)
    base = np.concatenate([[0], np.cumsum(span + tallest + 1)])[:-1]
    margin = 1e-9 * (1 + base[-1] + span[-1])
    shifted = lambda e, y: y - least[e.row] + base[e.row]
    order = np.argsort(shifted(b, low(b)), kind="stable")
    starts = shifted(b, low(b))[order]
    first = np.searchsorted(starts, shifted(a, low(a)) - tallest[a.row] - margin)
    last = np.searchsorted(starts, shifted(a, high(a)) + margin, "right")
    number = np.maximum(last - first, 0)
    ends = np.cumsum(number)
    at = 0
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
        n = number[at:to]
        i = np.repeat(np.arange(at, to), n)
        j = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at:to], n)]
        p, q = a[i], b[j]
        meet = (p.row == q.row) & (high(p) >= low(q)) & (high(q) >= low(p))
        meet &= (np.maximum(p.ax, p.bx) >= np.minimum(q.ax, q.bx)) & (np.maximum(q.ax, q.bx) >= np.minimum(p.ax, p.bx))
        yield i[meet], j[meet]
        at = to


def _side(ax, ay, bx, by, px, py) -> np.ndarray:
    """On which side of the line from a to b a point is: 1, -1, or 0 on it."""
    return np.sign((bx - ax) * (py - ay) - (by - ay) * (px - ax))


def _in_areas(x: np.ndarray, y: np.ndarray, row: np.ndarray, e: Edges, rows: int) -> np.ndarray:
    """Whether points, at most one a row, are inside of their row's rings: an odd number of edges to the right."""
    at = np.full(rows, -1)
    at[row] = np.arange(len(row))
    k = at[e.row]
    e, k = e[k >= 0], k[k >= 0]
    px, py = x[k], y[k]
    spans = (e.ay > py) != (e.by > py)
    crossed = np.zeros(len(e), bool)
    with np.errstate(divide="ignore", invalid="ignore"):
        crossed[spans] = (px < e.ax + (py - e.ay) * (e.bx - e.ax) / (e.by - e.ay))[spans]
    return np.bincount(k[crossed], minlength=len(x)) % 2 == 1


def meets(a: Outlines, b: Outlines) -> np.ndarray:
    """For each row whether the two shapes have a point in common; borders belong to shapes.

    A shape is all its rings of one row: an area with holes, a line, or a point.
    """
    out = np.zeros(a.rows, bool)
    ea, eb = edges_of(a), edges_of(b)
    # Edges beyond the other shape's bounds can't touch it.
    ea_near, eb_near = _within(ea, eb, a.rows), _within(eb, ea, a.rows)
    for i, j in _near(ea_near, eb_near, a.rows):
        p, q = ea_near[i], eb_near[j]
        s1, s2 = _side(p.ax, p.ay, p.bx, p.by, q.ax, q.ay), _side(p.ax, p.ay, p.bx, p.by, q.bx, q.by)
        s3, s4 = _side(q.ax, q.ay, q.bx, q.by, p.ax, p.ay), _side(q.ax, q.ay, q.bx, q.by, p.bx, p.by)
        # Bounds meet, so edges on one line, and points on an edge, touch.
        out[p.row[(s1 * s2 <= 0) & (s3 * s4 <= 0)]] = True
    for one, other in ((a, b), (b, a)):
        first = np.flatnonzero(one.sizes > 0)
        rows, at = np.unique(one.owner[first], return_index=True)
        at = one.ends[first[at]]
        open_rows = ~out[rows]
        rows, at = rows[open_rows], at[open_rows]
        out[rows] |= _in_areas(one.x[at], one.y[at], rows, edges_of(other, areas_only=True), a.rows)
    return out


def _within(e: Edges, other: Edges, rows: int) -> Edges:
    """Edges that reach the bounds of the other shape of their row."""
    keep = np.ones(len(e), bool)
    for lo, hi, olo, ohi in ((np.minimum(e.ax, e.bx), np.maximum(e.ax, e.bx), np.minimum(other.ax, other.bx), np.maximum(other.ax, other.bx)), (np.minimum(e.ay, e.by), np.maximum(e.ay, e.by), np.minimum(other.ay, other.by), np.maximum(other.ay, other.by))):
        least, most = np.full(rows, np.inf), np.full(rows, -np.inf)
        np.minimum.at(least, other.row, olo)
        np.maximum.at(most, other.row, ohi)
        keep &= (hi >= least[e.row]) & (lo <= most[e.row])
    return e[keep]


@dataclass
class Slabs:
    """Edges within slabs, sorted by slab and place. Between place k and k + 1 of one slab lies a
    trapezoid, around which the two groups wind ``winds[0][k]`` and ``winds[1][k]`` times."""

    row: np.ndarray
    level: np.ndarray
    heights: np.ndarray
    below: np.ndarray
    above: np.ndarray
    winds: tuple[np.ndarray, np.ndarray]
    close: float

    @property
    def inner(self) -> np.ndarray:
        """Places that a trapezoid follows."""
        return np.append(self.level[1:] == self.level[:-1], False) if len(self.level) else np.zeros(0, bool)


Rule = Callable[[np.ndarray], np.ndarray]
#: How windings tell the inside: any, an odd number, or more than none.
NONZERO: Rule = lambda w: w != 0
ODD: Rule = lambda w: w % 2 != 0
POSITIVE: Rule = lambda w: w > 0


def slabs(e: Edges, group: np.ndarray, rows: int) -> Slabs:
    """Slabs of closed rings of two groups, 0 and 1, of each row."""
    close = CLOSE * max(1.0, *(float(np.abs(v).max()) if len(v) else 0.0 for v in (e.ax, e.ay)))
    slanted = e.ay != e.by
    e, group = e[slanted], group[slanted]
    up = e.ay < e.by
    turn = np.where(up, -1, 1)  # counted from the left, so that rings around their left wind once
    e = Edges(np.where(up, e.ax, e.bx), np.where(up, e.ay, e.by), np.where(up, e.bx, e.ax), np.where(up, e.by, e.ay), e.row)
    cross_row, cross_y = [np.zeros(0, np.int64)], [np.zeros(0)]
    for i, j in _near(e, e, rows):
        i, j = i[i < j], j[i < j]
        p, q = e[i], e[j]
        rx, ry, sx, sy = p.bx - p.ax, p.by - p.ay, q.bx - q.ax, q.by - q.ay
        turned = rx * sy - ry * sx
        with np.errstate(divide="ignore", invalid="ignore"):
            t = ((q.ax - p.ax) * sy - (q.ay - p.ay) * sx) / turned
            u = ((q.ax - p.ax) * ry - (q.ay - p.ay) * rx) / turned
            hit = (turned != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1)
            cross_y.append((p.ay + t * ry)[hit])
        cross_row.append(p.row[hit])
    n = len(e)
    crossings = np.concatenate(cross_y)
    ys, of_row = np.concatenate([e.ay, e.by, crossings]), np.concatenate([e.row, e.row, *cross_row])
    order = np.lexsort([ys, of_row])
    new = np.ones(len(ys), bool)
    new[1:] = (np.diff(of_row[order]) != 0) | (np.diff(ys[order]) > close)
    number = np.empty(len(ys), np.int64)
    number[order] = np.cumsum(new) - 1
    # A height is a corner's where there is one.
    heights = ys[order][new]
    heights[number[: 2 * n][::-1]] = ys[: 2 * n][::-1]
    lower, upper = number[:n], number[n : 2 * n]
    spans = upper - lower
    at = np.repeat(np.arange(n), spans)
    level = np.arange(spans.sum()) - np.repeat(np.cumsum(spans) - spans, spans) + np.repeat(lower, spans)
    slope = np.divide(e.bx - e.ax, e.by - e.ay, out=np.zeros(n), where=e.by > e.ay)
    place = lambda h: e.ax[at] + (heights[h] - e.ay[at]) * slope[at]
    below = np.where(level == lower[at], e.ax[at], place(level))
    above = np.where(level + 1 == upper[at], e.bx[at], place(np.minimum(level + 1, len(heights) - 1)))
    order = np.lexsort([below + above, level])
    at, level = at[order], level[order]
    winds = tuple(np.cumsum(np.where(group[at] == g, turn[at], 0)) for g in (0, 1))
    return Slabs(e.row[at], level, heights, below[order], above[order], winds, close)


def areas(s: Slabs, keep: np.ndarray, rows: int) -> np.ndarray:
    """Area of the trapezoids to keep, by row."""
    k = np.flatnonzero(s.inner & keep)
    wide = (s.below[k + 1] - s.below[k]) + (s.above[k + 1] - s.above[k])
    return np.bincount(s.row[k], wide / 2 * (s.heights[s.level[k] + 1] - s.heights[s.level[k]]), rows).astype(float)


def _filled(s: Slabs, keep: np.ndarray) -> np.ndarray:
    """``keep``, where a trapezoid without a width goes with the one before it."""
    inner = s.inner
    k = np.arange(len(keep))
    ahead = np.minimum(k + 1, max(len(k) - 1, 0))
    flat = inner & (np.abs(s.below[ahead] - s.below) <= s.close) & (np.abs(s.above[ahead] - s.above) <= s.close)
    real = inner & ~flat
    last = np.maximum.accumulate(np.where(real, k, -1)) if len(k) else k
    known = (last >= 0) & (s.level[np.maximum(last, 0)] == s.level) if len(k) else np.zeros(0, bool)
    return np.where(flat, known & keep[np.maximum(last, 0)] if len(k) else False, keep & real)


@dataclass
class Rings:
    """Closed rings without the repeated point: corners, where each ends, and its row. Areas are
    to the left, so that outer rings have a positive area and holes a negative one."""

    x: np.ndarray
    y: np.ndarray
    ends: np.ndarray
    row: np.ndarray


def outlined(s: Slabs, keep: np.ndarray) -> Rings:
    """The borders of the trapezoids to keep."""
    keep = _filled(s, keep)
    before = np.concatenate([[False], keep[:-1]]) & np.concatenate([[False], s.inner[:-1]]) if len(keep) else keep
    left = np.flatnonzero(keep & ~before)
    # A stretch of kept trapezoids ends one place behind its last.
    ahead = np.append(keep[1:], False) if len(keep) else keep
    right = np.flatnonzero(keep & ~ahead) + 1
    if not len(left):
        return Rings(np.zeros(0), np.zeros(0), np.zeros(1, np.int64), np.zeros(0, np.int64))
    n = len(left)
    level = np.concatenate([s.level[left], s.level[left], s.level[left] + 1, s.level[left] + 1])
    x = np.concatenate([s.below[left], s.below[right], s.above[left], s.above[right]])
    order = np.lexsort([x, level])
    new = np.ones(len(x), bool)
    new[1:] = (np.diff(level[order]) != 0) | (np.diff(x[order]) > s.close)
    node = np.empty(len(x), np.int64)
    node[order] = np.cumsum(new) - 1
    node_x, node_level = x[order][new], level[order][new]
    node_row = np.empty(len(node_x), np.int64)
    node_row[node] = np.tile(s.row[left], 4)
    lower_left, lower_right, upper_left, upper_right = node[:n], node[n : 2 * n], node[2 * n : 3 * n], node[3 * n :]
    # Along a height: what is kept above it less what is kept below it.
    change = np.zeros(len(node_x), np.int64)
    for where, by in ((lower_left, 1), (lower_right, -1), (upper_left, -1), (upper_right, 1)):
        np.add.at(change, where, by)
    along = np.cumsum(change)
    east, west = np.flatnonzero(along > 0), np.flatnonzero(along < 0)
    source = np.concatenate([lower_right, upper_left, east, west + 1])
    target = np.concatenate([upper_right, lower_left, east + 1, west])
    return _chained(source, target, node_x, s.heights[node_level], node_row, s.close)


def _chained(source: np.ndarray, target: np.ndarray, x: np.ndarray, y: np.ndarray, row: np.ndarray, close: float) -> Rings:
    """Rings along directed sides; where ways part, the one furthest to the left is taken."""
    order = np.argsort(source, kind="stable")
    source, target = source[order], target[order]
    first = np.searchsorted(source, target)
    ways = np.searchsorted(source, target, "right") - first
    follow = first.copy()
    parting = np.flatnonzero(ways > 1)
    if len(parting):
        k = np.repeat(parting, ways[parting])
        begins = np.cumsum(ways[parting]) - ways[parting]
        out = np.arange(len(k)) - np.repeat(begins, ways[parting]) + first[k]
        u, v, w = source[k], target[k], target[out]
        dx, dy, ex, ey = x[v] - x[u], y[v] - y[u], x[w] - x[v], y[w] - y[v]
        angle = np.arctan2(dx * ey - dy * ex, dx * ex + dy * ey)
        best = np.lexsort([out, -angle, k])[begins]
        follow[parting] = out[best]
    seen = bytearray(len(source))
    walk, sizes = [], []
    following = follow.tolist()
    for start in range(len(source)):
        if seen[start]:
            continue
        k, before = start, len(walk)
        while not seen[k]:
            seen[k] = 1
            walk.append(k)
            k = following[k]
        sizes.append(len(walk) - before)
    nodes = source[np.array(walk, np.int64)]
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return _begun(_corners(Rings(x[nodes], y[nodes], ends, row[nodes[ends[:-1]]]), close))


def _taken(r: Rings, point: np.ndarray, ring: np.ndarray) -> Rings:
    """Some points of some rings, in their order."""
    of_ring = np.repeat(np.arange(len(r.row)), np.diff(r.ends))
    point = point & ring[of_ring]
    sizes = np.bincount(of_ring[point], minlength=len(r.row))[ring]
    return Rings(r.x[point], r.y[point], np.concatenate([[0], np.cumsum(sizes)]), r.row[ring])


def _rolled(r: Rings, first: np.ndarray) -> Rings:
    """Rings that begin at the points ``first``."""
    number, starts = np.diff(r.ends), r.ends[:-1]
    since = np.arange(len(r.x)) - np.repeat(starts, number)
    at = np.repeat(starts, number) + (since + np.repeat(first - starts, number)) % np.repeat(number, number)
    return Rings(r.x[at], r.y[at], r.ends, r.row)


def _begun(r: Rings) -> Rings:
    """Rings that begin at their lowest ``x``, then ``y``."""
    of_ring = np.repeat(np.arange(len(r.row)), np.diff(r.ends))
    return _rolled(r, np.lexsort([r.y, r.x, of_ring])[r.ends[:-1]]) if len(r.row) else r


def _off(r: Rings, close: float) -> np.ndarray:
    """Each point's distance from the line through its neighbours, positive where the ring turns left."""
    number, starts = np.diff(r.ends), r.ends[:-1]
    at = np.arange(len(r.x))
    base, count = np.repeat(starts, number), np.repeat(number, number)
    before, after = base + (at - base - 1) % count, base + (at - base + 1) % count
    px, py, qx, qy = r.x[before], r.y[before], r.x[after], r.y[after]
    return ((r.x - px) * (qy - r.y) - (r.y - py) * (qx - r.x)) / np.maximum(np.hypot(qx - px, qy - py), close)


def _corners(r: Rings, close: float) -> Rings:
    """Rings of the points at which they turn; those of fewer than three go."""
    done: list[Rings] = []
    while len(r.row):
        number = np.diff(r.ends)
        if (number < 3).any():
            r = _taken(r, np.ones(len(r.x), bool), number >= 3)
            continue
        bend = np.abs(_off(r, close)) > 2 * close
        whole = np.logical_and.reduceat(bend, r.ends[:-1])
        done.append(_taken(r, np.ones(len(r.x), bool), whole))
        of_ring = np.repeat(~whole, number)
        r, bend = _taken(r, np.ones(len(r.x), bool), ~whole), bend[of_ring]
        if not len(r.row):
            break
        # Of a stretch of straight points every second goes at a time, so never two neighbours.
        number, starts, at = np.diff(r.ends), r.ends[:-1], np.arange(len(r.x))
        first = np.minimum.reduceat(np.where(bend, at, len(at)), starts)
        first = np.where(first < len(at), first, starts)
        turned = Rings(bend.astype(float), r.y, r.ends, r.row)
        r, bend = _rolled(r, first), _rolled(turned, first).x > 0
        since = at - np.maximum.accumulate(np.where(bend, at, np.repeat(starts, number)))
        r = _taken(r, bend | (since % 2 == 0), np.ones(len(r.row), bool))
    return joined(*done) if done else Rings(np.zeros(0), np.zeros(0), np.zeros(1, np.int64), np.zeros(0, np.int64))


def joined(*many: Rings) -> Rings:
    """All rings of several."""
    sizes = np.concatenate([np.diff(r.ends) for r in many])
    return Rings(*(np.concatenate([getattr(r, c) for r in many]) for c in ("x", "y")), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), np.concatenate([r.row for r in many]))


def ring_areas(r: Rings) -> np.ndarray:
    """Signed areas."""
    if not len(r.row):
        return np.zeros(0)
    starts = r.ends[:-1]
    number = np.diff(r.ends)
    after = np.arange(len(r.x)) + 1
    after[r.ends[1:] - 1] = starts
    x0, y0 = np.repeat(r.x[starts], number), np.repeat(r.y[starts], number)
    px, py, qx, qy = r.x - x0, r.y - y0, r.x[after] - x0, r.y[after] - y0
    return np.add.reduceat(px * qy - qx * py, starts) / 2


def parts_of(r: Rings, rows: int) -> pa.Array:
    """Rings as parts (an outer ring and its holes), by row, in Arrow. Parts of a row come by their
    first corner, so do holes."""
    size = ring_areas(r)
    outer = np.flatnonzero(size > 0)
    inner = np.flatnonzero(size < 0)
    corner = lambda k: (r.x[r.ends[k]], r.y[r.ends[k]])
    outer = outer[np.lexsort([r.y[r.ends[outer]], r.x[r.ends[outer]], r.row[outer]])]
    if not len(inner):
        return _parts_array(r, outer, np.zeros(len(outer), np.int64), inner, rows)
    of_row: dict[int, list[int]] = {}
    for k in outer.tolist():
        of_row.setdefault(int(r.row[k]), []).append(k)
    held: dict[int, list[int]] = {}
    for h in sorted(inner.tolist(), key=corner):
        candidates = of_row.get(int(r.row[h]), [])
        if len(candidates) > 1:
            px, py = _just_inside(r, h)
            candidates = [k for k in candidates if size[k] > -size[h] and _in_ring(r, k, px, py)] or candidates
        if candidates:
            held.setdefault(min(candidates, key=lambda k: size[k]), []).append(h)
    hole_counts, hole_rings = [], []
    for k in outer.tolist():
        holes = held.get(k, [])
        hole_rings += holes
        hole_counts.append(len(holes))
    return _parts_array(r, outer, np.array(hole_counts, np.int64), np.array(hole_rings, np.int64), rows)


def _parts_array(r: Rings, outer: np.ndarray, hole_counts: np.ndarray, hole_rings: np.ndarray, rows: int) -> pa.Array:
    ring_column = _ring_array(r, outer)
    holes_column = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(hole_counts)]), pa.int32()), _ring_array(r, hole_rings))
    parts = pa.StructArray.from_arrays([ring_column, holes_column], fields=list(PART))
    counts = np.bincount(r.row[outer], minlength=rows) if len(outer) else np.zeros(rows, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), parts)


def _ring_array(r: Rings, which: np.ndarray) -> pa.Array:
    """Closed rings, the first point repeated."""
    first = r.ends[which]
    size = r.ends[which + 1] - first + 1
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    since = np.arange(ends[-1]) - np.repeat(ends[:-1], size)
    flat = np.repeat(first, size) + since % np.repeat(size - 1, size)
    points = pa.StructArray.from_arrays([pa.array(r.x[flat] + 0.0), pa.array(r.y[flat] + 0.0)], fields=list(POINT))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), points)


def _just_inside(r: Rings, k: int) -> tuple[float, float]:
    """A point within a hole, beside the middle of its longest side."""
    x, y = r.x[r.ends[k] : r.ends[k + 1]], r.y[r.ends[k] : r.ends[k + 1]]
    dx, dy = np.roll(x, -1) - x, np.roll(y, -1) - y
    i = int(np.hypot(dx, dy).argmax())
    step = 1e-6 / float(np.hypot(dx[i], dy[i]))
    return x[i] + dx[i] / 2 + dy[i] * step, y[i] + dy[i] / 2 - dx[i] * step


def _in_ring(r: Rings, k: int, px: float, py: float) -> bool:
    x, y = r.x[r.ends[k] : r.ends[k + 1]], r.y[r.ends[k] : r.ends[k + 1]]
    qx, qy = np.roll(x, -1), np.roll(y, -1)
    spans = (y > py) != (qy > py)
    return bool((px < x[spans] + (py - y[spans]) * (qx[spans] - x[spans]) / (qy[spans] - y[spans])).sum() % 2)


def oriented(o: Outlines) -> tuple[Edges, np.ndarray]:
    """Edges of closed rings, turned so that outer rings wind once around their area, and holes
    back; and for each edge the one that follows it in its ring.

    The first closed ring of a row is its outer one, others are holes.
    """
    closed = np.flatnonzero(o.closed)
    edges = edges_of(o, areas_only=True)
    if not len(closed):
        return edges, np.zeros(0, np.int64)
    number = o.sizes[closed] - 1
    starts = np.cumsum(number) - number
    x0, y0 = np.repeat(edges.ax[starts], number), np.repeat(edges.ay[starts], number)
    size = np.add.reduceat((edges.ax - x0) * (edges.by - y0) - (edges.bx - x0) * (edges.ay - y0), starts)
    _, first = np.unique(o.owner[closed], return_index=True)
    want = np.full(len(closed), -1)
    want[first] = 1
    turn = np.repeat(np.sign(size) * want < 0, number)
    swap = lambda p, q: np.where(turn, q, p)
    at = np.arange(len(edges))
    base, count = np.repeat(starts, number), np.repeat(number, number)
    after = base + (at - base + np.where(turn, -1, 1)) % count
    return Edges(swap(edges.ax, edges.bx), swap(edges.ay, edges.by), swap(edges.bx, edges.ax), swap(edges.by, edges.ay), edges.row), after


def widened(e: Edges, distance: float, after: np.ndarray) -> tuple[Edges, np.ndarray]:
    """Edges of pieces that lie within ``distance`` of edges, on their right: a strip along each, and
    a pie at each corner that turns left; and the number of each edge's piece. ``after`` is the
    edge that follows each. For ``distance`` below zero, pieces lie on the left.

    Arcs run along a circle in steps of at most a quarter over ``QUARTER``. All pieces wind once
    around their area.
    """
    d = abs(distance)
    sign = 1.0 if distance > 0 else -1.0
    dx, dy = e.bx - e.ax, e.by - e.ay
    long = np.hypot(dx, dy)
    real = long > 0
    nx, ny = np.where(real, sign * dy / np.where(real, long, 1), 0), np.where(real, -sign * dx / np.where(real, long, 1), 0)
    out, piece = [], []
    # Strips: along the edge and back at the distance; to the right that winds once.
    corners = [(e.ax, e.ay), (e.ax + d * nx, e.ay + d * ny), (e.bx + d * nx, e.by + d * ny), (e.bx, e.by)]
    if sign < 0:
        corners = corners[::-1]
    for (px, py), (qx, qy) in zip(corners, corners[1:] + corners[:1]):
        out.append(Edges(px[real], py[real], qx[real], qy[real], e.row[real]))
        piece.append(np.flatnonzero(real))
    # Pies: from the strip's end to the start of the next strip.
    k = np.flatnonzero(real & real[after])
    turned = np.arctan2(nx[k] * ny[after[k]] - ny[k] * nx[after[k]], nx[k] * nx[after[k]] + ny[k] * ny[after[k]])
    bends = turned * sign > 1e-12
    k, turned = k[bends], turned[bends]
    steps = np.maximum(1, np.floor(np.abs(turned) / (np.pi / 2 / QUARTER) + 0.5).astype(np.int64))
    if len(k):
        at = np.repeat(np.arange(len(k)), steps)
        i = np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps)
        angle = np.arctan2(ny[k], nx[k])
        begin, end = angle[at] + turned[at] * i / steps[at], angle[at] + turned[at] * (i + 1) / steps[at]
        cx, cy, row = e.bx[k][at], e.by[k][at], e.row[k][at]
        arc = (cx + d * np.cos(begin), cy + d * np.sin(begin), cx + d * np.cos(end), cy + d * np.sin(end))
        # The ends of an arc are the ends of strips, to the last bit.
        firsts, lasts = i == 0, i == steps[at] - 1
        for c, (p, n) in enumerate(((cx, nx), (cy, ny))):
            arc[c][firsts] = (p + d * n[k][at])[firsts]
            arc[c + 2][lasts] = (p + d * n[after[k]][at])[lasts]
        spokes = [Edges(e.bx[k], e.by[k], e.bx[k] + d * nx[k], e.by[k] + d * ny[k], e.row[k]), Edges(e.bx[k] + d * nx[after[k]], e.by[k] + d * ny[after[k]], e.bx[k], e.by[k], e.row[k])]
        pies = Edges.of(Edges(*arc, row), *spokes)
        if sign < 0:
            pies = Edges(pies.bx, pies.by, pies.ax, pies.ay, pies.row)
        out.append(pies)
        piece.append(len(e) + np.concatenate([k[at], k, k]))
    return Edges.of(*out), np.concatenate(piece)


def simple(o: Outlines) -> Rings:
    """Borders of what the outer rings wind around, without what their holes wind around."""
    plain, o = _convex(o)
    if not o.closed.any():
        return plain
    closed = o.closed
    _, first = np.unique(o.owner[closed], return_index=True)
    hole = np.ones(int(closed.sum()), np.int64)
    hole[first] = 0
    s = slabs(oriented(o)[0], np.repeat(hole, o.sizes[closed] - 1), o.rows)
    return joined(plain, outlined(s, NONZERO(s.winds[0]) & ~NONZERO(s.winds[1])))


def _left_only(r: Rings, close: float) -> np.ndarray:
    """Rings that turn left at every point, by more than places that are one, and wind once."""
    number, starts = np.diff(r.ends), r.ends[:-1]
    e, after = rings_as_edges(r)
    dx, dy = e.bx - e.ax, e.by - e.ay
    turned = np.arctan2(dx * dy[after] - dy * dx[after], dx * dx[after] + dy * dy[after])
    bends = (_off(r, close) > 4 * close) & (np.hypot(dx, dy) > 4 * close)
    return np.logical_and.reduceat(bends, starts) & (np.abs(np.add.reduceat(turned, starts) - 2 * np.pi) < 1e-6) & (number >= 3)


def _convex(o: Outlines) -> tuple[Rings, Outlines]:
    """Rings of rows that have but one, a convex one, which is its own border; and the other rows."""
    one = o.closed & (np.bincount(o.owner, minlength=o.rows) == 1)[o.owner]
    if not one.any():
        return Rings(np.zeros(0), np.zeros(0), np.zeros(1, np.int64), np.zeros(0, np.int64)), o
    close = CLOSE * max(1.0, float(np.abs(o.x).max()), float(np.abs(o.y).max()))
    size = np.where(one, o.sizes - 1, 0)
    ends = np.concatenate([[0], np.cumsum(size[one])])
    at = np.arange(ends[-1]) - np.repeat(ends[:-1], size[one]) + np.repeat(o.ends[:-1][one], size[one])
    r = Rings(o.x[at], o.y[at], ends, o.owner[one])
    back = np.repeat(ring_areas(r) < 0, size[one])
    mirror = np.repeat(ends[:-1] + ends[1:] - 1, size[one]) - np.arange(ends[-1])
    turn = np.where(back, mirror, np.arange(ends[-1]))
    r = Rings(r.x[turn], r.y[turn], ends, r.row)
    convex = _left_only(r, close)
    rest = np.ones(len(o.owner), bool)
    rest[np.flatnonzero(one)[convex]] = False
    keep = np.repeat(rest, o.sizes)
    others = Outlines(o.x[keep], o.y[keep], np.concatenate([[0], np.cumsum(o.sizes[rest])]), o.owner[rest], o.rows)
    return _begun(_taken(r, np.ones(len(r.x), bool), convex)), others


def _rounded(r: Rings, distance: float) -> Rings:
    """Convex rings widened: an arc around each corner, from one side's direction to the next's."""
    e, after = rings_as_edges(r)
    at = np.arange(len(r.x))
    before = np.empty(len(at), np.int64)
    before[after] = at
    way = np.arctan2(-(e.bx - e.ax), e.by - e.ay)  # of the normal on the right
    dx, dy = e.bx - e.ax, e.by - e.ay
    turned = np.arctan2(dx[before] * dy - dy[before] * dx, dx[before] * dx + dy[before] * dy)
    steps = np.maximum(1, np.floor(turned / (np.pi / 2 / QUARTER) + 0.5).astype(np.int64))
    k = np.repeat(at, steps + 1)
    i = np.arange(len(k)) - np.repeat(np.cumsum(steps + 1) - steps - 1, steps + 1)
    angle = way[before][k] + turned[k] * i / steps[k]
    ends = np.concatenate([[0], np.cumsum(np.add.reduceat(steps + 1, r.ends[:-1]))])
    return _begun(Rings(r.x[k] + distance * np.cos(angle), r.y[k] + distance * np.sin(angle), ends, r.row))


def buffered(r: Rings, distance: float, rows: int) -> Rings:
    """Outlines of all within ``distance`` of simple areas, or for one below zero, of what is
    further from their borders.

    Of rows with many edges, pieces are united first, those close to one another with each other.
    """
    if not distance or not len(r.row):
        return r
    if distance > 0:
        close = CLOSE * max(1.0, float(np.abs(r.x).max()), float(np.abs(r.y).max()))
        alone = (np.bincount(r.row, minlength=rows) == 1)[r.row] & _left_only(r, close)
        if alone.any() and distance > 1e3 * close:
            points = np.ones(len(r.x), bool)
            return joined(_corners(_rounded(_taken(r, points, alone), distance), close), buffered_any(_taken(r, points, ~alone), distance, rows))
    return buffered_any(r, distance, rows)


def buffered_any(r: Rings, distance: float, rows: int) -> Rings:
    """:func:`buffered`, by pieces that are united."""
    if not len(r.row):
        return r
    e, after = rings_as_edges(r)
    pieces, piece = widened(e, distance, after)
    many = np.bincount(e.row, minlength=rows) > FEW_EDGES
    large = many[pieces.row]
    if large.any():
        used, unit = np.unique(piece[large], return_inverse=True)
        of_piece = np.zeros(len(used), np.int64)
        of_piece[unit] = pieces.row[large]
        own = pieces[large]
        own.row = unit
        together, _ = rings_as_edges(united(outlined_union(own, len(used)), of_piece, rows))
        pieces = Edges.of(pieces[~large], together)
    group = np.repeat([0, 0 if distance > 0 else 1], [len(e), len(pieces)])
    s = slabs(Edges.of(e, pieces), group, rows)
    return outlined(s, POSITIVE(s.winds[0]) if distance > 0 else POSITIVE(s.winds[0]) & ~NONZERO(s.winds[1]))


def outlined_union(e: Edges, rows: int) -> Rings:
    """Borders of what rings that run around their left cover, by row."""
    s = slabs(e, np.zeros(len(e), np.int64), rows)
    return outlined(s, POSITIVE(s.winds[0]))


def united(r: Rings, group: np.ndarray, groups: int) -> Rings:
    """Borders of the union of the areas of all rows of a group; ``group`` is that of each row.

    Rows that are close to one another are united by ``FAN`` at a time, so that few edges are
    left when distant ones meet.
    """
    while True:
        units = len(group)
        size = np.bincount(group, minlength=groups)
        x, y = np.full(units, np.inf), np.full(units, np.inf)
        of_point = np.repeat(r.row, np.diff(r.ends))
        np.minimum.at(x, of_point, r.x)
        np.minimum.at(y, of_point, r.y)
        order = np.lexsort([_along(x, y), group])
        place = np.empty(units, np.int64)
        place[order] = np.arange(units) - np.repeat(np.cumsum(size) - size, size)
        share = -(-size // FAN)
        first = np.cumsum(share) - share
        unit = first[group] + place // FAN
        e, _ = rings_as_edges(r)
        e.row = unit[e.row]
        r = outlined_union(e, int(share.sum()))
        if (share <= 1).all():
            r.row = np.flatnonzero(share)[r.row]
            return r
        group = np.repeat(np.arange(groups), share)


def _along(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places on a curve that keeps neighbours together: the bits of both coordinates in turns."""
    out = np.zeros(len(x), np.int64)
    for shift, c in ((0, x), (1, y)):
        fine = np.isfinite(c)
        low, high = (c[fine].min(), c[fine].max()) if fine.any() else (0.0, 1.0)
        scaled = np.where(fine, (np.where(fine, c, low) - low) / max(high - low, 1e-300) * ((1 << 20) - 1), 0).astype(np.int64)
        for bit in range(20):
            out |= (scaled >> bit & 1) << (2 * bit + shift)
    return out


def rings_as_edges(r: Rings) -> tuple[Edges, np.ndarray]:
    """Edges of rings, and the one that follows each."""
    after = np.arange(len(r.x)) + 1
    after[r.ends[1:] - 1] = r.ends[:-1]
    return Edges(r.x, r.y, r.x[after], r.y[after], np.repeat(r.row, np.diff(r.ends))), after
