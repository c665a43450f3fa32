"""Filters that need a pixel's surroundings: chunks of pixels with their neighbours' borders.

A pixel goes to its own chunk and, near a border, to the chunks that see it: 1.3 copies on
average at a reach of 8, where a copy for every window that holds it would be 289. A filter then
runs on arrays: of one large chunk, or of many small ones side by side, so that small pictures
share a call, and a task holds an Arrow batch, a chunk and a band of windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.plans.session import ship_package

#: Side of a chunk, without its halo, and values of windows that are sorted at once.
SIDE, AT_ONCE = 128, 4_000_000


def filtered(pixels: DataFrame, reach: int, of: Callable[[np.ndarray], np.ndarray], side: int = SIDE) -> DataFrame:
    """``image_id, y, x, v``: a filter's value at each pixel, from those at most ``reach`` away.

    ``of`` gets a chunk as doubles with ``reach`` more on each side, NaN where there is no pixel
    or its value is null, and gives the chunk's inner part; NaN becomes null. Images may have
    holes. A pixel has one row; of several, any value is taken and each row is returned.
    """
    ship_package(pixels.sparkSession)
    side = max(side, 2 * reach)
    chunk = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach) / side), F.floor((F.col(c) + reach) / side)))
    rows = pixels.select("image_id", F.col("y").cast("long"), F.col("x").cast("long"), F.col("v").cast("double").alias("v"))
    dealt = rows.withColumn("cy", chunk("y")).withColumn("cx", chunk("x"))

    def made(table: pa.Table, starts: np.ndarray) -> list[pa.RecordBatch]:
        y, x, v, cy, cx = (table.column(c).to_numpy() for c in ("y", "x", "v", "cy", "cx"))
        dy, dx = y - cy * side + reach, x - cx * side + reach
        own = (dy >= reach) & (dx >= reach) & (dy < side + reach) & (dx < side + reach)
        group = np.searchsorted(starts, np.arange(len(y)), "right") - 1
        # A picture that is smaller than a chunk isn't padded to one.
        high, wide = (np.minimum(np.maximum.reduceat(d, starts) + 1 - reach, side) for d in (dy, dx))
        value = np.full(len(y), np.nan)
        for pack, left in _packs(np.flatnonzero(np.logical_or.reduceat(own, starts)), high, wide, reach):
            place = np.full(len(starts), -1)
            place[pack] = left
            rows = np.flatnonzero(place[group] >= 0)
            at = place[group[rows]] + dx[rows]
            held = np.full((high[pack].max() + 2 * reach, left[-1] + wide[pack[-1]] + 2 * reach), np.nan)
            held[dy[rows], at] = v[rows]
            inner = own[rows]
            value[rows[inner]] = of(held)[dy[rows][inner] - reach, at[inner] - reach]
        kept = table.select(["image_id", "y", "x"]).append_column("v", pa.array(value, pa.float64(), from_pandas=True)).filter(pa.array(own))
        return kept.combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held).combine_chunks()
            starts = _begins(table)
            if len(starts) > 1:
                yield from made(table.slice(0, int(starts[-1])), starts[:-1])
                held = table.slice(int(starts[-1])).to_batches()
        if held and sum(b.num_rows for b in held):
            table = pa.Table.from_batches(held).combine_chunks()
            yield from made(table, _begins(table))

    schema = T.StructType([*rows.schema.fields[:3], T.StructField("v", T.DoubleType())])
    key = ("image_id", "cy", "cx")
    return dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, schema)


def _begins(table: pa.Table) -> np.ndarray:
    """Where each chunk begins, in rows sorted by chunk."""
    if not table.num_rows:
        return np.zeros(0, np.int64)
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for c in ("image_id", "cy", "cx"):
        codes = table.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _packs(groups: np.ndarray, high: np.ndarray, wide: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunks that are laid side by side, each with its own halo, and where each begins. Those of a
    pack are alike in height; windows along a pack are at most ``AT_ONCE`` values."""
    kind = np.ceil(np.log2(high[groups].astype(float)))
    for k in np.unique(kind):
        alike = groups[kind == k]
        full = wide[alike] + 2 * reach
        most = max(1, AT_ONCE // max((2 * reach + 1) ** 2, int(high[alike].max()) + 2 * reach))
        ends = np.cumsum(full)
        number = (ends - full) // most
        for pack in np.split(np.arange(len(alike)), np.flatnonzero(np.diff(number)) + 1):
            yield alike[pack], (ends - full)[pack] - (ends - full)[pack[0]]


def _sorted_windows(held: np.ndarray, reach: int, offsets: list[tuple[int, int]], of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """``of`` the sorted values, NaN last, at ``offsets`` from each inner pixel, band by band."""
    high, wide = (n - 2 * reach for n in held.shape)
    band = max(1, AT_ONCE // (len(offsets) * wide))
    made = np.empty((high, wide))
    for top in range(0, high, band):
        rows = min(band, high - top)
        seen = np.stack([held[top + reach + dy : top + reach + dy + rows, reach + dx : reach + dx + wide] for dy, dx in offsets], axis=-1)
        seen.sort(axis=-1)
        made[top : top + rows] = of(seen)
    return made


def _median_of_sorted(seen: np.ndarray) -> np.ndarray:
    n = (~np.isnan(seen)).sum(axis=-1)[..., None]
    low, high = (np.take_along_axis(seen, np.maximum(i, 0), axis=-1)[..., 0] for i in ((n - 1) // 2, n // 2))
    return np.where(n[..., 0] > 0, (low + high) / 2, np.nan)


def _entropy_of_sorted(seen: np.ndarray) -> np.ndarray:
    """In bits; a value's k-th occurrence adds k log k - (k-1) log (k-1) to the sum of c log c."""
    k = np.arange(1, seen.shape[-1] + 1, dtype=np.float64)
    parts = k * np.log2(k)
    step = np.concatenate([[0.0, 0.0], np.diff(parts)])
    place, total = np.ones(seen.shape[:-1], np.int64), np.zeros(seen.shape[:-1])
    for i in range(1, seen.shape[-1]):
        place = np.where(seen[..., i] == seen[..., i - 1], place + 1, 1)
        total += step[place]
    n = (~np.isnan(seen)).sum(axis=-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n > 0, np.log2(n) - total / n, np.nan)


def median(pixels: DataFrame, k: int) -> DataFrame:
    """Median over the k x k window, of the values that exist; of an even number, the middle's mean."""
    r = k // 2
    window = [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1)]
    return filtered(pixels, r, lambda held: _sorted_windows(held, r, window, _median_of_sorted))


def entropy(pixels: DataFrame, radius: int) -> DataFrame:
    """Entropy, in bits, of the values that exist within ``radius`` of each pixel."""
    reach = range(-radius, radius + 1)
    disk = [(dy, dx) for dy in reach for dx in reach if dy * dy + dx * dx <= radius * radius]
    return filtered(pixels, radius, lambda held: _sorted_windows(held, radius, disk, _entropy_of_sorted))


def weighted_mean(pixels: DataFrame, weights: list[float]) -> DataFrame:
    """Mean along rows, then along columns, of the values that exist, by ``weights`` of a window."""
    r = len(weights) // 2

    def means(held: np.ndarray) -> np.ndarray:
        there = ~np.isnan(held)
        for axis in (1, 0):
            n = held.shape[axis] - 2 * r
            cut = [(slice(None), slice(i, i + n)) if axis == 1 else (slice(i, i + n),) for i in range(2 * r + 1)]
            of = sum(w * there[c] for w, c in zip(weights, cut))
            total = sum(w * np.where(there[c], held[c], 0.0) for w, c in zip(weights, cut))
            with np.errstate(invalid="ignore"):
                # Rows are averaged at pixels that exist, as columns then need them.
                there = there[cut[r]]
                held = np.where(there if axis == 1 else of > 0, total / of, np.nan)
        return held

    return filtered(pixels, r, means)
