"""Connected components of an edge list: of small groups in one call each, of large ones by label
hooking and pointer jumping."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.plans.session import cut

#: Edges of a slide up to which one call labels it.
WHOLE = 1_000_000
INTEGERS = {"bigint", "int", "smallint", "tinyint"}


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Labels every vertex of ``edges`` with the smallest vertex that it can reach.

    Each round lowers a vertex's label, and that of its label, to the least label among its
    neighbours, then replaces a label by that label's own; the number of rounds grows with
    the logarithm of the longest chain. Every step is a join or a minimum, so a vertex with
    very many edges is pre-aggregated, and nothing is gathered in one place. Each round is
    checkpointed. Edges with a null end are ignored; repeats and loops do no harm; an empty
    list gives an empty result.

    Returns ``vertex, component``.
    """
    one_way = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    both = cut(one_way.unionByName(one_way.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("l")))
    while True:
        far = labels.select(F.col("u").alias("v"), F.col("l").alias("far"))
        seen = both.join(far, "v").groupBy("u").agg(F.min("far").alias("far")).join(labels, "u")
        offers = seen.select(F.explode(F.array("u", "l")).alias("u"), "far").groupBy("u").agg(F.min("far").alias("far"))
        hooked = labels.join(offers, "u", "left").select("u", F.col("l").alias("was"), F.least("l", F.coalesce("far", "l")).alias("l"))
        hooked = cut(hooked)
        jump = hooked.select(F.col("u").alias("l"), F.col("l").alias("next"))
        new = cut(hooked.join(jump, "l").select("u", "was", F.least("l", "next").alias("l")))
        labels = new.select("u", "l")
        if new.where("l < was").limit(1).count() == 0:
            return labels.select(F.col("u").alias("vertex"), F.col("l").alias("component"))


def slide_components(edges: DataFrame, src: str, dst: str, id_col: str, within: tuple[str, ...] = ("slide_id",)) -> DataFrame:
    """``within``, ``id_col`` and ``component`` of every vertex of edges within slides.

    Ids count within their slide; ``component`` is the smallest id of the vertex's component.
    Slides of at most ``WHOLE`` edges are labelled in one call, many to a task; larger ones by
    :func:`connected_components`, whose rounds shuffle edges but hold none together.
    """
    types = dict(edges.dtypes)
    if not {types[src], types[dst]} <= INTEGERS:
        return _by_rounds(edges, src, dst, id_col, within)
    pairs = cut(edges.select(*within, F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b")).where("a is not null and b is not null"))
    small, large = by_size(pairs, within)
    names = [f"k{i}" for i in range(len(within))]

    def labels(rows: pd.DataFrame) -> pd.DataFrame:
        group, ids, root = local_components(rows[names], rows.a.to_numpy(np.int64), rows.b.to_numpy(np.int64))
        out = rows[names].iloc[group].reset_index(drop=True)
        out["id"], out["component"] = ids, root
        return out

    kinds = ", ".join(f"{n} {types[c]}" for n, c in zip(names, within))
    found = map_components(small.select(*[F.col(c).alias(n) for n, c in zip(names, within)], "a", "b"), labels, f"{kinds}, id long, component long", tuple(names))
    near = found.select(*[F.col(n).alias(c) for n, c in zip(names, within)], F.col("id").alias(id_col), "component")
    return near if large is None else near.unionByName(_by_rounds(large, "a", "b", id_col, within))


def _by_rounds(edges: DataFrame, src: str, dst: str, id_col: str, within: tuple[str, ...]) -> DataFrame:
    node = lambda c: F.struct(*within, F.col(c).alias("id"))
    parts = connected_components(edges.select(node(src).alias("src"), node(dst).alias("dst")))
    place = [F.col(f"vertex.{c}").alias(c) for c in within]
    return parts.select(*place, F.col("vertex.id").alias(id_col), F.col("component.id").alias("component"))


def by_size(rows: DataFrame, within: tuple[str, ...]) -> tuple[DataFrame, DataFrame | None]:
    """Rows of groups of at most ``WHOLE`` rows, which a task may hold, and those of larger groups,
    if there are any. ``rows`` are read three times at most, so they should be cut."""
    many = rows.groupBy(*within).agg(F.count("*").alias("_n")).where(F.col("_n") > WHOLE).select(*within)
    if many.isEmpty():
        return rows, None
    many = cut(many)
    alike = [F.col(f"l.`{c}`").eqNullSafe(F.col(f"m.`{c}`")) for c in within]
    part = lambda how: rows.alias("l").join(many.alias("m"), alike, how)
    return part("left_anti"), part("left_semi")


def local_components(groups: pd.DataFrame, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Components of edges in memory, within groups, of which the rows lie together: for every vertex
    a row of its group, its id, and the smallest id that it reaches."""
    new = np.ones(len(groups), bool)
    if len(groups):
        same = np.ones(len(groups) - 1, bool)
        for c in groups.columns:
            codes = pd.factorize(groups[c], use_na_sentinel=False)[0]
            same &= codes[1:] == codes[:-1]
        new[1:] = ~same
    group = np.cumsum(new) - 1
    both, ids = np.concatenate([group, group]), np.concatenate([a, b])
    order = np.lexsort([ids, both])
    fresh = np.ones(len(order), bool)
    fresh[1:] = (np.diff(both[order]) != 0) | (np.diff(ids[order]) != 0)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(fresh) - 1
    own, own_group = ids[order][fresh], both[order][fresh]
    root = roots(len(own), number[: len(a)], number[len(a) :])
    return np.flatnonzero(new)[own_group], own, own[root]


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` vertices the lowest one that it reaches along edges from ``a`` to ``b``."""
    root = np.arange(n)
    while len(a):
        a, b = root[a], root[b]
        apart = a != b
        a, b = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
        np.minimum.at(root, b, a)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def map_components(rows: DataFrame, of_many: Callable[[pd.DataFrame], pd.DataFrame], schema: str, key: tuple[str, ...] = ("slide_id", "component")) -> DataFrame:
    """Applies a function to frames that hold many whole components at once.

    Rows are dealt out and sorted by ``key``; batches are cut where a component ends, so that
    small components share one call. A component is in one task, whole.
    """
    key = list(key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            last = batch[key].iloc[-1]
            open_rows = (batch[key] == last).all(axis=1)
            if open_rows.all() and (not held or (held[-1][key].iloc[-1] == last).all()):
                held.append(batch)
                continue
            if not open_rows.all():
                held.append(batch[~open_rows])
            yield of_many(pd.concat(held))
            held = [batch[open_rows]]
        if held:
            yield of_many(pd.concat(held))

    return rows.repartition(*key).sortWithinPartitions(*key).mapInPandas(run, schema)
