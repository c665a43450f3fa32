"""Communities of a neighbour graph by modularity: of small slides in one call each, of large ones
in rounds of joins."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.plans.components import INTEGERS, by_size, map_components, roots, slide_components
from tessella.plans.session import written

#: A gain below this is none, so that rounding doesn't move anything.
LEAST_GAIN = 1e-9


def modularity(matrix: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """``slide_id, q`` of a symmetric matrix ``slide_id, u, v, a`` and labels ``slide_id, u, c``."""
    other = labels.withColumnsRenamed({"u": "v", "c": "cv"})
    inside = F.sum(F.when(F.col("c") == F.col("cv"), F.col("a")).otherwise(0.0))
    part = matrix.join(labels, ["slide_id", "u"]).join(other, ["slide_id", "v"]).groupBy("slide_id", "c").agg(F.sum("a").alias("total"), inside.alias("inside"))
    share = F.col("inside") / F.col("m2") - resolution * F.pow(F.col("total") / F.col("m2"), 2)
    whole = part.groupBy("slide_id").agg(F.sum("total").alias("m2"))
    return part.join(whole, "slide_id").groupBy("slide_id").agg(F.sum(share).alias("q"))


def _proposals(matrix: DataFrame, degrees: DataFrame, labels: DataFrame, resolution: float, seed: int) -> DataFrame:
    """``slide_id, u, to``: the neighbouring community that a vertex gains most by moving to."""
    own = labels.join(degrees, ["slide_id", "u"])
    sizes = own.groupBy("slide_id", "c").agg(F.sum("k").alias("total"), F.count("*").alias("n"))
    linked = matrix.where("u <> v").join(labels.withColumnsRenamed({"u": "v"}), ["slide_id", "v"]).select("slide_id", "u", "c", "a")
    linked = linked.unionByName(labels.withColumn("a", F.lit(0.0))).groupBy("slide_id", "u", "c").agg(F.sum("a").alias("a"))
    rows = linked.join(sizes, ["slide_id", "c"]).join(own.withColumnRenamed("c", "at"), ["slide_id", "u"])
    stays = F.col("c") == F.col("at")
    gain = F.col("a") - resolution * F.col("k") * (F.col("total") - F.when(stays, F.col("k")).otherwise(0.0)) / F.col("m2")
    order = F.struct(F.round("gain", 9).alias("gain"), F.xxhash64(F.lit(seed), "c").alias("tie"), "c", "n")
    chosen = rows.withColumn("gain", gain).groupBy("slide_id", "u", "at").agg(F.max(F.when(~stays, order)).alias("best"), F.max(F.when(stays, F.col("gain"))).alias("here"), F.max(F.when(stays, F.col("n"))).alias("n"))
    # Two vertices that are alone don't swap places: the one with the greater label moves.
    apart = (F.col("n") > 1) | (F.col("best.n") > 1) | (F.col("best.c") < F.col("at"))
    return chosen.where((F.col("best.gain") > F.col("here") + LEAST_GAIN) & apart).select("slide_id", "u", F.col("best.c").alias("to"))


def _moved(matrix: DataFrame, resolution: float, seed: int) -> DataFrame:
    """Labels ``slide_id, u, c`` after rounds of moves, from every vertex on its own.

    In a round a seeded half of the vertices moves at once; a slide whose modularity that doesn't
    raise keeps its labels and draws another half. After three draws that help no slide, one
    vertex of each slide moves, which helps. It ends when no vertex wants to move.
    """
    degrees = matrix.groupBy("slide_id", F.col("u")).agg(F.sum("a").alias("k"))
    degrees = written(degrees.join(degrees.groupBy("slide_id").agg(F.sum("k").alias("m2")), "slide_id"))
    labels = written(degrees.select("slide_id", "u", F.col("u").alias("c")))
    best = written(modularity(matrix, labels, resolution))
    idle = step = 0
    while idle < 4:
        wanted = written(_proposals(matrix, degrees, labels, resolution, seed))
        if wanted.isEmpty():
            break
        draw = F.xxhash64(F.lit(seed), F.lit(step), "slide_id", "u")
        if idle < 3:
            movers = wanted.where(F.pmod(draw, F.lit(2)) == 0)
        else:
            movers = wanted.join(wanted.groupBy("slide_id").agg(F.min_by("u", draw).alias("u")), ["slide_id", "u"], "left_semi")
        step += 1
        new = written(labels.join(movers, ["slide_id", "u"], "left").select("slide_id", "u", "c", F.coalesce("to", "c").alias("new")))
        q = written(modularity(matrix, new.select("slide_id", "u", F.col("new").alias("c")), resolution).join(best.withColumnRenamed("q", "was"), "slide_id").withColumn("better", F.col("q") > F.col("was") + LEAST_GAIN))
        if q.where("better").isEmpty():
            idle += 1
            continue
        idle = 0
        labels = written(new.join(q.select("slide_id", "better"), "slide_id").select("slide_id", "u", F.when(F.col("better"), F.col("new")).otherwise(F.col("c")).alias("c")))
        best = written(q.select("slide_id", F.greatest("q", "was").alias("q")))
    return labels


def _near_by(u: np.ndarray, v: np.ndarray, a: np.ndarray, n: int, resolution: float, rng: np.random.Generator) -> np.ndarray:
    """A community of each of ``n`` vertices of a symmetric matrix, after moves of one at a time."""
    order = np.argsort(u, kind="stable")
    degree = np.bincount(u, a, n)
    whole = degree.sum()
    ends, to, weight = np.searchsorted(u[order], np.arange(n + 1)).tolist(), v[order].tolist(), a[order].tolist()
    k, total, label = degree.tolist(), degree.tolist(), list(range(n))
    turns, waiting = deque(rng.permutation(n).tolist()), [True] * n
    while turns:
        i = turns.popleft()
        waiting[i] = False
        own, near = label[i], {label[i]: 0.0}
        for e in range(ends[i], ends[i + 1]):
            if to[e] != i:
                near[label[to[e]]] = near.get(label[to[e]], 0.0) + weight[e]
        gain = lambda c: near[c] - resolution * k[i] * (total[c] - (k[i] if c == own else 0.0)) / whole
        best = max(near, key=lambda c: (round(gain(c), 9), -c))
        if best == own or gain(best) <= gain(own) + LEAST_GAIN:
            continue
        total[own] -= k[i]
        total[best] += k[i]
        label[i] = best
        for e in range(ends[i], ends[i + 1]):
            j = to[e]
            if label[j] != best and not waiting[j]:
                waiting[j] = True
                turns.append(j)
    return np.array(label, np.int64)


def _of_one(u: np.ndarray, v: np.ndarray, a: np.ndarray, resolution: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Vertices of a symmetric matrix and the smallest of each one's community."""
    ids, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = ends[: len(u)], ends[len(u) :]
    found, n, rng = np.arange(len(ids)), len(ids), np.random.default_rng(seed)
    while True:
        label = _near_by(u, v, a, n, resolution, rng)
        inside = label[u] == label[v]
        # Parts that don't hang together are communities of their own.
        merged, part = np.unique(roots(n, u[inside], v[inside]), return_inverse=True)
        if len(merged) == n:
            break
        found, n = part[found], len(merged)
        pair, of = np.unique(part[u] * n + part[v], return_inverse=True)
        u, v, a = pair // n, pair % n, np.bincount(of, a, len(pair))
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, found, ids)
    return ids, least[found]


def communities(edges: DataFrame, resolution: float = 1.0, seed: int = 7) -> DataFrame:
    """``slide_id, id, community`` of the ends of edges ``slide_id, src, dst, w``.

    Vertices move to the neighbouring community that raises modularity most; communities are
    split where they don't hang together, become the vertices of a smaller graph, and move
    again, until nothing merges. Every step is a join or a sum, so hubs are pre-aggregated and
    no graph is gathered anywhere; each round is written out and read again (sizes that
    Spark would guess from the joins of all rounds have no bound), and ties are seeded.

    Edges count in both directions, repeats add up; those with a null end or without a positive
    weight are ignored. ``community`` is its smallest id. An empty list gives an empty result.
    """
    one_way = edges.where("src is not null and dst is not null and w > 0").select("slide_id", F.col("src").alias("u"), F.col("dst").alias("v"), F.col("w").cast("double").alias("a"))
    both = one_way.unionByName(one_way.select("slide_id", F.col("v").alias("u"), F.col("u").alias("v"), "a"))
    types = dict(both.dtypes)
    matrix = written(both.groupBy("slide_id", "u", "v").agg(F.sum("a").alias("a")))
    if not {types["u"], types["v"]} <= INTEGERS:
        return _by_rounds(matrix, resolution, seed)
    small, large = by_size(matrix, ("slide_id",))

    def of_slides(rows: pd.DataFrame) -> pd.DataFrame:
        starts = np.flatnonzero(np.append(True, rows["slide_id"].to_numpy()[1:] != rows["slide_id"].to_numpy()[:-1]))
        out = []
        for at, end in zip(starts, [*starts[1:], len(rows)]):
            own = rows.iloc[at:end]
            ids, community = _of_one(own["u"].to_numpy(np.int64), own["v"].to_numpy(np.int64), own["a"].to_numpy(), resolution, seed)
            out.append(pd.DataFrame({"slide_id": own["slide_id"].iloc[0], "id": ids, "community": community}))
        return pd.concat(out)

    near = map_components(small.where("slide_id is not null"), of_slides, f"slide_id {types['slide_id']}, id {types['u']}, community {types['u']}", ("slide_id",))
    return near if large is None else near.unionByName(_by_rounds(large, resolution, seed))


def _by_rounds(matrix: DataFrame, resolution: float, seed: int) -> DataFrame:
    """Communities of large slides, in rounds of joins."""
    found = written(matrix.select("slide_id", F.col("u").alias("id"), F.col("u").alias("c")).distinct())
    while True:
        labels = _moved(matrix, resolution, seed)
        if labels.where("u <> c").isEmpty():
            break
        ends = labels.withColumnsRenamed({"u": "v", "c": "cv"})
        within = matrix.where("u < v").join(labels, ["slide_id", "u"]).join(ends, ["slide_id", "v"]).where("c = cv")
        parts = slide_components(within.select("slide_id", "u", "v"), "u", "v", "u")
        labels = written(labels.join(parts, ["slide_id", "u"], "left").select("slide_id", "u", F.coalesce("component", "u").alias("c")))
        found = written(found.join(labels.select("slide_id", F.col("u").alias("c"), F.col("c").alias("to")), ["slide_id", "c"]).select("slide_id", "id", F.col("to").alias("c")))
        ends = labels.withColumnsRenamed({"u": "v", "c": "cv"})
        merged = matrix.join(labels, ["slide_id", "u"]).join(ends, ["slide_id", "v"]).groupBy("slide_id", F.col("c").alias("u"), F.col("cv").alias("v"))
        matrix = written(merged.agg(F.sum("a").alias("a")))
    least = found.groupBy("slide_id", "c").agg(F.min("id").alias("community"))
    return found.join(least, ["slide_id", "c"]).select("slide_id", "id", "community")


def numbered_by_size(found: DataFrame) -> DataFrame:
    """``slide_id, id, domain``: a slide's communities counted from 0, the largest first."""
    sizes = found.groupBy("slide_id", "community").agg(F.count("*").alias("n"))
    order = Window.partitionBy("slide_id").orderBy(F.desc("n"), "community")
    ranked = sizes.select("slide_id", "community", (F.row_number().over(order) - 1).alias("domain"))
    return found.join(ranked, ["slide_id", "community"]).select("slide_id", "id", "domain")
