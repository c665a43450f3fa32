"""Links between measured genes and scored samples: group tests, scores and associations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.plans.components import map_components
from tessella.plans.session import cut


def welch(long: DataFrame, group: str = "grp") -> DataFrame:
    """``dim, t`` of Welch's test of each dimension, group 1 against group 0.

    ``long`` has ``grp`` (0 or 1), ``dim`` and ``v``; a dimension without variance has a null.
    """
    side = lambda f, g: f(F.when(F.col(group) == g, F.col("v")))
    s = long.groupBy("dim").agg(*[side(f, g).alias(f"{n}{g}") for g in (0, 1) for n, f in (("m", F.avg), ("s", F.var_samp), ("n", F.count))])
    spread = F.sqrt(F.col("s1") / F.col("n1") + F.col("s0") / F.col("n0"))
    return s.select("dim", ((F.col("m1") - F.col("m0")) / F.nullif(spread, F.lit(0.0))).alias("t"))


def signature_scores(scaled: DataFrame, ranked: DataFrame, n_features: int, key: str = "tile_id") -> DataFrame:
    """Sum of scaled values times weights over the ``n_features`` highest and lowest dimensions.

    ``scaled`` has ``key, dim, v``; ``ranked`` has ``dim, t``. Dimensions are aligned by name.
    """
    up, down = Window.orderBy(F.desc("t"), "dim"), Window.orderBy("t", "dim")
    chosen = ranked.withColumns({"hi": F.row_number().over(up), "lo": F.row_number().over(down)}).where((F.col("hi") <= n_features) | (F.col("lo") <= n_features))
    return scaled.join(F.broadcast(chosen.select("dim", "t")), "dim").groupBy(key).agg(F.sum(F.col("v") * F.col("t")).alias("score"))


#: Ranges that the values of a group are dealt into, to be ranked or compared.
RANGES = 64


def _average_ranks(df: DataFrame, by: list[str], value: str, name: str, ranges: int = RANGES) -> DataFrame:
    """Ranks from 1 with the mean rank for ties.

    Distinct values are dealt into ranges of about as many of them, by quantiles of a sketch, and
    ranked there, from what stands in the ranges before; no group is sorted whole, however its
    values are spread.
    """
    counted = cut(df.groupBy(*by, value).agg(F.count("*").alias("_ties")))
    shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    borders = counted.groupBy(*by).agg(F.percentile_approx(value, shares, 20 * ranges).alias("_borders"))
    bucket = F.size(F.filter("_borders", lambda b: b < F.col(value))).alias("_bucket")
    counted = counted.join(borders, by).select(*by, value, "_ties", bucket)
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.groupBy(*by, "_bucket").agg(F.sum("_ties").alias("_n")).select(*by, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    upto = F.sum("_ties").over(Window.partitionBy(*by, "_bucket").orderBy(value))
    rank = F.col("_first") + F.col("_upto") - (F.col("_ties") - 1) / 2
    ranks = counted.withColumn("_upto", upto).join(starts, [*by, "_bucket"]).select(*by, value, rank.alias(name))
    return df.join(ranks, [*by, value])


def _higher_before(group: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """How many rows before it, in its group, have a higher rank; a group's rows lie together.

    Ranks agree down to some bit, where the higher has a one. So bit by bit, rows that agree above
    lie together in their order, and each with a zero counts the ones before.
    """
    n = len(group)
    found, at = np.zeros(n, np.int64), np.arange(n)
    if not n:
        return found
    new = np.append(True, group[1:] != group[:-1])
    start = np.flatnonzero(new)[np.cumsum(new) - 1]
    for bit in reversed(range(int(rank.max()).bit_length())):
        one = (rank[at] >> bit) & 1
        upto = np.concatenate([[0], np.cumsum(one)])
        size = np.bincount(start, minlength=n)[start]
        before = upto[:-1] - upto[start]
        zeros = size - (upto[start + size] - upto[start])
        found[at] += np.where(one == 1, 0, before)
        to = start + np.where(one == 1, zeros + before, np.arange(n) - start - before)
        moved, begins = np.empty_like(at), np.empty_like(start)
        moved[to], begins[to] = at, start + one * zeros
        at, start = moved, begins
    return found


def _codes(values: pd.Series) -> np.ndarray:
    """Places among the distinct values, in order; NaN is the greatest."""
    return np.unique(values.to_numpy(), return_inverse=True)[1]


def _alike_before(*columns: np.ndarray) -> np.ndarray:
    """How many rows before each are equal to it, in rows sorted by the columns."""
    n = np.arange(len(columns[0]))
    fresh = np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns]))[: len(n)]
    return n - np.maximum.accumulate(np.where(fresh, n, 0))


def _kendall(rows: DataFrame) -> DataFrame:
    """``dim, r``: tau-b of ``v`` and ``score`` in each dimension, in n log n.

    Two samples disagree if the one of the lower ``v`` has the higher ``score``. Both columns are
    dealt into blocks: even ones between quantiles of a sketch, and odd ones that hold a quantile
    itself, however often it comes. Pairs within a block of ``v`` are counted there, further ones
    within a block of ``score`` there, and all others from the sizes of the blocks' meetings. So
    rows are shuffled twice, and a call holds about one in ``RANGES`` of a dimension's rows.
    """
    shares = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
    borders = rows.groupBy("dim").agg(*[F.percentile_approx(c, shares, 20 * RANGES).alias(f"_{c}") for c in ("v", "score")])
    block = lambda c: (2 * F.size(F.filter(f"_{c}", lambda b: b < F.col(c))) + F.array_contains(f"_{c}", F.col(c)).cast("int"))
    dealt = cut(rows.join(F.broadcast(borders), "dim").select("dim", "v", "score", block("v").alias("a"), block("score").alias("b")))
    dim = dict(rows.dtypes)["dim"]

    def sorted_by(part: pd.DataFrame, by: str, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
        own, place = part["dim"].to_numpy(), part[by].to_numpy()
        group = np.cumsum(np.append(True, (own[1:] != own[:-1]) | (place[1:] != place[:-1]))) - 1
        order = np.lexsort([high, low, group])
        return order, group[order], low[order], high[order]

    def within_v(part: pd.DataFrame) -> pd.DataFrame:
        order, group, v, score = sorted_by(part, "a", _codes(part["v"]), _codes(part["score"]))
        counts = {"n": 1, "against": _higher_before(group, score), "rv": _alike_before(group, v), "rv_rs": _alike_before(group, v, score)}
        return part[["dim", "a", "b"]].iloc[order].assign(**counts).groupby(["dim", "a", "b"], as_index=False, sort=False).sum()

    def within_score(part: pd.DataFrame) -> pd.DataFrame:
        codes = _codes(part["score"])
        order, group, a, score = sorted_by(part, "b", part["a"].to_numpy(np.int64), codes)
        ties = np.lexsort([score, group])
        rs = np.empty(len(ties), np.int64)
        rs[ties] = _alike_before(group[ties], score[ties])
        # Rows of equal ``v`` that lie in an even block were counted there.
        counts = {"against": _higher_before(group, score), "rs": rs, "rv_rs": np.where(a % 2 == 1, _alike_before(group, a, score), 0)}
        return part[["dim"]].iloc[order].assign(**counts).groupby("dim", as_index=False, sort=False).sum()

    def between(part: pd.DataFrame) -> pd.DataFrame:
        a, b, n = (part[c].to_numpy(np.int64) for c in ("a", "b", "n"))
        size = np.zeros((2 * RANGES, 2 * RANGES), np.int64)
        size[a, b] = n
        higher = size[:, ::-1].cumsum(1)[:, ::-1] - size
        lower = higher.cumsum(0) - higher
        pairs = lambda k: int((k * (k - 1) // 2).sum())
        odd = slice(1, None, 2)
        told = {"all": pairs(size.sum(keepdims=True)), "against": int((size * lower).sum()), "rv": pairs(size[odd].sum(1)), "rs": pairs(size[:, odd].sum(0)), "rv_rs": pairs(size[odd, odd])}
        return pd.DataFrame({"dim": part["dim"].iloc[:1], **told})

    near = cut(map_components(dealt.where("a % 2 = 0"), within_v, f"dim {dim}, a int, b int, n long, against long, rv long, rv_rs long", ("dim", "a")))
    further = map_components(dealt.where("b % 2 = 0").select("dim", "a", "b", "score"), within_score, f"dim {dim}, against long, rs long, rv_rs long", ("dim", "b"))
    same = dealt.where("a % 2 = 1").groupBy("dim", "a", "b").agg(F.count("*").alias("n"))
    sizes = near.select("dim", "a", "b", "n").unionByName(same).groupBy("dim", "a", "b").agg(F.sum("n").alias("n"))
    others = sizes.groupBy("dim").applyInPandas(between, f"dim {dim}, all long, against long, rv long, rs long, rv_rs long")
    parts = others.unionByName(near.drop("a", "b", "n"), allowMissingColumns=True).unionByName(further, allowMissingColumns=True)
    told = parts.groupBy("dim").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("all", "against", "rv", "rs", "rv_rs")])
    agree = F.col("all") - F.col("rv") - F.col("rs") + F.col("rv_rs") - F.col("against")
    root = F.sqrt((F.col("all") - F.col("rv")).cast("double")) * F.sqrt((F.col("all") - F.col("rs")).cast("double"))
    return told.select("dim", ((agree - F.col("against")) / F.nullif(root, F.lit(0.0))).alias("r"))


def association(genes: DataFrame, scores: DataFrame, method: str = "pearson", key: str = "tile_id") -> DataFrame:
    """``dim, r``: each gene's correlation with the score over samples; ``kendall`` is tau-b.

    ``genes`` has ``key, dim, v``, ``scores`` has ``key, score``; samples are joined by key.
    """
    rows = genes.join(scores.select(key, "score"), key)
    if method == "pearson":
        return rows.groupBy("dim").agg(F.corr("v", "score").alias("r"))
    if method == "spearman":
        rows = cut(rows.select("dim", "v", "score"))
        ranked = _average_ranks(cut(_average_ranks(rows, ["dim"], "v", "rv")), ["dim"], "score", "rs")
        return ranked.groupBy("dim").agg(F.corr("rv", "rs").alias("r"))
    if method == "kendall":
        return _kendall(cut(rows.select("dim", "v", "score").where("v is not null and score is not null")))
    raise ValueError(f"unknown method {method!r}: pearson, spearman or kendall")


def regression(genes: DataFrame, scores: DataFrame, kind: str = "ols", penalty: float = 0.01, key: str = "tile_id") -> DataFrame:
    """``dim, coefficient`` of a linear model of the score on all genes; ``lasso`` with an L1 penalty."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    pairs = F.array_sort(F.collect_list(F.struct("dim", "v")))
    wide = genes.groupBy(key).agg(pairs.alias("p")).join(scores.select(key, F.col("score").alias("label")), key)
    wide = wide.select(array_to_vector(F.transform("p", lambda p: p["v"])).alias("features"), "label")
    model = LinearRegression(regParam=penalty if kind == "lasso" else 0.0, elasticNetParam=1.0 if kind == "lasso" else 0.0, standardization=False).fit(wide)
    dims = genes.select("dim").distinct().withColumn("place", F.row_number().over(Window.orderBy("dim")) - 1)
    values = genes.sparkSession.createDataFrame(list(enumerate(map(float, model.coefficients))), "place int, coefficient double")
    return dims.join(values, "place").select("dim", "coefficient")


def ranked(df: DataFrame, score: str, n: int | None = None, top: bool = True) -> DataFrame:
    """Rows by score with their ``rank`` from 0; the first or last ``n`` of them."""
    by = (F.desc(score) if top else F.asc(score), F.col("dim"))
    # With ``n`` only so many rows are ranked; without, all are in one task: one row a dimension.
    rows = df if n is None else df.orderBy(*by).limit(n)
    return rows.withColumn("rank", (F.row_number().over(Window.orderBy(*by)) - 1).cast("long"))
