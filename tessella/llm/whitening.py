"""Whitening of vectors by the leading components of their covariance, by Jacobi-Davidson.

The covariance V is never formed. What is asked for is its product with a block of vectors: each
partition centres its rows, multiplies them with the block, and multiplies the result with the
rows again; partial products are summed in tasks first. The driver holds blocks of as many
rows as the vectors have dimensions.

1. Entries become integers, and the fit list is each distinct vector once. Sums are exact, so
   rows are centred without rounding: n*x - S is an integer.
2. Rayleigh-Ritz: the covariance within a subspace gives Ritz pairs. Those whose residual is
   down to double precision are locked.
3. Each pair that isn't gets a correction from the projected equation
   (I - QQ')(V - theta I)(I - QQ') t = -r, Q being all wanted pairs, solved roughly by a few
   steps of MINRES. The steps of all equations go together, so each is one distributed product.
4. Corrections widen the subspace. A full subspace is cut back to its best pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.plans.session import bounded_batches, ship_package, table, written

#: Entries are read in this many parts of one, and moved by this much (fixed by the contract).
PARTS, MOVED = 64, 1_000_000
#: Entries beyond this size, in parts, count as that size: sums stay within 64 bits.
MOST_PARTS = 1 << 40
COMPONENTS = 16
#: Steps of MINRES for a correction, and how many blocks a subspace holds before it is cut back.
INNER_STEPS, MOST_BLOCKS = 3, 6
#: A residual is down to double precision below this share of the greatest eigenvalue; if
#: rounding stops it earlier, it may be this much at most.
PRECISION, STALLED = 2e-14, 1e-10
#: Eigenvalues below this share of the greatest are zero up to rounding.
RANK_PRECISION = 1e-12
SEED = 11


def _floored(id_col: str, vector_col: str):
    """``vec_id`` and ``x``, the integers packed; rows with a missing or non-finite entry go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(vector_col)
            rows = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
            packed, kept = [], []
            if len(rows):
                values = vectors.flatten()
                lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.concatenate([[0], np.cumsum(lengths)])
                c = values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null is a NaN
                good = np.concatenate([[0], np.cumsum(np.isfinite(c))])
                with np.errstate(invalid="ignore"):
                    x = (np.clip(np.floor(PARTS * np.where(np.isfinite(c), c, 0)), -MOST_PARTS, MOST_PARTS) + MOVED).astype("<i8")
                for i in rows[(good[ends[rows + 1]] - good[ends[rows]] == lengths[rows]) & (lengths[rows] > 0)].tolist():
                    kept.append(i)
                    packed.append(x[ends[i] : ends[i + 1]].tobytes())
            if kept:
                yield pa.RecordBatch.from_pydict({"vec_id": batch.column(id_col).take(pa.array(kept)), "x": pa.array(packed, pa.binary())})

    return run


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, x`` of the rows whose vector is whole: ``x`` is the packed integers floor(64c) + 10^6."""
    ship_package(vectors.sparkSession)
    bounded_batches(vectors.sparkSession)
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("vector"))
    return rows.mapInArrow(_floored("vec_id", "vector"), "vec_id long, x binary")


def _matrix(batch: pa.RecordBatch, column: str = "x") -> np.ndarray:
    blocks = batch.column(column).to_pylist()
    return np.frombuffer(b"".join(blocks), "<i8").reshape(len(blocks), -1)


def _summed(rows: DataFrame, part_of: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None], kind: str, tasks: int) -> np.ndarray:
    """Sum of the arrays that ``part_of`` makes of each partition, in two steps.

    So many ``tasks`` sum the arrays, and the driver the few that these give.
    """

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = part_of(batches)
        if part is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part.astype(kind).tobytes()], pa.binary())})

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from parts_summed(b for batch in batches for b in batch.column("part").to_pylist())

    def parts_summed(blocks: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in blocks:
            part = np.frombuffer(b, kind)
            total = part.copy() if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([total.tobytes()], pa.binary())})

    got = rows.mapInArrow(parts, "part binary").repartition(tasks).mapInArrow(sums, "part binary").collect()
    return sum(np.frombuffer(r.part, kind) for r in got)


@dataclass
class Centre:
    """The fit list's number of vectors and sums; centres rows exactly."""

    n: int
    sums: np.ndarray

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n*x - S, in integers."""
        whole, rest = np.divmod(self.sums, self.n)
        return (x - whole) * self.n - rest

    def of(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(x) / self.n


def covariance_times(fit: DataFrame, centre: Centre, tasks: int) -> Callable[[np.ndarray], tuple[np.ndarray, float]]:
    """The product of the covariance with a block of vectors, and its trace."""
    spark = fit.sparkSession

    def times(block: np.ndarray) -> tuple[np.ndarray, float]:
        sent = spark.sparkContext.broadcast(block)

        def part_of(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
            u, total, squares = sent.value, None, 0.0
            for batch in batches:
                if batch.num_rows:
                    c = centre.of(_matrix(batch))
                    product = c.T @ (c @ u)
                    total = product if total is None else total + product
                    squares += float((c * c).sum())
            return None if total is None else np.append(total.ravel(), squares)

        done = _summed(fit, part_of, "<f8", tasks)
        sent.unpersist()
        return done[:-1].reshape(block.shape) / centre.n, float(done[-1]) / centre.n

    return times


def _orthonormal(new: np.ndarray, *to: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``new`` adds to orthonormal blocks; projected twice."""
    for _ in range(2):
        for q in to:
            new = new - q @ (q.T @ new)
        sizes = np.linalg.norm(new, axis=0)
        new = new[:, sizes > 1e-300] / sizes[sizes > 1e-300]
        if not new.shape[1]:
            return new
        q, r = np.linalg.qr(new)
        new = q[:, np.abs(np.diag(r)) > 1e-10]
    return new


def minres(times: Callable[[np.ndarray], np.ndarray], b: np.ndarray, steps: int) -> np.ndarray:
    """``steps`` steps of MINRES for many right sides at once; ``times`` works on all columns."""
    x = np.zeros_like(b)
    beta = np.linalg.norm(b, axis=0)
    safe = lambda a: np.where(np.abs(a) > 1e-300, a, 1.0)
    v_old, v = np.zeros_like(b), b / safe(beta)
    w_old, w = np.zeros_like(b), np.zeros_like(b)
    eta, beta_old = beta.copy(), np.zeros_like(beta)
    c_old, c, s_old, s = np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    for _ in range(steps):
        a = times(v)
        alpha = (v * a).sum(axis=0)
        a = a - alpha * v - beta_old * v_old
        next_beta = np.linalg.norm(a, axis=0)
        # Two earlier rotations, then a new one, on the next column of the tridiagonal matrix.
        r3, r2 = s_old * beta_old, s * alpha + c * c_old * beta_old
        r1_bar = c * alpha - s * c_old * beta_old
        r1 = np.hypot(r1_bar, next_beta)
        c_new, s_new = r1_bar / safe(r1), next_beta / safe(r1)
        w_new = (v - r3 * w_old - r2 * w) / safe(r1)
        x = x + c_new * eta * w_new
        eta = -s_new * eta
        v_old, v = v, a / safe(next_beta)
        w_old, w, c_old, c, s_old, s, beta_old = w, w_new, c, c_new, s, s_new, next_beta
        if (np.abs(next_beta) < 1e-300).all():
            break
    return x


@dataclass
class Eigenpairs:
    """Falling eigenvalues, unit vectors as columns, their residuals, and the covariance's trace."""

    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    trace: float
    products: int


def jacobi_davidson(times: Callable[[np.ndarray], tuple[np.ndarray, float]], dimensions: int, wanted: int) -> Eigenpairs:
    """The greatest eigenpairs of a symmetric matrix that is known by its products."""
    wanted = min(wanted, dimensions)
    rng = np.random.default_rng(SEED)
    basis = _orthonormal(rng.standard_normal((dimensions, min(wanted + 4, dimensions))))
    image, trace = times(basis)
    products, least, stalled = 1, np.inf, 0
    while True:
        inner = basis.T @ image
        theta, s = np.linalg.eigh((inner + inner.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        u, image_u = basis @ s[:, :wanted], image @ s[:, :wanted]
        residual = image_u - u * theta[:wanted]
        sizes = np.linalg.norm(residual, axis=0)
        top = max(abs(theta[0]), 1e-300)
        locked = sizes <= PRECISION * top
        whole = basis.shape[1] == dimensions
        stalled = stalled + 1 if sizes.max() > least / 2 and sizes.max() <= STALLED * top else 0
        least = min(least, sizes.max())
        if locked.all() or whole or stalled >= 2:
            break
        # All wanted pairs are projected out: the locked ones stay as they are.
        shift, q = theta[:wanted][~locked], u
        project = lambda t: t - q @ (q.T @ t)

        def equation(t: np.ndarray) -> np.ndarray:
            nonlocal products
            products += 1
            t = project(t)
            return project(times(t)[0] - shift * t)

        corrections = minres(equation, -project(residual[:, ~locked]), INNER_STEPS)
        if basis.shape[1] + corrections.shape[1] > max(MOST_BLOCKS * wanted, 2 * wanted + 4) and basis.shape[1] > 2 * wanted:
            keep = s[:, : 2 * wanted]
            basis, image = basis @ keep, image @ keep
        new = _orthonormal(corrections, basis)
        if new.shape[1] == 0:
            break
        products += 1
        basis, image = np.hstack([basis, new]), np.hstack([image, times(new)[0]])
    # Either sign will do: the greatest entry is positive.
    sign = np.sign(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])])
    real = theta[:wanted] > RANK_PRECISION * top
    if not (sizes[real] <= STALLED * top).all():
        raise ArithmeticError(f"residuals stay above {STALLED * top}: {sizes}")
    return Eigenpairs(theta[:wanted][real], (u * sign)[:, real], sizes[real], trace, products)


def _whitened(centre: Centre, components: np.ndarray):
    dimensions = len(centre.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = np.array([len(b) == 8 * dimensions for b in batch.column("x").to_pylist()], bool)
            batch = batch.filter(pa.array(fits))
            if batch.num_rows:
                scaled = centre.scaled(_matrix(batch))
                about = (scaled.astype(float) ** 2).sum(axis=1)
                exact = np.where(about < 2.0**62, (scaled * scaled).sum(axis=1), 0)
                deviation = pa.array(exact, pa.int64(), mask=about >= 2.0**62)
                white = (scaled / centre.n) @ components
                lists = pa.ListArray.from_arrays(np.arange(len(white) + 1, dtype=np.int32) * white.shape[1], pa.array(white.ravel()))
                yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "deviation": deviation, "whitened": lists})

    return run


@dataclass
class Whitening:
    """``rows`` are ``vec_id, deviation, whitened``; the rest tells how they were made."""

    rows: DataFrame
    pairs: Eigenpairs
    n: int
    identity_error: float


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> Whitening | None:
    """Every row's coordinates along the leading components, scaled to unit variance.

    Entries are read as integers, floor(64c) + 10^6; each distinct vector counts once in means
    and covariances. ``deviation`` is the sum over dimensions of (n*x - S)^2, null where that
    takes more than 62 bits. Fewer components come where the vectors span fewer dimensions.

    Rows without a vector, with an empty one, or with a null or non-finite entry, go. If lengths
    differ, that of most distinct vectors counts (of equals the longest) and rows of others go.
    Entries of more than 2^34 in size count as that. Rows that repeat an id or a vector, and
    null ids, come as often as they stand. Without any row, or where all vectors are equal,
    there is nothing to whiten: None.
    """
    spark = vectors.sparkSession
    rows = integer_vectors(vectors, id_col, vector_col)
    every = written(rows.select("x").distinct())
    lengths = every.groupBy(F.octet_length("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if lengths is None or lengths["count"] < 2:
        return None
    fit = every.where(F.octet_length("x") == lengths["size"])

    def sums(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        parts = [_matrix(b).sum(axis=0) for b in batches if b.num_rows]
        return sum(parts) if parts else None

    tasks = max(1, math.isqrt(fit.rdd.getNumPartitions()))
    centre = Centre(int(lengths["count"]), _summed(fit, sums, "<i8", tasks))
    times = covariance_times(fit, centre, tasks)
    pairs = jacobi_davidson(times, lengths["size"] // 8, components)
    if not len(pairs.values):
        return None
    scale = 1 / np.sqrt(pairs.values)
    covariance = (pairs.vectors.T @ times(pairs.vectors)[0]) * np.outer(scale, scale)
    error = float(np.abs(covariance - np.eye(len(scale))).max())
    white = rows.mapInArrow(_whitened(centre, pairs.vectors * scale), "vec_id long, deviation long, whitened array<double>")
    return Whitening(white, pairs, centre.n, error)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of every embedding, one row for each component."""
    done = whiten(table(spark, sf_dir, "embeddings"))
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if done is None:
        return spark.createDataFrame([], schema)
    explained = F.array(*[F.lit(float(e / done.pairs.trace)) for e in done.pairs.values])
    each = done.rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(done.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(done.identity_error).alias("identity_error"),
    )
