import numpy as np
import pytest

from tessella.llm import whitening


def plain(vectors):
    """Integers, the distinct ones' mean and leading components, by a full decomposition."""
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    c = (n * fit - sums) / n
    values, parts = np.linalg.eigh(c.T @ c / n)
    return x, n, sums, values[::-1], parts[:, ::-1]


def drawn(rows, dims, seed=0):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(rows, dims)) @ np.diag(np.linspace(3, 0.5, dims))


@pytest.mark.parametrize("dims", [3, 20, 40])
def test_whitening_equals_numpy(spark, dims):
    vectors = drawn(400, dims).tolist()
    rows = [(i, v) for i, v in enumerate(vectors)] + [(1000 + i, vectors[0]) for i in range(200)] + [(None, vectors[1]), (7, vectors[2])]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, x string, deviation int").repartition(5)
    done = whitening.whiten(frame)
    x, n, sums, values, parts = plain([v for _, v in rows])
    k = min(16, dims)
    assert done.n == n == 400 and np.allclose(done.pairs.values, values[:k], rtol=1e-13)
    assert np.allclose(np.abs((parts[:, :k] * done.pairs.vectors).sum(axis=0)), 1, rtol=0, atol=1e-12)
    assert done.identity_error < 1e-10 and abs(done.pairs.trace - values.sum()) < 1e-9
    expected = {}
    white = (n * x - sums) / n @ done.pairs.vectors / np.sqrt(done.pairs.values)
    for (i, _), w, row in zip(rows, white, x):
        expected.setdefault(i, []).append((int(((n * row - sums) ** 2).sum()), tuple(np.round(w, 9))))
    got = {}
    for r in done.rows.collect():
        got.setdefault(r.vec_id, []).append((r.deviation, tuple(np.round(r.whitened, 9))))
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted(v) for i, v in expected.items()}


def of_matrix(matrix):
    return lambda block: (matrix @ block, float(np.trace(matrix)))


@pytest.mark.parametrize("spectrum", [np.linspace(100, 1, 500), 0.97 ** np.arange(500), np.concatenate([[50.0] * 10, np.linspace(40, 0, 490)])])
def test_eigenpairs_without_filling_the_space(spectrum):
    rng = np.random.default_rng(3)
    turn = np.linalg.qr(rng.normal(size=(500, 500)))[0]
    matrix = turn @ np.diag(spectrum) @ turn.T
    got = whitening.jacobi_davidson(of_matrix((matrix + matrix.T) / 2), 500, 16)
    assert np.allclose(got.values, np.sort(spectrum)[::-1][:16], rtol=1e-12)
    assert (got.residuals < 1e-11 * got.values[0]).all() and got.products < 400
    assert np.abs(got.vectors.T @ got.vectors - np.eye(16)).max() < 1e-12


def test_minres_solves():
    rng = np.random.default_rng(5)
    a = rng.normal(size=(12, 12))
    a = a + a.T
    b = rng.normal(size=(12, 4))
    assert np.allclose(a @ whitening.minres(lambda t: a @ t, b, 12), b, atol=1e-7)
    least = whitening.minres(lambda t: a @ t, b, 3)
    for k in range(4):  # the least residual within the Krylov space
        space = np.stack([np.linalg.matrix_power(a, i) @ b[:, k] for i in range(3)], axis=1)
        best = np.linalg.lstsq(a @ space, b[:, k], rcond=None)[0]
        assert np.isclose(np.linalg.norm(a @ least[:, k] - b[:, k]), np.linalg.norm(a @ space @ best - b[:, k]), rtol=1e-8)


def test_awkward_rows(spark):
    good = drawn(30, 4).tolist()
    bad = [None, [], [1.0, None, 2.0, 3.0], [float("nan")] * 4, [float("inf"), 0.0, 0.0, 0.0], [1.0, 2.0]]
    rows = [(i, v) for i, v in enumerate(good + bad)]
    done = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3))
    assert done.n == 30 and sorted(r.vec_id for r in done.rows.collect()) == list(range(30))
    huge = spark.createDataFrame([(0, [1e300, 0.0]), (1, [-1e300, 1.0]), (2, [0.0, 2.0])], "vec_id long, embedding array<double>")
    assert {r.vec_id: r.deviation for r in whitening.whiten(huge).rows.collect()}.keys() == {0, 1, 2}


def test_fewer_dimensions_than_components(spark):
    """Vectors on a plane have two components; equal ones, and none, have no rows."""
    a = np.array([[1.0, 2.0, 3.0, 4.0], [4.0, -3.0, 2.0, -1.0]])
    flat = (np.random.default_rng(1).integers(-9, 9, (50, 2)) @ a).tolist()
    frame = spark.createDataFrame(list(enumerate(flat)), "vec_id long, embedding array<double>")
    assert len(whitening.whiten(frame).pairs.values) == 2
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)) is None
    assert whitening.whiten(spark.createDataFrame([], schema)) is None


def test_query(spark, tmp_path):
    frame = spark.createDataFrame(list(enumerate(drawn(60, 20).tolist())), "vec_id long, embedding array<float>")
    frame.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = whitening.op11_whitening(spark, str(tmp_path)).toPandas()
    assert len(got) == 60 * 16 and sorted(got.component.unique()) == list(range(1, 17)) and (got.n == 60).all()
    first = got[got.component == 1].explained.unique()
    assert len(first) == 1 and 0 < first[0] < 1 and (got.identity_error < 1e-8).all()
    assert got.groupby("component").whitened.apply(lambda w: (w**2).mean()).sub(1).abs().max() < 1e-9
    frame.limit(0).write.parquet(str(tmp_path / "none/embeddings.parquet"))
    assert whitening.op11_whitening(spark, str(tmp_path / "none")).count() == 0
