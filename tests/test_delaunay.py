from itertools import combinations

import numpy as np
import pytest

from tessella import queries
from tessella.operators.delaunay import delaunay

SCHEMA = "slide_id long, id long, x long, y long"


def brute_force(points):
    """Pairs with an empty circle through both and a third point, found by trying all triples."""
    p = np.array([(x, y) for _, x, y in points], float)
    edges = set()
    for i, j, k in combinations(range(len(p)), 3):
        a, b, c = p[i], p[j], p[k]
        d = 2 * (a[0] * (b[1] - c[1]) + b[0] * (c[1] - a[1]) + c[0] * (a[1] - b[1]))
        if abs(d) < 1e-9:
            continue
        s = [(q * q).sum() for q in (a, b, c)]
        o = np.array([s[0] * (b[1] - c[1]) + s[1] * (c[1] - a[1]) + s[2] * (a[1] - b[1]), s[0] * (c[0] - b[0]) + s[1] * (a[0] - c[0]) + s[2] * (b[0] - a[0])]) / d
        r = np.hypot(*(a - o))
        others = [n for n in range(len(p)) if n not in (i, j, k)]
        if all(np.hypot(*(p[n] - o)) > r - 1e-9 for n in others):
            edges |= {frozenset((points[m][0], points[n][0])) for m, n in ((i, j), (j, k), (i, k))}
    return edges


@pytest.mark.parametrize("seed", [8, 9])
def test_edges_equal_brute_force(spark, seed):
    """All edges, those on the outside of the slide included, in two slides with equal ids."""
    rng = np.random.default_rng(seed)
    slides = [[(i, int(x), int(y)) for i, (x, y) in enumerate(rng.integers(0, 1000, (n, 2)))] for n in (45, 12)]
    rows = [(s, *p) for s, pts in enumerate(slides) for p in pts]
    got = delaunay(spark.createDataFrame(rows, SCHEMA), 150, first=4).collect()
    for s, pts in enumerate(slides):
        assert {frozenset((r.src, r.dst)) for r in got if r.slide_id == s} == brute_force(pts)


@pytest.mark.parametrize("side", [12, 150])
def test_edges_do_not_depend_on_blocks(spark, side):
    """Many small blocks, and few; points in a cluster, far apart, and on both sides of zero."""
    rng = np.random.default_rng(5)
    close = rng.integers(-30, 30, (30, 2))
    pts = [(i, int(x), int(y)) for i, (x, y) in enumerate(np.concatenate([close, rng.integers(-400, 500, (20, 2))]))]
    pts = list({(x, y): (i, x, y) for i, x, y in reversed(pts)}.values())
    got = delaunay(spark.createDataFrame([(0, *p) for p in pts], SCHEMA), side, first=4).collect()
    assert {frozenset((r.src, r.dst)) for r in got} == brute_force(pts)


@pytest.mark.parametrize("n", [1, 2])
def test_few_points(spark, n):
    got = delaunay(spark.createDataFrame([(0, i, 10 * i, 0) for i in range(n)], SCHEMA), 100).collect()
    assert len(got) == (2 if n == 2 else 0)


def test_square_grid_has_no_diagonals(spark):
    pts = [(0, 5 * y + x, 256 * x, 256 * y) for y in range(5) for x in range(5)]
    assert delaunay(spark.createDataFrame(pts, SCHEMA), 512).count() == 80


def test_points_at_one_place(spark):
    got = {(r.src, r.dst) for r in delaunay(spark.createDataFrame([(0, 1, 5, 5), (0, 2, 5, 5), (0, 3, 90, 5), (0, 4, 50, 80)], SCHEMA), 100).collect()}
    assert got == {(a, b) for x, y in ((1, 2), (1, 3), (1, 4), (3, 4)) for a, b in ((x, y), (y, x))}


def test_tiles_of_a_last_row_that_ends_early(spark, tmp_path):
    """The query gives what its SQL does: tiles side by side, none across the gap."""
    rows = [(i, i % 3, [0.0] * 4) for i in range(57)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {(r.src, r.dst) for r in queries.tile_graph_delaunay(spark, str(tmp_path)).collect()}
    place = {i: (i % 25, i // 25) for i in range(57)}
    assert got == {(a, b) for a in place for b in place if abs(place[a][0] - place[b][0]) + abs(place[a][1] - place[b][1]) == 1}
