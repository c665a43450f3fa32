"""Instances of model maps: pooled tokens, outlines, owners, suppression and the store, on small inputs."""

import numpy as np
import pytest

from tessella.operators import cells, instances, segmentation
from tessella.operators.instances import CellMaps
from tessella.operators.tiling import TileSpec
from tessella.plans.session import shared_dir
from tessella.sources.store import SlideStore

BOX = "slide_id long, {} long, x0 long, y0 long, x1 long, y1 long"


def pictures(spark, values, slide=0):
    rows = [(s, i, x, y, [float(v) for v in np.asarray(p).ravel()]) for s in np.atleast_1d(slide).tolist() for i, (x, y, p) in enumerate(values)]
    return spark.createDataFrame(rows, "slide_id long, tile_id long, x long, y long, vec array<double>")


def plain_pool(labels, tokens, one):
    (rows, columns), (h, w) = tokens.shape[1:], labels.shape
    ys, xs = np.round(np.linspace(0, h - 1, rows)).astype(int), np.round(np.linspace(0, w - 1, columns)).astype(int)
    hit = [tokens[:, i, j] for i, y in enumerate(ys) for j, x in enumerate(xs) if labels[y, x] == one]
    if hit:
        return np.mean(hit, axis=0)
    at = np.argwhere(labels == one)
    if not len(at):
        return np.zeros(len(tokens))
    y, x = at.mean(axis=0)
    return tokens[:, min(int(y * rows / h), rows - 1), min(int(x * columns / w), columns - 1)]


def test_pooled_tokens():
    rng = np.random.default_rng(0)
    tokens = rng.normal(size=(16, 8, 8)).astype(np.float32)
    labels = np.zeros((128, 128), int)
    labels[0:40, 0:40], labels[50:90, 60:100], labels[100:120, 10:30], labels[40:42, 45:47] = 3, 7, 11, 99
    ids = np.array([99, 3, 7, 11, 5, 3])  # 99 holds no place of a token, 5 isn't there, 3 comes twice
    got = instances.pooled_tokens(labels, tokens, ids)
    assert np.allclose(got, [plain_pool(labels, tokens, k) for k in ids], atol=1e-6)
    assert instances.pooled_tokens(labels, tokens, np.array([], int)).shape == (0, 16)
    for _ in range(20):
        labels = rng.integers(0, 40, (13, 17))
        ids = 1 + rng.permutation(50)  # 0 is background, not an instance
        tokens = rng.normal(size=(3, 4, 5))
        assert np.allclose(instances.pooled_tokens(labels, tokens, ids), [plain_pool(labels, tokens, k) for k in ids])


def test_outlines_of_holes_islands_and_corners(spark):
    picture = np.zeros((12, 12))
    picture[1:8, 1:8], picture[2:7, 2:7], picture[4, 4] = 1, 0, 1  # a ring with an island
    picture[9, 9] = picture[10, 10] = 2  # neighbours at a corner are one part
    picture[9, 1] = picture[11, 1] = 3  # two parts
    run = lambda holes: {r.instance: r for r in instances.find_instances(pictures(spark, [(100, 50, picture)]), lambda b: b, 12, 2, holes=holes).collect()}
    filled, open_ = run(False), run(True)
    assert [(len(filled[k].parts), filled[k].pixels, filled[k].filled) for k in (1, 2, 3)] == [(1, 25, 49), (1, 2, 2), (2, 2, 2)]
    assert [(len(open_[k].parts), sorted(len(p.holes) for p in open_[k].parts), open_[k].filled) for k in (1, 2, 3)] == [(2, [0, 1], 25), (1, [0], 2), (2, [0, 0], 2)]
    assert {(p.x, p.y) for p in filled[1].parts[0].ring} == {(102.0, 52.0), (116.0, 52.0), (116.0, 66.0), (102.0, 66.0)}
    assert (filled[2].cx, filled[2].cy, filled[2].prob, filled[2].class_id, filled[2].vec) == (100 + 2 * 9.5, 50 + 2 * 9.5, 1.0, None, None)


def test_random_outlines_hold_their_pixels(spark):
    rng = np.random.default_rng(1)
    maps = [rng.integers(0, 4, (9, 9)) for _ in range(6)]
    found = instances.find_instances(pictures(spark, [(0, 0, m) for m in maps]), lambda b: b, 9, holes=True).collect()
    assert len(found) == sum(len(np.unique(m[m > 0])) for m in maps)
    for r in found:
        at = np.argwhere(maps[r.tile_id] == r.instance)
        assert r.filled == r.pixels == len(at) and (r.tx0, r.ty0, r.tx1, r.ty1) == (at[:, 1].min(), at[:, 0].min(), at[:, 1].max(), at[:, 0].max())
        sides = {(a.x, a.y, b.x, b.y) for p in r.parts for ring in (p.ring, *p.holes) for a, b in zip(ring, ring[1:])}
        length = sum(abs(a - c) + abs(b - d) for a, b, c, d in sides)
        own = {tuple(q) for q in at.tolist()}
        assert length == sum((y + dy, x + dx) not in own for y, x in own for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0)))


def test_classes_and_probabilities(spark):
    picture = np.zeros((6, 6))
    picture[1, 1:3], picture[3, 1:3], picture[3:5, 4] = 1, 2, 3

    def model(b):
        p = np.zeros((len(b), 3, 6, 6))
        p[:, 0], p[:, 1, 1], p[:, 2, 3, :3] = 0.25, 0.5, 0.75
        return CellMaps(b, p)

    images = pictures(spark, [(0, 0, picture)])
    runner = segmentation.CellRunner(model, 6, 0, names={0: "Background", 1: "a"})
    assert {r.instance: (r["class"], r.prob) for r in runner.run(images).collect()} == {1: ("a", 0.5), 2: ("2", 0.75)}
    flat = segmentation.CellRunner(lambda b: CellMaps(b, np.full(b.shape, 0.5)), 6, 0, features=True).run(images).collect()
    assert {(r["class"], r.prob, r.vec) for r in flat} == {(None, 0.5, None)}  # no class, and no model with tokens
    for bad in (lambda b: CellMaps(None), lambda b: CellMaps(b, b[:, :3]), lambda b: CellMaps(b, None, b), lambda b: b[:, :2]):
        with pytest.raises(Exception):
            segmentation.CellRunner(bad, 6).run(images).collect()
    with pytest.raises(TypeError):
        instances.find_instances(images, 3, 6)
    assert runner.run(images.limit(0)).count() == 0


def test_tiles_own_what_is_nearest(spark):
    """The middle of an overlap is nobody's own by distance: the smaller id has it. Both slides alike."""
    tiles = spark.createDataFrame([(s, t, x, 0, x + 10, 10) for s in (0, 1) for t, x in ((0, 0), (1, 6))], BOX.format("tile_id"))
    places = [(0, 2.0), (0, 7.0), (0, 8.5), (0, 9.5), (1, 6.5), (1, 7.0), (1, 8.0), (1, 9.0), (1, 15.0), (9, 8.5)]
    found = spark.createDataFrame([(s, t, i, x, 5.0) for s in (0, 1) for i, (t, x) in enumerate(places)], "slide_id long, tile_id long, instance long, cx double, cy double")
    got = sorted((r.slide_id, r.tile_id, r.cx) for r in instances.owned(found, tiles).collect())
    kept = [(0, 2.0), (0, 7.0), (1, 9.0), (1, 15.0), (9, 8.5)]
    assert got == [(s, *k) for s in (0, 1) for k in kept]
    middle = found.limit(1).selectExpr("slide_id", "explode(array(0L, 1L)) as tile_id", "instance", "8.0D as cx", "5.0D as cy")
    assert [r.tile_id for r in instances.owned(middle, tiles).collect()] == [0]


def test_a_cell_in_two_tiles_is_kept_once(spark):
    left, right = np.zeros((12, 12)), np.zeros((12, 12))
    left[4:7, 8:11], right[4:7, 3:6] = 5, 9  # the same place, in tiles five pixels apart
    images = pictures(spark, [(0, 0, left), (5, 0, right)], slide=[0, 1])
    tiles = spark.createDataFrame([(s, t, x, 0, x + 12, 12) for s in (0, 1) for t, x in ((0, 0), (1, 5))], BOX.format("tile_id"))
    tissues = spark.createDataFrame([(s, 4, 0, 0, 50, 50) for s in (0, 1)], BOX.format("tissue_id"))
    runner = segmentation.CellRunner(lambda b: b, 12, 0)
    by = lambda **k: sorted((r.slide_id, r.cell_id, r.tile_id, r.x0, r.area) for r in runner.run(images, **k).collect())
    assert by() == by(tissues=tissues) == [(0, 0, 0, 8, 9), (1, 0, 0, 8, 9)]
    assert by(tiles=tiles) == by(tiles=tiles, tissues=tissues) == [(0, 0, 1, 8, 9), (1, 0, 1, 8, 9)]
    assert by(tissues=tissues.where("slide_id = 1")) == [(1, 0, 0, 8, 9)]


def test_suppression_sees_outlines_not_boxes(spark):
    """Two triangles share their boxes, but hardly an area."""
    one = [[(0, 0), (9, 0), (9, 9), (0, 0)]]
    other = [[(0, 0.5), (8.5, 9), (0, 9), (0, 0.5)]]
    ring = lambda r: [({"x": float(x), "y": float(y)}) for x, y in r]
    part = lambda rs: [{"ring": ring(r), "holes": []} for r in rs]
    schema = f"slide_id long, cell_id long, prob double, area double, parts {instances.PARTS}"
    rows = [(s, i, p, a, part(r)) for s in (0, 1) for i, (p, a, r) in enumerate(((0.5, 40.5, one), (0.9, 36.125, other), (0.8, 36.125, other)))]
    kept = cells.nms_parts(spark.createDataFrame(rows, schema), 0.2)
    assert sorted((r.slide_id, r.cell_id) for r in kept.collect()) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    apart = [(0, i, 0.5, 40.5, part(one), t) for i, t in enumerate((1, 1, 2))]
    kept = cells.nms_parts(spark.createDataFrame(apart, schema + ", tissue_id long"), 0.2)
    assert sorted(r.cell_id for r in kept.collect()) == [0, 2]


def test_store_of_cells_tiles_and_vectors(spark):
    store = SlideStore(spark, f"{shared_dir(spark)}/store-of-cells")
    picture = np.zeros((8, 8))
    picture[1:3, 1:3], picture[5, 5], picture[5, 2] = 1, 2, 3
    model = lambda b: CellMaps(b, None, np.stack([b[:, ::4, ::4]] * 4, axis=1) + 1)
    found = segmentation.CellRunner(model, 8, 0, features=True).run(pictures(spark, [(0, 0, picture), (20, 0, picture)], slide=[0, 1]))
    store.put_cells("cells", found)
    shapes, vectors = store.get("cells"), store.vectors("cells_features")
    assert "vec" not in shapes.columns and shapes.count() == vectors.count() == 12
    assert shapes.join(vectors, ["slide_id", "cell_id"]).count() == 12 and {len(r.vec) for r in vectors.collect()} == {4}
    many = spark.range(100).selectExpr("id % 2 as slide_id", "id div 2 as cell_id", "array(cast(id as double)) as vec")
    store.put_vectors("many", many, span=10)
    wanted = spark.createDataFrame([(0, 3), (0, 3), (1, 49), (1, 77)], "slide_id long, cell_id long")
    assert sorted((r.slide_id, r.cell_id, r.vec) for r in store.vectors("many", wanted, span=10).collect()) == [(0, 3, [6.0]), (1, 49, [99.0])]
    assert store.get("many").select("slide_id", "bucket").distinct().count() == 10
    for bad in (many.unionByName(many), many.selectExpr("slide_id", "cell_id", "if(cell_id = 3, null, vec) as vec"), many.selectExpr("slide_id", "cell_id", "if(cell_id = 3, array(1D, 2D), vec) as vec")):
        with pytest.raises(ValueError):
            store.put_vectors("bad", bad)
    tiles = spark.createDataFrame([(s, t, 0, 0, 8, 8) for s in (0, 1) for t in (0, 1, 2)], BOX.format("tile_id"))
    spec = TileSpec(256, overlap=0.25, mpp=0.5, slide_mpp=0.25)
    store.put_tiles("grid", tiles, spec)
    store.put_tiles(None, tiles, spec)
    assert store.tile_spec("grid") == spec and store.tile_spec("grid").base_stride == 384
    store.put("m_grid", tiles.where("tile_id < 2").selectExpr("slide_id", "tile_id", "array(1D) as vec", "x0"))
    joined = store.tile_features("m", "grid")
    assert joined.count() == 4 and sorted(joined.columns) == sorted([*tiles.columns, "vec"])


@pytest.mark.parametrize("seed", range(4))
def test_sure_pairs_leave_the_best_total(seed, monkeypatch):
    """Pairs that gain more than the next best of both ends are taken; the total is that of a full assignment."""
    from tessella.operators import cells

    rng = np.random.default_rng(seed)
    n = 60
    gt, pred = rng.integers(0, 25, n), rng.integers(0, 25, n)
    _, once = np.unique(gt * 100 + pred, return_index=True)
    gt, pred = gt[once], pred[once]
    slide, gain = gt % 2, rng.random(len(gt)) ** 3
    keep = slide == pred % 2
    slide, gt, pred, gain = slide[keep], gt[keep], pred[keep], gain[keep]
    links = list(zip(gt.tolist(), pred.tolist(), gain.tolist()))
    value = {(a, b): g for a, b, g in links}
    best = sum(value[p] for p in cells._assignment(links))
    assigned, real = [], cells._assignment
    monkeypatch.setattr(cells, "_assignment", lambda rows: assigned.append(len(rows)) or real(rows))
    at = cells._matched(slide, gt, pred, gain)
    assert len(set(gt[at])) == len(set(pred[at])) == len(at) and abs(gain[at].sum() - best) < 1e-9
    assert sum(assigned) < len(links)


def test_semantic_stats_grow_tasks_with_boxes(spark, monkeypatch):
    """A task holds the bands of so many boxes, whatever the number of shuffle partitions."""
    rows = spark.createDataFrame([(i % 3, i * 7, i * 5, i * 7 + 30, i * 5 + 40) for i in range(40)], "slide_id long, x0 long, y0 long, x1 long, y1 long")
    moved = rows.selectExpr("slide_id", "x0 + 3 as x0", "y0", "x1 + 3 as x1", "y1")
    before = sorted(cells.semantic_stats(rows, moved).collect())
    monkeypatch.setattr(cells, "BOXES", 2, raising=False)
    after = cells.semantic_stats(rows, moved)
    assert "gy#" in (plan := after._jdf.queryExecution().executedPlan().toString()) and ", 40), REPARTITION_BY_NUM" in plan
    assert sorted(after.collect()) == before
