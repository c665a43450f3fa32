import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions.boxes import box, ring_of
from tessella.operators import aggregate, annotations, cells, graph, models, omics, raster, shapes, similarity, tiling
from tessella.operators.similarity import text_image_similarity
from tessella.plans.components import connected_components
from tessella.plans.spatial_join import spatial_join

BOX = "slide_id long, id long, x0 long, y0 long, x1 long, y1 long"


def boxes(spark, n, seed=1, size=60, extent=400):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x, y = (int(v) for v in rng.integers(0, extent, 2))
        w, h = (int(v) for v in rng.integers(1, size, 2))
        rows.append((int(i % 2), i, x, y, x + w, y + h))
    return spark.createDataFrame(rows, BOX), rows


def meets(a, b, touch=True):
    if touch:
        return a[0] == b[0] and a[2] <= b[4] and b[2] <= a[4] and a[3] <= b[5] and b[3] <= a[5]
    return a[0] == b[0] and a[2] < b[4] and b[2] < a[4] and a[3] < b[5] and b[3] < a[5]


@pytest.mark.parametrize("touch", [True, False])
@pytest.mark.parametrize("cell", [16, 64, 1000])
def test_spatial_join_equals_nested_loop(spark, touch, cell):
    a, ra = boxes(spark, 80, 1)
    b, rb = boxes(spark, 60, 2)
    got = sorted(tuple(r) for r in spatial_join(a, b, cell, touch).select("id", "r_id").collect())
    assert got == sorted((x[1], y[1]) for x in ra for y in rb if meets(x, y, touch))


def test_spatial_join_keeps_unmatched(spark):
    a, ra = boxes(spark, 40, 1)
    b, rb = boxes(spark, 5, 2)
    got = spatial_join(a, b, 64, how="left").select("id", "r_id").collect()
    assert {r.id for r in got} == {r[1] for r in ra}
    assert {r.id for r in got if r.r_id is None} == {x[1] for x in ra if not any(meets(x, y) for y in rb)}
    semi = {r.id for r in spatial_join(a, b, 64, how="left_semi").collect()}
    assert semi == {x[1] for x in ra if any(meets(x, y) for y in rb)}


def test_spatial_join_has_no_nested_loop(spark):
    a, _ = boxes(spark, 10)
    plan = spatial_join(a, a, 64)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 180)] + [(7, 3), (3, 9), (3, 9), (5, 5)]
    got = {r.vertex: r.component for r in connected_components(spark.createDataFrame(chain, "src long, dst long")).collect()}
    assert {got[i] for i in range(100, 181)} == {100}
    assert (got[7], got[3], got[9], got[5]) == (3, 3, 3, 5)
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


@pytest.mark.parametrize(("w", "h", "edge", "n"), [(300, 300, False, 9), (350, 350, False, 9), (350, 350, True, 16), (50, 50, True, 1), (300, 40, False, 3)])
def test_grid_counts(spark, w, h, edge, n):
    df = spark.createDataFrame([(0, 0, 0, 0, w, h)], BOX)
    assert tiling.tiles_from_boxes(df, 100, 100, edge).count() == n


def test_tile_spec():
    assert tiling.TileSpec(256, overlap=0.25).stride == 192
    assert tiling.TileSpec(256, overlap=64).stride == 192
    assert tiling.TileSpec(256, mpp=0.5, slide_mpp=0.25).base_tile == 512
    with pytest.raises(ValueError):
        tiling.TileSpec(256, stride_px=10, overlap=0.1)


def test_every_kept_tile_is_covered(spark):
    df = spark.createDataFrame([(0, 1, 5, 5, 505, 405), (0, 2, 900, 0, 930, 30)], "slide_id long, tissue_id long, x0 long, y0 long, x1 long, y1 long")
    got = tiling.tile_tissues(df, 64, 48, True).collect()
    assert got and all(r.coverage >= 0.7 for r in got)
    assert [r.tile_id for r in sorted(got, key=lambda r: r.tile_id)] == list(range(len(got)))


def test_knn_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    pts = [(0, i, int(x), int(y)) for i, (x, y) in enumerate(rng.integers(0, 3000, (120, 2)))] + [(1, 500, 0, 0), (1, 501, 9999, 9999)]
    got = graph.knn(spark.createDataFrame(pts, "slide_id long, id long, x long, y long"), 5, 100)
    found = {}
    for r in got.collect():
        found.setdefault(r.src, []).append((round(r.dist, 6), r.dst))
    for s, i, x, y in pts:
        near = sorted((round(float(np.hypot(x - u, y - v)), 6), j) for t, j, u, v in pts if t == s and j != i)[:5]
        assert sorted(found[i]) == near


def test_smoothing_keeps_mass(spark):
    tiles = spark.createDataFrame([(0, i, (i % 5) * 256, (i // 5) * 256) for i in range(25)], "slide_id long, id long, x long, y long")
    feats = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(25)], "tile_id long, vec array<double>")
    g = graph.tile_graph(tiles, 4)
    assert g.count() == 80
    out = graph.spatial_features(feats, g, tiles)
    assert out.where("dim = 1").agg(F.sum("v")).first()[0] == pytest.approx(25)
    average = graph.spatial_features(feats, g, tiles, "average").where("dim = 1").collect()
    assert all(r.v == pytest.approx(1) for r in average)
    with pytest.raises(NotImplementedError):
        graph.tile_graph(tiles, 4, transform="other")


def test_encoders_and_topk(spark):
    feats = spark.createDataFrame([(i, i % 2, [float(i), -float(i)]) for i in range(6)], "tile_id long, g long, vec array<double>")
    got = {r.dim: r.score for r in aggregate.topk_score(feats, 2, "sum").collect()}
    assert got == {0: 9.0, 1: -1.0}
    vec = {r.g: r.vec for r in aggregate.as_vectors(aggregate.feature_aggregation(feats, ("g",), "mean"), ("g",)).collect()}
    assert vec == {0: [2.0, -2.0], 1: [3.0, -3.0]}
    with pytest.raises(ValueError):
        aggregate.feature_aggregation(feats, (), "mode")


def test_softmax_rows_sum_to_one(spark, monkeypatch):
    feats = spark.createDataFrame([(i, [float(i), 1.0, 2.0]) for i in range(4)], "tile_id long, vec array<double>")
    texts = spark.createDataFrame([(i, [1.0, float(i), 0.5]) for i in range(3)], "text_id long, vec array<double>")
    sums = text_image_similarity(feats, texts, softmax=True).groupBy("tile_id").agg(F.sum("score").alias("s")).collect()
    assert len(sums) == 4 and all(r.s == pytest.approx(1) for r in sums)
    assert text_image_similarity(feats, texts.limit(0)).count() == 0
    whole = {tuple(r) for r in text_image_similarity(feats, texts).collect()}
    monkeypatch.setattr(similarity, "TEXTS_AT_ONCE", 1)
    assert {tuple(r) for r in text_image_similarity(feats, texts).collect()} == whole and len(whole) == 12
    with pytest.raises(ValueError):
        text_image_similarity(feats, texts, "nothing")


def test_assignment_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(3)
    for n, m, held in ((3, 5, 1.0), (5, 3, 1.0), (4, 4, 0.5), (1, 3, 1.0), (6, 6, 0.35)) * 6:
        gain = rng.random((n, m)) * (rng.random((n, m)) < held)
        links = [(i, 100 + j, float(gain[i, j])) for i in range(n) for j in range(m) if gain[i, j] > 0]
        if not links:
            continue
        pairs = cells._assignment(links)
        assert len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs)
        got = sum(gain[i, j - 100] for i, j in pairs)
        big, small = max(n, m), min(n, m)
        g = gain if n <= m else gain.T
        assert got == pytest.approx(max(sum(g[i, p[i]] for i in range(small)) for p in permutations(range(big), small)))


def test_matching_and_metrics(spark):
    gt = spark.createDataFrame([(0, 1, 0, 0, 10, 10), (0, 2, 20, 0, 30, 10), (0, 3, 50, 50, 60, 60)], BOX)
    pred = spark.createDataFrame([(0, 7, 0, 0, 10, 9), (0, 8, 21, 0, 31, 10), (0, 9, 90, 90, 99, 99)], BOX)
    m = cells.match_instances(gt, pred)
    assert {(r.gt_id, r.pred_id) for r in m.collect()} == {(1, 7), (2, 8)}
    s = cells.metrics(cells.instance_stats(gt, pred, m)).first()
    assert (s.tp, s.fp, s.fn) == (2, 1, 1)
    assert s.recall == s.sensitivity and s.pq == pytest.approx((0.9 + 90 / 110) / 3)
    hand = spark.createDataFrame([(3, 2, 1, 0, 2.4)], "tp long, fp long, fn long, tn long, iou_sum double")
    assert cells.metrics(hand).first().pq == pytest.approx(2.4 / 4.5)


@pytest.mark.parametrize("strip", [7, 64])
def test_semantic_stats(spark, strip):
    gt = spark.createDataFrame([(0, 1, 0, 0, 10, 10), (0, 2, 5, 5, 15, 15)], BOX)
    pred = spark.createDataFrame([(0, 3, 0, 0, 10, 10)], BOX)
    s = cells.semantic_stats(gt, pred, strip).first()
    assert (s.tp, s.fp, s.fn) == (100, 0, 75)
    a, ra = boxes(spark, 60, 3, extent=150)
    b, rb = boxes(spark, 60, 4, extent=150)
    for r in cells.semantic_stats(a, b, strip).collect():
        cover = [np.zeros((250, 250), bool) for _ in range(2)]
        for drawn, rows in zip(cover, (ra, rb)):
            for s, _, x0, y0, x1, y1 in rows:
                if s == r.slide_id:
                    drawn[y0:y1, x0:x1] = True
        t, p = cover
        assert (r.tp, r.fp, r.fn) == ((t & p).sum(), (p & ~t).sum(), (t & ~p).sum())


def plain_nms(rows, threshold=0.2):
    """Suppression as a walk over all boxes of a slide: (slide, id) of those that stay."""

    def iou(a, b):
        w = max(0, min(a[4], b[4]) - max(a[2], b[2])) * max(0, min(a[5], b[5]) - max(a[3], b[3]))
        return w / ((a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - w)

    kept = set()
    for slide in {r[0] for r in rows}:
        own = sorted(r for r in rows if r[0] == slide)
        suppressed = set()
        for first in own:
            current = first
            while first[1] not in suppressed or current is not first:
                near = [r for r in own if r[1] not in suppressed and iou(current, r) > threshold]
                if not near:
                    break
                best = max(near, key=lambda r: (r[6], -r[1]))
                kept.add((slide, best[1]))
                if len(near) == 1:
                    break
                suppressed |= {r[1] for r in near if r[1] != best[1]}
                current = best
    return kept


CELL = BOX.replace("id long, x0", "cell_id long, x0") + ", prob double"


@pytest.mark.parametrize("seed", [9, 10])
def test_nms_equals_a_walk_over_all_boxes(spark, seed):
    """Ids restart in each slide, and many boxes overlap in chains."""
    _, rows = boxes(spark, 160, seed, size=80)
    rng = np.random.default_rng(seed)
    rows = [(r[0], r[1] // 2, *r[2:], float(p)) for r, p in zip(rows, rng.random(len(rows)))]
    got = cells.nms(spark.createDataFrame(rows, CELL)).collect()
    assert {(r.slide_id, r.cell_id) for r in got} == plain_nms(rows) and len(got) == len(plain_nms(rows))


def test_nms_drops_degenerate_boxes(spark):
    rows = [(0, 0, 0, 0, 10, 10, 0.5), (0, 1, 5, 5, 5, 9, 0.9), (0, 2, 100, 100, 110, 110, 0.1)]
    assert {r.cell_id for r in cells.nms(spark.createDataFrame(rows, CELL)).collect()} == {0, 2}


def test_nms_keeps_what_the_walk_left(spark):
    chain = [(s, i, 6 * i, 0, 6 * i + 10, 10, p) for s in (0, 1) for i, p in enumerate((0.1, 0.5, 0.9))]
    got = cells.nms(spark.createDataFrame(chain, CELL)).collect()
    assert {(r.slide_id, r.cell_id) for r in got} == {(s, i) for s in (0, 1) for i in (1, 2)}


def test_nms_by_tissue(spark):
    cell_rows = [(0, 1, 0, 0, 10, 10, 0.5), (0, 2, 1, 0, 11, 10, 0.9), (0, 3, 2, 0, 12, 10, 0.7), (0, 4, 500, 500, 510, 510, 0.1)]
    tissue_rows = [(0, 7, 0, 0, 0, 10), (0, 8, 11, 0, 12, 10)]
    tissues = spark.createDataFrame(tissue_rows, "slide_id long, tissue_id long, x0 long, y0 long, x1 long, y1 long")
    got = cells.nms_by_tissue(spark.createDataFrame(cell_rows, CELL), tissues).collect()
    assert {(r.cell_id, r.tissue_id) for r in got} == {(1, 7), (2, 8)}


def test_equal_ids_in_two_slides_stay_apart(spark):
    tiles = [(s, i, x, 0, x + 10, 10, 1) for s in (0, 1) for i, x in enumerate((0, 10 if s else 30))]
    df = spark.createDataFrame(tiles, "slide_id long, tile_id long, x0 long, y0 long, x1 long, y1 long, domain long")
    regions = {(r.slide_id, r.region): r.n_tiles for r in shapes.dissolve(df, "domain").collect()}
    assert regions == {(0, 0): 1, (0, 1): 1, (1, 0): 2}
    near = {(r.slide_id, r.region): r.n for r in shapes.dissolve_near(df.withColumnRenamed("tile_id", "cell_id").withColumn("prob", F.lit(0.5)), "domain", 1).collect()}
    assert near == regions
    merged = cells.best_of_clusters(df.withColumnRenamed("tile_id", "cell_id").withColumn("prob", F.lit(0.5))).collect()
    assert sorted((r.slide_id, r.component, r.n) for r in merged) == [(0, 0, 1), (0, 1, 1), (1, 0, 1), (1, 1, 1)]
    gt = spark.createDataFrame([(s, i, 20 * i, 0, 20 * i + 10, 10) for s in (0, 1) for i in (0, 1)], BOX)
    pred = gt.where("slide_id = 0 or id = 1")
    assert sorted((r.slide_id, r.gt_id, r.pred_id) for r in cells.match_instances(gt, pred).collect()) == [(0, 0, 0), (0, 1, 1), (1, 1, 1)]
    points = spark.createDataFrame([(s, i, 256 * i, 0) for s in (0, 1) for i in range(3)], "slide_id long, id long, x long, y long")
    feats = spark.createDataFrame([(s, i, [float(10 * s + i)]) for s in (0, 1) for i in range(3)], "slide_id long, tile_id long, vec array<double>")
    smooth = graph.spatial_features(feats, graph.tile_graph(points, 2), points, "average").collect()
    assert len(smooth) == 6 and all((r.v >= 10) == (r.slide_id == 1) for r in smooth)
    texts = spark.createDataFrame([(0, [2.0])], "text_id long, vec array<double>")
    scores = {(r.slide_id, r.tile_id): r.score for r in text_image_similarity(feats, texts, normalize=False).collect()}
    assert scores == {(s, i): 2.0 * (10 * s + i) for s in (0, 1) for i in range(3)}


def test_left_join_with_nulls_in_the_left_row(spark):
    left = spark.createDataFrame([(0, 1, 0, 0, 5, 5, None), (0, 2, 90, 90, 95, 95, None), (0, 3, 1, 1, 2, 2, "x")], BOX + ", details string")
    right = spark.createDataFrame([(0, 9, 4, 4, 8, 8)], BOX)
    got = sorted(((r.id, r.r_id) for r in spatial_join(left, right, 16, how="left").collect()), key=str)
    assert got == [(1, 9), (2, None), (3, None)]
    assert [r.id for r in spatial_join(left, right, 16, how="left_semi").collect()] == [1]


def test_nms_single_and_cluster(spark):
    df = spark.createDataFrame([(0, 1, 0, 0, 10, 10, 0.5), (0, 2, 1, 1, 11, 11, 0.9), (0, 3, 100, 100, 110, 110, 0.1)], "slide_id long, cell_id long, x0 long, y0 long, x1 long, y1 long, prob double")
    assert {r.cell_id for r in cells.nms(df).collect()} == {2, 3}


def test_raster_components_and_otsu(spark):
    art = ["##..", "..#.", "....", "#..#"]
    px = spark.createDataFrame([(0, y, x, 200 if c == "#" else 10) for y, row in enumerate(art) for x, c in enumerate(row)], "image_id long, y long, x long, v long")
    t = raster.otsu(px)
    assert t.first().threshold == 10
    parts = raster.component_shapes(raster.mask_components(raster.binary(px, t)))
    assert sorted(r.area for r in parts.collect()) == [1, 1, 3]
    wide = spark.createDataFrame([(0, 0, 4095, 1), (0, 1, 0, 1), (0, 2, 1, 1), (1, 3, 0, 1)], "image_id long, y long, x long, v long")
    assert sorted(r.area for r in raster.component_shapes(raster.mask_components(wide)).collect()) == [1, 1, 2]
    with pytest.raises(ValueError):
        raster.box_blur(px, 2)
    with pytest.raises(ValueError):
        raster.importance(F.lit(1), F.lit(1), 8, "other")


def test_dissolve_two_islands(spark):
    rows = [(0, i, x, 0, x + 10, 10, d) for i, (x, d) in enumerate([(0, 1), (10, 1), (30, 1), (20, 2)])]
    df = spark.createDataFrame(rows, "slide_id long, tile_id long, x0 long, y0 long, x1 long, y1 long, domain long")
    got = {(r.domain, r.region): r.area for r in shapes.dissolve(df, "domain").collect()}
    assert got == {(1, 0): 200, (1, 2): 100, (2, 3): 100}


def test_ring_props(spark):
    df = spark.createDataFrame([(0, 1, 0, 0, 4, 2)], BOX).withColumn("ring", ring_of(box()))
    r = shapes.tissue_props(df).first()
    assert (r.area, r.perimeter, r.centroid_x, r.centroid_y, r.extent) == (8, 12, 2, 1, 1)


def test_models_contracts(spark):
    feats = spark.createDataFrame([(i, [float(i), 2.0]) for i in range(5)], "tile_id long, vec array<double>")
    out = models.feature_prediction(feats, lambda x: {"s": x.sum(1)}, ("s",), batch_size=2)
    assert {r.tile_id: r.s for r in out.collect()} == {i: i + 2.0 for i in range(5)}
    with pytest.raises(ValueError):
        models.feature_prediction(feats, lambda x: {}, ())
    with pytest.raises(Exception):
        models.feature_prediction(feats, lambda x: {"t": x.sum(1)}, ("s",)).collect()
    models.register("halves", lambda x: x / 2)
    assert {r.tile_id: r.vec for r in models.feature_extraction(feats, "halves").collect()}[3] == [1.5, 1.0]
    with pytest.raises(ValueError):
        models.register("moments", lambda x: x)
    with pytest.raises(ValueError):
        models.resolve("nothing")
    probs = models.zero_shot_scores(aggregate.as_vectors(aggregate.feature_aggregation(feats, ("tile_id",)), ("tile_id",)), {"a": [1, 0], "b": [0, 1]}, ("tile_id",))
    assert all(r.s == pytest.approx(1) for r in probs.groupBy("tile_id").agg(F.sum("p").alias("s")).collect())


def test_magnification(spark):
    df = spark.createDataFrame([(None,), (0.5,), (0.25,)], "mpp double")
    assert [r[0] for r in df.select(cells.magnification(F.col("mpp"))).collect()] == ["20x", "20x", "40x"]
    with pytest.raises(Exception):
        spark.createDataFrame([(9.0,)], "mpp double").select(cells.magnification(F.col("mpp"))).collect()


def test_annotations_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([(0, 1, 0, 0, 4, 2, "a"), (0, 2, 5, 5, 9, 9, "b")], BOX + ", class string")
    annotations.export_annotations(df, str(tmp_path / "out"), "class", "id")
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(lines) == 2 and all('"classification":{"color":[' in x for x in lines)
    whole = tmp_path / "in.geojson"
    whole.write_text('{"type":"FeatureCollection","features":[' + ",".join(lines) + "]}")
    back = annotations.load_annotations(spark, str(whole), min_area=0)
    assert sorted((r.x0, r.y0, r.x1, r.y1) for r in back.collect()) == [(0, 0, 4, 2), (5, 5, 9, 9)]
    flat = annotations.flatten_json(spark.createDataFrame([(1, '{"k": 3}'), (2, "bad"), (3, None)], "id long, p string"), "p", {"k": "bigint"})
    assert {r.id: r.p_k for r in flat.collect()} == {1: 3, 2: None, 3: None}


def test_ndpa(spark, tmp_path):
    point = lambda x, y: f"<point><x>{x}</x><y>{y}</y></point>"
    body = "".join(point(x, y) for x, y in ((-100000, -50000), (100000, -50000), (100000, 50000), (-100000, 50000)))
    (tmp_path / "a.ndpa").write_text(f"""<annotations>
<ndpviewstate id="1"><title>area</title><annotation type="freehand" displayname="A" color="#ff0000"><closed>1</closed><pointlist>{body}</pointlist></annotation></ndpviewstate>
<ndpviewstate id="2"><title>pin</title><annotation type="pin" displayname="B" color="#00ff00"><x>0</x><y>0</y></annotation></ndpviewstate>
<ndpviewstate id="3"><title>none</title></ndpviewstate></annotations>""")
    got = {r.ndpa_id: r for r in annotations.read_ndpa(spark, str(tmp_path / "a.ndpa"), 0.5, 0.5, 0, 0, 1000, 800).collect()}
    assert set(got) == {"1", "2"}
    assert got["1"].kind == "Polygon" and len(got["1"].ring) == 5
    assert (got["1"].ring[0].x, got["1"].ring[0].y) == (300.0, 300.0)
    assert got["2"].kind == "Point" and (got["2"].ring[0].x, got["2"].ring[0].y) == (500.0, 400.0)
    half = {r.ndpa_id: r for r in annotations.read_ndpa(spark, str(tmp_path / "a.ndpa"), None, 1.0, 0, 0, 1000, 800, mpp=0.5).collect()}
    assert (half["1"].ring[0].x, half["1"].ring[0].y) == (300.0, 350.0)
    with pytest.raises(ValueError):
        annotations.read_ndpa(spark, "x", None, None, 0, 0, 1, 1)


def test_association_errors(spark):
    df = spark.createDataFrame([(1, 0, 1.0)], "tile_id long, dim long, v double")
    with pytest.raises(ValueError):
        omics.association(df, df.select("tile_id", F.lit(1.0).alias("score")), "other")


def test_components_of_small_and_large_groups_are_the_same(spark, monkeypatch):
    """Groups up to WHOLE edges are labelled in one call without rounds, larger ones by rounds."""
    import random

    from tessella.plans import components

    rng = random.Random(5)
    rows = [(s, rng.randrange(40), rng.randrange(40)) for s in range(12) for _ in range(3 * s + 1)] + [(3, None, 4), (3, 5, None)]
    edges = spark.createDataFrame(rows, "slide_id long, a long, b long")
    got = {}
    for whole in (1_000_000, 15, 0):
        monkeypatch.setattr(components, "WHOLE", whole)
        with monkeypatch.context() as m:
            if whole == 1_000_000:
                m.setattr(components, "connected_components", None)
            got[whole] = sorted(components.slide_components(edges, "a", "b", "id").collect())
    assert got[1_000_000] == got[15] == got[0]
    reach = {}
    for s, a, b in rows:
        if a is not None and b is not None:
            one, other = reach.setdefault((s, a), {a}), reach.setdefault((s, b), {b})
            one |= other
            for v in one:
                reach[s, v] = one
    assert [(r[0], r[1], r[2]) for r in got[0]] == sorted((s, v, min(c)) for (s, v), c in reach.items())
    assert components.slide_components(edges.limit(0), "a", "b", "id").count() == 0
