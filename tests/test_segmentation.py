"""Segmentation runs, thresholds, palettes, plans and model surfaces on small inputs."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import annotations, models, palette, segmentation, shapes, viewport
from tessella.plans.session import shared_dir

BOX = "slide_id long, {} long, x0 long, y0 long, x1 long, y1 long"


def pictures(spark, values, edge):
    rows = [(0, i, x, y, [float(v) for v in np.asarray(p).ravel()]) for i, (x, y, p) in enumerate(values)]
    return spark.createDataFrame(rows, "slide_id long, tile_id long, x long, y long, vec array<double>"), edge


def test_thresholds(spark):
    values = spark.createDataFrame([(p, float(v)) for p in "ab" for v in (1, 1, 2, 9, 9, 8)], "prompt string, v double")
    otsu = {r.prompt: r.threshold for r in segmentation.thresholds(values, "otsu").collect()}
    assert all(2 < t < 8 for t in otsu.values()) and len(otsu) == 2
    assert {r.threshold for r in segmentation.thresholds(values, 3).collect()} == {3.0}
    assert {r.prompt: r.threshold for r in segmentation.thresholds(values, [1, 2]).collect()} == {"a": 1.0, "b": 2.0}
    with pytest.raises(IndexError):
        segmentation.thresholds(values, [1])
    for bad in ("other", None, True):
        with pytest.raises(ValueError):
            segmentation.thresholds(values, bad)
    with pytest.raises(ValueError):
        segmentation.thresholds(values.limit(0), "otsu")


def test_padding_round_trip(spark):
    images, edge = pictures(spark, [(0, 0, np.arange(1, 10).reshape(3, 3))], 3)
    big, before = segmentation.padded(images, edge, 4)
    assert np.array(big.first().vec).reshape(4, 4)[before : before + 3, before : before + 3].tolist() == np.arange(1, 10).reshape(3, 3).tolist()
    pixels = segmentation.unpadded(segmentation.segment_tiles(big, lambda x: x, 4), 3, before)
    assert {(r.py, r.px): r.v for r in pixels.collect()} == {(y, x): 3.0 * y + x + 1 for y in range(3) for x in range(3)}


def test_segmentation_models_are_checked(spark):
    images, edge = pictures(spark, [(0, 0, np.ones((4, 4)))], 4)
    with pytest.raises(TypeError):
        segmentation.segment_tiles(images, 3, edge)
    with pytest.raises(Exception):
        segmentation.segment_tiles(images, lambda x: x[:, :2], edge).collect()

    class Model:
        def segment(self, batch):
            return batch * 2

    assert {r.v for r in segmentation.segment_tiles(images, Model(), edge).collect()} == {2.0}
    kept = segmentation.segment_tiles(images, lambda x: np.arange(16).reshape(1, 4, 4), edge, keep=lambda m: [3, 7])
    assert sorted(r.v for r in kept.collect()) == [3.0, 7.0]


def test_semantic_votes_are_blended(spark):
    """Two tiles overlap in two columns; there the one whose middle is nearer decides."""
    left, right = np.full((4, 4), 1), np.full((4, 4), 2)
    images, edge = pictures(spark, [(0, 0, left), (2, 0, right)], 4)
    runner = segmentation.SemanticRunner(lambda x: x, edge, {1: "a", 2: "b"}, "gaussian", sigma_scale=0.25)
    votes = {(r.y, r.x): r.v for r in runner.class_map(images).collect()}
    assert [votes[1, x] for x in range(6)] == [1, 1, 1, 2, 2, 2]
    assert sorted((r["class"], r.area) for r in runner(images).collect()) == [("a", 12.0), ("b", 12.0)]
    with pytest.raises(ValueError):
        segmentation.SemanticRunner(lambda x: x, edge, {}, "other")
    with pytest.raises(NotImplementedError):
        runner.tiler(images)


def test_artifact_variants():
    names = {0: "Background", 1: "Normal Tissue", 2: "Fold"}
    assert segmentation.artifact_runner(lambda x: x, 512, 1.5, 0, names).mode == "constant"
    assert segmentation.artifact_runner(lambda x: x, 512, 2.0, 64, names, "5x").mode == "gaussian"
    for tile, mpp, variant in ((256, 1.5, "7x"), (512, 1.0, "7x"), (512, 1.5, "9x")):
        with pytest.raises(ValueError):
            segmentation.artifact_runner(lambda x: x, tile, mpp, 0, names, variant)


def test_cells_at_tile_edges_go(spark):
    picture = np.zeros((10, 10))
    picture[0:3, 0:3], picture[4:6, 4:7] = 1, 2
    images, edge = pictures(spark, [(100, 50, picture)], 10)
    found = segmentation.CellRunner(lambda x: x, edge, 2).run(images).collect()
    assert [(r.cell_id, r.instance, r.area, r.x0, r.y0, r.x1, r.y1) for r in found] == [(0, 2, 6, 104, 54, 107, 56)]
    assert segmentation.CellRunner(lambda x: x, edge, 2, size=(7, 99)).run(images).count() == 0
    tissues = spark.createDataFrame([(0, 9, 0, 0, 500, 500)], BOX.format("tissue_id"))
    assert segmentation.CellRunner(lambda x: x, edge, 2).run(images, tissues).first().tissue_id == 9


def test_zero_shot_regions_have_holes(spark):
    tiles = spark.createDataFrame([(0, 3 * y + x, 10 * x, 10 * y, 10 * x + 10, 10 * y + 10) for y in range(3) for x in range(3)], BOX.format("tile_id"))
    scores = tiles.select("slide_id", "tile_id", F.lit("p").alias("prompt"), (F.col("tile_id") != 4).cast("double").alias("v"))
    found = segmentation.zero_shot_regions(tiles, scores, 0.5, 10, 3, 3).collect()
    assert [(r.prompt, r.area, len(r.holes), r.x1) for r in found] == [("p", 800.0, 1, 30)]
    smooth = segmentation.prompt_mask(tiles, 3, 3, 10, blur=3)
    assert smooth.agg(F.sum("v")).first()[0] == 9


def test_running_numbers_and_offsets(spark):
    rows = spark.createDataFrame([(s, t, i, i, i + 1, i + 1) for s in (0, 1) for t, i in ((7, 1), (0, 2), (7, 0), (99, 5))], BOX.format("tile_id"))
    got = segmentation.numbered(rows, 8).collect()
    assert {(r.slide_id, r.tile_id, r.x0): r.cell_id for r in got} == {(s, t, x): n for s in (0, 1) for n, (t, x) in enumerate(((0, 2), (7, 0), (7, 1), (99, 5)))}


def test_palettes(spark):
    df = spark.createDataFrame([(i, c, "#0102ff" if c == "b" else None) for i, c in enumerate("bacab")], "id long, c string, own string")
    colors = lambda **k: {r["class"]: json.loads(r.color)["color"] for r in palette.class_colors(df, "c", "id", **k).collect()}
    assert colors() == {"b": [27, 158, 119], "a": [217, 95, 2], "c": [117, 112, 179]}
    assert colors(colors="own") == {"b": [1, 2, 255], "a": None, "c": None}
    assert colors(colors={"a": "#000000"}) == {"b": None, "a": [0, 0, 0], "c": None}
    assert colors(colors=["#ffffff"]) == {"b": [255, 255, 255], "a": None, "c": None}
    for bad in ({"colors": "nothing"}, {"colors": 3}):
        with pytest.raises(ValueError):
            palette.class_colors(df, "c", "id", **bad)
    with pytest.raises(ValueError):
        palette.class_colors(df, "missing", "id")
    many = spark.createDataFrame([(i, f"k{i:02}") for i in range(22)], "id long, c string")
    twenty = {r.category: r.color for r in palette.palette(many, "c", "id").collect()}
    assert twenty["k00"] == twenty["k20"] == "#1f77b4" and len(set(twenty.values())) == 20
    assert {r.color for r in palette.palette(many, "c", "id", "#101010").collect()} == {"#101010"}
    with pytest.raises(ValueError):
        palette.palette(many, "c", "id", "red")


def test_color_values(spark):
    tiles = spark.createDataFrame([(0, 1, 5.0)], "slide_id long, tile_id long, qc double")
    feats = spark.createDataFrame([(1, [1.0, 2.0], "x")], "tile_id long, vec array<double>, domain string")
    assert palette.color_values(tiles, "qc").first().value == 5.0
    assert palette.color_values(tiles, "domain", feats).first().value == "x"
    assert palette.color_values(tiles, "g", feats, ["f", "g"]).first().value == 2.0
    assert palette.color_values(tiles, "0", feats).first().value == 1.0
    for args in (("other",), ("other", feats)):
        with pytest.raises(ValueError):
            palette.color_values(tiles, *args)


def test_plans():
    assert viewport.zoom_view((0, 0, 100, 200), (0.1, 0.5), (0, 1)) == (10, 0, 50, 200)
    assert viewport.zoom_view((10, 20, 100, 200), (5, 9), (2, 30)) == (15, 22, 19, 50)
    for x, y in (((0.1, 0.5), (2, 30)), ((0.5, 0.1), (0, 1))):
        with pytest.raises(ValueError):
            viewport.zoom_view((0, 0, 9, 9), x, y)


def test_model_surfaces(spark):
    feats = spark.createDataFrame([(0, i, i, 0, [float(i), 2.0, 3.0, 4.0]) for i in range(4)], "slide_id long, tile_id long, x long, y long, vec array<double>")

    class Dense:
        def encode_image_dense(self, x):
            return x[:, :1], x.reshape(len(x), 2, 2)

    pooled, tokens = models.dense_features(feats, Dense(), "cls_patch_mean")
    assert {r.tile_id: r.vec for r in pooled.collect()} == {i: [i, (i + 3) / 2, 3.0] for i in range(4)}
    assert {(r.tile_id, r.token): r.vec for r in tokens.collect()}[2, 1] == [3.0, 4.0]
    with pytest.raises(ValueError):
        models.dense_features(feats, Dense(), "mean")
    with pytest.raises(TypeError):
        models.dense_features(feats, 3)
    slide = models.slide_vectors(feats, lambda f, c, base_tile_size: f.sum(0) + c[:, 0].max() + base_tile_size, base_tile=10).first()
    assert slide.vec[1] == 8 + 3 + 10
    with pytest.raises(ValueError):
        models.slide_vectors(feats, lambda f, c: f.sum(0), most=3)
    texts = spark.createDataFrame([(1, "ab"), (2, None)], "text_id long, text string")
    assert {r.text_id: r.vec for r in models.text_vectors(texts, lambda t: [[len(x)] for x in t]).collect()} == {1: [2.0], 2: [0.0]}
    got = models.scores(feats, lambda f, p: f[:, : len(p)], ["a", "b"], ("tile_id",)).collect()
    assert {(r.tile_id, r.prompt): r.p for r in got}[3, "b"] == 2.0 and len(got) == 8
    with pytest.raises(Exception):
        models.scores(feats, lambda f, p: f, ["a"], ("tile_id",)).collect()
    with pytest.raises(ValueError):
        models.scores(feats, lambda f, p: f, [], ("tile_id",))
    tiles = models.tile_prediction(feats, lambda x: {"s": x[:, 0]}, ("s",), feats.drop("vec"), transform=lambda x: x * 2)
    assert {r.tile_id: r.s for r in tiles.collect()} == {i: 2.0 * i for i in range(4)}


SHAPES = {
    "Point": [1, 2], "MultiPoint": [[1, 2], [3, 4]], "LineString": [[0, 0], [5, 5]], "MultiLineString": [[[0, 0], [1, 1]], [[2, 2], [3, 3]]],
    "Polygon": [[[0, 0], [20, 0], [20, 20], [0, 20], [0, 0]], [[5, 5], [10, 5], [10, 10], [5, 10], [5, 5]]],
    "MultiPolygon": [[[[0, 0], [20, 0], [20, 20], [0, 0]]], [[[30, 30], [31, 30], [31, 31], [30, 30]]]],
}


def test_load_all_kinds(spark, tmp_path):
    features = [{"type": "Feature", "geometry": {"type": k, "coordinates": c}, "properties": {"k": k}} for k, c in SHAPES.items()]
    path = tmp_path / "a.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    rows = annotations.load_annotations(spark, str(path), json_flatten={"properties": {"k": "string"}}, in_bounds=(100, 200), min_area=100).collect()
    assert sorted((r.properties_k, r.kind) for r in rows) == sorted(
        [("Point", "Point"), ("MultiPoint", "Point"), ("MultiPoint", "Point"), ("LineString", "LineString"), ("MultiLineString", "LineString"), ("MultiLineString", "LineString"), ("Polygon", "Polygon"), ("MultiPolygon", "Polygon")]
    )
    ring = next(r for r in rows if r.properties_k == "Polygon")
    assert (ring.x0, ring.y0, ring.x1, ring.y1, len(ring.holes)) == (100, 200, 120, 220, 1)
    assert annotations.load_annotations(spark, str(path), explode=False).count() == 6
    tiles = spark.createDataFrame([(0, 1, 100, 200, 110, 210), (0, 2, 115, 200, 130, 230)], BOX.format("tile_id"))
    joined = annotations.load_annotations(spark, str(path), in_bounds=(100, 200), join_with=[tiles]).where("kind = 'Polygon'").collect()
    assert {r.r_tile_id for r in joined} == {1, 2}
    with pytest.raises(ValueError):
        annotations.load_annotations(spark, 3)


def test_semantic_polygons_of_probabilities(spark):
    """A seam of one pixel closes, pixels at the threshold and ignored classes go, tissues clip."""
    p = np.zeros((3, 20, 30))
    p[0] = 0.9
    p[1, 2:8, 2:10], p[1, 2:8, 11:15], p[1, 12:16, 22:28] = 0.8, 0.6, 0.95
    p[1, 18, 2:9], p[2, 2:6, 2:6] = 0.5, 0.7
    rows = [(0, y, x, c, float(p[c, y, x])) for c in range(3) for y in range(20) for x in range(30)]
    df = spark.createDataFrame(rows, "slide_id long, y long, x long, c long, p double")
    got = {(r["class"], round(r.x0, 6)): r for r in segmentation.semantic_polygons(df, {1: "one", 2: "two"}, scale=2).collect()}
    assert {k: round(r.prob, 6) for k, r in got.items()} == {("one", 4.0): 0.95, ("one", 44.0): 0.95, ("two", 4.0): 0.7}
    # The gap is as wide as the tolerance on both sides: half a circle stays open at either mouth.
    assert got["one", 4.0].area == pytest.approx(4 * (6 * 8 + 6 * 4) + 2 * 12 - np.pi, abs=0.05) and got["two", 4.0].area == pytest.approx(64, abs=0.1)
    tissue = spark.createDataFrame([(0, 1, 50, 20, 90, 60)], BOX.format("tissue_id"))
    kept = segmentation.semantic_polygons(df, {1: "one"}, scale=2, tissues=tissue, ignore=(0, 2)).collect()
    assert [(r["class"], round(r.x0, 6)) for r in kept] == [("one", 44.0)]
    assert segmentation.semantic_polygons(df.limit(0), {}).count() == 0


def test_unions_are_made_once_for_the_tissues(spark):
    """The join with tissues reads its left side twice; it finds the unions made."""
    df = spark.createDataFrame([(0, y, x, 1, 0.9) for y in range(4) for x in range(5)], "slide_id long, y long, x long, c long, p double")
    tissue = spark.createDataFrame([(0, 1, 0, 0, 90, 60)], BOX.format("tissue_id"))
    kept = segmentation.semantic_polygons(df, {1: "one"}, tissues=tissue)
    assert "MapInArrow" not in kept._jdf.queryExecution().toString()
    assert [(r["class"], round(r.area, 2)) for r in kept.collect()] == [("one", 20.0)]


def test_probabilities_are_averaged_over_tiles(spark):
    images, edge = pictures(spark, [(0, 0, np.full((4, 4), 2.0)), (2, 0, np.full((4, 4), 6.0))], 4)
    runner = segmentation.ProbabilityRunner(lambda b: np.stack([b / 10, 1 - b / 10], axis=1), edge, {0: "a"}, "constant")
    got = {(r.c, r.y, r.x): round(r.p, 9) for r in runner.probability(images).collect()}
    assert got[0, 0, 0] == 0.2 and got[0, 3, 2] == 0.4 and got[0, 1, 5] == 0.6 and got[1, 3, 3] == 0.6 and len(got) == 2 * 4 * 6
    with pytest.raises(Exception):
        segmentation.ProbabilityRunner(lambda b: b, edge, {}).probability(images).collect()


def test_export_is_checked(spark, tmp_path):
    df = spark.createDataFrame([(0, 1, 5, 6, 9, 9, "a")], BOX.format("id") + ", class string")
    line = annotations.export_annotations(df, classes="class", order="id", in_bounds=(5, 6)).first().value
    assert json.loads(line)["geometry"]["coordinates"][0][0] == [0.0, 0.0]
    assert json.loads(line)["properties"]["classification"]["name"] == "a"
    with pytest.raises(NotADirectoryError):
        annotations.export_annotations(df, str(tmp_path / "no" / "out"))
    for bad in ({"classes": "other"}, {"format": "x"}, {"classes": "class", "colors": "other"}):
        with pytest.raises(ValueError):
            annotations.export_annotations(df, **bad)
    with pytest.raises(ValueError):
        annotations.export_annotations(df.select("id"))


def test_hu_moments_and_holes(spark):
    """Against pixel sums of a fine drawing of a triangle; invariant to a turn and a scaling."""
    rings = [[(0, 0), (90, 0), (0, 30), (0, 0)], [(0, 0), (0, 180), (-60, 0), (0, 0)]]
    rows = [(i, [{"x": float(x), "y": float(y)} for x, y in r], [[{"x": float(x), "y": float(y)} for x, y in ((1, 1), (3, 1), (3, 3), (1, 3), (1, 1))]]) for i, r in enumerate(rings)]
    df = spark.createDataFrame(rows, "id long, ring array<struct<x: double, y: double>>, holes array<array<struct<x: double, y: double>>>")
    a, b = (np.array(r[3:]) for r in shapes.hu_moments(df).orderBy("id").collect())
    assert a == pytest.approx(b, rel=1e-6, abs=1e-12)
    y, x = np.mgrid[0:3000, 0:9000] / 100 + 0.005
    on = y / 30 + x / 90 < 1
    x, y, area = x[on], y[on], on.sum() / 1e4
    n = lambda p, q: ((x - x.mean()) ** p * (y - y.mean()) ** q).sum() / 1e4 / area ** (1 + (p + q) / 2)
    assert a[0] == pytest.approx(n(2, 0) + n(0, 2), rel=1e-3)
    assert a[1] == pytest.approx((n(2, 0) - n(0, 2)) ** 2 + 4 * n(1, 1) ** 2, rel=1e-3)
    assert a[2] == pytest.approx((n(3, 0) - 3 * n(1, 2)) ** 2 + (3 * n(2, 1) - n(0, 3)) ** 2, rel=1e-3)
    assert shapes.tissue_props(df, holes="holes").where("id = 0").first().area == 1350 - 4


def test_shared_dir_is_the_sessions(spark):
    assert shared_dir(spark).startswith("file://")
