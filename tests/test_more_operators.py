import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.__main__ import main
from tessella.functions.rings import clip, clipped, clipped_area, hull, hull_area
from tessella.operators import masks, omics, shapes
from tessella.settings import Settings
from tessella.sources.store import SlideStore, cohort, feature_key, pyramid
from tessella.streaming.arrivals import running_means, stream_features, write_means

RING = "array<struct<x:double,y:double>>"
U = [(0, 0), (6, 0), (6, 6), (4, 6), (4, 2), (2, 2), (2, 6), (0, 6), (0, 0)]


def area(p):
    x, y = np.array(p, float).T
    return abs(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2


def test_clip_of_a_concave_shape():
    rng = np.random.default_rng(0)
    for _ in range(200):
        x0, y0 = rng.integers(-2, 6, 2)
        x1, y1 = x0 + rng.integers(1, 6), y0 + rng.integers(1, 6)
        got = clip(np.array(U, float), x0, y0, x1, y1)
        cells = sum(1 for i in range(x0, x1) for j in range(y0, y1) if 0 <= i < 6 and 0 <= j < 6 and not (2 <= i < 4 and j >= 2))
        assert (area(got) if len(got) > 2 else 0) == pytest.approx(cells)


def test_hull():
    assert area(hull(np.array(U, float))) == 36
    assert len(hull(np.array([(0, 0), (1, 1), (0, 0)], float))) == 2


def test_ring_functions(spark):
    df = spark.createDataFrame([([tuple(map(float, p)) for p in U], 0, 0, 3, 6), (None, 0, 0, 1, 1)], f"ring {RING}, x0 int, y0 int, x1 int, y1 int")
    got = df.select(clipped_area("ring", "x0", "y0", "x1", "y1").alias("c"), hull_area("ring").alias("h")).collect()
    assert [(r.c, r.h) for r in got] == [(14.0, 36.0), (0.0, 0.0)]
    out = shapes.ellipse_props(df.limit(1)).first()
    assert out.convex_area == 36 and out.solidity == pytest.approx(28 / 36)
    tilted = spark.createDataFrame([([(0.0, 0.0), (4.0, 4.0), (3.0, 5.0), (-1.0, 1.0), (0.0, 0.0)],)], f"ring {RING}")
    assert shapes.ellipse_props(tilted).first().orientation == pytest.approx(np.pi / 4)


def test_masks(spark):
    df = spark.createDataFrame([(0, 0, 0, 2, 1, "a"), (0, 1, 0, 3, 1, "b")], "slide_id long, x0 long, y0 long, x1 long, y1 long, k string")
    drawn = masks.draw(df, 1, "k")
    assert drawn.count() == 4 and masks.to_binary(drawn).count() == 3
    multi = {r.x: r.v for r in masks.to_multiclass(drawn, {"a": 1, "b": 2}).collect()}
    assert multi == {0: 1, 1: 2, 2: 2}
    named = masks.class_names(masks.to_multilabel(masks.to_multiclass(drawn, {"a": 1, "b": 2})), "c", {2: "b"})
    assert sorted(r["class"] or "" for r in named.collect()) == ["", "b", "b"]


def test_find_tissues(spark):
    px = [(0, y, x, 220 if 3 <= y < 9 and 3 <= x < 9 else 5) for y in range(16) for x in range(16)]
    got = masks.find_tissues(spark.createDataFrame(px, "image_id long, y long, x long, v long"), scale=4).collect()
    assert len(got) == 1 and (got[0].x0, got[0].y0, got[0].x1, got[0].y1) == (12, 12, 36, 36)


def test_split_and_dissolve_near(spark):
    df = spark.createDataFrame([(1, 0.4), (2, 0.5), (3, 0.6)], "id long, p double")
    assert {r.id: r.side for r in masks.threshold_split(df, "p", 0.5).collect()} == {1: "negative", 3: "positive"}
    boxes = spark.createDataFrame([(0, 1, "a", 0, 0, 4, 4, 0.2), (0, 2, "a", 8, 0, 12, 4, 0.9), (0, 3, "a", 17, 0, 20, 4, 0.1), (0, 4, "b", 4, 0, 8, 4, 0.3)], "slide_id long, cell_id long, class string, x0 long, y0 long, x1 long, y1 long, prob double")
    got = {(r["class"], r.region): (r.n, r.prob) for r in shapes.dissolve_near(boxes, "class", 2).collect()}
    assert got == {("a", 1): (2, 0.9), ("a", 3): (1, 0.1), ("b", 4): (1, 0.3)}


def test_store_and_commands(spark, tmp_path, capsys):
    at = str(tmp_path / "s")
    store = SlideStore(spark, at)
    store.put("tissues", spark.createDataFrame([(0, 1, 0, 0, 600, 512), (1, 2, 0, 0, 300, 300)], "slide_id long, tissue_id long, x0 long, y0 long, x1 long, y1 long"))
    with pytest.raises(Exception):
        store.put("tissues", store.get("tissues"))
    main(["info", at], spark)
    assert "600" in capsys.readouterr().out
    main(["preprocess", at, "--tile-px", "256"], spark)
    tiles = store.get("tiles")
    assert tiles.where("slide_id = 0").count() == 4 and tiles.where("slide_id = 1").count() == 1
    store.put("images", tiles.where("slide_id = 0").select("tile_id", F.array(F.col("x0").cast("double"), F.lit(1.0)).alias("vec")))
    main(["feature", at, "--model", "moments"], spark)
    assert store.get(feature_key("moments")).count() == 4
    store.put("flags", tiles.withColumn("qc", F.col("x0") == 0))
    main(["qc", at, "--element", "flags"], spark)
    assert store.get("flags_passed").count() == 3
    tiles.where("slide_id = 0").write.parquet(f"{at}/one/tiles")
    store.get(feature_key("moments")).write.parquet(f"{at}/one/moments_tiles")
    (tmp_path / "c.csv").write_text("store\none\n")
    main(["agg", at, "--slides", str(tmp_path / "c.csv"), "--features", "moments_tiles", "--out", f"{at}/agg"], spark)
    assert spark.read.parquet(f"{at}/agg").count() == 4
    assert cohort(spark, str(tmp_path / "c.csv"), "store", "/r").first().store == "/r/one"
    updated = store.update("tiles", tiles.select("slide_id", "tile_id", F.lit(1).alias("more")), ["slide_id", "tile_id"], "tiles2")
    assert updated.where("more = 1").count() == tiles.count()


def test_pyramid(spark):
    df = spark.createDataFrame([(7, [(0, 100, 80, 1.0), (1, 50, 40, 2.0)])], "slide_id long, levels array<struct<level:long,height:long,width:long,downsample:double>>")
    assert [(r.level, r.height) for r in pyramid(df).orderBy("level").collect()] == [(0, 100), (1, 50)]


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i % 2, i, [float(i), 1.0]) for i in range(20)], "slide_id long, tile_id long, vec array<double>")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    means = running_means(stream_features(spark, str(tmp_path / "in"), rows.schema, 1), "slide_id")
    write_means(means, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = {(r.slide_id, r.dim): (r.value, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(0, 0): (9.0, 10), (1, 0): (10.0, 10), (0, 1): (1.0, 10), (1, 1): (1.0, 10)}


def test_settings(spark):
    Settings(batch_rows=7).apply(spark)
    assert Settings.read(spark).batch_rows == 7
    with pytest.raises(ValueError):
        Settings(batch_rows=0)
    with pytest.raises(TypeError):
        Settings(progress=1)


def test_many_clips_at_once_equal_single_ones(spark):
    """Rings without a point, without an area and beyond the box among others, in one call."""
    rng = np.random.default_rng(1)
    rings = [None, [], [(1.0, 1.0)], *[[tuple(map(float, p)) for p in rng.integers(-5, 9, (n, 2))] for n in (2, 3, 5, 8, 8, 4)], [tuple(map(float, p)) for p in U]]
    boxes = [tuple(map(int, (x, y, x + w, y + h))) for x, y, w, h in zip(*rng.integers(-3, 3, (2, 10)), *rng.integers(1, 6, (2, 10)))]
    many, row = clipped(np.array([p for r in rings for p in r or []], float), np.repeat(np.arange(10), [len(r or []) for r in rings]), np.array(boxes, float))
    for k, (r, b) in enumerate(zip(rings, boxes)):
        assert many[row == k].tolist() == (clip(np.array(r, float), *b).tolist() if r else [])
    df = spark.createDataFrame([(k, r, *b) for k, (r, b) in enumerate(zip(rings, boxes))], f"k int, ring {RING}, x0 int, y0 int, x1 int, y1 int").coalesce(1)
    got = {r.k: r.c for r in df.select("k", clipped_area("ring", "x0", "y0", "x1", "y1").alias("c")).collect()}
    cut = [clip(np.array(r, float), *b) if r else [] for r, b in zip(rings, boxes)]
    assert [got[k] for k in range(10)] == pytest.approx([area(p) if len(p) > 2 else 0 for p in cut])


def test_kendall_of_ties_writes_no_row_for_each_bit(spark):
    """Equals a count of all pairs, with values that most rows share; what is kept beside the rows is a few times their size."""
    import pathlib

    rng = random.Random(5)
    score = [rng.choice([0.5, rng.random(), round(rng.random(), 2)]) for _ in range(1500)]
    columns = {"few": [rng.randrange(3) for _ in score], "mostly none": [s * rng.random() if rng.random() < 0.3 else 0.0 for s in score], "own": [rng.gauss(s, 1) for s in score], "flat": [1.0 for _ in score]}
    genes = [(i, d, float(v)) for d, vs in columns.items() for i, v in enumerate(vs)] + [(0, "own", None), (1, "flat", float("nan"))]
    genes = spark.createDataFrame(genes, "tile_id long, dim string, v double")
    scores = spark.createDataFrame(list(enumerate(score)), "tile_id long, score double")
    at = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    size = lambda: sum(p.stat().st_size for p in at.rglob("*") if p.is_file())
    before = size()
    got = {r["dim"]: r.r for r in omics.association(genes, scores, "kendall").collect()}
    assert size() - before < 100 * 4 * len(score)
    columns["flat"].append(math.inf)
    score.append(score[1])
    sign = lambda d: (d > 0) - (d < 0)
    for d, v in columns.items():
        pairs = [(sign(v[i] - v[j]), sign(score[i] - score[j])) for i in range(len(v)) for j in range(i)]
        root = math.sqrt(sum(x != 0 for x, _ in pairs) * sum(y != 0 for _, y in pairs))
        assert got[d] == pytest.approx(sum(x * y for x, y in pairs) / root), d


def test_softmax_of_several_blocks_shuffles_no_score(spark, monkeypatch):
    """Equals numpy, also for a tile that comes twice and scores far apart; pairs are made last."""
    from tessella.operators import similarity

    rng = np.random.default_rng(2)
    a, t = rng.normal(size=(5, 3)), rng.normal(size=(7, 3)) * 400
    rows = [(0, i, a[i].tolist()) for i in (0, 1, 2, 3, 3)] + [(1, 0, a[4].tolist())]
    features = spark.createDataFrame(rows, "slide_id long, tile_id long, vec array<double>")
    texts = spark.createDataFrame([(j, v.tolist()) for j, v in enumerate(t)], "text_id long, vec array<double>")
    monkeypatch.setattr(similarity, "TEXTS_AT_ONCE", 2)
    out = similarity.text_image_similarity(features, texts, normalize=False, softmax=True)
    assert out._jdf.queryExecution().optimizedPlan().toString().startswith("MapInArrow")
    s = a @ t.T
    share = np.exp(s - s.max(1)[:, None])
    share /= share.sum(1)[:, None]
    expected = [(0, i, j, share[i, j] / (2 if i == 3 else 1)) for i in (0, 1, 2, 3, 3) for j in range(7)] + [(1, 0, j, share[4, j]) for j in range(7)]
    got = sorted(out.collect())
    assert [tuple(r)[:3] for r in got] == [e[:3] for e in sorted(expected)]
    assert np.allclose([r.score for r in got], [e[3] for e in sorted(expected)])
