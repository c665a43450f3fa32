"""Masks, polygons, chunks and transforms against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import polygons, transforms
from tessella.sources import images

ART = ["#####....", "#...#..#.", "#.#.#....", "#...#.##.", "#####.##.", ".....#...", "..##.....", ".#..#....", "..##....."]


def mask_of(spark, art, image=0):
    return spark.createDataFrame([(image, y, x, int(c == "#")) for y, row in enumerate(art) for x, c in enumerate(row)], "image_id long, y long, x long, v long")


def components(on, corners):
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if corners else [])
    left, out = set(on), []
    while left:
        todo, part = [left.pop()], set()
        while todo:
            y, x = todo.pop()
            part.add((y, x))
            near = {(y + a, x + b) for a, b in steps} & left
            left -= near
            todo += near
        out.append(part)
    return out


@pytest.mark.parametrize("seed", [None, 1, 2, 3])
def test_polygons_have_the_areas_and_holes_of_components(spark, seed):
    if seed is None:
        art = ART
    else:
        rng = np.random.default_rng(seed)
        art = ["".join("#" if v else "." for v in row) for row in rng.random((14, 17)) < 0.55]
    on = {(y, x) for y, row in enumerate(art) for x, c in enumerate(row) if c == "#"}
    got = polygons.mask_polygons(mask_of(spark, art)).collect()
    parts = components(on, True)
    assert sorted(r.area for r in got) == sorted(len(p) for p in parts)
    off = {(y, x) for y in range(-1, len(art) + 1) for x in range(-1, len(art[0]) + 1)} - on
    inner = [p for p in components(off, False) if (-1, -1) not in p]
    assert sum(len(r.holes) for r in got) == len(inner)
    for r in got:
        assert r.ring[0] == r.ring[-1] and all((a.x == b.x) != (a.y == b.y) for a, b in zip(r.ring, r.ring[1:]))
        own = next(p for p in parts if r.component == min(y * 2**32 + x for y, x in p))
        assert (r.x0, r.y0, r.x1, r.y1) == (min(x for _, x in own), min(y for y, _ in own), max(x for _, x in own) + 1, max(y for y, _ in own) + 1)


def test_limits_and_filled_holes(spark):
    mask = mask_of(spark, ART)
    assert all(not r.holes for r in polygons.mask_polygons(mask, holes=False).collect())
    big = polygons.mask_polygons(mask, least_area=15, least_hole=5).collect()
    assert [(r.area, len(r.holes)) for r in big] == [(21.0, 1)]


def test_class_and_instance_polygons(spark):
    rows = [(0, 0, x, v) for x, v in enumerate([1, 1, 2, 0, 1, 3])]
    mask = spark.createDataFrame(rows, "image_id long, y long, x long, v long")
    got = polygons.class_polygons(mask, {1: "a", 2: "b"}).collect()
    assert sorted((r["class"], r.area) for r in got) == [("3", 1.0), ("a", 1.0), ("a", 2.0), ("b", 1.0)]
    assert sorted(r.class_id for r in polygons.class_polygons(mask, ignore=(0, 1)).collect()) == [2, 3]
    assert sorted((r.instance, r.area) for r in polygons.instance_polygons(mask).collect()) == [(1, 1.0), (1, 2.0), (2, 1.0), (3, 1.0)]
    assert polygons.mask_polygons(mask.limit(0)).count() == 0


def test_mask_checks(spark):
    good = mask_of(spark, ["#."])
    polygons.check_mask(good, "binary")
    with pytest.raises(ValueError):
        polygons.check_mask(good.withColumn("v", F.col("v") + 1), "binary")
    with pytest.raises(ValueError):
        polygons.check_mask(good.withColumn("p", F.lit(1.5)), "probability")
    with pytest.raises(ValueError):
        polygons.check_mask(good, "multilabel")
    with pytest.raises(ValueError):
        polygons.check_mask(good, "other")


def test_points_in_polygons(spark):
    shapes = polygons.mask_polygons(mask_of(spark, ART)).withColumnRenamed("image_id", "slide_id")
    points = spark.createDataFrame([(0, i, x + 0.5, y + 0.5) for i, (y, x) in enumerate((y, x) for y in range(9) for x in range(9))], "slide_id long, point_id long, x double, y double")
    got = {(r.y - 0.5, r.x - 0.5) for r in polygons.points_in_polygons(points, shapes).collect()}
    assert got == {(y, x) for y, row in enumerate(ART) for x, c in enumerate(row) if c == "#"}


def picture(spark, h, w, seed=0, image=0):
    values = np.random.default_rng(seed).integers(0, 256, (h, w))
    return spark.createDataFrame([(image, y, x, int(values[y, x])) for y in range(h) for x in range(w)], "image_id long, y long, x long, v long"), values


def test_chunks_levels_and_regions(spark):
    pixels, values = picture(spark, 21, 30)
    chunks = images.pyramid(pixels, 3, 8).cache()
    assert {(r.level, r.height, r.width, r.downsample) for r in images.level_table(chunks).collect()} == {(0, 21, 30, 1), (1, 11, 15, 2), (2, 6, 8, 4)}
    whole = {(r.y, r.x): r.v for r in images.level_image(chunks, 0).collect()}
    assert whole == {(y, x): values[y, x] for y in range(21) for x in range(30)}
    second = {(r.y, r.x): r.v for r in images.level_image(chunks, 1).collect()}
    assert second == {(y, x): int(values[2 * y : 2 * y + 2, 2 * x : 2 * x + 2].mean()) for y in range(11) for x in range(15)}
    part = {(r.y, r.x): r.v for r in images.region(chunks, 22, 5, 12, 9).collect()}
    assert part == {(y, x): values[5 + y, 22 + x] for y in range(9) for x in range(8)}
    with pytest.raises(ValueError):
        images.region(chunks, 0, 0, 0, 5)
    boxes = spark.createDataFrame([(0, 1, 3, 2, 11, 10), (0, 2, 26, 16, 34, 24)], "slide_id long, tile_id long, x0 long, y0 long, x1 long, y1 long")
    tiles = {r.tile_id: np.array(r.vec).reshape(4, 4) for r in images.tile_images(chunks, boxes, 4, size=8).collect()}
    assert (tiles[1] == values[3:11:2, 4:12:2][:4, :4]).all()
    padded = np.zeros((24, 34))
    padded[:21, :30] = values
    assert (tiles[2] == padded[17:24:2, 27:34:2]).all()
    tissue = images.tissue_images(chunks, boxes.withColumnRenamed("tile_id", "tissue_id"), size=8).where("tissue_id = 2").collect()
    assert {(r.y, r.x): r.v for r in tissue} == {(y, x): values[16 + y, 26 + x] for y in range(5) for x in range(4)}


def test_images_that_lack_pixels(spark):
    """A last row that ends early, a hole and a corner that is cut off move no other pixel."""
    pixels, values = picture(spark, 13, 11)
    gone = "(y >= 9 and x >= 4) or (y = 3 and x = 5) or (y < 2 and x < 3)"
    there = {(r.y, r.x): r.v for r in pixels.where(f"not ({gone})").collect()}
    chunks = images.pyramid(pixels.where(f"not ({gone})"), 2, 8).cache()
    assert {(r.y, r.x): r.v for r in images.level_image(chunks, 0).collect()} == there
    half = {}
    for (y, x), v in there.items():
        half.setdefault((y // 2, x // 2), []).append(v)
    assert {(r.y, r.x): r.v for r in images.level_image(chunks, 1).collect()} == {k: int(np.mean(v)) for k, v in half.items()}
    assert {(r.y + 2, r.x + 1): r.v for r in images.region(chunks, 1, 2, 10, 11).collect()} == {(y, x): v for (y, x), v in there.items() if y >= 2 and x >= 1}
    box = spark.createDataFrame([(0, 1, 0, 0, 11, 13)], "slide_id long, tile_id long, x0 long, y0 long, x1 long, y1 long").cache()
    (tile,) = images.tile_images(chunks, box.withColumn("x1", F.lit(13)), 13, size=8).collect()
    assert tile.vec == [float(there.get((y, x), 0)) for y in range(13) for x in range(13)]
    assert {(r.y, r.x): r.v for r in images.tissue_images(chunks, box.withColumnRenamed("tile_id", "tissue_id"), size=8).collect()} == there


def test_saved_image(spark, tmp_path):
    pixels, _ = picture(spark, 5, 5)
    chunks = images.chunked(pixels, 4)
    images.save_image(chunks, str(tmp_path / "i"), {"dna": chunks, "rna": chunks}, 2.0)
    back = spark.read.parquet(str(tmp_path / "i"))
    assert back.count() == 8 and {(r.channel, r.scale) for r in back.select("channel", "scale").distinct().collect()} == {("dna", 2.0), ("rna", 2.0)}


def test_gaussian_and_entropy(spark):
    pixels, values = picture(spark, 7, 6)
    values = values // 64
    pixels = pixels.withColumn("v", F.expr("v div 64"))
    blurred = {(r.y, r.x): r.v for r in transforms.gaussian_blur(pixels, 3, 0.8).collect()}
    entropy = {(r.y, r.x): r.v for r in transforms.local_entropy(pixels, 2).collect()}
    for y in range(7):
        for x in range(6):
            near = [(i, j) for i in range(7) for j in range(6) if abs(i - y) <= 1 and abs(j - x) <= 1]
            w = [np.exp(-((i - y) ** 2 + (j - x) ** 2) / (2 * 0.64)) for i, j in near]
            assert blurred[y, x] == pytest.approx(np.average([values[i, j] for i, j in near], weights=w))
            disk = [values[i, j] for i in range(7) for j in range(6) if (i - y) ** 2 + (j - x) ** 2 <= 4]
            p = np.unique(disk, return_counts=True)[1] / len(disk)
            assert entropy[y, x] == pytest.approx(-(p * np.log2(p)).sum(), abs=1e-9)
    with pytest.raises(ValueError):
        transforms.gaussian_blur(pixels, 4)


def test_entropy_threshold_finds_texture(spark):
    rng = np.random.default_rng(2)
    rows = [(0, y, x, *(int(v) for v in (rng.integers(60, 200, 3) if 6 <= y < 14 and 6 <= x < 14 else (240, 240, 240)))) for y in range(20) for x in range(20)]
    rgb = spark.createDataFrame(rows, "image_id long, y long, x long, r long, g long, b long")
    mask = {(r.y, r.x): r.v for r in transforms.EntropyThreshold(2)(rgb).collect()}
    assert all(mask[y, x] == 1 for y in range(7, 13) for x in range(7, 13)) and mask[0, 0] == mask[19, 10] == 0
    with pytest.raises(ValueError):
        transforms.EntropyThreshold(0)
    flat = spark.createDataFrame([(0, y, x, 1) for y in range(5) for x in range(5) if True], "image_id long, y long, x long, v long")
    assert {r.v for r in transforms.unflipped(flat).collect()} == {0}


def test_compose_and_parameters(spark):
    rows = [(0, y, x, *((200, 60, 120) if 3 <= y < 9 and 3 <= x < 10 and (y, x) != (5, 5) else (230, 230, 230))) for y in range(12) for x in range(14)]
    rgb = spark.createDataFrame(rows, "image_id long, y long, x long, r long, g long, b long")
    found = transforms.tissue_detection(blur=1, morph=1, n_iterations=1, min_hole_area=1)(rgb).collect()
    assert [(r.area, len(r.holes)) for r in found] == [(41.0, 1)]
    closed = transforms.tissue_detection(blur=1, morph=3, n_iterations=1)(rgb).collect()
    assert [(r.area, len(r.holes)) for r in closed] == [(42.0, 0)]
    step = transforms.MedianBlur(5)
    assert step.params == {"kernel_size": 5} and step.set_params(kernel_size=7).kernel_size == 7
    for bad in (lambda: transforms.MedianBlur(4), lambda: step.set_params(other=1), lambda: transforms.Compose((1,)), lambda: transforms.Channel("x")(rgb), lambda: transforms.BinaryThreshold()(rgb)):
        with pytest.raises(ValueError):
            bad()
    fixed = transforms.Compose((transforms.Channel("grey"), transforms.BinaryThreshold(200)))(rgb)
    assert fixed.agg(F.sum("v")).first()[0] == 12 * 14 - 41


def test_colour_channels(spark):
    df = spark.createDataFrame([(255, 0, 0), (10, 20, 30), (0, 0, 0), (255, 255, 255)], "r int, g int, b int")
    got = df.select(transforms.grey(*map(F.col, "rgb")), transforms.saturation(*map(F.col, "rgb")), *transforms.hed(*map(F.col, "rgb"))).collect()
    assert [tuple(r[:2]) for r in got] == [(76, 255), (18, 170), (0, 0), (255, 0)]
    assert tuple(got[3][2:]) == (0.0, 0.0, 0.0) and got[2][2] > 0
