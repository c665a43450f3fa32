import numpy as np
import pytest

from tessella.operators import halo, raster, transforms

PIXEL = "image_id long, y long, x long, v long"


def picture(spark, high, wide, seed=1, holes=0.1):
    """Two images with holes, one of them away from the origin."""
    rng = np.random.default_rng(seed)
    held = {(i, y + i * 3, x - i * 5): int(rng.integers(0, 6)) for i in (0, 1) for y in range(high) for x in range(wide) if rng.random() > holes}
    return spark.createDataFrame([(*k, v) for k, v in held.items()], PIXEL), held


def near(held, at, offsets):
    i, y, x = at
    return [held[i, y + dy, x + dx] for dy, dx in offsets if (i, y + dy, x + dx) in held]


@pytest.mark.parametrize("side", [4, 7, 128])
def test_filters_equal_plain_loops_whatever_the_chunks(spark, side, monkeypatch):
    monkeypatch.setattr(halo.filtered, "__defaults__", (side,))
    monkeypatch.setattr(halo, "AT_ONCE", 200)
    pixels, held = picture(spark, 13, 18)
    square = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    disk = [(a, b) for a in range(-2, 3) for b in range(-2, 3) if a * a + b * b <= 4]
    medians = {(r.image_id, r.y, r.x): r.v for r in raster.median_blur(pixels, 3).collect()}
    entropies = {(r.image_id, r.y, r.x): r.v for r in transforms.local_entropy(pixels, 2).collect()}
    blurred = {(r.image_id, r.y, r.x): r.v for r in transforms.gaussian_blur(pixels, 3, 0.9).collect()}
    assert medians.keys() == entropies.keys() == blurred.keys() == held.keys()
    w = [np.exp(-d * d / (2 * 0.81)) for d in (-1, 0, 1)]
    rows = {k: mean(held, (0, 1), *k, w) for k in held}
    for k in held:
        assert medians[k] == np.median(near(held, k, square))
        counts = np.unique(near(held, k, disk), return_counts=True)[1]
        p = counts / counts.sum()
        assert entropies[k] == pytest.approx(-(p * np.log2(p)).sum(), abs=1e-9)
        assert blurred[k] == pytest.approx(mean(rows, (1, 0), *k, w))


def mean(of, step, i, y, x, w):
    keys = [(i, y + step[0] * d, x + step[1] * d) for d in (-1, 0, 1)]
    there = [(of[k], u) for k, u in zip(keys, w) if k in of]
    return sum(v * u for v, u in there) / sum(u for _, u in there)


def test_nulls_and_empty_images(spark):
    rows = spark.createDataFrame([(0, 0, 0, None), (0, 0, 1, 4), (0, 0, 2, 8), (1, 0, 0, None)], PIXEL)
    got = {(r.image_id, r.x): r.v for r in raster.median_blur(rows, 3).collect()}
    assert got == {(0, 0): 4.0, (0, 1): 6.0, (0, 2): 6.0, (1, 0): None}
    assert raster.median_blur(rows.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        raster.median_blur(rows, 4)


def test_names_of_images_may_be_text(spark):
    rows = spark.createDataFrame([("a", 0, 0, 1.5), ("b", 200, 300, 2.5)], "image_id string, y int, x int, v double")
    assert {(r.image_id, r.y, r.x, r.v) for r in raster.median_blur(rows, 17).collect()} == {("a", 0, 0, 1.5), ("b", 200, 300, 2.5)}


def test_small_pictures_share_a_call(spark):
    """Filters run on many pictures at once; each sees its own pixels alone."""
    pixels = spark.createDataFrame([(i, y, x, (i * 7 + y * 3 + x * 5) % 11) for i in range(300) for y in range(1 + i % 4) for x in range(1 + i % 3)], PIXEL)
    held = {(r.image_id, r.y, r.x): r.v for r in pixels.collect()}
    calls = spark.sparkContext.accumulator(0)

    def counted(seen):
        calls.add(1)
        return halo._sorted_windows(seen, 1, [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)], halo._median_of_sorted)

    got = {(r.image_id, r.y, r.x): r.v for r in halo.filtered(pixels, 1, counted).collect()}
    assert got == {k: np.median(near(held, k, [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)])) for k in held}
    assert calls.value < 60
