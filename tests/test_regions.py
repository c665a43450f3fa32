"""Polygons: exact joins, overlay, repair, buffers, unions, drawing and export, by sampling and by hand."""

import json
import math
import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella import queries_shapes
from tessella.functions import planar
from tessella.functions.overlay import buffered, overlap_areas, overlay, parts_area
from tessella.operators import annotations, cells, regions
from tessella.plans.spatial_join import spatial_join

SCHEMA = "slide_id long, id long, class string, prob double, ring array<struct<x: double, y: double>>, holes array<array<struct<x: double, y: double>>>"


def points(ring):
    return [{"x": float(x), "y": float(y)} for x, y in ring]


def plain(ring):
    return [(p["x"], p["y"]) for p in ring]


def frame(spark, rows):
    """Rows of ``slide, id, class, prob, ring, holes``, with bounds."""
    out = spark.createDataFrame([(s, i, c, p, points(r), [points(h) for h in hs]) for s, i, c, p, r, hs in rows], SCHEMA)
    return annotations.with_bounds(out).drop("is_area")


def square(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def star(rng, cx, cy, least=3, most=10):
    angles = sorted(rng.random() * 2 * math.pi for _ in range(rng.randrange(3, 11)))
    ring = [(cx + rng.uniform(least, most) * math.cos(a), cy + rng.uniform(least, most) * math.sin(a)) for a in angles]
    return [*ring, ring[0]]


def winding(x, y, ring):
    n = 0
    for (ax, ay), (bx, by) in zip(ring, ring[1:]):
        if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
            n += 1 if by > ay else -1
    return n


def within(x, y, parts):
    return sum(winding(x, y, plain(r)) % 2 for p in parts for r in [p["ring"], *p["holes"]]) % 2 == 1


def signed(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])) / 2


def distance(x, y, ring):
    best = math.inf
    for (ax, ay), (bx, by) in zip(ring, ring[1:]):
        dx, dy = bx - ax, by - ay
        t = max(0, min(1, ((x - ax) * dx + (y - ay) * dy) / ((dx * dx + dy * dy) or 1)))
        best = min(best, math.hypot(x - ax - t * dx, y - ay - t * dy))
    return best


def arrow(rings):
    return pa.array([points(r) for r in rings], planar.RING)


def touching(p, q, r, s):
    """Whether two segments touch, in exact numbers."""
    side = lambda a, b, c: (v := (Fraction(b[0]) - Fraction(a[0])) * (Fraction(c[1]) - Fraction(a[1])) - (Fraction(b[1]) - Fraction(a[1])) * (Fraction(c[0]) - Fraction(a[0]))) and (1 if v > 0 else -1)
    on = lambda a, b, c: side(a, b, c) == 0 and min(a[0], b[0]) <= c[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= c[1] <= max(a[1], b[1])
    return (side(p, q, r) != side(p, q, s) and side(r, s, p) != side(r, s, q)) or on(p, q, r) or on(p, q, s) or on(r, s, p) or on(r, s, q)


def test_meeting_equals_exact_brute_force():
    rng = random.Random(7)
    a = [[(round(x), round(y)) for x, y in star(rng, 0, 0)] for _ in range(150)]
    b = [[(round(x), round(y)) for x, y in star(rng, rng.uniform(-12, 12), rng.uniform(-12, 12), 1)] for _ in range(150)]
    got = planar.meets(planar.outlines(arrow(a)), planar.outlines(arrow(b)))
    for x, y, g in zip(a, b, got):
        expected = any(touching(p, q, r, s) for p, q in zip(x, x[1:]) for r, s in zip(y, y[1:])) or winding(*x[0], y) % 2 or winding(*y[0], x) % 2
        assert bool(expected) == bool(g)


def test_join_by_shapes(spark):
    """The triangle's box holds the small box, the triangle doesn't; what lies in a hole isn't met."""
    left = frame(spark, [(0, 1, "a", 0.5, [(0, 0), (100, 0), (0, 100), (0, 0)], []), (0, 2, "a", 0.5, square(200, 0, 300, 100), [square(220, 20, 280, 80)]), (1, 1, "a", 0.5, square(0, 0, 9, 9), [])])
    other = [
        (0, 10, square(90, 90, 99, 99)), (0, 11, square(10, 10, 20, 20)), (0, 12, square(40, 50, 50, 60)),
        (0, 20, square(230, 30, 240, 40)), (0, 21, square(225, 30, 240, 40)), (0, 22, square(215, 30, 240, 40)), (0, 23, square(100, -50, 400, 150)),
        (0, 30, [(230, 30)]), (0, 31, [(220, 50)]), (0, 32, [(230, 30), (270, 70)]), (0, 33, [(230, 30), (290, 30)]), (0, 34, [(50, 50)]), (0, 35, [(51, 50)]),
    ]
    right = frame(spark, [(s, i, "b", 0.5, r, []) for s, i, r in other])
    met = {(r.id, r.r_id) for r in spatial_join(left, right, 64, exact=True).collect()}
    assert met == {(1, 11), (1, 12), (1, 23), (2, 22), (2, 23), (2, 31), (2, 33), (1, 34)}
    rows = annotations.annotations_with_shapes(left, right).select("slide_id", "id", "r_id").collect()
    assert {(r.id, r.r_id) for r in rows if r.r_id is not None} == met and [(r.slide_id, r.id) for r in rows if r.r_id is None] == [(1, 1)]
    lists = {(r.slide_id, r.id): r.annotations for r in annotations.shapes_with_annotations(left, right.withColumnRenamed("id", "n"), "id", "n").collect()}
    assert lists == {(0, 1): [11, 12, 23, 34], (0, 2): [22, 23, 31, 33], (1, 1): []}
    first = cells.first_tissue(right.withColumnRenamed("id", "cell_id"), left.withColumnRenamed("id", "tissue_id")).collect()
    assert {(r.cell_id, r.tissue_id) for r in first} == {(11, 1), (12, 1), (22, 2), (23, 1), (31, 2), (33, 2), (34, 1)}


@pytest.mark.parametrize("how", ["intersection", "union", "difference", "symmetric_difference"])
def test_overlay_by_sampling(spark, how):
    rng = random.Random(how)
    rows = [(star(rng, 0, 0), star(rng, rng.uniform(-9, 9), rng.uniform(-9, 9))) for _ in range(60)]
    df = spark.createDataFrame([(points(a), [], points(b), []) for a, b in rows], "a array<struct<x: double, y: double>>, ah array<array<struct<x: double, y: double>>>, b array<struct<x: double, y: double>>, bh array<array<struct<x: double, y: double>>>")
    columns = [F.col(c) for c in ("a", "ah", "b", "bh")]
    out = df.select("a", "b", overlay(how, *columns).alias("parts"), overlap_areas(*columns).alias("s")).withColumn("area", parts_area(F.col("parts"))).collect()
    wants = {"intersection": lambda a, b: a and b, "union": lambda a, b: a or b, "difference": lambda a, b: a and not b, "symmetric_difference": lambda a, b: a != b}[how]
    area = {"intersection": lambda s: s.both, "union": lambda s: s.a + s.b - s.both, "difference": lambda s: s.a - s.both, "symmetric_difference": lambda s: s.a + s.b - 2 * s.both}[how]
    for r in out:
        a, b = plain(r.a), plain(r.b)
        assert r.area == pytest.approx(area(r.s), abs=1e-7)
        for p in r.parts:
            assert signed(plain(p["ring"])) > 0 and all(signed(plain(h)) < 0 for h in p["holes"])
        for _ in range(25):
            x, y = rng.uniform(-18, 18), rng.uniform(-18, 18)
            assert within(x, y, r.parts) == bool(wants(winding(x, y, a) != 0, winding(x, y, b) != 0))
    with pytest.raises(ValueError):
        overlay("other", *columns)


def test_holes_take_part_in_overlay(spark):
    ring = frame(spark, [(0, 1, "a", 0.5, square(0, 0, 10, 10), [square(2, 2, 8, 8)])])
    across = frame(spark, [(0, 2, "b", 0.5, square(-5, 4, 15, 6), [])])
    assert sorted((r.area, r.x0) for r in regions.overlaid(ring, across).collect()) == [(4.0, 0.0), (4.0, 8.0)]
    united = regions.overlaid(ring, across, "union").collect()
    assert len(united) == 1 and united[0].area == 100 - 36 + 20 + 12 and len(united[0].holes) == 2


def test_repair(spark):
    bow, spike = [(0, 0), (10, 10), (10, 0), (0, 10), (0, 0)], [(0, 0), (10, 0), (10, 10), (15, 10), (10, 10), (0, 10), (0, 0)]
    flat, twice = [(100, 100), (110, 100), (100, 100), (100, 100)], [*square(0, 0, 4, 4), *square(0, 0, 4, 4)]
    rows = [(0, i, "a", 0.5, r, []) for i, r in enumerate([bow, spike, flat, twice, square(0, 0, 2, 2)])]
    got = {}
    for r in regions.valid_polygons(frame(spark, rows)).collect():
        got.setdefault(r.id, []).append((r.area, plain(r.ring)))
    assert got[0] == [(25.0, [(0, 0), (5, 5), (0, 10), (0, 0)]), (25.0, [(5, 5), (10, 0), (10, 10), (5, 5)])]
    assert got[1] == [(100.0, square(0, 0, 10, 10))] and 2 not in got and got[3] == [(16.0, square(0, 0, 4, 4))] and got[4] == [(4.0, square(0, 0, 2, 2))]
    cut = regions.valid_polygons(frame(spark, [(0, 1, "a", 0.5, square(0, 0, 4, 4), [square(2, 2, 6, 6)])])).collect()
    assert [(r.area, len(r.holes)) for r in cut] == [(12.0, 0)]


@pytest.mark.parametrize("by", [2.0, -1.0, 0.0])
def test_buffers_by_sampling(spark, by):
    rng = random.Random(3)
    rings = [square(0, 0, 10, 10), [(0, 0), (20, 0), (20, 4), (4, 4), (4, 20), (0, 20), (0, 0)], *[star(rng, 0, 0, 5, 9) for _ in range(25)]]
    rings = [r for r in rings if abs(signed(r)) == pytest.approx(float(planar.ring_areas(planar.simple(planar.outlines(arrow([r])))).sum()))]
    df = spark.createDataFrame([(points(r), []) for r in rings], "ring array<struct<x: double, y: double>>, holes array<array<struct<x: double, y: double>>>")
    assert len(rings) > 10
    for r in df.select("ring", buffered(F.col("ring"), F.col("holes"), by).alias("parts")).collect():
        ring = plain(r.ring)
        for _ in range(60):
            x, y = rng.uniform(-14, 24), rng.uniform(-14, 24)
            far = distance(x, y, ring)
            if abs(far - abs(by)) > 0.02:  # arcs are cut by chords
                inside = winding(x, y, ring) != 0
                assert within(x, y, r.parts) == ((inside or far < by) if by >= 0 else (inside and far > -by))


def test_unions_of_many_by_neighbourhood(monkeypatch):
    """United a few at a time, and pieces of buffers too."""
    rng = random.Random(5)
    rings = [star(rng, rng.uniform(0, 120), rng.uniform(0, 120), 6, 15) for _ in range(90)]
    group = np.arange(90) % 3
    united = planar.united(planar.simple(planar.outlines(arrow(rings))), group, 3)
    parts = planar.parts_of(united, 3).to_pylist()
    monkeypatch.setattr(planar, "FEW_EDGES", 0)
    grown = planar.parts_of(planar.buffered(united, 2.0, 3), 3).to_pylist()
    monkeypatch.setattr(planar, "FEW_EDGES", 10**9)
    again = planar.parts_of(planar.buffered(united, 2.0, 3), 3).to_pylist()
    for _ in range(400):
        x, y = rng.uniform(-15, 135), rng.uniform(-15, 135)
        for g in range(3):
            assert within(x, y, parts[g]) == any(winding(x, y, rings[i]) != 0 for i in range(g, 90, 3))
            assert within(x, y, grown[g]) == within(x, y, again[g])


def test_merge_and_dissolve(spark):
    rows = [
        (0, 1, "a", 0.9, square(0, 0, 10, 10), []), (0, 2, "a", 0.3, square(10, 5, 30, 15), []), (0, 3, "a", 0.5, [(12, 12), (40, 40), (12, 40), (12, 12)], []),
        (0, 4, "a", 0.7, square(31, 0, 40, 10), []), (0, 5, "b", 0.2, square(0, 0, 10, 10), []), (1, 1, "a", 0.1, square(0, 0, 10, 10), []),
    ]
    df = frame(spark, rows)
    got = {(r.slide_id, r.component): r for r in regions.merge_connected(df, "id", "prob").collect()}
    assert {k: r.n for k, r in got.items()} == {(0, 1): 4, (0, 4): 1, (1, 1): 1}
    first = got[0, 1]
    assert first.area == pytest.approx(100 + 200 + 28 * 28 / 2 - 3 * 3 / 2)
    sizes = {1: 100, 2: 200, 3: 392, 5: 100}
    assert first.prob == pytest.approx(sum(sizes[i] * p for _, i, _, p, *_ in rows[:3] + rows[4:5]) / sum(sizes.values()))
    near = {(r.slide_id, r["class"], round(r.x0, 9) + 0.0): r for r in regions.dissolve_polygons(df, ("slide_id", "class"), 1.0, "prob").collect()}
    assert set(near) == {(0, "a", 0.0), (0, "b", 0.0), (1, "a", 0.0)}
    # The gap of 1 x 5 pixels between the second and the fourth is closed, and corners that point inwards are rounded.
    seam = near[0, "a", 0.0].area - (first.area + 90)
    assert 5 < seam < 9 and near[0, "a", 0.0].prob == 0.9 and near[1, "a", 0.0].prob == 0.1
    assert near[0, "b", 0.0].area == pytest.approx(100, abs=0.01)
    wide = {(r.slide_id, r.component): r.n for r in regions.merge_connected(df, "id", buffer_px=0.6).collect()}
    assert wide == {(0, 1): 5, (1, 1): 1}
    assert regions.merge_connected(df.where("id < 0"), "id").count() == 0 and regions.dissolve_polygons(df.where("id < 0"), ("slide_id", "class")).count() == 0


def test_suppression_of_polygons(spark):
    """Of coincident ones the likelier stays, degenerate ones go, and boxes that overlap by their corners alone don't count."""
    dart = [(0, 0), (10, 0), (0, 10), (0, 0)]
    other = [(10, 10), (10, 1), (1, 10), (10, 10)]
    rows = [(0, 1, "a", 0.2, dart, []), (0, 2, "a", 0.9, dart, []), (0, 3, "a", 0.5, other, []), (0, 4, "a", 0.5, [(100, 100), (110, 100), (100, 100)], []), (1, 2, "a", 0.1, dart, [])]
    df = frame(spark, rows)
    assert sorted((r.slide_id, r.id) for r in cells.nms_polygons(df, 0.2, id_col="id").collect()) == [(0, 2), (0, 3), (1, 2)]
    kept = {r.id: plain(r.ring) for r in cells.nms_polygons(df.where("slide_id = 0"), 0.2, id_col="id").collect()}
    assert kept == {2: dart, 3: other}
    assert {(r.a, r.b): round(r.iou, 6) for r in cells.iou_pairs(df, id_col="id").where("slide_id = 0").collect()}[1, 2] == 1.0
    matched = cells.match_instances(df.where("id in (1, 3)"), df.where("id = 2")).collect()
    assert [(r.slide_id, r.gt_id, r.pred_id, r.iou) for r in matched] == [(0, 1, 2, 1.0)]


def test_areas_by_squares(spark):
    gt = frame(spark, [(0, 1, "a", 0.5, [(0, 0), (40, 0), (0, 40), (0, 0)], []), (0, 2, "a", 0.5, square(0, 0, 10, 10), []), (1, 1, "a", 0.5, square(0, 0, 4, 4), [square(1, 1, 3, 3)])])
    pred = frame(spark, [(0, 1, "a", 0.5, square(5, 5, 60, 60), []), (0, 2, "a", 0.5, square(50, 50, 70, 70), [])])
    got = {r.slide_id: tuple(round(v, 6) for v in (r.tp, r.fp, r.fn)) for r in regions.polygon_stats(gt, pred, 16).collect()}
    assert got == {0: (450.0, 55 * 55 + 400 - 100 - 450, 350.0), 1: (0.0, 0.0, 12.0)}


def test_areas_of_many_squares_share_calls(spark):
    """Squares of slides, with a polygon's border alone in some, and a slide without an area; no call for each square."""
    rng = random.Random(4)
    rows = [(s, i, "a", 0.5, square(x, y, x + 16 * rng.randrange(1, 3), y + rng.randrange(5, 30)), []) for s in range(3) for i in range(8) for x, y in [(16 * rng.randrange(4), rng.randrange(64))]]
    gt, pred = frame(spark, [*rows, (9, 0, "a", 0.5, [(3, 3), (5, 5), (3, 3)], [])]), frame(spark, rows[::2])
    stats = regions.polygon_stats(gt, pred, 16)
    assert "FlatMapGroups" not in stats._jdf.queryExecution().toString()
    whole = lambda of, s: {(x, y) for r in of if r[0] == s for x in range(r[4][0][0], r[4][2][0]) for y in range(r[4][0][1], r[4][2][1])}
    expected = {}
    for s in range(3):
        a, b = whole(rows, s), whole(rows[::2], s)
        expected[s] = (len(a & b), len(b - a), len(a - b))
    assert {r.slide_id: tuple(round(v, 6) for v in (r.tp, r.fp, r.fn)) for r in stats.collect()} == expected


def test_drawing_equals_points_in_rings(spark):
    rng = random.Random(2)

    def around(cx, cy, least, most):
        ring = [(cx + (r := rng.uniform(least, most)) * math.cos(math.pi / 4 * k), cy + r * math.sin(math.pi / 4 * k)) for k in range(8)]
        return [*ring, ring[0]]

    rows = [(s, i, "a", 0.5, around(20 + 7 * i, 30, 8, 20), [around(20 + 7 * i, 30, 1, 4)]) for s in range(2) for i in range(4)]
    df = frame(spark, rows).withColumnRenamed("slide_id", "image_id")
    got = {(r.image_id, r.id, r.y, r.x) for r in regions.drawn(df, "id", chunk=16).collect()}
    expected = {(s, i, y, x) for s, i, _, _, r, h in rows for y in range(80) for x in range(-10, 80) if (winding(x + 0.5, y + 0.5, r) + winding(x + 0.5, y + 0.5, h[0])) % 2}
    assert got == expected


KINDS = {
    "Point": [5.0, 6.0],
    "MultiPoint": [[1.0, 2.0], [3.0, 4.0]],
    "LineString": [[0.0, 0.0], [5.0, 5.0], [6.0, 1.0]],
    "MultiLineString": [[[0.0, 0.0], [5.0, 5.0]], [[7.0, 7.0], [8.0, 9.0]]],
    "Polygon": [[[0.0, 0.0], [50.0, 0.0], [0.0, 50.0], [0.0, 0.0]], [[5.0, 5.0], [9.0, 5.0], [5.0, 9.0], [5.0, 5.0]]],
    "MultiPolygon": [[[[0.0, 0.0], [50.0, 0.0], [0.0, 50.0], [0.0, 0.0]]], [[[60.0, 60.0], [90.0, 60.0], [60.0, 90.0], [60.0, 60.0]], [[62.0, 62.0], [66.0, 62.0], [62.0, 66.0], [62.0, 62.0]]]],
}


def test_export_of_every_kind_comes_back(spark, tmp_path):
    features = [{"type": "Feature", "geometry": {"type": k, "coordinates": c}, "properties": {"name": k, "n": i, "none": None}} for i, (k, c) in enumerate(KINDS.items())]
    (tmp_path / "in.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    rows = annotations.flatten_json(annotations.read_geojson(spark, str(tmp_path / "in.geojson")), "properties", {"name": "string", "n": "bigint", "none": "string"})
    rows = rows.withColumnsRenamed({"properties_name": "name", "properties_n": "n", "properties_none": "none"})
    annotations.export_annotations(rows, str(tmp_path / "out"))
    back = sorted((json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()), key=lambda f: f["properties"]["n"])
    assert back == features
    moved = annotations.export_annotations(rows.where("kind = 'Point'"), in_bounds=(5, 6)).first().value
    assert json.loads(moved)["geometry"] == {"type": "Point", "coordinates": [0.0, 0.0]}


def test_export_tells_kinds_by_points(spark):
    rows = frame(spark, [(0, 1, "a", 0.5, [(1, 2)], []), (0, 2, "a", 0.5, [(1, 2), (3, 4)], []), (0, 3, "b", 0.5, square(0, 0, 4, 4), [])])
    got = [json.loads(r.value) for r in annotations.export_annotations(rows, classes="class", order="id").collect()]
    assert {f["properties"]["id"]: f["geometry"]["type"] for f in got} == {1: "Point", 2: "LineString", 3: "Polygon"}
    assert {f["properties"]["id"]: f["properties"]["classification"]["name"] for f in got} == {1: "a", 2: "a", 3: "b"}
    assert all(set(f["properties"]) == {"slide_id", "id", "class", "prob", "classification"} for f in got)
    with pytest.raises(NotADirectoryError):
        annotations.export_annotations(rows, "/nowhere/at/all/out")


def test_corners_are_the_nearest_half_pixels(spark):
    """Crossings are right up to double precision, so a coordinate may lie just below its place."""
    row = spark.createDataFrame([([(7.499999999999999, 3.0), (1024.0000000000001, -2.5000000000000004), (1.0, -7.999999999999999)],)], "ring array<struct<x: double, y: double>>")
    assert row.select(queries_shapes._corners(F.col("ring")).alias("t")).first().t == "15,6 2048,-5 2,-16"


def test_convex_rings_need_no_slabs(monkeypatch):
    """Convex polygons are their own borders, and widened corner by corner, as pieces united would be."""
    import pyarrow as pa

    from tessella.functions import planar as P

    square, diamond = [(0, 0), (40, 0), (40, 40), (0, 40)], [(20, 0), (0, 20), (20, 40), (40, 20)]
    rings = [[{"x": float(x), "y": float(y)} for x, y in [*r, r[0]]] for r in (square, diamond, [(0, 0), (30, 0), (0, 30)])]
    o = P.outlines(pa.array(rings, P.RING))
    pieces = P.parts_of(P.buffered_any(P.simple(o), 7.0, 3), 3).to_pylist()
    monkeypatch.setattr(P, "slabs", None)
    wide = P.parts_of(P.buffered(P.simple(o), 7.0, 3), 3).to_pylist()
    assert [[len(p["ring"]) for p in row] for row in wide] == [[len(p["ring"]) for p in row] for row in pieces] == [[69], [69], [68]]
    for a, b in zip(wide, pieces):
        for p, q in zip(a[0]["ring"], b[0]["ring"]):
            assert abs(p["x"] - q["x"]) < 1e-9 and abs(p["y"] - q["y"]) < 1e-9


def test_rings_that_turn_twice_or_have_a_dent_go_the_long_way():
    import pyarrow as pa

    from tessella.functions import planar as P

    twice = [(0, 0), (9, 0), (9, 9), (0, 9), (-1, -1), (10, -1), (10, 10), (-1, 10)]
    dent = [(0, 0), (8, 0), (4, 3), (8, 8), (0, 8)]
    rings = [[{"x": float(x), "y": float(y)} for x, y in [*r, r[0]]] for r in (twice, dent)]
    plain, rest = P._convex(P.outlines(pa.array(rings, P.RING)))
    assert not len(plain.row) and rest.rows == 2 and list(rest.owner) == [0, 1]
