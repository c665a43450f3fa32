"""Registered queries on slanted polygons: joins, overlay, repair, buffers, unions and drawing,
each beside the SQL that DuckDB answers alike. Doubles are rounded to six decimals on both sides.

Cells become diamonds, triangles and darts, tissues cut-off boxes with a hole in their middle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.overlay import buffered, parts_area
from tessella.operators import annotations, cells, regions
from tessella.queries import Query
from tessella.sources import adapters
from tessella.sources.adapters import with_relations

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in columns})


def _ring(*corners: tuple[Column, Column]) -> Column:
    """A closed ring."""
    point = lambda c: F.struct(c[0].cast("double").alias("x"), c[1].cast("double").alias("y"))
    return F.array(*[point(c) for c in (*corners, corners[0])])


def cell_rings(spark: SparkSession, sf: str) -> DataFrame:
    """Cells with a ``ring``: by id a diamond, a triangle or a dart with a corner pressed in."""
    x0, y0, x1, y1 = (F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1"))
    mx, my, s = (x0 + x1) / 2, (y0 + y1) / 2, (x1 - x0) / 4
    kind = F.col("cell_id") % 3
    ring = F.when(kind == 0, _ring((mx, y0), (x1, my), (mx, y1), (x0, my))).when(kind == 1, _ring((x0, y0), (x1, y0), (x0, y1))).otherwise(_ring((x0, y0), (x1, y0), (x0 + s, y0 + s), (x0, y1)))
    return adapters.cells(spark, sf).withColumn("ring", ring)


def tissue_rings(spark: SparkSession, sf: str, dx: int = 0, dy: int = 0, per: float = 1) -> DataFrame:
    """Tissues with a ``ring`` of six corners and a diamond for a hole, moved and scaled down."""
    x0, y0, x1, y1 = (F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1"))
    mx, my = (x0 + x1) / 2, (y0 + y1) / 2
    at = lambda x, y: ((x + dx) / per, (y + dy) / per)
    ring = _ring(at(x0 + 100, y0), at(x1, y0), at(x1, y1 - 120), at(x1 - 150, y1), at(x0, y1), at(x0, y0 + 80))
    hole = _ring(at(mx, my - 70), at(mx + 70, my), at(mx, my + 70), at(mx - 70, my))
    rows = adapters.tissues(spark, sf).withColumns({"ring": ring, "holes": F.array(hole)})
    return rows.withColumns({c: (F.col(c) + d) / per for c, d in (("x0", dx), ("y0", dy), ("x1", dx), ("y1", dy))})


_RINGS = """, shapes AS (
  SELECT *, CASE cell_id % 3
    WHEN 0 THEN [{'x': (x0 + x1) / 2.0, 'y': y0 / 1.0}, {'x': x1 / 1.0, 'y': (y0 + y1) / 2.0}, {'x': (x0 + x1) / 2.0, 'y': y1 / 1.0}, {'x': x0 / 1.0, 'y': (y0 + y1) / 2.0}, {'x': (x0 + x1) / 2.0, 'y': y0 / 1.0}]
    WHEN 1 THEN [{'x': x0 / 1.0, 'y': y0 / 1.0}, {'x': x1 / 1.0, 'y': y0 / 1.0}, {'x': x0 / 1.0, 'y': y1 / 1.0}, {'x': x0 / 1.0, 'y': y0 / 1.0}]
    ELSE [{'x': x0 / 1.0, 'y': y0 / 1.0}, {'x': x1 / 1.0, 'y': y0 / 1.0}, {'x': x0 + (x1 - x0) / 4.0, 'y': y0 + (x1 - x0) / 4.0}, {'x': x0 / 1.0, 'y': y1 / 1.0}, {'x': x0 / 1.0, 'y': y0 / 1.0}] END AS ring
  FROM cells
), shape_edges AS (
  SELECT slide_id, cell_id, ring[i].x AS ax, ring[i].y AS ay, ring[i + 1].x AS bx, ring[i + 1].y AS by_
  FROM (SELECT *, unnest(range(1, len(ring))) AS i FROM shapes) t
)"""

_REGIONS = """, regions AS (
  SELECT slide_id, tissue_id, x0, y0, x1, y1,
    [{'x': x0 + 100.0, 'y': y0 / 1.0}, {'x': x1 / 1.0, 'y': y0 / 1.0}, {'x': x1 / 1.0, 'y': y1 - 120.0}, {'x': x1 - 150.0, 'y': y1 / 1.0}, {'x': x0 / 1.0, 'y': y1 / 1.0}, {'x': x0 / 1.0, 'y': y0 + 80.0}, {'x': x0 + 100.0, 'y': y0 / 1.0}] AS ring,
    [{'x': (x0 + x1) / 2.0, 'y': (y0 + y1) / 2.0 - 70}, {'x': (x0 + x1) / 2.0 + 70, 'y': (y0 + y1) / 2.0}, {'x': (x0 + x1) / 2.0, 'y': (y0 + y1) / 2.0 + 70}, {'x': (x0 + x1) / 2.0 - 70, 'y': (y0 + y1) / 2.0}, {'x': (x0 + x1) / 2.0, 'y': (y0 + y1) / 2.0 - 70}] AS hole
  FROM tissues
), region_edges AS (
  SELECT slide_id, tissue_id, 1 AS turn, ring[i].x AS ax, ring[i].y AS ay, ring[i + 1].x AS bx, ring[i + 1].y AS by_ FROM (SELECT *, unnest(range(1, len(ring))) AS i FROM regions) t
  UNION ALL
  SELECT slide_id, tissue_id, -1, hole[i].x, hole[i].y, hole[i + 1].x, hole[i + 1].y FROM (SELECT *, unnest(range(1, len(hole))) AS i FROM regions) t
)"""

#: Pairs of a shape and a region that have a point in common: edges that touch, or a first corner
#: that is inside of the other.
_MET = """, near AS (
  SELECT c.slide_id, c.cell_id, t.tissue_id FROM cells c JOIN tissues t ON c.slide_id = t.slide_id AND c.x0 <= t.x1 AND t.x0 <= c.x1 AND c.y0 <= t.y1 AND t.y0 <= c.y1
), crossing AS (
  SELECT DISTINCT n.slide_id, n.cell_id, n.tissue_id
  FROM near n JOIN shape_edges p ON p.slide_id = n.slide_id AND p.cell_id = n.cell_id JOIN region_edges q ON q.slide_id = n.slide_id AND q.tissue_id = n.tissue_id
  WHERE least(p.ax, p.bx) <= greatest(q.ax, q.bx) AND least(q.ax, q.bx) <= greatest(p.ax, p.bx) AND least(p.ay, p.by_) <= greatest(q.ay, q.by_) AND least(q.ay, q.by_) <= greatest(p.ay, p.by_)
    AND sign((p.bx - p.ax) * (q.ay - p.ay) - (p.by_ - p.ay) * (q.ax - p.ax)) * sign((p.bx - p.ax) * (q.by_ - p.ay) - (p.by_ - p.ay) * (q.bx - p.ax)) <= 0
    AND sign((q.bx - q.ax) * (p.ay - q.ay) - (q.by_ - q.ay) * (p.ax - q.ax)) * sign((q.bx - q.ax) * (p.by_ - q.ay) - (q.by_ - q.ay) * (p.bx - q.ax)) <= 0
), inner_shapes AS (
  SELECT n.slide_id, n.cell_id, n.tissue_id FROM near n JOIN shapes s USING (slide_id, cell_id) JOIN region_edges q ON q.slide_id = n.slide_id AND q.tissue_id = n.tissue_id
  GROUP BY ALL HAVING count(*) FILTER (WHERE (q.ay > s.ring[1].y) <> (q.by_ > s.ring[1].y) AND s.ring[1].x < q.ax + (s.ring[1].y - q.ay) * (q.bx - q.ax) / (q.by_ - q.ay)) % 2 = 1
), inner_regions AS (
  SELECT n.slide_id, n.cell_id, n.tissue_id FROM near n JOIN regions s USING (slide_id, tissue_id) JOIN shape_edges q ON q.slide_id = n.slide_id AND q.cell_id = n.cell_id
  GROUP BY ALL HAVING count(*) FILTER (WHERE (q.ay > s.ring[1].y) <> (q.by_ > s.ring[1].y) AND s.ring[1].x < q.ax + (s.ring[1].y - q.ay) * (q.bx - q.ax) / (q.by_ - q.ay)) % 2 = 1
), met AS (SELECT * FROM crossing UNION SELECT * FROM inner_shapes UNION SELECT * FROM inner_regions)"""


@query("ring_join", with_relations("cells tissues", _RINGS + _REGIONS + _MET + " SELECT slide_id, cell_id, tissue_id FROM cells LEFT JOIN met USING (slide_id, cell_id)"))
def ring_join(spark: SparkSession, sf: str) -> DataFrame:
    """Every slanted cell once for each tissue with a hole that it meets, or once with a null."""
    rows = annotations.annotations_with_shapes(cell_rings(spark, sf), tissue_rings(spark, sf))
    return rows.select("slide_id", "cell_id", F.col("r_tissue_id").alias("tissue_id"))


@query("ring_lists", with_relations("cells tissues", _RINGS + _REGIONS + _MET + " SELECT slide_id, tissue_id, count(met.cell_id) AS n, coalesce(string_agg(met.cell_id, ',' ORDER BY met.cell_id), '') AS met FROM tissues LEFT JOIN met USING (slide_id, tissue_id) GROUP BY slide_id, tissue_id"))
def ring_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Every tissue once with the cells that it meets."""
    rows = annotations.shapes_with_annotations(tissue_rings(spark, sf), cell_rings(spark, sf), "tissue_id", "cell_id")
    return rows.select("slide_id", "tissue_id", F.size("annotations").cast("long").alias("n"), F.array_join(F.transform("annotations", lambda a: a.cast("string")), ",").alias("met"))


@query("ring_first_tissue", with_relations("cells tissues", _RINGS + _REGIONS + _MET + " SELECT slide_id, cell_id, min(tissue_id) AS tissue_id FROM met GROUP BY ALL"))
def ring_first_tissue(spark: SparkSession, sf: str) -> DataFrame:
    return cells.first_tissue(cell_rings(spark, sf), tissue_rings(spark, sf))


def _slab_sql(edges: str, keys: str) -> str:
    """Trapezoids between neighbouring edges of every slab of a group, with how often the sides
    ``g`` 0 and 1 wind around them. ``edges`` has ``keys, g, turn, ax, ay, bx, by_``."""
    on = " AND ".join(f"p.{k} = q.{k}" for k in keys.split(", "))
    own = ", ".join(f"p.{k}" for k in keys.split(", "))
    return f""", sides AS (
  SELECT {keys}, g, CASE WHEN ay < by_ THEN turn ELSE -turn END AS w, CASE WHEN ay < by_ THEN ax ELSE bx END AS ax, least(ay, by_) AS ay, CASE WHEN ay < by_ THEN bx ELSE ax END AS bx, greatest(ay, by_) AS by_,
         row_number() OVER () AS e FROM {edges} WHERE ay <> by_
), heights AS (
  SELECT {keys}, ay AS y FROM sides UNION SELECT {keys}, by_ FROM sides
  UNION SELECT {own}, p.ay + ((q.ax - p.ax) * (q.by_ - q.ay) - (q.ay - p.ay) * (q.bx - q.ax)) / ((p.bx - p.ax) * (q.by_ - q.ay) - (p.by_ - p.ay) * (q.bx - q.ax)) * (p.by_ - p.ay)
  FROM sides p JOIN sides q ON {on} AND p.e < q.e AND p.ay < q.by_ AND q.ay < p.by_
  WHERE (p.bx - p.ax) * (q.by_ - q.ay) - (p.by_ - p.ay) * (q.bx - q.ax) <> 0
    AND ((q.ax - p.ax) * (q.by_ - q.ay) - (q.ay - p.ay) * (q.bx - q.ax)) / ((p.bx - p.ax) * (q.by_ - q.ay) - (p.by_ - p.ay) * (q.bx - q.ax)) BETWEEN 0 AND 1
    AND ((q.ax - p.ax) * (p.by_ - p.ay) - (q.ay - p.ay) * (p.bx - p.ax)) / ((p.bx - p.ax) * (q.by_ - q.ay) - (p.by_ - p.ay) * (q.bx - q.ax)) BETWEEN 0 AND 1
), slabs AS (
  SELECT {keys}, y AS lo, lead(y) OVER (PARTITION BY {keys} ORDER BY y) AS hi FROM heights
), placed AS (
  SELECT {own}, lo, hi, g, w, p.ax + (lo - p.ay) * (p.bx - p.ax) / (p.by_ - p.ay) AS xa, p.ax + (hi - p.ay) * (p.bx - p.ax) / (p.by_ - p.ay) AS xb
  FROM slabs q JOIN sides p ON {on} AND p.ay <= lo AND hi <= p.by_ WHERE hi - lo > 1e-9
), traps AS (
  SELECT {keys}, sum(CASE WHEN g = 0 THEN w ELSE 0 END) OVER s AS w0, sum(CASE WHEN g = 1 THEN w ELSE 0 END) OVER s AS w1,
         ((lead(xa) OVER n - xa) + (lead(xb) OVER n - xb)) / 2 * (hi - lo) AS area
  FROM placed WINDOW s AS (PARTITION BY {keys}, lo ORDER BY xa + xb ROWS UNBOUNDED PRECEDING), n AS (PARTITION BY {keys}, lo ORDER BY xa + xb)
)"""


_PAIR_EDGES = """, pairs AS (
  SELECT a.slide_id, a.cell_id AS a, b.cell_id AS b FROM cells a JOIN cells b ON a.slide_id = b.slide_id AND a.cell_id < b.cell_id AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1
), pair_edges AS (
  SELECT p.slide_id, a, b, 0 AS g, 1 AS turn, ax, ay, bx, by_ FROM pairs p JOIN shape_edges e ON e.slide_id = p.slide_id AND e.cell_id = p.a
  UNION ALL SELECT p.slide_id, a, b, 1, 1, ax, ay, bx, by_ FROM pairs p JOIN shape_edges e ON e.slide_id = p.slide_id AND e.cell_id = p.b
)"""


@query("ring_iou", with_relations("cells", _RINGS + _PAIR_EDGES + _slab_sql("pair_edges", "slide_id, a, b") + """, areas AS (
  SELECT slide_id, a, b, sum(area) FILTER (WHERE w0 <> 0 AND w1 <> 0) AS shared, sum(area) FILTER (WHERE w0 <> 0 OR w1 <> 0) AS one FROM traps GROUP BY ALL
) SELECT slide_id, a, b, round(shared / one, 6) AS iou FROM areas WHERE shared / one > 0.1"""))  # fmt: skip
def ring_iou(spark: SparkSession, sf: str) -> DataFrame:
    """IoU of slanted cells that overlap."""
    return rounded(cells.iou_pairs(cell_rings(spark, sf), threshold=0.1), "iou")


@query("polygon_stats", with_relations("tissues", _REGIONS + """, both_edges AS (
  SELECT slide_id, 0 AS g, turn, ax, ay, bx, by_ FROM region_edges UNION ALL SELECT slide_id, 1, turn, ax + 137, ay + 93, bx + 137, by_ + 93 FROM region_edges
)""" + _slab_sql("both_edges", "slide_id") + """ SELECT slide_id, round(sum(area) FILTER (WHERE w0 <> 0 AND w1 <> 0), 6) AS tp, round(sum(area) FILTER (WHERE w0 = 0 AND w1 <> 0), 6) AS fp,
  round(sum(area) FILTER (WHERE w0 <> 0 AND w1 = 0), 6) AS fn, 0.0 AS tn FROM traps GROUP BY slide_id"""))  # fmt: skip
def polygon_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Areas that tissues and the same tissues moved share, and don't."""
    return rounded(regions.polygon_stats(tissue_rings(spark, sf), tissue_rings(spark, sf, 137, 93)), "tp", "fp", "fn")


def _corners(ring: Column) -> Column:
    """A ring's points in half pixels, as text, in order."""
    return _text(_halves(ring))


def _text(points: Column) -> Column:
    return F.array_join(F.transform(points, lambda p: F.concat(p["x"].cast("string"), F.lit(","), p["y"].cast("string"))), " ")


def _halves(ring: Column) -> Column:
    """A ring's points as whole numbers of half pixels: the nearest, as crossings of edges are
    right up to double precision alone."""
    near = lambda c: F.round(c.cast("double") * 2).cast("long")
    return F.transform(ring, lambda p: F.struct(near(p["x"]).alias("x"), near(p["y"]).alias("y")))


@query("repaired_polygons", with_relations("cells", """
  SELECT slide_id, cell_id, 0::INTEGER AS part, (x1 - x0) * (y1 - y0) / 4.0 AS area, concat_ws(' ', 2 * x0 || ',' || 2 * y0, x0 + x1 || ',' || y0 + y1, 2 * x0 || ',' || 2 * y1, 2 * x0 || ',' || 2 * y0) AS corners FROM cells
  UNION ALL SELECT slide_id, cell_id, 1, (x1 - x0) * (y1 - y0) / 4.0, concat_ws(' ', x0 + x1 || ',' || y0 + y1, 2 * x1 || ',' || 2 * y0, 2 * x1 || ',' || 2 * y1, x0 + x1 || ',' || y0 + y1) FROM cells"""))  # fmt: skip
def repaired_polygons(spark: SparkSession, sf: str) -> DataFrame:
    """Cells drawn as a bow-tie with a spike fall into two triangles."""
    x0, y0, x1, y1 = (F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1"))
    bow = _ring((x0, y0), (x1, y1), (x1, y0), (x0, y1), (x0, y1 + 9), (x0, y1))
    done = regions.valid_polygons(adapters.cells(spark, sf).select("slide_id", "cell_id", "x0", "y0", "x1", "y1", bow.alias("ring")))
    return done.select("slide_id", "cell_id", "part", "area", _corners(F.col("ring")).alias("corners"))


@query("overlaid_rings", with_relations("cells tiles", """, d AS (
  SELECT slide_id, cell_id, (x0 + x1) / 2.0 AS mx, (y0 + y1) / 2.0 AS my, (x1 - x0) / 2.0 AS r, x0, y0, x1, y1 FROM cells
), pairs AS (
  SELECT d.slide_id, cell_id, tile_id, mx, my, r, t.x0 AS tx0, t.y0 AS ty0, t.x1 AS tx1, t.y1 AS ty1
  FROM d JOIN tiles t ON d.slide_id = t.slide_id AND d.x0 <= t.x1 AND t.x0 <= d.x1 AND d.y0 <= t.y1 AND t.y0 <= d.y1
), candidates AS (
  SELECT slide_id, cell_id, tile_id, mx, my, r, tx0, ty0, tx1, ty1, unnest([
    {'x': mx, 'y': my - r}, {'x': mx + r, 'y': my}, {'x': mx, 'y': my + r}, {'x': mx - r, 'y': my},
    {'x': tx0, 'y': ty0}, {'x': tx1, 'y': ty0}, {'x': tx1, 'y': ty1}, {'x': tx0, 'y': ty1},
    {'x': tx0, 'y': my - (r - abs(tx0 - mx))}, {'x': tx0, 'y': my + (r - abs(tx0 - mx))}, {'x': tx1, 'y': my - (r - abs(tx1 - mx))}, {'x': tx1, 'y': my + (r - abs(tx1 - mx))},
    {'x': mx - (r - abs(ty0 - my)), 'y': ty0}, {'x': mx + (r - abs(ty0 - my)), 'y': ty0}, {'x': mx - (r - abs(ty1 - my)), 'y': ty1}, {'x': mx + (r - abs(ty1 - my)), 'y': ty1}]) AS p FROM pairs
), corners AS (
  SELECT DISTINCT slide_id, cell_id, tile_id, p.x AS x, p.y AS y FROM candidates
  WHERE p.x BETWEEN tx0 AND tx1 AND p.y BETWEEN ty0 AND ty1 AND abs(p.x - mx) + abs(p.y - my) <= r
), middled AS (
  SELECT *, avg(x) OVER w AS cx, avg(y) OVER w AS cy, count(*) OVER w AS n FROM corners WINDOW w AS (PARTITION BY slide_id, cell_id, tile_id)
), turned AS (
  SELECT *, row_number() OVER w AS k, coalesce(lead(x) OVER w, first(x) OVER w) AS nx, coalesce(lead(y) OVER w, first(y) OVER w) AS ny
  FROM middled WHERE n >= 3 WINDOW w AS (PARTITION BY slide_id, cell_id, tile_id ORDER BY atan2(y - cy, x - cx))
) SELECT slide_id, cell_id, tile_id, sum((x - cx) * (ny - cy) - (nx - cx) * (y - cy)) / 2 AS area, string_agg(CAST(2 * x AS BIGINT) || ',' || CAST(2 * y AS BIGINT), ' ' ORDER BY x, y) AS corners
FROM turned GROUP BY slide_id, cell_id, tile_id HAVING area > 1e-9"""))  # fmt: skip
def overlaid_rings(spark: SparkSession, sf: str) -> DataFrame:
    """Diamonds cut by the tiles that they reach: areas, and corners by place."""
    x0, y0, x1, y1 = (F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1"))
    mx, my = (x0 + x1) / 2, (y0 + y1) / 2
    diamonds = adapters.cells(spark, sf).select("slide_id", "cell_id", "x0", "y0", "x1", "y1", _ring((mx, y0), (x1, my), (mx, y1), (x0, my)).alias("ring"))
    cut = regions.overlaid(diamonds, adapters.tiles(spark, sf).select("slide_id", "tile_id", "x0", "y0", "x1", "y1"))
    once = F.array_sort(_halves(F.slice("ring", 2, F.size("ring") - 1)))
    return cut.select("slide_id", "cell_id", F.col("r_tile_id").alias("tile_id"), "area", _text(once).alias("corners"))


@query("buffered_polygons", with_relations("cells", """
  SELECT slide_id, cell_id, round(CASE cell_id % 3 WHEN 0 THEN (x1 - x0) ** 2 / 2.0 + 7 * (x1 - x0) * 2 * sqrt(2) WHEN 1 THEN (x1 - x0) ** 2 / 2.0 + 7 * (x1 - x0) * (2 + sqrt(2)) ELSE (x1 - x0) ** 2 + 28 * (x1 - x0) END
    + 64 * 24.5 * sin(pi() / 32), 4) AS area FROM cells"""))  # fmt: skip
def buffered_polygons(spark: SparkSession, sf: str) -> DataFrame:
    """Convex cells (diamonds, triangles, boxes) widened by 7: area, sides and arcs add up."""
    rows = regions.with_outline(cell_rings(spark, sf).withColumn("ring", F.when(F.col("cell_id") % 3 < 2, F.col("ring")).otherwise(_ring(*[(F.col(a), F.col(b)) for a, b in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))]))))
    return rows.select("slide_id", "cell_id", F.round(parts_area(buffered("ring", "holes", 7)), 4).alias("area"))


@query("drawn_polygons", with_relations("tissues", _REGIONS + """, small AS (
  SELECT slide_id, tissue_id, ax / 20 AS ax, ay / 20 AS ay, bx / 20 AS bx, by_ / 20 AS by_ FROM region_edges
), area AS (
  SELECT slide_id, tissue_id, x, unnest(range(CAST(floor(y0 / 20) AS BIGINT), CAST(ceil(y1 / 20) AS BIGINT))) AS y
  FROM (SELECT *, unnest(range(CAST(floor(x0 / 20) AS BIGINT), CAST(ceil(x1 / 20) AS BIGINT))) AS x FROM tissues) t
) SELECT a.slide_id AS image_id, a.y, a.x, a.tissue_id AS v FROM area a JOIN small e USING (slide_id, tissue_id)
GROUP BY ALL HAVING count(*) FILTER (WHERE (e.ay > a.y + 0.5) <> (e.by_ > a.y + 0.5) AND a.x + 0.5 < e.ax + (a.y + 0.5 - e.ay) * (e.bx - e.ax) / (e.by_ - e.ay)) % 2 = 1"""))  # fmt: skip
def drawn_polygons(spark: SparkSession, sf: str) -> DataFrame:
    """Tissues at a twentieth of their size as pixels, in chunks of 16."""
    return regions.drawn(tissue_rings(spark, sf, per=20).withColumnsRenamed({"slide_id": "image_id", "tissue_id": "v"}), chunk=16)


@query("merged_polygons")
def merged_polygons(spark: SparkSession, sf: str) -> DataFrame:
    """Slanted cells that meet as one, with their mean probability by area."""
    done = regions.merge_connected(cell_rings(spark, sf), prob_col="prob")
    return rounded(done.select("slide_id", "component", "n", "part", "prob", "area", F.size("holes").alias("holes")), "prob", "area")


@query("dissolved_polygons")
def dissolved_polygons(spark: SparkSession, sf: str) -> DataFrame:
    """Tissues within 120 pixels of one another as one."""
    rows = tissue_rings(spark, sf).withColumns({"kind": F.col("tissue_id") % 2, "prob": (F.col("tissue_id") % 10) / 10})
    done = regions.dissolve_polygons(rows, ("slide_id", "kind"), 60.0, "prob", cell=512)
    return rounded(done.select("slide_id", "kind", "part", "prob", "area", "x0", "y0", "x1", "y1"), "prob", "area", "x0", "y0", "x1", "y1")
