"""Queries over polygons with holes, crossing borders and coverages with gaps, made from the positions of customers and suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo as G
from ..operators import overlay as O
from ..operators import spatial as S
from ..operators import thinning as T
from .coverages import _SQUARES, squares
from .flows import _grid_boxes, _supplier_boxes
from .tables import SQL_LAT, SQL_LON, boxes, customers, table


def _holed(df: DataFrame, id: str, hole: tuple[float, float, float, float]) -> DataFrame:
    """Boxes as shapes with one hole, given relative to the south-west corner."""
    w, s = F.col("west"), F.col("south")
    inner = G.box_ring(w + hole[0], s + hole[1], w + hole[2], s + hole[3])
    return df.select(id, F.array(G.box_ring(w, s, F.col("east"), F.col("north")), inner).alias("rings"))


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _holed(_grid_boxes(spark, sf_dir), "id", (1, 1, 2, 3))


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _holed(_supplier_boxes(spark, sf_dir), "rid", (2, 2, 4, 4))


def polygon_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplier's shape with which each customer's shares most area."""
    found = O.overlap_areas(_customers(spark, sf_dir), _suppliers(spark, sf_dir), "id", "rid").withColumn("area", F.round("area", 6))
    return S.largest_overlap(found, "id", "rid").select("id", "rid", "area", F.round("percent", 4).alias("percent"))


def polygon_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a customer's and a supplier's shape that share area, with intersection over union."""
    found = O.overlap_areas(_customers(spark, sf_dir), _suppliers(spark, sf_dir), "id", "rid")
    iou = F.col("area") / (F.col("left_area") + F.col("right_area") - F.col("area"))
    return found.select("id", "rid", F.round("area", 6).alias("area"), F.round(iou, 6).alias("iou"))


def polygon_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplier's shape that holds an interior point of each customer's, or else shares most area with it."""
    return O.parents(_customers(spark, sf_dir), _suppliers(spark, sf_dir), "id", "rid").select("id", "rid", "how")


def snapped_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers inside a supplier's shape, or at the nearest place of a border one degree away at most."""
    points = customers(spark, sf_dir).select("c_custkey", (F.col("lon") + 0.001).alias("x"), (F.col("lat") + 0.002).alias("y"))
    found = O.snapped(points, _suppliers(spark, sf_dir), "c_custkey", "rid", 1.0, strict=False)
    return found.where("distance IS NOT NULL").select("c_custkey", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round("distance", 6).alias("distance"))


def atomic_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area by the set of customers' boxes that cover it."""
    c = boxes(table(spark, sf_dir, "customer"), "c_custkey", F.lit(4.0)).groupBy("west", "south", "east", "north").agg(F.min("c_custkey").alias("id"))
    shapes = c.select("id", F.array(G.box_ring(*[F.col(k) for k in S.BOX])).alias("rings"))
    cells = O.atomic_cells(shapes, "id", 4.0)
    return cells.groupBy(F.array_join(F.col("members").cast("array<string>"), ",").alias("members")).agg(F.round(F.sum("area"), 6).alias("area"))


def coverage_thinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares merged by code and thinned where borders are straight: area and points of each code."""
    merged = O.regions(squares(spark, sf_dir), "id", "code", 4.0).select("code", "rings")
    thin = T.thinned(merged, "code", T.weights(merged, "code"), 0.01, 4.0)
    points = F.aggregate("rings", F.lit(0), lambda n, r: n + F.size(r))
    return thin.groupBy("code").agg(F.count(F.lit(1)).alias("parts"), F.round(F.sum(O.shape_area(F.col("rings"))), 6).alias("area"), F.sum(points).alias("points"))


def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The areas that squares enclose and leave free, and the square that each would go to."""
    return O.gaps(squares(spark, sf_dir, 30, 30), "id", 4.0).select("x", "y", F.round("area", 6).alias("area"), "id", "shared")


def shape_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings that cross themselves, one for each customer, with their faults and what repair makes of them."""
    c = boxes(table(spark, sf_dir, "customer"), "c_custkey", F.lit(2.0)).withColumn("h", 1 + F.round(F.abs("c_acctbal")) / 10000)
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    w, s = F.col("west"), F.col("south")
    shapes = c.select(F.col("c_custkey").alias("id"), F.array(F.array(p(w, s), p(w + 2, s + 2), p(w + 2, s), p(w, s + F.col("h")))).alias("rings"))
    fixed = O.repaired(shapes, "id", 4.0).groupBy("id").agg(F.count(F.lit(1)).alias("parts"), F.round(F.sum("area"), 5).alias("area"))
    return O.validity(shapes, "id", 4.0).select("id", "crossings", "valid").join(fixed, "id")


QUERIES = {f.__name__: f for f in (polygon_argmax, polygon_overlaps, polygon_parents, snapped_points, atomic_cells, coverage_thinned, coverage_gaps, shape_repair)}

_GRID = f"""
    g AS (SELECT floor({SQL_LON.format(k="c_custkey")})::DOUBLE AS west, floor({SQL_LAT.format(k="c_custkey")})::DOUBLE AS south, min(c_custkey) AS id FROM customer GROUP BY 1, 2),
    r AS (SELECT floor({SQL_LON.format(k="s_suppkey * 7 + 3")})::DOUBLE AS w2, floor({SQL_LAT.format(k="s_suppkey * 7 + 3")})::DOUBLE AS s2, min(s_suppkey) AS rid FROM supplier GROUP BY 1, 2)"""


def _shared(a: tuple[float, ...], b: tuple[float, ...]) -> str:
    """Area shared by two boxes given relative to the corners of g and r."""
    return (
        f"greatest(0, least(west + {a[2]}, w2 + {b[2]}) - greatest(west + {a[0]}, w2 + {b[0]})) * greatest(0, least(south + {a[3]}, s2 + {b[3]}) - greatest(south + {a[1]}, s2 + {b[1]}))"
    )


_OUT, _IN, _OUT2, _IN2 = (0, 0, 4, 4), (1, 1, 2, 3), (0, 0, 6, 6), (2, 2, 4, 4)
_PAIRS = f"""{_GRID},
    o AS (SELECT id, rid, {_shared(_OUT, _OUT2)} - {_shared(_IN, _OUT2)} - {_shared(_OUT, _IN2)} + {_shared(_IN, _IN2)} AS area FROM g, r),
    p AS (SELECT * FROM o WHERE area > 0)"""
_TOP = "SELECT id, rid, round(area, 6) AS area, round(area / 14 * 100, 4) AS percent FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY area DESC, rid) = 1"
_FOLDED = _SQUARES.replace("% 60) + 60) % 60", "% 30) + 30) % 30").replace("% 40) + 40) % 40", "% 30) + 30) % 30")
_SIDES = """s(dx, dy, px, py, qx, qy) AS (VALUES (1, 0, 0, 0, 0, -1), (-1, 0, -1, 0, -1, -1), (0, 1, 0, 0, -1, 0), (0, -1, 0, -1, -1, -1))"""
ORACLES = {
    "polygon_argmax": f"WITH {_PAIRS} {_TOP}",
    "polygon_overlaps": f"WITH {_PAIRS} SELECT id, rid, round(area, 6) AS area, round(area / (14 + 32 - area), 6) AS iou FROM p",
    "polygon_parents": f"""WITH {_PAIRS}, q AS (SELECT id, west + 3 AS x, south + 2.000004 AS y FROM g),
      h AS (SELECT q.id, count(*) AS n, min(rid) AS rid FROM q, r WHERE x >= w2 AND x < w2 + 6 AND y >= s2 AND y < s2 + 6 AND NOT (x >= w2 + 2 AND x < w2 + 4 AND y >= s2 + 2 AND y < s2 + 4) GROUP BY 1),
      t AS ({_TOP})
      SELECT g.id, CASE WHEN h.n = 1 THEN h.rid ELSE t.rid END AS rid, CASE WHEN h.n = 1 THEN 'point' WHEN t.rid IS NULL THEN 'none' ELSE 'overlap' END AS how FROM g LEFT JOIN h ON h.id = g.id LEFT JOIN t ON t.id = g.id""",
    "snapped_points": f"""WITH {_GRID}, c AS (SELECT c_custkey, {SQL_LON.format(k="c_custkey")} + 0.001::DOUBLE AS x, {SQL_LAT.format(k="c_custkey")} + 0.002::DOUBLE AS y FROM customer),
      i AS (SELECT DISTINCT c_custkey FROM c, r WHERE x > w2 AND x < w2 + 6 AND y > s2 AND y < s2 + 6 AND NOT (x > w2 + 2 AND x < w2 + 4 AND y > s2 + 2 AND y < s2 + 4)),
      b(x1, y1, x2, y2) AS (VALUES (0, 0, 6, 0), (0, 6, 6, 6), (0, 0, 0, 6), (6, 0, 6, 6), (2, 2, 4, 2), (2, 4, 4, 4), (2, 2, 2, 4), (4, 2, 4, 4)),
      n AS (SELECT c_custkey, x, y, least(greatest(x, w2 + x1), w2 + x2) AS nx, least(greatest(y, s2 + y1), s2 + y2) AS ny FROM c ANTI JOIN i USING (c_custkey), r, b),
      d AS (SELECT *, sqrt(pow(nx - x, 2) + pow(ny - y, 2)) AS d FROM n)
      SELECT c_custkey, round(nx, 6) AS x, round(ny, 6) AS y, round(d, 6) AS distance FROM d WHERE d <= 1 QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY round(d, 12), nx, ny) = 1
      UNION ALL SELECT c_custkey, round(x, 6), round(y, 6), 0.0::DOUBLE FROM c SEMI JOIN i USING (c_custkey)""",
    "atomic_cells": f"""WITH {_GRID}, u AS (SELECT west + i AS x, south + j AS y, string_agg(id::VARCHAR, ',' ORDER BY id) AS members FROM g, range(4) a(i), range(4) b(j) GROUP BY 1, 2)
      SELECT members, count(*)::DOUBLE AS area FROM u GROUP BY members""",
    "coverage_thinned": f"""WITH RECURSIVE {_SQUARES}, {_SIDES},
      v AS (SELECT DISTINCT w + i AS x, s + j AS y FROM u, range(2) a(i), range(2) b(j)),
      -- The four sides at a point, with the codes of the squares on both.
      e AS (SELECT x, y, dx, dy, a.code AS p, b.code AS q FROM v, s LEFT JOIN u a ON a.w = x + px AND a.s = y + py LEFT JOIN u b ON b.w = x + qx AND b.s = y + qy WHERE a.code IS DISTINCT FROM b.code),
      k AS (SELECT x, y FROM e GROUP BY x, y HAVING count(*) > 2 OR (sum(dx) <> 0 OR sum(dy) <> 0)),
      n AS (SELECT code, count(*) // 2 AS points FROM (SELECT x, y, p AS code FROM e UNION ALL SELECT x, y, q FROM e) JOIN k USING (x, y) WHERE code IS NOT NULL GROUP BY code),
      l AS (SELECT a.id AS x, b.id AS y FROM u a JOIN u b ON abs(a.w - b.w) + abs(a.s - b.s) = 1 AND a.code = b.code),
      c(id, reach) AS (SELECT id, id FROM u UNION SELECT c.id, l.y FROM c JOIN l ON l.x = c.reach),
      m AS (SELECT id, min(reach) AS root FROM c GROUP BY id)
      SELECT u.code, count(DISTINCT root) AS parts, count(*)::DOUBLE AS area, any_value(n.points)::BIGINT AS points FROM u JOIN m ON m.id = u.id JOIN n ON n.code = u.code GROUP BY u.code""",
    "coverage_gaps": f"""WITH RECURSIVE {_FOLDED}, f AS (SELECT x, y FROM range(-1, 31) a(x), range(-1, 31) b(y) ANTI JOIN u ON u.w = x AND u.s = y),
      c(x, y) AS (SELECT -1::BIGINT, -1::BIGINT UNION SELECT f.x, f.y FROM c JOIN f ON abs(f.x - c.x) + abs(f.y - c.y) = 1),
      i AS (SELECT f.x, f.y FROM f ANTI JOIN c ON c.x = f.x AND c.y = f.y),
      t(x, y, rx, ry) AS (SELECT x, y, x, y FROM i UNION SELECT t.x, t.y, i.x, i.y FROM t JOIN i ON abs(i.x - t.rx) + abs(i.y - t.ry) = 1),
      g AS (SELECT x, y, min(rx * 1000 + ry) AS k FROM t GROUP BY x, y),
      b AS (SELECT k, u.id, count(*)::DOUBLE AS shared FROM g JOIN u ON abs(u.w - g.x) + abs(u.s - g.y) = 1 GROUP BY k, u.id QUALIFY row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, u.id) = 1)
      SELECT (k // 1000)::DOUBLE AS x, (k % 1000)::DOUBLE AS y, (SELECT count(*) FROM g WHERE g.k = b.k)::DOUBLE AS area, id, shared FROM b""",
    "shape_repair": "WITH h AS (SELECT c_custkey AS id, 1 + round(abs(c_acctbal)) / 10000 AS h FROM customer) SELECT id, 1::BIGINT AS crossings, false AS valid, 2::BIGINT AS parts, round(h * h / (2 + h) + 4 / (2 + h), 5) AS area FROM h",
}
