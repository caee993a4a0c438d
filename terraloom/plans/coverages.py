"""Queries over a coverage: one-degree squares around customers, each of the nation of its first customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo as G
from ..operators import coverage as V
from .tables import SQL_LAT, SQL_LON, customers


def squares(spark: SparkSession, sf_dir: str, wide: int = 60, high: int = 40) -> DataFrame:
    """Squares in a part of the world that customers fill densely enough: positions folded into so many degrees."""
    c = customers(spark, sf_dir).withColumn("west", F.pmod(F.floor("lon"), F.lit(wide)).cast("double")).withColumn("south", F.pmod(F.floor("lat"), F.lit(high)).cast("double"))
    first = c.groupBy("west", "south").agg(F.min_by("c_nationkey", "c_custkey").alias("nation"), F.min("c_custkey").alias("id"))
    ring = G.box_ring(F.col("west"), F.col("south"), F.col("west") + 1, F.col("south") + 1)
    return first.select("id", (F.col("nation") % 5).alias("code"), F.array(ring).alias("rings"))


def coverage_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.adjacency(squares(spark, sf_dir), "id")


def coverage_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.corner_adjacency(squares(spark, sf_dir), "id")


def coverage_dissolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.dissolve(squares(spark, sf_dir), "id", "code")


def coverage_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that are wrong once every seventh square is there twice."""
    units = squares(spark, sf_dir)
    twice = units.unionByName(units.where("id % 7 = 0").withColumn("id", -F.col("id") - 1))
    return V.faults(twice, "id").select(F.col("ax").alias("x1"), F.col("ay").alias("y1"), F.col("bx").alias("x2"), F.col("by").alias("y2"), "n")


def shape_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label point, points and path of each square, drawn with a hole in the middle."""
    r = F.col("rings")[0]
    hole = G.box_ring(r[0]["x"] + 0.25, r[0]["y"] + 0.25, r[0]["x"] + 0.5, r[0]["y"] + 0.75)
    units = squares(spark, sf_dir).withColumn("rings", F.array(r, hole))
    at = V.label_point(F.col("rings"))
    return units.select("id", F.round(at["x"], 4).alias("x"), F.round(at["y"], 4).alias("y"), V.points_of(F.col("rings")).cast("long").alias("points"), V.svg_path(F.col("rings"), 8.0).alias("path"))


QUERIES = {f.__name__: f for f in (coverage_adjacency, coverage_corners, coverage_dissolve, coverage_faults, shape_labels)}
_SQUARES = f"""q AS (SELECT ((floor({SQL_LON.format(k="c_custkey")})::BIGINT % 60) + 60) % 60 AS w, ((floor({SQL_LAT.format(k="c_custkey")})::BIGINT % 40) + 40) % 40 AS s, c_custkey, c_nationkey FROM customer),
    u AS (SELECT w, s, min(c_custkey) AS id, arg_min(c_nationkey, c_custkey) % 5 AS code FROM q GROUP BY 1, 2)"""
ORACLES = {
    "coverage_adjacency": f"WITH {_SQUARES} SELECT a.id AS src, b.id AS dst, 1.0::DOUBLE AS shared FROM u a JOIN u b ON abs(a.w - b.w) + abs(a.s - b.s) = 1",
    "coverage_corners": f"WITH {_SQUARES} SELECT a.id AS src, b.id AS dst FROM u a JOIN u b ON abs(a.w - b.w) <= 1 AND abs(a.s - b.s) <= 1 AND a.id <> b.id",
    "coverage_dissolve": f"""WITH {_SQUARES}, n AS (SELECT a.code, count(*) AS n FROM u a JOIN u b ON abs(a.w - b.w) + abs(a.s - b.s) = 1 AND a.code = b.code GROUP BY 1)
      SELECT u.code, count(*) AS members, count(*)::DOUBLE AS area, (4 * count(*) - coalesce(any_value(n.n), 0))::DOUBLE AS border FROM u LEFT JOIN n ON n.code = u.code GROUP BY 1""",
    "coverage_faults": f"""WITH {_SQUARES}, t AS (SELECT w, s FROM u UNION ALL SELECT w, s FROM u WHERE id % 7 = 0),
      e AS (SELECT w AS x1, s AS y1, w + 1 AS x2, s AS y2, 1 AS f FROM t UNION ALL SELECT w + 1, s, w + 1, s + 1, 1 FROM t UNION ALL SELECT w, s + 1, w + 1, s + 1, 0 FROM t UNION ALL SELECT w, s, w, s + 1, 0 FROM t)
      SELECT x1::DOUBLE AS x1, y1::DOUBLE AS y1, x2::DOUBLE AS x2, y2::DOUBLE AS y2, count(*) AS n FROM e GROUP BY e.x1, e.y1, e.x2, e.y2 HAVING count(*) > 2 OR (count(*) = 2 AND sum(f) <> 1)""",
    "shape_labels": f"WITH {_SQUARES} SELECT id, (w + 0.75)::DOUBLE AS x, (s + 0.5)::DOUBLE AS y, 8::BIGINT AS points, 'M0.0 8.0L8.0 8.0L8.0 0.0L0.0 0.0ZM2.0 6.0L4.0 6.0L4.0 2.0L2.0 2.0Z' AS path FROM u",
}
