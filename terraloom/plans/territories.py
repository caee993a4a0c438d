"""Queries over Voronoi cells of the suppliers' places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import voronoi as V
from .tables import SQL_POINTS, suppliers

BOX = (-180.0, -60.0, 180.0, 60.0)
#: Shorter sides come from four seeds on one circle and count as none.
LEAST = 1e-6


def _cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = suppliers(spark, sf_dir).select("s_suppkey", "s_nationkey", F.col("rlon").alias("x"), F.col("rlat").alias("y"))
    return V.cells(s, "s_suppkey", BOX), s


def voronoi_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cell of each supplier: area, circumference and number of neighbours."""
    sides = V.sides(_cells(spark, sf_dir)[0], "s_suppkey")
    near = F.count(F.when((F.col("length") > LEAST) & F.col("other").isNotNull(), 1))
    return sides.groupBy("s_suppkey").agg(F.round(F.sum("area"), 5).alias("area"), F.round(F.sum("length"), 5).alias("around"), near.alias("neighbours"))


def voronoi_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells dissolved by nation: number, area and length of the border."""
    found, codes = _cells(spark, sf_dir)
    return V.regions(found, "s_suppkey", codes, "s_nationkey").select("s_nationkey", "cells", F.round("area", 4).alias("area"), F.round("border", 4).alias("border"))


QUERIES = {f.__name__: f for f in (voronoi_cells, voronoi_regions)}
# A side is the stretch of a bisector, or of a side of the box, that every other seed and the box leave.
_SIDES = f"""WITH {SQL_POINTS},
  d AS (SELECT rlon AS x, rlat AS y, min(s_suppkey) AS id FROM s GROUP BY 1, 2),
  l AS (SELECT p.id, p.x, p.y, q.id AS other, (p.x + q.x) / 2 AS mx, (p.y + q.y) / 2 AS my, (p.y - q.y) / sqrt((q.x - p.x) ** 2 + (q.y - p.y) ** 2) AS ux, (q.x - p.x) / sqrt((q.x - p.x) ** 2 + (q.y - p.y) ** 2) AS uy, sqrt((q.x - p.x) ** 2 + (q.y - p.y) ** 2) / 2 AS h, 0 AS side FROM d p, d q WHERE p.id <> q.id
    UNION ALL SELECT id, x, y, NULL, -180, y, 0, 1, x + 180, 1 FROM d UNION ALL SELECT id, x, y, NULL, 180, y, 0, 1, 180 - x, 2 FROM d
    UNION ALL SELECT id, x, y, NULL, x, -60, 1, 0, y + 60, 3 FROM d UNION ALL SELECT id, x, y, NULL, x, 60, 1, 0, 60 - y, 4 FROM d),
  k AS (SELECT l.id, l.other, l.side, l.h, ux * (r.x - l.x) + uy * (r.y - l.y) AS a, ((r.x + l.x) / 2 - mx) * (r.x - l.x) + ((r.y + l.y) / 2 - my) * (r.y - l.y) AS c FROM l JOIN d r ON r.id <> l.id AND r.id IS DISTINCT FROM l.other
    UNION ALL SELECT id, other, side, h, ux, 180 - mx FROM l UNION ALL SELECT id, other, side, h, -ux, mx + 180 FROM l
    UNION ALL SELECT id, other, side, h, uy, 60 - my FROM l UNION ALL SELECT id, other, side, h, -uy, my + 60 FROM l),
  e AS (SELECT id, other, side, h, min(c / a) FILTER (a > 1e-12) - max(c / a) FILTER (a < -1e-12) AS length FROM k GROUP BY ALL HAVING NOT coalesce(bool_or(abs(a) <= 1e-12 AND c < -1e-9), false) AND length > {LEAST})"""
ORACLES = {
    "voronoi_cells": f"{_SIDES} SELECT id AS s_suppkey, round(sum(h * length / 2), 5) AS area, round(sum(length), 5) AS around, count(other) AS neighbours FROM e GROUP BY 1",
    "voronoi_regions": f"""{_SIDES} SELECT a.s_nationkey, count(DISTINCT id) AS cells, round(sum(h * length / 2), 4) AS area, round(sum(CASE WHEN b.s_nationkey = a.s_nationkey THEN 0 ELSE length END), 4) AS border
      FROM e JOIN supplier a ON a.s_suppkey = id LEFT JOIN supplier b ON b.s_suppkey = other GROUP BY 1""",
}
