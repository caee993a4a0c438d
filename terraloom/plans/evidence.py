"""Queries over clusters and evidence from neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import clusters as L
from ..operators import ranking as R
from .flows import _KM, _grid_boxes
from .tables import SQL_LAT, SQL_LON, SQL_POINTS, customers, suppliers


def cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-link clusters of each nation's customers, 600 km apart."""
    c = customers(spark, sf_dir)
    out = L.cluster_stats(c, L.single_link(c, "c_custkey", 600.0, "c_nationkey"), "c_custkey")
    return out.select("cluster", "members", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.round("radius_km", 4).alias("radius_km"))


def dense_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.dense_core(customers(spark, sf_dir), "c_custkey", 500.0, 3)


def leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy by segment of guessing a customer's nation from the nearest other customer within 800 km."""
    c = customers(spark, sf_dir)
    told = L.leave_one_out(c, "c_custkey", "c_nationkey", 800.0).join(c.select("c_custkey", "c_mktsegment"), "c_custkey")
    return A.accuracy(told, ["c_mktsegment"], "actual", "predicted").withColumn("accuracy", F.round("accuracy", 6)).withColumn("hits", F.col("hits").cast("long"))


def distance_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = L.distance_evidence(customers(spark, sf_dir), suppliers(spark, sf_dir), "c_custkey", "s_suppkey", "s_nationkey", 5)
    return out.select("c_custkey", "s_nationkey", F.round("score", 6).alias("score"))


def rasterise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-degree cells by the number of boxes that cover their centres."""
    cells = L.rasterise(_grid_boxes(spark, sf_dir), "id", 0.5)
    return cells.groupBy("gx", "gy").agg(F.count(F.lit(1)).alias("n"))


def regions_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.regions_by_place(customers(spark, sf_dir), "c_nationkey")


def label_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as labels by balance, spaced 900 km at zoom 3.5 and 400 km at 4.5."""
    c = customers(spark, sf_dir).select("c_custkey", "lat", "lon", (-F.col("c_acctbal")).alias("rank"), F.when(F.col("c_custkey") % 4 == 0, 3.5).otherwise(4.5).alias("min_zoom"))
    return L.place_labels(c, "c_custkey", {3.5: 900.0, 4.5: 400.0})


def territory_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-degree cells that hold customers, by the nation of the nearest supplier to their centres."""
    c = customers(spark, sf_dir).select(F.floor(F.col("lat") / 4).alias("cy"), F.floor(F.col("lon") / 4).alias("cx")).distinct()
    cells = c.select((F.col("cy") * 1000 + F.col("cx")).alias("cell"), (F.col("cy") * 4.0 + 2).alias("lat"), (F.col("cx") * 4.0 + 2).alias("lon"))
    return L.territories(cells, suppliers(spark, sf_dir), "cell", "s_suppkey", "s_nationkey")


QUERIES = {f.__name__: f for f in (cluster_stats, dense_core, leave_one_out, distance_evidence, rasterise, regions_by_place, label_placement, territory_cells)}
_PAIRS = f"e AS (SELECT a.c_custkey AS x, b.c_custkey AS y, a.c_nationkey AS nx, b.c_nationkey AS ny, {_KM} AS km FROM c a JOIN c b ON a.c_custkey <> b.c_custkey AND abs(a.lat - b.lat) < 8)"
ORACLES = {
    "cluster_stats": f"""WITH RECURSIVE {SQL_POINTS}, {_PAIRS}, t(id, reach) AS (SELECT c_custkey, c_custkey FROM customer UNION SELECT t.id, e.y FROM t JOIN e ON e.x = t.reach AND e.km <= 600 AND e.nx = e.ny),
      k AS (SELECT id, min(reach) AS cluster FROM t GROUP BY 1), m AS (SELECT cluster, count(*) AS members, avg(lat) AS lat, avg(lon) AS lon FROM k JOIN c ON c_custkey = id GROUP BY 1)
      SELECT b.cluster, any_value(members) AS members, round(any_value(b.lat), 6) AS lat, round(any_value(b.lon), 6) AS lon, round(max({_KM}), 4) AS radius_km FROM m b JOIN k ON k.cluster = b.cluster JOIN c a ON a.c_custkey = k.id GROUP BY 1""",
    "dense_core": f"WITH {SQL_POINTS}, {_PAIRS} SELECT x AS c_custkey FROM e WHERE km <= 500 GROUP BY 1 HAVING count(*) + 1 >= 3",
    "leave_one_out": f"""WITH {SQL_POINTS}, {_PAIRS}, n AS (SELECT x, ny FROM e WHERE km <= 800 QUALIFY row_number() OVER (PARTITION BY x ORDER BY round(km, 9), y) = 1)
      SELECT c_mktsegment, count(*) AS n, sum(coalesce((ny = c_nationkey)::INT, 0))::BIGINT AS hits, round(avg(coalesce((ny = c_nationkey)::INT, 0)), 6) AS accuracy FROM customer LEFT JOIN n ON x = c_custkey GROUP BY 1""",
    "distance_evidence": f"""WITH {SQL_POINTS}, n AS (SELECT a.c_custkey, s_nationkey, {_KM.replace("b.lat", "b.rlat").replace("b.lon", "b.rlon")} AS km FROM c a, s b QUALIFY row_number() OVER (PARTITION BY a.c_custkey ORDER BY km, s_suppkey) <= 5)
      SELECT c_custkey, s_nationkey, round(sum(1 / greatest(km, 0.01)), 6) AS score FROM n GROUP BY 1, 2""",
    "rasterise": f"""WITH g AS (SELECT DISTINCT floor({SQL_LON.format(k="c_custkey")})::BIGINT AS west, floor({SQL_LAT.format(k="c_custkey")})::BIGINT AS south FROM customer)
      SELECT west * 2 + i AS gx, south * 2 + j AS gy, count(*) AS n FROM g, (SELECT unnest(range(8)) AS i), (SELECT unnest(range(8)) AS j) GROUP BY 1, 2""",
    "regions_by_place": f"WITH {SQL_POINTS}, m AS (SELECT c_nationkey, avg(lat) AS lat, avg(lon) AS lon FROM c GROUP BY 1) SELECT c_nationkey, 'region-' || row_number() OVER (ORDER BY round(lat, 6) DESC, round(lon, 6), c_nationkey) AS region_id FROM m",
    "territory_cells": f"""WITH {SQL_POINTS}, g AS (SELECT DISTINCT floor(lat / 4)::BIGINT AS cy, floor(lon / 4)::BIGINT AS cx FROM c), a AS (SELECT cy * 1000 + cx AS cell, cy * 4.0::DOUBLE + 2 AS lat, cx * 4.0::DOUBLE + 2 AS lon FROM g)
      SELECT cell, s_nationkey FROM (SELECT a.cell, s_suppkey, s_nationkey, {_KM.replace("b.lat", "b.rlat").replace("b.lon", "b.rlon")} AS km FROM a, s b) QUALIFY row_number() OVER (PARTITION BY cell ORDER BY km, s_suppkey) = 1""",
}
