"""Queries by distance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import geo as G
from ..operators import aggregate as A
from ..operators import spatial as S
from .tables import SQL_POINTS, customers, sql_km, suppliers

KM = sql_km()


def guess_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers guess where their nation's first supplier is; scores by nation, ranked."""
    target = suppliers(spark, sf_dir).groupBy("s_nationkey").agg(F.min_by(F.struct("rlat", "rlon"), "s_suppkey").alias("t"))
    guesses = customers(spark, sf_dir).join(target, F.col("c_nationkey") == F.col("s_nationkey"))
    km = G.haversine_km(F.col("lat"), F.col("lon"), F.col("t.rlat"), F.col("t.rlon"), G.SCORE_EARTH_KM)
    scored = guesses.select("c_nationkey", km.alias("km")).withColumn("score", G.guess_score(F.col("km"), F.lit(15000.0)))
    totals = scored.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("guesses"), F.round(F.sum("score"), 6).alias("total"), F.round(F.avg("score"), 6).alias("average"), F.round(F.avg("km"), 4).alias("average_km"))
    return totals.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("total"), "c_nationkey")).cast("long"))


def nearest_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = S.nearest(customers(spark, sf_dir), suppliers(spark, sf_dir), "c_custkey", "s_suppkey")
    return near.select("c_custkey", "s_suppkey", F.round("km", 6).alias("km"))


def knn_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    won = S.knn_vote(customers(spark, sf_dir), suppliers(spark, sf_dir), "c_custkey", "s_suppkey", "s_nationkey", 10)
    return won.select("c_custkey", "s_nationkey", F.col("votes").cast("long").alias("votes"), F.col("others").cast("long").alias("others"))


def radius_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    won = S.radius_vote(customers(spark, sf_dir), suppliers(spark, sf_dir), "c_custkey", "s_suppkey", "s_nationkey", 1500.0)
    return won.select("c_custkey", "s_nationkey", F.round("score", 6).alias("score"), F.round("nearest_km", 6).alias("nearest_km"))


def radius_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers around each customer, and how far out of line it is."""
    radii = (60.0, 120.0, 240.0)
    points = customers(spark, sf_dir).select("c_custkey", "c_nationkey", "lat", "lon")
    every, same = (S.radius_counts(points, "c_custkey", radii, code) for code in (None, "c_nationkey"))
    same = same.select("c_custkey", *[F.col(f"within_{r:g}").alias(f"same_{r:g}") for r in radii])
    both = every.join(same, "c_custkey")
    counts = [c for r in radii for c in (F.col(f"same_{r:g}"), F.col(f"within_{r:g}") - F.col(f"same_{r:g}"))]
    return both.select("c_custkey", *[f"{k}_{r:g}" for k in ("within", "same") for r in radii], C.outlier_severity(*counts).cast("long").alias("severity"))


def cell_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = S.cell_range_join(customers(spark, sf_dir), suppliers(spark, sf_dir), 250.0, 1.0, 2)
    return pairs.select("c_custkey", "s_suppkey", F.round("km", 6).alias("km"), C.distance_bucket(F.col("km")).alias("bucket"))


def _by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers(spark, sf_dir).select("c_nationkey", "c_custkey", "lat", "lon")


def medoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.medoid(_by_nation(spark, sf_dir), "c_nationkey", "c_custkey").select("c_nationkey", "c_custkey", F.round("total_km", 3).alias("total_km"))


def core_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    core = A.max_error_km(A.core_median(_by_nation(spark, sf_dir), "c_nationkey", "c_custkey"))
    return core.select("c_nationkey", "n_core", F.round("median_km", 4).alias("median_km"), "max_error_km")


def longitude_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.longitude_extent(customers(spark, sf_dir), "c_nationkey").select("c_nationkey", *[F.round(c, 6).alias(c) for c in ("west", "east", "width")])


def projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = customers(spark, sf_dir)
    e = G.equal_area_xy(F.col("lat"), F.col("lon"))
    q = G.equidistant_xy(F.col("lat"), F.col("lon"), F.lit(10.0), F.lit(20.0))
    t = G.tile(F.col("lat"), F.col("lon"), 6)
    return c.select("c_custkey", F.round(G.mercator_y(F.col("lat")), 8).alias("my"), F.round(G.mercator_latitude(G.mercator_y(F.col("lat"))), 6).alias("back"), F.round(e[1], 5).alias("ey"), F.round(q[0], 4).alias("qx"), F.round(q[1], 4).alias("qy"), t[0].cast("long").alias("tx"), t[1].cast("long").alias("ty"))


QUERIES = {f.__name__: f for f in (guess_score, nearest_supplier, knn_vote, radius_vote, radius_counts, cell_range_join, medoid, core_median, longitude_extent, projections)}
_GROUPED = """
    d AS (SELECT a.c_nationkey, a.c_custkey, sum({km}) AS total_km FROM c a JOIN c b ON a.c_nationkey = b.c_nationkey GROUP BY ALL),
    m AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY round(total_km, 6), c_custkey) = 1)""".format(km=sql_km("a.lat", "a.lon", "b.lat", "b.lon"))
ORACLES = {
    "guess_score": f"""WITH {SQL_POINTS},
    t AS (SELECT s_nationkey, rlat, rlon FROM s QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) = 1),
    g AS (SELECT c_nationkey, {sql_km(radius=6371.0)} AS km FROM c JOIN t ON c_nationkey = s_nationkey),
    x AS (SELECT *, CASE WHEN km <= 5 THEN 1.0 ELSE pow(1 - greatest(0, least(1, (km - 5) / (15000.0 - 5))), 0.65) END AS score FROM g)
    SELECT c_nationkey, count(*) AS guesses, round(sum(score), 6) AS total, round(avg(score), 6) AS average, round(avg(km), 4) AS average_km, row_number() OVER (ORDER BY round(sum(score), 6) DESC, c_nationkey) AS rank FROM x GROUP BY c_nationkey""",
    "nearest_supplier": f"WITH {SQL_POINTS} SELECT c_custkey, s_suppkey, round(km, 6) AS km FROM (SELECT c_custkey, s_suppkey, {KM} AS km FROM c, s) QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY km, s_suppkey) = 1",
    "knn_vote": f"""WITH {SQL_POINTS}, n AS (SELECT * FROM (SELECT c_custkey, s_suppkey, s_nationkey, {KM} AS km FROM c, s) QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY km, s_suppkey) <= 10),
    v AS (SELECT c_custkey, s_nationkey, count(*) AS votes FROM n GROUP BY ALL)
    SELECT c_custkey, s_nationkey, votes, (sum(votes) OVER (PARTITION BY c_custkey) - votes)::BIGINT AS others FROM v QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY votes DESC, s_nationkey DESC) = 1""",
    "radius_vote": f"""WITH {SQL_POINTS}, n AS (SELECT c_custkey, s_nationkey, {KM} AS km FROM c, s WHERE {KM} <= 1500),
    v AS (SELECT c_custkey, s_nationkey, sum(1 / pow(greatest(km, 1), 1.5)) AS score, min(km) AS nearest_km FROM n GROUP BY ALL)
    SELECT c_custkey, s_nationkey, round(score, 6) AS score, round(nearest_km, 6) AS nearest_km FROM v QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY round(score, 9) DESC, round(nearest_km, 9), s_nationkey) = 1""",
    "radius_counts": f"""WITH {SQL_POINTS}, p AS (SELECT a.c_custkey, a.c_nationkey = b.c_nationkey AS same, {sql_km("a.lat", "a.lon", "b.lat", "b.lon")} AS km FROM c a LEFT JOIN c b ON a.c_custkey <> b.c_custkey AND abs(a.lat - b.lat) < 3),
    n AS (SELECT c_custkey, {", ".join(f"count(*) FILTER (km <= {r}) AS within_{r}, count(*) FILTER (km <= {r} AND same) AS same_{r}" for r in (60, 120, 240))} FROM p GROUP BY 1)
    SELECT *, (CASE WHEN same_120 = 0 AND within_120 >= 5 THEN 3 WHEN within_60 >= 5 AND same_60 <= 0.2 * within_60 OR within_120 >= 8 AND same_120 <= 0.25 * within_120 THEN 2
      WHEN same_120 >= 2 AND within_120 - same_120 >= 2 THEN 1 WHEN same_240 = 0 AND within_240 >= 5 THEN 1 ELSE 0 END)::BIGINT AS severity FROM n""",
    "cell_range_join": f"""WITH {SQL_POINTS}, p AS (SELECT c_custkey, s_suppkey, {KM} AS km FROM c, s WHERE abs(floor(lat) - floor(rlat)) <= 2 AND abs(floor(lon) - floor(rlon)) <= 2)
    SELECT c_custkey, s_suppkey, round(km, 6) AS km, CASE WHEN km < 1 THEN '<1' WHEN km < 2 THEN '1-2' WHEN km < 5 THEN '2-5' WHEN km < 10 THEN '5-10' WHEN km < 20 THEN '10-20' WHEN km < 50 THEN '20-50' WHEN km < 100 THEN '50-100' ELSE '100+' END AS bucket FROM p WHERE km <= 250""",
    "medoid": f"WITH {SQL_POINTS}, {_GROUPED} SELECT c_nationkey, c_custkey, round(total_km, 3) AS total_km FROM m",
    "core_median": f"""WITH {SQL_POINTS}, {_GROUPED},
    r AS (SELECT c.*, row_number() OVER (PARTITION BY c.c_nationkey ORDER BY round({sql_km("c.lat", "c.lon", "x.lat", "x.lon")}, 6), c.c_custkey) AS r, count(*) OVER (PARTITION BY c.c_nationkey) AS n
          FROM c JOIN m ON m.c_nationkey = c.c_nationkey JOIN c x ON x.c_custkey = m.c_custkey),
    k AS (SELECT * FROM r WHERE r <= greatest(3, ceil(n * 0.9::DOUBLE))),
    q AS (SELECT a.c_nationkey, quantile_cont({sql_km("a.lat", "a.lon", "b.lat", "b.lon")}, 0.5) AS median_km FROM k a JOIN k b ON a.c_nationkey = b.c_nationkey AND a.c_custkey < b.c_custkey GROUP BY 1)
    SELECT k.c_nationkey, count(*) AS n_core, round(any_value(median_km), 4) AS median_km, CASE WHEN count(*) = 1 THEN 25.0 ELSE greatest(1.0, round(any_value(median_km))) END AS max_error_km FROM k LEFT JOIN q ON q.c_nationkey = k.c_nationkey GROUP BY 1""",
    "longitude_extent": f"""WITH {SQL_POINTS}, p AS (SELECT DISTINCT c_nationkey, lon FROM c),
    g AS (SELECT *, coalesce(lead(lon) OVER w, min(lon) OVER (PARTITION BY c_nationkey) + 360) AS after FROM p WINDOW w AS (PARTITION BY c_nationkey ORDER BY lon)),
    b AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY round(after - lon, 9) DESC, lon) = 1)
    SELECT c_nationkey, round(CASE WHEN after >= 180 THEN after - 360 ELSE after END, 6) AS west, round(lon, 6) AS east, round(360 - (after - lon), 6) AS width FROM b""",
    "projections": f"""WITH {SQL_POINTS}, p AS (SELECT c_custkey, lat, lon, (1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 AS y, (lon + 180) / 360.0 AS x,
      acos(greatest(-1, least(1, sin(radians(10)) * sin(radians(lat)) + cos(radians(10)) * cos(radians(lat)) * cos(radians(lon - 20))))) AS a FROM c)
    SELECT c_custkey, round(y, 8) AS my, round(lat, 6) AS back, round(sin(radians(lat)) * 6371.0088, 5) AS ey,
      round(CASE WHEN abs(a) < 1e-12 THEN 1 ELSE a / sin(a) END * 6371.0088 * cos(radians(lat)) * sin(radians(lon - 20)), 4) AS qx,
      round(CASE WHEN abs(a) < 1e-12 THEN 1 ELSE a / sin(a) END * 6371.0088 * (cos(radians(10)) * sin(radians(lat)) - sin(radians(10)) * cos(radians(lat)) * cos(radians(lon - 20))), 4) AS qy,
      greatest(0, least(63, floor(x * 64)))::BIGINT AS tx, greatest(0, least(63, floor(y * 64)))::BIGINT AS ty FROM p""",
}
