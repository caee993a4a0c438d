"""The town list over the driver tables: customers as candidates, suppliers as places, regions as countries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import towns
from .tables import SQL_POINTS, customers, sql_km, suppliers, table


def town_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five towns of each region. Positions are drawn together tenfold, so that customers have suppliers near; names are those of the nations, and suppliers with most money are primary places."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("country"), T.name_key(F.col("n_name")).alias("key"))
    c = customers(spark, sf_dir).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.select(
        F.col("c_custkey").alias("id"), "country", F.col("key").alias("primary_key"), F.col("key").alias("ascii_key"), F.array(F.lower("c_mktsegment")).alias("alternates"), F.col("c_acctbal").alias("population"),
        (F.col("lat") / 10).alias("lat"), (F.col("lon") / 10).alias("lon"), (F.col("c_mktsegment") == "BUILDING").alias("capital"),
    )
    s = suppliers(spark, sf_dir).join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    s = s.select(F.col("s_suppkey").alias("place_id"), "country", "key", F.col("key").alias("english_key"), (F.col("rlat") / 10).alias("rlat"), (F.col("rlon") / 10).alias("rlon"), F.col("s_suppkey").alias("ord"), (F.col("s_acctbal") >= 6000).alias("primary"))
    out = towns.town_list(c, s, "country", 5)
    return out.select("country", F.col("rank").cast("long").alias("rank"), "id", "place_id", F.col("tier").cast("long").alias("tier"), F.col("grade").cast("long").alias("grade"))


QUERIES = {"town_list": town_list}
ORACLES = {
    "town_list": f"""WITH {SQL_POINTS},
      a AS (SELECT c_custkey AS id, n_regionkey AS country, n_name AS name, c_acctbal AS population, lat / 10 AS lat, lon / 10 AS lon, c_mktsegment = 'BUILDING' AS capital FROM c JOIN nation ON n_nationkey = c_nationkey),
      b AS (SELECT s_suppkey AS place_id, n_regionkey AS land, n_name AS called, rlat / 10 AS rlat, rlon / 10 AS rlon, CASE WHEN s_acctbal >= 6000 THEN 0 ELSE 1 END AS tier FROM s JOIN nation ON n_nationkey = s_nationkey),
      p AS (SELECT *, CASE WHEN name = called THEN 0 ELSE 4 END AS grade, {sql_km()} AS km FROM a JOIN b ON country = land AND abs(floor(lat / 0.1) - floor(rlat / 0.1)) <= 2 AND abs(floor(lon / 0.1) - floor(rlon / 0.1)) <= 2),
      g AS (SELECT * FROM p WHERE km <= CASE grade WHEN 0 THEN 20 ELSE 1 END),
      m AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY id ORDER BY tier, grade, km, place_id) = 1),
      d AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY grade, km, population DESC, id) = 1),
      r AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY tier, population DESC, id) AS rank FROM d QUALIFY rank <= 5),
      k AS (SELECT * FROM m WHERE capital QUALIFY row_number() OVER (PARTITION BY country ORDER BY tier, population DESC, id) = 1),
      f AS (SELECT k.*, least(5, 1 + (SELECT count(*) FROM r WHERE r.country = k.country)) AS rank FROM k WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.id = k.id))
      SELECT country, rank, id, place_id, tier::BIGINT AS tier, grade::BIGINT AS grade FROM r WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.country = r.country AND f.rank <= r.rank)
      UNION ALL SELECT country, rank, id, place_id, tier::BIGINT, grade::BIGINT FROM f""",
}
