"""The driver tables as geographic inputs: positions and boxes derived from keys by integer arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The same positions in SQL.
SQL_LAT = "((({k}) * 7919) % 12000) / 100.0 - 60"
SQL_LON = "((({k}) * 104729) % 36000) / 100.0 - 180"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lat(key: str) -> Column:
    return (F.col(key) * 7919 % 12000) / F.lit(100.0) - 60.0


def lon(key: str) -> Column:
    return (F.col(key) * 104729 % 36000) / F.lit(100.0) - 180.0


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.withColumn("lat", lat("c_custkey")).withColumn("lon", lon("c_custkey"))


def suppliers(spark: SparkSession, sf_dir: str, offset: int = 3) -> DataFrame:
    """Suppliers lie where customer s_suppkey * 7 + offset does not, so that distances are seldom zero."""
    s = table(spark, sf_dir, "supplier").withColumn("__k", F.col("s_suppkey") * 7 + offset)
    return s.withColumn("rlat", lat("__k")).withColumn("rlon", lon("__k")).drop("__k")


SQL_POINTS = f"""
    c AS (SELECT *, {SQL_LAT.format(k="c_custkey")} AS lat, {SQL_LON.format(k="c_custkey")} AS lon FROM customer),
    s AS (SELECT *, {SQL_LAT.format(k="s_suppkey * 7 + 3")} AS rlat, {SQL_LON.format(k="s_suppkey * 7 + 3")} AS rlon FROM supplier)"""


def sql_km(lat1: str = "lat", lon1: str = "lon", lat2: str = "rlat", lon2: str = "rlon", radius: float = 6371.0088) -> str:
    return f"({2 * radius} * asin(sqrt(least(1.0, pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)))))"


def boxes(df: DataFrame, key: str, size: Column) -> DataFrame:
    """Axis-aligned boxes whose south-west corner is the key's position in whole degrees."""
    west, south = F.floor(lon(key)).cast("double"), F.floor(lat(key)).cast("double")
    return df.withColumn("west", west).withColumn("south", south).withColumn("east", west + size).withColumn("north", south + size)
