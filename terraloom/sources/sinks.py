"""Sinks: all by Spark's own writers, so that a lost executor's output is written again and nothing passes the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def feature_json(id: Column, properties: dict[str, Column], geometry_type: Column, coordinates: Column) -> Column:
    """A GeoJSON feature without spaces; null properties are left out. ``coordinates`` is JSON text."""
    props = F.to_json(F.struct(*[c.alias(k) for k, c in properties.items()]))
    shape = F.concat(F.lit('{"type":"'), geometry_type, F.lit('","coordinates":'), coordinates, F.lit("}"))
    name = F.to_json(F.struct(id.cast("string").alias("id")))
    return F.concat(F.lit('{"type":"Feature",'), F.regexp_replace(name, r"^\{|\}$", ""), F.lit(',"properties":'), props, F.lit(',"geometry":'), shape, F.lit("}"))


def point_coordinates(lat: Column, lon: Column) -> Column:
    return F.concat(F.lit("["), lon.cast("string"), F.lit(","), lat.cast("string"), F.lit("]"))


def write_geojson_lines(features: DataFrame, feature: Column, path: str) -> None:
    """One feature a line, in as many files as there are partitions."""
    features.select(feature.alias("value")).write.mode("overwrite").text(path)


def write_partitioned_json(df: DataFrame, path: str, by: str) -> None:
    """One folder per value, old files removed; nulls are left out of the objects."""
    df.repartition(by).write.mode("overwrite").option("ignoreNullFields", True).partitionBy(by).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_literals(df: DataFrame, path: str, fields: list[str], order: str) -> None:
    """Rows as object literals of a script, quoted and escaped, in order of ``order``."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    parts = [F.when(F.col(f).isNotNull(), F.concat(F.lit(f"{f}: "), quoted(F.col(f)))) for f in fields]
    df.orderBy(order).select(F.concat(F.lit("{ "), F.concat_ws(", ", *parts), F.lit(" },")).alias("value")).write.mode("overwrite").text(path)


def write_summary(df: DataFrame, path: str, key: str) -> None:
    """Counts by a key as JSON."""
    df.groupBy(key).count().orderBy(key).coalesce(1).write.mode("overwrite").json(path)


def json_bytes(df: DataFrame, column: Column) -> int:
    """Bytes that a text column would take, for sinks with a size budget."""
    return df.agg(F.coalesce(F.sum(F.octet_length(column) + 1), F.lit(0)).alias("n")).first().n
