"""Aggregations with explicit tie rules, roll-ups, robust centres and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import geo as G
from ..functions import text as T
from . import sphere as S
from ._shared import kept


def counts_by(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, counts: map of value to n)."""
    pairs = df.groupBy(key, value).count().groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(value).cast("string").alias("k"), "count"))).alias("p"))
    return pairs.select(key, F.map_from_entries("p").alias("counts"))


def mode(df: DataFrame, key: str, value: str, ties: str = "least", ordinal: str | None = None) -> DataFrame:
    """Most frequent value per key; ties go to the least or greatest value, or the first seen by ``ordinal``."""
    counted = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"), *([F.min(ordinal).alias("__first")] if ties == "first" else []))
    order = {"least": F.asc(value), "greatest": F.desc(value), "first": F.asc("__first")}[ties]
    first = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), order))
    return counted.withColumn("__n", first).where("__n = 1").select(key, value, "n")


def dominance_ladder(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, first, second, total, verdict) by the vote ladder."""
    counted = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("first"))
    order = Window.partitionBy(key).orderBy(F.desc("first"), value)
    ranked = counted.withColumn("second", F.coalesce(F.lead("first").over(order), F.lit(0))).withColumn("total", F.sum("first").over(Window.partitionBy(key))).withColumn("__n", F.row_number().over(order))
    return ranked.where("__n = 1").drop("__n").withColumn("verdict", C.dominance(F.col("first"), F.col("second"), F.col("total")))


def answer_sets(df: DataFrame, key: str, code: str) -> DataFrame:
    """(key, answers): the complete sorted set of codes of each key."""
    return df.groupBy(key).agg(F.array_sort(F.collect_set(code)).alias("answers"))


def dissolve_by_answers(sets: DataFrame, key: str, *measures: Column) -> DataFrame:
    """Keys with one complete answer set become one row; a set never merges with a larger one."""
    return sets.groupBy(T.array_id(F.col("answers")).alias("answer_id")).agg(F.count(F.lit(1)).alias("members"), F.min(key).alias("first_member"), *measures)


def prefix_rollup(df: DataFrame, code: str, levels: list[int], *measures: Column) -> DataFrame:
    """(level, prefix, measures) for every length of prefix, in one pass."""
    levelled = df.withColumn("level", F.explode(F.array(*[F.lit(n) for n in levels]))).withColumn("prefix", F.expr(f"substring({code}, 1, level)"))
    return levelled.groupBy("level", "prefix").agg(*measures)


def consistent_merge(df: DataFrame, key: str, metadata: list[str]) -> tuple[DataFrame, DataFrame]:
    """(key, metadata) of keys whose rows agree, and the keys that do not."""
    said = df.groupBy(key).agg(F.countDistinct(F.struct(*metadata)).alias("n"), *[F.min(c).alias(c) for c in metadata])
    return said.where("n = 1").drop("n"), said.where("n > 1").select(key, "n")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


#: Parts that a group's rows are dealt to before they meet the group's candidates.
_SALTS = 16
#: A total this much above another may still round to the same.
_SLACK_KM = 1e-5
#: How far off the first bounds of a mean distance may be.
_ERROR_KM = 1.0


def _places(points: DataFrame, group: str, id: str) -> DataFrame:
    """(group, lat, lon, n, id, pid): distinct places with their number of points, least id and own number; points without coordinates are left out."""
    return kept(points.where(F.col(group).isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull()).groupBy(group, "lat", "lon").agg(F.count(F.lit(1)).alias("n"), F.min(id).alias(id)).withColumn("pid", F.monotonically_increasing_id()))


def _least(bounds: DataFrame, group: str) -> DataFrame:
    """(group, pid) of those whose lower bound reaches their group's least upper one."""
    bounds = kept(bounds)
    least = bounds.groupBy(group).agg(F.min("high").alias("__least"))
    return kept(bounds.join(least, group).where(F.col("low") <= F.col("__least") * (1 + 1e-12) + _SLACK_KM).select(group, "pid"))


def medoid(points: DataFrame, group: str, id: str) -> DataFrame:
    """Per group the point with the least summed distance to the others, first by id on ties: (group, id, total_km).

    Points without coordinates are left out; equal points count once, with their number.  :func:`sphere.distance_sums` bounds each sum from both sides by cells; only points whose lower bound reaches the
    least upper one meet all places, first by unit vectors, and those that noise leaves open by :func:`geo.haversine_km`.
    """
    places = _places(points, group, id)
    nodes = S.tree(places, group)
    still = _least(S.distance_sums(nodes, group, _ERROR_KM), group)
    still = _least(S.place_sums(nodes, still, group), group)
    left = places.join(still, [group, "pid"], "left_semi").select(group, id, "lat", "lon").withColumn("__p", F.explode(F.array(*[F.lit(k) for k in range(_SALTS)])))
    other = places.select(group, F.pmod(F.col("pid"), F.lit(_SALTS)).cast("int").alias("__p"), "n", F.col("lat").alias("rlat"), F.col("lon").alias("rlon"))
    km = G.haversine_km(F.col("lat"), F.col("lon"), F.col("rlat"), F.col("rlon"))
    sums = left.join(other, [group, "__p"]).groupBy(group, id).agg(F.sum(km * F.col("n")).alias("total_km"))
    return sums.groupBy(group).agg(F.min(F.struct(F.round("total_km", 6).alias("t"), F.col(id).alias("i"), "total_km")).alias("b")).select(group, F.col("b.i").alias(id), F.col("b.total_km").alias("total_km"))


def core_median(points: DataFrame, group: str, id: str, share: float = 0.9, least: int = 3) -> DataFrame:
    """Median distance between pairs of the core: the nearest ``share`` of points (``least`` or more) to the medoid: (group, n_core, median_km)."""
    centre = medoid(points, group, id).select(group, F.col(id).alias("__m"))
    at = points.join(centre, group).where(F.col(id) == F.col("__m")).select(group, F.col("lat").alias("mlat"), F.col("lon").alias("mlon"))
    km = G.haversine_km(F.col("lat"), F.col("lon"), F.col("mlat"), F.col("mlon"))
    ranked = points.join(at, group).withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(F.round(km, 6), id))).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(group)))
    core = kept(ranked.where(F.col("__r") <= F.greatest(F.lit(least), F.ceil(F.col("__n") * share))).select(group, id, "lat", "lon"))
    return core.groupBy(group).agg(F.count(F.lit(1)).alias("n_core")).join(S.median_distances(_places(core, group, id), group), group, "left")


def max_error_km(core: DataFrame) -> DataFrame:
    """Rounded median, at least 1; 25 for a single point."""
    return core.withColumn("max_error_km", F.when(F.col("n_core") == 1, F.lit(25.0)).otherwise(F.greatest(F.lit(1.0), F.round("median_km"))))


def longitude_extent(points: DataFrame, group: str) -> DataFrame:
    """(group, west, east, width): the arc left when the widest empty one is taken away."""
    order = Window.partitionBy(group).orderBy("lon")
    distinct = points.select(group, "lon").distinct()
    lowest = F.min("lon").over(Window.partitionBy(group))
    gaps = distinct.withColumn("after", F.coalesce(F.lead("lon").over(order), lowest + 360.0)).withColumn("gap", F.col("after") - F.col("lon"))
    first = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(F.round("gap", 9)), "lon"))
    widest = gaps.withColumn("__n", first).where("__n = 1")
    return widest.select(group, G.normalise_longitude(F.col("after")).alias("west"), F.col("lon").alias("east"), (360.0 - F.col("gap")).alias("width"))


def percentiles(df: DataFrame, group: str, value: str, at: dict[str, float]) -> DataFrame:
    """Exact interpolated percentiles of the values that are not null, at place (n - 1) p.

    Values are counted and dealt to partitions by ranges of (group, value); sums by partition give the place of each value, so a group may be of any size.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.struct(group).alias("g"), F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    dealt = kept(counts.repartitionByRange("g", "v").withColumn("part", F.spark_partition_id()))
    ahead = Window.rowsBetween(Window.unboundedPreceding, -1)
    before = lambda by, order: F.coalesce(F.sum("n").over(ahead.partitionBy(*by).orderBy(order)), F.lit(0))
    sums = dealt.groupBy("g", "part").agg(F.sum("n").alias("n"))
    sums = sums.select("g", "part", before(["g"], "part").alias("off"), F.sum("n").over(Window.partitionBy("g")).alias("total"))
    placed = dealt.withColumn("own", before(["g", "part"], "v")).join(sums, ["g", "part"]).withColumn("from", F.col("off") + F.col("own"))
    found = []
    for name, p in at.items():
        place = (F.col("total") - 1) * F.lit(float(p))
        holds = lambda k: F.max(F.when((F.col("from") <= k) & (k < F.col("from") + F.col("n")), F.col("v").cast("double")))
        found += [holds(F.floor(place)).alias(f"{name} low"), holds(F.ceil(place)).alias(f"{name} high"), F.max(place - F.floor(place)).alias(f"{name} rest")]
    part = lambda name: F.when(F.col(f"{name} low") == F.col(f"{name} high"), F.col(f"{name} low")).otherwise((1 - F.col(f"{name} rest")) * F.col(f"{name} low") + F.col(f"{name} rest") * F.col(f"{name} high"))
    done = placed.groupBy("g").agg(*found).select("g", *[part(name).alias(name) for name in at])
    return df.select(F.struct(group).alias("g")).distinct().join(done, "g", "left").select(f"g.{group}", *at)


def profile(df: DataFrame, samples: int = 5) -> DataFrame:
    """(column, rows, missing, distinct, samples) of every column: counts by value, and the least values, of which each task sends on ``samples`` at most."""
    cast = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
    long = cast.unpivot([], list(df.columns), "column", "value")
    by_value = kept(long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))
    blank = F.col("value").isNull() | (F.trim("value") == "")
    counts = by_value.groupBy("column").agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(blank, F.col("n"))), F.lit(0)).alias("missing"), F.count("value").alias("distinct"))
    rank = F.row_number().over(Window.partitionBy("column").orderBy("value"))
    least = by_value.where("value IS NOT NULL").withColumn("r", rank).where(F.col("r") <= samples).groupBy("column").agg(F.array_sort(F.collect_list("value")).alias("samples"))
    return counts.join(least, "column", "left").withColumn("samples", F.coalesce("samples", F.array().cast("array<string>")))


def accuracy(df: DataFrame, keys: list[str], actual: str, predicted: str) -> DataFrame:
    """(keys, n, hits, accuracy); rows without a prediction count as misses."""
    hit = F.coalesce((F.col(actual) == F.col(predicted)).cast("int"), F.lit(0))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(hit).alias("hits"), F.avg(hit.cast("double")).alias("accuracy"))


def pixel_votes(pixels: DataFrame, unit: str, code: str, units: DataFrame | None = None) -> DataFrame:
    """(unit, code, winner, runner_up, samples, status) from one row per pixel; pixels without a code do not vote.

    With ``units`` each of them has a row: NO_PIXELS where it has no pixel at all, which is not UNCLASSIFIED, where none of its pixels has a code.
    """
    counted = pixels.where(F.col(code).isNotNull()).groupBy(unit, code).agg(F.count(F.lit(1)).alias("n"))
    order, by = Window.partitionBy(unit).orderBy(F.desc("n"), code), Window.partitionBy(unit)
    ranked = counted.withColumn("samples", F.sum("n").over(by)).withColumn("next", F.coalesce(F.lead("n").over(order), F.lit(0))).withColumn("__r", F.row_number().over(order)).where("__r = 1")
    every = pixels.select(unit).distinct().join(ranked, unit, "left").withColumn("samples", F.coalesce("samples", F.lit(0)))
    share = lambda c: F.when(F.col("samples") > 0, F.col(c) / F.col("samples")).otherwise(F.lit(0.0))
    out = every.select(unit, code, share("n").alias("winner"), share("next").alias("runner_up"), "samples")
    voted = out.withColumn("status", C.vote_status(F.col("winner"), F.col("samples")))
    if units is None:
        return voted
    every = units.select(unit).distinct().join(voted, unit, "left")
    return every.fillna(0, ["winner", "runner_up", "samples"]).withColumn("status", F.coalesce("status", F.lit("NO_PIXELS")))
