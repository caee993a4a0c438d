"""The list of towns of each country: graded matches in two tiers, one candidate for each place, a limit, and the capital in any case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import spatial as S
from ._shared import kept


def town_list(candidates: DataFrame, places: DataFrame, country: str, limit: int = 300) -> DataFrame:
    """(country, rank, id, place_id, tier, grade, km, population) of each country's towns.

    ``candidates`` and ``places`` as for :func:`spatial.graded_match`, both with ``country``; candidates with ``capital``, places with ``primary``. Tier 0 are matches with primary places;
    only a candidate without one may match another place (tier 1). Each place takes its best candidate. Tiers are filled in order, by population (descending) and id, to the limit; the
    first capital that matched anything, if it is not among them, takes the last place or one more.
    """
    group = {country: f"__{country}"}
    there = places.withColumnsRenamed(group)
    first = kept(S.graded_match(candidates, there.where("primary"), country, f"__{country}").withColumn("tier", F.lit(0)))
    rest = candidates.join(first.select("id"), "id", "left_anti")
    second = S.graded_match(rest, there.where("NOT primary"), country, f"__{country}").withColumn("tier", F.lit(1))
    matched = kept(first.unionByName(second))
    order = [F.asc("tier"), F.desc("population"), F.asc("id")]
    by = Window.partitionBy(country).orderBy(*order)
    single = S.dedupe_matches(matched)  # a place is of one tier
    chosen = kept(single.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit))
    capital = matched.where("capital").withColumn("k", F.row_number().over(by)).where("k = 1").drop("k")
    forced = capital.join(chosen.select(country, "id"), [country, "id"], "left_anti")
    size = chosen.groupBy(country).agg(F.count(F.lit(1)).alias("size"))
    forced = kept(forced.join(size, country, "left").withColumn("rank", F.least(F.coalesce("size", F.lit(0)) + 1, F.lit(limit)).cast("int")).drop("size"))
    out = chosen.join(forced.select(country, F.col("rank").alias("taken")), country, "left").where("taken IS NULL OR rank < taken").drop("taken").unionByName(forced)
    return out.select(country, "rank", "id", "place_id", "tier", "grade", "km", "population")


def town_names(native: Column, english: Column) -> list[Column]:
    """``name`` and ``native_name`` to show: one preferred spelling where both are equal by key, else the English name over the native one; a blank native name is none."""
    own, other = F.trim(native), F.trim(english)
    has = F.coalesce(own, F.lit("")) != ""
    same = has & F.coalesce(T.same_name(own, other), F.lit(False))
    return [F.when(same, T.preferred_spelling(own, other)).otherwise(other).alias("name"), F.when(has & ~same, own).alias("native_name")]
