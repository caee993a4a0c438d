"""Families of colours: the frequent ones lead, and colours near a leader follow it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph

#: Greatest distance to a leader, and the fewest pixels of a colour that counts (fixed values).
TOLERANCE, LEAST = 18.0, 20


def colour_families(colours: DataFrame, tolerance: float = TOLERANCE, least: int = LEAST) -> DataFrame:
    """(r, g, b, n, lr, lg, lb) of each colour (r, g, b from 0 to 255, n pixels) that ``least`` pixels have, with its leader.

    In order of pixels, ties by red, green and blue, a colour follows the nearest leader before it within ``tolerance`` (ties: the first), or leads. Leaders are the greedy
    independent set of that order. Colours meet in cells as wide as the tolerance, so one meets 27 cells at most, whatever the number of pixels; rows
    without a channel are left out.
    """
    counted = colours.where("r IS NOT NULL AND g IS NOT NULL AND b IS NOT NULL").groupBy(*[F.col(c).cast("long").alias(c) for c in ("r", "g", "b")]).agg(F.sum("n").cast("long").alias("n")).where(F.col("n") >= least)
    rank = F.struct((-F.col("n")).alias("n"), "r", "g", "b")
    counted = counted.withColumn("id", F.col("r") * 65536 + F.col("g") * 256 + F.col("b"))
    size = max(1, int(tolerance))
    cell = lambda c: F.floor(F.col(c) / F.lit(float(size + 1)))
    a = counted.select(F.col("id").alias("src"), rank.alias("p1"), *[F.col(c).alias(f"{c}1") for c in "rgb"], *[cell(c).alias(f"_{c}") for c in "rgb"])
    for c in "rgb":
        a = a.withColumn(f"_{c}", F.explode(F.sequence(F.col(f"_{c}") - 1, F.col(f"_{c}") + 1)))
    b = counted.select(F.col("id").alias("dst"), rank.alias("p2"), *[F.col(c).alias(f"{c}2") for c in "rgb"], *[cell(c).alias(f"_{c}") for c in "rgb"])
    gap = sum(((F.col(f"{c}1") - F.col(f"{c}2")) * (F.col(f"{c}1") - F.col(f"{c}2")) for c in "gb"), (F.col("r1") - F.col("r2")) * (F.col("r1") - F.col("r2")))
    pairs = a.join(b, ["_r", "_g", "_b"]).withColumn("gap", gap).where((F.col("src") != F.col("dst")) & (F.col("gap") <= tolerance * tolerance))
    leaders = graph.greedy_independent(counted.select("id", rank.alias("rank")), pairs.select("src", "dst"))
    led = pairs.where("p2 < p1").join(leaders.select(F.col("id").alias("dst")), "dst", "left_semi").join(leaders.select(F.col("id").alias("src")), "src", "left_anti")
    led = led.groupBy("src").agg(F.min(F.struct("gap", "p2")).alias("best")).select(F.col("src").alias("id"), "best.p2")
    leader = F.coalesce("p2", rank)
    return counted.join(led, "id", "left").select("r", "g", "b", "n", *[leader[c].alias(f"l{c}") for c in "rgb"])


def family_sizes(families: DataFrame) -> DataFrame:
    """(lr, lg, lb, colours, n): members and pixels of each family."""
    return families.groupBy("lr", "lg", "lb").agg(F.count(F.lit(1)).alias("colours"), F.sum("n").alias("n"))
