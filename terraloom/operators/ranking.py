"""Ranks, caps, labels and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_by(df: DataFrame, group: str, order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def cap_with_forced(df: DataFrame, group: str, order: list[Column], n: int, forced: Column) -> DataFrame:
    """The top n per group; if the first forced row is not among them it takes the last place."""
    by = Window.partitionBy(group)
    ranked = rank_by(df, group, order, "rank").withColumn("__f", F.min(F.when(forced, F.col("rank"))).over(by))
    keep = F.when(F.col("__f") > n, (F.col("rank") < n) | (F.col("rank") == F.col("__f"))).otherwise(F.col("rank") <= n)
    return ranked.where(keep).withColumn("rank", F.least("rank", F.lit(n))).drop("__f")


def suffix_ids(df: DataFrame, base: str, order: list[Column], name: str = "id") -> DataFrame:
    """``x``, ``x-2``, ``x-3`` for rows that share a base."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(*order))
    return df.withColumn(name, F.when(n == 1, F.col(base)).otherwise(F.concat_ws("-", F.col(base), n.cast("string"))))


def disambiguate(df: DataFrame, label: str, parents: list[str], name: str = "display") -> DataFrame:
    """The label alone where it is unique, else with the fewest parents that make it so, and with all of them if none do."""
    out = df
    options, unique = [F.col(label)], []
    for p in parents:
        options.append(F.concat(options[-1], F.lit(", "), F.col(p)))
    for k, o in enumerate(options):
        out = out.withColumn(f"__o{k}", o)
        unique.append(F.count(F.lit(1)).over(Window.partitionBy(f"__o{k}")))
    pick = F.col(f"__o{len(options) - 1}")
    for k in range(len(options) - 2, -1, -1):
        pick = F.when(unique[k] == 1, F.col(f"__o{k}")).otherwise(pick)
    return out.withColumn(name, pick).drop(*[f"__o{k}" for k in range(len(options))])


def top_margin(df: DataFrame, group: str, score: str, id: str) -> DataFrame:
    """Best row per group with the runner-up's score and the margin between them."""
    order = Window.partitionBy(group).orderBy(F.desc(score), id)
    ranked = df.withColumn("second", F.lead(score).over(order)).withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
    return ranked.withColumn("margin", F.col(score) - F.coalesce("second", F.lit(0.0)))


def even_sample(df: DataFrame, group: str, order: list[Column], most: int) -> DataFrame:
    """At most ``most`` rows per group, at places floor(i n / most)."""
    by = Window.partitionBy(group)
    placed = df.withColumn("__i", F.row_number().over(by.orderBy(*order)) - 1).withColumn("__n", F.count(F.lit(1)).over(by))
    # Place p is taken if some i has floor(i n / most) = p, i being ceil(p most / n).
    i = F.ceil(F.col("__i") * most / F.col("__n"))
    return placed.where((F.col("__n") <= most) | ((i < most) & (F.floor(i * F.col("__n") / most) == F.col("__i")))).drop("__i", "__n")


def presets(n: Column, sizes: tuple[int, ...] = (10, 25, 50, 100)) -> Column:
    return F.filter(F.array(*[F.lit(s) for s in sizes]), lambda s: s <= n)


def numeric_first(code: Column) -> list[Column]:
    """Sort keys: numbers by value, before other labels by name."""
    return [F.when(code.rlike(r"^\d+$"), 0).otherwise(1), F.length(F.when(code.rlike(r"^\d+$"), code)), code]


def shuffled(df: DataFrame, id: str, seed: int) -> DataFrame:
    """A permutation that a seed fixes at any partitioning; ``ordinal`` sorts by it."""
    return df.withColumn("ordinal", F.xxhash64(F.lit(seed), F.col(id).cast("string")))


def regions_by_place(df: DataFrame, group: str, prefix: str = "region") -> DataFrame:
    """(group, region_id): numbered from north to south, then west to east, by mean position. Groups are few by nature (regions of one map)."""
    centre = df.groupBy(group).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    n = F.row_number().over(Window.orderBy(F.desc(F.round("lat", 6)), F.round("lon", 6), group))
    return centre.select(group, F.format_string(prefix + "-%d", n).alias("region_id"))
