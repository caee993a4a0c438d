"""Checks that raise: each returns its input so that it can stand in a chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class CheckFailed(ValueError):
    """Data that a check refused; the message has some of the rows."""


def _none(bad: DataFrame, what: str) -> None:
    rows = bad.limit(10).collect()
    if rows:
        raise CheckFailed(f"{what}: {[r.asDict() for r in rows]}")


def exact_count(df: DataFrame, n: int) -> DataFrame:
    if (found := df.count()) != n:
        raise CheckFailed(f"expected {n} rows, found {found}")
    return df


def required(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns exist, and their values are neither null nor blank."""
    if missing := set(columns) - set(df.columns):
        raise CheckFailed(f"missing columns: {sorted(missing)}")
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    _none(df.where(bad), f"empty values in {columns}")
    return df


def unique(df: DataFrame, keys: list[str]) -> DataFrame:
    _none(df.groupBy(*keys).count().where("count > 1"), f"keys of {keys} more than once")
    return df


def parents_exist(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    _none(child.join(parent.select(key), key, "left_anti").select(key).distinct(), f"no parent by {key}")
    return child


def total_partition(rows: DataFrame, groups: DataFrame, id: str) -> DataFrame:
    """Every row is in exactly one group, and groups have no other members."""
    n = groups.groupBy(id).agg(F.count(F.lit(1)).alias("n"))
    _none(rows.select(id).distinct().withColumn("here", F.lit(True)).join(n, id, "full").where("here IS NULL OR n IS NULL OR n <> 1"), "not in exactly one group")
    return groups


def same_rows(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """The columns are the same multiset of rows before and after."""
    a, b = before.select(*columns), after.select(*columns)
    _none(a.exceptAll(b).withColumn("side", F.lit("before")).unionByName(b.exceptAll(a).withColumn("side", F.lit("after"))), f"{columns} differ")
    return after


def bounded(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    _none(df.where(~F.col(column).between(low, high) | F.isnan(F.col(column).cast("double"))), f"{column} outside [{low}, {high}]")
    return df
