"""Similar names without comparing all pairs of a scope.

The gestalt ratio of two keys is twice the matched characters over all characters, so it is at most twice the characters that they
have in common, counted with repeats, over all.  Keys become sets of numbered characters (``a1``, ``a2``, ``l1``); a pair with a ratio of at least a
floor shares one of the rarest of the left key, few of which need to be looked up when the floor is high.  The exact bound is
then taken in the JVM, and only what passes it is compared in Python.  The lower the floor, the less this prunes; at 0 it is
every pair with a character in common.

Equal keys of a scope are compared once, whatever number of rows has them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ._shared import kept

#: Floors that ``top_similar`` tries in turn; a row is done at the first at which it has enough names.
FLOORS = (0.8, 0.6, 0.4, 0.0)


def _numbered(key: str) -> Column:
    """Each character with the number of its occurrence."""
    return F.expr(
        f"transform(sequence(1, length({key})), i -> concat(substring({key}, i, 1), cast(length(substring({key}, 1, i)) - length(replace(substring({key}, 1, i), substring({key}, i, 1), '')) as string)))"
    )


def _keys(df: DataFrame, scope: list[str], key: str) -> DataFrame:
    return df.select(*scope, key).where(F.col(key) != "").distinct()


def ratio_pairs(left: DataFrame, right: DataFrame, scope: list[str], a: str, b: str, floor: float) -> DataFrame:
    """(scope, a, b, ratio) of the distinct keys of one scope whose ratio is at least ``floor`` and above 0; null and empty keys have no pairs."""
    la, lb, share = F.length(a), F.length(b), floor / (2.0 - floor)
    mine = _keys(left, scope, a).withColumn("__ta", _numbered(a))
    other = _keys(right, scope, b).withColumn("__tb", _numbered(b))
    index = other.withColumn("__t", F.explode("__tb"))
    rare = index.groupBy(*scope, "__t").agg(F.count(F.lit(1)).alias("__n"))
    each = mine.withColumn("__t", F.explode("__ta")).join(rare, [*scope, "__t"], "left")
    looked = each.groupBy(*scope, a).agg(F.first("__ta").alias("__ta"), F.array_sort(F.collect_list(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), "__t"))).alias("__p"))
    need = F.greatest(F.lit(1), F.ceil(la * share - 1e-9))
    looked = looked.select(*scope, a, "__ta", F.explode(F.slice("__p", F.lit(1), (la - need + 1).cast("int"))).alias("p")).select(*scope, a, "__ta", F.col("p.__t").alias("__t"))
    met = looked.join(index, [*scope, "__t"]).where((lb >= la * share - 1e-9) & (la >= lb * share - 1e-9))
    bound = 2.0 * F.size(F.array_intersect("__ta", "__tb")) / (la + lb)
    near = met.where(bound >= floor - 1e-9).select(*scope, a, b).distinct()
    return near.withColumn("ratio", T.match_ratio(F.col(a), F.col(b))).where((F.col("ratio") >= floor) & (F.col("ratio") > 0))


def top_similar(left: DataFrame, right: DataFrame, scope: list[str], left_id: str, left_name: str, right_name: str, n: int = 5) -> DataFrame:
    """The n rows of ``right`` of the same scope whose names are most similar, ties by name, with ``ratio`` and ``rank``; names without a character in common are not offered."""
    mine = left.withColumn("__a", T.ascii_key(F.col(left_name)))
    order = Window.partitionBy(*scope, "__b").orderBy(*[F.col(c).asc_nulls_last() for c in (right_name, *[c for c in right.columns if c != right_name and c not in scope])])
    theirs = kept(right.withColumn("__b", T.ascii_key(F.col(right_name))).withColumn("__copy", F.row_number().over(order)).where(F.col("__copy") <= n))
    copies = theirs.groupBy(*scope, "__b").agg(F.count(F.lit(1)).alias("__n"))
    open_keys, found = kept(_keys(mine, scope, "__a")), []
    for floor in FLOORS:
        pairs = kept(ratio_pairs(open_keys, copies, scope, "__a", "__b", floor).join(copies, [*scope, "__b"]))
        full = pairs.groupBy(*scope, "__a").agg(F.sum("__n").alias("__n")).where((F.col("__n") >= n) | F.lit(floor == FLOORS[-1])).select(*scope, "__a")
        found.append(pairs.join(full, [*scope, "__a"], "left_semi").drop("__n"))
        if floor != FLOORS[-1]:
            open_keys = kept(open_keys.join(full, [*scope, "__a"], "left_anti"))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    best = Window.partitionBy(*scope, "__a").orderBy(F.desc("ratio"), right_name, "__copy")
    ranked = pairs.join(theirs, [*scope, "__b"]).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)
    return mine.join(ranked, [*scope, "__a"]).drop("__a", "__b", "__copy").select(*left.columns, *[c for c in right.columns if c not in scope], "ratio", "rank")


def within_two_edits(left: DataFrame, right: DataFrame, scope: list[str], a: str, b: str, reach: int = 1) -> DataFrame:
    """(scope, a, b, edits) of distinct keys with at most two edits between them and lengths at most ``reach`` apart.

    A right key is cut in three; two edits leave one third whole, so a left key looks up its pieces at places moved by two at most.
    """
    cut = f"transform(array(0, 1, 2), i -> struct(i as i, substring({b}, 1 + cast(floor(i * length({b}) / 3) as int), cast(floor((i + 1) * length({b}) / 3) as int) - cast(floor(i * length({b}) / 3) as int)) as s))"
    theirs = _keys(right, scope, b).withColumn("p", F.explode(F.expr(cut))).select(*scope, b, F.length(b).alias("__l"), "p.*")
    lengths = F.sequence(F.greatest(F.length(a) - reach, F.lit(1)), F.length(a) + reach)
    mine = _keys(left, scope, a).withColumn("__l", F.explode(lengths)).withColumn("i", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    mine = mine.withColumn("__s", F.expr("cast(floor(i * __l / 3) as int)")).withColumn("__w", F.expr("cast(floor((i + 1) * __l / 3) as int)") - F.col("__s"))
    mine = mine.withColumn("__d", F.explode(F.array(*[F.lit(d) for d in range(-2, 3)]))).where("__s + __d >= 0").withColumn("s", F.expr(f"substring({a}, 1 + __s + __d, __w)")).where("length(s) = __w")
    met = mine.select(*scope, a, "__l", "i", "s").distinct().join(theirs, [*scope, "__l", "i", "s"]).select(*scope, a, b).distinct()
    return met.withColumn("edits", F.levenshtein(a, b, 2)).where("edits >= 0")
