"""Names resolved against a register in stages, each on what is still open.

``left``: id, scope, hint (area, or null), name; ``right``: right_id, scope, area, priority, name.  Stages in order:

* ``unresolved``: listed to stay open; ``manual``: set by hand; ``group``: a name that stands for several rows.
* ``exact``, ``loose``, ``core``, ``compact``, ``skeleton``, ``significant``: equal forms of the name.  Candidates of the hinted area come first; of several
  the one with the highest priority is taken if it is the only one, first in the area, then in the scope.
* ``containment``: the significant words of one are among those of the other, two or more, or one of six letters with at most one
  beside it; the only candidate of the hinted area, or where that has none, of the scope.
* ``typo``: one edit away, both six letters or more, nothing else (of about the same length) within two edits.
* ``fuzzy``: best score of the hinted area, then of the scope, by gates of score and lead that depend on the priority.

Names that both hold numbers, and different ones, never match from ``containment`` on.  Rows of the register are counted by form before they are
joined, so a frequent name costs one row.  Null and empty names stay open, as does what no stage resolves; ids must be unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import similar
from ._shared import kept

FORMS = ("exact", "loose", "core", "compact", "skeleton", "significant")
#: Least score and least lead over the second, for priority 2 and 3, and for 1.
GATES = {True: ((0.94, 0.05), (0.90, 0.12), (0.86, 0.20)), False: ((0.96, 0.08), (0.92, 0.16))}
#: A second candidate below the least score less the widest lead decides nothing.
_LEAST = 0.86 - 0.20


def _with_forms(df: DataFrame, stop: list[str], generic: list[str]) -> DataFrame:
    forms = {"exact": F.lower(F.trim("name"))} | T.token_forms(F.col("name"), stop, generic)
    numbers = F.array_join(F.array_sort(F.filter(T.tokens(F.col("name")), lambda t: t.rlike(r"^\d+$"))), " ")
    return df.withColumns({f"f_{k}": F.coalesce(forms[k], F.lit("")) for k in FORMS}).withColumn("numbers", F.coalesce(numbers, F.lit("")))


def _agree(a: Column, b: Column) -> Column:
    """Number words do not conflict."""
    return (a == "") | (b == "") | (a == b)


def _by_form(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, right_id, stage) by equal forms."""
    forms = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"f_{f}").alias("key")) for k, f in enumerate(FORMS)])).alias("f")
    theirs = right.select("scope", "area", "priority", "right_id", forms).select("scope", "area", "priority", "right_id", "f.*").where("key <> ''")
    counted = theirs.groupBy("scope", "k", "key", "area", "priority").agg(F.count(F.lit(1)).alias("n"), F.min("right_id").alias("rid"))
    best = lambda df, keys: df.groupBy(*keys).agg(F.max(F.struct("priority", "n", "rid")).alias("b")).where("b.n = 1").select(*keys, "b.rid")
    inside = best(counted.where("area IS NOT NULL"), ["scope", "k", "key", "area"]).withColumnsRenamed({"area": "hint", "rid": "near"})
    whole = counted.groupBy("scope", "k", "key", "priority").agg(F.sum("n").alias("n"), F.min("rid").alias("rid"))
    mine = left.select("id", "scope", "hint", forms).select("id", "scope", "hint", "f.*").where("key <> ''")
    met = mine.join(best(whole, ["scope", "k", "key"]), ["scope", "k", "key"], "left").join(inside, ["scope", "k", "key", "hint"], "left")
    first = met.withColumn("right_id", F.coalesce("near", "rid")).where("right_id IS NOT NULL").groupBy("id").agg(F.min(F.struct("k", "right_id")).alias("b"))
    return first.select("id", "b.right_id", F.element_at(F.array(*[F.lit(f) for f in FORMS]), F.col("b.k") + 1).alias("stage"))


def _by_words(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, right_id, stage) by contained words; sets meet in the rarest word of the smaller."""
    theirs = right.where("f_significant <> ''").groupBy("scope", "area", F.col("f_significant").alias("words"), "numbers").agg(F.count(F.lit(1)).alias("n"), F.min("right_id").alias("rid"))
    sets = theirs.select("scope", "words").distinct().withColumn("w", F.split("words", " "))
    word = sets.withColumn("t", F.explode("w"))
    freq = word.groupBy("scope", "t").agg(F.count(F.lit(1)).alias("c"))
    mine = left.where("f_significant <> ''").select("scope", F.col("f_significant").alias("said")).distinct().withColumn("s", F.split("said", " "))
    rarest = lambda df, keys: df.join(freq, ["scope", "t"], "left").groupBy(*keys).agg(F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "t")).alias("m")).select(*keys, F.col("m.t").alias("t"))
    said = mine.withColumn("t", F.explode("s"))
    up = rarest(said, ["scope", "said", "s"]).join(word, ["scope", "t"])
    down = said.join(rarest(word, ["scope", "words", "w"]), ["scope", "t"])
    both = up.select("scope", "said", "s", "words", "w").unionByName(down.select("scope", "said", "s", "words", "w")).distinct()
    less, more = F.least(F.size("s"), F.size("w")), F.greatest(F.size("s"), F.size("w"))
    inside = F.size(F.array_intersect("s", "w")) == less
    strong = (less >= 2) | (less == more) | ((F.length(F.when(F.size("s") <= F.size("w"), F.col("said")).otherwise(F.col("words"))) >= 6) & (more <= 2))
    pairs = both.where(inside & strong).select("scope", "said", "words").join(theirs.withColumnRenamed("numbers", "rnumbers"), ["scope", "words"])
    asked = left.select("id", "scope", "hint", "numbers", F.col("f_significant").alias("said"))
    met = asked.join(pairs, ["scope", "said"]).where(_agree(F.col("numbers"), F.col("rnumbers")))
    near = F.col("hint").isNotNull() & (F.col("hint") == F.col("area"))
    sums = met.groupBy("id").agg(F.sum(F.when(near, F.col("n"))).alias("near"), F.min(F.when(near, F.col("rid"))).alias("near_id"), F.sum("n").alias("n"), F.min("rid").alias("rid"))
    return sums.where(F.coalesce("near", "n") == 1).select("id", F.when(F.col("near").isNotNull(), F.col("near_id")).otherwise(F.col("rid")).alias("right_id"), F.lit("containment").alias("stage"))


def _by_typo(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, right_id, stage) by one edit."""
    mine, theirs = left.where("length(f_compact) >= 6"), right.where("length(f_compact) >= 6")
    near = similar.within_two_edits(mine.withColumnRenamed("f_compact", "a"), theirs.withColumnRenamed("f_compact", "b"), ["scope"], "a", "b")
    counted = theirs.groupBy("scope", F.col("f_compact").alias("b"), F.col("numbers").alias("rnumbers")).agg(F.count(F.lit(1)).alias("n"), F.min("right_id").alias("rid"))
    met = mine.select("id", "scope", "numbers", F.col("f_compact").alias("a")).join(near, ["scope", "a"]).join(counted, ["scope", "b"]).where(_agree(F.col("numbers"), F.col("rnumbers")))
    sums = met.groupBy("id").agg(F.sum("n").alias("n"), F.min(F.when(F.col("edits") == 1, F.col("rid"))).alias("right_id"))
    return sums.where("n = 1 AND right_id IS NOT NULL").select("id", "right_id", F.lit("typo").alias("stage"))


def _by_score(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, right_id, stage) by the best score and its lead. The score is 0.9 of the best ratio of a form and 0.1 of the words in common."""
    used = [f for f in FORMS if f != "significant"]
    form = F.explode(F.array(*[F.struct(F.lit(f).alias("form"), F.col(f"f_{f}").alias("key")) for f in used])).alias("f")
    mine = left.select("id", "scope", "hint", "numbers", "f_loose", form).select("id", "scope", "hint", "numbers", "f_loose", "f.form", F.col("f.key").alias("a"))
    theirs = right.select("right_id", "scope", "area", "priority", F.col("numbers").alias("rnumbers"), F.col("f_loose").alias("r_loose"), form)
    theirs = theirs.select("right_id", "scope", "area", "priority", "rnumbers", "r_loose", "f.form", F.col("f.key").alias("b"))
    ratios = similar.ratio_pairs(mine, theirs, ["scope", "form"], "a", "b", round((_LEAST - 0.1) / 0.9, 6))
    met = mine.join(ratios, ["scope", "form", "a"]).join(theirs, ["scope", "form", "b"]).where(_agree(F.col("numbers"), F.col("rnumbers")))
    best = met.groupBy("id", "right_id").agg(F.max("ratio").alias("ratio"), *[F.first(c).alias(c) for c in ("hint", "area", "priority", "f_loose", "r_loose")])
    scored = best.withColumn("score", 0.9 * F.col("ratio") + 0.1 * T.token_jaccard(F.col("f_loose"), F.col("r_loose"))).where(F.col("score") >= _LEAST)
    near = F.col("hint").isNotNull() & (F.col("hint") == F.col("area"))
    rows = scored.withColumn("wide", F.explode(F.when(near, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))))
    order = Window.partitionBy("id", "wide").orderBy(F.desc("score"), "right_id")
    led = rows.withColumn("lead", F.col("score") - F.coalesce(F.lead("score").over(order), F.lit(0.0))).withColumn("k", F.row_number().over(order)).where("k = 1")
    passes = F.lit(False)
    for high, gates in GATES.items():
        for least, lead in gates:
            passes = passes | (((F.col("priority") >= 2) == F.lit(high)) & (F.col("score") >= least) & (F.col("lead") >= lead))
    return led.where(passes).groupBy("id").agg(F.min(F.struct("wide", "right_id")).alias("b")).select("id", "b.right_id", F.lit("fuzzy").alias("stage"))


def resolve(left: DataFrame, right: DataFrame, unresolved: DataFrame | None = None, manual: DataFrame | None = None, groups: DataFrame | None = None, stop: list[str] = (), generic: list[str] = (), fuzzy: bool = True) -> DataFrame:
    """(id, right_id, stage) of every left row; a group gives a row for each of its members, open rows have two nulls.

    ``unresolved``: id; ``manual``: id, right_id; ``groups``: scope, name, right_id.
    """
    mine, theirs = _with_forms(left.select("id", "scope", "hint", "name"), list(stop), list(generic)), _with_forms(right.select("right_id", "scope", "area", "priority", "name"), list(stop), list(generic))
    target = right.schema["right_id"].dataType
    stages = []
    if unresolved is not None:
        stages.append(lambda o: o.join(unresolved.select("id").distinct(), "id", "left_semi").select("id", F.lit(None).cast(target).alias("right_id"), F.lit("unresolved").alias("stage")))
    if manual is not None:
        stages.append(lambda o: o.select("id").join(manual.select("id", "right_id"), "id").withColumn("stage", F.lit("manual")))
    if groups is not None:
        keyed = groups.select("scope", T.ascii_key(F.col("name")).alias("f_loose"), "right_id").distinct()
        stages.append(lambda o: o.select("id", "scope", "f_loose").where("f_loose <> ''").join(keyed, ["scope", "f_loose"]).select("id", "right_id", F.lit("group").alias("stage")))
    stages += [lambda o: _by_form(o, theirs), lambda o: _by_words(o, theirs), lambda o: _by_typo(o, theirs)]
    if fuzzy:
        stages.append(lambda o: _by_score(o, theirs))
    still, done = mine, None
    for stage in stages:
        hits = kept(stage(still))
        still = still.join(hits.select("id").distinct(), "id", "left_anti")
        done = hits if done is None else done.unionByName(hits)
    return done.unionByName(still.select("id", F.lit(None).cast(target).alias("right_id"), F.lit(None).cast("string").alias("stage")))
