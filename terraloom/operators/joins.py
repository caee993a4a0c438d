"""Joins by key: lookups with reports, exactly-one matches, crosswalks, coverage and cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import similar


class DuplicateKey(ValueError):
    """A side that must be unique has a key twice."""


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` itself; raises with some of the keys that occur more than once."""
    twice = df.groupBy(*keys).count().where("count > 1").limit(20).collect()
    if twice:
        raise DuplicateKey(f"duplicate {keys}: {[tuple(r[k] for k in keys) for r in twice]}")
    return df


def lookup(left: DataFrame, dim: DataFrame, keys: list[str], check: bool = True) -> tuple[DataFrame, DataFrame]:
    """Left join to a unique dimension, and the distinct keys that found nothing. Spark broadcasts a small dimension by its size."""
    if check:
        require_unique(dim, keys)
    return left.join(dim, keys, "left"), left.select(*keys).distinct().join(dim.select(*keys), keys, "left_anti")


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of two sides that both must be unique."""
    return require_unique(left, keys).join(require_unique(right, keys), keys, "left")


def exactly_one(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id) where a key has one row on either side; keys are counted before they are joined."""
    single = lambda df, id: df.select(*keys, id).distinct().groupBy(*keys).agg(F.min(id).alias(id), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    return single(left, left_id).join(single(right, right_id), keys).select(left_id, right_id)


def crosswalk(left: DataFrame, right: DataFrame, scope: list[str], left_name: str, right_name: str) -> DataFrame:
    """Join by normalised name inside a parent scope; names that are ambiguous on the right match nothing."""
    key = "__key"
    unique = right.withColumn(key, T.name_key(F.col(right_name)))
    single = unique.groupBy(*scope, key).count().where("count = 1").drop("count")
    return left.withColumn(key, T.name_key(F.col(left_name))).join(unique.join(single, [*scope, key], "left_semi"), [*scope, key], "left").drop(key)


def coverage(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of both sides with ``side``: both, left or right."""
    a, b = left.select(*keys).distinct().withColumn("__l", F.lit(1)), right.select(*keys).distinct().withColumn("__r", F.lit(1))
    return a.join(b, keys, "full").select(*keys, F.when(F.col("__l").isNull(), "right").when(F.col("__r").isNull(), "left").otherwise("both").alias("side"))


def override(auto: DataFrame, manual: DataFrame, keys: list[str], value: str, forced_unresolved: DataFrame | None = None) -> DataFrame:
    """Manual values before automatic ones; keys that are forced to stay unresolved get null."""
    out = auto.join(manual.select(*keys, F.col(value).alias("__manual")), keys, "left").withColumn(value, F.coalesce("__manual", value)).drop("__manual")
    if forced_unresolved is not None:
        out = out.join(forced_unresolved.select(*keys).distinct().withColumn("__off", F.lit(True)), keys, "left").withColumn(value, F.when(F.col("__off").isNull(), F.col(value))).drop("__off")
    return out


def by_code_prefix(child: DataFrame, parent: DataFrame, child_code: str, parent_code: str, length: int) -> DataFrame:
    """Each child with the parent whose code is the start of its own."""
    return child.withColumn("__p", F.substring(child_code, 1, length)).join(parent.withColumnRenamed(parent_code, "__p"), "__p", "left").withColumnRenamed("__p", parent_code)


def parent_compatible(left: DataFrame, right: DataFrame, name: str, parents: list[str]) -> DataFrame:
    """Equal names and, for each parent level, equal values where both sides have one. Columns of the right get the suffix _r."""
    other = right.toDF(*[c if c == name else f"{c}_r" for c in right.columns])
    same = F.lit(True)
    for p in parents:
        same = same & (F.col(p).isNull() | F.col(f"{p}_r").isNull() | (F.col(p) == F.col(f"{p}_r")))
    return left.join(other, name).where(same)


def any_candidate(left: DataFrame, right: DataFrame, candidates: Column, key: str, left_id: str) -> DataFrame:
    """Left rows of which one of several plausible keys exists on the right."""
    hits = left.select(left_id, F.explode(candidates).alias(key)).join(right.select(key).distinct(), key, "left_semi").select(left_id).distinct()
    return left.join(hits, left_id, "left_semi")


def mixed_granularity(parents: DataFrame, children: DataFrame, exceptions: DataFrame, parent_id: str, value: str) -> DataFrame:
    """Parents carry the value, but those listed as exceptions are replaced by their children, each with its own value or the parent's."""
    whole = parents.join(exceptions.select(parent_id).distinct(), parent_id, "left_anti").select(parent_id, F.lit(None).cast("string").alias("child_id"), value)
    split = children.withColumnRenamed(value, "__own").join(exceptions.select(parent_id).distinct(), parent_id, "left_semi").join(parents.select(parent_id, value), parent_id)
    return whole.unionByName(split.select(parent_id, F.col("child_id").cast("string").alias("child_id"), F.coalesce("__own", value).alias(value)))


def pairs_below(df: DataFrame, id: str, block: list[str]) -> DataFrame:
    """Unordered pairs inside a block, the smaller id first; columns of the second get the suffix _2."""
    other = df.toDF(*[c if c in block else f"{c}_2" for c in df.columns])
    return df.join(other, block).where(F.col(id) < F.col(f"{id}_2"))


#: Ids in one row of :func:`scored_pairs`.
CHUNK = 1000


def scored_pairs(df: DataFrame, id: str, block: list[str], kind: str, score: Column, name: str) -> DataFrame:
    """(id, id_2, name): unordered pairs inside a block, the smaller id first, with ``score``, a Column of ``kind`` and its copy ``kind``_2.

    Rows of one kind score alike: kinds meet with at most CHUNK ids in a row and score once, then their ids are paired.  Blocks are dealt to as many tasks as
    a shuffle has, since their bytes do not tell the work, which is quadratic in a block by its result.
    """
    place = F.row_number().over(Window.partitionBy(*block, kind).orderBy(id))
    chunks = df.where(F.col(id).isNotNull()).select(*block, kind, id, F.floor((place - 1) / CHUNK).alias("__c")).groupBy(*block, kind, "__c").agg(F.sort_array(F.collect_list(id)).alias("__ids"))
    chunks = chunks.drop("__c").repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *block)
    other = chunks.withColumnsRenamed({kind: f"{kind}_2", "__ids": "__ids_2"})
    met = chunks.join(other.hint("merge"), block).where(F.element_at("__ids", 1) < F.element_at("__ids_2", -1)).select("__ids", "__ids_2", score.alias(name))
    pairs = met.select(F.explode("__ids").alias(id), "__ids_2", name).select(id, F.explode("__ids_2").alias(f"{id}_2"), name)
    return pairs.where(F.col(id) < F.col(f"{id}_2"))


def suggest(left: DataFrame, right: DataFrame, scope: list[str], left_id: str, left_name: str, right_name: str, n: int = 5) -> DataFrame:
    """The n most similar names of the same scope for each left row, by :func:`similar.top_similar`."""
    return similar.top_similar(left, right, scope, left_id, left_name, right_name, n)


def cascade(left: DataFrame, right: DataFrame, left_id: str, right_id: str, stages: list[tuple[str, Column, Column]], scope: list[str]) -> DataFrame:
    """Entity resolution in stages: (name, left key, right key) tried in order, each on the rows still open; a stage matches a
    left row that has one candidate. Returns (left_id, right_id, stage); unresolved rows have nulls.

    All stages' keys meet in one join per stage of the open rows only; no stage sees rows that an earlier one resolved. The right side is
    counted by key before it is joined, so a key that many rows of both sides have costs one row for each of the left.
    """
    open_rows, done = left, None
    for name, left_key, right_key in stages:
        a = open_rows.select(left_id, *scope, left_key.alias("__k")).where("__k IS NOT NULL AND __k <> ''")
        b = right.select(right_id, *scope, right_key.alias("__k")).where("__k IS NOT NULL AND __k <> ''").distinct()
        b = b.groupBy(*scope, "__k").agg(F.min(right_id).alias(right_id), F.count(F.lit(1)).alias("__c"))
        hit = a.join(b, [*scope, "__k"]).groupBy(left_id).agg(F.min(right_id).alias(right_id), F.sum("__c").alias("n")).where("n = 1").select(left_id, right_id, F.lit(name).alias("stage"))
        done = hit if done is None else done.unionByName(hit)
        open_rows = open_rows.join(hit.select(left_id), left_id, "left_anti")
    return done.unionByName(open_rows.select(left_id, F.lit(None).cast(right.schema[right_id].dataType).alias(right_id), F.lit(None).cast("string").alias("stage")))


def _deletions(key: Column) -> Column:
    """The key and every form of it with one character left out."""
    places = F.sequence(F.lit(1), F.greatest(F.length(key), F.lit(1)))
    return F.array_distinct(F.concat(F.array(key), F.transform(places, lambda i: F.concat(F.substring(key, F.lit(1), i - 1), F.substring(key, i + 1, F.length(key))))))


def one_edit_pairs(df: DataFrame, id: str, scope: list[str], key: str) -> DataFrame:
    """(id, id_2), id below id_2, of rows of one scope whose keys are equal or one edit apart; they meet in a common one-deletion form."""
    forms = df.select(id, *scope, key).withColumn("__d", F.explode(_deletions(F.col(key))))
    other = forms.withColumnsRenamed({id: f"{id}_2", key: f"{key}_2"})
    near = forms.join(other, [*scope, "__d"]).where((F.col(id) < F.col(f"{id}_2")) & T.within_one_edit(F.col(key), F.col(f"{key}_2")))
    return near.select(id, f"{id}_2").distinct()


def one_edit_matches(left: DataFrame, right: DataFrame, scope: list[str], left_id: str, right_id: str, left_key: Column, right_key: Column, runner_up: int = 3) -> DataFrame:
    """(left_id, right_id) where one right key of the scope is one edit away and every other is ``runner_up`` edits or more.

    Candidates meet in a common one-deletion form, runners-up in a third of their key; ``runner_up`` is 3 at most.
    """
    a = left.select(left_id, *scope, left_key.alias("__a")).where("__a <> ''")
    b = right.select(right_id, *scope, right_key.alias("__b")).where("__b <> ''")
    forms = a.withColumn("__d", F.explode(_deletions(F.col("__a")))).join(b.withColumn("__d", F.explode(_deletions(F.col("__b")))), [*scope, "__d"])
    near = forms.where(F.levenshtein("__a", "__b", 1) == 1).select(left_id, right_id, *scope, "__a").distinct()
    single = near.join(near.groupBy(left_id).count().where("count = 1").select(left_id), left_id)
    held = b.groupBy(*scope, "__b").agg(F.count_distinct(right_id).alias("__n"), F.min(right_id).alias("__o"))
    around = similar.within_two_edits(single, b, scope, "__a", "__b", 2).where(F.col("edits") < runner_up).join(held, [*scope, "__b"])
    close = single.join(around, [*scope, "__a"]).where((F.col("__n") > 1) | (F.col("__o") != F.col(right_id))).select(left_id).distinct()
    return single.join(close, left_id, "left_anti").select(left_id, right_id)


def fuzzy_matches(left: DataFrame, right: DataFrame, scope: list[str], left_id: str, right_id: str, left_name: str, right_name: str, gates: list[tuple[float, float]]) -> DataFrame:
    """(left_id, right_id, score, margin) where the best score of the scope and its lead over the second pass one of the gates (least score, least margin)."""
    two = suggest(left, right, scope, left_id, left_name, right_name, 2)
    best = two.groupBy(left_id).agg(F.max(F.when(F.col("rank") == 1, F.struct("ratio", right_id))).alias("b"), F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("ratio"))), F.lit(0.0)).alias("second"))
    scored = best.select(left_id, F.col(f"b.{right_id}").alias(right_id), F.col("b.ratio").alias("score"), (F.col("b.ratio") - F.col("second")).alias("margin"))
    passes = F.lit(False)
    for least, lead in gates:
        passes = passes | ((F.col("score") >= least) & (F.col("margin") >= lead))
    return scored.where(passes)


def with_ancestors(df: DataFrame, levels: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """``df`` with the columns of its ancestors: each level (table, key of the child, key of the level) is a join on what is there by then."""
    for parent, child_key, own_key in levels:
        df = df.join(parent.withColumnRenamed(own_key, f"__{own_key}"), F.col(child_key) == F.col(f"__{own_key}"), "left").drop(f"__{own_key}")
    return df


def find_column(df: DataFrame, candidates: list[str]) -> str:
    """The first of the candidates that ``df`` has, whatever its case."""
    own = {c.lower(): c for c in df.columns}
    for c in candidates:
        if c.lower() in own:
            return own[c.lower()]
    raise ValueError(f"none of {candidates} among {df.columns}")
