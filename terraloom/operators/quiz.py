"""Feature queries: groups of features, their answers and questions, and option lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import text as T


def as_list(scalar: Column | None = None, array: Column | None = None) -> Column:
    """A string becomes a list of one, a list stays, anything else is empty."""
    parts = [c for c in (array, F.when(scalar.isNotNull(), F.array(scalar)) if scalar is not None else None) if c is not None]
    return F.coalesce(*parts, F.array().cast("array<string>"))


def feature_id(promoted: Column, own: Column) -> Column:
    return F.coalesce(promoted.cast("string"), own.cast("string"))


def full_group(features: DataFrame) -> DataFrame:
    return features


def property_group(features: DataFrame, values: str, selected: list[str]) -> DataFrame:
    """Features whose list of values has any of the selected; an unknown property gives none."""
    if values not in features.columns:
        return features.limit(0)
    return features.where(F.arrays_overlap(F.col(values), F.array(*[F.lit(s) for s in selected]).cast("array<string>")))


def feature_group(features: DataFrame, id: str, ids: list[str]) -> DataFrame:
    return features.where(F.col(id).isin(ids))


def saved_group(features: DataFrame, id: str, saved: DataFrame) -> DataFrame:
    """Like :func:`feature_group`, of a saved list of ids that is a table."""
    return features.join(saved.select(id).distinct(), id, "left_semi")


def typed_values(scalar: Column, array: Column, kind: str) -> Column:
    """Values of a property of a declared type: ``string`` takes a string only, ``string-array`` a list only."""
    none = F.array().cast("array<string>")
    return F.coalesce(F.when(scalar.isNotNull(), F.array(scalar)) if kind == "string" else array, none)


def answers_of(features: DataFrame, answers: str) -> DataFrame:
    """The distinct answers of some features."""
    return features.select(F.explode(answers).alias("answer")).distinct()


def active_questions(questions: DataFrame, features: DataFrame, answers: str) -> DataFrame:
    """Questions whose answer some feature of the group has."""
    return questions.join(answers_of(features, answers), "answer", "left_semi")


def group_options(features: DataFrame, values: str) -> DataFrame:
    """(value, n): each value of a property with its features."""
    return features.select(F.explode(F.array_distinct(values)).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def questions_in_order(features: DataFrame, questions: DataFrame, id: str, answers: str) -> DataFrame:
    """(id, displays): each feature's answers as displayed, in their order; the first question of an answer counts."""
    first = questions.groupBy("answer").agg(F.min_by("display", "ord").alias("display"))
    each = features.select(id, F.posexplode(answers).alias("pos", "answer")).join(first, "answer")
    return each.groupBy(id).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "display"))), lambda s: s["display"]).alias("displays"))


def two_line_labels(features: DataFrame, questions: DataFrame, id: str, answer: str, name: str) -> DataFrame:
    """(id, label): the display of the feature's first question above the feature's own name."""
    first = features.join(questions, answer).groupBy(id).agg(F.min_by("display", "ord").alias("display"), F.first(name).alias(name))
    return first.select(id, T.two_lines(F.col("display"), F.col(name)).alias("label"))


def visible(features: DataFrame, id: str, mode: Column, last: Column, capital: Column) -> DataFrame:
    """Features that show: all in normal mode, in hard mode the one answered last; a capital layer asks for capitals as well."""
    return features.where(F.when(mode == "hard", F.coalesce(F.col(id) == last, F.lit(False))).otherwise(F.lit(True)) & F.coalesce(capital, F.lit(True)))


def judged_clicks(clicks: DataFrame, answers: DataFrame, order: list[str], running: str | None = None) -> DataFrame:
    """``clicks`` (session, feature, question, mode, ...) with ``verdict``, by the answers of features (feature, answer).

    A feature without answers, or a click while no question is asked, is ``ignored``; while the session does not run (``running``, if given) a click is
    ``inspected``. In normal mode a feature is ignored once all its answers have been answered right in the session, on whatever feature; else the
    click is right if the question is among the feature's answers, or wrong.
    """
    known = answers.select("feature", "answer").where("answer IS NOT NULL").distinct()
    at = F.struct(*order)
    live = F.coalesce(F.col(running), F.lit(False)) if running else F.lit(True)
    total = known.groupBy("feature").agg(F.count(F.lit(1)).alias("__n"))
    given = clicks.join(known.select("feature", F.col("answer").alias("question"), F.lit(True).alias("__hit")), ["feature", "question"], "left").join(total, "feature", "left")
    answered = given.where(F.col("__hit") & live).groupBy("session", F.col("question").alias("answer")).agg(F.min(at).alias("__at"))
    complete = answered.join(known, "answer").groupBy("session", "feature").agg(F.count(F.lit(1)).alias("__k"), F.max("__at").alias("__done"))
    judged = given.join(complete, ["session", "feature"], "left")
    done = (F.col("mode") != "hard") & (F.col("__k") == F.col("__n")) & (F.col("__done") < at)
    verdict = F.when(F.col("__n").isNull(), "ignored").when(~live, "inspected").when(F.col("question").isNull() | F.coalesce(done, F.lit(False)), "ignored")
    return judged.withColumn("verdict", verdict.when(F.coalesce("__hit", F.lit(False)), "right").otherwise("wrong")).drop("__hit", "__n", "__k", "__done")


def feature_colours(features: DataFrame, statuses: DataFrame, id: str, normal: tuple[int, int, int] = (150, 150, 150), shading: bool = True, visible: DataFrame | None = None) -> DataFrame:
    """(session, id, r, g, b, a) of the features (id, ``answers``) with an answer in the session's ``statuses`` (session, answer, status: correct or wrong).

    All other features have the colour of :func:`~terraloom.functions.classify.feature_colour` for no answers. In hard mode ``visible`` (session, answer) says which
    answer shows: features without it look as if not answered. An answer with both statuses counts as correct; an answer that a feature lists twice counts once,
    but as two of its total.
    """
    given = statuses.where("status IN ('correct', 'wrong')").groupBy("session", "answer").agg(F.min("status").alias("status"))
    each = features.select(id, F.size("answers").alias("__n"), F.explode(F.array_distinct("answers")).alias("answer")).join(given, "answer")
    seen = F.lit(True)
    if visible is not None:
        each = each.join(visible.select("session", "answer", F.lit(True).alias("__seen")).distinct(), ["session", "answer"], "left")
        seen = F.coalesce(F.max("__seen"), F.lit(False))
    n = lambda status: F.when(seen, F.count_if(F.col("status") == status)).otherwise(0)
    counted = each.groupBy("session", id).agg(n("correct").alias("__right"), n("wrong").alias("__wrong"), F.first("__n").alias("__n"))
    colour = C.feature_colour(F.col("__right"), F.col("__wrong"), F.col("__n"), normal, shading)
    return counted.select("session", id, colour.alias("__c")).select("session", id, "__c.*")


def sections(listing: DataFrame, section: str, item: str, order: str) -> DataFrame:
    """(section, items): the items of each section in order; sections without an item go."""
    found = listing.where(F.col(item).isNotNull()).groupBy(section).agg(F.array_sort(F.collect_list(F.struct(order, item))).alias("s"))
    return found.select(section, F.transform("s", lambda x: x[item]).alias("items"))
