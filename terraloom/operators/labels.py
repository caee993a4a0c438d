"""Zooms from which labels show: what one greedy pass over all labels by importance gives, computed zoom by zoom.

The pass asks, for each label in order, at which half zoom no label before it that shows by then lies within the spacing. A label that is taken at a zoom
shows a little later, by its own offset, and so stands in nobody's way before the next half zoom. So all labels that ask at one zoom are
independent of each other, but for those without an offset, and the zooms, 22 at most, are the only loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C
from . import graph
from ._shared import cut

#: First and last zoom of labels, step of the zooms tried, pixels of the world's width at zoom 0 (fixed values).
LOW, HIGH, STEP, TILE = 3.5, 14.0, 0.5, 512


def _step_up(zoom: Column) -> Column:
    return F.ceil(zoom / STEP) * STEP


def _near(asking: DataFrame, others: DataFrame, zoom: float) -> DataFrame:
    """(src, dst): labels of ``asking`` (id, x, y, place) and those of ``others`` (id, x, y, place) nearer than the spacing at a zoom and before them in place."""
    size, spacing = float(TILE * 2**zoom), C.spacing_at(zoom)
    cell = lambda c: F.floor(F.col(c) * size / spacing)
    around = lambda c: F.explode(F.sequence(cell(c) - 1, cell(c) + 1))
    a = asking.select(F.col("id").alias("src"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("place").alias("p1"), around("x").alias("cx"), F.col("y"))
    a = a.select("src", "x1", "y1", "p1", "cx", around("y").alias("cy"))
    b = others.select(F.col("id").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("place").alias("p2"), cell("x").alias("cx"), cell("y").alias("cy"))
    away = F.sqrt(F.pow((F.col("x1") - F.col("x2")) * size, 2) + F.pow((F.col("y1") - F.col("y2")) * size, 2))
    return a.join(b, ["cx", "cy"]).where((F.col("p2") < F.col("p1")) & (away < spacing)).select("src", "dst")


def _free(asking: DataFrame, others: DataFrame, zoom: float) -> DataFrame:
    """Rows of ``asking`` with none of ``others`` near and before; of labels at one place only the first is compared."""
    spots = others.groupBy("x", "y").agg(F.min("place").alias("place")).withColumn("id", F.lit(0))
    return asking.join(_near(asking, spots, zoom).select(F.col("src").alias("id")).distinct(), "id", "left_anti")


def label_zooms(labels: DataFrame, id: str) -> DataFrame:
    """(id, zoom) of ``labels``: ``x``, ``y`` (fractions of the world's width and height), ``base`` (zoom from which the label may show), ``delay`` (most
    zooms by which others may put it off), ``offset`` (added to a zoom found, below STEP) and ``rank`` (its order, ties by id).

    Bases are held to LOW and HIGH. Without a delay a label shows from its base on. A label that finds no room shows at the end of its delay. Ids must be unique; labels without a base are
    left out, those without a position are in nobody's way; a null delay or offset is 0.
    """
    rows = labels.where("base IS NOT NULL").select(
        F.col(id).alias("id"), "x", "y", F.struct("rank", F.col(id).alias("id")).alias("place"), F.greatest(F.lit(LOW), F.least(F.lit(HIGH), "base")).alias("base"), F.coalesce("delay", F.lit(0.0)).alias("delay"), F.coalesce("offset", F.lit(0.0)).alias("offset")
    )
    most = F.least(F.lit(HIGH), F.col("base") + F.col("delay"))
    rows = cut(rows.withColumn("most", most).withColumn("first", F.when(F.col("delay") > 0, _step_up(F.col("base")))))
    late = F.least(F.lit(HIGH), F.col("most") + F.col("offset"))
    keep = lambda df, zoom: df.select("id", "x", "y", "place", zoom.alias("zoom"))
    asks = F.coalesce(F.col("first") <= F.col("most"), F.lit(False))
    settled = keep(rows.where(~asks), F.when(F.col("delay") > 0, late).otherwise(F.col("base")))
    left = rows.where(asks)
    spans = left.select("first", (F.floor(F.col("most") / STEP) * STEP).alias("last")).distinct().collect()
    for k in range(round(LOW / STEP), round(HIGH / STEP) + 1):
        z = k * STEP
        if not any(s["first"] <= z <= s["last"] for s in spans):
            continue
        now, shown = left.where((F.col("first") <= z) & (F.col("most") >= z)), settled.where(F.least(F.lit(HIGH), _step_up(F.col("zoom"))) <= z)
        here, late_here = F.least(F.lit(HIGH), F.lit(z) + F.col("offset")), F.col("most") < z + STEP
        # Those that show at this zoom whether they have room or not.
        sure = now.where(F.least(here, late) == z if z == HIGH else (F.col("offset") == 0) & (F.col("most") == z))
        now = cut(now.join(sure.select("id"), "id", "left_anti"))
        shown = shown.unionByName(keep(sure, F.lit(z)))
        plain = cut(_free(now.where("offset = 0"), shown, z))
        if plain.isEmpty():
            taken = plain.select("id")
        else:
            pairs = _near(plain, plain, z)
            both = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
            taken = graph.greedy_independent(plain.select("id", F.col("place").alias("rank")), both)
        taken = plain.join(taken, "id", "left_semi")
        found = taken.unionByName(_free(now.where("offset > 0"), shown.unionByName(keep(taken, F.lit(z))), z))
        ended = now.where(late_here).join(found.select("id"), "id", "left_anti")
        new = cut(keep(sure, F.lit(z)).unionByName(keep(found, here)).unionByName(keep(ended, late)))
        settled, left = settled.unionByName(new), cut(left.join(new.select("id"), "id", "left_anti"))
    return settled.select(F.col("id").alias(id), "zoom")
