"""Voronoi cells of points in a box, without a grid in the result.

A cell is right when none of its corners has a seed nearer than its own.  So each round asks for the seed nearest to every
corner not yet asked, and clips the cell by the half-plane towards it; a cell whose corners are all confirmed is done.
Cells start from the box, clipped by one representative of each of the nine quadtree cells around the seed on every level,
at most 117 of them, so that few rounds are left.

The search descends a quadtree: of the squares that a corner still looks into, those farther than the nearest representative
go.  A corner meets few squares a level whatever the density, so a far corner never meets all of a dense cluster.  Squares of
the upper levels, 4,096 a level at most, are broadcast; deeper ones are joined by key.

Seeds with a null id (guards) take their share of the plane but give no cell; rows at one place are one seed, with its
smallest id.  Seeds with a null coordinate are left out, an empty table gives an empty table, and a cell that misses the box
gives no row.  One cell's ring stands in one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import kept

#: Squares of level n have 2 ** -n of the root's side; levels are STEP apart, so a square has 16 parts. Squares of at most LEAF seeds are not parted.
DEPTH, STEP, LEAF = 24, 2, 16
#: Squares up to this level are at most 4 ** 6 and may be broadcast.
UPPER = 6
#: A seed counts as nearer if it is by this part of the root's side.
NEARER = 1e-11

Box = tuple[float, float, float, float]
_KEY = ["l", "cx", "cy"]


def guard_points(box: Box, margin: float = 10.0) -> list[tuple[float, float]]:
    """Eight points around a box: its corners and the middles of its sides, moved out by ``margin`` times its longer side (1 at least)."""
    west, south, east, north = box
    out = max(east - west, north - south, 1.0) * margin
    xs, ys = (west - out, (west + east) / 2, east + out), (south - out, (south + north) / 2, north + out)
    return [(x, y) for x in xs for y in ys if (x, y) != (xs[1], ys[1])]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _square(v: str, low: float, side: float, level: Column | int) -> Column:
    cell = F.least(F.lit((1 << DEPTH) - 1), F.greatest(F.lit(0), F.floor((F.col(v) - low) / side * float(1 << DEPTH)))).cast("long")
    return F.floor(cell / F.pow(F.lit(2.0), DEPTH - F.lit(level) if isinstance(level, int) else DEPTH - level)).cast("long")


class _Quadtree:
    """The seeds by squares: ``nodes`` of all levels, ``parts`` of each crowded square, and ``homes``, the seeds under the square that is not parted."""

    def __init__(self, seeds: DataFrame, box: Box) -> None:
        b = seeds.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
        west, south, east, north = ((f(v, w) if v is not None else w) for f, v, w in zip((min, min, max, max), b, box, strict=True))
        self.x0, self.y0, self.side = west, south, max(east - west, north - south, 1e-9) * (1 + 1e-9)
        levels = F.explode(F.array(*[F.lit(n) for n in range(0, DEPTH + 1, STEP)]))
        spread = seeds.withColumn("l", levels)
        spread = spread.withColumn("cx", _square("x", self.x0, self.side, F.col("l"))).withColumn("cy", _square("y", self.y0, self.side, F.col("l")))
        every = kept(spread.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("x", "y", "id")).alias("rep")))
        self.depth = min(DEPTH, (every.where(F.col("n") > LEAF).agg(F.max("l")).first()[0] or 0) + STEP)
        self.nodes = every.where(F.col("l") <= self.depth)
        above = F.col("l") - STEP
        kids = self.nodes.where("l > 0").select(above.alias("l"), F.shiftright("cx", STEP).alias("cx"), F.shiftright("cy", STEP).alias("cy"), F.struct(*_KEY, "rep").alias("part"))
        crowded = self.nodes.where((F.col("n") > LEAF) & (F.col("l") < self.depth)).select(*_KEY)
        self.parts = kept(kids.join(crowded, _KEY, "left_semi").groupBy(*_KEY).agg(F.collect_list("part").alias("parts")))
        whole = self.nodes.where((F.col("n") <= LEAF) | (F.col("l") == self.depth)).select(*_KEY)
        first = Window.partitionBy("x", "y").orderBy("l")
        self.homes = kept(spread.join(whole, _KEY, "left_semi").withColumn("k", F.row_number().over(first)).where("k = 1").select(*_KEY, F.struct("x", "y", "id").alias("seed")))

    def around(self, seeds: DataFrame) -> DataFrame:
        """(x, y, id, near): each seed with the representatives of the nine squares around it on every level, the nearest first."""
        near = seeds.withColumn("l", F.explode(F.array(*[F.lit(n) for n in range(0, self.depth + 1, STEP)])))
        for c, low in (("x", self.x0), ("y", self.y0)):
            near = near.withColumn(f"c{c}", F.explode(F.transform(F.array(*[F.lit(d) for d in (-1, 0, 1)]), lambda d: _square(c, low, self.side, F.col("l")) + d)))  # noqa: B023
        upper = near.where(F.col("l") <= UPPER).join(F.broadcast(self.nodes.where(F.col("l") <= UPPER)), _KEY)
        lower = near.where(F.col("l") > UPPER).join(self.nodes.where(F.col("l") > UPPER), _KEY)
        met = upper.unionByName(lower).where("rep.x <> x OR rep.y <> y")
        met = met.groupBy("x", "y", "id").agg(F.array_sort(F.collect_set(F.struct(_square_away("x", "y", F.col("rep.x"), F.col("rep.y")).alias("d2"), "rep"))).alias("near"))
        return seeds.join(met.withColumnsRenamed({"x": "__x", "y": "__y", "id": "__id"}), (F.col("x") == F.col("__x")) & (F.col("y") == F.col("__y")), "left").drop("__x", "__y", "__id")

    def nearest(self, asked: DataFrame, keys: list[str]) -> DataFrame:
        """The seed nearest to each row of ``asked`` (keys, x, y) among those with a square distance under ``bound``: (keys, d2, seed); rows without one are left out."""
        found = asked.withColumns({"l": F.lit(0), "cx": F.lit(0).cast("long"), "cy": F.lit(0).cast("long")})
        for level in range(0, self.depth, STEP):
            parts = self.parts.where(F.col("l") == level)
            joined = found.join(F.broadcast(parts) if level <= UPPER else parts, _KEY, "left")
            own = F.struct(*[F.col(c).alias(c) for c in _KEY], F.lit(None).cast(self.nodes.schema["rep"].dataType).alias("rep"))
            split = joined.withColumn("part", F.explode(F.coalesce("parts", F.array(own)))).drop("parts", *_KEY)
            split = split.select(*keys, "x", "y", "bound", "part.*")
            size = F.lit(self.side) / F.pow(F.lit(2.0), F.col("l"))
            gap = lambda v, low, c: F.greatest(F.lit(0.0), low + F.col(c) * size - F.col(v), F.col(v) - low - (F.col(c) + 1) * size)
            least = F.pow(gap("x", self.x0, "cx"), 2) + F.pow(gap("y", self.y0, "cy"), 2)
            best = F.min(F.least(F.col("bound"), _square_away("x", "y", F.col("rep.x"), F.col("rep.y")))).over(Window.partitionBy(*keys))
            found = split.withColumn("__best", best).where(least * (1 - 1e-9) <= F.col("__best")).drop("__best", "rep")
        met = found.join(self.homes, _KEY).withColumn("d2", _square_away("x", "y", F.col("seed.x"), F.col("seed.y"))).where("d2 < bound")
        return met.groupBy(*keys).agg(F.min(F.struct("d2", "seed")).alias("hit")).select(*keys, "hit.*")


def _square_away(x: str, y: str, x2: Column, y2: Column) -> Column:
    return F.pow(F.col(x) - x2, 2) + F.pow(F.col(y) - y2, 2)


def _corner(x: Column, y: Column, other: Column, ok: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), other.cast("long").alias("other"), ok.alias("ok"))


def _clip(ring: Column, px: Column, py: Column, q: Column) -> Column:
    """The part of a ring that is no nearer to q (x, y, id) than to p; ``other`` of a corner names the seed beyond the side that begins there."""
    dx, dy = q["x"] - px, q["y"] - py
    beyond = lambda v: (v["x"] - (q["x"] + px) / 2) * dx + (v["y"] - (q["y"] + py) / 2) * dy

    def sides(g: Column) -> Column:
        def side(i: Column) -> Column:
            a, b = F.element_at(g, i), F.element_at(g, i % F.size(g) + 1)
            t = a["f"] / (a["f"] - b["f"])
            cut = lambda other: _corner(a["x"] + (b["x"] - a["x"]) * t, a["y"] + (b["y"] - a["y"]) * t, other, F.lit(False))
            stays = F.when(b["f"] <= 0, F.array(a["v"])).when(a["f"] == 0, F.array(_corner(a["x"], a["y"], q["id"], a["v"]["ok"]))).otherwise(F.array(a["v"], cut(q["id"])))
            return F.when(a["f"] <= 0, stays).when(b["f"] < 0, F.array(cut(a["v"]["other"]))).otherwise(F.slice(F.array(a["v"]), 1, 0))

        return F.flatten(F.transform(F.sequence(F.lit(1), F.size(g)), side))

    marked = F.transform(ring, lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"), v.alias("v"), beyond(v).alias("f")))
    return F.when((F.size(ring) == 0) | ~F.exists(ring, lambda v: beyond(v) > 0), ring).otherwise(_let(marked, sides))


def _clipped(ring: Column, others: str, seed: str) -> Column:
    return F.when(F.col(others).isNull(), ring).otherwise(F.aggregate(others, ring, lambda r, o: _clip(r, F.col("x"), F.col("y"), o[seed])))


def cells(seeds: DataFrame, id: str, box: Box, guards: list[tuple[float, float]] = ()) -> DataFrame:
    """(id, x, y, ring): the part of ``box`` (west, south, east, north) nearer to each seed (id, x, y) than to any other.

    ``ring`` runs counter-clockwise; each corner (x, y, other) names the seed on the other side of the side that begins there, null at the box and at guards.
    """
    spark = seeds.sparkSession
    points = seeds.select(F.col(id).cast("long").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    if guards:
        points = points.unionByName(spark.createDataFrame([(None, float(x), float(y)) for x, y in guards], "id long, x double, y double"))
    points = kept(points.groupBy("x", "y").agg(F.min("id").alias("id")))
    tree = _Quadtree(points, box)
    west, south, east, north = box
    corners = F.array(*[_corner(F.lit(float(x)), F.lit(float(y)), F.lit(None), F.lit(False)) for x, y in ((west, south), (east, south), (east, north), (west, north))])
    start = tree.around(points.where("id IS NOT NULL"))
    state = start.select("id", "x", "y", _clipped(corners, "near", "rep").alias("ring"))
    done, slack = [], NEARER * tree.side
    while True:
        state = kept(state.where(F.size("ring") > 0).withColumn("open", F.exists("ring", lambda v: ~v["ok"])))
        done.append(state.where("NOT open"))
        now = state.where("open").drop("open")
        if now.isEmpty():
            break
        own = F.greatest(F.lit(0.0), F.sqrt(F.pow(F.col("v.x") - F.col("x"), 2) + F.pow(F.col("v.y") - F.col("y"), 2)) - slack)
        asked = now.select("id", "x", "y", F.posexplode("ring").alias("place", "v")).where("NOT v.ok").select("id", "place", F.pow(own, 2).alias("bound"), F.col("v.x").alias("x"), F.col("v.y").alias("y"))
        cut = tree.nearest(asked, ["id", "place"]).groupBy("id").agg(F.array_sort(F.collect_set(F.struct("seed"))).alias("near"))
        seen = F.transform("ring", lambda v: _corner(v["x"], v["y"], v["other"], F.lit(True)))
        state = now.withColumn("ring", seen).join(cut, "id", "left").select("id", "x", "y", _clipped(F.col("ring"), "near", "seed").alias("ring"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(F.col("id").alias(id), "x", "y", F.transform("ring", lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"), v["other"].alias("other"))).alias("ring"))


def sides(cells: DataFrame, id: str) -> DataFrame:
    """(id, other, length, area): a row for each side of a cell, with the area of the triangle between it and the seed (signed, if the seed lies outside)."""
    ends = F.transform("ring", lambda v, i: F.struct(v.alias("a"), F.element_at("ring", (i + 1) % F.size("ring") + 1).alias("b")))
    each = cells.select(id, "x", "y", F.explode(ends).alias("s")).select(id, "x", "y", "s.a", "s.b")
    length = F.sqrt(F.pow(F.col("a.x") - F.col("b.x"), 2) + F.pow(F.col("a.y") - F.col("b.y"), 2))
    area = ((F.col("a.x") - F.col("x")) * (F.col("b.y") - F.col("y")) - (F.col("b.x") - F.col("x")) * (F.col("a.y") - F.col("y"))) / 2
    return each.select(id, F.col("a.other").alias("other"), length.alias("length"), area.alias("area"))


def regions(cells: DataFrame, id: str, codes: DataFrame, code: str) -> DataFrame:
    """(code, cells, area, border): cells dissolved by the code of their seeds (``codes``: id, code); the border is what lies against another code or the box."""
    own = sides(cells, id).join(codes.select(id, code), id)
    other = codes.select(F.col(id).alias("other"), F.col(code).alias("__other"))
    edge = F.when(F.col("__other").eqNullSafe(F.col(code)) & F.col("other").isNotNull(), F.lit(0.0)).otherwise(F.col("length"))
    return own.join(other, "other", "left").groupBy(code).agg(F.count_distinct(id).alias("cells"), F.sum("area").alias("area"), F.sum(edge).alias("border"))
