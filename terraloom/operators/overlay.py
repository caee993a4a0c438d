"""Overlays of polygons with holes: shared areas, parents, atomic cells, merged regions, repair, gaps.

A shape is a row (id, rings), outer ring first; rows that repeat an id are parts of one shape and must not overlap each other.
Shared areas are sums over pairs of border segments by slabs of x; everything that makes new borders works on the half-edges of
:mod:`planar`.  ``size`` is the side of the tiles, in map units: a tile should hold some dozens of segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo as G
from . import coverage as V
from . import planar as P
from . import rowwork as R
from . import spatial as S
from ._shared import kept


def shape_area(rings: Column) -> Column:
    holes = F.transform(F.slice(rings, F.lit(2), F.size(rings)), lambda r: F.abs(P.signed_area(r)))
    return F.abs(P.signed_area(rings[0])) - F.aggregate(holes, F.lit(0.0), lambda s, a: s + a)


def _bounds(shapes: DataFrame, id: str) -> DataFrame:
    box = G.ring_bounds(F.col("rings")[0])
    return shapes.groupBy(id).agg(*[(F.min if c in ("west", "south") else F.max)(box[c]).alias(c) for c in S.BOX], F.sum(shape_area(F.col("rings"))).alias("own_area"))


def overlap_areas(left: DataFrame, right: DataFrame, left_id: str, right_id: str, size: float = 10.0) -> DataFrame:
    """(left_id, right_id, area, left_area, right_area) of the shapes that share area, as of :func:`spatial.overlapping_boxes`.

    A shape is the signed sum of the strips under its segments, so the shared area of two shapes is the signed sum, over pairs of their
    segments, of the strip under the lower of the two.  Segments are cut into slabs of ``size`` along x and meet by pair and slab.
    """
    boxes = [_bounds(left, left_id), _bounds(right, right_id)]
    pairs = S.overlapping_boxes(boxes[0], boxes[1], left_id, right_id, size).select(left_id, right_id)
    low = boxes[0].select(left_id, F.col("south").alias("s1"), F.col("own_area").alias("left_area")), boxes[1].select(right_id, F.col("south").alias("s2"), F.col("own_area").alias("right_area"))
    pairs = kept(pairs.join(low[0], left_id).join(low[1], right_id).select(left_id, right_id, F.least("s1", "s2").alias("base"), "left_area", "right_area"))

    def strips(shapes: DataFrame, id: str, p: str) -> DataFrame:
        lines = P.segments(shapes, id, 15).where("ax < bx")
        cell = lambda c: F.floor(F.col(c) / size).cast("long")
        wide = lines.withColumn("slab", F.explode(F.sequence(cell("ax"), cell("bx"))))
        return wide.select(F.col("id").alias(id), "slab", F.when(F.col("forward"), -1.0).otherwise(1.0).alias(f"{p}sign"), *[F.col(c).alias(f"{p}{c}") for c in P._ENDS])

    met = pairs.select(left_id, right_id, "base").join(strips(left, left_id, "p"), left_id).join(strips(right, right_id, "q"), [right_id, "slab"])
    x1 = F.greatest(F.col("pax"), F.col("qax"), F.col("slab") * size)
    x2 = F.least(F.col("pbx"), F.col("qbx"), (F.col("slab") + 1) * size)
    at = lambda p, x: F.col(f"{p}ay") + (F.col(f"{p}by") - F.col(f"{p}ay")) * (x - F.col(f"{p}ax")) / (F.col(f"{p}bx") - F.col(f"{p}ax")) - F.col("base")
    met = met.withColumn("x1", x1).withColumn("x2", x2).where("x1 < x2")
    met = met.select(left_id, right_id, (F.col("psign") * F.col("qsign")).alias("sign"), (F.col("x2") - F.col("x1")).alias("w"), at("p", F.col("x1")).alias("p1"), at("p", F.col("x2")).alias("p2"), at("q", F.col("x1")).alias("q1"), at("q", F.col("x2")).alias("q2"))
    d1, d2 = F.col("p1") - F.col("q1"), F.col("p2") - F.col("q2")
    s = d1 / F.when(d1 * d2 < 0, d1 - d2)
    m = F.col("p1") + s * (F.col("p2") - F.col("p1"))
    crossed = s * (F.least("p1", "q1") + m) + (1 - s) * (m + F.least("p2", "q2"))
    strip = F.col("w") * F.coalesce(crossed, F.least(F.col("p1") + F.col("p2"), F.col("q1") + F.col("q2"))) / 2.0
    areas = met.groupBy(left_id, right_id).agg(F.sum(F.col("sign") * strip).alias("area"))
    known = pairs.select(left_id, right_id, "left_area", "right_area")
    return known.join(areas, [left_id, right_id]).select(left_id, right_id, "area", "left_area", "right_area").where(F.col("area") > 1e-12 * F.least("left_area", "right_area"))


def carved(parents: DataFrame, parts: DataFrame, id: str, part_id: str, size: float = 10.0) -> DataFrame:
    """(id, area, part_area, left): parents without the area that the parts, which do not overlap each other, take; parents that no part meets stay whole. An error where nothing is left."""
    own = parents.groupBy(id).agg(F.sum(shape_area(F.col("rings"))).alias("area"))
    taken = overlap_areas(parents, parts, id, part_id, size).groupBy(id).agg(F.sum("area").alias("part_area"))
    both = own.join(taken, id, "left").fillna(0.0, ["part_area"])
    gone = F.col("part_area") >= F.col("area") * (1 - 1e-12)
    return both.withColumn("left", F.when(gone, F.raise_error(F.concat(F.lit("nothing is left of "), F.col(id).cast("string"))).cast("double")).otherwise(F.col("area") - F.col("part_area")))


def containers(points: DataFrame, shapes: DataFrame, point_id: str, shape_id: str, size: float = 10.0) -> DataFrame:
    """(point_id, shape_id): every shape that a point (x, y) lies in. Of points on a border, those on a western or southern one lie inside and those on an eastern or northern one do not (of a hole likewise), so a point of a coverage lies in one shape."""
    tiles = S._tiles(shapes.select(shape_id, "rings"), size, G.ring_bounds(F.col("rings")[0]))
    placed = points.select(point_id, "x", "y").withColumn("__ty", G.cell(F.col("y"), size)).withColumn("__tx", G.cell(F.col("x"), size))
    return placed.join(tiles, ["__ty", "__tx"]).where(G.point_in_polygon(F.col("x"), F.col("y"), F.col("rings"))).select(point_id, shape_id).distinct()


def parents(children: DataFrame, shapes: DataFrame, id: str, parent_id: str, size: float = 10.0, strict: bool = False) -> DataFrame:
    """(id, parent_id, how, percent) of every child (id, rings): the one parent that its interior point lies in (``point``), else, with none or several,
    the one with most shared area, the least id on ties (``overlap``), else null (``none``); ``percent`` is the share of the child's area that the fallback found.

    ``strict`` takes points alone: an error where a point lies in no parent or in several.
    """
    points = children.select(id, V.interior_point(F.col("rings")).alias("p")).select(id, "p.x", "p.y")
    hits = containers(points, shapes, id, parent_id, size).groupBy(id).agg(F.count(F.lit(1)).alias("n"), F.min(parent_id).alias(parent_id))
    placed = kept(children.select(id).distinct().join(hits, id, "left"))
    if strict:
        fault = F.when(F.col("n").isNull(), F.lit("lies in no parent")).otherwise(F.lit("lies in several parents"))
        said = F.raise_error(F.concat(F.col(id).cast("string"), F.lit(" "), fault)).cast(shapes.schema[parent_id].dataType)
        return placed.select(id, F.when(F.col("n") == 1, F.col(parent_id)).otherwise(said).alias(parent_id), F.lit("point").alias("how"), F.lit(None).cast("double").alias("percent"))
    sole = placed.where("n = 1").select(id, parent_id, F.lit("point").alias("how"), F.lit(None).cast("double").alias("percent"))
    open_ = children.join(placed.where("n IS NULL OR n > 1").select(id), id, "left_semi")
    best = S.largest_overlap(overlap_areas(open_, shapes, id, parent_id, size), id, parent_id)
    rest = open_.select(id).distinct().join(best, id, "left").select(id, parent_id, F.when(F.col(parent_id).isNull(), "none").otherwise("overlap").alias("how"), "percent")
    return sole.unionByName(rest)


def atomic_cells(shapes: DataFrame, id: str, size: float = 10.0) -> DataFrame:
    """(cell, area, rings, members): the pieces that all borders together cut the covered area into, each with the sorted ids of the shapes that cover it."""
    edges, _ = P.noded(P.segments(shapes, id), size)
    cells = kept(P.face_rings(P.faces(edges, size)))
    points = cells.select("face", V.interior_point(F.col("rings")).alias("p")).select("face", "p.x", "p.y")
    over = containers(points, shapes, "face", id, size).groupBy("face").agg(F.array_sort(F.collect_set(id)).alias("members"))
    return cells.join(over, "face").select(F.col("face").alias("cell"), "area", "rings", "members")


def regions(units: DataFrame, id: str, key: str, size: float = 10.0) -> DataFrame:
    """(key, part, area, rings): the units of a coverage merged by ``key``: borders between units of one key go, and each face of the rest is a part."""
    edges, owners = P.shared_edges(P.segments(units, id))
    side = owners.join(units.select(F.col(id).alias("id"), F.col(key).alias("key")).distinct(), "id")
    by_edge = side.groupBy("eid").agg(F.max(F.when(F.col("forward"), F.struct("key"))).alias("l"), F.max(F.when(~F.col("forward"), F.struct("key"))).alias("r"))
    border = kept(by_edge.where("NOT (l <=> r)"))
    halves = P.faces(edges.join(border.select("eid"), "eid"), size)
    owned = border.select((F.col("eid") * 2).alias("id"), F.col("l.key").alias(key), F.col("l").isNotNull().alias("is")).unionByName(border.select((F.col("eid") * 2 + 1).alias("id"), F.col("r.key").alias(key), F.col("r").isNotNull().alias("is")))
    named = halves.where("face IS NOT NULL").join(owned.where("is"), "id").groupBy("face").agg(F.first(key).alias(key))
    return P.face_rings(halves).join(named, "face").select(key, F.col("face").alias("part"), "area", "rings")


def _by_size(shapes: DataFrame, id: str) -> tuple[DataFrame, DataFrame | None]:
    """Shapes (id, rings) of at most :data:`rowwork.SEGMENTS` points in all their parts, and the others, if any."""
    own = shapes.select(F.col(id).alias("id"), "rings")
    points = F.aggregate("rings", F.lit(0), lambda n, r: n + F.coalesce(F.size(r), F.lit(0)))
    large = kept(own.groupBy("id").agg(F.sum(points).alias("n")).where(F.col("n") > R.SEGMENTS).select(F.col("id").alias("__id")))
    if large.isEmpty():
        return own, None
    same = F.col("id").eqNullSafe(F.col("__id"))
    return own.join(large, same, "left_anti"), own.join(large, same, "left_semi")


def _dealt(shapes: DataFrame) -> DataFrame:
    """Shapes by id in a fixed number of partitions: Spark would merge them by their bytes, which say little about the work in a row."""
    spark = shapes.sparkSession
    return shapes.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "id")


def validity(shapes: DataFrame, id: str, size: float = 10.0) -> DataFrame:
    """(id, crossings, doubled, short, valid): points where a shape's own borders cross or touch inside a segment, segments it has more than once, and rings of fewer than three points.

    Small shapes are worked out in their rows, others by tiles of their segments.
    """
    small, large = _by_size(shapes, id)
    few = F.sum(F.size(F.filter("rings", lambda r: F.size(F.array_distinct(r)) < 3))).cast("long").alias("short")
    at_once = _dealt(small).groupBy("id").agg(few, F.flatten(F.collect_list("rings")).alias("rings")).select("id", "short", R.faults(F.col("rings")).alias("f"))
    out = at_once.select("id", "short", "f.crossings", "f.doubled")
    if large is not None:
        borders = P.segments(large.withColumn("__layer", F.col("id")), "id", layer="__layer")
        lines = kept(borders.select("layer", *P._ENDS).distinct().withColumn("sid", F.monotonically_increasing_id()))
        crossed = P.meetings(lines, size).join(lines.select("sid", F.col("layer").alias("id")), "sid").select("id", "x", "y").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("crossings"))
        twice = borders.groupBy("layer", *P._ENDS).count().where("count > 1").groupBy(F.col("layer").alias("id")).agg(F.count(F.lit(1)).alias("doubled"))
        out = out.unionByName(large.groupBy("id").agg(few).join(crossed, "id", "left").join(twice, "id", "left").fillna(0, ["crossings", "doubled"]))
    return out.select(F.col("id").alias(id), "crossings", "doubled", "short", ((F.col("crossings") == 0) & (F.col("doubled") == 0) & (F.col("short") == 0)).alias("valid"))


def _covered(part: Column, rings: Column) -> Column:
    """An interior point of a part lies within an odd number of the rings."""
    crossed = lambda p: F.aggregate(F.transform(rings, lambda r: G.point_in_ring(p["x"], p["y"], r).cast("int")), F.lit(0), lambda n, k: n + k)
    return V._let(V.interior_point(part), lambda p: crossed(p) % 2 == 1)


def repaired(shapes: DataFrame, id: str, size: float = 10.0) -> DataFrame:
    """(id, part, area, rings): what a shape's rings enclose by the even-odd rule, as parts that do not cross themselves; lines without area go.

    Small shapes are worked out in their rows, others by tiles of their segments. ``part`` is negative for the former and not for the latter.
    """
    small, large = _by_size(shapes, id)
    whole = _dealt(small).groupBy("id").agg(F.flatten(F.collect_list("rings")).alias("rings"))
    cut = whole.select("id", "rings", R.odd_edges(F.col("rings")).alias("edges"))
    # explode_outer, since Spark filters what explode takes by computing it once more.
    each = cut.select("id", "rings", F.explode_outer(R.faces(F.col("edges"))).alias("p")).where("p IS NOT NULL").where(_covered(F.col("p.rings"), F.col("rings")))
    done = kept(each.select("id", (-1 - F.monotonically_increasing_id()).alias("part"), "p.area", "p.rings"))
    if large is not None:
        edges, owners = P.noded(P.segments(large.withColumn("__layer", F.col("id")), "id", layer="__layer"), size)
        odd = owners.groupBy("eid").count().where("count % 2 = 1").select("eid")
        halves = P.faces(edges.join(odd, "eid"), size)
        parts = kept(P.face_rings(halves).join(halves.select("face", F.col("layer").alias("id")).distinct(), "face"))
        own = large.groupBy("id").agg(F.flatten(F.collect_list("rings")).alias("own_rings"))
        inside = parts.join(own, "id").where(_covered(F.col("rings"), F.col("own_rings")))
        done = done.unionByName(inside.select("id", F.col("face").alias("part"), "area", "rings"))
    return done.select(F.col("id").alias(id), "part", "area", "rings")


def simplified_valid(shapes: DataFrame, id: str, tolerances: list[float], size: float = 10.0) -> DataFrame:
    """(id, rings, tolerance): each shape by the first of ``tolerances`` that leaves it valid; as it is, with a null tolerance, where none does."""
    left, done = shapes.select(id, "rings"), None
    for tolerance in tolerances:
        tried = kept(left.withColumn("rings", V.simplify(F.col("rings"), tolerance)))
        good = kept(validity(tried, id, size).where("valid").select(id))
        now = tried.join(good, id, "left_semi").withColumn("tolerance", F.lit(float(tolerance)))
        done = now if done is None else done.unionByName(now)
        left = left.join(good, id, "left_anti")
    rest = left.withColumn("tolerance", F.lit(None).cast("double"))
    return rest if done is None else done.unionByName(rest)


def gaps(units: DataFrame, id: str, size: float = 10.0, outline: DataFrame | None = None) -> DataFrame:
    """(gap, area, x, y, id, shared, rings): the areas that units of a coverage enclose but none holds, with their lowest point from the west, and the unit with the longest
    border in common, the least id on ties.  With ``outline`` (rings that share their points with the units) also what lies between the units and it.
    """
    borders = P.segments(units, id).withColumn("outer", F.lit(False))
    if outline is not None:
        beyond = P.segments(outline.select(F.lit(None).cast(units.schema[id].dataType).alias(id), "rings"), id).withColumn("forward", ~F.col("forward")).withColumn("outer", F.lit(True))
        borders = borders.unionByName(beyond)
    edges, owners = P.shared_edges(borders)
    # A segment with owners on both sides, be it the outside of the outline, borders no gap.
    open_ = kept(owners.groupBy("eid").agg(F.count(F.lit(1)).alias("n"), F.first("id").alias("owner"), F.first("forward").alias("forward")).where("n % 2 = 1"))
    halves = P.faces(edges.join(open_.select("eid"), "eid"), size)
    held = open_.select((F.col("eid") * 2 + F.when(F.col("forward"), 0).otherwise(1)).alias("id"), "owner")
    taken = halves.join(held, "id", "left_semi").where("face IS NOT NULL").select("face").distinct()
    free = kept(halves.where("face IS NOT NULL").join(taken, "face", "left_anti"))
    length = F.sqrt(F.pow(F.col("dx") - F.col("ox"), 2) + F.pow(F.col("dy") - F.col("oy"), 2))
    near = free.select("face", F.col("id").bitwiseXOR(F.lit(1)).alias("id"), length.alias("len")).join(held, "id").where("owner IS NOT NULL")
    order = Window.partitionBy("face").orderBy(F.desc("shared"), "owner")
    best = near.groupBy("face", "owner").agg(F.round(F.sum("len"), 9).alias("shared")).withColumn("k", F.row_number().over(order)).where("k = 1").select("face", F.col("owner").alias(id), "shared")
    corner = free.groupBy("face").agg(F.min(F.struct("ox", "oy")).alias("p"))
    return P.face_rings(free).join(corner, "face").join(best, "face", "left").select(F.col("face").alias("gap"), "area", F.col("p.ox").alias("x"), F.col("p.oy").alias("y"), id, "shared", "rings")


def filled(units: DataFrame, id: str, size: float = 10.0, outline: DataFrame | None = None) -> DataFrame:
    """(id, rings): the units, and each gap as a further part of the unit that :func:`gaps` names for it."""
    found = gaps(units, id, size, outline)
    return units.select(id, "rings").unionByName(found.where(F.col(id).isNotNull()).select(id, "rings"))


def snapped(points: DataFrame, shapes: DataFrame, point_id: str, shape_id: str, limit: float = 0.25, strict: bool = True, size: float = 10.0) -> DataFrame:
    """(point_id, x, y, distance): points (x, y) inside a shape as they are, others at the nearest place of any border, at most ``limit`` map units away.

    Borders are looked for in tiles as wide as an eighth of the limit, a quarter, a half and the whole, each time for the points for which none has been found, so that points near to a border
    meet few segments; points of one place are looked for once. Ties go to the least place from the west. A point farther away is an error, or, if not ``strict``, has a null place.
    """
    every, point_id, own_id = points.select(point_id, F.col("x").alias("__x"), F.col("y").alias("__y")), "__place", point_id
    at = kept(points.groupBy("x", "y").agg(F.min(own_id).alias(point_id)))
    inside = kept(containers(at, shapes, point_id, shape_id, size).select(point_id).distinct())
    lines = kept(P.segments(shapes, shape_id, 15).select(*P._ENDS).distinct())
    done = at.join(inside, point_id, "left_semi").withColumn("distance", F.lit(0.0))
    left = at.join(inside, point_id, "left_anti")
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - F.col("ax")) * dx + (F.col("y") - F.col("ay")) * dy) / (dx * dx + dy * dy)))
    for part in (8, 4, 2, 1):
        reach = limit / part
        steps = F.array(*[F.lit(d) for d in (-1, 0, 1)])
        cell = lambda c: F.floor(F.col(c) / reach).cast("long")  # noqa: B023, E731
        near = left.withColumn("tx", F.explode(F.transform(steps, lambda d: cell("x") + d))).withColumn("ty", F.explode(F.transform(steps, lambda d: cell("y") + d)))  # noqa: B023
        met = near.join(P.tiled(lines, reach), ["tx", "ty"]).withColumn("t", t)
        met = met.select(point_id, "x", "y", (F.col("ax") + F.col("t") * dx).alias("nx"), (F.col("ay") + F.col("t") * dy).alias("ny"))
        met = met.withColumn("distance", F.sqrt(F.pow(F.col("nx") - F.col("x"), 2) + F.pow(F.col("ny") - F.col("y"), 2))).where(F.col("distance") <= reach)
        best = kept(met.groupBy(point_id).agg(F.min(F.struct(F.round("distance", 12).alias("d"), "nx", "ny", "distance")).alias("b")).select(point_id, F.col("b.nx").alias("x"), F.col("b.ny").alias("y"), "b.distance"))
        done, left = done.unionByName(best), left.join(best.select(point_id), point_id, "left_anti")
    far = F.raise_error(F.concat(F.col(point_id).cast("string"), F.lit(f" is more than {limit:g} away from every shape"))).cast("double") if strict else F.lit(None).cast("double")
    done = done.unionByName(left.select(point_id, far.alias("x"), F.lit(None).cast("double").alias("y"), F.lit(None).cast("double").alias("distance")))
    found = at.select(point_id, F.col("x").alias("__x"), F.col("y").alias("__y")).join(done, point_id)
    return every.alias("every").join(found.alias("found"), F.col("every.__x").eqNullSafe(F.col("found.__x")) & F.col("every.__y").eqNullSafe(F.col("found.__y"))).select(own_id, "x", "y", "distance")
