"""Line work of polygons as a planar graph of half-edges: noding, cycles, faces, rings.

Everything is a relation of segments.  Segments meet in the tiles that they cross, so no task holds a layer or a shape; rings
and faces are found by pointer jumping, in as many rounds as the logarithm of the longest ring, each of which is written to the shared folder.
Coordinates are rounded to ``digits`` decimals, and a point this near to a segment lies on it.

``layer`` keeps line work apart: segments of different layers never meet.  A unit is (id, rings) with the outer ring first; rows that repeat
an id are parts of one unit.  Rings may run either way; empty ones, and segments without length, are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo as G
from ._shared import kept

DIGITS = 9
_ENDS = ["ax", "ay", "bx", "by"]
Line = Column | dict[str, Column]
Let = Callable[[Column, Callable[[Column], Column]], Column]


def segments(units: DataFrame, id: str, digits: int = DIGITS, layer: str | None = None) -> DataFrame:
    """(layer, id, ax, ay, bx, by, forward): border segments, lesser end first; ``forward`` where the unit lies on the left of a to b."""
    rounded = lambda p: F.struct(F.round(p["x"], digits).alias("x"), F.round(p["y"], digits).alias("y"))
    whole = units.select((F.col(layer) if layer else F.lit(0)).alias("layer"), F.col(id).alias("id"), F.posexplode("rings").alias("k", "ring"))
    ring = whole.select("layer", "id", "k", F.transform("ring", rounded).alias("ring")).withColumn("ccw", signed_area(F.col("ring")) > 0)
    pairs = ring.select("layer", "id", (F.col("ccw") == (F.col("k") == 0)).alias("left"), F.explode(G._edges(F.col("ring"))).alias("e")).where("e.a <> e.b")
    up = (F.col("e.a.x") < F.col("e.b.x")) | ((F.col("e.a.x") == F.col("e.b.x")) & (F.col("e.a.y") < F.col("e.b.y")))
    low, high = F.when(up, F.col("e.a")).otherwise(F.col("e.b")), F.when(up, F.col("e.b")).otherwise(F.col("e.a"))
    return pairs.select("layer", "id", low["x"].alias("ax"), low["y"].alias("ay"), high["x"].alias("bx"), high["y"].alias("by"), (up == F.col("left")).alias("forward"))


def signed_area(ring: Column) -> Column:
    """Area of a ring, positive where it runs counter-clockwise; taken about its first point."""
    x0, y0 = ring[0]["x"], ring[0]["y"]
    twice = F.aggregate(G._edges(ring), F.lit(0.0), lambda s, e: s + (e["a"]["x"] - x0) * (e["b"]["y"] - y0) - (e["b"]["x"] - x0) * (e["a"]["y"] - y0))
    return twice / 2.0


def tiled(lines: DataFrame, size: float) -> DataFrame:
    """``lines`` (ax, ay, bx, by with ax <= bx) once for every tile (tx, ty) that each crosses."""
    cell = lambda v: F.floor(v / size).cast("long")
    wide = lines.withColumn("tx", F.explode(F.sequence(cell(F.col("ax")), cell(F.col("bx")))))
    slope = F.when(F.col("bx") > F.col("ax"), (F.col("by") - F.col("ay")) / (F.col("bx") - F.col("ax")))
    west, east = F.greatest(F.col("ax"), F.col("tx") * size), F.least(F.col("bx"), (F.col("tx") + 1) * size)
    one, two = F.coalesce(F.col("ay") + slope * (west - F.col("ax")), F.col("ay")), F.coalesce(F.col("ay") + slope * (east - F.col("ax")), F.col("by"))
    slack = F.lit(size * 1e-9)
    return wide.withColumn("ty", F.explode(F.sequence(cell(F.least(one, two) - slack), cell(F.greatest(one, two) + slack))))


def _on(x: Column, y: Column, s: Line, dx: Column, dy: Column, tolerance: float, let: Let) -> Column:
    """Whether a point lies on the inside of a segment with the extent (dx, dy)."""
    size = F.sqrt(dx * dx + dy * dy)

    def inside(d: Column) -> Column:
        off = F.abs((x - s["ax"]) * dy - (y - s["ay"]) * dx) / d["size"]
        return (off <= tolerance) & (d["t"] * d["size"] > tolerance) & ((1 - d["t"]) * d["size"] > tolerance)

    return let(F.struct((((x - s["ax"]) * dx + (y - s["ay"]) * dy) / (size * size)).alias("t"), size.alias("size")), inside)


def met(p: Line, q: Line, digits: int, let: Let = lambda value, f: f(value)) -> Column:
    """Array of (sid, x, y): inner points of two segments (sid, ax, ay, bx, by) at which they cross or an end of the other lies.

    ``let`` gives a value to a function; where expressions are interpreted, as inside arrays, it should compute the value once.
    """
    tolerance = 10.0**-digits
    wx, wy = q["ax"] - p["ax"], q["ay"] - p["ay"]
    at = lambda s, x, y: F.struct(s["sid"].alias("sid"), x.alias("x"), y.alias("y"))

    def touches(d: Column) -> list[tuple[Line, Column, Column, Column]]:
        """For both ends of each: the other segment, the end, and whether it lies on that segment's inside."""
        ends = [(s, o[f"{end}x"], o[f"{end}y"], d[f"{k}x"], d[f"{k}y"]) for s, o, k in ((p, q, "r"), (q, p, "s")) for end in "ab"]
        return [(s, x, y, _on(x, y, s, dx, dy, tolerance, let)) for s, x, y, dx, dy in ends]

    def crossing(d: Column) -> Column:
        cross = d["cross"]
        parallel = F.abs(cross) <= 1e-12 * F.sqrt((d["rx"] * d["rx"] + d["ry"] * d["ry"]) * (d["sx"] * d["sx"] + d["sy"] * d["sy"]))
        own = lambda c: F.struct(((wx * d["sy"] - wy * d["sx"]) / c).alias("t"), ((wx * d["ry"] - wy * d["rx"]) / c).alias("u"))
        point = lambda t: F.struct(F.round(p["ax"] + t * d["rx"], digits).alias("x"), F.round(p["ay"] + t * d["ry"], digits).alias("y"))
        both = lambda m: F.when(_apart(m["x"], m["y"], (p, q), tolerance), F.array(at(p, m["x"], m["y"]), at(q, m["x"], m["y"])))
        hit = lambda k: F.when((k["t"] > 0) & (k["t"] < 1) & (k["u"] > 0) & (k["u"] < 1), let(point(k["t"]), both))
        return let(own(F.when(~parallel, cross)), hit)

    def found(d: Column) -> Column:
        ends = touches(d)
        flags = F.struct(*[ok.alias(f"on{k}") for k, (_, _, _, ok) in enumerate(ends)])

        def either(on: Column) -> Column:
            touched = on["on0"] | on["on1"] | on["on2"] | on["on3"]
            points = F.array(*[F.when(on[f"on{k}"], at(s, x, y)) for k, (s, x, y, _) in enumerate(ends)])
            none = F.array().cast("array<struct<sid:long,x:double,y:double>>")
            return F.when(touched, F.filter(points, lambda m: m.isNotNull())).otherwise(F.coalesce(crossing(d), none))

        return let(flags, either)

    def extents(rx: Column, ry: Column, sx: Column, sy: Column) -> Column:
        return F.struct(rx.alias("rx"), ry.alias("ry"), sx.alias("sx"), sy.alias("sy"), (rx * sy - ry * sx).alias("cross"))

    return let(extents(*[s[f"b{c}"] - s[f"a{c}"] for s in (p, q) for c in "xy"]), found)


def meetings(lines: DataFrame, size: float, digits: int = DIGITS) -> DataFrame:
    """(sid, x, y): inner points of ``lines`` (layer, sid, ax, ay, bx, by) at which another line of the layer crosses, ends or begins."""
    tiles = tiled(lines, size)
    left, right = (tiles.withColumnsRenamed({c: f"{s}{c}" for c in ("sid", *_ENDS)}) for s in "pq")
    pairs = left.join(right, ["layer", "tx", "ty"]).where("psid < qsid")
    one, two = ({c: F.col(f"{s}{c}") for c in ("sid", *_ENDS)} for s in "pq")
    return pairs.select(F.explode(met(one, two, digits)).alias("m")).select("m.sid", "m.x", "m.y").distinct()


def _apart(x: Column, y: Column, lines: tuple[Line, Line], tolerance: float) -> Column:
    """The point is none of the four ends."""
    far = F.lit(True)
    for s in lines:
        for end in "ab":
            far = far & ((F.abs(x - s[f"{end}x"]) > tolerance) | (F.abs(y - s[f"{end}y"]) > tolerance))
    return far


def noded(borders: DataFrame, size: float, digits: int = DIGITS) -> tuple[DataFrame, DataFrame]:
    """Borders as of :func:`segments`, cut wherever they meet: edges (layer, eid, ax, ay, bx, by), each once, and owners (eid, id, forward)."""
    lines = kept(borders.select("layer", *_ENDS).distinct().withColumn("sid", F.monotonically_increasing_id()))
    ends = lines.select("sid", F.explode(F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))).alias("p")).select("sid", "p.x", "p.y")
    points = ends.unionByName(meetings(lines, size, digits)).distinct()
    order = Window.partitionBy("sid").orderBy("t", "x", "y")
    # Along the line, so that the rounding of a point cannot change the order; the lesser end comes first.
    run = points.join(lines, "sid").withColumn("t", (F.col("x") - F.col("ax")) * (F.col("bx") - F.col("ax")) + (F.col("y") - F.col("ay")) * (F.col("by") - F.col("ay")))
    parts = run.select("layer", "sid", F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(order).alias("x2"), F.lead("y").over(order).alias("y2")).where("x2 IS NOT NULL AND (x1 <> x2 OR y1 <> y2)")
    up = (F.col("x1") < F.col("x2")) | ((F.col("x1") == F.col("x2")) & (F.col("y1") < F.col("y2")))
    pick = lambda a, b: F.when(up, F.col(a)).otherwise(F.col(b))
    parts = kept(parts.select("layer", "sid", pick("x1", "x2").alias("ax"), pick("y1", "y2").alias("ay"), pick("x2", "x1").alias("bx"), pick("y2", "y1").alias("by"), up.alias("same")))
    edges = kept(parts.select("layer", *_ENDS).distinct().withColumn("eid", F.monotonically_increasing_id()))
    of = parts.join(edges, ["layer", *_ENDS]).select("sid", "eid", "same")
    whole = borders.join(lines, ["layer", *_ENDS]).select("sid", "id", "forward")
    return edges, whole.join(of, "sid").select("eid", "id", (F.col("forward") == F.col("same")).alias("forward"))


def shared_edges(borders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As :func:`noded`, of borders that share all their vertices already: a coverage."""
    edges = kept(borders.select("layer", *_ENDS).distinct().withColumn("eid", F.monotonically_increasing_id()))
    return edges, borders.join(edges, ["layer", *_ENDS]).select("eid", "id", "forward")


def half_edges(edges: DataFrame) -> DataFrame:
    """(layer, id, ox, oy, dx, dy, next): both directions of every edge, a to b as 2 eid and b to a as 2 eid + 1; ``next`` follows with the same face on the left."""
    one = edges.select("layer", (F.col("eid") * 2).alias("id"), F.col("ax").alias("ox"), F.col("ay").alias("oy"), F.col("bx").alias("dx"), F.col("by").alias("dy"))
    two = edges.select("layer", (F.col("eid") * 2 + 1).alias("id"), F.col("bx").alias("ox"), F.col("by").alias("oy"), F.col("ax").alias("dx"), F.col("ay").alias("dy"))
    halves = one.unionByName(two)
    around = Window.partitionBy("layer", "ox", "oy").orderBy(F.atan2(F.col("dy") - F.col("oy"), F.col("dx") - F.col("ox")), "id")
    whole = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = halves.select(F.col("id").bitwiseXOR(F.lit(1)).alias("id"), F.coalesce(F.lag("id").over(around), F.last("id").over(whole)).alias("next"))
    return kept(halves.join(before, "id"))


def cycles(links: DataFrame) -> DataFrame:
    """(id, cycle, left) of ``links`` (id, next), a permutation: the least id of the cycle, and the steps from id to that one."""
    now = kept(links.select("id", F.col("next").alias("jump"), F.col("id").alias("cycle")))
    while True:
        far = now.select(F.col("id").alias("jump"), F.col("jump").alias("jump2"), F.col("cycle").alias("cycle2"))
        then = kept(now.join(far, "jump").select("id", F.col("jump2").alias("jump"), F.least("cycle", "cycle2").alias("cycle"), (F.col("cycle2") < F.col("cycle")).alias("moved")))
        now = then.drop("moved")
        if then.where("moved").isEmpty():
            break
    broken = links.join(now.select("id", "cycle"), "id").select("id", F.when(F.col("id") != F.col("cycle"), F.col("next")).alias("next"), "cycle")
    return broken.select("id", "cycle").join(chains(broken.select("id", "next"))[0].select("id", "left"), "id")


def chains(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``links`` (id, next or null): (id, end, left), the last id of each chain and the steps to it; and the (id, next) that run in circles."""
    now = kept(links.select("id", F.col("next").alias("jump"), F.coalesce("next", "id").alias("end"), F.col("next").isNotNull().cast("long").alias("left")))
    open_ = now.where("jump IS NOT NULL").count()
    while open_:
        far = now.select(F.col("id").alias("jump"), F.col("jump").alias("jump2"), F.col("end").alias("end2"), F.col("left").alias("left2"))
        step = now.where("jump IS NOT NULL").join(far, "jump").select("id", F.col("jump2").alias("jump"), F.col("end2").alias("end"), (F.col("left") + F.col("left2")).alias("left"))
        now = kept(now.where("jump IS NULL").unionByName(step))
        before, open_ = open_, now.where("jump IS NOT NULL").count()
        if open_ == before:
            break  # in each round the nearest to an end arrive, so the rest are circles
    return now.where("jump IS NULL").select("id", "end", "left"), links.join(now.where("jump IS NOT NULL").select("id"), "id", "left_semi")


def faces(edges: DataFrame, size: float) -> DataFrame:
    """Half-edges with their cycle and face: (layer, id, ox, oy, dx, dy, cycle, left, area, face).

    ``area`` is the signed area of the cycle; ``face`` the cycle that bounds the face from outside, null for the unbounded one.
    """
    halves = half_edges(edges)
    placed = kept(halves.drop("next").join(cycles(halves.select("id", "next")), "id"))
    turn = F.sum(F.col("ox") * F.col("dy") - F.col("dx") * F.col("oy")) / 2.0
    known = kept(placed.groupBy("layer", "cycle").agg(turn.alias("area"), F.min(F.struct("ox", "oy")).alias("p")))
    inner = known.where("area <= 1e-15")
    parent = _below(inner.select("layer", "cycle", F.col("p.ox").alias("px"), F.col("p.oy").alias("py")), edges, placed, size)
    # A cycle that is not an outer one leads to the cycle above the edge below it, until an outer one is met.
    up = kept(inner.select("cycle").join(parent, "cycle", "left").select("cycle", F.col("parent").alias("up")))
    while True:
        more = up.select(F.col("cycle").alias("up"), F.col("up").alias("up2"), F.lit(True).alias("hit"))
        then = kept(up.join(more, "up", "left").select("cycle", F.when(F.col("hit"), F.col("up2")).otherwise(F.col("up")).alias("up"), F.coalesce("hit", F.lit(False)).alias("hit")))
        up = then.drop("hit")
        if then.where("hit").isEmpty():
            break
    face = known.join(up, "cycle", "left").select("cycle", "area", F.when(F.col("area") > 1e-15, F.col("cycle")).otherwise(F.col("up")).alias("face"))
    return kept(placed.join(face, "cycle"))


def _below(points: DataFrame, edges: DataFrame, halves: DataFrame, size: float) -> DataFrame:
    """(cycle, parent): for each point (layer, cycle, px, py) the cycle on the upper side of the nearest edge straight below it."""
    tiles = kept(tiled(edges, size))
    full = tiles.select("layer", "tx", F.col("ty").alias("row")).distinct()
    cell = lambda c: F.floor(F.col(c) / size).cast("long")
    y = F.when(F.col("bx") > F.col("ax"), F.col("ay") + (F.col("by") - F.col("ay")) * (F.col("px") - F.col("ax")) / (F.col("bx") - F.col("ax")))
    slope = (F.col("by") - F.col("ay")) / F.when(F.col("bx") > F.col("ax"), F.col("bx") - F.col("ax"))

    def best(met: DataFrame) -> DataFrame:
        hits = met.where("ax <= px AND px < bx").withColumn("y", y).where("y < py")
        return hits.groupBy("cycle").agg(F.max(F.struct("y", slope.alias("slope"), "eid")).alias("b")).select("cycle", (F.col("b.eid") * 2).alias("id"))

    # The nearest row of tiles that has lines settles most points; the rest look at all lines below them in their column.
    open_ = points.withColumn("tx", cell("px")).withColumn("ty", cell("py"))
    near = kept(open_.join(full, ["layer", "tx"]).where("row <= ty").groupBy("layer", "cycle", "px", "py", "tx").agg(F.max("row").alias("ty")))
    first = kept(best(near.join(tiles, ["layer", "tx", "ty"]).where(y >= F.col("ty") * size)))
    rest = near.join(first, "cycle", "left_anti").join(tiles.drop("ty").distinct(), ["layer", "tx"])
    found = first.unionByName(best(rest))
    return found.join(halves.select("id", F.col("cycle").alias("parent")), "id").select("cycle", "parent")


def face_rings(halves: DataFrame) -> DataFrame:
    """(face, area, rings) of the bounded faces of :func:`faces`; the outer ring first, holes by their cycle."""
    order = F.array_sort(F.collect_list(F.struct(F.when(F.col("left") == 0, F.lit(0)).otherwise(-F.col("left") + (1 << 62)).alias("k"), F.col("ox").alias("x"), F.col("oy").alias("y"))))
    ring = halves.where("face IS NOT NULL").groupBy("face", "cycle", "area").agg(F.transform(order, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("ring"))
    rings = F.array_sort(F.collect_list(F.struct((F.col("cycle") != F.col("face")).alias("hole"), "cycle", "ring")))
    return ring.groupBy("face").agg(F.sum("area").alias("area"), F.transform(rings, lambda r: r["ring"]).alias("rings"))
