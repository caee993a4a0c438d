"""Polygon coverages (units that share their borders vertex by vertex), as relations of directed edges.

A unit is (id, rings): rings of structs (x, y), the outer one first.  Every border segment becomes one row, so dissolving,
adjacency and checks are group-bys that scale with the number of segments, not overlays of pairs of shapes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions import geo as G

POINT = StructType([StructField("x", DoubleType()), StructField("y", DoubleType())])


def edges(units: DataFrame, id: str, digits: int = 9) -> DataFrame:
    """(id, ax, ay, bx, by, forward): border segments with their lesser end first; ``forward`` says whether the ring runs that way."""
    rounded = lambda p: F.struct(F.round(p["x"], digits).alias("x"), F.round(p["y"], digits).alias("y"))
    ring = units.select(id, F.explode("rings").alias("ring")).select(id, F.transform("ring", rounded).alias("ring"))
    pairs = ring.select(id, F.explode(G._edges(F.col("ring"))).alias("e")).where("e.a <> e.b")
    forward = (F.col("e.a.x") < F.col("e.b.x")) | ((F.col("e.a.x") == F.col("e.b.x")) & (F.col("e.a.y") < F.col("e.b.y")))
    low, high = F.when(forward, F.col("e.a")).otherwise(F.col("e.b")), F.when(forward, F.col("e.b")).otherwise(F.col("e.a"))
    return pairs.select(id, low["x"].alias("ax"), low["y"].alias("ay"), high["x"].alias("bx"), high["y"].alias("by"), forward.alias("forward"))


_KEY = ["ax", "ay", "bx", "by"]


def _length() -> Column:
    return F.sqrt(F.pow(F.col("bx") - F.col("ax"), 2) + F.pow(F.col("by") - F.col("ay"), 2))


def adjacency(units: DataFrame, id: str) -> DataFrame:
    """(src, dst, shared): length of border in common, both directions; units that only touch at corners are not adjacent."""
    e = edges(units, id)
    a, b = e.select(F.col(id).alias("src"), *_KEY), e.select(F.col(id).alias("dst"), *_KEY)
    return a.join(b, _KEY).where("src <> dst").withColumn("len", _length()).groupBy("src", "dst").agg(F.sum("len").alias("shared"))


def corner_adjacency(units: DataFrame, id: str, digits: int = 9) -> DataFrame:
    """(src, dst) of units that share a vertex at least, both directions."""
    points = units.select(id, F.explode(F.flatten("rings")).alias("p")).select(id, F.round("p.x", digits).alias("x"), F.round("p.y", digits).alias("y")).distinct()
    return points.withColumnRenamed(id, "src").join(points.withColumnRenamed(id, "dst"), ["x", "y"]).where("src <> dst").select("src", "dst").distinct()


def border_edges(units: DataFrame, id: str, key: str) -> DataFrame:
    """Segments (key, ax, ay, bx, by) left after dissolving by ``key``: those that a group has once."""
    e = edges(units, id).join(units.select(id, key), id)
    return e.groupBy(key, *_KEY).agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1").drop("n")


def dissolve(units: DataFrame, id: str, key: str) -> DataFrame:
    """(key, members, area, border): summed area of the group's units and length of its outline."""
    border = border_edges(units, id, key).groupBy(key).agg(F.sum(_length()).alias("border"))
    outer = G.ring_area(F.col("rings")[0])
    holes = F.aggregate(F.transform(F.slice("rings", F.lit(2), F.size("rings")), G.ring_area), F.lit(0.0), lambda s, x: s + x)
    areas = units.groupBy(key).agg(F.count(F.lit(1)).alias("members"), F.sum(outer - holes).alias("area"))
    return areas.join(border, key)


def outlines(units: DataFrame, id: str, key: str) -> DataFrame:
    """(key, rings): the outline of each group, stitched from its border segments. One group's border is held at a time."""
    border = border_edges(units, id, key)
    kind = units.schema[key].dataType.simpleString()

    def stitch(rows: list[tuple]) -> list[list[dict]]:
        ends: dict[tuple, list[int]] = {}
        for k, (a, b) in enumerate(rows):
            ends.setdefault(a, []).append(k)
            ends.setdefault(b, []).append(k)
        used, rings = [False] * len(rows), []
        for k in range(len(rows)):
            if used[k]:
                continue
            ring, here = [rows[k][0]], rows[k][1]
            used[k] = True
            while here != ring[0]:
                ring.append(here)
                follow = [j for j in ends[here] if not used[j]]
                if not follow:
                    raise ValueError(f"the border is open at {here}")
                j = follow[0]
                used[j] = True
                here = rows[j][1] if rows[j][0] == here else rows[j][0]
            rings.append([{"x": x, "y": y} for x, y in ring])
        return rings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, some = None, [], False
        shape = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for k, ax, ay, bx, by in zip(*columns, strict=True):
                if some and k != now:
                    yield pa.RecordBatch.from_arrays([pa.array([now], batch.schema.field(0).type), pa.array([stitch(rows)], shape)], ["key", "rings"])
                    rows = []
                now, some = k, True
                rows.append(((ax, ay), (bx, by)))
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([now], batch.schema.field(0).type), pa.array([stitch(rows)], shape)], ["key", "rings"])

    ordered = border.select(key, *_KEY).repartition(key).sortWithinPartitions(key, *_KEY)
    return ordered.mapInArrow(run, f"key {kind}, rings array<array<struct<x: double, y: double>>>").withColumnRenamed("key", key)


def faults(units: DataFrame, id: str) -> DataFrame:
    """Segments that more than two units have (overlap), or two run through the same way (one lies on the other)."""
    e = edges(units, id).groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("forward").cast("int")).alias("forward"))
    return e.where("n > 2 OR (n = 2 AND forward <> 1)")


def carve(area: Column, parts: Column) -> Column:
    """Area of a parent without its parts; an error where these are as large as it."""
    return F.when(area - parts > 0, area - parts).otherwise(F.raise_error(F.lit("nothing is left of the parent")).cast("double"))


def _simplified(ring: list, tolerance: float) -> list:
    """Douglas-Peucker between the two points farthest apart along the ring; fewer than three points left gives the ring back."""
    p = np.array([(q["x"], q["y"]) for q in ring])
    if len(p) > 1 and (p[0] == p[-1]).all():
        p = p[:-1]
    if len(p) < 4:
        return [{"x": float(x), "y": float(y)} for x, y in p]
    far = int(np.argmax(((p - p[0]) ** 2).sum(axis=1)))
    closed = np.concatenate([p, p[:1]])
    keep = np.zeros(len(closed), bool)
    keep[[0, far, len(p)]] = True
    todo = [(0, far), (far, len(p))]
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        a, b, mid = closed[i], closed[j], closed[i + 1 : j]
        d = b - a
        size = np.hypot(*d)
        off = np.abs(d[0] * (mid[:, 1] - a[1]) - d[1] * (mid[:, 0] - a[0])) / size if size else np.hypot(*(mid - a).T)
        k = int(np.argmax(off))
        if off[k] > tolerance:
            keep[i + 1 + k] = True
            todo += [(i, i + 1 + k), (i + 1 + k, j)]
    out = closed[:-1][keep[:-1]]
    out = out if len(out) >= 3 else p
    return [{"x": float(x), "y": float(y)} for x, y in out]


def simplify(rings: Column, tolerance: float) -> Column:
    """Rings with fewer points, each within the tolerance of the old line."""

    @F.pandas_udf(ArrayType(ArrayType(POINT)))
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda rs: None if rs is None else [_simplified(r, tolerance) for r in rs])

    return run(rings)


def points_of(rings: Column) -> Column:
    """Number of points of a shape."""
    return F.aggregate(rings, F.lit(0), lambda n, r: n + F.size(r))


def drop_small(shapes: Column, least_km2: float) -> Column:
    """Parts (each a list of rings) of at least an area; the largest stays in any case."""
    areas = F.transform(shapes, lambda part: G.ring_area_km2(part[0]))
    return F.filter(shapes, lambda part: (G.ring_area_km2(part[0]) >= least_km2) | (G.ring_area_km2(part[0]) >= F.array_max(areas)))


def largest_part(shapes: Column) -> Column:
    return F.array_max(F.transform(shapes, lambda part: F.struct(G.ring_area(part[0]).alias("area"), part.alias("part"))))["part"]


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.transform(F.array(value), f)[0]


def _stretch(rings: Column, part: Column) -> Column:
    """The widest stretch (width, x, y) that the shape covers on the horizontal line a part of its height above its south end."""

    def cuts(ring: Column, y: Column) -> Column:
        hit = F.filter(G._edges(ring), lambda e: (e["a"]["y"] > y) != (e["b"]["y"] > y))
        return F.transform(hit, lambda e: e["a"]["x"] + (y - e["a"]["y"]) * (e["b"]["x"] - e["a"]["x"]) / (e["b"]["y"] - e["a"]["y"]))

    def widest(xs: Column, y: Column) -> Column:
        ends = F.sequence(F.lit(1), F.greatest(F.floor(F.size(xs) / 2), F.lit(1)).cast("int"))
        at = lambda k: F.try_element_at(xs, k)
        spans = F.transform(ends, lambda k: F.struct((at(2 * k) - at(2 * k - 1)).alias("width"), ((at(2 * k) + at(2 * k - 1)) / 2).alias("x"), y.alias("y")))
        return F.array_max(spans)

    ys = F.transform(rings[0], lambda p: p["y"])
    level = _let(ys, lambda v: F.array_min(v) + (F.array_max(v) - F.array_min(v)) * (part + 1e-6))
    return _let(level, lambda y: _let(F.array_sort(F.flatten(F.transform(rings, lambda r: cuts(r, y)))), lambda xs: widest(xs, y)))


def label_point(rings: Column) -> Column:
    """A point inside: the middle of the widest stretch that the shape covers on the horizontal line through its middle."""
    return _let(_stretch(rings, F.lit(0.5)), lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y")))


def interior_point(rings: Column) -> Column:
    """As :func:`label_point`; where the shape is too thin there, on the lines at a quarter, three quarters, an eighth and so on; null for a shape without width."""
    box = G.ring_bounds(rings[0])
    least = F.greatest(box["east"] - box["west"], box["north"] - box["south"]) * 1e-7
    tried = F.transform(F.array(*[F.lit(k) for k in (0.5, 0.25, 0.75, 0.125, 0.375, 0.625, 0.875)]), lambda k: _stretch(rings, k))
    middle = _stretch(rings, F.lit(0.5))

    def best(least: Column, all_: Column) -> Column:
        wide = F.filter(all_, lambda s: s["width"] > least)
        return F.coalesce(F.try_element_at(wide, F.lit(1)), F.array_max(F.filter(all_, lambda s: s["width"] > 0)))

    # The other lines are looked at only where the middle one is too thin.
    found = _let(least, lambda m: _let(middle, lambda s: F.when(s["width"] > m, s).otherwise(_let(tried, lambda t: best(m, t)))))
    return _let(found, lambda s: F.when(s.isNotNull(), F.struct(s["x"].alias("x"), s["y"].alias("y"))))


def svg_path(rings: Column, size: float = 100.0) -> Column:
    """Path data of a silhouette, scaled to a square with north up; coordinates have one decimal."""
    box = G.ring_bounds(rings[0])
    scale = F.lit(size) / F.greatest(box["east"] - box["west"], box["north"] - box["south"], F.lit(1e-12))
    at = lambda p: F.format_string("%.1f %.1f", (p["x"] - box["west"]) * scale, (box["north"] - p["y"]) * scale)
    return F.array_join(F.transform(rings, lambda r: F.concat(F.lit("M"), F.array_join(F.transform(r, at), "L"), F.lit("Z"))), "")
