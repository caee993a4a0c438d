"""Simplification of coverages by arcs: the borders between junctions, each thinned once for both of its sides.

Points where other than two borders meet, and one point of every ring without such a point, are junctions and stay.  Arcs are found by pointer
jumping over half-edges.  Every inner point of an arc gets the area of the triangle at which it would be taken away if the least were
always taken next (never less than what went before), so one table of weights serves every tolerance and every size.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import planar as P
from ._shared import kept

_INF = float("inf")


def arcs(units: DataFrame, id: str, digits: int = P.DIGITS) -> DataFrame:
    """(arc, points, closed): each border between two junctions once, its points in order."""
    edges, _ = P.shared_edges(P.segments(units, id, digits))
    one = edges.select((F.col("eid") * 2).alias("id"), F.col("ax").alias("ox"), F.col("ay").alias("oy"), F.col("bx").alias("dx"), F.col("by").alias("dy"))
    two = edges.select((F.col("eid") * 2 + 1).alias("id"), F.col("bx").alias("ox"), F.col("by").alias("oy"), F.col("ax").alias("dx"), F.col("ay").alias("dy"))
    halves = kept(one.unionByName(two))
    here = halves.groupBy("ox", "oy").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("both")).select(F.col("ox").alias("dx"), F.col("oy").alias("dy"), "n", "both")
    follow = F.when(F.col("n") == 2, F.col("both") - F.col("id").bitwiseXOR(F.lit(1)))
    links = kept(halves.join(here, ["dx", "dy"]).select("id", follow.alias("next")))
    ended, circles = P.chains(links)
    circles = kept(circles)
    if not circles.isEmpty():
        turn = P.cycles(circles).select("id", "cycle")
        placed = halves.join(turn, "id")
        first = placed.groupBy("cycle").agg(F.min(F.struct("dx", "dy")).alias("p"))
        opened = placed.join(first, "cycle").join(circles, "id").select("id", F.when((F.col("dx") != F.col("p.dx")) | (F.col("dy") != F.col("p.dy")), F.col("next")).alias("next"))
        ended = ended.unionByName(P.chains(kept(opened))[0])
    ended = kept(ended)
    # The other direction of a chain ends with the twin of its first half-edge: of both the one with the lesser end is kept.
    ruled = ended.groupBy("end").agg(F.max_by("id", "left").alias("first")).where(F.col("end") < F.col("first").bitwiseXOR(F.lit(1))).select("end")
    order = F.array_sort(F.collect_list(F.struct((-F.col("left")).alias("k"), "ox", "oy", "dx", "dy")))
    rows = ended.join(ruled, "end").join(halves, "id").groupBy(F.col("end").alias("arc")).agg(order.alias("run"))
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    last = F.element_at("run", -1)
    points = F.concat(F.transform("run", lambda r: point(r["ox"], r["oy"])), F.array(point(last["dx"], last["dy"])))
    return rows.select("arc", points.alias("points")).withColumn("closed", F.col("points")[0] == F.element_at("points", -1))


def effective_areas(points: np.ndarray) -> np.ndarray:
    """Weight of every point of a line: infinite at its ends, else the running maximum of the least triangles taken away."""
    n = len(points)
    out = np.full(n, _INF)
    if n < 3:
        return out
    before, after = np.arange(n) - 1, np.arange(n) + 1
    xs, ys = points[:, 0].tolist(), points[:, 1].tolist()

    def area(i: int) -> float:
        a, b = int(before[i]), int(after[i])
        return abs((xs[i] - xs[a]) * (ys[b] - ys[a]) - (xs[b] - xs[a]) * (ys[i] - ys[a])) / 2.0

    now = [area(i) if 0 < i < n - 1 else _INF for i in range(n)]
    heap = [(now[i], i) for i in range(1, n - 1)]
    heapq.heapify(heap)
    gone, most = np.zeros(n, bool), 0.0
    while heap:
        size, i = heapq.heappop(heap)
        if gone[i] or size != now[i]:
            continue
        most = max(most, size)
        out[i], gone[i] = most, True
        a, b = int(before[i]), int(after[i])
        after[a], before[b] = b, a
        for k in (a, b):
            if 0 < k < n - 1:
                now[k] = area(k)
                heapq.heappush(heap, (now[k], k))
    return out


def weights(units: DataFrame, id: str, digits: int = P.DIGITS) -> DataFrame:
    """(arc, pos, x, y, weight) of every point of every arc.

    So that no shape vanishes, a ring keeps two points besides its first, and of several arcs between the same two junctions all but the one with fewest points keep their heaviest.
    """
    found = kept(arcs(units, id, digits))
    ends = F.array_sort(F.array(F.col("points")[0], F.element_at("points", -1)))
    rank = F.row_number().over(Window.partitionBy("ends").orderBy(F.size("points"), "arc"))
    needed = F.when(F.col("closed"), 2).when(rank > 1, 1).otherwise(0)
    asked = found.withColumn("ends", ends).select("arc", "points", needed.alias("least"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for arc, points, least in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                p = np.array([(q["x"], q["y"]) for q in points])
                w = effective_areas(p)
                inner = np.argsort(-w[1:-1], kind="stable")[:least] + 1
                w[inner] = _INF
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), arc)), pa.array(np.arange(len(p))), pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(w)], ["arc", "pos", "x", "y", "weight"])

    return kept(asked.mapInArrow(run, "arc long, pos long, x double, y double, weight double"))


def thinned(units: DataFrame, id: str, weight: DataFrame, least: float, size: float = 10.0, digits: int = P.DIGITS) -> DataFrame:
    """(id, rings): the units with the points whose weight is above ``least``.

    Arcs that would then cross or touch another are given all their points back, until none does; so neighbours keep equal borders and nothing new overlaps.
    """
    whole = weight.select("arc").limit(0)
    while True:
        now = weight.join(whole.withColumn("full", F.lit(True)), "arc", "left").withColumn("full", F.coalesce("full", F.lit(False)))
        stay = kept(now.where((F.col("weight") > least) | F.col("full")).select("arc", "pos", "x", "y", "full"))
        order = Window.partitionBy("arc").orderBy("pos")
        pairs = stay.select("arc", "full", F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(order).alias("x2"), F.lead("y").over(order).alias("y2")).where("x2 IS NOT NULL")
        up = (F.col("x1") < F.col("x2")) | ((F.col("x1") == F.col("x2")) & (F.col("y1") < F.col("y2")))
        pick = lambda a, b: F.when(up, F.col(a)).otherwise(F.col(b))
        lines = kept(pairs.select(F.lit(0).alias("layer"), "arc", "full", pick("x1", "x2").alias("ax"), pick("y1", "y2").alias("ay"), pick("x2", "x1").alias("bx"), pick("y2", "y1").alias("by")).withColumn("sid", F.monotonically_increasing_id()))
        met = P.meetings(lines.drop("arc", "full"), size, digits).select("sid").distinct().join(lines, "sid")
        twice = lines.join(lines.groupBy(*P._ENDS).count().where("count > 1").select(*P._ENDS), P._ENDS)
        bad = kept(met.select("arc", "full").unionByName(twice.select("arc", "full")).where("NOT full").select("arc").distinct())
        if bad.isEmpty():
            break
        whole = kept(whole.unionByName(bad))
    stays = stay.select("x", "y").distinct()
    rounded = lambda p: F.struct(F.round(p["x"], digits).alias("x"), F.round(p["y"], digits).alias("y"))
    # Rows of one id are parts; a part is named by its rings, so that equal points of parts stay apart.
    wide = units.select(id, F.monotonically_increasing_id().alias("part"), F.posexplode("rings").alias("ring", "points"))
    flat = kept(wide.select(id, "part", "ring", F.posexplode(F.transform("points", rounded)).alias("pos", "p")).select(id, "part", "ring", "pos", "p.x", "p.y"))
    ring = flat.join(stays, ["x", "y"]).groupBy(id, "part", "ring").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points"))
    return ring.groupBy(id, "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("ring", "points"))), lambda r: r["points"]).alias("rings")).drop("part")


def budget_weight(units: DataFrame, weight: DataFrame, budget: int, each: int = 40, fixed: int = 0) -> float:
    """The least weight above which points fit a budget of bytes: ``each`` for a point of a ring, ``fixed`` for every unit row.

    Points count as often as rings hold them.  Found from the histogram of weights, ordered by ranges over the whole table; nothing is written out to be measured.
    """
    point = units.select(F.explode(F.flatten("rings")).alias("p")).select(F.round("p.x", P.DIGITS).alias("x"), F.round("p.y", P.DIGITS).alias("y"))
    by_point = weight.groupBy("x", "y").agg(F.max("weight").alias("weight"))
    counts = kept(point.join(by_point, ["x", "y"]).groupBy("weight").agg(F.count(F.lit(1)).alias("n")))
    allowed = (budget - fixed * units.count()) // each
    # Sums by range of weights first, then inside the one range in which the budget ends.
    dealt = kept(counts.repartitionByRange(F.desc("weight")).withColumn("part", F.spark_partition_id()))
    before = 0
    for part, n in sorted((r["part"], r["n"]) for r in dealt.groupBy("part").agg(F.sum("n").alias("n")).collect()):
        if before + n > allowed:
            run = F.sum("n").over(Window.orderBy(F.desc("weight"))) + before
            over = dealt.where(F.col("part") == part).withColumn("run", run).where(F.col("run") > allowed).agg(F.max("weight")).first()[0]
            if over == _INF:
                raise ValueError("the points that must stay do not fit the budget")
            return over
        before += n
    return -1.0
