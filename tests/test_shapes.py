import math
import random

import pytest
from pyspark.sql import functions as F

from terraloom.functions import geo as G
from terraloom.operators import clusters as L
from terraloom.operators import coverage as V


@pytest.fixture(scope="module")
def units(spark):
    """An L of three squares of one key around a square of another."""
    rows = [(1, "a", 0.0, 0.0), (2, "a", 1.0, 0.0), (3, "a", 0.0, 1.0), (4, "b", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id int, key string, w double, s double")
    return df.select("id", "key", F.array(G.box_ring(F.col("w"), F.col("s"), F.col("w") + 1, F.col("s") + 1)).alias("rings"))


def test_dissolve_keeps_area_and_drops_inner_borders(units):
    got = {r.key: (r.members, r.area, r.border) for r in V.dissolve(units, "id", "key").collect()}
    assert got == {"a": (3, 3.0, 8.0), "b": (1, 1.0, 4.0)}
    assert V.faults(units, "id").count() == 0


def test_outlines_close(units):
    rings = {r.key: r.rings for r in V.outlines(units, "id", "key").collect()}
    assert len(rings["a"]) == 1 and len(rings["a"][0]) == 8 and len(rings["b"][0]) == 4
    area = lambda ring: abs(sum(p.x * q.y - q.x * p.y for p, q in zip(ring, ring[1:] + ring[:1], strict=True))) / 2
    assert area(rings["a"][0]) == 3.0


def test_adjacency_with_and_without_corners(units):
    assert {(r.src, r.dst): r.shared for r in V.adjacency(units, "id").collect()} == {(a, b): 1.0 for a, b in [(1, 2), (2, 1), (1, 3), (3, 1), (2, 4), (4, 2), (3, 4), (4, 3)]}
    assert V.corner_adjacency(units, "id").count() == 12


def test_simplify_stays_within_the_tolerance(spark):
    circle = [{"x": math.cos(t / 50 * math.pi), "y": math.sin(t / 50 * math.pi)} for t in range(100)]
    df = spark.createDataFrame([([circle],), ([circle[:3]],), (None,)], "rings array<array<struct<x: double, y: double>>>")
    some, few, none = [r.r for r in df.select(V.simplify(F.col("rings"), 0.05).alias("r")).collect()]
    assert 6 <= len(some[0]) < 30 and len(few[0]) == 3 and none is None
    assert all(abs(math.hypot(p.x, p.y) - 1) < 1e-9 for p in some[0])


def test_parts_and_labels(spark):
    big, small = G.box_ring(F.lit(0), F.lit(0), F.lit(2), F.lit(2)), G.box_ring(F.lit(5), F.lit(5), F.lit(5.001), F.lit(5.001))
    shapes = F.array(F.array(small), F.array(big))
    r = spark.range(1).select(F.size(V.drop_small(shapes, 1.0)).alias("n"), V.largest_part(shapes)[0][2]["x"].alias("x"), V.label_point(F.array(big))["x"].alias("lx"), V.points_of(F.array(big)).alias("p")).first()
    assert tuple(r) == (1, 2.0, 1.0, 4)


def test_clusters(spark):
    rng = random.Random(2)
    rows = [(k, 10 + rng.uniform(0, 0.05), 20.0, "x") for k in range(6)] + [(k, 12.0, 20 + 0.01 * (k - 6), "x") for k in range(6, 9)] + [(9, 40.0, 40.0, "x")]
    points = spark.createDataFrame(rows, "id long, lat double, lon double, code string")
    found = L.single_link(points, "id", 50.0, "code")
    assert {r.id: r.cluster for r in found.collect()} == {k: 0 if k < 6 else 6 if k < 9 else 9 for k in range(10)}
    assert sorted(r.id for r in L.clean_clusters(points, found, "id", "code").collect()) == [0, 1, 2, 3, 4, 5, 7, 8]
    assert {r.cluster: r.members for r in L.cluster_stats(points, found, "id").collect()} == {0: 6, 6: 3, 9: 1}
    assert sorted(r.id for r in L.expand_core(points, "id", 5.0, 4, 20.0).collect()) == [0, 1, 2, 3, 4, 5]
    assert L.near_any(points, spark.createDataFrame([(12.0, 20.0)], "rlat double, rlon double"), "id", 1.5).count() == 2


def test_budget_ladder(spark):
    df = spark.createDataFrame([(10.123456, 20.654321)], "lat double, lon double")
    render = lambda t: L.rounded_point(F.col("lat"), F.col("lon"), t)
    assert L.fit_budget(df, render, [1e-6, 1e-3, 1.0], 12) == 1.0
    with pytest.raises(ValueError):
        L.fit_budget(df, render, [1e-6], 3)


def test_labels_as_a_greedy_pass(spark):
    rng = random.Random(11)
    rows = [(k, rng.uniform(-3, 3), rng.uniform(-3, 3), rng.randrange(5), rng.choice([3.5, 4.5])) for k in range(80)]
    got = {r.id: r.zoom for r in L.place_labels(spark.createDataFrame(rows, "id long, lat double, lon double, rank int, min_zoom double"), "id", {3.5: 200.0, 4.5: 90.0}).collect()}

    def km(a, b):
        la, lo, lb, lp = map(math.radians, (a[1], a[2], b[1], b[2]))
        return 2 * 6371.0088 * math.asin(math.sqrt(math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2))

    placed = {}
    for zoom, gap in ((3.5, 200.0), (4.5, 90.0)):
        for r in sorted(rows, key=lambda r: (r[3], r[0])):
            if r[0] not in placed and r[4] <= zoom and all(km(r, rows[o]) > gap for o in placed):
                placed[r[0]] = zoom
    assert got == placed
