"""Overlays against plain versions that cut the plane into slabs between all corners and crossings."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from terraloom.functions import geo as G
from terraloom.operators import coverage as V
from terraloom.operators import overlay as O
from terraloom.operators import planar as P
from terraloom.operators import rowwork as R
from terraloom.operators import thinning as T

SHAPES = "id long, rings array<array<struct<x: double, y: double>>>"


def made(spark, rows):
    return spark.createDataFrame([(i, [[(float(x), float(y)) for x, y in r] for r in rings]) for i, rings in rows], SHAPES)


def star(rng, cx, cy, size, n):
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    reach = [size * rng.uniform(0.3, 1) for _ in turns]
    return [(round(cx + r * math.cos(t), 6), round(cy + r * math.sin(t), 6)) for t, r in zip(turns, reach, strict=True)]


def box(w, s, e, n):
    return [(w, s), (e, s), (e, n), (w, n)]


def edges(rings):
    return [(a, b) for r in rings for a, b in zip(r, r[1:] + r[:1], strict=True)]


def spans(rings, x):
    ys = sorted(a[1] + (x - a[0]) * (b[1] - a[1]) / (b[0] - a[0]) for a, b in edges(rings) if (a[0] > x) != (b[0] > x))
    return list(zip(ys[::2], ys[1::2], strict=True))


def slabs(shapes):
    lines = [e for rings in shapes for e in edges(rings)]
    xs = {p[0] for e in lines for p in e}
    for (a, b), (c, d) in itertools.combinations(lines, 2):
        cross = (b[0] - a[0]) * (d[1] - c[1]) - (b[1] - a[1]) * (d[0] - c[0])
        if cross:
            t = ((c[0] - a[0]) * (d[1] - c[1]) - (c[1] - a[1]) * (d[0] - c[0])) / cross
            if 0 <= t <= 1:
                xs.add(a[0] + t * (b[0] - a[0]))
    xs = sorted(xs)
    return [((a + b) / 2, b - a) for a, b in itertools.pairwise(xs) if b - a > 1e-12]


def plain_covers(shapes):
    """{ids that cover it: area} of the pieces of the plane."""
    out = {}
    for x, w in slabs([r for _, r in shapes]):
        own = {i: spans(r, x) for i, r in shapes}
        ys = sorted({y for s in own.values() for p in s for y in p})
        for lo, hi in itertools.pairwise(ys):
            ids = tuple(sorted(i for i, s in own.items() if any(p <= (lo + hi) / 2 <= q for p, q in s)))
            if ids:
                out[ids] = out.get(ids, 0) + (hi - lo) * w
    return {k: v for k, v in out.items() if v > 1e-9}


@pytest.fixture(scope="module")
def shapes():
    rng = random.Random(4)
    left = [(k, [star(rng, rng.uniform(0, 6), rng.uniform(0, 6), rng.uniform(1, 3), rng.randrange(3, 12))]) for k in range(7)]
    left.append((7, [box(1, 1, 5, 5), box(2, 2, 4, 4)]))  # a hole
    left.append((8, [box(2.5, 2.5, 3.5, 3.5)]))  # an island in it
    return left


def shared(covers, a, b):
    return sum(v for k, v in covers.items() if a in k and b in k)


def test_overlap_areas(spark, shapes):
    covers = plain_covers(shapes)
    df = made(spark, shapes)
    got = {(r.a, r.b): r for r in O.overlap_areas(df.withColumnRenamed("id", "a"), df.withColumnRenamed("id", "b"), "a", "b", 1.7).collect()}
    want = {(a, b): shared(covers, a, b) for a in range(9) for b in range(9)}
    assert set(got) == {k for k, v in want.items() if v > 1e-9}
    assert all(abs(r.area - want[k]) < 1e-9 and abs(r.left_area - want[k[0], k[0]]) < 1e-9 for k, r in got.items())
    assert want[7, 7] == pytest.approx(12) and want[8, 8] == pytest.approx(1)


@pytest.mark.parametrize("size", [1.3])
def test_atomic_cells(spark, shapes, size):
    covers = plain_covers(shapes)
    cells = O.atomic_cells(made(spark, shapes), "id", size).collect()
    got = {}
    for c in cells:
        got[tuple(c.members)] = got.get(tuple(c.members), 0) + c.area
        assert abs(sum(s[1] - s[0] for x, w in [slabs([[[(p.x, p.y) for p in r] for r in c.rings]])[0]] for s in spans([[(p.x, p.y) for p in r] for r in c.rings], x))) > 0
    got = {k: v for k, v in got.items() if v > 1e-8}
    assert set(got) == {k for k, v in covers.items() if v > 1e-8}
    assert all(abs(got[k] - covers[k]) < 1e-6 for k in got)


def test_carved_and_parents(spark):
    parents = made(spark, [(10, [box(0, 0, 10, 10), box(4, 4, 6, 6)]), (11, [box(10, 0, 20, 10)]), (12, [box(15, 0, 25, 10)])])
    children = made(spark, [(1, [box(1, 1, 2, 2)]), (2, [box(4, 4, 6.5, 6)]), (3, [box(14, 1, 18, 2)]), (4, [box(50, 50, 51, 51)])])
    got = {r.id: (r.parent, r.how, r.percent and round(r.percent, 6)) for r in O.parents(children, parents.withColumnRenamed("id", "parent"), "id", "parent").collect()}
    assert got == {1: (10, "point", None), 2: (10, "overlap", 20.0), 3: (11, "overlap", 100.0), 4: (None, "none", None)}
    sole = O.parents(children.where("id = 1"), parents.withColumnRenamed("id", "parent"), "id", "parent", strict=True)
    assert [r.parent for r in sole.collect()] == [10]
    for bad in ("id = 3", "id = 4"):
        with pytest.raises(Exception, match="parent"):
            O.parents(children.where(bad), parents.withColumnRenamed("id", "parent"), "id", "parent", strict=True).collect()
    parts = children.withColumnRenamed("id", "part")
    assert {r.id: round(r.left, 9) for r in O.carved(parents, parts.where("part < 3"), "id", "part").collect()} == {10: 94.0, 11: 100.0, 12: 100.0}
    with pytest.raises(Exception, match="nothing is left"):
        O.carved(children, parents.withColumnRenamed("id", "part").where("part = 10"), "id", "part").collect()


def test_regions_have_holes_and_islands(spark):
    rows = [(10 * x + y, [box(x, y, x + 1, y + 1)]) for x in range(5) for y in range(5)]
    units = made(spark, rows).withColumn("key", F.when(F.col("id").isin(11, 12, 13, 21, 23, 31, 32, 33), "ring").when(F.col("id") == 22, "core").otherwise("rest"))
    got = {r.key: r for r in O.regions(units, "id", "key", 2.0).collect()}
    assert {k: (r.area, len(r.rings), sorted(len(x) for x in r.rings)) for k, r in got.items()} == {"rest": (16.0, 2, [12, 20]), "ring": (8.0, 2, [4, 12]), "core": (1.0, 1, [4])}
    alone = made(spark, rows[:1]).withColumn("key", F.lit("a"))
    assert O.regions(alone, "id", "key").first().area == 1.0
    assert O.regions(units.limit(0), "id", "key").count() == 0


def test_validity_and_repair(spark):
    bow, spike, doubled = [(0, 0), (2, 2), (2, 0), (0, 2)], [(0, 0), (4, 0), (4, 3), (4, 0), (4, -2), (0, -2)], [(0, 0), (1, 0), (1, 1), (0, 1)]
    df = made(spark, [(1, [bow]), (2, [spike]), (3, [doubled]), (4, [[(0, 0), (1, 1)]]), (5, [box(0, 0, 4, 4), box(1, 1, 2, 2)])])
    assert {r.id: (r.crossings, r.doubled, r.short, r.valid) for r in O.validity(df, "id", 1.5).collect()} == {
        1: (1, 0, 0, False), 2: (0, 1, 0, False), 3: (0, 0, 0, True), 4: (0, 1, 1, False), 5: (0, 0, 0, True),
    }
    parts = {}
    for r in O.repaired(df, "id", 1.5).collect():
        parts.setdefault(r.id, []).append((round(r.area, 9), len(r.rings)))
    assert {k: sorted(v) for k, v in parts.items()} == {1: [(1.0, 1), (1.0, 1)], 2: [(8.0, 1)], 3: [(1.0, 1)], 5: [(15.0, 2)]}
    again = O.repaired(df, "id", 1.5).select(F.col("part").alias("id"), "rings")
    assert O.validity(again, "id").where("NOT valid").count() == 0


@pytest.fixture(scope="module")
def tangled():
    """Rings at random on a coarse grid, which cross, touch, repeat lines, lie in each other and come in several parts; some without area."""
    rng = random.Random(19)
    at = lambda n: [(rng.randrange(-3, 4), rng.randrange(-3, 4)) for _ in range(n)]
    fine = lambda n: [(rng.uniform(-3, 3), rng.uniform(-3, 3)) for _ in range(n)]
    rows = [(k, [(at if k % 3 else fine)(rng.randrange(2, 8)) for _ in range(rng.randrange(1, 4))]) for k in range(60)]
    rows += [(k, [at(4)]) for k in range(0, 60, 7)]
    nested = [box(-9 + k, -9 + k, 9 - k, 9 - k) for k in range(7)]
    return [*rows, (60, nested), (61, [box(0, 0, 1, 1)] * 2), (62, [box(0, 0, 2, 2), box(3, 0, 5, 2), box(0.5, 0.5, 1, 1)])]


def test_small_shapes_in_rows_are_as_by_tiles(spark, tangled, monkeypatch):
    df = made(spark, tangled)

    def told():
        faults = {r.id: (r.crossings, r.doubled, r.short, r.valid) for r in O.validity(df, "id", 1.5).collect()}
        parts, seen = {}, set()
        for r in O.repaired(df, "id", 1.5).collect():
            rings = [[(round(p.x, 7), round(p.y, 7)) for p in ring] for ring in r.rings]
            turned = sorted(ring[ring.index(min(ring)) :] + ring[: ring.index(min(ring))] if ring.count(min(ring)) == 1 else sorted(ring) for ring in rings)
            parts.setdefault(r.id, []).append((round(r.area, 7), turned))
            seen.add(r.part)
        assert len(seen) == sum(map(len, parts.values()))
        return faults, {k: sorted(v) for k, v in parts.items()}

    in_rows = told()
    monkeypatch.setattr(R, "SEGMENTS", 0)
    by_tiles = told()
    monkeypatch.setattr(R, "SEGMENTS", 10)
    assert in_rows[0] == by_tiles[0] and in_rows[1] == by_tiles[1]
    assert told() == in_rows
    assert sum(not v[3] for v in in_rows[0].values()) > 40 and len(in_rows[1][60]) == 4
    for i, parts in in_rows[1].items():
        rings = [r for k, rings in tangled if k == i for r in rings]
        plain = sum(w * sum(hi - lo for lo, hi in spans(rings, x)) for x, w in slabs([rings]))
        assert sum(a for a, _ in parts) == pytest.approx(plain, abs=1e-6)


def test_repair_of_small_shapes_takes_no_rounds(spark, tangled, monkeypatch):
    """Each round is a table written and read again; small shapes need the list of large ones and their result."""
    written = []
    for module in (O, P):
        monkeypatch.setattr(module, "kept", lambda df, kept=module.kept: written.append(1) or kept(df))
    df = made(spark, tangled)
    assert O.repaired(df, "id", 1.5).count() > 60 and O.validity(df, "id", 1.5).count() == 63
    assert len(written) <= 3


def test_simplified_valid_takes_the_first_that_is_valid(spark):
    notch = [(0, 0), (10, 0), (10, 10), (5.2, 10), (5, 0.5), (4.8, 10), (0, 10)]
    df = made(spark, [(1, [notch]), (2, [box(0, 0, 1, 1)])])
    got = {r.id: r.tolerance for r in O.simplified_valid(df, "id", [20.0, 0.01]).collect()}
    assert got[1] in (20.0, 0.01) and got[2] == 20.0
    assert {r.id: r.tolerance for r in O.simplified_valid(made(spark, [(1, [[(0, 0), (2, 2), (2, 0), (0, 2)]])]), "id", [0.1]).collect()} == {1: None}


def test_gaps_come_back_whole(spark):
    holes = {11, 12, 22, 44}
    rows = [(10 * x + y, [box(x, y, x + 1, y + 1)]) for x in range(6) for y in range(6) if 10 * x + y not in holes and 10 * x + y != 3]
    units = made(spark, rows)
    got = sorted((r.x, r.y, r.area, r.id, r.shared) for r in O.gaps(units, "id", 2.5).collect())
    assert got == [(1.0, 1.0, 3.0, 21, 2.0), (4.0, 4.0, 1.0, 34, 1.0)]
    whole = O.filled(units, "id", 2.5)
    assert V.faults(whole, "id").count() == 0 and O.gaps(whole, "id").count() == 0
    outline = made(spark, [(0, [[(x, 0) for x in range(6)] + [(6, y) for y in range(6)] + [(x, 6) for x in range(6, 0, -1)] + [(0, y) for y in range(6, 0, -1)]])]).select("rings")
    assert sorted((r.x, r.y, r.id) for r in O.gaps(units, "id", 2.5, outline).collect()) == [(0.0, 3.0, 2), (1.0, 1.0, 21), (4.0, 4.0, 34)]


def wavy(rng, cols, rows, steps):
    """A coverage of quadrilaterals whose shared sides are jagged lines."""
    corner = {(i, j): (i * 10 + rng.uniform(-2, 2), j * 10 + rng.uniform(-2, 2)) for i in range(cols + 1) for j in range(rows + 1)}
    sides = {}

    def side(a, b):
        if (b, a) in sides:
            return sides[b, a][::-1]
        if (a, b) not in sides:
            p, q = corner[a], corner[b]
            sides[a, b] = [p, *[(p[0] + (q[0] - p[0]) * k / steps + rng.uniform(-0.3, 0.3), p[1] + (q[1] - p[1]) * k / steps + rng.uniform(-0.3, 0.3)) for k in range(1, steps)], q]
        return sides[a, b]

    out = []
    for i in range(cols):
        for j in range(rows):
            loop = [(i, j), (i + 1, j), (i + 1, j + 1), (i, j + 1)]
            ring = [p for a, b in zip(loop, loop[1:] + loop[:1], strict=True) for p in side(a, b)[:-1]]
            out.append((i * rows + j, [[(round(x, 7), round(y, 7)) for x, y in ring]]))
    return out


def test_coverage_is_thinned_alike_on_both_sides(spark):
    rng = random.Random(9)
    rows = wavy(rng, 3, 3, 12)
    island = [(round(44 + 3 * math.cos(t / 20 * math.pi), 7), round(3 * math.sin(t / 20 * math.pi), 7)) for t in range(40)]
    rows.append((99, [island]))
    units = made(spark, rows)
    found = T.weights(units, "id")
    assert V.faults(units, "id").count() == 0
    assert found.select("arc").distinct().count() == 24 - 8 + 4 + 1  # the four outer corners are no junctions, so their sides make one arc
    before = sum(len(r) for _, rings in rows for r in rings)
    last = before + 1
    for least in (0.0, 0.3, 5.0):
        out = T.thinned(units, "id", found, least, 4.0).collect()
        points = sum(len(r) for u in out for r in u.rings)
        df = made(spark, [(u.id, [[(p.x, p.y) for p in r] for r in u.rings]) for u in out])
        assert V.faults(df, "id").count() == 0 and O.validity(df, "id").where("NOT valid").count() == 0
        assert O.gaps(df, "id").count() == 0 and {u.id for u in out} == {i for i, _ in rows}
        assert min(len(u.rings[0]) for u in out) >= 3 and points < last
        last = points
    for share in (0.8, 0.5):
        budget = int(before * 40 * share)
        size = sum(len(r) for u in T.thinned(units, "id", found, T.budget_weight(units, found, budget), 4.0).collect() for r in u.rings) * 40
        assert 0.98 * budget <= size + 80 and size <= budget
    with pytest.raises(ValueError):
        T.budget_weight(units, found, 100)


def test_chains_and_cycles(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, None), (7, 8), (8, 9), (9, 7), (5, None)], "id long, next long")
    ended, circles = P.chains(links)
    assert sorted(map(tuple, ended.collect())) == [(1, 3, 2), (2, 3, 1), (3, 3, 0), (5, 5, 0)]
    assert sorted(map(tuple, P.cycles(circles).collect())) == [(7, 7, 0), (8, 7, 2), (9, 7, 1)]


def test_points_snap_to_the_nearest_border(spark, shapes):
    rng = random.Random(12)
    points = [(k, rng.uniform(-1, 8), rng.uniform(-1, 8)) for k in range(150)]
    df = spark.createDataFrame(points, "p long, x double, y double")
    got = {r.p: r for r in O.snapped(df, made(spark, shapes), "p", "id", 0.8, strict=False, size=2.0).collect()}

    def away(x, y, a, b):
        t = max(0, min(1, ((x - a[0]) * (b[0] - a[0]) + (y - a[1]) * (b[1] - a[1])) / ((b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2)))
        return math.hypot(a[0] + t * (b[0] - a[0]) - x, a[1] + t * (b[1] - a[1]) - y)

    for k, x, y in points:
        inside = any(lo <= y <= hi for _, rings in shapes for lo, hi in spans(rings, x))
        d = 0.0 if inside else min(away(x, y, a, b) for _, rings in shapes for a, b in edges(rings))
        if d > 0.8:
            assert got[k].x is None and got[k].distance is None
        else:
            assert abs(got[k].distance - d) < 1e-9 and abs(math.hypot(got[k].x - x, got[k].y - y) - d) < 1e-9
    assert sum(r.distance is None for r in got.values()) > 5 and sum(0 < (r.distance or 0) < 0.8 for r in got.values()) > 20
    with pytest.raises(Exception, match="away from every shape"):
        O.snapped(df, made(spark, shapes), "p", "id", 0.01).collect()


def test_points_on_borders_lie_in_one_shape(spark):
    """Western and southern borders belong to a shape, eastern and northern ones do not; of a hole likewise."""
    ring = lambda *b: F.array(G.box_ring(*[F.lit(float(v)) for v in b]))
    holed = F.concat(ring(0, 0, 6, 6), ring(2, 2, 4, 4))
    shapes = spark.range(1).select(F.lit(1).alias("p"), holed.alias("rings")).unionByName(spark.range(1).select(F.lit(2).alias("p"), ring(6, 0, 9, 6).alias("rings")))
    points = spark.createDataFrame([(1, 0.0, 1.0), (2, 6.0, 1.0), (3, 2.0, 3.0), (4, 4.0, 3.0), (5, 1.0, 0.0), (6, 1.0, 6.0), (7, 9.0, 1.0)], "id int, x double, y double")
    assert sorted(tuple(r) for r in O.containers(points, shapes, "id", "p").collect()) == [(1, 1), (2, 2), (4, 1), (5, 1)]
