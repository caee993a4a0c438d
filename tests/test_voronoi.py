"""Voronoi cells against a plain half-plane clipping of all pairs."""

import numpy as np
import pytest

from terraloom.operators import voronoi as V

BOX = (0.0, 0.0, 10.0, 8.0)


def plain(points, k):
    """The ring of point k, clipped by every other point."""
    ring = [(BOX[0], BOX[1]), (BOX[2], BOX[1]), (BOX[2], BOX[3]), (BOX[0], BOX[3])]
    p = points[k]
    for q in points:
        if q == p:
            continue
        f = [(x - (p[0] + q[0]) / 2) * (q[0] - p[0]) + (y - (p[1] + q[1]) / 2) * (q[1] - p[1]) for x, y in ring]
        out = []
        for i, a in enumerate(ring):
            j = (i + 1) % len(ring)
            if f[i] <= 0:
                out.append(a)
            if f[i] * f[j] < 0:
                t = f[i] / (f[i] - f[j])
                out.append((a[0] + (ring[j][0] - a[0]) * t, a[1] + (ring[j][1] - a[1]) * t))
        ring = out
    return ring


def area(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


def made(spark, points):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "id long, x double, y double")


def spread(kind):
    r = np.random.default_rng(5)
    if kind == "even":
        return [tuple(p) for p in r.uniform((0, 0), (10, 8), (120, 2))]
    if kind == "cluster":  # most seeds within a thousandth of the box, a few far away, some outside
        return [tuple(p) for p in np.vstack([r.normal((3, 3), 0.002, (150, 2)), r.uniform((0, 0), (10, 8), (6, 2)), r.uniform((10, 8), (14, 12), (8, 2))])]
    if kind == "lattice":  # four seeds on one circle everywhere
        return [(x + 0.5, y + 0.5) for x in range(10) for y in range(8)]
    return [(5.0, 4.0)] + [(5 + 3 * np.cos(t), 4 + 3 * np.sin(t)) for t in np.linspace(0, 2 * np.pi, 61)[:-1]]


@pytest.mark.parametrize("kind", ["even", "cluster", "lattice", "star"])
def test_cells_equal_plain_clipping(spark, kind):
    points = spread(kind)
    got = {r.id: [(c.x, c.y) for c in r.ring] for r in V.cells(made(spark, points), "id", BOX).collect()}
    told = {k: area(ring) for k in range(len(points)) if len(ring := plain(points, k)) > 2}
    told = {k: a for k, a in told.items() if a > 1e-12}
    assert {k for k in got if area(got[k]) > 1e-12} == set(told)
    assert all(abs(area(got[k]) - a) < 1e-8 for k, a in told.items())
    assert abs(sum(area(r) for r in got.values()) - 80.0) < 1e-8
    # The cell that holds a random place belongs to the seed nearest to it.
    for x, y in np.random.default_rng(1).uniform((0, 0), (10, 8), (40, 2)):
        near = min(range(len(points)), key=lambda k: (points[k][0] - x) ** 2 + (points[k][1] - y) ** 2)
        ring = got[near]
        assert all((b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) > -1e-9 for a, b in zip(ring, ring[1:] + ring[:1], strict=True))


def test_neighbours_are_mutual_and_regions_dissolve(spark):
    cells = V.cells(made(spark, spread("even")), "id", BOX)
    sides = {(r.id, r.other): r.length for r in V.sides(cells, "id").where("other IS NOT NULL").collect()}
    assert all(abs(sides[(b, a)] - n) < 1e-7 for (a, b), n in sides.items() if n > 1e-6)
    one = V.regions(cells, "id", made(spark, spread("even")).selectExpr("id", "'x' AS code"), "code").collect()
    assert len(one) == 1 and one[0].cells == 120 and abs(one[0].area - 80) < 1e-8 and abs(one[0].border - 36) < 1e-8


def test_defined_cases(spark):
    rows = spark.createDataFrame([(4, 2.0, 4.0), (3, 2.0, 4.0), (9, None, 1.0), (5, 8.0, 4.0)], "id long, x double, y double")
    got = {r.id: area([(c.x, c.y) for c in r.ring]) for r in V.cells(rows, "id", BOX).collect()}
    assert set(got) == {3, 5} and all(abs(a - 40) < 1e-9 for a in got.values())
    assert V.cells(rows.limit(0), "id", BOX).count() == 0
    alone = V.cells(rows.where("id = 5"), "id", BOX).first()
    assert area([(c.x, c.y) for c in alone.ring]) == 80 and {c.other for c in alone.ring} == {None}
    # Guards take their share of the box and give no cell.
    guarded = V.cells(rows.where("id = 5"), "id", BOX, V.guard_points((7.0, 3.0, 9.0, 5.0), 1.0)).collect()
    assert len(guarded) == 1 and 0 < area([(c.x, c.y) for c in guarded[0].ring]) < 20
    assert len(V.guard_points(BOX)) == 8
