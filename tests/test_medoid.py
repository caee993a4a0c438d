"""Medoids against the sums over all pairs."""

import math
import random

from terraloom.operators import aggregate as A


def km(a, b):
    h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 12742.0176 * math.asin(math.sqrt(min(1.0, h)))


def test_medoid_equals_all_pairs(spark):
    r = random.Random(2)
    rows = [("wide", r.uniform(-80, 80), r.uniform(-180, 180)) for _ in range(150)] + [("tight", 10 + r.gauss(0, 0.01), 20 + r.gauss(0, 0.01)) for _ in range(150)] + [("tight", r.uniform(-60, 60), r.uniform(-180, 180)) for _ in range(10)]
    rows += [("copies", 5.0, 5.0)] * 40 + [("copies", 6.0, 5.0)] * 40 + [("one", 1.0, 1.0), ("two", 1.0, 1.0), ("two", 2.0, 2.0)]
    rows = [(k, *v) for k, v in enumerate(rows)]
    got = {x.g: (x.id, x.total_km) for x in A.medoid(spark.createDataFrame(rows, "id int, g string, lat double, lon double"), "g", "id").collect()}
    for g in {x[1] for x in rows}:
        own = [x for x in rows if x[1] == g]
        total, first = min((round(sum(km(a[2:], b[2:]) for b in own), 6), a[0]) for a in own)
        assert got[g][0] == first and abs(got[g][1] - total) < 1e-4
    assert A.medoid(spark.createDataFrame(rows[:0], "id int, g string, lat double, lon double"), "g", "id").count() == 0
