"""Medians and bounds of sums by trees of cells, against all pairs; the copies made the median compare billions of pairs before."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from terraloom.operators import aggregate as A
from terraloom.operators import sphere as S

from test_medoid import km


@pytest.fixture(scope="module")
def groups():
    r = random.Random(5)
    out = {"wide": [(r.uniform(-90, 90), r.uniform(-180, 180)) for _ in range(120)] + [(90.0, 0.0), (-90.0, 0.0), (0.0, 180.0), (0.0, -180.0), (0.0, 0.0)]}
    out["towns"] = [(a + r.gauss(0, 1e-4), b + r.gauss(0, 1e-4)) for a, b in ((10, 20), (-10, -160), (51, 0)) for _ in range(40)]
    out["copies"] = [(5.0, 5.0)] * 30 + [(6.0, 5.0)] * 9 + [(-5.0, -175.0)] * 2
    out["same"], out["two"], out["one"] = [(1.0, 2.0)] * 7, [(0.0, 0.0), (0.0, 1.0)], [(3.0, 3.0)]
    return out


def _places(spark, groups):
    rows = [(g, k, *p) for g, own in groups.items() for k, p in enumerate(own)]
    return A._places(spark.createDataFrame(rows, "g string, id int, lat double, lon double"), "g", "id")


def test_median_equals_all_pairs(spark, groups):
    places = _places(spark, groups)
    for least in (1, 32):
        got = dict(map(tuple, S.median_distances(places, "g", least).collect()))
        assert set(got) == set(groups) - {"one"}
        for g, median in got.items():
            own = groups[g]
            # An ulp of a chord between antipodes is 1e-4 km.
            assert abs(median - statistics.median(km(a, b) for i, a in enumerate(own) for b in own[:i])) < (1e-3 if g == "copies" else 1e-6)


def test_bounds_hold_every_sum(spark, groups):
    places = _places(spark, groups)
    at = {x.pid: x for x in places.collect()}
    for least in (1, 32):
        nodes = S.tree(places, "g", least)
        for bounds in (S.distance_sums(nodes, "g", 20.0), S.place_sums(nodes, places.select("g", "pid"), "g")):
            got = bounds.collect()
            assert sorted(x.pid for x in got) == sorted(at)
            for x in got:
                total = sum(km((at[x.pid].lat, at[x.pid].lon), p) for p in groups[x.g])
                assert x.low - 1e-5 <= total <= x.high + 1e-5


def test_core_of_copies(spark):
    spot = F.col("id") % 3
    points = spark.range(60000).select(F.lit("g").alias("g"), "id", F.lit(0.0).alias("lat"), F.when(spot == 0, 0.0).when(spot == 1, 1.0).otherwise(40.0).alias("lon"))
    got = A.core_median(points, "g", "id").first()
    assert got.n_core == 54000 and abs(got.median_km - km((0.0, 0.0), (0.0, 1.0))) < 1e-6
