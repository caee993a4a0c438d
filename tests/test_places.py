"""Operators by distance over many points of one place: they join places, and the results are those of all pairs."""

import math
import random

from pyspark.sql import functions as F

from terraloom.operators import clusters as L
from terraloom.operators import graph as R
from terraloom.operators import spatial as S

KM = 300.0


def km(a, b):
    h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
    return 12742.0176 * math.asin(math.sqrt(min(1.0, h)))


def rows():
    r = random.Random(5)
    spots = [(r.uniform(-8, 8), r.uniform(-8, 8)) for _ in range(25)]
    return [(k, *spots[r.randrange(25)], r.choice("ab")) for k in range(120)]


def table(spark, data):
    return spark.createDataFrame([*data, (900, None, 1.0, "a")], "id long, lat double, lon double, code string")


def test_places_meet_once(spark):
    copies = [(k, float(k % 3), 0.0, "a") for k in range(3000)]
    at = S.places(table(spark, copies), "id")
    assert sorted((x.id, x.n) for x in at.collect()) == [(0, 1000), (1, 1000), (2, 1000)]
    assert S.near_places(at, 150.0).count() == 7


def test_counts_and_votes(spark):
    data, points = rows(), table(spark, rows())
    near = {a[0]: [b for b in data if b[0] != a[0] and km(a, b) <= KM] for a in data}
    assert sorted(x.id for x in L.dense_core(points, "id", KM, 20).collect()) == sorted(k for k, v in near.items() if len(v) + 1 >= 20)
    same = {a[0]: sum(b[3] == a[3] for b in near[a[0]]) for a in data} | {900: 0}
    assert {x.id: x.within_300 for x in S.radius_counts(points, "id", (KM,), "code").collect()} == same
    told = {x.id: x.predicted for x in L.leave_one_out(points, "id", "code", KM).collect()}
    assert told == {a[0]: min(((round(km(a, b), 9), b[0], b[3]) for b in near[a[0]]), default=(0, 0, None))[2] for a in data} | {900: None}
    votes = S.radius_vote(points, points.withColumnsRenamed({"lat": "rlat", "lon": "rlon", "id": "rid"}), "id", "rid", "code", KM)
    for x in votes.collect():
        of = {c: sum(1 / max(km(data[x.id], b), 1.0) ** 1.5 for b in data if b[3] == c and km(data[x.id], b) <= KM) for c in "ab"}
        assert abs(x.score - max(of.values())) < 1e-9 and abs(of[x.code] - x.score) < 1e-9


def test_loops(spark):
    data, points = rows(), table(spark, rows())
    pairs = spark.createDataFrame([(a[0], b[0], km(a, b)) for a in data for b in data if a[0] != b[0] and km(a, b) <= KM], "src long, dst long, km double")
    plain = lambda df: sorted(tuple(x) for x in df.collect())
    assert plain(L.single_link(points, "id", KM)) == plain(R.components(points.select("id"), pairs))
    seeds = points.where("id % 40 = 1").select("id")
    assert plain(L.reached(points, seeds, "id", KM)) == plain(R.grow(seeds, pairs))
    nodes = points.where("id < 900").withColumn("code", F.when(F.col("id") % 30 < 2, F.col("code")))
    shared = 1000.0 - F.col("km")
    assert plain(L.spread_labels(nodes, "id", "code", KM, shared)) == plain(R.propagate(nodes.select("id", "code"), pairs.withColumn("shared", shared)))
    start = seeds.withColumn("prefix", F.lit("p"))
    got = plain(L.seed_paths(points, start, "id", KM, F.round("km")))
    assert got == plain(R.multi_source_paths(start, pairs.withColumn("cost", F.round("km"))))


def test_estimates_do_not_grow_by_rounds(spark):
    """The plan's estimate of bytes after a loop is that of a file, not a product over the rounds."""
    nodes = spark.range(64).toDF("id")
    found = R.components(nodes, nodes.select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).where("dst < 64"))
    assert found.count() == 64 and int(str(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1 << 20


def test_components_in_few_rounds(spark, monkeypatch):
    """Ids that rise to the middle of a path and fall again: least ids handed on step by step took a round for each step of one half."""
    n, written = 100, []
    monkeypatch.setattr(R, "cut", lambda df, plain=R.cut: written.append(1) or plain(df))
    path = [*range(1, n), *range(2 * n, n, -1), 0]
    edges = spark.createDataFrame([*zip(path, path[1:], strict=False), (500, 501), (501, 500), (7, 7), (900, 1)], "src long, dst long")
    nodes = spark.createDataFrame([(k,) for k in [*path, 500, 501, 600, 600, None]], "id long")
    got = {x.id: x.component for x in R.components(nodes, edges).collect()}
    assert got == {k: 0 for k in path} | {500: 500, 501: 500, 600: 600, None: None}
    assert len(written) < 60
    assert R.components(nodes, edges.limit(0)).where("id <> component").isEmpty()


def test_no_exploded_side_is_broadcast(spark):
    """Points in few bytes of Parquet become 27 rows each before they meet; as a broadcast they took the driver's memory."""
    points = spark.range(4000).select("id", (F.col("id") % 50 * 1.0).alias("lat"), (F.col("id") % 70 * 1.0).alias("lon"), F.lit("a").alias("code"))
    at = S.places(points, "id")
    votes = S.within_km(at.select("id", "lat", "lon"), at.select(F.col("lat").alias("rlat"), F.col("lon").alias("rlon")), KM)
    stats = L.cluster_stats(points, points.select("id", F.lit(0).alias("cluster")), "id")
    for df in (S.near_places(at, KM), votes, S.radius_counts(points, "id", (KM,)), stats):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" in plan and "Generate explode" not in _under_broadcasts(plan)
    assert stats.first().members == 4000


def _under_broadcasts(plan: str) -> str:
    """The lines of a plan below its broadcasts."""
    depth, out = None, []
    for line in plan.split("== Initial Plan ==")[0].splitlines():
        at = len(line) - len(line.lstrip(" :+-*()0123456789"))
        depth = None if depth is not None and at <= depth else depth
        if depth is not None:
            out.append(line)
        elif "BroadcastExchange" in line:
            depth = at
    return "\n".join(out)


def test_clusters_go_back_to_points_by_shuffle(spark):
    points = spark.range(300).select("id", (F.col("id") % 50 * 1.0).alias("lat"), F.lit(0.0).alias("lon"))
    found = L.single_link(points, "id", 120.0)
    assert {x.cluster for x in found.collect()} == {0}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
