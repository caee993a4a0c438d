"""Label zooms and families of colours against one pass in order; colours of features by hand."""

import math
import random

from pyspark.sql import functions as F

from terraloom.functions import classify as C
from terraloom.operators import colours, labels
from terraloom.operators import quiz as Z

LABEL = "id long, x double, y double, base double, delay double, offset double, rank int"


def one_pass(rows):
    """Zooms by the rule itself, a label at a time."""
    laid, out = [], {}
    for id, x, y, base, delay, offset, _ in sorted((r for r in rows if r[3] is not None), key=lambda r: (r[6], r[0])):
        most = min(14.0, base + (delay or 0))
        zoom, z = None, math.ceil(base * 2) / 2
        if not delay:
            zoom = base
        while zoom is None and z <= most:
            size = 512 * 2**z
            if all(g > z or math.hypot((x - a) * size, (y - b) * size) >= C.spacing_at(z) for a, b, g in laid):
                zoom = min(14.0, z + offset)
            z += 0.5
        out[id] = min(14.0, most + offset) if zoom is None else zoom
        laid.append((x, y, min(14.0, math.ceil(out[id] * 2) / 2)))
    return out


def test_label_zooms_equal_one_pass(spark):
    rng = random.Random(3)
    rows = []
    for i in range(220):
        spot = (rng.randrange(12) / 4000, rng.randrange(12) / 4000) if i % 3 else (0.001, 0.002)
        rows.append((i, *spot, rng.choice([3.5, 5.0, 6.2, 6.5, 7.9, 12.5, 13.1, 13.9, 14.0]), rng.choice([0.0, 0.5, 1.25, 1.75]), rng.choice([0.0, 0.0, 0.05, 0.17]), rng.randrange(40)))
    got = {r.id: r.zoom for r in labels.label_zooms(spark.createDataFrame(rows, LABEL), "id").collect()}
    told = one_pass(rows)
    assert got.keys() == told.keys() and all(abs(got[k] - told[k]) < 1e-9 for k in told)
    assert len({round(told[r[0]] - r[3], 3) for r in rows}) > 10


def test_label_zooms_defined_cases(spark):
    rows = [(1, 0.5, 0.5, None, 0.5, 0.1, 1), (2, 0.5, 0.5, 6.0, None, None, 2), (3, None, None, 6.0, 0.5, 0.1, 3), (4, 0.5, 0.5, 6.0, 0.5, 0.1, 4)]
    frame = spark.createDataFrame(rows, LABEL)
    got = {r.id: round(r.zoom, 6) for r in labels.label_zooms(frame, "id").collect()}
    assert got == {2: 6.0, 3: 6.1, 4: 6.6}
    assert labels.label_zooms(frame.limit(0), "id").count() == 0


def test_colour_families_equal_one_pass(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(60), rng.randrange(60), rng.randrange(200, 256), rng.randrange(15, 40)) for _ in range(300)] + [(None, 1, 1, 99), (255, 255, 255, 19), (0, 0, 0, 12), (0, 0, 0, 12)]
    got = {(r.r, r.g, r.b): (r.lr, r.lg, r.lb) for r in colours.colour_families(spark.createDataFrame(rows, "r int, g int, b int, n int")).collect()}
    counts: dict = {}
    for r, g, b, n in rows:
        if r is not None:
            counts[r, g, b] = counts.get((r, g, b), 0) + n
    leaders, told = [], {}
    for c in sorted((c for c in counts if counts[c] >= 20), key=lambda c: (-counts[c], c)):
        near = min(leaders, key=lambda k: math.dist(c, k), default=None)
        if near is None or math.dist(c, near) > 18:
            leaders.append(c)
            near = c
        told[c] = near
    assert got == told and 1 < len(leaders) < len(told)
    assert colours.colour_families(spark.createDataFrame([], "r int, g int, b int, n int")).count() == 0


def test_feature_colours(spark):
    f = spark.createDataFrame([(1, ["a"]), (2, ["a", "b"]), (3, ["c"]), (4, []), (5, None), (6, ["b", "b"])], "id int, answers array<string>")
    s = spark.createDataFrame([("x", "a", "correct"), ("x", "b", "wrong"), ("x", "c", None), ("y", "b", "wrong")], "session string, answer string, status string")
    rows = lambda df: {(r.session, r.id): tuple(round(v, 3) for v in r[2:]) for r in df.collect()}
    got = rows(Z.feature_colours(f, s, "id", (0, 0, 0), False))
    assert got == {
        ("x", 1): (34.0, 197.0, 94.0, 1.0),
        ("x", 2): (136.5, 132.5, 81.0, 1.0),
        ("x", 6): (149.375, 42.5, 42.5, 1.0),
        ("y", 2): (149.375, 42.5, 42.5, 1.0),
        ("y", 6): (149.375, 42.5, 42.5, 1.0),
    }
    hard = rows(Z.feature_colours(f, s, "id", (9, 9, 9), False, spark.createDataFrame([("x", "a")], "session string, answer string")))
    assert hard["x", 6] == hard["y", 2] == (9.0, 9.0, 9.0, 0.0) and hard["x", 1] == (34.0, 197.0, 94.0, 1.0) and hard["x", 2][3] == 1.0


def test_spacing_of_known_zooms(spark):
    zooms = [k / 2 for k in range(7, 29)]
    told = spark.createDataFrame([(z,) for z in zooms], "z double").select(C.label_spacing(F.col("z")).alias("s")).collect()
    assert [r.s for r in told] == [C.spacing_at(z) for z in zooms]
