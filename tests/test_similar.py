"""Similar names and resolution in stages against plain comparison of all pairs."""

import random
from difflib import SequenceMatcher

from terraloom.operators import joins as J
from terraloom.operators import resolution as R
from terraloom.operators import similar as S


def words(n, seed, letters="abcdeo"):
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(r.randint(1, 9))) for _ in range(n)]


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


def test_pairs_equal_all_pairs(spark):
    a, b = sorted(set(words(60, 1))), sorted(set(words(60, 2)))
    left, right = spark.createDataFrame([("x", w) for w in a] + [("y", a[0]), ("x", ""), ("x", None)], "scope string, a string"), spark.createDataFrame([("x", w) for w in b] + [("x", None)], "scope string, b string")
    for floor in (0.8, 0.622, 0.0):
        got = {(r.a, r.b): r.ratio for r in S.ratio_pairs(left, right, ["scope"], "a", "b", floor).collect()}
        assert got == {(x, y): ratio(x, y) for x in a for y in b if ratio(x, y) >= floor and ratio(x, y) > 0}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_two_edits_equal_all_pairs(spark):
    a, b = sorted(set(words(80, 3, "abc"))), sorted(set(words(80, 4, "abc")))
    left, right = spark.createDataFrame([("x", w) for w in a], "scope string, a string"), spark.createDataFrame([("x", w) for w in b], "scope string, b string")
    for reach in (1, 2):
        got = {(r.a, r.b): r.edits for r in S.within_two_edits(left, right, ["scope"], "a", "b", reach).collect()}
        assert got == {(x, y): d for x in a for y in b if abs(len(x) - len(y)) <= reach and (d := edits(x, y)) <= 2}


def test_suggestions_equal_all_pairs(spark):
    a, b = words(40, 5), words(50, 6) + ["abcde"] * 7
    left = spark.createDataFrame([(i, "x", w) for i, w in enumerate(a)] + [(99, "x", None), (98, "z", "abc")], "id int, scope string, name string")
    right = spark.createDataFrame([(i, "x", w) for i, w in enumerate(b)], "rid int, scope string, rname string")
    got = {}
    for r in sorted(J.suggest(left, right, ["scope"], "id", "name", "rname", 4).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.id, []).append((round(r.ratio, 9), r.rname))
    assert got == {i: [(round(s, 9), w) for s, w in sorted(((ratio(w, v), v) for v in b if ratio(w, v) > 0), key=lambda t: (-t[0], t[1]))[:4]] for i, w in enumerate(a)}


REGISTER = [
    (1, "p", "n", 3, "Florentino Ameghino"), (2, "p", "s", 3, "San Martin"), (3, "p", "n", 3, "San Martin"), (4, "p", "n", 1, "Villa Real"), (5, "p", "s", 2, "Villa Real"),
    (6, "p", "n", 3, "Rosario 2"), (7, "p", "n", 3, "Cordoba"), (8, "p", "n", 3, "Mendozza del Valle"), (9, "p", "s", 1, "Pergamino Chico Alto"), (10, "q", "n", 3, "Cordoba"), (11, "p", "s", 3, "La Cumbre"), (12, "p", "n", 3, "Corralitos"),
]
ASKED = [
    (1, "p", None, "AMEGHINO", (1, "containment")), (2, "p", "s", "San Martín", (2, "loose")), (3, "p", None, "San Martin", (None, None)), (4, "p", None, "villa real", (5, "exact")), (5, "p", "n", "villa real", (4, "exact")),
    (6, "p", None, "Rosario 3", (None, None)), (7, "p", None, "Cordobba", (7, "typo")), (8, "p", None, "the cumbre", (11, "core")), (9, "p", None, "lacumbre", (None, "unresolved")), (10, "p", None, "zzz", (12, "manual")),
    (11, "p", None, "Gran Villa", (4, "group")), (11, "p", None, "Gran Villa", (5, "group")), (12, "p", None, "Mendoza del Vale", (8, "fuzzy")), (13, "p", None, "", (None, None)), (14, "p", None, None, (None, None)),
    (15, "p", None, "Chico Pergamino Alto", (9, "significant")), (16, "p", None, "crrlts", (12, "skeleton")), (17, "p", None, "corral itos", (12, "compact")), (18, None, None, "Cordoba", (None, None)),
]


def test_stages(spark):
    left = spark.createDataFrame(sorted({r[:4] for r in ASKED}, key=lambda r: r[0]), "id int, scope string, hint string, name string")
    right = spark.createDataFrame(REGISTER, "right_id int, scope string, area string, priority int, name string")
    off, hand = spark.createDataFrame([(9,)], "id int"), spark.createDataFrame([(10, 12)], "id int, right_id int")
    groups = spark.createDataFrame([("p", "gran villa", 4), ("p", "gran villa", 5)], "scope string, name string, right_id int")
    got = sorted(((r.id, r.right_id, r.stage) for r in R.resolve(left, right, off, hand, groups, ["the", "la"]).collect()), key=str)
    assert got == sorted(((r[0], *r[4]) for r in ASKED), key=str)
    assert R.resolve(left.limit(0), right, stop=["the"]).count() == 0
    assert {r.stage for r in R.resolve(left, right.limit(0)).collect()} == {None}
