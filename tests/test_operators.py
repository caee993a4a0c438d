import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from terraloom.operators import aggregate as A
from terraloom.operators import graph as R
from terraloom.operators import joins as J
from terraloom.operators import quiz as Z
from terraloom.operators import ranking as K
from terraloom.operators import spatial as S
from terraloom.operators import validation as V


def km(a, b):
    la, lo, lb, lp = map(math.radians, (*a, *b))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
    return 2 * 6371.0088 * math.asin(min(1, math.sqrt(h)))


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(7)
    left = [(k, rng.uniform(-90, 90), rng.uniform(-180, 180)) for k in range(40)] + [(90, 89.9, 10.0), (91, 10.0, 179.99), (92, -89.99, 0.0)]
    right = [(k, rng.uniform(-90, 90), rng.uniform(-180, 180), str(k % 3)) for k in range(60)] + [(80, 89.9, -170.0, "0"), (81, 10.0, -179.99, "1")]
    return left, right, spark.createDataFrame(left, "id long, lat double, lon double"), spark.createDataFrame(right, "rid long, rlat double, rlon double, code string")


def test_distance_joins_against_brute_force(points):
    left, right, a, b = points
    every = {(x[0], y[0]): km(x[1:], y[1:3]) for x in left for y in right}
    for radius in (30.0, 2500.0):
        got = {(r.id, r.rid): r.km for r in S.within_km(a, b, radius).collect()}
        assert got.keys() == {k for k, d in every.items() if d <= radius}
    got = {(r.id, r.rank): r.rid for r in S.nearest(a, b, "id", "rid", 3).collect()}
    for x in left:
        order = sorted((every[x[0], y[0]], y[0]) for y in right)
        assert [got[x[0], k] for k in (1, 2, 3)] == [i for _, i in order[:3]]


def test_joins(spark):
    left = spark.createDataFrame([(1, "a", "North"), (2, "b", "North"), (3, "c", "South")], "id int, k string, parent string")
    dim = spark.createDataFrame([("a", 10), ("b", 20)], "k string, v int")
    joined, missing = J.lookup(left, dim, ["k"])
    assert {r.id: r.v for r in joined.collect()} == {1: 10, 2: 20, 3: None} and [r.k for r in missing.collect()] == ["c"]
    with pytest.raises(J.DuplicateKey):
        J.lookup(left, dim.union(dim), ["k"])
    auto = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "id int, code string")
    done = J.override(auto, spark.createDataFrame([(2, "m")], "id int, code string"), ["id"], "code", spark.createDataFrame([(3,)], "id int"))
    assert {r.id: r.code for r in done.collect()} == {1: "x", 2: "m", 3: None}
    names = spark.createDataFrame([(7, "São Paulo", "North"), (8, "Foo", "North"), (9, "foo", "North")], "rid int, rname string, parent string")
    mine = spark.createDataFrame([(1, "sao-paulo", "North"), (2, "FOO", "North")], "id int, name string, parent string")
    assert {r.id: r.rid for r in J.crosswalk(mine, names, ["parent"], "name", "rname").collect()} == {1: 7, 2: None}
    top = J.suggest(mine, names, ["parent"], "id", "name", "rname", 1).collect()
    assert {r.id: r.rid for r in top} == {1: 7, 2: 8}
    parents = spark.createDataFrame([("p", "1"), ("q", "2")], "pid string, code string")
    children = spark.createDataFrame([("q", "q1", None), ("q", "q2", "9")], "pid string, child_id string, code string")
    mixed = J.mixed_granularity(parents, children, spark.createDataFrame([("q",)], "pid string"), "pid", "code").collect()
    assert sorted((r.pid, r.child_id or "", r.code) for r in mixed) == [("p", "", "1"), ("q", "q1", "2"), ("q", "q2", "9")]


def test_typos_and_fuzzy_names(spark):
    right = spark.createDataFrame([(1, "p", "rosario"), (2, "p", "cordoba"), (3, "p", "cordobb"), (4, "q", "rosaria")], "rid int, scope string, rname string")
    left = spark.createDataFrame([(10, "p", "rosaro"), (11, "p", "cordobx"), (12, "p", "rosario"), (13, "p", "xrosario"), (14, "p", "osarix")], "id int, scope string, name string")
    got = {r.id: r.rid for r in J.one_edit_matches(left, right, ["scope"], "id", "rid", F.col("name"), F.col("rname")).collect()}
    assert got == {10: 1, 13: 1}
    got = {r.id: r.rid for r in J.fuzzy_matches(left, right, ["scope"], "id", "rid", "name", "rname", [(0.90, 0.12)]).collect()}
    assert got == {10: 1, 12: 1, 13: 1}


def test_graded_match(spark):
    c = spark.createDataFrame([(1, "foo", "foo", [], 5, 10.0, 20.0), (2, "bar", "bar", ["baz"], 9, 10.0, 20.0), (3, "none", "none", [], 1, 50.0, 50.0)], "id int, primary_key string, ascii_key string, alternates array<string>, population int, lat double, lon double")
    p = spark.createDataFrame([(100, "foo", "foo", 10.1, 20.0, 1), (101, "x", "baz", 10.0, 20.05, 2), (102, "far", "far", 11.0, 20.0, 3)], "place_id int, key string, english_key string, rlat double, rlon double, ord int")
    got = {r.id: (r.place_id, r.grade) for r in S.graded_match(c, p).collect()}
    assert got == {1: (100, 0), 2: (101, 2)}


def test_aggregates(spark):
    votes = spark.createDataFrame([(1, "a", 3), (1, "b", 1), (1, "a", 4), (1, "b", 2), (2, "c", 5)], "k int, v string, o int")
    for ties, winner in (("least", "a"), ("greatest", "b"), ("first", "b")):
        assert {r.k: r.v for r in A.mode(votes, "k", "v", ties, "o").collect()} == {1: winner, 2: "c"}
    sets = A.answer_sets(spark.createDataFrame([(1, "12"), (2, "12"), (2, "13"), (3, "13"), (3, "12")], "k int, c string"), "k", "c")
    assert {r.answer_id: r.members for r in A.dissolve_by_answers(sets, "k").collect()} == {"12": 1, "12-13": 2}
    fine, odd = A.consistent_merge(spark.createDataFrame([(1, "x"), (1, "x"), (2, "x"), (2, "y")], "k int, m string"), "k", ["m"])
    assert [r.k for r in fine.collect()] == [1] and [r.k for r in odd.collect()] == [2]
    pixels = spark.createDataFrame([(1, "a")] * 9 + [(1, "b")] + [(2, None)], "u int, c string")
    assert {r.u: r.status for r in A.pixel_votes(pixels, "u", "c").collect()} == {1: "REVIEW", 2: "UNCLASSIFIED"}
    units = spark.createDataFrame([(1,), (2,), (3,)], pixels.select("u").schema)
    assert {r.u: (r.status, r.samples) for r in A.pixel_votes(pixels, "u", "c", units).where("u > 1").collect()} == {2: ("UNCLASSIFIED", 0), 3: ("NO_PIXELS", 0)}
    lons = spark.createDataFrame([(1, 170.0), (1, -170.0), (1, 175.0)], "g int, lon double")
    r = A.longitude_extent(lons, "g").first()
    assert (r.west, r.east, r.width) == (170.0, -170.0, 20.0)
    r = {x.column: x for x in A.profile(spark.createDataFrame([(1, "a"), (2, None), (2, " ")], "n int, s string")).collect()}
    assert (r["s"].rows, r["s"].missing, r["s"].distinct, r["n"].distinct) == (3, 2, 2, 2)


def test_ranking(spark):
    towns = spark.createDataFrame([(1, k, 100 - k, k == 9) for k in range(10)], "g int, id int, pop int, capital boolean")
    got = K.cap_with_forced(towns, "g", [F.desc("pop")], 3, F.col("capital")).collect()
    assert sorted(r.id for r in got) == [0, 1, 9] and max(r["rank"] for r in got) == 3
    assert [r.id for r in K.cap_with_forced(towns, "g", [F.desc("pop")], 1, F.col("capital")).collect()] == [9]
    for n in (1, 3, 7, 10, 20):
        got = sorted(r.id for r in K.even_sample(towns, "g", [F.col("id").asc()], n).collect())
        assert got == (list(range(10)) if n >= 10 else sorted({i * 10 // n for i in range(n)}))
    labels = spark.createDataFrame([(1, "a", "x", "p"), (2, "a", "y", "p"), (3, "b", "x", "p"), (4, "c", "x", "p"), (5, "c", "x", "q")], "id int, l string, m string, n string")
    assert {r.id: r.display for r in K.disambiguate(labels, "l", ["m", "n"]).collect()} == {1: "a, x", 2: "a, y", 3: "b", 4: "c, x, p", 5: "c, x, q"}


def test_graph_loops(spark):
    nodes = spark.createDataFrame([(k, "A" if k == 0 else "B" if k == 9 else None) for k in range(11)], "id long, code string")
    chain = [(k, k + 1, 1.0) for k in range(9)]
    edges = spark.createDataFrame(chain + [(b, a, s) for a, b, s in chain], "src long, dst long, shared double")
    labels = {r.id: (r.code, r.round) for r in R.propagate(nodes, edges).collect()}
    assert labels[4] == ("A", 4) and labels[5] == ("B", 4) and labels[10] == (None, None)
    comp = {r.id: r.component for r in R.components(nodes.select("id"), edges.where("src < dst")).collect()}
    assert set(comp.values()) == {0, 10} and comp[9] == 0
    paths = {r.id: (r.dist, r.seed) for r in R.multi_source_paths(spark.createDataFrame([(0, "p"), (9, "q")], "id long, prefix string"), edges.withColumnRenamed("shared", "cost")).collect()}
    assert paths[4] == (4.0, 0) and paths[5] == (4.0, 9) and 10 not in paths
    assert {r.id: r.round for r in R.grow(spark.createDataFrame([(3,)], "id long"), edges).collect()}[0] == 3


def test_agreed_labels(spark):
    nodes = spark.createDataFrame([(1, "A"), (2, "A"), (3, "A"), (4, "B"), (5, None), (6, None), (7, None), (8, None)], "id long, code string")
    # 5: three of four agree; 6: neighbours differ one to one; 7: only through 5; 8: nobody.
    pairs = [(5, 1), (5, 2), (5, 3), (5, 4), (6, 1), (6, 4), (7, 5)]
    edges = spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "src long, dst long")
    got = {r.id: (r.code, r.round) for r in R.propagate_agreed(nodes, edges).collect()}
    assert got[5] == ("A", 1) and got[6] == (None, None) and got[7] == ("A", 2) and got[8] == (None, None)
    thin = spark.createDataFrame([(5, "A", 0.1)], "id long, code string, share double")
    assert {r.id: r.code for r in R.propagate_agreed(nodes, edges, thin).collect()}[5] is None


def test_groups(spark):
    f = spark.createDataFrame([("1", ["a"], ["x"]), ("2", ["a", "b"], ["y", "x"]), ("3", None, ["z"])], "id string, vals array<string>, answers array<string>")
    assert [r.id for r in Z.property_group(f, "vals", ["b"]).collect()] == ["2"] and Z.property_group(f, "nope", ["b"]).count() == 0
    q = spark.createDataFrame([("x", "X", 2), ("x", "X first", 1), ("y", "Y", 3)], "answer string, display string, ord int")
    assert {r.id: r.displays for r in Z.questions_in_order(f, q, "id", "answers").collect()} == {"1": ["X first"], "2": ["Y", "X first"]}


def test_checks(spark):
    df = spark.createDataFrame([(1, "a"), (2, " ")], "id int, name string")
    assert V.exact_count(df, 2) is df and V.unique(df, ["id"]) is df
    for bad in (lambda: V.exact_count(df, 3), lambda: V.required(df, ["name"]), lambda: V.unique(df.union(df), ["id"]), lambda: V.parents_exist(df, df.where("id = 1"), "id"), lambda: V.total_partition(df, df.where("id = 1"), "id"), lambda: V.same_rows(df, df.limit(1), ["id"])):
        with pytest.raises(V.CheckFailed):
            bad()


def test_files(spark, tmp_path):
    from terraloom.sources import files, sinks

    (tmp_path / "a.geojson").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","id":"i","properties":{"n":"x"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}}]}')
    r = files.geojson(spark, str(tmp_path / "a.geojson"), "n: string").withColumn("rings", files.rings_of(F.col("coordinates"))).first()
    assert (r.id, r.n, r.geometry_type, len(r.rings[0])) == ("i", "x", "Polygon", 4)
    (tmp_path / "g.tsv").write_text("\t".join(["1", 'The "X"', "x", "a,b", "1.5", "2.5", "P", "PPL", "ZA", "", "", "", "", "", "77"]) + "\n")
    r = files.gazetteer(spark, str(tmp_path / "g.tsv")).first()
    assert (r.name, r.lat, r.population) == ('The "X"', 1.5, 77)
    (tmp_path / "d.sql").write_text("INSERT INTO city VALUES (1, 'SP', 'D''Oeste');\nINSERT INTO other VALUES (1);\n")
    assert files.sql_dump(spark, str(tmp_path / "d.sql"), "city", ["id", "state", "name"]).first() == ("1", "SP", "D'Oeste")
    (tmp_path / "m.sql").write_text("INSERT INTO `city` (id, n) VALUES (1, 'a (b), c'), (2, NULL),(3,'d''e');\n")
    assert [tuple(r) for r in files.sql_dump(spark, str(tmp_path / "m.sql"), "city", ["id", "n"]).collect()] == [("1", "a (b), c"), ("2", None), ("3", "d'e")]
    (tmp_path / "s.sql").write_text("-- towns; all\nCREATE TABLE t (id int);\nINSERT INTO t VALUES\n(1,'a'),\n  (2, 'b;c') ;\ninsert into t values (3,'d');\n/* end */\nINSERT INTO t (id, n) VALUES (4,\n NULL);")
    assert sorted(tuple(r) for r in files.sql_dump(spark, str(tmp_path / "s.sql"), "t", ["id", "n"]).collect()) == [("1", "a"), ("2", "b;c"), ("3", "d"), ("4", None)]
    (tmp_path / "w.sql").write_text("INSERT INTO t VALUES (1,'a','x');\n")
    with pytest.raises(Exception, match="not 2 plain values"):
        files.sql_dump(spark, str(tmp_path / "w.sql"), "t", ["id", "n"]).collect()
    assert {"d", "m", "g"} <= {r.name for r in files.listing(spark, str(tmp_path)).collect()}
    (tmp_path / "l.js").write_text("var x = [{name: 'A &amp; B', code: 12}, {name: \"C\", code: '0341'}];")
    assert {tuple(r) for r in files.object_literals(spark, str(tmp_path / "l.js"), ["name", "code"]).collect()} == {("A & B", "12"), ("C", "0341")}
    (tmp_path / "i.ppm").write_bytes(b"P6\n2 1\n255\n" + struct.pack("6B", 1, 2, 3, 4, 5, 6))
    assert [(r.x, r.y, r.r, r.b) for r in files.image_pixels(spark, str(tmp_path / "i.ppm")).collect()] == [(0, 0, 1, 3), (1, 0, 4, 6)]
    df = spark.createDataFrame([(1, 'q"\\'), (2, None)], "id int, answer string")
    sinks.write_literals(df, str(tmp_path / "lit"), ["id", "answer"], "id")
    assert [r.value for r in spark.read.text(str(tmp_path / "lit")).collect()] == ['{ id: "1", answer: "q\\"\\\\" },', '{ id: "2" },']
    with pytest.raises(ValueError):
        files.partition_of(spark, str(tmp_path), "c", "../x")


def test_sessions(spark):
    from terraloom.streaming.sessions import Session, fold_sessions

    rng = random.Random(3)
    rows = [(rng.randrange(5), k, k, rng.choice(["right", "wrong", "skip", "restart", "stop", "other"])) for k in range(300)]
    got = {r.key: tuple(r) for r in fold_sessions(spark.createDataFrame(rows, "key long, ts long, ordinal long, action string"), 4, False).collect()}
    for key in range(5):
        s = Session(4, False)
        for k, _, _, action in rows:
            if k == key:
                s.take(action)
        assert got[key] == s.row(key)
    s = Session(3, True)
    s.take("wrong")
    assert list(s.queue) == [1, 2, 0] and s.wrong == 1 and s.answered == 0


def test_propagation_weighs_border_neighbours_and_evidence(spark):
    nodes = spark.createDataFrame([(0, None), (1, "x"), (2, "y"), (3, "y")], "id long, code string")
    edges = spark.createDataFrame([(0, 1, 1.0), (0, 2, 0.35), (0, 3, 0.35)], "src long, dst long, shared double")
    label = lambda seen=None: {r.id: r.code for r in R.propagate(nodes, edges, seen).collect()}[0]
    assert label() == "x"  # 0.50 + 0.10 against 0.35 + 0.20
    assert label(spark.createDataFrame([(0, "y", 2.0), (0, "x", 1.0), (0, "z", 9.0)], "id long, code string, score double")) == "y"


def test_a_feature_is_done_when_all_its_answers_are(spark):
    answers = spark.createDataFrame([(1, "A"), (1, "B"), (2, "A"), (3, None)], "feature int, answer string")
    rows = [
        (1, "A", "normal", True, "right"), (1, "B", "normal", True, "right"), (1, "A", "normal", True, "ignored"), (2, "B", "normal", True, "ignored"), (1, "C", "hard", True, "wrong"),
        (1, "A", "normal", False, "inspected"), (2, None, "hard", True, "ignored"), (3, "A", "hard", True, "ignored"), (9, "A", "normal", True, "ignored"),
    ]
    clicks = spark.createDataFrame([(k, 5, f, q, m, on, v) for k, (f, q, m, on, v) in enumerate(rows)], "k int, session int, feature int, question string, mode string, on boolean, want string")
    got = Z.judged_clicks(clicks, answers, ["k"], "on").collect()
    assert len(got) == len(rows) and all(r.verdict == r.want for r in got), got


def test_percentiles_equal_the_built_in_ones(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(-5, 40)])) for _ in range(500)] + [("one", 7), ("none", None)]
    df = spark.createDataFrame([(g, None if v is None else float(v)) for g, v in rows], "g string, v double").repartition(5)
    at = {"low": 0.0, "p10": 0.1, "mid": 0.5, "p99": 0.99, "high": 1.0}
    want = df.groupBy("g").agg(*[F.percentile("v", p).alias(n) for n, p in at.items()])
    plain = lambda d: sorted(((r[0] or "", *[None if x is None else round(x, 9) for x in r[1:]]) for r in d.collect()), key=repr)
    assert plain(A.percentiles(df, "g", "v", at)) == plain(want)
