"""Operators over rows that repeat a key or a place many times: each is looked up once (in the form before, the first two tests compared billions of pairs)."""

from pyspark.sql import functions as F

from terraloom.functions import geo as G
from terraloom.functions import text as T
from terraloom.operators import joins as J
from terraloom.operators import overlay as O
from terraloom.operators import spatial as S
from terraloom.plans import relational


def test_cascade_counts_the_right_side_first(spark):
    left = spark.range(60000).select(F.col("id").alias("l"), F.lit("s").alias("scope"), F.when(F.col("id") == 7, "b").otherwise("a").alias("k"))
    right = spark.range(60000).select(F.col("id").alias("r"), F.lit("s").alias("scope"), F.when(F.col("id") == 9, "b").otherwise("a").alias("k"))
    got = J.cascade(left, right, "l", "r", [("exact", F.col("k"), F.col("k"))], ["scope"])
    assert got.count() == 60000 and [tuple(x) for x in got.where("stage IS NOT NULL").collect()] == [(7, 9, "exact")]


def test_graded_match_by_kinds(spark):
    c = spark.range(30000).select("id", F.lit("x").alias("primary_key"), F.lit("x").alias("ascii_key"), F.array(F.lit("y")).alias("alternates"), F.col("id").alias("population"), F.lit(1.0).alias("lat"), F.lit(1.0).alias("lon"))
    p = spark.range(30000).select((F.col("id") + 5).alias("place_id"), F.when(F.col("id") < 3, "z").otherwise("x").alias("key"), F.lit("q").alias("english_key"), F.lit(1.0).alias("rlat"), F.lit(1.0).alias("rlon"), F.col("id").alias("ord"))
    got = S.graded_match(c, p)
    assert got.agg(F.count("id"), F.countDistinct("id"), F.min("place_id"), F.max("place_id"), F.max("grade")).first() == (30000, 30000, 8, 8, 0)


def test_points_of_one_place(spark):
    points = spark.range(20).select("id", (F.col("id") % 3 * 2.0 + 1).alias("x"), F.lit(1.0).alias("y")).unionByName(spark.createDataFrame([(99, 2.3, 1.0)], "id long, x double, y double"))
    shapes = spark.range(3).select((F.col("id") + 1).alias("p"), F.array(G.box_ring(F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(2.0))).alias("rings"), F.col("id").alias("ord"))
    at = points.select("id", F.col("y").alias("lat"), F.col("x").alias("lon"))
    assert sorted(tuple(r) for r in S.points_in_polygons(at, shapes, "id", "p").collect()) == [(k, 1) for k in range(0, 20, 3)]
    got = {r.id: (r.x, r.distance) for r in O.snapped(points, shapes.where("p = 1"), "id", "p", 1.0, strict=False).collect()}
    assert len(got) == 21 and got[3] == (1.0, 0.0) and got[4] == (2.0, 1.0) and got[5] == (None, None) and abs(got[99][1] - 0.3) < 1e-9


def test_words_are_split_once(spark):
    df = spark.createDataFrame([("new york city", "york new")], "a string, b string")
    words = [F.array_distinct(T.tokens(F.col(c))) for c in "ab"]
    r = df.select(T.words_jaccard(*words).alias("w"), T.token_jaccard(F.col("a"), F.col("b")).alias("t")).first()
    assert r.w == r.t == 2 / 3


def test_kinds_are_scored_once(spark, monkeypatch):
    """Pairs of ids are those of the plain join; scores are of pairs of kinds, and no side is broadcast."""
    rows = [(k % 40, "b" if k % 7 else None, k % 3, ["x", "y", "z"][k % 5 % 3 :] if k % 11 else None) for k in range(150)]
    df = spark.createDataFrame([*rows, (None, "b", 1, ["x"])], "id long, brand string, size int, words array<string>")
    score, plain = T.words_jaccard(F.col("words"), F.col("words_2")), J.pairs_below(df, "id", ["brand", "size"])
    want = sorted(tuple(r) for r in plain.select("id", "id_2", F.coalesce(score, F.lit(-1.0))).collect())
    monkeypatch.setattr(J, "CHUNK", 4)
    got = J.scored_pairs(df, "id", ["brand", "size"], "words", F.coalesce(score, F.lit(-1.0)), "score")
    assert len(want) > 500 and sorted(tuple(r) for r in got.collect()) == want
    monkeypatch.setattr(J, "CHUNK", 1000)
    calls = spark.sparkContext.accumulator(0)
    counted = F.udf(lambda a, b: calls.add(1) or a == b, "boolean")
    one = spark.range(500).select("id", F.lit("b").alias("brand"), (F.col("id") % 2).alias("kind"))
    assert J.scored_pairs(one, "id", ["brand"], "kind", counted("kind", "kind_2"), "same").where("same").count() == 2 * 250 * 249 // 2
    assert 3 <= calls.value <= 8
    plan = relational.token_jaccard(spark, "/root/testdata/sf0.001")
    plan.collect()
    assert "Broadcast" not in plan._jdf.queryExecution().executedPlan().toString()
