"""The town list on small rows."""

from pyspark.sql import functions as F

from terraloom.operators import towns

CANDIDATE = "id long, country string, primary_key string, ascii_key string, alternates array<string>, population long, lat double, lon double, capital boolean"
PLACE = "place_id long, country string, key string, english_key string, rlat double, rlon double, ord long, primary boolean"


def made(spark, people, spots):
    c = spark.createDataFrame([(i, "x", name, name, [], n, lat, 5.0, capital) for i, name, n, lat, capital in people], CANDIDATE)
    return c, spark.createDataFrame([(i, land, name, name, lat, 5.0, i, primary) for i, land, name, lat, primary in spots], PLACE)


def test_tiers_places_limit_and_capital(spark):
    people = [(1, "a", 10, 10.0, False), (2, "a", 99, 10.05, False), (3, "b", 50, 10.1, False), (4, "v", 900, 10.15, False), (5, "cap", 1, 10.2, True), (6, "far", 70, 50.0, False), (7, "w", 800, 10.25, False)]
    spots = [(1, "x", "a", 10.0, True), (2, "x", "b", 10.1, True), (3, "x", "v", 10.15, False), (4, "x", "cap", 10.2, False), (5, "y", "far", 50.0, True), (6, "x", "w", 10.25, False), (7, "x", "a", 10.01, False)]
    c, p = made(spark, people, spots)
    got = lambda limit: sorted((r["rank"], r.id, r.place_id, r.tier) for r in towns.town_list(c, p, "country", limit).collect())
    # The nearer candidate takes the place, whatever its population; primary places come first; no match across countries.
    assert got(9) == [(1, 3, 2, 0), (2, 1, 1, 0), (3, 4, 3, 1), (4, 7, 6, 1), (5, 5, 4, 1)]
    assert got(3) == [(1, 3, 2, 0), (2, 1, 1, 0), (3, 5, 4, 1)]
    assert got(1) == [(1, 5, 4, 1)]
    assert towns.town_list(c.limit(0), p, "country").count() == 0


def test_names(spark):
    rows = [("Ségou", "Segou"), ("Davao City", "Davao"), ("Wien", "Vienna"), ("", "Rome"), (None, "Oslo"), (" Thetford-Mines ", "Thetford Mines")]
    got = spark.createDataFrame(rows, "n string, e string").select(*towns.town_names(F.col("n"), F.col("e"))).collect()
    assert [tuple(r) for r in got] == [("Ségou", None), ("Davao City", None), ("Vienna", "Wien"), ("Rome", None), ("Oslo", None), ("Thetford Mines", None)]
