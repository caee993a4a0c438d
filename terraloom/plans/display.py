"""Queries over what a map shows: label zooms, families of colours, colours of answered features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import geo as G
from ..functions import text as T
from ..operators import colours, labels
from ..operators import quiz as Z
from .rules import _SETTLED, _settlements
from .tables import SQL_POINTS, customers, table


def label_zooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zooms of customers as settlements, their positions drawn together fortyfold, so that labels crowd."""
    place, people, capital, seat, regional = (F.col(c) for c in ("place", "people", "capital", "seat", "regional"))
    tier = C.significance_tier(place, people, capital, seat)
    important = F.round(C.importance(tier, place, people, capital, seat, regional), 4)
    at = customers(spark, sf_dir).select("c_custkey", "c_name", (F.col("lat") / 40).alias("lat"), (F.col("lon") / 40).alias("lon"))
    rows = _settlements(spark, sf_dir).join(at, "c_custkey").select(
        "c_custkey", G.mercator_x(F.col("lon")).alias("x"), G.mercator_y(F.col("lat")).alias("y"), F.round(C.min_zoom(place, people, capital, seat, regional), 6).alias("base"),
        C.label_delay(tier).alias("delay"), T.stable_unit(F.col("c_custkey").cast("string")).alias("offset"), F.struct(tier.alias("tier"), (-important).alias("important"), "c_name").alias("rank"),
    )
    return labels.label_zooms(rows, "c_custkey").select("c_custkey", F.round("zoom", 6).alias("zoom"))


def colour_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities, discounts and taxes of line items as channels of pixels."""
    step = lambda c, by, wide: (F.round(F.col(c) * by).cast("long") * wide)
    pixels = table(spark, sf_dir, "lineitem").select((F.floor(F.col("l_quantity") / 10) * 12).alias("r"), step("l_discount", 100, 9).alias("g"), step("l_tax", 100, 7).alias("b"), F.lit(1).alias("n"))
    return colours.colour_families(pixels, least=5)


def feature_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as features by the priorities of their orders; a session for each order status, which has answered the priorities whose orders do not divide by three."""
    o = table(spark, sf_dir, "orders")
    features = o.groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("answers"))
    counts = o.groupBy(F.col("o_orderstatus").alias("session"), F.col("o_orderpriority").alias("answer")).agg(F.count(F.lit(1)).alias("n"))
    statuses = counts.select("session", "answer", F.when(F.col("n") % 3 == 1, "correct").when(F.col("n") % 3 == 2, "wrong").alias("status"))
    out = Z.feature_colours(features, statuses, "o_custkey")
    return out.select("session", "o_custkey", *[F.round(c, 6).alias(c) for c in "rgb"], "a")


QUERIES = {f.__name__: f for f in (label_zooms, colour_families, feature_colours)}
_SPACING = "CASE WHEN {z} < 5 THEN 90 WHEN {z} < 6 THEN 80 WHEN {z} < 7 THEN 70 WHEN {z} < 8 THEN 60 WHEN {z} < 9 THEN 50 WHEN {z} < 10 THEN 42 WHEN {z} < 11 THEN 35 WHEN {z} < 12 THEN 30 WHEN {z} < 13 THEN 25 ELSE 20 END"
ORACLES = {
    # One label after the other, in order; the state is the list of all labels before it, with the half zoom at which each stands in the way.
    "label_zooms": f"""WITH RECURSIVE {SQL_POINTS}, {_SETTLED},
      t AS (SELECT *, coalesce(people, 0) AS n, CASE WHEN capital OR n >= 1000000 THEN 0 WHEN n >= 250000 OR seat THEN 1 WHEN n >= 75000 THEN 2 WHEN place = 'city' OR n >= 20000 OR place = 'town' THEN 3 WHEN place IN ('village', 'hamlet') THEN 4 ELSE 5 END AS tier FROM p),
      z1 AS (SELECT *, CASE WHEN n > 0 THEN 10.5::DOUBLE - log10(n) + CASE place WHEN 'city' THEN -0.2 WHEN 'town' THEN 0 WHEN 'village' THEN 0.4 WHEN 'hamlet' THEN 1 WHEN 'suburb' THEN 1.5 ELSE 2 END
        ELSE CASE place WHEN 'city' THEN 6 WHEN 'town' THEN 7 WHEN 'village' THEN 8 WHEN 'hamlet' THEN 9.25 WHEN 'suburb' THEN 10.25 ELSE 11 END END::DOUBLE AS z FROM t),
      z2 AS (SELECT * REPLACE (CASE WHEN capital THEN least(z, 3.75) ELSE z END AS z) FROM z1), z3 AS (SELECT * REPLACE (CASE WHEN seat THEN least(z - 0.05, 4.9) ELSE z END AS z) FROM z2),
      z4 AS (SELECT *, round(greatest(3.5, least(14, CASE WHEN regional THEN z - 0.05 ELSE z END)), 6)::DOUBLE AS base,
        round((5 - tier) * 1000 + CASE place WHEN 'city' THEN 500 WHEN 'town' THEN 400 WHEN 'village' THEN 300 WHEN 'hamlet' THEN 200 WHEN 'suburb' THEN 125 ELSE 75 END
          + CASE WHEN n > 0 THEN log10(n) * 140 ELSE 0 END + CASE WHEN capital THEN 500 WHEN seat THEN 25 WHEN regional THEN 20 ELSE 0 END, 4)::DOUBLE AS importance,
        CASE WHEN tier < 3 THEN 0 WHEN tier = 3 THEN 0.5 WHEN tier = 4 THEN 1.25 ELSE 1.75 END::DOUBLE AS delay,
        list_reduce([0::HUGEINT] || list_transform(string_split(c_custkey::VARCHAR, ''), lambda c: ord(c)::HUGEINT), lambda h, c: (h * 31 + c) % 4294967296)::BIGINT % 1000 / 1000::DOUBLE * 0.18 AS shift FROM z3),
      o AS (SELECT c_custkey AS id, base, delay, shift, (lon / 40 + 180) / 360 AS x, (1 - ln(tan(radians(lat / 40)) + 1 / cos(radians(lat / 40))) / pi()) / 2 AS y,
        row_number() OVER (ORDER BY tier, importance DESC, c_name, c_custkey) AS i FROM z4 JOIN c USING (c_custkey)),
      w(i, id, zoom, laid) AS (
        SELECT 0::BIGINT, 0::BIGINT, 0::DOUBLE, []::STRUCT(x DOUBLE, y DOUBLE, g DOUBLE)[]
        UNION ALL
        SELECT i, id, zoom, laid || [{{'x': x, 'y': y, 'g': least(14, ceil(zoom * 2) / 2)::DOUBLE}}] FROM (
          SELECT o.i, o.id, o.x, o.y, laid, CASE WHEN delay = 0 THEN base ELSE coalesce(
            list_min(list_transform(list_filter(list_transform(range(ceil(base * 2)::BIGINT, floor(least(14, base + delay) * 2)::BIGINT + 1), lambda h: h / 2.0::DOUBLE),
              lambda z: len(list_filter(laid, lambda q: q.g <= z AND sqrt(pow((q.x - o.x) * 512 * pow(2, z), 2) + pow((q.y - o.y) * 512 * pow(2, z), 2)) < {_SPACING.format(z="z")})) = 0),
              lambda z: least(14, z + shift))), least(14, least(14, base + delay) + shift)) END::DOUBLE AS zoom
          FROM w JOIN o ON o.i = w.i + 1))
      SELECT id AS c_custkey, round(zoom, 6) AS zoom FROM w WHERE i > 0""",
    "colour_families": """WITH RECURSIVE q AS (SELECT (floor(l_quantity / 10) * 12)::BIGINT AS r, round(l_discount * 100)::BIGINT * 9 AS g, round(l_tax * 100)::BIGINT * 7 AS b, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) >= 5),
      o AS (SELECT *, row_number() OVER (ORDER BY n DESC, r, g, b) AS i FROM q),
      w(i, leaders, mine) AS (SELECT 0::BIGINT, []::STRUCT(d BIGINT, i BIGINT, r BIGINT, g BIGINT, b BIGINT)[], NULL::STRUCT(d BIGINT, i BIGINT, r BIGINT, g BIGINT, b BIGINT)
        UNION ALL SELECT i, CASE WHEN near IS NULL THEN leaders || [own] ELSE leaders END, coalesce(near, own) FROM (
          SELECT o.i, leaders, {'d': 0::BIGINT, 'i': o.i, 'r': o.r, 'g': o.g, 'b': o.b} AS own,
            list_min(list_filter(list_transform(leaders, lambda l: {'d': (l.r - o.r) * (l.r - o.r) + (l.g - o.g) * (l.g - o.g) + (l.b - o.b) * (l.b - o.b), 'i': l.i, 'r': l.r, 'g': l.g, 'b': l.b}), lambda l: l.d <= 324)) AS near
          FROM w JOIN o ON o.i = w.i + 1))
      SELECT o.r, o.g, o.b, o.n, mine.r AS lr, mine.g AS lg, mine.b AS lb FROM w JOIN o USING (i)""",
    "feature_colours": """WITH s AS (SELECT o_orderstatus AS session, o_orderpriority AS p, count(*) % 3 AS k FROM orders GROUP BY 1, 2), f AS (SELECT DISTINCT o_custkey, o_orderpriority AS p FROM orders), t AS (SELECT o_custkey, count(*) AS n FROM f GROUP BY 1),
      m AS (SELECT session, o_custkey, count(*) FILTER (k = 1) AS good, count(*) AS done FROM f JOIN s USING (p) WHERE k > 0 GROUP BY 1, 2), a AS (SELECT session, o_custkey, good / done AS acc, 0.25::DOUBLE + 0.75::DOUBLE * done / n AS s FROM m JOIN t USING (o_custkey))
      SELECT session, o_custkey, round(150 * (1 - s) + (239 * (1 - acc) + 34 * acc) * s, 6) AS r, round(150 * (1 - s) + (68 * (1 - acc) + 197 * acc) * s, 6) AS g, round(150 * (1 - s) + (68 * (1 - acc) + 94 * acc) * s, 6) AS b, 1::DOUBLE AS a FROM a""",
}
