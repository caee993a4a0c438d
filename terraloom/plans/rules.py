"""Queries over classification ladders, filters and small set operations; every rule meets rows at its bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import text as T
from ..operators import aggregate as A
from ..operators import joins as J
from ..operators import quiz as Z
from .tables import table

#: Populations on both sides of every bound of the settlement ladders.
_PEOPLE = [None, 0, 19_999, 20_000, 49_999, 50_000, 74_999, 75_000, 99_999, 100_000, 249_999, 250_000, 999_999, 1_000_000, 12_345]
_PLACES = list(C.PLACES)


def _settlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as settlements: kind, population and ranks by their keys."""
    k = F.col("c_custkey")
    pick = lambda values, n, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), (n % len(values) + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", pick(_PLACES, k, "string").alias("place"), pick(_PEOPLE, F.floor(k / len(_PLACES)), "long").alias("people"),
        (k % 53 == 0).alias("capital"), (k % 17 == 0).alias("seat"), (k % 7 == 0).alias("regional"),
    )


def settlement_ladders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tier, importance, zoom, marker, spacing and delay of every settlement."""
    place, people, capital, seat, regional = (F.col(c) for c in ("place", "people", "capital", "seat", "regional"))
    tier = C.significance_tier(place, people, capital, seat)
    zoom = C.min_zoom(place, people, capital, seat, regional)
    return _settlements(spark, sf_dir).select(
        "c_custkey", tier.cast("long").alias("tier"), F.round(C.importance(tier, place, people, capital, seat, regional), 4).alias("importance"), F.round(zoom, 6).alias("zoom"),
        C.marker_type(place, people, capital, seat, regional).alias("marker"), C.label_spacing(F.round(zoom, 6)).cast("long").alias("spacing"), C.label_delay(tier).alias("delay"),
        C.difficulty(F.col("c_custkey") % 900).alias("difficulty"),
    )


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    severity = C.seed_severity(k % 6, k % 5 != 0, k % 11, k % 3 == 0)
    return table(spark, sf_dir, "customer").select("c_custkey", severity.cast("long").alias("severity"))


def seed_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seeds(spark, sf_dir)


def usable_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settlements whose severity is at most 1."""
    return _settlements(spark, sf_dir).join(_seeds(spark, sf_dir).where("severity <= 1"), "c_custkey").select("c_custkey", "place", "severity")


def outlier_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity for counts of like and other points at three radii, made of keys."""
    k = F.col("c_custkey")
    counts = [k % 3, k % 8, k % 3 + F.floor(k / 7) % 3, k % 8 + F.floor(k / 5) % 4, k % 3 + F.floor(k / 7) % 3 + F.floor(k / 11) % 2, k % 8 + F.floor(k / 5) % 4 + 1]
    return table(spark, sf_dir, "customer").select("c_custkey", C.outlier_severity(*counts).cast("long").alias("severity"))


def vote_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as units whose order lines vote with their return flag."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", F.when(F.col("l_linenumber") < 6, F.concat("l_returnflag", "l_linestatus")).alias("code"))
    out = A.pixel_votes(lines, "l_partkey", "code")
    return out.select("l_partkey", "code", F.round("winner", 6).alias("winner"), F.round("runner_up", 6).alias("runner_up"), F.col("samples").cast("long").alias("samples"), "status")


def same_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names against a form with or without a last word city, parted or not."""
    k, name = F.col("p_partkey"), F.col("p_name")
    other = F.when(k % 4 == 0, F.concat(name, F.lit(" City"))).when(k % 4 == 1, F.concat(name, F.lit("city"))).when(k % 4 == 2, F.upper(F.replace(name, F.lit(" "), F.lit(" - ")))).otherwise(F.concat(name, F.lit(" town")))
    return table(spark, sf_dir, "part").select("p_partkey", T.same_name(name, other).alias("same"))


def preferred_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spelling to show of each part's name, of a native form with a last word, dashes or accents and another with accents."""
    k, name = F.col("p_partkey"), F.col("p_name")
    native = F.when(k % 3 == 0, F.concat(name, F.lit(" City"))).when(k % 3 == 1, F.replace(name, F.lit(" "), F.lit("-"))).otherwise(F.replace(name, F.lit("e"), F.lit("é")))
    other = F.when(k % 2 == 0, F.replace(name, F.lit("a"), F.lit("á"))).otherwise(name)
    return table(spark, sf_dir, "part").select("p_partkey", T.preferred_spelling(native, other).alias("name"))


def feature_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settlements of the larger kinds."""
    return _settlements(spark, sf_dir).where(F.col("place").isin("city", "town", "village")).select("c_custkey", "place")


def valid_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postal codes made of keys that have the right form."""
    k = F.col("c_custkey")
    code = F.when(k % 3 == 0, F.format_string("%05d-%03d", k % 100000, k % 1000)).when(k % 3 == 1, F.format_string("%05d%03d", k % 100000, k % 1000)).otherwise(F.format_string("%04d-%03d", k % 10000, k % 1000))
    return table(spark, sf_dir, "customer").select("c_custkey", code.alias("code")).where(F.col("code").rlike(r"^[0-9]{5}-[0-9]{3}$"))


def layer_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document sources by what their names contain, each with its documents."""
    said = F.lower("source")
    kind = F.when(said.contains("src1"), "label").when(said.contains("3") | said.contains("5"), "hidden").when(said.contains("src"), "site").otherwise("other")
    return table(spark, sf_dir, "documents").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def candidate_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first usable of three codes of a nation's customers: missing, blank, or none of the valid."""
    k = F.col("c_custkey")
    a = F.when(k % 2 == 0, "-99").otherwise(F.format_string("N%02d", k % 30))
    b = F.when(k % 3 == 0, " ").otherwise(F.format_string("N%02d", k % 25))
    code = T.candidate_code(a, b, F.format_string("N%02d", F.col("c_nationkey")), valid=[f"N{n:02d}" for n in range(20)])
    return table(spark, sf_dir, "customer").select("c_custkey", code.alias("code"))


def discovered_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by the first of some names that is a column of theirs."""
    c = table(spark, sf_dir, "customer")
    return c.groupBy(F.col(J.find_column(c, ["SEGMENT", "C_MKTSEGMENT", "c_name"])).alias("segment")).agg(F.count(F.lit(1)).alias("n"))


def visible_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settlements that show to each nation's quiz: every second nation plays in hard mode and has answered its greatest key last."""
    s = _settlements(spark, sf_dir)
    last = s.groupBy("c_nationkey").agg(F.max("c_custkey").alias("last"))
    mode = F.when(F.col("c_nationkey") % 2 == 0, "hard").otherwise("normal")
    return Z.visible(s.join(last, "c_nationkey"), "c_custkey", mode, F.col("last"), F.when(F.col("c_nationkey") % 3 == 0, F.col("capital"))).select("c_custkey", "c_nationkey")


def never_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that were never ordered in large quantities."""
    used = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").join(used, "p_partkey", "left_anti").select("p_partkey", "p_brand")


def region_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions with their nations in order; those that have none of a supplier go."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey")).distinct(), "n_nationkey")
    listing = table(spark, sf_dir, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return Z.sections(listing, "r_name", "n_name", "n_nationkey").select("r_name", F.array_join("items", "|").alias("items"))


def ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the ids of customer, nation and region above them."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    return J.with_ancestors(o, [(c, "o_custkey", "c_custkey"), (n, "c_nationkey", "n_nationkey")]).select("o_orderkey", "o_custkey", "c_nationkey", "n_regionkey")


def difficulty_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as quizzes: from easy to extreme by their parts, then by the number of parts and name."""
    brands = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")).withColumn("difficulty", C.difficulty(F.col("n")))
    level = F.when(F.col("difficulty") == "easy", 0).when(F.col("difficulty") == "medium", 1).when(F.col("difficulty") == "hard", 2).otherwise(3)
    return brands.withColumn("place", F.row_number().over(Window.orderBy(level, "n", "p_brand")).cast("long"))


def key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of customers and suppliers as sets: in either, and in both."""
    a = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    either, both = a.union(b).distinct(), a.join(b, "k", "left_semi").distinct()
    return either.select("k", F.lit("either").alias("kind")).union(both.select("k", F.lit("both").alias("kind")))


def flag_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by their lines' flags: any of two, all within two, and every line shipped."""
    flags = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("flags"), F.collect_list("l_linestatus").alias("lines"))
    two = F.array(F.lit("A"), F.lit("R"))
    return flags.select("l_orderkey", F.arrays_overlap("flags", two).alias("any"), (F.size(F.array_except("flags", two)) == 0).alias("within"), F.forall("lines", lambda s: s == "F").alias("all"))


def native_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each supplier's names: two spellings of one name, or two names with an override by nation, which is null for one."""
    n = F.col("s_nationkey")
    entry = lambda language, name: F.struct(F.lit(language).alias("language"), name.alias("name"))
    second = F.when(n % 2 == 0, F.upper("s_name")).otherwise(F.concat(F.lit("x"), F.col("s_name")))
    overrides = {str(k): None if k == 7 else "fra" if k % 3 else "eng" for k in range(1, 25, 2)}
    names = F.array(entry("eng", F.col("s_name")), entry("fra", second))
    return table(spark, sf_dir, "supplier").select("s_suppkey", T.resolved_language(n.cast("string"), names, overrides).alias("language"))


def two_line_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as towns with their first question above their name; the questions are brands by supplier price."""
    p = table(spark, sf_dir, "part")
    questions = p.groupBy(F.col("p_type").alias("answer")).agg(F.min("p_partkey").alias("ord"), F.min(F.upper("p_brand")).alias("display"))
    return Z.two_line_labels(p.withColumn("answer", F.col("p_type")), questions, "p_partkey", "answer", "p_name")


def click_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as clicks on features: the feature by value, the question by type, every third user in hard mode."""
    e = table(spark, sf_dir, "events")
    clicks = e.select("event_id", "ts", F.col("user_id").alias("session"), (F.col("event_id") % 3).alias("feature"), F.col("event_type").alias("question"), F.when(F.col("user_id") % 3 == 0, "hard").otherwise("normal").alias("mode"))
    answers = e.select((F.col("event_id") % 3).alias("feature"), F.col("event_type").alias("answer")).distinct().where((F.length("answer") + F.col("feature")) % 2 == 0)
    return Z.judged_clicks(clicks, answers, ["ts", "event_id"]).select("event_id", "verdict")


def typed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two properties of parts: a string one, which ignores lists, and a list one, which ignores strings."""
    p = table(spark, sf_dir, "part")
    odd = F.col("p_partkey") % 2 == 1
    text, lists = F.when(odd, F.col("p_brand")), F.when(~odd, F.array("p_brand", "p_type"))
    join = lambda c: F.array_join(c, "|")
    return p.select("p_partkey", join(Z.typed_values(text, lists, "string")).alias("as_string"), join(Z.typed_values(text, lists, "string-array")).alias("as_list"))


def vote_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each event type among a user's events."""
    n = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.select("user_id", "event_type", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("user_id")), 6).alias("share"))


QUERIES = {
    f.__name__: f
    for f in (
        settlement_ladders, seed_severity, usable_seeds, outlier_ladder, vote_status, same_names, preferred_spelling, feature_codes, valid_codes, layer_kinds, candidate_codes, discovered_key,
        visible_features, never_ordered, region_sections, ancestors, difficulty_order, key_sets, flag_sets, native_languages, two_line_labels, click_verdicts, typed_values, vote_shares,
    )
}
_SETTLED = """p AS (SELECT c_custkey, c_nationkey, (['city', 'town', 'village', 'hamlet', 'suburb', 'isolated_dwelling'])[c_custkey % 6 + 1] AS place,
      ([NULL, 0, 19999, 20000, 49999, 50000, 74999, 75000, 99999, 100000, 249999, 250000, 999999, 1000000, 12345])[(c_custkey // 6) % 15 + 1] AS people, c_custkey % 53 = 0 AS capital, c_custkey % 17 = 0 AS seat, c_custkey % 7 = 0 AS regional FROM customer)"""
_SEED = """q AS (SELECT c_custkey, c_custkey % 6 AS same, c_custkey % 5 <> 0 AS other, c_custkey % 11 AS leader, c_custkey % 3 = 0 AS far FROM customer),
      v AS (SELECT c_custkey, CASE WHEN same = 0 AND other AND leader >= 8 AND far THEN 3 WHEN same = 0 AND other AND leader >= 9 THEN 3 WHEN far AND same <= 2 THEN 2
        WHEN same <= 1 AND other AND leader >= 7 THEN 2 WHEN same <= 3 AND other AND leader >= 6 THEN 1 ELSE 0 END::BIGINT AS severity FROM q)"""
ORACLES = {
    "settlement_ladders": f"""WITH {_SETTLED},
      t AS (SELECT *, coalesce(people, 0) AS n, CASE WHEN capital OR n >= 1000000 THEN 0 WHEN n >= 250000 OR seat THEN 1 WHEN n >= 75000 THEN 2 WHEN place = 'city' OR n >= 20000 OR place = 'town' THEN 3 WHEN place IN ('village', 'hamlet') THEN 4 ELSE 5 END AS tier FROM p),
      z1 AS (SELECT *, CASE WHEN n > 0 THEN 10.5::DOUBLE - log10(n) + CASE place WHEN 'city' THEN -0.2 WHEN 'town' THEN 0 WHEN 'village' THEN 0.4 WHEN 'hamlet' THEN 1 WHEN 'suburb' THEN 1.5 ELSE 2 END
        ELSE CASE place WHEN 'city' THEN 6 WHEN 'town' THEN 7 WHEN 'village' THEN 8 WHEN 'hamlet' THEN 9.25 WHEN 'suburb' THEN 10.25 ELSE 11 END END::DOUBLE AS z FROM t),
      z2 AS (SELECT * REPLACE (CASE WHEN capital THEN least(z, 3.75) ELSE z END AS z) FROM z1), z3 AS (SELECT * REPLACE (CASE WHEN seat THEN least(z - 0.05, 4.9) ELSE z END AS z) FROM z2),
      z4 AS (SELECT * REPLACE (round(greatest(3.5, least(14, CASE WHEN regional THEN z - 0.05 ELSE z END)), 6) AS z) FROM z3)
      SELECT c_custkey, tier::BIGINT AS tier, round((5 - tier) * 1000 + CASE place WHEN 'city' THEN 500 WHEN 'town' THEN 400 WHEN 'village' THEN 300 WHEN 'hamlet' THEN 200 WHEN 'suburb' THEN 125 ELSE 75 END
        + CASE WHEN n > 0 THEN log10(n) * 140 ELSE 0 END + CASE WHEN capital THEN 500 WHEN seat THEN 25 WHEN regional THEN 20 ELSE 0 END, 4)::DOUBLE AS importance, z::DOUBLE AS zoom,
        CASE WHEN capital THEN 'country-capital' WHEN seat THEN 'admin-capital' WHEN n >= 100000 THEN 'major-city' WHEN place = 'city' AND (n >= 50000 OR regional) THEN 'major-city' END AS marker,
        CASE WHEN z < 5 THEN 90 WHEN z < 6 THEN 80 WHEN z < 7 THEN 70 WHEN z < 8 THEN 60 WHEN z < 9 THEN 50 WHEN z < 10 THEN 42 WHEN z < 11 THEN 35 WHEN z < 12 THEN 30 WHEN z < 13 THEN 25 ELSE 20 END::BIGINT AS spacing,
        CASE WHEN tier < 3 THEN 0 WHEN tier = 3 THEN 0.5 WHEN tier = 4 THEN 1.25 ELSE 1.75 END::DOUBLE AS delay,
        CASE WHEN c_custkey % 900 <= 25 THEN 'easy' WHEN c_custkey % 900 <= 100 THEN 'medium' WHEN c_custkey % 900 <= 500 THEN 'hard' ELSE 'extreme' END AS difficulty FROM z4""",
    "seed_severity": f"WITH {_SEED} SELECT * FROM v",
    "usable_seeds": f"WITH {_SETTLED}, {_SEED} SELECT c_custkey, place, severity FROM p JOIN v USING (c_custkey) WHERE severity <= 1",
    "outlier_ladder": """WITH q AS (SELECT c_custkey, c_custkey % 3 AS s5, c_custkey % 8 AS o5, s5 + (c_custkey // 7) % 3 AS s15, o5 + (c_custkey // 5) % 4 AS o15, s15 + (c_custkey // 11) % 2 AS s50, o15 + 1 AS o50 FROM customer)
      SELECT c_custkey, CASE WHEN s15 + o15 >= 5 AND s15 = 0 AND o15 >= 5 THEN 3 WHEN s5 + o5 >= 5 AND s5 / (s5 + o5) <= 0.20 THEN 2 WHEN s15 + o15 >= 8 AND s15 / (s15 + o15) <= 0.25 THEN 2
        WHEN s15 >= 2 AND o15 >= 2 THEN 1 WHEN s50 + o50 >= 5 AND s50 = 0 AND o50 >= 5 THEN 1 ELSE 0 END::BIGINT AS severity FROM q""",
    "vote_status": """WITH n AS (SELECT l_partkey, l_returnflag || l_linestatus AS code, count(*) AS n FROM lineitem WHERE l_linenumber < 6 GROUP BY 1, 2),
      r AS (SELECT *, sum(n) OVER (PARTITION BY l_partkey) AS total, coalesce(lead(n) OVER w, 0) AS second, row_number() OVER w AS k FROM n WINDOW w AS (PARTITION BY l_partkey ORDER BY n DESC, code)),
      e AS (SELECT u.l_partkey, code, coalesce(n / total, 0)::DOUBLE AS winner, coalesce(second / total, 0)::DOUBLE AS runner_up, coalesce(total, 0)::BIGINT AS samples FROM (SELECT DISTINCT l_partkey FROM lineitem) u LEFT JOIN (SELECT * FROM r WHERE k = 1) r ON u.l_partkey = r.l_partkey)
      SELECT l_partkey, code, round(winner, 6) AS winner, round(runner_up, 6) AS runner_up, samples, CASE WHEN samples = 0 THEN 'UNCLASSIFIED' WHEN winner >= 0.8 AND samples >= 20 THEN 'HIGH' WHEN winner >= 0.6 THEN 'REVIEW' ELSE 'UNCERTAIN' END AS status FROM e""",
    "same_names": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE false END AS same FROM part",
    "preferred_spelling": """WITH s AS (SELECT p_partkey, p_name, replace(p_name, 'a', 'á') AS other, length(p_name) - length(replace(p_name, 'a', '')) AS na, length(p_name) - length(replace(p_name, 'e', '')) AS ne FROM part)
      SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name || ' City' WHEN p_partkey % 2 = 0 AND na > CASE WHEN p_partkey % 3 = 1 THEN 0 ELSE ne END THEN other WHEN p_partkey % 3 = 1 THEN replace(p_name, '-', ' ') ELSE replace(p_name, 'e', 'é') END AS name FROM s""",
    "feature_codes": f"WITH {_SETTLED} SELECT c_custkey, place FROM p WHERE place IN ('city', 'town', 'village')",
    "valid_codes": "SELECT c_custkey, lpad((c_custkey % 100000)::VARCHAR, 5, '0') || '-' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') AS code FROM customer WHERE c_custkey % 3 = 0",
    "layer_kinds": """SELECT CASE WHEN lower(source) LIKE '%src1%' THEN 'label' WHEN lower(source) LIKE '%3%' OR lower(source) LIKE '%5%' THEN 'hidden' WHEN lower(source) LIKE '%src%' THEN 'site' ELSE 'other' END AS kind, count(*) AS n FROM documents GROUP BY 1""",
    "candidate_codes": """WITH q AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_custkey % 30 END AS a, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 25 END AS b, c_nationkey AS c FROM customer)
      SELECT c_custkey, 'N' || lpad(coalesce(CASE WHEN a < 20 THEN a END, CASE WHEN b < 20 THEN b END, CASE WHEN c < 20 THEN c END)::VARCHAR, 2, '0') AS code FROM q""",
    "discovered_key": "SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1",
    "visible_features": f"""WITH {_SETTLED}, l AS (SELECT c_nationkey AS k, max(c_custkey) AS last FROM customer GROUP BY 1)
      SELECT c_custkey, c_nationkey FROM p JOIN l ON k = c_nationkey WHERE (c_nationkey % 2 = 1 OR c_custkey = last) AND (c_nationkey % 3 <> 0 OR capital)""",
    "never_ordered": "SELECT p_partkey, p_brand FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)",
    "region_sections": "SELECT r_name, string_agg(n_name, '|' ORDER BY n_nationkey) AS items FROM region JOIN nation ON r_regionkey = n_regionkey WHERE n_nationkey IN (SELECT s_nationkey FROM supplier) GROUP BY 1",
    "ancestors": "SELECT o_orderkey, o_custkey, c_nationkey, n_regionkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey",
    "difficulty_order": """WITH b AS (SELECT p_brand, count(*) AS n, CASE WHEN count(*) <= 25 THEN 'easy' WHEN count(*) <= 100 THEN 'medium' WHEN count(*) <= 500 THEN 'hard' ELSE 'extreme' END AS difficulty FROM part GROUP BY 1)
      SELECT *, row_number() OVER (ORDER BY list_position(['easy', 'medium', 'hard', 'extreme'], difficulty), n, p_brand) AS place FROM b""",
    "key_sets": """WITH a AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0), b AS (SELECT s_suppkey AS k FROM supplier)
      SELECT k, 'either' AS kind FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT k, 'both' FROM (SELECT k FROM a INTERSECT SELECT k FROM b)""",
    "flag_sets": "SELECT l_orderkey, bool_or(l_returnflag IN ('A', 'R')) AS any, bool_and(l_returnflag IN ('A', 'R')) AS within, bool_and(l_linestatus = 'F') AS all FROM lineitem GROUP BY 1",
    "native_languages": "SELECT s_suppkey, CASE WHEN s_nationkey % 2 = 0 THEN 'eng' WHEN s_nationkey = 7 THEN NULL WHEN s_nationkey % 3 = 0 THEN 'eng' ELSE 'fra' END AS language FROM supplier",
    "two_line_labels": "WITH q AS (SELECT p_type, min(upper(p_brand)) AS display FROM part GROUP BY 1) SELECT p_partkey, display || chr(10) || p_name AS label FROM part JOIN q USING (p_type)",
    "click_verdicts": """WITH a AS (SELECT DISTINCT event_id % 3 AS f, event_type AS t FROM events WHERE (length(event_type) + event_id % 3) % 2 = 0),
      c AS (SELECT event_id, ts, user_id, event_id % 3 AS f, a.f IS NOT NULL AS hit, event_type, (ts, event_id) AS o FROM events LEFT JOIN a ON a.f = event_id % 3 AND a.t = event_type),
      r AS (SELECT user_id, event_type AS t, min(o) AS o FROM c WHERE hit GROUP BY 1, 2),
      d AS (SELECT user_id, f, max(o) AS o, count(*) AS n FROM r JOIN a USING (t) GROUP BY 1, 2),
      n AS (SELECT f, count(*) AS n FROM a GROUP BY f)
      SELECT event_id, CASE WHEN n.n IS NULL THEN 'ignored' WHEN user_id % 3 <> 0 AND d.n = n.n AND d.o < c.o THEN 'ignored' WHEN hit THEN 'right' ELSE 'wrong' END AS verdict
      FROM c LEFT JOIN n USING (f) LEFT JOIN d USING (user_id, f)""",
    "typed_values": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 1 THEN p_brand ELSE '' END AS as_string, CASE WHEN p_partkey % 2 = 0 THEN p_brand || '|' || p_type ELSE '' END AS as_list FROM part",
    "vote_shares": "SELECT user_id, event_type, round(count(*) / sum(count(*)) OVER (PARTITION BY user_id), 6)::DOUBLE AS share FROM events GROUP BY 1, 2",
}
