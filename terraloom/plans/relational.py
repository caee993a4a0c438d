"""Queries over keys, names, groups and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import text as T
from ..operators import aggregate as A
from ..operators import joins as J
from ..operators import quiz as Z
from ..operators import ranking as R
from .tables import table


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.withColumn("values", Z.as_list(F.col("p_brand"))).withColumn("answers", F.array(F.col("p_type")))


def group_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.answers_of(Z.full_group(_parts(spark, sf_dir)), "answers")


def group_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.property_group(_parts(spark, sf_dir), "values", ["Brand#11", "Brand#23"]).select("p_partkey", "p_type")


def group_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a saved group: those that were ever returned."""
    rows = _parts(spark, sf_dir).withColumn("fid", Z.feature_id(F.lit(None), F.col("p_partkey")))
    saved = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").cast("string").alias("fid")).distinct()
    return Z.saved_group(rows, "fid", saved).select("fid", "p_type")


def group_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.group_options(_parts(spark, sf_dir), "values")


def active_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types as questions; those that some part of two brands answers, with the displayed answers of each feature."""
    parts = _parts(spark, sf_dir)
    questions = parts.groupBy(F.col("p_type").alias("answer")).agg(F.min("p_partkey").alias("ord"), F.min(F.upper("p_type")).alias("display"))
    group = Z.property_group(parts, "values", ["Brand#11", "Brand#23"])
    shown = Z.questions_in_order(group, Z.active_questions(questions, group, "answers"), "p_partkey", "answers")
    return shown.select("p_partkey", F.array_join("displays", "|").alias("displays"))


def answer_set_dissolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by the complete set of their lines' return flags and statuses."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("code"))  # noqa: E741
    out = A.dissolve_by_answers(A.answer_sets(l, "l_orderkey", "code"), "l_orderkey")
    return out.select("answer_id", "members", "first_member")


def prefix_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("code", F.lpad(F.col("c_custkey").cast("string"), 6, "0"))
    return A.prefix_rollup(c, "code", [1, 2, 3, 4], F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance")).withColumn("level", F.col("level").cast("long"))


def mode_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.mode(table(spark, sf_dir, "events"), "user_id", "event_type", "greatest")


def mode_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.mode(table(spark, sf_dir, "events"), "user_id", "event_type", "first", "event_id")


def dominance_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.dominance_ladder(table(spark, sf_dir, "events"), "user_id", "event_type").select("user_id", "event_type", "first", "second", "total", "verdict")


def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.percentiles(table(spark, sf_dir, "customer"), "c_nationkey", "c_acctbal", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    return out.select("c_nationkey", *[F.round(c, 6).alias(c) for c in ("p10", "p50", "p90")])


def rank_cap_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten richest customers of each nation, with its first of the BUILDING segment among them whatever its balance."""
    c = table(spark, sf_dir, "customer")
    out = R.cap_with_forced(c, "c_nationkey", [F.desc("c_acctbal"), F.asc("c_custkey")], 10, F.col("c_mktsegment") == "BUILDING")
    return out.select("c_nationkey", "c_custkey", F.col("rank").cast("long").alias("rank"))


def population_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without a positive balance take the total of their orders; who has neither goes."""
    c = table(spark, sf_dir, "customer")
    spent = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("spent"))
    fine = c.where("c_acctbal > 0").select("c_custkey", F.col("c_acctbal").alias("amount"), F.lit("own").alias("source"))
    rescued = c.where("NOT (c_acctbal > 0)").join(spent, "c_custkey").where("spent > 0").select("c_custkey", F.col("spent").alias("amount"), F.lit("orders").alias("source"))
    return fine.unionByName(rescued)


def label_disambiguation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.disambiguate(table(spark, sf_dir, "part"), "p_name", ["p_brand", "p_type"]).select("p_partkey", "display")


def suffix_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.suffix_ids(table(spark, sf_dir, "part"), "p_name", [F.asc("p_partkey")]).select("p_partkey", "id")


def top_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_margin(table(spark, sf_dir, "part"), "p_brand", "p_retailprice", "p_partkey").select("p_brand", "p_partkey", F.round("margin", 6).alias("margin"))


def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.even_sample(table(spark, sf_dir, "customer"), "c_nationkey", [F.asc("c_custkey")], 7).select("c_nationkey", "c_custkey")


def name_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.name_key(F.col("text")), 256).alias("key"))


def token_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in common of part names of one brand and size."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_size", "p_partkey", F.array_distinct(T.tokens(F.col("p_name"))).alias("words"))
    return J.scored_pairs(p, "p_partkey", ["p_brand", "p_size"], "words", F.round(T.words_jaccard(F.col("words"), F.col("words_2")), 6), "jaccard")


def edit_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of neighbouring customers' padded keys that one edit parts."""
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment", "c_custkey").withColumn("code", F.col("c_custkey").cast("string"))
    return J.one_edit_pairs(c, "c_custkey", ["c_nationkey", "c_mktsegment"], "code")


def range_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of labels made of part keys: a range, ten of a digit, two digits, and two digits with a third or an x."""
    k = F.col("p_partkey")
    two = F.lpad((k % 90).cast("string"), 2, "0")
    label = F.when(k % 5 == 0, F.concat_ws("-", two, F.lpad((k % 90 + k % 10).cast("string"), 2, "0"))).when(k % 5 == 1, F.concat((k % 10).cast("string"), F.lit("x"))).when(k % 5 == 2, two).when(k % 5 == 3, F.concat(two, F.lit("x"))).otherwise(F.concat(two, (k % 10).cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(T.range_codes(label), ",").alias("codes"))


def phone_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area codes of numbers made of customer keys, as +27, 0027, 27, trunk 0, another country's, or without a 0."""
    k = F.col("c_custkey")
    body = F.lpad((k * 7919 % 1000000000).cast("string"), 9, "2")
    said = F.when(k % 6 == 0, F.concat(F.lit("+27 "), body)).when(k % 6 == 1, F.concat(F.lit("0027"), body)).when(k % 6 == 2, F.concat(F.lit("(0"), F.substring(body, 1, 2), F.lit(") "), F.substring(body, 3, 7), F.lit(" ext 5")))
    said = said.when(k % 6 == 3, F.concat(F.lit("+44"), body)).when(k % 6 == 4, F.concat(F.lit("27"), body)).otherwise(body)
    return table(spark, sf_dir, "customer").select("c_custkey", T.area_code(said, "27", [f"0{n}" for n in range(10, 60)]).alias("area"))


def stable_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(T.stable_unit(F.col("s_name")), 9).alias("unit"))


def lookup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by the status of their first order, with those that never ordered as a status of their own."""
    first = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min_by("o_orderstatus", "o_orderkey").alias("status"))
    joined, missing = J.lookup(table(spark, sf_dir, "customer").select("c_custkey"), first, ["c_custkey"])
    found = joined.where("status IS NOT NULL").groupBy(F.col("status").alias("segment")).agg(F.count(F.lit(1)).alias("n"))
    return found.unionByName(missing.agg(F.count(F.lit(1)).alias("n")).select(F.lit("(missing keys)").alias("segment"), "n"))


def exact_one_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers of one nation whose balances agree to the hundred, where neither has another choice."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.floor(F.col("c_acctbal") / 100).alias("band"), "c_custkey")
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.floor(F.col("s_acctbal") / 100).alias("band"), "s_suppkey")
    return J.exactly_one(c, s, ["nation", "band"], "c_custkey", "s_suppkey").select("c_custkey", "s_suppkey")


def coverage_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return J.coverage(a, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), ["k"]).groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("keys"))


def code_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers under the parent whose code starts theirs."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("code"))
    parent = c.groupBy(F.substring("code", 1, 4).alias("parent_code")).agg(F.count(F.lit(1)).alias("size"))
    return J.by_code_prefix(c, parent, "code", "parent_code", 4).select("c_custkey", "parent_code", "size")


def entity_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names in three spellings resolved against the plain ones: exact, then by key, then by skeleton."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name")
    noisy = p.select(F.col("p_partkey").alias("left_id"), "p_brand", F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, F.upper("p_name")).otherwise(F.regexp_replace("p_name", "[aeiou]", "")).alias("said"))
    stages = [("exact", F.col("said"), F.col("p_name")), ("key", T.name_key(F.col("said")), T.name_key(F.col("p_name"))), ("skeleton", F.regexp_replace(T.name_key(F.col("said")), "[aeiou]", ""), F.regexp_replace(T.name_key(F.col("p_name")), "[aeiou]", ""))]
    return J.cascade(noisy, p.withColumnRenamed("p_partkey", "right_id"), "left_id", "right_id", stages, ["p_brand"])


def dup_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.duplicates(table(spark, sf_dir, "documents").withColumn("key", F.md5(F.coalesce("text", F.lit("")))), ["key"])


def hierarchy_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each level and those without a parent."""
    n, r, c = (table(spark, sf_dir, t) for t in ("nation", "region", "customer"))
    lost = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("customer").alias("level"), "n")
    return lost.unionByName(n.join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("nation").alias("level"), "n"))


def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.profile(table(spark, sf_dir, "customer"), 3)
    return out.select("column", "rows", "missing", "distinct")


def two_level_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.counts_by(table(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment")
    return out.select("c_nationkey", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("counts"))


def session_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals of each user's events, as a session of guesses: answered so far, errors so far, total value."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return e.select("event_id", "user_id", F.count(F.lit(1)).over(w).alias("answered"), F.sum((F.col("event_type") == "error").cast("long")).over(w).alias("errors"), F.round(F.sum("value").over(w), 2).alias("total"))


QUERIES = {
    f.__name__: f
    for f in (
        group_full, group_property, group_features, group_options, active_questions, answer_set_dissolve, prefix_rollup, mode_ties, mode_first_seen, dominance_ladder, percentiles,
        rank_cap_force, population_rescue, label_disambiguation, suffix_ids, top_margin, even_sample, name_key, token_jaccard, edit_one, range_labels, phone_codes, stable_hash,
        lookup_report, exact_one_join, coverage_diff, code_hierarchy, entity_cascade, dup_detect, hierarchy_check, column_profile, two_level_counts, session_totals,
    )
}
ORACLES = {
    "group_full": "SELECT DISTINCT p_type AS answer FROM part",
    "group_property": "SELECT p_partkey, p_type FROM part WHERE p_brand IN ('Brand#11', 'Brand#23')",
    "group_features": "SELECT p_partkey::VARCHAR AS fid, p_type FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')",
    "group_options": "SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1",
    "active_questions": "SELECT p_partkey, upper(p_type) AS displays FROM part WHERE p_brand IN ('Brand#11', 'Brand#23')",
    "answer_set_dissolve": "WITH s AS (SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_returnflag || l_linestatus)), '-') AS answer_id FROM lineitem GROUP BY 1) SELECT answer_id, count(*) AS members, min(l_orderkey) AS first_member FROM s GROUP BY 1",
    "prefix_rollup": "SELECT level, substring(lpad(c_custkey::VARCHAR, 6, '0'), 1, level::INT) AS prefix, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer, (SELECT unnest([1, 2, 3, 4])::BIGINT AS level) GROUP BY 1, 2",
    "mode_ties": "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type DESC) = 1",
    "mode_first_seen": "SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) = 1",
    "dominance_ladder": """WITH v AS (SELECT user_id, event_type, count(*) AS first FROM events GROUP BY 1, 2),
      r AS (SELECT *, coalesce(lead(first) OVER w, 0) AS second, (sum(first) OVER (PARTITION BY user_id))::BIGINT AS total, row_number() OVER w AS n FROM v WINDOW w AS (PARTITION BY user_id ORDER BY first DESC, event_type))
      SELECT user_id, event_type, first, second, total, CASE WHEN first = total THEN 'unanimous' WHEN total >= 3 AND first >= 2 * second THEN 'dominant' WHEN total >= 5 AND first >= 0.6 * total THEN 'majority' ELSE 'ambiguous' END AS verdict FROM r WHERE n = 1""",
    "percentiles": "SELECT c_nationkey, round(quantile_cont(c_acctbal, 0.1), 6) AS p10, round(quantile_cont(c_acctbal, 0.5), 6) AS p50, round(quantile_cont(c_acctbal, 0.9), 6) AS p90 FROM customer GROUP BY 1",
    "rank_cap_force": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer), f AS (SELECT *, min(CASE WHEN c_mktsegment = 'BUILDING' THEN rank END) OVER (PARTITION BY c_nationkey) AS f FROM r)
      SELECT c_nationkey, c_custkey, least(rank, 10) AS rank FROM f WHERE CASE WHEN f > 10 THEN rank < 10 OR rank = f ELSE rank <= 10 END""",
    "population_rescue": """SELECT c_custkey, c_acctbal AS amount, 'own' AS source FROM customer WHERE c_acctbal > 0 UNION ALL
      SELECT c_custkey, round(sum(o_totalprice), 2) AS amount, 'orders' AS source FROM customer JOIN orders ON o_custkey = c_custkey WHERE NOT c_acctbal > 0 GROUP BY 1 HAVING sum(o_totalprice) > 0""",
    "label_disambiguation": """WITH o AS (SELECT p_partkey, p_name AS a, p_name || ', ' || p_brand AS b, p_name || ', ' || p_brand || ', ' || p_type AS c FROM part)
      SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY a) = 1 THEN a WHEN count(*) OVER (PARTITION BY b) = 1 THEN b ELSE c END AS display FROM o""",
    "suffix_ids": "SELECT p_partkey, CASE WHEN n = 1 THEN p_name ELSE p_name || '-' || n END AS id FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)",
    "top_margin": "SELECT p_brand, p_partkey, round(p_retailprice - coalesce(lead(p_retailprice) OVER w, 0), 6) AS margin FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) QUALIFY row_number() OVER w = 1",
    "even_sample": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) SELECT c_nationkey, c_custkey FROM r WHERE n <= 7 OR i IN (SELECT (k * r.n) // 7 FROM range(7) t(k))",
    "name_key": r"SELECT doc_id, sha256(regexp_replace(lower(strip_accents(text)), '[^\p{L}\p{N}]+', '', 'g')) AS key FROM documents",
    "token_jaccard": r"""WITH t AS (SELECT *, list_distinct(list_filter(string_split(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')) AS w FROM part)
      SELECT a.p_partkey, b.p_partkey AS p_partkey_2, round(len(list_intersect(a.w, b.w)) / len(list_distinct(a.w || b.w))::DOUBLE, 6) AS jaccard FROM t a JOIN t b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey""",
    "edit_one": "SELECT a.c_custkey, b.c_custkey AS c_custkey_2 FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.c_custkey < b.c_custkey WHERE levenshtein(a.c_custkey::VARCHAR, b.c_custkey::VARCHAR) <= 1",
    "range_labels": """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN array_to_string(list_transform(range(p_partkey % 90, p_partkey % 90 + p_partkey % 10 + 1), lambda x: lpad(x::VARCHAR, 2, '0')), ',')
      WHEN 1 THEN array_to_string(list_filter(list_transform(range(10), lambda d: (p_partkey % 10)::VARCHAR || d::VARCHAR), lambda s: s <> '00'), ',') ELSE lpad((p_partkey % 90)::VARCHAR, 2, '0') END AS codes FROM part""",
    "phone_codes": """WITH b AS (SELECT *, lpad((c_custkey * 7919 % 1000000000)::VARCHAR, 9, '2') AS n FROM customer),
      d AS (SELECT c_custkey, CASE WHEN c_custkey % 6 IN (0, 1, 2, 4) THEN '0' || n WHEN c_custkey % 6 = 3 THEN NULL WHEN n LIKE '27%' THEN '0' || n[3:] WHEN n LIKE '0%' THEN n END AS said FROM b)
      SELECT c_custkey, CASE WHEN said[1:3] BETWEEN '010' AND '059' THEN said[1:3] END AS area FROM d""",
    "stable_hash": "SELECT s_suppkey, round(list_reduce([0::HUGEINT] || list_transform(string_split(s_name, ''), lambda c: ord(c)::HUGEINT), lambda h, c: (h * 31 + c) % 4294967296)::BIGINT % 1000 / 1000::DOUBLE * 0.18, 9) AS unit FROM supplier",
    "lookup_report": """WITH f AS (SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1) SELECT status AS segment, count(*) AS n FROM customer JOIN f ON o_custkey = c_custkey GROUP BY 1
      UNION ALL SELECT '(missing keys)', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM f)""",
    "exact_one_join": """WITH p AS (SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND floor(c_acctbal / 100) = floor(s_acctbal / 100))
      SELECT * FROM p QUALIFY count(*) OVER (PARTITION BY c_custkey) = 1 AND count(*) OVER (PARTITION BY s_suppkey) = 1""",
    "coverage_diff": """WITH a AS (SELECT c_custkey AS k FROM customer), b AS (SELECT DISTINCT o_custkey AS k FROM orders)
      SELECT CASE WHEN a.k IS NULL THEN 'right' WHEN b.k IS NULL THEN 'left' ELSE 'both' END AS side, count(*) AS n, sum(coalesce(a.k, b.k))::BIGINT AS keys FROM a FULL JOIN b ON a.k = b.k GROUP BY 1""",
    "code_hierarchy": "SELECT c_custkey, lpad(c_custkey::VARCHAR, 6, '0')[1:4] AS parent_code, count(*) OVER (PARTITION BY lpad(c_custkey::VARCHAR, 6, '0')[1:4]) AS size FROM customer",
    "dup_detect": "SELECT md5(coalesce(text, '')) AS key, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "hierarchy_check": "SELECT 'customer' AS level, count(*) AS n FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation) UNION ALL SELECT 'nation', count(*) FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region)",
    "column_profile": " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) AS rows, count(*) FILTER ({c} IS NULL OR trim({c}::VARCHAR) = '') AS missing, count(DISTINCT {c}) AS distinct FROM customer""" for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")),
    "two_level_counts": "WITH v AS (SELECT c_nationkey, c_mktsegment AS k, count(*) AS n FROM customer GROUP BY 1, 2) SELECT c_nationkey, string_agg(k || '=' || n, ',' ORDER BY k) AS counts FROM v GROUP BY 1",
    "session_totals": "SELECT event_id, user_id, count(*) OVER w AS answered, (sum((event_type = 'error')::INT) OVER w)::BIGINT AS errors, round(sum(value) OVER w, 2) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)",
    "entity_cascade": r"""WITH l AS (SELECT p_partkey AS left_id, p_brand, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) ELSE regexp_replace(p_name, '[aeiou]', '', 'g') END AS said FROM part),
      k AS (SELECT left_id, p_brand, said AS k1, regexp_replace(lower(strip_accents(said)), '[^\p{L}\p{N}]+', '', 'g') AS k2 FROM l), a AS (SELECT *, regexp_replace(k2, '[aeiou]', '', 'g') AS k3 FROM k),
      r AS (SELECT p_partkey AS right_id, p_brand, p_name AS k1, regexp_replace(lower(strip_accents(p_name)), '[^\p{L}\p{N}]+', '', 'g') AS k2 FROM part), b AS (SELECT *, regexp_replace(k2, '[aeiou]', '', 'g') AS k3 FROM r),
      s1 AS (SELECT left_id, min(right_id) AS right_id FROM a JOIN b USING (p_brand, k1) WHERE a.k1 <> '' GROUP BY 1 HAVING count(*) = 1), s2 AS (SELECT left_id, min(right_id) AS right_id FROM a JOIN b USING (p_brand, k2) WHERE a.k2 <> '' GROUP BY 1 HAVING count(*) = 1),
      s3 AS (SELECT left_id, min(right_id) AS right_id FROM a JOIN b USING (p_brand, k3) WHERE a.k3 <> '' GROUP BY 1 HAVING count(*) = 1)
      SELECT left_id, coalesce(s1.right_id, s2.right_id, s3.right_id) AS right_id, CASE WHEN s1.right_id IS NOT NULL THEN 'exact' WHEN s2.right_id IS NOT NULL THEN 'key' WHEN s3.right_id IS NOT NULL THEN 'skeleton' END AS stage
      FROM l LEFT JOIN s1 USING (left_id) LEFT JOIN s2 USING (left_id) LEFT JOIN s3 USING (left_id)""",
}
