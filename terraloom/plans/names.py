"""Queries that match noisy part names with a register of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import resolution as R
from ..operators import similar as S
from .tables import table

STOP, GENERIC = ["the"], ["small", "large"]
_SAID = """CASE p_partkey % 8 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN 'The ' || p_name WHEN 3 THEN replace(p_name, ' ', '') WHEN 4 THEN {strip}
  WHEN 5 THEN split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) WHEN 6 THEN substring(p_name, 2) ELSE replace(p_name, ' ', ' extra ') END"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    said = F.expr(_SAID.format(strip="regexp_replace(p_name, '[aeiou]', '')"))
    left = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("scope"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).alias("hint"), said.alias("name"))
    right = p.groupBy(F.col("p_brand").alias("scope"), F.col("p_type").alias("area"), F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("right_id"))
    return left, right.withColumn("priority", F.col("right_id") % 3 + 1)


def entity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names in eight spellings resolved within their brand, the type as area: forced and manual rows, six forms, contained words, typos."""
    left, right = _sides(spark, sf_dir)
    off, hand = left.where("id % 50 = 0").select("id"), left.where("id % 50 = 1").select("id", F.col("id").alias("right_id"))
    return R.resolve(left, right, off, hand, stop=STOP, generic=GENERIC, fuzzy=False)


def two_edit_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noisy and plain part names of one brand at most two edits apart."""
    left, right = _sides(spark, sf_dir)
    return S.within_two_edits(left.withColumnRenamed("name", "said"), right, ["scope"], "said", "name", 2).withColumn("edits", F.col("edits").cast("long"))


QUERIES = {f.__name__: f for f in (entity_resolution, two_edit_names)}
_SIDES = f"""l AS (SELECT p_partkey AS id, p_brand AS scope, CASE WHEN p_partkey % 3 = 0 THEN p_type END AS hint, {_SAID.format(strip="regexp_replace(p_name, '[aeiou]', '', 'g')")} AS name FROM part),
  r AS (SELECT p_brand AS scope, p_type AS area, p_name AS name, min(p_partkey) AS right_id, min(p_partkey) % 3 + 1 AS priority FROM part GROUP BY 1, 2, 3)"""
_FORMS = "lower(trim(name)) AS f0, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS f1, list_filter(string_split(f1, ' '), lambda t: t NOT IN ('', 'the')) AS c, array_to_string(c, ' ') AS f2, array_to_string(c, '') AS f3, regexp_replace(f3, '[aeiou]', '', 'g') AS f4, list_sort(list_distinct(list_filter(c, lambda t: t NOT IN ('small', 'large')))) AS w, array_to_string(w, ' ') AS f5"
ORACLES = {
    "two_edit_names": f"WITH {_SIDES} SELECT DISTINCT scope, l.name AS said, r.name AS name, levenshtein(l.name, r.name) AS edits FROM l JOIN r USING (scope) WHERE edits <= 2 AND l.name <> '' AND abs(length(l.name) - length(r.name)) <= 2",
    "entity_resolution": f"""WITH {_SIDES}, a AS (SELECT *, {_FORMS} FROM l), b AS (SELECT *, {_FORMS} FROM r),
      ak AS (SELECT id, scope, hint, unnest([0, 1, 2, 3, 4, 5]) AS k, unnest([f0, f1, f2, f3, f4, f5]) AS key FROM a), bk AS (SELECT right_id, scope, area, priority, unnest([0, 1, 2, 3, 4, 5]) AS k, unnest([f0, f1, f2, f3, f4, f5]) AS key FROM b),
      m AS (SELECT ak.id, ak.k, right_id, priority, coalesce(area = hint, false) AS near FROM ak JOIN bk USING (scope, k, key) WHERE key <> ''),
      top AS (SELECT id, k, near, right_id FROM (SELECT id, k, true AS near, right_id, priority FROM m WHERE near UNION ALL SELECT id, k, false, right_id, priority FROM m) QUALIFY priority = max(priority) OVER (PARTITION BY id, k, near)),
      one AS (SELECT id, k, near, min(right_id) AS right_id FROM top GROUP BY ALL HAVING count(*) = 1),
      s1 AS (SELECT id, right_id, ['exact', 'loose', 'core', 'compact', 'skeleton', 'significant'][k + 1] AS stage FROM one QUALIFY row_number() OVER (PARTITION BY id ORDER BY k, near DESC) = 1),
      t AS (SELECT a.id, b.right_id, coalesce(area = hint, false) AS near, len(a.w) AS n, len(b.w) AS o, len(list_intersect(a.w, b.w)) AS c, CASE WHEN n <= o THEN a.f5 ELSE b.f5 END AS short FROM a JOIN b USING (scope) WHERE len(a.w) > 0 AND len(b.w) > 0),
      t2 AS (SELECT * FROM t WHERE c = least(n, o) AND (n = o OR c >= 2 OR (length(short) >= 6 AND greatest(n, o) <= 2))), t3 AS (SELECT * FROM t2 QUALIFY near OR NOT bool_or(near) OVER (PARTITION BY id)),
      s2 AS (SELECT id, min(right_id) AS right_id, 'containment' AS stage FROM t3 GROUP BY 1 HAVING count(*) = 1),
      e AS (SELECT a.id, b.right_id, levenshtein(a.f3, b.f3) AS d FROM a JOIN b USING (scope) WHERE length(a.f3) >= 6 AND length(b.f3) >= 6 AND abs(length(a.f3) - length(b.f3)) <= 1),
      s3 AS (SELECT id, min(right_id) AS right_id, 'typo' AS stage FROM e WHERE d <= 2 GROUP BY 1 HAVING count(*) = 1 AND min(d) = 1)
      SELECT l.id, CASE WHEN l.id % 50 = 0 THEN NULL WHEN l.id % 50 = 1 THEN l.id ELSE coalesce(s1.right_id, s2.right_id, s3.right_id) END AS right_id,
        CASE WHEN l.id % 50 = 0 THEN 'unresolved' WHEN l.id % 50 = 1 THEN 'manual' ELSE coalesce(s1.stage, s2.stage, s3.stage) END AS stage FROM l LEFT JOIN s1 USING (id) LEFT JOIN s2 USING (id) LEFT JOIN s3 USING (id)""",
}
