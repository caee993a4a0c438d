"""Queries that read and write files, run streams, and loop over graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo as G
from ..operators import clusters as L
from ..operators import spatial as S
from ..operators._shared import scratch
from ..sources import files, sinks
from ..streaming import sessions
from .tables import SQL_LAT, SQL_LON, SQL_POINTS, boxes, customers, suppliers, table


def geojson_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as point features and read again."""
    c, path = customers(spark, sf_dir), scratch(spark, "features")
    feature = sinks.feature_json(F.col("c_custkey"), {"name": F.col("c_name"), "segment": F.col("c_mktsegment")}, F.lit("Point"), sinks.point_coordinates(F.col("lat"), F.col("lon")))
    sinks.write_geojson_lines(c, feature, path)
    return files.geojson_lines(spark, path, "name: string, segment: string").select("id", "name", "segment", *files.point_of(F.col("coordinates")))


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "table")
    sinks.write_csv(table(spark, sf_dir, "supplier").select(F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("code"), "s_name"), path)
    return files.csv_table(spark, path, "code string, s_name string")


def partitioned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers laid out by a code of their nation, and one partition read back."""
    path = scratch(spark, "customers")
    code = F.concat(F.lit("n"), F.char(F.col("c_nationkey") + 97), F.lit("x"))
    sinks.write_partitioned_json(table(spark, sf_dir, "customer").select("c_custkey", "c_name", code.alias("country_id")), path, "country_id")
    return files.partition_of(spark, path, "country_id", "nhx", "c_custkey long, c_name string, country_id string").select("c_custkey", "c_name")


def session_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.fold_sessions(_actions(table(spark, sf_dir, "events")))


def _actions(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    action = F.when(kind == "click", "right").when(kind == "error", "wrong").when(kind == "signup", "restart").when(kind == "view", "skip").otherwise("wrong")
    return events.select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("ordinal"), action.alias("action"))


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events counted by hour as a stream that ends; windows that the watermark has passed are final."""
    batch = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(batch.schema).parquet(f"{sf_dir}/events.parquet*")
    out = scratch(spark, "windows")
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    counted = sessions.windowed_counts(timed).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
    counted.writeStream.outputMode("append").option("checkpointLocation", scratch(spark, "stream")).format("parquet").trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(counted.schema).parquet(out)


def _grid_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' boxes of 4 degrees, by the first customer of each place."""
    c = boxes(table(spark, sf_dir, "customer"), "c_custkey", F.lit(4.0))
    return c.groupBy("west", "south", "east", "north").agg(F.min("c_custkey").alias("id"))


def _supplier_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = boxes(table(spark, sf_dir, "supplier").withColumn("k", F.col("s_suppkey") * 7 + 3), "k", F.lit(6.0))
    return s.groupBy("west", "south", "east", "north").agg(F.min("s_suppkey").alias("rid"))


def overlap_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.overlapping_boxes(_grid_boxes(spark, sf_dir), _supplier_boxes(spark, sf_dir), "id", "rid")
    return S.largest_overlap(found, "id", "rid").select("id", "rid", F.round("area", 6).alias("area"), F.round("percent", 6).alias("percent"))


def overlap_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.overlapping_boxes(_grid_boxes(spark, sf_dir), _supplier_boxes(spark, sf_dir), "id", "rid")
    return S.overlap_assignments(found, "id", "rid", 2.0, 0.05, 0.5).select("id", "rid", F.round("area", 6).alias("area"))


def iou_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.overlapping_boxes(_grid_boxes(spark, sf_dir), _supplier_boxes(spark, sf_dir), "id", "rid")
    return S.iou_match(found, "id", "rid", 0.2, 0.05).select("id", "rid", F.round("iou", 6).alias("iou"))


def box_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.box_adjacency(_grid_boxes(spark, sf_dir), "id").select("src", "dst", F.round("shared", 6).alias("shared"))


def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first supplier box, as a polygon with a square hole, that holds a customer."""
    b = _supplier_boxes(spark, sf_dir)
    hole = G.box_ring(F.col("west") + 2, F.col("south") + 2, F.col("west") + 3, F.col("south") + 3)
    polygons = b.select("rid", F.array(G.box_ring(F.col("west"), F.col("south"), F.col("east"), F.col("north")), hole).alias("rings"), F.col("rid").alias("ord"))
    points = customers(spark, sf_dir).withColumn("lat", F.col("lat") + 0.001).withColumn("lon", F.col("lon") + 0.001)
    return S.points_in_polygons(points, polygons, "c_custkey", "rid", 2.0)


def distance_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-link clusters of customers 250 km apart."""
    return L.single_link(customers(spark, sf_dir), "c_custkey", 250.0).select(F.col("c_custkey").alias("id"), F.col("cluster").alias("component"))


def propagate_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of every tenth customer spread over customers 400 km apart."""
    nodes = customers(spark, sf_dir).select(F.col("c_custkey").alias("id"), "lat", "lon", F.when(F.col("c_custkey") % 10 == 0, F.col("c_nationkey").cast("string")).alias("code"))
    return L.spread_labels(nodes, "id", "code", 400.0, 1000.0 - F.col("km")).select("id", "code", F.col("round").cast("long").alias("round"))


def multi_source_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least distance over 500 km hops from every fiftieth customer."""
    points = customers(spark, sf_dir).withColumnRenamed("c_custkey", "id")
    seeds = points.where("id % 50 = 0").select("id", F.col("c_nationkey").cast("string").alias("prefix"))
    return L.seed_paths(points, seeds, "id", 500.0, F.round("km")).select("id", F.round("dist", 3).alias("dist"), "prefix", "seed")


def frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds in which 300 km hops reach customers from every hundredth."""
    points = customers(spark, sf_dir).select(F.col("c_custkey").alias("id"), "lat", "lon")
    return L.reached(points, points.where("id % 100 = 0"), "id", 300.0).select("id", F.col("round").cast("long").alias("round"))


QUERIES = {
    f.__name__: f
    for f in (
        geojson_round_trip, csv_round_trip, partitioned_scan, session_fold, stream_windows, overlap_argmax, overlap_multi, iou_match, box_adjacency, point_in_polygon,
        distance_components, propagate_labels, multi_source_path, frontier,
    )
}
_KM = "(12742.0176 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))))"
_BOXES = f"""
    g AS (SELECT floor({SQL_LON.format(k="c_custkey")})::DOUBLE AS west, floor({SQL_LAT.format(k="c_custkey")})::DOUBLE AS south, min(c_custkey) AS id FROM customer GROUP BY 1, 2),
    r AS (SELECT floor({SQL_LON.format(k="s_suppkey * 7 + 3")})::DOUBLE AS west, floor({SQL_LAT.format(k="s_suppkey * 7 + 3")})::DOUBLE AS south, min(s_suppkey) AS rid FROM supplier GROUP BY 1, 2),
    o AS (SELECT id, rid, greatest(0, least(g.west + 4, r.west + 6) - greatest(g.west, r.west)) * greatest(0, least(g.south + 4, r.south + 6) - greatest(g.south, r.south)) AS area FROM g, r),
    p AS (SELECT * FROM o WHERE area > 0)"""
_NEAR = f"""
    n AS (SELECT c_custkey AS id, {SQL_LAT.format(k="c_custkey")} AS lat, {SQL_LON.format(k="c_custkey")} AS lon, c_nationkey::VARCHAR AS nation FROM customer),
    d AS MATERIALIZED (SELECT a.id AS src, b.id AS dst, {_KM} AS km FROM n a JOIN n b ON a.id <> b.id WHERE {_KM} <= 500)"""
ORACLES = {
    # Each step of the recursion is a whole round: all rows of the state, and its number.
    "propagate_labels": f"""WITH RECURSIVE {_NEAR},
      s(k, id, code, round, new) AS (SELECT 0::BIGINT, id, CASE WHEN id % 10 = 0 THEN nation END, CASE WHEN id % 10 = 0 THEN 0::BIGINT END, true FROM n
        UNION ALL
        SELECT k + 1, id, coalesce(code, best), coalesce(round, CASE WHEN best IS NOT NULL THEN k + 1 END), bool_or(code IS NULL AND best IS NOT NULL) OVER () FROM (
          SELECT s.k, s.id, s.code, s.round, s.new, b.best FROM s LEFT JOIN (
            SELECT src, code AS best FROM (
              SELECT src, code, round(0.5 * shared / max(shared) OVER (PARTITION BY src) + 0.2 * n / max(n) OVER (PARTITION BY src), 9) AS score FROM (
                SELECT d.src, o.code, sum(1000 - km) AS shared, count(*) AS n FROM d JOIN s o ON o.id = d.dst AND o.code IS NOT NULL WHERE km <= 400 GROUP BY d.src, o.code))
            QUALIFY row_number() OVER (PARTITION BY src ORDER BY score DESC, code) = 1) b ON b.src = s.id AND s.code IS NULL WHERE s.new))
      SELECT id, code, round FROM s QUALIFY k = max(k) OVER ()""",
    "multi_source_path": f"""WITH RECURSIVE {_NEAR},
      p(k, id, b, new) AS (SELECT 0, id, {{'dist': 0.0::DOUBLE, 'prefix': nation, 'seed': id}}, true FROM n WHERE id % 50 = 0
        UNION ALL
        SELECT k + 1, id, b, bool_or(b IS DISTINCT FROM was) OVER () FROM (
          SELECT k, id, min(b) AS b, min(was) AS was FROM (SELECT k, id, b, b AS was FROM p WHERE new
            UNION ALL SELECT p.k, d.dst, {{'dist': b.dist + round(km), 'prefix': b.prefix, 'seed': b.seed}}, NULL FROM p JOIN d ON d.src = p.id WHERE p.new) GROUP BY k, id))
      SELECT id, round(b.dist, 3) AS dist, b.prefix AS prefix, b.seed AS seed FROM p QUALIFY k = max(k) OVER ()""",
    "geojson_round_trip": f"SELECT c_custkey::VARCHAR AS id, c_name AS name, c_mktsegment AS segment, {SQL_LAT.format(k='c_custkey')} AS lat, {SQL_LON.format(k='c_custkey')} AS lon FROM customer",
    "csv_round_trip": "SELECT lpad(s_suppkey::VARCHAR, 6, '0') AS code, s_name FROM supplier",
    "partitioned_scan": "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 7",
    "stream_windows": """WITH w AS (SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2)
      SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, event_type, n, total FROM w WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
    "overlap_argmax": f"WITH {_BOXES} SELECT id, rid, round(area, 6) AS area, round(area / 16 * 100, 6) AS percent FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY area DESC, rid) = 1",
    "overlap_multi": f"""WITH {_BOXES}, m AS (SELECT *, max(area) OVER (PARTITION BY id) AS most, row_number() OVER (PARTITION BY id ORDER BY area DESC, rid) AS n FROM p), q AS (SELECT *, area >= 2 AND area / 16 >= 0.05 AND area >= 0.5 * most AS good FROM m)
      SELECT id, rid, round(area, 6) AS area FROM q QUALIFY good OR (NOT bool_or(good) OVER (PARTITION BY id) AND n = 1)""",
    "iou_match": f"""WITH {_BOXES}, i AS (SELECT *, area / (16 + 36 - area) AS iou FROM p), n AS (SELECT *, coalesce(lead(iou) OVER w, 0) AS second, row_number() OVER w AS n FROM i WINDOW w AS (PARTITION BY id ORDER BY iou DESC, rid))
      SELECT id, rid, round(iou, 6) AS iou FROM n WHERE n = 1 AND iou >= 0.2 AND iou - second >= 0.05""",
    "box_adjacency": f"""WITH {_BOXES}, a AS (SELECT x.id AS src, y.id AS dst, least(x.west, y.west) + 4 - greatest(x.west, y.west) AS w, least(x.south, y.south) + 4 - greatest(x.south, y.south) AS h FROM g x, g y WHERE x.id <> y.id)
      SELECT src, dst, round(CASE WHEN w = 0 THEN h ELSE w END, 6) AS shared FROM a WHERE (w = 0 AND h > 0) OR (h = 0 AND w > 0)""",
    "point_in_polygon": f"""WITH {SQL_POINTS}, {_BOXES.strip()}, q AS (SELECT c_custkey, lat + 0.001::DOUBLE AS y, lon + 0.001::DOUBLE AS x FROM c)
      SELECT c_custkey, min(rid) AS rid FROM q JOIN r ON x > west AND x < west + 6 AND y > south AND y < south + 6 AND NOT (x > west + 2 AND x < west + 3 AND y > south + 2 AND y < south + 3) GROUP BY 1""",
    "distance_components": f"""WITH RECURSIVE {SQL_POINTS}, e AS (SELECT a.c_custkey AS x, b.c_custkey AS y FROM c a JOIN c b ON a.c_custkey <> b.c_custkey AND abs(a.lat - b.lat) < 3 WHERE {_KM} <= 250),
      t(id, reach) AS (SELECT c_custkey, c_custkey FROM customer UNION SELECT t.id, e.y FROM t JOIN e ON e.x = t.reach) SELECT id, min(reach) AS component FROM t GROUP BY 1""",
    "frontier": f"""WITH RECURSIVE {SQL_POINTS}, e AS (SELECT a.c_custkey AS x, b.c_custkey AS y FROM c a JOIN c b ON a.c_custkey <> b.c_custkey AND abs(a.lat - b.lat) < 3 WHERE {_KM} <= 300),
      t(id, round) AS (SELECT c_custkey, 0::BIGINT FROM customer WHERE c_custkey % 100 = 0 UNION SELECT e.y, t.round + 1 FROM t JOIN e ON e.x = t.id WHERE t.round < 40) SELECT id, min(round) AS round FROM t GROUP BY 1""",
}
