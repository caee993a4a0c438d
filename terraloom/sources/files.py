"""Scans: every reader takes an explicit schema, so that codes stay strings and a bad file fails at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Headerless gazetteer dump: the columns that are used, by position (a fixed format).
GAZETTEER = {0: "id", 1: "name", 2: "ascii_name", 3: "alternates", 4: "lat", 5: "lon", 6: "feature_class", 7: "feature_code", 8: "country", 14: "population"}


def geojson(spark: SparkSession, path: str, properties: str, id_type: str = "string", srid: int = 4326) -> DataFrame:
    """Features of whole GeoJSON files: (id, properties, geometry: type and coordinates as JSON text, srid). ``properties`` is a DDL string."""
    shape = f"type string, features array<struct<type: string, id: {id_type}, properties: struct<{properties}>, geometry: struct<type: string, coordinates: string>>>"
    raw = spark.read.schema(shape).option("multiLine", True).json(path)
    checked = raw.where(F.when((F.col("type") == "FeatureCollection") & F.col("features").isNotNull(), F.lit(True)).otherwise(F.raise_error(F.lit("not a feature collection")).isNull()))
    return checked.select(F.explode("features").alias("f")).select("f.id", "f.properties.*", F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"), F.lit(srid).alias("srid"))


def geojson_lines(spark: SparkSession, path: str, properties: str, id_type: str = "string") -> DataFrame:
    """One feature a line: splittable, so a large collection is read by many tasks."""
    shape = f"type string, id {id_type}, properties struct<{properties}>, geometry struct<type: string, coordinates: string>"
    return spark.read.schema(shape).option("mode", "FAILFAST").json(path).select("id", "properties.*", F.col("geometry.type").alias("geometry_type"), F.col("geometry.coordinates").alias("coordinates"))


def point_of(coordinates) -> list:
    """(lat, lon) of a point's coordinates."""
    pair = F.from_json(coordinates, "array<double>")
    return [pair[1].alias("lat"), pair[0].alias("lon")]


def rings_of(coordinates):
    """Rings (arrays of x, y) of a polygon's coordinates."""
    return F.transform(F.from_json(coordinates, "array<array<array<double>>>"), lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))


def ndjson(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line; blank lines are skipped and a bad line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """Headerless tab-separated dump; quotes are ordinary characters."""
    kinds = {"lat": "double", "lon": "double", "population": "long"}
    last = max(GAZETTEER)
    schema = ", ".join(f"{GAZETTEER.get(k, f'unused_{k}')} {kinds.get(GAZETTEER.get(k, ''), 'string')}" for k in range(last + 1))
    return spark.read.schema(schema).option("sep", "\t").option("quote", "").option("enforceSchema", True).csv(path).select(*GAZETTEER.values())


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header, also with a byte-order mark; blanks stay blank."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("emptyValue", "").option("encoding", "UTF-8").csv(path)


def sql_dump(spark: SparkSession, path: str, table: str, columns: list[str]) -> DataFrame:
    """Values of the INSERT statements of one table, one row or several to a statement, as strings with doubled quotes undone; NULL is null.

    A statement may stand on several lines and ends with a semicolon at the end of a line. Rows that do not parse as so many plain values are an error.
    """
    value = r"\s*('[^']*+(?:''[^']*+)*+'|[^,()']++)\s*"
    row = r"\(" + ",".join([value] * len(columns)) + r"\)"
    insert = rf"(?is)^(?:\s|--[^\n]*\n|/\*.*?\*/)*insert\s+into\s+[`\"]?{table}[`\"]?\s*(?:\([^)]*\)\s*)?values\s*"
    said = spark.read.option("lineSep", ";\n").text(path).select(F.explode(F.split("value", r";[ \t]*\r\n")).alias("value"))
    rows = said.where(F.col("value").rlike(insert)).select(F.regexp_replace("value", insert, "").alias("rows"))
    rest = F.regexp_replace("rows", row, "")
    checked = F.when(rest.rlike(r"^[\s,;]*$"), F.col("rows")).otherwise(F.raise_error(F.concat(F.lit(f"rows of {table} are not {len(columns)} plain values: "), F.substring(F.trim(rest), 1, 80))).cast("string"))
    each = rows.select(F.explode(F.regexp_extract_all(checked, F.lit(row), 0)).alias("value"))

    def clean(k: int):
        said = F.trim(F.regexp_extract("value", row, k))
        return F.when(F.upper(said) != "NULL", F.replace(F.regexp_replace(said, r"^'|'$", ""), F.lit("''"), F.lit("'")))

    return each.select(*[clean(k + 1).alias(c) for k, c in enumerate(columns)])


def listing(spark: SparkSession, path: str, pattern: str = r"([^/]+?)(?:\.[A-Za-z0-9]+)?$") -> DataFrame:
    """(path, name) of the files of a folder, without reading them; ``name`` is the first group of the pattern."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    return found.select("path", F.regexp_extract("path", pattern, 1).alias("name"))


def object_literals(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """Flat object blocks of a script file, field by field; common character references are undone. One file is one row until it is split."""
    blocks = spark.read.option("wholetext", True).text(path).select(F.explode(F.regexp_extract_all("value", F.lit(r"(\{[^{}]*\})"), 1)).alias("b"))

    def field(name: str):
        said = F.regexp_extract("b", rf"""["']?\b{name}["']?\s*:\s*(?:"([^"]*)"|'([^']*)'|([-0-9.]+))""", 1)
        other = F.regexp_extract("b", rf"""["']?\b{name}["']?\s*:\s*'([^']*)'""", 1)
        number = F.regexp_extract("b", rf"""["']?\b{name}["']?\s*:\s*([-0-9.]+)""", 1)
        text = F.coalesce(*[F.when(c != "", c) for c in (said, other, number)])
        for a, b in (("&amp;", "&"), ("&#39;", "'"), ("&quot;", '"')):
            text = F.replace(text, F.lit(a), F.lit(b))
        return text.alias(name)

    return blocks.select(*[field(f) for f in fields]).where(F.coalesce(*[F.col(f) for f in fields]).isNotNull())


def partition_of(spark: SparkSession, path: str, column: str, value: str, schema: str | None = None) -> DataFrame:
    """One partition of a table that is laid out by ``column``; the value must be three lower-case letters."""
    if not (len(value) == 3 and value.isascii() and value.isalpha() and value.islower()):
        raise ValueError(f"not a code: {value!r}")
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path).where(F.col(column) == value)


def image_pixels(spark: SparkSession, path: str) -> DataFrame:
    """(path, x, y, r, g, b) of binary PPM images (P6, one byte a channel), a row per pixel."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_buffer().to_pybytes()
                head, at = [], 0
                while len(head) < 4:
                    while data[at : at + 1].isspace():
                        at += 1
                    end = at
                    while not data[end : end + 1].isspace():
                        end += 1
                    head.append(data[at:end])
                    at = end
                if head[0] != b"P6" or int(head[3]) > 255:
                    raise ValueError(f"not a P6 image: {name}")
                w, h = int(head[1]), int(head[2])
                pixels = np.frombuffer(data, np.uint8, w * h * 3, at + 1).reshape(-1, 3)
                for lo in range(0, w * h, 1 << 18):
                    part = pixels[lo : lo + (1 << 18)].astype(np.int32)
                    y, x = np.divmod(np.arange(lo, lo + len(part), dtype=np.int32), np.int32(w))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(x), pa.array(y), *(pa.array(part[:, k].copy()) for k in range(3))], ["path", "x", "y", "r", "g", "b"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, x int, y int, r int, g int, b int")
