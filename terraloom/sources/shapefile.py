"""Shapefiles: geometry and attributes read from any store that Spark reads, a file pair per task.

The format is public and fixed: ``.shp`` has records of a big-endian header and a little-endian shape, ``.dbf`` rows of
fixed-width fields.  A file is read whole, as the format has no splits; bounds prune records before their points are read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, record long, shape_type int, rings array<array<struct<x: double, y: double>>>, attributes map<string,string>"
Bounds = tuple[float, float, float, float]


def shapes(data: bytes, bounds: Bounds | None = None) -> Iterator[tuple[int, int, list]]:
    """Number, type and parts of each record; points are one part of one point. Records outside the bounds are skipped."""
    at = 100
    while at + 8 <= len(data):
        number, words = struct.unpack_from(">ii", data, at)
        at += 8
        (kind,) = struct.unpack_from("<i", data, at)
        if kind in (1, 11, 21):
            x, y = struct.unpack_from("<2d", data, at + 4)
            if bounds is None or bounds[0] <= x <= bounds[2] and bounds[1] <= y <= bounds[3]:
                yield number, 1, [[(x, y)]]
        elif kind in (3, 5, 13, 15, 23, 25):
            west, south, east, north = struct.unpack_from("<4d", data, at + 4)
            if bounds is None or west <= bounds[2] and east >= bounds[0] and south <= bounds[3] and north >= bounds[1]:
                n_parts, n_points = struct.unpack_from("<2i", data, at + 36)
                parts = np.frombuffer(data, "<i4", n_parts, at + 44)
                points = np.frombuffer(data, "<f8", n_points * 2, at + 44 + 4 * n_parts).reshape(-1, 2)
                yield number, kind % 10, [[tuple(p) for p in part.tolist()] for part in np.split(points, parts[1:])]
        elif kind != 0:
            raise ValueError(f"record {number}: shapes of type {kind} are not read")
        at += words * 2


def attributes(data: bytes, encoding: str) -> list[dict[str, str | None]]:
    """Rows of a dBase table, as stripped strings; blanks are null."""
    rows, head, width = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode("ascii"), data[at + 16]))
        at += 32
    out = []
    for k in range(rows):
        place, row = head + k * width + 1, {}
        for name, size in fields:
            row[name] = data[place : place + size].decode(encoding, "replace").strip(" \0") or None
            place += size
        out.append(row)
    return out


def shapefile(spark: SparkSession, path: str, bounds: Bounds | None = None, encoding: str = "utf-8") -> DataFrame:
    """Records of the shapefiles in a folder (SCHEMA); with ``bounds`` (west, south, east, north) only those that meet them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{shp,dbf}").load(path).select("path", "content")
    stem, kind = F.regexp_replace("path", r"\.[^.]*$", ""), F.regexp_extract("path", r"\.([^.]*)$", 1)
    named = files.select(stem.alias("path"), kind.alias("kind"), "content")
    pairs = named.where("kind = 'shp'").select("path", F.col("content").alias("shp")).join(named.where("kind = 'dbf'").select("path", F.col("content").alias("dbf")), "path", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))), pa.map_(pa.string(), pa.string())]
        names = ["path", "record", "shape_type", "rings", "attributes"]
        for batch in batches:
            for name, shp, dbf in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                told = attributes(dbf, encoding) if dbf is not None else []
                rows = []
                for number, kind, parts in shapes(shp, bounds):
                    said = list(told[number - 1].items()) if number <= len(told) else []
                    rows.append((name, number, kind, [[{"x": x, "y": y} for x, y in p] for p in parts], said))
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return pairs.mapInArrow(run, SCHEMA)
