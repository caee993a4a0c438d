"""OpenStreetMap extracts (``.osm.pbf``) as a data source that Spark reads by blocks.

The format is public and fixed: a file is a row of blobs, each with a header that tells its size.  Planning reads these headers only and deals
blobs to tasks by bytes; a task reads, unpacks and decodes its own range, so a file of any size has as many tasks as it has splits, and a
lost task repeats its range alone.  Numbers are variable-length and delta-coded; they are decoded in numpy by block.

Paths are of any file system that pyarrow opens by URI, or local paths that every executor reaches.  A comparison of ``kind`` with a constant is taken down to
the reader (where ``spark.sql.python.filterPushdown.enabled`` is set), and columns of other kinds are not decoded then.

Defined cases: bounds apply to nodes: a file whose header box lies outside gives no nodes, and of a block only nodes inside have their tags decoded; ways and
relations have no place and stay.  An extract without blocks gives no rows; a blob cut short, an unknown compression or a required feature
that is not read is an error.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, IsNotNull

from .shapefile import Bounds

SCHEMA = "kind string, id long, lat double, lon double, tags map<string,string>, refs array<long>, members array<struct<kind: string, ref: long, role: string>>"
KINDS = ("node", "way", "relation")
#: Features that a reader must know; history is read as it stands.
KNOWN = {"OsmSchema-V0.6", "DenseNodes", "HistoricalInformation"}
_MEMBER = pa.struct([("kind", pa.string()), ("ref", pa.int64()), ("role", pa.string())])
_ARROW = pa.schema([("kind", pa.string()), ("id", pa.int64()), ("lat", pa.float64()), ("lon", pa.float64()), ("tags", pa.map_(pa.string(), pa.string())), ("refs", pa.list_(pa.int64())), ("members", pa.list_(_MEMBER))])


def _varint(data: memoryview, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value, at
        shift += 7


def _fields(data: memoryview) -> Iterator[tuple[int, int | memoryview]]:
    """Number and value of each field of a message; bytes are not copied."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            if at + size > len(data):
                raise ValueError("a field is cut short")
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"fields of wire type {kind} are not read")
        yield key >> 3, value


def unpack(data: bytes | memoryview) -> np.ndarray:
    """Packed variable-length numbers as unsigned 64-bit integers."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    last = np.flatnonzero(raw < 0x80)
    first = np.concatenate(([0], last[:-1] + 1))
    place = np.arange(last[-1] + 1) - np.repeat(first, last - first + 1)
    return np.bitwise_or.reduceat((raw[: last[-1] + 1] & 0x7F).astype(np.uint64) << (7 * place).astype(np.uint64), first)


def signed(values: np.ndarray) -> np.ndarray:
    """Zigzag-coded numbers with their sign."""
    return (values >> np.uint64(1)).astype(np.int64) ^ -(values & np.uint64(1)).astype(np.int64)


def _sint(value: int) -> int:
    return (value >> 1) ^ -(value & 1)


def _payload(blob: memoryview) -> memoryview:
    for number, value in _fields(blob):
        if number == 1:
            return value
        if number == 3:
            return memoryview(zlib.decompress(value))
        if number == 7:
            import zstandard

            return memoryview(zstandard.ZstdDecompressor().decompressobj().decompress(value))
        if number in (4, 5, 6):
            raise ValueError(f"blobs of compression {number} are not read")
    raise ValueError("a blob holds no data")


def _opened(path: str):
    """The file system of a path and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    from pyarrow import fs

    system, inner = _opened(path)
    if system.get_file_info(inner).type == fs.FileType.Directory:
        prefix = path[: len(path) - len(inner.rstrip("/"))] if path.rstrip("/").endswith(inner.rstrip("/")) else ""
        return sorted(prefix + f.path for f in system.get_file_info(fs.FileSelector(inner)) if f.path.endswith(".pbf"))
    return [path]


def _blobs(path: str) -> Iterator[tuple[str, int, int]]:
    """Type, offset and size of each blob; only the headers are read."""
    system, inner = _opened(path)
    with system.open_input_file(inner) as f:
        at, end = 0, f.size()
        while at < end:
            size = int.from_bytes(f.read_at(4, at), "big")
            head = dict(_fields(memoryview(f.read_at(size, at + 4))))
            start = at + 4 + size
            if start + head[3] > end:
                raise ValueError(f"{path}: the blob at {at} is cut short")
            yield bytes(head[1]).decode(), start, head[3]
            at = start + head[3]


def _header(data: memoryview) -> tuple[Bounds | None, set[str]]:
    box, needs = None, set()
    for number, value in _fields(data):
        if number == 1:
            b = {n: _sint(v) * 1e-9 for n, v in _fields(value)}
            box = (b.get(1, -180.0), b.get(4, -90.0), b.get(2, 180.0), b.get(3, 90.0))
        elif number == 4:
            needs.add(bytes(value).decode())
    return box, needs


class _Block:
    """One primitive block: strings, scale and groups."""

    def __init__(self, data: memoryview) -> None:
        self.strings: list[str] = []
        self.groups: list[memoryview] = []
        scale = {17: 100, 19: 0, 20: 0}
        for number, value in _fields(data):
            if number == 1:
                self.strings = [bytes(v).decode("utf-8", "replace") for n, v in _fields(value) if n == 1]
            elif number == 2:
                self.groups.append(value)
            elif number in scale:
                scale[number] = value if value < 1 << 63 else value - (1 << 64)
        self.step, self.lat0, self.lon0 = scale[17], scale[19], scale[20]

    def place(self, v: np.ndarray, origin: int) -> np.ndarray:
        return (v * self.step + origin) * 1e-9

    def tags(self, f: dict) -> list[tuple[str, str]]:
        keys, values = (unpack(f.get(n, b"")).astype(np.int64) for n in (2, 3))
        return list({self.strings[k]: self.strings[v] for k, v in zip(keys, values, strict=True)}.items())


def _inside(lat: np.ndarray, lon: np.ndarray, bounds: Bounds | None) -> np.ndarray:
    if bounds is None:
        return np.ones(len(lat), bool)
    return (lon >= bounds[0]) & (lat >= bounds[1]) & (lon <= bounds[2]) & (lat <= bounds[3])


def _dense(block: _Block, data: memoryview, bounds: Bounds | None, tagged: bool) -> list[tuple]:
    f = dict(_fields(data))
    ids, lats, lons = (np.cumsum(signed(unpack(f.get(n, b"")))) for n in (1, 8, 9))
    lat, lon = block.place(lats, block.lat0), block.place(lons, block.lon0)
    keep = _inside(lat, lon, bounds)
    pairs = unpack(f.get(10, b"")).astype(np.int64)
    if not len(pairs):
        ends = starts = np.zeros(len(ids), np.int64)
    else:  # key, value, ..., 0 for each node; a value is never 0, but a delimiter is found by parity from the last one
        ends = np.flatnonzero(pairs == 0)
        if len(ends) != len(ids):
            raise ValueError("dense tags do not match their nodes")
        starts = np.concatenate(([0], ends[:-1] + 1))
    if tagged:
        keep &= ends > starts
    out = []
    for k in np.flatnonzero(keep):
        own = pairs[starts[k] : ends[k]]
        out.append(("node", int(ids[k]), float(lat[k]), float(lon[k]), list({block.strings[a]: block.strings[b] for a, b in zip(own[::2], own[1::2], strict=True)}.items()), None, None))
    return out


def _element(block: _Block, kind: str, data: memoryview, bounds: Bounds | None) -> tuple | None:
    f = dict(_fields(data))
    if kind == "node":
        lat, lon = block.place(np.array([_sint(f[8])]), block.lat0), block.place(np.array([_sint(f[9])]), block.lon0)
        return (kind, _sint(f[1]), float(lat[0]), float(lon[0]), block.tags(f), None, None) if _inside(lat, lon, bounds)[0] else None
    if kind == "way":
        return kind, f[1], None, None, block.tags(f), np.cumsum(signed(unpack(f.get(8, b"")))).tolist(), None
    roles, refs, kinds = unpack(f.get(8, b"")), np.cumsum(signed(unpack(f.get(9, b"")))), unpack(f.get(10, b""))
    return kind, f[1], None, None, block.tags(f), None, [{"kind": KINDS[t], "ref": int(r), "role": block.strings[s]} for t, r, s in zip(kinds.tolist(), refs, roles.tolist(), strict=True)]


def elements(data: memoryview, kinds: Iterable[str] = KINDS, bounds: Bounds | None = None, tagged: bool = False) -> list[tuple]:
    """The rows of an unpacked primitive block."""
    block, out = _Block(data), []
    for group in block.groups:
        for number, value in _fields(group):
            if number == 2 and "node" in kinds:
                out += _dense(block, value, bounds, tagged)
            elif number in (1, 3, 4) and (kind := KINDS[max(number - 2, 0)]) in kinds:
                row = _element(block, kind, value, bounds)
                if row and (row[4] or not tagged):
                    out.append(row)
    return out


@dataclass
class _Range(InputPartition):
    path: str
    blobs: tuple[tuple[int, int], ...]
    nodes: bool


class PbfReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.split = options["path"], int(options.get("splitbytes", 32 << 20))
        self.kinds = tuple(k for k in options.get("kinds", ",".join(KINDS)).split(",") if k)
        self.bounds = tuple(float(v) for v in options["bounds"].split(",")) if options.get("bounds") else None
        self.tagged = options.get("tagged", "false").lower() == "true"

    def partitions(self) -> list[_Range]:
        out = []
        for path in _files(self.path):
            ranges, size, nodes = [], 0, True
            for kind, at, length in _blobs(path):
                if kind == "OSMHeader":
                    box, needs = _header(_payload(self._read(path, at, length)))
                    if needs - KNOWN:
                        raise ValueError(f"{path} needs {sorted(needs - KNOWN)}")
                    if box and self.bounds:
                        nodes = box[0] <= self.bounds[2] and box[2] >= self.bounds[0] and box[1] <= self.bounds[3] and box[3] >= self.bounds[1]
                elif kind == "OSMData":
                    if not ranges or size + length > self.split:
                        ranges.append([])
                        size = 0
                    ranges[-1].append((at, length))
                    size += length
            if nodes or set(self.kinds) - {"node"}:
                out += [_Range(path, tuple(r), nodes) for r in ranges]
        return out or [_Range("", (), False)]

    @staticmethod
    def _read(path: str, at: int, length: int) -> memoryview:
        system, inner = _opened(path)
        with system.open_input_file(inner) as f:
            return memoryview(f.read_at(length, at))

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        kinds = self.kinds if partition.nodes else [k for k in self.kinds if k != "node"]
        if not partition.blobs or not kinds:
            return
        system, inner = _opened(partition.path)
        with system.open_input_file(inner) as f:
            for at, length in partition.blobs:
                rows = elements(_payload(memoryview(f.read_at(length, at))), kinds, self.bounds, self.tagged)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class PushingReader(PbfReader):
    """Takes comparisons of ``kind`` down; Spark accepts such a reader only where its setting allows filters to be pushed."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("kind",):
                self.kinds = tuple(k for k in self.kinds if k == f.value)
            elif not (isinstance(f, IsNotNull) and f.attribute == ("kind",)):
                yield f


class PbfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "osm_pbf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PbfReader:  # noqa: ARG002
        options = dict(self.options)
        return (PushingReader if options.get("push") == "true" else PbfReader)(options)


def osm(spark: SparkSession, path: str, kinds: Iterable[str] = KINDS, bounds: Bounds | None = None, tagged: bool = False, split_bytes: int = 32 << 20) -> DataFrame:
    """Elements of an extract, or of all extracts of a folder; ``tagged`` leaves out what has no tags."""
    spark.dataSource.register(PbfSource)
    reader = spark.read.format("osm_pbf").option("kinds", ",".join(kinds)).option("tagged", str(tagged)).option("splitbytes", str(split_bytes))
    reader = reader.option("push", str(spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")).lower())
    return (reader.option("bounds", ",".join(map(str, bounds))) if bounds else reader).load(path)


def way_points(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, lat, lon, tags) of ways at the inner vertex nearest to the middle of their line; ways with a node missing, or fewer than two, are left out.

    A way has 2,000 nodes at most by the format, so its line stands in one row.
    """
    each = ways.select("id", F.size("refs").alias("n"), F.posexplode("refs").alias("k", "ref"))
    placed = each.join(nodes.select(F.col("id").alias("ref"), "lat", "lon"), "ref")
    lines = placed.groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("k", "lat", "lon"))).alias("p")).where("size(p) = n AND n > 1")
    length = lambda a, b: F.sqrt(F.pow(a["lat"] - b["lat"], 2) + F.pow(a["lon"] - b["lon"], 2))
    steps = F.transform(F.sequence(F.lit(1), F.col("n") - 1), lambda i: F.struct(F.element_at("p", i).alias("a"), F.element_at("p", i + 1).alias("b")))
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("w", "lat", "lon")])
    add = lambda s, t: F.struct((s["w"] + length(t["a"], t["b"])).alias("w"), *[(s[c] + length(t["a"], t["b"]) * (t["a"][c] + t["b"][c]) / 2).alias(c) for c in ("lat", "lon")])
    middle = F.aggregate(steps, zero, add, lambda s: F.struct(*[F.when(s["w"] > 0, s[c] / s["w"]).otherwise(F.element_at("p", 1)[c]).alias(c) for c in ("lat", "lon")]))
    inner = F.when(F.col("n") > 2, F.slice("p", F.lit(2), F.col("n") - 2)).otherwise(F.col("p"))
    near: Column = F.array_min(F.transform(inner, lambda v: F.struct(length(v, F.col("m")).alias("d"), v["k"].alias("k"), v.alias("v"))))
    points = lines.withColumn("m", middle).withColumn("v", near["v"])
    return ways.select("id", "tags").join(points.select("id", "v.lat", "v.lon"), "id").select("id", "lat", "lon", "tags")
