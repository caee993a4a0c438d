"""Extracts written here by the public format, read by the data source."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.sources import pbf


def varint(v):
    v &= (1 << 64) - 1
    out = bytearray()
    while v > 0x7F:
        out.append(v & 0x7F | 0x80)
        v >>= 7
    return bytes(out) + bytes([v])


def zig(v):
    return varint((v << 1) ^ (v >> 63))


def field(n, data):
    return varint(n << 3 | 2) + varint(len(data)) + data


def number(n, v):
    return varint(n << 3) + varint(v)


def deltas(values):
    return b"".join(zig(b - a) for a, b in zip([0, *values], values))


def blob(kind, payload, packed=True):
    body = field(3, zlib.compress(payload)) + number(2, len(payload)) if packed else field(1, payload)
    head = field(1, kind.encode()) + number(3, len(body))
    return len(head).to_bytes(4, "big") + head + body


def block(nodes, ways=(), relations=(), plain=()):
    strings = [""]

    def at(s):
        if s not in strings:
            strings.append(s)
        return strings.index(s)

    unit = lambda d: round(d * 1e7)
    tags = lambda t: field(2, b"".join(varint(at(k)) for k in t)) + field(3, b"".join(varint(at(v)) for v in t.values()))
    out = b""
    if nodes:
        kv = b"".join(b"".join(varint(at(k)) + varint(at(v)) for k, v in t.items()) + b"\0" for *_, t in nodes) if any(n[3] for n in nodes) else b""
        out += field(2, field(2, field(1, deltas([n[0] for n in nodes])) + field(8, deltas([unit(n[1]) for n in nodes])) + field(9, deltas([unit(n[2]) for n in nodes])) + field(10, kv)))
    if plain:
        out += field(2, b"".join(field(1, varint(8) + zig(i) + tags(t) + varint(8 << 3) + zig(unit(lat)) + varint(9 << 3) + zig(unit(lon))) for i, lat, lon, t in plain))
    if ways:
        out += field(2, b"".join(field(3, number(1, i) + tags(t) + field(8, deltas(refs))) for i, refs, t in ways))
    if relations:
        out += field(2, b"".join(field(4, number(1, i) + tags(t) + field(8, b"".join(varint(at(r)) for *_, r in m)) + field(9, deltas([x for _, x, _ in m])) + field(10, b"".join(varint(pbf.KINDS.index(k)) for k, *_ in m))) for i, m, t in relations))
    return field(1, b"".join(field(1, s.encode()) for s in strings)) + out


def header(box=None, needs=("OsmSchema-V0.6", "DenseNodes")):
    edges = b"".join(varint(n << 3) + zig(round(v * 1e9)) for n, v in zip((1, 2, 3, 4), box, strict=True)) if box else b""
    return blob("OSMHeader", (field(1, edges) if box else b"") + b"".join(field(4, n.encode()) for n in needs))


@pytest.fixture
def extract(tmp_path):
    r = random.Random(4)
    nodes = [(10 + k * 3, round(r.uniform(-80, 80), 7), round(r.uniform(-179, 179), 7), {"name": f"n{k} é", "phone": "+27 21"} if k % 5 == 0 else {}) for k in range(400)]
    ways = [(5, [10, 13, 16, 10], {"highway": "x"}), (6, [10, 999999], {}), (7, [19, 16], {"a": "b"})]
    relations = [(8, [("way", 5, "outer"), ("node", 10, ""), ("relation", 3, "sub")], {"type": "multipolygon"})]
    file = tmp_path / "one.osm.pbf"
    file.write_bytes(header((-179, 179, 80, -80)) + b"".join(blob("OSMData", block(nodes[k : k + 50]), k % 100 == 0) for k in range(0, 400, 50)) + blob("OSMData", block([], ways, relations, [(-4, 1.5, 2.5, {"k": "v"})])))
    return str(file), nodes, ways, relations


def test_numbers():
    values = [0, 1, 127, 128, 300, 2**31, 2**63 - 1, 2**64 - 1]
    assert pbf.unpack(b"".join(map(varint, values))).tolist() == values and len(pbf.unpack(b"")) == 0
    back = [0, -1, 1, -64, 64, -(2**62), 2**62]
    assert pbf.signed(pbf.unpack(b"".join(map(zig, back)))).tolist() == back


def test_round_trip_in_several_tasks(spark, extract):
    path, nodes, ways, relations = extract
    df = pbf.osm(spark, path, split_bytes=2000)
    assert df.rdd.getNumPartitions() > 3
    rows = df.collect()
    got = {r.id: (r.lat, r.lon, r.tags) for r in rows if r.kind == "node"}
    want = {i: (lat, lon, t) for i, lat, lon, t in [*nodes, (-4, 1.5, 2.5, {"k": "v"})]}
    assert set(got) == set(want) and all(np.allclose(got[i][:2], want[i][:2], atol=1e-9) and got[i][2] == want[i][2] for i in want)
    assert {r.id: (r.refs, r.tags) for r in rows if r.kind == "way"} == {i: (refs, t) for i, refs, t in ways}
    assert [(r.id, [tuple(m) for m in r.members], r.tags) for r in rows if r.kind == "relation"] == relations
    folder = path.rsplit("/", 1)[0]
    assert pbf.osm(spark, folder).count() == len(rows) and pbf.osm(spark, f"file://{folder}").count() == len(rows)


def test_bounds_kinds_and_tags(spark, extract):
    path, nodes, *_ = extract
    inside = {i for i, lat, lon, _ in nodes if -10 <= lon <= 90 and 0 <= lat <= 40} | {-4}
    assert {r.id for r in pbf.osm(spark, path, ["node"], (-10, 0, 90, 40)).collect()} == inside
    # The box of the file lies outside: nothing is read of nodes, ways stay.
    assert {r.kind for r in pbf.osm(spark, path, bounds=(179.5, 81, 180, 85)).collect()} == {"way", "relation"}
    assert {r.id for r in pbf.osm(spark, path, ["node"], tagged=True).collect()} == {i for i, *_, t in nodes if t} | {-4}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        ways = pbf.osm(spark, path).where(F.col("kind") == "way")
        assert {r.id for r in ways.collect()} == {5, 6, 7}
        assert " Filter " not in ways._jdf.queryExecution().executedPlan().toString().replace("PushedFilters", "")
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_points_of_ways(spark, extract):
    path, nodes, *_ = extract
    df = pbf.osm(spark, path)
    place = {i: (lat, lon) for i, lat, lon, _ in nodes}
    line = [place[k] for k in (10, 13, 16, 10)]
    w = [np.hypot(a[0] - b[0], a[1] - b[1]) for a, b in zip(line, line[1:])]
    middle = [sum(x * (a[c] + b[c]) / 2 for x, a, b in zip(w, line, line[1:])) / sum(w) for c in (0, 1)]
    told = min(line[1:-1], key=lambda p: np.hypot(p[0] - middle[0], p[1] - middle[1]))
    got = {r.id: (r.lat, r.lon) for r in pbf.way_points(df.where("kind = 'way'"), df.where("kind = 'node'")).collect()}
    assert set(got) == {5, 7} and np.allclose(got[5], told, atol=1e-9)


def test_faults(spark, tmp_path):
    def made(name, data):
        (tmp_path / name).write_bytes(data)
        return pbf.osm(spark, str(tmp_path / name))

    assert made("none.pbf", header()).count() == 0 and made("empty.pbf", b"").count() == 0
    for name, data in (("cut.pbf", header() + blob("OSMData", block([(1, 1.0, 1.0, {})]))[:-3]), ("needs.pbf", header(needs=("Sort.Other",)))):
        with pytest.raises(Exception, match="cut short|needs"):
            made(name, data).count()
