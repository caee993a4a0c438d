import struct

from terraloom.sources.shapefile import shapefile


def record(number, body):
    return struct.pack(">ii", number, len(body) // 2) + body


def polygon(points):
    xs, ys = zip(*points, strict=True)
    return struct.pack("<i4d2i1i", 5, min(xs), min(ys), max(xs), max(ys), 1, len(points), 0) + b"".join(struct.pack("<2d", *p) for p in points)


def test_reads_shapes_and_attributes(spark, tmp_path):
    square = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.0, 0.0)]
    far = [(x + 50, y) for x, y in square]
    (tmp_path / "a.shp").write_bytes(bytes(100) + record(1, polygon(square)) + record(2, polygon(far)) + record(3, struct.pack("<i", 0)) + record(4, struct.pack("<i2d", 1, 7.0, 8.0)))
    fields = b"".join(n.ljust(11, b"\0") + b"C" + bytes(4) + bytes([w, 0]) + bytes(14) for n, w in ((b"NAME", 6), (b"CODE", 3)))
    rows = "".join(" " + n.ljust(6) + c.ljust(3) for n, c in (("one", "007"), ("two", ""), ("none", "1"), ("é", "2"))).encode("latin-1")
    (tmp_path / "a.dbf").write_bytes(struct.pack("<BBBBIHH", 3, 0, 0, 0, 4, 32 + 64 + 1, 10) + bytes(20) + fields + b"\r" + rows)
    got = {r.record: r for r in shapefile(spark, str(tmp_path), encoding="latin-1").collect()}
    assert set(got) == {1, 2, 4} and [(p.x, p.y) for p in got[1].rings[0]] == square
    assert got[1].attributes == {"NAME": "one", "CODE": "007"} and got[2].attributes["CODE"] is None and got[4].attributes["NAME"] == "é"
    assert [r.record for r in shapefile(spark, str(tmp_path), (40.0, -1.0, 60.0, 2.0)).collect()] == [2]
