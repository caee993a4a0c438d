"""Spherical and planar geometry as Column expressions; all of it stays in generated code.

Angles are degrees, distances kilometres.  A ring is an array of structs (x, y) whose last point may repeat the first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Radius for matching and all pipelines, and radius for scoring.
EARTH_KM, SCORE_EARTH_KM = 6371.0088, 6371.0
#: Fixed values of the guess score.
FREE_KM, SCORE_POWER = 5.0, 0.65


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM) -> Column:
    """Great-circle distance."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return F.lit(2.0 * radius) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def unit_vector(lat: Column, lon: Column) -> list[Column]:
    """Point on the unit sphere; straight distances there rank as great-circle ones and need no care at poles or the date line."""
    la, lo = F.radians(lat), F.radians(lon)
    return [F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la)]


def guess_score(km: Column, max_error_km: Column) -> Column:
    """1 within the free radius, 0 from the greatest error on, between them (1 - x) ** 0.65; the tests hold in this order."""
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (km - FREE_KM) / (max_error_km - FREE_KM)))
    return (
        F.when(max_error_km <= 0, F.when(km == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
        .when(km <= FREE_KM, F.lit(1.0))
        .when(max_error_km <= FREE_KM, F.lit(0.0))
        .otherwise(F.pow(F.lit(1.0) - x, F.lit(SCORE_POWER)))
    )


def cell(value: Column, size: float) -> Column:
    """Number of the grid cell that holds a coordinate."""
    return F.floor(value / F.lit(float(size))).cast("int")


def normalise_longitude(lon: Column) -> Column:
    """Into [-180, 180)."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def unwrap(longitudes: Column) -> Column:
    """Each longitude moved by whole turns to lie within half a turn of the one before."""
    step = F.aggregate(
        longitudes,
        F.array().cast("array<double>"),
        lambda acc, lon: F.concat(acc, F.array(F.when(F.size(acc) == 0, lon).otherwise(F.element_at(acc, -1) + F.pmod(lon - F.element_at(acc, -1) + 180.0, F.lit(360.0)) - 180.0))),
    )
    return step


def mercator_x(lon: Column) -> Column:
    """Fraction of the world's width."""
    return (lon + 180.0) / 360.0


def mercator_y(lat: Column) -> Column:
    """Fraction of the world's height from the north, with latitude clamped to the square map's limits."""
    limit = 85.051128779806604
    la = F.radians(F.greatest(F.lit(-limit), F.least(F.lit(limit), lat)))
    return (1.0 - F.log(F.tan(la) + 1.0 / F.cos(la)) / F.lit(3.141592653589793)) / 2.0


def mercator_latitude(y: Column) -> Column:
    return F.degrees(F.atan(F.sinh(F.lit(3.141592653589793) * (1.0 - 2.0 * y))))


def tile(lat: Column, lon: Column, zoom: int) -> list[Column]:
    """Column and row of the map tile at a zoom."""
    n = 1 << zoom
    clamp = lambda c: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(c * n).cast("int")))
    return [clamp(mercator_x(lon)), clamp(mercator_y(lat))]


def fit_zoom(west: Column, south: Column, east: Column, north: Column, width: int = 1200, height: int = 800, share: float = 0.75, low: float = 1.0, high: float = 11.0, tile_size: int = 512) -> Column:
    """Zoom at which bounds fill the given share of a viewport."""
    across = F.greatest(mercator_x(east) - mercator_x(west), F.lit(1e-9))
    down = F.greatest(mercator_y(south) - mercator_y(north), F.lit(1e-9))
    zoom = F.least(F.log2(F.lit(width * share / tile_size) / across), F.log2(F.lit(height * share / tile_size) / down))
    return F.greatest(F.lit(low), F.least(F.lit(high), zoom))


def equidistant_xy(lat: Column, lon: Column, lat0: Column, lon0: Column) -> list[Column]:
    """Azimuthal equidistant projection around a centre, in kilometres (sphere)."""
    la, la0, dlon = F.radians(lat), F.radians(lat0), F.radians(lon - lon0)
    cos_c = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin(la0) * F.sin(la) + F.cos(la0) * F.cos(la) * F.cos(dlon)))
    c = F.acos(cos_c)
    k = F.when(F.abs(c) < 1e-12, F.lit(1.0)).otherwise(c / F.sin(c)) * EARTH_KM
    return [k * F.cos(la) * F.sin(dlon), k * (F.cos(la0) * F.sin(la) - F.sin(la0) * F.cos(la) * F.cos(dlon))]


def equal_area_xy(lat: Column, lon: Column) -> list[Column]:
    """Cylindrical equal-area projection, in kilometres (sphere)."""
    return [F.radians(lon) * EARTH_KM, F.sin(F.radians(lat)) * EARTH_KM]


def _edges(ring: Column) -> Column:
    """Pairs of neighbouring points, closed."""
    follow = F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, 1, 1))
    return F.zip_with(ring, follow, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def ring_area(ring: Column) -> Column:
    """Absolute area of a ring in its own units (shoelace)."""
    twice = F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])
    return F.abs(twice) / 2.0


def ring_area_km2(ring: Column) -> Column:
    """Area of a small lon/lat ring: shoelace, with longitudes shrunk by the cosine of the mean latitude."""
    mean = F.aggregate(ring, F.lit(0.0), lambda s, p: s + p["y"]) / F.greatest(F.size(ring), F.lit(1))
    degree = EARTH_KM * 3.141592653589793 / 180.0
    return ring_area(ring) * degree * degree * F.cos(F.radians(mean))


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd test by ray casting with strict comparisons; what lies on the boundary is undefined."""

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        straddles = (a["y"] > y) != (b["y"] > y)
        return straddles & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.when(straddles, b["y"] - a["y"]).otherwise(F.lit(1.0)) + a["x"])

    return F.pmod(F.aggregate(_edges(ring), F.lit(0), lambda n, e: n + crosses(e).cast("int")), F.lit(2)) == 1


def point_in_polygon(x: Column, y: Column, rings: Column) -> Column:
    """In the first ring and in none of the others (holes)."""
    holes = F.slice(rings, F.lit(2), F.size(rings))
    return point_in_ring(x, y, rings[0]) & ~F.exists(holes, lambda h: point_in_ring(x, y, h))


def box_ring(west: Column, south: Column, east: Column, north: Column) -> Column:
    p = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    return F.array(p(west, south), p(east, south), p(east, north), p(west, north))


def box_overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Area shared by two boxes (west, south, east, north)."""
    w = F.least(a["east"], b["east"]) - F.greatest(a["west"], b["west"])
    h = F.least(a["north"], b["north"]) - F.greatest(a["south"], b["south"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def ring_bounds(ring: Column) -> dict[str, Column]:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return {"west": F.array_min(xs), "south": F.array_min(ys), "east": F.array_max(xs), "north": F.array_max(ys)}


def pixel_to_lonlat(px: Column, py: Column, affine: tuple[float, float, float, float, float, float]) -> list[Column]:
    """(lon, lat) = (a px + b py + c, d px + e py + f)."""
    a, b, c, d, e, f = affine
    return [a * px + b * py + c, d * px + e * py + f]


def lonlat_to_pixel(lon: Column, lat: Column, affine: tuple[float, float, float, float, float, float]) -> list[Column]:
    """Inverse of :func:`pixel_to_lonlat`."""
    a, b, c, d, e, f = affine
    det = a * e - b * d
    if not det:
        raise ValueError("the affine transform has no inverse")
    return [(e * (lon - c) - b * (lat - f)) / det, (a * (lat - f) - d * (lon - c)) / det]


def rgb_distance(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    return F.sqrt(sum(((p - q) * (p - q) for p, q in zip(a[1:], b[1:], strict=True)), (a[0] - b[0]) * (a[0] - b[0])).cast("double"))


def snap(value: Column, step: float) -> Column:
    """To the nearest multiple of a step."""
    return F.round(value / F.lit(float(step))) * F.lit(float(step))
