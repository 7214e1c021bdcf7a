"""Distances, bearings, local projection and grid cells as column maths."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the study area.
EARTH_M = 6371008.8
ANCHOR_LAT, ANCHOR_LON = -23.5505, -46.6333
CELL_EDGE_M = {7: 1220.0, 8: 461.0, 9: 174.0, 10: 66.0}

M_PER_LAT = math.radians(1.0) * EARTH_M
M_PER_LON = M_PER_LAT * math.cos(math.radians(ANCHOR_LAT))


def _c(x) -> Column:
    if isinstance(x, str):
        return F.col(x)
    return x if isinstance(x, Column) else F.lit(float(x))


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    a1, o1, a2, o2 = (F.radians(_c(v)) for v in (lat1, lon1, lat2, lon2))
    sa, so = F.sin((a2 - a1) / 2), F.sin((o2 - o1) / 2)
    h = sa * sa + F.cos(a1) * F.cos(a2) * so * so
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), h))))


def bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    """0 = north, clockwise."""
    a1, o1, a2, o2 = (F.radians(_c(v)) for v in (lat1, lon1, lat2, lon2))
    east = F.sin(o2 - o1) * F.cos(a2)
    north = F.cos(a1) * F.sin(a2) - F.sin(a1) * F.cos(a2) * F.cos(o2 - o1)
    return F.pmod(F.degrees(F.atan2(east, north)) + 360.0, F.lit(360.0))


def to_x(lon, lon0: float = ANCHOR_LON, k: float = M_PER_LON) -> Column:
    return (_c(lon) - F.lit(lon0)) * F.lit(k)


def to_y(lat, lat0: float = ANCHOR_LAT, k: float = M_PER_LAT) -> Column:
    return (_c(lat) - F.lit(lat0)) * F.lit(k)


def to_lon(x) -> Column:
    return _c(x) / F.lit(M_PER_LON) + F.lit(ANCHOR_LON)


def to_lat(y) -> Column:
    return _c(y) / F.lit(M_PER_LAT) + F.lit(ANCHOR_LAT)


def utm_xy(lat, lon, central: float = -45.0) -> tuple[Column, Column]:
    """Transverse Mercator series for zone 23 south (easting, northing) on the GRS80 ellipsoid."""
    a, f, k0 = 6378137.0, 1 / 298.257222101, 0.9996
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    phi = F.radians(_c(lat))
    d = F.radians(_c(lon) - F.lit(central)) * F.cos(phi)
    n = F.lit(a) / F.sqrt(1 - e2 * F.sin(phi) * F.sin(phi))
    t, c = F.tan(phi) * F.tan(phi), ep2 * F.cos(phi) * F.cos(phi)
    h = f / (2 - f)  # third flattening
    m = a / (1 + h) * (
        (1 + h**2 / 4 + h**4 / 64) * phi
        - (3 * h / 2 - 3 * h**3 / 16) * F.sin(2 * phi)
        + (15 * h**2 / 16 - 15 * h**4 / 64) * F.sin(4 * phi)
        - (35 * h**3 / 48) * F.sin(6 * phi)
        + (315 * h**4 / 512) * F.sin(8 * phi)
    )
    east = k0 * n * (
        d + (1 - t + c) * F.pow(d, F.lit(3)) / 6
        + (5 - 18 * t + t * t + c * (14 - 58 * t) + c * c * (13 - 64 * t) + c * c * c * (4 - 24 * t)) * F.pow(d, F.lit(5)) / 120
        + (61 - 479 * t + 179 * t * t - t * t * t) * F.pow(d, F.lit(7)) / 5040
    ) + 500000.0
    north = k0 * (
        m + n * F.tan(phi) * (
            d * d / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(d, F.lit(4)) / 24
            + (61 - 58 * t + t * t + c * (270 - 330 * t) + c * c * (445 - 680 * t)) * F.pow(d, F.lit(6)) / 720
            + (1385 - 3111 * t + 543 * t * t - t * t * t) * F.pow(d, F.lit(8)) / 40320
        )
    ) + 10000000.0
    return east, north


def cell_id(lat, lon, res: int = 9) -> Column:
    edge = CELL_EDGE_M.get(res, 174.0)
    ix = F.floor(to_x(lon) / edge).cast("string")
    iy = F.floor(to_y(lat) / edge).cast("string")
    return F.concat_ws("_", F.lit(f"g{res}"), ix, iy)


def cell_center(cell) -> tuple[Column, Column]:
    """(lat, lon) of the centre of a cell id, NULL if it is not one."""
    cell = _c(cell)
    ok = cell.rlike(r"^g\d+_-?\d+_-?\d+$")
    parts = F.split(cell, "_")
    edge = F.lit(174.0)
    for res, size in CELL_EDGE_M.items():
        edge = F.when(F.get(parts, F.lit(0)) == f"g{res}", F.lit(size)).otherwise(edge)
    x = (F.get(parts, F.lit(1)).try_cast("int") + 0.5) * edge
    y = (F.get(parts, F.lit(2)).try_cast("int") + 0.5) * edge
    return F.when(ok, to_lat(y)), F.when(ok, to_lon(x))


def snap(x, step: float, low: float | None = None, high: float | None = None) -> Column:
    out = F.round(_c(x) / step) * step
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return out


def geojson_point(lat, lon) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(_c(lon), _c(lat)).alias("coordinates"))


def geojson_line(points) -> Column:
    """From an array of (lat, lon) structs."""
    xy = F.transform(points, lambda p: F.array(p["lon"], p["lat"]))
    return F.struct(F.lit("LineString").alias("type"), xy.alias("coordinates"))


# -- the same formulas as SQL text, for oracles
def num(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


def sql_x(lon: str) -> str:
    return f"(({lon} - {num(ANCHOR_LON)}) * {num(M_PER_LON)})"


def sql_y(lat: str) -> str:
    return f"(({lat} - {num(ANCHOR_LAT)}) * {num(M_PER_LAT)})"


def sql_cell(lat: str, lon: str, res: int = 9) -> str:
    e = num(CELL_EDGE_M[res])
    return (
        f"concat('g{res}_', CAST(floor({sql_x(lon)} / {e}) AS BIGINT), '_', "
        f"CAST(floor({sql_y(lat)} / {e}) AS BIGINT))"
    )


def sql_haversine(a1: str, o1: str, a2: str, o2: str) -> str:
    return (
        f"{num(2 * EARTH_M)} * asin(sqrt(least(1.0, greatest(0.0, "
        f"pow(sin((radians({a2}) - radians({a1})) / 2), 2) + cos(radians({a1})) * cos(radians({a2}))"
        f" * pow(sin((radians({o2}) - radians({o1})) / 2), 2)))))"
    )
