"""Coordinates in column arithmetic: transverse Mercator, datum shift, distances on the sphere and in the plane.

The three local scales of metres for a degree differ on purpose; each has the name of its use.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0
WEB_RADIUS_M = 6378137.0
#: Metres for a degree of longitude at the equator, and of latitude.
DEGREE_LON_M, DEGREE_LAT_M = 111_320.0, 110_540.0

# Ellipsoids (semi-major axis, inverse flattening), belts (ellipsoid, central meridian, false northing) and the
# published shift from the old datum (metres, seconds of arc, parts in a million).
ELLIPSOIDS = {"grs80": (6378137.0, 298.257222101), "bessel": (6377397.155, 299.1528128)}
BELTS = {
    "EPSG:5186": ("grs80", 127.0, 600000.0),
    "EPSG:5187": ("grs80", 129.0, 600000.0),
    "EPSG:5181": ("grs80", 127.0, 500000.0),
    "EPSG:5183": ("grs80", 129.0, 500000.0),
    "EPSG:5174": ("bessel", 127.0028902777778, 500000.0),
    "EPSG:5176": ("bessel", 129.0028902777778, 500000.0),
}
FALSE_EASTING, ORIGIN_LATITUDE = 200000.0, 38.0
SHIFT = (-145.907, 505.034, 685.756, -1.162, 2.347, 1.592, 6.342)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


@dataclass(frozen=True)
class Belt:
    a: float
    e2: float
    lon0: float
    northing: float

    @classmethod
    def of(cls, code: str) -> Belt:
        ellipsoid, lon0, northing = BELTS[code]
        a, inverse = ELLIPSOIDS[ellipsoid]
        return cls(a, (2 - 1 / inverse) / inverse, math.radians(lon0), northing)

    def meridian(self, lat):
        """Length of the meridian from the equator, for a number or a column."""
        e2 = self.e2
        sine = F.sin if isinstance(lat, Column) else math.sin
        terms = (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256, 3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024, 15 * e2**2 / 256 + 45 * e2**3 / 1024, 35 * e2**3 / 3072)
        return (lat * terms[0] - sine(lat * 2) * terms[1] + sine(lat * 4) * terms[2] - sine(lat * 6) * terms[3]) * self.a


def _pack(**parts: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in parts.items()])


def geographic(northing: Column, easting: Column, code: str) -> Column:
    """struct<lat, lon> in degrees on the belt's own datum, by the series to the sixth power."""
    belt = Belt.of(code)
    e2, ep2 = belt.e2, belt.e2 / (1 - belt.e2)
    n = (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    origin = belt.meridian(math.radians(ORIGIN_LATITUDE)) - belt.northing
    series = ((2, 3 * n / 2 - 27 * n**3 / 32), (4, 21 * n**2 / 16 - 55 * n**4 / 32), (6, 151 * n**3 / 96), (8, 1097 * n**4 / 512))

    def foot_point(v: Column) -> Column:
        foot = v["mu"]
        for k, factor in series:
            foot = foot + F.sin(v["mu"] * k) * factor
        return let(_pack(foot=foot, east=v["east"]), powers)

    def powers(v: Column) -> Column:
        flat = F.lit(1.0) - F.pow(F.sin(v["foot"]), 2) * e2
        c, t, normal = F.pow(F.cos(v["foot"]), 2) * ep2, F.pow(F.tan(v["foot"]), 2), F.lit(belt.a) / F.sqrt(flat)
        return let(_pack(foot=v["foot"], c=c, t=t, normal=normal, curve=F.lit(belt.a * (1 - e2)) / F.pow(flat, 1.5), d=v["east"] / normal), place)

    def place(v: Column) -> Column:
        c, t, d, foot = v["c"], v["t"], v["d"], v["foot"]
        second = F.pow(d, 2) / 2
        fourth = F.pow(d, 4) / 24 * (t * 3 + 5 + c * 10 - c * c * 4 - 9 * ep2)
        sixth = F.pow(d, 6) / 720 * (t * 90 + 61 + c * 298 + t * t * 45 - 252 * ep2 - c * c * 3)
        third = F.pow(d, 3) / 6 * (t * 2 + 1 + c)
        fifth = F.pow(d, 5) / 120 * (t * 28 + 5 - c * 2 - c * c * 3 + 8 * ep2 + t * t * 24)
        lat = foot - v["normal"] * F.tan(foot) / v["curve"] * (second - fourth + sixth)
        return _pack(lat=F.degrees(lat), lon=F.degrees((d - third + fifth) / F.cos(foot) + belt.lon0))

    mu = (northing + origin) / (belt.a * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
    return let(_pack(mu=mu, east=easting - FALSE_EASTING), foot_point)


def to_geographic(northing: Column, easting: Column, code: str) -> tuple[Column, Column]:
    """Latitude and longitude in degrees on the belt's own datum."""
    met = geographic(northing, easting, code)
    return met["lat"], met["lon"]


def to_grid(lat: Column, lon: Column, code: str) -> tuple[Column, Column]:
    """Northing and easting of a latitude and longitude in degrees on the belt's own datum."""
    belt = Belt.of(code)
    ep2 = belt.e2 / (1 - belt.e2)

    def powers(v: Column) -> Column:
        phi = v["phi"]
        normal = F.lit(belt.a) / F.sqrt(F.lit(1.0) - F.pow(F.sin(phi), 2) * belt.e2)
        return let(_pack(phi=phi, t=F.pow(F.tan(phi), 2), c=F.pow(F.cos(phi), 2) * ep2, x=(v["lam"] - belt.lon0) * F.cos(phi), normal=normal), place)

    def place(v: Column) -> Column:
        t, c, x = v["t"], v["c"], v["x"]
        rise = F.pow(x, 2) / 2 + F.pow(x, 4) / 24 * (F.lit(5.0) - t + c * 9 + c * c * 4)
        rise = rise + F.pow(x, 6) / 720 * (F.lit(61.0) - t * 58 + t * t + c * 600 - 330 * ep2)
        north = belt.meridian(v["phi"]) - belt.meridian(math.radians(ORIGIN_LATITUDE)) + v["normal"] * F.tan(v["phi"]) * rise + belt.northing
        run = x + F.pow(x, 3) / 6 * (F.lit(1.0) - t + c) + F.pow(x, 5) / 120 * (F.lit(5.0) - t * 18 + t * t + c * 72 - 58 * ep2)
        return _pack(north=north, east=v["normal"] * run + FALSE_EASTING)

    met = let(_pack(phi=F.radians(lat), lam=F.radians(lon)), powers)
    return met["north"], met["east"]


def shifted(place: Column, rounds: int = 8) -> Column:
    """struct<lat, lon> of degrees on the old datum's ellipsoid as degrees on the new one's: a seven-parameter shift at height 0."""
    a, inverse = ELLIPSOIDS["bessel"]
    e2 = (2 - 1 / inverse) / inverse
    a_new, inverse = ELLIPSOIDS["grs80"]
    e2_new = (2 - 1 / inverse) / inverse
    dx, dy, dz, *turns, ppm = SHIFT
    rx, ry, rz = (math.radians(s / 3600) for s in turns)
    scale = 1 + ppm * 1e-6

    def centred(v: Column) -> Column:
        phi, lam = F.radians(v["lat"]), F.radians(v["lon"])
        normal = F.lit(a) / F.sqrt(F.lit(1.0) - F.pow(F.sin(phi), 2) * e2)
        return let(_pack(x=normal * F.cos(phi) * F.cos(lam), y=normal * F.cos(phi) * F.sin(lam), z=normal * F.sin(phi) * (1 - e2)), turned)

    def turned(v: Column) -> Column:
        x, y, z = v["x"], v["y"], v["z"]
        return let(_pack(x=x * scale - y * rz + z * ry + dx, y=x * rz + y * scale - z * rx + dy, z=y * rx - x * ry + z * scale + dz), back)

    def back(v: Column) -> Column:
        across = F.sqrt(v["x"] * v["x"] + v["y"] * v["y"])
        start = _pack(phi=F.atan2(v["z"], across * (1 - e2_new)), z=v["z"], p=across)
        phi = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, again)["phi"]
        return _pack(lat=F.degrees(phi), lon=F.degrees(F.atan2(v["y"], v["x"])))

    def again(s: Column, _: Column) -> Column:
        sine = F.sin(s["phi"])
        return _pack(phi=F.atan2(s["z"] + sine * e2_new * a_new / F.sqrt(F.lit(1.0) - sine * sine * e2_new), s["p"]), z=s["z"], p=s["p"])

    return let(place, centred)


def shift_datum(lat: Column, lon: Column, rounds: int = 8) -> tuple[Column, Column]:
    met = shifted(_pack(lat=lat, lon=lon), rounds)
    return met["lat"], met["lon"]


def wgs84_place(northing: Column, easting: Column, crs: Column) -> Column:
    """struct<lat, lon> of grid coordinates whose system is in a column; EPSG:4326 passes, others give null."""

    def by_system(v: Column) -> Column:
        out = F.when(v["crs"] == "EPSG:4326", _pack(lat=v["n"], lon=v["e"]))
        for code, (ellipsoid, _, _) in BELTS.items():
            own = geographic(v["n"], v["e"], code)
            out = out.when(v["crs"] == code, shifted(own) if ellipsoid == "bessel" else own)
        return out

    return let(_pack(n=northing.cast("double"), e=easting.cast("double"), crs=crs), by_system)


def grid_to_wgs84(northing: Column, easting: Column, crs: Column | str) -> tuple[Column, Column]:
    """Latitude and longitude of grid coordinates, whose system is in a column or, if it is known beforehand, a code."""
    if isinstance(crs, str):
        own = geographic(northing.cast("double"), easting.cast("double"), crs)
        met = shifted(own) if BELTS[crs][0] == "bessel" else own
    else:
        met = wgs84_place(northing, easting, crs)
    return met["lat"], met["lon"]


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.asin(F.sqrt(F.least(h, F.lit(1.0)))) * (2 * EARTH_RADIUS_KM)


def plane_metres(lon: Column, lat: Column, mid_lat: Column) -> tuple[Column, Column]:
    """East and north in metres on the local plane of a mean latitude."""
    return lon * DEGREE_LON_M * F.cos(F.radians(mid_lat)), lat * DEGREE_LAT_M


def sphere_metres(lon: Column, lat: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    return F.radians(lon - lon0) * F.cos(F.radians(lat0)) * WEB_RADIUS_M, F.radians(lat - lat0) * WEB_RADIUS_M


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * WEB_RADIUS_M, F.log(F.tan(F.radians(lat) / 2 + math.pi / 4)) * WEB_RADIUS_M


def tile(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Column and row of the map tile that holds a place."""
    n = 2.0**zoom
    return F.floor((lon + 180) / 360 * n), F.floor((F.lit(1.0) - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2 * n)


def tile_height(r: Column, g: Column, b: Column) -> Column:
    """Metres of a terrain tile's colour."""
    return r * 256.0 + g + b / 256.0 - 32768.0


def section_axis(x0: Column, z0: Column, x1: Column, z1: Column) -> dict[str, Column]:
    """Length, azimuth (clockwise from north, which is -z) and unit normal of a section line."""
    dx, dz = x1 - x0, z1 - z0
    length = F.sqrt(dx * dx + dz * dz)
    return {"length": length, "azimuth": F.pmod(F.degrees(F.atan2(dx, -dz)), F.lit(360.0)), "normal_x": -dz / length, "normal_z": dx / length}
