"""Which reading of two numbers is a place: candidates of belt and order, the best by region or by the project's own place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrakern.functions import geodesy

CODES = ("EPSG:5186", "EPSG:5187", "EPSG:5181", "EPSG:5183", "EPSG:5174", "EPSG:5176")
Box = tuple[float, float, float, float]


def candidates(x: Column, y: Column, codes: Sequence[str] = CODES) -> Column:
    """array<struct<ord, crs, reading, lon, lat>>: x as easting and y as northing, and the other way, in each belt."""
    out = []
    for code in codes:
        for reading, (east, north) in (("xy", (x, y)), ("yx", (y, x))):
            own = geodesy.geographic(north, east, code)
            own = geodesy.shifted(own) if geodesy.BELTS[code][0] == "bessel" else own
            out.append(F.struct(F.lit(len(out)).alias("ord"), F.lit(code).alias("crs"), F.lit(reading).alias("reading"), own.alias("at")))
    flat = lambda c: F.struct(c["ord"].alias("ord"), c["crs"].alias("crs"), c["reading"].alias("reading"), c["at"]["lon"].alias("lon"), c["at"]["lat"].alias("lat"))
    return F.transform(F.array(*out), flat)


def region_score(lon: Column, lat: Column, hard: Box, soft: Box) -> Column:
    """40 in the inner region, 30 in the outer one, 15 elsewhere in the country, below 0 beyond."""
    inside = lambda b: lon.between(b[0], b[2]) & lat.between(b[1], b[3])
    home = inside((124.0, 33.0, 132.0, 39.0))
    return F.when(lon.isNull() | lat.isNull() | F.isnan(lon), -1000).when(~home, -100).when(inside(hard), 40).when(inside(soft), 30).otherwise(15)


def best_by_region(points: DataFrame, x: str, y: str, hard: Box, soft: Box, codes: Sequence[str] = CODES) -> DataFrame:
    """Adds crs, reading, lon and lat of the candidate with the highest score, of equal ones the first; null where none is in
    the country. Both numbers are read as they stand or exchanged."""
    scored = F.transform(candidates(F.col(x), F.col(y), codes), lambda c: F.struct(region_score(c["lon"], c["lat"], hard, soft).alias("score"), (-c["ord"]).alias("first"), c.alias("c")))
    best = points.withColumn("_best", F.array_max(F.filter(scored, lambda s: s["score"] > 0)))
    return best.select(*points.columns, *[F.col(f"_best.c.{n}").alias(n) for n in ("crs", "reading", "lon", "lat")])


# Belts whose numbers are as small as they look, and the number below which others lack a digit.
EAST, SMALL, LARGE = ("EPSG:5187", "EPSG:5183", "EPSG:5176"), 30000, 100000


def as_number(cell: Column) -> Column:
    """The number that a cell's digits, points and minus signs make, whatever else it holds; null where they make none."""
    return F.regexp_replace(cell.cast("string"), r"[^0-9.\-]", "").try_cast("double")


def normalized(points: DataFrame, x: str, y: str, crs: str, hard: Box, soft: Box, order: Column | None = None) -> DataFrame:
    """Adds lon, lat (7 places), tm_x, tm_y (easting and northing on the first belt, 3 places) and system to points with two written numbers and a
    system, one of CODES, WGS84 or null.

    A first number below SMALL lacks a digit unless it is a degree or of an eastern belt. A known belt's numbers are read with the smaller
    as easting and the other way, by `region_score`, the first of equals; with `order` easting_northing as they stand. Without
    a system all belts are tried where a number is LARGE, those on the new datum first, and only places in the country count;
    system is then the belt's with _INFERRED, UNKNOWN without any. Places are null where nothing fits.
    """
    a, b = as_number(F.col(x)), as_number(F.col(y))
    tenfold = F.coalesce(a < SMALL, F.lit(False)) & ~F.coalesce(F.col(crs).isin("WGS84", *EAST), F.lit(False))
    rows = points.withColumns({"_a": F.when(tenfold, a * 10).otherwise(a), "_b": b, "_fixed": F.coalesce((order if order is not None else F.lit("")) == "easting_northing", F.lit(False))})
    ordered = rows.withColumns({"_low": F.least("_a", "_b"), "_high": F.greatest("_a", "_b")})
    east = F.when(F.col("_fixed") & F.col(crs).isNotNull(), F.col("_a")).otherwise(F.col("_low"))
    north = F.when(F.col("_fixed") & F.col(crs).isNotNull(), F.col("_b")).otherwise(F.col("_high"))
    rows = ordered.select(*points.columns, "_a", "_b", "_fixed", F.col(crs).alias("_crs"), east.alias("_east"), north.alias("_north"))
    wanted = lambda c: (F.col("_crs") == c["crs"]) & ~(F.col("_fixed") & (c["reading"] == "yx")) | F.col("_crs").isNull()
    scored = F.transform(
        F.filter(candidates(F.col("_east"), F.col("_north")), wanted), lambda c: F.struct(region_score(c["lon"], c["lat"], hard, soft).alias("score"), (-c["ord"]).alias("first"), c.alias("c"))
    )
    sound = F.filter(scored, lambda s: s["score"] > F.when(F.col("_crs").isNull(), 0).otherwise(-1000))
    given = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    fits = given & F.coalesce(F.col("_crs").isin(*CODES), F.greatest("_a", "_b") > LARGE)
    rows = rows.withColumn("_best", F.when(fits, F.array_max(sound)))
    degrees = given & F.coalesce(F.col("_crs") == "WGS84", F.lit(False))
    rows = rows.withColumns({"lon": F.when(degrees, F.col("_a")).otherwise(F.col("_best.c.lon")), "lat": F.when(degrees, F.col("_b")).otherwise(F.col("_best.c.lat"))})
    tm_y, tm_x = geodesy.to_grid(F.col("lat"), F.col("lon"), CODES[0])
    system = F.coalesce(F.col("_crs"), F.concat(F.col("_best.c.crs"), F.lit("_INFERRED")), F.lit("UNKNOWN"))
    out = rows.withColumns({"tm_x": F.round(tm_x, 3), "tm_y": F.round(tm_y, 3), "system": system})
    return out.select(*points.columns, F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"), "tm_x", "tm_y", "system")


def anchored(points: DataFrame, x: str, y: str, anchor: tuple[float, float], near: float = 0.05, far: float = 0.5) -> DataFrame:
    """Moves a hole (x, y as read, lon, lat, crs) that lies off the project's place to the candidate nearest to it.

    A hole within `near` degrees stays; a candidate beyond `far` isn't taken, nor one that is hardly nearer than where it is.
    """
    lon0, lat0 = anchor
    apart = lambda lon, lat: F.pow(lon - lon0, 2) + F.pow(lat - lat0, 2)
    sound = F.filter(candidates(F.col(x), F.col(y)), lambda c: c["lon"].between(120, 135) & c["lat"].between(30, 40))
    nearest = F.array_min(F.transform(sound, lambda c: F.struct(apart(c["lon"], c["lat"]).alias("d"), c["ord"].alias("ord"), c.alias("c"))))
    now = apart(F.col("lon"), F.col("lat"))
    moved = points.withColumn("_n", nearest).withColumn("_move", (now > near**2) & (F.col("_n.d") <= far**2) & (now > F.col("_n.d") + near**2))
    moved = moved.withColumn("moved", F.coalesce("_move", F.lit(False)))
    return moved.withColumns({c: F.when(F.col("moved"), F.col(f"_n.c.{c}")).otherwise(F.col(c)) for c in ("lon", "lat", "crs")}).drop("_n", "_move")


def box_centre(box: Sequence[float]) -> tuple[float, float]:
    return (box[0] + box[2]) / 2, (box[1] + box[3]) / 2
