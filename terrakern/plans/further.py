"""More queries: text and keys, coordinates, layouts, orders, reads, changes across tables, surfaces and documents."""

from __future__ import annotations

import io
import math
import zipfile
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrakern.functions import geodesy, groundwater, names, parse, text
from terrakern.operators import changes as X
from terrakern.operators import coordinates as C
from terrakern.operators import documents as DOC
from terrakern.operators import duplicates as D
from terrakern.operators import intervals as I
from terrakern.operators import modelling as N
from terrakern.operators import mutations as M
from terrakern.operators import ordering as R
from terrakern.operators import overlay as O
from terrakern.operators import presence as Z
from terrakern.operators import reads as V
from terrakern.operators import selection as S
from terrakern.operators import spatial as P
from terrakern.operators import surfaces as U
from terrakern.operators.materialise import dealt
from terrakern.plans import standins as T
from terrakern.plans.registry import HOLE, ORDER, _all_anchors, _nodes, _with, query
from terrakern.sources import exports as E
from terrakern.sources import tables as SRC


#: Rows of a task that takes long over each.
WORKED = 20_000


def pick(words, number):
    """words[number % len(words)] as a column."""
    return F.get(F.array(*[F.lit(w) for w in words]), F.pmod(number, F.lit(len(words))).cast("int"))


def picked(words, number: str) -> str:
    """The same in SQL."""
    quoted = ", ".join("NULL" if w is None else "'" + w.replace("'", "''") + "'" for w in words)
    return f"([{quoted}])[CAST(({number}) % {len(words)} AS INTEGER) + 1]"


def grid_sql(source: str, lat: str, lon: str, code: str, name: str = "placed") -> str:
    """CTEs that add n and e, the grid coordinates, to a relation: the series of the transverse projection to the sixth power."""
    ellipsoid, lon0, northing = geodesy.BELTS[code]
    a, inverse = geodesy.ELLIPSOIDS[ellipsoid]
    e2 = (2 - 1 / inverse) / inverse
    m = (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256, 3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024, 15 * e2**2 / 256 + 45 * e2**3 / 1024, 35 * e2**3 / 3072)
    arc = lambda p: f"CAST({a!r} AS DOUBLE) * ({m[0]!r}::DOUBLE * {p} - {m[1]!r}::DOUBLE * SIN(2 * {p}) + {m[2]!r}::DOUBLE * SIN(4 * {p}) - {m[3]!r}::DOUBLE * SIN(6 * {p}))"
    ep2 = e2 / (1 - e2)
    return f"""{name}_p AS (SELECT *, RADIANS({lat}) AS _phi, RADIANS({lon}) - RADIANS({lon0!r}::DOUBLE) AS _lam FROM {source}),
 {name}_q AS (SELECT *, {a!r}::DOUBLE / SQRT(1 - {e2!r}::DOUBLE * SIN(_phi) * SIN(_phi)) AS _v, TAN(_phi) * TAN(_phi) AS _t, {ep2!r}::DOUBLE * COS(_phi) * COS(_phi) AS _c, _lam * COS(_phi) AS _a FROM {name}_p),
 {name} AS (SELECT * EXCLUDE (_phi, _lam, _v, _t, _c, _a), {arc('_phi')} - {arc(repr(math.radians(38.0)) + '::DOUBLE')} + {northing!r}::DOUBLE + _v * TAN(_phi) * (_a * _a / 2 + (5 - _t + 9 * _c + 4 * _c * _c) * POWER(_a, 4) / 24
 + (61 - 58 * _t + _t * _t + 600 * _c - 330 * {ep2!r}::DOUBLE) * POWER(_a, 6) / 720) AS n, 200000 + _v * (_a + (1 - _t + _c) * POWER(_a, 3) / 6 + (5 - 18 * _t + _t * _t + 72 * _c - 58 * {ep2!r}::DOUBLE) * POWER(_a, 5) / 120) AS e FROM {name}_q)"""


# --- text and keys

_NAMES = ("BH-01", "bh 12", "시추공 B H - 7A", "EL. 12.5", "12.5 m", "NH3", "바-9", "-SBH--04-", "X-1", "표고\nCH-2", "", None)
_HOLE_NAMES = ("BH-01", "BH-12", "BH-7A", None, None, "NH-3", "BH-9", "SBH-04", None, "CH-2", None, None)
_HOLE_IDS = ("BH-01", "BH12", "BH-7A", "EL125", "125M", "NH3", "9", "SBH-04", "X-1", "CH-2", "", "")


@query(f"SELECT p_partkey, {picked(_HOLE_NAMES, 'p_partkey')} AS hole, {picked(_HOLE_IDS, 'p_partkey')} AS id FROM part")
def hole_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of holes in cells, with prefixes, levels, syllables and several lines."""
    raw = pick(_NAMES, F.col("p_partkey"))
    return T.table(spark, sf_dir, "part").select("p_partkey", text.hole_name(raw).alias("hole"), text.hole_id(raw).alias("id"))


_DIRTY = ("a\x07b", "  x \n\n y\t", "ＢＨ－１", "①\r\nm³", None)


@query(f"SELECT p_partkey, {picked(('ab', 'x y', 'BH-1', '1 m3', ''), 'p_partkey')} AS cell FROM part")
def clean_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "part").select("p_partkey", text.clean_cell(pick(_DIRTY, F.col("p_partkey"))).alias("cell"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 IN (0, 1) THEN NULL ELSE p_name END AS said, CASE p_partkey % 4 WHEN 2 THEN 1234.5 WHEN 3 THEN p_retailprice END AS value FROM part")
def texts_or_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    said = F.when(k == 0, F.lit(" n/a ")).when(k == 1, F.lit("")).otherwise(F.concat(F.lit(" "), "p_name"))
    cell = F.when(k == 0, F.lit("N/A")).when(k == 1, F.lit("x1")).when(k == 2, F.lit("1,234.5")).otherwise(F.col("p_retailprice").cast("string"))
    return T.table(spark, sf_dir, "part").select("p_partkey", text.text_or_null(said).alias("said"), text.float_or_null(cell).alias("value"))


_REMARKS = ("EPSG:5186", "epsg 5174", "EPSG:9999", "4326", "WGS84 경위도", "GRS80 동부 60만", "GRS80 50만", "Bessel 동부", "GRS80 서부 60만", "GRS80", "중부 60만", " N/A ", "code 5187", None)
_SYSTEMS = ("EPSG:5186", "EPSG:5174", None, "WGS84", "WGS84", "EPSG:5187", "EPSG:5181", "EPSG:5176", None, "EPSG:5186", None, None, None, None)


@query(f"SELECT p_partkey, {picked(_SYSTEMS, 'p_partkey')} AS crs FROM part")
def supported_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "part").select("p_partkey", text.supported_crs(pick(_REMARKS, F.col("p_partkey")), F.lit(True)).alias("crs"))


_SOILS = ("매립층", "실트질모래", "풍화대(상)", "보통암층", "화강암", "SOIL", "연 암", "잔류토", "", None)
_BY_IMPORT = ("soil", "soil", "soil", "hard_rock", "soil", "soil", "soil", "soil", "soil", "soil")
_BY_SHARED = ("soil", "unknown", "weathered_rock", "normal_rock", "unknown", "soil", "soft_rock", "soil", "unknown", "unknown")
_BY_VIEWER = ("TOPSOIL", "UNKNOWN", "WEATHERED", "HARD_ROCK", "UNKNOWN", "UNKNOWN", "SOFT_ROCK", "UNKNOWN", "UNKNOWN", "UNKNOWN")


@query(f"SELECT p_partkey, {picked(_BY_IMPORT, 'p_partkey')} AS by_import, {picked(_BY_SHARED, 'p_partkey')} AS by_shared, {picked(_BY_VIEWER, 'p_partkey')} AS by_viewer FROM part")
def rival_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One name in three vocabularies that differ."""
    raw = pick(_SOILS, F.col("p_partkey"))
    return T.table(spark, sf_dir, "part").select("p_partkey", *[text.variant_group(raw, v).alias(f"by_{v}") for v in ("import", "shared", "viewer")])


@query(
    """SELECT p_partkey, lower(p_name) || ' ' || lower(p_brand) AS key, lower(p_name) || ' ' || lower(p_brand) = lower(p_name) || ' brand#1' AS same, p_partkey % 3 = 0 OR lower(p_brand) = 'brand#1' AS same_or_missing FROM part"""
)
def survey_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, other = F.concat(F.lit("  "), F.upper("p_name"), F.lit(" \t "), F.col("p_brand"), F.lit(" ")), F.concat_ws(" ", "p_name", F.lit("Brand#1"))
    loose = names.same_survey(raw, F.when(F.col("p_partkey") % 3 == 0, F.lit(" ")).otherwise(other), allow_missing=True)
    return T.table(spark, sf_dir, "part").select("p_partkey", names.survey_key(raw).alias("key"), names.same_survey(raw, other).alias("same"), loose.alias("same_or_missing"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '/mnt/logs/' || p_name || '/a.pdf' ELSE 'D:/else/' || p_name END AS path FROM part")
def source_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("c:\\DATA\\Logs\\"), "p_name", F.lit("\\a.pdf"))).otherwise(F.concat(F.lit("D:\\else\\"), "p_name"))
    return T.table(spark, sf_dir, "part").select("p_partkey", names.source_path(raw, "C:\\Data\\Logs\\", "/mnt/logs").alias("path"))


@query("SELECT p_partkey, 'source:' || sha256(p_name) AS by_source, 'job:' || p_brand AS by_job FROM part")
def file_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "part").select("p_partkey", parse.file_key("source", F.col("p_name")).alias("by_source"), parse.file_key("job", F.col("p_brand")).alias("by_job"))


_GROUPS = ("soil", "weathered_rock", "soft_rock", "normal_rock", "hard_rock", "나무")


@query(f"SELECT p_partkey, {picked(('#8B7355', '#C4A57B', '#6B8E5A', '#5F6552', '#3D3D3D', '#B4B4B4'), 'p_partkey')} AS colour FROM part")
def group_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "part").select("p_partkey", names.color(pick(_GROUPS, F.col("p_partkey"))).alias("colour"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, event_id % 3 = 2 AS unread FROM (SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE props END AS props FROM events)")
def raw_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects written as JSON, as a literal of another language, or not at all."""
    raw = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.replace("props", F.lit('"'), F.lit("'"))).otherwise(F.lit("[1, 2"))
    rows = DOC.literal_objects(T.table(spark, sf_dir, "events").select("event_id", raw.alias("raw")), "raw", "event_id")
    return rows.select("event_id", F.try_element_at("values", F.lit("k")).cast("double").alias("k"), F.col("values").isNull().alias("unread"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity + 0.5 AS depth FROM lineitem")
def last_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.concat(F.lit("0.0 ~ "), F.col("l_quantity").cast("int").cast("string"), F.lit(".5 m"))
    return T.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", parse.last_depth(cell).alias("depth"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS INTEGER) || ' ' || (CAST(l_quantity AS INTEGER) + 0.5) || ' -0.25 0.5' AS depths FROM lineitem")
def depth_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several depths in one cell, with commas and a letter for a zero."""
    q = F.col("l_quantity").cast("int").cast("string")
    cell = F.concat(q, F.lit("\n"), q, F.lit(",5 ~ -O.25m . 5"))
    values = F.transform(parse.depth_values(cell), lambda v: F.when(v == F.floor(v), v.cast("int").cast("string")).otherwise(v.cast("string")))
    return T.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.array_join(values, " ").alias("depths"))


@query(_with(T.STRATA, then="""SELECT borehole_id, sha256(STRING_AGG(CAST(ROUND(depth_top, 2) AS VARCHAR) || ':' || CAST(ROUND(depth_bottom, 2) AS VARCHAR) || ':' || soil_type, ';' ORDER BY depth_top, depth_bottom, soil_type)) AS signature FROM strata GROUP BY borehole_id"""))
def strata_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.signature(T.strata(spark, sf_dir), 2)




@query(
    """SELECT event_id, CASE d WHEN 'EL' THEN 50.0 - h WHEN 'GL' THEN value ELSE value END AS depth, CASE d WHEN 'GL' THEN 50.0 - value WHEN 'EL' THEN h ELSE h END AS head
 FROM (SELECT event_id, value, 50.0 - value * 2 AS h, """ + picked(("GL", "EL", "GL+EL"), "event_id") + """ AS d FROM events)"""
)
def levels_by_datum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.table(spark, sf_dir, "events").select("event_id", groundwater.by_datum(pick(("GL", "EL", "GL+EL"), F.col("event_id")), F.lit(50.0), F.col("value"), F.lit(50.0) - F.col("value") * 2).alias("g"))
    return rows.select("event_id", "g.depth", "g.head")


# --- coordinates


@query(_with(T.HOLES, grid_sql("holes", "latitude", "longitude", "EPSG:5186"), then="SELECT id, ROUND(n, 3) AS north, ROUND(e, 3) AS east FROM placed"))
def grid_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid coordinates of every hole in the central belt."""
    north, east = geodesy.to_grid(F.col("latitude"), F.col("longitude"), "EPSG:5186")
    return T.holes(spark, sf_dir).select("id", F.round(north, 3).alias("north"), F.round(east, 3).alias("east"))


def _shift_sql() -> str:
    a, inverse = geodesy.ELLIPSOIDS["bessel"]
    b, inverse_new = geodesy.ELLIPSOIDS["grs80"]
    e2, f2 = (2 - 1 / inverse) / inverse, (2 - 1 / inverse_new) / inverse_new
    dx, dy, dz, *turns, ppm = geodesy.SHIFT
    rx, ry, rz = (math.radians(s / 3600) for s in turns)
    k = 1 + ppm * 1e-6
    phi = f"ATAN2(z, p * (1 - {f2!r}::DOUBLE))"
    steps = [f"s0 AS (SELECT id, x, y, z, SQRT(x * x + y * y) AS p FROM turned)", f"t0 AS (SELECT *, {phi} AS phi FROM s0)"]
    for n in range(1, 9):
        steps.append(f"t{n} AS (SELECT * REPLACE (ATAN2(z + {f2!r}::DOUBLE * {b!r}::DOUBLE / SQRT(1 - {f2!r}::DOUBLE * SIN(phi) * SIN(phi)) * SIN(phi), p) AS phi) FROM t{n - 1})")
    return _with(
        T.HOLES,
        f"n0 AS (SELECT id, RADIANS(latitude) AS a, RADIANS(longitude) AS l, {a!r}::DOUBLE / SQRT(1 - {e2!r}::DOUBLE * SIN(RADIANS(latitude)) * SIN(RADIANS(latitude))) AS v FROM holes)",
        f"c0 AS (SELECT id, v * COS(a) * COS(l) AS x, v * COS(a) * SIN(l) AS y, v * (1 - {e2!r}::DOUBLE) * SIN(a) AS z FROM n0)",
        f"turned AS (SELECT id, {k!r}::DOUBLE * x - {rz!r}::DOUBLE * y + {ry!r}::DOUBLE * z + {dx!r}::DOUBLE AS x, {rz!r}::DOUBLE * x + {k!r}::DOUBLE * y - {rx!r}::DOUBLE * z + {dy!r}::DOUBLE AS y, -{ry!r}::DOUBLE * x + {rx!r}::DOUBLE * y + {k!r}::DOUBLE * z + {dz!r}::DOUBLE AS z FROM c0)".replace("--", "+"),
        *steps,
        then="SELECT id, ROUND(DEGREES(phi), 7) AS latitude, ROUND(DEGREES(ATAN2(y, x)), 7) AS longitude FROM t8",
    )


@query(_shift_sql())
def shifted_datums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hole's place read on the old datum, on the new one."""
    lat, lon = geodesy.shift_datum(F.col("latitude"), F.col("longitude"))
    return T.holes(spark, sf_dir).select("id", F.round(lat, 7).alias("latitude"), F.round(lon, 7).alias("longitude"))


@query(
    _with(
        T.HOLES,
        then="""SELECT id, ROUND(longitude * 111320.0 * COS(RADIANS(36.0)), 3) AS plane_x, ROUND(latitude * 110540.0, 3) AS plane_y, ROUND(RADIANS(longitude - 127.0) * COS(RADIANS(36.0)) * 6378137.0, 3) AS sphere_x,
 ROUND(RADIANS(latitude - 36.0) * 6378137.0, 3) AS sphere_y, ROUND(RADIANS(longitude) * 6378137.0, 3) AS web_x, ROUND(LN(TAN(RADIANS(latitude) / 2 + PI() / 4)) * 6378137.0, 3) AS web_y FROM holes""",
    )
)
def local_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat, mid = F.col("longitude"), F.col("latitude"), F.lit(36.0)
    at = {"plane": geodesy.plane_metres(lon, lat, mid), "sphere": geodesy.sphere_metres(lon, lat, F.lit(127.0), mid), "web": geodesy.web_mercator(lon, lat)}
    return T.holes(spark, sf_dir).select("id", *[F.round(c, 3).alias(f"{n}_{k}") for n, some in at.items() for k, c in zip("xy", some, strict=True)])


@query("SELECT c_custkey, CASE WHEN scaled THEN v / 10.0 ELSE v END AS value, scaled FROM (SELECT *, ABS(v) >= 1000000 AND ABS(v / 10.0) BETWEEN 50000 AND 800000 AS scaled FROM (SELECT c_custkey, CAST(c_custkey % 20 AS DOUBLE) * 500000.0 + c_custkey AS v FROM customer))")
def grid_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    value, scaled = parse.tm_scale((F.col("c_custkey") % 20).cast("double") * 500000.0 + F.col("c_custkey"))
    return T.table(spark, sf_dir, "customer").select("c_custkey", value.alias("value"), scaled.alias("scaled"))


@query("SELECT c_custkey, 'EPSG:5187' AS crs, TRUE AS moved, ROUND(127.5 + (c_custkey % 97 - 48) * 0.002, 6) AS lon, ROUND(36.0 + (c_custkey % 61 - 30) * 0.003, 6) AS lat FROM customer")
def anchored_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holes near a project's place, read in the wrong belt: the belt that brings them back is taken."""
    key = F.col("c_custkey")
    c = dealt(T.table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", rows=WORKED)
    c = c.select("c_custkey", (F.lit(127.5) + (key % 97 - 48) * 0.002).alias("_lon"), (F.lit(36.0) + (key % 61 - 30) * 0.003).alias("_lat"))
    n, e = geodesy.to_grid(F.col("_lat"), F.col("_lon"), "EPSG:5187")
    c = c.withColumns({"x": e, "y": n})
    lat, lon = geodesy.to_geographic(F.col("y"), F.col("x"), "EPSG:5186")
    c = c.withColumns({"lon": lon, "lat": lat, "crs": F.lit("EPSG:5186")})
    return C.anchored(c, "x", "y", (127.5, 36.0)).select("c_custkey", "crs", "moved", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query(_with(T.POINTS, then="""SELECT key, ROUND(SQRT(dx * dx + dz * dz), 6) AS length, ROUND(CASE WHEN a < 0 THEN a + 360 ELSE a END, 6) AS azimuth, ROUND(-dz / SQRT(dx * dx + dz * dz), 9) AS normal_x FROM
 (SELECT key, dx, dz, DEGREES(ATAN2(dx, -dz)) AS a FROM (SELECT key, x + 1 - 500.0 AS dx, y - 500.5 AS dz FROM points))"""))
def section_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    axis = geodesy.section_axis(F.lit(500.0), F.lit(500.5), F.col("x") + 1, F.col("y"))
    return T.points(spark, sf_dir).select("key", F.round(axis["length"], 6).alias("length"), F.round(axis["azimuth"], 6).alias("azimuth"), F.round(axis["normal_x"], 9).alias("normal_x"))


@query(_with(T.HOLES, then="SELECT id, CASE WHEN NOT (longitude BETWEEN 124 AND 132 AND latitude BETWEEN 33 AND 36.5) THEN 'reject' WHEN longitude BETWEEN 127 AND 128 AND latitude BETWEEN 35 AND 36 THEN 'hard' WHEN longitude BETWEEN 126.5 AND 128.5 AND latitude BETWEEN 34.5 AND 36.5 THEN 'soft' ELSE 'out_of_region' END AS zone FROM holes"))
def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    zone = S.zone(F.col("longitude"), F.col("latitude"), (127.0, 35.0, 128.0, 36.0), (126.5, 34.5, 128.5, 36.5), (124.0, 33.0, 132.0, 36.5))
    return T.holes(spark, sf_dir).select("id", zone.alias("zone"))


@query(_with(T.HOLES, then="SELECT project_id, (MIN(longitude) + MAX(longitude)) / 2 AS lon, (MIN(latitude) + MAX(latitude)) / 2 AS lat FROM holes GROUP BY project_id"))
def project_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = T.holes(spark, sf_dir).groupBy("project_id").agg(*[f(c).alias(f"{n}{k}") for n, c in (("x", "longitude"), ("y", "latitude")) for k, f in (("0", F.min), ("1", F.max))])
    lon, lat = C.box_centre([F.col(c) for c in ("x0", "y0", "x1", "y1")])
    return boxes.select("project_id", lon.alias("lon"), lat.alias("lat"))


@query(
    _with(
        T.HOLES,
        """b AS (SELECT project_id AS key, MIN(longitude) AS x0, MIN(latitude) AS y0, MIN(longitude) + 0.05 AS x1, MIN(latitude) + 0.03 AS y1 FROM holes GROUP BY project_id),
 s AS (SELECT *, GREATEST((x1 - x0) * 111.32 * COS(RADIANS((y0 + y1) / 2)), 0.001) AS w, GREATEST((y1 - y0) * 110.54, 0.001) AS h FROM b), t AS (SELECT *, GREATEST(CEIL(w * h / 1.9), 1) AS need FROM s),
 u AS (SELECT *, GREATEST(CEIL(SQRT(need * w / h)), 1) AS cols FROM t)""",
        then="SELECT key, CAST(r AS BIGINT) AS \"row\", CAST(c AS BIGINT) AS \"column\", ROUND(x0 + (x1 - x0) * c / cols, 9) AS x0, ROUND(y0 + (y1 - y0) * (r + 1) / GREATEST(CEIL(need / cols), 1), 9) AS y1 FROM u, range(40) p(c), range(40) q(r) WHERE c < cols AND r < GREATEST(CEIL(need / cols), 1)",
    )
)
def tiled_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = T.holes(spark, sf_dir).groupBy(F.col("project_id").alias("key")).agg(F.min("longitude").alias("x0"), F.min("latitude").alias("y0"), (F.min("longitude") + 0.05).alias("x1"), (F.min("latitude") + 0.03).alias("y1"))
    return P.box_tiles(boxes).select("key", "row", "column", F.round("x0", 9).alias("x0"), F.round("y1", 9).alias("y1"))


@query("SELECT o_custkey AS id, MAX(o_orderkey) AS tile FROM orders GROUP BY o_custkey")
def features_of_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.features_of_tiles(T.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("tile")), "tile")


_SQUARE = ((126.5, 34.5), (128.5, 34.5), (128.5, 36.5), (126.5, 36.5))
_INNER = ((127.0, 35.0), (127.5, 35.0), (127.5, 35.5), (127.0, 35.5))


@query(_with(T.HOLES, then="SELECT id FROM holes WHERE longitude >= 126.5 AND longitude < 128.5 AND latitude >= 34.5 AND latitude < 36.5 AND NOT (longitude >= 127 AND longitude < 127.5 AND latitude >= 35 AND latitude < 35.5)"))
def holes_in_half_open_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A square with a hole, edges half-open: left and lower ones are inside."""
    return T.holes(spark, sf_dir).where(P.in_polygon(F.col("longitude"), F.col("latitude"), [_SQUARE, _INNER], edge=None)).select("id")


@query(_with(T.HOLES, T.STRATA, then="SELECT h.id, COUNT(s.borehole_id) AS n_strata FROM holes h LEFT JOIN strata s ON s.borehole_id = h.id WHERE h.deleted_at IS NULL AND longitude > 126.5 AND longitude < 128.5 AND latitude > 34.5 AND latitude < 36.5 GROUP BY h.id"))
def holes_by_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live holes inside a drawn area with their strata."""
    rows = S.live(T.holes(spark, sf_dir)).where(P.in_polygon(F.col("longitude"), F.col("latitude"), [_SQUARE]))
    return S.nested_strata(rows, T.strata(spark, sf_dir)).select("id", F.size("strata").cast("long").alias("n_strata"))


_KM = "2 * 6371000.0 * ASIN(SQRT(POWER(SIN(RADIANS(b.latitude - a.latitude) / 2), 2) + COS(RADIANS(a.latitude)) * COS(RADIANS(b.latitude)) * POWER(SIN(RADIANS(b.longitude - a.longitude) / 2), 2)))"


@query(_with(T.HOLES, then=f"SELECT a.id AS key, b.id AS other FROM holes a JOIN holes b ON ABS(a.latitude - b.latitude) < 0.2 AND a.id % 2 = 0 AND b.id % 2 = 1 AND {_KM} <= 12000"))
def holes_within_metres(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = T.holes(spark, sf_dir).select(F.col("id").alias("key"), F.col("longitude").alias("lon"), F.col("latitude").alias("lat"))
    return P.within_metres(h.where("key % 2 = 0"), h.where("key % 2 = 1"), 12000.0).select("key", "other")


@query(
    _with(
        T.POINTS,
        then="SELECT key, other, place FROM (SELECT a.key, b.key AS other, ROW_NUMBER() OVER (PARTITION BY a.key ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.key) AS place FROM points a JOIN points b ON a.key % 2 = 0 AND b.key % 2 = 1) WHERE place <= 4",
    )
)
def nearest_four_anywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four neighbours of every point, however far they are."""
    p = T.points(spark, sf_dir)
    return P.nearest(p.where("key % 2 = 0"), p.where("key % 2 = 1"), 4).select("key", "other", "place")


@query(_with(T.POINTS, then="SELECT project, key, CAST(x / 64 AS INTEGER) AS place FROM points WHERE x % 64 = 0 AND x <= 1024"))
def points_on_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = F.explode(F.sequence(F.lit(0), F.lit(16))).alias("place")
    axis = T.projects(spark, sf_dir).select(F.col("project_id").alias("project"), steps).withColumn("at", F.col("place") * 64.0)
    return P.on_axis(axis, T.points(spark, sf_dir).select("project", "key", F.col("x").alias("at")))


# --- layouts

_BOXES = """e AS (SELECT l_orderkey AS page, l_linenumber * 1000000 + l_partkey AS key, l_quantity AS x0, l_quantity + 20 AS x1, l_linenumber * 10.0 AS y0, l_linenumber * 10.0 + 12 AS y1 FROM
 (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem))"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").distinct()
    y = F.col("l_linenumber") * 10.0
    return rows.select(F.col("l_orderkey").alias("page"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("key"), F.col("l_quantity").alias("x0"), (F.col("l_quantity") + 20).alias("x1"), y.alias("y0"), (y + 12).alias("y1"))


@query(_with(_BOXES, then="""SELECT page, key, box, ROUND(share, 6) AS share FROM (SELECT a.page, a.key, b.key AS box, GREATEST(LEAST(a.x1, b.x1) - GREATEST(a.x0, b.x0), 0) * GREATEST(LEAST(a.y1, b.y1) - GREATEST(a.y0, b.y0), 0) / 240.0 AS share
 FROM e a JOIN e b ON a.page = b.page AND a.key % 2 = 0 AND b.key % 2 = 1) WHERE share >= 0.05"""))
def overlapping_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _boxes(spark, sf_dir)
    return P.overlapping_boxes(e.where("key % 2 = 0"), e.where("key % 2 = 1"), "page").withColumn("share", F.round("share", 6))


@query(_with(_BOXES, then="""SELECT page, key, value FROM (SELECT a.page, a.key, b.key AS value, ROW_NUMBER() OVER (PARTITION BY a.page, a.key ORDER BY b.x0 - a.x1 + 8 * ABS(b.y0 - a.y0), b.key) AS n FROM e a JOIN e b ON a.page = b.page AND a.key % 2 = 0 AND b.key % 2 = 1
 AND b.x0 - a.x1 BETWEEN 0 AND 180 AND ABS(b.y0 - a.y0) <= 18) WHERE n = 1"""))
def values_right_of_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _boxes(spark, sf_dir)
    return P.value_right_of(e.where("key % 2 = 0"), e.where("key % 2 = 1"), "page")


@query(_with(_BOXES, then="""SELECT page, key, line FROM (SELECT page, key, line, ROW_NUMBER() OVER (PARTITION BY page, key ORDER BY share DESC, CASE WHEN share > 0 THEN 0 ELSE gap END, line) AS n FROM (SELECT a.page, a.key, b.key AS line,
 CASE WHEN LEAST(a.y1, b.y1) - GREATEST(a.y0, b.y0) > 0 THEN (LEAST(a.y1, b.y1) - GREATEST(a.y0, b.y0)) / 12.0 ELSE 0.0 END AS share, ABS(a.y0 - b.y0) AS gap FROM e a JOIN e b ON a.page = b.page AND a.key % 2 = 0 AND b.key % 2 = 1)) WHERE n = 1"""))
def lines_by_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _boxes(spark, sf_dir)
    return P.best_by_overlap(e.where("key % 2 = 0"), e.where("key % 2 = 1"), "page")


@query(
    """SELECT CAST(o_orderkey AS VARCHAR) AS doc, 1 AS page, 'paragraph' AS type, o_orderpriority AS text, CAST(NULL AS INTEGER) AS col FROM orders UNION ALL
 SELECT CAST(o_orderkey AS VARCHAR), 1, 'cell', o_orderstatus, 2 FROM orders UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 1, 'list', o_orderpriority || chr(10) || o_orderstatus, NULL FROM orders"""
)
def flattened_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of a paragraph, a table and a list that takes its text from its kids; one in five isn't JSON and has no elements."""
    box = '"bounding box": [0, 0, 1, 1]'
    tree = F.format_string(
        '{"type": "document", "page number": 1, "kids": [{"type": "paragraph", ' + box + ', "content": " %s "}, {"type": "table", "rows": [{"row number": 1, "cells": [{"type": "cell", "column number": 2, ' + box + ', "content": "%s"}]}]}, '
        '{"type": "list", ' + box + ', "kids": [{"type": "item", "content": "%s"}, {"type": "item", "kids": [{"content": "%s"}]}]}]}',
        "o_orderpriority", "o_orderstatus", "o_orderpriority", "o_orderstatus",
    )
    docs = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("doc"), tree.alias("json"))
    broken = docs.select(F.concat(F.lit("broken-"), "doc").alias("doc"), F.lit('{"type": ').alias("json"))
    return DOC.flattened(dealt(docs.unionByName(broken), "doc", rows=WORKED)).select("doc", "page", "type", "text", "col")


_SHEET = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{rows}</sheetData></worksheet>'


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of each project's holes (path, content): semicolons in three encodings, or a workbook."""
    rows = T.holes(spark, sf_dir).select("project_id", "id", "name", "longitude", "latitude", "elevation")

    def write(some: pd.DataFrame) -> pd.DataFrame:
        some, key = some.sort_values("id"), int(some["project_id"].iloc[0])
        named = some.rename(columns={"name": "name_"})
        lines = chain([["공번", "경도", "위도", "표고", "토사", "연암"]], ([r.name_, repr(r.longitude), repr(r.latitude), repr(r.elevation), "2.5", "1.0"] for r in named.itertuples()))
        if key % 4 == 3:
            buffer, (head, tail) = io.BytesIO(), _SHEET.split("{rows}")
            with zipfile.ZipFile(buffer, "w") as z, z.open("xl/worksheets/sheet1.xml", "w") as sheet:
                sheet.write(head.encode())
                for n, line in enumerate(lines, start=1):
                    cells = "".join(f'<c r="{"ABCDEF"[k]}{n}" t="inlineStr"><is><t>{v}</t></is></c>' for k, v in enumerate(line))
                    sheet.write(f'<row r="{n}">{cells}</row>'.encode())
                sheet.write(tail.encode())
            return pd.DataFrame({"path": [f"p{key}.xlsx"], "content": [buffer.getvalue()]})
        return pd.DataFrame({"path": [f"p{key}.csv"], "content": ["\n\n".join(";".join(line) for line in lines).encode(("utf-8", "utf-8-sig", "cp949")[key % 4])]})

    return rows.groupBy("project_id").applyInPandas(write, "path string, content binary")


_PATH = "'p' || CAST(project_id AS VARCHAR) || CASE WHEN project_id % 4 = 3 THEN '.xlsx' ELSE '.csv' END"


@query(_with(T.HOLES, then=f"SELECT {_PATH} AS path, ROW_NUMBER() OVER (PARTITION BY project_id ORDER BY id) AS row_no, name AS first, CAST(6 AS BIGINT) AS n FROM holes UNION ALL SELECT DISTINCT {_PATH}, 0, '공번', 6 FROM holes"))
def cells_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of tables in four encodings and of workbooks."""
    return SRC.cells_of(_files(spark, sf_dir)).select("path", "row_no", F.get("cells", F.lit(0)).alias("first"), F.size("cells").cast("long").alias("n"))


@query(_with(T.HOLES, then=f"SELECT {_PATH} AS path, name, longitude, latitude, elevation, latitude BETWEEN 33 AND 36.5 AS inside, 'wide' AS form, 1.0 AS confidence, COUNT(*) OVER () * 2 AS strata FROM holes WHERE TRUE"))
def holes_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holes and strata of the same files: the layout is inferred from a file's first rows, places beyond the bounds set apart."""
    cells = SRC.cells_of(_files(spark, sf_dir))
    layout = SRC.infer([r["cells"] for r in cells.where("row_no < 5").orderBy("path", "row_no").limit(5).collect()])
    holes = SRC.holes_of(cells, layout)
    inside, outside = SRC.quarantined(holes, north=36.5)
    strata = SRC.wide_strata(holes, layout).agg(F.count(F.lit(1)).alias("strata"))
    both = inside.withColumn("inside", F.lit(True)).unionByName(outside.withColumn("inside", F.lit(False)))
    return both.crossJoin(F.broadcast(strata)).select("path", "name", "longitude", "latitude", "elevation", "inside", F.lit(layout.form).alias("form"), F.lit(layout.confidence).alias("confidence"), "strata")


# --- filters, orders and small reads


@query("SELECT event_id, event_id % 7 <> 0 AND event_id % 11 <> 0 AS sound FROM events")
def finite_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    e = T.table(spark, sf_dir, "events").withColumn("v", F.when(k % 7 == 0, float("nan")).when(k % 11 == 0, float("inf")).otherwise(F.col("value")))
    sound, rest = S.finite_rows(e, ["v", "value"])
    return sound.select("event_id", F.lit(True).alias("sound")).unionByName(rest.select("event_id", F.lit(False).alias("sound")))


@query(_with(T.LOGGED, then="SELECT borehole_id, COUNT(*) AS n FROM logged WHERE depth_bottom > depth_top + 3 GROUP BY borehole_id"))
def valid_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.logged(spark, sf_dir).withColumn("depth_top", F.col("depth_top") + 3)
    return S.valid_intervals(rows, "depth_top", "depth_bottom").groupBy("borehole_id").agg(F.count(F.lit(1)).alias("n"))


@query(_with(T.HOLES, then="SELECT id FROM holes WHERE elevation > 0 AND elevation < 2000"))
def sane_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sane_levels(T.holes(spark, sf_dir), "elevation", 0.0).select("id")


_MODES = {"all": "NOT v", "existing": "NOT v AND NOT w", "new": "NOT v AND w", "virtual": "v", "warn": "NOT v AND (gap >= 0.5 OR bad)", "edited": "NOT v AND ed"}


@query(_with("m AS (SELECT c_custkey, c_custkey % 7 = 0 AS v, c_custkey % 3 = 0 AS w, ABS(c_acctbal) / 8000 AS gap, c_custkey % 13 = 0 AS bad, c_custkey % 5 = 0 AS ed FROM customer)", then=" UNION ALL ".join(f"SELECT '{n}' AS mode, COUNT(*) AS n FROM m WHERE {w}" for n, w in _MODES.items())))
def table_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k, out = T.table(spark, sf_dir, "customer"), F.col("c_custkey"), None
    for mode in _MODES:
        rows = DOC.table_mode(c, mode, F.abs("c_acctbal") / 8000, k % 13 == 0, k % 5 == 0, k % 7 == 0, k % 3 == 0)
        part = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(mode).alias("mode"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query(_with(T.HOLES, T.LINKS, then="SELECT 'saved' AS which, id FROM holes WHERE id IN (SELECT borehole_id FROM links WHERE project_role = 'new') UNION ALL SELECT 'all', id FROM holes"))
def saved_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saved selection, none saved, and an empty one."""
    h = T.holes(spark, sf_dir)
    saved = T.links(spark, sf_dir).where("project_role = 'new'").select(F.col("borehole_id").alias("id"))
    some = {"saved": S.selected(h, "id", saved), "all": S.selected(h, "id", None), "none": S.selected(h, "id", saved.limit(0))}
    parts = [df.select(F.lit(n).alias("which"), "id") for n, df in some.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_LAYERED = "CASE soil_type WHEN 'A' THEN 'soil' WHEN 'N' THEN 'soft_rock' ELSE 'unknown' END"


def _grouped_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.strata(spark, sf_dir).withColumn("strata_group", F.when(F.col("soil_type") == "A", F.lit("soil")).when(F.col("soil_type") == "N", F.lit("soft_rock")).otherwise(F.lit("unknown")))


@query("SELECT DISTINCT CASE l_returnflag WHEN 'A' THEN 'soil' ELSE 'soft_rock' END AS layer FROM lineitem WHERE l_returnflag IN ('A', 'N')")
def grounded_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.grounded_layers(_grouped_strata(spark, sf_dir))


@query(_with(T.HOLES, then="SELECT id, CASE id WHEN 7 THEN 1 WHEN 3 THEN 3 WHEN 5 THEN 2 ELSE 0 END AS place FROM holes"))
def listed_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in a list that names a hole twice: the last counts."""
    return M.by_listed_order(T.holes(spark, sf_dir), "id", F.array(*[F.lit(n).cast("long") for n in (3, 7, 5, 3)])).select("id", "place")


@query("SELECT name, n, kind, CAST(ROW_NUMBER() OVER (ORDER BY CASE kind WHEN 'conflict' THEN 0 WHEN 'coordinate_conflict' THEN 1 ELSE 2 END, n DESC, name) - 1 AS INTEGER) AS place FROM (SELECT p_brand || p_type AS name, COUNT(*) AS n, CASE MIN(p_partkey) % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'conflict' ELSE 'coordinate_conflict' END AS kind FROM part GROUP BY p_brand || p_type)")
def duplicates_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.table(spark, sf_dir, "part").groupBy(F.concat("p_brand", "p_type").alias("name")).agg(F.count(F.lit(1)).alias("n"), pick(("exact", "conflict", "coordinate_conflict"), F.min("p_partkey")).alias("kind"))
    return R.placed(p, [], [D.kind_rank(F.col("kind")), F.desc("n"), F.col("name")]).select("name", "n", "kind", F.col("place").cast("int").alias("place"))


@query("SELECT o_custkey, o_orderkey, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) - 1 AS INTEGER) AS place FROM orders")
def newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.placed(T.table(spark, sf_dir, "orders"), ["o_custkey"], R.newest_first("o_orderdate", "o_orderkey")).select("o_custkey", "o_orderkey", F.col("place").cast("int").alias("place"))


@query("SELECT n_regionkey, n_name, CAST(ROW_NUMBER() OVER (PARTITION BY n_regionkey ORDER BY CASE n_name WHEN 'NATION_7' THEN 1 WHEN 'NATION_3' THEN 2 WHEN 'NATION_12' THEN 3 ELSE 4 END, n_name) - 1 AS INTEGER) AS place FROM nation")
def vocabulary_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.placed(T.table(spark, sf_dir, "nation"), ["n_regionkey"], R.by_vocabulary("n_name", ("NATION_7", "NATION_3", "NATION_12"))).select("n_regionkey", "n_name", F.col("place").cast("int").alias("place"))


@query("SELECT user_id, event_id, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY COALESCE(CASE WHEN event_id % 4 <> 0 THEN value - 2 END, -1), event_id) - 1 AS INTEGER) AS place FROM events")
def depth_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.table(spark, sf_dir, "events").withColumn("depth", F.when(F.col("event_id") % 4 != 0, F.col("value") - 2))
    return R.placed(e, ["user_id"], [*R.by_depth("depth"), F.col("event_id")]).select("user_id", "event_id", F.col("place").cast("int").alias("place"))


@query("SELECT c_nationkey, c_mktsegment, CAST(ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment = 'BUILDING', c_mktsegment) - 1 AS INTEGER) AS place FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer)")
def group_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = T.table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment").distinct().withColumn("virtual", F.col("c_mktsegment") == "BUILDING")
    return R.placed(g, ["c_nationkey"], R.by_group("virtual", "c_mktsegment")).select("c_nationkey", "c_mktsegment", F.col("place").cast("int").alias("place"))


@query("SELECT o_custkey, MAX(o_orderkey) AS id FROM (SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 100) WHERE o_custkey % 2 = 0 GROUP BY o_custkey")
def replayed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey")
    return R.replay_of(jobs, "o_custkey", T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey")).where("o_custkey % 2 = 0"))


@query(_with(T.STRATA, then="SELECT borehole_id AS id, depth_top, thickness FROM strata"))
def preview_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.strata(spark, sf_dir)
    holes = s.select(F.col("borehole_id").alias("id")).distinct()
    return V.preview_rows(S.nested_strata(holes, s)).select("id", "depth_top", "thickness")


@query(
    _with(
        T.HOLES, T.LINKS,
        then="""SELECT project_id, id FROM holes WHERE project_id IN (SELECT CAST(n_nationkey AS BIGINT) FROM nation WHERE n_regionkey < 3) UNION SELECT l.project_id, h.id FROM links l JOIN holes h ON h.id = l.borehole_id
 WHERE l.deleted_at IS NULL AND l.project_role <> 'excluded' AND l.project_id IN (SELECT CAST(n_nationkey AS BIGINT) FROM nation WHERE n_regionkey < 3)""",
    )
)
def owned_or_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    projects = T.table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").cast("long").alias("project_id"))
    return V.owned_or_linked(T.holes(spark, sf_dir), T.links(spark, sf_dir), projects)


@query("SELECT c_custkey AS id, (SELECT MAX(o_orderkey) FROM orders WHERE o_custkey % 500 = c_custkey % 700) AS job_id FROM customer")
def newest_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 500).cast("string").alias("path"))
    holes = T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 700).cast("string").alias("source_file"))
    return V.newest_job(holes, jobs).select("id", "job_id")


@query("SELECT 'origin' AS kind, c_mktsegment AS name, COUNT(*) AS n FROM customer GROUP BY c_mktsegment UNION ALL SELECT 'flag', 'low', COUNT(*) FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'flag', 'odd', COUNT(*) FROM customer WHERE c_custkey % 2 = 1")
def flag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = S.flags({"low": F.col("c_acctbal") < 0, "odd": F.col("c_custkey") % 2 == 1})
    return V.flag_counts(T.table(spark, sf_dir, "customer").withColumn("flags", flags), "c_mktsegment", "flags")


@query(_with(T.LOGGED, then="SELECT COUNT(*) AS rows, COUNT(DISTINCT (borehole_id, soil_type)) AS holes, COUNT(*) FILTER (WHERE depth_bottom > depth_top) AS valid FROM logged"))
def summary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.summary(T.logged(spark, sf_dir), ["borehole_id", "soil_type"])


@query("SELECT 'orders' AS name, COUNT(*) AS n, MAX(o_orderkey) + 1 AS next_id FROM orders UNION ALL SELECT 'holes', COUNT(*), MAX(c_custkey) + 1 FROM customer UNION ALL SELECT 'none', 0, 1")
def table_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, holes = T.table(spark, sf_dir, "orders"), T.table(spark, sf_dir, "customer")
    return V.table_marks({"orders": (orders, "o_orderkey"), "holes": (holes, "c_custkey"), "none": (holes.limit(0), "c_custkey")})


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN CAST(NULL AS BIGINT) ELSE c_custkey % 4 + 1 END AS page FROM customer")
def pages_of_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hole's page by its name, dashes and blanks aside: a third are in no page."""
    h = T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("doc"), F.concat(F.lit("BH - "), F.col("c_custkey")).alias("name"))
    at = F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 4 + 1)
    pages = h.withColumn("page", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(5).cast("long"))))
    body = F.when(F.col("page") >= at, F.concat(F.lit("log of bh–"), F.col("id"), F.lit(" end"))).otherwise(F.lit("contents"))
    return V.page_of_hole(h, pages.select("doc", "page", body.alias("text")))


@query(_with(T.PROJECTS, T.HOLES, then="SELECT (SELECT COUNT(*) FROM projects) AS projects, (SELECT MAX(project_id) FROM projects) AS newest, (SELECT COUNT(*) FROM holes WHERE deleted_at IS NULL) AS holes, 2 AS missing"))
def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.health(T.projects(spark, sf_dir), T.holes(spark, sf_dir), [0, 5, 1000, 2000])


@query("SELECT o_custkey, CASE WHEN COUNT(DISTINCT o_orderstatus) = 1 THEN MIN(o_orderstatus) END AS o_orderstatus FROM orders GROUP BY o_custkey")
def only_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.only_candidate(T.table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus")


@query(_with(T.POINTS, then="SELECT project, ROUND(AVG(x), 6) AS x, ROUND(AVG(y), 6) AS y, COUNT(*) AS n FROM (SELECT project, key % 50 AS grp, ARG_MIN(x, key) AS x, ARG_MIN(y, key) AS y FROM points GROUP BY project, key % 50) GROUP BY project"))
def preview_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.points(spark, sf_dir).withColumn("group", F.struct("project", (F.col("key") % 50).alias("part")))
    first = V.preview_points(p, "group", "key").withColumn("project", F.col("group.project"))
    return V.mean_point(first, ["project"]).select("project", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "n")


@query(_with(T.STRATA, then=f"SELECT borehole_id, strata_group, MIN(depth_top) AS depth_top, ANY_VALUE(total) AS total_depth FROM (SELECT borehole_id, depth_top, {_LAYERED} AS strata_group, MAX(depth_bottom) OVER (PARTITION BY borehole_id) AS total FROM strata) GROUP BY borehole_id, strata_group"))
def legends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.legend(_grouped_strata(spark, sf_dir))


@query("SELECT DISTINCT CASE l_returnflag WHEN 'A' THEN 'soil' WHEN 'N' THEN 'soft_rock' ELSE 'unknown' END AS strata_group FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def groups_in_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = T.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("borehole_id"))
    return V.groups_in_scope(_grouped_strata(spark, sf_dir), scope)


@query("SELECT c_nationkey, AVG(COALESCE(CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END, 0)) AS mean FROM customer GROUP BY c_nationkey")
def means_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrakern.operators.aggregates import mean_with_nulls_as_zero

    value = F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal"))
    return T.table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(mean_with_nulls_as_zero(value).alias("mean"))


# --- strata


@query("SELECT borehole_id, t AS depth_top, b AS depth_bottom, soil_type, MIN(k) AS code FROM (SELECT l_orderkey AS borehole_id, ROUND(l_quantity / 7, 2) AS t, ROUND(l_quantity / 3, 2) AS b, l_returnflag AS soil_type, l_partkey AS k FROM lineitem) GROUP BY ALL")
def first_of_rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strata that agree in rounded depths and soil, each once: the first by code."""
    rows = T.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("borehole_id"), (F.col("l_quantity") / 7).alias("depth_top"), (F.col("l_quantity") / 3).alias("depth_bottom"), F.col("l_returnflag").alias("soil_type"), F.col("l_partkey").alias("code"))
    out = I.distinct_rounded(rows, HOLE, {"depth_top": 2, "depth_bottom": 2}, ["soil_type"], ["code"])
    return out.select("borehole_id", F.round("depth_top", 2).alias("depth_top"), F.round("depth_bottom", 2).alias("depth_bottom"), "soil_type", "code")


@query(
    """SELECT event_id, CASE WHEN has THEN v ELSE LAST_VALUE(CASE WHEN has THEN ROW(event_id, v) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)[2] END AS v
 FROM (SELECT event_id, user_id, event_id % 4 IN (0, 1) AS has, CASE WHEN event_id % 4 = 0 THEN value END AS v FROM events)""".replace(")[2]", ").v")
    .replace("ROW(event_id, v)", "{'n': event_id, 'v': v}")
    .replace("CASE WHEN has THEN v ELSE LAST_VALUE", "CASE WHEN has THEN v ELSE (LAST_VALUE")
    .replace("CURRENT ROW).v", "CURRENT ROW)).v")
)
def cascaded_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages take what the page before says only where they lack the key; a key that is there and empty stands."""
    k = F.col("event_id")
    e = T.table(spark, sf_dir, "events").select("event_id", "user_id", F.when(k % 4 == 0, F.create_map(F.lit("v"), F.col("value"))).when(k % 4 == 1, F.create_map(F.lit("v"), F.lit(None).cast("double"))).otherwise(F.create_map().cast("map<string,double>")).alias("said"))
    return I.cascaded(e, ["user_id"], ["event_id"], "said", ["v"]).select("event_id", "v")


@query(
    _with(
        "n AS (SELECT l_orderkey AS hole, l_linenumber, CAST(l_quantity AS DOUBLE) AS b, LAG(CAST(l_quantity AS DOUBLE)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS p, l_partkey % 4 = 0 AS z, l_partkey, l_suppkey FROM lineitem)",
        then="SELECT hole, l_linenumber, l_partkey, l_suppkey, SUM(CASE WHEN COALESCE(p >= 4 AND ((p >= 10 AND z) OR b <= p - GREATEST(1, p * 0.1)), FALSE) THEN 1 ELSE 0 END) OVER (PARTITION BY hole ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM n",
    )
)
def holes_by_depth_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's rows parted where a depth says that a new hole begins."""
    rows = T.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("hole"), "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("bottom"), F.lit(None).cast("double").alias("top"), (F.col("l_partkey") % 4 == 0).alias("zero"))
    return DOC.sections_by_depth(rows, ["hole"], ["l_linenumber", "l_partkey", "l_suppkey"], "top", "bottom", F.col("zero")).select("hole", "l_linenumber", "l_partkey", "l_suppkey", "section")


_LOST = """lost AS (SELECT borehole_id, CAST(ROW_NUMBER() OVER (PARTITION BY borehole_id ORDER BY l_linenumber, l_partkey, l_suppkey, thickness, soil_type) AS INTEGER) AS n,
 CASE WHEN l_partkey % 3 = 0 THEN depth_bottom ELSE depth_bottom / 10 END AS d FROM strata), ahead AS (SELECT *, LEAD(d) OVER (PARTITION BY borehole_id ORDER BY n) AS f, CAST(CAST(ROUND(d) AS INTEGER) AS VARCHAR) AS t FROM lost)"""


def _repair(at: str, x: str) -> str:
    """What a bottom is read as after `at`, in SQL, without depths known from elsewhere."""
    tries = (f"ROUND({x}.d / 10, 2)", f"CASE WHEN {x}.d >= 100 THEN ROUND({x}.d / 100, 2) END", f"CASE WHEN LENGTH({x}.t) = 3 AND {x}.t LIKE '1%' THEN CAST(SUBSTR({x}.t, 2, 2) AS DOUBLE) / 10 END")
    fit = ", ".join(f"CASE WHEN {t} > {at} + 0.001 AND {t} < {x}.f THEN {t} END" for t in tries)
    return f"CASE WHEN {x}.d >= 10 AND ABS({x}.d - ROUND({x}.d)) <= 0.001 AND COALESCE({x}.f > {at} AND {x}.f < {x}.d, FALSE) THEN COALESCE(GREATEST({fit}), {x}.d) ELSE {x}.d END"


@query("WITH RECURSIVE " + T.STRATA + ", " + _LOST + f", walk AS (SELECT borehole_id, n, {_repair('CAST(0 AS DOUBLE)', 'a')} AS v FROM ahead a WHERE n = 1 UNION ALL SELECT x.borehole_id, x.n, {_repair('w.v', 'x')} FROM walk w JOIN ahead x ON x.borehole_id = w.borehole_id AND x.n = w.n + 1) SELECT borehole_id, n, ROUND(v, 6) AS depth FROM walk")
def depths_with_lost_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bottoms of every hole, a third without their decimal point."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("borehole_id").orderBy(*ORDER))
    lost = T.strata(spark, sf_dir).select("borehole_id", n.alias("n"), F.when(F.col("l_partkey") % 3 == 0, F.col("depth_bottom")).otherwise(F.col("depth_bottom") / 10).alias("depth"))
    return DOC.repaired_depths(lost, HOLE, "n", "depth").withColumn("depth", F.round("depth", 6))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 <> 1 THEN 'existing' WHEN o_orderkey % 3 = 0 THEN 'manual' ELSE 'upload-' || CAST(o_orderkey % 7 AS VARCHAR) END AS grp, place FROM orders JOIN (SELECT grp AS g2, CAST(ROW_NUMBER() OVER (ORDER BY grp <> 'existing', MIN(o) DESC) - 1 AS INTEGER) AS place FROM (SELECT o_orderkey AS o, CASE WHEN o_orderkey % 4 <> 1 THEN 'existing' WHEN o_orderkey % 3 = 0 THEN 'manual' ELSE 'upload-' || CAST(o_orderkey % 7 AS VARCHAR) END AS grp FROM orders) GROUP BY grp) ON g2 = CASE WHEN o_orderkey % 4 <> 1 THEN 'existing' WHEN o_orderkey % 3 = 0 THEN 'manual' ELSE 'upload-' || CAST(o_orderkey % 7 AS VARCHAR) END")
def uploads_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.links(spark, sf_dir).select("id", "project_role", F.col("id").alias("ord"), F.when(F.col("id") % 3 != 0, F.col("id") % 7).alias("job"))
    return DOC.by_upload(rows).select("id", F.col("group").alias("grp"), F.col("place").cast("int").alias("place"))


@query("SELECT event_id, CASE WHEN c >= b AND c > a THEN 'ocr' WHEN b > a THEN 'tables' ELSE 'text' END AS source FROM (SELECT event_id, event_id % 5 AS a, event_id % 7 AS b, CASE WHEN event_id % 7 >= event_id % 3 THEN -1 ELSE event_id % 3 END AS c FROM events)")
def best_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    third = F.when(k % 7 >= k % 3, F.lit(-1)).otherwise(k % 3)
    best = DOC.best_reading({"text": (k % 5, F.lit("a")), "tables": (k % 7, F.lit("b")), "ocr": (third, F.lit("c"))})
    return T.table(spark, sf_dir, "events").select("event_id", best["source"].alias("source"))


# --- changes across tables

_OVERRIDES = """overrides AS (SELECT project_id, source_borehole_id, status, sets, CASE WHEN sets = 1 THEN v END AS v FROM (SELECT o_orderkey % 20 AS project_id, o_custkey AS source_borehole_id, """ + picked(("draft", "approved", "rejected"), "MIN(o_orderkey)") + """ AS status,
 CASE MIN(o_orderkey) % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS sets, CAST(MIN(o_orderkey) % 100 AS DOUBLE) + 0.5 AS v FROM orders GROUP BY o_orderkey % 20, o_custkey))"""  # fmt: skip


def _overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An override of each project and hole: a level, a null level, or nothing that is named."""
    o = T.table(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 20).alias("project_id"), F.col("o_custkey").alias("source_borehole_id")).agg(F.min("o_orderkey").alias("k"))
    data = F.when(F.col("k") % 4 == 0, F.concat(F.lit('{"elevation": '), (F.col("k") % 100).cast("string"), F.lit(".5}"))).when(F.col("k") % 4 == 1, F.lit('{"elevation": null}')).otherwise(F.lit("{}"))
    return o.select("project_id", "source_borehole_id", pick(("draft", "approved", "rejected"), F.col("k")).alias("status"), data.alias("data"), F.lit(None).cast("timestamp_ntz").alias("deleted_at"))


@query(_with(T.HOLES, _OVERRIDES, then="""SELECT id, CASE sets WHEN 1 THEN v WHEN 2 THEN NULL ELSE elevation END AS elevation, CASE WHEN o.status IS NOT NULL THEN 'modified_' || o.status WHEN is_supplementary THEN 'supplementary' ELSE 'original' END AS data_status,
 CASE WHEN o.status IS NOT NULL THEN FALSE ELSE is_supplementary END AS is_supplementary FROM holes LEFT JOIN (SELECT * FROM overrides WHERE status <> 'rejected') o ON o.project_id = holes.project_id AND o.source_borehole_id = holes.id"""))
def overridden_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hole under its project's override: a level that is set, one that is set to nothing, one that isn't named."""
    base = S.with_status(T.holes(spark, sf_dir))
    return O.with_override(base, _overrides(spark, sf_dir), {"elevation": "double"}).select("id", "elevation", "data_status", "is_supplementary")


@query(_with(T.HOLES, T.LINKS, _OVERRIDES, then="""SELECT h.id, l.project_id, CASE sets WHEN 1 THEN v WHEN 2 THEN NULL ELSE elevation END AS elevation, l.project_role AS data_status FROM (SELECT * FROM holes WHERE deleted_at IS NULL) h JOIN links l ON l.borehole_id = h.id AND l.deleted_at IS NULL AND l.project_role <> 'excluded'
 LEFT JOIN (SELECT * FROM overrides WHERE status <> 'rejected') o ON o.project_id = l.project_id AND o.source_borehole_id = h.id UNION ALL
 SELECT h.id, h.project_id, CASE sets WHEN 1 THEN v WHEN 2 THEN NULL ELSE elevation END, CASE WHEN o.status IS NOT NULL THEN 'modified_' || o.status WHEN is_supplementary THEN 'supplementary' ELSE 'original' END FROM (SELECT * FROM holes WHERE deleted_at IS NULL) h
 LEFT JOIN (SELECT * FROM overrides WHERE status <> 'rejected') o ON o.project_id = h.project_id AND o.source_borehole_id = h.id WHERE h.project_id NOT IN (SELECT project_id FROM links WHERE deleted_at IS NULL)
 OR (is_supplementary AND o.status IS NULL AND NOT EXISTS (SELECT 1 FROM links l WHERE l.deleted_at IS NULL AND l.project_id = h.project_id AND l.borehole_id = h.id))"""))
def effective_with_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The effective view of all projects with real overrides and without revisions: all three layers but one."""
    base = T.holes(spark, sf_dir).withColumns({c: F.lit(None).cast("double") for c in ("groundwater_depth_bgl_m", "groundwater_head_elevation_m")}).withColumn("groundwater_reference_datum", F.lit(None).cast("string"))
    out = O.effective(base, T.revisions(spark, sf_dir).limit(0), _overrides(spark, sf_dir), T.links(spark, sf_dir), {"elevation": "double"})
    return out.select("id", "project_id", "elevation", "data_status")


@query("""SELECT 'hole' AS what, c_custkey AS id, c_nationkey AS project FROM customer UNION ALL SELECT 'hole', s_suppkey + 10000000, s_nationkey FROM supplier WHERE s_suppkey % 4 <> 0 UNION ALL
 SELECT 'refused', s_suppkey + 10000000, -1 FROM supplier WHERE s_suppkey % 4 = 0 UNION ALL SELECT 'refused', c_custkey, -2 FROM customer WHERE c_custkey < 3 UNION ALL SELECT 'link', s_suppkey + 10000000, s_nationkey FROM supplier WHERE s_suppkey % 4 <> 0""")
def created_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as new holes: a quarter have a stratum that ends above its top, three take ids that are there."""
    h = T.holes(spark, sf_dir)
    s = T.table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 10000000).alias("id"), F.col("s_nationkey").cast("long").alias("project_id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("elevation"), F.lit(127.0).alias("longitude"), F.lit(36.0).alias("latitude"), F.lit(True).alias("is_supplementary"), F.lit(None).cast("timestamp_ntz").alias("deleted_at"))
    strata = s.select(F.col("id").alias("borehole_id"), F.lit(0.0).alias("depth_top"), F.when((F.col("id") - 10000000) % 4 == 0, 0.0).otherwise(2.0).alias("depth_bottom"))
    links = T.links(spark, sf_dir).limit(0).select("project_id", "borehole_id", "project_role")
    holes, linked, refused = X.created(h, links, s.unionByName(h.where("id < 3")), strata)
    project = lambda df, what, id_, c: df.select(F.lit(what).alias("what"), F.col(id_).alias("id"), c.cast("int").alias("project"))
    return project(holes, "hole", "id", F.col("project_id")).unionByName(project(refused, "refused", "id", F.when(F.col("reason") == "taken", -2).otherwise(-1))).unionByName(project(linked, "link", "borehole_id", F.col("project_id")))


@query(_with(T.REVISIONS, then="""SELECT borehole_id, version FROM revisions UNION ALL SELECT c_custkey, COALESCE(m, 0) + k FROM (SELECT c_custkey, CAST(UNNEST([1, 2]) AS BIGINT) AS k FROM customer WHERE c_custkey % 3 = 0) LEFT JOIN (SELECT borehole_id, MAX(version) AS m FROM revisions GROUP BY borehole_id) ON borehole_id = c_custkey"""))
def revised_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three requests for every third hole, of which the one without a reason is refused; other holes' name nothing."""
    key = F.col("c_custkey")
    c = T.table(spark, sf_dir, "customer").select(key.alias("borehole_id"), F.explode(F.array(*[F.lit(n) for n in (1, 2, 3)])).alias("ord"))
    asked = c.withColumns({"reason": F.when(F.col("ord") == 2, F.lit(" ")).otherwise(F.lit("survey")), "payload": F.when(F.col("borehole_id") % 3 == 0, F.lit('{"elevation": 1.5}')).otherwise(F.lit("{}"))})
    return X.revised(T.revisions(spark, sf_dir), asked).select("borehole_id", "version")


@query(_with(T.HOLES, """old AS (SELECT id % 7 AS project_id, id AS source_borehole_id, 'approved' AS status, CAST(1.5 AS DOUBLE) AS elevation, 'kept' AS name FROM holes WHERE id % 2 = 0),
 asked AS (SELECT h.id % 7 AS project_id, h.id AS source_borehole_id, CASE WHEN h.id % 4 = 0 THEN 'review' END AS status, CASE WHEN h.id % 3 = 0 THEN CAST(9.5 AS DOUBLE) END AS elevation, h.elevation AS own_e, h.name AS own_n FROM holes h WHERE NOT is_supplementary AND h.id % 5 < 3)""",
 then="""SELECT COALESCE(a.project_id, o.project_id) AS project_id, COALESCE(a.source_borehole_id, o.source_borehole_id) AS source_borehole_id, CASE WHEN a.project_id IS NULL THEN o.status ELSE COALESCE(a.status, o.status, 'draft') END AS status,
 CASE WHEN a.project_id IS NULL THEN o.elevation ELSE COALESCE(a.elevation, o.elevation, own_e) END AS elevation, CASE WHEN a.project_id IS NULL THEN o.name ELSE COALESCE(o.name, own_n) END AS name FROM old o FULL JOIN asked a ON a.project_id = o.project_id AND a.source_borehole_id = o.source_borehole_id"""))  # fmt: skip
def upserted_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = T.holes(spark, sf_dir)
    key = [(F.col("id") % 7).alias("project_id"), F.col("id").alias("source_borehole_id")]
    old = h.where("id % 2 = 0").select(*key, F.lit("approved").alias("status"), F.lit(1.5).alias("elevation"), F.lit("kept").alias("name"))
    asked = h.where("id % 5 < 3").select(*key, F.when(F.col("id") % 4 == 0, F.lit("review")).alias("status"), F.when(F.col("id") % 3 == 0, F.lit(9.5)).alias("elevation"), F.lit(None).cast("string").alias("name"))
    return X.overridden(old, asked, h, ["elevation", "name"])


@query(_with(T.HOLES, T.LINKS, then="SELECT 'hole' AS what, id, deleted_at IS NOT NULL OR id % 6 = 0 AS gone FROM holes UNION ALL SELECT 'link', id, deleted_at IS NOT NULL OR borehole_id % 6 = 0 AND borehole_id IN (SELECT id FROM holes) FROM links"))
def deleted_with_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = T.holes(spark, sf_dir)
    holes, links = X.deleted_with_links(h, T.links(spark, sf_dir), h.where("id % 6 = 0").select("id"), F.lit(T.STAMP).cast("timestamp_ntz"))
    gone = F.col("deleted_at").isNotNull().alias("gone")
    return holes.select(F.lit("hole").alias("what"), "id", gone).unionByName(links.select(F.lit("link").alias("what"), "id", gone))


@query(_with(T.HOLES, T.LINKS, """p AS (SELECT id, project_id, CASE WHEN borehole_id % 10 = 3 THEN borehole_id - 3 ELSE borehole_id END AS b, (borehole_id % 10 = 3)::INTEGER AS m FROM links), k AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY project_id, b ORDER BY m, id) AS n FROM p) WHERE n = 1)""",
 then="SELECT 'hole' AS what, id, -1 AS at_hole, deleted_at IS NOT NULL OR id % 10 = 3 AS gone FROM holes UNION ALL SELECT 'link', id, b, FALSE FROM k UNION ALL SELECT 'override', id, b, FALSE FROM k"))
def merged_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates merged into the hole they copy: links, overrides and the holes themselves."""
    h, links = T.holes(spark, sf_dir), T.links(spark, sf_dir).drop("deleted_at")
    moved = h.where("id % 10 = 3").select("id", (F.col("id") - 3).alias("keep"))
    overrides = links.withColumnRenamed("borehole_id", "source_borehole_id")
    holes, linked, over = X.merged_duplicates(h, links, overrides, moved, F.lit(T.STAMP).cast("timestamp_ntz"))
    row = lambda df, what, at, gone: df.select(F.lit(what).alias("what"), "id", at.alias("at_hole"), gone.alias("gone"))
    return row(holes, "hole", F.lit(-1).cast("long"), F.col("deleted_at").isNotNull()).unionByName(row(linked, "link", F.col("borehole_id"), F.lit(False))).unionByName(row(over, "override", F.col("source_borehole_id"), F.lit(False)))


@query("""SELECT 'hole' AS what, CASE WHEN c_custkey % 3 = 2 THEN c_custkey + 50000000 ELSE c_custkey END AS id, CAST(c_custkey % 3 AS DOUBLE) AS v FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT 'hole', c_custkey, -1.0 FROM customer WHERE c_custkey % 3 <> 1 UNION ALL
 SELECT 'stratum', CASE WHEN c_custkey % 3 = 2 THEN c_custkey + 50000000 ELSE c_custkey END, 7.5 FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT 'stratum', c_custkey, 3.5 FROM customer WHERE c_custkey % 3 <> 1 UNION ALL
 SELECT 'link', CASE WHEN c_custkey % 3 = 2 THEN c_custkey + 50000000 ELSE c_custkey END, 5.0 FROM customer""")
def applied_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upload of every hole: a third each are only linked, replace an old one, and are new."""
    key = F.col("c_custkey")
    c = T.table(spark, sf_dir, "customer").select(key.alias("id"))
    holes = c.withColumn("elevation", F.lit(-1.0))
    strata = c.select(F.col("id").alias("borehole_id"), F.lit(3.5).alias("depth_bottom"))
    new = (F.col("id") + 50000000).alias("id")
    uploaded = c.select(new, (F.col("id") % 3).cast("double").alias("elevation"), F.lit(5).cast("long").alias("project_id"))
    uploaded_strata = c.select(new, F.lit(7.5).alias("depth_bottom")).withColumnRenamed("id", "borehole_id")
    actions = c.select((F.col("id") + 50000000).alias("key"), pick(("link", "replace", "insert"), F.col("id")).alias("action"), F.when(F.col("id") % 3 < 2, F.col("id")).alias("target"))
    links = spark.createDataFrame([], "project_id long, borehole_id long, project_role string")
    a, b, l = X.applied_upload(holes, strata, links, actions, uploaded, uploaded_strata)
    row = lambda df, what, k, v: df.select(F.lit(what).alias("what"), F.col(k).alias("id"), v.cast("double").alias("v"))
    return row(a, "hole", "id", F.col("elevation")).unionByName(row(b, "stratum", "borehole_id", F.col("depth_bottom"))).unionByName(row(l, "link", "borehole_id", F.col("project_id")))


@query("""WITH n AS (SELECT event_id // 2 AS key, event_id AS ord, 10.0::DOUBLE AS e, CASE WHEN event_id % 3 < 2 THEN value - 20 END AS d, CASE WHEN event_id % 5 < 2 THEN 10 - value END AS h FROM events WHERE event_id % 3 < 2 OR event_id % 5 < 2), b AS (SELECT *, COALESCE(ABS(d), e - h) AS below FROM n),
 l AS (SELECT *, COALESCE(h, e - below) AS above, CASE WHEN d IS NOT NULL AND h IS NOT NULL THEN 'GL+EL' WHEN h IS NOT NULL THEN 'EL' ELSE 'GL' END AS datum FROM b), v AS (SELECT *, CASE WHEN below >= 0 THEN below END AS depth, below < 0 OR ABS(e - below - above) > 0.25 AS odd FROM l),
 s AS (SELECT key, ARG_MIN(datum, ord) AS datum, MAX(ord) AS ord FROM v GROUP BY key), t AS (SELECT s.key, s.datum, v.depth, above AS head, CASE WHEN odd THEN 'needs_review' ELSE 'confirmed' END AS status FROM s JOIN v ON v.ord = s.ord),
 o AS (SELECT event_id // 2 AS key, -1.0::DOUBLE AS depth, 'old' AS datum, CASE WHEN event_id // 2 % 5 = 0 THEN 'confirmed' ELSE 'auto' END AS status, event_id // 2 % 4 = 0 AS gone FROM events WHERE event_id // 2 % 7 <> 0 GROUP BY ALL)
 SELECT COALESCE(o.key, t.key) AS key, CASE WHEN t.key IS NULL THEN o.depth ELSE t.depth END AS depth, t.head, COALESCE(o.datum, t.datum) AS datum, COALESCE(t.status, o.status) AS review_status, t.key IS NULL AND o.gone AS gone FROM o FULL JOIN t ON t.key = o.key""")
def upserted_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two new observations for each key, of which some say nothing, over old ones, confirmed, deleted and not there."""
    k, e = F.col("event_id"), T.table(spark, sf_dir, "events")
    key = F.floor(k / 2).alias("key")
    gone = F.when(F.col("key") % 4 == 0, F.lit(T.STAMP).cast("timestamp_ntz"))
    old = e.select(key).where("key % 7 <> 0").distinct().select("key", F.lit(-1.0).alias("depth"), F.lit(None).cast("double").alias("head"), F.lit("old").alias("datum"), F.when(F.col("key") % 5 == 0, F.lit("confirmed")).otherwise(F.lit("auto")).alias("review_status"), gone.alias("deleted_at"))
    new = e.select(key, k.alias("ord"), F.lit(10.0).alias("elevation"), F.when(k % 3 < 2, F.col("value") - 20).alias("depth"), F.when(k % 5 < 2, F.lit(10.0) - F.col("value")).alias("head"))
    return X.observed(old, new).withColumn("gone", F.col("deleted_at").isNotNull()).drop("deleted_at")


@query(_with(T.HOLES, then="SELECT id AS key, CASE WHEN deleted_at IS NULL AND id % 4 <> 0 THEN 'close' WHEN id % 5 = 0 THEN 'strata' END AS reason FROM holes h WHERE NOT (id % 4 = 0 OR deleted_at IS NOT NULL) OR NOT EXISTS (SELECT 1 FROM holes o WHERE FALSE)"))
def virtual_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A virtual hole for each hole: at its place, or a little off; a fifth with a gap between their strata."""
    h = T.holes(spark, sf_dir)
    key = F.col("id").alias("key")
    off = F.col("id") % 20_000 * 0.001  # far from the holes, whatever their number
    lon = F.when(F.col("id") % 4 == 0, F.lit(100.0) + off).when(F.col("deleted_at").isNotNull(), F.lit(50.0) + off).otherwise(F.col("longitude"))
    v = h.select(key, lon.alias("lon"), F.col("latitude").alias("lat"))
    parts = h.select(key, F.explode(F.array(F.struct(F.lit(0.0).alias("a"), F.lit(1.0).alias("b")), F.struct(F.when(F.col("id") % 5 == 0, 1.5).otherwise(1.0).alias("a"), F.lit(2.0).alias("b")))).alias("s"))
    return X.enabled_virtual(v, parts.select("key", F.col("s.a").alias("depth_top"), F.col("s.b").alias("depth_bottom")), h)


#: Three changes of each key, in the order of `ord`, over snapshots of two thirds of the keys.
_ASKED = """old AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 5 = 0 THEN 'deleted' ELSE 'live' END AS state FROM customer WHERE c_custkey % 3 <> 0), asked AS (SELECT o_custkey AS key, o_orderkey AS ord, (['create', 'update', 'delete', 'copy', 'update', 'update'])[CAST(o_orderkey % 6 AS INTEGER) + 1] AS action, CASE WHEN o_orderkey % 4 < 2 THEN o_orderstatus || CAST(o_orderkey AS VARCHAR) END AS data FROM orders),
 b AS (SELECT a.*, old.state, CASE WHEN old.key IS NULL THEN MIN(CASE WHEN action IN ('create', 'copy') THEN ord END) OVER (PARTITION BY a.key) WHEN old.state = 'live' THEN -1 END AS born FROM asked a LEFT JOIN old ON old.key = a.key),
 g AS (SELECT *, MIN(CASE WHEN action = 'delete' AND ord > born THEN ord END) OVER (PARTITION BY key) AS gone FROM b), j AS (SELECT *, CASE WHEN COALESCE(state = 'deleted' OR ord > gone, FALSE) THEN 'deleted' WHEN action IN ('create', 'copy') AND (born IS NULL OR ord <> born) THEN 'taken' WHEN action NOT IN ('create', 'copy') AND (born IS NULL OR ord < born) THEN 'absent' END AS reason FROM g)"""


def _virtual_changes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    old = T.table(spark, sf_dir, "customer").where(k % 3 != 0).select(k.alias("key"), F.lit(1).cast("long").alias("version"), F.when(k % 5 == 0, F.lit("deleted")).otherwise(F.lit("live")).alias("state"), F.lit("a").alias("data"))
    data = F.when(o % 4 < 2, F.concat("o_orderstatus", o.cast("string")))
    asked = T.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), o.alias("ord"), pick(("create", "update", "delete", "copy", "update", "update"), o).alias("action"), data.alias("data"))
    return X.versioned_virtual(old, asked)


@query(f"""WITH {_ASKED} SELECT key, CAST(1 AS BIGINT) AS version, state, 'a' AS data FROM old UNION ALL SELECT key, CASE WHEN state IS NULL THEN 0 ELSE 1 END + ROW_NUMBER() OVER w, CASE WHEN action = 'delete' THEN 'deleted' ELSE 'live' END,
 COALESCE(LAST_VALUE(data IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), CASE WHEN state IS NOT NULL THEN 'a' END) FROM j WHERE reason IS NULL WINDOW w AS (PARTITION BY key ORDER BY ord)""")
def versioned_virtual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots after all orders, read as changes of their customer, many to a key."""
    return _virtual_changes(spark, sf_dir)[0]


@query(f"WITH {_ASKED} SELECT key, ord, action, reason FROM j WHERE reason IS NOT NULL")
def refused_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes that a key's state refused."""
    return _virtual_changes(spark, sf_dir)[1]


# --- surfaces, sections, documents


@query("SELECT l_returnflag AS layer, l_linenumber AS j, CAST(l_quantity % 5 AS INTEGER) AS i, ROUND(AVG(l_extendedprice), 4) AS z, COUNT(*) AS n FROM lineitem GROUP BY ALL")
def averaged_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("layer"), F.col("l_linenumber").alias("j"), (F.col("l_quantity") % 5).cast("int").alias("i"), F.col("l_extendedprice").alias("z"))
    return U.targets(rows).withColumn("z", F.round("z", 4))


@query(_with(T.STRATA, then="SELECT borehole_id AS key, MAX(l_suppkey) AS radius, MIN(-depth_bottom) AS z_low, MAX(-depth_top) AS z_high FROM strata GROUP BY borehole_id"))
def section_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.strata(spark, sf_dir).withColumnRenamed("borehole_id", "key")
    near = s.groupBy("key").agg(F.max("l_suppkey").alias("radius"))
    return N.section_outline(near, s.select("key", (-F.col("depth_top")).alias("z_top"), (-F.col("depth_bottom")).alias("z_bot")))


@query(_with(T.POINTS, then="SELECT key, ROUND(POWER(1 - r, 4) * (4 * r + 1), 9) AS weight FROM (SELECT key, LEAST(x / 800.0, 1.0) AS r FROM points)"))
def kernel_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.points(spark, sf_dir).select("key", F.round(N.kernel(F.col("x"), 800.0), 9).alias("weight"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_partkey % 3 = 0 THEN l_quantity WHEN l_partkey % 3 = 1 THEN -0.75 * l_suppkey END AS control, GREATEST(LEAST(l_quantity, 40.0), 2.5) AS clamped FROM lineitem")
def thickness_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_partkey") % 3
    control = U.thickness_controls(k == 0, F.col("l_quantity"), k == 1, F.col("l_suppkey").cast("double"))
    return T.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", control.alias("control"), U.clamped_thickness(F.col("l_quantity"), F.lit(2.5), F.lit(20.0)).alias("clamped"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_partkey % 4 = 0 THEN 'present' WHEN l_quantity >= 20.25 THEN 'absent' ELSE 'not_reached' END AS state FROM lineitem")
def absence_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = U.absence(F.col("l_quantity"), F.lit(20.0), F.col("l_partkey") % 4 == 0)
    return T.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", state.alias("state"))


_TREND = """a AS (SELECT project, x, y, z FROM points), t AS (SELECT project, x, y, MIN(z) AS z, MAX(z) - MIN(z) > 0.000001 AS apart, (x + y) / 8 AS trend FROM a GROUP BY project, x, y),
 n AS (SELECT CAST(n_nationkey AS BIGINT) AS project, CAST(j AS INTEGER) AS j, CAST(i AS INTEGER) AS i, i * 256.0 AS x, j * 256.0 AS y FROM nation, range(5) p(j), range(5) q(i))"""


@query(_with(T.POINTS, _TREND, then="""SELECT n.project, j, i, ROUND(COALESCE(MIN(t.z) FILTER (WHERE t.x = n.x AND t.y = n.y), ANY_VALUE(n.x + n.y) / 8 + SUM((t.z - t.trend) / NULLIF(POWER(n.x - t.x, 2) + POWER(n.y - t.y, 2), 0)) / SUM(1 / NULLIF(POWER(n.x - t.x, 2) + POWER(n.y - t.y, 2), 0))), 6) AS z
 FROM n JOIN t ON t.project = n.project AND NOT t.apart GROUP BY n.project, j, i"""))
def groundwater_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A level at every node: what the anchors leave over a trend, by distance, and at an anchor its own level."""
    trend = ((F.col("x") + F.col("y")) / 8).alias("trend")
    surface, _ = U.exact_surface(_nodes(spark, sf_dir, 5).select("*", trend), _all_anchors(spark, sf_dir).select("*", trend))
    return surface.select("project", "j", "i", F.round("z", 6).alias("z"))


@query(_with(T.POINTS, then="SELECT project, FLOOR(x / 128) AS x, FLOOR(y / 128) AS y, MIN(z) AS z, MAX(z) AS other FROM points GROUP BY project, FLOOR(x / 128), FLOOR(y / 128) HAVING MAX(z) - MIN(z) > 0.000001"))
def conflicting_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors in cells of 128 m taken as being at one place: those that disagree."""
    cell = lambda c: F.floor(F.col(c) / 128).cast("double")
    _, apart = U.settled_anchors(_all_anchors(spark, sf_dir).withColumns({"x": cell("x"), "y": cell("y")}))
    return apart.select("project", "x", "y", "z", "other")


@query(_with(T.POINTS, then="SELECT project, COUNT(*) AS observations, TRUE AS passed FROM (SELECT project, x, y FROM points WHERE x <= 1024 AND y <= 1024 AND x % 64 = 0 AND y % 64 = 0 GROUP BY project, x, y HAVING MAX(z) - MIN(z) <= 0.000001) GROUP BY project"))
def diagnosed_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors at nodes of a grid of 17 x 17: the surface meets each."""
    zero = F.lit(0.0).alias("trend")
    anchors = _all_anchors(spark, sf_dir)
    surface, _ = U.exact_surface(_nodes(spark, sf_dir, 17).select("*", zero), anchors.select("*", zero))
    return U.diagnosed(surface, U.settled_anchors(anchors)[0]).select("project", "observations", "passed")


@query(_with(T.POINTS, """g AS (SELECT project, x, y, MIN(z) AS z FROM points GROUP BY project, x, y HAVING MAX(z) - MIN(z) <= 0.000001), q AS (SELECT DISTINCT a.project FROM g a JOIN g b ON b.project = a.project AND (a.x, a.y) < (b.x, b.y) AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 576)""",
 then="""SELECT p AS project, j, i, ROUND(COALESCE(MIN(z) FILTER (WHERE d = 0), SUM(z / NULLIF(SQRT(d), 0)) / SUM(1 / NULLIF(SQRT(d), 0))), 6) AS z, 'close' AS reason FROM (SELECT n.p, n.j, n.i, g.z, (n.x - g.x) * (n.x - g.x) + (n.y - g.y) * (n.y - g.y) AS d FROM
 (SELECT CAST(n_nationkey AS BIGINT) AS p, CAST(j AS INTEGER) AS j, CAST(i AS INTEGER) AS i, i * 64.0::DOUBLE AS x, j * 64.0::DOUBLE AS y FROM nation, range(17) t(j), range(17) s(i)) n JOIN g ON g.project = n.p JOIN q ON q.project = n.p) GROUP BY p, j, i"""))  # fmt: skip
def plates_given_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of projects with two anchors closer than 24: means by distance."""
    surface, _ = U.guarded_plate(_nodes(spark, sf_dir, 17), _all_anchors(spark, sf_dir), near=24.0)
    return surface.where("reason = 'close'").select("project", "j", "i", F.round("z", 6).alias("z"), "reason")


@query(_with(T.POINTS, then="SELECT project, COUNT(*) AS anchors, 256 AS nodes, TRUE AS within FROM (SELECT project, x, y FROM points GROUP BY project, x, y HAVING MAX(z) - MIN(z) <= 0.000001) GROUP BY project"))
def guarded_plates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plates of every project: all nodes are there, none beyond four spans of the anchors' levels."""
    anchors = _all_anchors(spark, sf_dir)
    surface, _ = U.guarded_plate(_nodes(spark, sf_dir, 16), anchors)
    spans = U.settled_anchors(anchors)[0].groupBy("project").agg(F.count(F.lit(1)).alias("anchors"), F.min("z").alias("lo"), F.max("z").alias("hi"))
    span = F.greatest(F.col("hi") - F.col("lo"), F.lit(1.0))
    inside = F.col("z").between(F.col("lo") - span * 4, F.col("hi") + span * 4)
    return surface.join(spans, "project").groupBy("project").agg(F.first("anchors").alias("anchors"), F.count(F.lit(1)).alias("nodes"), F.bool_and(inside).alias("within"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'inland' WHEN o_orderkey % 3 = 1 THEN 'sea' END AS kind, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice WHEN o_orderkey % 3 = 1 THEN 0.5 END AS level FROM orders""")
def water_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    cell = U.water_class(F.when(k % 3 == 0, F.col("o_totalprice")), F.when(k % 6 == 2, F.lit(None).cast("boolean")).otherwise(k % 3 == 2), 0.5)
    return T.table(spark, sf_dir, "orders").select("o_orderkey", cell["kind"].alias("kind"), cell["level"].alias("level"))


@query(_with("s AS (SELECT o_orderkey AS k, o_totalprice AS z, o_orderkey % 7 = 0 AS a, CASE WHEN o_orderkey % 4 = 0 THEN 10.0 END AS w FROM orders WHERE o_orderkey % 5 <> 0)", then="""SELECT k AS j, CASE WHEN a THEN z WHEN w IS NOT NULL THEN w WHEN z > 99999.95 THEN 99999.95 ELSE z END AS z,
 CASE WHEN a THEN 'anchor' WHEN w IS NOT NULL THEN 'water' WHEN z > 99999.95 THEN 'terrain' ELSE 'none' END AS cap FROM s"""))
def capped_groundwater(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display levels of cells with water, with terrain and with anchors; a fifth are surfaces of too few anchors."""
    k = F.col("o_orderkey")
    o = T.table(spark, sf_dir, "orders").select(F.lit(0).alias("project"), k.alias("j"), F.lit(0).alias("i"), F.col("o_totalprice").alias("z"), F.when(k % 5 == 0, 2).otherwise(3).alias("anchors"), (k % 7 == 0).alias("is_anchor"))
    ground = o.select("project", "j", "i", F.lit(100000.0).alias("terrain"), F.when(F.col("j") % 4 == 0, F.lit(10.0)).alias("water"))
    return U.capped_groundwater(o, ground).select("j", "z", "cap")


@query(_with(T.POINTS, then="SELECT project, CAST(j AS INTEGER) AS j, CAST(i AS INTEGER) AS i, ROUND(AVG((c * 7 + r * 3 + project) % 5), 6) AS z FROM (SELECT CAST(n_nationkey AS BIGINT) AS project, j, i FROM nation, range(8) p(j), range(8) q(i)) g, range(8) a(r), range(8) b(c) WHERE ABS(r - j) <= 1 AND ABS(c - i) <= 1 GROUP BY project, j, i"))
def means_of_nine(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _nodes(spark, sf_dir, 8).withColumn("z", ((F.col("i") * 7 + F.col("j") * 3 + F.col("project")) % 5).cast("double"))
    return N.mean_of_nine(g.select("project", "j", "i", "z")).select("project", "j", "i", F.round("z", 6).alias("z"))


_SURFACE = """g AS (SELECT 127.0 + i * 0.25 AS x, 36.0 + j * 0.25 AS y, CAST(j AS INTEGER) AS j, CAST(i AS INTEGER) AS i, COALESCE(z, 0.0) AS z FROM range(9) p(j), range(9) q(i) LEFT JOIN (SELECT LEAST(CAST(floor(y / 128) AS BIGINT), 8) AS b, LEAST(CAST(floor(x / 128) AS BIGINT), 8) AS a, MAX(z) AS z FROM points GROUP BY ALL) ON b = j AND a = i)"""


def _surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One surface on 9 x 9 nodes: the highest of all points around each."""
    step = F.sequence(F.lit(0), F.lit(8))
    cell = lambda c: F.least(F.floor(F.col(c) / 128), F.lit(8)).cast("int")
    high = T.points(spark, sf_dir).groupBy(cell("y").alias("j"), cell("x").alias("i")).agg(F.max("z").alias("z"))
    nodes = spark.range(1).select(F.lit("soil").alias("layer"), F.explode(step).alias("j")).select("layer", "j", F.explode(step).alias("i"))
    return nodes.join(high, ["j", "i"], "left").select("layer", "j", "i", (F.lit(127.0) + F.col("i") * 0.25).alias("x"), (F.lit(36.0) + F.col("j") * 0.25).alias("y"), F.coalesce("z", F.lit(0.0)).alias("z"))


@query(_with(T.POINTS, _SURFACE, grid_sql("g", "y", "x", "EPSG:5186"),
 then="""SELECT 1 AS "group", 2 AS part, CAST(j * 9 + i + 1 AS DOUBLE) AS number, printf('          <P id="%d">%.3f %.3f %.4f</P>', CAST(j * 9 + i + 1 AS BIGINT), n, e, CAST(z AS DOUBLE)) AS line FROM placed UNION ALL
 SELECT 1, 4, (j * 9 + i + 1) * 2.0 + h, '          <F>' || CASE h WHEN 0 THEN concat_ws(' ', j * 9 + i + 1, j * 9 + i + 2, j * 9 + i + 11) ELSE concat_ws(' ', j * 9 + i + 1, j * 9 + i + 11, j * 9 + i + 10) END || '</F>' FROM g, range(2) t(h) WHERE i < 8 AND j < 8"""))  # fmt: skip
def surface_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points and faces of a whole document of one surface, as lines; its frame is held by a test."""
    return E.surface_document(_surface(spark, sf_dir), 9, ["soil"], "2026-01-01", "00:00:00").where("part IN (2, 4)").select("group", "part", "number", "line")


@query(_with(T.POINTS, _SURFACE, "q AS (SELECT MIN(key) AS id, ARG_MIN(z, key) AS z, 127 + x / 1000 AS lon, 36 + y / 1000 AS lat FROM points GROUP BY x, y)", grid_sql("q", "lat", "lon", "EPSG:5186", "seen"), grid_sql("g", "y", "x", "EPSG:5186"),
 then="""SELECT 2 AS part, CAST(k AS DOUBLE) AS number, printf('    <CgPoint name="SOIL_OBS_%06d" code="SOIL_OBSERVED" desc="시추공 %d">%.3f %.3f %.4f</CgPoint>', k, id, n, e, z) AS line FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY id) AS k FROM seen) UNION ALL
 SELECT 3, j * 9.0 + i, printf('    <CgPoint name="SOIL_INT_R%03d_C%03d" code="SOIL_INTERPOLATED">%.3f %.3f %.4f</CgPoint>', j + 1, i + 1, n, e, CAST(z AS DOUBLE)) FROM placed UNION ALL SELECT 1, 0.0, '  <CgPoints name="SOIL" desc="토사; grid=9x9">' UNION ALL SELECT 4, 0.0, '  </CgPoints>'"""))  # fmt: skip
def point_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All observed points and nodes of a document of points, as lines, between the lines of their layer."""
    seen = T.points(spark, sf_dir).select(F.lit("soil").alias("layer"), F.col("key").alias("id"), (F.lit(127.0) + F.col("x") / 1000).alias("x"), (F.lit(36.0) + F.col("y") / 1000).alias("y"), "z")
    return E.point_document(_surface(spark, sf_dir), seen, 9, ["soil"], "2026-01-01", "00:00:00").where("group = 1").select("part", "number", "line")


@query(_with(T.HOLES, T.STRATA, grid_sql("holes", "latitude", "longitude", "EPSG:5186"), then=f"""SELECT id AS part, depth_top AS number, concat_ws(chr(10), '0', 'LINE', '8', upper({_LAYERED}), '10', printf('%.4f', e), '20', printf('%.4f', n), '30', printf('%.4f', elevation - depth_bottom), '11', printf('%.4f', e), '21', printf('%.4f', n), '31', printf('%.4f', elevation - depth_top)) AS line
 FROM placed JOIN strata ON borehole_id = id WHERE depth_bottom > depth_top AND depth_bottom <= 300"""))
def drawing_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upright lines of all strata of all holes, as a whole drawing has them."""
    out = E.drawing_document(T.holes(spark, sf_dir), _grouped_strata(spark, sf_dir))
    return out.where(F.col("line").startswith("0\nLINE")).select("part", "number", "line")


@query(_with(T.POINTS, "q AS (SELECT project, x, y, MIN(key) AS id, ARG_MIN(z, key) AS z, 127 + x / 1000 AS lon, 36 + y / 1000 AS lat FROM points GROUP BY project, x, y)", grid_sql("q", "lat", "lon", "EPSG:5186"), then="SELECT id, printf('%.3f %.3f %.4f', n, e, z) AS line FROM placed"))
def observed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed points as text, of those at one place the least id."""
    p = T.points(spark, sf_dir).select(F.col("project").cast("string").alias("layer"), F.col("key").alias("id"), (F.lit(127.0) + F.col("x") / 1000).alias("x"), (F.lit(36.0) + F.col("y") / 1000).alias("y"), "z")
    return E.observed_points(p).select("id", "line")


@query(_with(T.HOLES, then="SELECT id, longitude, latitude FROM holes"))
def restored_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot written as text and read back: every place as it was."""
    from terrakern.operators.materialise import folder

    path = folder(spark, "snapshot")
    E.snapshot(T.holes(spark, sf_dir).select("id", "longitude", "latitude"), path)
    return E.restored(spark.read.schema("id long, location string").json(path))


@query("SELECT n_name AS project, c_name AS name, CAST(c_custkey % 50 AS DOUBLE) AS elevation, 'soft_rock' AS strata_group FROM customer JOIN nation ON n_nationkey = c_nationkey")
def nested_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects with holes with strata, written as JSON and read back."""
    from terrakern.operators.materialise import folder

    h = T.holes(spark, sf_dir).join(T.projects(spark, sf_dir), "project_id")
    stratum = F.array(F.struct(F.lit(0.0).alias("depth_top"), F.lit(1.0).alias("depth_bottom"), F.lit("연암").alias("soil_type"), F.lit("x").alias("raw_text")))
    hole = F.struct("name", "longitude", "latitude", (F.col("id") % 50).cast("double").alias("elevation"), stratum.alias("strata"))
    path = folder(spark, "nested")
    h.groupBy(F.col("project").alias("name")).agg(F.collect_list(hole).alias("boreholes")).select(F.array(F.struct("name", "boreholes")).alias("projects")).write.option("maxRecordsPerFile", 1).json(path)
    holes, strata = SRC.read_nested(spark, path)
    return holes.join(strata.select("project", "name", "strata_group"), ["project", "name"]).select("project", "name", "elevation", "strata_group")


# --- presence, detail, terrain, sources


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("key")
    return T.points(spark, sf_dir).select("key", "x", "y", F.when(k % 3 == 0, 2.0).otherwise(0.0).alias("thickness"), (k % 7 == 1).alias("absent"))


_FIELD = """p AS (SELECT key, x, y, key % 3 = 0 AS has, key % 7 = 1 AND key % 3 <> 0 AS lack, key % 7 = 1 AS absent FROM points), n AS (SELECT j * 100 + i AS key, i * 100.0 AS x, j * 100.0 AS y FROM range(11) a(j), range(11) b(i)),
 d AS (SELECT n.key, p.key AS other, SQRT(POWER(n.x - p.x, 2) + POWER(n.y - p.y, 2)) AS d, has, absent FROM n, p),
 z AS (SELECT a.key, a.x, a.y, MIN(SQRT(POWER(a.x - b.x, 2) + POWER(a.y - b.y, 2))) AS near FROM p a JOIN p b ON a.absent AND b.has GROUP BY a.key, a.x, a.y),
 c AS (SELECT *, LEAST(100.0, GREATEST(20.0, LEAST(near * 0.3, 20.0, 100.0))) AS core FROM z), w AS (SELECT *, LEAST(150.0, GREATEST(core + 10.0, LEAST(near * 0.5, 30.0, 150.0))) AS tr FROM c),
 q AS (SELECT n.key, ARG_MIN({'d': SQRT(POWER(n.x - w.x, 2) + POWER(n.y - w.y, 2)), 'core': core, 'tr': tr}, ROW(SQRT(POWER(n.x - w.x, 2) + POWER(n.y - w.y, 2)), w.key)) AS z FROM n JOIN w ON SQRT(POWER(n.x - w.x, 2) + POWER(n.y - w.y, 2)) <= 150 GROUP BY n.key),
 m AS (SELECT key, COUNT(*) FILTER (WHERE d <= 80) AS around FROM d GROUP BY key), r AS (SELECT d.*, around, ROW_NUMBER() OVER (PARTITION BY d.key ORDER BY d, other) AS place FROM d JOIN m ON m.key = d.key),
 s AS (SELECT key, SUM(CASE WHEN has THEN 1 / GREATEST(d * d, 1) ELSE 0 END) / SUM(1 / GREATEST(d * d, 1)) AS share FROM r WHERE (has OR absent) AND CASE WHEN around >= 3 THEN d <= 80 ELSE place <= 4 END GROUP BY key),
 o AS (SELECT key, BOOL_OR(has AND d <= 2.0) AS own FROM d GROUP BY key)"""


@query(_with(T.POINTS, _FIELD, then="""SELECT n.key, ROUND(CASE WHEN own THEN 1.0 WHEN z.d <= z.core THEN -1.0 WHEN z.d <= z.tr THEN LEAST(GREATEST((z.d - z.core) / GREATEST(z.tr - z.core, 1.0), 0.0), 1.0) * 2 - 1 ELSE GREATEST(COALESCE(share, 1.0) * 2 - 1, 0.1) END, 6) AS signed
 FROM n LEFT JOIN q ON q.key = n.key LEFT JOIN s ON s.key = n.key LEFT JOIN o ON o.key = n.key"""))
def presence_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signed field of a layer over 11 x 11 nodes, from the profiles of all points."""
    steps = F.sequence(F.lit(0), F.lit(10))
    nodes = T.projects(spark, sf_dir).where("project_id = 0").select(F.explode(steps).alias("j")).select("j", F.explode(steps).alias("i"))
    nodes = nodes.select((F.col("j") * 100 + F.col("i")).cast("long").alias("key"), (F.col("i") * 100.0).alias("x"), (F.col("j") * 100.0).alias("y"))
    return Z.presence_field(nodes, _profiles(spark, sf_dir), 40.0, 10.0).select("key", F.round("signed", 6).alias("signed"))


_HOLLOW = "g AS (SELECT CAST(n_nationkey AS BIGINT) AS project, CAST(j AS INTEGER) AS j, CAST(i AS INTEGER) AS i, CASE WHEN (i * 7 + j * 5 + i * j + n_nationkey) % 3 = 0 THEN -1.0 ELSE 1.0 END AS v, (i + j + n_nationkey) % 11 = 0 AS sure FROM nation, range(9) a(j), range(9) b(i))"


@query("WITH RECURSIVE " + _HOLLOW + """, low AS (SELECT * FROM g WHERE v <= 0), r AS (SELECT project, j, i, j AS sj, i AS si FROM low UNION SELECT l.project, l.j, l.i, r.sj, r.si FROM r JOIN low l ON l.project = r.project AND ABS(l.j - r.j) + ABS(l.i - r.i) = 1),
 f AS (SELECT r.project, sj AS j, si AS i, BOOL_OR(r.j IN (0, 8) OR r.i IN (0, 8)) AS open, BOOL_OR(sure) AS s FROM r JOIN low l ON l.project = r.project AND l.j = r.j AND l.i = r.i GROUP BY r.project, sj, si)
 SELECT g.project, g.j, g.i, CASE WHEN NOT open AND NOT s THEN 0.01 ELSE v END AS signed, CASE WHEN open IS NULL OR open THEN 'kept' WHEN s THEN 'sure' ELSE 'filled' END AS kind FROM g LEFT JOIN f ON f.project = g.project AND f.j = g.j AND f.i = g.i""")
def filled_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hollows in a grid of every project: those at the edge and with a sure absence stay."""
    k = F.col("i") * 7 + F.col("j") * 5 + F.col("i") * F.col("j") + F.col("project")
    g = _nodes(spark, sf_dir, 9).select("project", "j", "i", F.when(k % 3 == 0, -1.0).otherwise(1.0).alias("signed"), ((F.col("i") + F.col("j") + F.col("project")) % 11 == 0).alias("sure"))
    return Z.filled_holes(g, 9).select("project", "j", "i", "signed", "kind")


_PARTS = """n AS (SELECT c_custkey AS k, 10.0::DOUBLE AS top, CAST(c_custkey % 12 AS DOUBLE) AS base FROM customer), t AS (SELECT k, o, CAST((k + o * 5) % 4 AS DOUBLE) AS th, 9.0 - o * 2 - k % 3 AS c FROM n, range(1, 4) r(o)), a AS (SELECT k, SUM(th) AS total FROM t GROUP BY k)"""
_THICK = "CASE WHEN a.total > 0.05 THEN x.th / a.total * GREATEST(n.top - n.base, 0) ELSE x.th END"


@query("WITH RECURSIVE " + _PARTS + f""", f AS (SELECT k, 0 AS o, top AS at_z, CAST(NULL AS DOUBLE) AS upper FROM n UNION ALL SELECT f.k, CAST(x.o AS INTEGER), CASE WHEN f.at_z - n.base > 0.05 AND {_THICK} >= 0.05 THEN GREATEST(n.base, LEAST(f.at_z - 0.05, GREATEST(x.c, f.at_z - {_THICK}))) ELSE f.at_z END,
 CASE WHEN f.at_z - n.base > 0.05 AND {_THICK} >= 0.05 THEN f.at_z END FROM f JOIN n ON n.k = f.k JOIN a ON a.k = f.k JOIN t x ON x.k = f.k AND x.o = f.o + 1)
 SELECT k AS j, 'part' || o AS key, ROUND(upper, 6) AS top, ROUND(at_z, 6) AS bottom FROM f WHERE upper IS NOT NULL UNION ALL SELECT f.k, 'unclassified', ROUND(at_z, 6), base FROM f JOIN n ON n.k = f.k WHERE o = 3 AND at_z - base >= 0.05""")
def detail_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers of detail in a column for each customer: three parts between 10 and a base that is sometimes above it."""
    k = F.col("c_custkey")
    part = lambda o: F.struct(F.lit(o).alias("ord"), F.lit(f"part{o}").alias("key"), ((k + o * 5) % 4).cast("double").alias("thickness"), (F.lit(9.0) - o * 2 - k % 3).alias("contact"))
    nodes = T.table(spark, sf_dir, "customer").select(F.lit(0).alias("project"), k.alias("j"), F.lit(0).alias("i"), F.lit(10.0).alias("top"), (k % 12).cast("double").alias("base"), F.array(*[part(o) for o in (1, 2, 3)]).alias("parts"))
    return Z.detail_layers(nodes).select("j", "key", F.round("top", 6).alias("top"), F.round("bottom", 6).alias("bottom"))


@query(_with(T.POINTS, T.STRATA, then="SELECT s.borehole_id, l_linenumber, l_partkey, l_suppkey, 2 * x + 3 * y - depth_top AS z_top, 2 * x + 3 * y - depth_bottom AS z_bot FROM strata s JOIN points p ON p.key = s.borehole_id WHERE x <= 1024 AND y <= 1024"))
def strata_below_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strata below a modelled plane at their hole."""
    from terrakern.plans.registry import sampled_plane

    return N.below_surface(T.strata(spark, sf_dir), sampled_plane(spark, sf_dir)).select("borehole_id", "l_linenumber", "l_partkey", "l_suppkey", "z_top", "z_bot")


@query(_with(T.POINTS, then="SELECT key, ROUND(2 * x + 3 * y, 6) AS z FROM points WHERE x <= 1024 AND y <= 1024"))
def sampled_uneven_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plane over axes whose steps double: between nodes it is the plane."""
    steps = [0.0, 1.0, 3.0, 7.0, 15.0, 31.0, 63.0, 127.0, 255.0, 511.0, 1024.0]
    xs = F.array(*[F.lit(s) for s in steps])
    axes = T.projects(spark, sf_dir).select(F.col("project_id").alias("project"), xs.alias("xs"), xs.alias("ys"))
    g = axes.select("project", F.posexplode("ys").alias("j", "y"), "xs").select("project", "j", "y", F.posexplode("xs").alias("i", "x"))
    grid = g.select("project", "j", "i", (F.col("x") * 2 + F.col("y") * 3).alias("z"))
    return N.sampled_uneven(T.points(spark, sf_dir).select("project", "key", "x", "y"), grid, axes).select("key", F.round("z", 6).alias("z"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS project, CAST(j AS INTEGER) AS j, CAST(i AS INTEGER) AS i, ROUND(i * 128.0 * 2 + j * 128.0 * 3 + 10, 4) AS z FROM nation, range(9) a(j), range(9) b(i)")
def corrected_terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plane that lies 10 m too low at every hole, moved up to them; one hole in fifty is off by 100 m and isn't heard."""
    z = F.col("x") * 2 + F.col("y") * 3
    g = _nodes(spark, sf_dir, 9).withColumn("z", z)
    holes = T.points(spark, sf_dir).select("project", "key", "x", "y", (z + 10 + F.when(F.col("key") % 50 == 7, 100.0).otherwise(0.0)).alias("z")).where("x <= 1024 AND y <= 1024")
    boxes = T.projects(spark, sf_dir).select(F.col("project_id").alias("project"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(128.0).alias("dx"), F.lit(128.0).alias("dy"), F.lit(9).alias("columns"), F.lit(9).alias("rows"))
    return N.corrected(g, holes, boxes).select("project", "j", "i", F.round("z", 4).alias("z"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS project, CAST(s AS INTEGER) AS size, CAST(j AS INTEGER) AS j, CAST(i AS INTEGER) AS i, ROUND(i * 1024.0 / (s - 1) + j * 2048.0 / (s - 1), 6) AS z FROM nation, (VALUES (3), (9)) v(s), range(9) a(j), range(9) b(i) WHERE i < s AND j < s")
def two_resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = T.projects(spark, sf_dir).select(F.col("project_id").alias("project"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(1024.0).alias("x1"), F.lit(1024.0).alias("y1"))
    out = N.at_resolutions(box, [3, 9], lambda g: g.withColumn("z", F.col("x") + F.col("y") * 2))
    return out.select("project", "size", "j", "i", F.round("z", 6).alias("z"))


@query(_with(T.POINTS, then="SELECT project, x, y, ROUND(AVG(z), 3) AS z FROM points GROUP BY project, x, y"))
def thin_plate_at_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plates of every project at the places of their anchors: the anchors' own levels."""
    from pyspark.sql import Window

    a = _all_anchors(spark, sf_dir)
    places = a.select("project", "x", "y").distinct()
    nodes = places.withColumns({"j": F.row_number().over(Window.partitionBy("project").orderBy("x", "y")), "i": F.lit(0)})
    return U.thin_plate(nodes, a).select("project", "x", "y", F.round("z", 3).alias("z"))


@query(
    "WITH RECURSIVE " + T.POINTS + """, o AS (SELECT project, key, x, y, z, key % 5 AS s, ROW_NUMBER() OVER (PARTITION BY project ORDER BY key) AS n FROM points), g AS (SELECT project, n, [{'k': key, 'x': x, 'y': y}] AS seeds FROM o WHERE n = 1 UNION ALL
 SELECT o.project, o.n, CASE WHEN len(list_filter(g.seeds, lambda v: POWER(v.x - o.x, 2) + POWER(v.y - o.y, 2) <= 400)) > 0 THEN g.seeds ELSE list_append(g.seeds, {'k': o.key, 'x': o.x, 'y': o.y}) END FROM g JOIN o ON o.project = g.project AND o.n = g.n + 1),
 l AS (SELECT project, ARG_MAX(seeds, n) AS seeds FROM g GROUP BY project), m AS (SELECT o.*, list_filter(seeds, lambda v: POWER(v.x - o.x, 2) + POWER(v.y - o.y, 2) <= 400)[1].k AS seed FROM o JOIN l ON l.project = o.project)
 SELECT project, ARG_MIN(key, ROW(-s, key)) AS id, ROUND(AVG(x), 6) AS x, ROUND(AVG(y), 6) AS y, COUNT(*) AS merged FROM m GROUP BY project, seed"""
)
def merged_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near holes of every project merged greedily, as merged_near_holes does, with its SQL."""
    from terrakern.plans.registry import merged_near_holes

    return merged_near_holes(spark, sf_dir).select("project", "id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "merged")


@query("""SELECT r_regionkey AS feature, ROUND(GREATEST(LEAST(r_regionkey * 3.0 + 4, 8.0) - GREATEST(r_regionkey * 3.0, 1.0), 0) * GREATEST(LEAST(r_regionkey * 1.0 + 5, 6.0) - GREATEST(r_regionkey * 1.0, 2.0), 0), 6) AS area, 'ok' AS status FROM region
 WHERE LEAST(r_regionkey * 3.0 + 4, 8.0) > GREATEST(r_regionkey * 3.0, 1.0) AND LEAST(r_regionkey * 1.0 + 5, 6.0) > GREATEST(r_regionkey * 1.0, 2.0)""")
def clipped_coast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A square for each region as map features, written, read and cut by a box."""
    from terrakern.operators.materialise import folder

    k = F.col("r_regionkey")
    x, y = k * 3.0, k * 1.0
    point = lambda a, b: F.concat(F.lit("["), (x + a).cast("string"), F.lit(","), (y + b).cast("string"), F.lit("]"))
    ring = F.concat(F.lit("[["), F.concat_ws(",", point(0, 0), point(4, 0), point(4, 5), point(0, 5)), F.lit("]]"))
    text = F.concat(F.lit('{"type":"Feature","geometry":{"type":"Polygon","coordinates":'), ring, F.lit("}}"))
    rows = T.table(spark, sf_dir, "region").agg(F.transform(F.sort_array(F.collect_list(F.struct(k.alias("k"), text.alias("t")))), lambda s: s["t"]).alias("t"))
    path = folder(spark, "coast")
    rows.select(F.concat(F.lit('{"features":['), F.array_join("t", ","), F.lit("]}")).alias("value")).write.text(path)
    status = SRC.polygon_status(True, spark.read.text(path, wholetext=True).where("value <> ''"))
    cut_ = SRC.clipped_rings(SRC.read_rings(spark, path), (1.0, 2.0, 8.0, 6.0))
    return cut_.select("feature", F.round("area", 6).alias("area"), F.lit(status).alias("status"))


@query(_with(T.HOLES, then="SELECT id FROM holes WHERE (longitude > 126.5 AND longitude < 127 AND latitude > 34.5 AND latitude < 35.5) OR (longitude > 128 AND longitude < 128.5 AND latitude > 36 AND latitude < 37)"))
def holes_on_land(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holes in either of two polygons."""
    box = lambda a, b, c, d: [((a, b), (c, b), (c, d), (a, d))]
    land = P.any_polygon(F.col("longitude"), F.col("latitude"), [box(126.5, 34.5, 127.0, 35.5), box(128.0, 36.0, 128.5, 37.0)])
    return T.holes(spark, sf_dir).where(land).select("id")


@query("SELECT o_orderpriority AS job, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS issues, MIN('order ' || o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS first_issue FROM orders GROUP BY o_orderpriority")
def run_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch's report, written and read back."""
    from terrakern.operators.materialise import folder

    o, path = T.table(spark, sf_dir, "orders"), folder(spark, "report")
    issues = o.where("o_orderstatus = 'F'").select(F.col("o_orderpriority").alias("job"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("issue"))
    V.run_report(o.select(F.col("o_orderpriority").alias("job")).distinct(), issues, path)
    return spark.read.schema("job string, issues long, first_issue string").json(path)


@query(_with(T.HOLES, then=f"SELECT {_PATH} AS path, name AS hole, longitude AS lon, CASE WHEN id % 3 = 0 THEN 0.0 ELSE elevation END AS elevation FROM holes"))
def headered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed rows of tables with a header; a blank elevation is 0."""
    h = T.holes(spark, sf_dir).withColumn("path", F.expr("'p' || CAST(project_id AS STRING) || CASE WHEN project_id % 4 = 3 THEN '.xlsx' ELSE '.csv' END"))
    level = F.when(F.col("id") % 3 == 0, F.lit(" ")).otherwise(F.col("elevation").cast("string"))
    rows = h.select("path", (F.col("id") + 1).alias("row_no"), F.array(F.col("name"), F.col("longitude").cast("string"), level).alias("cells"))
    heads = h.select("path").distinct().select("path", F.lit(0).cast("long").alias("row_no"), F.array(F.lit(" Hole"), F.lit("LON"), F.lit("elevation")).alias("cells"))
    return SRC.headered(rows.unionByName(heads), {"hole": "string", "lon": "double", "elevation": "double"}).drop("row_no")


@query(_with(T.HOLES, T.LINKS, """k AS (SELECT project_id, borehole_id, MIN(project_role) AS role FROM links GROUP BY project_id, borehole_id), w AS (SELECT DISTINCT project_id, id AS borehole_id FROM holes WHERE id % 2 = 0 AND project_id < 15)""",
 then="""SELECT COALESCE(k.project_id, w.project_id) AS project_id, COALESCE(k.borehole_id, w.borehole_id) AS borehole_id, CASE WHEN w.borehole_id IS NOT NULL AND (role IS NULL OR role = 'excluded') THEN 'existing' ELSE role END AS project_role
 FROM k FULL JOIN w ON w.project_id = k.project_id AND w.borehole_id = k.borehole_id"""))  # fmt: skip
def synchronised_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of projects that name further holes; links that they don't name stay."""
    links = T.links(spark, sf_dir).groupBy("project_id", "borehole_id").agg(F.min("project_role").alias("project_role"))
    wanted = T.holes(spark, sf_dir).where("id % 2 = 0 AND project_id < 15").select("project_id", F.col("id").alias("borehole_id"))
    return M.synchronised(links, wanted)


@query(
    "WITH RECURSIVE " + T.HOLES + """, h AS (SELECT id AS key, project_id AS project, longitude AS x, latitude AS y FROM holes), e AS (SELECT a.key AS a, b.key AS b FROM h a JOIN h b ON a.project = b.project AND a.key <> b.key AND POWER(a.x - b.x, 2) + POWER(a.y - b.y, 2) <= 0.04),
 r AS (SELECT a AS key, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.key), c AS (SELECT key, MIN(root) AS cluster FROM r GROUP BY key), s AS (SELECT project, cluster, COUNT(*) AS n FROM c JOIN h ON h.key = c.key GROUP BY project, cluster),
 b AS (SELECT project, ARG_MAX(cluster, ROW(n, -cluster)) AS cluster FROM s GROUP BY project), t AS (SELECT project, COUNT(*) AS n, MEDIAN(x) AS mx, MEDIAN(y) AS my FROM h GROUP BY project), g AS (SELECT b.project, c.key FROM b JOIN c ON c.cluster = b.cluster JOIN t ON t.project = b.project AND t.n >= 3)
 SELECT project, key FROM g UNION ALL SELECT h.project, h.key FROM h JOIN t ON t.project = h.project WHERE h.project NOT IN (SELECT project FROM g)
 AND 2 * 6371.0 * ASIN(SQRT(POWER(SIN(RADIANS(y - my) / 2), 2) + COS(RADIANS(my)) * COS(RADIANS(y)) * POWER(SIN(RADIANS(x - mx) / 2), 2))) <= 20"""
)
def main_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holes of every project that lie with the others."""
    h = T.holes(spark, sf_dir).select(F.col("id").alias("key"), F.col("project_id").alias("project"), F.col("longitude").alias("x"), F.col("latitude").alias("y"))
    return P.main_places(h, 0.2)


@query(_with(T.HOLES, then="""SELECT id, CASE WHEN id % 4 = 0 OR id % 5 = 0 THEN name ELSE 'new' END AS name, CASE WHEN id % 4 = 0 OR id % 5 = 0 OR id % 3 <> 0 THEN project_id ELSE 7 END AS project_id, CASE WHEN id % 4 = 0 THEN 'name' WHEN id % 5 = 0 THEN 'project' END AS refused FROM holes UNION ALL SELECT -1, NULL, NULL, 'hole'"""))
def checked_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change to every hole: a quarter with a blank name, a fifth to a project that is gone, one to a hole that isn't there."""
    h = T.holes(spark, sf_dir)
    k = F.col("id")
    project = F.when(k % 5 == 0, F.lit(900)).when(k % 3 == 0, F.lit(7)).cast("long")
    changes = h.select("id", F.when(k % 4 == 0, F.lit(" ")).otherwise(F.lit("new")).alias("name"), project.alias("project_id"), F.lit(None).cast("double").alias("elevation"))
    changes = changes.unionByName(h.agg(F.lit(-1).cast("long").alias("id"), F.lit("x").alias("name"), F.lit(None).cast("long").alias("project_id"), F.lit(None).cast("double").alias("elevation")))
    projects = T.projects(spark, sf_dir).select("project_id", F.lit(None).cast("timestamp_ntz").alias("deleted_at"))
    rows, refused = M.patched_holes(h, changes, projects)
    return rows.select("id", "name", "project_id").join(refused.withColumnRenamed("reason", "refused"), "id", "full_outer")


@query("SELECT n_nationkey FROM nation WHERE n_nationkey % 5 <> 0 AND n_regionkey = 1 AND n_nationkey % 3 = 0 AND NOT starts_with(n_name, 'NATION_2')")
def listed_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    n = T.table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("project"), F.col("n_regionkey").cast("string").alias("status"), F.lit("survey").alias("kind"), F.when(k % 3 == 0, F.lit("[0,0,1,1]")).alias("bbox"), F.when(k % 5 == 0, F.lit(T.STAMP).cast("timestamp_ntz")).alias("deleted_at"))
    return S.listed_projects(n, status="1", kind="all", has_box=True, hidden=["NATION_2"]).select("n_nationkey")
