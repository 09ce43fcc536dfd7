"""Queries on projects changed by requests, on holes that ask for a second look, and on what pages and written coordinates say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrakern.functions import geodesy, parse, scores, text
from terrakern.functions.names import SOIL_DETAIL
from terrakern.operators import coordinates as C
from terrakern.operators import duplicates as D
from terrakern.operators import intervals as I
from terrakern.operators import projects as PR
from terrakern.operators import reads as R
from terrakern.operators import terrain as TR
from terrakern.plans import standins as T
from terrakern.plans.further import grid_sql, pick, picked
from terrakern.plans.registry import HOLE, _with, query

# --- projects


def _requests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nations as projects of four owners, two of them deleted; orders as requests, of which some are for projects that never were."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    gone = F.lit(T.STAMP).cast("timestamp_ntz")
    p = T.projects(spark, sf_dir)
    p = p.select("project_id", F.col("project").alias("name"), F.lit("r").alias("region"), (F.col("project_id") % 4).alias("owner_id"), F.when(F.col("project_id") % 11 == 10, gone).alias("deleted_at"))
    r = T.table(spark, sf_dir, "orders").select(
        k.alias("ord"), F.when(k % 7 == 0, "create").when(k % 97 == 5, "delete").otherwise("update").alias("action"), F.when(k % 7 != 0, k % 27).alias("project_id"), (c % 4).alias("user_id"), (k % 13 == 0).alias("is_admin"),
        F.to_timestamp_ntz(F.lit("2025-01-01 00:00:00")).alias("at"), F.array(c, c + 1).alias("selected"), F.concat(F.lit("p"), k.cast("string")).alias("name"), F.when(k % 5 != 0, F.concat(F.lit("r"), (k % 3).cast("string"))).alias("region"),
    )
    return p, r


_REQUESTS = f"""{T.PROJECTS}, pj AS (SELECT project_id, project AS name, 'r' AS region, project_id % 4 AS owner_id, CASE WHEN project_id % 11 = 10 THEN TIMESTAMP '{T.STAMP}' END AS deleted_at FROM projects),
 rq AS (SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 7 = 0 THEN 'create' WHEN o_orderkey % 97 = 5 THEN 'delete' ELSE 'update' END AS action, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 27 END AS project_id,
 o_custkey % 4 AS user_id, o_orderkey % 13 = 0 AS is_admin, o_custkey AS c, 'p' || o_orderkey AS name, CASE WHEN o_orderkey % 5 <> 0 THEN 'r' || (o_orderkey % 3) END AS region FROM orders),
 jr AS (SELECT rq.*, CASE WHEN action = 'create' THEN NULL WHEN pj.project_id IS NULL OR pj.deleted_at IS NOT NULL OR EXISTS (SELECT 1 FROM rq e WHERE e.action = 'delete' AND e.project_id = rq.project_id AND e.ord < rq.ord
  AND (e.is_admin OR e.user_id = pj.owner_id)) THEN 'missing' WHEN NOT (is_admin OR user_id = owner_id) THEN 'forbidden' END AS reason FROM rq LEFT JOIN pj ON pj.project_id = rq.project_id),
 mk AS (SELECT (SELECT MAX(project_id) FROM pj) + ROW_NUMBER() OVER (ORDER BY ord) AS project_id, name, region, user_id, c FROM jr WHERE action = 'create')"""  # fmt: skip


@query(f"WITH {_REQUESTS} SELECT ord, action, project_id, reason FROM jr WHERE reason IS NOT NULL")
def refused_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for projects that aren't there (any more), or by others than their owner."""
    p, r = _requests(spark, sf_dir)
    return PR.judged(p, r).where("reason IS NOT NULL").select("ord", "action", "project_id", "reason")


@query(
    f"""WITH {_REQUESTS}, up AS (SELECT project_id, ARG_MAX({{'name': name, 'region': region}}, ord) AS s FROM jr WHERE reason IS NULL AND action = 'update' GROUP BY project_id)
 SELECT pj.project_id, CASE WHEN s IS NULL THEN name ELSE s.name END AS name, CASE WHEN s IS NULL THEN region ELSE s.region END AS region, owner_id,
 COALESCE(deleted_at, CASE WHEN EXISTS (SELECT 1 FROM jr WHERE jr.project_id = pj.project_id AND action = 'delete' AND reason IS NULL) THEN TIMESTAMP '2025-01-01 00:00:00' END) AS deleted_at
 FROM pj LEFT JOIN up ON up.project_id = pj.project_id UNION ALL SELECT project_id, name, region, user_id, NULL FROM mk"""
)
def projects_after_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, r = _requests(spark, sf_dir)
    return PR.applied(p, T.links(spark, sf_dir), T.holes(spark, sf_dir), r)[0]


@query(
    f"""WITH {_REQUESTS}, {T.HOLES}, {T.LINKS}, nm AS (SELECT DISTINCT project_id, UNNEST([c, c + 1]) AS borehole_id FROM (SELECT project_id, c FROM jr WHERE reason IS NULL AND action = 'update' UNION ALL SELECT project_id, c FROM mk)),
 w AS (SELECT nm.project_id, borehole_id, CASE WHEN is_supplementary AND holes.project_id = nm.project_id THEN 'new' ELSE 'existing' END AS role FROM nm JOIN holes ON holes.id = borehole_id WHERE deleted_at IS NULL),
 lk AS (SELECT links.*, ROW_NUMBER() OVER (PARTITION BY project_id, borehole_id ORDER BY deleted_at IS NOT NULL, id) = 1 AS best FROM links)
 SELECT id, lk.project_id, lk.borehole_id, CASE WHEN role IS NOT NULL AND project_role = 'excluded' THEN role ELSE project_role END AS project_role, CASE WHEN role IS NULL THEN deleted_at END AS deleted_at
 FROM lk LEFT JOIN w ON best AND w.project_id = lk.project_id AND w.borehole_id = lk.borehole_id
 UNION ALL SELECT NULL, project_id, borehole_id, role, NULL FROM w WHERE NOT EXISTS (SELECT 1 FROM lk WHERE lk.project_id = w.project_id AND lk.borehole_id = w.borehole_id)"""
)
def links_after_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links once the projects' requests have named their holes."""
    p, r = _requests(spark, sf_dir)
    return PR.applied(p, T.links(spark, sf_dir), T.holes(spark, sf_dir), r)[1]


@query(
    _with(
        T.HOLES, T.LOGGED,
        """bad AS (SELECT borehole_id, BOOL_OR((prev IS NULL AND depth_top < -0.02) OR depth_bottom <= depth_top OR COALESCE(ABS(depth_bottom - nxt) > 0.02, FALSE) OR (nxt IS NULL AND depth_bottom <= 0)) AS depth_anomaly
 FROM (SELECT *, LAG(depth_top) OVER w AS prev, LEAD(depth_top) OVER w AS nxt FROM logged WINDOW w AS (PARTITION BY borehole_id ORDER BY depth_top, depth_bottom)) GROUP BY borehole_id),
 seg AS (SELECT h.*, c_mktsegment AS s, COUNT(*) OVER (PARTITION BY c_mktsegment, ROUND(longitude), ROUND(latitude)) AS n FROM holes h JOIN customer ON c_custkey = id)""",
        then="""SELECT id, CONCAT_WS(',', CASE WHEN n > 1 THEN 'duplicate' END, CASE WHEN depth_anomaly THEN 'depth_anomaly' END, CASE WHEN depth_anomaly IS NULL OR id % 10 = 0 THEN 'unreviewed' END,
 CASE WHEN id % 9 = 0 OR id % 8 = 0 THEN 'coord_outlier' END) AS flags FROM seg LEFT JOIN bad ON borehole_id = id""",
    )
)
def second_looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of all holes; those of one segment at one degree are duplicates, one in nine lies in the sea and one in eight nowhere."""
    name = T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("name"))
    h = T.holes(spark, sf_dir).drop("name").join(name, "id").withColumn("data_status", F.when(F.col("id") % 10 == 0, "pending_review:2").when(F.col("id") % 3 == 0, "original"))
    none = D.signature(T.strata(spark, sf_dir).where("false"), 2)
    twice = D.members(h, D.grouped(h, none, places=0), places=0)
    moved = h.withColumns({"longitude": F.when(F.col("id") % 8 != 0, F.col("longitude")), "latitude": F.when(F.col("id") % 9 == 0, 43.5).otherwise(F.col("latitude"))})
    flagged = D.derived_flags(moved, I.depth_anomalies(T.logged(spark, sf_dir), HOLE), twice)
    return flagged.select("id", F.array_join("flags", ",").alias("flags"))


# --- coordinates and terrain


def _in_turn(number: Column, *values: Column) -> Column:
    out = F.lit(None)
    for n, v in enumerate(values):
        out = F.when(number == n, v).otherwise(out)
    return out


_WEST = "SELECT c_custkey, c_custkey % 7 AS kind, 126 + c_custkey % 61 * 0.03125::DOUBLE AS lon, 36 + c_custkey % 31 * 0.0625::DOUBLE AS lat FROM customer"


@query(
    f"""WITH w AS ({_WEST}) SELECT c_custkey, CASE WHEN kind <> 5 THEN lon END AS lon, CASE WHEN kind <> 5 THEN lat END AS lat, CASE kind WHEN 2 THEN 'EPSG:5186_INFERRED' WHEN 3 THEN 'WGS84' WHEN 5 THEN 'UNKNOWN' WHEN 6 THEN 'EPSG:5187' ELSE 'EPSG:5186' END AS system FROM w"""
)
def normalized_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written coordinates as places: on a belt, exchanged, without a system, as degrees, without a digit, too small for anything, on the eastern belt between words."""
    k = F.col("c_custkey")
    c = T.table(spark, sf_dir, "customer").select("c_custkey", (k % 7).alias("kind"), (F.lit(126.0) + k % 61 * 0.03125).alias("lon0"), (F.lit(36.0) + k % 31 * 0.0625).alias("lat0"))
    (n, e), (n7, e7) = (geodesy.to_grid(F.col("lat0"), F.col("lon0"), code) for code in ("EPSG:5186", "EPSG:5187"))
    said = lambda v: F.concat(F.lit("좌표 "), F.format_number(v, 6), F.lit(" m"))
    plain = lambda v: v.cast("string")
    c = c.withColumns({
        "x": _in_turn(F.col("kind"), plain(e), plain(n), plain(e), plain(F.col("lon0")), plain(e / 10), F.lit("12.5"), said(e7)),
        "y": _in_turn(F.col("kind"), plain(n), plain(e), plain(n), plain(F.col("lat0")), plain(n), F.lit("3"), said(n7)),
        "crs": _in_turn(F.col("kind"), F.lit("EPSG:5186"), F.lit("EPSG:5186"), F.lit(None), F.lit("WGS84"), F.lit("EPSG:5186"), F.lit(None), F.lit("EPSG:5187")),
    })
    return C.normalized(c, "x", "y", "crs", (125.5, 35.5, 128.5, 38.5), (125.0, 35.0, 129.0, 38.9)).select("c_custkey", "lon", "lat", "system")


_SIZES = (0.0078125, 0.0625, 0.5, 3.0, 24.0)


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.projects(spark, sf_dir).select("project_id", (F.lit(126.0) + F.col("project_id") % 5 * 0.375).alias("x0"), (F.lit(34.0) + F.col("project_id") % 3 * 0.25).alias("y0"), pick(_SIZES, F.col("project_id")).alias("size"))
    return p.select("project_id", "x0", "y0", (F.col("x0") + F.col("size")).alias("x1"), (F.col("y0") + F.col("size")).alias("y1"), "size")


def _x(lon: str, z: str) -> str:
    return f"(({lon} + 180) / 360 * 256 * POWER(2.0::DOUBLE, {z}))"


def _y(lat: str, z: str) -> str:
    s = f"SIN(RADIANS({lat}))"
    return f"((0.5 - LN((1 + {s}) / (1 - {s})) / (4 * PI())) * 256 * POWER(2.0::DOUBLE, {z}))"


_LOOK = f"""bx AS (SELECT *, x0 + size AS x1, y0 + size AS y1 FROM (SELECT CAST(n_nationkey AS BIGINT) AS project_id, 126 + n_nationkey % 5 * 0.375::DOUBLE AS x0, 34 + n_nationkey % 3 * 0.25::DOUBLE AS y0, CAST({picked(tuple(map(str, _SIZES)), 'n_nationkey')} AS DOUBLE) AS size FROM nation)),
 zs AS (SELECT bx.*, z, CAST(FLOOR({_x('x0', 'z')} / 256) AS BIGINT) AS l, CAST(FLOOR({_y('y1', 'z')} / 256) AS BIGINT) AS u, CAST(FLOOR({_x('x1', 'z')} / 256) AS BIGINT) AS r, CAST(FLOOR({_y('y0', 'z')} / 256) AS BIGINT) AS w FROM bx CROSS JOIN UNNEST(range(8, 15)) AS t(z)),
 lo AS (SELECT * FROM zs WHERE z = 8 OR (r - l + 1) * (w - u + 1) <= 9 QUALIFY ROW_NUMBER() OVER (PARTITION BY project_id ORDER BY z DESC) = 1)"""  # fmt: skip


@query(f"WITH {_LOOK} SELECT project_id, CAST(z AS INTEGER) AS zoom, tx, UNNEST(range(u, w + 1)) AS ty FROM (SELECT *, UNNEST(range(l, r + 1)) AS tx FROM lo)")
def terrain_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiles of terrain that each project's box asks for."""
    return TR.tiles_of(_boxes(spark, sf_dir), "project_id")


@query(
    f"""WITH {_LOOK}, pl AS (SELECT c_custkey AS k, lo.*, x0 + c_custkey % 64 * size / 64 AS lon, y0 + c_custkey * 5 % 64 * size / 64 AS lat FROM customer JOIN lo ON project_id = c_nationkey),
 px AS (SELECT k, z, GREATEST(l * 256, LEAST(r * 256 + 255, CAST(FLOOR({_x('lon', 'z')} + 0.5) AS BIGINT))) AS px, GREATEST(u * 256, LEAST(w * 256 + 255, CAST(FLOOR({_y('lat', 'z')} + 0.5) AS BIGINT))) AS py FROM pl),
 im AS (SELECT z, px, py, MIN({{'r': 128 + (k % 10 - 1), 'g': k % 256, 'b': k * 7 % 256}}) AS c FROM px WHERE k % 3 <> 0 GROUP BY z, px, py),
 hh AS (SELECT k, px.z AS zoom, COALESCE(c.r * 256 + c.g + c.b / 256.0::DOUBLE - 32768, 0) AS h FROM px LEFT JOIN im ON im.z = px.z AND im.px = px.px AND im.py = px.py)
 SELECT k AS id, CAST(zoom AS INTEGER) AS zoom, CASE WHEN h BETWEEN -30 AND 2000 THEN CAST(h AS DOUBLE) END AS z FROM hh"""
)
def terrain_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights of places in their projects' boxes, from pixels that a part of the places has coloured."""
    boxes, k = _boxes(spark, sf_dir), F.col("c_custkey")
    c = T.table(spark, sf_dir, "customer").select(k.alias("id"), F.col("c_nationkey").cast("long").alias("project_id")).join(boxes.select("project_id", "x0", "y0", "size"), "project_id")
    places = c.select("id", "project_id", (F.col("x0") + F.col("id") % 64 * F.col("size") / 64).alias("lon"), (F.col("y0") + F.col("id") * 5 % 64 * F.col("size") / 64).alias("lat"))
    i = F.col("id")
    pixels = TR.pixels_of(places.where("id % 3 <> 0"), boxes, "project_id").select("zoom", "px", "py", (i % 10 + 127).alias("r"), (i % 256).alias("g"), (i * 7 % 256).alias("b"))
    return TR.heights(places, boxes, pixels, "project_id").select("id", "zoom", "z")


# --- pages

_BEFORE, _SOIL, _AFTER = ("회색 ", "", "담회색", "(상부) ", "암 갈색", "부분"), ("점토질모래", "풍화", "SM", "사질", "경", "x연", "실 트층", "SMX", "전답토", "!?", "이탄"), ("암", "", "층", "(CL)", " 암반", "1")
_NAME = f"{picked(_BEFORE, 'p_partkey')} || {picked(_SOIL, 'p_partkey // 6')} || {picked(_AFTER, 'p_partkey // 66')}"


def _first_sql(words, held: str, value=lambda w: w) -> str:
    return "".join(f" WHEN contains({held}, '{w}') THEN '{value(w)}'" for w in words)


def _cleared(raw: str) -> str:
    out = f"regexp_replace({raw}, '\\(.*?\\)', '', 'g')"
    for word in text.PAGE_COLOURS:
        out = f"replace({out}, '{word}', '')"
    return f"regexp_replace({out}, '\\s+', '', 'g')"


def _page_sql(tight: str) -> str:
    """SQL of a page's name of a cleared text."""
    rest = f"regexp_replace(regexp_replace({tight}, '[a-zA-Z]', '', 'g'), '[^\\p{{L}}\\p{{N}}_]', '', 'g')"
    codes = "".join(f" WHEN regexp_matches(upper({tight}), '(^|[^A-Z]){k}([^A-Z]|$)') THEN '{v}'" for k, v in SOIL_DETAIL.items() if k.isascii())
    rock = f"CASE WHEN regexp_matches({rest}, '{'|'.join(text.HARD_HINTS)}') THEN '경암' WHEN regexp_matches({rest}, '{'|'.join(text.SOFT_HINTS)}') THEN '연암' ELSE '보통암' END"
    return f"CASE{_first_sql(text.PAGE_NAMES, tight)}{codes} WHEN contains({rest}, '풍화') AND contains({rest}, '암') THEN '풍화암'{_first_sql(text.PAGE_HINTS, rest, text.PAGE_HINTS.get)} WHEN contains({rest}, '암') THEN {rock} ELSE '토사' END"


def _shown_sql(name: str) -> str:
    return f"CASE {name}" + "".join(f" WHEN '{k}' THEN '{v}'" for k, v in text.PAGE_GROUPS.items()) + f" ELSE {name} END"


@query(f"WITH t AS (SELECT p_partkey, {_cleared(_NAME)} AS t FROM part), n AS (SELECT p_partkey, {_page_sql('t')} AS name FROM t) SELECT p_partkey, name, {_shown_sql('name')} AS shown FROM n")
def page_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of soils as pages say them, and as a table of pages shows them."""
    k = F.col("p_partkey")
    raw = F.concat(pick(_BEFORE, k), pick(_SOIL, F.floor(k / 6)), pick(_AFTER, F.floor(k / 66)))
    named = T.table(spark, sf_dir, "part").select("p_partkey", text.page_name(raw).alias("name"))
    return named.withColumn("shown", text.table_name(F.col("name")))


_FIELDS = ("depth", "soil_type", "project_name", "remark")
_FIRST, _SECOND, _THIRD = ("1.5", "점토\n모래", " ", "3\n.2 5", "BH 1", "가나�다", "사"), ("-12,5 ", "점성토 2.5", "", "연 암\n실트\nx", "한글"), ("7.25 8", "풍화\n암", "점\n토\n모래", None)


def _split_sql(t: str) -> str:
    return f"list_filter(list_transform(string_split(replace({t}, chr(13), chr(10)), chr(10)), lambda v: trim(v)), lambda v: v <> '')"


def _scores_sql(t: str) -> str:
    tight = f"regexp_replace({t}, '\\s+', '', 'g')"
    line, rivals = "regexp_replace(v, '\\s+', '', 'g')", text.PAGE_GROUPS | text.MISREAD
    read = f"CASE{_first_sql(rivals, line, rivals.get)} ELSE {_shown_sql('(' + _page_sql(_cleared('v')) + ')')} END"
    numbers = f"len(regexp_extract_all({t}, '[-+]?\\d+(?:[,.]\\d+)?')) * 10 + LEAST(length({t}), 20) - CASE WHEN regexp_matches({t}, '\\d\\s*\\n\\s*\\d') THEN 5 ELSE 0 END"
    soils = f"""len(regexp_extract_all({tight}, '{scores.TOKENS}')) * 20 + len(list_filter({_split_sql(t)}, lambda v: regexp_full_match({line}, '{scores.TOKENS}'))) * 10 + len(list_filter({_split_sql(t)}, lambda v: {read} <> '토사'))
 - 3 * len(list_filter({_split_sql(t)}, lambda v: length({line}) = 1)) + LEAST(length({tight}), 30)"""
    names = f"length({tight}) + CASE WHEN regexp_matches({t}, '[가-힣A-Za-z0-9]') THEN 10 ELSE 0 END - CASE WHEN contains({t}, '�') THEN 20 ELSE 0 END"
    return f"CASE WHEN {t} = '' THEN -99 WHEN f = 'depth' THEN {numbers} WHEN f = 'soil_type' THEN {soils} WHEN f = 'project_name' THEN {names} ELSE 0 END"


def _word(words) -> tuple[str, ...]:
    return tuple("" if w is None else w.strip() for w in words)


@query(
    f"""WITH r AS (SELECT event_id, {picked(_FIELDS, 'event_id')} AS f, {picked(_word(_FIRST), 'event_id // 4')} AS a, {picked(_word(_SECOND), 'event_id // 28')} AS b, {picked(_word(_THIRD), 'event_id // 140')} AS c FROM events),
 s AS (SELECT *, {_scores_sql('a')} AS sa, {_scores_sql('b')} AS sb, {_scores_sql('c')} AS sc, CAST(a <> '' AS INTEGER) + CAST(b <> '' AS INTEGER) + CAST(c <> '' AS INTEGER) AS n FROM r)
 SELECT event_id, CASE WHEN n = 0 THEN '' WHEN f = 'remark' AND n > 1 THEN a WHEN f = 'remark' THEN a || b || c WHEN sa >= sb AND sa >= sc THEN a WHEN sb >= sc THEN b ELSE c END AS best FROM s"""
)
def best_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of three texts of one box the one that reads best as what its field holds."""
    k = F.col("event_id")
    readings = [pick(_FIRST, F.floor(k / 4)), pick(_SECOND, F.floor(k / 28)), pick(_THIRD, F.floor(k / 140))]
    return T.table(spark, sf_dir, "events").select("event_id", scores.best_text(readings, pick(_FIELDS, k)).alias("best"))


# --- what areas and files are asked for

_WRITTEN = ("126.5, 36 ,127,37.25", "126,36,126,37", "126,36,127", "a,36,127,37", "127,36,126,37", "", None, " 1e2,-3,101,4 ", "126,36,127,37,", "1,2,1,2")


def _box_sql(strict: str, blank: str, name: str) -> str:
    ok = f"p[1] {strict} p[3] AND p[2] {strict} p[4]"
    return f"""CASE WHEN len(p) = 4 AND len(list_filter(p, lambda v: v IS NULL)) = 0 AND {ok} THEN p[1] END AS {name}_west,
 CASE WHEN COALESCE(t, '') = '' THEN {blank} WHEN len(p) <> 4 OR len(list_filter(p, lambda v: v IS NULL)) > 0 THEN 'numbers' WHEN NOT ({ok}) THEN 'order' END AS {name}_reason"""


@query(
    f"""WITH r AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey || ',' || s_nationkey || ',' || 50 || ',' || 9 ELSE {picked(_WRITTEN, 's_suppkey')} END AS t FROM supplier),
 s AS (SELECT *, list_transform(string_split(t, ','), lambda v: TRY_CAST(trim(v) AS DOUBLE)) AS p FROM r) SELECT s_suppkey, {_box_sql('<', "'numbers'", 'area')}, {_box_sql('<=', 'NULL', 'list')} FROM s"""
)
def written_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes as requests write them, for areas, which have a size, and for lists, which may have none."""
    k = F.col("s_suppkey")
    asked = F.when(k % 3 == 0, F.concat_ws(",", k.cast("string"), F.col("s_nationkey").cast("string"), F.lit("50"), F.lit("9"))).otherwise(pick(_WRITTEN, k))
    s = T.table(spark, sf_dir, "supplier").select("s_suppkey", parse.box_of(asked).alias("a"), parse.box_of(asked, point=True).alias("l"))
    return s.select("s_suppkey", F.try_element_at("a.box", F.lit(1)).alias("area_west"), F.col("a.reason").alias("area_reason"), F.try_element_at("l.box", F.lit(1)).alias("list_west"), F.col("l.reason").alias("list_reason"))


@query(
    f"""WITH {T.HOLES}, {T.LINKS}, h AS (SELECT id, project_id % 20 AS project_id, 'f' || (id % 40) AS source_file, is_supplementary AND id % 4 = 0 AS is_supplementary FROM holes WHERE deleted_at IS NULL AND id % 40 <> 7)
 SELECT h.project_id, source_file, COUNT(*) AS n, COUNT(*) FILTER (WHERE is_supplementary IS TRUE OR project_role = 'new') AS new, COUNT(*) FILTER (WHERE is_supplementary IS TRUE OR project_role = 'new') > 0 AS supplementary
 FROM h LEFT JOIN links l ON l.borehole_id = h.id AND l.project_id = h.project_id AND l.deleted_at IS NULL GROUP BY h.project_id, source_file"""
)
def origins_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files brought holes that are a project's own."""
    i = F.col("id")
    file = F.when(i % 40 != 7, F.concat(F.lit("f"), (i % 40).cast("string")))
    h = T.holes(spark, sf_dir).withColumns({"project_id": F.col("project_id") % 20, "source_file": file, "is_supplementary": F.col("is_supplementary") & (i % 4 == 0)})
    return R.origin_of_files(h, T.links(spark, sf_dir))
