"""Queries over the driver's tables, each a caller of the library's operators, beside the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrakern.functions import geodesy, groundwater, names, parse
from terrakern.operators import aggregates as A
from terrakern.operators import coordinates as C
from terrakern.operators import documents as DOC
from terrakern.operators import duplicates as D
from terrakern.operators import intervals as I
from terrakern.operators import modelling as N
from terrakern.operators import mutations as M
from terrakern.operators import overlay as O
from terrakern.operators import selection as S
from terrakern.operators import spatial as P
from terrakern.operators import surfaces as U
from terrakern.plans import standins as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
HOLE, KEY, ORDER = ["borehole_id"], T.KEY, T.ORDER


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _with(*parts: str, then: str) -> str:
    return "WITH " + ", ".join(parts) + " " + then


# --- the effective view


_REVISED = """latest AS (SELECT borehole_id, version, k, sets_elevation FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY borehole_id ORDER BY version DESC) AS n FROM revisions
 WHERE deleted_at IS NULL) WHERE n = 1)"""


@query(
    _with(
        T.HOLES, T.REVISIONS, _REVISED,
        then="""SELECT id, project_id, COALESCE(CASE WHEN sets_elevation THEN k END, elevation) AS elevation, CASE WHEN NOT sets_elevation THEN k END AS depth,
 CASE WHEN NOT sets_elevation THEN elevation - k END AS head, version AS revision_version,
 CASE WHEN version IS NOT NULL THEN 'revised' WHEN is_supplementary THEN 'supplementary' ELSE 'original' END AS data_status
 FROM holes LEFT JOIN latest ON borehole_id = id WHERE deleted_at IS NULL""",
    )
)
def effective_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Originals with their latest revision."""
    base = S.with_status(S.live(T.holes(spark, sf_dir)))
    base = base.withColumns({c: F.lit(None).cast("double") for c in ("groundwater_depth_bgl_m", "groundwater_head_elevation_m")}).withColumn("groundwater_reference_datum", F.lit(None).cast("string"))
    out = O.with_revision(base, O.latest_revisions(T.revisions(spark, sf_dir)))
    return out.select("id", "project_id", "elevation", F.col("groundwater_depth_bgl_m").alias("depth"), F.col("groundwater_head_elevation_m").alias("head"), "revision_version", "data_status")


flagship = effective_holes


@query(
    _with(
        T.HOLES, T.LINKS, T.REVISIONS, _REVISED,
        then="""SELECT b.id, l.project_id, l.project_role = 'new' AS is_supplementary, l.project_role AS data_status, version AS revision_version
 FROM (SELECT id, project_id, is_supplementary, version FROM holes LEFT JOIN latest ON borehole_id = id WHERE deleted_at IS NULL) b JOIN links l ON l.borehole_id = b.id WHERE l.deleted_at IS NULL AND project_role <> 'excluded'
 UNION ALL SELECT b.id, b.project_id, is_supplementary, CASE WHEN version IS NOT NULL THEN 'revised' WHEN is_supplementary THEN 'supplementary' ELSE 'original' END, version
 FROM (SELECT id, project_id, is_supplementary, version FROM holes LEFT JOIN latest ON borehole_id = id WHERE deleted_at IS NULL) b
 LEFT JOIN (SELECT DISTINCT project_id AS p FROM links WHERE deleted_at IS NULL) lp ON lp.p = b.project_id
 LEFT JOIN (SELECT DISTINCT project_id AS p2, borehole_id AS h2 FROM links WHERE deleted_at IS NULL) lh ON lh.p2 = b.project_id AND lh.h2 = b.id
 WHERE lp.p IS NULL OR (is_supplementary AND lh.h2 IS NULL)""",
    )
)
def effective_by_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All projects' holes: linked and supplementary where there are links, own holes elsewhere."""
    base = T.holes(spark, sf_dir).withColumns({c: F.lit(None).cast("double") for c in ("groundwater_depth_bgl_m", "groundwater_head_elevation_m")}).withColumn("groundwater_reference_datum", F.lit(None).cast("string"))
    none = spark.createDataFrame([], "project_id long, source_borehole_id long, status string, data string, deleted_at timestamp_ntz")
    out = O.effective(base, T.revisions(spark, sf_dir), none, T.links(spark, sf_dir), {"elevation": "double"})
    return out.select("id", "project_id", "is_supplementary", "data_status", "revision_version")


@query(_with(T.REVISIONS, then="SELECT borehole_id, MAX(version) AS version FROM revisions WHERE deleted_at IS NULL GROUP BY borehole_id"))
def latest_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.latest_revisions(T.revisions(spark, sf_dir)).select("borehole_id", "version")


@query(
    _with(
        T.OBSERVATIONS,
        then="""SELECT borehole_id, id, review_status, depth_bgl_m FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY borehole_id ORDER BY CASE review_status WHEN 'confirmed' THEN 3 WHEN 'approved' THEN 3
 WHEN 'auto' THEN 2 WHEN 'needs_review' THEN 1 ELSE 0 END DESC, COALESCE(observed_at, created_at) DESC, id DESC) AS n FROM observations WHERE review_status NOT IN ('rejected', 'excluded') AND depth_bgl_m IS NOT NULL) WHERE n = 1""",
    )
)
def best_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.best_observations(T.observations(spark, sf_dir)).select("borehole_id", "id", "review_status", "depth_bgl_m")


@query(_with(T.REVISIONS, then="SELECT borehole_id, MAX(version) + 1 AS next_version FROM revisions WHERE deleted_at IS NULL GROUP BY borehole_id"))
def next_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.next_version(S.live(T.revisions(spark, sf_dir)), HOLE, "version")


@query(_with(T.HOLES, T.REVISIONS, then="SELECT id AS borehole_id, CAST(0 AS BIGINT) AS version FROM holes UNION ALL SELECT borehole_id, version FROM revisions WHERE deleted_at IS NULL"))
def timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.timeline(T.holes(spark, sf_dir), T.revisions(spark, sf_dir), F.to_json(F.struct("elevation"))).select("borehole_id", "version")


@query(
    _with(
        T.REVISIONS,
        then="SELECT r.borehole_id, m.last + 1 AS version, r.version AS restored_from FROM revisions r JOIN (SELECT borehole_id, MAX(version) AS last, MIN(version) AS first FROM revisions WHERE deleted_at IS NULL GROUP BY borehole_id) m ON m.borehole_id = r.borehole_id AND r.version = m.first",
    )
)
def restored_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = T.revisions(spark, sf_dir)
    first = S.live(r).groupBy("borehole_id").agg(F.min("version").alias("version"))
    return O.restored(r, first).select("borehole_id", "version", "restored_from")


@query("SELECT event_id, props LIKE '%\"k\"%' AS names_key, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def payload_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("props")
    return T.table(spark, sf_dir, "events").select("event_id", O.named(p, "k").alias("names_key"), O.value(p, "k").alias("k"))


# --- filters and projections


@query(_with(T.HOLES, then="SELECT id FROM holes WHERE deleted_at IS NULL AND longitude BETWEEN 127.0 AND 128.5 AND latitude BETWEEN 35.0 AND 37.0"))
def holes_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.in_box(S.live(T.holes(spark, sf_dir)), "longitude", "latitude", (127.0, 35.0, 128.5, 37.0)).select("id")


TRIANGLE = ((126.5, 34.5), (128.5, 34.5), (127.5, 37.5))


@query(
    _with(
        T.HOLES,
        then="SELECT id FROM holes WHERE latitude > 34.5 AND (longitude - 126.5) * 3.0 - (latitude - 34.5) * 1.0 > 0 AND (128.5 - longitude) * 3.0 - (latitude - 34.5) * 1.0 > 0",
    )
)
def holes_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.holes(spark, sf_dir).where(P.in_polygon(F.col("longitude"), F.col("latitude"), [TRIANGLE])).select("id")


@query(_with(T.HOLES, then="SELECT id FROM holes WHERE name ILIKE '%00012%' OR CAST(id AS VARCHAR) ILIKE '%00012%' OR CAST(project_id AS VARCHAR) ILIKE '%00012%'"))
def holes_by_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.keyword(T.holes(spark, sf_dir), " 00012 ", ["name", "id", "project_id"]).select("id")


@query(_with(T.HOLES, then="SELECT id FROM holes WHERE project_id = 16 AND id BETWEEN 0 AND 99"))
def holes_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.by_ids(S.equal_unless_all(T.holes(spark, sf_dir), "project_id", 16), "id", list(range(100)))
    return S.equal_unless_all(rows, "name", "all").select("id")


@query(_with(T.HOLES, then="SELECT id, CASE WHEN is_supplementary THEN 'supplementary' ELSE 'original' END AS data_status FROM holes ORDER BY id DESC LIMIT 100 OFFSET 50"))
def hole_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.with_status(T.holes(spark, sf_dir)).orderBy(F.desc("id")).offset(50).limit(100).select("id", "data_status")


@query(_with(T.PROJECTS, then="SELECT project_id FROM projects WHERE NOT (starts_with(project, 'NATION_1') OR starts_with(project, 'NATION_20'))"))
def named_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.not_prefixed(T.projects(spark, sf_dir), "project", ["NATION_1", "NATION_20"]).select("project_id")


@query(_with(T.HOLES, T.STRATA, then="SELECT s.borehole_id, l_linenumber, l_partkey, l_suppkey, elevation - depth_top AS z_top, elevation - depth_bottom AS z_bot, depth_bottom - depth_top AS thickness FROM strata s JOIN holes h ON h.id = s.borehole_id"))
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.segments(T.holes(spark, sf_dir), T.strata(spark, sf_dir)).select("borehole_id", *KEY, "z_top", "z_bot", "thickness")


@query(_with(T.HOLES, T.STRATA, then="SELECT h.id, COUNT(s.borehole_id) AS n_strata, COALESCE(MAX(s.depth_bottom), 0.0) AS deepest FROM holes h LEFT JOIN strata s ON s.borehole_id = h.id GROUP BY h.id"))
def nested_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.nested_strata(T.holes(spark, sf_dir), T.strata(spark, sf_dir))
    last = F.try_element_at("strata", F.lit(-1))["depth_bottom"]
    return rows.select("id", F.size("strata").cast("long").alias("n_strata"), F.coalesce(last, F.lit(0.0)).alias("deepest"))


@query(_with(T.HOLES, then="SELECT id, CASE WHEN ABS(elevation) < 0.5 THEN 'normal' WHEN ABS(elevation) < 1 THEN 'minor' WHEN ABS(elevation) < 2 THEN 'major' ELSE 'critical' END AS severity FROM holes"))
def terrain_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.holes(spark, sf_dir).select("id", S.severity(F.col("elevation")).alias("severity"))


@query("SELECT c_nationkey, (list_sort(list(c_acctbal)))[CAST(COUNT(c_acctbal) // 2 AS INTEGER) + 1] AS middle FROM customer GROUP BY c_nationkey")
def upper_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(A.upper_median("c_acctbal").alias("middle"))


@query("SELECT c_custkey FROM customer, (SELECT (list_sort(list(c_acctbal)))[CAST(COUNT(*) // 2 AS INTEGER) + 1] AS m FROM customer) WHERE ABS(c_acctbal - m) < 1500")
def residual_inliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.within_upper_median(T.table(spark, sf_dir, "customer"), "c_acctbal", 1500.0).select("c_custkey")


@query(
    _with(
        T.STRATA,
        "deep AS (SELECT borehole_id, MAX(depth_bottom) AS depth FROM strata GROUP BY borehole_id)",
        then="SELECT borehole_id, depth, depth > GREATEST(2.0 * m, 100.0) AS warn FROM deep, (SELECT (list_sort(list(depth)))[CAST(COUNT(*) // 2 AS INTEGER) + 1] AS m FROM deep)",
    )
)
def depth_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    deep = T.strata(spark, sf_dir).groupBy("borehole_id").agg(F.max("depth_bottom").alias("depth"))
    return S.depth_warnings(deep, "depth", times=2.0)


@query(
    _with(
        T.HOLES, T.LOGGED,
        """bad AS (SELECT borehole_id, BOOL_OR((prev IS NULL AND depth_top < -0.02) OR depth_bottom <= depth_top OR COALESCE(ABS(depth_bottom - nxt) > 0.02, FALSE) OR (nxt IS NULL AND depth_bottom <= 0)) AS depth_anomaly
 FROM (SELECT *, LAG(depth_top) OVER w AS prev, LEAD(depth_top) OVER w AS nxt FROM logged WINDOW w AS (PARTITION BY borehole_id ORDER BY depth_top, depth_bottom)) GROUP BY borehole_id)""",
        then="""SELECT id, CONCAT_WS(',', CASE WHEN depth_anomaly THEN 'depth_anomaly' END, CASE WHEN depth_anomaly IS NULL THEN 'unreviewed' END, CASE WHEN longitude > 128.5 OR latitude > 37.5 THEN 'coord_outlier' END) AS flags FROM holes LEFT JOIN bad ON borehole_id = id""",
    )
)
def review_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = I.depth_anomalies(T.logged(spark, sf_dir), HOLE)
    rows = T.holes(spark, sf_dir).join(bad, F.col("id") == F.col("borehole_id"), "left")
    named = {"depth_anomaly": F.col("depth_anomaly"), "unreviewed": F.col("depth_anomaly").isNull(), "coord_outlier": S.coordinate_outlier(F.col("longitude"), F.col("latitude"), east=128.5, north=37.5)}
    return rows.select("id", F.array_join(S.flags(named), ",").alias("flags"))


# --- joins and counts


@query(_with(T.PROJECTS, T.HOLES, then="SELECT p.project_id, COUNT(h.id) AS n FROM projects p LEFT JOIN holes h ON h.project_id = p.project_id AND h.deleted_at IS NULL GROUP BY p.project_id"))
def holes_of_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.child_counts(T.projects(spark, sf_dir), "project_id", {"n": S.live(T.holes(spark, sf_dir))}).select("project_id", "n")


@query(
    _with(
        T.PROJECTS, T.HOLES, T.LINKS,
        then="SELECT p.project_id, CASE WHEN COALESCE(l.n, 0) > 0 THEN l.n ELSE COALESCE(h.n, 0) END AS n FROM projects p LEFT JOIN (SELECT project_id, COUNT(*) AS n FROM holes WHERE deleted_at IS NULL GROUP BY project_id) h ON h.project_id = p.project_id LEFT JOIN (SELECT project_id, COUNT(*) AS n FROM links WHERE deleted_at IS NULL GROUP BY project_id) l ON l.project_id = p.project_id",
    )
)
def project_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.own_or_linked_count(T.projects(spark, sf_dir), "project_id", S.live(T.holes(spark, sf_dir)), S.live(T.links(spark, sf_dir))).select("project_id", "n")


@query(_with(T.HOLES, T.LINKS, then="SELECT id FROM holes h WHERE is_supplementary AND NOT EXISTS (SELECT 1 FROM links l WHERE l.borehole_id = h.id AND l.deleted_at IS NULL AND l.project_id = 3)"))
def unlinked_supplementary(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = S.live(T.links(spark, sf_dir)).where("project_id = 3").select(F.col("borehole_id").alias("id"))
    return T.holes(spark, sf_dir).where("is_supplementary").join(linked, "id", "left_anti").select("id")


@query(_with(T.LINKS, then="SELECT project_id, COUNT(*) FILTER (WHERE project_role = 'new') AS new_count, COUNT(*) FILTER (WHERE project_role = 'existing') AS selected_count, COUNT(DISTINCT borehole_id) AS holes FROM links WHERE deleted_at IS NULL GROUP BY project_id"))
def role_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = lambda r: F.count(F.when(F.col("project_role") == r, 1))
    return S.live(T.links(spark, sf_dir)).groupBy("project_id").agg(role("new").alias("new_count"), role("existing").alias("selected_count"), F.count_distinct("borehole_id").alias("holes"))


@query(
    _with(
        T.HOLES, T.LINKS,
        then="SELECT l.id, CASE WHEN o.borehole_id IS NOT NULL THEN 'new' ELSE 'existing' END AS project_role FROM links l JOIN holes h ON h.id = l.borehole_id LEFT JOIN (SELECT DISTINCT project_id, borehole_id FROM links WHERE project_role = 'new') o ON o.project_id = l.project_id AND o.borehole_id = l.borehole_id",
    )
)
def reclassified_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = T.links(spark, sf_dir)
    return M.reclassified(links, T.holes(spark, sf_dir), links.where("project_role = 'new'")).select("id", "project_role")


@query(_with(T.STRATA, then="SELECT borehole_id, COALESCE(SUM(thickness) FILTER (WHERE soil_type = 'A'), 0.0) AS A, COALESCE(SUM(thickness) FILTER (WHERE soil_type = 'N'), 0.0) AS N, COALESCE(SUM(thickness) FILTER (WHERE soil_type = 'R'), 0.0) AS R FROM strata GROUP BY borehole_id"))
def thickness_by_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.thickness_by(T.strata(spark, sf_dir), "borehole_id", "soil_type", ["A", "N", "R"])


_TURNS = "turns AS (SELECT *, LAG(soil_type) OVER (PARTITION BY borehole_id ORDER BY l_linenumber, l_partkey, l_suppkey, thickness, soil_type) AS before FROM layers)"


@query(
    _with(
        T.LAYERS, _TURNS,
        then="SELECT sequence, COUNT(*) AS n FROM (SELECT borehole_id, STRING_AGG(soil_type, '>' ORDER BY l_linenumber, l_partkey, l_suppkey, thickness, soil_type) AS sequence FROM turns WHERE before IS NULL OR before <> soil_type GROUP BY borehole_id) GROUP BY sequence",
    )
)
def soil_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.sequences(T.layers(spark, sf_dir), "borehole_id", "soil_type", ORDER)


@query(
    _with(
        T.LAYERS,
        then="SELECT soil_type, occurrence, COUNT(*) AS holes, AVG(place) AS mean_place FROM (SELECT soil_type, ROW_NUMBER() OVER (PARTITION BY borehole_id ORDER BY l_linenumber, l_partkey, l_suppkey, thickness, soil_type) - 1 AS place, CAST(ROW_NUMBER() OVER (PARTITION BY borehole_id, soil_type ORDER BY l_linenumber, l_partkey, l_suppkey, thickness, soil_type) AS INTEGER) AS occurrence FROM layers) GROUP BY soil_type, occurrence",
    )
)
def soil_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.occurrence_order(T.layers(spark, sf_dir), "borehole_id", "soil_type", ORDER)


@query("SELECT c_nationkey, MIN(c_acctbal) AS low, MAX(c_acctbal) AS high, COUNT(*) AS n FROM customer GROUP BY c_nationkey")
def project_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.min("c_acctbal").alias("low"), F.max("c_acctbal").alias("high"), F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, mode, n, size FROM (SELECT user_id, length(event_type) AS mode, COUNT(*) AS n, SUM(COUNT(*)) OVER (PARTITION BY user_id) AS size, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY COUNT(*) DESC, length(event_type)) AS k FROM events GROUP BY user_id, length(event_type)) WHERE k = 1")
def commonest_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.table(spark, sf_dir, "events").withColumn("_length", F.length("event_type").cast("long"))
    return A.shares_of_mode(e, ["user_id"], "_length")


# --- intervals


@query(
    _with(
        T.STRATA,
        then="""SELECT borehole_id, run, MIN(soil_type) AS soil_type, MIN(depth_top) AS depth_top, MAX(depth_bottom) AS depth_bottom, COUNT(*) AS parts FROM (SELECT *, SUM(b) OVER (PARTITION BY borehole_id ORDER BY l_linenumber, l_partkey, l_suppkey, thickness, soil_type ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM (SELECT *, CASE WHEN LAG(soil_type) OVER w = soil_type AND ABS(LAG(depth_bottom) OVER w - depth_top) <= 0.05 THEN 0 ELSE 1 END AS b FROM strata WINDOW w AS (PARTITION BY borehole_id ORDER BY l_linenumber, l_partkey, l_suppkey, thickness, soil_type))) GROUP BY borehole_id, run""",
    )
)
def merged_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.merge_adjacent(T.strata(spark, sf_dir), HOLE, ORDER, "soil_type")


@query(
    _with(
        T.LOGGED,
        then="""SELECT borehole_id, run, MIN(soil_type) AS soil_type, MIN(depth_top) AS depth_top, MAX(depth_bottom) AS depth_bottom, STRING_AGG(code, '/' ORDER BY l_linenumber, l_partkey, l_suppkey, thickness, soil_type) AS code FROM (SELECT *, CAST(l_suppkey AS VARCHAR) AS code, SUM(b) OVER (PARTITION BY borehole_id ORDER BY l_linenumber, l_partkey, l_suppkey, thickness, soil_type ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM (SELECT *, CASE WHEN LAG(soil_type) OVER w = soil_type THEN 0 ELSE 1 END AS b FROM logged WINDOW w AS (PARTITION BY borehole_id ORDER BY l_linenumber, l_partkey, l_suppkey, thickness, soil_type))) GROUP BY borehole_id, run""",
    )
)
def merged_same_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.logged(spark, sf_dir).withColumn("code", F.col("l_suppkey").cast("string"))
    return I.merge_same_name(rows, HOLE, ORDER, "soil_type", "code")


@query(_with(T.STRATA, then="SELECT borehole_id, l_linenumber, l_partkey, l_suppkey, depth_top, depth_bottom FROM strata WHERE thickness > 0"))
def stacked_thicknesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.stacked(T.layers(spark, sf_dir), HOLE, ORDER, "thickness").select("borehole_id", *KEY, "depth_top", "depth_bottom")


@query(
    "WITH RECURSIVE "
    + T.LOGGED
    + """, numbered AS (SELECT borehole_id, depth_top, depth_bottom, soil_type, CAST(ROW_NUMBER() OVER (PARTITION BY borehole_id ORDER BY depth_top, depth_bottom, soil_type) AS INTEGER) AS n FROM logged),
 walk AS (SELECT borehole_id, n, depth_top AS t, depth_bottom AS b FROM numbered WHERE n = 1 UNION ALL SELECT x.borehole_id, x.n, CASE WHEN w.b > x.depth_top THEN w.b ELSE x.depth_top END,
 CASE WHEN x.depth_bottom <= CASE WHEN w.b > x.depth_top THEN w.b ELSE x.depth_top END THEN CASE WHEN w.b > x.depth_top THEN w.b ELSE x.depth_top END + CAST(0.1 AS DOUBLE) ELSE x.depth_bottom END FROM walk w JOIN numbered x ON x.borehole_id = w.borehole_id AND x.n = w.n + 1)
 SELECT borehole_id, CAST(n - 1 AS INTEGER) AS place, t AS depth_top, b AS depth_bottom FROM walk"""
)
def continuous_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.continuous(T.logged(spark, sf_dir), HOLE, "soil_type").select("borehole_id", "place", "depth_top", "depth_bottom")


@query(_with(T.STRATA, then="SELECT borehole_id, l_linenumber, l_partkey, l_suppkey, COALESCE(LAG(depth_bottom) OVER (PARTITION BY borehole_id ORDER BY l_linenumber, l_partkey, l_suppkey, thickness, soil_type), 0.0) AS depth_top FROM strata"))
def tops_from_bottoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.tops_from_bottoms(T.strata(spark, sf_dir).drop("depth_top"), HOLE, ORDER).select("borehole_id", *KEY, "depth_top")


@query("SELECT l_orderkey, l_linenumber, MIN(l_partkey) AS l_partkey FROM lineitem GROUP BY l_orderkey, l_linenumber")
def first_of_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.distinct_first(T.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT event_id, LAST_VALUE(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hint FROM events")
def hints_carried_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.table(spark, sf_dir, "events").withColumn("hint", F.when(F.col("event_type") == "error", F.col("event_id")))
    return I.filled_down(rows, ["user_id"], ["event_id"], ["hint"]).select("event_id", "hint")


@query("SELECT event_id, SUM(b) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM (SELECT *, CASE WHEN LAG(value) OVER w IS NULL OR value < LAG(value) OVER w - 2.0 THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))")
def depth_resets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.resets(T.table(spark, sf_dir, "events"), ["user_id"], ["event_id"], "value").select("event_id", "section")


@query(
    _with(
        T.STRATA,
        then="""SELECT borehole_id, l_linenumber, l_partkey, l_suppkey, CASE WHEN u THEN 'BH-a' || CAST(SUM(b) OVER (PARTITION BY borehole_id ORDER BY l_linenumber, l_partkey, l_suppkey, thickness, soil_type ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS VARCHAR) ELSE soil_type END AS name FROM (SELECT *, CASE WHEN u AND NOT COALESCE(LAG(u) OVER w AND depth_top > 0 AND depth_top >= LAG(depth_bottom) OVER w - 2.0, FALSE) THEN 1 ELSE 0 END AS b FROM (SELECT *, soil_type = 'N' AS u FROM strata) WINDOW w AS (PARTITION BY borehole_id ORDER BY l_linenumber, l_partkey, l_suppkey, thickness, soil_type))""",
    )
)
def unknown_holes_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.strata(spark, sf_dir).withColumn("name", F.when(F.col("soil_type") == "N", F.lit(" unknown ")).otherwise(F.col("soil_type")))
    return I.numbered_unknown(rows, HOLE, ORDER, "name").select("borehole_id", *KEY, "name")


_ENDS = "ends AS (SELECT DISTINCT borehole_id, depth_top AS cut_at FROM logged UNION SELECT borehole_id, depth_bottom FROM logged), pieces AS (SELECT * FROM (SELECT borehole_id, cut_at AS depth_top, LEAD(cut_at) OVER (PARTITION BY borehole_id ORDER BY cut_at) AS depth_bottom FROM ends) WHERE depth_bottom IS NOT NULL)"


@query(_with(T.LOGGED, _ENDS, then="SELECT * FROM pieces"))
def elementary_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.elementary(T.logged(spark, sf_dir), HOLE)


@query(
    _with(
        T.LOGGED, _ENDS,
        then="SELECT borehole_id, depth_top, depth_bottom, soil_type FROM (SELECT p.*, l.soil_type, ROW_NUMBER() OVER (PARTITION BY p.borehole_id, p.depth_top, p.depth_bottom ORDER BY l.l_partkey NULLS LAST, l.soil_type) AS n FROM pieces p LEFT JOIN logged l ON l.borehole_id = p.borehole_id AND p.depth_top >= l.depth_top - 0.05 AND p.depth_bottom <= l.depth_bottom + 0.08) WHERE n = 1",
    )
)
def named_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.logged(spark, sf_dir)
    return I.named_by_containment(I.elementary(rows, HOLE), rows, HOLE, "soil_type", "l_partkey")


@query(
    _with(
        T.LOGGED,
        then="SELECT borehole_id, BOOL_AND(ABS(depth_top - before) <= 0.000001 AND depth_bottom > depth_top) AS contiguous, MAX(depth_bottom) AS total_depth FROM (SELECT *, COALESCE(LAG(depth_bottom) OVER (PARTITION BY borehole_id ORDER BY l_linenumber, l_partkey, l_suppkey, thickness, soil_type), 0.0) AS before FROM logged) GROUP BY borehole_id",
    )
)
def contiguous_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.contiguity(T.logged(spark, sf_dir), HOLE, ORDER)


@query(
    """SELECT user_id, run, MIN(label) AS label, MIN(event_id) AS first, MAX(event_id) AS last FROM (SELECT *, SUM(b) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM
 (SELECT user_id, event_id, length(event_type) AS label, CASE WHEN LAG(length(event_type)) OVER w = length(event_type) AND LAG(event_id) OVER w + 1 = event_id THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))) WHERE label <> 5 GROUP BY user_id, run"""
)
def label_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.table(spark, sf_dir, "events").withColumn("label", F.length("event_type").cast("long"))
    return I.run_lengths(e, ["user_id"], "event_id", "label", skip=5)


# --- duplicates and changes


@query("SELECT c_mktsegment AS name, c_nationkey, COUNT(*) AS n, MIN(c_custkey) AS keep FROM customer GROUP BY c_mktsegment, c_nationkey HAVING COUNT(*) > 1")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("name"), F.col("c_nationkey").cast("double").alias("longitude"), F.lit(1.0).alias("latitude"), F.lit(0.0).alias("elevation"))
    none = spark.createDataFrame([], "borehole_id long, signature string")
    return D.grouped(c, none).select("name", F.col("x").cast("int").alias("c_nationkey"), "n", "keep")


_COPIES = "copies AS (SELECT md5(text) AS name, COUNT(*) AS n, COUNT(DISTINCT lang) AS logs, MIN(doc_id) AS keep FROM documents GROUP BY text HAVING COUNT(*) > 1)"


@query(_with(_COPIES, then="SELECT CASE WHEN logs = 1 THEN 'exact' ELSE 'conflict' END AS kind, COUNT(*) AS groups, SUM(n) AS holes, SUM(CASE WHEN logs = 1 THEN n - 1 ELSE 0 END) AS removable FROM copies GROUP BY kind"))
def duplicate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.table(spark, sf_dir, "documents")
    holes = d.select(F.col("doc_id").alias("id"), F.md5("text").alias("name"), F.lit(1.0).alias("longitude"), F.lit(1.0).alias("latitude"), F.lit(0.0).alias("elevation"))
    return D.summary(D.grouped(holes, d.select(F.col("doc_id").alias("borehole_id"), F.col("lang").alias("signature"))))


@query("SELECT p_size, COUNT(*) AS n, STRING_AGG(DISTINCT p_brand, ', ' ORDER BY p_brand) AS name FROM part WHERE p_partkey % 10 <> 0 GROUP BY p_size HAVING COUNT(DISTINCT p_brand) > 1")
def place_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"), F.col("p_size").cast("double").alias("longitude"), F.lit(1.0).alias("latitude"))
    return D.place_conflicts(p, p.where("id % 10 = 0")).select(F.col("x").cast("int").alias("p_size"), "n", "name")


@query(
    _with(
        T.LINKS,
        then="SELECT id, project_id, borehole_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY project_id, borehole_id ORDER BY moved, id) AS n FROM (SELECT id, project_id, CASE WHEN borehole_id % 10 = 3 THEN borehole_id - 3 ELSE borehole_id END AS borehole_id, CASE WHEN borehole_id % 10 = 3 THEN 1 ELSE 0 END AS moved FROM links)) WHERE n = 1",
    )
)
def repointed_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = T.holes(spark, sf_dir).where("id % 10 = 3").select("id", (F.col("id") - 3).alias("keep"))
    return D.repointed(T.links(spark, sf_dir), moved).select("id", "project_id", "borehole_id")


@query(
    _with(
        T.LINKS,
        then="SELECT project_id, STRING_AGG(CAST(id AS VARCHAR), ',' ORDER BY first_at) AS ids FROM (SELECT project_id, CASE WHEN borehole_id % 10 = 3 THEN borehole_id - 3 ELSE borehole_id END AS id, MIN(links.id) AS first_at FROM links GROUP BY 1, 2) GROUP BY project_id",
    )
)
def rewritten_id_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = T.links(spark, sf_dir).groupBy("project_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "borehole_id"))), lambda s: s["borehole_id"]).alias("ids"))
    moved = T.holes(spark, sf_dir).where("id % 10 = 3").select("id", (F.col("id") - 3).alias("keep"))
    out = D.rewritten_ids(lists, "ids", "project_id", moved)
    return out.select("project_id", F.array_join("ids", ",").alias("ids"))


@query(
    _with(
        T.STRATA,
        """rows_ AS (SELECT borehole_id % 50 AS file, CASE WHEN borehole_id % 3 = 0 THEN 'UNKNOWN' ELSE CAST(borehole_id AS VARCHAR) END AS hole, depth_top, depth_bottom FROM strata),
 h AS (SELECT file, hole, MAX(depth_bottom) AS deepest, COUNT(*) AS known, COUNT(*) FILTER (WHERE depth_bottom > 100 OR depth_bottom - depth_top > 50) AS odd FROM rows_ GROUP BY file, hole),
 d AS (SELECT file, deepest AS v, COUNT(*) AS n FROM h GROUP BY file, deepest), m AS (SELECT file, MAX(n) AS most, SUM(n) AS deep, ARG_MAX(v, ROW(n, -v)) AS mode FROM d GROUP BY file)""",
        then="""SELECT h.file, COUNT(*) AS holes, COUNT(*) FILTER (WHERE hole = 'UNKNOWN') AS unread, SUM(known) AS strata, SUM(odd) AS odd, (COUNT(*) FILTER (WHERE hole = 'UNKNOWN') * 2 >= COUNT(*)) OR SUM(odd) / SUM(known) >= 0.3 OR BOOL_OR(deep >= 3 AND mode > 100 AND most >= deep * 0.6) AS anomalous FROM h JOIN m ON m.file = h.file GROUP BY h.file""",
    )
)
def extraction_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.strata(spark, sf_dir).select((F.col("borehole_id") % 50).alias("file"), F.when(F.col("borehole_id") % 3 == 0, F.lit("unknown ")).otherwise(F.col("borehole_id").cast("string")).alias("name"), "depth_top", "depth_bottom")
    return D.quality(rows, "file", "name")


@query(_with(T.HOLES, then="SELECT id, CASE WHEN id % 5 = 0 THEN 1.5 ELSE elevation END AS elevation, CASE WHEN id % 4 = 0 THEN 'renamed' ELSE name END AS name FROM holes"))
def patched_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = T.holes(spark, sf_dir)
    changes = h.select("id", F.when(F.col("id") % 5 == 0, F.lit(1.5)).alias("elevation"), F.when(F.col("id") % 4 == 0, F.lit("renamed")).alias("name"))
    return M.patched(h, changes, "id", ["elevation", "name"]).select("id", "elevation", "name")


@query(_with(T.LAYERS, then="SELECT borehole_id, l_partkey, CASE WHEN borehole_id % 10 = 0 THEN 1.0 ELSE thickness END AS thickness FROM layers"))
def replaced_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.layers(spark, sf_dir)
    return M.replaced(rows, rows.where("borehole_id % 10 = 0").withColumn("thickness", F.lit(1.0)), "borehole_id").select("borehole_id", "l_partkey", "thickness")


@query(_with(T.HOLES, then="SELECT id, deleted_at IS NOT NULL OR id % 6 = 0 AS gone FROM holes"))
def soft_deleted_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = T.holes(spark, sf_dir)
    return M.soft_deleted(h, h.where("id % 6 = 0"), "id", F.lit(T.STAMP).cast("timestamp_ntz")).select("id", F.col("deleted_at").isNotNull().alias("gone"))


@query("SELECT DISTINCT o_custkey AS borehole_id, o_orderkey % 20 AS project_id FROM orders")
def inserted_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = T.links(spark, sf_dir).select("borehole_id", "project_id")
    base = keys.where("borehole_id % 2 = 0").distinct()
    return M.inserted_if_new(base, keys, ["borehole_id", "project_id"])


@query(_with(T.HOLES, then="SELECT id, CASE WHEN id % 5 = 0 THEN 'third' WHEN id % 3 = 0 THEN 'second' ELSE 'first' END AS source, ROW_NUMBER() OVER (ORDER BY CASE WHEN id % 2 = 0 THEN 0 WHEN id % 3 = 0 THEN 1 ELSE 2 END, id) - 1 AS place FROM holes WHERE id % 2 = 0 OR id % 3 = 0 OR id % 5 = 0"))
def later_group_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three groups that share holes: the last says what a hole is, the first where it stands."""
    ids = T.holes(spark, sf_dir).select("id")
    groups = [ids.where(f"id % {n} = 0").withColumn("source", F.lit(name)) for n, name in ((2, "first"), (3, "second"), (5, "third"))]
    return M.union_later_wins(groups, "id")


@query(_with(T.HOLES, T.LINKS, then="SELECT DISTINCT borehole_id FROM links WHERE borehole_id NOT IN (SELECT id FROM holes WHERE deleted_at IS NULL)"))
def missing_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.missing_ids(T.links(spark, sf_dir), S.live(T.holes(spark, sf_dir)).select(F.col("id").alias("borehole_id")), "borehole_id")


@query(
    _with(
        T.HOLES, T.OBSERVATIONS,
        then="SELECT h.id AS borehole_id, 2.5 AS depth_bgl_m, h.elevation - 2.5 AS head_elevation_m FROM holes h WHERE h.id NOT IN (SELECT borehole_id FROM observations) AND h.id % 2 = 0",
    )
)
def backfilled_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = T.holes(spark, sf_dir)
    logs = h.select(F.col("id").alias("borehole_id"), F.lit(1).alias("ord"), F.when(F.col("id") % 2 == 0, F.lit("지하수위: GL(-) 2.5")).otherwise(F.lit("지하수위: N/A")).alias("raw_text"))
    depths = logs.select("borehole_id", "ord", groundwater.depth_in_text(F.col("raw_text")).alias("depth"))
    return M.backfilled(T.observations(spark, sf_dir), h, depths).select("borehole_id", "depth_bgl_m", "head_elevation_m")


# --- scalars


@query(
    """SELECT event_id, CASE WHEN d < 0 THEN NULL ELSE d END AS depth, COALESCE(h, e - d) AS head, d < 0 OR COALESCE(ABS(e - d - COALESCE(h, e - d)) > 0.25, FALSE) AS inconsistent FROM
 (SELECT event_id, CAST(100 AS DOUBLE) AS e, COALESCE(ABS(CASE WHEN event_id % 3 <> 0 THEN -value END), 100 - CASE WHEN event_id % 2 = 0 THEN value * 2 END) AS d, CASE WHEN event_id % 2 = 0 THEN value * 2 END AS h FROM events) WHERE d IS NOT NULL"""
)
def normalized_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    depth, head = F.when(F.col("event_id") % 3 != 0, -F.col("value")), F.when(F.col("event_id") % 2 == 0, F.col("value") * 2)
    rows = T.table(spark, sf_dir, "events").where(depth.isNotNull() | head.isNotNull()).select("event_id", groundwater.normalized(F.lit(100.0), depth, head).alias("g"))
    return rows.select("event_id", "g.depth", "g.head", "g.inconsistent")


@query("SELECT p_partkey, regexp_replace(upper(p_name || '-' || p_brand), '[^A-Z0-9]', '', 'g') AS key FROM part")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "part").select("p_partkey", names.duplicate_key(F.concat_ws("-", "p_name", "p_brand")).alias("key"))


@query("SELECT p_partkey, regexp_replace(lower(p_brand), '[0-9]+', '', 'g') || lpad(regexp_extract(p_brand, '[0-9]+'), 12, '0') AS key FROM part")
def natural_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "part").select("p_partkey", names.natural_key(F.col("p_brand")).alias("key"))


_RAW = "CASE p_partkey % 12 WHEN 0 THEN '매립층' WHEN 1 THEN ' 풍화토 (하부)' WHEN 2 THEN 'cl' WHEN 3 THEN '풍화암' WHEN 4 THEN '극경암층' WHEN 5 THEN 'SOIL' WHEN 6 THEN '연 암' WHEN 7 THEN '사질점토층' WHEN 8 THEN p_name WHEN 9 THEN '' WHEN 10 THEN '보통암' ELSE NULL END"


@query(
    """SELECT p_partkey, CASE p_partkey % 12 WHEN 0 THEN '매립토' WHEN 1 THEN '풍화토' WHEN 2 THEN '점토' WHEN 7 THEN '사질점토' END AS detail, CASE p_partkey % 12 WHEN 0 THEN 'soil' WHEN 1 THEN 'soil' WHEN 2 THEN 'soil' WHEN 3 THEN 'weathered_rock'
 WHEN 4 THEN 'hard_rock' WHEN 5 THEN 'soil' WHEN 6 THEN 'soft_rock' WHEN 7 THEN 'soil' WHEN 10 THEN 'normal_rock' ELSE 'unknown' END AS strata_group, CASE p_partkey % 12 WHEN 0 THEN '매립토' WHEN 1 THEN '풍화토' WHEN 2 THEN '점토' WHEN 3 THEN '풍화암'
 WHEN 4 THEN '경암' WHEN 5 THEN '토사' WHEN 6 THEN '연암' WHEN 7 THEN '사질점토' WHEN 8 THEN p_name WHEN 10 THEN '보통암' ELSE '미분류' END AS shown FROM part"""
)
def soil_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.table(spark, sf_dir, "part").withColumn("raw", F.expr(_RAW))
    return rows.select("p_partkey", names.soil_detail(F.col("raw")).alias("detail"), names.strata_group(F.col("raw")).alias("strata_group"), names.display_name(F.col("raw")).alias("shown"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE l_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN 1234.5 WHEN 3 THEN NULL ELSE l_quantity END AS value FROM lineitem")
def numbers_in_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_partkey") % 5
    cell = F.when(k == 0, F.lit("N/A")).when(k == 1, F.lit(" - ")).when(k == 2, F.lit("1,234.5")).when(k == 3, F.lit("NaN")).otherwise(F.col("l_quantity").cast("string"))
    return T.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", parse.number(cell).alias("value"))


@query(
    "SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'EPSG:5187' WHEN 1 THEN 'EPSG:5183' WHEN 2 THEN CASE WHEN p_size >= 25 THEN 'EPSG:5181' ELSE 'EPSG:5174' END WHEN 3 THEN 'EPSG:5176' WHEN 4 THEN 'EPSG:4326' WHEN 5 THEN 'EPSG:5186' END AS crs FROM part"
)
def systems_in_remarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = ("동부(60만,20만)", "동부 50만", "중부 50만", "동부 50만 베셀", "WGS84", "epsg 5186", "서부 60만", "2015년 시추")
    remark = F.get(F.array(*[F.lit(t) for t in texts]), (F.col("p_partkey") % 8).cast("int"))
    year = F.when(F.col("p_partkey") % 8 == 2, F.when(F.col("p_size") >= 25, F.lit("2003")).otherwise(F.lit("1992")))
    return T.table(spark, sf_dir, "part").select("p_partkey", parse.crs_hint(remark, year).alias("crs"))


@query(_with(T.HOLES, then="SELECT id, ROUND(longitude, 7) AS longitude, ROUND(latitude, 7) AS latitude FROM holes"))
def grid_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To the eastern belt and back: the place it was."""
    north, east = geodesy.to_grid(F.col("latitude"), F.col("longitude"), "EPSG:5187")
    back = T.holes(spark, sf_dir).withColumns({"n": north, "e": east})
    lat, lon = geodesy.grid_to_wgs84(F.col("n"), F.col("e"), "EPSG:5187")
    return back.select("id", F.round(lon, 7).alias("longitude"), F.round(lat, 7).alias("latitude"))


@query(_with(T.HOLES, then="SELECT id, ROUND(2 * 6371.0 * ASIN(SQRT(POWER(SIN(RADIANS(latitude - 35.0) / 2), 2) + COS(RADIANS(35.0)) * COS(RADIANS(latitude)) * POWER(SIN(RADIANS(longitude - 129.0) / 2), 2))), 6) AS km FROM holes"))
def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.holes(spark, sf_dir).select("id", F.round(geodesy.haversine_km(F.lit(35.0), F.lit(129.0), F.col("latitude"), F.col("longitude")), 6).alias("km"))


@query("SELECT l_partkey, MAX(t * t * (3 - 2 * t)) AS weight FROM (SELECT l_partkey, GREATEST(LEAST(l_quantity / 32.0 - 0.25, 1.0), 0.0) AS t FROM lineitem) GROUP BY l_partkey")
def presence_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.max(U.presence_weight(F.col("l_quantity") / 32.0 - 0.25)).alias("weight"))


# --- the plane


@query(_with(T.POINTS, then="SELECT a.key, b.key AS other FROM points a JOIN points b ON a.key < b.key AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 144"))
def pairs_within_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.pairs_within(T.points(spark, sf_dir), 12.0).select("key", "other")


@query(
    _with(
        T.POINTS,
        then="SELECT key, other, place FROM (SELECT a.key, b.key AS other, ROW_NUMBER() OVER (PARTITION BY a.key ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.key) AS place FROM points a JOIN points b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 900 WHERE a.key % 2 = 0 AND b.key % 2 = 1) WHERE place <= 4",
    )
)
def four_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.points(spark, sf_dir)
    return P.nearest_within(p.where("key % 2 = 0"), p.where("key % 2 = 1"), 30.0, 4).select("key", "other", "place")


@query(
    _with(
        T.POINTS,
        then="SELECT COUNT(*) FILTER (WHERE d = 0) AS exact_pairs, COUNT(*) AS near_pairs, COUNT(*) FILTER (WHERE apart) AS conflicting_near_pairs, COUNT(*) FILTER (WHERE apart AND d = 0) AS conflicting_exact_pairs FROM (SELECT (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d, ABS(a.z - b.z) > 0.0001 AS apart FROM points a JOIN points b ON a.key < b.key) WHERE d <= 400",
    )
)
def anchor_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.stability(T.points(spark, sf_dir), "z", near=20.0)


@query(
    "WITH RECURSIVE "
    + T.POINTS
    + """, e AS (SELECT a.key AS a, b.key AS b FROM points a JOIN points b ON a.key <> b.key AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 144), r AS (SELECT a AS key, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.key) SELECT key, MIN(root) AS cluster FROM r GROUP BY key"""
)
def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.clusters(T.points(spark, sf_dir), 12.0)


@query()
def merged_near_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.points(spark, sf_dir).withColumnRenamed("key", "id").withColumn("ord", F.col("id")).withColumn("n_strata", F.col("id") % 5)
    return P.merge_near(p.withColumnRenamed("z", "elevation").select("project", "ord", "id", "x", "y", "elevation", "n_strata"), 20.0)


@query(_with(T.POINTS, then="SELECT key, (x * 3.0 + y * 4.0) / 5.0 AS chainage, (y * 3.0 - x * 4.0) / 5.0 AS distance FROM points WHERE ABS((y * 3.0 - x * 4.0) / 5.0) <= 100 AND (x * 3.0 + y * 4.0) / 5.0 BETWEEN 0 AND 500"))
def points_on_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = P.onto_section(F.col("x"), F.col("y"), (0.0, 0.0), (300.0, 400.0), 100.0)
    return T.points(spark, sf_dir).withColumn("p", at).where("p IS NOT NULL").select("key", "p.chainage", "p.distance")


def _all_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.points(spark, sf_dir).select("project", F.lit("soil").alias("layer"), "x", "y", "z")


def _nodes(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    box = T.projects(spark, sf_dir).select(F.col("project_id").alias("project"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(1024.0).alias("x1"), F.lit(1024.0).alias("y1"))
    return U.grid(box, size)


@query(
    _with(
        T.POINTS,
        then="""SELECT p AS project, j, i, ROUND(COALESCE(MIN(z) FILTER (WHERE d = 0), SUM(z / NULLIF(d, 0)) / SUM(1 / NULLIF(d, 0))), 6) AS z FROM (SELECT n.p, n.j, n.i, a.z, (n.x - a.x) * (n.x - a.x) + (n.y - a.y) * (n.y - a.y) AS d FROM
 (SELECT CAST(n_nationkey AS BIGINT) AS p, CAST(j AS INTEGER) AS j, CAST(i AS INTEGER) AS i, i * 256.0 + 0.0 AS x, j * 256.0 + 0.0 AS y FROM nation, range(5) t(j), range(5) s(i)) n JOIN points a ON a.project = n.p) GROUP BY p, j, i""",
    )
)
def weighted_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels by distance from every point, and at a point's own place its value."""
    return U.distance_weighted(_nodes(spark, sf_dir, 5), _all_anchors(spark, sf_dir)).select("project", "j", "i", F.round("z", 6).alias("z"))


@query()
def thin_plate_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.thin_plate(_nodes(spark, sf_dir, 16), _all_anchors(spark, sf_dir))


@query(
    _with(
        T.POINTS,
        """m AS (SELECT project, AVG(x) AS mx, AVG(y) AS my FROM points GROUP BY project), r AS (SELECT p.project, p.key, p.x - mx AS x, p.y - my AS y FROM points p JOIN m ON m.project = p.project),
 a AS (SELECT CAST(k AS BIGINT) AS k, COS(-PI() + 2 * PI() * k / 12) AS dx, SIN(-PI() + 2 * PI() * k / 12) AS dy FROM range(12) t(k)),
 e AS (SELECT p.project, p.x AS px, p.y AS py, q.x - p.x AS ex, q.y - p.y AS ey FROM r p JOIN r q ON q.project = p.project AND p.key < q.key),
 h AS (SELECT project, k, ANY_VALUE(dx) AS dx, ANY_VALUE(dy) AS dy, MAX((px * ey - py * ex) / (dx * ey - dy * ex)) AS t FROM e, a WHERE ABS(dx * ey - dy * ex) > 1e-12 AND (px * dy - py * dx) / (dx * ey - dy * ex) BETWEEN -1e-9 AND 1 + 1e-9 GROUP BY project, k),
 o AS (SELECT h.project, -100 - k AS id, mx + 1.8 * t * dx AS x, my + 1.8 * t * dy AS y FROM h JOIN m ON m.project = h.project)""",
        then="SELECT o.project, o.id, ROUND(o.x, 5) AS x, ROUND(o.y, 5) AS y, ARG_MIN(p.key, ROW(POWER(o.x - p.x, 2) + POWER(o.y - p.y, 2), p.key)) AS copies FROM o JOIN points p ON p.project = o.project GROUP BY ALL",
    )
)
def phantom_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = U.phantoms(T.points(spark, sf_dir).withColumnRenamed("key", "id"))
    return out.withColumns({c: F.round(c, 5) for c in "xy"})


@query(
    ORACLE_SQL["phantom_points"].replace("WITH points AS", f"WITH {T.STRATA}, points AS").replace("SELECT o.project, o.id, ROUND(o.x, 5) AS x", "SELECT f.project, f.id, 'PHANTOM-' || CAST(-f.id - 99 AS VARCHAR) AS name, depth_top, depth_bottom, soil_type FROM (SELECT o.project, o.id, ROUND(o.x, 5) AS x")
    + ") f JOIN strata ON borehole_id = copies"
)
def phantom_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strata that phantom points bring along from the hole that each copies."""
    strata = T.strata(spark, sf_dir).withColumn("strata_group", F.lit("soil"))
    points = U.phantoms(T.points(spark, sf_dir).withColumnRenamed("key", "id"))
    return U.phantom_strata(points, strata).select("project", "id", "name", "depth_top", "depth_bottom", "soil_type")


@query(
    _with(
        T.STRATA,
        then="""SELECT h.borehole_id AS id, l.layer, -COALESCE(own.t, above.b, 0.0) AS z FROM (SELECT DISTINCT borehole_id FROM strata) h CROSS JOIN (VALUES ('soil', 1), ('weathered_rock', 2), ('soft_rock', 3), ('normal_rock', 4), ('hard_rock', 5)) l(layer, n)
 LEFT JOIN (SELECT borehole_id, k, MIN(depth_top) AS t FROM (SELECT *, CASE soil_type WHEN 'A' THEN 1 WHEN 'N' THEN 3 ELSE 5 END AS k FROM strata) GROUP BY borehole_id, k) own ON own.borehole_id = h.borehole_id AND own.k = l.n
 LEFT JOIN (SELECT x.borehole_id, y.n, ARG_MAX(x.b, x.k) AS b FROM (SELECT borehole_id, k, ARG_MIN(depth_bottom, ROW(depth_top, depth_bottom)) AS b FROM (SELECT *, CASE soil_type WHEN 'A' THEN 1 WHEN 'N' THEN 3 ELSE 5 END AS k FROM strata) GROUP BY borehole_id, k) x JOIN range(1, 6) y(n) ON x.k < y.n GROUP BY x.borehole_id, y.n) above ON above.borehole_id = h.borehole_id AND above.n = l.n""",
    )
)
def layer_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = F.when(F.col("soil_type") == "A", F.lit("soil")).when(F.col("soil_type") == "N", F.lit("soft_rock")).otherwise(F.lit("hard_rock"))
    s = T.strata(spark, sf_dir).withColumn("strata_group", group)
    holes = s.select(F.col("borehole_id").alias("id")).distinct().select(F.lit(0).alias("project"), "id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("elevation"))
    return U.contacts(holes, s).select("id", "layer", F.round("z", 6).alias("z"))


@query("SELECT l_orderkey AS project, CAST(l AS INTEGER) AS l, CASE WHEN l > 12 THEN 0 WHEN l > q1 THEN 1 WHEN l > q2 THEN 2 ELSE 3 END AS label FROM (SELECT l_orderkey, MAX(l_quantity) / 5 AS q1, MIN(l_quantity) / 25 AS q2 FROM lineitem GROUP BY l_orderkey), range(16) t(l)")
def voxel_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("project")).agg((F.max("l_quantity") / 5).alias("q1"), (F.min("l_quantity") / 25).alias("q2"))
    c = c.withColumns({"j": F.lit(0), "i": F.lit(0), "low": F.lit(0.0), "step": F.lit(1.0), "count": F.lit(16), "ground": F.lit(12.0)})
    return U.voxels(c, "low", "step", "count", "ground", ["q1", "q2"]).select("project", "l", "label")


# --- streams


@query("SELECT event_type, COUNT(*) AS n FROM events GROUP BY event_type")
def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


# --- coordinates, models and pages


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'EPSG:5187' ELSE 'EPSG:5186' END AS crs, CASE WHEN c_custkey % 3 = 0 THEN 'yx' ELSE 'xy' END AS reading FROM customer")
def readings_of_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in the south-east on their own belt, and in the west on the other, some with their numbers exchanged."""
    c = T.table(spark, sf_dir, "customer")
    east = F.col("c_custkey") % 2 == 0
    lat, lon = F.lit(35.15), F.when(east, F.lit(129.05)).otherwise(F.lit(126.95))
    grid = {code: geodesy.to_grid(lat, lon, code) for code in ("EPSG:5187", "EPSG:5186")}
    c = c.withColumns({"n": F.when(east, grid["EPSG:5187"][0]).otherwise(grid["EPSG:5186"][0]), "e": F.when(east, grid["EPSG:5187"][1]).otherwise(grid["EPSG:5186"][1])})
    swapped = F.col("c_custkey") % 3 == 0
    c = c.withColumns({"x": F.when(swapped, F.col("n")).otherwise(F.col("e")), "y": F.when(swapped, F.col("e")).otherwise(F.col("n"))})
    codes = ("EPSG:5187", "EPSG:5186")
    in_east = C.best_by_region(c.where(east), "x", "y", (129.0, 35.1, 129.1, 35.2), (128.5, 34.5, 129.5, 35.5), codes)
    in_west = C.best_by_region(c.where(~east), "x", "y", (126.9, 35.1, 127.0, 35.2), (126.5, 34.5, 127.5, 35.5), codes)
    return in_east.unionByName(in_west).select("c_custkey", "crs", "reading")


@query(_with(T.POINTS, then="SELECT key, 2 * x + 3 * y AS z FROM points WHERE x BETWEEN 0 AND 1024 AND y BETWEEN 0 AND 1024"))
def sampled_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An even grid of a plane gives the plane between its nodes."""
    p = T.points(spark, sf_dir).select("key", "project", "x", "y")
    boxes = T.projects(spark, sf_dir).select(F.col("project_id").alias("project"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(64.0).alias("dx"), F.lit(64.0).alias("dy"), F.lit(17).alias("columns"), F.lit(17).alias("rows"))
    grid = _nodes(spark, sf_dir, 17).withColumn("z", F.col("x") * 2 + F.col("y") * 3)
    return N.sampled(p, grid.drop("x", "y"), boxes).select("key", "z")


@query(
    _with(
        T.STRATA,
        "p AS (SELECT borehole_id AS id, COALESCE(SUM(thickness) FILTER (WHERE soil_type = 'A'), 0.0) AS a, COALESCE(SUM(thickness) FILTER (WHERE soil_type = 'N'), 0.0) AS n, COALESCE(SUM(thickness) FILTER (WHERE soil_type = 'R'), 0.0) AS r FROM strata GROUP BY borehole_id)",
        then="SELECT id, 'soil' AS layer, 500.0 - a AS z FROM p WHERE a > 0 UNION ALL SELECT id, 'soft_rock', 500.0 - a - n FROM p WHERE n > 0 UNION ALL SELECT id, 'hard_rock', 500.0 - a - n - r FROM p WHERE r > 0",
    )
)
def boundary_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = A.thickness_by(T.strata(spark, sf_dir), "borehole_id", "soil_type", ["A", "N", "R"])
    profiles = wide.select(F.col("borehole_id").alias("id"), F.lit(0).alias("project"), F.lit(500.0).alias("surface"), F.col("A").alias("soil"), F.lit(0.0).alias("weathered_rock"), F.col("N").alias("soft_rock"), F.lit(0.0).alias("normal_rock"), F.col("R").alias("hard_rock"))
    return N.boundary_targets(profiles).select("id", "layer", "z")


@query(
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN a + b > 0.001 THEN a / (a + b) WHEN c > 0.001 THEN 0.0 ELSE 0.0 END AS first_share, CASE WHEN a + b > 0.001 THEN b / (a + b) ELSE 1.0 END AS last_share
 FROM (SELECT *, GREATEST(l_quantity - 40, 0) AS a, GREATEST(l_quantity - 45, 0) AS b, 0.0 AS c FROM lineitem)"""
)
def extension_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, last = N.extension_weights([F.col("l_quantity") - 40, F.col("l_quantity") - 45], [F.lit(0.0), F.lit(0.0)])
    return T.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", first.alias("first_share"), last.alias("last_share"))


@query(
    _with(
        T.POINTS,
        then="SELECT project, CAST(ROW_NUMBER() OVER (PARTITION BY project ORDER BY v) - 1 AS INTEGER) AS place, v AS at_value FROM (SELECT project, x AS v FROM points WHERE x BETWEEN 0 AND 512 UNION SELECT CAST(n_nationkey AS BIGINT), k * 64.0 FROM nation, range(9) t(k))",
    )
)
def constrained_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = T.projects(spark, sf_dir).select(F.col("project_id").alias("project"), F.lit(0.0).alias("lo"), F.lit(512.0).alias("hi"))
    return N.constrained_axis(T.points(spark, sf_dir).select("project", F.col("x").alias("at")), bounds, 9).withColumnRenamed("at", "at_value")


@query(
    "SELECT s_suppkey AS tri, 0.0 AS ax, CAST(s_suppkey AS DOUBLE) / 2 AS ay, 1.0 AS az, 0.0 AS bx, CAST(s_suppkey AS DOUBLE) / 2 AS by_, 3.0 AS bz FROM supplier"
)
def section_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles over the plane x = 0, each cut halfway up two of its edges."""
    k = F.col("s_suppkey").cast("double")
    corners = {"x0": F.lit(-1.0), "y0": F.lit(0.0), "z0": F.lit(0.0), "x1": F.lit(1.0), "y1": k, "z1": F.lit(2.0), "x2": F.lit(-1.0), "y2": F.lit(0.0), "z2": F.lit(4.0)}
    triangles = T.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("tri"), *[c.alias(n) for n, c in corners.items()])
    return N.cut_triangles(triangles, (1.0, 0.0, 0.0), 0.0).withColumnRenamed("by", "by_")


_CELLS = "'| BH-' || CAST(p_partkey AS STRING) || ' | ' || p_name || ' | |'"


@query("SELECT p_partkey AS line_no, 'BH-' || CAST(p_partkey AS VARCHAR) AS first, p_name AS second, CAST(3 AS BIGINT) AS n FROM part WHERE p_partkey % 3 = 0")
def pipe_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("p_partkey") % 3 == 0, F.expr(_CELLS)).when(F.col("p_partkey") % 3 == 1, F.lit("|---|:--:|")).otherwise(F.col("p_name"))
    lines = T.table(spark, sf_dir, "part").select(F.lit("d").alias("doc"), F.col("p_partkey").alias("line_no"), text.alias("text"))
    return DOC.pipe_rows(lines).select("line_no", F.get("cells", F.lit(0)).alias("first"), F.get("cells", F.lit(1)).alias("second"), F.size("cells").cast("long").alias("n"))


@query(
    _with(
        T.LAYERS,
        then="SELECT soil_type AS upper, below AS lower, COUNT(*) AS n FROM (SELECT soil_type, LEAD(soil_type) OVER (PARTITION BY borehole_id ORDER BY l_linenumber, l_partkey, l_suppkey, thickness, soil_type) AS below FROM layers) WHERE below <> soil_type GROUP BY soil_type, below",
    )
)
def soil_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.layers(spark, sf_dir).withColumn("place", F.struct(*ORDER))
    return DOC.precedence(rows, "borehole_id", "place", "soil_type")


@query("SELECT n_name AS name, CAST(ROW_NUMBER() OVER (ORDER BY n_regionkey, n_nationkey) - 1 AS INTEGER) AS place FROM nation")
def ordered_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain through each region, regions by rank: the order that both keep."""
    n = T.table(spark, sf_dir, "nation")
    chain = n.alias("a").join(n.alias("b"), F.expr("a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")).select(F.col("a.n_name").alias("upper"), F.col("b.n_name").alias("lower"))
    return DOC.topological(chain, n.select(F.col("n_name").alias("name"), (F.col("n_regionkey") * 100 + F.col("n_nationkey")).alias("rank")))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 <> 1 THEN 'existing' WHEN o_orderkey % 3 = 0 THEN 'manual' ELSE 'upload-' || CAST(o_orderkey % 7 AS VARCHAR) END AS grp FROM orders")
def holes_by_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.links(spark, sf_dir).select("id", "project_role", F.col("id").alias("ord"), F.when(F.col("id") % 3 != 0, F.col("id") % 7).alias("job"))
    return DOC.by_upload(rows).select("id", F.col("group").alias("grp"))


@query(
    _with(
        T.STRATA,
        then="SELECT borehole_id, MAX(depth_bottom) / 10 AS deepest FROM strata GROUP BY borehole_id",
    )
)
def repaired_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bottoms in tenths, all but the last with their point: nothing contradicts them, so all stay."""
    rows = T.strata(spark, sf_dir).select("borehole_id", (F.col("depth_bottom") / 10).alias("d")).distinct().withColumn("ord", F.col("d"))
    return DOC.repaired_depths(rows, HOLE, "ord", "d").groupBy("borehole_id").agg(F.max("d").alias("deepest"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'EL' WHEN 1 THEN 'GL' WHEN 2 THEN 'GL' ELSE 'unknown' END AS datum, CAST(ROUND(LEAST(0.75 + CASE WHEN value <= 3 THEN 0.15 ELSE 0 END + CASE WHEN event_id % 2 = 0 THEN 0.08 ELSE 0 END + CASE WHEN event_id % 3 = 0 THEN 0.02 ELSE 0 END, 1.0), 2) AS DOUBLE) AS confidence FROM events")
def label_confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.get(F.array(*[F.lit(u) for u in ("EL. m", "(GL - m)", "-m", "m")]), (F.col("event_id") % 4).cast("int"))
    confidence = DOC.label_confidence(F.col("value"), F.col("event_id") % 2 == 0, F.col("event_id") % 3 == 0)
    return T.table(spark, sf_dir, "events").select("event_id", DOC.datum_of(unit).alias("datum"), confidence.alias("confidence"))


from terrakern.plans import batches, further, grounds, lands, requests, scanned, streams  # noqa: E402, F401  more queries, registered here
