"""The driver's tables read as the domain's: holes, strata, revisions, observations, links. Each has its SQL beside it.

customer is read as holes and nation as projects, lineitem as strata (an order is a hole, a quantity a thickness, a flag a soil),
events as revisions and observations, orders as links between projects and holes. Fractions are such that doubles hold them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrakern.operators.materialise import dealt

STAMP = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("id"),
        F.col("c_nationkey").cast("long").alias("project_id"),
        F.col("c_name").alias("name"),
        F.col("c_acctbal").alias("elevation"),
        (F.lit(126.0) + (key % 97) * F.lit(0.03125)).alias("longitude"),
        (F.lit(34.0) + (key % 61) * F.lit(0.0625)).alias("latitude"),
        (F.col("c_mktsegment") == "BUILDING").alias("is_supplementary"),
        F.when(key % 19 == 0, F.lit(STAMP).cast("timestamp_ntz")).alias("deleted_at"),
    )


HOLES = f"""holes AS (SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS project_id, c_name AS name, c_acctbal AS elevation,
 CAST(126 AS DOUBLE) + (c_custkey % 97) * CAST(0.03125 AS DOUBLE) AS longitude, CAST(34 AS DOUBLE) + (c_custkey % 61) * CAST(0.0625 AS DOUBLE) AS latitude,
 c_mktsegment = 'BUILDING' AS is_supplementary, CASE WHEN c_custkey % 19 = 0 THEN TIMESTAMP '{STAMP}' END AS deleted_at FROM customer)"""

KEY = ["l_linenumber", "l_partkey", "l_suppkey"]
ORDER = [*KEY, "thickness", "soil_type"]


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thicknesses in order."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("borehole_id"), *KEY, F.col("l_quantity").alias("thickness"), F.col("l_returnflag").alias("soil_type"))


LAYERS = "layers AS (SELECT l_orderkey AS borehole_id, l_linenumber, l_partkey, l_suppkey, l_quantity AS thickness, l_returnflag AS soil_type FROM lineitem)"


def strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals, the thicknesses added up."""
    w = Window.partitionBy("borehole_id").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    rows = dealt(layers(spark, sf_dir), "borehole_id").withColumn("depth_bottom", F.sum("thickness").over(w))
    return rows.withColumn("depth_top", F.col("depth_bottom") - F.col("thickness"))


STRATA = LAYERS + """, strata AS (SELECT *, depth_bottom - thickness AS depth_top FROM (SELECT *, SUM(thickness) OVER (PARTITION BY borehole_id
 ORDER BY l_linenumber, l_partkey, l_suppkey, thickness, soil_type ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS depth_bottom FROM layers))"""


def logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals as a careless log has them: a discount moves tops up, so neighbours overlap; one in seven leaves a gap."""
    lift = F.when(F.col("l_partkey") % 3 == 0, F.lit(2.0)).when(F.col("l_partkey") % 7 == 0, F.lit(-1.0)).otherwise(F.lit(0.0))
    return strata(spark, sf_dir).withColumn("depth_top", F.col("depth_top") - lift)


LOGGED = STRATA + ", logged AS (SELECT * REPLACE (depth_top - CASE WHEN l_partkey % 3 = 0 THEN 2.0 WHEN l_partkey % 7 = 0 THEN -1.0 ELSE 0.0 END AS depth_top) FROM strata)"


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    payload = F.replace("props", F.lit('"k"'), F.when(F.col("event_id") % 2 == 0, F.lit('"elevation"')).otherwise(F.lit('"groundwater_depth_bgl_m"')))
    gone = F.when(F.col("event_type") == "error", F.lit(STAMP).cast("timestamp_ntz"))
    return e.select(F.col("user_id").alias("borehole_id"), F.col("event_id").alias("version"), payload.alias("payload"), gone.alias("deleted_at"))


REVISIONS = f"""revisions AS (SELECT user_id AS borehole_id, event_id AS version, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
 event_id % 2 = 0 AS sets_elevation, CASE WHEN event_type = 'error' THEN TIMESTAMP '{STAMP}' END AS deleted_at FROM events)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    status = F.get(F.array(*[F.lit(s) for s in ("confirmed", "auto", "needs_review", "rejected", "odd")]), (F.col("event_id") % 5).cast("int"))
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("borehole_id"), status.alias("review_status"),
        F.when(F.col("event_id") % 3 != 0, F.col("ts")).alias("observed_at"), F.col("ts").alias("created_at"),
        F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("depth_bgl_m"), F.lit(None).cast("double").alias("head_elevation_m"), F.lit(None).cast("timestamp_ntz").alias("deleted_at"),
    )


OBSERVATIONS = """observations AS (SELECT event_id AS id, user_id AS borehole_id, CASE event_id % 5 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'auto' WHEN 2 THEN 'needs_review'
 WHEN 3 THEN 'rejected' ELSE 'odd' END AS review_status, CASE WHEN event_id % 3 <> 0 THEN ts END AS observed_at, ts AS created_at,
 CASE WHEN event_id % 4 <> 0 THEN value END AS depth_bgl_m FROM events)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.get(F.array(*[F.lit(s) for s in ("existing", "new", "duplicate_linked", "excluded")]), (F.col("o_orderkey") % 4).cast("int"))
    gone = F.when(F.col("o_orderstatus") == "F", F.lit(STAMP).cast("timestamp_ntz"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 20).alias("project_id"), F.col("o_custkey").alias("borehole_id"), role.alias("project_role"), gone.alias("deleted_at"))


LINKS = f"""links AS (SELECT o_orderkey AS id, o_orderkey % 20 AS project_id, o_custkey AS borehole_id, CASE o_orderkey % 4 WHEN 0 THEN 'existing' WHEN 1 THEN 'new'
 WHEN 2 THEN 'duplicate_linked' ELSE 'excluded' END AS project_role, CASE WHEN o_orderstatus = 'F' THEN TIMESTAMP '{STAMP}' END AS deleted_at FROM orders)"""


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("project_id"), F.col("n_name").alias("project"))


PROJECTS = "projects AS (SELECT CAST(n_nationkey AS BIGINT) AS project_id, n_name AS project FROM nation)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and customers as points in metres, many at one place."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(key.alias("key"), ((key * 37) % 1009).cast("double").alias("x"), ((key * 53) % 997).cast("double").alias("y"), F.col("c_acctbal").alias("z"), F.col("c_nationkey").cast("long").alias("project"))


POINTS = "points AS (SELECT c_custkey AS key, CAST((c_custkey * 37) % 1009 AS DOUBLE) AS x, CAST((c_custkey * 53) % 997 AS DOUBLE) AS y, c_acctbal AS z, CAST(c_nationkey AS BIGINT) AS project FROM customer)"
