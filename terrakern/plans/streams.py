"""Queries that drain a stream and give what it has come to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrakern.operators import modelling as N
from terrakern.operators.materialise import folder
from terrakern.plans import standins as T
from terrakern.plans.lands import _vertices
from terrakern.plans.registry import query
from terrakern.sources import lines as L
from terrakern.streaming import jobs as J

_ACTION = "(['submit', 'start', 'finish', 'fail', 'start', 'odd'])[CAST((event_id * 7 + user_id) % 6 AS INTEGER) + 1]"


@query(
    f"""WITH RECURSIVE e AS (SELECT user_id AS job, event_id AS seq, {_ACTION} AS action, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
 s AS (SELECT DISTINCT job, CAST(0 AS BIGINT) AS k, CAST(-1 AS BIGINT) AS applied, 'none' AS state, CAST(0 AS BIGINT) AS attempts, CAST(0 AS BIGINT) AS refused FROM e UNION ALL
 SELECT e.job, e.k, e.seq, CASE WHEN ok THEN CASE action WHEN 'submit' THEN 'queued' WHEN 'start' THEN 'running' WHEN 'finish' THEN 'done' ELSE 'failed' END ELSE state END, attempts + CASE WHEN ok AND action = 'submit' THEN 1 ELSE 0 END, refused + CASE WHEN ok THEN 0 ELSE 1 END
 FROM (SELECT e.*, s.state, s.attempts, s.refused, CASE action WHEN 'submit' THEN s.state IN ('none', 'done', 'failed') WHEN 'start' THEN s.state = 'queued' WHEN 'finish' THEN s.state = 'running' WHEN 'fail' THEN s.state IN ('queued', 'running') ELSE FALSE END AS ok FROM s JOIN e ON e.job = s.job AND e.k = s.k + 1) e)
 SELECT job, applied, state, attempts, refused FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY job ORDER BY k DESC) AS n FROM s) WHERE n = 1"""
)
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of files, read to its end: each user's job after all of its events."""
    schema = T.table(spark, sf_dir, "events").schema
    at, kept = F.col("event_id") * 7 + F.col("user_id"), folder(spark, "jobs")
    action = F.get(F.array(*[F.lit(a) for a in ("submit", "start", "finish", "fail", "start", "odd")]), (at % 6).cast("int"))
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    rows = J.job_states(events.select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), action.alias("action")))
    rows.writeStream.format("parquet").option("checkpointLocation", f"{kept}/log").option("path", f"{kept}/rows").trigger(availableNow=True).start().awaitTermination()
    last = F.max_by(F.struct("applied", "state", "attempts", "refused"), "applied")
    return spark.read.schema(J.ROW).parquet(f"{kept}/rows").groupBy("job").agg(last.alias("l")).select("job", "l.*")


@query(
    "WITH RECURSIVE "
    + T.POINTS
    + """, a AS (SELECT project, list_sort(list_distinct(list(x))) AS s, CAST(400 + project * 3 AS BIGINT) AS target FROM points GROUP BY project), r AS (SELECT project, s, target FROM a UNION ALL
 SELECT project, s[:k] || [(s[k] + s[k + 1]) / 2] || s[k + 1:], target FROM (SELECT *, list_position(g, list_max(g)) AS k FROM (SELECT *, list_transform(range(1, len(s)), lambda i: s[i + 1] - s[i]) AS g FROM r WHERE len(s) < target)))
 SELECT project, CAST(UNNEST(range(len(s))) AS INTEGER) AS place, UNNEST(s) AS at_value FROM (SELECT project, s, ROW_NUMBER() OVER (PARTITION BY project ORDER BY len(s) DESC) AS n FROM r) WHERE n = 1"""
)
def padded_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axes of all points of a project, filled up to a length by halving the widest gaps."""
    axis = T.points(spark, sf_dir).select("project", F.col("x").alias("at")).distinct()
    lengths = T.projects(spark, sf_dir).select(F.col("project_id").alias("project"), (F.lit(400) + F.col("project_id") * 3).alias("target"))
    return N.padded_axis(axis, lengths).select("project", "place", F.col("at").alias("at_value"))


def _rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.sort_array(F.collect_list(F.struct("seq", F.array("x", "y").alias("p"))))
    return _vertices(spark, sf_dir).groupBy("region", "part", "ring").agg(F.transform(listed, lambda v: v["p"]).alias("points"))


@query()
def thinned_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All regions' rings with the points that a tolerance of 25 keeps."""
    return L.thinned_rings(_rings(spark, sf_dir), 25.0).select("region", "part", "ring", "points")
