"""Queries on tables of polygons: membership, waters' levels, classes of cells, the sea bed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrakern.operators import regions as R
from terrakern.plans import standins as T
from terrakern.plans.registry import query

#: Of the stand-in's polygons: customers are vertices, 25 regions of them on a lattice; metres are about 1e-5 degrees.
WEST, SOUTH, UNIT = 127.0, 35.0, 1e-5


def _vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A star-shaped ring of each region's customers, from the corner of a square on; every other region has a hole of the same shape."""
    c = T.table(spark, sf_dir, "customer").select((F.col("c_custkey") % 25).alias("region"), F.floor(F.col("c_custkey") / 25).alias("seq"), F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("z"))
    c = c.join(c.groupBy("region").agg(F.count(F.lit(1)).alias("n")), "region").withColumn("t", F.col("seq") * 4.0 / F.col("n"))
    side = F.floor("t")
    f = (F.col("t") - side) * 2 - 1
    at = lambda a, b, c_, d: F.when(side == 0, a).when(side == 1, b).when(side == 2, c_).otherwise(d)
    one = F.lit(1.0)
    c = c.withColumns({"dx": at(-f, -one, f, one), "dy": at(one, -f, -one, f), "r": 120.0 + (F.col("k") * 7919) % 83})
    c = c.withColumn("ring", F.explode(F.when(F.col("region") % 2 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    scale = F.col("r") * F.when(F.col("ring") == 0, 1.0).otherwise(0.375)
    return c.select("region", F.lit(0).alias("part"), "ring", "seq", ((F.col("region") % 5) * 200 + 100 + scale * F.col("dx")).alias("x"), (F.floor(F.col("region") / 5) * 200 + 100 + scale * F.col("dy")).alias("y"), "z")


_VERTICES = """n AS (SELECT c_custkey % 25 AS region, COUNT(*) AS n FROM customer GROUP BY 1), t AS (SELECT c_custkey % 25 AS region, c_custkey // 25 AS seq, n, c_acctbal AS z, 120.0::DOUBLE + (c_custkey * 7919) % 83 AS r, (c_custkey // 25) * 4.0::DOUBLE / n AS t FROM customer JOIN n ON region = c_custkey % 25),
 u AS (SELECT *, CAST(floor(t) AS BIGINT) AS side, (t - floor(t)) * 2 - 1 AS f FROM t), d AS (SELECT *, CASE side WHEN 0 THEN -f WHEN 1 THEN -1 WHEN 2 THEN f ELSE 1 END AS dx, CASE side WHEN 0 THEN 1 WHEN 1 THEN -f WHEN 2 THEN -1 ELSE f END AS dy FROM u),
 v AS (SELECT region, ring, seq, n, z, (region % 5) * 200 + 100 + r * CASE WHEN ring = 0 THEN 1.0::DOUBLE ELSE 0.375::DOUBLE END * dx AS x, (region // 5) * 200 + 100 + r * CASE WHEN ring = 0 THEN 1.0::DOUBLE ELSE 0.375::DOUBLE END * dy AS y FROM d, (VALUES (0), (1)) g(ring) WHERE ring = 0 OR region % 2 = 0)"""


def _edges(vertices: str, name: str) -> str:
    return f"{name} AS (SELECT a.region, a.ring, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM {vertices} a JOIN {vertices} b ON b.region = a.region AND b.ring = a.ring AND b.seq = (a.seq + 1) % a.n)"


def _held(points: str, edges: str, name: str) -> str:
    """CTE of (key, region): points (key, x, y) held against all edges."""
    crossed = "SUM(CASE WHEN (y0 > y) <> (y1 > y) AND x < (x1 - x0) * (y - y0) / (y1 - y0) + x0 THEN 1 ELSE 0 END) % 2"
    return f"{name} AS (SELECT key, region FROM (SELECT key, region, ring, {crossed} AS odd FROM {points} CROSS JOIN {edges} GROUP BY key, region, ring) GROUP BY key, region HAVING MAX(CASE WHEN ring = 0 THEN odd END) = 1 AND COALESCE(MAX(CASE WHEN ring > 0 THEN odd END), 0) = 0)"


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return T.table(spark, sf_dir, "orders").select(key.alias("key"), ((key * 37) % 1009 + (F.col("o_custkey") % 8) * 0.125).alias("x"), ((key * 53) % 997).cast("double").alias("y"))


_PLACES = "places AS (SELECT o_orderkey AS key, (o_orderkey * 37) % 1009 + (o_custkey % 8) * 0.125::DOUBLE AS x, CAST((o_orderkey * 53) % 997 AS DOUBLE) AS y FROM orders)"


@query(f"WITH {_VERTICES}, {_edges('v', 'e')}, {_PLACES}, {_held('places', 'e', 'h')} SELECT key, region FROM h")
def regions_of_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place in every polygon of the table that holds it."""
    return R.regions_of(_places(spark, sf_dir), R.cover(_vertices(spark, sf_dir))).select("key", "region")


_LEVELS = """w AS (SELECT region, CASE WHEN region % 3 = 0 THEN region * 1.5::DOUBLE END AS own, median(z) AS middle FROM v WHERE ring = 0 AND seq % GREATEST(n // 64, 1) = 0 GROUP BY region), levels AS (SELECT region, COALESCE(own, middle) AS level FROM w)"""


def _levels(spark: SparkSession, sf_dir: str, vertices: DataFrame) -> DataFrame:
    own = vertices.select("region").distinct().withColumn("level", F.when(F.col("region") % 3 == 0, F.col("region") * 1.5))
    return R.water_levels(own, vertices)


@query(f"WITH {_VERTICES}, {_edges('v', 'e')}, {_PLACES}, {_held('places', 'e', 'h')}, {_LEVELS} SELECT key, MIN(level) AS level FROM h JOIN levels ON levels.region = h.region GROUP BY key")
def water_levels_at_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lowest of the waters that hold a place, those of no known level at their shore's median."""
    v = _vertices(spark, sf_dir)
    return R.water_at(_places(spark, sf_dir), R.cover(v), _levels(spark, sf_dir, v))


def _in_degrees(df: DataFrame) -> DataFrame:
    return df.withColumns({"x": F.col("x") * UNIT + WEST, "y": F.col("y") * UNIT + SOUTH})


def _degrees(c: str, start: float) -> str:
    return f"{c} * {UNIT!r}::DOUBLE + {start!r}::DOUBLE AS {c}"


_DEGREES = f"vd AS (SELECT region, ring, seq, n, z, {_degrees('x', WEST)}, {_degrees('y', SOUTH)} FROM v), land AS (SELECT * FROM vd WHERE region % 2 = 0), inland AS (SELECT * FROM vd WHERE region % 5 = 1)"
#: Moves a place by metres in degrees.
_EAST, _NORTH = "/ (111320.0::DOUBLE * GREATEST(0.1, COS(y * PI() / 180)))", "/ 110540.0::DOUBLE"
_NINE = "(VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (-1, 1), (1, -1), (-1, -1)) nine(a, b)"


def _near_land(points: str, metres: float, name: str) -> str:
    """CTEs; `name` has the keys of places on land or so near to it."""
    return f"{name}_s AS (SELECT {{'k': key, 's': 10 * a + b}} AS key, x + a * {metres!r}::DOUBLE {_EAST} AS x, y + b * {metres!r}::DOUBLE {_NORTH} AS y FROM {points}, {_NINE}), {_held(name + '_s', 'el', name + '_h')}, {name} AS (SELECT DISTINCT key.k AS key FROM {name}_h)"


_SHIPS = f"ships AS (SELECT s_suppkey AS key, ((s_suppkey * 379) % 1201 - 100) * {UNIT!r}::DOUBLE + {WEST!r}::DOUBLE AS x, ((s_suppkey * 211) % 1193 - 100) * {UNIT!r}::DOUBLE + {SOUTH!r}::DOUBLE AS y, s_acctbal AS z FROM supplier)"


def _ships(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return _in_degrees(T.table(spark, sf_dir, "supplier").select(key.alias("key"), ((key * 379) % 1201 - 100).alias("x"), ((key * 211) % 1193 - 100).alias("y"), F.col("s_acctbal").alias("z")))


def _covers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, R.Cover, R.Cover]:
    v = _in_degrees(_vertices(spark, sf_dir))
    inland = v.where("region % 5 = 1")
    return inland, R.cover(inland), R.cover(v.where("region % 2 = 0"))


@query(
    f"""WITH {_VERTICES}, {_DEGREES}, {_edges('inland', 'ei')}, {_edges('land', 'el')}, {_SHIPS}, {_held('ships', 'ei', 'hi')}, {_LEVELS}, wet AS (SELECT key, MIN(level) AS level FROM hi JOIN levels ON levels.region = hi.region GROUP BY key), {_near_land('ships', 5.0, 'dry')}
 SELECT s.key, CASE WHEN wet.key IS NOT NULL THEN 'inland' WHEN dry.key IS NOT NULL THEN 'land' ELSE 'sea' END AS kind, CASE WHEN wet.key IS NOT NULL THEN wet.level WHEN dry.key IS NULL THEN 0.0 END AS level FROM ships s LEFT JOIN wet ON wet.key = s.key LEFT JOIN dry ON dry.key = s.key"""
)
def classes_of_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inland water before land with its margin before the sea."""
    v, inland, land = _covers(spark, sf_dir)
    return R.classed_cells(_ships(spark, sf_dir), inland, _levels(spark, sf_dir, v), land)


@query(
    f"""WITH {_VERTICES}, {_DEGREES}, {_edges('land', 'el')}, {_SHIPS}, {_near_land('ships', 2.0, 'dry')}, ring AS (SELECT {{'k': key, 'r': r, 'd': 100 * a + b}} AS key, x + a * r {_EAST} AS x, y + b * r {_NORTH} AS y FROM ships,
 (VALUES (5), (10), (20), (40), (80), (160), (320)) g(r), (VALUES (1.0::DOUBLE, 0.0::DOUBLE), (-1, 0), (0, 1), (0, -1), (0.7071, 0.7071), (-0.7071, 0.7071), (0.7071, -0.7071), (-0.7071, -0.7071)) h(a, b) WHERE key NOT IN (SELECT key FROM dry)), {_near_land('ring', 2.0, 'close')},
 least AS (SELECT key.k AS key, MIN(key.r) AS radius FROM close GROUP BY key.k) SELECT s.key, CASE WHEN dry.key IS NOT NULL THEN 0 ELSE radius END AS radius, ROUND(CASE WHEN dry.key IS NOT NULL THEN z ELSE LEAST(z, -COALESCE(LEAST(16.0, 0.75 + radius * 0.045::DOUBLE), 16.0)) END, 6) AS z
 FROM ships s LEFT JOIN dry ON dry.key = s.key LEFT JOIN least ON least.key = s.key"""
)
def sea_bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terrain for display: below the sea by the distance of the land."""
    _, _, land = _covers(spark, sf_dir)
    return R.shown_terrain(_ships(spark, sf_dir), land).select("key", "radius", F.round("z", 6).alias("z"))

