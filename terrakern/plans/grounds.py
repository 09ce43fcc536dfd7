"""Queries of the ground model: states of layers, control points, the stack with its targets, its extension, its errors, presence.

Orders are read as holes of 25 projects, most at nodes of a 17 x 17 grid, and lineitems as their strata.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrakern.operators import details as D
from terrakern.operators import ground as G
from terrakern.operators.materialise import cut, stored
from terrakern.operators.surfaces import LAYERS, distance_weighted, grid
from terrakern.plans import standins as T
from terrakern.plans.registry import query

_LIST = "[" + ", ".join(f"'{n}'" for n in LAYERS) + "]"


def _holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = T.table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = o.select(k.alias("id"), (k % 25).alias("project"), (k * 37 % 17).alias("i"), ((k * 11 + c) % 17).alias("j"), F.when(c % 4 == 0, 20.0).otherwise(0.0).alias("off"))
    return o.select("project", "id", (F.col("i") * 64.0 + F.col("off")).alias("x"), (F.col("j") * 64.0).alias("y"), (F.lit(300.0) + (F.col("j") * 7 + F.col("i") * 3) % 5).alias("surface"))


def _strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.least(F.lit(4), F.col("l_linenumber") - 1 + (F.col("soil_type") == "R").cast("int"))
    group = F.when(F.col("l_partkey") % 11 == 0, F.lit("odd")).otherwise(F.get(F.array(*[F.lit(n) for n in LAYERS]), place.cast("int")))
    return T.strata(spark, sf_dir).select("borehole_id", "depth_top", "depth_bottom", group.alias("strata_group"))


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = T.projects(spark, sf_dir).select(F.col("project_id").alias("project"), *[F.lit(v).alias(c) for c, v in (("x0", 0.0), ("y0", 0.0), ("x1", 1024.0), ("y1", 1024.0))])
    return grid(box, 17).withColumn("ground", F.lit(300.0) + (F.col("j") * 7 + F.col("i") * 3) % 5)


def _floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.projects(spark, sf_dir).select(F.col("project_id").alias("project"), (F.lit(120.0) - F.col("project_id") % 3 * 40.0).alias("floor"))


def _axes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = _nodes(spark, sf_dir)
    return tuple(n.where(f"{other} = 0").select("project", F.col(name).alias("place"), F.col(c).alias("at")) for name, other, c in (("i", "j", "x"), ("j", "i", "y")))


def _profiled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = stored(G.profiles(_holes(spark, sf_dir), _strata(spark, sf_dir)))
    return p, G.layered(p)


_HOLES = f"""{T.STRATA}, gh AS (SELECT id, project, i * 64.0::DOUBLE + off AS x, j * 64.0::DOUBLE AS y, 300.0::DOUBLE + (j * 7 + i * 3) % 5 AS surface FROM (SELECT o_orderkey AS id, o_orderkey % 25 AS project, o_orderkey * 37 % 17 AS i, (o_orderkey * 11 + o_custkey) % 17 AS j, CASE WHEN o_custkey % 4 = 0 THEN 20.0 ELSE 0.0 END AS off FROM orders)),
 gs AS (SELECT borehole_id AS id, depth_top AS t, depth_bottom AS b, CASE WHEN l_partkey % 11 = 0 THEN 'odd' ELSE ({_LIST})[CAST(LEAST(4, l_linenumber - 1 + CASE WHEN soil_type = 'R' THEN 1 ELSE 0 END) AS INTEGER) + 1] END AS g FROM strata WHERE depth_bottom > depth_top),
 pr AS MATERIALIZED (SELECT gh.*, drilled, first.g AS first_layer, first.t AS first_top, last.g AS deepest, last.b AS deepest_bottom FROM gh JOIN (SELECT id, MAX(b) AS drilled, ARG_MIN({{'g': g, 't': t}}, ROW(t, b)) FILTER (WHERE g <> 'odd' AND b > 0.001) AS first, ARG_MAX({{'g': g, 'b': b}}, ROW(b, -t)) FILTER (WHERE g <> 'odd') AS last FROM gs GROUP BY id HAVING BOOL_OR(g <> 'odd')) s ON s.id = gh.id),
 ly AS MATERIALIZED (SELECT project, layer, n, pr.id, x, y, drilled, first_layer, first_top, COALESCE(thickness, 0.0) AS thickness, top FROM pr CROSS JOIN (SELECT UNNEST({_LIST}) AS layer, UNNEST(range(5)) AS n) l LEFT JOIN (SELECT id, g, SUM(b - t) AS thickness, MIN(t) AS top FROM gs GROUP BY id, g) s ON s.id = pr.id AND s.g = layer),
 ex AS (SELECT id, layer, SUM(top / GREATEST(d, 0.25)) / SUM(1 / GREATEST(d, 0.25)) AS e FROM (SELECT a.id, a.layer, b.top, SQRT(POWER(a.x - b.x, 2) + POWER(a.y - b.y, 2)) AS d, ROW_NUMBER() OVER (PARTITION BY a.id, a.layer ORDER BY SQRT(POWER(a.x - b.x, 2) + POWER(a.y - b.y, 2)), b.id) AS k FROM ly a JOIN ly b ON b.project = a.project AND b.layer = a.layer AND b.thickness > 0.001 WHERE a.thickness <= 0.001 AND a.layer <> 'soil') WHERE k <= 4 GROUP BY id, layer),
 st AS MATERIALIZED (SELECT ly.*, COALESCE(top, e) AS expected, CASE WHEN thickness > 0.001 THEN 'present' WHEN CASE WHEN ly.layer = 'soil' THEN first_top <= 0.001 AND first_layer <> 'soil' ELSE COALESCE(drilled >= COALESCE(top, e) + 0.25, FALSE) END THEN 'absent' ELSE 'not_reached' END AS state FROM ly LEFT JOIN ex ON ex.id = ly.id AND ex.layer = ly.layer)"""


def _nearest(of: str, among: str, value: str) -> str:
    """SQL: of `of` (project, layer, id, x, y) the value of the nearest of `among`."""
    return f"SELECT a.project, a.layer, a.id, ANY_VALUE(a.x) AS x, ANY_VALUE(a.y) AS y, ARG_MIN(b.{value}, ROW(SQRT(POWER(a.x - b.x, 2) + POWER(a.y - b.y, 2)), b.id)) AS z FROM {of} a JOIN {among} b ON b.project = a.project AND b.layer = a.layer GROUP BY a.project, a.layer, a.id"


_POINTS = f"""whole AS (SELECT project, layer, NOT BOOL_OR(state = 'absent') AS continuous FROM st GROUP BY project, layer HAVING BOOL_OR(state = 'present')),
 pres AS (SELECT * FROM st WHERE state = 'present'), gone AS (SELECT st.* FROM st JOIN whole ON whole.project = st.project AND whole.layer = st.layer AND NOT continuous WHERE state = 'absent' AND st.layer <> 'soil'),
 tp AS MATERIALIZED (SELECT project, layer, id, x, y, thickness AS z FROM pres UNION ALL SELECT project, layer, id, x, y, -0.75 * z FROM ({_nearest('gone', 'pres', 'thickness')}))"""
_FLOORS = "fl AS (SELECT CAST(n_nationkey AS BIGINT) AS project, 120.0::DOUBLE - n_nationkey % 3 * 40.0::DOUBLE AS floor FROM nation)"
_EXTENSION = f"""ea AS (SELECT pr.project, deepest AS layer, id, x, y, GREATEST(surface - deepest_bottom - floor, 0.0) AS z FROM pr JOIN fl ON fl.project = pr.project), eo AS (SELECT * FROM ea WHERE z > 0.001),
 en AS (SELECT ea.project, l.layer, ea.id, ea.x, ea.y FROM ea JOIN (SELECT DISTINCT project, layer FROM eo) l ON l.project = ea.project LEFT JOIN eo ON eo.id = ea.id AND eo.layer = l.layer WHERE eo.id IS NULL),
 ep AS MATERIALIZED (SELECT * FROM (SELECT project, layer, id, x, y, z FROM eo) UNION ALL SELECT project, layer, id, x, y, -0.3 * z FROM ({_nearest('en', 'eo', 'z')}))"""
_NODES = "gn AS MATERIALIZED (SELECT CAST(n_nationkey AS BIGINT) AS project, CAST(j AS INTEGER) AS j, CAST(i AS INTEGER) AS i, i * 64.0::DOUBLE AS x, j * 64.0::DOUBLE AS y, 300.0::DOUBLE + (j * 7 + i * 3) % 5 AS ground FROM nation, range(17) a(j), range(17) b(i))"


def _idw(points: str, power: float, where: str = "TRUE") -> str:
    d2 = "((n.x - p.x) * (n.x - p.x) + (n.y - p.y) * (n.y - p.y))"
    return f"SELECT project, layer, j, i, COALESCE(MIN(z) FILTER (WHERE d = 0), SUM(z / NULLIF(POWER(d, {power / 2}), 0)) / SUM(1 / NULLIF(POWER(d, {power / 2}), 0))) AS z FROM (SELECT n.project, p.layer, n.j, n.i, p.z, {d2} AS d FROM gn n JOIN {points} p ON p.project = n.project WHERE {where}) GROUP BY project, layer, j, i"


_THICK = f"""span AS (SELECT tp.project, tp.layer, MAX(z) AS most, MIN(z) FILTER (WHERE z > 0) AS least, BOOL_OR(continuous OR tp.layer = 'soil') AS whole FROM tp JOIN whole ON whole.project = tp.project AND whole.layer = tp.layer GROUP BY tp.project, tp.layer HAVING MAX(z) > 0),
 raw AS MATERIALIZED ({_idw('tp', 2)}), near AS ({_idw('tp', 1, 'p.z > 0')}), th AS MATERIALIZED (SELECT r.project, r.layer, r.j, r.i, r.z AS raw, GREATEST(CASE WHEN whole THEN GREATEST(0.01, least * 0.1, near.z * 0.1) ELSE 0.0 END, LEAST(r.z, most * 2)) AS z FROM raw r JOIN span ON span.project = r.project AND span.layer = r.layer
 LEFT JOIN near ON near.project = r.project AND near.layer = r.layer AND near.j = r.j AND near.i = r.i)"""
_TARGETS = """bp AS (SELECT ly.project, layer, ly.id, ly.x, ly.y, surface - SUM(thickness) OVER (PARTITION BY ly.id ORDER BY n) AS z FROM ly JOIN pr ON pr.id = ly.id WHERE thickness > 0.000001),
 tg AS MATERIALIZED (SELECT bp.project, layer, gn.j, gn.i, bp.x, bp.y, AVG(z) AS z FROM bp LEFT JOIN gn ON gn.project = bp.project AND gn.x = bp.x AND gn.y = bp.y GROUP BY ALL)"""
_P = {n: f"MAX(z) FILTER (WHERE layer = '{n}') AS {n}" for n in LAYERS}


def _stacked() -> str:
    """SQL of the stack's bottoms: thickness by thickness, each above the floor, then the targets."""
    steps, above = [], "ground"
    for n in LAYERS:
        steps.append(f"GREATEST({above} - COALESCE(t.{n}, 0), floor) AS b_{n}")
        above = f"b_{n}"
    out = ", ".join(f"COALESCE(o.{n}, b_{n}) AS {n}" for n in LAYERS)
    return f"""tw AS (SELECT project, j, i, {', '.join(_P.values())} FROM th GROUP BY project, j, i), ow AS (SELECT project, j, i, {', '.join(_P.values())} FROM tg WHERE j IS NOT NULL GROUP BY project, j, i),
 sk AS MATERIALIZED (SELECT s.project, s.j, s.i, ground, floor, {out} FROM (SELECT gn.*, floor, {', '.join(steps)} FROM gn JOIN fl ON fl.project = gn.project LEFT JOIN tw t ON t.project = gn.project AND t.j = gn.j AND t.i = gn.i) s LEFT JOIN ow o ON o.project = s.project AND o.j = s.j AND o.i = s.i)"""


_SHARES = f"""ew AS (SELECT project, j, i, {', '.join(_P.values())} FROM ({_idw('ep', 2)}) GROUP BY project, j, i), pu AS (SELECT project, j, i, {', '.join(_P.values())} FROM (SELECT n.project, n.j, n.i, layer, SUM(z / GREATEST((n.x - p.x) * (n.x - p.x) + (n.y - p.y) * (n.y - p.y), 1)) AS z FROM gn n JOIN eo p ON p.project = n.project GROUP BY ALL) GROUP BY project, j, i),
 ws AS (SELECT gn.project, gn.j, gn.i, {', '.join(f'GREATEST(COALESCE(ew.{n}, 0), 0) AS w_{n}, COALESCE(pu.{n}, 0) AS p_{n}' for n in LAYERS)} FROM gn LEFT JOIN ew ON ew.project = gn.project AND ew.j = gn.j AND ew.i = gn.i LEFT JOIN pu ON pu.project = gn.project AND pu.j = gn.j AND pu.i = gn.i),
 wt AS (SELECT *, {' + '.join(f'w_{n}' for n in LAYERS)} AS own, {' + '.join(f'p_{n}' for n in LAYERS)} AS other FROM ws),
 sh AS MATERIALIZED (SELECT project, j, i, {', '.join(f"CASE WHEN own > 0.001 THEN w_{n} / own WHEN other > 0.001 THEN p_{n} / other ELSE {float(n == LAYERS[-1])} END AS {n}" for n in LAYERS)}, CASE WHEN own > 0.001 THEN 'surface' WHEN other > 0.001 THEN 'distance' ELSE 'last' END AS basis FROM wt)"""
_ROUNDED = ", ".join(f"ROUND({n}, 5) AS {n}" for n in LAYERS)


def _rounded(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, *[F.round(n, 5).alias(n) for n in LAYERS])


@query(f"WITH {_HOLES} SELECT project, layer, id, state, ROUND(expected, 6) AS expected FROM st")
def layer_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each hole has each layer, surely lacks it, or didn't reach it."""
    _, rows = _profiled(spark, sf_dir)
    return G.with_states(rows).select("project", "layer", "id", "state", F.round("expected", 6).alias("expected"))


@query(f"WITH {_HOLES}, {_POINTS} SELECT project, layer, id, z FROM tp")
def thickness_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rows = _profiled(spark, sf_dir)
    stated = G.with_states(rows)
    return G.thickness_points(stated, G.continuity(stated)).select("project", "layer", "id", "z")


@query(f"WITH {_HOLES}, {_FLOORS}, {_EXTENSION} SELECT project, layer, id, z FROM ep")
def extension_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, _ = _profiled(spark, sf_dir)
    return G.extension_points(G.extension_anchors(p, _floors(spark, sf_dir))).select("project", "layer", "id", "z")


@query(f"WITH {_HOLES}, {_FLOORS}, {_EXTENSION}, {_NODES}, {_SHARES} SELECT project, j, i, {_ROUNDED}, basis FROM sh")
def extension_of_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each layer's share of what lies below the deepest boundary, by means by distance of the extension's control points."""
    p, _ = _profiled(spark, sf_dir)
    return _rounded(G.extension_shares(_nodes(spark, sf_dir), G.extension_anchors(p, _floors(spark, sf_dir)), distance_weighted), "project", "j", "i", "basis")


def _model(spark: SparkSession, sf_dir: str) -> G.Model:
    """The model of all projects, with means by distance for surfaces."""
    return G.model(_holes(spark, sf_dir), _strata(spark, sf_dir), _nodes(spark, sf_dir), *_axes(spark, sf_dir), _floors(spark, sf_dir), distance_weighted)


_STACK = f"{_HOLES}, {_FLOORS}, {_POINTS}, {_NODES}, {_THICK}, {_TARGETS}, {_stacked()}"
_PAIRS = list(zip(["ground", *LAYERS[:-1]], LAYERS, strict=True))


@query(f"WITH {_STACK} SELECT project, j, i, {_ROUNDED}, ROUND({LAYERS[-1]} - floor, 5) AS unknown, {' + '.join(f'CASE WHEN {b} > {a} + 1e-9 THEN 1 ELSE 0 END' for a, b in _PAIRS)} AS crossing FROM sk")
def ground_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries from holes to nodes: thicknesses, the stack, the holes' own contacts put back at their nodes."""
    return _rounded(_model(spark, sf_dir).stack.withColumn("unknown", F.round("unknown", 5)), "project", "j", "i", "unknown", "crossing")


def _extended_sql() -> str:
    out, above = [], "ground"
    for (a, n), m in zip(_PAIRS, LAYERS[:-1], strict=False):
        out.append(f"GREATEST({above} - (GREATEST({a} - sk.{n}, 0) + GREATEST(sk.{LAYERS[-1]} - floor, 0) * sh.{n}), floor) AS e_{m}".replace(f"GREATEST({a} -", f"GREATEST(sk.{a} -"))
        above = f"e_{m}"
    return f"WITH {_STACK}, {_EXTENSION}, {_SHARES} SELECT project, j, i, {', '.join(f'ROUND(e_{m}, 5) AS {m}' for m in LAYERS[:-1])}, ROUND(floor, 5) AS {LAYERS[-1]} FROM (SELECT sk.project, sk.j, sk.i, floor, {', '.join(out)} FROM sk JOIN sh ON sh.project = sk.project AND sh.j = sk.j AND sh.i = sk.i)"


@query(_extended_sql())
def extended_ground_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stack down to the model's floor, what lies below the deepest boundary shared out among the layers."""
    return _rounded(_model(spark, sf_dir).extended(), "project", "j", "i")


_TALL = " UNION ALL ".join(f"SELECT project, j, i, '{n}' AS layer, {n} AS z FROM sk" for n in LAYERS)


@query(
    f"""WITH {_STACK}, tl AS (SELECT * FROM ({_TALL})), pt AS (SELECT *, LEAST(CAST(FLOOR(x / 64) AS INTEGER), 15) AS i0, LEAST(CAST(FLOOR(y / 64) AS INTEGER), 15) AS j0 FROM (SELECT ROW_NUMBER() OVER () AS k, project, layer, LEAST(x, 1024.0) AS x, y, z FROM tg)),
 er AS (SELECT pt.k, pt.project, pt.layer, ABS(SUM(tl.z * (1 - ABS(pt.x / 64 - tl.i)) * (1 - ABS(pt.y / 64 - tl.j))) - ANY_VALUE(pt.z)) AS e FROM pt JOIN tl ON tl.project = pt.project AND tl.layer = pt.layer AND tl.i BETWEEN i0 AND i0 + 1 AND tl.j BETWEEN j0 AND j0 + 1 GROUP BY pt.k, pt.project, pt.layer)
 SELECT project, layer, COUNT(*) AS targets, ROUND(MAX(e), 5) AS greatest, ROUND(AVG(e), 5) AS mean FROM er GROUP BY project, layer"""
)
def ground_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each layer's boundary is off the holes' contacts, those between nodes included."""
    return _model(spark, sf_dir).errors().select("project", "layer", "targets", F.round("greatest", 5).alias("greatest"), F.round("mean", 5).alias("mean"))


def _voxels_sql() -> str:
    levels = " ".join(f"WHEN level > {n} THEN {k}" for k, n in enumerate(LAYERS, 1))
    grown = " ".join(f"WHEN level > e_{n} THEN {k}" for k, n in enumerate(LAYERS, 1))
    deep = " ".join(f"WHEN {'ground' if k == 1 else 'e_' + LAYERS[k - 2]} - e_{n} > 1e-9 THEN {k}" for k, n in reversed(list(enumerate(LAYERS, 1))))
    ext = _extended_sql().removeprefix("WITH ").replace(f"ROUND(e_{LAYERS[0]}, 5)", f"e_{LAYERS[0]}")
    for n in LAYERS:
        ext = ext.replace(f"ROUND(e_{n}, 5) AS {n}", f"e_{n} AS x_{n}").replace(f"e_{n} AS {n}", f"e_{n} AS x_{n}")
    ext = ext.replace(f"ROUND(floor, 5) AS {LAYERS[-1]}", f"floor AS x_{LAYERS[-1]}")
    head, _, tail = ext.rpartition(" SELECT project, j, i, e_")
    return f"""WITH {head}, xt AS (SELECT project, j, i, e_{tail}), tops AS (SELECT project, MAX(ground) AS top FROM sk GROUP BY project), bo AS (SELECT sk.*, {', '.join(f'x_{n} AS e_{n}' for n in LAYERS)}, GREATEST(top - floor, 1.0) AS r FROM sk JOIN xt ON xt.project = sk.project AND xt.j = sk.j AND xt.i = sk.i JOIN tops ON tops.project = sk.project),
 ce AS (SELECT *, floor + r / (m - 1) * l AS level FROM (SELECT *, UNNEST(range(m)) AS l FROM (SELECT *, CAST(LEAST(GREATEST(ROUND(r / 1.2), 16), 96) AS BIGINT) AS m FROM bo)))
 SELECT project, label, label_extended, COUNT(*) AS n FROM (SELECT project, CASE WHEN level > ground THEN 0 {levels} ELSE 6 END AS label, CASE WHEN level > ground THEN 0 {grown} ELSE CASE {deep} ELSE 1 END END AS label_extended FROM ce) GROUP BY ALL"""


@query(_voxels_sql())
def ground_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the whole model by their labels in both stacks."""
    return _model(spark, sf_dir).voxels().groupBy("project", "label", "label_extended").agg(F.count(F.lit(1)).alias("n"))


_RADIUS = "LEAST(GREATEST((30 + n_nationkey * 6) * 1.5::DOUBLE, 80), 250)"
_COUNTED = "COUNT(*) FILTER (WHERE state = 'present') AS {0}present, COUNT(*) FILTER (WHERE state <> 'not_reached') AS {0}told"


@query(
    f"""WITH {_HOLES}, {_POINTS}, {_NODES}, {_THICK}, rd AS (SELECT CAST(n_nationkey AS BIGINT) AS project, {_RADIUS} AS radius FROM nation),
 nt AS (SELECT th.project, th.layer, th.j, th.i, raw, gn.x, gn.y, radius FROM th JOIN gn ON gn.project = th.project AND gn.j = th.j AND gn.i = th.i JOIN rd ON rd.project = th.project WHERE th.layer <> 'soil'),
 dd AS MATERIALIZED (SELECT *, ROW_NUMBER() OVER (PARTITION BY project, layer, j, i ORDER BY d, id) AS k, COUNT(*) FILTER (WHERE d <= radius) OVER (PARTITION BY project, layer, j, i) AS within FROM (SELECT nt.project, nt.layer, j, i, radius, st.id, thickness, state, SQRT(POWER(nt.x - st.x, 2) + POWER(nt.y - st.y, 2)) AS d FROM nt JOIN st ON st.project = nt.project AND st.layer = nt.layer)),
 sc AS (SELECT project, layer, j, i, {_COUNTED.format('')}, list_sort(list(thickness) FILTER (WHERE state = 'present')) AS t FROM dd WHERE CASE WHEN within >= 3 THEN d <= radius ELSE k <= 4 END GROUP BY ALL),
 nr AS (SELECT project, layer, j, i, {_COUNTED.format('near_')} FROM dd WHERE k <= 4 GROUP BY ALL), mn AS (SELECT project, layer, j, i, MIN(d) FILTER (WHERE state = 'present') AS dp, MIN(d) FILTER (WHERE state = 'absent') AS da FROM dd GROUP BY ALL),
 us AS (SELECT project, layer, list_sort(list(thickness)) AS t FROM pres GROUP BY ALL), al AS (SELECT nt.*, present, told, near_present, near_told, dp, da, CASE WHEN told > 0 THEN present / told ELSE 0 END AS ratio, COALESCE(sc.t[len(sc.t) // 2 + 1], us.t[len(us.t) // 2 + 1], 0.1) AS thick FROM nt JOIN sc USING (project, layer, j, i) JOIN nr USING (project, layer, j, i) JOIN mn USING (project, layer, j, i) LEFT JOIN us USING (project, layer))
 SELECT project, layer, j, i, ROUND(CASE WHEN COALESCE((told >= 3 AND ratio >= 0.7) OR (near_told >= 4 AND near_present = near_told) OR (dp <= radius * 0.75 AND (da IS NULL OR dp < da * 0.75) AND near_present >= LEAST(3, near_told)), FALSE) THEN GREATEST(raw, GREATEST(thick * 0.25, 0.1))
 WHEN COALESCE(da <= radius AND told > 0 AND ratio < 0.5 AND (dp IS NULL OR da < dp * 0.8), FALSE) THEN LEAST(raw, -GREATEST(thick * 0.1, 0.1)) ELSE raw END, 5) AS signed FROM al"""
)
def rock_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each layer of rock is, by the holes around each node."""
    _, rows = _profiled(spark, sf_dir)
    stated = G.with_states(rows)
    whole = stored(G.continuity(stated))
    thick = G.thicknesses(_nodes(spark, sf_dir).drop("ground"), G.thickness_points(stated, whole), whole, distance_weighted).where("layer <> 'soil'")
    spacings = T.projects(spark, sf_dir).select(F.col("project_id").alias("project"), (F.lit(30.0) + F.col("project_id") * 6).alias("spacing"))
    return G.rock_presence(thick, stated, spacings).withColumn("signed", F.round("signed", 5))




_WORDS = ("매립토", "점토", "사질점토")


def _detailed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Occurrences, and the holes with soil: lineitems up to the fourth of an order are soil, of three names or none."""
    k = F.col("l_partkey") % 4
    name = F.when(k == 0, "매립토").when(k == 1, "점토").when(k == 2, "사질점토").otherwise("토사")
    s = T.strata(spark, sf_dir).select("borehole_id", "depth_top", "depth_bottom", F.when(F.col("l_linenumber") <= 4, "soil").otherwise("hard_rock").alias("strata_group"), name.alias("soil_type"))
    holes = _holes(spark, sf_dir)
    return stored(D.occurrences(holes, s)), holes.join(s.where("strata_group = 'soil'").select(F.col("borehole_id").alias("id")).distinct(), "id", "left_semi")


_OCCURRENCES = f"""{T.STRATA}, gh AS (SELECT id, project, i * 64.0::DOUBLE + off AS x, j * 64.0::DOUBLE AS y, 300.0::DOUBLE + (j * 7 + i * 3) % 5 AS surface FROM (SELECT o_orderkey AS id, o_orderkey % 25 AS project, o_orderkey * 37 % 17 AS i, (o_orderkey * 11 + o_custkey) % 17 AS j, CASE WHEN o_custkey % 4 = 0 THEN 20.0 ELSE 0.0 END AS off FROM orders)),
 gs AS (SELECT borehole_id AS id, depth_top AS t, depth_bottom AS b, (['매립토', '점토', '사질점토', '토사'])[CAST(l_partkey % 4 AS INTEGER) + 1] AS name FROM strata WHERE l_linenumber <= 4), sh AS (SELECT * FROM gh WHERE id IN (SELECT id FROM gs)),
 oc AS MATERIALIZED (SELECT project, gs.id, x, y, name, name || '#' || CAST(nth AS VARCHAR) AS key, nth, place, b - t AS thickness, surface - b AS z, rk FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY id, name ORDER BY t, b, name) AS nth, ROW_NUMBER() OVER (PARTITION BY id ORDER BY t, b, name) - 1 AS place, list_position(['매립토', '점토', '사질점토'], name) AS rk FROM gs WHERE name <> '토사') gs JOIN gh ON gh.id = gs.id)"""


@query(f"WITH {_OCCURRENCES} SELECT id, key, place, thickness, ROUND(z, 6) AS z FROM oc")
def soil_occurrences_of_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detailed(spark, sf_dir)[0].select("id", "key", "place", "thickness", F.round("z", 6).alias("z"))


@query()
def order_of_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each project's occurrences in an order that its holes don't contradict."""
    return D.occurrence_places(_detailed(spark, sf_dir)[0], _WORDS)


_W2 = "(n.x - p.x) * (n.x - p.x) + (n.y - p.y) * (n.y - p.y)"


def _means(points: str) -> str:
    return f"SELECT project, key, j, i, COALESCE(MIN(z) FILTER (WHERE d = 0), SUM(z / NULLIF(d, 0)) / SUM(1 / NULLIF(d, 0))) AS z FROM (SELECT n.project, p.key, n.j, n.i, p.z, {_W2} AS d FROM gn n JOIN ({points}) p ON p.project = n.project) GROUP BY ALL"


@query(
    f"""WITH RECURSIVE {_OCCURRENCES}, {_NODES}, ky AS (SELECT project, key, ROW_NUMBER() OVER (PARTITION BY project ORDER BY MIN(rk), MIN(nth)) AS k FROM oc GROUP BY project, key), tk AS (SELECT sh.project, ky.key, sh.x, sh.y, COALESCE(t, 0.0) AS z FROM sh JOIN ky ON ky.project = sh.project LEFT JOIN (SELECT id, key, SUM(thickness) AS t FROM oc GROUP BY id, key) o ON o.id = sh.id AND o.key = ky.key),
 mt AS MATERIALIZED ({_means('SELECT * FROM tk')}), mb AS MATERIALIZED ({_means('SELECT project, key, x, y, z FROM oc')}), sn AS (SELECT gn.project, gn.j, gn.i, key, AVG(z) AS z FROM oc JOIN gn ON gn.project = oc.project AND gn.x = oc.x AND gn.y = oc.y GROUP BY ALL),
 pt AS MATERIALIZED (SELECT mt.project, mt.j, mt.i, ky.k, mt.key, mt.z AS thick, mb.z AS contact, sn.z AS snap, SUM(mt.z) OVER (PARTITION BY mt.project, mt.j, mt.i) AS total FROM mt JOIN ky ON ky.project = mt.project AND ky.key = mt.key JOIN mb ON mb.project = mt.project AND mb.key = mt.key AND mb.j = mt.j AND mb.i = mt.i LEFT JOIN sn ON sn.project = mt.project AND sn.key = mt.key AND sn.j = mt.j AND sn.i = mt.i),
 st AS (SELECT project, j, i, CAST(0 AS BIGINT) AS k, CAST('' AS VARCHAR) AS key, ground AS ground, ground - 40.0::DOUBLE - (j + i) % 3 * 20 AS base, ground AS top, ground AS bottom FROM gn UNION ALL
 SELECT project, j, i, k, key, ground, base, lo, CASE WHEN snap IS NOT NULL THEN GREATEST(base, LEAST(lo - 0.05, snap)) WHEN lo - base <= 0.05 OR share < 0.05 THEN lo ELSE GREATEST(base, LEAST(lo - 0.05, GREATEST(contact, lo - share))) END
 FROM (SELECT st.project, st.j, st.i, pt.k, pt.key, ground, base, st.bottom AS lo, snap, contact, CASE WHEN total > 0.05 THEN thick / total * GREATEST(ground - base, 0) ELSE thick END AS share FROM st JOIN pt ON pt.project = st.project AND pt.j = st.j AND pt.i = st.i AND pt.k = st.k + 1)),
 al AS (SELECT project, j, i, key, top, bottom FROM st WHERE k > 0 UNION ALL SELECT project, j, i, '토사', ARG_MAX(bottom, k), ANY_VALUE(base) FROM st GROUP BY project, j, i) SELECT project, j, i, key, ROUND(top, 5) AS top, ROUND(bottom, 5) AS bottom FROM al WHERE top - bottom >= 0.05"""
)
def layers_of_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers of detail of all projects, from the holes' occurrences to the nodes, in the words' order."""
    found, soil = _detailed(spark, sf_dir)
    rank = F.array_position(F.array(*[F.lit(w) for w in _WORDS]), F.col("name"))
    w = Window.partitionBy("project").orderBy("r", "nth")  # a row for each name and n
    places = cut(found.groupBy("project", "key").agg(F.min(rank).alias("r"), F.min("nth").alias("nth")).select("project", "key", F.row_number().over(w).alias("place")))
    nodes = _nodes(spark, sf_dir)
    parts = D.detail_parts(nodes, found, soil, places, *_axes(spark, sf_dir))
    column = nodes.select("project", "j", "i", F.col("ground").alias("top"), (F.col("ground") - 40.0 - (F.col("j") + F.col("i")) % 3 * 20).alias("base"))
    return D.layers_of_detail(column, parts).select("project", "j", "i", "key", F.round("top", 5).alias("top"), F.round("bottom", 5).alias("bottom"))
