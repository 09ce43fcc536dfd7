"""Surfaces of strata and groundwater over grids.

A grid is a tall table (project, j, i, x, y), an anchor table (project, layer, x, y, z). A thin plate through more than PATCH anchors
is blended from overlapping patches; work is split by patches and blocks of grid nodes, so that nothing larger than one patch's
anchors and one block is in a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrakern.operators.materialise import ROWS, cut, dealt, stored
from terrakern.operators.spatial import pairs_within

LAYERS = ("soil", "weathered_rock", "soft_rock", "normal_rock", "hard_rock")
NODES = 4096
#: Anchors in a dense solve; side of the coarse plate's lattice; a patch's halo in sides of its cell; halvings of a project's box.
PATCH, COARSE_CELLS, HALO, DEEPEST = 1024, 16, 0.25, 40
KEYS, WHOLE, COARSE = ["project", "layer", "patch"], "whole", "coarse"


def grid(projects: DataFrame, size: int) -> DataFrame:
    """size x size nodes over each project's box (project, x0, y0, x1, y1), its edges included."""
    steps = F.sequence(F.lit(0), F.lit(size - 1))
    at = lambda lo, hi, k: F.col(lo) + (F.col(hi) - F.col(lo)) * F.col(k) / max(1, size - 1)
    nodes = projects.withColumn("j", F.explode(steps)).withColumn("i", F.explode(steps))
    return nodes.select("project", "j", "i", at("x0", "x1", "i").alias("x"), at("y0", "y1", "j").alias("y"))


def contacts(holes: DataFrame, strata: DataFrame) -> DataFrame:
    """(project, id, layer, x, y, z): level of each layer's top in each hole; where a hole lacks it, the bottom of the nearest
    layer above that it has, else its elevation. Of a layer's strata in a hole the uppermost counts."""
    first = strata.where(F.col("strata_group").isin(*LAYERS)).groupBy("borehole_id", "strata_group").agg(F.min_by(F.struct("depth_top", "depth_bottom"), F.struct("depth_top", "depth_bottom")).alias("_s"))
    have = first.groupBy("borehole_id").agg(F.map_from_entries(F.collect_list(F.struct("strata_group", "_s"))).alias("_m"))
    all_ = holes.join(have, holes["id"] == have["borehole_id"], "left")
    parts = []
    for n, layer in enumerate(LAYERS):
        top = F.try_element_at("_m", F.lit(layer))["depth_top"]
        above = [F.try_element_at("_m", F.lit(name))["depth_bottom"] for name in reversed(LAYERS[:n])]
        parts.append(F.struct(F.lit(layer).alias("layer"), (F.col("elevation") - F.coalesce(top, *above, F.lit(0.0))).alias("z")))
    return all_.withColumn("_c", F.explode(F.array(*parts))).select("project", "id", F.col("_c.layer").alias("layer"), "x", "y", F.col("_c.z").alias("z"))


def grounded_layers(strata: DataFrame) -> DataFrame:
    """Layers that some hole really has."""
    return strata.where(F.col("strata_group").isin(*LAYERS)).select(F.col("strata_group").alias("layer")).distinct()


def distance_weighted(nodes: DataFrame, anchors: DataFrame, power: float = 2.0, exact: float = 1e-14) -> DataFrame:
    """Nodes (project, j, i, x, y) with z of each layer: an anchor's own value at its place, else the mean by 1 / d ** power.

    Anchors of a layer at one place count as one with their sum, number and least. A project's nodes and anchors are dealt to blocks; two blocks
    meet in numpy, and give sums for each node and layer.
    """
    value = F.coalesce(F.col("z").cast("double"), F.lit(float("nan")))
    return weighted_by_places(nodes, anchors.groupBy("project", "layer", "x", "y").agg(F.sum(value).alias("z"), F.count(F.lit(1)).alias("n"), F.min(value).alias("low")), power, exact)


def weighted_by_places(nodes: DataFrame, places: DataFrame, power: float = 2.0, exact: float = 1e-14) -> DataFrame:
    """distance_weighted() of anchors by their places (project, layer, x, y): z, the sum of their values, their number n and least value low."""
    anchors = stored(places.select("project", "layer", "x", "y", "z", "n", "low"))
    spread = lambda df, name: df.withColumn(name, F.pmod(F.xxhash64("x", "y"), F.lit(1 << 20)))
    many = lambda df, name: df.groupBy("project").agg(F.ceil(F.count(F.lit(1)) / NODES).alias(name))
    sizes = many(nodes, "_rows").join(many(anchors, "_columns"), "project")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = spread(nodes.select("project", "j", "i", "x", "y"), "_a").join(sizes, "project").withColumn("_a", F.col("_a") % F.col("_rows")).withColumn("_b", each("_columns")).drop("_rows", "_columns")
    right = spread(anchors, "_b").join(sizes, "project").withColumn("_b", F.col("_b") % F.col("_columns")).withColumn("_a", each("_rows")).drop("_rows", "_columns")
    kind = nodes.schema["project"].dataType.simpleString()

    def meet(some: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for layer, own in known.groupby("layer"):
            x, y, z, n, low = (own[c].to_numpy(float) for c in ("x", "y", "z", "n", "low"))
            for lo in range(0, len(some), 1024):
                part = some.iloc[lo : lo + 1024]
                d2 = (part["x"].to_numpy(float)[:, None] - x) ** 2 + (part["y"].to_numpy(float)[:, None] - y) ** 2
                there = d2 < exact
                weight = np.where(there, 0.0, 1 / np.where(there, 1.0, d2) ** (power / 2))
                at = np.where(there.any(axis=1), np.where(there, low, np.inf).min(axis=1), np.nan)
                parts.append(part[["project", "j", "i", "x", "y"]].assign(layer=layer, _z=weight @ z, _w=weight @ n, _at=at))
        return pd.concat(parts) if parts else some[["project", "j", "i", "x", "y"]].iloc[:0].assign(layer="", _z=0.0, _w=0.0, _at=0.0)

    key = ["project", "_a", "_b"]
    schema = f"project {kind}, j int, i int, x double, y double, layer string, _z double, _w double, _at double"
    met = left.repartition(*key).groupBy(*key).cogroup(right.repartition(*key).groupBy(*key)).applyInPandas(meet, schema)
    at = F.min(F.when(~F.isnan("_at"), F.col("_at")))
    return met.groupBy("project", "layer", "j", "i").agg(F.first("x").alias("x"), F.first("y").alias("y"), F.coalesce(at, F.sum("_z") / F.sum("_w")).alias("z"))


def exact_surface(nodes: DataFrame, anchors: DataFrame, power: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """A groundwater surface through its anchors (project, layer, x, y, z, trend) at nodes (project, j, i, x, y, trend), and the
    places whose anchors disagree, which take no part. What the anchors leave over the trend is spread by distance and added to
    the node's trend; at an anchor's place its own level comes back, whatever the trend."""
    good, apart = settled_anchors(anchors)
    trend = anchors.groupBy("project", "layer", "x", "y").agg(F.min("trend").alias("_t"))
    rest = good.join(trend, ["project", "layer", "x", "y"])
    over = distance_weighted(nodes, rest.select("project", "layer", "x", "y", (F.col("z") - F.coalesce("_t", F.lit(0.0))).alias("z")), power)
    own = rest.select("project", "layer", F.round(F.col("x") / 1e-9).alias("_px"), F.round(F.col("y") / 1e-9).alias("_py"), F.col("z").alias("_own"))
    out = over.join(nodes.select("project", "j", "i", F.coalesce("trend", F.lit(0.0)).alias("_trend")), ["project", "j", "i"])
    out = out.withColumns({"_px": F.round(F.col("x") / 1e-9), "_py": F.round(F.col("y") / 1e-9)}).join(own, ["project", "layer", "_px", "_py"], "left")
    return out.select("project", "layer", "j", "i", "x", "y", F.coalesce("_own", F.col("z") + F.col("_trend")).alias("z")), apart


def diagnosed(surface: DataFrame, anchors: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(project, layer, observations, greatest, mean, passed): how far a surface's nodes are off the anchors at their places."""
    at = anchors.select("project", "layer", "x", "y", F.col("z").alias("_z")).join(surface.select("project", "layer", "x", "y", "z"), ["project", "layer", "x", "y"])
    error = F.abs(F.col("z") - F.col("_z"))
    out = at.groupBy("project", "layer").agg(F.count(F.lit(1)).alias("observations"), F.max(error).alias("greatest"), F.avg(error).alias("mean"))
    return out.withColumn("passed", F.col("greatest") <= tolerance)


#: A plate's weights, in units of the anchors' mean distance, that are this many times their span are no sound solution.
STEEP = 1e5


def plate_report(settled: DataFrame) -> DataFrame:
    """(project, layer, anchors, scale, span, steepness) of plates through settled anchors (project, layer, x, y, z): their mean distance, the
    span of their levels, 1 at the least, and the greatest weight in these units, null where there is no solution. A layer of more
    than PATCH anchors is fitted patch by patch, and reported for the coarse plate that all of its patches lie on."""
    boxes = settled.groupBy("project", "layer").agg(*[f(c).alias(f"_{c}{n}") for c in "xy" for n, f in (("0", F.min), ("1", F.max))], F.count(F.lit(1)).alias("_n"), F.min("z").alias("_lo"), F.max("z").alias("_hi"))
    at = settled.join(boxes, ["project", "layer"])
    cell = [F.when(F.col("_n") > PATCH, F.least(F.floor((F.col(c) - F.col(f"_{c}0")) / F.greatest(F.col(f"_{c}1") - F.col(f"_{c}0"), F.lit(1e-9)) * COARSE_CELLS), F.lit(COARSE_CELLS - 1))).otherwise(F.xxhash64("x", "y")).alias(f"_c{c}") for c in "xy"]
    known = at.groupBy("project", "layer", "_n", "_lo", "_hi", *cell).agg(*[F.avg(c).alias(c) for c in "xyz"])
    kind = settled.schema["project"].dataType.simpleString()

    def report(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["x", "y"], ignore_index=True)
        x, y = rows["x"].to_numpy(float), rows["y"].to_numpy(float)
        pairs = sum(float(np.hypot(x[k + 1 :] - x[k], y[k + 1 :] - y[k]).sum()) for k in range(len(x) - 1))  # at most PATCH places
        scale = max(pairs / max(len(x) * (len(x) - 1) / 2, 1), 1.0)
        span = max(float(rows["_hi"].iloc[0] - rows["_lo"].iloc[0]), 1.0)
        try:
            plate = _solve(rows.assign(patch=WHOLE))
            steep = float(np.abs(plate["w"][plate["part"] == 0]).max() * (scale / plate["scale"].iloc[0]) ** 2 / span)
        except np.linalg.LinAlgError:
            steep = float("nan")
        return pd.DataFrame({"project": [rows["project"].iloc[0]], "layer": [rows["layer"].iloc[0]], "anchors": [int(rows["_n"].iloc[0])], "scale": [scale], "span": [span], "steepness": [steep]})

    out = known.groupBy("project", "layer").applyInPandas(report, f"project {kind}, layer string, anchors long, scale double, span double, steepness double")
    return out.withColumn("steepness", F.when(~F.isnan("steepness"), F.col("steepness")))


def guarded_plate(nodes: DataFrame, anchors: DataFrame, near: float = 0.5, beyond: float = 4.0) -> tuple[DataFrame, DataFrame]:
    """(project, layer, j, i, x, y, z, fallback, reason) and the places whose anchors disagree. A thin plate where it is safe; elsewhere means by
    distance, with the first reason that holds: few, where there are fewer than three anchors; close, where two are no farther apart than
    `near`; steep, where the plate's weights are none or beyond STEEP; wild, where a node lies more than `beyond` spans off the
    anchors' levels. At an anchor's own place its level stands in either case."""
    good, apart = settled_anchors(anchors)
    good = cut(good)
    key = ["project", "layer"]
    spans = good.groupBy(*key).agg(F.min("z").alias("_lo"), F.max("z").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    span = F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1.0))
    points = good.select(F.monotonically_increasing_id().alias("key"), "x", "y", *key)
    close = pairs_within(cut(points), near, key).select(*key).distinct().withColumn("_close", F.lit(True))
    early = spans.join(close, key, "left").withColumn("reason", F.when(F.col("_n") < 3, F.lit("few")).when(F.col("_close"), F.lit("close")))
    early = cut(early.select(*key, "reason"))
    open_ = early.where("reason IS NULL").select(*key)
    steep = plate_report(good.join(open_, key, "left_semi")).where(F.coalesce(F.col("steepness") > STEEP, F.lit(True))).select(*key, F.lit("steep").alias("_steep"))
    steep = cut(steep)
    plate = cut(thin_plate(nodes, good.join(open_, key, "left_semi").join(steep, key, "left_anti"))).join(spans, key)
    wild = plate.groupBy(*key).agg(F.bool_or(F.isnan("z") | (F.col("z") < F.col("_lo") - span * beyond) | (F.col("z") > F.col("_hi") + span * beyond)).alias("_wild"))
    unsafe = early.join(steep, key, "left").join(wild, key, "left").select(*key, F.coalesce("reason", "_steep", F.when(F.col("_wild"), F.lit("wild"))).alias("reason"))
    unsafe = cut(unsafe)
    by_distance = distance_weighted(nodes, good.join(unsafe.where("reason IS NOT NULL").select(*key), key, "left_semi"), 1.0)
    safe = plate.join(unsafe.where("reason IS NULL").select(*key), key, "left_semi").select(*key, "j", "i", "x", "y", "z")
    own = good.select(*key, "x", "y", F.col("z").alias("_own"))
    both = safe.unionByName(by_distance.select(*safe.columns)).join(unsafe, key).join(own, [*key, "x", "y"], "left")
    return both.withColumns({"z": F.coalesce("_own", "z"), "fallback": F.col("reason").isNotNull()}).select(*key, "j", "i", "x", "y", "z", "fallback", "reason"), apart


def settled_anchors(anchors: DataFrame, place: float = 1e-9, height: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """Anchors with equal ones at a place taken once, and the places whose values differ by more than `height`."""
    key = ["project", "layer", F.round(F.col("x") / place).alias("_px"), F.round(F.col("y") / place).alias("_py")]
    at = anchors.groupBy(*key).agg(F.first("x").alias("x"), F.first("y").alias("y"), F.min("z").alias("z"), F.max("z").alias("_high"))
    apart = F.col("_high") - F.col("z") > height
    return at.where(~apart).select("project", "layer", "x", "y", "z"), at.where(apart).select("project", "layer", "x", "y", "z", F.col("_high").alias("other"))


def _kernel(r2: np.ndarray) -> np.ndarray:
    return 0.5 * r2 * np.log(np.where(r2 > 0, r2, 1.0))


def _solve(rows: pd.DataFrame) -> pd.DataFrame:
    """Weights of a thin plate through a patch's anchors, which are at places of their own; the plane's three coefficients follow as
    rows of their own. Below three anchors or on a line a part of a project takes the least weights that meet them."""
    rows = rows.sort_values(["x", "y"])
    x, y, z = (rows[c].to_numpy(float) for c in ("x", "y", "z"))
    cx, cy, scale = x.mean(), y.mean(), max(np.ptp(x), np.ptp(y), 1e-9)
    u, v, n = (x - cx) / scale, (y - cy) / scale, len(rows)
    plane = np.stack([np.ones(n), u, v], axis=1)
    level = n < 3 or np.linalg.matrix_rank(plane) < 3
    if level and rows["patch"].iloc[0] in (WHOLE, COARSE):
        w, c = np.zeros(n), np.array([z.mean(), 0.0, 0.0])
    else:
        k = _kernel((u[:, None] - u) ** 2 + (v[:, None] - v) ** 2)
        top = np.concatenate([k, plane], axis=1)
        both = np.concatenate([top, np.concatenate([plane.T, np.zeros((3, 3))], axis=1)])
        right = np.concatenate([z, np.zeros(3)])
        w, c = np.split(np.linalg.lstsq(both, right, rcond=None)[0] if level else np.linalg.solve(both, right), [n])
    out = pd.DataFrame({"u": np.append(u, [np.nan] * 3), "v": np.append(v, [np.nan] * 3), "w": np.append(w, c), "part": [0] * n + [1, 2, 3]})
    return out.assign(**{c: rows[c].iloc[0] for c in KEYS}, cx=cx, cy=cy, scale=scale)


def _on_plates(places: DataFrame, anchors: DataFrame, block: int) -> DataFrame:
    """places (project, layer, patch, x, y, ...) with h, the level of their patch's plate. A plate is solved once, and evaluated
    block by block of places."""
    kind = anchors.schema["project"].dataType.simpleString()
    weights = anchors.groupBy(*KEYS).applyInPandas(_solve, f"u double, v double, w double, part int, project {kind}, layer string, patch string, cx double, cy double, scale double")
    blocks = places.withColumn("block", F.pmod(F.xxhash64("x", "y"), F.lit(1 << 20)))
    sizes = places.groupBy(*KEYS).agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.lit(1)).alias("_blocks"))
    blocks = blocks.join(sizes, KEYS).withColumn("block", F.col("block") % F.col("_blocks")).drop("_blocks")
    spread = weights.join(sizes, KEYS).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))).drop("_blocks")
    names = places.columns

    def evaluate(some: pd.DataFrame, plate: pd.DataFrame) -> pd.DataFrame:
        if not len(some) or not len(plate):
            return some[names].iloc[:0].assign(h=np.array([], float))
        p = plate.iloc[0]
        own, coefficients = plate[plate["part"] == 0], plate[plate["part"] > 0].sort_values("part")["w"].to_numpy()
        h = []
        for lo in range(0, len(some), 1024):
            u, v = ((some[c].to_numpy(float)[lo : lo + 1024] - p[f"c{c}"]) / p["scale"] for c in ("x", "y"))
            bent = _kernel((u[:, None] - own["u"].to_numpy()) ** 2 + (v[:, None] - own["v"].to_numpy()) ** 2) @ own["w"].to_numpy()
            h.append(coefficients[0] + coefficients[1] * u + coefficients[2] * v + bent)
        return some[names].assign(h=np.concatenate(h))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in places.schema) + ", h double"
    return blocks.groupBy(*KEYS, "block").cogroup(spread.groupBy(*KEYS, "block")).applyInPandas(evaluate, schema)


def _cells(places: DataFrame, levels: list[int]) -> DataFrame:
    """places (u, v in the unit square, ...) once for each cell (level, a, b) that they lie in or within HALO of, in cell sides."""
    at = places.withColumn("level", F.explode(F.array(*[F.lit(n) for n in levels]))).withColumn("_n", F.pow(F.lit(2.0), F.col("level")))
    for name, c in (("a", "u"), ("b", "v")):
        near = F.sequence(F.floor(F.col(c) * F.col("_n") - HALO), F.floor(F.col(c) * F.col("_n") + HALO))
        at = at.withColumn(name, F.explode(near))
    return at


def _leaves(anchors: DataFrame, large: DataFrame, patch: int) -> tuple[DataFrame, list[int]]:
    """Cells (project, layer, level, a, b, n) of a quadtree over each large surface, each with at most `patch` of the anchors in
    it and its halo, and the levels that occur."""
    split, out = large.select("project", "layer", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")), []
    for level in range(1, DEEPEST + 1):
        half = lambda c: F.explode(F.array(F.col(c) * 2, F.col(c) * 2 + 1)).alias(c)
        cells = split.select("project", "layer", half("a"), "b").select("project", "layer", "a", half("b"))
        key = ["project", "layer", "a", "b"]
        counts = _cells(anchors, [level]).join(cells, key, "left_semi").groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
        counts = cut(cells.join(counts, key, "left").select(*key, F.lit(level).alias("level"), F.coalesce("n", F.lit(0)).alias("n")))
        split = counts.where((F.col("n") > patch) & (F.col("level") < DEEPEST))
        out.append(counts.where((F.col("n") <= patch) | (F.col("level") == DEEPEST)))
        if split.isEmpty():
            break
    leaves = out[0]
    for more in out[1:]:
        leaves = leaves.unionByName(more)
    return leaves, list(range(1, len(out) + 1))


def _patched(nodes: DataFrame, anchors: DataFrame, large: DataFrame, block: int, patch: int) -> DataFrame:
    """Nodes on blended plates: a coarse plate through the means of COARSE_CELLS ** 2 cells of all anchors, and on it, patch by
    patch of a quadtree, plates through what it leaves of the anchors in the patch and its halo. Weights fall to 0 at a halo's
    edge, so the surface is smooth and meets every anchor; where a patch has no anchor, it is the coarse plate's."""
    of = large.select("project").distinct()
    places = nodes.select("project", "x", "y").unionByName(anchors.select("project", "x", "y")).join(of, "project", "left_semi")
    boxes = places.groupBy("project").agg(F.min("x").alias("_x0"), F.min("y").alias("_y0"), (F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.lit(1e-9)) * (1 + 1e-9)).alias("_side"))
    unit = lambda df: df.join(boxes, "project").withColumns({"u": (F.col("x") - F.col("_x0")) / F.col("_side"), "v": (F.col("y") - F.col("_y0")) / F.col("_side")}).drop("_x0", "_y0", "_side")
    anchors = cut(unit(anchors))
    cell = [F.floor(F.col(c) * COARSE_CELLS).alias(f"_{c}") for c in ("u", "v")]
    means = anchors.groupBy("project", "layer", *cell).agg(*[F.avg(c).alias(c) for c in ("x", "y", "z")]).select("project", "layer", F.lit(COARSE).alias("patch"), "x", "y", "z")
    wanted = unit(nodes).join(large, "project").withColumn("patch", F.lit(COARSE))
    columns = ["project", "layer", "patch", "j", "i", "x", "y", "u", "v", "z"]
    both = wanted.withColumn("z", F.lit(None).cast("double")).select(*columns)
    both = both.unionByName(anchors.withColumns({"j": F.lit(None).cast("int"), "i": F.lit(None).cast("int"), "patch": F.lit(COARSE)}).select(*columns))
    based = cut(_on_plates(both, means, block))
    left = based.where("j IS NULL").select("project", "layer", "x", "y", "u", "v", (F.col("z") - F.col("h")).alias("z"))
    base = based.where("j IS NOT NULL").select("project", "layer", "j", "i", "x", "y", "u", "v", F.col("h").alias("base"))
    leaves, levels = _leaves(anchors.select("project", "layer", "u", "v"), large, patch)
    key = ["project", "layer", "level", "a", "b"]
    name = F.concat_ws("/", "level", "a", "b").alias("patch")
    fit = _cells(left, levels).join(leaves, key).select("project", "layer", name, "x", "y", "z")
    share = lambda c, a: (F.col(c) * F.col("_n") - F.col(a) + HALO) / (1 + 2 * HALO)
    bump = lambda t: F.pow(t * (1 - t) * 4, 2)
    seen = _cells(base, levels).join(leaves, key).select("project", "layer", name, "j", "i", "x", "y", (bump(share("u", "a")) * bump(share("v", "b"))).alias("weight"), "n").where("weight > 0")
    bent = _on_plates(seen.where("n > 0"), fit, block).unionByName(seen.where("n = 0").withColumn("h", F.lit(0.0)))
    node = ["project", "layer", "j", "i"]
    bent = bent.groupBy(*node).agg((F.sum(F.col("weight") * F.col("h")) / F.sum("weight")).alias("h"))
    return base.join(bent, node).select("project", "j", "i", "x", "y", "layer", (F.col("base") + F.col("h")).alias("z"))


def thin_plate(nodes: DataFrame, anchors: DataFrame, block: int = NODES, patch: int = PATCH) -> DataFrame:
    """Nodes with z of each layer on the thin plate through its anchors (means at one place; a level plane below three anchors
    or on a line). A layer of a project with more than `patch` places of anchors is fitted in overlapping patches, see _patched;
    its nodes have a j and an i of their own."""
    settled = cut(anchors.groupBy("project", "layer", "x", "y").agg(F.avg("z").alias("z")))
    sizes = cut(settled.groupBy("project", "layer").agg(F.count(F.lit(1)).alias("_n")))
    large, small = (sizes.where(c).select("project", "layer") for c in (F.col("_n") > patch, F.col("_n") <= patch))
    plain = _on_plates(
        nodes.select("project", "j", "i", "x", "y").join(small, "project").withColumn("patch", F.lit(WHOLE)),
        settled.join(small, ["project", "layer"], "left_semi").withColumn("patch", F.lit(WHOLE)),
        block,
    )
    plain = plain.select("project", "j", "i", "x", "y", "layer", F.col("h").alias("z"))
    if large.isEmpty():
        return plain
    return plain.unionByName(_patched(nodes.select("project", "j", "i", "x", "y"), settled.join(large, ["project", "layer"], "left_semi"), large, block, patch))


def layer_order(layer: Column) -> Column:
    out = F.lit(0)
    for n, name in enumerate(LAYERS, start=1):
        out = F.when(layer == name, F.lit(n)).otherwise(out)
    return out


def held_below(grids: DataFrame) -> DataFrame:
    """Each layer at most as high as any above it at the node; a layer not in LAYERS, the ground, comes first."""
    w = Window.partitionBy("project", "j", "i").orderBy(layer_order(F.col("layer"))).rowsBetween(Window.unboundedPreceding, 0)
    return grids.withColumn("z", F.min("z").over(w))


def stacked_boundaries(ground: Column, thicknesses: list[Column], floor: Column) -> list[Column]:
    """Bottoms below the ground by one thickness after the other, none below the floor."""
    out, at = [], ground
    for t in thicknesses:
        at = F.greatest(at - t, floor)
        out.append(at)
    return out


def thickness_controls(present: Column, thickness: Column, absent: Column, nearest: Column) -> Column:
    """Control value of a hole: its thickness; three quarters of the nearest one, below zero, where absence is sure; else none."""
    return F.when(present, thickness).when(absent, nearest * -0.75)


def clamped_thickness(value: Column, floor: Column, greatest: Column) -> Column:
    return F.greatest(F.least(value, greatest * 2), floor)


def absence(drilled: Column, expected_top: Column, present: Column, margin: float = 0.25) -> Column:
    """present, absent where the hole went past the layer's expected top, or unknown."""
    return F.when(present, F.lit("present")).when(drilled >= expected_top + margin, F.lit("absent")).otherwise(F.lit("not_reached"))


def presence_weight(signed: Column) -> Column:
    t = F.least(F.greatest(signed, F.lit(0.0)), F.lit(1.0))
    return t * t * (F.lit(3.0) - t * 2)


def effective_thickness(value: Column, signed: Column) -> Column:
    return F.when((value > 0) & ~F.isnan(value), value * presence_weight(signed)).otherwise(F.lit(0.0))


def absence_radii(nearest: Column, spacing: Column, cell: Column) -> Column:
    """struct<core, transition>: metres around a sure absence without, and with less, of the layer."""
    # The shares and metres of the radii.
    known = F.when(nearest.isNotNull() & ~F.isnan(nearest) & (nearest < float("inf")), nearest).otherwise(F.least(spacing, F.lit(200.0)))
    core = F.least(F.lit(100.0), F.greatest(cell * 2, F.least(known * 0.3, spacing * 0.5, F.lit(100.0))))
    transition = F.least(F.lit(150.0), F.greatest(core + cell, F.least(known * 0.5, spacing * 0.75, F.lit(150.0))))
    return F.struct(core.alias("core"), transition.alias("transition"))


def voxel_count(low: Column, high: Column, step: float = 1.2, least: int = 16, most: int = 96) -> Column:
    return F.least(F.greatest(F.round((high - low) / step), F.lit(least)), F.lit(most)).cast("int")


def voxels(columns: DataFrame, low: str, step: str, count: str, ground: str, bottoms: list[str]) -> DataFrame:
    """(project, j, i, l, label) of a column of cells: 0 above the ground, 1 to n for the layers, n + 1 below the last."""
    level = F.col(low) + F.col(step) * F.col("l")
    label = F.lit(len(bottoms) + 1)
    for n, bottom in reversed(list(enumerate(bottoms, start=1))):
        label = F.when(level > F.col(bottom), F.lit(n)).otherwise(label)
    label = F.when(level > F.col(ground), F.lit(0)).otherwise(label)
    cells = columns.withColumn("l", F.explode(F.sequence(F.lit(0), F.col(count) - 1)))
    return cells.select("project", "j", "i", "l", label.alias("label"))


def capped_by_water(z: Column, terrain: Column, water: Column, clearance: float = 0.05) -> Column:
    """A groundwater level for display: at most the water's level where there is water, and just below the terrain."""
    return F.least(z, F.coalesce(water, z), terrain - clearance)


def water_class(inland: Column, on_land: Column, sea: float = 0.0) -> Column:
    """struct<kind, level> of a cell's water, null for land: inland water at its own level before the sea. Where it isn't known
    what is land (null), there is no sea."""
    level = F.when(inland.isNotNull() & ~F.isnan(inland), F.struct(F.lit("inland").alias("kind"), inland.alias("level")))
    return level.when(~on_land, F.struct(F.lit("sea").alias("kind"), F.lit(sea).alias("level")))


def capped_groundwater(surface: DataFrame, ground: DataFrame, clearance: float = 0.05, least_anchors: int = 3) -> DataFrame:
    """Levels for display (project, j, i, z, cap) of a surface (project, j, i, z, anchors, is_anchor) over ground (project, j, i,
    terrain, water): water's level where there is water, else at most just below the terrain; anchors keep theirs. Without
    enough anchors there is no surface."""
    both = surface.where(F.col("anchors") >= least_anchors).join(ground, ["project", "j", "i"])
    low = F.col("terrain") - clearance
    cap = F.when(F.col("is_anchor"), F.lit("anchor")).when(F.col("water").isNotNull(), F.lit("water")).when(F.col("z") > low, F.lit("terrain")).otherwise(F.lit("none"))
    z = F.when(cap == "water", F.col("water")).when(cap == "terrain", low).otherwise(F.col("z"))
    return both.select("project", "j", "i", z.alias("z"), cap.alias("cap"))


def targets(points: DataFrame) -> DataFrame:
    """Mean of the values that meet at a layer's node."""
    return points.groupBy("layer", "j", "i").agg(F.avg("z").alias("z"), F.count(F.lit(1)).alias("n"))


def _corners(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Numbers of the points that are corners of their convex hull: of each x the lowest and highest, and of these, from either
    side, those at which the chain turns one way."""
    order = np.lexsort((y, x))
    chains = []
    for side in (order, order[::-1]):
        chain: list[int] = []
        for k in side.tolist():
            while len(chain) > 1:
                a, b = chain[-2], chain[-1]
                if (x[b] - x[a]) * (y[k] - y[a]) - (y[b] - y[a]) * (x[k] - x[a]) > 0:
                    break
                del chain[-1]
            chain.append(k)
        chains += chain[:-1]
    return np.unique(np.array(chains or order[:1].tolist(), np.int64))


def _outline(points: DataFrame, key: list[str]) -> DataFrame:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        some = rows.drop_duplicates(["x", "y"])
        return some.iloc[_corners(some["x"].to_numpy(float), some["y"].to_numpy(float))]

    return points.groupBy(*key).applyInPandas(run, points.schema)


def phantoms(holes: DataFrame, scale: float = 1.8, count: int = 12, block: int = NODES) -> DataFrame:
    """Points around each project's holes (project, id, x, y) that keep a surface level beyond them, and the hole each copies.

    From the holes' mean place a ray goes out at each of `count` even angles and meets their convex hull; the point lies `scale`
    times as far. Holes on a line or fewer than three take a circle through the farthest. Hulls are made of blocks of a
    project's holes, then of the blocks' corners; the nearest hole is an aggregate.
    """
    sound = holes.where("x IS NOT NULL AND y IS NOT NULL").select("project", "id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    middles = stored(sound.groupBy("project").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.ceil(F.count(F.lit(1)) / block).alias("_blocks")))
    places = sound.join(middles, "project").withColumn("_block", F.pmod(F.xxhash64("x", "y"), F.col("_blocks")))
    corners = _outline(dealt(places.select("project", "_block", "x", "y", "mx", "my"), "project", "_block"), ["project", "_block"])
    corners = _outline(corners.drop("_block"), ["project"])
    kind = holes.schema["project"].dataType.simpleString()

    def rays(rows: pd.DataFrame) -> pd.DataFrame:
        mx, my = rows["mx"].iloc[0], rows["my"].iloc[0]
        x, y = rows["x"].to_numpy(float) - mx, rows["y"].to_numpy(float) - my
        angle = -np.pi + 2 * np.pi * np.arange(count) / count
        dx, dy = np.cos(angle)[:, None], np.sin(angle)[:, None]
        far = np.full(count, max(float(np.hypot(x, y).max()), 0.002))
        if len(x) >= 3:
            turn = np.argsort(np.arctan2(y, x))
            px, py = x[turn], y[turn]
            ex, ey = np.roll(px, -1) - px, np.roll(py, -1) - py
            across = dx * ey - dy * ex
            safe = np.where(np.abs(across) > 1e-12, across, np.nan)
            t, u = (px * ey - py * ex) / safe, (px * dy - py * dx) / safe
            t = np.where((u >= -1e-9) & (u <= 1 + 1e-9) & (t > 0), t, -np.inf)
            best = t.max(axis=1)
            far = np.where(np.isfinite(best), best, far)
        return pd.DataFrame({"project": rows["project"].iloc[0], "id": -100 - np.arange(count), "x": mx + scale * far * dx[:, 0], "y": my + scale * far * dy[:, 0]})

    around = stored(corners.groupBy("project").applyInPandas(rays, f"project {kind}, id long, x double, y double"))  # a row for each ray
    each = dealt(sound, "id", rows=max(1, ROWS // count))  # a task sorts `count` rows for each of its holes
    met = each.select("project", F.col("id").alias("_hole"), F.col("x").alias("_x"), F.col("y").alias("_y")).join(around, "project")
    apart = F.pow(F.col("x") - F.col("_x"), 2) + F.pow(F.col("y") - F.col("_y"), 2)
    nearest = met.groupBy("project", "id").agg(F.min_by("_hole", F.struct(apart, "_hole")).alias("copies"))
    return around.join(nearest, ["project", "id"])


def phantom_strata(points: DataFrame, strata: DataFrame) -> DataFrame:
    """Strata (borehole_id, depth_top, depth_bottom, strata_group, soil_type) of the holes that phantoms() points copy, as theirs: project, id, name
    and the strata's columns, a missing group being unknown. A hole without strata gives its copies none."""
    copied = points.select("project", "id", F.concat(F.lit("PHANTOM-"), (-F.col("id") - 99).cast("string")).alias("name"), F.col("copies").alias("borehole_id"))
    rows = copied.join(strata.select("borehole_id", "depth_top", "depth_bottom", "strata_group", "soil_type"), "borehole_id")
    return rows.withColumn("strata_group", F.coalesce("strata_group", F.lit("unknown"))).drop("borehole_id")
