"""The ground model as tables: what each hole shows of each layer, thicknesses between holes, the stack of boundaries and its errors.

Holes are (project, id, x, y, surface), the ground at a hole being the modelled one; nodes are (project, j, i, x, y, ground); grids are
tall, (project, layer, j, i, x, y, z). What asks every node or hole of a project about every other is done by blocks of both that
meet in numpy inside tasks and give sums, or the few nearest; a project of any size is many such blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrakern.operators.aggregates import upper_median
from terrakern.operators.materialise import cut, stored
from terrakern.operators.modelling import NODE, clamped_boundaries, extension_weights
from terrakern.operators.neighbours import nearest_of_places
from terrakern.operators.spatial import on_axis
from terrakern.operators.surfaces import LAYERS, distance_weighted, presence_weight, stacked_boundaries, thin_plate, voxel_count

#: Rows of a block; rows of one that are held against a whole other at once.
BLOCK, STRIP = 4096, 256
LAYER = ["project", "layer"]
Surface = Callable[[DataFrame, DataFrame], DataFrame]

# The least thickness, the margin below an expected top, the shares of the nearest thickness and extension taken where a layer
# is absent, the neighbours asked and the least distance that weighs, the least share of the nearest holes' thickness.
THIN, MARGIN, PINCH, EXTENSION_PINCH, NEIGHBOURS, NEAR, FLOOR_SHARE = 0.001, 0.25, 0.75, 0.3, 4, 0.25, 0.1
# The radius in which holes speak for a node, in spacings, and its bounds in metres; shares that protect and that pinch; the least
# signed value; shares of distances and thicknesses in the rules.
SPACINGS, LEAST_M, MOST_M, PROTECT, PINCHED, LEAST_SIGNED = 1.5, 80.0, 250.0, 0.7, 0.5, 0.1


def _in_blocks(left: DataFrame, right: DataFrame, on: Sequence[str], meet: Callable, schema: str) -> DataFrame:
    """`meet` of each block of left with each block of right of the same `on`, as tables of pandas. A block has about BLOCK rows."""
    on = list(on)
    many = lambda df, name: df.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias(name))
    sizes = cut(many(left, "_rows").join(many(right, "_columns"), on))

    def dealt(df: DataFrame, own: str, other: str, n: str, m: str) -> DataFrame:
        df = df.withColumn("_deal", F.pmod(F.xxhash64(*df.columns), F.lit(1 << 20))).join(sizes, on)
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.col(m) - 1))
        return df.withColumn(own, F.col("_deal") % F.col(n)).withColumn(other, each).drop("_rows", "_columns", "_deal")

    a, b = dealt(left, "_a", "_b", "_rows", "_columns"), dealt(right, "_b", "_a", "_columns", "_rows")
    key = [*on, "_a", "_b"]
    b = b.select(*[F.col(c).alias(c) for c in b.columns])  # both may come from one table
    return a.groupBy(*key).cogroup(b.groupBy(*key)).applyInPandas(meet, schema)


def nearest_in(left: DataFrame, right: DataFrame, on: Sequence[str], k: int = 1, keep: Sequence[str] = ()) -> DataFrame:
    """(on, key, other, d, place, keep): the k nearest of right (on, key, x, y, keep) to each row of left (on, key, x, y), ties by the least key;
    fewer where right has fewer. Keys are unique within `on`; rows without a place have none."""
    near = stored(nearest_of_places(left, right, on, k, keep, _tile()))
    return left.select(*on, "key", "x", "y").join(near, [*on, "x", "y"]).select(*on, "key", "other", "d", "place", *keep)


def _tile() -> int:
    return max(2, BLOCK // 8)


def profiles(holes: DataFrame, strata: DataFrame) -> DataFrame:
    """Holes with what their strata (borehole_id, depth_top, depth_bottom, strata_group) show: drilled depth, the uppermost known layer
    and its top, the deepest and its bottom, and `layers`, the sum of thicknesses and the top of each of LAYERS, null where it isn't. Strata
    that don't end below their top are none; groups not in LAYERS are unknown, and a hole of unknown strata alone has no profile."""
    s = strata.where("depth_bottom > depth_top").withColumn("_known", F.col("strata_group").isin(*LAYERS))
    known = lambda value, by: F.max_by(value, F.when(F.col("_known"), by))
    first = F.when(F.col("_known") & (F.col("depth_bottom") > THIN), F.struct("depth_top", "depth_bottom"))
    own = lambda n, c: F.when(F.col("strata_group") == n, F.col(c))
    each = [F.struct(F.sum(own(n, "depth_bottom") - own(n, "depth_top")).alias("thickness"), F.min(own(n, "depth_top")).alias("top")) for n in LAYERS]
    seen = s.groupBy(F.col("borehole_id").alias("id")).agg(
        F.max("depth_bottom").alias("drilled"), F.min_by(F.struct("strata_group", "depth_top"), first).alias("_first"), F.bool_or("_known").alias("_any"),
        known(F.struct("strata_group", "depth_bottom"), F.struct("depth_bottom", -F.col("depth_top"))).alias("_last"), F.array(*each).alias("layers"),
    )
    seen = seen.where("_any").select("id", "drilled", F.col("_first.strata_group").alias("first_layer"), F.col("_first.depth_top").alias("first_top"), F.col("_last.strata_group").alias("deepest"), F.col("_last.depth_bottom").alias("deepest_bottom"), "layers")
    return holes.join(seen, "id").where("x IS NOT NULL AND y IS NOT NULL AND surface IS NOT NULL")


def layered(profiled: DataFrame, strata: DataFrame | None = None) -> DataFrame:
    """(project, layer, id, x, y, thickness, top, drilled, first_layer, first_top) of every profile and layer; a layer's strata in a hole
    add up, and one that a hole lacks has thickness 0 and no top."""
    if "layers" not in profiled.columns:
        profiled = profiled.join(profiles(profiled.select("project", "id", "x", "y", "surface"), strata).select("id", "layers"), "id")
    each = F.array(*[F.struct(F.lit(n).alias("layer"), F.get("layers", F.lit(k)).alias("s")) for k, n in enumerate(LAYERS)])
    every = profiled.select("project", "id", "x", "y", "drilled", "first_layer", "first_top", F.explode(each).alias("_l"))
    return every.select("project", F.col("_l.layer").alias("layer"), "id", "x", "y", F.coalesce("_l.s.thickness", F.lit(0.0)).alias("thickness"), F.col("_l.s.top").alias("top"), "drilled", "first_layer", "first_top")


def with_states(rows: DataFrame) -> DataFrame:
    """layered() rows with state: present; absent, where soil is not what the hole begins with, or where it went past the top that a rock
    layer has in the nearest holes that have it; else not_reached. Adds `expected`, that top, which is one for all holes at a place."""
    has = F.col("thickness") > THIN
    lacks = rows.where(~has & (F.col("layer") != "soil") & F.col("top").isNull())
    near = nearest_of_places(lacks, rows.where(has).withColumnRenamed("id", "key"), LAYER, NEIGHBOURS, ["top"], _tile())
    weight = F.lit(1.0) / F.greatest(F.col("d"), F.lit(NEAR))
    near = stored(near.groupBy(*LAYER, "x", "y").agg((F.sum(F.col("top") * weight) / F.sum(weight)).alias("_expected")))
    asks = F.when(~has & F.col("top").isNull(), F.col("_expected"))
    both = rows.join(near, [*LAYER, "x", "y"], "left").withColumn("expected", F.coalesce("top", asks))
    soil = (F.col("first_top") <= THIN) & (F.col("first_layer") != "soil")
    gone = F.when(F.col("layer") == "soil", soil).otherwise(F.col("drilled") >= F.col("expected") + MARGIN)
    return both.withColumn("state", F.when(has, "present").when(F.coalesce(gone, F.lit(False)), "absent").otherwise("not_reached")).drop("_expected")


def continuity(stated: DataFrame) -> DataFrame:
    """(project, layer, continuous): some hole has the layer and none surely lacks it. Layers that no hole has are left out."""
    has, gone = F.bool_or(F.col("state") == "present"), F.bool_or(F.col("state") == "absent")
    return stated.groupBy(*LAYER).agg(has.alias("_has"), (~gone).alias("continuous")).where("_has").drop("_has")


def thickness_points(stated: DataFrame, whole: DataFrame) -> DataFrame:
    """(project, layer, id, x, y, z): control points of the layers' thickness. A hole's own; where a layer that isn't soil nor continuous is
    surely absent, less than zero by a share of the nearest one; elsewhere none."""
    whole = stored(whole)
    present = stated.where("state = 'present'")
    gone = stated.where("state = 'absent' AND layer <> 'soil'").join(whole.where("NOT continuous"), LAYER, "left_semi")
    near = stored(nearest_of_places(gone, present.withColumnRenamed("id", "key"), LAYER, 1, ["thickness"], _tile()).select(*LAYER, "x", "y", F.col("thickness").alias("_t")))
    gone = gone.join(near, [*LAYER, "x", "y"])
    return present.select(*LAYER, "id", "x", "y", F.col("thickness").alias("z")).unionByName(gone.select(*LAYER, "id", "x", "y", (F.col("_t") * -PINCH).alias("z")))


def thicknesses(nodes: DataFrame, points: DataFrame, whole: DataFrame, surface: Surface = thin_plate) -> DataFrame:
    """(project, layer, j, i, x, y, raw, z) of layers with a positive control point: the surface through the points, and the same held between a
    floor and twice the greatest. The floor is 0, or where a layer is continuous, and of soil, a tenth of what is near."""
    spans = points.groupBy(*LAYER).agg(F.max("z").alias("_most"), F.min(F.when(F.col("z") > 0, F.col("z"))).alias("_least")).where("_most > 0")
    spans = stored(spans.join(whole, LAYER).withColumn("_whole", F.col("continuous") | (F.col("layer") == "soil")).drop("continuous"))  # a row for each layer
    raw = surface(nodes, points.join(spans, LAYER, "left_semi").select(*LAYER, "x", "y", "z")).select(*LAYER, "j", "i", "x", "y", F.col("z").alias("raw"))
    near = distance_weighted(nodes, points.where("z > 0").join(spans.where("_whole"), LAYER, "left_semi").select(*LAYER, "x", "y", "z"), 1.0)
    both = raw.join(spans, LAYER).join(near.select(*LAYER, "j", "i", F.col("z").alias("_near")), [*LAYER, "j", "i"], "left")
    least = F.greatest(F.lit(THIN * 10), F.col("_least") * FLOOR_SHARE, F.col("_near") * FLOOR_SHARE)
    z = F.greatest(F.when(F.col("_whole"), least).otherwise(F.lit(0.0)), F.least("raw", F.col("_most") * 2))
    return both.select(*LAYER, "j", "i", "x", "y", "raw", z.alias("z"))


def _heard(nodes: DataFrame, held: DataFrame) -> DataFrame:
    """(project, layer, key, state, _t, _n): how many holes with a state and thickness nodes (project, layer, key, x, y, radius) have within their
    radius, MOST_M at the most, of held (project, layer, x, y, state, _t, _n).

    Nodes meet the holes in reach of their cell in numpy. A cell's holes are dealt by state and thickness, so that a node's number of one
    is whole in one block; only where a cell has more than BLOCK places are they dealt by place too, and the numbers added up.
    """
    on, side = [*LAYER, "_cx", "_cy"], MOST_M * 4
    whole = lambda df: df.where((F.abs(F.col("x")) < float("inf")) & (F.abs(F.col("y")) < float("inf")))
    at = whole(nodes).withColumns({"_cx": F.floor(F.col("x") / side), "_cy": F.floor(F.col("y") / side)})
    reach = lambda c: F.explode(F.sequence(F.floor((F.col(c) - MOST_M) / side), F.floor((F.col(c) + MOST_M) / side)))
    there = whole(held).withColumn("_cx", reach("x")).withColumn("_cy", reach("y"))
    many = there.groupBy(*on).agg(F.ceil(F.count_distinct("x", "y") / BLOCK).alias("_slabs"), F.count(F.lit(1)).alias("_m"))
    many = many.withColumn("_values", F.ceil(F.col("_m") / (F.col("_slabs") * BLOCK * 16))).drop("_m")
    sizes = stored(many.join(at.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_rows")), on))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    number = lambda n, *c: F.pmod(F.xxhash64(*c), F.col(n))
    left = at.join(sizes, on).withColumn("_a", number("_rows", "key")).withColumn("_b", each(F.col("_slabs") * F.col("_values"))).drop("_slabs", "_values", "_rows")
    right = there.join(sizes, on).withColumn("_b", number("_slabs", "x", "y") * F.col("_values") + number("_values", "state", "_t")).withColumn("_a", each(F.col("_rows"))).drop("_slabs", "_values", "_rows")
    types = {f.name: f.dataType.simpleString() for f in nodes.schema}

    def meet(some: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        known = known.sort_values(["state", "_t"], ignore_index=True)
        t, state, n = known["_t"].to_numpy(float), known["state"].to_numpy(), known["_n"].to_numpy(np.int64)
        new = np.flatnonzero(np.append(True, (state[1:] != state[:-1]) | ~((t[1:] == t[:-1]) | (np.isnan(t[1:]) & np.isnan(t[:-1])))))
        spots, spot = np.unique(known[["x", "y"]].to_numpy(float), axis=0, return_inverse=True)
        parts = []
        for lo in range(0, len(some) if len(known) else 0, 64):
            part = some.iloc[lo : lo + 64]
            d = np.sqrt((part["x"].to_numpy(float)[:, None] - spots[:, 0]) ** 2 + (part["y"].to_numpy(float)[:, None] - spots[:, 1]) ** 2)
            close = (d <= part["radius"].to_numpy(float)[:, None]).astype(np.int64)
            counts = np.add.reduceat(close[:, spot.ravel()] * n, new, axis=1)
            row, column = np.nonzero(counts)
            parts.append(part[[*LAYER, "key"]].iloc[row].assign(state=state[new[column]], _t=t[new[column]], _n=counts[row, column]))
        return pd.concat(parts) if parts else some[[*LAYER, "key"]].iloc[:0].assign(state="", _t=0.0, _n=0)

    key = [*on, "_a", "_b"]
    met = left.repartition(*key).groupBy(*key).cogroup(right.repartition(*key).groupBy(*key)).applyInPandas(meet, f"project {types['project']}, layer string, key {types['key']}, state string, _t double, _n long")
    met = met.withColumn("_t", F.when(~F.isnan("_t"), F.col("_t")))
    return met.groupBy(*LAYER, "key", "state", "_t").agg(F.sum("_n").alias("_n"))


def rock_presence(nodes: DataFrame, stated: DataFrame, spacings: DataFrame) -> DataFrame:
    """(project, layer, j, i, signed) of nodes (project, layer, j, i, x, y, raw): the raw thickness, lifted where holes that have the layer
    dominate and lowered where holes that surely lack it do. spacings: (project, spacing), the holes' mean distance.

    A node hears the holes within a radius, or its nearest four where there are fewer than three. Holes that didn't reach the
    layer say nothing. The layer's middle thickness around it, or of the project, is the measure.
    """
    nodes = cut(nodes)
    radius = F.least(F.greatest(F.col("spacing") * SPACINGS, F.lit(LEAST_M)), F.lit(MOST_M))
    reach = stored(spacings.select("project", radius.alias("radius")))
    node = F.shiftleft(F.col("j").cast("long"), 32) + F.col("i")
    at = nodes.select(*LAYER, node.alias("key"), "x", "y")
    spot = lambda which: stated.where(which).select(*LAYER, F.col("id").alias("key"), "x", "y", "thickness", "state")
    has, gone = F.col("state") == "present", F.col("state") == "absent"
    # holes at one place with one thickness are counted before they meet the nodes
    held = stated.groupBy(*LAYER, "x", "y", "state", F.when(has, F.col("thickness")).alias("_t")).agg(F.count(F.lit(1)).alias("_n"))
    around = stored(_heard(at.join(reach, "project"), stored(held)))
    near = stored(nearest_in(at, spot("true"), LAYER, NEIGHBOURS, ["thickness", "state"]))
    many = around.groupBy(*LAYER, "key").agg(F.sum("_n").alias("_all")).where("_all >= 3").drop("_all")
    few = near.join(many, [*LAYER, "key"], "left_anti").select(*LAYER, "key", "state", F.when(has, F.col("thickness")).alias("_t"), F.lit(1).cast("long").alias("_n"))
    scope = stored(around.join(many, [*LAYER, "key"], "left_semi").unionByName(few))
    count = lambda c: F.count(F.when(c, 1))
    w = Window.partitionBy(*LAYER, "key")
    ranked = scope.where("_t IS NOT NULL").withColumns({"_over": F.sum("_n").over(w.orderBy(F.col("_t").desc())), "_all": F.sum("_n").over(w)})
    middle = ranked.where(F.col("_over") * 2 >= F.col("_all")).groupBy(*LAYER, "key").agg(F.max("_t").alias("local"))  # the upper median
    told = lambda c: F.coalesce(F.sum(F.when(c, F.col("_n"))), F.lit(0))
    local = scope.groupBy(*LAYER, "key").agg(told(has).alias("present"), told(has | gone).alias("told")).join(middle, [*LAYER, "key"], "left")
    four = near.groupBy(*LAYER, "key").agg(count(has).alias("near_present"), count(has | gone).alias("near_told"))
    least = lambda which, name: nearest_in(at, spot(which), LAYER).select(*LAYER, "key", F.col("d").alias(name))
    usual = stated.where(has).groupBy(*LAYER).agg(upper_median("thickness").alias("usual"))
    both = nodes.withColumn("key", node).join(local, [*LAYER, "key"], "left").join(four, [*LAYER, "key"], "left").join(least("state = 'present'", "to_present"), [*LAYER, "key"], "left")
    both = both.join(least("state = 'absent'", "to_absent"), [*LAYER, "key"], "left").join(usual, LAYER, "left").join(reach, "project")
    ratio = F.when(F.col("told") > 0, F.col("present") / F.col("told")).otherwise(F.lit(0.0))
    thick = F.coalesce("local", "usual", F.lit(LEAST_SIGNED))
    close = (F.col("to_present") <= F.col("radius") * 0.75) & (F.col("to_absent").isNull() | (F.col("to_present") < F.col("to_absent") * 0.75)) & (F.col("near_present") >= F.least(F.lit(3), F.col("near_told")))
    up = ((F.col("told") >= 3) & (ratio >= PROTECT)) | ((F.col("near_told") >= NEIGHBOURS) & (F.col("near_present") == F.col("near_told"))) | close
    down = (F.col("to_absent") <= F.col("radius")) & (F.col("told") > 0) & (ratio < PINCHED) & (F.col("to_present").isNull() | (F.col("to_absent") < F.col("to_present") * 0.8))
    signed = F.when(F.coalesce(up, F.lit(False)), F.greatest("raw", F.greatest(thick * 0.25, F.lit(LEAST_SIGNED)))).when(F.coalesce(down, F.lit(False)), F.least("raw", -F.greatest(thick * 0.1, F.lit(LEAST_SIGNED)))).otherwise(F.col("raw"))
    return both.select(*LAYER, "j", "i", signed.alias("signed"))


def extension_anchors(profiled: DataFrame, floors: DataFrame) -> DataFrame:
    """(project, layer, id, x, y, z): how far each hole's deepest layer would go on to the model's floor (project, floor)."""
    left = F.greatest(F.col("surface") - F.col("deepest_bottom") - F.col("floor"), F.lit(0.0))
    return profiled.join(floors, "project").select("project", F.col("deepest").alias("layer"), "id", "x", "y", left.alias("z"))


def extension_points(anchors: DataFrame) -> DataFrame:
    """(project, layer, id, x, y, z) of anchors, one a hole: control points of each layer's extension: a hole's own where the layer is its deepest and goes on; in all
    the project's other holes less than zero, by a share of the nearest one's. Layers that go on nowhere have none."""
    own = anchors.where(F.col("z") > THIN)
    layers = stored(own.select(*LAYER).distinct())
    every = anchors.select("project", "id", "x", "y", F.when(F.col("z") > THIN, F.col("layer")).alias("_own")).join(layers, "project")
    others = every.where(~F.col("layer").eqNullSafe(F.col("_own")))
    near = stored(nearest_of_places(others, own.withColumnRenamed("id", "key"), LAYER, 1, ["z"], _tile()).select(*LAYER, "x", "y", F.col("z").alias("_z")))
    others = others.join(near, [*LAYER, "x", "y"])
    return own.select(*LAYER, "id", "x", "y", "z").unionByName(others.select(*LAYER, "id", "x", "y", (F.col("_z") * -EXTENSION_PINCH).alias("z")))


def _pulls(nodes: DataFrame, anchors: DataFrame) -> DataFrame:
    """(project, j, i, layer, pull): the sum of z / d ** 2 of a project's anchors, d being at least 1."""
    kind = nodes.schema["project"].dataType.simpleString()

    def meet(some: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for layer, own in known.groupby("layer"):
            for lo in range(0, len(some), STRIP):
                part = some.iloc[lo : lo + STRIP]
                d2 = (part["x"].to_numpy(float)[:, None] - own["x"].to_numpy(float)) ** 2 + (part["y"].to_numpy(float)[:, None] - own["y"].to_numpy(float)) ** 2
                parts.append(part[NODE].assign(layer=layer, pull=(own["z"].to_numpy(float) / np.maximum(d2, 1.0)).sum(axis=1)))
        return pd.concat(parts) if parts else some[NODE].iloc[:0].assign(layer="", pull=0.0)

    met = _in_blocks(nodes.select(*NODE, "x", "y"), stored(anchors.groupBy("project", "layer", "x", "y").agg(F.sum("z").alias("z"))), ["project"], meet, f"project {kind}, j int, i int, layer string, pull double")
    return met.groupBy(*NODE, "layer").agg(F.sum("pull").alias("pull"))


def _wide(tall: DataFrame, value: str, prefix: str = "") -> DataFrame:
    """One row for each node with a column for each of LAYERS."""
    return tall.groupBy(*NODE).agg(*[F.max(F.when(F.col("layer") == n, F.col(value))).alias(prefix + n) for n in LAYERS])


def extension_shares(nodes: DataFrame, anchors: DataFrame, surface: Surface = thin_plate) -> DataFrame:
    """Nodes (project, j, i) with each layer's share, as columns named by it, of what lies below the deepest boundary: by the surfaces
    through the extension's control points; where all are below zero, by the anchors over the square of their distance; where there
    are none, the last layer alone. Adds `basis`: surface, distance or last."""
    fields = surface(nodes, extension_points(anchors).select(*LAYER, "x", "y", "z"))
    wide = cut(nodes.select(*NODE, "x", "y").join(_wide(fields, "z"), NODE, "left"))
    above = lambda c: F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0))
    total = lambda p: reduce(lambda a, b: a + b, [above(F.col(p + n)) for n in LAYERS])
    pulls = _wide(_pulls(wide.where(total("") <= THIN), anchors.where(F.col("z") > THIN)), "pull", "_")
    both = wide.join(pulls, NODE, "left")
    shares = extension_weights([above(F.col(n)) for n in LAYERS], [above(F.col("_" + n)) for n in LAYERS], THIN)
    basis = F.when(total("") > THIN, "surface").when(total("_") > THIN, "distance").otherwise("last")
    return both.select(*NODE, *[s.alias(n) for s, n in zip(shares, LAYERS, strict=True)], basis.alias("basis"))


def boundary_points(profiled: DataFrame, rows: DataFrame) -> DataFrame:
    """(project, layer, id, x, y, z): bottoms that the holes show, below the modelled ground: the layers' thicknesses add up in their order;
    a layer that a hole lacks has none."""
    if "layers" not in profiled.columns:
        place = F.array_position(F.array(*[F.lit(n) for n in LAYERS]), F.col("layer"))
        there = rows.where("thickness > 1e-6").join(profiled.select("id", "surface"), "id")
        depth = F.sum("thickness").over(Window.partitionBy("project", "id").orderBy(place))  # five rows at the most
        return there.select(*LAYER, "id", "x", "y", (F.col("surface") - depth).alias("z"))
    depth, parts = F.lit(0.0), []
    for k, n in enumerate(LAYERS):
        thick = F.get("layers", F.lit(k))["thickness"]
        depth = depth + F.when(thick > 1e-6, thick).otherwise(F.lit(0.0))
        parts.append(F.struct(F.lit(n).alias("layer"), F.when(thick > 1e-6, F.col("surface") - depth).alias("z")))
    each = profiled.select("project", "id", "x", "y", F.explode(F.array(*parts)).alias("_l"))
    return each.where("_l.z IS NOT NULL").select("project", "_l.layer", "id", "x", "y", "_l.z")


def placed_targets(points: DataFrame, axis_x: DataFrame, axis_y: DataFrame) -> DataFrame:
    """(project, layer, j, i, x, y, z, n, low, high): points (project, layer, id, x, y, z) by the node of the axes (project, place, at) where
    they lie, or without j and i by their own place; several at one give their mean."""
    def at(axis: DataFrame, c: str, name: str) -> DataFrame:
        places = points.where(F.col(c).isNotNull()).select("project", F.col(c).alias("key"), F.col(c).alias("at")).distinct()
        return stored(on_axis(axis, places, 1e-10).select("project", F.col("key").alias(c), F.col("place").cast("int").alias(name)))

    both = points.join(at(axis_x, "x", "i"), ["project", "x"], "left").join(at(axis_y, "y", "j"), ["project", "y"], "left")
    node = F.col("i").isNotNull() & F.col("j").isNotNull()
    own = [F.when(~node, F.round(F.col(c), 12)).alias(f"_{c}") for c in "xy"]
    grouped = both.select(*LAYER, *[F.when(node, F.col(c)).alias(c) for c in "ji"], *own, "id", "x", "y", "z").groupBy(*LAYER, "j", "i", "_x", "_y")
    out = grouped.agg(*[F.min_by(c, "id").alias(c) for c in "xy"], F.avg("z").alias("z"), F.count(F.lit(1)).alias("n"), F.min("z").alias("low"), F.max("z").alias("high"))
    return out.select(*LAYER, "j", "i", "x", "y", "z", "n", "low", "high")


def constrained_stack(nodes: DataFrame, thick: DataFrame, placed: DataFrame, floors: DataFrame, ordered: bool = False) -> DataFrame:
    """Nodes with the layers' bottoms, as columns named by them: the thicknesses (project, layer, j, i, z) below the ground one after the other,
    none below the floor, and at a node with targets exactly these. Targets may cross; with `ordered` the bottoms that no hole shows give
    way to them, so that only targets that contradict each other still cross. Adds `unknown`, what is left above the floor, and
    `crossing`, how many bottoms stand above the one before."""
    wide = nodes.select(*NODE, "ground").join(_wide(thick, "z"), NODE, "left").join(floors, "project")
    wide = wide.join(_wide(placed.where("j IS NOT NULL"), "z", "_"), NODE, "left")
    plain = stacked_boundaries(F.col("ground"), [F.coalesce(n, F.lit(0.0)) for n in LAYERS], F.col("floor"))
    held = clamped_boundaries(F.col("ground"), plain, F.col("floor"))
    if ordered:
        upper, out = F.col("ground"), []
        for n, b in zip(LAYERS, held, strict=True):
            upper = F.coalesce("_" + n, F.least(b, upper))
            out.append(upper)
        lower, held = F.lit(float("-inf")), []
        for n, b in reversed(list(zip(LAYERS, out, strict=True))):
            held.insert(0, F.coalesce("_" + n, F.greatest(b, lower)))
            lower = F.greatest(lower, F.coalesce("_" + n, F.lit(float("-inf"))))
    wide = wide.withColumns({n: F.coalesce("_" + n, b) if not ordered else b for n, b in zip(LAYERS, held, strict=True)})
    pairs = list(zip(["ground", *LAYERS[:-1]], LAYERS, strict=True))
    crossing = reduce(lambda a, b: a + b, [(F.col(below) > F.col(above) + 1e-9).cast("int") for above, below in pairs])
    return wide.select(*NODE, "ground", "floor", *LAYERS, (F.col(LAYERS[-1]) - F.col("floor")).alias("unknown"), crossing.alias("crossing"))


def extended_stack(stack: DataFrame, shares: DataFrame) -> DataFrame:
    """A stack in which what is left above the floor is shared out among the layers (project, j, i and a column for each), down to the
    floor; bottoms that stand above the one before are taken as no thickness."""
    both = stack.join(shares.select(*NODE, *[F.col(n).alias("_" + n) for n in LAYERS]), NODE)
    left = F.greatest(F.col("unknown"), F.lit(0.0))
    above = [F.col("ground"), *[F.col(n) for n in LAYERS[:-1]]]
    grown = [F.greatest(a - F.col(n), F.lit(0.0)) + left * F.col("_" + n) for a, n in zip(above, LAYERS, strict=True)]
    bottoms = stacked_boundaries(F.col("ground"), grown[:-1], F.col("floor"))
    return both.select(*NODE, "ground", "floor", *[b.alias(n) for b, n in zip(bottoms, LAYERS[:-1], strict=True)], F.col("floor").alias(LAYERS[-1]))


def tall(stack: DataFrame) -> DataFrame:
    """(project, layer, j, i, z) of a stack."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("layer"), F.col(n).alias("z")) for n in LAYERS])).alias("_l")
    return stack.select(*NODE, each).select("project", "_l.layer", "j", "i", "_l.z")


def stack_errors(stack: DataFrame, placed: DataFrame, axis_x: DataFrame, axis_y: DataFrame) -> DataFrame:
    """(project, layer, targets, greatest, mean): how far the boundaries, between their four nodes, are off the targets."""
    where = cut(placed.select(*LAYER, "x", "y", "z").withColumn("_row", F.monotonically_increasing_id()))
    at = where
    for axis, c, name in ((axis_x, "x", "i"), (axis_y, "y", "j")):
        at = at.join(_segments(where, axis, c, name), ["project", "_row"])
    corner = F.explode(F.array(*[F.struct(F.lit(b).alias("b"), F.lit(a).alias("a")) for b in (0, 1) for a in (0, 1)]))
    share = lambda t, side: F.when(F.col(side) == 1, F.col(t)).otherwise(1.0 - F.col(t))
    at = at.withColumn("_c", corner).withColumns({"j": F.col("_j") + F.col("_c.b"), "i": F.col("_i") + F.col("_c.a"), "_w": share("_ti", "_c.a") * share("_tj", "_c.b")})
    met = at.where("_w > 0").join(tall(stack).withColumnRenamed("z", "_z"), [*LAYER, "j", "i"]).groupBy(*LAYER, "_row").agg(F.first("z").alias("z"), F.sum(F.col("_z") * F.col("_w")).alias("_z"))
    error = F.abs(F.col("_z") - F.col("z"))
    return met.groupBy(*LAYER).agg(F.count(F.lit(1)).alias("targets"), F.max(error).alias("greatest"), F.avg(error).alias("mean"))


def _segments(points: DataFrame, axis: DataFrame, c: str, name: str) -> DataFrame:
    """(project, _row, _name, _tname): the step of an axis (project, place, at) that a point lies in and the share of it, the edge for
    points outside. Axis and points are merged in one order of a project, by ranges, so that each point knows the step before it."""
    w = Window.partitionBy("project").orderBy("at")
    steps = axis.withColumns({"_to": F.lead("at").over(w)}).where("_to IS NOT NULL")
    ends = axis.groupBy("project").agg(F.min("at").alias("_lo"), F.max("at").alias("_hi"), (F.count(F.lit(1)) - 1).alias("_steps"))
    cell = lambda at: F.least(F.floor((at - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.col("_steps")), F.col("_steps") - 1)
    held = steps.join(ends, "project").withColumn("_cell", F.explode(F.sequence(cell(F.col("at")), cell(F.col("_to"))))).select("project", "_cell", F.col("place").alias("_place"), F.col("at").alias("_from"), "_to", "_hi")
    inside = F.least(F.greatest(F.col(c), F.col("_lo")), F.col("_hi"))
    at = points.select("project", "_row", c).join(ends, "project").withColumn("_v", inside).withColumn("_cell", cell(F.col("_v"))).select("project", "_row", "_v", "_cell")
    met = at.join(held, ["project", "_cell"]).where((F.col("_from") <= F.col("_v")) & ((F.col("_v") < F.col("_to")) | ((F.col("_to") == F.col("_hi")) & (F.col("_v") == F.col("_hi")))))
    return met.select("project", "_row", F.col("_place").cast("int").alias(f"_{name}"), ((F.col("_v") - F.col("_from")) / (F.col("_to") - F.col("_from"))).alias(f"_t{name}"))


@dataclass
class Model:
    """A ground model: what the holes show, the layers' thickness, targets and stack, each written to the shared folder once; the
    states of layers, the extended stack, the errors and the cells are worked out when asked for."""

    nodes: DataFrame
    axis_x: DataFrame
    axis_y: DataFrame
    floors: DataFrame
    surface: Surface
    profiled: DataFrame
    stated: DataFrame
    thick: DataFrame
    placed: DataFrame
    stack: DataFrame

    def extended(self) -> DataFrame:
        return extended_stack(self.stack, extension_shares(self.nodes, extension_anchors(self.profiled, self.floors), self.surface))

    def errors(self) -> DataFrame:
        return stack_errors(self.stack, self.placed, self.axis_x, self.axis_y)

    def voxels(self) -> DataFrame:
        return model_voxels(self.stack, self.extended())


def model(holes: DataFrame, strata: DataFrame, nodes: DataFrame, axis_x: DataFrame, axis_y: DataFrame, floors: DataFrame, surface: Surface = thin_plate, soil_signed: DataFrame | None = None, ordered: bool = False) -> Model:
    """The whole model of all projects: from holes (project, id, x, y, surface) and strata to the boundaries at nodes (project, j, i, x, y, ground)
    of the axes (project, place, at), above floors (project, floor). `soil_signed` (project, j, i, signed) is where there is soil: its
    thickness follows it down to nothing. Without holes the stack is the ground."""
    profiled = stored(profiles(holes, strata))
    rows = layered(profiled)
    stated = with_states(rows)
    whole = stored(continuity(stated))
    plain = nodes.select(*NODE, "x", "y")
    thick = thicknesses(plain, thickness_points(stated, whole), whole, surface)
    if soil_signed is not None:
        weight = F.coalesce(presence_weight(F.col("signed")), F.lit(1.0))
        thick = thick.join(soil_signed.withColumn("layer", F.lit("soil")), [*LAYER, "j", "i"], "left").withColumn("z", F.col("z") * weight).drop("signed")
    thick = cut(thick)
    placed = cut(placed_targets(boundary_points(profiled, rows), axis_x, axis_y))
    stack = cut(constrained_stack(nodes, thick, placed, floors, ordered))
    return Model(plain, axis_x, axis_y, floors, surface, profiled, stated, thick, placed, stack)


def model_voxels(stack: DataFrame, extended: DataFrame) -> DataFrame:
    """(project, j, i, l, label, label_extended) of cells from the floor to a project's highest ground: 0 above the ground, 1 to 5 for the layers and 6
    below them; extended, what stands on the floor is the deepest layer that has a thickness there."""
    tops = stack.groupBy("project").agg(F.max("ground").alias("_top"))
    both = stack.join(extended.select(*NODE, *[F.col(n).alias("_" + n) for n in LAYERS]), NODE).join(tops, "project")
    range_ = F.greatest(F.col("_top") - F.col("floor"), F.lit(1.0))
    both = both.withColumn("_count", voxel_count(F.lit(0.0), range_)).withColumn("_step", range_ / (F.col("_count") - 1))
    cells = both.withColumn("l", F.explode(F.sequence(F.lit(0), F.col("_count") - 1)))
    level = F.col("floor") + F.col("_step") * F.col("l")
    label, grown = F.lit(len(LAYERS) + 1), F.lit(1)
    for k, (above, n) in enumerate(zip(["ground", *["_" + n for n in LAYERS[:-1]]], LAYERS, strict=True)):
        grown = F.when(F.col(above) - F.col("_" + n) > 1e-9, F.lit(k + 1)).otherwise(grown)
    for k, n in reversed(list(enumerate(LAYERS))):
        label, grown = F.when(level > F.col(n), F.lit(k + 1)).otherwise(label), F.when(level > F.col("_" + n), F.lit(k + 1)).otherwise(grown)
    air = level > F.col("ground")
    return cells.select(*NODE, "l", F.when(air, F.lit(0)).otherwise(label).alias("label"), F.when(air, F.lit(0)).otherwise(grown).alias("label_extended"))
