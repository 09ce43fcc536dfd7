"""Steps of a ground model over tall grids (project, j, i, z): neighbours, samples, absence, extension, targets, sections.

Neighbours are windows along a row or column, or an equi-join with shifted indices; no grid is gathered in a task.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrakern.operators.aggregates import upper_median
from terrakern.operators.surfaces import LAYERS, distance_weighted
from terrakern.operators.surfaces import grid as even_grid

NODE = ["project", "j", "i"]


def _near(grid: DataFrame) -> DataFrame:
    """Each node's values of the nodes around it and of itself."""
    steps = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(a).alias("a")) for b in (-1, 0, 1) for a in (-1, 0, 1)])
    sent = grid.where("z IS NOT NULL").withColumn("_s", F.explode(steps))
    return sent.select("project", (F.col("j") + F.col("_s.b")).alias("j"), (F.col("i") + F.col("_s.a")).alias("i"), "z")


def filled(grid: DataFrame, passes: int = 3) -> DataFrame:
    """Nodes without a value take their neighbours' mean, pass by pass, and those still without the project's mean."""
    for _ in range(passes):
        around = _near(grid).groupBy(*NODE).agg(F.avg("z").alias("_m"))
        grid = grid.join(around, NODE, "left").withColumn("z", F.coalesce("z", "_m")).drop("_m")
    mean = grid.groupBy("project").agg(F.coalesce(F.avg("z"), F.lit(0.0)).alias("_m"))
    return grid.join(mean, "project").withColumn("z", F.coalesce("z", "_m")).drop("_m")


def mean_of_nine(grid: DataFrame) -> DataFrame:
    around = _near(grid).groupBy(*NODE).agg(F.avg("z").alias("_m"))
    return grid.join(around, NODE).withColumn("z", F.col("_m")).drop("_m")


def clipped(z: Column, low: float = -30.0, high: float = 2000.0) -> Column:
    return F.when(z.between(low, high) & ~F.isnan(z), z)


def smoothed(grid: DataFrame, passes: int = 4) -> DataFrame:
    """Means of three along rows, then along columns; an edge counts itself for what lies beyond."""
    for _ in range(passes):
        for along, across in (("i", "j"), ("j", "i")):
            w = Window.partitionBy("project", across).orderBy(along)
            z = F.col("z")
            grid = grid.withColumn("z", (F.coalesce(F.lag("z").over(w), z) + z + F.coalesce(F.lead("z").over(w), z)) / 3)
    return grid


def sampled(points: DataFrame, grid: DataFrame, boxes: DataFrame) -> DataFrame:
    """Adds z of an even grid at points (project, key, x, y), between its four nodes, at the edge for points outside.

    boxes: (project, x0, y0, dx, dy, columns, rows).
    """
    at = points.join(boxes, "project")
    u = F.least(F.greatest((F.col("x") - F.col("x0")) / F.col("dx"), F.lit(0.0)), F.col("columns") - 1.0)
    v = F.least(F.greatest((F.col("y") - F.col("y0")) / F.col("dy"), F.lit(0.0)), F.col("rows") - 1.0)
    at = at.withColumns({"_u": u, "_v": v}).withColumns({"_i": F.least(F.floor("_u"), F.col("columns") - 2), "_j": F.least(F.floor("_v"), F.col("rows") - 2)})
    corners = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(a).alias("a")) for b in (0, 1) for a in (0, 1)])
    at = at.withColumn("_c", F.explode(corners))
    share = lambda n, side: F.when(F.col(side) == 1, F.col(n) - F.col(f"_{'i' if n == '_u' else 'j'}")).otherwise(1.0 - F.col(n) + F.col(f"_{'i' if n == '_u' else 'j'}"))
    at = at.select("project", "key", (F.col("_j") + F.col("_c.b")).cast("int").alias("j"), (F.col("_i") + F.col("_c.a")).cast("int").alias("i"), (share("_u", "_c.a") * share("_v", "_c.b")).alias("_w"))
    return at.join(grid, NODE).groupBy("project", "key").agg(F.sum(F.col("z") * F.col("_w")).alias("z"))


def kernel(distance: Column, radius: float) -> Column:
    """Smooth weight from 1 at 0 to 0 at the radius."""
    r = F.least(distance / radius, F.lit(1.0))
    return F.pow(F.lit(1.0) - r, 4) * (r * 4 + 1)


def snapped(nodes: DataFrame, errors: DataFrame, radius: float) -> DataFrame:
    """nodes (project, j, i, x, y, z) moved by the errors (project, x, y, error) of anchors near them: at an anchor by its whole
    error, less with distance, a mean of them where several reach. Anchors and nodes meet by cells of the radius."""
    cell = lambda c: F.floor(F.col(c) / radius)
    steps = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(a).alias("a")) for b in (-1, 0, 1) for a in (-1, 0, 1)])
    e = errors.withColumn("_s", F.explode(steps)).select("project", (cell("x") + F.col("_s.a")).alias("_cx"), (cell("y") + F.col("_s.b")).alias("_cy"), F.col("x").alias("_x"), F.col("y").alias("_y"), "error")
    met = nodes.withColumns({"_cx": cell("x"), "_cy": cell("y")}).join(e, ["project", "_cx", "_cy"])
    weight = kernel(F.sqrt(F.pow(F.col("x") - F.col("_x"), 2) + F.pow(F.col("y") - F.col("_y"), 2)), radius)
    moves = met.groupBy(*NODE).agg((F.sum(F.col("error") * weight) / F.greatest(F.sum(weight), F.lit(1.0))).alias("_move"))
    return nodes.join(moves, NODE, "left").withColumn("z", F.col("z") + F.coalesce("_move", F.lit(0.0))).drop("_move")


def constrained_axis(values: DataFrame, bounds: DataFrame, size: int) -> DataFrame:
    """(project, place, at) of an axis: `size` even steps between bounds (project, lo, hi) and the values (project, at) between
    them, each place once to within a part in 1e12."""
    even = bounds.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).select("project", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("_k") / (size - 1)).alias("at"))
    inside = values.join(bounds, "project").where(F.col("at").between(F.col("lo"), F.col("hi"))).select("project", "at")
    w = Window.partitionBy("project").orderBy("at")
    both = even.unionByName(inside).distinct().join(bounds, "project").withColumn("_before", F.lag("at").over(w))
    kept = both.where(F.col("_before").isNull() | (F.col("at") - F.col("_before") > (F.col("hi") - F.col("lo")) * 1e-12))
    return kept.select("project", (F.row_number().over(w) - 1).alias("place"), "at")


def padded_axis(axis: DataFrame, lengths: DataFrame) -> DataFrame:
    """(project, place, at) of an axis (project, at) that has at least as many places as lengths (project, target) asks for, by putting a place
    in the middle of the widest gap, of equal ones the first, again and again.

    Halves of a gap g are g / 2 ** level wide, so the widths that are halved are known beforehand: for each gap and level how many pieces there
    are. All pieces wider than some width are halved and, of that width, the first ones; the width is found by a running count.
    """
    w = Window.partitionBy("project").orderBy("at")
    gaps = axis.select("project", F.col("at").alias("_a"), (F.lead("at").over(w) - F.col("at")).alias("_g")).where("_g > 0")
    have = axis.groupBy("project").agg(F.count(F.lit(1)).alias("_n"))
    need = have.join(lengths, "project").select("project", (F.col("target") - F.col("_n")).alias("_need")).where("_need > 0")
    levels = F.explode(F.sequence(F.lit(0), F.ceil(F.log2(F.col("_need") + 1)).cast("int"))).alias("_level")
    pieces = gaps.join(need, "project").select("*", levels).withColumns({"_width": F.col("_g") / F.pow(F.lit(2.0), F.col("_level")), "_many": F.pow(F.lit(2.0), F.col("_level")).cast("long")})
    widths = pieces.groupBy("project", "_width").agg(F.sum("_many").alias("_all"), F.first("_need").alias("_need"))
    wider = F.sum("_all").over(Window.partitionBy("project").orderBy(F.desc("_width")).rowsBetween(Window.unboundedPreceding, -1))
    widths = widths.withColumn("_left", F.col("_need") - F.coalesce(wider, F.lit(0))).where("_left > 0").select("project", "_width", "_left", (F.col("_left") < F.col("_all")).alias("_some"))
    halved = pieces.join(widths, ["project", "_width"]).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_many") - 1)))
    halved = halved.withColumn("_from", F.col("_a") + F.col("_k") * F.col("_width"))
    first = F.row_number().over(Window.partitionBy("project", "_width").orderBy("_from"))
    new = halved.where("NOT _some").unionByName(halved.where("_some").withColumn("_nth", first).where("_nth <= _left").drop("_nth"))
    both = axis.select("project", "at").unionByName(new.select("project", (F.col("_from") + F.col("_width") / 2).alias("at")))
    return both.select("project", (F.row_number().over(w) - 1).alias("place"), "at")


def boundary_targets(profiles: DataFrame, surface: str = "surface") -> DataFrame:
    """(project, id, layer, z): bottoms of the layers that a hole has (columns named as LAYERS, thicknesses), below the surface
    where it stands; layers that it lacks have no target."""
    parts, depth = [], F.lit(0.0)
    for layer in LAYERS:
        there = F.coalesce(F.col(layer) > 1e-6, F.lit(False))
        depth = depth + F.when(there, F.col(layer)).otherwise(0.0)
        parts.append(F.when(there, F.struct(F.lit(layer).alias("layer"), (F.col(surface) - depth).alias("z"))))
    return profiles.withColumn("_t", F.explode(F.array_compact(F.array(*parts)))).select("project", "id", "_t.layer", "_t.z")


def clamped_boundaries(surface: Column, bottoms: list[Column], floor: Column) -> list[Column]:
    """Bottoms not above what lies above them, nor below the floor."""
    out, upper = [], surface
    for b in bottoms:
        upper = F.greatest(floor, F.least(b, upper))
        out.append(upper)
    return out


def continuous_layers(profiles: DataFrame, states: str = "state") -> DataFrame:
    """(layer, continuous) from (id, layer, state): some hole has it and none is sure to lack it."""
    return profiles.groupBy("layer").agg((F.bool_or(F.col(states) == "present") & ~F.bool_or(F.col(states) == "absent")).alias("continuous"))


def extension_weights(weights: list[Column], fallback: list[Column], least: float = 0.001) -> list[Column]:
    """Shares of the layers below the deepest hole, adding up to 1: by the weights, by the fallback where they vanish, and the
    last layer alone where that vanishes too."""
    total = lambda some: reduce(lambda a, b: a + b, some)
    positive, spare = [F.greatest(w, F.lit(0.0)) for w in weights], [F.greatest(w, F.lit(0.0)) for w in fallback]
    own, other = total(positive), total(spare)
    last = len(weights) - 1
    return [F.when(own > least, p / own).when(other > least, s / other).otherwise(F.lit(float(k == last))) for k, (p, s) in enumerate(zip(positive, spare, strict=True))]


def section_outline(near: DataFrame, segments: DataFrame) -> DataFrame:
    """(key, radius, z_low, z_high) of the holes near a section, over their segments."""
    return near.join(segments, "key").groupBy("key").agg(F.max("radius").alias("radius"), F.min(F.least("z_top", "z_bot")).alias("z_low"), F.max(F.greatest("z_top", "z_bot")).alias("z_high"))


def cut_triangles(triangles: DataFrame, normal: tuple[float, float, float], constant: float) -> DataFrame:
    """(tri, ax, ay, az, bx, by, bz): where a plane cuts triangles (tri, x0 ... z2), those it only touches left out."""
    side = [sum((F.col(f"{c}{k}") * n for c, n in zip("xyz", normal, strict=True)), F.lit(float(constant))) for k in range(3)]
    points = []
    for k in range(3):
        m = (k + 1) % 3
        t = side[k] / (side[k] - side[m])
        crossing = F.when(side[k] * side[m] < 0, F.struct(*[(F.col(f"{c}{k}") + (F.col(f"{c}{m}") - F.col(f"{c}{k}")) * t).alias(c) for c in "xyz"]))
        corner = F.when(side[k] == 0, F.struct(*[F.col(f"{c}{k}").alias(c) for c in "xyz"]))
        points += [corner, crossing]
    met = triangles.withColumn("_p", F.array_distinct(F.array_compact(F.array(*points)))).where(F.size("_p") == 2)
    return met.select("tri", *[F.get("_p", F.lit(n))[c].alias(f"{e}{c}") for n, e in enumerate("ab") for c in "xyz"])


def below_surface(strata: DataFrame, at_holes: DataFrame) -> DataFrame:
    """Strata with z_top and z_bot below a modelled surface (key, z) at their hole (borehole_id), not below its collar."""
    return strata.join(at_holes.select(F.col("key").alias("borehole_id"), F.col("z").alias("_z")), "borehole_id").withColumns({"z_top": F.col("_z") - F.col("depth_top"), "z_bot": F.col("_z") - F.col("depth_bottom")}).drop("_z")


def sampled_uneven(points: DataFrame, grid: DataFrame, axes: DataFrame) -> DataFrame:
    """(project, key, z) of a grid (project, j, i, z) over uneven axes (project, xs, ys: ascending arrays, each of two or more) at
    points (project, key, x, y), between its four nodes, at the edge for points outside."""
    at = points.join(axes, "project")
    below = lambda some, c: F.size(F.filter(some, lambda v: v <= F.col(c)))
    for n, (c, some) in {"i": ("x", "xs"), "j": ("y", "ys")}.items():
        last = F.size(some) - 2
        before = below(some, c) - 1
        at = at.withColumn(f"_{n}", F.greatest(F.least(before, last), F.lit(0)))
        low, high = F.get(some, F.col(f"_{n}")), F.get(some, F.col(f"_{n}") + 1)
        at = at.withColumn(f"_t{n}", F.least(F.greatest((F.col(c) - low) / (high - low), F.lit(0.0)), F.lit(1.0)))
    corners = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(a).alias("a")) for b in (0, 1) for a in (0, 1)])
    at = at.withColumn("_c", F.explode(corners))
    share = lambda n, side: F.when(F.col(side) == 1, F.col(f"_t{n}")).otherwise(1.0 - F.col(f"_t{n}"))
    at = at.select("project", "key", (F.col("_j") + F.col("_c.b")).alias("j"), (F.col("_i") + F.col("_c.a")).alias("i"), (share("i", "_c.a") * share("j", "_c.b")).alias("_w"))
    return at.join(grid, NODE).groupBy("project", "key").agg(F.sum(F.col("z") * F.col("_w")).alias("z"))


def corrected(grid: DataFrame, holes: DataFrame, boxes: DataFrame, most: float = 15.0, passes: int = 4, radius: float = 80.0) -> DataFrame:
    """A terrain grid (project, j, i, x, y, z) moved to the holes' collars (project, key, x, y, z). Residuals within `most` of the
    project's upper median are spread by distance and smoothed, then the nodes near a hole are moved by what is left there."""
    plain = grid.select(*NODE, "z")
    seen = sampled(holes.select("project", "key", "x", "y"), plain, boxes).withColumnRenamed("z", "_g")
    rest = holes.join(seen, ["project", "key"]).select("project", "key", "x", "y", (F.col("z") - F.col("_g")).alias("r"))
    middle = rest.groupBy("project").agg(upper_median("r").alias("_m"))
    good = rest.join(middle, "project").where(F.abs(F.col("r") - F.col("_m")) < most)
    spread = distance_weighted(grid.select(*NODE, "x", "y"), good.select("project", F.lit("r").alias("layer"), "x", "y", F.col("r").alias("z")), 1.0)
    moves = smoothed(spread.select(*NODE, "z"), passes).withColumnRenamed("z", "_r")
    moved = grid.join(moves, NODE, "left").withColumn("z", F.col("z") + F.coalesce("_r", F.lit(0.0))).drop("_r")
    now = sampled(holes.select("project", "key", "x", "y"), moved.select(*NODE, "z"), boxes).withColumnRenamed("z", "_g")
    errors = holes.join(now, ["project", "key"]).join(good.select("project", "key"), ["project", "key"], "left_semi")
    return snapped(moved, errors.select("project", "x", "y", (F.col("z") - F.col("_g")).alias("error")), radius)


def at_resolutions(projects: DataFrame, sizes: list[int], model: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What `model` makes of even grids of several sizes, the preview's and the final one's, with a column `size`."""
    parts = [model(even_grid(projects, n)).withColumn("size", F.lit(n)) for n in sizes]
    return reduce(lambda a, b: a.unionByName(b), parts)
