"""Where a layer is present: a signed field over nodes, holes in it filled, and layers of detail inside it.

Nodes (key, x, y) and holes' profiles (key, x, y, thickness, absent) are in metres. All that a node needs of the profiles lies
within a radius or is its few nearest, so nothing is crossed with everything; filling follows connected cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrakern.operators.graph import components
from terrakern.operators.materialise import cut
from terrakern.operators.spatial import nearest, within_radius
from terrakern.operators.surfaces import absence_radii

LEAST, WIDEST = 0.1, 150.0


def absence_zones(profiles: DataFrame, spacing: float, cell: float) -> DataFrame:
    """(key, x, y, core, transition) of profiles that surely lack the layer, by how far the nearest one is that has it."""
    absent = profiles.where("absent").select("key", "x", "y")
    close = nearest(absent, profiles.where("thickness > 0").select("key", "x", "y")).select("key", "d")
    radii = absence_radii(F.col("d"), F.lit(float(spacing)), F.lit(float(cell)))
    return absent.join(close, "key", "left").withColumn("_r", radii).select("key", "x", "y", "_r.core", "_r.transition")


def presence_field(nodes: DataFrame, profiles: DataFrame, spacing: float, cell: float, few: int = 4) -> DataFrame:
    """(key, signed) of every node: 1 at a hole that has the layer, -1 in the core of an absence, rising to 1 over its transition;
    elsewhere what the informative holes around say, weighted by 1 / d ** 2, but above LEAST. The holes around are those within
    a radius, or the `few` nearest where there are fewer than three."""
    nodes = cut(nodes.select("key", "x", "y"))
    profiles = cut(profiles)
    radius = max(80.0, min(spacing * 1.5, 250.0))
    places = profiles.select("key", "x", "y")
    around = cut(within_radius(nodes, places, radius))
    many = around.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    lonely = nodes.join(many, "key", "left_anti")
    scope = around.join(many.select("key"), "key", "left_semi").unionByName(nearest(lonely, places, few).select("key", "other", "d"))
    said = profiles.select(F.col("key").alias("other"), (F.col("thickness") > 0).alias("has"), "absent").where("has OR absent")
    weight = F.lit(1.0) / F.greatest(F.col("d") * F.col("d"), F.lit(1.0))
    shares = scope.join(said, "other").groupBy("key").agg((F.sum(F.when(F.col("has"), weight).otherwise(0.0)) / F.sum(weight)).alias("share"))
    own = within_radius(nodes, profiles.where("thickness > 0").select("key", "x", "y"), max(0.1, cell * 0.2)).select("key").distinct().withColumn("own", F.lit(True))
    zones = absence_zones(profiles, spacing, cell)
    zone = within_radius(nodes, zones.select("key", "x", "y"), WIDEST).join(zones.select(F.col("key").alias("other"), "core", "transition"), "other")
    zone = zone.groupBy("key").agg(F.min_by(F.struct("d", "core", "transition"), F.struct("d", "other")).alias("z"))
    both = nodes.select("key").join(shares, "key", "left").join(own, "key", "left").join(zone, "key", "left")
    t = (F.col("z.d") - F.col("z.core")) / F.greatest(F.col("z.transition") - F.col("z.core"), F.lit(1.0))
    rising = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)) * 2 - 1
    signed = (
        F.when(F.col("own"), 1.0).when(F.col("z.d") <= F.col("z.core"), -1.0).when(F.col("z.d") <= F.col("z.transition"), rising).otherwise(F.greatest(F.coalesce("share", F.lit(1.0)) * 2 - 1, F.lit(LEAST)))
    )
    return both.select("key", signed.alias("signed"))


def filled_holes(grid: DataFrame, size: int, fill: float = 0.01) -> DataFrame:
    """A grid (project, j, i, signed, sure) in which negative cells that don't reach the edge of size x size nodes, by steps along
    rows and columns, become `fill`; a part with a sure absence stays. Adds kind: kept, filled or sure."""
    low = cut(grid.where("signed <= 0").select("project", "j", "i", "sure", F.xxhash64("project", "j", "i").alias("cell")))
    steps = F.explode(F.array(F.struct(F.lit(0).alias("b"), F.lit(1).alias("a")), F.struct(F.lit(1).alias("b"), F.lit(0).alias("a"))))
    ahead = low.select("project", "j", "i", F.col("cell").alias("a"), steps.alias("s")).select("project", (F.col("j") + F.col("s.b")).alias("j"), (F.col("i") + F.col("s.a")).alias("i"), "a")
    edges = ahead.join(low.select("project", "j", "i", F.col("cell").alias("b")), ["project", "j", "i"]).select("a", "b")
    named = low.join(components(edges).withColumnRenamed("node", "cell"), "cell", "left").withColumn("component", F.coalesce("component", "cell"))
    edge = (F.col("j") == 0) | (F.col("i") == 0) | (F.col("j") == size - 1) | (F.col("i") == size - 1)
    parts = named.groupBy("component").agg(F.bool_or(edge).alias("open"), F.bool_or("sure").alias("has_sure"))
    kinds = named.join(parts, "component").select("project", "j", "i", F.when(F.col("open"), "kept").when(F.col("has_sure"), "sure").otherwise("filled").alias("kind"))
    out = grid.join(kinds, ["project", "j", "i"], "left").withColumn("kind", F.coalesce("kind", F.lit("kept")))
    return out.withColumn("signed", F.when(F.col("kind") == "filled", F.greatest("signed", F.lit(fill))).otherwise(F.col("signed")))


def detail_layers(nodes: DataFrame, least: float = 0.05) -> DataFrame:
    """(project, j, i, key, top, bottom) of layers of detail between `top` and `base` of each node, from its `parts`, an array of
    (ord, key, thickness, contact) in the order from above.

    A part takes its share of what is there, by thickness, but not below its contact nor the base; one thinner than `least` is
    left out. What stays below the last is unclassified.
    """
    rows = F.transform(F.array_sort("parts"), lambda p: p)
    total = F.aggregate("parts", F.lit(0.0), lambda s, p: s + F.greatest(p["thickness"], F.lit(0.0)))
    nodes = nodes.withColumns({"_parts": rows, "_all": total, "_room": F.greatest(F.col("top") - F.col("base"), F.lit(0.0))})

    def step(state: Column, p: Column) -> Column:
        at, base = state["at"], F.col("base")
        raw = F.greatest(p["thickness"], F.lit(0.0))
        thick = F.when(F.col("_all") > least, raw / F.col("_all") * F.col("_room")).otherwise(raw)
        bottom = F.greatest(base, F.least(at - least, F.greatest(p["contact"], at - thick)))
        there = (at - base > least) & (thick >= least)
        out = F.concat(state["out"], F.array(F.struct(p["key"].alias("key"), at.alias("top"), bottom.alias("bottom"))))
        return F.struct(F.when(there, bottom).otherwise(at).alias("at"), F.when(there, out).otherwise(state["out"]).alias("out"))

    none = F.array().cast("array<struct<key:string,top:double,bottom:double>>")
    folded = F.aggregate("_parts", F.struct(F.col("top").cast("double").alias("at"), none.alias("out")), step)
    nodes = nodes.withColumn("_f", folded)
    rest = F.array(F.struct(F.lit("unclassified").alias("key"), F.col("_f.at").alias("top"), F.col("base").cast("double").alias("bottom")))
    layers = F.when(F.col("_f.at") - F.col("base") >= least, F.concat("_f.out", rest)).otherwise(F.col("_f.out"))
    return nodes.withColumn("_l", F.explode(layers)).select("project", "j", "i", "_l.key", "_l.top", "_l.bottom")
