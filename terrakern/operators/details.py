"""Layers of detail inside the soil, from what holes show: occurrences of names, their order in a project, their share at each node.

An occurrence is the n-th time a hole shows a name from the top down; `key` is name#n. What a node needs of all holes are means by
distance, sums over blocks; what it does with them is a fold over its few occurrences.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrakern.functions import names
from terrakern.operators.ground import placed_targets
from terrakern.operators.materialise import stored
from terrakern.operators.surfaces import distance_weighted, weighted_by_places

# The name of soil that says no more, the least thickness of a layer of detail, and of a stratum.
PLAIN, LEAST, THIN = "토사", 0.05, 0.001
NODE = ["project", "j", "i"]


def occurrences(holes: DataFrame, strata: DataFrame) -> DataFrame:
    """(project, id, x, y, key, name, nth, place, thickness, z, after) of each stratum of soil with a name of its own in holes (project, id, x, y,
    surface), from strata (borehole_id, depth_top, depth_bottom, strata_group, soil_type): z is its bottom's level, after the key right below."""
    s = strata.where("strata_group = 'soil'").where(F.col("depth_bottom") - F.col("depth_top") > THIN).select(F.col("borehole_id").alias("id"), "depth_top", "depth_bottom", F.coalesce(names.soil_detail(F.col("soil_type")), F.lit(PLAIN)).alias("name"))
    s = holes.select("project", "id", "x", "y", "surface").join(s.where(F.col("name") != PLAIN), "id")
    order = ["depth_top", "depth_bottom", "name"]
    hole, own = Window.partitionBy("id").orderBy(*order), Window.partitionBy("id", "name").orderBy(*order)
    s = s.withColumns({"nth": F.row_number().over(own), "place": F.row_number().over(hole) - 1})
    s = s.withColumn("key", F.concat("name", F.lit("#"), F.col("nth").cast("string")))
    return s.select("project", "id", "x", "y", "key", "name", "nth", "place", (F.col("depth_bottom") - F.col("depth_top")).alias("thickness"), (F.col("surface") - F.col("depth_bottom")).alias("z"), F.lead("key").over(hole).alias("after"))


def occurrence_places(found: DataFrame, words: Sequence[str]) -> DataFrame:
    """(project, key, place): each project's keys in an order that no hole contradicts; ties by the words' own order, then by n, by the mean place
    in the holes and by key. Keys that holes contradict each other about follow in that order. A project's keys are as many as its names and
    how often a hole repeats one: a small table, walked with a heap."""
    found = stored(found)
    rank = F.array_position(F.array(*[F.lit(w) for w in words]), F.col("name"))
    keys = found.groupBy("project", "key").agg(F.min(F.when(rank > 0, rank).otherwise(len(words) + 1)).alias("rank"), F.min("nth").alias("nth"), F.avg("place").alias("mean"), F.collect_set("after").alias("below"))
    kind = found.schema["project"].dataType.simpleString()

    def kahn(rows: pd.DataFrame) -> pd.DataFrame:
        ranks = {r.key: (r.rank, r.nth, r.mean, r.key) for r in rows.itertuples()}
        below = {r.key: [b for b in r.below if b in ranks and b != r.key] for r in rows.itertuples()}
        waits = dict.fromkeys(ranks, 0)
        for some in below.values():
            for b in some:
                waits[b] += 1
        ready, out = [ranks[k] for k, w in waits.items() if not w], []
        heapq.heapify(ready)
        while ready:
            key = heapq.heappop(ready)[-1]
            out.append(key)
            for b in below[key]:
                waits[b] -= 1
                if not waits[b]:
                    heapq.heappush(ready, ranks[b])
        done = set(out)
        out += [r[-1] for r in sorted(r for k, r in ranks.items() if k not in done)]
        return pd.DataFrame({"project": rows["project"].iloc[0], "key": out, "place": range(len(out))})

    return keys.groupBy("project").applyInPandas(kahn, f"project {kind}, key string, place int")


def detail_parts(nodes: DataFrame, found: DataFrame, soil: DataFrame, places: DataFrame, axis_x: DataFrame, axis_y: DataFrame) -> DataFrame:
    """Nodes (project, j, i) with `parts`, an array of (place, key, thickness, contact, snap) in the project's order: the mean by distance of an
    occurrence's thickness over all holes with soil (project, id, x, y), 0 where a hole lacks it; that of its bottom over the holes
    that have it; and at a node where holes stand, the mean of what they show. Holes are counted by their places before they meet the keys."""
    found = stored(found)
    at, spot = ["project", "layer", "j", "i"], ["project", "x", "y"]
    plain = nodes.select(*NODE, "x", "y")
    holes = soil.select("project", "id", "x", "y")
    every = holes.groupBy(*spot).agg(F.count(F.lit(1)).alias("n")).join(places.select("project", F.col("key").alias("layer")), "project")
    own = holes.join(found.groupBy("project", "id", F.col("key").alias("layer")).agg(F.coalesce(F.sum("thickness"), F.lit(0.0)).alias("t")), ["project", "id"])
    own = own.groupBy(*spot, "layer").agg(F.sum("t").alias("z"), F.min("t").alias("low"), F.count(F.lit(1)).alias("_have"))
    low = F.when(F.col("_have") < F.col("n"), F.least("low", F.lit(0.0))).otherwise(F.col("low"))
    thick = every.join(own, [*spot, "layer"], "left").select(*spot, "layer", F.coalesce("z", F.lit(0.0)).alias("z"), "n", F.coalesce(low, F.lit(0.0)).alias("low"))
    shares = weighted_by_places(plain, thick).select(*at, F.col("z").alias("thickness"))
    bottoms = found.select("project", F.col("key").alias("layer"), "id", "x", "y", "z")
    contacts = distance_weighted(plain, bottoms.drop("id")).select(*at, F.col("z").alias("contact"))
    snaps = placed_targets(bottoms, axis_x, axis_y).where("j IS NOT NULL").select(*at, F.col("z").alias("snap"))
    rows = shares.join(contacts, at).join(snaps, at, "left").withColumnRenamed("layer", "key").join(places, ["project", "key"])
    listed = F.array_sort(F.collect_list(F.struct("place", "key", "thickness", "contact", "snap")))
    return rows.groupBy(*NODE).agg(listed.alias("parts"))


def layers_of_detail(nodes: DataFrame, parts: DataFrame) -> DataFrame:
    """(project, j, i, key, top, bottom) of nodes (project, j, i, top, base) between the ground and the bottom of the soil.

    From the top down each part takes its share, by thickness, of all that is there, ending no deeper than its contact; where holes stand it
    ends where they show it. No layer is thinner than LEAST nor reaches below the base; what stays over is plain soil, all of it
    where there are no parts.
    """
    both = nodes.select(*NODE, "top", "base").join(parts, NODE, "left").withColumn("parts", F.coalesce("parts", F.expr("CAST(array() AS array<struct<place:int,key:string,thickness:double,contact:double,snap:double>>)")))
    total = F.aggregate("parts", F.lit(0.0), lambda s, p: s + F.greatest(p["thickness"], F.lit(0.0)))
    both = both.withColumns({"_all": total, "_room": F.greatest(F.col("top") - F.col("base"), F.lit(0.0))})

    def bottom(at: Column, p: Column) -> Column:
        raw = F.greatest(p["thickness"], F.lit(0.0))
        thick = F.when(F.col("_all") > LEAST, raw / F.col("_all") * F.col("_room")).otherwise(raw)
        held = lambda z: F.greatest(F.col("base"), F.least(at - LEAST, z))
        free = F.when((at - F.col("base") <= LEAST) | (thick < LEAST), at).otherwise(held(F.greatest(p["contact"], at - thick)))
        return F.when(p["snap"].isNotNull(), held(p["snap"])).otherwise(free)

    # bottoms one by one: each list is as short as a project's names
    start = F.array(F.col("top"))
    ends = F.aggregate("parts", start, lambda ends, p: F.concat(ends, F.array(bottom(F.element_at(ends, -1), p))))
    both = both.withColumn("_e", ends)
    own = F.transform("parts", lambda p, n: F.struct(p["key"].alias("key"), F.get(F.col("_e"), n).alias("top"), F.get(F.col("_e"), n + 1).alias("bottom")))
    rest = F.struct(F.lit(PLAIN).alias("key"), F.element_at("_e", -1).alias("top"), F.col("base").alias("bottom"))
    rows = both.select(*NODE, F.explode(F.concat(own, F.array(rest))).alias("_l")).select(*NODE, "_l.key", "_l.top", "_l.bottom")
    return rows.where(F.col("top") - F.col("bottom") >= LEAST)
