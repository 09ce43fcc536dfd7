"""Duplicate holes: found by name and place, told apart by their logs, merged by pointing links at the one that is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrakern.operators.selection import coordinate_outlier, flags


def signature(strata: DataFrame, places: int, key: str = "borehole_id", name: Column | None = None) -> DataFrame:
    """(key, signature): digest of a hole's strata in order, depths rounded to `places`."""
    row = F.struct(F.round("depth_top", places).alias("t"), F.round("depth_bottom", places).alias("b"), (F.col("soil_type") if name is None else name).alias("s"))
    listed = F.sort_array(F.collect_list(row))
    text = F.array_join(F.transform(listed, lambda x: F.concat_ws(":", x["t"].cast("string"), x["b"].cast("string"), x["s"])), ";")
    return strata.groupBy(key).agg(F.sha2(text, 256).alias("signature"))


def grouped(holes: DataFrame, signatures: DataFrame, x: str = "longitude", y: str = "latitude", places: int = 7) -> DataFrame:
    """Groups of two or more holes of one name and place: exact where elevation and strata agree, else in conflict."""
    both = holes.join(signatures.withColumnRenamed("borehole_id", "id"), "id", "left")
    log = F.struct(F.coalesce(F.round("elevation", 4), F.lit(0.0)), F.coalesce("signature", F.lit("")))
    out = both.groupBy("name", F.round(x, places).alias("x"), F.round(y, places).alias("y")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(log).alias("logs"), F.min("id").alias("keep")
    )
    return out.where("n > 1").withColumn("kind", F.when(F.col("logs") == 1, F.lit("exact")).otherwise(F.lit("conflict"))).drop("logs")


def place_conflicts(holes: DataFrame, handled: DataFrame, x: str = "longitude", y: str = "latitude", places: int = 7) -> DataFrame:
    """Places that holes of two or more names share, without those (id) that are handled."""
    left = holes.join(handled.select("id").distinct(), "id", "left_anti")
    out = left.groupBy(F.round(x, places).alias("x"), F.round(y, places).alias("y")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("name").alias("names"), F.array_join(F.sort_array(F.collect_set("name")), ", ").alias("name"))
    return out.where("names > 1").drop("names").withColumn("kind", F.lit("coordinate_conflict"))


def kind_rank(kind: Column) -> Column:
    return F.when(kind == "conflict", 0).when(kind == "coordinate_conflict", 1).otherwise(2)


def summary(groups: DataFrame) -> DataFrame:
    """Groups, holes and removable holes of each kind; of an exact group all but one can go."""
    removable = F.sum(F.when(F.col("kind") == "exact", F.col("n") - 1).otherwise(0))
    return groups.groupBy("kind").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("holes"), removable.alias("removable"))


def keepers(holes: DataFrame, groups: DataFrame, x: str = "longitude", y: str = "latitude", places: int = 7) -> DataFrame:
    """(id, keep) of every hole of an exact group that isn't kept."""
    exact = groups.where("kind = 'exact'").select(F.col("name").alias("_name"), F.col("x").alias("_x"), F.col("y").alias("_y"), "keep")
    same = F.col("name").eqNullSafe(F.col("_name")) & F.round(x, places).eqNullSafe(F.col("_x")) & F.round(y, places).eqNullSafe(F.col("_y"))
    return holes.join(exact, same).where("id <> keep").select("id", "keep")


def repointed(links: DataFrame, moved: DataFrame, key: str = "borehole_id") -> DataFrame:
    """Links with moved holes (id, keep) exchanged. A project keeps one link to a hole: one to the kept hole itself before
    moved ones, of these the least id."""
    both = links.join(moved.select(F.col("id").alias(key), "keep"), key, "left")
    both = both.withColumns({"_moved": F.col("keep").isNotNull().cast("int"), key: F.coalesce("keep", key)}).drop("keep")
    w = Window.partitionBy("project_id", key).orderBy("_moved", "id")
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_moved").select(*links.columns)


def rewritten_ids(lists: DataFrame, column: str, key: str, moved: DataFrame) -> DataFrame:
    """Arrays of ids with moved holes exchanged, each id once, where it first stood."""
    flat = lists.select(key, F.posexplode(column).alias("_at", "id")).join(moved, "id", "left")
    first = flat.groupBy(key, F.coalesce("keep", "id").alias("id")).agg(F.min("_at").alias("_at"))
    back = first.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "id"))), lambda s: s["id"]).alias(column))
    return lists.drop(column).join(back, key, "left").withColumn(column, F.coalesce(column, F.array().cast(lists.schema[column].dataType)))


def quality(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Whether an extraction (key) looks wrong: unread names, implausible depths, or one great depth for most holes.

    rows: (key, name, depth_top, depth_bottom). A hole is a name of the extraction.
    """
    text = F.trim(F.coalesce(name, F.lit("")))
    unread = (text == "") | text.rlike(r"^시추-[0-9]+$") | F.upper(text).isin("UNKNOWN", "N/A")
    odd = (F.col("depth_bottom") > 100) | (F.col("depth_bottom") - F.col("depth_top") > 50)
    known = F.col("depth_top").isNotNull() & F.col("depth_bottom").isNotNull()
    holes = rows.groupBy(key, text.alias("_hole")).agg(
        F.max(unread.cast("int")).alias("_unread"), F.max("depth_bottom").alias("_deepest"), F.sum(known.cast("int")).alias("_known"), F.sum((known & odd).cast("int")).alias("_odd")
    )
    depths = holes.where("_deepest IS NOT NULL").groupBy(key, F.round("_deepest", 1).alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    modes = depths.groupBy(key).agg(F.max_by("_d", F.struct("_n", -F.col("_d"))).alias("_mode"), F.max("_n").alias("_most"), F.sum("_n").alias("_deep"))
    out = holes.groupBy(key).agg(F.count(F.lit(1)).alias("holes"), F.sum("_unread").alias("unread"), F.sum("_known").alias("strata"), F.sum("_odd").alias("odd")).join(modes, key, "left")
    uniform = (F.col("_deep") >= 3) & (F.col("_mode") > 100) & (F.col("_most") >= F.col("_deep") * 0.6)
    share = F.when(F.col("strata") > 0, F.col("odd") / F.col("strata")).otherwise(1.0)
    wrong = (F.col("unread") * 2 >= F.col("holes")) | (share >= 0.3) | F.coalesce(uniform, F.lit(False))
    return out.select(key, "holes", "unread", "strata", "odd", wrong.alias("anomalous"))


def members(holes: DataFrame, groups: DataFrame, x: str = "longitude", y: str = "latitude", places: int = 7) -> DataFrame:
    """(id) of every hole of a group, whatever its kind."""
    g = groups.select(F.col("name").alias("_name"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    same = F.col("name").eqNullSafe(F.col("_name")) & F.round(x, places).eqNullSafe(F.col("_x")) & F.round(y, places).eqNullSafe(F.col("_y"))
    return holes.join(g, same, "left_semi").select("id")


def derived_flags(holes: DataFrame, anomalies: DataFrame, duplicates: DataFrame, status: str = "data_status") -> DataFrame:
    """(id, flags) of what asks for a second look: duplicate (an id of `duplicates`), depth_anomaly, unreviewed (no strata, or a status that
    says so) and coord_outlier. anomalies (borehole_id, depth_anomaly) has a row for each hole with strata."""
    twice = duplicates.select("id").distinct().withColumn("_twice", F.lit(True))
    rows = holes.join(anomalies.select(F.col("borehole_id").alias("id"), "depth_anomaly"), "id", "left").join(twice, "id", "left")
    pending = F.coalesce(F.col(status).contains("pending_review"), F.lit(False))
    named = {"duplicate": F.col("_twice"), "depth_anomaly": F.col("depth_anomaly"), "unreviewed": F.col("depth_anomaly").isNull() | pending, "coord_outlier": coordinate_outlier(F.col("longitude"), F.col("latitude"))}
    return rows.select("id", flags(named).alias("flags"))
