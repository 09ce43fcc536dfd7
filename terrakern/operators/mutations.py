"""Changes as pure functions: a table and a table of changes give a new table, to be written beside the old one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrakern.operators.aggregates import first_by
from terrakern.operators.ordering import placed
from terrakern.operators.selection import live


def patched(base: DataFrame, changes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Columns that a change holds replace the base's; a null keeps it."""
    c = changes.select(key, *[F.col(n).alias(f"_{n}") for n in columns])
    return base.join(c, key, "left").withColumns({n: F.coalesce(f"_{n}", n) for n in columns}).drop(*[f"_{n}" for n in columns])


def patched_holes(holes: DataFrame, changes: DataFrame, projects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Holes after changes (id, name, project_id, elevation), null keeping a value, and the changes refused (id, reason): a blank
    name, a project that isn't live, a hole that isn't there."""
    there = holes.select("id").withColumn("_there", F.lit(True))
    alive = live(projects).select(F.col("project_id")).distinct().withColumn("_alive", F.lit(True))
    judged = changes.join(there, "id", "left").join(alive, "project_id", "left")
    reason = (
        F.when(F.col("_there").isNull(), "hole").when(F.trim("name") == "", "name").when(F.col("project_id").isNotNull() & F.col("_alive").isNull(), "project")
    )
    good = judged.where(reason.isNull()).select("id", "name", "project_id", "elevation")
    return patched(holes, good, "id", ["name", "project_id", "elevation"]), judged.where(reason.isNotNull()).select("id", reason.alias("reason"))


def replaced(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of the keys in `new` exchanged for those of `new`."""
    return base.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def soft_deleted(base: DataFrame, gone: DataFrame, key: str, at: Column) -> DataFrame:
    """Marks the rows of the keys in `gone`; those marked before keep their time."""
    g = gone.select(key).distinct().withColumn("_gone", F.lit(True))
    return base.join(g, key, "left").withColumn("deleted_at", F.coalesce("deleted_at", F.when(F.col("_gone"), at))).drop("_gone")


def inserted_if_new(base: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of `new` whose key the base lacks are added, each key once."""
    fresh = first_by(new, list(key), [c for c in new.columns if c not in key]) if len(new.columns) > len(key) else new.distinct()
    return base.unionByName(fresh.join(base.select(*key), list(key), "left_anti").select(*base.columns))


def linked(links: DataFrame, wanted: DataFrame) -> DataFrame:
    """Links (project_id, borehole_id, project_role) after wanted ones are set: excluded stays, new isn't taken back."""
    w = wanted.select("project_id", "borehole_id", F.col("project_role").alias("_role"))
    both = links.join(w, ["project_id", "borehole_id"], "full_outer")
    role = F.when(F.col("project_role").isin("excluded", "new"), F.col("project_role")).otherwise(F.coalesce("_role", "project_role"))
    return both.withColumn("project_role", role).drop("_role")


def synchronised(links: DataFrame, wanted: DataFrame, role: str = "existing") -> DataFrame:
    """A project's links after it names holes (project_id, borehole_id): those named are live again, with `role` where they were excluded or
    not linked; links to other holes stay as they are, whatever their role. Several links to one hole: see projects.linked_to_named."""
    w = wanted.select("project_id", "borehole_id").distinct().withColumn("_wanted", F.lit(True))
    both = links.join(w, ["project_id", "borehole_id"], "full_outer")
    excluded = F.col("project_role").isNull() | (F.col("project_role") == "excluded")
    out = both.withColumn("project_role", F.when(F.col("_wanted") & excluded, F.lit(role)).otherwise(F.col("project_role")))
    if "deleted_at" in links.columns:
        out = out.withColumn("deleted_at", F.when(F.col("_wanted"), F.lit(None)).otherwise(F.col("deleted_at")))
    return out.drop("_wanted")


def reclassified(links: DataFrame, holes: DataFrame, uploads: DataFrame) -> DataFrame:
    """Links take the role of how their hole came: those of a project's own uploads are new, all others existing."""
    own = uploads.select("project_id", "borehole_id").distinct().withColumn("_own", F.lit(True))
    known = links.join(holes.select(F.col("id").alias("borehole_id")), "borehole_id", "left_semi")
    return known.join(own, ["project_id", "borehole_id"], "left").withColumn("project_role", F.when(F.col("_own"), F.lit("new")).otherwise(F.lit("existing"))).drop("_own")


def backfilled(observations: DataFrame, holes: DataFrame, depths: DataFrame, confidence: float = 0.6) -> DataFrame:
    """Observations for holes without a live one, from depths (borehole_id, ord, depth) read in their logs: the first by ord."""
    bare = holes.select(F.col("id").alias("borehole_id"), "elevation").join(live(observations).select("borehole_id"), "borehole_id", "left_anti")
    first = first_by(depths.where("depth IS NOT NULL"), ["borehole_id"], ["ord"])
    return bare.join(first, "borehole_id").select("borehole_id", F.col("depth").alias("depth_bgl_m"), (F.col("elevation") - F.col("depth")).alias("head_elevation_m"), F.lit(confidence).alias("confidence"))


def union_later_wins(groups: Sequence[DataFrame], key: str, order: str | None = None) -> DataFrame:
    """Rows of all groups, of a key that of the last group that has it, with `place`, from 0, where the key was first put: by group, then by
    `order` within it, or by the key."""
    order = order or key
    marked = [g.withColumn("_group", F.lit(n)) for n, g in enumerate(groups)]
    out = marked[0]
    for g in marked[1:]:
        out = out.unionByName(g, allowMissingColumns=True)
    rest = [c for c in out.columns if c not in (key, "_group")]
    first = F.min(F.struct("_group", F.col(order).alias("_order"))).alias("_first")
    best = out.groupBy(key).agg(F.max_by(F.struct(*rest), "_group").alias("_best"), first)
    placed_ = placed(best, [], [F.col("_first._group"), F.col("_first._order"), F.col(key)])
    return placed_.select(key, *[F.col(f"_best.{c}").alias(c) for c in rest], "place")


def by_listed_order(df: DataFrame, key: str, ids: Column) -> DataFrame:
    """Adds place: the last place of the key in an array of ids, 0 where it isn't there."""
    place = F.array_max(F.transform(ids, lambda x, i: F.when(x == F.col(key), i)))
    return df.withColumn("place", F.coalesce(place, F.lit(0)))


def missing_ids(wanted: DataFrame, have: DataFrame, key: str) -> DataFrame:
    return wanted.select(key).distinct().join(have.select(key), key, "left_anti")


def matched_for_upload(new: DataFrame, old: DataFrame, pairs: DataFrame) -> DataFrame:
    """What becomes of each uploaded hole (key, project, source, name_key, survey_key, elevation, signature): replace where a
    hole of the same source and name is within reach (pairs: key, other), link where the project has the same log, else insert.

    Of several the hole with the least id is taken; old has the same columns.
    """
    o = old.select(*[F.col(c).alias(f"_{c}") for c in ("key", "project", "source", "name_key", "survey_key", "elevation", "signature")])
    near = pairs.join(new, "key").join(o, F.col("other") == F.col("_key"))
    replace = near.where((F.col("source") == F.col("_source")) & (F.col("name_key") == F.col("_name_key"))).groupBy("key").agg(F.min("_key").alias("replaces"))
    same = new.join(o, (F.col("project") == F.col("_project")) & (F.col("survey_key") == F.col("_survey_key")) & (F.col("name_key") == F.col("_name_key")) & (F.col("signature") == F.col("_signature")))
    link = same.where(F.abs(F.col("elevation") - F.col("_elevation")) <= 0.05).groupBy("key").agg(F.min("_key").alias("links"))
    out = new.join(replace, "key", "left").join(link, "key", "left")
    action = F.when(F.col("replaces").isNotNull(), F.lit("replace")).when(F.col("links").isNotNull(), F.lit("link")).otherwise(F.lit("insert"))
    return out.select("key", action.alias("action"), F.coalesce("replaces", F.when(action == "link", F.col("links"))).alias("target"))
