"""The effective view of holes: original, then revision, then project override, then project link.

An original is never changed. A payload is JSON text; whether it names a key is kept apart from what it holds, because a null
that is named may clear a value or be ignored, as the layer says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrakern.functions import groundwater
from terrakern.functions.parse import finite
from terrakern.operators.aggregates import latest_by
from terrakern.operators.selection import live


def named(payload: Column, key: str) -> Column:
    """Whether the payload, an object, has the key, be it null."""
    return F.coalesce(F.array_contains(F.json_object_keys(payload), key), F.lit(False))


def value(payload: Column, key: str, kind: str = "double") -> Column:
    return F.get_json_object(payload, f"$.{key}").try_cast(kind)


def latest_revisions(revisions: DataFrame, key: str = "borehole_id", version: str = "version") -> DataFrame:
    return latest_by(live(revisions), [key], [version])


def best_observations(observations: DataFrame, key: str = "borehole_id") -> DataFrame:
    """Of each hole, the observation of the best status, then the latest, then the greatest id; those refused or without a
    level take no part."""
    sound = live(observations).where(~F.coalesce(F.col("review_status").isin(*groundwater.REFUSED), F.lit(False)))
    sound = sound.where(F.col("depth_bgl_m").isNotNull() | F.col("head_elevation_m").isNotNull())
    ranked = sound.withColumns({"_rank": groundwater.status_rank(F.col("review_status")), "_at": F.coalesce("observed_at", "created_at")})
    return latest_by(ranked, [key], ["_rank", "_at", "id"]).drop("_rank", "_at")


def reconciled(elevation: Column, depth: Column, head: Column, datum: Column) -> tuple[Column, Column]:
    """Depth and head after the elevation may have changed: the datum's side is kept where it is known."""
    e, by_head = finite(elevation), F.upper(F.coalesce(datum, F.lit("GL"))) == "EL"
    from_head = F.when(by_head & head.isNotNull(), e - head).when(~by_head & depth.isNull() & head.isNotNull(), e - head)
    from_depth = F.when(~by_head & depth.isNotNull(), e - depth).when(by_head & head.isNull() & depth.isNotNull(), e - depth)
    return F.when(e.isNotNull() & from_head.isNotNull(), from_head).otherwise(depth), F.when(e.isNotNull() & from_depth.isNotNull(), from_depth).otherwise(head)


def with_revision(holes: DataFrame, latest: DataFrame, key: str = "id") -> DataFrame:
    """Latest revisions (borehole_id, version, payload) applied. An elevation counts if it isn't null; a groundwater depth
    counts if it is named, null clearing both levels."""
    r = latest.select(F.col("borehole_id").alias("_hole"), F.col("version").alias("revision_version"), F.col("payload").alias("_payload"))
    out = holes.join(r, holes[key] == r["_hole"], "left")
    p, has = F.col("_payload"), F.col("_hole").isNotNull()
    sets = has & named(p, "groundwater_depth_bgl_m")
    depth = value(p, "groundwater_depth_bgl_m")
    out = out.withColumns(
        {
            "elevation": F.coalesce(value(p, "elevation"), F.col("elevation")),
            "_depth": F.when(sets, depth).otherwise(F.col("groundwater_depth_bgl_m")),
            "_head": F.when(sets & depth.isNull(), F.lit(None)).otherwise(F.col("groundwater_head_elevation_m")),
            "groundwater_reference_datum": F.when(sets, F.coalesce(value(p, "groundwater_reference_datum", "string"), F.lit("GL"))).otherwise(F.col("groundwater_reference_datum")),
        }
    )
    depth, head = reconciled(F.col("elevation"), F.col("_depth"), F.col("_head"), F.col("groundwater_reference_datum"))
    return out.withColumns(
        {
            "groundwater_depth_bgl_m": F.when(has, depth).otherwise(F.col("_depth")),
            "groundwater_head_elevation_m": F.when(has, head).otherwise(F.col("_head")),
            "data_status": F.when(has, F.lit("revised")).otherwise(F.col("data_status")),
        }
    ).drop("_hole", "_payload", "_depth", "_head")


def with_override(holes: DataFrame, overrides: DataFrame, columns: dict[str, str], key: str = "id") -> DataFrame:
    """Live overrides (project_id, source_borehole_id, status, data) that aren't rejected, applied: a key that is named takes
    effect even if it is null. columns: name and type of what an override may set."""
    o = live(overrides).where(F.coalesce(F.col("status") != "rejected", F.lit(True)))
    o = o.select(F.col("project_id").alias("_project"), F.col("source_borehole_id").alias("_hole"), F.col("status").alias("_status"), F.col("data").alias("_data"))
    out = holes.join(o, (holes[key] == o["_hole"]) & (holes["project_id"] == o["_project"]), "left")
    changed = {c: F.when(named(F.col("_data"), c), value(F.col("_data"), c, kind)).otherwise(F.col(c)) for c, kind in columns.items()}
    has = F.col("_hole").isNotNull()
    changed["data_status"] = F.when(has, F.concat(F.lit("modified_"), F.col("_status"))).otherwise(F.col("data_status"))
    changed["is_supplementary"] = F.when(has, F.lit(False)).otherwise(F.col("is_supplementary"))
    return out.withColumns(changed).drop("_project", "_hole", "_status", "_data")


def with_link(holes: DataFrame, links: DataFrame, key: str = "id") -> DataFrame:
    """A row for each live link (project_id, borehole_id, project_role) that isn't excluded, with its role as status."""
    role = F.coalesce("project_role", F.lit("existing"))
    chosen = live(links).withColumn("project_role", role).where("project_role <> 'excluded'")
    chosen = chosen.select(F.col("project_id").alias("_project"), F.col("borehole_id").alias("_hole"), "project_role")
    out = holes.drop("project_role").join(chosen, holes[key] == chosen["_hole"])
    return out.withColumns({"project_id": F.col("_project"), "is_supplementary": F.col("project_role") == "new", "data_status": F.col("project_role")}).drop("_project", "_hole")


def effective(holes: DataFrame, revisions: DataFrame, overrides: DataFrame, links: DataFrame, columns: dict[str, str]) -> DataFrame:
    """All projects' effective holes in one job. A project with links has its linked holes and its own supplementary ones that
    no link of it names; a project without has its own holes.

    A hole is revised once, and then stands once for each project that may show it, with or without a link; overrides are
    applied to all of these at once, as they decide whether a project's own hole is supplementary.
    """
    base = live(holes).drop("project_role")
    revised = with_revision(base.withColumn("data_status", F.when(F.col("is_supplementary"), F.lit("supplementary")).otherwise(F.lit("original"))), latest_revisions(revisions))
    role = F.coalesce("project_role", F.lit("existing"))
    by_hole = live(links).groupBy("borehole_id").agg(F.collect_list(F.struct(F.col("project_id").cast("long").alias("project"), role.alias("role"))).alias("_links"))
    linked_projects = live(links).select("project_id").distinct().withColumn("_linked", F.lit(True))
    own = F.struct(F.col("project_id").cast("long").alias("project"), F.lit(None).cast("string").alias("role"))
    shown = F.concat(F.coalesce(F.filter("_links", lambda t: t["role"] != "excluded"), F.array().cast("array<struct<project:bigint,role:string>>")), F.array(own))
    named_here = F.coalesce(F.exists("_links", lambda t: t["project"] == F.col("project_id")), F.lit(False))
    met = revised.join(by_hole, revised["id"] == by_hole["borehole_id"], "left").withColumns({"_named": named_here, "_shown": shown}).drop("borehole_id", "_links")
    rows = met.withColumn("_t", F.explode("_shown")).withColumns({"project_id": F.col("_t.project"), "project_role": F.col("_t.role")}).drop("_shown", "_t")
    rows = with_override(rows, overrides, columns).join(linked_projects, "project_id", "left")
    through = F.col("project_role").isNotNull()
    kept = rows.where(through | F.col("_linked").isNull() | (F.col("is_supplementary") & ~F.col("_named")))
    # The link's own status stands above the override's.
    status = {"data_status": F.coalesce("project_role", "data_status"), "is_supplementary": F.when(through, F.col("project_role") == "new").otherwise(F.col("is_supplementary"))}
    return kept.withColumns(status).drop("_named", "_linked")


def timeline(holes: DataFrame, revisions: DataFrame, snapshot: Column) -> DataFrame:
    """All versions of all holes: the original as version 0, then its live revisions."""
    zero = holes.select(F.col("id").alias("borehole_id"), F.lit(0).cast("long").alias("version"), snapshot.alias("payload"))
    return zero.unionByName(live(revisions).select("borehole_id", F.col("version").cast("long").alias("version"), "payload"))


def restored(revisions: DataFrame, wanted: DataFrame) -> DataFrame:
    """New revisions that take back the payload of the wanted versions (borehole_id, version)."""
    last = live(revisions).groupBy("borehole_id").agg(F.max("version").alias("_last"))
    old = live(revisions).join(wanted, ["borehole_id", "version"], "left_semi")
    return old.join(last, "borehole_id").select("borehole_id", (F.col("_last") + 1).alias("version"), "payload", F.col("version").alias("restored_from"))
