"""Changes that span tables: creating, revising and overriding holes, applying uploads, virtual holes, merging duplicates.

Each takes tables and a table of requests and gives the new tables, to be written beside the old ones; what is refused comes back
with the reason. Several requests for one thing take effect in their order, `ord` where they have one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrakern.functions import groundwater
from terrakern.operators.duplicates import repointed
from terrakern.operators.intervals import contiguity
from terrakern.operators.materialise import cut
from terrakern.operators.mutations import soft_deleted
from terrakern.operators.ordering import in_pieces, running
from terrakern.operators.selection import live
from terrakern.operators.spatial import within_metres


def created(holes: DataFrame, links: DataFrame, new: DataFrame, strata: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Holes and links with new holes (the columns of holes) added, and the requests refused (id, reason): an id that is taken, or
    a stratum that doesn't end below its top; of sound requests for one id the least by all its columns takes effect, the others are
    repeated. A hole of a project is linked to it, as new if supplementary."""
    bad = strata.where(~F.coalesce(F.col("depth_bottom") > F.col("depth_top"), F.lit(False))).select(F.col("borehole_id").alias("id")).distinct().withColumn("_bad", F.lit(True))
    taken = holes.select("id").withColumn("_taken", F.lit(True))
    judged = new.join(bad, "id", "left").join(taken, "id", "left")
    judged = cut(running(judged, ["id"], [F.col(c) for c in holes.columns if c != "id"], counts={"_nth": F.lit(True)}))
    reason = F.when(F.col("_taken"), F.lit("taken")).when(F.col("_bad"), F.lit("strata")).when(F.col("_nth") > 1, F.lit("repeated"))
    refused = judged.where(reason.isNotNull()).select("id", reason.alias("reason"))
    good = judged.where(reason.isNull()).select(*holes.columns)
    role = F.when(F.col("is_supplementary"), F.lit("new")).otherwise(F.lit("existing"))
    linked = good.where("project_id IS NOT NULL").select("project_id", F.col("id").alias("borehole_id"), role.alias("project_role"))
    return holes.unionByName(good), links.unionByName(linked, allowMissingColumns=True), refused


def revised(revisions: DataFrame, requests: DataFrame) -> DataFrame:
    """Revisions with requests (borehole_id, ord, reason, payload) added, those with a reason and a payload that names something;
    a hole's get the versions after its last in the order of `ord`."""
    names = F.coalesce(F.size(F.json_object_keys("payload")), F.lit(0))
    sound = requests.where((F.trim(F.coalesce("reason", F.lit(""))) != "") & (names > 0))
    last = revisions.groupBy("borehole_id").agg(F.max("version").alias("_last"))
    place = F.row_number().over(Window.partitionBy("borehole_id").orderBy("ord"))
    new = sound.withColumn("_place", place).join(last, "borehole_id", "left")
    new = new.select("borehole_id", (F.coalesce("_last", F.lit(0)) + F.col("_place")).cast("long").alias("version"), "payload")
    return revisions.unionByName(new, allowMissingColumns=True)


def overridden(overrides: DataFrame, requests: DataFrame, holes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Overrides (project_id, source_borehole_id, status, columns...) after requests of the same columns: what a request leaves
    null stays as it was, or is the hole's own value, and a status stays, or is draft. Of several requests for a hole the last that names a
    column sets it. A supplementary hole can't be overridden."""
    key = ["project_id", "source_borehole_id"]
    order = F.struct("ord", *[c for c in requests.columns if c != "ord"]) if "ord" in requests.columns else F.struct(*requests.columns)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order))
    requests = requests.groupBy(*key).agg(*[last(c).alias(c) for c in ("status", *columns)])
    allowed = holes.where(~F.coalesce("is_supplementary", F.lit(False))).select(F.col("id").alias("source_borehole_id"), *[F.col(c).alias(f"_own_{c}") for c in columns])
    asked = requests.select(*key, F.col("status").alias("_status"), *[F.col(c).alias(f"_new_{c}") for c in columns]).join(allowed, "source_borehole_id")
    both = overrides.join(asked.withColumn("_asked", F.lit(True)), key, "full_outer")
    value = {c: F.when(F.col("_asked"), F.coalesce(f"_new_{c}", c, f"_own_{c}")).otherwise(F.col(c)) for c in columns}
    value["status"] = F.when(F.col("_asked"), F.coalesce("_status", "status", F.lit("draft"))).otherwise(F.col("status"))
    return both.withColumns(value).select(*key, "status", *columns)


def deleted_with_links(holes: DataFrame, links: DataFrame, gone: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """Holes of `gone` (id) and their links marked as deleted."""
    return soft_deleted(holes, gone, "id", at), soft_deleted(links, gone.select(F.col("id").alias("borehole_id")), "borehole_id", at)


def merged_duplicates(holes: DataFrame, links: DataFrame, overrides: DataFrame, moved: DataFrame, at: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Holes, links and overrides after moved holes (id, keep) are merged: links and overrides point at the kept hole unless its
    project has one for it already, of several the least id comes first; merged holes are marked as deleted."""
    own = overrides.withColumnRenamed("source_borehole_id", "borehole_id")
    pointed = repointed(own, moved).withColumnRenamed("borehole_id", "source_borehole_id")
    return soft_deleted(holes, moved, "id", at), repointed(links, moved), pointed.select(*overrides.columns)


def applied_upload(holes: DataFrame, strata: DataFrame, links: DataFrame, actions: DataFrame, uploaded: DataFrame, uploaded_strata: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Holes, strata and links after an upload. actions: (key, action, target) as matched_for_upload gives them.

    insert: the hole and its strata are added; replace: the target keeps its id and takes the new columns and strata; link: the
    target stays as it is. Each is linked to the upload's project as new where there is no link yet. Of several uploaded holes for one
    target the last, by `ord` if uploaded has it, then by id, gives columns and strata.
    """
    order = F.struct("ord", "id") if "ord" in uploaded.columns else F.struct("id")
    uploaded = uploaded.withColumn("_order", order)
    a = uploaded.withColumnRenamed("id", "key").join(actions, "key").withColumn("_id", F.coalesce("target", "key"))
    written = a.where("action <> 'link'")
    written = written.join(written.groupBy("_id").agg(F.max("_order").alias("_order")), ["_id", "_order"], "left_semi")
    new = written.select(*[F.col("_id").alias("id") if c == "id" else F.col(c) for c in holes.columns])
    rows = uploaded_strata.withColumnRenamed("borehole_id", "key").join(written.select("key", "_id"), "key").select(*[F.col("_id").alias("borehole_id") if c == "borehole_id" else F.col(c) for c in strata.columns])
    gone = new.select("id")
    wanted = a.select("project_id", F.col("_id").alias("borehole_id")).distinct().join(links.select("project_id", "borehole_id"), ["project_id", "borehole_id"], "left_anti")
    return (
        holes.join(gone, "id", "left_anti").unionByName(new),
        strata.join(gone.withColumnRenamed("id", "borehole_id"), "borehole_id", "left_anti").select(*strata.columns).unionByName(rows),
        links.unionByName(wanted.withColumn("project_role", F.lit("new")), allowMissingColumns=True),
    )


def observed(observations: DataFrame, new: DataFrame) -> DataFrame:
    """Observations (key, depth, head, datum, review_status, deleted_at) after new ones (key, elevation, depth, head) are set by key.

    A level is filled from the other by the elevation. Whatever stood at a key is overwritten and revived: it is confirmed, or needs
    review where depth and head disagree; only its datum, which says what was measured when it was first seen, stays. Several for
    one key take effect in the order of `ord`, where new has it. A row without a level sets nothing.
    """
    level = groundwater.normalized(F.col("elevation"), F.col("depth"), F.col("head"))
    datum = F.when(F.col("depth").isNotNull() & F.col("head").isNotNull(), "GL+EL").when(F.col("head").isNotNull(), "EL").otherwise("GL")
    order = F.struct(*(["ord"] if "ord" in new.columns else []), "depth", "head", "elevation").alias("_order")
    sound = new.where("depth IS NOT NULL OR head IS NOT NULL").select("key", level.alias("_level"), datum.alias("_datum"), order).where("_level.depth IS NOT NULL OR _level.head IS NOT NULL")
    n = sound.groupBy("key").agg(F.max_by("_level", "_order").alias("_level"), F.min_by("_datum", "_order").alias("_datum"))
    both = observations.join(n, "key", "full_outer")
    set_ = F.col("_level").isNotNull()
    status = F.when(F.col("_level.inconsistent"), F.lit("needs_review")).otherwise(F.lit("confirmed"))
    value = {"depth": F.col("_level.depth"), "head": F.col("_level.head"), "datum": F.coalesce("datum", "_datum"), "review_status": status, "deleted_at": F.lit(None).cast(observations.schema["deleted_at"].dataType)}
    return both.select("key", *[F.when(set_, v).otherwise(F.col(c)).alias(c) for c, v in value.items()])


def enabled_virtual(virtual: DataFrame, strata: DataFrame, holes: DataFrame, metres: float = 1.0) -> DataFrame:
    """(key, reason) of virtual holes (key, lon, lat): null where one can be enabled, else close (to a live hole) or strata (not
    without gaps from 0 down)."""
    at = live(holes).select(F.col("id").alias("key"), F.col("longitude").alias("lon"), F.col("latitude").alias("lat"))
    close = within_metres(virtual.select("key", "lon", "lat"), at.dropDuplicates(["lon", "lat"]), metres).select("key").distinct().withColumn("_close", F.lit(True))
    whole = contiguity(strata, ["key"], ["depth_top", "depth_bottom"]).select("key", "contiguous")
    judged = virtual.join(close, "key", "left").join(whole, "key", "left")
    return judged.select("key", F.when(F.col("_close"), "close").when(~F.coalesce("contiguous", F.lit(False)), "strata").alias("reason"))


def versioned_virtual(versions: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Snapshots (key, version, state, data) with changes (key, ord, action, data) added in their order, and the changes refused (key, ord,
    action, reason). What isn't there can only be created, or copied; what is there is updated or deleted; what is deleted takes no
    further change. Each change that is taken is the next version; data that it leaves null stays.

    A key goes from absent to live to deleted and never back, so the first creation and the first deletion after it, two aggregates,
    say of each change what it met; versions and data are running values over ranges of the sorted changes.
    """
    latest = versions.groupBy("key").agg(F.max_by(F.struct("version", "state", "data"), "version").alias("_l"))
    asked = cut(in_pieces(changes.select("key", "ord", "action", F.col("data").alias("_data")), [F.col("key"), F.col("ord"), F.col("action"), F.col("_data")]).drop("_piece"))
    makes, ends = F.col("action").isin("create", "copy"), F.col("action") == "delete"
    born = asked.groupBy("key").agg(F.min(F.when(makes, F.col("_at"))).alias("_first")).join(latest, "key", "left")
    born = born.select("key", "_l", F.when(F.col("_l").isNull(), F.col("_first")).when(F.col("_l.state") != "deleted", F.lit(-1)).alias("_born"))
    lives = asked.join(born, "key")
    gone = lives.where(ends & (F.col("_at") > F.col("_born"))).groupBy("key").agg(F.min("_at").alias("_gone"))
    lives = lives.join(gone, "key", "left")
    at, born_at, gone_at = F.col("_at"), F.col("_born"), F.coalesce("_gone", F.lit((1 << 63) - 1))
    over = (F.col("_l.state") == "deleted") | (at > gone_at)
    early = born_at.isNull() | (at < born_at)
    reason = F.when(F.coalesce(over, F.lit(False)), F.lit("deleted")).when(makes & (early | (at > born_at)), F.lit("taken")).when(~makes & early, F.lit("absent"))
    judged = lives.withColumn("reason", reason)
    refused = judged.where("reason IS NOT NULL").select("key", "ord", "action", "reason")
    taken = running(judged.where("reason IS NULL"), ["key"], [F.col("_at")], last={"_kept": F.col("_data")}, counts={"_n": F.lit(True)})
    new = taken.select(
        "key", (F.coalesce("_l.version", F.lit(0)) + F.col("_n")).cast("long").alias("version"), F.when(ends, "deleted").otherwise("live").alias("state"), F.coalesce("_kept", "_l.data").alias("data")
    )
    return versions.unionByName(new), refused
