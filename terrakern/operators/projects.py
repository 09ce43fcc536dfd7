"""Projects created, changed and deleted by requests, with the links to the holes that they name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrakern.operators.ordering import placed
from terrakern.operators.selection import live

FIELDS = ("name", "region")


def judged(projects: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests with reason: null where one is taken, else missing (no live project of that id when it came) or forbidden (neither its
    owner nor an administrator). Creations are always taken.

    A project's owner never changes and what is deleted stays so; the first deletion that its user may ask for, an aggregate, thus says of
    every request what it met. A deletion comes after the changes of the same `ord`.
    """
    known = projects.select("project_id", F.col("owner_id").alias("_owner"), F.col("deleted_at").isNull().alias("_live"))
    met = requests.join(known, "project_id", "left")
    may = F.coalesce((F.col("_owner") == F.col("user_id")) | F.col("is_admin"), F.lit(False))
    met = met.withColumns({"_may": may, "_live": F.coalesce("_live", F.lit(False)), "_last": F.col("action") == "delete"})
    first = met.where("_last AND _may AND _live").groupBy("project_id").agg(F.min("ord").alias("_gone"))
    met = met.join(first, "project_id", "left")
    over = F.coalesce((F.col("ord") > F.col("_gone")), F.lit(False))
    reason = F.when(F.col("action") == "create", F.lit(None)).when(~F.col("_live") | over, F.lit("missing")).when(~F.col("_may"), F.lit("forbidden"))
    return met.select(*requests.columns, reason.cast("string").alias("reason"))


def applied(projects: DataFrame, links: DataFrame, holes: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Projects, links, and refused requests (ord, action, project_id, reason) after requests.

    requests: ord (none twice), action (create, update or delete), project_id (null for a creation), user_id, is_admin, at, selected (ids of
    holes) and FIELDS. A creation gets the next number after the greatest, in the order of requests, and belongs to its user. The
    last update taken sets all FIELDS, nulls too; a deletion sets deleted_at and leaves the links. Holes named by any request
    taken are linked as in `linked_to_named`.
    """
    all_ = judged(projects, requests)
    refused = all_.where("reason IS NOT NULL").select("ord", "action", "project_id", "reason")
    taken = all_.where("reason IS NULL").drop("reason")
    top = projects.agg(F.coalesce(F.max("project_id"), F.lit(0)).alias("_top"))
    made = placed(taken.where("action = 'create'"), [], [F.col("ord")]).crossJoin(F.broadcast(top))  # one row
    made = made.withColumn("project_id", F.col("_top") + F.col("place") + 1)
    set_ = F.max_by(F.struct(*FIELDS), F.when(F.col("action") == "update", F.col("ord")))
    gone = F.min_by("at", F.when(F.col("action") == "delete", F.col("ord")))
    changed = taken.where("action <> 'create'").groupBy("project_id").agg(set_.alias("_set"), gone.alias("_gone"))
    old = projects.join(changed, "project_id", "left").withColumns(
        {f: F.when(F.col("_set").isNotNull(), F.col(f"_set.{f}")).otherwise(F.col(f)) for f in FIELDS} | {"deleted_at": F.coalesce("deleted_at", "_gone")}
    )
    new = made.select("project_id", *FIELDS, F.col("user_id").alias("owner_id"), F.lit(None).cast(projects.schema["deleted_at"].dataType).alias("deleted_at"))
    named = taken.where("action = 'update'").select("project_id", "selected").unionByName(made.select("project_id", "selected"))
    named = named.select("project_id", F.explode("selected").alias("borehole_id"))
    return old.select(projects.columns).unionByName(new, allowMissingColumns=True), linked_to_named(links, holes, named), refused


def linked_to_named(links: DataFrame, holes: DataFrame, named: DataFrame) -> DataFrame:
    """Links (id, project_id, borehole_id, project_role, deleted_at) after projects name holes (project_id, borehole_id).

    A live hole without a link to the project gets one: new if it is the project's own and supplementary, else existing; its id is null
    until it is stored. Of the links it has, one is taken, a live one before deleted ones, of these the least id: it is live again,
    and has the same role where it was excluded. All other links, and those of holes that aren't named or are deleted, stay.
    """
    owner = live(holes).select(F.col("id").alias("borehole_id"), F.col("project_id").alias("_own"), F.coalesce("is_supplementary", F.lit(False)).alias("_sup"))
    wanted = named.select("project_id", "borehole_id").distinct().join(owner, "borehole_id")
    role = F.when(F.col("_sup") & (F.col("_own") == F.col("project_id")), F.lit("new")).otherwise(F.lit("existing"))
    wanted = wanted.select("project_id", "borehole_id", role.alias("_role"))
    order = F.struct(F.col("deleted_at").isNotNull(), F.col("id"))
    best = links.groupBy("project_id", "borehole_id").agg(F.min_by("id", order).alias("_best"))
    met = wanted.join(best, ["project_id", "borehole_id"], "left")
    out = links.join(met.where("_best IS NOT NULL").select(F.col("_best").alias("id"), "_role"), "id", "left")
    revived: dict[str, Column] = {
        "project_role": F.when(F.col("_role").isNotNull() & (F.col("project_role") == "excluded"), F.col("_role")).otherwise(F.col("project_role")),
        "deleted_at": F.when(F.col("_role").isNull(), F.col("deleted_at")),
    }
    first = met.where("_best IS NULL").select("project_id", "borehole_id", F.col("_role").alias("project_role"))
    return out.withColumns(revived).select(links.columns).unionByName(first, allowMissingColumns=True)
