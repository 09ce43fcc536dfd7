"""Small reads: what pages, previews, dialogs and reports ask of holes, strata, jobs and projects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrakern.operators.aggregates import first_by, latest_by
from terrakern.operators.selection import live


def preview_rows(nested: DataFrame) -> DataFrame:
    """A row for each stratum of holes with an array `strata`; a hole without strata has none."""
    rest = [c for c in nested.columns if c != "strata"]
    return nested.select(*rest, F.explode("strata").alias("_s")).select(*rest, "_s.*")


def owned_or_linked(holes: DataFrame, links: DataFrame, project: DataFrame) -> DataFrame:
    """(project_id, id) of holes that a project (project_id) owns or has a live link to that isn't excluded, each once."""
    own = holes.join(project, "project_id", "left_semi").select("project_id", "id")
    good = live(links).where(F.coalesce(F.col("project_role") != "excluded", F.lit(True))).join(project, "project_id", "left_semi")
    through = good.select("project_id", F.col("borehole_id").alias("id")).join(holes.select("id"), "id", "left_semi").select("project_id", "id")
    return own.unionByName(through).distinct()


def newest_job(holes: DataFrame, jobs: DataFrame) -> DataFrame:
    """holes with job_id, the newest job (id, path) of their source_file."""
    newest = jobs.groupBy("path").agg(F.max("id").alias("job_id"))
    return holes.join(newest, holes["source_file"] == newest["path"], "left").drop("path")


def flag_counts(df: DataFrame, origin: str, flags: str) -> DataFrame:
    """(kind, name, n): rows by origin, and by each of their flags."""
    origins = df.groupBy(F.col(origin).alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("origin").alias("kind"), "name", "n")
    flagged = df.select(F.explode(flags).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n")).select(F.lit("flag").alias("kind"), "name", "n")
    return origins.unionByName(flagged)


def summary(rows: DataFrame, hole: Sequence[str]) -> DataFrame:
    """One row of counts over (hole..., depth_top, depth_bottom): rows, different holes and valid strata."""
    valid = F.col("depth_bottom") > F.col("depth_top")
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(F.struct(*hole)).alias("holes"), F.count(F.when(valid, 1)).alias("valid"))


def table_marks(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(name, n, next_id) of each table: its rows and the id that follows its greatest, 1 for an empty one."""
    out = None
    for name, (df, key) in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("n"), (F.coalesce(F.max(key), F.lit(0)) + 1).cast("long").alias("next_id")).select(F.lit(name).alias("name"), "n", "next_id")
        out = row if out is None else out.unionByName(row)
    return out


def plain_name(name: Column) -> Column:
    """A name without blanks and with every kind of dash left out, for finding it in a page's text."""
    return F.upper(F.regexp_replace(F.coalesce(name, F.lit("")), r"[\s\-‐‑‒–—_]+", ""))


def page_of_hole(holes: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, page): the first page (doc, page, text) of a hole's document (doc) that names it, null where none does."""
    met = holes.select("id", "doc", plain_name(F.col("name")).alias("_n")).join(pages.select("doc", "page", plain_name(F.col("text")).alias("_t")), "doc")
    found = met.where((F.col("_n") != "") & F.col("_t").contains(F.col("_n"))).groupBy("id").agg(F.min("page").alias("page"))
    return holes.select("id").join(found, "id", "left")


def health(projects: DataFrame, holes: DataFrame, expected: Sequence[int]) -> DataFrame:
    """One row: live projects and holes, the newest project, and how many of the expected project ids are missing."""
    newest = projects.agg(F.count(F.lit(1)).alias("projects"), F.max("project_id").alias("newest"))
    have = projects.where(F.col("project_id").isin(*expected)).agg((F.lit(len(set(expected))) - F.count_distinct("project_id")).alias("missing"))
    return newest.crossJoin(live(holes).agg(F.count(F.lit(1)).alias("holes"))).crossJoin(have)  # three tables of one row


def only_candidate(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): the value of each key that has one alone, null where there are several."""
    return rows.groupBy(key).agg(F.when(F.count_distinct(value) == 1, F.min(value)).alias(value))


def preview_points(rows: DataFrame, group: str, order: str) -> DataFrame:
    """The first point (x, y) of each group in `order`."""
    return first_by(rows.select(group, order, "x", "y"), [group], [order])


def mean_point(points: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    return points.groupBy(*key).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n"))


def legend(strata: DataFrame) -> DataFrame:
    """(borehole_id, strata_group, depth_top, total_depth): where each group first stands in a hole, and the hole's depth."""
    first = strata.groupBy("borehole_id", "strata_group").agg(F.min("depth_top").alias("depth_top"))
    return first.join(strata.groupBy("borehole_id").agg(F.max("depth_bottom").alias("total_depth")), "borehole_id")


def groups_in_scope(strata: DataFrame, scope: DataFrame) -> DataFrame:
    """Groups that some hole of the scope (borehole_id) has."""
    return strata.join(scope.select("borehole_id").distinct(), "borehole_id", "left_semi").select("strata_group").distinct()


def newest(df: DataFrame, key: str, order: str) -> DataFrame:
    return latest_by(df, [key], [order])


def run_report(jobs: DataFrame, issues: DataFrame, path: str) -> None:
    """A report of a batch as JSON: a line for each job (job, ...) with its count of issues and the first of them by text."""
    counted = issues.groupBy("job").agg(F.count(F.lit(1)).alias("issues"), F.min("issue").alias("first_issue"))
    jobs.join(counted, "job", "left").withColumn("issues", F.coalesce("issues", F.lit(0))).write.mode("overwrite").json(path)


def origin_of_files(holes: DataFrame, links: DataFrame) -> DataFrame:
    """(project_id, source_file, n, new, supplementary) of the files that a project's live holes come from: rows of holes with their live links to
    the same project, how many of them are supplementary or linked as new, and whether any is. A hole linked twice counts twice."""
    own = live(links).select(F.col("borehole_id").alias("id"), "project_id", "project_role")
    met = live(holes).where("source_file IS NOT NULL").join(own, ["id", "project_id"], "left")
    new = F.coalesce(F.col("is_supplementary"), F.lit(False)) | F.coalesce(F.col("project_role") == "new", F.lit(False))
    out = met.groupBy("project_id", "source_file").agg(F.count(F.lit(1)).alias("n"), F.count_if(new).alias("new"))
    return out.withColumn("supplementary", F.col("new") > 0)
