"""Filters and projections over holes, strata and projects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrakern.functions.names import any_of
from terrakern.operators.aggregates import upper_median_of_all


def live(df: DataFrame, deleted: str = "deleted_at") -> DataFrame:
    """Rows that aren't soft-deleted."""
    return df.where(F.col(deleted).isNull())


def by_ids(df: DataFrame, key: str, ids: Sequence[int] | DataFrame | None) -> DataFrame:
    """Rows of the ids, given as a list or as a table with `key`; None or an empty list lets all pass."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(key).distinct(), key, "left_semi")
    return df.where(F.col(key).isin(*ids)) if ids else df


def selected(df: DataFrame, key: str, saved: DataFrame | None) -> DataFrame:
    """Rows of a saved selection; without one, all; of an empty one, none."""
    return df if saved is None else df.join(saved.select(key).distinct(), key, "left_semi")


def equal_unless_all(df: DataFrame, column: str, value) -> DataFrame:
    """Equality, switched off by None or 'all'."""
    return df if value is None or value == "all" else df.where(F.col(column) == value)


def keyword(df: DataFrame, text: str | None, columns: Sequence[str]) -> DataFrame:
    """Rows of which a column, as text, holds the words; % and _ are wildcards, case doesn't count."""
    text = (text or "").strip()
    return df.where(any_of([F.col(c).cast("string").ilike(f"%{text}%") for c in columns])) if text else df


def in_box(df: DataFrame, x: str, y: str, box: Sequence[float]) -> DataFrame:
    """Rows in or on a box (min x, min y, max x, max y); the comparisons reach the scan."""
    x0, y0, x1, y1 = box
    if x0 > x1 or y0 > y1:
        raise ValueError("a box runs from its least to its greatest corner")
    return df.where(F.col(x).between(x0, x1) & F.col(y).between(y0, y1))


def not_prefixed(df: DataFrame, column: str, prefixes: Sequence[str]) -> DataFrame:
    return df.where(~any_of([F.col(column).startswith(p) for p in prefixes]))


def listed_projects(df: DataFrame, status: str | None = "all", kind: str | None = "all", has_box: bool | None = None, hidden: Sequence[str] = ()) -> DataFrame:
    """Live projects (project, status, kind, bbox, deleted_at) of a status and a kind, None or 'all' for any, with or without a box,
    and of no hidden prefix."""
    rows = equal_unless_all(equal_unless_all(live(df), "status", status), "kind", kind)
    rows = rows if has_box is None else rows.where(F.col("bbox").isNotNull() if has_box else F.col("bbox").isNull())
    return not_prefixed(rows, "project", list(hidden)) if hidden else rows


def finite_rows(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose columns are all finite numbers, and the others."""
    sound = F.lit(True)
    for c in columns:
        sound = sound & F.coalesce(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.lit(False))
    return df.where(sound), df.where(~sound)


def valid_intervals(df: DataFrame, top: str, bottom: str) -> DataFrame:
    return df.where(F.col(bottom) > F.col(top))


def within_upper_median(df: DataFrame, column: str, most: float) -> DataFrame:
    """Rows less than `most` from the upper median of all."""
    return df.where(F.abs(F.col(column) - F.lit(upper_median_of_all(df, column))) < most)


def depth_warnings(df: DataFrame, depth: str, times: float = 5.0, least: float = 100.0) -> DataFrame:
    """Adds warn: a depth above `times` the upper median, or `least`."""
    bound = max((upper_median_of_all(df, depth) or 0.0) * times, least)
    return df.withColumn("warn", F.coalesce(F.col(depth) > bound, F.lit(False)))


def severity(gap: Column) -> Column:
    """Class of a gap between a log's elevation and the terrain's, in metres."""
    size = F.abs(gap)
    return F.when(size.isNull(), F.lit(None)).when(size < 0.5, F.lit("normal")).when(size < 1.0, F.lit("minor")).when(size < 2.0, F.lit("major")).otherwise(F.lit("critical"))


def flags(named: dict[str, Column]) -> Column:
    """Names of the conditions that hold, in their order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in named.items()]))


def coordinate_outlier(lng: Column, lat: Column, west: float = 124, east: float = 132, south: float = 33, north: float = 43) -> Column:
    out = lng.isNull() | lat.isNull() | ((lng == 0) & (lat == 0)) | ~lng.between(west, east) | ~lat.between(south, north)
    return F.coalesce(out, F.lit(True))


def zone(lon: Column, lat: Column, hard: Sequence[float], soft: Sequence[float], home: Sequence[float] = (124.0, 33.0, 132.0, 39.0)) -> Column:
    """hard, soft or out_of_region by boxes one in the other; reject beyond the country or without a place."""
    inside = lambda b: F.coalesce(lon.between(b[0], b[2]) & lat.between(b[1], b[3]), F.lit(False))
    return F.when(~inside(home), F.lit("reject")).when(inside(hard), F.lit("hard")).when(inside(soft), F.lit("soft")).otherwise(F.lit("out_of_region"))


def sane_levels(df: DataFrame, z: str, low: float = -200.0, high: float = 2000.0) -> DataFrame:
    """Rows with a level that ground can have, its bounds not included."""
    return df.where((F.col(z) > low) & (F.col(z) < high) & ~F.isnan(z))


def with_status(df: DataFrame, supplementary: str = "is_supplementary") -> DataFrame:
    return df.withColumn("data_status", F.when(F.col(supplementary), F.lit("supplementary")).otherwise(F.lit("original")))


def segments(holes: DataFrame, strata: DataFrame, key: str = "id", elevation: str = "elevation") -> DataFrame:
    """Strata with their levels above the sea: z_top, z_bot and thickness."""
    e = F.col(elevation)
    return strata.join(holes.select(F.col(key).alias("borehole_id"), e), "borehole_id").withColumns({"z_top": e - F.col("depth_top"), "z_bot": e - F.col("depth_bottom"), "thickness": F.col("depth_bottom") - F.col("depth_top")})


def nested_strata(holes: DataFrame, strata: DataFrame, key: str = "id") -> DataFrame:
    """Holes with an array of their strata by top; an empty one where there are none."""
    fields = [c for c in strata.columns if c != "borehole_id"]
    lists = strata.groupBy("borehole_id").agg(F.sort_array(F.collect_list(F.struct("depth_top", *[c for c in fields if c != "depth_top"]))).alias("strata"))
    out = holes.join(lists, holes[key] == lists["borehole_id"], "left").drop("borehole_id")
    return out.withColumn("strata", F.coalesce("strata", F.array().cast(lists.schema["strata"].dataType)))
