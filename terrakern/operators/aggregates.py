"""Aggregates that the built-in ones don't name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upper_median(column: str) -> Column:
    """The middle value, of two the greater: never between values. Nulls don't count.

    It is the discrete median from above; the aggregate combines counted values before the shuffle.
    """
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{column}` DESC)")


def upper_median_of_all(df: DataFrame, column: str, small: int = 100_000, cells: int = 1024) -> float | None:
    """The upper median of a whole table's column. Its range is parted into cells and counted; only the cell that holds the
    median's rank is looked into again, until few values are left, so no task holds all values."""
    values = df.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    state = values.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    n, lo, hi = state["n"], state["lo"], state["hi"]
    rank = n // 2  # from 0, from below
    while n > small and lo < hi:
        cell = F.least(F.floor((F.col("v") - lo) / (hi - lo) * cells), F.lit(cells - 1))
        counts = values.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("cell").collect()  # `cells` rows
        for c in counts:
            if rank < c["n"]:
                break
            rank -= c["n"]
        n, lo, hi = c["n"], c["lo"], c["hi"]
        values = values.where(F.col("v").between(lo, hi))
    if not n:
        return None
    return lo if lo == hi else values.agg(F.get(F.sort_array(F.collect_list("v")), F.lit(rank))).first()[0]  # at most `small` values


def latest_by(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is greatest by `order`, found by a map-side combined maximum, not a sort."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_best"))
    return best.select(*key, *[F.col(f"_best.{c}").alias(c) for c in rest])


def first_by(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is least by `order`."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_best"))
    return best.select(*key, *[F.col(f"_best.{c}").alias(c) for c in rest])


def child_counts(parents: DataFrame, key: str, children: dict[str, DataFrame]) -> DataFrame:
    """Adds a count for each table of children that holds `key`; each is counted before it is joined, so tables don't multiply."""
    out = parents
    for name, child in children.items():
        out = out.join(child.groupBy(key).agg(F.count(F.lit(1)).alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def own_or_linked_count(parents: DataFrame, key: str, own: DataFrame, links: DataFrame) -> DataFrame:
    """Adds n: links where there are any, else own children."""
    both = child_counts(parents, key, {"_own": own, "_links": links})
    return both.withColumn("n", F.when(F.col("_links") > 0, F.col("_links")).otherwise(F.col("_own"))).drop("_own", "_links")


def mean_with_nulls_as_zero(c: Column) -> Column:
    return F.avg(F.coalesce(c, F.lit(0.0)))


def shares_of_mode(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Each group's commonest value (of equal counts the least), its count and the group's size."""
    counted = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    best = F.max_by(F.struct(F.col(value).alias("v"), F.col("n").alias("n")), F.struct(F.col("n"), -F.col(value)))
    return counted.groupBy(*group).agg(best.alias("_m"), F.sum("n").alias("size")).select(*group, F.col("_m.v").alias("mode"), F.col("_m.n").alias("n"), "size")


def thickness_by(strata: DataFrame, key: str, group: str, names: list[str]) -> DataFrame:
    """Thickness of each group in columns of its name."""
    thickness = F.col("depth_bottom") - F.col("depth_top")
    return strata.groupBy(key).pivot(group, names).agg(F.sum(thickness)).na.fill(0.0, names)


def sequences(strata: DataFrame, key: str, name: str, order: list[str], most: int | None = None) -> DataFrame:
    """How many holes have each order of names, runs of a name counted once; the commonest first."""
    w = Window.partitionBy(key).orderBy(*order)
    turns = strata.withColumn("_before", F.lag(name).over(w)).where(F.col("_before").isNull() | (F.col("_before") != F.col(name)))
    lists = turns.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, F.col(name).alias("_name")))).alias("_l"))
    out = lists.groupBy(F.array_join(F.transform("_l", lambda x: x["_name"]), ">").alias("sequence")).agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.desc("n"), "sequence").limit(most) if most else out


def occurrence_order(strata: DataFrame, key: str, name: str, order: list[str]) -> DataFrame:
    """Mean place of each name's n-th occurrence in its hole, over all holes."""
    hole, own = Window.partitionBy(key).orderBy(*order), Window.partitionBy(key, name).orderBy(*order)
    placed = strata.withColumn("_place", F.row_number().over(hole) - 1).withColumn("occurrence", F.row_number().over(own))
    return placed.groupBy(name, "occurrence").agg(F.count(F.lit(1)).alias("holes"), F.avg("_place").alias("mean_place"))


def next_version(df: DataFrame, key: list[str], version: str) -> DataFrame:
    return df.groupBy(*key).agg((F.coalesce(F.max(version), F.lit(0)) + 1).alias("next_version"))
