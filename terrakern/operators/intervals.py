"""Depth intervals of a hole: merging, stacking, repairing, checking, cutting at each other's ends.

Runs are found with lag and a running sum. Where a row depends on the corrected row before it, one fold over the hole's sorted
array does the work, in column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrakern.operators.aggregates import first_by


def runs(df: DataFrame, key: list[str], order: list[str], broken: Column, name: str = "run") -> DataFrame:
    """Numbers the runs of each key: a row for which `broken` holds begins one. `broken` may use lag over key and order."""
    w = Window.partitionBy(*key).orderBy(*order)
    marked = df.withColumn("_broken", F.coalesce(broken, F.lit(True)).cast("int"))
    return marked.withColumn(name, F.sum("_broken").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_broken")


def merge_adjacent(df: DataFrame, key: list[str], order: list[str], name: str, tolerance: float = 0.05) -> DataFrame:
    """Joins neighbours of one name whose ends meet within the tolerance."""
    w = Window.partitionBy(*key).orderBy(*order)
    same = (F.lag(name).over(w) == F.col(name)) & (F.abs(F.lag("depth_bottom").over(w) - F.col("depth_top")) <= tolerance)
    out = runs(df, key, order, ~same).groupBy(*key, "run")
    return out.agg(F.first(name).alias(name), F.min("depth_top").alias("depth_top"), F.max("depth_bottom").alias("depth_bottom"), F.count(F.lit(1)).alias("parts"))


def merge_same_name(df: DataFrame, key: list[str], order: list[str], name: str, codes: str | None = None) -> DataFrame:
    """Joins neighbours of one name, whether their ends meet or not; the bottom is the greatest, codes are strung by /."""
    w = Window.partitionBy(*key).orderBy(*order)
    aggregates = [F.first(name).alias(name), F.min("depth_top").alias("depth_top"), F.max("depth_bottom").alias("depth_bottom")]
    if codes:
        listed = F.sort_array(F.collect_list(F.struct(*order, F.col(codes).alias("_code"))))
        aggregates.append(F.array_join(F.transform(listed, lambda x: x["_code"]), "/").alias(codes))
    return runs(df, key, order, F.lag(name).over(w) != F.col(name)).groupBy(*key, "run").agg(*aggregates)


def stacked(df: DataFrame, key: list[str], order: list[str], thickness: str, places: int = 3) -> DataFrame:
    """Tops and bottoms from thicknesses, rounded at each step; those null or not above 0 are left out."""
    rest = [c for c in df.columns if c not in key]
    kept = df.where(F.col(thickness) > 0)
    lists = kept.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*order, *[F.col(c).alias(f"_{c}") for c in rest]))).alias("_rows"))

    def step(state: Column, row: Column) -> Column:
        bottom = F.round(state["at"] + row[f"_{thickness}"], places)
        one = F.array(F.struct(row.alias("row"), state["at"].alias("top"), bottom.alias("bottom")))
        return F.struct(bottom.alias("at"), F.concat(state["out"], one).alias("out"))

    row_type = lists.schema["_rows"].dataType.elementType.simpleString()
    start = F.struct(F.lit(0.0).alias("at"), F.array().cast(f"array<struct<row:{row_type},top:double,bottom:double>>").alias("out"))
    made = lists.select(*key, F.explode(F.aggregate("_rows", start, step)["out"]).alias("_o"))
    return made.select(*key, *[F.col(f"_o.row._{c}").alias(c) for c in rest], F.col("_o.top").alias("depth_top"), F.col("_o.bottom").alias("depth_bottom"))


def continuous(df: DataFrame, key: list[str], name: str, least: float = 0.1) -> DataFrame:
    """Overlaps moved down: a top above the corrected bottom before it takes that bottom, and a bottom not below its top is
    put `least` under it."""
    lists = df.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("depth_top", "depth_bottom", F.col(name).alias("_name")))).alias("_rows"))

    def step(state: Column, row: Column) -> Column:
        top = F.when(state["at"] > row["depth_top"], state["at"]).otherwise(row["depth_top"])
        # The first row of a hole stays as it is.
        bottom = F.when(state["at"].isNotNull() & (row["depth_bottom"] <= top), top + least).otherwise(row["depth_bottom"])
        one = F.array(F.struct(top.alias("top"), bottom.alias("bottom"), row["_name"].alias("name")))
        return F.struct(bottom.alias("at"), F.concat(state["out"], one).alias("out"))

    text = df.schema[name].dataType.simpleString()
    start = F.struct(F.lit(None).cast("double").alias("at"), F.array().cast(f"array<struct<top:double,bottom:double,name:{text}>>").alias("out"))
    made = lists.select(*key, F.posexplode(F.aggregate("_rows", start, step)["out"]).alias("place", "_o"))
    return made.select(*key, "place", F.col("_o.top").alias("depth_top"), F.col("_o.bottom").alias("depth_bottom"), F.col("_o.name").alias(name))


def tops_from_bottoms(df: DataFrame, key: list[str], order: list[str], bottom: str = "depth_bottom") -> DataFrame:
    return df.withColumn("depth_top", F.lag(bottom, 1, 0.0).over(Window.partitionBy(*key).orderBy(*order)))


def distinct_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def filled_down(df: DataFrame, key: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Each null takes the last value above it."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def resets(df: DataFrame, key: list[str], order: list[str], depth: str, drop: float = 2.0) -> DataFrame:
    """Numbers the sections of each key: a depth more than `drop` above the one before begins a new one."""
    before = F.lag(depth).over(Window.partitionBy(*key).orderBy(*order))
    return runs(df, key, order, before.isNull() | (F.col(depth) < before - drop), "section")


def numbered_unknown(df: DataFrame, key: list[str], order: list[str], name: str, prefix: str = "BH-a") -> DataFrame:
    """Names for rows without a usable one: a row goes on with the unknown hole before it where its top is below 0 and not more
    than 2 m above the bottom before it, else it begins the next."""
    w = Window.partitionBy(*key).orderBy(*order)
    text = F.upper(F.trim(F.coalesce(name, F.lit(""))))
    unknown = (text == "") | text.startswith("XX-") | text.isin("UNKNOWN", "N/A")
    marked = df.withColumn("_unknown", unknown)
    goes_on = F.lag("_unknown").over(w) & (F.col("depth_top") > 0) & (F.col("depth_top") >= F.lag("depth_bottom").over(w) - 2.0)
    begins = marked.withColumn("_begins", (F.col("_unknown") & ~F.coalesce(goes_on, F.lit(False))).cast("int"))
    count = F.sum("_begins").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return begins.withColumn(name, F.when(F.col("_unknown"), F.concat(F.lit(prefix), count.cast("string"))).otherwise(F.col(name))).drop("_unknown", "_begins")


def elementary(df: DataFrame, key: list[str]) -> DataFrame:
    """The intervals between neighbouring ends of any of a key's intervals."""
    ends = df.select(*key, F.explode(F.array("depth_top", "depth_bottom")).alias("at")).distinct()
    cut = ends.withColumn("to", F.lead("at").over(Window.partitionBy(*key).orderBy("at")))
    return cut.where(F.col("to").isNotNull()).select(*key, F.col("at").alias("depth_top"), F.col("to").alias("depth_bottom"))


def named_by_containment(pieces: DataFrame, ranges: DataFrame, key: list[str], name: str, order: str, above: float = 0.05, below: float = 0.08) -> DataFrame:
    """Each piece takes the name of the first range, by `order`, that holds it within the tolerances; null if none does."""
    r = ranges.select(*key, F.col("depth_top").alias("_top"), F.col("depth_bottom").alias("_bottom"), F.col(name).alias("_name"), F.col(order).alias("_order"))
    inside = (F.col("depth_top") >= F.col("_top") - above) & (F.col("depth_bottom") <= F.col("_bottom") + below)
    met = pieces.join(r, key, "left").withColumn("_hit", F.when(inside, F.struct("_order", "_name")))
    return met.groupBy(*key, "depth_top", "depth_bottom").agg(F.min("_hit")["_name"].alias(name))


def contiguity(df: DataFrame, key: list[str], order: list[str], tolerance: float = 1e-6) -> DataFrame:
    """For each key: whether it starts at 0 and leaves no gap or overlap, and its total depth."""
    before = F.lag("depth_bottom", 1, 0.0).over(Window.partitionBy(*key).orderBy(*order))
    meets = (F.abs(F.col("depth_top") - before) <= tolerance) & (F.col("depth_bottom") > F.col("depth_top"))
    return df.withColumn("_ok", meets).groupBy(*key).agg(F.bool_and("_ok").alias("contiguous"), F.max("depth_bottom").alias("total_depth"))


def depth_anomalies(df: DataFrame, key: list[str], tolerance: float = 0.02) -> DataFrame:
    """For each key, whether a top is above ground, an interval is empty, neighbours don't meet, or the last bottom isn't below ground."""
    w = Window.partitionBy(*key).orderBy("depth_top", "depth_bottom")
    following = F.lead("depth_top").over(w)
    first = F.lag("depth_top").over(w).isNull() & (F.col("depth_top") < -tolerance)
    gap = F.coalesce(F.abs(F.col("depth_bottom") - following) > tolerance, F.lit(False))
    last = following.isNull() & (F.col("depth_bottom") <= 0)
    return df.withColumn("_bad", first | (F.col("depth_bottom") <= F.col("depth_top")) | gap | last).groupBy(*key).agg(F.bool_or("_bad").alias("depth_anomaly"))


def run_lengths(df: DataFrame, key: list[str], order: str, label: str, skip: int = 0) -> DataFrame:
    """Runs of equal labels over consecutive places, those of `skip` left out."""
    before, place = F.lag(label).over(Window.partitionBy(*key).orderBy(order)), F.lag(order).over(Window.partitionBy(*key).orderBy(order))
    marked = runs(df, key, [order], (before != F.col(label)) | (place + 1 != F.col(order)))
    return marked.where(F.col(label) != skip).groupBy(*key, "run").agg(F.first(label).alias(label), F.min(order).alias("first"), F.max(order).alias("last"))


def distinct_rounded(df: DataFrame, key: list[str], rounded: dict[str, int], same: list[str], order: list[str]) -> DataFrame:
    """The first row by `order` of those that agree in key, in `same` and in columns rounded to so many places."""
    marks = {f"_r_{c}": F.round(c, n) for c, n in rounded.items()}
    return first_by(df.withColumns(marks), [*key, *same, *marks], order).select(*df.columns)


def cascaded(df: DataFrame, key: list[str], order: list[str], said: str, names: list[str]) -> DataFrame:
    """Columns `names` out of a map: a page without a key takes it from the last page before that has it, be it null there; a page
    that has the key keeps its own, null or not."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = {n: F.last(F.when(F.map_contains_key(said, n), F.struct(F.col(said)[n].alias("v"))), ignorenulls=True).over(w)["v"] for n in names}
    return df.withColumns(last)
