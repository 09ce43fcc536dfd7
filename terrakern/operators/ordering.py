"""Orders that lists are shown in, each as a `place` from 0 within its list, or as columns to sort by."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrakern.operators.materialise import cut


def in_pieces(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """df dealt into ranges of `order` and sorted, with `_piece`, the range's number, and `_at`, which rises with the order.

    However many rows a key has, a range holds its share; rows that tie wholly are told apart by where they were read. Ranges
    are drawn anew each time this is worked out, so the result is written, or read once.
    """
    df = df.withColumn("_row", F.monotonically_increasing_id())
    df = df.repartitionByRange(*order, F.col("_row")).sortWithinPartitions(*order, F.col("_row"))
    return df.withColumns({"_piece": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}).drop("_row")


def running(df: DataFrame, keys: Sequence[str], order: Sequence[Column], last: dict[str, Column] | None = None, counts: dict[str, Column] | None = None) -> DataFrame:
    """Adds, over a row's own and all earlier rows of its keys by `order`: for each of `last` the last value that isn't null, for each of
    `counts` how many rows meet a condition. A key may hold any share of the rows: each range of the sorted table is scanned by itself
    and what it ends with, a row for each range and key, is carried on to the next."""
    last, counts, keys = last or {}, counts or {}, list(keys)
    names = [*last, *counts]
    rows = df.withColumns({f"_v_{n}": c for n, c in last.items()} | {f"_v_{n}": F.coalesce(c, F.lit(False)).cast("long") for n, c in counts.items()})
    rows = cut(in_pieces(rows, [*[F.col(k) for k in keys], *order]))
    here = Window.partitionBy(*keys, "_piece").orderBy("_at")
    ends = {n: F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col("_at"))) for n in last} | {n: F.sum(f"_v_{n}") for n in counts}
    pieces = rows.groupBy(*keys, "_piece").agg(*[c.alias(f"_e_{n}") for n, c in ends.items()])
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    carry = {n: F.last(f"_e_{n}", ignorenulls=True).over(before) for n in last} | {n: F.sum(f"_e_{n}").over(before) for n in counts}
    carried = pieces.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_piece").alias("_p"), *[c.alias(f"_c_{n}") for n, c in carry.items()])
    local = {n: F.last(f"_v_{n}", ignorenulls=True).over(here) for n in last} | {n: F.sum(f"_v_{n}").over(here) for n in counts}
    met = F.col("_piece") == F.col("_p")
    for k in keys:  # a null key is a key
        met = met & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    rows = rows.withColumns({f"_l_{n}": c for n, c in local.items()}).join(carried, met)
    out = {n: F.coalesce(f"_l_{n}", f"_c_{n}") for n in last} | {n: F.col(f"_l_{n}") + F.coalesce(f"_c_{n}", F.lit(0)) for n in counts}
    return rows.withColumns(out).select(*df.columns, *[n for n in names if n not in df.columns])


def placed(df: DataFrame, within: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Adds place, from 0, by `order` in each list; a list is what is shown to one reader, so it is sorted in one task. Without `within`
    the whole table is one list, which is numbered range by range."""
    if not within:
        rows = cut(in_pieces(df, order))
        sizes = rows.groupBy("_piece").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
        before = F.sum("_n").over(Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
        starts = sizes.select("_piece", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_from"))
        return rows.join(F.broadcast(starts), "_piece").select(*df.columns, (F.col("_at") + F.col("_from")).alias("place"))
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*within).orderBy(*order)) - 1)


def newest_first(created: str, key: str) -> list[Column]:
    return [F.col(created).desc_nulls_last(), F.col(key).desc()]


def by_vocabulary(name: str, words: Sequence[str]) -> list[Column]:
    """The words' own order, then other names by code points."""
    rank = F.array_position(F.array(*[F.lit(w) for w in words]), F.col(name))
    return [F.when(rank > 0, rank).otherwise(len(words) + 1), F.col(name)]


def by_depth(depth: str) -> list[Column]:
    """A missing depth stands before 0."""
    return [F.coalesce(depth, F.lit(-1.0))]


def by_group(virtual: str, label: str) -> list[Column]:
    """Virtual groups last, then labels by code points."""
    return [F.coalesce(virtual, F.lit(False)), F.col(label)]


def replay_of(jobs: DataFrame, key: str, wanted: DataFrame, last: int = 100) -> DataFrame:
    """(wanted's key, id): the newest of the last jobs (id, `key`) that has the key. The last are the `last` newest of all."""
    recent = jobs.orderBy(F.desc("id")).limit(last)
    return recent.join(wanted.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.max("id").alias("id"))
