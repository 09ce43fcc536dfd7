"""The nearest few, exactly, wherever they are.

Rows that share a place ask once, and of those that share a place as many are asked as can be among the nearest. Places are sorted into strips
and these into tiles of about as many rows, however they lie; a tile's box and count say how far its nearest can be, and only tiles
that reach so near are met, in numpy. No project is one task's work.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrakern.operators.materialise import stored

#: Places of a tile; tiles of one side that a task holds against all tiles of the other; tiles that one tile meets at once.
TILE, BOXES, AT_ONCE = 512, 1024, 64


def _numbered(df: DataFrame, by: Sequence[str], order: str, size: str, name: str) -> DataFrame:
    """df with the number of its run of about `size` rows (a column) among those of the same `by`, sorted by ranges: names are unique."""
    by = list(by)

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start, last, at, run = TaskContext.get().partitionId() << 32, None, 0, -1
        for rows in batches:
            if not len(rows):
                continue
            new = np.zeros(len(rows), bool)
            for value in (rows[c].to_numpy() for c in by):
                new[1:] |= value[1:] != value[:-1]
            new[0] = last is None or tuple(rows[by].iloc[0]) != last
            place, first = np.arange(len(rows)), np.flatnonzero(new)
            since = np.zeros(len(rows), np.int64)
            since[first] = first
            place = place - np.maximum.accumulate(since) + np.where(np.cumsum(new) > 0, 0, at)
            turn = new | (place % rows[size].to_numpy() == 0)
            numbers = run + np.cumsum(turn)
            last, at, run = tuple(rows[by].iloc[-1]), int(place[-1]) + 1, int(numbers[-1])
            yield rows.assign(**{name: start + numbers})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", {name} long"
    return df.repartitionByRange(*by, order).sortWithinPartitions(*by, order).mapInPandas(runs, schema)


def _tiled(df: DataFrame, on: Sequence[str], tile: str, size: int) -> tuple[DataFrame, DataFrame]:
    """df (on, x, y, ...) with `tile`, and the tiles' boxes and counts."""
    sizes = stored(df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"), F.ceil(F.sqrt(F.count(F.lit(1)) * F.lit(float(size)))).cast("long").alias("_size")))
    most, sizes = sizes.agg(F.max("_n")).first()[0] or 0, sizes.drop("_n")
    ends = [f(c).alias(f"{c}{n}") for c in "xy" for n, f in (("0", F.min), ("1", F.max))]
    if most <= size * 8:  # a tile for each
        tiles = df.withColumn(tile, F.lit(0).cast("long"))
        return tiles, tiles.groupBy(*on, tile).agg(*ends, F.count(F.lit(1)).alias("n"))
    strips = stored(_numbered(df.join(sizes, [*on]), on, "x", "_size", "_strip"))
    tiles = stored(_numbered(strips.withColumn("_size", F.lit(size).cast("long")), [*on, "_strip"], "y", "_size", tile).drop("_strip", "_size"))
    return tiles, tiles.groupBy(*on, tile).agg(*ends, F.count(F.lit(1)).alias("n"))


def nearest_of_places(left: DataFrame, right: DataFrame, on: Sequence[str] = (), k: int = 1, keep: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """(on, x, y, other, d, place, keep): the k nearest of right (on, key, x, y, keep) to each place (on, x, y) of left, ties by the least key; fewer
    where right has fewer. Keys are unique within `on`; a place that is null, or no finite number, is none."""
    names, keep = list(on), list(keep)
    on = names or ["_all"]
    whole = lambda c: F.col(c).isNotNull() & (F.abs(F.col(c)) < float("inf"))
    at = lambda df: (df if names else df.withColumn("_all", F.lit(0))).where(whole("x") & whole("y")).withColumns({c: F.col(c).cast("double") for c in "xy"})
    left, right = stored(at(left).select(*on, "x", "y").distinct()), at(right).select(*on, "x", "y", F.col("key").alias("other"), *keep)
    if k == 1:
        right = right.groupBy(*on, "x", "y").agg(F.min("other").alias("_k"), *[F.min_by(c, "other").alias(c) for c in keep]).withColumnRenamed("_k", "other")
    else:
        w = Window.partitionBy(*on, "x", "y").orderBy("other")
        right = right.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")
    right = stored(right)
    left, left_boxes = _tiled(left, on, "_a", tile)
    right, right_boxes = _tiled(right, on, "_b", tile)
    left_boxes = left_boxes.withColumn("_part", F.pmod(F.xxhash64("_a"), F.lit(1 << 20)))
    parts = left_boxes.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / BOXES).alias("_parts"))
    left_boxes = left_boxes.join(parts, on).withColumn("_part", F.col("_part") % F.col("_parts")).drop("_parts")
    right_boxes = right_boxes.join(parts.select(*[F.col(c).alias(c) for c in parts.columns]), on).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_parts")
    types = {f.name: f.dataType.simpleString() for f in [*left.schema, *right.schema]}
    declared = lambda columns: ", ".join(f"`{c}` {types[c]}" for c in columns)

    def reached(asking: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        low, high, counts, parts = known[["x0", "y0"]].to_numpy(), known[["x1", "y1"]].to_numpy(), known["n"].to_numpy(), []
        for lo in range(0, len(asking) if len(known) else 0, 256):
            some = asking.iloc[lo : lo + 256]
            a, b = some[["x0", "y0"]].to_numpy()[:, None], some[["x1", "y1"]].to_numpy()[:, None]
            near = np.sqrt((np.maximum(np.maximum(low - b, a - high), 0) ** 2).sum(2))
            far = np.sqrt((np.maximum(np.abs(b - low), np.abs(high - a)) ** 2).sum(2))
            order = np.argsort(far, axis=1)
            enough = np.cumsum(counts[order], axis=1) >= k
            enough = np.where(enough.any(axis=1), enough.argmax(axis=1), len(counts) - 1)
            reach = np.take_along_axis(far, np.take_along_axis(order, enough[:, None], 1), 1) * (1 + 1e-12)
            row, column = np.nonzero(near <= reach)
            turn = (np.arange(len(row)) - np.searchsorted(row, row, "left")) // AT_ONCE
            parts.append(some[[*on, "_a"]].iloc[row].assign(_b=known["_b"].to_numpy()[column], _turn=turn))
        return pd.concat(parts) if parts else asking[[*on, "_a"]].iloc[:0].assign(_b=0, _turn=0)

    pairs = stored(left_boxes.groupBy(*on, "_part").cogroup(right_boxes.groupBy(*on, "_part")).applyInPandas(reached, f"{declared(on)}, _a long, _b long, _turn long"))
    asked = left.join(pairs.select(*on, "_a", "_turn").distinct(), [*on, "_a"])
    known = right.join(pairs, [*on, "_b"]).drop("_b")
    known = known.select(*[F.col(c).alias(c) for c in known.columns])  # both come from one table of pairs

    def meet(some: pd.DataFrame, all_: pd.DataFrame) -> pd.DataFrame:
        all_ = all_.sort_values("other")
        x, y, parts = all_["x"].to_numpy(), all_["y"].to_numpy(), []
        for lo in range(0, len(some) if len(x) else 0, 128):
            part = some.iloc[lo : lo + 128]
            d = np.sqrt((part["x"].to_numpy()[:, None] - x) ** 2 + (part["y"].to_numpy()[:, None] - y) ** 2)
            last = np.partition(d, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1]
            row, column = np.nonzero(d <= last[:, None])
            order = np.lexsort((column, d[row, column], row))  # columns rise with the key
            row, column = row[order], column[order]
            few = np.arange(len(row)) - np.searchsorted(row, row, "left") < k
            row, column = row[few], column[few]
            parts.append(part[[*on, "x", "y"]].iloc[row].assign(d=d[row, column], **{c: all_[c].to_numpy()[column] for c in ("other", *keep)}))
        out = pd.concat(parts) if parts else some[[*on, "x", "y"]].iloc[:0].assign(d=0.0, **{c: all_[c].iloc[:0] for c in ("other", *keep)})
        return out[[*on, "x", "y", "other", "d", *keep]]

    met = asked.groupBy(*on, "_a", "_turn").cogroup(known.groupBy(*on, "_a", "_turn")).applyInPandas(meet, f"{declared([*on, 'x', 'y', 'other'])}, d double" + (", " + declared(keep) if keep else ""))
    w = Window.partitionBy(*on, "x", "y").orderBy("d", "other")
    return met.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select(*names, "x", "y", "other", "d", "place", *keep)
