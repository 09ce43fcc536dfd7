"""Polygons of GeoJSON files as parts with rings: reading, cutting by a box, thinning lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrakern.sources.tables import clipped_rings

RING = ["region", "part", "ring"]


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """(region, part, ring, points) of polygon and multi-polygon features of GeoJSON files; a region is a feature's place in all files in the
    order of their paths. Other geometries are left out."""
    schema = "features array<struct<geometry:struct<type:string,coordinates:string>>>"
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("_file"), F.from_json("value", schema).alias("f"))
    flat = files.select("_file", F.posexplode("f.features.geometry").alias("_n", "g"))
    many = F.when(F.col("g.type") == "Polygon", F.array(F.from_json("g.coordinates", "array<array<array<double>>>"))).when(F.col("g.type") == "MultiPolygon", F.from_json("g.coordinates", "array<array<array<array<double>>>>"))
    parts = flat.select(F.struct("_file", "_n").alias("region"), F.posexplode(many).alias("part", "p"))
    return parts.select("region", "part", F.posexplode("p").alias("ring", "points"))


def clipped_polygons(rings: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Rings (region, part, ring, points) cut by a box. A hole goes with its outline: where nothing of that is left, nothing is left of the
    hole."""
    cut_ = clipped_rings(rings, box)
    return cut_.join(cut_.where("ring = 0").select("region", "part"), ["region", "part"], "left_semi")


def thinned(x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """Numbers of the points of an open line that stay: its ends and, between two that stay, the one farthest from their segment, if it is farther
    than the tolerance."""
    keep, stack = np.zeros(len(x), bool), [(0, len(x) - 1)]
    keep[[0, -1]] = True
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        px, py = x[a + 1 : b], y[a + 1 : b]
        dx, dy = x[b] - x[a], y[b] - y[a]
        length = dx * dx + dy * dy
        t = np.clip(((px - x[a]) * dx + (py - y[a]) * dy) / length, 0, 1) if length else np.zeros(len(px))
        d = np.hypot(px - x[a] - t * dx, py - y[a] - t * dy)
        far = int(d.argmax())
        if d[far] > tolerance:
            keep[a + 1 + far] = True
            stack += [(a, a + 1 + far), (a + 1 + far, b)]
    return np.flatnonzero(keep)


def _ring(points: np.ndarray, tolerance: float) -> np.ndarray | None:
    """A ring's points, closed or not, thinned in two halves: from the first point to the one farthest from it and back."""
    closed = len(points) > 1 and (points[0] == points[-1]).all()
    open_ = points[:-1] if closed else points
    if len(open_) < 3:
        return None
    far = int(np.hypot(*(open_ - open_[0]).T).argmax())
    whole = np.concatenate([open_, open_[:1]])
    there, back = thinned(*whole[: far + 1].T, tolerance), thinned(*whole[far:].T, tolerance) + far
    kept = np.concatenate([there, back[1:-1]])
    if len(kept) < 3:
        return None
    return np.concatenate([whole[kept], whole[:1]]) if closed else whole[kept]


def thinned_rings(rings: DataFrame, tolerance: float) -> DataFrame:
    """Rings (region, part, ring, points) with fewer points: none that is left out lies farther than the tolerance from its ring. A ring of which
    fewer than three points stay is nothing, and takes its holes along. Without a tolerance all points stay. A ring is a row, and is
    walked with a stack of its own, so it may have any number of points."""
    if tolerance <= 0:
        return rings
    names = rings.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            thin = [_ring(np.array([list(q[:2]) for q in p], float).reshape(-1, 2), tolerance) for p in batch["points"]]
            batch = batch.assign(points=[t if t is None else t.tolist() for t in thin])
            yield batch[batch["points"].notna()][names]

    out = rings.mapInPandas(run, rings.schema)
    return out.join(out.where("ring = 0").select("region", "part"), ["region", "part"], "left_semi").select(*names)
