"""Terrain from tiles of coloured pixels: how closely to look at a box, the pixels of places, their heights."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrakern.functions.geodesy import tile_height
from terrakern.operators.modelling import clipped

# Pixels along a tile's side, the closest and the farthest look, tiles that one look may take, the colour of a missing pixel.
SIDE, CLOSEST, FARTHEST, MOST_TILES, MISSING = 256, 14, 8, 9, (128, 0, 0)


def world_pixel(lon: Column, lat: Column, zoom: Column) -> tuple[Column, Column]:
    """Place on the whole map of a zoom in pixels, eastwards and southwards."""
    s, size = F.sin(F.radians(lat)), F.pow(F.lit(2.0), zoom) * SIDE
    return (lon + 180) / 360 * size, (F.lit(0.5) - F.log((F.lit(1.0) + s) / (F.lit(1.0) - s)) / (4 * math.pi)) * size


def looked_at(boxes: DataFrame) -> DataFrame:
    """Adds to boxes (x0, y0, x1, y1 in degrees) zoom and the first and last tiles each way: the closest zoom at which a box touches at most
    MOST_TILES tiles, and the farthest if none is."""

    def tiles(zoom: Column) -> list[Column]:
        (left, upper), (right, lower) = world_pixel(F.col("x0"), F.col("y1"), zoom), world_pixel(F.col("x1"), F.col("y0"), zoom)
        return [F.floor(v / SIDE) for v in (left, upper, right, lower)]

    def few(zoom: int) -> Column:
        left, upper, right, lower = tiles(F.lit(zoom))
        return F.when((right - left + 1) * (lower - upper + 1) <= MOST_TILES, F.lit(zoom))

    out = boxes.withColumn("zoom", F.coalesce(*[few(z) for z in range(CLOSEST, FARTHEST, -1)], F.lit(FARTHEST)))
    return out.withColumns(dict(zip(("tile_left", "tile_upper", "tile_right", "tile_lower"), tiles(F.col("zoom")))))


def tiles_of(boxes: DataFrame, key: str) -> DataFrame:
    """(key, zoom, tx, ty) of the tiles that each box needs, at most MOST_TILES but for boxes wider than the farthest look."""
    across = looked_at(boxes).withColumn("tx", F.explode(F.sequence("tile_left", "tile_right")))
    return across.withColumn("ty", F.explode(F.sequence("tile_upper", "tile_lower"))).select(key, "zoom", "tx", "ty")


def pixels_of(places: DataFrame, boxes: DataFrame, key: str) -> DataFrame:
    """Places (key, lon, lat) with zoom, px and py: the nearest pixel on the map, none beyond the tiles of the key's box."""
    edges = looked_at(boxes).select(key, "zoom", "tile_left", "tile_upper", "tile_right", "tile_lower")
    met = places.join(edges, key)
    near = lambda v, first, last: F.greatest(F.col(first) * SIDE, F.least((F.col(last) + 1) * SIDE - 1, F.floor(v + 0.5)))
    x, y = world_pixel(F.col("lon"), F.col("lat"), F.col("zoom"))
    return met.withColumns({"px": near(x, "tile_left", "tile_right"), "py": near(y, "tile_upper", "tile_lower")}).drop("tile_left", "tile_upper", "tile_right", "tile_lower")


def heights(places: DataFrame, boxes: DataFrame, pixels: DataFrame, key: str) -> DataFrame:
    """Places (key, lon, lat and more) with zoom and z: the height of their pixel's colour, null where ground can't have it.

    pixels (zoom, px, py, r, g, b) are joined by their own numbers, so no tile is a hot key; one that is missing, with its tile or by
    itself, has the colour of sea level. Of a pixel given twice the lowest colour counts.
    """
    shown = pixels.groupBy("zoom", "px", "py").agg(F.min(F.struct("r", "g", "b")).alias("_c"))
    met = pixels_of(places, boxes, key).join(shown, ["zoom", "px", "py"], "left")
    r, g, b = (F.coalesce(F.col(f"_c.{c}"), F.lit(v)) for c, v in zip("rgb", MISSING))
    return met.select(*places.columns, "zoom", clipped(tile_height(r, g, b)).alias("z"))
