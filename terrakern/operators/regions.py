"""Points and polygons as tables: which polygons hold a point, what water or land a cell is, how far the land is.

A polygon is rows of edges (region, part, ring, x0, y0, x1, y1), ring 0 being a part's outline and the others its holes. Edges are
dealt to the cells of a lattice that they touch, so a polygon with a million of them is as many small rows. In a cell, a point is held
against the cell's own edges alone: along the row to the cell's right side, then down the side to its lower corner, whose parity
is a running count over the row. Cells without edges are inside or outside as a whole. Cells are dealt to tasks as their rows ask
for, points and edges alike, and meet there in numpy: all that a cell's rings say of a point is settled in the cell. Nothing is
broadcast. A cell is one task's work; the lattice is sized by edges, areas and the length of edges, so a cell with many is one of
many edges at one place.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from terrakern.functions.geodesy import DEGREE_LAT_M, DEGREE_LON_M
from terrakern.operators.materialise import stored

RING = ["region", "part", "ring"]
CELL = ["_r", "_c"]
#: Lattice cells for each edge and region at the most; share of a cell by which the lattice is off the least place.
CELLS_PER_EDGE, CELLS_PER_REGION, OFFSET = 4, 256, 0.41421356
#: Side of a cell as a share of an edge's mean length at the least, so that an edge touches a few cells however many edges there are.
SIDE_PER_EDGE = 0.4
#: Rows of edges or points for a task, and pairs of both that are worked on at a time.
ROWS, PAIRS = 200_000, 1 << 16
#: A place and those around it, in steps east and north.
NINE = [(0, 0)] + [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]


def edges(vertices: DataFrame) -> DataFrame:
    """(region, part, ring, x0, y0, x1, y1) of rings of vertices (region, part, ring, seq from 0 without gaps, x, y), closed by the edge from
    the last to the first. An edge without length is none; rings of a single place have no edges. Each vertex meets the next by an equi-join,
    so a ring may have any number."""
    sizes = vertices.groupBy(*RING).agg(F.count(F.lit(1)).alias("_n"))
    at = vertices.join(sizes, RING)
    following = vertices.select(*RING, F.col("seq").alias("_next"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    both = at.withColumn("_next", (F.col("seq") + 1) % F.col("_n")).join(following.hint("merge"), [*RING, "_next"])  # never to all tasks: it is all vertices
    return both.where("x <> x1 OR y <> y1").select(*RING, F.col("x").alias("x0"), F.col("y").alias("y0"), "x1", "y1")


def vertices_of(rings: DataFrame) -> DataFrame:
    """(region, part, ring, seq, x, y) of rings (region, part, ring, points: array<array<double>>); a last point equal to the first is
    left out, as edges close rings."""
    closed = (F.size("points") > 1) & (F.element_at("points", 1) == F.element_at("points", -1))
    points = F.when(closed, F.slice("points", 1, F.size("points") - 1)).otherwise(F.col("points"))
    rows = rings.select(*RING, F.posexplode(points).alias("seq", "_p"))
    return rows.select(*RING, "seq", F.get("_p", F.lit(0)).alias("x"), F.get("_p", F.lit(1)).alias("y"))


class Cover:
    """A lattice over the edges: `inside`, cells that a ring holds whole, `corners`, the parity of the lower right corner of cells that a ring
    touches, and `touched`, edges in the cells that they touch. What is stored is written to the shared folder; the lattice is four numbers."""

    def __init__(self, edged: DataFrame, side: float | None = None) -> None:
        ranges = edged.groupBy(*RING).agg(*[F.min(F.least(f"{c}0", f"{c}1")).alias(f"{c}0") for c in "xy"], *[F.max(F.greatest(f"{c}0", f"{c}1")).alias(f"{c}1") for c in "xy"], F.count(F.lit(1)).alias("n"), F.sum(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).alias("way"))
        span = ranges.agg(F.min("x0").alias("x"), F.min("y0").alias("y"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area"), F.max(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).alias("long"), F.sum("way").alias("way")).first()
        self.empty = not span["k"]
        budget = 0 if self.empty else CELLS_PER_EDGE * span["n"] + CELLS_PER_REGION * span["k"]
        self.side = side or (1.0 if self.empty else max(math.sqrt(span["area"] / budget), span["long"] / budget, SIDE_PER_EDGE * span["way"] / span["n"], 1e-12))
        self.x, self.y = ((0.0, 0.0) if self.empty else (span["x"] - OFFSET * self.side, span["y"] - OFFSET * self.side))
        self.inside, self.corners, self.touched = self._cells(edged)
        self._size: int | None = None

    def row(self, y: Column) -> Column:
        return F.floor((y - self.y) / self.side)

    def column(self, x: Column) -> Column:
        return F.floor((x - self.x) / self.side)

    def _cells(self, edged: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
        hair = self.side * 1e-9
        low, high = F.least(y0, y1), F.greatest(y0, y1)
        rows = edged.withColumn("_r", F.explode(F.sequence(self.row(low - hair), self.row(high + hair))))
        base = F.col("_r") * self.side + self.y
        at = lambda y: x0 + (x1 - x0) * ((y - y0) / (y1 - y0))
        ends = [F.when(y0 == y1, e).otherwise(at(F.least(F.greatest(y, low), high))) for e, y in ((x0, base), (x1, base + self.side))]
        reach = F.sequence(self.column(F.least(*ends) - hair), self.column(F.greatest(*ends) + hair))
        touched = rows.withColumn("_c", F.explode(reach))
        met = (y0 > base) != (y1 > base)
        crossings = rows.where(met).select(*RING, "_r", self.column((x1 - x0) * (base - y0) / (y1 - y0) + x0).alias("_c"), F.lit(1).alias("_met"))
        cells = touched.select(*RING, *CELL, F.lit(0).alias("_met")).unionByName(crossings).groupBy(*RING, *CELL).agg(F.sum("_met").alias("_met"))
        row = Window.partitionBy(*RING, "_r").orderBy(F.desc("_c"))  # as many rows as a ring's edges touch cells of one row
        right = F.coalesce(F.sum("_met").over(row.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2
        cells = stored(cells.select(*RING, *CELL, right.alias("_odd"), F.lag("_c").over(row).alias("_next")))
        inside = cells.where((F.col("_odd") == 1) & (F.col("_next") > F.col("_c") + 1))
        inside = inside.select(*RING, "_r", F.explode(F.sequence(F.col("_c") + 1, F.col("_next") - 1)).alias("_c"))
        return inside, cells.select(*RING, *CELL, "_odd"), touched

    def holding(self, points: DataFrame, metres: float = 0.0) -> DataFrame:
        """(key, region, part) of the parts that hold points (key, x, y), or any of nine places `metres` around them (in degrees): in the outline
        and in no hole, in a ring where an odd number of edges lies to the right, an edge from its lower end up to below its upper end. Equal
        rows of points give equal rows; a point may come back more than once where there are nine places."""
        x, y = F.col("x").cast("double"), F.col("y").cast("double")
        at = points.where(~F.isnan(x) & ~F.isnan(y)).select("key", x.alias("x"), y.alias("y"))
        steps = [(0, 0)] if metres <= 0 else NINE
        at = at.withColumns({"_east": _east(F.lit(float(metres))), "_north": F.lit(metres / DEGREE_LAT_M)})
        cells = F.array_distinct(F.array(*[F.struct(self.row(F.col("y") + float(b) * F.col("_north")).alias("_r"), self.column(F.col("x") + float(a) * F.col("_east")).alias("_c")) for a, b in steps]))
        at = stored(at.withColumn("_at", F.explode(cells)).select("key", "x", "y", "_east", "_north", "_at._r", "_at._c"))
        corner = F.lit(None).cast("double")
        whole = self.inside.withColumn("_odd", F.lit(1).cast("long")).unionByName(self.corners.withColumn("_odd", F.col("_odd").cast("long")))
        whole = whole.select(*RING, *CELL, *[corner.alias(c) for c in ("x0", "y0", "x1", "y1")], "_odd")
        faces = self.touched.select(*RING, *CELL, *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")], F.lit(None).cast("long").alias("_odd")).unionByName(whole)
        if self._size is None:
            self._size = faces.count()
        tasks = max(points.sparkSession.sparkContext.defaultParallelism, math.ceil(max(self._size, at.count()) / ROWS))
        task = F.pmod(F.xxhash64(*CELL), F.lit(tasks)).alias("_task")
        left, right = (df.select("*", task).repartition(tasks, "_task").groupBy("_task") for df in (at, faces))
        kind = {f.name: f.dataType.simpleString() for f in (*points.schema, *self.corners.schema)}
        return left.cogroup(right).applyInArrow(_meeting(self.x, self.y, self.side, steps), f"key {kind['key']}, region {kind['region']}, part {kind['part']}")


def _meeting(x: float, y: float, side: float, steps: list[tuple[int, int]]):
    """What a task makes of its cells' points and faces: edges, and for each ring and cell the parity of the lower right corner."""

    def codes(*columns: pa.ChunkedArray) -> np.ndarray:
        out = np.zeros(len(columns[0]), np.int64)
        for c in columns:
            d = c.combine_chunks().dictionary_encode()
            out = out * len(d.dictionary) + d.indices.to_numpy()
        return out

    def parities(px: np.ndarray, py: np.ndarray, edges: tuple[np.ndarray, ...], row: int, column: int) -> np.ndarray:
        """Edges met along the row and down the side. What lies above or below the side's ends is told by the crossings that tell left from
        right, so an edge that is level but for its last digit isn't met by one and missed by the other."""
        x0, y0, x1, y1 = edges
        corner_x, base = (column + 1) * side + x, row * side + y
        n, up = np.zeros(len(px), np.int64), (x1 > x0) == (y1 > y0)
        beyond = np.floor(((x1 - x0) * (base - y0) / (y1 - y0) + x0 - x) / side) > column
        down = np.flatnonzero(((x0 > corner_x) != (x1 > corner_x)) & np.where((y0 > base) != (y1 > base), beyond != up, y0 > base))
        for lo in range(0, len(px), step := max(1, PAIRS // max(1, len(x0)))):
            qx, qy = px[lo : lo + step, None], py[lo : lo + step, None]
            crossing, met = (x1 - x0) * (qy - y0) / (y1 - y0) + x0, (y0 > qy) != (y1 > qy)
            n[lo : lo + step] = (met & (qx < crossing) & (crossing <= corner_x)).sum(axis=1)
            n[lo : lo + step] += np.where(met[:, down], (crossing[:, down] > corner_x) == up[down], y0[down] <= qy).sum(axis=1)
        return n

    def run(points: pa.Table, faces: pa.Table) -> pa.Table:
        whose, which = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        n = points.num_rows
        if n and faces.num_rows:
            r, c = (np.concatenate((points[k].to_numpy(), faces[k].to_numpy())) for k in CELL)
            order = np.lexsort((c, r))
            starts = np.flatnonzero(np.concatenate(([True], (np.diff(r[order]) != 0) | (np.diff(c[order]) != 0))))
            px, py, east, north = (points[k].to_numpy() for k in ("x", "y", "_east", "_north"))
            edges = [faces[k].to_numpy() for k in ("x0", "y0", "x1", "y1")]
            odd, ring, part = faces["_odd"].fill_null(-1).to_numpy(), faces["ring"].to_numpy(), codes(faces["region"], faces["part"])
            for lo, hi in zip(starts, [*starts[1:], len(order)], strict=True):
                rows = order[lo:hi]
                p, f = rows[rows < n], rows[rows >= n] - n
                if not len(p) or not len(f):
                    continue
                row, column = r[rows[0]], c[rows[0]]
                sx, sy = (np.concatenate([v[p] + float(s[i]) * d[p] for s in steps]) for i, v, d in ((0, px, east), (1, py, north)))
                here = np.flatnonzero((np.floor((sy - y) / side) == row) & (np.floor((sx - x) / side) == column))
                sx, sy, owner = sx[here], sy[here], np.tile(p, len(steps))[here]
                held: dict[int, tuple[np.ndarray, int]] = {}
                f = f[np.lexsort((ring[f], part[f]))]
                for some in np.split(f, np.flatnonzero((np.diff(part[f]) != 0) | (np.diff(ring[f]) != 0)) + 1):
                    lines = some[odd[some] < 0]
                    count = odd[some].max(initial=0)
                    if len(lines):
                        count = count + parities(sx, sy, tuple(e[lines] for e in edges), row, column)
                    within, outline = np.broadcast_to(count % 2 == 1, len(sx)), ring[some[0]] == 0
                    before = held.get(part[some[0]], (np.zeros(len(sx), bool), some[0]))[0]
                    held[part[some[0]]] = (within if outline else before & ~within), some[0]  # by rings, an outline is the first
                for inside, face in held.values():
                    found = np.unique(owner[inside]) if len(steps) > 1 else owner[inside]
                    whose.append(found)
                    which.append(np.full(len(found), face))
        whose, which = pa.array(np.concatenate(whose)), pa.array(np.concatenate(which))
        return pa.table({"key": points["key"].take(whose), "region": faces["region"].take(which), "part": faces["part"].take(which)})

    def quiet(points: pa.Table, faces: pa.Table) -> pa.Table:
        with np.errstate(divide="ignore", invalid="ignore"):  # of edges along an axis, which no line in that direction crosses
            return run(points, faces)

    return quiet


def cover(vertices: DataFrame, side: float | None = None) -> Cover:
    return Cover(stored(edges(vertices)), side)


def regions_of(points: DataFrame, covered: Cover) -> DataFrame:
    """(key, region, part) of parts of regions that hold points (key, x, y): inside the outline and in none of its holes. A point
    without a place is in none; keys are unique."""
    return covered.holding(points.where("x IS NOT NULL AND y IS NOT NULL"))


def on_land(points: DataFrame, covered: Cover, metres: float = 0.0) -> DataFrame:
    """Keys of points (key, x, y in degrees) on land, or of which one of eight places `metres` around is. Of no land at all, every
    point is on land: a boundary that isn't known takes nothing away."""
    if covered.empty:
        return points.select("key").distinct()
    return covered.holding(points.where("x IS NOT NULL AND y IS NOT NULL"), metres).select("key").distinct()


def _east(metres: Column) -> Column:
    """Degrees of longitude at y."""
    return metres / (F.greatest(F.cos(F.col("y") * math.pi / 180), F.lit(0.1)) * DEGREE_LON_M)


def _around(points: DataFrame, steps: list[tuple[float, float]], radii: tuple[float, ...]) -> DataFrame:
    """(key, radius, x, y): places each radius in metres times each step east and north of points in degrees."""
    each = F.explode(F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for a, b in steps])).alias("_s")
    rows = points.select("key", "x", "y", F.explode(F.array(*[F.lit(r) for r in radii])).alias("radius")).select("*", each)
    return rows.select("key", "radius", (F.col("x") + _east(F.col("_s.a") * F.col("radius"))).alias("x"), (F.col("y") + F.col("_s.b") * F.col("radius") / DEGREE_LAT_M).alias("y"))


# Directions, radii in metres, the land's margin, and the sea bed's least depth, slope and greatest depth.
DIRECTIONS = [(1, 0), (-1, 0), (0, 1), (0, -1), (0.7071, 0.7071), (-0.7071, 0.7071), (0.7071, -0.7071), (-0.7071, -0.7071)]
RADII = (5, 10, 20, 40, 80, 160, 320)
MARGIN, SHALLOW, SLOPE, DEEP = 2.0, 0.75, 0.045, 16.0


def land_distance(points: DataFrame, covered: Cover) -> DataFrame:
    """(key, radius) of points (key, x, y in degrees): 0 on land or within its margin, else the least of RADII at which land lies in one
    of eight directions, else null. All radii are asked at once of the points that aren't on land, so edges are dealt to tasks twice in all."""
    land = stored(on_land(points, covered, MARGIN))
    far = stored(points.select("key", "x", "y").join(land.hint("merge"), "key", "left_anti"))
    samples = _around(far, DIRECTIONS, RADII).select(F.struct("key", "radius").alias("key"), "x", "y")
    close = on_land(samples, covered, MARGIN).groupBy("key.key").agg(F.min("key.radius").alias("radius"))
    return land.withColumn("radius", F.lit(0)).unionByName(far.select("key").join(close.hint("merge"), "key", "left"))


def shown_terrain(points: DataFrame, covered: Cover, sea_level: float = 0.0) -> DataFrame:
    """(key, z, radius) of points (key, x, y, z): their own level on land or where no land is known, else at most that of a sea
    bed that falls with the distance of the land."""
    if covered.empty:
        return points.select("key", "z", F.lit(0).alias("radius"))
    depth = F.coalesce(F.least(F.lit(DEEP), F.col("radius") * SLOPE + SHALLOW), F.lit(DEEP))
    both = points.select("key", "z").join(land_distance(points, covered).hint("merge"), "key")
    return both.select("key", F.when(F.col("radius") == 0, F.col("z")).otherwise(F.least("z", F.lit(sea_level) - depth)).alias("z"), "radius")


def water_levels(parts: DataFrame, outlines: DataFrame, samples: int = 64) -> DataFrame:
    """(region, part, level) of waters: their own level (region, level) where it is known, else the median of the terrain along the
    outline's vertices (region, part, ring, seq, z), of which every n-th is taken so that about `samples` remain."""
    outer = outlines.where("ring = 0")
    sizes = outer.groupBy("region", "part").agg(F.count(F.lit(1)).alias("_n"))
    every = F.greatest(F.floor(F.col("_n") / samples), F.lit(1))
    some = outer.join(sizes, ["region", "part"]).where((F.col("seq") % every == 0) & F.col("z").isNotNull() & ~F.isnan("z"))
    middle = some.groupBy("region", "part").agg(F.median("z").alias("_middle"))  # of fewer than twice `samples`
    known = parts.select("region", F.when(~F.isnan("level"), F.col("level")).alias("level")).distinct()
    return sizes.join(known, "region", "left").join(middle, ["region", "part"], "left").select("region", "part", F.coalesce("level", "_middle").alias("level")).where("level IS NOT NULL")


def water_at(points: DataFrame, covered: Cover, levels: DataFrame) -> DataFrame:
    """(key, level): the lowest level of the waters (region, part, level) that hold a point; points in no water are left out."""
    return regions_of(points, covered).join(levels, ["region", "part"]).groupBy("key").agg(F.min("level").alias("level"))


def classed_cells(points: DataFrame, inland: Cover, levels: DataFrame, land: Cover, metres: float = 5.0, sea_level: float = 0.0) -> DataFrame:
    """(key, kind, level) of points: inland water at its own level before anything else, land within `metres` of which nothing is
    lost, and the sea."""
    held = points.select("key").join(water_at(points, inland, levels).hint("merge"), "key", "left")
    held = held.join(on_land(points, land, metres).withColumn("_land", F.lit(True)).hint("merge"), "key", "left")
    kind = F.when(F.col("level").isNotNull(), "inland").when(F.col("_land"), "land").otherwise("sea")
    return held.select("key", kind.alias("kind"), F.when(kind == "sea", F.lit(sea_level)).otherwise(F.col("level")).alias("level"))
