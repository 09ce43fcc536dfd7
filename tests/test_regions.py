"""Points in polygons of a table against every edge, and what follows from it on land and water."""

import math
import random

import pytest

from terrakern.operators import regions as R


def rings_of(seed, n):
    draw, out = random.Random(seed), {}
    for region in range(n):
        cx, cy, size = draw.uniform(0, 50), draw.uniform(0, 50), draw.choice([0.7, 4, 20, 30])
        for part in range(draw.choice([1, 1, 2])):
            for ring, scale in enumerate([1.0, 0.5][: draw.choice([1, 2])]):
                k = draw.choice([3, 4, 7, 60])
                out[region, part, ring] = [(cx + part * 3 * size + scale * size * draw.uniform(0.6, 1) * math.cos(2 * math.pi * i / k), cy + scale * size * draw.uniform(0.6, 1) * math.sin(2 * math.pi * i / k)) for i in range(k)]
    return out


def held(ring, x, y):
    inside = False
    for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (y0 > y) != (y1 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0:
            inside = not inside
    return inside


def holding(rings, x, y):
    parts = {k[:2] for k in rings}
    return {p for p in parts if held(rings[*p, 0], x, y) and not any(held(r, x, y) for k, r in rings.items() if k[:2] == p and k[2] > 0)}


def table(spark, rings):
    return spark.createDataFrame([(*k, n, float(x), float(y)) for k, ring in rings.items() for n, (x, y) in enumerate(ring)], "region long, part int, ring int, seq int, x double, y double")


@pytest.mark.parametrize(("seed", "side"), [(1, None), (2, None), (3, 2.5), (4, 100.0)])
def test_points_in_drawn_polygons(spark, seed, side):
    rings, draw = rings_of(seed, 12), random.Random(seed)
    places = [(k, draw.uniform(-5, 80), draw.uniform(-5, 80)) for k in range(600)] + [(600 + n, *ring[0]) for n, ring in enumerate(rings.values())]
    covered = R.cover(table(spark, rings).repartition(3), side)
    got = {tuple(r) for r in R.regions_of(spark.createDataFrame([*places, (-1, None, 1.0)], "key long, x double, y double"), covered).collect()}
    want = {(k, *p) for k, x, y in places for p in holding(rings, x, y)}
    assert got == want and len(want) > 100


def test_whole_numbers_and_shared_edges(spark):
    rings = {(a * 4 + b, 0, 0): [(a, b), (a + 1, b), (a + 1, b + 1), (a, b + 1)] for a in range(4) for b in range(4)}
    points = spark.createDataFrame([(n, n % 9 / 2, n // 9 / 2) for n in range(81)], "key long, x double, y double")
    got = {tuple(r)[:2] for r in R.regions_of(points, R.cover(table(spark, rings))).collect()}
    assert got == {(n, p[0]) for n in range(81) for p in holding(rings, n % 9 / 2, n // 9 / 2)}
    assert sorted(k for k, _ in got) == sorted({k for k, _ in got})  # neighbours share no point


def test_closed_rings_and_no_polygons(spark):
    rings = spark.createDataFrame([(0, 0, 0, [[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 0.0]])], "region long, part int, ring int, points array<array<double>>")
    assert R.vertices_of(rings).count() == 3 and R.edges(R.vertices_of(rings)).count() == 3
    nothing = R.cover(R.vertices_of(rings.where("region > 0")))
    points = spark.createDataFrame([(1, 1.0, 1.0, 5.0)], "key long, x double, y double, z double")
    assert nothing.empty and not R.regions_of(points, nothing).count() and R.on_land(points, nothing, 5.0).count() == 1
    assert [tuple(r) for r in R.shown_terrain(points, nothing).collect()] == [(1, 5.0, 0)]


def test_a_ring_of_many_edges_is_split(spark):
    n = 40_000
    ring = [(math.cos(2 * math.pi * k / n) * (1 + 0.01 * (k % 2)), math.sin(2 * math.pi * k / n) * (1 + 0.01 * (k % 2))) for k in range(n)]
    covered = R.cover(table(spark, {(0, 0, 0): ring}))
    per_cell = covered.touched.groupBy("_r", "_c").count().agg({"count": "max"}).first()[0]
    assert per_cell < n / 50
    places = [(k, 1.02 * math.cos(k), 1.02 * math.sin(k) * (0.5 + k % 3 / 4)) for k in range(200)]
    got = {r["key"] for r in R.regions_of(spark.createDataFrame(places, "key long, x double, y double"), covered).collect()}
    assert got == {k for k, x, y in places if held(ring, x, y)}


def test_land_water_and_sea_bed(spark):
    x, y = 129.0, 35.0
    east = lambda m: x + m / (R.DEGREE_LON_M * math.cos(math.radians(y)))
    land = R.cover(table(spark, {(0, 0, 0): [(x - 0.01, y - 0.01), (x, y - 0.01), (x, y + 0.01), (x - 0.01, y + 0.01)]}))
    places = [(k, east(m), y, 3.0) for k, m in enumerate((-50, 1, 4, 6.5, 11, 100, 319, 330))]
    points = spark.createDataFrame(places, "key long, x double, y double, z double")
    got = {r["key"]: (r["z"], r["radius"]) for r in R.shown_terrain(points, land).collect()}
    radii = [0, 0, 5, 5, 10, 160, 320, None]
    assert {k: r for k, (_, r) in got.items()} == dict(enumerate(radii))
    assert all(z == (3.0 if r == 0 else pytest.approx(-min(16, 0.75 + r * 0.045) if r else -16.0)) for z, r in got.values())
    water = table(spark, {(7, 0, 0): [(east(-60), y - 1e-4), (east(-40), y - 1e-4), (east(-40), y + 1e-4), (east(-60), y + 1e-4)], (8, 0, 0): [(east(-55), y - 1e-4), (east(2), y - 1e-4), (east(2), y + 1e-4), (east(-55), y + 1e-4)], (9, 0, 0): [(0, 0), (1, 0), (0, 1)]})
    outlines = water.selectExpr("*", "CASE WHEN region = 8 THEN CAST(seq AS DOUBLE) WHEN region = 7 THEN 9.0 END AS z")
    levels = R.water_levels(spark.createDataFrame([(7, 2.5), (8, float("nan"))], "region long, level double"), outlines)
    assert {tuple(r) for r in levels.collect()} == {(7, 0, 2.5), (8, 0, 1.5)}
    kinds = {r["key"]: (r["kind"], r["level"]) for r in R.classed_cells(points, R.cover(water), levels, land).collect()}
    assert kinds[0] == ("inland", 1.5) and kinds[1] == ("inland", 1.5) and kinds[2] == ("land", None) and kinds[3] == ("sea", 0.0)


def test_long_edges_touch_a_few_cells_each(spark):
    """A ring whose edges go to and fro over all its width: cells, and rows that meet a point, don't grow faster than the edges."""
    for n in (400, 4000):
        ring = [(math.cos(2 * math.pi * k / n) * (1 - 0.6 * (k % 2)), math.sin(2 * math.pi * k / n) * (1 - 0.6 * (k % 2))) for k in range(n)]
        covered = R.cover(table(spark, {(0, 0, 0): ring}))
        assert covered.touched.count() <= 8 * n
    places = [(k, 1.1 * math.cos(k), 1.1 * math.sin(k) * (0.5 + k % 3 / 4)) for k in range(300)]
    got = {r["key"] for r in R.regions_of(spark.createDataFrame(places, "key long, x double, y double"), covered).collect()}
    assert got == {k for k, x, y in places if held(ring, x, y)} and len(got) > 20


@pytest.mark.parametrize("rows", [200_000, 50])
def test_land_around_drawn_places(spark, monkeypatch, rows):
    """Nine places around each, and all radii at once, against every edge; no table goes to all tasks."""
    monkeypatch.setattr(R, "ROWS", rows)
    draw = random.Random(5)
    rings = {k: [(120 + x * 1e-4, 35 + y * 1e-4) for x, y in ring] for k, ring in rings_of(6, 8).items()}
    places = [(k, 120 + draw.uniform(-30, 90) * 1e-4, 35 + draw.uniform(-30, 90) * 1e-4) for k in range(150)]
    covered, points = R.cover(table(spark, rings)), spark.createDataFrame(places, "key long, x double, y double")

    def near(x, y, metres):
        east, north = metres / (max(math.cos(y * math.pi / 180), 0.1) * R.DEGREE_LON_M), metres / R.DEGREE_LAT_M
        return any(holding(rings, x + a * east, y + b * north) for a in (-1, 0, 1) for b in (-1, 0, 1))

    land = R.on_land(points, covered, 40.0)
    assert "Broadcast" not in land._jdf.queryExecution().toString()
    assert {r["key"] for r in land.collect()} == {k for k, x, y in places if near(x, y, 40.0)}

    def radius(x, y):
        if near(x, y, R.MARGIN):
            return 0
        for r in R.RADII:
            east, north = r / (max(math.cos(y * math.pi / 180), 0.1) * R.DEGREE_LON_M), r / R.DEGREE_LAT_M
            if any(near(x + a * east, y + b * north, R.MARGIN) for a, b in R.DIRECTIONS):
                return r
        return None

    got = {r["key"]: r["radius"] for r in R.land_distance(points, covered).collect()}
    assert got == {k: radius(x, y) for k, x, y in places} and len(set(got.values())) > 4


@pytest.mark.parametrize("side", [0.7, 1.3, 2.7])
def test_edges_level_but_for_the_last_digit(spark, side):
    """Places at the height of long edges whose ends differ by a rounding error, both ways up."""
    rings, low, high = {}, math.nextafter(496, 0), math.nextafter(496, 1e9)
    for k, (a, b) in enumerate([(low, high), (high, low), (low, 496.0), (496.0, high), (math.nextafter(low, 0), high)]):
        rings[k, 0, 0] = [(0.0, 490.0), (17.3, 490.0), (23.1, a), (3.3, b), (1.0, 495.0)]
        rings[k + 10, 0, 0] = [(0.0, 499.0), (3.3, a), (23.1, b), (19.0, 500.0)]
    places = [(n * 3 + m, n / 8 - 1, y) for n in range(210) for m, y in enumerate((low, 496.0, high))]
    got = {tuple(r)[:2] for r in R.regions_of(spark.createDataFrame(places, "key long, x double, y double"), R.cover(table(spark, rings), side)).collect()}
    assert got == {(k, p[0]) for k, x, y in places for p in holding(rings, x, y)}
