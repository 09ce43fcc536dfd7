"""The ground model's steps on small tables: neighbours by blocks, order of bottoms, fallbacks of the extension, errors off the nodes."""

import math
import random

import numpy as np
import pytest

from terrakern.operators import ground as G
from terrakern.operators.surfaces import LAYERS, distance_weighted

NODE = "project long, j int, i int, x double, y double, ground double"
AXIS = "project long, place int, at double"


def test_nearest_by_blocks(spark, monkeypatch):
    draw = random.Random(1)
    left = [(p, k, float(draw.randrange(6)), float(draw.randrange(6))) for p in (1, 2) for k in range(70)] + [(1, 900, None, 0.0)]
    right = [(p, 1000 + k, float(draw.randrange(6)), float(draw.randrange(6))) for p in (1, 3) for k in range(60)]
    monkeypatch.setattr(G, "BLOCK", 16)
    schema = "project long, key long, x double, y double"
    got = sorted((r["project"], r["key"], r["other"], r["place"]) for r in G.nearest_in(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["project"], 4).collect())
    want = []
    for p, k, x, y in left:
        near = sorted((math.dist((x, y), (a, b)), o) for q, o, a, b in right if q == p) if x is not None else []
        want += [(p, k, o, n + 1) for n, (_, o) in enumerate(near[:4])]
    assert got == sorted(want)
    one = spark.createDataFrame(left, schema).where("x IS NOT NULL")
    assert all(r["other"] == r["key"] for r in G.nearest_in(one.dropDuplicates(["project", "x", "y"]), one.dropDuplicates(["project", "x", "y"]), ["project"]).collect())


def _stack(spark, thick, targets, ordered):
    nodes = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 100.0), (1, 0, 1, 10.0, 0.0, 100.0)], NODE)
    t = spark.createDataFrame([(1, layer, 0, 0, z) for layer, z in thick.items()], "project long, layer string, j int, i int, z double")
    placed = spark.createDataFrame([(1, layer, 0, 0, 0.0, 0.0, z) for layer, z in targets.items()], "project long, layer string, j int, i int, x double, y double, z double")
    rows = G.constrained_stack(nodes, t, placed, spark.createDataFrame([(1, 40.0)], "project long, floor double"), ordered).collect()
    return {r["i"]: ([r[n] for n in LAYERS], r["unknown"], r["crossing"]) for r in rows}


def test_stack_holds_targets(spark):
    thick = {"soil": 5.0, "weathered_rock": 5.0, "soft_rock": 70.0}
    assert _stack(spark, thick, {}, False) == {0: ([95.0, 90.0, 40.0, 40.0, 40.0], 0.0, 0), 1: ([100.0] * 5, 60.0, 0)}
    assert _stack(spark, thick, {"weathered_rock": 97.0}, False)[0] == ([95.0, 97.0, 40.0, 40.0, 40.0], 0.0, 1)
    assert _stack(spark, thick, {"weathered_rock": 97.0}, True)[0] == ([97.0, 97.0, 40.0, 40.0, 40.0], 0.0, 0)
    assert _stack(spark, thick, {"soil": 60.0, "hard_rock": 50.0}, True)[0] == ([60.0, 60.0, 50.0, 50.0, 50.0], 10.0, 0)
    assert _stack(spark, thick, {"soil": 60.0, "soft_rock": 70.0}, True)[0][2] == 1  # two holes' word against each other stays


def test_extension_falls_back(spark):
    nodes = spark.createDataFrame([(p, 0, i, i * 100.0, 0.0, 0.0) for p in (1, 2, 3) for i in range(2)], NODE)
    schema = "project long, layer string, id long, x double, y double, z double"
    anchors = spark.createDataFrame([(1, "soil", 1, 0.0, 0.0, 10.0), (1, "soft_rock", 2, 100.0, 0.0, 5.0), (2, "soil", 3, 0.0, 0.0, 0.0)], schema)
    points = {(r["layer"], r["id"]): r["z"] for r in G.extension_points(anchors).collect()}
    assert points == {("soil", 1): 10.0, ("soil", 2): -3.0, ("soft_rock", 2): 5.0, ("soft_rock", 1): -1.5}
    by = {(r["project"], r["i"]): r for r in G.extension_shares(nodes, anchors, distance_weighted).collect()}
    assert by[1, 0]["soil"] == 1.0 and by[1, 1]["soft_rock"] == 1.0 and by[1, 0]["basis"] == "surface"
    assert by[2, 0]["hard_rock"] == by[3, 1]["hard_rock"] == 1.0 and by[2, 0]["basis"] == "last"
    low = {(r["project"], r["i"]): r for r in G.extension_shares(nodes, anchors, lambda n, a: distance_weighted(n, a.withColumn("z", -a["z"] * a["z"]))).collect()}
    pull = [10.0, 5.0 / 100**2]
    assert low[1, 0]["basis"] == "distance" and low[1, 0]["soil"] == pytest.approx(pull[0] / sum(pull))


def test_extended_stack_ends_at_the_floor(spark):
    stack = spark.createDataFrame([(1, 0, 0, 100.0, 40.0, 95.0, 97.0, 60.0, 60.0, 60.0, 20.0, 1)], "project long, j int, i int, ground double, floor double, soil double, weathered_rock double, soft_rock double, normal_rock double, hard_rock double, unknown double, crossing int")
    shares = spark.createDataFrame([(1, 0, 0, 0.5, 0.0, 0.25, 0.0, 0.25)], "project long, j int, i int, soil double, weathered_rock double, soft_rock double, normal_rock double, hard_rock double")
    (row,) = G.extended_stack(stack, shares).collect()
    assert [row[n] for n in LAYERS] == [85.0, 85.0, 43.0, 43.0, 40.0]


def test_targets_by_node_and_errors_between_nodes(spark):
    axis_x = spark.createDataFrame([(1, 0, 0.0), (1, 1, 1.0), (1, 2, 10.0)], AXIS)
    axis_y = spark.createDataFrame([(1, 0, 0.0), (1, 1, 4.0)], AXIS)
    points = spark.createDataFrame([(1, "soil", 1, 1.0, 4.0, 5.0), (1, "soil", 2, 1.0, 4.0, 7.0), (1, "soil", 3, 5.5, 2.0, 9.0), (1, "soft_rock", 4, 20.0, -1.0, 3.0)], "project long, layer string, id long, x double, y double, z double")
    placed = G.placed_targets(points, axis_x, axis_y)
    rows = sorted((r["layer"], r["j"], r["i"], r["z"], r["n"]) for r in placed.where("j IS NOT NULL").collect())
    assert rows == [("soil", 1, 1, 6.0, 2)] and placed.where("j IS NULL").count() == 2
    flat = spark.createDataFrame([(1, j, i, 0.0, 0.0, float(i * 10 + j), *[1.0] * 4) for j in range(2) for i in range(3)], "project long, j int, i int, ground double, floor double, soil double, weathered_rock double, soft_rock double, normal_rock double, hard_rock double")
    got = {r["layer"]: (r["targets"], r["greatest"], r["mean"]) for r in G.stack_errors(flat, placed, axis_x, axis_y).collect()}
    # at (1, 4) the node has 11 against 6; at (5.5, 2) the mean of 10, 11, 20, 21 against 9; beyond the corner its own value, 1 against 3
    assert got["soil"] == (2, pytest.approx(6.5), pytest.approx(5.75)) and got["soft_rock"] == (1, 2.0, 2.0)


def test_holes_without_known_strata_and_no_holes(spark):
    holes = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0), (1, 2, 1.0, 0.0, 10.0), (1, 3, 2.0, 0.0, None)], "project long, id long, x double, y double, surface double")
    strata = spark.createDataFrame([(1, 0.0, 2.0, "odd"), (2, 3.0, 3.0, "soil"), (2, 0.0, 1.0, "odd"), (2, 1.0, 4.0, "soft_rock"), (3, 0.0, 1.0, "soil")], "borehole_id long, depth_top double, depth_bottom double, strata_group string")
    p = G.profiles(holes, strata)
    assert [(r["id"], r["drilled"], r["first_layer"], r["deepest"]) for r in p.collect()] == [(2, 4.0, "soft_rock", "soft_rock")]
    states = {r["layer"]: r["state"] for r in G.with_states(G.layered(p, strata)).collect()}
    assert states == {n: "present" if n == "soft_rock" else "not_reached" for n in LAYERS}
    assert not G.with_states(G.layered(G.profiles(holes.where("id > 9"), strata), strata)).count()


def test_plates_say_why_they_are_given_up(spark):
    from terrakern.operators import surfaces as U

    draw = random.Random(3)
    even = [(x * 100.0 + draw.random(), y * 100.0 + draw.random(), draw.uniform(0, 10)) for x in range(5) for y in range(5)]
    places = {"fine": even, "few": even[:2], "close": [*even, (even[0][0] + 0.3, even[0][1], 5.0)], "steep": [*even, (even[0][0] + 1e-6, even[0][1], even[0][2] + 100)], "wild": [(x, y, x / 10) for x, y, _ in even]}
    anchors = spark.createDataFrame([(p, "soil", *a) for p, some in places.items() for a in some], "project string, layer string, x double, y double, z double")
    nodes = spark.createDataFrame([(p, 0, i, x, 50.0) for p in places for i, x in enumerate((50.0, 150.0, 9000.0 if p == "wild" else 350.0))], "project string, j int, i int, x double, y double")
    at = lambda near: {p: {r["reason"] for r in rows} for p, rows in _by(U.guarded_plate(nodes, anchors, near)[0].collect()).items()}
    assert at(0.5) == {"fine": {None}, "few": {"few"}, "close": {"close"}, "steep": {"close"}, "wild": {"wild"}}
    assert at(1e-8) == {"fine": {None}, "few": {"few"}, "close": {None}, "steep": {"steep"}, "wild": {"wild"}}
    report = {r["project"]: r for r in U.plate_report(anchors).collect()}
    own = places["fine"]
    pairs = [math.dist(a[:2], b[:2]) for n, a in enumerate(own) for b in own[:n]]
    assert report["fine"]["scale"] == pytest.approx(sum(pairs) / len(pairs)) and report["fine"]["anchors"] == 25 and report["fine"]["steepness"] < 100 and report["steep"]["steepness"] > U.STEEP


def _by(rows):
    out = {}
    for r in rows:
        out.setdefault(r["project"], []).append(r)
    return out


def test_holes_around_nodes_are_counted_in_blocks(spark, monkeypatch):
    """Numbers by state and thickness of the holes within each node's radius; a node meets no hole row by row, and crowded cells are split."""
    rng = np.random.default_rng(4)
    nodes = [("p", "soil", k, float(x), float(y), r) for k, (x, y, r) in enumerate(zip(rng.uniform(-900, 900, 60), rng.uniform(-900, 900, 60), rng.choice([80.0, 250.0], 60).tolist()))]
    held = [("p", "soil", float(x), float(y), str(s), float(t) if s == "present" else None, int(n)) for x, y, s, t, n in zip(rng.integers(-9, 9, 900) * 100, rng.integers(-9, 9, 900) * 100, rng.choice(["present", "absent"], 900), rng.integers(1, 5, 900), rng.integers(1, 4, 900))]
    want = {}
    for _, _, k, x, y, r in nodes:
        for _, _, hx, hy, s, t, n in held:
            if math.hypot(x - hx, y - hy) <= r:
                want[k, s, t] = want.get((k, s, t), 0) + n
    a = spark.createDataFrame(nodes, "project string, layer string, key long, x double, y double, radius double")
    b = spark.createDataFrame(held, "project string, layer string, x double, y double, state string, _t double, _n long")
    for block in (4096, 8):
        monkeypatch.setattr(G, "BLOCK", block)
        heard = G._heard(a, b)
        assert {(r["key"], r["state"], r["_t"]): r["_n"] for r in heard.collect()} == want
