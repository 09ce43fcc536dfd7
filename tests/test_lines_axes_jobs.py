"""Thinned lines, filled-up axes and the stream of jobs against plain loops."""

import json
import math
import random

import numpy as np
import pytest

from terrakern.operators import modelling as N
from terrakern.sources import lines as L
from terrakern.streaming import jobs as J


def from_segment(p, a, b):
    d = [b[0] - a[0], b[1] - a[1]]
    n = d[0] ** 2 + d[1] ** 2
    t = max(0.0, min(1.0, ((p[0] - a[0]) * d[0] + (p[1] - a[1]) * d[1]) / n)) if n else 0.0
    return math.hypot(p[0] - a[0] - t * d[0], p[1] - a[1] - t * d[1])


def slow_thinned(points, tolerance):
    if len(points) < 3:
        return points
    k = max(range(1, len(points) - 1), key=lambda i: (from_segment(points[i], points[0], points[-1]), -i))
    if from_segment(points[k], points[0], points[-1]) <= tolerance:
        return [points[0], points[-1]]
    return slow_thinned(points[: k + 1], tolerance)[:-1] + slow_thinned(points[k:], tolerance)


def test_thinned_lines():
    draw = random.Random(4)
    for n in (2, 3, 10, 80):
        for _ in range(20):
            points = [(draw.uniform(0, 10), draw.uniform(0, 3)) for _ in range(n)]
            x, y = np.array(points).T
            assert [points[k] for k in L.thinned(x, y, 0.8)] == slow_thinned(points, 0.8)


def test_rings_keep_their_shape_or_go(spark):
    circle = [[math.cos(2 * math.pi * k / 100), math.sin(2 * math.pi * k / 100)] for k in range(100)]
    hole = [[x * 0.5, y * 0.5] for x, y in circle]
    speck, dot = [[5 + x * 1e-3, y * 1e-3] for x, y in circle], [[5.0, 5.0], [5.0, 5.0], [5.0, 5.0]]
    rows = [(1, 0, 0, circle + circle[:1]), (1, 0, 1, hole), (2, 0, 0, speck), (2, 0, 1, circle), (3, 0, 0, dot)]
    rings = spark.createDataFrame(rows, "region long, part int, ring int, points array<array<double>>")
    got = {(r["region"], r["ring"]): r["points"] for r in L.thinned_rings(rings, 0.05).collect()}
    assert set(got) == {(1, 0), (1, 1)} and got[1, 0][0] == got[1, 0][-1] and got[1, 1][0] != got[1, 1][-1]
    assert 4 < len(got[1, 1]) < len(got[1, 0]) < 30
    closed = [*got[1, 0]]
    assert all(min(from_segment(p, a, b) for a, b in zip(closed, closed[1:], strict=False)) <= 0.05 for p in circle)
    assert L.thinned_rings(rings, 0.0).count() == 5


def test_read_and_cut_with_their_holes(spark, tmp_path):
    square = lambda a, b: [[a, a], [b, a], [b, b], [a, b], [a, a]]
    features = [{"geometry": {"type": "Polygon", "coordinates": [square(0, 10), square(2, 4)]}}, {"geometry": {"type": "Point", "coordinates": [1, 1]}}, {"geometry": {"type": "MultiPolygon", "coordinates": [[square(20, 30)], [square(5, 9), square(6, 7)]]}}]
    (tmp_path / "a.json").write_text(json.dumps({"features": features}))
    rings = L.read_polygons(spark, str(tmp_path))
    assert sorted((r["region"]["_n"], r["part"], r["ring"]) for r in rings.collect()) == [(0, 0, 0), (0, 0, 1), (2, 0, 0), (2, 1, 0), (2, 1, 1)]
    cut = sorted((r["region"]["_n"], r["part"], r["ring"]) for r in L.clipped_polygons(rings, (0.0, 0.0, 5.5, 5.5)).collect())
    assert cut == [(0, 0, 0), (0, 0, 1), (2, 1, 0)]


def slow_padded(axis, target):
    axis = sorted(axis)
    while len(axis) < target:
        gaps = [b - a for a, b in zip(axis, axis[1:], strict=False)]
        k = gaps.index(max(gaps))
        axis.insert(k + 1, (axis[k] + axis[k + 1]) / 2)
    return axis


@pytest.mark.parametrize("seed", range(3))
def test_padded_axes(spark, seed):
    draw = random.Random(seed)
    axes = {p: sorted(draw.sample(range(64), draw.randint(2, 9))) for p in range(12)}
    targets = {p: draw.choice([1, 3, 9, 10, 17, 40]) for p in axes}
    axis = spark.createDataFrame([(p, float(v)) for p, some in axes.items() for v in some], "project long, at double")
    got = {p: [] for p in axes}
    for r in N.padded_axis(axis, spark.createDataFrame(list(targets.items()), "project long, target long")).orderBy("project", "place").collect():
        assert r["place"] == len(got[r["project"]])
        got[r["project"]].append(r["at"])
    assert got == {p: slow_padded([float(v) for v in some], targets[p]) for p, some in axes.items()}


def test_jobs_over_batches_with_repeats(spark, tmp_path):
    draw = random.Random(6)
    events = [(k % 5, k, draw.choice([*J.STEPS, "odd"])) for k in range(200)]
    parts = [events[:80], events[60:140], events[140:], events[:200:3]]
    schema = "job long, seq long, action string"
    for n, part in enumerate(parts):
        draw.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in/*")
    J.job_states(stream).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/log").option("path", f"{tmp_path}/out").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(J.ROW).parquet(f"{tmp_path}/out").collect()
    got = {}
    for r in rows:
        if r["applied"] >= got.get(r["job"], (-1,))[0]:
            got[r["job"]] = tuple(r)[1:]
    want = {}
    for job, seq, action in events:
        _, state, attempts, refused = want.get(job, (-1, "none", 0, 0))
        allowed, then = J.STEPS.get(action, (set(), state))
        ok = state in allowed
        want[job] = (seq, then if ok else state, attempts + (ok and action == "submit"), refused + (not ok))
    assert got == want and len(rows) > 5
