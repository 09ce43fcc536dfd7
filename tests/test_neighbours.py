"""The nearest few by tiles against a plain loop: many tiles, places that several rows share, places that are none."""

import math
import random

from terrakern.operators import ground as G
from terrakern.operators.neighbours import nearest_of_places


def test_nearest_of_places_by_tiles(spark):
    draw = random.Random(3)
    at = lambda n: (float(draw.randrange(n)), float(draw.randrange(n)))
    left = [(p, *at(30)) for p in (1, 2, 4) for _ in range(150)]
    right = [(p, 1000 + k, *(at(30) if k % 2 else at(3)), k % 7) for p in (1, 2, 3) for k in range(150)] + [(4, 1, 500.0, 500.0, 5), (4, 2, float("nan"), 0.0, 5)]
    rights = spark.createDataFrame(right, "project long, key long, x double, y double, worth long")
    got = nearest_of_places(spark.createDataFrame(left, "project long, x double, y double"), rights, ["project"], 3, ["worth"], tile=4).collect()
    got = sorted((r["project"], r["x"], r["y"], r["place"], r["other"], r["worth"]) for r in got)
    want = []
    for p, x, y in set(left):
        near = sorted((math.dist((x, y), (a, b)), o, v) for q, o, a, b, v in right if q == p and a == a)
        want += [(p, x, y, n + 1, o, v) for n, (_, o, v) in enumerate(near[:3])]
    assert got == sorted(want)


def test_a_place_that_is_no_number_hides_no_other(spark):
    schema = "project long, key long, x double, y double"
    left = spark.createDataFrame([(1, 1, 0.0, 0.0)], schema)
    right = spark.createDataFrame([(1, 2, 3.0, 4.0), (1, 3, float("nan"), 0.0)], schema)
    assert [(r["other"], r["d"]) for r in G.nearest_in(left, right, ["project"], 2).collect()] == [(2, 5.0)]
