"""Occurrences of soils, their order in a project, layers of detail; and orders of names by components, against plain loops."""

import random

from pyspark.sql import functions as F

from terrakern.operators import details as D
from terrakern.operators import documents as DOC


def slow_order(names, edges):
    """names: {name: rank tuple}; the least free name first, circular ones last."""
    waits = {n: len({a for a, b in edges if b == n and a != b and a in names}) for n in names}
    out = []
    while True:
        free = [n for n in names if n not in out and not waits[n]]
        if not free:
            return out + sorted((n for n in names if n not in out), key=names.get)
        n = min(free, key=names.get)
        out.append(n)
        for b in {b for a, b in edges if a == n and b != n and b in names}:
            waits[b] -= 1


def test_names_in_order_by_components(spark):
    draw = random.Random(5)
    for n, m in ((0, 0), (1, 0), (12, 6), (30, 12), (30, 60)):
        names = {f"n{k}": (float(draw.randrange(8)), f"n{k}") for k in range(n)}
        keys = list(names)
        edges = [tuple(draw.sample(keys, 2)) for _ in range(m)] if n > 1 else []
        if m == 12:  # no circle
            edges = [tuple(sorted(e, key=lambda k: int(k[1:]) * 7 % 30)) for e in edges]
        e = spark.createDataFrame([*edges, ("n0", "gone")], "upper string, lower string")
        rows = DOC.topological(e, spark.createDataFrame([(k, r[0]) for k, r in names.items()], "name string, rank double")).collect()
        assert [r["name"] for r in sorted(rows, key=lambda r: r["place"])] == slow_order(names, set(edges))


STRATA = "borehole_id long, depth_top double, depth_bottom double, strata_group string, soil_type string"
HOLES = "project long, id long, x double, y double, surface double"


def _found(spark):
    holes = spark.createDataFrame([(1, 1, 0.0, 0.0, 100.0), (1, 2, 10.0, 0.0, 100.0), (1, 3, 20.0, 0.0, 100.0), (2, 4, 0.0, 0.0, 50.0)], HOLES)
    strata = spark.createDataFrame([
        (1, 0.0, 2.0, "soil", "점토"), (1, 2.0, 3.0, "soil", "모래"), (1, 3.0, 5.0, "soil", "점토"), (2, 0.0, 4.0, "soil", "모래"), (2, 4.0, 4.0, "soil", "점토"), (2, 4.0, 5.0, "soil", "토사"), (3, 0.0, 1.0, "soil", "토사"),
        (3, 1.0, 2.0, "hard_rock", "점토"), (4, 0.0, 1.0, "soil", "모래"), (4, 1.0, 2.0, "soil", "점토"),
    ], STRATA)
    return holes, D.occurrences(holes, strata)


def test_occurrences_and_their_order(spark):
    _, found = _found(spark)
    rows = {(r["id"], r["key"]): (r["place"], r["thickness"], r["z"], r["after"]) for r in found.collect()}
    clay, sand = "점토", next(k for _, k in {(r["id"], r["name"]) for r in found.collect()} if k != "점토")
    assert rows == {
        (1, f"{clay}#1"): (0, 2.0, 98.0, f"{sand}#1"), (1, f"{sand}#1"): (1, 1.0, 97.0, f"{clay}#2"), (1, f"{clay}#2"): (2, 2.0, 95.0, None), (2, f"{sand}#1"): (0, 4.0, 96.0, None), (4, f"{sand}#1"): (0, 1.0, 49.0, f"{clay}#1"), (4, f"{clay}#1"): (1, 1.0, 48.0, None),
    }
    got = {(r["project"], r["key"]): r["place"] for r in D.occurrence_places(found, (sand, clay)).collect()}
    assert got == {(1, f"{clay}#1"): 0, (1, f"{sand}#1"): 1, (1, f"{clay}#2"): 2, (2, f"{sand}#1"): 0, (2, f"{clay}#1"): 1}


def test_drawn_orders(spark):
    draw, words = random.Random(2), ("a", "b", "c")
    rows = []
    for project in range(4):
        for hole in range(draw.choice([2, 6])):
            seen, keys = {}, []
            for name in draw.choices(["a", "b", "c", "d"], k=draw.randint(1, 4)):
                seen[name] = seen.get(name, 0) + 1
                keys.append((name, seen[name]))
            rows += [(project, f"{n}#{k}", n, k, p, f"{keys[p + 1][0]}#{keys[p + 1][1]}" if p + 1 < len(keys) else None) for p, (n, k) in enumerate(keys)]
    found = spark.createDataFrame(rows, "project long, key string, name string, nth int, place int, after string")
    got = {}
    for r in D.occurrence_places(found, words).orderBy("place").collect():
        got.setdefault(r["project"], []).append(r["key"])
    for project in got:
        own = [r for r in rows if r[0] == project]
        names = {k: (words.index(n) + 1 if n in words else 4, nth, sum(r[4] for r in own if r[1] == k) / sum(r[1] == k for r in own), k) for _, k, n, nth, _, _ in own}
        assert got[project] == slow_order(names, {(r[1], r[5]) for r in own if r[5]})


def test_layers_from_parts(spark):
    nodes = spark.createDataFrame([(1, 0, i, 10.0, b) for i, b in enumerate((0.0, 0.0, 9.98, 11.0, 0.0))], "project long, j int, i int, top double, base double")
    part = lambda n, key, thickness, contact, snap=None: (n, key, thickness, contact, snap)
    two = [part(1, "b", 3.0, -9.0), part(0, "a", 1.0, -9.0)]
    parts = spark.createDataFrame([(1, 0, 0, two), (1, 0, 1, [part(0, "a", 1.0, 9.0), part(1, "b", 3.0, -9.0, 20.0)]), (1, 0, 2, two), (1, 0, 3, two)], "project long, j int, i int, parts array<struct<place:int,key:string,thickness:double,contact:double,snap:double>>")
    parts = parts.withColumn("parts", F.array_sort("parts"))
    got = {}
    for r in D.layers_of_detail(nodes, parts).collect():
        got.setdefault(r["i"], []).append((r["key"], round(r["top"], 6), round(r["bottom"], 6)))
    assert sorted(got[0]) == [("a", 10.0, 7.5), ("b", 7.5, 0.0)]  # shares of all that is there
    assert sorted(got[1]) == [("a", 10.0, 9.0), ("b", 9.0, 8.95), ("토사", 8.95, 0.0)]  # no deeper than its contact; where a hole shows it, but not above its top
    assert 2 not in got and 3 not in got and got[4] == [("토사", 10.0, 0.0)]
