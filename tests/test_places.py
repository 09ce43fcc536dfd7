"""Joins and chains of near points by cells that are crowded, against plain loops; queries on keys beyond those of the small tables."""

import itertools
import math
import random

import pyarrow as pa
import pyarrow.parquet as pq

from terrakern.operators import spatial as P
from terrakern.plans import registry

SCHEMA = "key long, x double, y double, z double"


def _points(seed):
    draw = random.Random(seed)
    free = [(k, draw.uniform(0, 60), draw.uniform(-30, 30)) for k in range(150)]
    return [(k, x, y, float(k % 3)) for k, x, y in free + [(200 + k, 5.0, 5.0) for k in range(60)] + [(300, 900.0, 900.0), (301, None, 0.0)]]


def test_crowded_cells_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(P, "CROWD", 50)
    rows = _points(1)
    points = spark.createDataFrame(rows, SCHEMA)
    near = {(a[0], b[0]): abs(a[3] - b[3]) > 1e-4 for a, b in itertools.combinations(sorted(r for r in rows if r[1] is not None), 2) if math.dist(a[1:3], b[1:3]) <= 4.0}
    got = sorted((r["key"], r["other"]) for r in P.pairs_within(points, 4.0).collect())
    assert got == sorted(near)
    assert P.stability(points, "z", 4.0).first()["conflicting_near_pairs"] == sum(near.values())
    deals = P._met(points, points, 4.0, ()).groupBy("_cx", "_cy").agg(P.F.countDistinct("_deal").alias("n")).agg(P.F.max("n")).first()[0]
    assert deals > 1


def test_clusters_by_cells(spark):
    rows = [r for r in _points(2) if r[1] is not None]
    up = {r[0]: r[0] for r in rows}

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    alone = set(up)
    for a, b in itertools.combinations(rows, 2):
        if math.dist(a[1:3], b[1:3]) <= 3.0:
            alone -= {a[0], b[0]}
            lo, hi = sorted((top(a[0]), top(b[0])))
            up[hi] = lo
    got = sorted((r["key"], r["cluster"]) for r in P.clusters(spark.createDataFrame(_points(2), SCHEMA), 3.0).collect())
    assert got == sorted((k, top(k)) for k in up if k not in alone)


def test_virtual_holes_with_large_keys(spark, tmp_path):
    keys = [*range(97 * 61), *range(26_000, 29_000), *range(76_000, 79_000)]
    table = pa.table({"c_custkey": pa.array(keys, pa.int64()), "c_name": [f"c{k}" for k in keys], "c_nationkey": pa.array([0] * len(keys), pa.int32()), "c_acctbal": [0.0] * len(keys), "c_mktsegment": ["x"] * len(keys)})
    pq.write_table(table, tmp_path / "customer.parquet")
    found = {r["key"]: r["reason"] for r in registry.QUERIES["virtual_holes"](spark, str(tmp_path)).collect()}
    assert found == {k: "close" if k % 4 and k % 19 else "strata" if k % 5 == 0 else None for k in keys}
