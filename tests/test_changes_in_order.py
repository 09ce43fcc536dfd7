"""Several requests for one thing in one batch, and running values over ranges of a table."""

import random

from pyspark.sql import functions as F

from terrakern.operators import changes as X
from terrakern.operators import ordering as R

HOLE = "id long, project_id long, elevation double, is_supplementary boolean"


def slow_versions(versions, changes):
    state = {}
    for key, version, what, data in sorted(versions):
        state[key] = (version, what, data)
    out, refused = list(versions), []
    for key, ord_, action, data in sorted(changes, key=lambda c: (c[0], c[1])):
        version, what, kept = state.get(key, (0, None, None))
        made = action in ("create", "copy")
        reason = "deleted" if what == "deleted" else "taken" if made and what else "absent" if not made and not what else None
        if reason:
            refused.append((key, ord_, action, reason))
            continue
        state[key] = (version + 1, "deleted" if action == "delete" else "live", kept if data is None else data)
        out.append((key, *state[key]))
    return sorted(out, key=str), sorted(refused)


def test_changes_of_one_key_are_folded_in_order(spark):
    draw = random.Random(3)
    versions = [(k, v, "live", f"v{v}") for k in range(0, 20, 2) for v in (1, 2)] + [(k, 3, "deleted", None) for k in range(0, 20, 4)]
    changes = [(draw.randrange(25), n, draw.choice(["create", "copy", "update", "update", "update", "delete"]), draw.choice([None, f"d{n}"])) for n in range(400)] + [(99, n, "update" if n else "create", f"n{n}") for n in range(1000, 0, -1)] + [(99, 0, "create", "z")]
    all_, refused = X.versioned_virtual(spark.createDataFrame(versions, "key long, version long, state string, data string"), spark.createDataFrame(changes, "key long, ord long, action string, data string").repartition(7))
    want, no = slow_versions(versions, changes)
    assert sorted((tuple(r) for r in all_.select("key", "version", "state", "data").collect()), key=str) == want
    assert sorted(tuple(r) for r in refused.collect()) == no and {r[3] for r in no} == {"deleted", "taken", "absent"}


def test_created_once(spark):
    holes = spark.createDataFrame([(1, 1, 0.0, False)], HOLE)
    links = spark.createDataFrame([], "project_id long, borehole_id long, project_role string")
    new = spark.createDataFrame([(2, 1, 5.0, False), (2, 1, 4.0, True), (1, 1, 9.0, False), (3, 1, 1.0, False), (3, 1, 1.0, False)], HOLE)
    strata = spark.createDataFrame([(3, 2.0, 2.0)], "borehole_id long, depth_top double, depth_bottom double")
    all_, linked, refused = X.created(holes, links, new, strata)
    assert sorted((r["id"], r["elevation"]) for r in all_.collect()) == [(1, 0.0), (2, 4.0)]
    assert [tuple(r) for r in linked.collect()] == [(1, 2, "new")]
    assert sorted(tuple(r) for r in refused.collect()) == [(1, "taken"), (2, "repeated"), (3, "strata"), (3, "strata")]


def test_one_target_takes_the_last_upload(spark):
    holes = spark.createDataFrame([(1, 0.0)], "id long, elevation double")
    strata = spark.createDataFrame([(1, 9.0)], "borehole_id long, depth_bottom double")
    uploaded = spark.createDataFrame([(10, 7, 5.0, 2), (11, 7, 6.0, 1)], "id long, project_id long, elevation double, ord int")
    new_strata = spark.createDataFrame([(10, 5.0), (11, 7.0)], "borehole_id long, depth_bottom double")
    actions = spark.createDataFrame([(10, "replace", 1), (11, "replace", 1)], "key long, action string, target long")
    links = spark.createDataFrame([], "project_id long, borehole_id long, project_role string")
    a, b, linked = X.applied_upload(holes, strata, links, actions, uploaded, new_strata)
    assert [tuple(r) for r in a.collect()] == [(1, 5.0)] and [tuple(r) for r in b.collect()] == [(1, 5.0)] and linked.count() == 1


def test_overrides_of_one_hole_add_up(spark):
    key = "project_id long, source_borehole_id long, status string, elevation double, name string"
    holes = spark.createDataFrame([(5, 1.0, "own", False)], "id long, elevation double, name string, is_supplementary boolean")
    asked = spark.createDataFrame([(1, 5, None, 2.0, None, 1), (1, 5, "review", None, "b", 2), (1, 5, None, 3.0, None, 3)], key + ", ord int")
    out = X.overridden(spark.createDataFrame([], key), asked, holes, ["elevation", "name"])
    assert [tuple(r) for r in out.collect()] == [(1, 5, "review", 3.0, "b")]


def test_observations_are_set_by_key(spark):
    old = spark.createDataFrame([("a", 1.0, 9.0, "GL", "confirmed"), ("b", 1.0, 9.0, "EL", "auto"), ("z", 1.0, None, "GL", "auto")], "key string, depth double, head double, datum string, review_status string").withColumn("deleted_at", F.when(F.col("key") != "a", F.lit("2024-01-01").cast("timestamp_ntz")))
    new = spark.createDataFrame([("a", 10.0, 2.0, None, 1), ("a", 10.0, None, 7.0, 2), ("b", 10.0, 3.0, 3.0, 1), ("c", 10.0, 4.0, None, 1), ("c", 10.0, None, None, 2), ("d", None, None, None, 1), ("e", None, -2.0, None, 1)], "key string, elevation double, depth double, head double, ord int")
    got = {r["key"]: (r["depth"], r["head"], r["datum"], r["review_status"], r["deleted_at"] is None) for r in X.observed(old, new).collect()}
    assert got == {
        "a": (3.0, 7.0, "GL", "confirmed", True), "b": (3.0, 3.0, "EL", "needs_review", True), "z": (1.0, None, "GL", "auto", False), "c": (4.0, 6.0, "GL", "confirmed", True), "e": (2.0, None, "GL", "confirmed", True),
    }


def test_running_values_and_places_over_ranges(spark):
    draw = random.Random(8)
    rows = [(draw.choice([1, 1, 1, 2, None]), n, draw.choice([None, None, n])) for n in range(500)]
    df = spark.createDataFrame(rows, "k long, n long, v long").repartition(9)
    got = {r["n"]: (r["seen"], r["many"]) for r in R.running(df, ["k"], [F.col("n")], {"seen": F.col("v")}, {"many": F.col("n") % 3 == 0}).collect()}
    last, many, want = {}, {}, {}
    for k, n, v in rows:
        last[k] = v if v is not None else last.get(k)
        many[k] = many.get(k, 0) + (n % 3 == 0)
        want[n] = (last[k], many[k])
    assert got == want
    assert [r["place"] for r in R.placed(df, [], [F.desc("n")]).orderBy(F.desc("n")).collect()] == list(range(500))
