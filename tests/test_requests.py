"""Projects by requests, written coordinates, terrain tiles and page texts on small tables worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from terrakern.functions import parse, scores, text
from terrakern.operators import coordinates as C
from terrakern.operators import duplicates as D
from terrakern.operators import projects as PR
from terrakern.operators import reads as R
from terrakern.operators import terrain as TR

PROJECTS = "project_id long, name string, region string, owner_id long, deleted_at string"
LINKS = "id long, project_id long, borehole_id long, project_role string, deleted_at string"
HOLES = "id long, project_id long, is_supplementary boolean, deleted_at string"
REQUESTS = "ord long, action string, project_id long, user_id long, is_admin boolean, at string, selected array<long>, name string, region string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_requests_meet_what_earlier_ones_left(spark):
    projects = spark.createDataFrame([(1, "old", "r", 10, None), (2, "gone", "r", 10, "t0"), (3, "quiet", None, None, None)], PROJECTS)
    links = spark.createDataFrame([(1, 1, 100, "excluded", "t0"), (2, 1, 100, "duplicate_linked", None), (3, 1, 101, "excluded", "t0"), (4, 1, 104, "excluded", "t0")], LINKS)
    holes = spark.createDataFrame([(100, 9, True, None), (101, 1, True, None), (102, 1, True, "t0"), (104, 1, None, None), (105, 9, True, None)], HOLES)
    requests = spark.createDataFrame(
        [
            (1, "update", 1, 10, False, "t1", [100, 100, None], "a", "r1"),
            (2, "update", 1, 99, False, "t2", [105], "b", "r2"),
            (3, "update", 1, 99, True, "t3", [101, 102, 777, 105], "c", None),
            (4, "delete", 1, 99, False, "t4", None, None, None),
            (5, "delete", 1, 10, None, "t5", [104], None, None),
            (6, "update", 1, 10, False, "t6", [104], "d", None),
            (7, "delete", 1, 10, False, "t7", None, None, None),
            (8, "create", None, 5, False, "t8", [101], "new", None),
            (9, "create", None, None, None, "t9", None, "bare", "x"),
            (10, "update", 2, 10, True, "t10", None, "e", None),
            (11, "delete", 77, 10, True, "t11", None, None, None),
            (12, "update", 3, None, None, "t12", None, "f", None),
        ],
        REQUESTS,
    )
    after, linked, refused = PR.applied(projects, links, holes, requests)
    assert {r["ord"]: r["reason"] for r in refused.collect()} == {2: "forbidden", 4: "forbidden", 6: "missing", 7: "missing", 10: "missing", 11: "missing", 12: "forbidden"}
    assert {r["project_id"]: tuple(r)[1:] for r in after.select("project_id", "name", "region", "owner_id", "deleted_at").collect()} == {
        1: ("c", None, 10, "t5"), 2: ("gone", "r", 10, "t0"), 3: ("quiet", None, None, None), 4: ("new", None, 5, None), 5: ("bare", "x", None, None),
    }
    got = {(r["id"], r["project_id"], r["borehole_id"]): (r["project_role"], r["deleted_at"]) for r in linked.collect()}
    assert got == {
        (1, 1, 100): ("excluded", "t0"), (2, 1, 100): ("duplicate_linked", None), (3, 1, 101): ("new", None), (4, 1, 104): ("excluded", "t0"), (None, 1, 105): ("existing", None), (None, 4, 101): ("existing", None),
    }


def test_no_projects_no_requests(spark):
    none = [spark.createDataFrame([], s) for s in (PROJECTS, LINKS, HOLES, REQUESTS)]
    assert [df.count() for df in PR.applied(*none)] == [0, 0, 0]
    one = spark.createDataFrame([(1, "create", None, 5, False, "t", None, "n", None)], REQUESTS)
    assert rows(PR.applied(*none[:3], one)[0].select("project_id", "name", "owner_id")) == [(1, "n", 5)]


HERE = (126.0, 35.5, 127.5, 36.5), (125.0, 35.0, 128.0, 37.0)
THERE = (128.5, 33.5, 129.5, 34.5), (128.0, 33.0, 130.0, 35.0)


@pytest.mark.parametrize(("boxes", "lon", "lat"), [(HERE, 126.56, 36.05), (THERE, 128.98, 34.03)])
def test_the_region_says_which_number_is_the_easting(spark, boxes, lon, lat):
    p = spark.createDataFrame([("383,000 m", "160000", "EPSG:5186"), ("160000", "383000", "EPSG:5186")], "x string, y string, crs string")
    for r in C.normalized(p, "x", "y", "crs", *boxes).collect():
        assert r["lon"] == pytest.approx(lon, abs=0.02) and r["lat"] == pytest.approx(lat, abs=0.02) and r["system"] == "EPSG:5186"
    fixed = C.normalized(p, "x", "y", "crs", *boxes, order=F.lit("easting_northing")).where("x LIKE '383%'").first()
    assert fixed["lat"] == pytest.approx(34.03, abs=0.02)


def test_written_coordinates(spark):
    cases = [
        ("127", "38", "WGS84", (127.0, 38.0, 200000.0, 600000.0, "WGS84")),
        ("200,000.000", "600000", "EPSG:5186", (127.0, 38.0, 200000.0, 600000.0, "EPSG:5186")),
        ("20000", "600000", "EPSG:5186", (127.0, 38.0, 200000.0, 600000.0, "EPSG:5186")),  # a digit is missing
        ("600000", "200000", None, (127.0, 38.0, 200000.0, 600000.0, "EPSG:5186_INFERRED")),
        (None, "600000", "EPSG:5186", (None, None, None, None, "EPSG:5186")),
        ("", "", None, (None, None, None, None, "UNKNOWN")),
        ("1-2", "600000", "EPSG:5186", (None, None, None, None, "EPSG:5186")),
        ("9000", "9000", None, (None, None, None, None, "UNKNOWN")),
        ("9e9", "3", None, (None, None, None, None, "UNKNOWN")),  # letters don't count: 99
    ]
    p = spark.createDataFrame([(n, *c[:3]) for n, c in enumerate(cases)], "n int, x string, y string, crs string")
    got = {r["n"]: r for r in C.normalized(p, "x", "y", "crs", (126.0, 37.0, 128.0, 39.0), (125.0, 36.0, 129.0, 39.0)).collect()}
    for n, case in enumerate(cases):
        assert tuple(got[n][c] for c in ("lon", "lat", "tm_x", "tm_y", "system")) == case[3], case


def test_a_box_is_looked_at_as_closely_as_nine_tiles_allow(spark):
    def plain(x0, y0, x1, y1):
        def at(lon, lat, z):
            s = math.sin(math.radians(lat))
            return (lon + 180) / 360 * 2**z, (0.5 - math.log((1 + s) / (1 - s)) / (4 * math.pi)) * 2**z

        for z in range(14, 7, -1):
            (left, upper), (right, lower) = at(x0, y1, z), at(x1, y0, z)
            xs, ys = range(math.floor(left), math.floor(right) + 1), range(math.floor(upper), math.floor(lower) + 1)
            if len(xs) * len(ys) <= 9 or z == 8:
                return {(z, x, y) for x in xs for y in ys}

    boxes = [(127.0, 36.0, 127.0, 36.0), (127.0, 36.0, 127.05, 36.02), (126.9, 35.9, 127.3, 36.4), (124.0, 33.0, 132.0, 39.0), (-0.001, -0.001, 0.001, 0.001)]
    df = spark.createDataFrame([(n, *b) for n, b in enumerate(boxes)], "n int, x0 double, y0 double, x1 double, y1 double")
    got = TR.tiles_of(df, "n").collect()
    for n, b in enumerate(boxes):
        assert {(r["zoom"], r["tx"], r["ty"]) for r in got if r["n"] == n} == plain(*b)


def test_heights_of_pixels(spark):
    boxes = spark.createDataFrame([(1, 127.0, 36.0, 127.01, 36.01)], "p int, x0 double, y0 double, x1 double, y1 double")
    places = spark.createDataFrame([(1, "a", 127.0, 36.0), (1, "b", 127.005, 36.005), (1, "c", 127.01, 36.01), (1, "d", 127.009, 36.001), (1, "far", 10.0, 10.0)], "p int, k string, lon double, lat double")
    at = {r["k"]: r for r in TR.pixels_of(places, boxes, "p").collect()}
    edge = TR.looked_at(boxes).first()
    assert (at["far"]["px"], at["far"]["py"]) == (edge["tile_left"] * 256, edge["tile_lower"] * 256 + 255)
    colours = {"a": (128, 12, 128), "b": (255, 0, 0), "c": (127, 200, 0)}  # 12.5 m, above all ground, below it
    pixels = spark.createDataFrame([(at[k]["zoom"], at[k]["px"], at[k]["py"], *c) for k, c in colours.items()] + [(14, at["a"]["px"], at["a"]["py"], 128, 13, 0)], "zoom int, px long, py long, r int, g int, b int")
    assert {r["k"]: r["z"] for r in TR.heights(places, boxes, pixels, "p").collect()} == {"a": 12.5, "b": None, "c": None, "d": 0.0, "far": 0.0}


def test_names_of_pages(spark):
    said = {
        "황갈색 실트 (ML)": "실트", "SP": "모래", "SPT": "토사", "a-SC-1": "모래", "부분풍화암질": "풍화암", "전답토": "토사", "견고한 암": "경암", "무른암": "연암", "암반": "보통암", "역질": "자갈",
        "": "토사", "!?": "토사", "리핑암": "리핑암", "ＣＬ": "점토",
    }
    df = spark.createDataFrame([(k,) for k in said] + [(None,)], "raw string")
    assert {r[0]: r[1] for r in df.select("raw", text.page_name(F.col("raw"))).collect()} == said | {None: "토사"}
    shown = df.select("raw", text.table_name(F.col("raw")).alias("t"), text.read_name(F.col("raw")).alias("r"))
    assert {r["raw"]: (r["t"], r["r"]) for r in shown.collect() if r["raw"] in ("리핑암", "", None)} == {"리핑암": ("연암", "연암"), "": ("", "토사"), None: ("토사", "토사")}
    assert spark.createDataFrame([("연 앙",)], "raw string").select(text.read_name(F.col("raw"))).first()[0] == "연암"


def test_scores_of_texts(spark):
    df = spark.createDataFrame([("1.5\n2,5",), ("점토\r점 토\n사\n전답토",), ("BH-1 �",), ("",), ("1" * 50,)], "t string")
    got = [tuple(r) for r in df.select(*[f(F.col("t")) for f in (scores.numeric_score, scores.soil_score, scores.general_score)]).collect()]
    assert got[0][0] == 2 * 10 + 7 - 5
    assert got[1][1] == 2 * 20 + 2 * 10 + 2 - 3 + 8
    assert got[2][2] == 5 + 10 - 20
    assert got[3] == (0, 0, 0)
    assert got[4][0] == 10 + 20
    pick = lambda field, *readings: df.limit(1).select(scores.best_text([F.lit(r).cast("string") for r in readings], F.lit(field).cast("string"))).first()[0]
    assert pick("Depth", "a", "1.5", "2.5") == "1.5"  # the first of equals
    assert pick("remark", "", "long text", "b") == "" and pick("remark", None, " b ", None) == "b" and pick(None, "a", "1", None) == "a"
    assert pick("depth", None, " ", "") == ""


def test_flags_of_holes(spark):
    holes = spark.createDataFrame([(1, 127.0, 36.0, None), (2, 0.0, 0.0, "pending_review"), (3, None, 36.0, ""), (4, 127.0, 43.0, "x")], "id long, longitude double, latitude double, data_status string")
    bad = spark.createDataFrame([(1, False), (2, True), (4, None)], "borehole_id long, depth_anomaly boolean")
    twice = spark.createDataFrame([(1,), (1,), (9,)], "id long")
    assert {r["id"]: r["flags"] for r in D.derived_flags(holes, bad, twice).collect()} == {
        1: ["duplicate"], 2: ["depth_anomaly", "unreviewed", "coord_outlier"], 3: ["unreviewed", "coord_outlier"], 4: ["unreviewed"],
    }


def test_boxes_as_written(spark):
    df = spark.createDataFrame([("1,2,3,4",), ("1,2,1,2",), ("3,2,1,4",), ("1,2,3",), ("1,,3,4",), ("",), (None,), ("x",)], "t string")
    assert [r[0] for r in df.select(parse.box_of(F.col("t"))["reason"]).collect()] == [None, "order", "order", "numbers", "numbers", "numbers", "numbers", "numbers"]
    assert [r[0] for r in df.select(parse.box_of(F.col("t"), point=True)["reason"]).collect()] == [None, None, "order", "numbers", "numbers", None, None, "numbers"]
    assert df.select(parse.box_of(F.col("t"))["box"]).first()[0] == [1.0, 2.0, 3.0, 4.0]


def test_origin_of_files(spark):
    holes = spark.createDataFrame([(1, 1, True, None, "a"), (2, 1, None, None, "b"), (3, 1, False, "t", "b"), (4, 1, False, None, None), (5, 2, False, None, "b")], HOLES + ", source_file string")
    links = spark.createDataFrame([(1, 1, 2, "existing", None), (2, 1, 2, "new", None), (3, 2, 5, "new", "t"), (4, 1, 5, "new", None)], LINKS)
    assert rows(R.origin_of_files(holes, links)) == [(1, "a", 1, 1, True), (1, "b", 2, 1, True), (2, "b", 1, 0, False)]
