"""Folders of spreadsheets of mixed forms: a layout for each file, corrections, what is wrong with one file alone."""

from terrakern.sources import batch as B

FILES = {
    "wide.csv": "공번,경도,위도,표고,토사,풍화토,연암,비고\nA,127.0,36.0,10,1.5,0.5,2,\nB,127.1,36.1,,0,,3,\nC,127.2,46.1,1,1,1,1,\n",
    "long.csv": "공번;상심도;하심도;지층명;경도;위도\nA;0;1;토사;127.0;36.0\nA;1;3;토사;127.0;36.0\nA;3;4;연암;127.0;36.0\nB;2;2;연암;127.0;36.5\nB;2;5;연암;127.0;36.5\n",
    "grid.csv": "제목\n공번,X,Y,토사,연암,비고\nG1,200000,600000,1,1,동부(60만)\nG2,201000,600000,2,0,\n",
    "odd.csv": "k,lon,lat,p,q\nQ1,127,36,1,2\n",
    "bad.xlsx": "not a workbook",
    "empty.csv": "\n\n",
}


def frames(spark, names=None):
    files = spark.createDataFrame([(n, t.encode()) for n, t in FILES.items()], "path string, content binary")
    return spark.createDataFrame([(n,) for n in names or [*FILES, "gone.csv"]], "path string"), files


def test_mixed_forms_in_one_job(spark):
    wanted, files = frames(spark)
    holes, strata, refused, reports = B.read_batch(wanted, files)
    got = {(r["path"], r["name"]): (r["longitude"], r["latitude"], r["elevation"], r["crs"]) for r in holes.collect()}
    assert set(got) == {("wide.csv", "A"), ("wide.csv", "B"), ("long.csv", "A"), ("long.csv", "B"), ("grid.csv", "G1"), ("grid.csv", "G2"), ("odd.csv", "ROW-1")}
    assert got["wide.csv", "B"] == (127.1, 36.1, None, None) and got["grid.csv", "G1"][3] == got["grid.csv", "G2"][3] == "EPSG:5187" and abs(got["grid.csv", "G1"][0] - 129) < 1e-6
    layers = sorted((r["path"], r["name"], r["depth_top"], r["depth_bottom"], r["soil_type"]) for r in strata.collect())
    assert layers == [
        ("grid.csv", "G1", 0.0, 1.0, "토사"), ("grid.csv", "G1", 1.0, 2.0, "연암"), ("grid.csv", "G2", 0.0, 2.0, "토사"), ("long.csv", "A", 0.0, 3.0, "토사"), ("long.csv", "A", 3.0, 4.0, "연암"), ("long.csv", "B", 2.0, 5.0, "연암"),
        ("wide.csv", "A", 0.0, 1.5, "토사"), ("wide.csv", "A", 1.5, 2.0, "풍화토"), ("wide.csv", "A", 2.0, 4.0, "연암"), ("wide.csv", "B", 0.0, 3.0, "연암"),
    ]
    assert [tuple(r) for r in refused.collect()] == [("wide.csv", 3, "C", "out_of_bounds")]
    told = {r["path"]: (r["status"], r["form"], r["boreholes"], r["strata"], r["refused"]) for r in reports.collect()}
    assert told == {
        "wide.csv": ("ok", "wide", 2, 4, 1), "long.csv": ("ok", "long", 2, 3, 0), "grid.csv": ("ok", "wide", 2, 3, 0), "odd.csv": ("failed", "ambiguous", 1, 0, 0),
        "bad.xlsx": ("failed", None, 0, 0, 0), "empty.csv": ("failed", None, 0, 0, 0), "gone.csv": ("skipped", None, 0, 0, 0),
    }
    soils = {r["path"]: r["soils"] for r in reports.collect()}
    assert soils["wide.csv"] == {"토사": 1, "풍화토": 1, "연암": 2} and soils["odd.csv"] is None


def test_roles_can_be_corrected(spark):
    wanted, files = frames(spark, ["odd.csv", "long.csv"])
    given = spark.createDataFrame([("odd.csv", "k", "name"), ("odd.csv", "p", "stratum"), ("odd.csv", "q", "stratum"), ("odd.csv", "none", "lon"), ("long.csv", "위도", "ignore")], "path string, header string, role string")
    holes, strata, refused, reports = B.read_batch(wanted, files, given)
    assert [(r["path"], r["name"]) for r in holes.collect()] == [("odd.csv", "Q1")]
    assert sorted((r["depth_top"], r["depth_bottom"]) for r in strata.collect()) in ([(0.0, 1.0), (1.0, 3.0)], [(0.0, 3.0)])
    assert {r["path"]: (r["status"], r["reason"]) for r in reports.collect()} == {"odd.csv": ("ok", None), "long.csv": ("failed", "nothing to store")}
    assert refused.count() == 5 and {r["reason"] for r in refused.collect()} == {"no_place"}


def test_too_many_rows_and_no_files(spark):
    wanted, files = frames(spark, ["gone.csv"])
    cells, errors = B.cells_and_errors(files, most_rows=4)
    assert {r["path"]: r["error"] for r in errors.collect()}["long.csv"] == "ValueError: more than 4 rows" and not cells.where("path = 'long.csv'").count()
    holes, strata, refused, reports = B.read_batch(wanted, files)
    assert not holes.count() and not strata.count() and not refused.count() and [r["status"] for r in reports.collect()] == ["skipped"]
