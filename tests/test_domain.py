"""Small cases worked out by hand."""


import math
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrakern.functions import geodesy, groundwater, names, parse
from terrakern.operators import intervals, overlay, selection, spatial, surfaces
from terrakern.plans import registry
from terrakern.sources import exports, tables

WIDE = "공번,X,Y,표고(m),수위(GL.-m),수위(EL.m),매립층,퇴적층,풍화토,풍화암,연암,경암,시추심도\nBH-1,203057.478,280763.68,122.4,7.2,115.2,0.6,-,21.4,5.2,13.1,-,40.3\nBH-2,203100.0,280800.0,120.0,N/A,,1.0,2.0,-,-,4.5,-,7.5\n"
LONG = "시추공명,경도,위도,표고,상심도,하심도,지층명\nDH-1,127.1,37.5,50,0,2.5,매립토\nDH-1,127.1,37.5,50,2.5,6,퇴적토\nDH-1,127.1,37.5,50,6,9,풍화암\nSHORT,127.1\nBAD,999,37.5,1,3,2,토사\n"


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first()["c"]


def test_soil_names(spark):
    cases = {
        "매립층": ("매립토", "soil", "매립토"), "점토질모래층": ("점토질모래", "soil", "점토질모래"), " sm ": ("모래", "soil", "모래"),
        "풍화암(상부)": (None, "weathered_rock", "풍화암"), "화강암": (None, "hard_rock", "경암"), "soft_rock": (None, "soft_rock", "연암"),
        None: (None, "unknown", "미분류"), "": (None, "unknown", "미분류"), "콘크리트": (None, "unknown", "콘크리트"),
    }
    df = spark.createDataFrame([(k,) for k in cases], "raw string")
    for r in df.select("raw", names.soil_detail(F.col("raw")).alias("d"), names.strata_group(F.col("raw")).alias("g"), names.display_name(F.col("raw")).alias("s")).collect():
        assert (r.d, r.g, r.s) == cases[r.raw]


def test_names_and_paths(spark):
    assert one(spark, names.duplicate_key(F.lit("bh-01 가"))) == "BH01"
    assert one(spark, names.same_survey(F.lit("A  b"), F.lit("a B"))) is True
    assert one(spark, names.same_survey(F.lit(""), F.lit("x"), allow_missing=True)) is True
    assert one(spark, names.source_path(F.lit("C:\\Data\\in\\a.pdf"), "c:\\data", "/mnt")) == "/mnt/in/a.pdf"
    keys = {n: one(spark, names.natural_key(F.lit(n))) for n in ("BH-2", "BH-10", "BH-1")}
    assert sorted(keys, key=keys.get) == ["BH-1", "BH-2", "BH-10"]


def test_numbers(spark):
    for text, want in {"1,234.5": 1234.5, "-": None, "—": None, "N/A": None, "": None, "inf": None, "NaN": None, " 7 ": 7.0, "x": None}.items():
        assert one(spark, parse.number(F.lit(text))) == want
    assert one(spark, parse.last_depth(F.lit("0.0 ~ 2.5m"))) == 2.5
    assert one(spark, parse.tm_scale(F.lit(2040401.48))[0]) == pytest.approx(204040.148)
    assert one(spark, parse.tm_scale(F.lit(204040.1))[1]) is False


def test_coordinate_systems(spark):
    cases = [("동부(60만,20만)", None, "EPSG:5187"), ("중부 60만", None, "EPSG:5186"), ("동부 50만", "2015", "EPSG:5183"), ("동부 50만", "1992", "EPSG:5176"), ("동부 50만", None, "EPSG:5183"), ("중부 50만 지적", None, "EPSG:5174"), ("서부 60만", None, None), ("동부", None, None), ("경위도", None, "EPSG:4326"), ("EPSG:5187", None, "EPSG:5187"), ("2016년 조사", None, None)]
    for text, year, want in cases:
        assert one(spark, parse.crs_hint(F.lit(text), F.lit(year).cast("string"))) == want, text
    for north, east, crs, lon, lat in [(280763.68, 203057.478, "EPSG:5187", 129.033543, 35.1232024), (179625.3, 204075.3, "EPSG:5183", 129.04470366, 35.11293782)]:
        got = geodesy.grid_to_wgs84(F.lit(north), F.lit(east), F.lit(crs))
        assert one(spark, got[0]) == pytest.approx(lat, abs=1e-5) and one(spark, got[1]) == pytest.approx(lon, abs=1e-5)
    north, east = geodesy.to_grid(F.lit(36.5), F.lit(128.25), "EPSG:5186")
    back = geodesy.to_geographic(F.lit(one(spark, north)), F.lit(one(spark, east)), "EPSG:5186")
    assert one(spark, back[0]) == pytest.approx(36.5, abs=1e-8) and one(spark, back[1]) == pytest.approx(128.25, abs=1e-8)
    lat, lon = geodesy.shift_datum(F.lit(35.0), F.lit(129.0))
    assert abs(one(spark, lat) - 35.0) < 0.01 and abs(one(spark, lon) - 129.0) < 0.01
    assert one(spark, geodesy.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) == pytest.approx(math.pi / 180 * 6371)


def test_groundwater(spark):
    level = lambda e, d, h: tuple(one(spark, groundwater.normalized(*[F.lit(x).cast("double") for x in (e, d, h)])))
    assert level(100, 4.3, None) == (4.3, pytest.approx(95.7), False)
    assert level(100, -4.3, None)[0] == 4.3
    assert level(100, 4.3, 90.0)[2] is True
    assert level(100, None, 103.0) == (None, 103.0, True)
    assert level(None, 4.3, None) == (4.3, None, False)
    for text, want in {"{'지하수위': 'GL(-) 3.25'}": 3.25, "{'water_level_gl': 7.2, 'x': 1}": 7.2, "지하수위: N/A": None, "": None, "water-level = 4.8": 4.8}.items():
        assert one(spark, groundwater.depth_in_text(F.lit(text))) == want, text
    both = one(spark, groundwater.by_datum(F.lit("EL"), F.lit(10.0), F.lit(1.0), F.lit(7.0)))
    assert tuple(both) == (3.0, 7.0)


def hole_row(i, **more):
    base = {"id": i, "project_id": 1, "elevation": 10.0, "is_supplementary": False, "groundwater_depth_bgl_m": None, "groundwater_head_elevation_m": None, "groundwater_reference_datum": None, "deleted_at": None}
    return {**base, **more}


HOLE = "id long, project_id long, elevation double, is_supplementary boolean, groundwater_depth_bgl_m double, groundwater_head_elevation_m double, groundwater_reference_datum string, deleted_at timestamp"


def test_layers_of_the_effective_view(spark):
    holes = spark.createDataFrame([hole_row(1), hole_row(2, groundwater_depth_bgl_m=2.0), hole_row(3), hole_row(4, is_supplementary=True), hole_row(5, deleted_at=None, project_id=2)], HOLE)
    revisions = spark.createDataFrame(
        [(1, 1, '{"elevation": 103.6}', None), (1, 2, '{"elevation": 3.6, "groundwater_depth_bgl_m": 2.9}', None), (2, 1, '{"groundwater_depth_bgl_m": null}', None), (3, 1, '{"elevation": null}', None)],
        "borehole_id long, version int, payload string, deleted_at timestamp",
    )
    overrides = spark.createDataFrame([(1, 1, "draft", '{"elevation": null}', None), (1, 3, "rejected", '{"elevation": 5}', None)], "project_id long, source_borehole_id long, status string, data string, deleted_at timestamp")
    links = spark.createDataFrame([(1, 1, "existing", None), (1, 2, "new", None), (1, 3, "excluded", None)], "project_id long, borehole_id long, project_role string, deleted_at timestamp")
    got = {(r.project_id, r.id): r for r in overlay.effective(holes, revisions, overrides, links, {"elevation": "double"}).collect()}
    assert set(got) == {(1, 1), (1, 2), (1, 4), (2, 5)}
    first = got[1, 1]
    assert (first.elevation, first.groundwater_depth_bgl_m, first.revision_version, first.data_status) == (None, 2.9, 2, "existing")
    assert first.groundwater_head_elevation_m == pytest.approx(0.7)
    assert (got[1, 2].groundwater_depth_bgl_m, got[1, 2].groundwater_head_elevation_m, got[1, 2].is_supplementary) == (None, None, True)
    assert got[1, 4].data_status == "supplementary" and got[2, 5].data_status == "original"


def test_intervals(spark):
    rows = spark.createDataFrame([("a", 0.0, 2.0, "x"), ("a", 1.0, 1.5, "x"), ("a", 2.5, 4.0, "y")], "hole string, depth_top double, depth_bottom double, name string")
    got = [(r.depth_top, round(r.depth_bottom, 6)) for r in intervals.continuous(rows, ["hole"], "name").orderBy("place").collect()]
    assert got == [(0.0, 2.0), (2.0, 2.1), (2.5, 4.0)]
    flat = spark.createDataFrame([("v", 0.0, 5.0), ("v", 5.0, 12.0), ("w", 0.0, 5.0), ("w", 6.0, 12.0)], "hole string, depth_top double, depth_bottom double")
    assert {r.hole: (r.contiguous, r.total_depth) for r in intervals.contiguity(flat, ["hole"], ["depth_top"]).collect()} == {"v": (True, 12.0), "w": (False, 12.0)}
    thick = spark.createDataFrame([("h", n, t) for n, t in enumerate([0.6, None, 21.4, -1.0, 5.2])], "hole string, n int, t double")
    assert [(r.depth_top, r.depth_bottom) for r in intervals.stacked(thick, ["hole"], ["n"], "t").orderBy("n").collect()] == [(0.0, 0.6), (0.6, 22.0), (22.0, 27.2)]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("sheets")
    (path / "wide.csv").write_text(WIDE, encoding="utf-8-sig")
    (path / "long.csv").write_bytes(LONG.replace(",", ";").encode("cp949"))
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>top</t></is></c></row><row/><row><c r="A3"><v>1.5</v></c></row></sheetData></worksheet>'
    shared = '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>공번</t></si></sst>'
    with zipfile.ZipFile(path / "book.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/sharedStrings.xml", shared)
    return path


def test_spreadsheets(spark, folder):
    cells = tables.read_cells(spark, str(folder)).cache()
    by_file = {n: [r.cells for r in cells.where(F.col("path").endswith(n)).orderBy("row_no").collect()] for n in ("wide.csv", "long.csv", "book.xlsx")}
    assert by_file["book.xlsx"] == [["공번", "", "top"], ["1.5"]]
    wide, long = tables.infer(by_file["wide.csv"], crs="EPSG:5187"), tables.infer(by_file["long.csv"])
    assert (wide.form, wide.roles["name"], wide.layers, wide.confidence) == ("wide", 0, [6, 7, 8, 9, 10, 11], 1.0)
    assert (long.form, set(long.roles)) == ("long", {"name", "lon", "lat", "elevation", "depth_top", "depth_bottom", "soil_type"})

    holes = tables.holes_of(cells.where(F.col("path").endswith("wide.csv")), wide, "EPSG:5187")
    rows = {r.name: r for r in holes.collect()}
    assert set(rows) == {"BH-1", "BH-2"}
    assert (rows["BH-1"].water_level_gl, rows["BH-1"].water_level_el, rows["BH-2"].water_level_gl) == (7.2, 115.2, None)
    assert rows["BH-1"].longitude == pytest.approx(129.033543, abs=1e-5) and rows["BH-1"].latitude == pytest.approx(35.1232024, abs=1e-5)
    strata = [(r.soil_type, r.depth_top, r.depth_bottom) for r in tables.wide_strata(holes, wide).where("name = 'BH-1'").orderBy("depth_top").collect()]
    assert strata == [("매립토", 0.0, 0.6), ("풍화토", 0.6, 22.0), ("풍화암", 22.0, 27.2), ("연암", 27.2, 40.3)]

    holes = tables.holes_of(cells.where(F.col("path").endswith("long.csv")), long)
    got = [(r.name, r.soil_type, r.depth_top, r.depth_bottom) for r in tables.long_strata(holes, long).orderBy("depth_top").collect()]
    assert got == [("DH-1", "매립토", 0.0, 2.5), ("DH-1", "퇴적토", 2.5, 6.0), ("DH-1", "풍화암", 6.0, 9.0)]
    inside, outside = tables.quarantined(holes)
    assert inside.count() == 3 and outside.count() == 2


def test_remarks_carried_down(spark):
    rows = [["공번", "X", "Y", "매립층", "풍화암", "비고"], ["A", "203057.478", "280763.68", "1", "2", "동부(60만,20만)"], ["B", "203057.478", "280763.68", "1", "2", ""], ["C", "203057.478", "280763.68", "1", "2", "중부 60만"], ["D", "203057.478", "280763.68", "1", "2", ""]]
    cells = spark.createDataFrame([("p", n, r) for n, r in enumerate(rows)], tables.CELLS)
    got = tables.holes_of(cells, tables.infer(rows)).orderBy("row_no").collect()
    assert [r.crs for r in got] == ["EPSG:5187", "EPSG:5187", "EPSG:5186", "EPSG:5186"]


def test_polygon_and_section(spark):
    square, hole = ((0, 0), (4, 0), (4, 4), (0, 4)), ((1, 1), (2, 1), (2, 2), (1, 2))
    for x, y, want in [(3, 3, True), (1.5, 1.5, False), (0, 2, False), (4, 4, False), (5, 1, False), (2, 1.5, False)]:
        assert one(spark, spatial.in_polygon(F.lit(float(x)), F.lit(float(y)), [square, hole])) is want
    assert one(spark, spatial.in_polygon(F.lit(0.0), F.lit(2.0), [square], edge=True)) is True
    got = one(spark, spatial.onto_section(F.lit(4.0), F.lit(1.5), (0.0, 0.0), (10.0, 0.0), 2.0))
    assert (got.chainage, got.distance) == (4.0, 1.5)
    assert one(spark, spatial.onto_section(F.lit(4.0), F.lit(2.5), (0.0, 0.0), (10.0, 0.0), 2.0)) is None
    tiles = spatial.box_tiles(spark.createDataFrame([(1, 129.0, 35.0, 129.05, 35.04)], "key int, x0 double, y0 double, x1 double, y1 double")).orderBy("row", "column").collect()
    assert (tiles[0].x0, tiles[0].y0) == (129.0, 35.0) and (tiles[-1].x1, tiles[-1].y1) == (129.05, 35.04)
    assert all((t.x1 - t.x0) * (t.y1 - t.y0) * 91 * 110.54 < 1.95 for t in tiles)
    few = spark.createDataFrame([(1, 0.0, 0.0), (2, 500.0, 0.0)], "key long, x double, y double")
    far = spark.createDataFrame([(7, 900.0, 0.0), (8, 1.0, 0.0), (9, 20000.0, 5.0)], "key long, x double, y double")
    assert sorted((r.key, r.other, r.place) for r in spatial.nearest(few, far, 2).collect()) == [(1, 7, 2), (1, 8, 1), (2, 7, 1), (2, 8, 2)]
    assert spatial.nearest(few, far, 5).count() == 6 and spatial.nearest(few, far.limit(0), 2).count() == 0
    poles = spark.createDataFrame([(1, 179.9999, 0.0), (2, -179.9999, 0.0), (3, 0.0, 89.9999), (4, 180.0, 89.9999), (5, 10.0, 10.0)], "key long, lon double, lat double")
    assert sorted((r.key, r.other) for r in spatial.within_metres(poles, poles, 30.0).where("key < other").collect()) == [(1, 2), (3, 4)]


def test_labels_and_values(spark):
    labels = spark.createDataFrame([(1, "level", 10.0, 100.0, 60.0, 112.0)], "page int, key string, x0 double, y0 double, x1 double, y1 double")
    values = spark.createDataFrame([(1, "4.3", 80.0, 101.0, 95.0, 112.0), (1, "9.9", 70.0, 112.0, 90.0, 124.0), (1, "7", 300.0, 100.0, 310.0, 112.0)], labels.schema)
    assert spatial.value_right_of(labels, values, "page").collect()[0].value == "4.3"
    assert [(r.key, r.box) for r in spatial.overlapping_boxes(values, labels.withColumns({"x1": F.lit(90.0)}), "page").collect()] == [("4.3", "level")]


def test_greedy_merge(spark):
    rows = [(1, 0, 10, 0.0, 0.0, 5.0, 1), (1, 1, 11, 1.5, 0.0, 7.0, 3), (1, 2, 12, 3.0, 0.0, 9.0, 9), (1, 3, 13, 50.0, 0.0, 1.0, 1), (2, 0, 14, 1.0, 0.0, 1.0, 1)]
    got = spatial.merge_near(spark.createDataFrame(rows, "project int, ord int, id long, x double, y double, elevation double, n_strata int"), 2.0)
    assert sorted((r.project, r.id, r.x, r.elevation, r.merged) for r in got.collect()) == [(1, 11, 0.75, 6.0, 2), (1, 12, 3.0, 9.0, 1), (1, 13, 50.0, 1.0, 1), (2, 14, 1.0, 1.0, 1)]


def test_surfaces_meet_their_anchors(spark):
    places = [(127.00123, 37.50117, 101.25), (127.00491, 37.50283, 97.8), (127.00307, 37.50649, 104.125), (127.00813, 37.50431, 99.45)]
    anchors = spark.createDataFrame([(1, "soil", *p) for p in places], "project long, layer string, x double, y double, z double")
    nodes = spark.createDataFrame([(1, n, 0, x, y) for n, (x, y, _) in enumerate(places)] + [(1, 9, 9, 127.004, 37.503)], "project long, j int, i int, x double, y double")
    for surface in (surfaces.distance_weighted(nodes, anchors), surfaces.thin_plate(nodes, anchors)):
        got = {r.j: r.z for r in surface.collect()}
        for n, (_, _, z) in enumerate(places):
            assert got[n] == pytest.approx(z, abs=1e-6)
        assert 90 < got[9] < 110
    twice = anchors.unionByName(anchors.limit(1)).unionByName(spark.createDataFrame([(1, "soil", 127.00491, 37.50283, 98.0)], anchors.schema))
    settled, apart = surfaces.settled_anchors(twice)
    assert settled.count() == 3 and apart.count() == 1


def test_large_surfaces_in_patches(spark):
    """A project with more anchors than a patch: every anchor is met, no node is lost, and no solve has more than a patch's."""
    rng = np.random.default_rng(4)
    field = lambda x, y: 50 + 10 * np.sin(x / 30) + 8 * np.cos(y / 25) + x / 20
    places = np.unique(np.concatenate([rng.uniform(0, 100, (220, 2)), 70 + rng.uniform(0, 2, (180, 2)), [[150.0, 10.0], [152.0, 95.0]]]).round(3), axis=0)
    rows = [(1, "soil", float(x), float(y), float(field(x, y))) for x, y in places]
    rows += [(p, layer, float(x), float(y), float(field(x, y))) for p, layer in ((1, "soft_rock"), (2, "soil")) for x, y in places[:20]]
    anchors = spark.createDataFrame(rows, "project long, layer string, x double, y double, z double")
    at = [(1, n, 0, float(x), float(y)) for n, (x, y) in enumerate(places)] + [(p, j, i, i * 8.0, j * 8.0) for p in (1, 2) for j in range(1000, 1013) for i in range(1, 20)]
    at = [(p, j, i, x, y - 8000 if j >= 1000 else y) for p, j, i, x, y in at]
    nodes = spark.createDataFrame(at, "project long, j int, i int, x double, y double")
    whole = {(r.project, r.layer, r.j, r.i): r for r in surfaces.thin_plate(nodes, anchors).collect()}
    got = {(r.project, r.layer, r.j, r.i): r for r in surfaces.thin_plate(nodes, anchors, patch=40).collect()}
    assert got.keys() == whole.keys() and len(got) == 2 * (len(places) + 13 * 19) + 13 * 19
    for key, r in got.items():
        if key[:2] != (1, "soil"):
            assert r.z == pytest.approx(whole[key].z, abs=1e-9)
        elif key[2] < 1000:
            assert r.z == pytest.approx(field(r.x, r.y), abs=1e-6)
        elif r.x <= 96 and r.y <= 96:
            assert r.z == pytest.approx(whole[key].z, abs=3)
    unit = anchors.where("project = 1 AND layer = 'soil'").selectExpr("project", "layer", "x / 153 AS u", "y / 153 AS v")
    leaves, levels = surfaces._leaves(unit, unit.select("project", "layer").distinct(), 40)
    assert max(r.n for r in leaves.collect()) <= 40 and len(levels) > 3
    assert sum(0.25**r.level for r in leaves.collect()) == 1


def test_weighted_grid_takes_all_points(spark, tmp_path):
    """Nodes at a point's place have its value; points of any key count."""
    spark.createDataFrame([(7, 3, 5.0), (1009 * 997, 3, 2.0), (11, 4, 9.0)], "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(3, "A"), (4, "B"), (5, "C")], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    got = {(r.project, r.j, r.i): r.z for r in registry.QUERIES["weighted_grid"](spark, str(tmp_path)).collect()}
    assert len(got) == 50 and got[3, 0, 0] == 2.0 and 2.0 < got[3, 1, 1] < 5.0 and got[4, 2, 2] == 9.0


def test_every_hole_has_contacts(spark):
    holes = {r[0] for r in spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_orderkey").distinct().collect()}
    rows = registry.QUERIES["layer_contacts"](spark, "/root/testdata/sf0.001").collect()
    assert {r.id for r in rows} == holes and len(rows) == 5 * len(holes)


def test_layer_order_and_voxels(spark):
    rows = [(1, 0, 0, layer, z) for layer, z in (("ground", 10.0), ("soil", 8.0), ("weathered_rock", 9.0), ("soft_rock", 3.0))]
    got = surfaces.held_below(spark.createDataFrame(rows, "project int, j int, i int, layer string, z double")).collect()
    assert {r.layer: r.z for r in got} == {"ground": 10.0, "soil": 8.0, "weathered_rock": 8.0, "soft_rock": 3.0}
    assert [one(spark, b) for b in surfaces.stacked_boundaries(F.lit(10.0), [F.lit(3.0), F.lit(4.0), F.lit(9.0)], F.lit(1.0))] == [7.0, 3.0, 1.0]
    assert [one(spark, surfaces.presence_weight(F.lit(t))) for t in (-1.0, 0.25, 0.5, 0.75, 2.0)] == [0, 0.15625, 0.5, 0.84375, 1]
    radii = one(spark, surfaces.absence_radii(F.lit(39.6), F.lit(80.0), F.lit(3.6)))
    assert (radii.core, radii.transition) == (pytest.approx(11.88), pytest.approx(19.8))
    places = np.array([[0, 0], [2, 0], [1, 1], [2, 2], [0, 2], [1, 0]], float)
    assert sorted(map(tuple, places[surfaces._corners(*places.T)].tolist())) == [(0, 0), (0, 2), (2, 0), (2, 2)]
    holes = spark.createDataFrame([(p, n, float(x), float(y)) for p, some in ((1, places), (2, [[0, 0], [4, 0]]), (3, [[7, 7]])) for n, (x, y) in enumerate(some)], "project int, id long, x double, y double")
    for block in (2, 4096):
        around = {(r.project, r.id): r for r in surfaces.phantoms(holes, 1.5, 4, block).collect()}
        assert (around[1, -100].x, around[1, -100].y) == (pytest.approx(1.0 - 1.5), pytest.approx(5 / 6)) and len(around) == 12
        assert (around[2, -102].x, around[2, -102].copies) == (pytest.approx(5.0), 1) and around[3, -100].copies == 0


def test_upper_median_in_cells(spark):
    from terrakern.operators.aggregates import upper_median_of_all

    rng = np.random.default_rng(3)
    for values in (rng.normal(size=999), rng.normal(size=1000), np.repeat([1.0, 2.0, 5.0], [400, 3, 397]), np.array([4.0]), np.exp(rng.normal(size=800) * 6)):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
        assert upper_median_of_all(df, "v", small=10, cells=8) == sorted(values.tolist())[len(values) // 2]
    assert upper_median_of_all(spark.createDataFrame([(None,)], "v double"), "v") is None


def test_exports(spark, tmp_path):
    grid = spark.createDataFrame([("soil", j, i, 127.0 + i, 37.0 + j, 10.0 + 2 * j + i) for j in range(2) for i in range(2)], "layer string, j int, i int, x double, y double, z double")
    points, faces = exports.tin(grid, 2)
    assert [r.line for r in faces.orderBy("face_no").collect()] == ["<F>1 2 4</F>", "<F>1 4 3</F>"]
    first = points.orderBy("point").first().line
    assert first.startswith('<P id="1">') and first.endswith(" 200000.000 10.0000</P>")
    contacts = spark.createDataFrame([("soil", n, 127.5, 37.5, 17.0) for n in (2, 1)], "layer string, id long, x double, y double, z double")
    seen = exports.observed_points(contacts).collect()
    assert len(seen) == 1 and seen[0].id == 1 and seen[0].line.endswith(" 17.0000")
    holes = spark.createDataFrame([(1, "BH-1", 127.0, 37.0, 20.0)], "id long, name string, longitude double, latitude double, elevation double")
    strata = spark.createDataFrame([(1, 0.0, 3.0, "soil"), (1, 3.0, 301.0, "soft_rock")], "borehole_id long, depth_top double, depth_bottom double, strata_group string")
    drawn = [r.entity.split("\n")[1] for r in exports.drawing(holes, strata).orderBy("part").collect()]
    assert drawn == ["LINE", "TEXT"]
    exports.write_lines(points, ["layer", "point"], str(tmp_path / "tin"))
    assert spark.read.text(str(tmp_path / "tin")).count() == 4
    exports.snapshot(holes, str(tmp_path / "snapshot"))
    back = exports.restored(spark.read.json(str(tmp_path / "snapshot")).drop("longitude", "latitude")).first()
    assert (back.longitude, back.latitude) == (127.0, 37.0)


def test_nested_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"projects": [{"name": "P", "boreholes": [{"name": "B", "longitude": 1, "latitude": 2, "elevation": 3, "strata": [{"depth_top": 0, "depth_bottom": 1, "soil_type": "연암"}]}]}]}')
    holes, strata = tables.read_nested(spark, str(tmp_path / "a.json"))
    assert holes.first().name == "B" and strata.first().strata_group == "soft_rock"
    (tmp_path / "b.geojson").write_text('{"features": [{"geometry": {"type": "Polygon", "coordinates": [[[0,0],[1,0],[1,1]], [[0.1,0.1],[0.2,0.1],[0.2,0.2]]]}}, {"geometry": {"type": "MultiPolygon", "coordinates": [[[[5,5],[6,5],[6,6]]]]}}]}')
    rings = tables.read_rings(spark, str(tmp_path / "b.geojson")).collect()
    assert sorted((r.feature, r.ring, len(r.points)) for r in rings) == [(0, 0, 3), (0, 1, 3), (1, 0, 3)]


def test_selection(spark):
    rows = spark.createDataFrame([(1, "Ab", 1.0), (2, "cd", float("nan")), (3, None, None)], "id long, name string, v double")
    assert selection.keyword(rows, "aB", ["name"]).count() == 1
    sound, other = selection.finite_rows(rows, ["v"])
    assert (sound.count(), other.count()) == (1, 2)
    assert selection.selected(rows, "id", None).count() == 3 and selection.selected(rows, "id", rows.limit(0)).count() == 0
    assert selection.by_ids(rows, "id", []).count() == 3
    with pytest.raises(ValueError):
        selection.in_box(rows, "v", "v", (1, 0, 0, 1))


def test_stream_of_observations(spark, small):
    from terrakern.streaming import observations

    schema = spark.read.parquet(f"{small}/events.parquet").schema
    stream = observations.arriving(spark, small, schema, "ts", pattern="events.parquet")
    counts = observations.latest(stream, "user_id", "event_id", "event_type").writeStream.outputMode("complete").format("memory").queryName("newest").start()
    try:
        counts.processAllAvailable()
        want = spark.read.parquet(f"{small}/events.parquet").groupBy("user_id").agg(F.max("event_id").alias("event_id"))
        assert spark.table("newest").select("user_id", "event_id").exceptAll(want).count() == 0 and spark.table("newest").count() == want.count()
    finally:
        counts.stop()


def test_readings_of_every_key(spark, tmp_path):
    keys = [1, 499, 500, 501, 15_000, 7_000_000_003]
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    got = {tuple(r) for r in registry.QUERIES["readings_of_coordinates"](spark, str(tmp_path)).select("c_custkey", "crs", "reading").collect()}
    assert got == {(k, "EPSG:5186" if k % 2 else "EPSG:5187", "xy" if k % 3 else "yx") for k in keys}


def test_nearest_of_far_and_crowded_points(spark):
    draw = random.Random(7)
    right = [(k, draw.gauss(0, 1) * draw.choice([0.01, 1, 50]), draw.gauss(0, 1)) for k in range(300)] + [(k, 3.0, 3.0) for k in range(300, 330)]
    left = [(-k, draw.uniform(-60, 60), draw.uniform(-5, 5)) for k in range(1, 60)] + [(-100, 1e9, -1e9), (-101, 3.0, 3.0), (-102, 0.0, None)]
    schema = "key long, x double, y double"
    for k in (1, 4, 400):
        got = {}
        for r in spatial.nearest(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), k, 0.5).collect():
            got.setdefault(r["key"], {})[r["place"]] = r["other"]
        for key, x, y in left:
            want = sorted((math.sqrt((x - a) ** 2 + (y - b) ** 2), o) for o, a, b in right)[:k] if y is not None else []
            assert [o for _, o in sorted(got.get(key, {}).items())] == [o for _, o in want]
