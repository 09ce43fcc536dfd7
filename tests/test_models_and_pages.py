"""Grids, readings of coordinates and pages, on cases worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from terrakern.functions import geodesy
from terrakern.operators import coordinates, documents, duplicates, modelling, mutations


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first()["c"]


def test_anchor_correction(spark):
    north, east = (one(spark, c) for c in geodesy.to_grid(F.lit(35.115), F.lit(129.043), "EPSG:5187"))
    wrong = geodesy.to_geographic(F.lit(north), F.lit(east), "EPSG:5186")
    rows = [(1, east, north, one(spark, wrong[1]), one(spark, wrong[0]), "EPSG:5186"), (2, east, north, 129.044, 35.116, "EPSG:5187"), (3, 1.0, 2.0, 100.0, 10.0, None)]
    df = spark.createDataFrame(rows, "id int, x double, y double, lon double, lat double, crs string")
    got = {r.id: r for r in coordinates.anchored(df, "x", "y", (129.043, 35.115)).collect()}
    assert (got[1].moved, got[1].crs) == (True, "EPSG:5187") and got[1].lon == pytest.approx(129.043, abs=1e-6)
    assert not got[2].moved and got[2].lon == 129.044 and not got[3].moved
    assert coordinates.box_centre((1, 2, 3, 4)) == (2, 3)


def test_fill_smooth_and_snap(spark):
    rows = [(1, j, i, float(i), float(j), None if (i, j) == (1, 1) else 4.0) for i in range(3) for j in range(3)]
    grid = spark.createDataFrame(rows, "project int, j int, i int, x double, y double, z double")
    assert {r.z for r in modelling.filled(grid).collect()} == {4.0}
    empty = grid.withColumn("z", F.lit(None).cast("double"))
    assert {r.z for r in modelling.filled(empty).collect()} == {0.0}
    flat = grid.na.fill(4.0, ["z"])
    assert {round(r.z, 9) for r in modelling.smoothed(flat).collect()} == {4.0}
    errors = spark.createDataFrame([(1, 0.0, 0.0, 2.0)], "project int, x double, y double, error double")
    moved = {(r.j, r.i): r.z for r in modelling.snapped(flat, errors, 1.5).collect()}
    assert moved[0, 0] == 6.0 and 4.0 < moved[0, 1] < 6.0 and moved[2, 2] == 4.0
    assert one(spark, modelling.clipped(F.lit(-31.0))) is None
    assert [one(spark, c) for c in modelling.clamped_boundaries(F.lit(5.0), [F.lit(6.0), F.lit(-9.0)], F.lit(0.0))] == [5.0, 0.0]
    shares = [one(spark, c) for c in modelling.extension_weights([F.lit(0.0)] * 3, [F.lit(1.0), F.lit(3.0), F.lit(0.0)])]
    assert shares == [0.25, 0.75, 0.0] and one(spark, modelling.extension_weights([F.lit(-1.0)] * 2, [F.lit(0.0)] * 2)[1]) == 1.0
    states = spark.createDataFrame([(1, "a", "present"), (2, "a", "not_reached"), (1, "b", "present"), (2, "b", "absent")], "id int, layer string, state string")
    assert {r.layer: r.continuous for r in modelling.continuous_layers(states).collect()} == {"a": True, "b": False}


def test_pages(spark):
    tree = {"type": "doc", "page number": 1, "kids": [{"type": "p", "content": "hello", "bounding box": [0, 0, 1, 1]}, {"type": "table", "page number": 2, "rows": [{"row number": 1, "cells": [{"column number": 3, "bounding box": [1, 1, 2, 2], "kids": [{"text": "a"}, {"text": "b"}]}]}]}]}
    got = documents.flattened(spark.createDataFrame([("d", json.dumps(tree)), ("e", "{}")], "doc string, json string")).orderBy("ord").collect()
    assert [(r.page, r.type, r.text, r.row, r.col) for r in got] == [(1, "p", "hello", None, None), (2, "", "a\nb", 1, 3)]
    raw = spark.createDataFrame([(1, '{"a": 1}'), (2, "{'b': None, 'c': 2.5}"), (3, "[1]"), (4, "boom("), (5, None)], "id long, raw string")
    assert {r.id: r["values"] for r in documents.literal_objects(raw, "raw", "id").collect()} == {1: {"a": "1"}, 2: {"b": None, "c": "2.5"}, 3: None, 4: None, 5: None}
    best = one(spark, documents.best_reading({"x": (F.lit(1.0), F.lit("a")), "y": (F.lit(2.0), F.lit("b")), "z": (F.lit(2.0), F.lit("c"))}))
    assert tuple(best) == ("y", "b")


def test_lost_decimal_points(spark):
    holes = {"a": [0.5, 12.0, 2.0, 35.0, 4.0], "b": [10.0, 20.0, 30.0], "c": [1.0, 125.0, 3.0], "d": [4.0]}
    rows = [(h, n, d) for h, some in holes.items() for n, d in enumerate(some)]
    got = {}
    for r in documents.repaired_depths(spark.createDataFrame(rows, "hole string, n int, d double"), ["hole"], "n", "d").orderBy("n").collect():
        got.setdefault(r.hole, []).append(r.d)
    assert got == {"a": [0.5, 1.2, 2.0, 3.5, 4.0], "b": [10.0, 20.0, 30.0], "c": [1.0, 2.5, 3.0], "d": [4.0]}
    new = lambda p, t, b, z=False: one(spark, documents.new_hole_by_depth(*[F.lit(x).cast("double") for x in (p, t, b)], F.lit(z)))
    assert [new(12, 0, 2), new(3, 0, 1), new(12, 5, 6), new(12, None, 11.5), new(12, None, None, True)] == [True, False, False, False, True]


def test_orders_with_cycles(spark):
    nodes = spark.createDataFrame([("a", 3), ("b", 2), ("c", 1), ("d", 0)], "name string, rank int")
    edges = spark.createDataFrame([("a", "b"), ("c", "d"), ("d", "c"), ("x", "a")], "upper string, lower string")
    assert [r.name for r in documents.topological(edges, nodes).orderBy("place").collect()] == ["a", "b", "d", "c"]
    many = spark.range(20000).selectExpr("concat('n', id) AS name", "id AS rank")
    chain = spark.range(19999).selectExpr("concat('n', id + 1) AS upper", "concat('n', id) AS lower")
    assert documents.topological(chain, many).where("place = 0").first().name == "n19999"


def test_deep_and_broken_trees(spark):
    tree = '{"content": "end", "page number": 1, "bounding box": [0, 0, 1, 1]}'
    for _ in range(400):
        tree = '{"kids": [' + tree + "]}"
    node = {"type": "leaf", "page number": 2, "bounding box": [0, 0, 2, 2], "content": " deep "}
    for _ in range(5000):
        node = {"kids": [node]}
    assert documents.elements_of(node) == [(2, "leaf", "deep", 0.0, 0.0, 2.0, 2.0, None, None)]
    some = spark.createDataFrame([("a", tree), ("b", "{"), ("c", None), ("d", "[1]")], "doc string, json string")
    assert [(r.doc, r.text, r.page) for r in documents.flattened(some).collect()] == [("a", "end", 1)]


def test_lost_points_with_known_depths(spark):
    rows = spark.createDataFrame([("h", 1, 12.0), ("h", 2, 25.0), ("h", 3, 31.0), ("k", 1, 12.0), ("k", 2, 2.0)], "hole string, n int, d double")
    known = spark.createDataFrame([("h", [1.2, 2.5, 3.1])], "hole string, depths array<double>")
    got = documents.repaired_depths(rows, ["hole"], "n", "d", known).orderBy("hole", "n").collect()
    assert [r.d for r in got] == [1.2, 2.5, 3.1, 1.2, 2.0]


def test_whole_documents(spark, tmp_path):
    from terrakern.sources import exports

    grid = spark.createDataFrame([("soil", j, i, 127.0 + i, 36.0 + j, 1.0) for j in range(2) for i in range(2)], "layer string, j int, i int, x double, y double, z double")
    lines = [r.line for r in exports.surface_document(grid, 2, ["soil"], "2026-01-01", "00:00:00").orderBy("group", "part", "number", "half").collect()]
    assert lines[0].startswith("<?xml") and lines[-1] == "</LandXML>" and lines.index('    <Surface name="토사">') == 10
    assert [x for x in lines if "<F>" in x] == ["          <F>1 2 4</F>", "          <F>1 4 3</F>"] and sum("<P id" in x for x in lines) == 4
    import xml.etree.ElementTree as tree

    assert tree.fromstring("\n".join(lines).encode()).tag.endswith("LandXML")
    for wrong in (grid.where("j + i < 2"), grid.withColumn("z", F.lit(float("nan")))):
        with pytest.raises(ValueError):
            exports.surface_document(wrong, 2, ["soil"], "", "")
    seen = spark.createDataFrame([("soil", 5, 127.0, 36.0, 2.0), ("soil", 4, 127.0, 36.0, 3.0)], "layer string, id long, x double, y double, z double")
    points = [r.line for r in exports.point_document(grid, seen, 2, ["soil"], "2026-01-01", "00:00:00").orderBy("group", "part", "number").collect()]
    assert sum("SOIL_OBS_000001" in x and "시추공 4" in x for x in points) == 1 and sum("_INTERPOLATED" in x for x in points) == 4
    assert tree.fromstring("\n".join(points).encode()) is not None
    holes = spark.createDataFrame([(1, "BH-1", 127.0, 36.0, 10.0)], "id long, name string, longitude double, latitude double, elevation double")
    strata = spark.createDataFrame([(1, 0.0, 2.0, "soil"), (1, 2.0, 400.0, "hard_rock")], "borehole_id long, depth_top double, depth_bottom double, strata_group string")
    drawn = "\n".join(r.line for r in exports.drawing_document(holes, strata).orderBy("group", "part", "number").collect()).split("\n")
    assert drawn[:4] == ["0", "SECTION", "2", "HEADER"] and drawn[-4:] == ["0", "ENDSEC", "0", "EOF"] and drawn.count("LINE") == 1 and drawn.count("TEXT") == 1


def test_listing_modes(spark):
    df = spark.createDataFrame([(1, 0.6, False, False, False, True), (2, 0.0, True, True, False, False), (3, 9.0, True, True, True, False)], "id int, gap double, w boolean, e boolean, v boolean, n boolean")
    ids = lambda m: [r.id for r in documents.table_mode(df, m, *[F.col(c) for c in ("gap", "w", "e", "v", "n")]).orderBy("id").collect()]
    assert [ids(m) for m in ("all", "existing", "new", "virtual", "warn", "edited")] == [[1, 2], [2], [1], [3], [1, 2], [2]]


def test_upload_matching(spark):
    schema = "key long, project int, source string, name_key string, survey_key string, elevation double, signature string"
    new = spark.createDataFrame([(1, 1, "f", "A", "s", 1.0, "x"), (2, 1, "g", "B", "s", 1.0, "y"), (3, 1, "g", "C", "s", 1.0, "z")], schema)
    old = spark.createDataFrame([(10, 1, "f", "A", "s", 9.0, "q"), (11, 1, "h", "B", "s", 1.04, "y"), (12, 1, "h", "C", "s", 1.2, "z")], schema)
    near = spark.createDataFrame([(1, 10), (1, 11)], "key long, other long")
    got = {r.key: (r.action, r.target) for r in mutations.matched_for_upload(new, old, near).collect()}
    assert got == {1: ("replace", 10), 2: ("link", 11), 3: ("insert", None)}


def test_links(spark):
    links = spark.createDataFrame([(1, 1, "existing"), (1, 2, "new"), (1, 3, "excluded"), (2, 1, "existing")], "project_id int, borehole_id int, project_role string")
    wanted = spark.createDataFrame([(1, 1, "new"), (1, 2, "existing"), (1, 3, "new"), (1, 4, "existing")], "project_id int, borehole_id int, project_role string")
    assert {(r.project_id, r.borehole_id): r.project_role for r in mutations.linked(links, wanted).collect()} == {(1, 1): "new", (1, 2): "new", (1, 3): "excluded", (1, 4): "existing", (2, 1): "existing"}
    named = wanted.where("borehole_id IN (3, 4)")
    assert {(r.project_id, r.borehole_id): r.project_role for r in mutations.synchronised(links, named).collect()} == {(1, 1): "existing", (1, 2): "new", (1, 3): "existing", (1, 4): "existing", (2, 1): "existing"}
    placed = mutations.by_listed_order(spark.createDataFrame([(5,), (7,), (9,)], "id int"), "id", F.array(F.lit(7), F.lit(5), F.lit(7)))
    assert {r.id: r.place for r in placed.collect()} == {5: 1, 7: 2, 9: 0}


def test_signatures(spark):
    strata = spark.createDataFrame([(1, 0.0, 1.00001, "a"), (1, 1.0, 2.0, "b"), (2, 1.0, 2.0, "b"), (2, 0.0, 1.0, "a"), (3, 0.0, 1.1, "a")], "borehole_id long, depth_top double, depth_bottom double, soil_type string")
    got = {r.borehole_id: r.signature for r in duplicates.signature(strata, 4).collect()}
    assert got[1] == got[2] != got[3]


def test_polygon_states(spark, tmp_path):
    from terrakern.sources import tables

    (tmp_path / "good.json").write_text('{"features": []}')
    (tmp_path / "bad.json").write_text("{")
    read = lambda name: spark.read.text(str(tmp_path / name), wholetext=True)
    assert [tables.polygon_status(False, read("bad.json")), tables.polygon_status(True, read("bad.json")), tables.polygon_status(True, read("good.json")), tables.polygon_status(True, read("good.json").limit(0))] == ["not_configured", "invalid", "ok", "missing"]
    rings = spark.createDataFrame([(1, [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0]]), (2, [[9.0, 9.0], [10.0, 9.0], [10.0, 10.0]]), (3, [[-1.0, 2.0], [2.0, 5.0], [5.0, 2.0], [2.0, -1.0]])], "feature int, points array<array<double>>")
    got = {r.feature: r.area for r in tables.clipped_rings(rings, (0, 0, 3, 2)).collect()}
    assert set(got) == {1, 3} and got[1] == 6.0 and got[3] == 5.5


def test_workbook_order_and_quotes():
    import io
    import zipfile

    from terrakern.sources import tables

    sheet = lambda v: f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c t="inlineStr"><is><t>{v}</t></is></c></row></sheetData></worksheet>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet("second"))
        z.writestr("xl/worksheets/sheet2.xml", sheet("first"))
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://x/r"><sheets><sheet name="b" r:id="r2"/><sheet name="a" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://x/p"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
    assert list(tables.xlsx_rows(data.getvalue())) == [["first"]]
    assert list(tables.csv_rows(b'"a;b;c;d",1\n"e;f;g;h",2\n')) == [["a;b;c;d", "1"], ["e;f;g;h", "2"]]


def test_presence_edges(spark):
    from terrakern.operators import presence

    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 500.0, 0.0)], "key long, x double, y double")
    none = spark.createDataFrame([], "key long, x double, y double, thickness double, absent boolean")
    assert {r.key: r.signed for r in presence.presence_field(nodes, none, 50.0, 5.0).collect()} == {1: 1.0, 2: 1.0}
    some = spark.createDataFrame([(1, 0.0, 0.0, 2.0, False), (2, 500.0, 0.0, 0.0, True)], none.schema)
    assert {r.key: r.signed for r in presence.presence_field(nodes, some, 50.0, 5.0).collect()} == {1: 1.0, 2: -1.0}
    flat = spark.createDataFrame([(1, j, i, 1.0, False) for j in range(3) for i in range(3)], "project int, j int, i int, signed double, sure boolean")
    assert {r.kind for r in presence.filled_holes(flat, 3).collect()} == {"kept"}
