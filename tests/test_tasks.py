"""Work that follows the rows: tasks get more with the table, not larger."""

import io
import math
import tracemalloc
import zipfile

from terrakern.operators import materialise
from terrakern.operators import spatial as P
from terrakern.operators import surfaces as U
from terrakern.plans import registry  # noqa: F401  (it loads the others in their order)
from terrakern.plans import further
from terrakern.plans import standins as T
from terrakern.sources import tables as SRC


def test_strata_are_dealt_by_rows(spark, small, monkeypatch):
    monkeypatch.setattr(materialise, "ROWS", 100)
    rows = T.table(spark, small, "lineitem").count()
    strata = T.strata(spark, small)
    assert strata.rdd.getNumPartitions() == math.ceil(rows / 100)
    assert strata.count() == rows


def _recorded(monkeypatch, module):
    seen = []

    def dealt(df, *keys, rows=None):
        seen.append((keys, rows))
        return materialise.dealt(df, *keys, rows=rows)

    monkeypatch.setattr(module, "dealt", dealt)
    return seen


def test_phantoms_deal_holes_by_rows(spark, small, monkeypatch):
    seen = _recorded(monkeypatch, U)
    points = U.phantoms(T.points(spark, small).withColumnRenamed("key", "id"), count=4)
    assert points.groupBy("project").count().where("count <> 4").isEmpty()
    assert (("project", "_block"), None) in seen and (("id",), materialise.ROWS // 4) in seen


def test_merging_deals_holes_by_rows(spark, monkeypatch):
    seen = _recorded(monkeypatch, P)
    holes = spark.createDataFrame([(1, n, n, float(n // 2 * 10), 0.0, 1.0, 1) for n in range(8)], "project long, ord long, id long, x double, y double, elevation double, n_strata long")
    assert sorted(r["merged"] for r in P.merge_near(holes, 2.0).collect()) == [2, 2, 2, 2]
    assert {keys for keys, _ in seen} >= {("id",), ("cluster",), ("_c",)}


def test_a_workbook_is_read_row_by_row():
    rows = "".join(f'<row r="{n}"><c r="A{n}" t="inlineStr"><is><t>{n}</t></is></c><c r="B{n}" t="inlineStr"><is><t>x</t></is></c></row>' for n in range(1, 20_001))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{rows}</sheetData></worksheet>')
    data = buffer.getvalue()
    tracemalloc.start()
    read = sum(1 for row in SRC.xlsx_rows(data) if row[1] == "x")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert read == 20_000 and peak < 4 << 20


def test_long_work_is_dealt_by_rows(spark, small, monkeypatch):
    monkeypatch.setattr(further, "WORKED", 10)
    rows = T.table(spark, small, "customer").count()
    assert further.anchored_places(spark, small).rdd.getNumPartitions() == max(4, math.ceil(rows / 10))
    monkeypatch.setattr(further, "WORKED", 50)
    rows = T.table(spark, small, "orders").count() * 2
    assert further.flattened_trees(spark, small).rdd.getNumPartitions() == max(4, math.ceil(rows / 50))


def test_places_stand_for_their_holes(spark):
    nodes = spark.createDataFrame([(1, 0, 0, 0.0, 0.0), (1, 0, 1, 3.0, 0.0)], "project long, j int, i int, x double, y double")
    anchors = spark.createDataFrame([(1, "a", 0.0, 0.0, 2.0), (1, "a", 0.0, 0.0, 0.0), (1, "a", 5.0, 0.0, 4.0)], "project long, layer string, x double, y double, z double")
    places = spark.createDataFrame([(1, "a", 0.0, 0.0, 2.0, 2, 0.0), (1, "a", 5.0, 0.0, 4.0, 1, 4.0)], "project long, layer string, x double, y double, z double, n long, low double")
    rows = lambda df: sorted((r["i"], round(r["z"], 9)) for r in df.collect())
    assert rows(U.weighted_by_places(nodes, places)) == rows(U.distance_weighted(nodes, anchors))
