"""Reading logs off lines, on documents read by hand."""

import unicodedata

from pyspark.sql import functions as F

from terrakern.functions.text import compatible
from terrakern.operators import scans as SC
from terrakern.plans import registry  # noqa: F401  (it loads the others in their order)
from terrakern.plans import scanned


def lines(spark, *texts, doc="d"):
    return spark.createDataFrame([(doc, n, t) for n, t in enumerate(texts)], "doc string, line_no long, text string")


def row(depth, tail="i.png|점토|"):
    return f"|{depth}|1|2|{tail}"


def read(spark, df, ids=()):
    given = spark.createDataFrame([("d", i, n) for n, i in enumerate(ids)], "doc string, id string, place int")
    return [tuple(r) for r in SC.intervals_of_rows(SC.rows_of_holes(df, given)).orderBy("doc", "line_no").select("hole", "section", "top", "bottom").collect()]


def test_ids_in_order_of_mention(spark):
    df = lines(spark, "BH - 2 and NH--1", None, "ＢＨ-2 TP 7A", "XX-3 12")
    assert [r["id"] for r in SC.ids_named(df).orderBy("place").collect()] == ["BH-2", "NH-1", "TP-7A"]


def test_rows_turn_to_the_next_hole(spark):
    df = lines(spark, row("1.0"), row("25 30.5"), row("29"), row("0.5"), row("2"), row("x"), row("0.1"), None, "", row(0.05))
    assert read(spark, df, ["BH-1", "BH-2"]) == [("BH-1", 0, 0.0, 1.0), ("BH-1", 0, 1.0, 30.5), ("BH-2", 1, 0.0, 0.5), ("BH-2", 1, 0.5, 2.0)]  # 29 falls by less than two, 0.1 from 2 too
    assert [r[:2] for r in read(spark, lines(spark, row(9), row(3), row(8), row(1)))] == [("시추-1", 0), ("시추-2", 1), ("시추-2", 1), ("시추-3", 2)]


def test_labels_turn_to_their_hole(spark):
    df = lines(spark, row(5), "시추공번: bh2", row(4), "No. BH-1", row(6), "시추번호 ZZ9", row(7), "No. BH1", row(6.5), row(7.5, "only|"), row(7.6, ""))
    assert read(spark, df, ["BH-1", "BH-2"]) == [("BH-1", 0, 0.0, 5.0), ("BH-2", 1, 0.0, 4.0), ("BH-1", 2, 0.0, 6.0), ("BH-1", 2, 6.0, 7.0), ("BH-1", 2, 7.0, 7.5)]


def test_documents_do_not_touch_and_nothing_is_read_from_nothing(spark):
    two = lines(spark, row(9)).unionByName(lines(spark, row(1), doc="e")).unionByName(lines(spark, row(3), doc=None))
    assert [r[:2] for r in read(spark, two)] == [("시추-1", 0), ("시추-1", 0)]
    assert read(spark, two.where("false")) == []
    clash = two.withColumns({"place": F.lit(7), "hole": F.lit("x")})
    assert len(read(spark, clash)) == 2


def test_soils_of_rows(spark):
    df = lines(spark, row(1, "a.png|풍화<br>암|"), row(1, "a.png|갈색 모래|"), row(1, ""), None)
    assert [r[0] for r in df.orderBy("line_no").select(SC.soil_of_row(F.col("text"))).collect()] == ["풍화암", "모래", "토사", "토사"]


def test_columns_stay_with_their_rows(spark):
    df = lines(spark, row("1.0"), "No. BH-2", row("0.5"), row("0.2"), doc="d").withColumn("cell", F.concat(F.lit("c"), F.col("line_no").cast("string")))
    given = spark.createDataFrame([("d", "BH-1", 0), ("d", "BH-2", 1)], "doc string, id string, place int")
    found = SC.rows_of_holes(df, given, ["cell"]).orderBy("line_no")
    assert [tuple(r) for r in found.select("line_no", "hole", "section", "bottom", "cell").collect()] == [(0, "BH-1", 0, 1.0, "c0"), (2, "BH-2", 1, 0.5, "c2")]


def test_scanned_logs_read_their_table_once(spark, small):
    plan = scanned.scanned_logs(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert sum(line.count("l_linenumber") > 0 and "Relation" in line for line in plan.splitlines()) == 1


def test_compatible_form(spark):
    texts = ["ＢＨ－１ ㎡", "a\n한글|", "가", "", None, "가각", "𝟏"]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string").orderBy("n")
    assert [r[0] for r in df.select(compatible(F.col("t"))).collect()] == [None if t is None else unicodedata.normalize("NFKC", t) for t in texts]
