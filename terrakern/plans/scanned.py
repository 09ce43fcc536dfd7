"""Logs read off lines of documents: orders are documents, their lineitems rows of tables, in between labels of holes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrakern.operators import scans as SC
from terrakern.plans import standins as T
from terrakern.plans.registry import query


def _document(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lines of documents, and pages that name their holes, none in one of three."""
    key, n = F.col("l_orderkey"), F.col("l_linenumber")
    li = T.table(spark, sf_dir, "lineitem").groupBy(key, n).agg(F.min(F.struct(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_quantity").alias("q"))).alias("r"))
    li = li.select(key.cast("string").alias("doc"), (n * 10).cast("long").alias("line_no"), "r.p", "r.s", "r.q")
    cells = [F.lit("|"), F.col("q").cast("int").cast("string"), F.lit(".5 |a|b|"), F.when(F.col("p") % 8 != 0, F.lit("x.png|실트층|")).otherwise(F.lit(""))]
    line = lambda before, text: F.struct((F.col("line_no") - before).alias("line_no"), text.alias("text"))
    label = F.when(F.col("p") % 6 == 0, line(5, F.concat(F.lit("시추공번 : bh"), (F.col("s") % 4).cast("string"))))
    lines = li.select("doc", F.inline(F.array_compact(F.array(line(0, F.concat(*cells)), label, line(7, F.lit("|---|---|---|---|---|"))))))
    o = F.col("o_orderkey")
    pages = T.table(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0").select(o.cast("string").alias("doc"), F.lit(1).cast("long").alias("line_no"), F.concat(F.lit("BH  -"), (o % 4).cast("string"), F.lit(" 와 BH 2, BH--3 그리고 BH-"), (o % 5).cast("string")).alias("text"))
    return lines, pages


_MATCHED = "list_filter(ids, lambda i: contains(replace(i, '-', ''), lab) OR contains(lab, i))"
_SCAN = f"""WITH RECURSIVE li AS (SELECT CAST(l_orderkey AS VARCHAR) AS doc, l_linenumber * 10 AS line_no, UNNEST(MIN({{'p': l_partkey, 's': l_suppkey, 'q': l_quantity}})) FROM lineitem GROUP BY l_orderkey, l_linenumber),
 ev AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc ORDER BY line_no) AS n FROM (SELECT doc, line_no, NULL AS lab, CAST(q AS INTEGER) + 0.5::DOUBLE AS d, p % 8 <> 0 AS whole FROM li UNION ALL SELECT doc, line_no - 5, 'BH' || (s % 4), NULL, FALSE FROM li WHERE p % 6 = 0)),
 id AS (SELECT doc, CASE WHEN k % 3 = 0 THEN ['시추-1'] ELSE ['BH-' || (k % 4)] || list_filter(['BH-2', 'BH-3'], lambda i: i <> 'BH-' || (k % 4)) || list_filter(['BH-' || (k % 5)], lambda i: i NOT IN ('BH-2', 'BH-3', 'BH-' || (k % 4))) END AS ids
 FROM (SELECT DISTINCT doc, CAST(doc AS BIGINT) AS k FROM li)),
 st AS (SELECT doc, 0::BIGINT AS n, ids, ids[1] AS hole, 0 AS section, -1.0::DOUBLE AS least, NULL::DOUBLE AS bef, NULL::BIGINT AS line_no, NULL::DOUBLE AS bottom, FALSE AS took FROM id
 UNION ALL SELECT doc, n, nids, h2, s2, CASE WHEN took THEN d ELSE l2 END, CASE WHEN took THEN d ELSE bef END, ln, d, took FROM
 (SELECT *, COALESCE(whole AND d > l2, FALSE) AS took FROM (SELECT *, CASE WHEN fell AND idx = len(ids) THEN ids || ['시추-' || (idx + 1)] ELSE ids END AS nids,
  CASE WHEN fell AND idx = len(ids) THEN '시추-' || (idx + 1) WHEN fell THEN ids[idx + 1] WHEN turned THEN m ELSE hole END AS h2, section + CASE WHEN fell OR turned THEN 1 ELSE 0 END AS s2, CASE WHEN fell OR turned THEN -1.0 ELSE least END AS l2
  FROM (SELECT *, COALESCE(d < bef - 2, FALSE) AS fell, COALESCE(m <> hole, FALSE) AS turned, list_position(ids, hole) AS idx FROM
  (SELECT st.doc, ev.n, ids, hole, section, least, bef, ev.line_no AS ln, d, whole, ({_MATCHED})[1] AS m FROM st JOIN ev ON ev.doc = st.doc AND ev.n = st.n + 1)))))"""  # fmt: skip


@query(f"{_SCAN} SELECT doc, line_no, hole, section, bottom, COALESCE(LAG(bottom) OVER (PARTITION BY doc, hole, section ORDER BY bottom), 0) AS top, '실트' AS soil FROM st WHERE took")
def scanned_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of all holes that the documents' tables speak of."""
    lines, pages = _document(spark, sf_dir)
    lines = lines.withColumn("cell", SC.soil_cell(F.col("text")))
    found = SC.intervals_of_rows(SC.rows_of_holes(lines, SC.ids_named(pages), ["cell"]))
    return found.withColumn("soil", SC.soil_of_cell(F.col("cell"))).drop("cell")
