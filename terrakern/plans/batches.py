"""Queries on a folder of spreadsheets of mixed forms: a file for every hundred customers, wide, long, on a grid, without names, or broken."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrakern.plans import standins as T
from terrakern.plans.registry import query
from terrakern.sources import batch as B

_PATH = "'f' || CAST(c_custkey // 100 AS VARCHAR) || '.csv'"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of a file is its number modulo 5: wide; long with two rows a hole and another order of columns; wide below two lines of title, with
    semicolons; without roles; of no rows."""
    rows = T.table(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / 100).alias("file"), "c_custkey")

    def write(some: pd.DataFrame) -> pd.DataFrame:
        file, lines = int(some["file"].iloc[0]), []
        kind = file % 5
        for k in sorted(some["c_custkey"]):
            lon, lat = f"{126 + k % 97 * 0.03125}", f"{34 + k % 61 * 0.0625 + (10 if k % 50 == 0 else 0)}"
            if kind == 1:
                lines += [f"0,1.5,점토,BH-{k},{lat},{lon}", f"1.5,{2 + k % 3},연암,BH-{k},{lat},{lon}"]
            elif kind == 2:
                lines.append(f"BH-{k};{lon};{lat};{k % 40};1.5;{k % 2};2")
            else:
                lines.append(f"{'Q' if kind == 3 else 'BH-'}{k},{lon},{lat},{k % 40},{k % 3},2.5")
        head = {1: "상심도,하심도,지층명,공번,위도,경도", 2: "조사 보고;;\n2020년;;\n공번;경도;위도;표고;매립토;풍화암;경암", 3: "a,b,c,d,e,f"}.get(kind, "공번,경도,위도,표고,토사,연암")
        text = "" if kind == 4 else head + "\n" + "\n".join(lines)
        return pd.DataFrame({"path": [f"f{file}.csv"], "content": [text.encode("cp949" if kind == 2 else "utf-8")]})

    return rows.groupBy("file").applyInPandas(write, "path string, content binary")


def _read(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    files = _files(spark, sf_dir)
    wanted = T.table(spark, sf_dir, "customer").select(F.concat(F.lit("f"), F.floor(F.col("c_custkey") / 100).cast("string"), F.lit(".csv")).alias("path")).distinct()
    return B.read_batch(wanted.unionByName(spark.range(1).select(F.lit("missing.csv").alias("path"))), files)


_ROWS = f"r AS (SELECT {_PATH} AS path, c_custkey // 100 % 5 AS kind, c_custkey AS k, 126 + c_custkey % 97 * 0.03125::DOUBLE AS longitude, 34 + c_custkey % 61 * 0.0625::DOUBLE + CASE WHEN c_custkey % 50 = 0 THEN 10 ELSE 0 END AS latitude FROM customer), h AS (SELECT *, 'BH-' || CAST(k AS VARCHAR) AS name FROM r WHERE kind < 3 AND latitude BETWEEN 33 AND 39)"
_STRATA = """s AS (SELECT path, name, t AS depth_top, b AS depth_bottom, soil AS soil_type FROM (
 SELECT path, name, 0.0::DOUBLE AS t, CAST(k % 3 AS DOUBLE) AS b, '토사' AS soil FROM h WHERE kind = 0 UNION ALL SELECT path, name, k % 3, k % 3 + 2.5, '연암' FROM h WHERE kind = 0 UNION ALL
 SELECT path, name, 0.0, 1.5, '점토' FROM h WHERE kind = 1 UNION ALL SELECT path, name, 1.5, 2 + k % 3, '연암' FROM h WHERE kind = 1 UNION ALL
 SELECT path, name, 0.0, 1.5, '매립토' FROM h WHERE kind = 2 UNION ALL SELECT path, name, 1.5, 1.5 + k % 2, '풍화암' FROM h WHERE kind = 2 UNION ALL SELECT path, name, 1.5 + k % 2, 3.5 + k % 2, '경암' FROM h WHERE kind = 2) WHERE b > t)"""


@query(f"WITH {_ROWS} SELECT path, name, longitude, latitude, CASE WHEN kind <> 1 THEN CAST(k % 40 AS DOUBLE) END AS elevation FROM h")
def holes_of_mixed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir)[0].select("path", "name", "longitude", "latitude", "elevation")


@query(f"WITH {_ROWS}, {_STRATA} SELECT * FROM s")
def strata_of_mixed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir)[1].select("path", "name", "depth_top", "depth_bottom", "soil_type")


@query(
    f"""WITH {_ROWS}, {_STRATA}, f AS (SELECT path, ANY_VALUE(kind) AS kind, COUNT(*) FILTER (WHERE latitude NOT BETWEEN 33 AND 39) * CASE WHEN ANY_VALUE(kind) = 1 THEN 2 ELSE 1 END AS far, COUNT(*) AS n FROM r GROUP BY path), hn AS (SELECT path, COUNT(*) AS n FROM h GROUP BY path), sn AS (SELECT path, COUNT(*) AS n FROM s GROUP BY path)
 SELECT f.path, CASE WHEN kind < 3 THEN 'ok' ELSE 'failed' END AS status, CASE kind WHEN 3 THEN 'ambiguous form' WHEN 4 THEN 'ValueError: no rows' END AS reason, CASE kind WHEN 1 THEN 'long' WHEN 3 THEN 'ambiguous' WHEN 4 THEN NULL ELSE 'wide' END AS form,
 COALESCE(hn.n, 0) AS boreholes, COALESCE(sn.n, 0) AS strata, CASE kind WHEN 3 THEN f.n WHEN 4 THEN 0 ELSE far END AS refused FROM f LEFT JOIN hn ON hn.path = f.path LEFT JOIN sn ON sn.path = f.path UNION ALL SELECT 'missing.csv', 'skipped', 'not found', NULL, 0, 0, 0"""
)
def reports_of_mixed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each file of the batch."""
    return _read(spark, sf_dir)[3].select("path", "status", "reason", "form", "boreholes", "strata", "refused")
