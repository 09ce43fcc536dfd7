"""What the corpus operators share: reading tables, cutting lineage, numbering rows without a hot task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrakern.operators.materialise import cut, folder
from terrakern.operators.ordering import in_pieces

__all__ = ["UPPER", "WORD", "ascii_lower", "cut", "folder", "id_text_crc", "in_pieces", "numbered", "sample", "table"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Java regex of a word: no space, tab, line feed, vertical tab, form feed or carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and leaves every other letter as it is."""
    return F.translate(c, UPPER, UPPER.lower())


def id_text_crc(doc_id: Column) -> Column:
    """crc32 of the id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def numbered(df: DataFrame, group: list[str], bucket: Column, order: list[Column], name: str) -> DataFrame:
    """Adds `name`: each row's place, gapless from 0, in its group, by bucket and then by `order`.

    A group may hold any share of the rows. Only (group, bucket) cells are sorted together; the cells' sizes, one
    row for each cell, give the offsets. `bucket` must be a deterministic integer.
    """
    df = df.withColumn("_bucket", bucket)
    cell = [*group, "_bucket"]
    sizes = df.groupBy(*cell).agg(F.count(F.lit(1)).alias("_cell_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*cell, F.coalesce(F.sum("_cell_n").over(before), F.lit(0)).alias("_offset"))
    local = df.withColumn("_place", F.row_number().over(Window.partitionBy(*cell).orderBy(*order)) - 1)
    return local.join(offsets, cell).withColumn(name, (F.col("_offset") + F.col("_place")).cast("long")).drop("_offset", "_place", "_bucket")


def sample(df: DataFrame, key: list[str], limit: int, cells: int = 1 << 14) -> DataFrame:
    """`limit` rows, or all where there are fewer: the first by a hash of `key`, then by a hash of the whole row.

    The hash's range is parted into cells and their rows are counted; those in cells beyond the one that fills the limit stay
    where they are. However often a key repeats, the rows asked for come back.
    """
    hashed = df.withColumns({"_h": F.pmod(F.xxhash64(*key), F.lit(1 << 40)), "_r": F.xxhash64(*df.columns)})
    counts = hashed.groupBy(F.floor(F.col("_h") / ((1 << 40) // cells)).cast("int").alias("cell")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    order = counts["cell"].to_numpy().argsort()
    reached = counts["n"].to_numpy()[order].cumsum()
    last = int(reached.searchsorted(limit))
    if last < len(order):
        hashed = hashed.where(F.col("_h") < (int(counts["cell"].to_numpy()[order][last]) + 1) * ((1 << 40) // cells))
    return hashed.orderBy("_h", "_r").limit(limit).drop("_h", "_r")
