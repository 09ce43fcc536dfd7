"""Observations as a stream of files: an extension, for tables that grow while they are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arriving(spark: SparkSession, folder: str, schema, time: str, late: str = "1 hour", pattern: str = "*.parquet") -> DataFrame:
    """Rows of the Parquet files of a folder as they come, with a bound on how late they may."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder).withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def once(stream: DataFrame, key: list[str]) -> DataFrame:
    """Each key once within the bound: a request sent again isn't applied again."""
    return stream.dropDuplicatesWithinWatermark(key)


def counted(stream: DataFrame, time: str, window: str, by: list[str]) -> DataFrame:
    """Rows of each window of time."""
    return stream.groupBy(F.window(time, window).alias("window"), *by).agg(F.count(F.lit(1)).alias("n"))


def latest(stream: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The newest value of each key so far (complete or update mode)."""
    return stream.groupBy(key).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))
