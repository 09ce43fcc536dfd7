"""Cutting lineage, and folders for files that a job writes and reads again, in the folder that the cluster shares."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. A session on one machine (a test) may do without; elsewhere executors wouldn't see each other's files."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="checkpoints-")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder: later jobs don't repeat it, lost executors don't lose it."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


#: Rows of a task of what is dealt().
ROWS = 250_000


def dealt(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """df dealt by keys to as many tasks as its rows ask for, about `rows` (else ROWS) to each, so that what follows by these keys takes the same memory in a
    task however large the table is. The rows are counted first, which a file answers from its footer."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(df.count() / (rows or ROWS)))
    return df.repartition(tasks, *keys)


def stored(df: DataFrame) -> DataFrame:
    """df, written to the shared folder by columns: many times smaller than the rows of cut(), and of a size that is known, so that a small
    table goes to all tasks of a join. The order of rows isn't kept. What is stored isn't stored again."""
    if getattr(df, "_is_stored", False):
        return df
    at = folder(df.sparkSession, "stored")
    df.write.parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out._is_stored = True
    return out
