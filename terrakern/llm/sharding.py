"""Sharding by jump consistent hashing, in column expressions alone.

The published loop draws the next jump from a 64-bit linear congruential generator seeded with the key, and ends when
the jump passes the last shard. Each turn moves on by one shard at least, so `shards` turns always do; the loop is an
`aggregate` over that many steps. Products are taken in DECIMAL(38,0) because BIGINT multiplication doesn't wrap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrakern.llm.common import cut, numbered, table

# Fixed values of the published algorithm.
MULTIPLIER = 2862933555777941757
TWO_64 = 18446744073709551616
TWO_33 = 8589934592
TWO_31 = 2147483648
#: Cells in which the rows of a shard are numbered.
BUCKETS = 512


def _exact(number: int) -> Column:
    return F.lit(str(number)).cast("decimal(38,0)")


def jump_hash(key: Column, shards: int) -> Column:
    """Shard 0 to shards - 1 of a long key. A null key counts as 0."""
    if shards < 1:
        raise ValueError("shards must be positive")
    key = F.coalesce(key, F.lit(0)).cast("decimal(38,0)")
    unsigned = F.when(key < 0, key + _exact(TWO_64)).otherwise(key).cast("decimal(38,0)")

    def turn(state: Column, _: Column) -> Column:
        seed = ((state["seed"] * _exact(MULTIPLIER)).cast("decimal(38,0)") + _exact(1)).cast("decimal(38,0)") % _exact(TWO_64)
        seed = seed.cast("decimal(38,0)")
        whole = (seed - seed % _exact(TWO_33)).cast("decimal(38,0)")  # divides exactly
        draw = (whole / _exact(TWO_33)).cast("double") + F.lit(1.0)
        jump = F.floor((state["next"] + 1).cast("double") * (F.lit(float(TWO_31)) / draw)).cast("long")
        ended = state["next"] >= F.lit(shards)
        return F.when(ended, state).otherwise(F.struct(seed.alias("seed"), state["next"].alias("shard"), jump.alias("next")))

    start = F.struct(unsigned.alias("seed"), F.lit(-1).cast("long").alias("shard"), F.lit(0).cast("long").alias("next"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, turn)["shard"].cast("int")


def shard(docs: DataFrame, shards: int = 8, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of docs (doc_id, text, ...).

    size is the text's UTF-8 bytes plus one; a null text has none and the crc32 of no bytes. The shard depends on
    doc_id and `shards` alone: equal ids meet in one shard, a null id goes where 0 goes. grown_shard is the shard among
    shards + 1. slot numbers the rows of a shard without gaps from 0, ties in any order; repeated rows get slots of
    their own. Further columns of docs are left out. An empty table gives an empty one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    ).select("*", jump_hash(F.col("doc_id"), shards).alias("shard"), jump_hash(F.col("doc_id"), shards + 1).alias("grown_shard"))
    rows = cut(rows)  # five numbers for each text, which is read once
    placed = numbered(rows, ["shard"], F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)), [F.col("doc_id"), F.col("text_crc32"), F.col("size")], "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shard() over all documents, eight shards."""
    return shard(table(spark, sf_dir, "documents"))
