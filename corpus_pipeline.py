"""The corpus pipeline: a chain of the corpus operators, each working on all that the one before has kept.

Every stage takes (spark, docs, sf_dir) and returns a table with the columns of documents; the last returns the shards. Columns of
docs may have any names beside doc_id, text and source. An empty table gives an empty one at every stage. Ties are settled by
ids and by hashes of texts, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrakern.llm import decontaminate, jaccard, mixing, quality, sharding
from terrakern.llm.common import folder, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of docs, rejects go. A null or empty text is judged by its empty
    features; rows that repeat are judged alike; without labels nothing goes."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the least id. Null and blank texts have no copies and stay; an id
    that repeats over different texts names different documents; a group without ids keeps one row."""
    return jaccard.representatives(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Null and short texts hold none; every row is judged by itself."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out as their sources' target weights ask. A null source is a source; a text without words
    stays once; rows that repeat share the repeats of their group."""
    return mixing.mixed(docs)


def sharding_by_jump_hash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets a shard and a slot in it. A null id goes where 0 goes; rows that repeat get slots of their own."""
    return sharding.shard(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", mixing_to_targets),
    ("sharding", sharding_by_jump_hash),
]

#: SQL can't express the trained stages; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents. What a stage keeps is written to the shared folder of spark.checkpoint.dir and read again, so
    that no stage is worked out twice and a lost executor costs no more than a stage; the folder's owner empties it."""
    kept = folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs.write.parquet(f"{kept}/{number}")
            docs = spark.read.parquet(f"{kept}/{number}")
    return docs
