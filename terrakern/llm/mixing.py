"""Mixing sources to target weights with a low-discrepancy schedule.

1. Targets: each source's share of the budget by weight, held under a cap; what a cap cuts off goes to the others by weight.
2. Blocks: a source's documents, shuffled by a hash, form one stream of words that is cut into blocks of equal length.
3. Schedule: slot t draws the golden-ratio point frac(t * 0.618...); the cumulative weights map the point to a source. The
   k-th slot of a source takes its block k, beginning again after the last block. A source stops at its target; the last
   slot may be a part of a block.
4. Slots and blocks meet in an equi-join; a document takes what its words' blocks are taken.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from terrakern.llm.common import WORD, cut, numbered, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
#: The schedule has about SHARE * 2 ** SCHEDULE_BITS slots over large tables; a block has LEAST_BLOCK words at least.
SCHEDULE_BITS = 20
LEAST_BLOCK = 16
BUCKETS = 1024
#: floor(2 ** 32 / golden ratio), odd: t * GOLDEN mod 2 ** 32 are the golden-ratio points in fixed point.
GOLDEN = 2654435769
TWO_32 = 4294967296
CELLS = 4096


def _running(order: list[Column]) -> WindowSpec:
    return Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Adds source_no, weight and target to (source, source_size), one row for each source.

    Sources count in the order of their code points, null last, and weights repeat along it. Raising one level of words
    for each unit of weight until the budget is spent gives what resharing each excess gives: a source with a cap below its
    share gets its cap. The windows below sort one row for each source.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    rows = (
        sources.withColumn("source_no", F.row_number().over(ordered) - 1)
        .withColumn("weight", weight)
        .withColumn("_cap", F.col("source_size") * float(cap))
        .withColumn("_level", F.col("_cap") / F.col("weight"))
    )
    order = [F.col("_level"), F.col("source_no")]
    whole = Window.partitionBy()
    rows = (
        rows.withColumn("_budget", F.sum("source_size").over(whole) * float(share))
        .withColumn("_capped", F.coalesce(F.sum("_cap").over(_running(order)), F.lit(0.0)))
        .withColumn("_open", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(_running(order)), F.lit(0.0)))
        .withColumn("_try", (F.col("_budget") - F.col("_capped")) / F.col("_open"))
        .withColumn("_reached", F.min(F.when(F.col("_try") <= F.col("_level"), F.struct("_level", "source_no", "_try"))).over(whole)["_try"])
    )
    target = F.when(F.col("_reached").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("weight") * F.col("_reached")))
    return rows.select("source", "source_size", "source_no", "weight", target.alias("target"))


def _schedule(sources: DataFrame, slots: int, chunk: int = 4096) -> DataFrame:
    """(source_no, rank) for each slot whose rank is within the source's `quota` of slots."""
    spark = sources.sparkSession
    before = F.coalesce(F.sum("quota").over(_running([F.col("source_no")])), F.lit(0))
    spans = sources.where("quota > 0").select("source_no", "quota", before.alias("_lo"), F.sum("quota").over(Window.partitionBy()).alias("_all"))
    lo = F.col("_lo") / F.col("_all") * float(TWO_32)
    hi = (F.col("_lo") + F.col("quota")) / F.col("_all") * float(TWO_32)
    spans = spans.select("source_no", "quota", lo.alias("_from"), hi.alias("_to"))
    width = TWO_32 // CELLS
    last = F.greatest(F.floor(F.col("_from") / width), F.ceil(F.col("_to") / width) - 1)
    spans = spans.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_from") / width), last)))
    points = spark.range(slots).select(F.col("id").alias("_t"), F.pmod(F.col("id") * F.lit(GOLDEN), F.lit(TWO_32)).alias("_u"))
    points = points.withColumn("_cell", F.floor(F.col("_u") / width))
    drawn = points.join(spans, "_cell").where((F.col("_u") >= F.col("_from")) & (F.col("_u") < F.col("_to")))
    ranked = numbered(drawn.select("source_no", "quota", "_t"), ["source_no"], F.floor(F.col("_t") / chunk), [F.col("_t")], "rank")
    return ranked.where(F.col("rank") < F.col("quota")).select("source_no", "rank")


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
    schedule_bits: int = SCHEDULE_BITS,
    carry: Sequence[str] = (),
) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row of docs (doc_id, text, source, ...), and the columns of `carry`.

    size counts the words of the text (null or blank: 0); taken the words that the mix takes of it, repeats counted, at most
    `cap` times size. A null source is a source of its own. Repeated rows are documents of their own. An empty table or one
    without words takes nothing. Further columns of docs, whatever their names, are left out unless carried.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    sizes = cut(docs.select(F.col("doc_id"), F.col("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), *[F.col(c).alias(f"_carry_{c}") for c in carry]))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    block = max(LEAST_BLOCK, -(-total // 2**schedule_bits))

    sources = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    rest = F.greatest(F.lit(0), F.round("target").cast("long") - F.col("_passes") * F.col("source_size"))
    sources = (
        sources.withColumn("blocks", F.ceil(F.col("source_size") / block))
        .withColumn("_passes", F.when(F.col("source_size") > 0, F.floor(F.round("target") / F.col("source_size"))).otherwise(F.lit(0)))
        .withColumn("_rest", rest)
        .withColumn("quota", (F.col("_passes") * F.col("blocks") + F.ceil(F.col("_rest") / block)).cast("long"))
        .withColumn("last_take", F.when(F.col("_rest") % block > 0, F.col("_rest") % block).otherwise(F.lit(0)))
        .select("source", "source_size", "source_no", "target", "blocks", "quota", "last_take")
    )
    sources = cut(sources)
    need = sources.where("quota > 0").agg(F.sum("quota").alias("n"), F.min("quota").alias("least")).first()
    # A golden-ratio run misses a share of its points by a few at most; the surplus lets every source reach its quota.
    slots = -(-need["n"] * (max(8, need["least"]) + 8) // max(8, need["least"])) if need["n"] else 0

    whole = F.col("last_take") == 0
    end = F.col("rank") == F.col("quota") - 1
    taken = (
        _schedule(sources, slots)
        .join(sources.select("source_no", "blocks", "quota", "last_take"), "source_no")
        .groupBy("source_no", (F.col("rank") % F.col("blocks")).alias("_block"))
        .agg(F.sum(F.when(end & ~whole, 0).otherwise(1)).alias("_times"), F.max(F.when(end, F.col("last_take")).otherwise(0)).alias("_part"))
    )

    # The stream of a source: by bucket, then by hash. A cell's words before it come from the cells' sums.
    shuffled = sizes.withColumn("_h", F.xxhash64(F.col("doc_id"), F.lit("shuffle"))).withColumn("_bucket", F.pmod(F.col("_h"), F.lit(BUCKETS)))
    cells = shuffled.groupBy("source", "_bucket").agg(F.sum("size").alias("_cell"))
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_before", F.coalesce(F.sum("_cell").over(before), F.lit(0)))
    cells = cells.join(sources.select(F.col("source").alias("_source"), "source_size", "source_no", "target"), F.col("source").eqNullSafe(F.col("_source")))
    cells = cells.select(F.col("source").alias("_source"), F.col("_bucket").alias("_cell_bucket"), "_before", "source_size", "source_no", "target")
    at = Window.partitionBy("source", "_bucket").orderBy("_h", "doc_id", "size")
    stream = (
        shuffled.withColumn("_place", F.row_number().over(at))
        .withColumn("_inner", F.sum("size").over(at.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .join(cells, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_cell_bucket")))
        .withColumn("_from", F.col("_before") + F.col("_inner"))
    )
    first = F.floor(F.col("_from") / block)
    parts = stream.withColumn("_block", F.explode(F.sequence(first, F.greatest(first, F.floor((F.col("_from") + F.col("size") - 1) / block)))))
    start, stop = F.greatest(F.col("_from"), F.col("_block") * block), F.least(F.col("_from") + F.col("size"), (F.col("_block") + 1) * block)
    part_stop = F.least(stop, F.col("_block") * block + F.col("_part"))
    words = F.greatest(stop - start, F.lit(0)) * F.col("_times") + F.greatest(part_stop - start, F.lit(0))
    key = ["source_no", "_bucket", "_place"]
    kept = ["doc_id", "size", "source_size", "target", *[f"_carry_{c}" for c in carry]]
    out = (
        parts.join(taken, ["source_no", "_block"], "left")
        .groupBy(*key)
        .agg(*[F.first(c).alias(c) for c in kept], F.sum(F.coalesce(words, F.lit(0))).cast("long").alias("taken"))
    )
    return out.select(*kept[:4], "taken", *[F.col(f"_carry_{c}").alias(c) for c in carry])


def mixed(docs: DataFrame, **options) -> DataFrame:
    """docs, each row repeated as often as the mix takes it: taken / size, rounded, half up. A row without words stays once.

    Rows are told apart by id, source and size, and by their place among those that agree in all three; such rows are given
    the repeats of their group in the order of their texts' hashes. Columns of docs may have any names; an empty table stays empty.
    """
    names = [f"_in_{k}" for k in range(len(docs.columns))]
    rows = docs.toDF(*names)
    doc_id, source, text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "source", "text"))
    key = ["_id", "_no_id", "_source", "_no_source", "_size", "_k"]

    def keyed(df: DataFrame, doc_id: Column, source: Column, size: Column, order: list[Column]) -> DataFrame:
        parts = [F.coalesce(doc_id.cast("long"), F.lit(0)), doc_id.isNull(), F.coalesce(source, F.lit("")), source.isNull(), size]
        df = df.withColumns(dict(zip(key, parts, strict=False)))
        return df.withColumn("_k", F.row_number().over(Window.partitionBy(*key[:-1]).orderBy(*order)))

    plain = rows.select(doc_id.alias("doc_id"), source.alias("source"), text.alias("text"))
    taken = keyed(mix(plain, carry=["source"], **options), F.col("doc_id"), F.col("source"), F.col("size"), [F.col("taken").desc()])
    times = F.when(F.col("size") > 0, F.floor((F.col("taken") * 2 + F.col("size")) / (F.col("size") * 2))).otherwise(F.lit(1))
    taken = taken.select(*key, times.cast("int").alias("_times")).where("_times > 0")
    size = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")
    met = keyed(rows, doc_id, source, size, [F.xxhash64(text)]).join(taken, key)
    return met.withColumn("_each", F.explode(F.array_repeat(F.lit(1), F.col("_times")))).select(*names).toDF(*docs.columns)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mix() over all documents with WEIGHTS and SHARE."""
    return mix(table(spark, sf_dir, "documents"))
