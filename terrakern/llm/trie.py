"""Trie of the conversations' prefixes, by partition refinement.

All conversations begin in one class, the root. A round deals the active classes' members by their next turns: by the first, then by
two more, four more and so on, told apart after each turn. A class of one different conversation is retired: what is left of
it is a unary chain, written without looking at it again. Conversations that are equal throughout are one member with a weight from
the start. Folding back needs no walk up the tree: each node belongs to its least member, so what a subtree adds up is a
sum over the members of its top.

Nothing is gathered by conversation or by node: turns are numbered within ranges of the sorted table with offsets, classes are
aggregates, and members find their class by an equi-join. Rounds grow with the logarithm of the deepest turn that two different
conversations share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrakern.llm.common import WORD, cut, id_text_crc, in_pieces, table

NO_ENDS = hashlib.sha256(b"").hexdigest()
#: Ids of one run of this many are joined before a node's list of ids is hashed.
RUN = 4096
_LIST = ["h1", "h2", "n_turns"]


def _digests(depth: Column, key: Column) -> tuple[Column, Column]:
    return F.xxhash64(depth, key), F.xxhash64(key, depth, F.lit(1))


def placed(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth from 1, key, words, rest, n_turns, n_words) of every turn; key stands for role and text, rest is the words of this
    and all later turns. Turns are in the order of turn, null first, then role and text, null being empty; repeats are turns too.
    Rows without a conv_id belong to no conversation and are left out."""
    rows = conversations.select("conv_id", "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")]).where("conv_id IS NOT NULL")
    rows = in_pieces(rows, [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")])
    key = F.unhex(F.sha2(F.concat_ws("", F.char_length("role"), F.lit(":"), "role", "text"), 256))
    rows = cut(rows.select("conv_id", "_piece", "_at", key.alias("key"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words")))
    piece = ["conv_id", "_piece"]
    whole, before = Window.partitionBy("conv_id"), Window.partitionBy("conv_id").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = rows.groupBy(*piece).agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("w"))
    pieces = pieces.select(
        *piece, F.sum("n").over(whole).alias("n_turns"), F.sum("w").over(whole).alias("n_words"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"), F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w_before"),
    )
    here = Window.partitionBy(*piece).orderBy("_at")
    rows = rows.withColumns({"place": F.row_number().over(here), "upto": F.sum("words").over(here)})
    rest = F.col("n_words") - F.col("w_before") - F.col("upto") + F.col("words")
    return rows.join(pieces, piece).select("conv_id", (F.col("n_before") + F.col("place")).alias("depth"), "key", "words", rest.alias("rest"), "n_turns", "n_words")


def rebuilt(turns: DataFrame, family: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) in which each conversation c begins with the first h turns of conversation c - c % family, as many as it
    has, h being crc32(c) % most, and goes on with its own turns after the first h. A conversation may be left without turns."""
    turns = cut(turns)
    h = (id_text_crc(F.col("conv_id")) % most).cast("long")
    known = turns.where("depth = 1").select("conv_id", "n_turns", "n_words", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    heads = turns.where(F.col("depth") < most).select(F.col("conv_id").alias("base"), "depth", "key", "words")
    lengths = known.select(F.col("conv_id").alias("base"), F.col("n_turns").alias("base_turns"))
    known = known.join(lengths, "base", "left").withColumn("lent", F.least("h", F.coalesce("base_turns", F.lit(0))))
    early = turns.where(F.col("depth") < most).where(F.col("depth") <= h).groupBy("conv_id").agg(F.sum("words").alias("early"))
    known = known.join(early, "conv_id", "left").withColumn("own_words", F.col("n_words") - F.coalesce("early", F.lit(0)))
    borrowed = known.where("lent > 0").select("conv_id", "base", "lent", "own_words").join(heads, "base").where("depth <= lent")
    later = Window.partitionBy("conv_id").orderBy(F.desc("depth"))  # `most` rows at the most
    borrowed = borrowed.select("conv_id", "depth", "key", "words", (F.sum("words").over(later) + F.col("own_words")).alias("rest"))
    own = turns.where(F.col("depth") > h).join(known.select("conv_id", (F.col("lent") - F.col("h")).alias("shift")), "conv_id")
    own = own.select("conv_id", (F.col("depth") + F.col("shift")).alias("depth"), "key", "words", "rest")
    return borrowed.unionByName(own), known.select("conv_id")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each group's texts, comma-joined, taken text by text in the order of the rows; groups lie together."""
    now, state = None, hashlib.sha256()

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in now] + [pa.array([state.hexdigest()])], [*_LIST, "ends"])

    for batch in batches:
        out = []
        for *group, ids in zip(*[batch.column(c).to_pylist() for c in (*_LIST, "ids")], strict=True):
            if group != now:
                out += [row()] if now else []
                now, state = group, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield from out
    if now:
        yield row()


def _members(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """(rep, weight, n_turns, ends) of each different conversation: its least id, how many are equal to it, and the hash of their ids."""
    one, two = _digests(F.col("depth"), F.col("key"))
    whole = turns.groupBy("conv_id").agg(F.bit_xor(one).alias("h1"), F.bit_xor(two).alias("h2"), F.count(F.lit(1)).alias("n_turns"))
    whole = conversations.join(whole, "conv_id", "left").select("conv_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in _LIST])
    runs = whole.groupBy(*_LIST, F.floor(F.col("conv_id") / RUN).alias("run")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    runs = cut(runs.select(*_LIST, "run", F.get("ids", F.lit(0)).alias("least"), F.size("ids").alias("n"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids")))
    ends = runs.select(*_LIST, "run", "ids").repartition(*_LIST).sortWithinPartitions(*_LIST, "run").drop("run")
    ends = ends.mapInArrow(_hashed, "h1 long, h2 long, n_turns long, ends string")
    counts = runs.groupBy(*_LIST).agg(F.min("least").alias("rep"), F.sum("n").alias("weight"))
    return counts.join(ends, _LIST).select("rep", "weight", "n_turns", "ends")


def _refined(turns: DataFrame, members: DataFrame) -> DataFrame:
    """(rep, depth, node, n_reps, n_convs, words) of each member in each class that it shares with another, and in the root."""
    root = members.agg(F.min("rep").alias("node"), F.count(F.lit(1)).alias("n_reps"), F.sum("weight").alias("n_convs")).first().asDict()
    path = cut(members.select("rep", *[F.lit(v).cast("long").alias(k) for k, v in {"depth": 0, **root, "words": 0}.items()]))
    found, at, wide = path, 0, 1
    while True:
        active = path.where((F.col("depth") == at) & (F.col("n_reps") > 1)).select("rep", F.col("node").alias("was"))
        if active.isEmpty():
            return found
        one, two = _digests(F.col("depth"), F.col("key"))
        since = Window.partitionBy("rep").orderBy("depth")  # `wide` rows at the most
        ahead = turns.where(F.col("depth").between(at + 1, at + wide)).join(active, "rep")
        ahead = ahead.select("rep", "was", "depth", "words", "weight", F.bit_xor(one).over(since).alias("p1"), F.bit_xor(two).over(since).alias("p2"))
        split = ["was", "depth", "p1", "p2"]
        classes = ahead.groupBy(*split).agg(F.min("rep").alias("node"), F.count(F.lit(1)).alias("n_reps"), F.sum("weight").alias("n_convs"))
        path = cut(ahead.join(classes.where("n_reps > 1"), split).select("rep", "depth", "node", "n_reps", "n_convs", "words"))
        found, at, wide = found.unionByName(path), at + wide, wide * 2


def trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row for each different sequence of first turns, the empty one (the root) included: conv_id, its least member, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256. `turns` has conv_id, depth from 1, key, words and
    rest; `conversations` all ids, those without turns too. Without conversations there is no root."""
    members = cut(_members(turns, conversations))
    turns = cut(turns.withColumnRenamed("conv_id", "rep").join(members.select("rep", "weight"), "rep"))
    path = _refined(turns, members)
    last = path.groupBy("rep").agg(F.max(F.struct("depth", "node", "n_reps")).alias("last"))
    last = last.select("rep", F.col("last.depth").alias("shared"), F.col("last.node").alias("top"), (F.col("last.n_reps") == 1).alias("alone"))
    last = cut(members.join(last, "rep"))

    tails = turns.drop("weight").join(last, "rep").where("depth > shared").withColumn("saved", (F.col("weight") - 1) * F.col("rest"))
    at_end = F.col("depth") == F.col("n_turns")
    chains = tails.select(
        F.col("rep").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("shared") + 1, F.col("top")).otherwise(F.col("rep")).alias("parent_conv_id"), F.col("weight").alias("n_convs"),
        F.when(at_end, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.when(at_end, F.col("ends")).alias("ends"),
    )

    tail = tails.where("depth = shared + 1").select("rep", F.col("saved").alias("tail_saved"))
    own = path.join(last, "rep").join(tail, "rep", "left")
    ordered = Window.partitionBy("rep").orderBy("depth")  # no more rows than turns that different conversations share
    goes_on = F.col("n_turns") > F.col("shared")
    owned = F.when(F.col("node") == F.col("rep"), (F.col("n_convs") - 1) * F.col("words")).otherwise(0)
    own = own.select(
        "rep", "depth", "node", "n_convs", F.lag("node").over(ordered).alias("parent"), (goes_on | F.col("alone")).cast("long").alias("leaf"),
        (F.sum(owned).over(ordered.rowsBetween(0, Window.unboundedFollowing)) + F.coalesce("tail_saved", F.lit(0))).alias("saved"),
        F.coalesce((F.lead("node").over(ordered) == F.col("rep")).cast("long"), goes_on.cast("long")).alias("child"),
        F.when(F.col("depth") == F.col("n_turns"), F.col("ends")).alias("ends"),
    )
    nodes = own.groupBy(F.col("node").alias("conv_id"), "depth").agg(
        F.max("parent").alias("parent_conv_id"), F.max("n_convs").alias("n_convs"), F.sum("child").alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"), F.max("ends").alias("ends")
    )
    return nodes.unionByName(chains).withColumn("ends_sha256", F.coalesce("ends", F.lit(NO_ENDS))).drop("ends")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text) as they are; see `placed` for nulls, ties and repeats, `trie` for the rows.
    Other columns may have any names; texts may be of any length."""
    turns = cut(placed(conversations))
    return trie(turns.select("conv_id", "depth", "key", "words", "rest"), turns.where("depth = 1").select("conv_id"))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each begun with turns of the first of its twenty."""
    return trie(*rebuilt(placed(table(spark, sf_dir, "conversations"))))
