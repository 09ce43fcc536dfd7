"""Language-model scores of whole texts.

The base is an add-one unigram over words. Words are counted over all learning documents; a word that makes up a share of
2 ** -HEAVY_BITS of them or more (at most 2 ** HEAVY_BITS words, so the table's size is bounded) is scored where its text is
read, the others meet their counts in an equi-join by the word's hash, and both parts are added up by document.

The model is attention.py's, over subword ids of a public tokenizer, which isn't trained here. What it knows grows with the corpus:

- counts of the ids, and of the first ids of words, from the counts of all words of all learning documents;
- prefixes of ids of the heavy words with their counts: inside a word they say what follows, as far as they have seen it;
- windows that together are the learning documents, each id of each text once. Classes of ids come from neighbours counted over all
  windows. Windows are dealt to ROUNDS, and a round's to trainers of about TRAINER windows, which take them all; these train from
  common weights, and their weights are averaged; more windows make more trainers, not longer ones.

Batches' distinct words are split into ids once.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrakern.llm import attention
from terrakern.llm import textbytes as tb
from terrakern.llm.common import cut, id_text_crc, table
from terrakern.operators.materialise import stored

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the tokenizer's authors part a text before merging; it must agree with the vocabulary's file.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
FOLDS, HELD_OUT = 7, 2
HEAVY_BITS = 20
#: Ids whose pairs inside words are counted.
COMMON = 2048
#: What a continuation of a prefix adds to the weight of those not seen.
DISCOUNT = 5.0
#: Ids of a window; windows of a trainer, rounds, steps of each where a trainer's windows make fewer.
SPAN = 80
TRAINER, ROUNDS, STEPS = 32768, 2, 300
#: Bytes of texts that a task works on at a time.
PIECE = 10 << 20
#: Parts in which trainers' weights are averaged.
SLABS = 64
_U = np.uint64


@lru_cache(maxsize=1)
def _tokenizer(vocabulary: bytes) -> tuple:
    """The encoding of a vocabulary's file, and which of its ids begin with a blank."""
    import tiktoken  # here, so that the other queries don't need it

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
    opens = np.zeros(max(ranks.values()) + 2, bool)
    opens[[n for word, n in ranks.items() if word[:1] == b" "]] = True
    return tiktoken.Encoding("subwords", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), opens


def subwords(words: bytes, count: int, vocabulary: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids of `count` words, each led by a blank in `words`, and count + 1 offsets."""
    encoding, opens = _tokenizer(vocabulary)
    text = words.decode("utf-8", "replace")
    ids = encoding.encode_to_numpy(text).astype(np.int64)
    first = np.flatnonzero(opens[ids])
    if len(first) != count:  # a word that the pattern parts from its blank
        each = [encoding.encode_ordinary(" " + w) for w in text[1:].split(" ")] if count else []
        ids = np.array([i for part in each for i in part], np.int64)
        first = np.cumsum([0, *map(len, each)])[:-1]
    return ids, np.append(first, len(ids)).astype(np.int64)


def spread(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for lengths[0] places, then from starts[1], and so on."""
    return np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths - starts, lengths)


def parts_of(batch: pa.RecordBatch, column: int, limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have at most `limit` bytes together, or are one text."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    for a, b in tb.slices(np.concatenate(([0], np.cumsum(lengths, dtype=np.int64))), limit):
        yield batch.slice(a, b - a)


class Batch:
    """The words of a column of texts: of each text, and the distinct ones."""

    def __init__(self, column: pa.Array):
        data, offsets = tb.texts(column)
        self.texts = len(offsets) - 1
        self.data = tb.LOWER[data]
        found = []
        for a, b in tb.slices(offsets):
            lo, part = int(offsets[a]), self.data[offsets[a] : offsets[b]]
            starts, ends, text = tb.word_spans(part, offsets[a : b + 1] - lo)
            found.append((tb.word_hashes(part, starts, ends), starts + lo, ends - starts, np.bincount(text, minlength=b - a)))
        h, starts, lengths, counts = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, t) for t in (_U, np.int64, np.int64, np.int64))
        self.counts = counts
        order = np.argsort(h)
        h = h[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        first = np.flatnonzero(new)
        self.hashes = h[first]
        self.many = np.diff(np.append(first, len(h)))
        self.which = np.empty(len(h), np.int32)
        self.which[order] = np.cumsum(new) - 1
        self.starts, self.lengths = starts[order[first]], lengths[order[first]]

    def words(self, lead: bool) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets of the distinct words, each after a blank if `lead`."""
        size = self.lengths + lead
        offsets = np.concatenate(([0], np.cumsum(size)))
        out = np.full(int(offsets[-1]), 32, np.uint8)
        out[spread(self.lengths, offsets[:-1] + lead)] = self.data[spread(self.lengths, self.starts)]
        return out, offsets


def learning(doc_id: Column) -> Column:
    return id_text_crc(doc_id) % FOLDS != HELD_OUT


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, c, word) of every word of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts_of(whole, 0)):
            b = Batch(batch.column(0))
            data, offsets = b.words(lead=False)
            for lo in range(0, len(b.hashes), 50_000):
                hi = min(len(b.hashes), lo + 50_000)
                part = data[offsets[lo] : offsets[hi]].tobytes()
                words = pa.StringArray.from_buffers(hi - lo, pa.py_buffer((offsets[lo : hi + 1] - offsets[lo]).astype(np.int32).tobytes()), pa.py_buffer(part))
                yield pa.record_batch([pa.array(b.hashes[lo:hi].view(np.int64)), pa.array(b.many[lo:hi]), words], ["h", "n", "word"])

    rows = docs.select("text").mapInArrow(run, "h long, n long, word string")
    return rows.groupBy("h").agg(F.sum("n").alias("c"), F.min("word").alias("word"))


def id_counts(counted: DataFrame, rank: np.ndarray, vocabulary: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How often each id occurs in the counted words, and begins one: as many numbers as the vocabulary has ids, and one for the end.
    And for each of the COMMON ids of least rank how often such an id follows it inside a word, or, in the last column, none."""
    shared = counted.sparkSession.sparkContext.broadcast((vocabulary, rank))
    size, wide = len(_tokenizer(vocabulary)[1]), COMMON + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, rank = shared.value
        total, first, pairs = np.zeros(size), np.zeros(size), np.zeros(COMMON * wide)
        for batch in batches:
            for lo in range(0, batch.num_rows, 50_000):
                part = batch.slice(lo, 50_000)
                words, c = part.column(0).to_pylist(), part.column(1).to_numpy()
                ids, offsets = subwords("".join(f" {w}" for w in words).encode(), len(words), vocabulary)
                each = np.repeat(c, np.diff(offsets))
                total += np.bincount(ids, each, size)
                first += np.bincount(ids[offsets[:-1]], c, size)
                here, after = rank[ids], np.append(rank[ids[1:]], COMMON)
                after[offsets[1:] - 1] = COMMON
                none = np.ones(len(ids), bool)
                none[offsets[1:] - 1] = False
                keep = (here < COMMON) & ((after < COMMON) | ~none)
                pairs += np.bincount(here[keep] * wide + after[keep], each[keep], len(pairs))
        for kind, numbers in enumerate((total, first, pairs)):
            some = np.flatnonzero(numbers)
            for lo in range(0, len(some), 100_000):
                at = some[lo : lo + 100_000]
                yield pa.record_batch([pa.array([kind] * len(at), pa.int32()), pa.array(at), pa.array(numbers[at])], ["kind", "at", "n"])

    out = [np.zeros(size), np.zeros(size), np.zeros(COMMON * wide)]
    rows = counted.select("word", "c").mapInArrow(run, "kind int, at long, n double").groupBy("kind", "at").agg(F.sum("n").alias("n")).toArrow()
    kind, at, n = (rows[c].to_numpy() for c in ("kind", "at", "n"))
    for k, numbers in enumerate(out):
        numbers[at[kind == k]] = n[kind == k]
    return out[0], out[1], out[2].reshape(COMMON, wide)


class Prefixes:
    """What follows the first ids of the heavy words. A prefix's escape, its share of the unseen, weighs as many words as it has
    different continuations, and for a first id also the other words that begin with it. What escapes follows the pairs of common
    ids in all words, and what escapes these is left to the model."""

    def __init__(self, ids: np.ndarray, offsets: np.ndarray, c: np.ndarray, first: np.ndarray, rank: np.ndarray, pairs: np.ndarray):
        seen, kinds = pairs.sum(axis=1, keepdims=True), (pairs > 0).sum(axis=1, keepdims=True)
        self.rank, self.pairs = rank.astype(np.int32), (pairs / np.maximum(seen + kinds, 1)).astype(np.float32)
        self.unpaired = np.where(seen[:, 0] > 0, kinds[:, 0] / np.maximum(seen + kinds, 1)[:, 0], 1).astype(np.float32)
        keys, weight, full, parent = [], [], [], []
        lengths, h = np.diff(offsets), np.zeros(len(c), _U)
        light = first.copy()
        np.subtract.at(light, ids[offsets[:-1]], c)
        other = []
        for j in range(int(lengths.max(initial=0))):
            some = np.flatnonzero(lengths > j)
            before = h[some]
            h[some] = self.step(before, ids[offsets[:-1][some] + j])
            keys.append(h[some])
            weight.append(c[some])
            full.append(np.where(lengths[some] == j + 1, c[some], 0))
            parent.append(before)
            other.append(np.maximum(light[ids[offsets[:-1][some]]], 0) if j == 0 else np.zeros(len(some)))
        keys, weight, full, parent, other = (np.concatenate(x) if x else np.empty(0, t) for x, t in ((keys, _U), (weight, float), (full, float), (parent, _U), (other, float)))
        self.keys, first_at, which = np.unique(keys, return_index=True, return_inverse=True)
        self.through = np.bincount(which, weight, len(self.keys)).astype(np.float32)
        self.full = np.bincount(which, full, len(self.keys)).astype(np.float32)
        of, kinds = np.unique(parent[first_at], return_counts=True)
        at = np.minimum(np.searchsorted(of, self.keys), max(len(of) - 1, 0))
        follow = np.where(of[at] == self.keys, kinds[at], 0) if len(of) else np.zeros(len(self.keys))
        self.escape = (DISCOUNT * (follow + (self.full > 0)) + other[first_at]).astype(np.float32)

    @staticmethod
    def step(h: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return tb.mix(h * _U(0x9FB21C651E98DF25) + ids.astype(_U) + _U(1))

    def told(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each id of words, but their first, what the counts give it and what they leave; then both for each word's end."""
        lengths = np.diff(offsets)
        given, left = np.zeros(len(ids), np.float32), np.ones(len(ids), np.float32)
        h = np.zeros(len(lengths), _U)
        known, through, escape, full = (np.zeros(len(lengths)) for _ in range(4))
        for j in range(int(lengths.max(initial=0))):
            some = np.flatnonzero(lengths > j)
            h[some] = self.step(h[some], ids[offsets[:-1][some] + j])
            at = np.minimum(np.searchsorted(self.keys, h[some]), max(len(self.keys) - 1, 0))
            found = self.keys[at] == h[some] if len(self.keys) else np.zeros(len(some), bool)
            here = np.where(found, self.through[at], 0.0) if len(self.keys) else np.zeros(len(some))
            if j:
                total = through[some] + escape[some]
                place = offsets[:-1][some] + j
                given[place] = np.where(known[some] > 0, here / np.maximum(total, 1e-9), 0)
                left[place] = np.where(known[some] > 0, escape[some] / np.maximum(total, 1e-9), 1)
            known[some], through[some] = found, here
            escape[some] = np.where(found, self.escape[at], 0.0) if len(self.keys) else 0.0
            full[some] = np.where(found, self.full[at], 0.0) if len(self.keys) else 0.0
        total = np.maximum(through + escape, 1e-9)
        stop = np.where(known > 0, full / total, 0).astype(np.float32)
        leaves = np.where(known > 0, escape / total, 1).astype(np.float32)
        inside = np.ones(len(ids), bool)
        inside[offsets[:-1]] = False
        at = np.flatnonzero(inside)
        self._paired(given, left, at, ids[at - 1], self.rank[ids[at]])
        self._paired(stop, leaves, np.arange(len(lengths)), ids[offsets[1:] - 1], np.full(len(lengths), COMMON))
        return given, left, stop, leaves

    def _paired(self, given: np.ndarray, left: np.ndarray, at: np.ndarray, last: np.ndarray, column: np.ndarray) -> None:
        """Parts what is left at some places by the pairs after the last ids."""
        row = self.rank[last]
        some = row < COMMON
        at, row, column = at[some], row[some], column[some]
        share = np.where(column <= COMMON, self.pairs[row, np.minimum(column, COMMON)], 0)
        given[at] += left[at] * share
        left[at] *= self.unpaired[row]


def windows(learn: DataFrame, tokens: int, vocabulary: bytes) -> DataFrame:
    """(key, ids) of all learning documents, which have `tokens` words and ends together: each id of each text once, in runs of whole words
    that begin in the same SPAN ids. A text's last run has the end's id. Keys are hashes of the ids."""
    shared = learn.sparkSession.sparkContext.broadcast(vocabulary)
    end = len(_tokenizer(vocabulary)[1]) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts_of(whole, 0)):
            b = Batch(batch.column(0))
            ids, offsets = subwords(b.words(lead=True)[0].tobytes(), len(b.hashes), shared.value)
            sizes, bounds = np.diff(offsets), np.concatenate(([0], np.cumsum(b.counts)))
            for lo, hi in tb.slices(bounds, 1 << 17):
                which, n = b.which[bounds[lo] : bounds[hi]], b.counts[lo:hi]
                pieces, text = np.concatenate(([0], np.cumsum(sizes[which]))), np.repeat(np.arange(hi - lo), n)
                own = pieces[bounds[lo : hi + 1] - bounds[lo]]
                lengths = np.diff(own) + 1
                flat = np.full(int(lengths.sum()), end, np.int32)
                flat[spread(lengths - 1, np.cumsum(lengths) - lengths)] = ids[spread(sizes[which], offsets[:-1][which])]
                nth = (pieces[:-1] - own[text]) // SPAN
                turn = np.flatnonzero(nth[1:] != nth[:-1]) + 1
                begins = np.append(np.unique(np.concatenate((own[:-1] + np.arange(hi - lo), pieces[turn] + text[turn]))), len(flat))
                for x in range(0, len(begins) - 1, 10_000):
                    at = begins[x : x + 10_001]
                    part, at = flat[at[0] : at[-1]], at - at[0]
                    place = np.arange(len(part)) - np.repeat(at[:-1], np.diff(at))
                    keys = np.add.reduceat(tb.mix(part.astype(_U) + place.astype(_U) * _U(1 << 32)), at[:-1]) >> _U(1)
                    lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(part))
                    yield pa.record_batch([pa.array(keys.astype(np.int64)), lists], ["key", "ids"])

    return learn.select("text").mapInArrow(run, "key long, ids array<int>") if tokens else learn.selectExpr("0L AS key", "array(0) AS ids").limit(0)


def neighbour_table(cut_windows: DataFrame, counts: np.ndarray) -> np.ndarray:
    """attention.neighbours over all windows: at most COMMON * 2 * NEIGHBOURS cells, whatever the corpus."""
    shared = cut_windows.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(attention.COMMON * 2 * attention.NEIGHBOURS, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                lists = batch.column(0).slice(lo, 4096)
                cells, n = attention.neighbours(shared.value, np.split(lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())[:-1]))
                total[cells] += n
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], ["cell", "n"])

    rows = cut_windows.select("ids").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(attention.COMMON * 2 * attention.NEIGHBOURS, np.int64)
    out[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return out


def _trainer(shared, round_: int):
    def train(group: pa.Table) -> pa.Table:
        vocabulary, start = shared.value
        order = np.argsort(group.column("key").to_numpy(), kind="stable")
        lists = group.column("ids").combine_chunks()
        sequences = [lists[int(k)].values.to_numpy(zero_copy_only=False) for k in order]
        trainer, end = group.column("trainer")[0].as_py(), len(vocabulary.slot) - 1
        model = attention.train(vocabulary, sequences, end, start and attention.unpacked(start["flat"]), STEPS, rate=0.01 / (1 + round_), seed=11 + trainer)
        flat, n = attention.packed(model.w).astype(np.float64), float(sum(map(len, sequences)))
        slabs = [x.tolist() for x in np.array_split(flat * n, SLABS)]
        return pa.table({"slab": pa.array(range(SLABS), pa.int32()), "trainer": pa.array([trainer] * SLABS, pa.int32()), "n": pa.array([n] * SLABS), "w": pa.array(slabs, pa.list_(pa.float64()))})

    return train


def _added(group: pa.Table) -> pa.Table:
    lists = group.column("w").combine_chunks()
    total = np.sum([lists[k].values.to_numpy() for k in range(len(lists))], axis=0)
    return pa.table({"slab": group.column("slab").slice(0, 1), "n": pa.array([float(np.sum(group.column("n").to_numpy()))]), "w": pa.array([total.tolist()], pa.list_(pa.float64()))})


def trained(cut_windows: DataFrame, words: attention.Vocabulary) -> attention.Model:
    """The model after all windows: they are dealt to rounds, and a round's to trainers of about TRAINER windows, which train by themselves from
    common weights that become the mean of theirs, by numbers of ids. Windows of one trainer alone take part in each round. The
    weights' size is fixed; sums of them are made in slabs, in two steps."""
    spark = cut_windows.sparkSession
    every = cut_windows.count()
    if not every:
        return attention.Model(attention.begin())
    parts = ROUNDS if every > TRAINER else 1
    many = -(-every // (TRAINER * parts))
    dealt = cut_windows.withColumns({"_round": F.pmod("key", F.lit(parts)), "trainer": F.pmod(F.floor(F.col("key") / parts), F.lit(many)).cast("int")})
    weights = None
    for round_ in range(ROUNDS):
        shared = spark.sparkContext.broadcast((words, weights))

        kind = "slab int, n double, w array<double>"
        own = dealt.where(F.col("_round") == round_ % parts).drop("_round")
        each = own.groupBy("trainer").applyInArrow(_trainer(shared, round_), "slab int, trainer int, n double, w array<double>")
        sums = each.groupBy("slab", F.pmod("trainer", F.lit(256))).applyInArrow(_added, kind).groupBy("slab").applyInArrow(_added, kind)
        got = sums.orderBy("slab").toArrow()
        if got.num_rows:
            weights = {"flat": (np.concatenate([np.array(x) for x in got["w"].to_pylist()]) / got["n"][0].as_py()).astype(np.float32)}
    return attention.Model(attention.unpacked(weights["flat"]))


SCORED = "row long, doc_id long, n_tokens long, known long, logs double, score double, light array<long>"


def _read(docs: DataFrame, heavy: tuple[np.ndarray, np.ndarray], model: attention.Model, words: attention.Vocabulary, prefixes: Prefixes, vocabulary: bytes) -> DataFrame:
    """SCORED of each document: known and logs, the sum of log10(c + 1), of its heavy words; the hashes of the others."""
    shared = docs.sparkSession.sparkContext.broadcast((heavy, model.w, words, prefixes, vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (known, logs), weights, words, prefixes, vocabulary = shared.value
        model, end = attention.Model(weights), len(words.slot) - 1
        for batch in (part for whole in batches for part in parts_of(whole, 2)):
            b = Batch(batch.column(2))
            at = np.minimum(np.searchsorted(known, b.hashes), max(len(known) - 1, 0))
            is_heavy = known[at] == b.hashes if len(known) else np.zeros(len(b.hashes), bool)
            log = np.where(is_heavy, logs[at], 0.0) if len(known) else np.zeros(len(b.hashes))
            data, _ = b.words(lead=True)
            ids, offsets = subwords(data.tobytes(), len(b.hashes), vocabulary)
            sizes = np.diff(offsets)
            given, left, ends, leaves = prefixes.told(ids, offsets)
            bounds = np.concatenate(([0], np.cumsum(b.counts)))
            score = np.empty(b.texts)
            for lo, hi in tb.slices(bounds, 1 << 17):
                which = b.which[bounds[lo] : bounds[hi]]
                pieces = np.concatenate(([0], np.cumsum(sizes[which])))
                own = pieces[bounds[lo : hi + 1] - bounds[lo]]
                lengths = np.diff(own) + 1
                all_ids, told, free = np.full(int(lengths.sum()), end, np.int64), np.zeros(int(lengths.sum()), np.float32), np.ones(int(lengths.sum()), np.float32)
                place, piece = spread(lengths - 1, np.cumsum(lengths) - lengths), spread(sizes[which], offsets[:-1][which])
                all_ids[place], told[place], free[place] = ids[piece], given[piece], left[piece]
                after = place[pieces[1:] - 1] + 1  # what follows a word: the next one's first id, or the end
                told[after], free[after] = ends[which], leaves[which]
                score[lo:hi] = attention.score(model, words, all_ids, lengths, end, told, free)
            owner = np.repeat(np.arange(b.texts), b.counts)
            heavy_words = is_heavy[b.which]
            light = ~heavy_words
            light_at = np.concatenate(([0], np.cumsum(np.bincount(owner[light], minlength=b.texts)))).astype(np.int32)
            yield pa.record_batch(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(b.counts + 1),
                    pa.array(np.bincount(owner[heavy_words], minlength=b.texts)),
                    pa.array(np.bincount(owner, log[b.which], b.texts).astype(float)),
                    pa.array(score),
                    pa.ListArray.from_arrays(pa.array(light_at), pa.array(b.hashes[b.which[light]].view(np.int64))),
                ],
                SCORED.replace(",", "").split()[::2],
            )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, SCORED)


def score(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs (doc_id, text, ...).

    A null or empty text is its end alone. A null id counts as the empty text for its fold. Repeated rows each give a row and
    are counted each. Without learning documents every count is 0 and the model has its untrained weights. Whole texts are
    read. Further columns of docs are left out. `tokenizer`, the path of a vocabulary's file, is read on the driver and sent to the
    tasks; without such a file there is no score.
    """
    vocabulary = Path(tokenizer).read_bytes()
    end = len(_tokenizer(vocabulary)[1]) - 1
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    learn = docs.where(learning(F.col("doc_id")))
    counted = cut(word_counts(learn))
    ends = learn.select("doc_id").count()
    words = counted.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    tokens, distinct = words["n"] + ends, words["v"] + (ends > 0)

    top = counted.where(F.col("c") >= max(1, tokens / 2**HEAVY_BITS)).select("h", "c", "word").toArrow()
    known, c = top["h"].to_numpy().view(_U), top["c"].to_numpy()
    order = np.argsort(known)
    heavy = (known[order], np.log10(c[order] + 1.0))

    ids, offsets = subwords("".join(f" {w}" for w in top["word"].to_pylist()).encode(), len(c), vocabulary)
    rank = np.empty(end + 1, np.int64)
    rank[np.argsort(-np.bincount(ids, np.repeat(c, np.diff(offsets)), end + 1), kind="stable")] = np.arange(end + 1)
    rank[rank >= COMMON] = COMMON + 1
    counts, first, pairs = id_counts(counted, rank, vocabulary)
    counts[end] = ends
    prefixes = Prefixes(ids, offsets, c.astype(float), first, rank, pairs)
    some = stored(windows(learn, tokens, vocabulary))
    starts = _tokenizer(vocabulary)[1].copy()
    starts[end] = True
    vocabulary_of = attention.vocabulary(counts, attention.classes_of(counts, starts, neighbour_table(some, counts)))
    model = trained(some, vocabulary_of)

    read = cut(_read(docs, heavy, model, vocabulary_of, prefixes, vocabulary))
    light = read.select("row", F.explode("light").alias("h")).join(counted.select("h", "c"), "h")
    light = light.groupBy("row").agg(F.count(F.lit(1)).alias("_known"), F.sum(F.log10(F.col("c") + 1)).alias("_logs"))
    both = read.drop("light").join(light, "row", "left")
    of_end, most = float(np.log10(ends + 1)), float(np.log10(tokens + distinct + 1))
    return both.select(
        "doc_id",
        (~learning(F.col("doc_id"))).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("_known", F.lit(0)) + int(ends > 0)).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("_logs", F.lit(0.0)) + of_end - F.col("n_tokens") * most).alias("base_score"),
        "score",
    )


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score() over all documents."""
    return score(table(spark, sf_dir, "documents"))
