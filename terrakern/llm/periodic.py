"""Runs of repeated word sequences in texts: maximal stretches with a period of at most a quarter of their length.

For each period p the words at jp and (j+1)p are held against each other, a harmonic number of places in all. A run of four periods
covers four such places, so only those with three equal neighbours in a row are looked at: how far both sides agree onwards and
backwards (the longest common extension, by suffix array, the array of the reversed words, and range minima of their common
prefixes) is the run with period p. A stretch found with several periods keeps the smallest.

Each text is a unit of work inside a task that reads its part of the table; nothing is shuffled. Memory follows the longest text: some
hundred bytes for each of its words times the logarithm of their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrakern.llm import textbytes
from terrakern.llm.common import WORD, id_text_crc, table

#: A run has this many words and this many periods at the least.
LEAST, TIMES = 6, 4
#: Places of the grid that are looked at in one go.
GRID = 1 << 20
RUNS = "array<struct<start: long, length: long, period: long>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class Extensions:
    """How many words two suffixes of a sequence have in common."""

    def __init__(self, ids: np.ndarray) -> None:
        n = self.n = len(ids)
        rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
        levels, reach = [rank.astype(np.int32)], 1
        order = np.argsort(rank, kind="stable")
        while rank[order[-1]] < n - 1:  # until all suffixes differ: twice as many words each turn
            key = rank * (n + 1)
            key[: n - reach] += rank[reach:] + 1
            order = np.argsort(key, kind="stable")
            new = np.cumsum(np.concatenate(([0], (key[order][1:] != key[order][:-1]).astype(np.int64))))
            rank = np.empty(n, np.int64)
            rank[order] = new
            levels.append(rank.astype(np.int32))
            reach *= 2
        self.rank = rank
        a, b, common = order[:-1].copy(), order[1:].copy(), np.zeros(n, np.int32)
        for k in range(len(levels) - 1, -1, -1):  # neighbours in order share 2**k words where their ranks by 2**k words are one
            within = np.flatnonzero((a + (1 << k) <= n) & (b + (1 << k) <= n))
            within = within[levels[k][a[within]] == levels[k][b[within]]]
            a[within] += 1 << k
            b[within] += 1 << k
            common[within + 1] += 1 << k
        self.least = [common]
        while (1 << len(self.least)) <= n:
            low, half = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(low[:-half], low[half:]))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of the suffixes from i and from j, other places than i."""
        low, high = np.minimum(self.rank[i], self.rank[j]) + 1, np.maximum(self.rank[i], self.rank[j]) + 1
        power, out = np.frexp((high - low).astype(np.float64))[1] - 1, np.empty(len(low), np.int64)
        for k in np.unique(power):
            at = np.flatnonzero(power == k)
            out[at] = np.minimum(self.least[k][low[at]], self.least[k][high[at] - (1 << k)])
        return out


def _grid(ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of the grid that four equal places begin, period by period in blocks."""
    n = len(ids)
    period = np.arange(1, (n - 1) // 3 + 1)
    many = (n - 1) // period - 2
    ends = np.cumsum(many)
    first = 0
    while first < len(period):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + GRID, "right")))
        p, m = period[first:last], many[first:last]
        p, at = np.repeat(p, m), np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        at *= p
        for step in (1, 2, 3):
            same = np.flatnonzero(ids[at] == ids[at + step * p])
            p, at = p[same], at[same]
        yield at, p
        first = last


def runs(ids: np.ndarray) -> np.ndarray:
    """(start, length, period) of each run of a sequence of numbers, by start, then period."""
    found, n = [np.empty((0, 3), np.int64)], len(ids)
    ahead = back = None
    for at, p in _grid(ids) if n >= LEAST else ():
        if not len(at):
            continue
        ahead, back = ahead or Extensions(ids), back or Extensions(ids[::-1])
        end = at + p + ahead.common(at, at + p)
        start, inner = at.copy(), np.flatnonzero(at)
        start[inner] -= back.common(n - at[inner], n - at[inner] - p[inner])
        long = end - start >= np.maximum(LEAST, TIMES * p)
        found.append(np.unique(np.stack([start, end - start, p], 1)[long], axis=0))
    found = np.concatenate(found)
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
    found = found[new]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def kept(n: int, found: np.ndarray) -> np.ndarray:
    """Which words stay when each run keeps its first period alone."""
    turns = np.zeros(n + 1, np.int64)
    np.add.at(turns, found[:, 0] + found[:, 2], 1)
    np.add.at(turns, found[:, 0] + found[:, 1], -1)
    return np.cumsum(turns)[:n] == 0


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = textbytes.texts(batch.column("text"))
        for lo, hi in textbytes.slices(offsets):
            counts, ends, rows, texts = [], [0], [], []
            for k in range(lo, hi):
                words = data[offsets[k] : offsets[k + 1]].tobytes().split()  # bytes are parted at the same six characters
                counts.append(len(words))
                number: dict[bytes, int] = {}
                found = runs(np.fromiter((number.setdefault(w, i) for i, w in enumerate(words)), np.int64, len(words)))
                if len(found):
                    words = [words[i] for i in np.flatnonzero(kept(len(words), found))]
                ends.append(ends[-1] + len(found))
                rows.append(found)
                texts.append(b" ".join(words))
            flat = np.concatenate(rows) if rows else np.empty((0, 3), np.int64)
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, c].copy()) for c in range(3)], fields=list(_RUN)))
            ids = batch.column("doc_id").slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64()), listed, pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs and collapsed of every row of docs (doc_id, text, ...).

    runs lists (start, length, period) by start, then period: stretches of words with a smallest period, of at least six words and
    four periods, that no neighbouring word extends. collapsed has the words that no run repeats, joined by one space. A null, empty or
    blank text has no words and an empty collapsed text. Whole texts are searched, however long; rows that repeat or lack an id each
    give a row; further columns of docs, whatever their names, are left out; an empty table gives an empty one.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_searched, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def with_planted(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) in which a tenth, by h = crc32(doc_id), end in a repeated stretch: with g = h // 10, each of the n words from
    a = g % n on is word a + (i - a) % p instead, p being 1 + (n - a) // (3 + g % 8)."""
    h = id_text_crc(F.col("doc_id"))

    def repeated(pair: Column) -> Column:
        words, n = pair["words"], F.size(pair["words"]).cast("long")
        a = pair["g"] % n
        p = F.lit(1) + F.floor((n - a) / (3 + pair["g"] % 8))
        whole = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
        return F.array_join(whole, " ")

    parts = F.struct(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"), F.floor(h / 10).alias("g"))
    planted = F.get(F.transform(F.filter(F.array(parts), lambda x: F.size(x["words"]) > 0), repeated), F.lit(0))
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text", F.coalesce(F.when(h % 10 == 0, planted), F.col("text")))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of all documents, a tenth of which have one planted."""
    found = periodic_runs(with_planted(table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("shorter"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
    found = found.withColumn("_long", longest)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_long.before")).alias("start"), F.col("_long.length").alias("length"), (-F.col("_long.shorter")).alias("period"),
        F.expr("1000 * _long.length DIV -_long.shorter").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )
