"""Benchmark decontamination by q-gram lemma filtering.

A string of L characters that is within e edits of a place in a text shares L + 1 - q - q * e of its q-grams with it, and all
of them lie on e + 1 neighbouring diagonals (place in the text less place in the string). The benchmark items are cut into
overlapping windows. Each text is hashed once, q-gram by q-gram; those that some item has are counted in overlapping bands
of diagonals, each twice as wide as a match can be. Bands under the bound are dropped, and the windows of the others are
verified by a banded alignment.

Characters are UTF-8 bytes here, case folded by Unicode on both sides and white space made blank: a passage in other case costs
no edits, a changed letter outside ASCII may count twice. Places found are mapped back to the text as it stands.
The items go to the tasks in blocks of at most BLOCK_BYTES, so what is broadcast is bounded whatever the benchmark's size. With one
block each text is judged where it is read, without a shuffle. With more, one pass over the texts holds them against a bit
filter of all items' q-grams, of fixed size, and the blocks are sought in the few that have enough of them close together.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrakern.llm import textbytes as tb
from terrakern.llm.common import cut, table

Q, WINDOW, STRIDE, EDITS = 10, 48, 16, 3
BLOCK_BYTES = 1 << 21
FILTER_BITS = 22
#: Bits of the filter of a benchmark of several blocks.
SIEVE_BITS = 27
CHUNK = 1 << 20
BLANKED = tb.LOWER.copy()
BLANKED[tb.SPACE] = 32
_U = np.uint64
_STEP = 0x9E3779B97F4A7C15


def _pieces(text: bytes) -> Iterator[str]:
    """A text in pieces of about CHUNK bytes, cut between characters."""
    at = 0
    while at < len(text):
        to = min(len(text), at + CHUNK)
        while to < len(text) and text[to] & 0xC0 == 0x80:
            to += 1
        yield text[at:to].decode("utf-8", "surrogateescape")
        at = to


def folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts (bytes and n + 1 offsets from 0) with case folded by Unicode and white space made blank, which may change their lengths."""
    if not (data > 127).any():
        return BLANKED[data], offsets
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        part = data[a:b]
        if (part > 127).any():
            part = np.frombuffer(b"".join(p.casefold().encode("utf-8", "surrogateescape") for p in _pieces(part.tobytes())), np.uint8)
        out.append(part)
    return BLANKED[np.concatenate(out)], np.concatenate(([0], np.cumsum([len(p) for p in out], dtype=np.int64)))


def span_of(text: np.ndarray, fold: np.ndarray, lo: int, hi: int) -> tuple[int, int]:
    """Code points of a text that bytes lo to hi of its folded form come from."""
    lo, hi = _code_points(fold[:lo]), _code_points(fold[:hi])
    if _code_points(text) == _code_points(fold):
        return lo, hi
    ends = np.cumsum([len(c.casefold()) for p in _pieces(text.tobytes()) for c in p])
    return int(np.searchsorted(ends, lo, "right")), int(np.searchsorted(ends, hi)) + 1 if hi else 0


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of data[i : i + Q] for each i, by doubling: of 2, 4 and 8 characters, then 8 and 2."""
    if len(data) < Q:
        return np.empty(0, _U)
    h = tb._CODES[data]
    size, known = 1, {1: h}
    while size * 2 <= Q:
        h = h[:-size] * _U(pow(_STEP, size, 1 << 64)) + h[size:]
        size *= 2
        known[size] = h
    at = size
    while at < Q:
        more = max(s for s in known if at + s <= Q)
        part = known[more][at:]
        n = min(len(h), len(part))
        h = h[:n] * _U(pow(_STEP, more, 1 << 64)) + part[:n]
        at += more
    return tb.mix(h)


class Items:
    """A block of benchmark items, ready for search."""

    def __init__(self, items: list[tuple[int, str]]):
        raw = [np.frombuffer(t.encode(), np.uint8) for _, t in items]
        data = [folded(d, np.array([0, len(d)]))[0] for d in raw]
        self.ids = [i for i, _ in items]
        self.data = data
        grams, item, place = [], [], []
        self.windows: list[np.ndarray] = []
        for n, d in enumerate(data):
            h = gram_hashes(d)
            grams.append(h)
            item.append(np.full(len(h), n))
            place.append(np.arange(len(h)))
            length = min(WINDOW, len(d))
            self.windows.append(np.unique(np.append(np.arange(0, len(d) - length + 1, STRIDE), len(d) - length)))
        grams, item, place = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (grams, item, place))
        order = np.argsort(grams, kind="stable")
        self.item, self.place = item[order], place[order]
        self.grams, self.first, self.many = np.unique(grams[order], return_index=True, return_counts=True)
        self.present = np.zeros(1 << FILTER_BITS, bool)
        self.present[(self.grams >> _U(64 - FILTER_BITS)).astype(np.int64)] = True

    def hits(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of grams in data that some item has, and the grams' numbers."""
        at, which = [], []
        for lo in range(0, max(0, len(data) - Q + 1), CHUNK):
            h = gram_hashes(data[lo : lo + CHUNK + Q - 1])
            some = np.flatnonzero(self.present[(h >> _U(64 - FILTER_BITS)).astype(np.int64)])
            n = np.minimum(np.searchsorted(self.grams, h[some]), len(self.grams) - 1)
            same = self.grams[n] == h[some]
            at.append(some[same] + lo)
            which.append(n[same])
        return (np.concatenate(at), np.concatenate(which)) if at else (np.empty(0, np.int64),) * 2


def _bound(length: int) -> tuple[int, int]:
    """Edits allowed in a window, and q-grams that it must share."""
    edits = max(0, min(EDITS, length * EDITS // WINDOW, (length - Q) // Q))
    return edits, length + 1 - Q - Q * edits


def aligned(data: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, window: np.ndarray, edits: int) -> np.ndarray:
    """Least edits between a window and any part of data that begins in at .. at + width, for each row.

    The band holds the diagonals that a match of so many edits can use. lo and hi bound the text of each row.
    """
    width = 2 * (edits + 1) + 2 * edits
    start = at - edits
    cost = np.zeros((len(at), width + 1), np.int16)
    cost[:, width] = 99
    columns = np.arange(width)
    for i in range(window.shape[1]):
        place = start[:, None] + i + columns
        inside = (place >= lo[:, None]) & (place < hi[:, None])
        differs = ~inside | (data[np.clip(place, 0, len(data) - 1)] != window[:, i : i + 1])
        cost[:, :width] = np.minimum(cost[:, :width] + differs, cost[:, 1:] + 1)
        for c in range(1, width):  # a character of the text that the window lacks
            np.minimum(cost[:, c], cost[:, c - 1] + 1, out=cost[:, c])
    return cost[:, :width].min(axis=1)


def find(items: Items, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
    """(text, item, windows matched, fewest edits, start, end) for each text and item that has a matching window; texts are folded()."""
    if not len(items.grams):
        return []
    at, gram = items.hits(data)
    text = np.searchsorted(offsets, at, "right") - 1
    inside = at + Q <= offsets[text + 1]
    at, gram, text = at[inside], gram[inside], text[inside]
    if not len(at):
        return []
    many = items.many[gram]
    row = np.repeat(np.arange(len(at)), many)
    entry = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(items.first[gram], many)
    item, place, text, at = items.item[entry], items.place[entry], text[row], at[row]
    half = EDITS + 1
    diagonal = at - place + (1 << 40)  # never below 0
    out: dict[tuple[int, int], list[int]] = {}
    for shift in (0, half):  # two families of bands, each of 2 * half diagonals
        band = (diagonal + shift) // (2 * half)
        order = np.lexsort((item, band))
        i, b, p = item[order], band[order], place[order]
        new = np.concatenate(([True], (i[1:] != i[:-1]) | (b[1:] != b[:-1])))
        group = np.cumsum(new) - 1
        enough = np.bincount(group)[group] >= min(_bound(min(WINDOW, len(d)))[1] for d in items.data if len(d) >= Q)
        i, b, p, t = i[enough], b[enough], p[enough], text[order][enough]
        # A band crosses texts at most where they meet; hits are told apart by text below.
        candidates = []
        key = np.stack([t, i, b]) if len(i) else np.empty((3, 0), np.int64)
        groups, inverse = np.unique(key, axis=1, return_inverse=True)
        inverse = inverse.ravel()
        by = np.argsort(inverse, kind="stable")
        cuts = np.searchsorted(inverse[by], np.arange(groups.shape[1] + 1))
        for g in range(groups.shape[1]):
            places = np.unique(p[by[cuts[g] : cuts[g + 1]]])
            n = int(groups[1, g])
            length = min(WINDOW, len(items.data[n]))
            edits, need = _bound(length)
            if len(places) < need:
                continue
            starts = items.windows[n]
            shared = np.searchsorted(places, starts + length - Q, "right") - np.searchsorted(places, starts)
            low = int(groups[2, g]) * 2 * half - shift - (1 << 40)
            candidates += [(int(groups[0, g]), n, int(s), length, edits, low) for s in starts[shared >= need]]
        for length, edits in {(c[3], c[4]) for c in candidates}:
            same = [c for c in candidates if (c[3], c[4]) == (length, edits)]
            for k in range(0, len(same), 4096):
                part = same[k : k + 4096]
                # A window of fewer edits than EDITS has a band as wide as the widest; it is searched in parts of its own width.
                window = np.stack([items.data[c[1]][c[2] : c[2] + length] for c in part])
                lo, hi = offsets[[c[0] for c in part]], offsets[[c[0] + 1 for c in part]]
                least = np.full(len(part), 99, np.int64)
                for step in range(0, 2 * half, 2 * (edits + 1)):
                    begin = np.array([c[5] + c[2] + step for c in part])
                    least = np.minimum(least, aligned(data, begin, lo, hi, window, edits))
                for c, e in zip(part, least.tolist(), strict=True):
                    if e <= edits:
                        start = max(int(offsets[c[0]]), c[5] + half + c[2])
                        found = out.setdefault((c[0], c[1]), [set(), 99, start, start])
                        found[0].add(c[2])
                        found[1:] = [min(found[1], e), min(found[2], start), max(found[3], min(start + length, int(offsets[c[0] + 1])))]
    return [(t, n, len(x[0]), x[1], x[2], x[3]) for (t, n), x in sorted(out.items())]


def blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most `limit` bytes (or of one item), read one after the other."""
    part, used = [], 0
    chosen = benchmark.where(F.col("text").isNotNull() & (F.octet_length("text") >= Q)).select("item_id", "text")
    for row in chosen.toLocalIterator():
        size = len(row["text"].encode())
        if part and used + size > limit:
            yield part
            part, used = [], 0
        part.append((row["item_id"], row["text"]))
        used += size
    if part:
        yield part


def _code_points(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


MATCHES = "doc_id long, item_id long, n_windows long, edits int, span_start long, span_end long"


def _sieve(benchmark: DataFrame, bits: int = SIEVE_BITS) -> np.ndarray:
    """2 ** bits bits, those of the items' q-grams set; more items only let more texts through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.texts(batch.column(0))
            for a, b in tb.slices(offsets):
                grams = gram_hashes(folded(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])[0]) >> _U(64 - bits)
                word, which = np.unique(grams >> _U(6), return_inverse=True)
                value = np.zeros(len(word), _U)
                np.bitwise_or.at(value, which, _U(1) << (grams & _U(63)))
                yield pa.record_batch([pa.array(word.astype(np.int64)), pa.array(value.view(np.int64))], ["word", "value"])

    rows = benchmark.where("text IS NOT NULL").select("text").mapInArrow(run, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[rows["word"].to_numpy()] = rows["value"].to_numpy()
    return out.view(_U)


def _sifted(docs: DataFrame, sieve: np.ndarray) -> DataFrame:
    """The rows of docs (doc_id, text) whose text has as many of the sieve's q-grams within a window's reach as a match needs."""
    shared = docs.sparkSession.sparkContext.broadcast(sieve)
    bits = int(len(sieve) * 64).bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bound = shared.value
        for batch in batches:
            data, offsets = tb.texts(batch.column(1))
            keep = np.zeros(batch.num_rows, bool)
            for a, b in tb.slices(offsets):
                fold, ends = folded(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for lo in range(0, max(0, len(fold) - Q + 1), CHUNK):  # pieces overlap by a window and what it may gain
                    h = gram_hashes(fold[lo : lo + CHUNK + WINDOW + EDITS + Q]) >> _U(64 - bits)
                    at = np.flatnonzero((bound[(h >> _U(6)).astype(np.int64)] >> (h & _U(63))) & _U(1)) + lo
                    text = np.searchsorted(ends, at, "right") - 1
                    for need, reach in {(_bound(n)[1], n + EDITS - Q) for n in range(Q, WINDOW + 1)}:
                        if len(at) >= need:
                            first, last = at[: len(at) - need + 1], at[need - 1 :]
                            close = (last - first <= reach) & (text[: len(first)] == text[need - 1 :])
                            keep[a + text[: len(first)][close]] = True
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each row of docs (doc_id, text, ...) and benchmark item (item_id, text, ...) of which it holds a window.

    n_windows counts the item's windows found, edits is the fewest over them, span_start and span_end bound them in code
    points, to within the edits allowed. A null or short text holds nothing; an item with fewer than Q bytes, or null, is
    in nothing; items of fewer bytes than WINDOW are one window. Repeated rows on either side each give rows. Whole texts
    are searched. Of windows found with equally few edits all count. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out, some = None, blocks(benchmark)
    first, second = next(some, None), next(some, None)
    if second is not None:
        docs = cut(_sifted(docs, _sieve(benchmark)))
    for block in chain([first] if first else [], [second] if second else [], some):
        shared = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = Items(shared.value)
            for batch in batches:
                data, offsets = tb.texts(batch.column(1))
                for a, b in tb.slices(offsets):
                    part, bounds = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                    fold, ends = folded(part, bounds)
                    rows = [
                        (batch.column(0)[a + t].as_py(), items.ids[n], many, edits, *span_of(part[bounds[t] : bounds[t + 1]], fold[ends[t] : ends[t + 1]], lo - ends[t], hi - ends[t]))
                        for t, n, many, edits, lo, hi in find(items, fold, ends)
                    ]
                    if rows:
                        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], MATCHES.replace(",", "").split()[::2])

        found = docs.mapInArrow(search, MATCHES)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], MATCHES)


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that hold no window of any item. A benchmark of one block is held against them
    where they are read; of a larger one the rows found are taken away by an anti-join on id and text."""
    spark, some = docs.sparkSession, blocks(benchmark)
    block, more = next(some, None), next(some, None)
    if block is None:
        return docs
    if more is not None:
        key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))
        names = [f"_in_{k}" for k in range(len(docs.columns))]
        found = leaks(docs.select(key.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("_key")).distinct()
        rows = docs.select(key.alias("_key"), *[F.col(c).alias(n) for c, n in zip(docs.columns, names, strict=True)])
        return rows.join(found, "_key", "left_anti").select(*names).toDF(*docs.columns)
    shared, place = spark.sparkContext.broadcast(block), docs.columns.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(shared.value)
        for batch in batches:
            data, offsets = tb.texts(batch.column(place))
            keep = np.ones(batch.num_rows, bool)
            for a, b in tb.slices(offsets):
                for t, *_ in find(items, *folded(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])):
                    keep[a + t] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(clean, docs.schema)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """leaks() of the whole benchmark in all documents."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
