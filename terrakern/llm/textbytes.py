"""Whole columns of texts as numpy bytes, for functions that run inside mapInArrow tasks.

Texts lie one after the other in a buffer; all work is done over slices of bounded size, so that memory doesn't follow the
length of a batch. A text longer than a slice is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE = 1 << 21
_U = np.uint64
#: Bytes that part words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts that have at most `limit` bytes together, or are one text."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of a published generator)."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


_STEP, _UNSTEP = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_CODES = mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.empty(n + 1, _U), np.empty(n + 1, _U)
    up[0] = down[0] = 1
    up[1:], down[1:] = _U(_STEP), _U(_UNSTEP)
    return np.cumprod(up, out=up), np.cumprod(down, out=down)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word. offsets begin at 0 and end at len(data)."""
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, none
    inside = ~SPACE[data]
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    before[first] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[first[first > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word: a polynomial over random codes of its bytes, by differences of running sums."""
    size = 1 << max(16, int(len(data) + 1).bit_length())
    up, down = _powers(size)
    sums = np.empty(len(data) + 1, _U)
    sums[0] = 0
    np.cumsum(_CODES[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U) * _U(0xC2B2AE3D27D4EB4F))


def shingles(hashes: np.ndarray, text: np.ndarray, n_texts: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every run of k words within a text; of the whole sequence where a text has fewer."""
    total = len(hashes)
    if not total:
        return np.empty(0, _U), np.empty(0, np.int64)
    counts = np.bincount(text, minlength=n_texts)
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    h, have = np.zeros(total, _U), np.minimum(counts[text] - (np.arange(total) - first[text]), k)
    for j in range(k):
        reach = np.flatnonzero(have > j) if j else np.arange(total)
        h[reach] = mix(h[reach] * _U(0x9FB21C651E98DF25) + hashes[reach + j])
    whole = (have == k) | ((counts[text] < k) & (np.arange(total) == first[text]))
    return h[whole], text[whole]
