"""A small causal self-attention language model over subword ids, trained and run in numpy.

Ids share embedding slots: the commonest have one each, the others a slot by remainder. The model predicts the class of the
next id from the last id and one attention head over a window; within a class, ids follow their smoothed counts in the corpus.
Classes below STARTS hold the ids that begin a word, and the end of a text; the others hold those that go on with one. Inside a
word a share of the probability follows the counts of all words with the same first ids, see lm.Prefixes. Probabilities of all
ids add up to one.

A text is laid out in blocks of BLOCK positions. The window of a block is the block before and itself, with a causal mask, so
windows overlap and each position is scored once, with BLOCK to 2 * BLOCK - 1 positions before it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BLOCK, DIM, CLASSES, STARTS, SLOTS, OWN = 16, 16, 64, 48, 4096, 3584
#: Ids whose neighbours are counted, and kinds of neighbours told apart.
COMMON, NEIGHBOURS = 2048, 128
#: Blocks that are worked on at a time, few enough for a processor's cache.
_CHUNK, _PART = 256, 128
_OFF = -1e4


@dataclass(frozen=True)
class Vocabulary:
    """For each id: its embedding slot, its class and log10 of its share of the class."""

    slot: np.ndarray
    kind: np.ndarray
    inside: np.ndarray


def slots_of(counts: np.ndarray) -> np.ndarray:
    order = np.argsort(-counts, kind="stable")
    slot = OWN + np.arange(len(counts)) % (SLOTS - OWN)
    slot[order[:OWN]] = np.arange(min(OWN, len(counts)))
    return slot.astype(np.int32)


def neighbours(counts: np.ndarray, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the table of how often the common ids stand beside which kinds of neighbours, and their counts: a row for each
    of COMMON ids, then NEIGHBOURS kinds before and as many after."""
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
    half = NEIGHBOURS // 2
    kind = np.where(rank < half, rank, half + np.arange(len(counts)) % half)
    if not len(sequences):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    flat, ends = np.concatenate(sequences), np.cumsum([len(s) for s in sequences])
    inside = np.ones(len(flat), bool)
    inside[ends[ends > 0] - 1] = False  # nothing follows a sequence's last id
    a, b = flat[:-1][inside[:-1]], flat[1:][inside[:-1]]
    total = np.zeros(COMMON * 2 * NEIGHBOURS, np.int64)
    for one, other, side in ((b, a, 0), (a, b, NEIGHBOURS)):
        keep = rank[one] < COMMON
        total += np.bincount(rank[one[keep]] * (2 * NEIGHBOURS) + side + kind[other[keep]], minlength=len(total))
    some = np.flatnonzero(total)
    return some, total[some]


def classes_of(counts: np.ndarray, starts: np.ndarray, table: np.ndarray, seed: int = 7, rounds: int = 12) -> np.ndarray:
    """Classes of ids that stand beside the same kinds of ids, by k-means over the rows of a table of neighbours, apart for ids that
    begin a word and others. Class 0 is the end of a text, the last id. Ids that the table lacks are dealt by remainder."""
    rng = np.random.default_rng(seed)
    order, end = np.argsort(-counts, kind="stable"), len(counts) - 1
    number = np.arange(len(counts))
    out = np.where(starts, 1 + number % (STARTS - 1), STARTS + number % (CLASSES - STARTS)).astype(np.int32)
    rows = table.reshape(COMMON, 2, NEIGHBOURS).astype(float)
    seen = rows.sum(axis=(1, 2))
    profile = np.sqrt(rows / np.maximum(rows.sum(axis=2, keepdims=True), 1)).reshape(COMMON, -1)
    ids = order[:COMMON]
    for first, many, own in ((1, STARTS - 1, starts), (STARTS, CLASSES - STARTS, ~starts)):
        known = np.flatnonzero((seen[: len(ids)] > 3) & own[ids] & (ids != end))
        if len(known) <= many:
            continue
        x, w = profile[known], np.sqrt(seen[known])
        centres = x[rng.choice(len(known), many, replace=False, p=w / w.sum())]
        near = np.zeros(len(known), np.int64)
        for _ in range(rounds):
            near = ((x**2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1)).argmin(axis=1)
            for k in range(many):
                mine = near == k
                centres[k] = np.average(x[mine], axis=0, weights=w[mine]) if mine.any() else x[rng.integers(len(x))]
        out[ids[known]] = first + near
    out[end] = 0
    return out


def vocabulary(counts: np.ndarray, kind: np.ndarray) -> Vocabulary:
    smooth = counts + 0.5
    total = np.bincount(kind, smooth, CLASSES)
    return Vocabulary(slots_of(counts), kind.astype(np.int32), np.log10(smooth / total[kind]).astype(np.float32))


def _layout(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of each text, and the place of its first position in the layout."""
    blocks = -(-lengths // BLOCK)
    return blocks, (np.cumsum(blocks) - blocks) * BLOCK


def _windows(rows: np.ndarray) -> np.ndarray:
    """(blocks, 2 * BLOCK, DIM) views of rows, which begin with the block before the first."""
    step = rows.strides[0]
    n = len(rows) // BLOCK - 1
    return np.lib.stride_tricks.as_strided(rows, (n, 2 * BLOCK, rows.shape[1]), (BLOCK * step, step, rows.strides[1]), writeable=False)


_DISTANCE = BLOCK + np.arange(BLOCK)[:, None] - np.arange(2 * BLOCK)
_CAUSAL = np.where(_DISTANCE >= 0, 0.0, _OFF).astype(np.float32)


#: Adds the columns of classes that begin a word, and all columns.
_SUMS = np.stack([np.arange(CLASSES) < STARTS, np.ones(CLASSES, bool)], axis=1).astype(np.float32)


def _exp(logits: np.ndarray) -> np.ndarray:
    np.minimum(logits, 50, out=logits)
    return np.exp(logits, out=logits)


class Model:
    """Weights, and what every slot asks, answers to and tells, side by side, so that a position fetches all three at once."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights
        self.maps = np.concatenate([weights["q"] * np.float32(1 / np.sqrt(DIM)), weights["k"], weights["v"]], axis=1)
        self.told = weights["e"] @ self.maps
        self.bias = weights["distance"][np.clip(_DISTANCE, 0, 2 * BLOCK - 1)] + _CAUSAL

    def attend(self, slots: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """slots: the block before and the blocks, flat; first: whether each block begins a text."""
        rows = self.told.take(slots, axis=0)
        q = rows[BLOCK:, :DIM].reshape(-1, BLOCK, DIM)
        windows = _windows(rows)
        k, v = windows[:, :, DIM : 2 * DIM], windows[:, :, 2 * DIM :]
        p = np.matmul(q, k.transpose(0, 2, 1))
        p += self.bias
        _exp(p)
        p[first, :, :BLOCK] = 0
        p /= (p.reshape(-1, 2 * BLOCK) @ np.ones(2 * BLOCK, np.float32)).reshape(-1, BLOCK, 1)
        h = np.matmul(p, v).reshape(-1, DIM)
        h += self.w["e"].take(slots[BLOCK:], axis=0)
        return q, k, v, p, h

    def classes(self, slots: np.ndarray, first: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of the class of the next id, and of any class that begins a word, for each position of the blocks."""
        logits = self.attend(slots, first)[-1] @ self.w["out"]
        logits += self.w["out_bias"]
        sums = _exp(logits) @ _SUMS
        picked = logits.ravel().take(np.arange(0, logits.size, CLASSES) + kinds)
        return picked / sums[:, 1], sums[:, 0] / sums[:, 1]


def score(model: Model, words: Vocabulary, ids: np.ndarray, lengths: np.ndarray, end: int, told: np.ndarray, free: np.ndarray) -> np.ndarray:
    """log10 probability of each text. ids: all texts' ids in turn, each ending in `end`, which is also what each begins after.

    told: for an id inside a word, what the words' counts give it; for one that begins a word, what they give the end of the
    word before. free: the share that they leave to the model. With 0 and 1 all is the model's.
    """
    blocks, at = _layout(lengths)
    total = int(blocks.sum())
    start = np.cumsum(lengths) - lengths
    place = np.arange(len(ids)) - np.repeat(start - at, lengths)
    given = np.full((total + 1) * BLOCK, end, np.int64)
    before = np.empty(len(ids), np.int64)
    before[1:] = ids[:-1]
    before[start] = end
    given[place + BLOCK] = before
    wanted, real = np.full(total * BLOCK, end, np.int64), np.zeros(total * BLOCK, bool)
    by_count, left = np.zeros(total * BLOCK, np.float32), np.ones(total * BLOCK, np.float32)
    wanted[place], real[place], by_count[place], left[place] = ids, True, told, free
    slots, kinds, shares = words.slot.take(given), words.kind.take(wanted), np.power(np.float32(10), words.inside).take(wanted)
    first = np.zeros(total, bool)
    first[at // BLOCK] = True
    out = np.empty(total, np.float64)
    for lo in range(0, total, _CHUNK):
        hi = min(total, lo + _CHUNK)
        span = slice(lo * BLOCK, hi * BLOCK)
        own, begins = model.classes(slots[lo * BLOCK : (hi + 1) * BLOCK], first[lo:hi], kinds[span])
        share = shares[span]
        word = kinds[span] < STARTS
        p = by_count[span] + left[span] * np.where(word, begins, own * share)
        p = np.where(word, p * own * share / np.maximum(begins, np.float32(1e-30)), p)
        logs = np.log10(np.maximum(p, np.float32(1e-37)), dtype=np.float32)
        out[lo:hi] = np.where(real[span], logs, 0).reshape(-1, BLOCK).sum(axis=1, dtype=np.float64)
    return np.add.reduceat(out, at // BLOCK) if total else np.zeros(0)


def begin(seed: int = 11) -> dict[str, np.ndarray]:
    """Weights before training."""
    rng, f32 = np.random.default_rng(seed), np.float32
    return {
        "e": rng.normal(0, 0.3, (SLOTS, DIM)).astype(f32),
        **{n: rng.normal(0, 0.3, (DIM, DIM)).astype(f32) for n in ("q", "k", "v")},
        "distance": np.zeros(2 * BLOCK, f32),
        "out": rng.normal(0, 0.3, (DIM, CLASSES)).astype(f32),
        "out_bias": np.zeros(CLASSES, f32),
    }


def packed(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[n].ravel() for n in sorted(w)])


def _parts(flat: np.ndarray) -> dict[str, np.ndarray]:
    """Views of the weights that are packed in a row."""
    like, out, at = begin(), {}, 0
    for n in sorted(like):
        out[n] = flat[at : at + like[n].size].reshape(like[n].shape)
        at += like[n].size
    return out


def unpacked(flat: np.ndarray) -> dict[str, np.ndarray]:
    return {n: x.astype(np.float32) for n, x in _parts(flat).items()}


def _add_gradient(model: Model, x: np.ndarray, first: np.ndarray, kinds: np.ndarray, weight: np.ndarray, g: dict[str, np.ndarray]) -> None:
    """Adds to g the gradient of the weighted loss of the positions of some blocks."""
    w, many = model.w, len(first)
    q, k, v, p, h = model.attend(x, first)
    d = h @ w["out"]
    d += w["out_bias"]
    d *= (weight / (_exp(d) @ np.ones(CLASSES, np.float32)))[:, None]
    d.ravel()[np.arange(0, d.size, CLASSES) + kinds] -= weight
    g["out"] += h.T @ d
    g["out_bias"] += np.ones(len(d), np.float32) @ d
    dh = d @ w["out"].T
    da, e = dh.reshape(-1, BLOCK, DIM), w["e"].take(x, axis=0)
    ds = np.matmul(da, v.transpose(0, 2, 1))
    h -= e[BLOCK:]  # what attention added
    ds -= np.einsum("nd,nd->n", dh, h).reshape(-1, BLOCK, 1)
    ds *= p
    g["distance"] += np.bincount(np.clip(_DISTANCE, 0, 2 * BLOCK - 1).ravel(), ds.sum(axis=0).ravel(), 2 * BLOCK)
    told = np.zeros((many + 1, BLOCK, 3 * DIM), np.float32)
    told[1:, :, :DIM] = np.matmul(ds, k)
    for at, part in ((DIM, np.matmul(ds.transpose(0, 2, 1), q)), (2 * DIM, np.matmul(p.transpose(0, 2, 1), da))):
        told[1:, :, at : at + DIM] = part[:, BLOCK:]
        told[:-1, :, at : at + DIM] += part[:, :BLOCK]
    told = told.reshape(-1, 3 * DIM)
    maps = e.T @ told
    for n, part in zip("qkv", np.split(maps, 3, axis=1), strict=True):
        g[n] += part * np.float32(1 / np.sqrt(DIM)) if n == "q" else part
    de = told @ model.maps.T
    de[BLOCK:] += dh
    np.add.at(g["e"].reshape(-1), (x[:, None] * np.intp(DIM) + np.arange(DIM)).ravel(), de.ravel())


def train(words: Vocabulary, sequences: list[np.ndarray], end: int, weights: dict[str, np.ndarray] | None = None, steps: int = 300, batch: int = 512, rate: float = 0.01, seed: int = 11) -> Model:
    """Adam on the mean loss of runs of blocks in random order, from `weights` on: each run once, or as often as makes about `steps`
    steps. A sequence is a text or a run of its ids; one that ends its text ends in `end`."""
    rng = np.random.default_rng(seed)
    f32 = np.float32
    fresh = weights is None
    w = dict(begin() if fresh else weights)
    lengths = np.array([len(s) for s in sequences], np.int64)
    if not len(lengths):
        return Model(w)
    blocks, at = _layout(lengths)
    total = int(blocks.sum())
    given, wanted, real = np.full((total + 1) * BLOCK, end, np.int32), np.full(total * BLOCK, end, np.int32), np.zeros(total * BLOCK, bool)
    flat, start = np.concatenate(sequences), np.cumsum(lengths) - lengths
    place = np.arange(len(flat)) - np.repeat(start - at, lengths)
    wanted[place], real[place] = flat, True
    begins = np.zeros(len(flat), bool)
    begins[start[lengths > 0]] = True
    given[place[1:] + BLOCK] = np.where(begins[1:], end, flat[:-1])
    slots, kinds = words.slot[given].astype(np.int16), words.kind[wanted]
    first = np.zeros(total, bool)
    first[at // BLOCK] = first[0] = True
    mean = np.bincount(kinds[real], minlength=CLASSES) + 1.0
    if fresh:
        w["out_bias"] = np.log(mean / mean.sum()).astype(f32)
    flat = packed(w)  # weights and what moves them, as parts of one row
    w, m, s2 = _parts(flat), np.zeros_like(flat), np.zeros_like(flat)
    gradient = np.empty_like(flat)
    g, buffer = _parts(gradient), np.empty_like(flat)
    starts = np.arange(0, total, batch)
    order = np.concatenate([rng.permutation(starts) for _ in range(max(1, round(steps / len(starts))))])
    steps = len(order)
    for step, lo in enumerate(order.tolist(), 1):
        hi = min(total, lo + batch)
        gradient[:] = 0
        model, many = Model(w), max(1, np.count_nonzero(real[lo * BLOCK : hi * BLOCK]))
        for a in range(lo, hi, _PART):
            b = min(hi, a + _PART)
            span = slice(a * BLOCK, b * BLOCK)
            _add_gradient(model, slots[a * BLOCK : (b + 1) * BLOCK], first[a:b], kinds[span], real[span] / f32(many), g)
        m *= f32(0.9)
        m += np.multiply(gradient, f32(0.1), out=buffer)
        s2 *= f32(0.99)
        np.multiply(gradient, gradient, out=buffer)
        s2 += np.multiply(buffer, f32(0.01), out=buffer)
        np.sqrt(np.divide(s2, f32(1 - 0.99**step), out=buffer), out=buffer)
        buffer += f32(1e-8)
        np.divide(m, buffer, out=buffer)
        move = f32(rate * min(1.0, 3 * (1 - step / (steps + 1))))
        flat -= np.multiply(buffer, move / f32(1 - 0.9**step), out=buffer)
    return Model(w)
