"""The language model and the word base, against plain Python."""

import collections
import math
import re
import zlib

import numpy as np
import pytest

from terrakern.llm import attention, lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return re.sub("[A-Z]", lambda c: c[0].lower(), text or "")


def check_base(docs, rows):
    texts = collections.defaultdict(list)
    learn = []
    for r in docs.collect():
        held = zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 7 == 2
        words = WORD.findall(low(r.text))
        texts[r.doc_id].append((held, words))
        if not held:
            learn.append(words)
    count = collections.Counter(w for words in learn for w in words)
    total, distinct = sum(count.values()) + len(learn), len(count) + (len(learn) > 0)
    want = []
    for i, some in texts.items():
        for held, words in some:
            cs = [count[w] for w in words] + [len(learn)]
            want.append((str(i), held, len(cs), sum(c > 0 for c in cs), total, round(sum(math.log10((c + 1) / (total + distinct + 1)) for c in cs), 5)))
    got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in rows]
    assert sorted(got) == sorted(want)


EDGES = [(1, None, 0), (2, "", 0), (2, "A a B", 1), (None, "x y   z", 2), (4, "naïve Ünder   'tis don't ... 123abc", 3), (5, "w " * 3000 + "tail", 4), (9, "one", 5)]


def test_base_and_order(spark, monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 5)
    edges = spark.createDataFrame(EDGES, "doc_id long, text string, row long")
    first = lm.score(edges).collect()
    check_base(edges, first)
    assert all(np.isfinite(r.score) and r.score < 0 for r in first)
    assert lm.score(edges.limit(0)).count() == 0
    only_held = edges.where("doc_id = -1").unionByName(edges.selectExpr("CAST(9 AS BIGINT) AS doc_id", "text", "row"))
    check_base(only_held, lm.score(only_held).collect())


def test_small_table(spark):
    """Learning texts score above the base, held-out ones near it."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = lm.score(docs).collect()
    check_base(docs, rows)
    mean = {h: [sum(getattr(r, c) for r in rows if r.held_out == h) / sum(r.n_tokens for r in rows if r.held_out == h) for c in ("score", "base_score")] for h in (False, True)}
    assert mean[False][0] > mean[False][1]
    assert mean[True][0] > mean[True][1] - 0.2
    again = {r.doc_id: r.score for r in lm.score(docs.repartition(7)).collect()}
    assert again == pytest.approx({r.doc_id: r.score for r in rows}, rel=1e-3)


def test_prefixes_against_counts():
    """Every word's ids and end against dictionaries; what the counts give and leave adds up to one."""
    rng = np.random.default_rng(8)
    words = sorted({tuple(rng.integers(0, 6, rng.integers(1, 5)).tolist()) for _ in range(60)})
    heavy, light = words[::2], words[1::2]
    count = {w: int(rng.integers(1, 40)) for w in words}
    pairs, first = np.zeros((lm.COMMON, lm.COMMON + 1)), np.zeros(6)
    rank = np.array([0, 1, 2, 3, lm.COMMON + 1, lm.COMMON + 1])
    for w, c in count.items():
        first[w[0]] += c
        for a, b in zip(w, (*w[1:], None)):
            if rank[a] < lm.COMMON and (b is None or rank[b] < lm.COMMON):
                pairs[rank[a], lm.COMMON if b is None else rank[b]] += c
    flat = lambda some: (np.array([i for w in some for i in w]), np.concatenate(([0], np.cumsum([len(w) for w in some]))))
    ids, offsets = flat(heavy)
    p = lm.Prefixes(ids, offsets, np.array([count[w] for w in heavy], float), first, rank, pairs)

    def share(s, nxt):
        """(what the counts give to nxt after s, what they leave)."""
        through = sum(count[w] for w in heavy if w[: len(s)] == s)
        here = sum(count[w] for w in heavy if (w == s if nxt is None else w[: len(s) + 1] == (*s, nxt)))
        kinds = len({w[len(s)] if len(w) > len(s) else None for w in heavy if w[: len(s)] == s})
        escape = lm.DISCOUNT * kinds + (sum(count[w] for w in light if w[0] == s[0]) if len(s) == 1 else 0)
        given, left = (here / (through + escape), escape / (through + escape)) if through else (0.0, 1.0)
        row = pairs[rank[s[-1]]] if rank[s[-1]] < lm.COMMON else None
        if row is not None and row.sum():
            total = row.sum() + (row > 0).sum()
            column = lm.COMMON if nxt is None else rank[nxt]
            given, left = given + left * (row[column] / total if column <= lm.COMMON else 0), left * (row > 0).sum() / total
        return given, left

    given, left, stop, leaves = p.told(*flat(words))
    at = flat(words)[1]
    for k, w in enumerate(words):
        for j in range(1, len(w)):
            assert (given[at[k] + j], left[at[k] + j]) == pytest.approx(share(w[:j], w[j]), rel=1e-4)
        assert (stop[k], leaves[k]) == pytest.approx(share(w, None), rel=1e-4)
        assert sum(share(w, n)[0] for n in (None, *range(6))) + share(w, None)[1] == pytest.approx(1)


def test_windows_come_from_texts_of_every_length(spark):
    """Windows are spread over characters, not texts, and hold whole words of theirs."""
    vocabulary = open(lm.TOKENIZER, "rb").read()
    long, short = " ".join(f"long{i}" for i in range(60_000)), [f"short{i} " * 20 for i in range(300)]
    docs = spark.createDataFrame([(0, long), *((i + 1, t) for i, t in enumerate(short)), (None, None), (901, "")], "doc_id long, text string")
    docs = docs.selectExpr("doc_id", "coalesce(text, '') AS text")
    encoding, opens = lm._tokenizer(vocabulary)
    some = [encoding.decode([i for i in r.ids if i < len(opens) - 1]) for r in lm.windows(docs, 66_000, vocabulary).collect()]
    assert sum("long" in w for w in some) / len(some) > 0.8
    assert any("short" in w for w in some)
    whole = {f"long{i}" for i in range(60_000)} | {f"short{i}" for i in range(300)}
    assert all(w in whole for part in some for w in part.split())


def test_words_and_ids():
    import pyarrow as pa

    vocabulary = open(lm.TOKENIZER, "rb").read()
    encoding, _ = lm._tokenizer(vocabulary)
    texts = [t for _, t, _ in EDGES]
    b = lm.Batch(pa.array(texts))
    words = [w for t in texts for w in WORD.findall(low(t))]
    data, offsets = b.words(lead=False)
    distinct = [bytes(data[x:y]).decode() for x, y in zip(offsets, offsets[1:])]
    assert [distinct[k] for k in b.which] == words and len(set(distinct)) == len(distinct)
    assert dict(zip(distinct, b.many)) == collections.Counter(words)
    ids, at = lm.subwords(b.words(lead=True)[0].tobytes(), len(distinct), vocabulary)
    for k, w in enumerate(distinct):
        assert encoding.decode(ids[at[k] : at[k + 1]].tolist()) == " " + w


def plain_score(model, words, ids, end):
    """One position after the other."""
    w, total = model.w, 0.0
    given = [end, *ids[:-1]]
    for t, want in enumerate(ids):
        lo = max(0, (t // attention.BLOCK - 1) * attention.BLOCK)
        x = words.slot[given[lo : t + 1]]
        e = w["e"][x].astype(float)
        s = (e @ w["k"]) @ (e[-1] @ w["q"]) / math.sqrt(attention.DIM) + w["distance"][[t - k for k in range(lo, t + 1)]]
        p = np.exp(s) / np.exp(s).sum()
        logits = (e[-1] + p @ (e @ w["v"])) @ w["out"] + w["out_bias"]
        total += (logits[words.kind[want]] - np.log(np.exp(logits).sum())) / math.log(10) + words.inside[want]
    return total


def test_windows_score_each_position_once():
    rng = np.random.default_rng(5)
    size, end = 500, 499
    counts = rng.integers(0, 50, size).astype(float)
    kind = attention.classes_of(counts, rng.random(size) < 0.6, np.zeros(attention.COMMON * 2 * attention.NEIGHBOURS))
    assert kind[end] == 0 and (kind == 0).sum() == 1
    words = attention.vocabulary(counts, kind)
    share = np.bincount(kind, 10.0 ** words.inside.astype(float), attention.CLASSES)
    assert share[np.unique(kind)] == pytest.approx(1, abs=1e-4)
    texts = [np.append(rng.integers(0, size - 1, n), end) for n in (0, 1, 14, 15, 16, 17, 31, 32, 33, 100, 0, 250)]
    model = attention.train(words, texts, end, steps=20)
    flat = np.concatenate(texts)
    none, all_ = np.zeros(len(flat), np.float32), np.ones(len(flat), np.float32)
    got = attention.score(model, words, flat, np.array([len(t) for t in texts]), end, none, all_)
    assert got == pytest.approx([plain_score(model, words, t.tolist(), end) for t in texts], rel=1e-3, abs=1e-3)


def test_training_gradients():
    """A pattern that needs the attention: the id after `key` is the one that followed the last `key`."""
    rng = np.random.default_rng(6)
    end, texts = 60, []
    for _ in range(300):
        a = int(rng.integers(0, 20))
        texts.append(np.array([*([21, a] * 6), end]))
    counts = np.bincount(np.concatenate(texts), minlength=61).astype(float)
    kind = np.arange(61) % attention.CLASSES
    words = attention.vocabulary(counts, kind)
    model = attention.train(words, texts, end, steps=600, batch=64)
    lengths = np.array([len(t) for t in texts])
    flat = np.concatenate(texts)
    per_text = attention.score(model, words, flat, lengths, end, np.zeros(len(flat), np.float32), np.ones(len(flat), np.float32)).mean()
    again = attention.unpacked(attention.packed(model.w))
    assert all((again[n] == model.w[n]).all() for n in again)
    assert per_text > -3.5  # six guesses among twenty would cost 7.8


def test_every_id_of_the_learning_texts_is_trained_on(spark):
    """Windows are the texts, whole; a pass of training takes each block."""
    vocabulary = open(lm.TOKENIZER, "rb").read()
    texts = [" ".join(f"w{i * 7919 % 5003}" for i in range(n)) for n in (0, 1, 30, 700, 40_000)] + ["x" * 3000 + " tail"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = lm.windows(docs, sum(len(t.split()) + 1 for t in texts), vocabulary).collect()
    end = len(lm._tokenizer(vocabulary)[1]) - 1
    whole = [i for t in texts for i in (*lm._tokenizer(vocabulary)[0].encode_ordinary("".join(f" {w}" for w in t.split())), end)]
    assert sorted(i for r in rows for i in r.ids) == sorted(whole)


def test_a_pass_takes_each_block(monkeypatch):
    counts = np.ones(20)
    words = attention.vocabulary(counts, np.arange(20) % attention.CLASSES)
    seen = []
    attend = attention.Model.attend
    monkeypatch.setattr(attention.Model, "attend", lambda self, x, f: seen.append(len(f)) or attend(self, x, f))
    texts = [np.arange(16) % 19 for _ in range(100)]
    attention.train(words, texts, 19, steps=1, batch=8)
    assert sum(seen) == int(attention._layout(np.array([16] * 100))[0].sum())


def test_gradients_against_differences():
    """The gradient of parts of some blocks, added up, against differences of the loss; a slot's is gathered from all its places."""
    rng = np.random.default_rng(3)
    weights = {n: x.astype(np.float64).astype(np.float32) for n, x in attention.begin(4).items()}
    blocks, first = 6, np.array([True, False, False, True, False, False])
    x = rng.integers(0, 30, (blocks + 1) * attention.BLOCK).astype(np.int16)
    kinds, real = rng.integers(0, attention.CLASSES, blocks * attention.BLOCK), rng.random(blocks * attention.BLOCK) < 0.8
    weight = (real / real.sum()).astype(np.float32)

    def loss(w):
        logits = (attention.Model(w).attend(x, first)[-1] @ w["out"] + w["out_bias"]).astype(float)
        return float((weight * (np.log(np.exp(logits).sum(axis=1)) - logits[np.arange(len(kinds)), kinds])).sum())

    flat = np.zeros_like(attention.packed(weights))
    g = attention._parts(flat)
    for a, b in ((0, 3), (3, 5), (5, 6)):
        span = slice(a * attention.BLOCK, b * attention.BLOCK)
        attention._add_gradient(attention.Model(weights), x[a * attention.BLOCK : (b + 1) * attention.BLOCK], first[a:b], kinds[span], weight[span], g)
    for n in weights:
        way = rng.normal(size=weights[n].shape).astype(np.float32)
        moved = [loss(weights | {n: weights[n] + np.float32(step) * way}) for step in (2e-3, -2e-3)]
        assert (moved[0] - moved[1]) / 4e-3 == pytest.approx(float((g[n] * way).sum()), rel=0.03, abs=2e-3)
