"""Runs against a search of all periods, word by word."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np

from terrakern.llm import periodic


def slow_runs(words):
    n, found = len(words), {}
    for p in range(1, n // 4 + 1):
        at = 0
        while at + p < n:
            end = at
            while end + p < n and words[end] == words[end + p]:
                end += 1
            if end > at and end + p - at >= max(6, 4 * p):
                found.setdefault((at, end + p), p)
            at = max(end, at) + 1
    return sorted(((s, e - s, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


def slow_collapsed(words, found):
    gone = {i for s, length, p in found for i in range(s + p, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def slow_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32((str(doc_id) if doc_id is not None else "").encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = slow_runs(words)
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    lines = "".join(f"{s},{length},{p}\n" for s, length, p in found)
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(lines), sha(slow_collapsed(words, found)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_runs_of_drawn_sequences():
    draw = random.Random(5)
    for _ in range(1500):
        n = draw.randint(0, 60)
        words = [draw.randint(0, draw.choice([0, 1, 1, 3])) for _ in range(n)]
        if draw.random() < 0.6 and n > 8:
            a, p = draw.randrange(n // 2), draw.randint(1, 9)
            words[a:] = [words[a + i % p] if a + i % p < n else 9 for i in range(n - a)]
            if draw.random() < 0.5:
                words[draw.randrange(n)] = 8
        found = periodic.runs(np.array(words, np.int64))
        assert [tuple(r) for r in found.tolist()] == slow_runs(words), words
        assert np.array_equal(np.flatnonzero(~periodic.kept(n, found)), sorted({i for s, m, p in found.tolist() for i in range(s + p, s + m)}))


def test_grid_in_blocks_finds_the_same(monkeypatch):
    words = np.array(([1, 2, 3] * 40 + [5] * 30 + list(range(20))) * 5, np.int64)
    whole = periodic.runs(words)
    monkeypatch.setattr(periodic, "GRID", 64)
    assert np.array_equal(whole, periodic.runs(words)) and [tuple(r) for r in whole.tolist()] == slow_runs(words.tolist())


def test_extensions():
    draw = np.random.default_rng(2)
    for n in (1, 2, 7, 40):
        ids = draw.integers(0, 2, n)
        ahead = periodic.Extensions(ids)
        i, j = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(n)))
        i, j = i[i != j], j[i != j]
        want = [next((k for k in range(n) if max(a, b) + k >= n or ids[a + k] != ids[b + k]), n) for a, b in zip(i, j, strict=True)]
        assert ahead.common(i, j).tolist() == want if len(i) else True


def test_all_documents(spark, small, tmp_path):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{small}/documents.parquet'").fetchall()
    got = sorted(map(tuple, periodic.op12_runs(spark, small).select(*COLUMNS).collect()))
    assert got == sorted(slow_row(*r) for r in rows) and any(r[1] for r in got)


def test_null_empty_blank_repeated_and_long_texts(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a b " * 9), (None, "a b " * 9), (5, "x " * 40_000), (6, "é a é a " * 4), (64, "one"), (7, "a a a a a a b")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, runs int")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in periodic.op12_runs(spark, str(tmp_path)).select(*COLUMNS).collect()]
    assert sorted((g for g in got if g[0] != 5), key=str) == sorted((slow_row(*r) for r in rows if r[0] != 5), key=str)
    assert [g[1:5] for g in got if g[0] == 5] == [(1, 0, 40_000, 1)]
    assert not periodic.periodic_runs(df.where("doc_id < 0")).count()
