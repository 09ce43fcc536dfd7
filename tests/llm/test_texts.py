"""The operators that read whole texts in Arrow batches, against plain Python."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrakern.llm import decontaminate, pii, quality
from terrakern.llm import textbytes as tb

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def random_text(rng, words):
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "é", "ing", "x"]) for _ in range(rng.randint(1, 4))) for _ in range(words))


def test_words_and_shingles():
    rng = random.Random(1)
    texts = [None, "", " ", "one", "\n one  two\t", "a b c d e", "a b c d e f g", "x y z w", *[random_text(rng, n) for n in (3, 50, 400)], "end"]
    data, offsets = tb.texts(pa.array(texts).slice(1))
    texts = texts[1:]
    assert [bytes(data[a:b]).decode() for a, b in zip(offsets, offsets[1:])] == [t or "" for t in texts]
    starts, ends, text = tb.word_spans(data, offsets)
    assert [(int(n), bytes(data[a:b]).decode()) for a, b, n in zip(starts, ends, text)] == [(n, w) for n, t in enumerate(texts) for w in WORD.findall(t or "")]
    h = tb.word_hashes(data, starts, ends)
    words = [bytes(data[a:b]) for a, b in zip(starts, ends)]
    assert len(set(h.tolist())) == len(set(words)) == len(set(zip(words, h.tolist())))
    s, owner = tb.shingles(h, text, len(texts), 5)
    by_text = [set(s[owner == n].tolist()) for n in range(len(texts))]
    plain = []
    for t in texts:
        w = WORD.findall(t or "")
        plain.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    assert [len(x) for x in by_text] == [len(x) for x in plain]
    assert len(by_text[4] & by_text[5]) == len(plain[4] & plain[5]) == 1


def pii_base(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


PII = [
    None,
    "",
    "é@b.c a@b.co@d.fr x@y @z.com me.you+1@mail-x.example.org.",
    "1.2.3.4.5 256.1.1.1 01.002.0003.4 12.34.56.78",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 5500000000000004",
    "+1 (555) 123-4567 +44.20.7946.0958 +12 +1-----2 ++33 1 23 45 67 89 ",
    "call 555-123-4567 or (212) 555-0147; ssn 078-05-1120; jane [at] site [dot] com; GB82WEST12345698765432",
    "a" * 30000 + "1" * 30000 + ".@" * 50,
]


def test_pii_base_spans(spark, small):
    fixture = spark.createDataFrame(list(enumerate(PII)) + [(4, PII[4])], "doc_id long, text string")
    for docs in (fixture, spark.read.parquet(f"{small}/documents.parquet")):
        texts = {r.doc_id: r.text or "" for r in docs.collect()}
        rows = pii.detect(docs).collect()
        assert len(rows) == docs.count()
        for r in rows:
            want = pii_base(texts[r.doc_id])
            joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
            assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), texts[r.doc_id][:200]
            assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(w[0] == k for w in want) for k in pii.BASE)
            assert r.spans.startswith(joined)
    assert pii.detect(fixture.limit(0)).count() == 0


def test_pii_estimates_reliabilities():
    """Two labelers that agree with the truth and one that votes at random: the posteriors follow the two."""
    rng, counts, truth = random.Random(2), {}, {}
    for _ in range(4000):
        true = rng.random() < 0.4
        good = [1 if (true if rng.random() < 0.95 else not true) else -1 for _ in range(3)]
        code = pii.encode(7, (1, 0, 0, 1), (good[0], good[1], good[2], 0, 0, rng.choice((-1, 1))))
        counts[code] = counts.get(code, 0) + 1
        truth.setdefault(code, []).append(true)
    p = pii.train(counts)
    right = sum(sum(t == (p[c] >= 0.5) for t in ts) for c, ts in truth.items())
    assert right / 4000 > 0.95
    assert pii.train({}) == {}
    for code in counts:
        assert pii.encode(*pii.decode(code)) == code


def test_pii_planted(spark):
    """Looser forms in their contexts are added; numbers of versions, parts and orders are not."""
    rng = random.Random(3)
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    rows, want = [], []
    for k in range(120):
        form = k % 3
        value = (f"{rng.choice('2345678')}{d(2)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}", f"({rng.randint(201, 989)}) {rng.randint(200, 999)}-{d(4)}", f"anna{k} [at] site{k} [dot] com")[form]
        lead = ("my ssn is ", "phone: ", "mail me: ")[form]
        rows.append((k, lead + value + " ok"))
        want.append((k, ("ssn", "phone_local", "email_spelled")[form], len(lead), len(lead) + len(value)))
    for k in range(120, 240):
        rows.append((k, (f"version {d(3)}-{d(2)}-{d(4)}", f"part {d(16)} in stock", f"order ref 000-{d(2)}-0000x")[k % 3]))
    docs = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, codes string, kinds int")
    got = {r.doc_id: r.spans.split(",") for r in pii.detect(docs).collect()}
    assert sum(f"{kind}:{a}:{b}" in got[i] for i, kind, a, b in want) / len(want) >= 0.9
    assert sum(any(s and s.split(":")[0] in pii.LOOSE for s in got[i]) for i in range(120, 240)) <= 6


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality.rate(docs, labels).collect()}
    assert len(got) == docs.count()
    right = [(got[r.doc_id].predicted == r.quality) for r in labels.collect() if r.doc_id in got and got[r.doc_id].held_out]
    assert len(right) > 50 and sum(right) / len(right) >= 0.95
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def plain_features(text):
    """FEATURES of a text, byte by byte and word by word."""
    data = (text or "").encode()
    out = [0.0] * len(quality.FEATURES)
    if not data:
        return out

    def kind(b):
        if b in b" \t\n\v\f\r":
            return "space"
        if 97 <= b < 123:
            return "lower"
        if 65 <= b < 91:
            return "upper"
        if 48 <= b < 58:
            return "digit"
        if chr(b) in ".,;:'\"-?()":
            return "stop"
        return "shout" if b == 33 else "bar" if b == 124 else "beyond" if b >= 128 else "mark" if b > 32 else "control"

    for b in data:
        out[quality.FEATURES.index(kind(b))] += 1 / len(data)
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    out[10] = math.log1p(len(data)) / 10
    if words:
        n = len(words)
        out[11:] = [
            sum(map(len, words)) / n / 10, math.log1p(n) / 10, sum(a == b for a, b in zip(words, words[1:])) / n, len(set(words)) / n,
            sum(kind(w[-1]) in ("mark", "shout") for w in words) / n, sum(kind(w[0]) == "upper" for w in words) / n, math.log1p(max(map(len, words))) / 10,
        ]
    return out


def test_quality_scores_against_plain_python(spark):
    """Features by hand, and scores from the fitted weights by hand."""
    texts = [None, "", " \n", "A b b C! naïve (x) 12|#$%& end.", "one", "\x01 x" * 50, "Wort für Wort, Zeile für Zeile. " * 30]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = quality.with_features(docs, {"doc_id": "doc_id"}).collect()
    for r in rows:
        assert list(r.f) == pytest.approx(plain_features(texts[r.doc_id]), abs=1e-6)
    rng = np.random.default_rng(4)
    n = len(quality.FEATURES)
    model = quality.fit(rng.normal(0.5, 0.2, (60, n)), rng.normal(0.4, 0.3, (90, n)), steps=50)
    scored = quality.with_features(docs, {"doc_id": "doc_id"}).select("f", model.score(F.col("f")).alias("s")).collect()
    for r in scored:
        raw = model.bias + sum(x * (model.weights[i] + x * model.weights[n + i]) for i, x in enumerate(r.f))
        assert r.s == pytest.approx(1 / (1 + math.exp(-raw)), rel=1e-6)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "", "y"), (1, "a b", "x")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.rate(docs, none).collect()] == [0.5] * 3
    assert quality.rate(docs.limit(0), none).count() == 0
    kept = quality.accepted(docs, none)
    assert kept.columns == docs.columns and kept.count() == 3


def edit_within(item, text):
    """Least edits between the item and any part of the text."""
    row = np.zeros(len(text) + 1, int)
    for i, c in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        for j, d in enumerate(text, 1):
            new[j] = min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1)
        row = new
    return row.min()


def test_leaks_against_alignment(spark):
    rng = random.Random(3)
    items = [(i, random_text(rng, n)) for i, n in enumerate([30, 9, 12, 40])] + [(9, None), (10, ""), (11, "short"), (12, "exactly ten plus")]
    docs = []
    for i in range(60):
        body = random_text(rng, rng.randint(0, 40))
        kind = i % 6
        if kind:
            passage = list(rng.choice(items[:4])[1])
            for _ in range({1: 0, 2: 1, 3: 3, 4: 12, 5: 2}[kind]):
                at = rng.randrange(len(passage))
                passage[at : at + rng.randint(0, 1)] = rng.choice(["", "q", "z"])
            passage = "".join(passage)
            if kind == 5:
                passage = passage.upper().replace("É", "é").replace(" ", "\n")
            body = body + " " + passage + " " + random_text(rng, rng.randint(0, 20))
        docs.append((i, body))
    docs += [(100, None), (101, ""), (102, "exactly  ten plus"), (103, "Exactly ten plus")]
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    flat = lambda t: bytes(decontaminate.BLANKED[np.frombuffer((t or "").encode(), np.uint8)])
    want = set()
    for d, text in docs:
        for n, item in items:
            whole, body = flat(item), flat(text)
            if len(whole) < decontaminate.Q or not body:
                continue
            length = min(decontaminate.WINDOW, len(whole))
            starts = {*range(0, len(whole) - length + 1, decontaminate.STRIDE), len(whole) - length}
            if any(edit_within(whole[s : s + length], body) <= decontaminate._bound(length)[0] for s in starts):
                want.add((d, n))
    assert found == want and len(want) > 25
    clean = decontaminate.without_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(r.doc_id for r in clean.collect()) == sorted({d for d, _ in docs} - {d for d, _ in want})


def test_leaks_edges(spark):
    docs = spark.createDataFrame([(1, "the same ten words here again and again for a whole window ok", "a")] * 2, "doc_id long, text string, item_id string")
    item = spark.createDataFrame([(5, "the same ten words here again and again for a whole window ok")] * 2, "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.edits) for r in decontaminate.leaks(docs, item).collect()] == [(1, 5, 0)] * 4
    assert decontaminate.leaks(docs, item.limit(0)).count() == 0
    assert decontaminate.leaks(docs.limit(0), item).count() == 0
    assert [len(b) for b in decontaminate.blocks(item, 70)] == [1, 1]
    with pytest.raises(Exception):
        decontaminate.leaks(docs, item.drop("text"))


def test_leaks_in_other_case(spark):
    """Upper-cased accented passages cost no edits, whatever letters unfold to; spans are places in the text as it stands."""
    passage = "où étaient passés les élèves très âgés de l'école près du château brûlé où le maïs né l'été a gelé à Noël"
    heavy = "größte Straße, weiße Füße, süße Soße, heiße Grüße: dreißig müßige Schöße büßen draußen für große Späße"
    items = spark.createDataFrame([(1, passage), (2, heavy)], "item_id long, text string")
    docs = [(1, "Straße " + passage.upper() + " fin"), (2, "ß x " + heavy.upper() + " ende"), (3, "rien de tout cela n'est dans ce texte, même en majuscules ÉÈÀ"), (4, passage)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(frame, items).collect()}
    assert {k: r.edits for k, r in rows.items()} == {(1, 1): 0, (2, 2): 0, (4, 1): 0}
    windows = {n: len(decontaminate.Items([(n, t)]).windows[0]) for n, t in ((1, passage), (2, heavy))}
    assert all(r.n_windows == windows[item] for (_, item), r in rows.items())
    for (doc, item), start, length in (((1, 1), 7, len(passage.upper())), ((2, 2), 4, len(heavy.upper())), ((4, 1), 0, len(passage))):
        r = rows[doc, item]
        assert abs(r.span_start - start) <= 4 and abs(r.span_end - start - length) <= 4
    assert [r.doc_id for r in decontaminate.without_leaks(frame, items).collect()] == [3]


def test_benchmark_of_several_blocks(spark, monkeypatch):
    """A benchmark that goes out in many blocks finds what it finds in one, and the same rows stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    benchmark = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    short = spark.createDataFrame([(10_000, "tiny item here"), (10_001, None), (10_002, "x")], "item_id long, text string")
    benchmark = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").unionByName(short)
    docs = docs.unionByName(spark.createDataFrame([(None, "a TINY item here too", "en", None, 1), (None, None, "en", None, 1)], docs.schema)).withColumn("_key", F.lit("clash"))
    limits = decontaminate.blocks.__defaults__
    rows = lambda: sorted(map(str, decontaminate.leaks(docs, benchmark).drop("span_start", "span_end").collect()))  # noqa: E731  spans hold to within the edits
    want = rows()
    stay = sorted(map(str, decontaminate.without_leaks(docs, benchmark).collect()))
    monkeypatch.setattr(decontaminate.blocks, "__defaults__", (1_500,))
    assert sum(1 for _ in decontaminate.blocks(benchmark)) > 2 and limits != (1_500,)
    assert rows() == want
    assert sorted(map(str, decontaminate.without_leaks(docs, benchmark).collect())) == stay
    assert len(want) > 10 and any("item_id=10000" in w for w in want) and len(stay) < docs.count()
