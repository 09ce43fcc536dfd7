"""The similarity joins and their components, against all pairs."""

import random
import re

import pytest

from terrakern.llm import jaccard
from terrakern.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def reach(nodes, links):
    """Least member of each node's component."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    shapes = [
        [],
        [(1, 1)],
        [(2, 1), (1, 2), (2, 1)],
        [(i, i + 1) for i in range(200)],
        [(0, i) for i in range(1, 300)],
        [(7, i) for i in range(50)] + [(1000, 1000 + i) for i in range(50)] + [(1020, 3)],
        [(rng.randrange(300), rng.randrange(300)) for _ in range(170)],
    ]
    for links in shapes:
        df = spark.createDataFrame(links, "a long, b long")
        want = reach({n for e in links for n in e}, links)
        got = {r.node: r.component for r in components(df).collect()}
        assert got == {n: c for n, c in want.items() if n != c}
    assert components(spark.createDataFrame([(None, 1), (2, None)], "a long, b long")).count() == 0


def sets_of(texts):
    out = {}
    for i, t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda c: c[0].lower(), t or ""))
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def brute(texts):
    sets = sets_of(texts)
    by_gram = {}
    for i, s in sets.items():
        for g in s:
            by_gram.setdefault(g, []).append(i)
    pairs = {(a, b) for some in by_gram.values() for a in some for b in some if a < b}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return sets, reach(sets, links)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        at = rng.randrange(len(words))
        words[at : at + rng.randint(0, 1)] = [f"e{rng.randrange(10**6)}"]
    return words


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_groups(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)]
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for _ in range(40):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 160))]
        words = words + passage if rng.random() < 0.5 else words
        for _ in range(rng.randint(1, 5)):
            texts.append(edited(rng, words, rng.choice([0, 0, 1, 2, 3, 6])))
    chain = [f"c{i}" for i in range(120)]
    for _ in range(12):
        chain = edited(rng, chain, 2)
        texts.append(chain)
    base = [f"b{i}" for i in range(200)]
    texts += [edited(rng, base, rng.choice([0, 1, 2, 5])) for _ in range(60)]
    texts = [" ".join(t) for t in texts] + [None, "", " \n", "A b", "a B", "a b c d e", "A  B\tC d e"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    sets, want = brute(rows)
    got = {r.doc_id: r for r in jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r.component_id for i, r in got.items()} == want


def test_jaccard_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets, want = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: r for r in jaccard.groups(docs).collect()}
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert len(set(want.values())) < len(want)


def test_jaccard_edges(spark):
    rows = [(None, "a b c", 1), (None, "x y z", 2), (7, "a b c", 3), (7, "", 4), (8, None, 5), (9, None, 6)]
    got = jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string, cls int")).collect()
    assert sorted(((r.doc_id or -1), r.n_shingles, r.component_id or -1) for r in got) == [(-1, 1, -1), (-1, 1, 7), (7, 0, 7), (7, 1, 7), (8, 0, 8), (9, 0, 9)]
    assert jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string, cls int").limit(0)).count() == 0


def test_products_of_tiles():
    """Overlaps by matrices and by pairs of entries, against sets."""
    import numpy as np

    rng = np.random.default_rng(2)
    a, b = (rng.random((n, 400)) < np.r_[np.full(40, 0.9), np.full(360, 0.02)] for n in (130, 70))
    got = jaccard._overlaps(*np.nonzero(a), *np.nonzero(b), (130, 70))
    assert (got == a.astype(int) @ b.T.astype(int)).all()
    none = np.empty(0, np.int64)
    assert (jaccard._overlaps(none, none, *np.nonzero(b), (3, 70)) == 0).all()


@pytest.mark.parametrize("sizes", [(3, 4, 64), (9, 2048, 1 << 20)])
def test_jaccard_groups_in_tiles(spark, monkeypatch, sizes):
    """Near copies without their original, in crowded columns and several tiles: each link is found, no other is made."""
    for name, value in zip(("CROWD", "TILE_ROWS", "TILE_ENTRIES"), sizes, strict=True):
        monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(11)
    base = [f"b{i}" for i in range(150)]
    texts = [" ".join(edited(rng, base, rng.choice([2, 3, 4, 6, 8]))) for _ in range(90)]
    other = base[:60] + [f"o{i}" for i in range(40)]
    texts += [" ".join(edited(rng, other, rng.choice([1, 2, 3]))) for _ in range(40)]
    rows = list(enumerate(texts))
    _, want = brute(rows)
    got = {r.doc_id: r.component_id for r in jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == want and 3 < len(set(want.values())) < len(want)


def test_representatives_keep_documents_apart(spark):
    """One row of each group; ids that repeat over different texts, missing ids, blanks and clashing columns."""
    rows = [
        (5, "a b c d e f g h", "first"), (5, "x y z u v w", "other"), (5, "a b c d e f g h", "again"), (3, "A B C D E F G H", "least"), (9, "x y z u v w", "copy"),
        (None, "p q r s t", "no id"), (None, "P q r s t", "no id either"), (7, None, "null"), (7, "", "empty"), (2**63 - 1, "m n", "great"), (-(2**63), "k l", "low"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _copy string")
    kept = [r._copy for r in jaccard.representatives(docs).collect()]
    assert sorted(k for k in kept if k not in ("no id", "no id either")) == ["empty", "great", "least", "low", "null", "other"]
    assert len(kept) == 7 and jaccard.representatives(docs).columns == docs.columns
    assert jaccard.representatives(docs.limit(0)).count() == 0
    assert sorted(r.component_id for r in jaccard.groups(docs.where("_copy IN ('low', 'great')")).collect()) == [-(2**63), 2**63 - 1]


def vectors_brute(rows):
    import numpy as np

    good = {}
    for n, (_, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[n] = np.array(v, np.float32).astype(float)
    links = [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= 0.9]
    root = reach(range(len(rows)), links)
    least = {}
    for n, r in root.items():
        if rows[n][0] is not None:
            least[r] = min(least.get(r, rows[n][0]), rows[n][0])
    degree = [0] * len(rows)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    return sorted((str(rows[n][0]), degree[n], str(least.get(root[n]) if n in good else rows[n][0])) for n in range(len(rows)))


@pytest.mark.parametrize("block", [4096, 32])
def test_near_duplicates(spark, monkeypatch, block):
    import numpy as np

    from terrakern.llm import neardup

    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(30):
        base = rng.normal(size=8)
        rows += [base + rng.normal(size=8) * s for s in rng.choice([0.0, 0.1, 0.2, 0.4], rng.integers(1, 6))]
    hot = rng.normal(size=8)
    rows += [hot + rng.normal(size=8) * 0.02 for _ in range(80)] + [hot] * 20 + [2 * hot]
    rows += [np.cos(t) * np.eye(8)[0] + np.sin(t) * np.eye(8)[1] for t in np.linspace(0, 2, 15)]
    rows = [(int(i), [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]
    rows += [(900, None), (901, []), (902, [0.0] * 8), (903, [1.0, None] + [0.0] * 6), (904, [float("nan")] * 8), (905, [float("inf")] * 8), (906, [1.0, 2.0]), (907, [2.0, 4.1]), (3, rows[3][1]), (None, rows[5][1]), (None, [9.0] * 8)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, cls int, n int")
    got = neardup.near_duplicates(df).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == vectors_brute(rows)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_dealt_vectors_grow_with_the_table(spark, monkeypatch):
    """Ten times the vectors in ten times the clusters, a pivot in each: about ten times the rows are dealt to tasks."""
    import numpy as np

    from terrakern.llm import neardup

    monkeypatch.setattr(neardup, "BLOCK", 64)
    rng = np.random.default_rng(12)
    dealt = []
    for clusters in (8, 80):
        centres = rng.normal(size=(clusters, 24))
        v = np.repeat(centres, 64, axis=0) + rng.normal(size=(clusters * 64, 24)) * 0.03
        df = spark.createDataFrame([(i, 1, x.tolist()) for i, x in enumerate(v)], "cls long, many long, v array<float>")
        pivots = v[::64]
        cells = neardup.Cells(pivots / np.linalg.norm(pivots, axis=1, keepdims=True), 0.9)
        cells = neardup._survey(df, neardup._survey(df, cells, 24), 24)
        dealt.append(neardup._deal(df, cells, 24).count())
    assert 64 * 8 <= dealt[0] and dealt[1] <= 12 * dealt[0]


def test_vectors_without_structure_are_not_copied(spark, monkeypatch):
    """Of vectors all over the sphere nothing is dealt to many tasks: what Spark shuffles is the vectors once, not once for each block."""
    import numpy as np

    from terrakern.llm import neardup

    monkeypatch.setattr(neardup, "BLOCK", 64)
    rows = []
    deal = neardup._deal
    monkeypatch.setattr(neardup, "_deal", lambda *x: rows.append(deal(*x).count()) or deal(*x))
    rng = np.random.default_rng(3)
    v = rng.normal(size=(1200, 16))
    v[1100:] = v[:100] + rng.normal(size=(100, 16)) * 0.05
    v = [(i, [float(x) for x in np.float32(u)]) for i, u in enumerate(v)]
    got = neardup.near_duplicates(spark.createDataFrame(v, "vec_id long, embedding array<float>").repartition(3)).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == vectors_brute(v)
    assert sum(rows) <= 1.2 * len(v)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_blocks_that_meet_each_other_agree_with_cells(spark, monkeypatch, kind):
    """Clusters of all widths, copies of them and hot ones, blocks that aren't full: in cells, in pairs of blocks and pair by pair."""
    import numpy as np

    from terrakern.llm import neardup

    monkeypatch.setattr(neardup, "BLOCK", 300)
    rng = np.random.default_rng(9)
    v = [c + rng.normal(size=12) * s for c in rng.normal(size=(60, 12)) for s in rng.choice([0, 0.02, 0.1, 0.15, 0.2, 0.5], 12)]
    v = [(i, [float(x) for x in np.float32(u)]) for i, u in enumerate([*v, *[v[0]] * 40, *[v[5] + rng.normal(size=12) * 0.01 for _ in range(500)]])]
    df = spark.createDataFrame(v, f"vec_id long, embedding array<{kind}>").repartition(5)
    want = vectors_brute(v)
    for dealt in (0, 1e9):
        monkeypatch.setattr(neardup, "DEALT", dealt)
        assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in neardup.near_duplicates(df).collect()) == want


def test_sizes_are_those_of_groups(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "A b c d e f"), (3, None), (4, "a b"), (4, " "), (None, "x")], "doc_id long, text string")
    rows = lambda df: sorted(map(str, df.select("doc_id", "n_shingles").collect()))
    assert rows(jaccard.sizes(docs)) == rows(jaccard.groups(docs))
