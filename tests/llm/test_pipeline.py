"""The pipeline's stages, one after the other, against plain Python on a small corpus."""

import re

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest tables, with rows that repeat ids, have none, or are copies, and a clashing column."""
    path = tmp_path_factory.mktemp("corpus")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{path}/{name}.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    some = docs.where("doc_id < 12")
    more = some.selectExpr("CAST(NULL AS BIGINT) AS doc_id", "concat(text, ' tail of its own') AS text", "lang", "source", "n_chars")
    again = some.selectExpr("doc_id", "upper(text) AS text", "lang", "CAST(NULL AS STRING) AS source", "n_chars").unionByName(some)
    docs.unionByName(more).unionByName(again).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    key = lambda r: (r.doc_id, r.text)
    # What the classifier accepts is what its scores say.
    first = pipeline.quality_classifier(spark, docs, folder).cache()
    from terrakern.llm import quality
    from terrakern.llm.common import table

    scores = {(r.doc_id, r.text): r.predicted for r in quality.rate(docs, table(spark, folder, "labels"), keep=["doc_id", "text"]).collect()}
    assert first.columns == docs.columns
    assert sorted(map(str, map(key, first.collect()))) == sorted(str(key(r)) for r in docs.collect() if scores[key(r)])
    # One row of each group of linked texts, of the least id.
    rows = first.collect()
    sets = [shingles(r.text) for r in rows]
    root = list(range(len(rows)))

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = {}
    for n, r in enumerate(rows):
        groups.setdefault(find(n), []).append(r)
    second = pipeline.ngram_jaccard_join(spark, first, folder).cache()
    kept = second.collect()
    assert len(kept) == len(groups) < len(rows)
    least = sorted(min((r.doc_id is None, r.doc_id or 0) for r in g) for g in groups.values())
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == least
    # No row that stays has a window of an item, found by plain search of short items' windows as they stand.
    third = pipeline.benchmark_decontamination(spark, second, folder).cache()
    items = [re.sub(r"\s", " ", r.text.casefold()) for r in table(spark, folder, "benchmark").collect()]
    windows = {t[k : k + 96] for t in items for k in range(0, max(1, len(t) - 95), 16)}
    left = {key(r) for r in third.collect()}
    for r in kept:
        text = re.sub(r"\s", " ", r.text.casefold())
        if any(w in text for w in windows):
            assert key(r) not in left
    assert third.columns == docs.columns
    # The mix repeats and leaves out whole rows; the shards number what it gives.
    fourth = pipeline.mixing_to_targets(spark, third, folder).cache()
    assert {key(r) for r in fourth.collect()} <= left and fourth.columns == docs.columns
    last = pipeline.sharding_by_jump_hash(spark, fourth, folder).collect()
    assert len(last) == fourth.count()
    assert all(r.shard == jump(r.doc_id or 0, 8) and r.grown_shard in (r.shard, 8) for r in last)
    for s in range(8):
        own = sorted(r.slot for r in last if r.shard == s)
        assert own == list(range(len(own)))


def test_run(spark, folder):
    rows = pipeline.run(spark, folder)
    assert rows.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert 0 < rows.count() == pipeline.run(spark, folder).count()


def test_stages_of_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0
