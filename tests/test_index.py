"""The inverted index against BM25 over all postings: segments, repeated batches, merging, and what stays closed."""

import random

import pytest
from pyspark.sql import functions as F

from provenio.operators import retrieval as R
from provenio.sources import index as I
from provenio.sources.index import TextIndex


def corpus(n, seed=1):
    """Some common and many rare terms, with ties; document 0 is long."""
    rng = random.Random(seed)
    word = lambda: f"c{rng.randint(0, 5)}" if rng.random() < 0.6 else f"r{int(rng.paretovariate(0.6)) % 400}"
    return [(i, [word() for _ in range(900 if i == 0 else rng.randint(0, 40))]) for i in range(n)]


def counts(spark, docs):
    return R.counted(spark.createDataFrame(docs, "key long, words array<string>"), "key", F.col("words"))


def ranked(found):
    return sorted((r.query_id, r["rank"], r.key, round(r.score, 9)) for r in found.collect())


@pytest.fixture()
def queries(spark):
    rng = random.Random(5)
    rows = [(q, t) for q in range(12) for t in rng.choices([f"c{i}" for i in range(6)] + [f"r{i}" for i in range(60)] + ["unknown"], k=rng.randint(1, 7))]
    return spark.createDataFrame(rows, "query_id int, term string")


def by_all_postings(spark, docs, queries, k):
    post = counts(spark, docs)
    n, mean = R.corpus_size(post, "key")
    return ranked(R.bm25(post, queries, k, n, mean, "key"))


def test_segments_give_what_all_postings_give(spark, tmp_path, queries, monkeypatch):
    monkeypatch.setattr(I, "BLOCK", 8)
    monkeypatch.setattr(I, "SLICE", 100)
    docs, index = corpus(700), TextIndex(spark, f"file://{tmp_path}/index")
    assert index.search(queries, 5).count() == 0 and index.segments() == (0, [])
    for at in range(3):
        index.append(counts(spark, docs[at::3]), f"batch-{at}")
    index.append(counts(spark, docs[2::3]), "batch-2")  # a repeated batch
    version, segments = index.segments()
    assert version == 3 and sum(s.n for s in segments) == sum(bool(w) for _, w in docs)
    want = by_all_postings(spark, docs, queries, 5)
    found, told = index.explained(queries, 5)
    assert ranked(found) == want and len(want) > 40
    read = {r.query_id: (r.opened, r.entries) for r in told.collect()}
    assert sum(o for o, _ in read.values()) < 0.6 * sum(e for _, e in read.values())
    index.merge()
    assert len(index.segments()[1]) == 1 and ranked(index.search(queries, 5)) == want
    index.append(counts(spark, [(9000 + i, w) for i, w in corpus(50, 2)]))
    assert ranked(index.search(queries, 3)) == by_all_postings(spark, docs + [(9000 + i, w) for i, w in corpus(50, 2)], queries, 3)


def test_one_of_two_writers_of_a_version_fails(spark, tmp_path):
    index = TextIndex(spark, f"file://{tmp_path}/index")
    index.append(counts(spark, corpus(20)), "a")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        index._publish(1, index.segments()[1])


def test_odd_batches(spark, tmp_path):
    index = TextIndex(spark, f"file://{tmp_path}/index")
    index.append(counts(spark, []), "none")
    asked = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "zzz")], "query_id int, term string")
    assert index.search(asked, 3).count() == 0
    index.append(counts(spark, [(7, ["a", "a", "b"]), (-3, []), (8, None), (9, ["a"])]), "some")
    assert ranked(index.search(asked, 3)) == by_all_postings(spark, [(7, ["a", "a", "b"]), (-3, []), (8, None), (9, ["a"])], asked, 3) != []


def test_few_documents_are_looked_up(spark, tmp_path, queries, monkeypatch):
    """What is scored from a document's own terms is little more than the result, once the blocks are read; and slices, folders' parts and ties change nothing."""
    for name, size in (("BLOCK", 8), ("SLICE", 64), ("PART", 20)):
        monkeypatch.setattr(I, name, size)
    written, real = [], I.staged
    monkeypatch.setattr(I, "staged", lambda df: written.append(real(df)) or written[-1])
    docs, index = corpus(2500, 4), TextIndex(spark, f"file://{tmp_path}/index")
    for at in range(2):
        index.append(counts(spark, docs[at::2]), f"batch-{at}")
    assert ranked(index.search(queries, 5)) == by_all_postings(spark, docs, queries, 5)
    looked_up = [x for x in written if x.columns == ["query_id", "key"]]
    assert len(looked_up) == 1 and looked_up[0].count() < 1000
