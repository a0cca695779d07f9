"""The corpus pipeline over a small table, stage by stage, against plain Python."""

from collections import Counter

import corpus_pipeline as P
from tests.llm.test_operators import SF, brute_classes, odd, plain_spans, shared  # noqa: F401


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [*docs.collect(), (9001, None, "en", "src0", 0), (9002, "12 34 !!", "en", "src0", 8), (9003, "漢字だけ", "xx", "src1", 4)]
    docs = spark.createDataFrame(rows, docs.schema)
    names = [n for n, _ in P.STAGES]
    assert names == ["language_id", "minhash_near_dedup", "secret_scans", "source_mixing", "best_fit_packing"]
    kept = {}
    for i, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(i)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(i)))
        if i < len(P.STAGES) - 1:
            assert docs.columns == before.columns
        kept[name] = docs.collect()
    ids = {r.doc_id for r in kept["language_id"]}
    assert ids == {r[0] for r in rows} - {9001, 9002, 9003}
    classes = brute_classes({r.doc_id: r.text for r in kept["language_id"]})
    assert sorted(r.doc_id for r in kept["minhash_near_dedup"]) == sorted(set(classes.values()))
    texts = {r.doc_id: r.text for r in kept["minhash_near_dedup"]}
    assert {r.doc_id for r in kept["secret_scans"]} == set(texts)
    for r in kept["secret_scans"]:
        assert not plain_spans(r.text) and (r.text == texts[r.doc_id]) == (not plain_spans(texts[r.doc_id]))
        assert r.text == texts[r.doc_id] or r.n_chars == len(r.text)
    mixed = Counter(r.doc_id for r in kept["source_mixing"])
    assert set(mixed) == set(texts) and max(mixed.values()) <= 2
    packed = Counter(r.doc_id for r in kept["best_fit_packing"] if r.piece == 0)
    assert packed == mixed
    by_sequence = Counter()
    for r in kept["best_fit_packing"]:
        by_sequence[r.sequence_id] += r.length
    assert max(by_sequence.values()) <= 2048 and len(by_sequence) <= 1.03 * sum(by_sequence.values()) / 2048 + 1


def test_odd_rows(spark):
    docs = odd(spark).select(*P.COLUMNS)
    for _, stage in P.STAGES:
        assert stage(spark, docs, SF).count() >= 0
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_repeated_rows_go(spark):
    docs = spark.createDataFrame([(i, "eins zwei drei vier fünf sechs", "de", "a", 30) for i in (2, 1, 1, None)], ", ".join(("doc_id long", "text string", "lang string", "source string", "n_chars long")))
    assert [r.doc_id for r in P.minhash_near_dedup(spark, docs, SF).collect()] == [1]


def test_one_python_worker_for_each_task(spark):
    """Two Python operators in one stage give each task two workers, which executors keep."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = P.secret_scans(spark, docs, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EvalPython") == 1
