"""Quotes in documents as they are, against plain containment."""

import random
from collections import Counter

import pytest

from provenio import registry
from provenio.queries import evidence


@pytest.mark.parametrize("travelling", [evidence.TRAVELLING, 0])
def test_quotes_are_found_wherever_they_stand(spark, tmp_path, monkeypatch, travelling):
    monkeypatch.setattr(evidence, "TRAVELLING", travelling)
    rng = random.Random(3)
    words = lambda n, most=40: " ".join(f"w{rng.randint(0, most)}" for _ in range(n))
    texts = [words(rng.randint(0, 60)) for _ in range(60)]
    texts += [words(30_000, 9), "aa bb cc dd ee ff " * 50, None, ""]  # a long text: the time is that of its words, not of their square
    docs = [*enumerate(texts), (3, texts[5]), (3, texts[5]), (None, texts[6])]
    cut = lambda t, i, n: " ".join(t.split(" ")[i : i + n])
    quotes = [(i, cut(texts[i], 2, n)) for i, n in [(0, 6), (1, 7), (2, 12), (4, 3), (5, 9), (6, 8), (8, 5), (60, 20)]]
    quotes += [(5, cut(texts[9], 1, 8)), (70, texts[60][1:-1]), (71, "f aa bb cc dd ee ff a"), (71, "f aa bb cc dd ee ff a"), (72, "not in any of these texts at all"), (73, "bb"), (None, "aa bb cc dd ee ff")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(quotes, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = Counter((q, d) for q, s in quotes for d, t in docs if q is not None and s.strip() in " ".join((t or "").split()))
    got = Counter((r.item_id, r.doc_id) for r in registry.QUERIES["quote_contains"](spark, str(tmp_path)).collect())
    assert got == want and len(want) > 12
