"""SimHash classes against brute force, cells and forests, and odd rows."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from provenio.llm import simhash
from tests.llm.test_operators import odd, shared  # noqa: F401


def plain_print(text):
    """The contract, word for word."""
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """The smallest id for each row of (id, print); null ids come last."""
    numbers = sorted(set(prints_ := [p for _, p in prints]))
    label = {p: p for p in numbers}
    x = np.array(numbers, np.uint64)
    for i, p in enumerate(numbers):
        for j in np.flatnonzero(np.bitwise_count(x[i + 1 :] ^ x[i]) <= 3):
            a, b = label[p], label[numbers[i + 1 + j]]
            if a != b:
                label = {k: a if v == b else v for k, v in label.items()}
    ids = {}
    for i, p in prints:
        ids.setdefault(label[p], []).append(i)
    least = {k: min((i for i in v if i is not None), default=None) for k, v in ids.items()}
    return [least[label[p]] for p in prints_]


def check(spark, docs):
    found = sorted(((r.doc_id, r.print & (1 << 64) - 1, r.component_id) for r in simhash.classes(docs).collect()), key=str)
    prints = [(r.doc_id, plain_print(r.text)) for r in docs.select("doc_id", "text").collect()]
    want = sorted(((i, p, c) for (i, p), c in zip(prints, brute_components(prints), strict=True)), key=str)
    assert found == want
    return found


def test_given_documents(spark):
    found = check(spark, spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert len({c for _, _, c in found}) < len({p for _, p, _ in found}) + 1


def near_copies(n, seed=1):
    """One text of many words with a word exchanged here and there, and texts of their own."""
    rng = np.random.default_rng(seed)
    base = [f"w{rng.integers(5000)}" for _ in range(220)]
    out = []
    for i in range(n):
        words = list(base)
        for at in rng.choice(220, rng.integers(0, 3), replace=False):
            words[at] = f"x{rng.integers(40)}"
        out.append((i + 10, " ".join(words) if i % 3 else " ".join(f"v{x}" for x in rng.integers(0, 900, 30))))
    return out


@pytest.mark.parametrize("block", [8192, 20])
def test_groups_of_near_copies(spark, block, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", block)
    found = check(spark, spark.createDataFrame(near_copies(900), "doc_id long, text string"))
    sizes = np.unique([c for _, _, c in found], return_counts=True)[1]
    assert sizes.max() > 300
    prints = simhash.prints(spark.createDataFrame(near_copies(900), "doc_id long, text string")).select("print").distinct()
    assert simhash.links(prints).count() < 100 * prints.count()  # not the pairs of a group


def test_cells_meet_within_three_bits(spark):
    rng = np.random.default_rng(2)
    pairs = []
    for i in range(3000):
        x = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(2)) if i % 5 else [0, (1 << 64) - 1, 0x5555555555555555, 0xAAAAAAAAAAAAAAAA][i // 5 % 4]
        y = x
        for bit in rng.choice(64, rng.integers(0, 4), replace=False):
            y ^= 1 << int(bit)
        pairs.append((x - (x >> 63 << 64), y - (y >> 63 << 64)))
    found = spark.createDataFrame(pairs, "x long, y long").select(simhash.cells(F.col("x")).alias("a"), simhash.cells(F.col("y")).alias("b"))
    assert found.where(~F.arrays_overlap("a", "b")).count() == 0 and found.agg(F.max(F.size("a"))).first()[0] <= 34


def test_forest_joins_what_is_linked():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 5).astype(np.uint64)
    x = np.unique(np.concatenate([base[:, None] ^ (np.uint64(1) << rng.integers(0, 64, (5, 60)).astype(np.uint64)), base[:, None]], axis=1).ravel())
    a, b = simhash.forest(x, 3)
    assert len(a) == len(x) - 5 and (np.bitwise_count(x[a] ^ x[b]) <= 3).all()


def test_long_texts_in_steps(monkeypatch):
    text = " ".join(f"wort{i % 977} und" for i in range(5000))
    want = plain_print(text)
    monkeypatch.setattr(simhash, "STEP", 1000)
    assert simhash.fingerprints(iter([b"", text.encode(), b"A b"]), 3).tolist() == [0, want, plain_print("a b")]


def test_odd(spark):
    docs = odd(spark).unionByName(spark.createDataFrame([(20, "\x0b\x0c"), (21, "Ä B\xa0c d"), (None, None), (None, "ganz allein hier")], "doc_id long, text string"), allowMissingColumns=True)
    found = check(spark, docs)
    assert {c for i, p, c in found if p == 0} == {1} and (None, plain_print("ganz allein hier"), None) in found
    assert simhash.classes(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "print long"), 4)
