"""Hard negatives and whitening against brute force, and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from provenio.llm import blocks, negatives, whitening
from tests.llm.test_operators import shared  # noqa: F401

SCHEMA = "vec_id long, embedding array<double>, label int, key string, x int, v binary, ids int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, "k", 1, b"", 2) for i, v, y in rows], SCHEMA)


def usable(rows):
    return [(i, v, y) for i, v, y in rows if v and all(c is not None and np.isfinite(c) for c in v)]


# -- 11


def brute_negatives(rows, scale=256):
    rows = [(i, [int(np.floor(scale * c)) for c in v], y) for i, v, y in usable(rows) if i is not None and y is not None]
    out = []
    for i, v, y in {(i, tuple(v), y) for i, v, y in rows if i % 100 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, z) for j, w, z in rows if j != i and len(w) == len(v))
        for s, j, _ in [x for x in scored if x[2] == y][:5]:
            found = [(n, m) for m, n, z in scored if z != y and -30 * s <= -100 * m <= -90 * s]
            out += [(i, j, rank, n, -s, -m) for rank, (n, m) in enumerate(found[:10], 1)]
    return sorted(out)


def mined(spark, rows, **more):
    found = negatives.mine(frame(spark, rows), F.col("vec_id") % 100 == 0, F.col("label"), **more)
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in found.collect())


@pytest.mark.parametrize("dims", [3, 17])
def test_negatives_against_brute_force(spark, dims, monkeypatch):
    monkeypatch.setattr(negatives, "BATCH", 3)
    rng = np.random.default_rng(dims)
    middle = rng.normal(size=(4, dims))
    rows = []
    for i in range(1200):
        y = int(min(rng.integers(0, 8), 3))  # one label has most rows
        x = (middle[y] + rng.normal(size=dims)) * rng.choice([0.2, 1, 5]) if i % 3 else np.round(middle[y] * 2) / 256  # with ties
        rows.append((i, x.tolist(), y))
    rows += [(200, [0.0] * dims, 1), (300, rows[300][1], rows[300][2]), (17, rows[17][1], rows[17][2]), (5000, [1.0] * dims, 99)]
    want = brute_negatives(rows)
    assert want and mined(spark, rows) == want


def test_negatives_of_few_and_odd_rows(spark):
    rows = [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [0.5, 1.0], 2), (3, None, 1), (4, [], 1), (5, [None, 1.0], 2), (6, [float("nan"), 1.0], 2), (7, [float("inf"), 1.0], 2), (8, [1.0, 1.0], None), (None, [1.0, 2.0], 1), (9, [1.0, 2.0, 3.0], 2), (100, [-1.0, -2.0], 1), (200, [0.0, 0.0], 3)]
    assert mined(spark, rows) == brute_negatives(rows)
    assert mined(spark, [r for r in rows if r[0] not in (0, 100, 200)]) == [] and negatives.mine(frame(spark, []), F.col("vec_id") % 100 == 0, F.col("label")).count() == 0


@pytest.mark.parametrize("size", [1 << 22, 1 << 27, 1 << 30])
def test_negatives_of_large_components(spark, size):
    """Scores over 53 bits, near 63, and near the limits of sums of 64."""
    rng = np.random.default_rng(1)
    rows = [(i, (size + rng.integers(-3, 3, 3) - (size // 3 if i % 4 == 0 else 0)).astype(float).tolist(), i % 2 + (i % 100 == 0)) for i in range(301)]
    assert mined(spark, rows, scale=1) == brute_negatives(rows, 1) != []


def test_index_finds_all_and_leaves_out():
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(size=(3000, 64)) * 50 * np.geomspace(4, 0.1, 64)).astype(np.int64)
    index = negatives.Index(x)
    q = x[:7][:, index.order]
    scores = (q @ index.x.T).astype(float)
    for part in (0.95, 0.5, 0.0):
        index.work, t = 0, scores.max(axis=1) * part
        a, c, s = index.above(q, negatives.rests(q), t)
        want = {(i, j) for i in range(7) for j in np.flatnonzero(scores[i] >= t[i])}
        assert {*zip(a.tolist(), c.tolist(), strict=True)} == want and (scores[a, c] == s).all()
        assert part < 0.9 or index.work < 0.4 * len(x) * 8  # of 8 groups


# -- 12


def brute_whitening(rows, k=8):
    """Of rows that take part, in their order: (deviation, whitened), the values and the trace."""
    x = np.array([[int(np.floor(1024 * c)) + 100_000 for c in v] for _, v, _ in usable(rows)], object)
    n, s = len(x), x.sum(axis=0)
    deviation = ((n * x - s) ** 2).sum(axis=1)
    c = ((n * x - s) / n).astype(float)
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return deviation, c @ vectors[:, :k] / np.sqrt(np.maximum(values[:k], 1e-300)), values, (c * c).sum() / n


@pytest.mark.parametrize("dims", [5, 40])
def test_whitening_against_a_full_decomposition(spark, dims, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 100)
    rng = np.random.default_rng(dims)
    x = rng.normal(size=(900, dims)) * np.linspace(1.5, 1, dims) @ np.linalg.qr(rng.normal(size=(dims, dims)))[0] + 7
    rows = [(i, v.tolist(), None) for i, v in enumerate(x)]
    rows[5] = (5, None, 1)
    deviation, whitened, values, trace = brute_whitening(rows)
    found = whitening.whiten(frame(spark, rows)).orderBy("vec_id", "component").collect()
    k = min(8, dims)
    assert [r.component for r in found[:k]] == list(range(1, k + 1)) and len(found) == 899 * k
    assert [r.deviation for r in found[::k]] == deviation.tolist() and {r.n for r in found} == {899}
    got = np.array([r.whitened for r in found]).reshape(-1, k)
    assert np.abs(got * np.sign((got * whitened).sum(axis=0)) - whitened).max() < 1e-8
    assert np.allclose([r.explained for r in found[:k]], values[:k] / trace, rtol=1e-9)
    assert max(r.identity_error for r in found) < 1e-9
    assert np.abs(np.cov(got.T, bias=True) - np.eye(k)).max() < 1e-9


def test_whitening_of_equal_eigenvalues_and_many_dimensions():
    """A flat spectrum, a repeated eigenvalue, and one that is far larger than all others."""
    rng = np.random.default_rng(3)
    for values in (np.append([9.0] * 4, np.linspace(5, 4.9, 96)), np.append(1e9, np.linspace(2, 1, 99)), np.append(np.linspace(10, 3, 9), np.zeros(91)), np.zeros(100)):
        turn = np.linalg.qr(rng.normal(size=(100, 100)))[0]
        v = turn @ np.diag(values) @ turn.T
        q, e, left = whitening.subspace(lambda m, v=v: v @ m, 100, 8)
        assert np.allclose(e, values[:8], atol=1e-12 * max(values[0], 1)) and np.abs(q.T @ q - np.eye(8)).max() < 1e-12
        assert np.linalg.norm(v @ q - q * e, axis=0).max() <= 1e-12 * max(values[0], 1)


def test_whitening_odd(spark):
    one = [(1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (None, [3.0, 1.0], 1), (2, None, 1), (3, [], 1), (4, [None, 1.0], 1), (5, [float("nan"), 1.0], 1), (6, [float("-inf"), 1.0], 1), (7, [1.0], 1), (8, [-4.0, 0.5], None)]
    found = whitening.whiten(frame(spark, one)).collect()
    assert sorted((str(r.vec_id), r.component) for r in found) == sorted((i, c) for i in ("1", "1", "None", "8") for c in (1, 2))
    assert {r.n for r in found} == {4} and found[0].identity_error < 1e-9
    assert whitening.whiten(frame(spark, [])).count() == 0
    same = whitening.whiten(frame(spark, [(i, [0.5, 0.25, 4.0], 1) for i in range(5)])).collect()
    assert len(same) == 15 and {r.whitened for r in same} == {None} and {r.deviation for r in same} == {0} and {r.identity_error for r in same} == {None}
    line = whitening.whiten(frame(spark, [(i, [float(i), 2.0 * i], 1) for i in range(5)])).collect()
    assert {(r.component, r.whitened is None) for r in line} == {(1, False), (2, True)}


def test_deviations_are_exact():
    rng = np.random.default_rng(4)
    for n, size in ((7, 10), (10**6, 200), (10**9, 10**4), (3, 1 << 61)):
        x = rng.integers(-size, size, (20, 6)) + 100_000
        sums = [int(s) for s in rng.integers(-size, size, 6) * n + rng.integers(0, n, 6)]
        want = [min(sum((n * int(a) - s) ** 2 for a, s in zip(row, sums, strict=True)), (1 << 63) - 1) for row in x]
        assert whitening.deviations(x, n, sums) == want
