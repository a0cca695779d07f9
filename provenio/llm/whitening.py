"""Whitening by Chebyshev-filtered subspace iteration over distributed passes.

Vectors are packed once into blocks of whole numbers x. One pass sums them, exactly. Each further pass multiplies the
centred blocks with a tall, narrow Q: XᵀXQ, summed over the tasks; the covariance itself is never built. A round runs
the Chebyshev recurrence of such passes over Q, which grows what lies over the unwanted part of the spectrum (from 0
to the smallest Ritz value of the block) and damps the rest, then QR, then Rayleigh-Ritz. It ends when the
residuals |Vq - eq| of the wanted components are certified: at rounding, that is under EXACT of their own
eigenvalue (ROUNDING of the largest, if that is more), or under SURE and no longer falling. A block has as many guard columns again as twice the wanted ones.

Centring is exact up to one rounding: with m the whole part of the mean and r its rest, x - S/n is (x - m) - r/n. What
goes through the driver are sums of dims * columns numbers.

Defined cases: vectors that are null, empty, or hold a null or non-finite component take no part; if lengths differ, the
commonest one (of several, the largest) is fitted and others take no part; rows that repeat are each fitted and
returned; a null id is returned as null; fewer dimensions than components give fewer components; components whose
variance is within NONE of the largest one's rounding have no direction: whitened is null there and they don't count in
identity_error, which is null if none is left; a deviation beyond 64 bits is given as the nearest number that fits; an
empty table gives an empty result; components beyond 2 to the 62nd count as it. Further columns of any name play no part.
Jobs run when the function is called.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import acosh, cosh, isqrt, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenio.llm.blocks import each_block, opened, packed

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
EXACT, SURE, ROUNDING, NONE = 1e-14, 1e-9, 1e-5, 1e-12
DEGREE, ROUNDS = 12, 100
#: What a filter may grow the largest eigenvalue's direction by.
GROWTH = 1e12
LONG = (1 << 63) - 1
RESULT = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Fit:
    """Sums over the fit list and the leading components of its covariance."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    residuals: np.ndarray
    passes: int


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n in double precision, rounded once."""
    mean = np.array([s // n for s in sums], np.int64)
    return (x - mean) - np.array([s % n / n for s in sums])


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """For each vector the exact sum over dimensions of (n*x - S)^2, at most the largest 64-bit number."""
    y = x - np.array([s // n for s in sums], np.int64)
    rest = [s % n for s in sums]
    most = int(np.abs(y).max(initial=0))
    if most * max(most, n) * x.shape[1] >= 1 << 63:
        exact = y.astype(object) * n - np.array(rest, object)
        return [min(int(v), LONG) for v in (exact * exact).sum(axis=1)]
    squares, mixed = (y * y).sum(axis=1).tolist(), (y * np.array(rest, np.int64)).sum(axis=1).tolist()
    own = sum(r * r for r in rest)
    return [min(n * n * a - 2 * n * b + own, LONG) for a, b in zip(squares, mixed, strict=True)]


def _sums(blocks: DataFrame) -> tuple[int, int, list[int]]:
    """(dims, number of vectors, sums) of the commonest length; sums are exact."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for ids, dims, v in each_block(batches, "ids", "dims", "v"):
            x = opened(v, dims, len(ids))
            old = held.get(dims, [0, 0, 0])
            held[dims] = [old[0] + len(x), old[1] + (x >> 31).sum(axis=0), old[2] + (x & 0x7FFFFFFF).sum(axis=0)]
        for dims, (n, high, low) in held.items():
            columns = [pa.array([dims] * dims, pa.int32()), pa.array(range(dims), pa.int32()), pa.array([n] * dims), pa.array(high), pa.array(low)]
            yield pa.RecordBatch.from_arrays(columns, ["dims", "at", "n", "high", "low"])

    parts = blocks.mapInArrow(each, "dims int, at int, n long, high long, low long")
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    rows = parts.groupBy("dims", "at").agg(F.sum("n").alias("n"), exact("high"), exact("low"))
    best = rows.groupBy("dims").agg(F.max("n").alias("n"), F.collect_list(F.struct("at", "high", "low")).alias("sums"))
    found = best.orderBy(F.desc("n"), F.desc("dims")).limit(1).collect()
    if not found:
        return 0, 0, []
    return found[0].dims, found[0].n, [(int(s.high) << 31) + int(s.low) for s in sorted(found[0].sums)]


def _added(blocks: DataFrame, dims: int, of: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...], groups: int) -> np.ndarray:
    """The sum over all blocks of a matrix worked out from each block; tasks add up first, then groups of tasks."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for ids, own, v in each_block(batches, "ids", "dims", "v"):
            if own == dims:
                total += of(opened(v, dims, len(ids)))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sum"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum((np.frombuffer(x.as_py()) for b in batches for x in b["sum"]), np.zeros(int(np.prod(shape))))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sum"])

    parts = blocks.mapInArrow(each, "sum binary")
    if groups > 1:
        parts = parts.repartition(groups).mapInArrow(again, "sum binary")
    rows = parts.collect()  # a matrix a group, or a task where there are few
    return np.sum([np.frombuffer(r["sum"]).reshape(shape) for r in rows], axis=0)


def _degree(values: np.ndarray, edge: float) -> int:
    x = 2 * float(values[0]) / edge - 1
    return DEGREE if x <= 1 else int(min(DEGREE, max(2, log(2 * GROWTH) / acosh(x))))


def filtered(times: Callable[[np.ndarray], np.ndarray], q: np.ndarray, once: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The Chebyshev polynomial of V applied to q; once is Vq; each further degree is a pass."""
    edge = max(float(values[-1]), float(values[0]) * 1e-15)
    middle = edge / 2
    sigma = first = middle / (float(values[0]) - middle)
    last, now = q, (once - middle * q) * (sigma / middle)
    for _ in range(_degree(values, edge) - 1):
        new = 1 / (2 / first - sigma)
        last, now = now, (times(now) - middle * now) * (2 * new / middle) - (sigma * new) * last
        sigma = new
    return now


def subspace(times: Callable[[np.ndarray], np.ndarray], dims: int, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(components, eigenvalues, residuals) of the k largest of a symmetric V that has no negative ones; times: V times a matrix."""
    width = min(dims, 3 * k)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, width)))[0]
    least, idle = np.inf, 0
    for _ in range(ROUNDS):
        product = times(q)
        small = q.T @ product
        values, turn = np.linalg.eigh((small + small.T) / 2)
        turn, values = turn[:, ::-1], values[::-1]
        q, product = q @ turn, product @ turn
        residuals = np.linalg.norm(product - q * values, axis=0)[:k]
        worst = float((residuals / np.maximum(values[:k], values[0] * ROUNDING)).max()) if values[0] > 0 else 0.0
        idle = idle + 1 if worst > least / 2 else 0
        least = min(least, worst)
        if worst <= EXACT or worst <= SURE and idle > 1:
            return q[:, :k], values[:k], residuals
        q = np.linalg.qr(filtered(times, q, product, values))[0]
    raise ArithmeticError(f"the residuals of the components stay at {worst:.1e} of the eigenvalues")


def fit(blocks: DataFrame, k: int = COMPONENTS) -> Fit | None:
    """The fit over all blocks; None for an empty table."""
    dims, n, sums = _sums(blocks)
    if not n:
        return None
    many = blocks.count()
    groups = isqrt(many) if many > 256 else 1
    trace = float(_added(blocks, dims, lambda x: np.square(centred(x, n, sums)).sum(axis=0), (dims,), groups).sum() / n)
    passes = 0

    def times(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1

        def of(x: np.ndarray) -> np.ndarray:
            c = centred(x, n, sums)
            return c.T @ (c @ q)

        return _added(blocks, dims, of, q.shape, groups) / n

    vectors, values, residuals = subspace(times, dims, min(k, dims))
    return Fit(n, sums, vectors, values, trace, residuals, passes)


def whiten(vectors: DataFrame, k: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (id, component, n, deviation, whitened, explained, identity_error) for each vector and component."""
    blocks = packed(vectors, F.col(f"`{id_col}`"), F.col(f"`{vector}`"), scale, shift)
    found = fit(blocks, k)
    if found is None:
        return vectors.sparkSession.createDataFrame([], RESULT).withColumnRenamed("id", id_col)
    n, sums, dims = found.n, found.sums, len(found.sums)
    some = (found.values > NONE * found.values[0]) & (found.values > 0)
    onto = found.vectors * np.divide(1, np.sqrt(np.maximum(found.values, 0)), out=np.full(len(some), np.nan), where=some)

    def moments(x: np.ndarray) -> np.ndarray:
        w = centred(x, n, sums) @ onto[:, some]
        return np.vstack([w.T @ w, w.sum(axis=0)])

    error = None
    if some.any():
        m = int(some.sum())
        got = _added(blocks, dims, moments, (m + 1, m), 1 if n < 1 << 20 else isqrt(n >> 12)) / n
        error = float(np.abs(got[:m] - np.outer(got[m], got[m]) - np.eye(m)).max())
    explained = found.values / found.trace if found.trace > 0 else np.zeros(len(some))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, own, v in each_block(batches, "ids", "dims", "v"):
            if own != dims:
                continue
            x, c = opened(v, dims, len(ids)), onto.shape[1]
            w = centred(x, n, sums) @ onto
            rows = len(x) * c
            columns = [
                ids.take(pa.array(np.repeat(np.arange(len(x)), c))), pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), len(x))), pa.array(np.full(rows, n)),
                pa.array(np.repeat(np.array(deviations(x, n, sums), np.int64), c)), pa.array(w.ravel(), mask=np.tile(~some, len(x))),
                pa.array(np.tile(explained, len(x))), pa.array([error] * rows, pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return blocks.mapInArrow(each, RESULT).withColumnRenamed("id", id_col)
