"""Vectors as blocks: whole numbers of some thousand vectors in one row of bytes, so that tasks read them without parsing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenio.llm.common import staged

BLOCK = 4096
#: Components beyond this count as it, so that sums with a shift fit 64 bits.
MOST = 1 << 62
SCHEMA = "ids array<bigint>, labels array<bigint>, marks binary, dims int, v binary"


def whole(flat: np.ndarray, scale: int, shift: int) -> np.ndarray:
    """floor(scale * x) + shift as 64-bit numbers; what lies beyond MOST counts as it."""
    return np.clip(np.floor(flat * float(scale)), -float(MOST), float(MOST)).astype(np.int64) + shift


def _packed(scale: int, shift: int, size: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch["vector"]
            length = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
            flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null is not a number
            bad = np.bincount(np.repeat(np.arange(len(length)), length), ~np.isfinite(flat), len(length)) > 0
            keep = (length > 0) & ~bad
            begin = np.cumsum(length) - length
            for dims in np.unique(length[keep]).tolist():
                rows = np.flatnonzero(keep & (length == dims))
                for at in range(0, len(rows), size):
                    part = rows[at : at + size]
                    x = whole(flat[begin[part][:, None] + np.arange(dims)], scale, shift)
                    most = max(abs(int(x.min())), abs(int(x.max())))
                    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
                    take = lambda c: pa.array([batch[c].take(pa.array(part)).to_pylist()], pa.list_(pa.int64()))  # noqa: B023, E731
                    marks = np.asarray(batch["mark"].to_numpy(zero_copy_only=False)[part], np.uint8).tobytes()
                    columns = [take("id"), take("label"), pa.array([marks], pa.binary()), pa.array([dims], pa.int32()), pa.array([x.astype(kind).tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["ids", "labels", "marks", "dims", "v"])

    return each


def packed(vectors: DataFrame, id_: Column, vector: Column, scale: int, shift: int = 0, label: Column | None = None, mark: Column | None = None, size: int = BLOCK) -> DataFrame:
    """Blocks (ids, labels, marks, dims, v) of floor(scale * component) + shift, written once.

    Vectors that are null, empty, or hold a null or non-finite component take no part. A block has vectors of one length
    from one Arrow batch; nothing is shuffled. mark: a condition, one byte for each vector.
    """
    rows = vectors.select(
        id_.cast("long").alias("id"), (F.lit(None) if label is None else label).cast("long").alias("label"),
        F.coalesce(F.lit(False) if mark is None else mark, F.lit(False)).alias("mark"), vector.cast("array<double>").alias("vector"),
    )
    return staged(rows.where(F.col("vector").isNotNull()).mapInArrow(_packed(scale, shift, size), SCHEMA))


def opened(v: bytes, dims: int, n: int) -> np.ndarray:
    """The n vectors of a block as a matrix of 64-bit numbers."""
    return np.frombuffer(v, f"<i{len(v) // (dims * n)}").reshape(n, dims).astype(np.int64)


def each_block(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """The named columns of one block at a time, ids and labels as arrays."""
    for batch in batches:
        for i in range(len(batch)):
            yield tuple(batch[c][i].values if c in ("ids", "labels") else batch[c][i].as_py() for c in columns)
