"""Exact top-k inner products by Fagin's threshold algorithm over sorted per-dimension lists.

Candidates lie in blocks of some thousand vectors. A block keeps, for each dimension, its
vectors sorted by that component. A query reads each list from the end that the sign of its
own component favours, and has a depth of its own in each: at every step it goes on in that
half of the lists whose next stretch lowers the bound most. Each vector seen for the first
time is scored in full, and the sum of the components at the depths reached, each times the
query's, bounds all vectors not yet seen. A query stops in a block as soon as that bound
is below its kth score, be that from this block or from those that its task read before. The k best of each
task meet in a ranking for each query.

Blocks are written once and never copied. Queries travel in passes of at most PASS bytes, broadcast; each task reads its
blocks one after the other, so that later blocks stop earlier. What is shuffled are the k best of each task and query.

Components are 64-bit whole numbers; those beyond 2 to the 62nd count as it. Scores are added up in single or double
precision where they are exact there, in 64-bit integers where they fit, and in unbounded ones else; a score beyond
64 bits is given, and ranked, as the nearest number that fits. Ties go to the smaller id.

Defined cases: vectors that are null, empty, or hold a null or non-finite component take
no part; vectors of another length than the query's are no candidates of it; rows that
repeat an id are ranked one by one, and no row of the query's own id is its candidate;
the rows of a query's id that repeats are ranked together; fewer than k candidates give
fewer ranks; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provenio.llm.blocks import each_block, opened, packed
from provenio.llm.negatives import PASS, TASK, Best
#: The first step reads this share of a list, and each step twice as much as the one before.
STRETCH = 1 / 128
LONG = (-(1 << 63), (1 << 63) - 1)


def _exact(queries: np.ndarray, block: np.ndarray) -> type:
    """The numbers in which all sums of products are exact."""
    size = lambda x: max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))
    most = size(queries) * size(block) * block.shape[1]
    return np.float32 if most < 1 << 24 else float if most < 1 << 53 else np.int64 if most <= LONG[1] else object


def threshold_top(
    queries: np.ndarray, own: np.ndarray, block: np.ndarray, ids: np.ndarray, k: int, least: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) of the k best of a block for each query, and how many vectors each query scored; own: the queries' ids.

    least: for each query a score under which nothing counts.
    """
    least = np.full(len(queries), -np.inf) if least is None else least
    n = len(block)
    order = np.asfortranarray(np.argsort(block, axis=0, kind="stable"))  # the sorted lists, lowest first
    kind = _exact(queries, block)
    lists = np.take_along_axis(block, order, axis=0).astype(kind)
    block, queries = block.astype(kind), queries.astype(kind)
    rows, cols, values, read = [], [], [], np.zeros(len(queries), np.int64)
    for i, q in enumerate(queries):
        dims = np.flatnonzero(q)
        down = q[dims] > 0  # read from the highest
        at = lambda depth: lists[np.where(down, n - 1 - depth, depth), dims] * q[dims]  # noqa: B023, E731
        depth, stretch = np.zeros(len(dims), np.int64), max(1, int(n * STRETCH))
        unseen, left = ids != own[i], int((ids != own[i]).sum())
        best, score = np.zeros(0, np.int64), np.zeros(0, kind)
        while left and at(np.minimum(depth, n - 1)).sum() >= least[i]:  # what is unseen lies no higher than the next in each list
            end = np.minimum(depth + stretch, n)
            drop = np.where(depth < n, at(np.minimum(depth, n - 1)) - at(end - 1), -1)
            met = np.zeros(n, bool)
            for d in np.argsort(-drop, kind="stable")[: (len(dims) + 1) // 2]:
                met[order[n - end[d] : n - depth[d], dims[d]] if down[d] else order[depth[d] : end[d], dims[d]]] = True
                depth[d] = end[d]
            new = np.flatnonzero(met & unseen) if len(dims) else np.flatnonzero(unseen)  # a query of zeros meets all
            unseen[new] = False
            left, stretch = left - len(new), 2 * stretch
            read[i] += len(new)
            full = block[new] @ q if 4 * len(new) < n else (block @ q)[new]
            enough = max(least[i], score[-1]) if len(best) == k else least[i]
            new, full = new[full >= enough], full[full >= enough]
            best, score = np.concatenate([best, new]), np.concatenate([score, full])
            if len(best) > k:
                cut = np.partition(score, len(score) - k)[len(score) - k]
                best, score = best[score >= cut], score[score >= cut]
            kept = np.lexsort((ids[best], -score))[:k]
            best, score = best[kept], score[kept]
            if len(best) == k and at(np.maximum(depth - 1, 0)).sum() < score[-1]:  # what is unseen lies no higher than the last read
                break
        rows.append(np.full(len(best), i))
        cols.append(best)
        values.append(score)
    joined = lambda x, t: np.concatenate([np.zeros(0, t), *x])
    score = np.array([min(max(int(x), LONG[0]), LONG[1]) for x in joined(values, kind)], np.int64)
    return joined(rows, np.int64).astype(np.int64), joined(cols, np.int64).astype(np.int64), score, read


def _search(sent, k: int):
    """Rows (query_id, vec_id, score): the k best of a task for each query; sent: {dims: (ids, vectors) of queries}."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {dims: Best(len(own), k) for dims, (own, _) in sent.value.items()}
        for ids, dims, v in each_block(batches, "ids", "dims", "v"):
            if dims in best:
                ids, (own, queries) = ids.to_numpy(), sent.value[dims]
                row, col, score, _ = threshold_top(queries, own, opened(v, dims, len(ids)), ids, k, best[dims].least)
                best[dims].add(row, score, ids[col])
        for dims, found in best.items():
            columns = [sent.value[dims][0][found.window], found.id, found.score]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])

    return each


def top_k(vectors: DataFrame, queries: DataFrame, k: int, scale: int = 64, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k highest integer inner products of each query. Blocks are written when it is called."""
    spark = vectors.sparkSession
    id_, v = F.col(f"`{id_col}`"), F.col(f"`{vector}`")
    blocks = packed(vectors.where(id_.isNotNull()), id_, v, scale).select("ids", "dims", "v")
    asked = packed(queries.where(id_.isNotNull()), id_, v, scale).select("ids", "dims", "v")
    size = asked.agg(F.coalesce(F.sum(F.size("ids") * F.col("dims").cast("long") * 8), F.lit(0))).first()[0]
    many = blocks.count()
    passes = max(1, -(-size // PASS))
    dealt = blocks.repartition(max(1, min(many, max(4 * spark.sparkContext.defaultParallelism, -(-many // TASK)))))
    parts = []
    for p in range(passes):
        own: dict[int, tuple[list, list]] = {}
        for row in asked.where(F.pmod(F.xxhash64("v"), F.lit(passes)) == p).toLocalIterator():  # PASS bytes on average
            ids, xs = own.setdefault(row.dims, ([], []))
            ids.append(np.array(row.ids, np.int64))
            xs.append(opened(row.v, row.dims, len(row.ids)))
        sent = spark.sparkContext.broadcast({dims: (np.concatenate(ids), np.concatenate(xs)) for dims, (ids, xs) in own.items()})
        parts.append(dealt.mapInArrow(_search(sent, k), "query_id long, vec_id long, score long"))
    part = parts[0]
    for more in parts[1:]:
        part = part.unionByName(more)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = part.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
