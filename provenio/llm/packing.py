"""Best-fit packing by patterns of lengths.

Documents become pieces of at most `size` tokens. Only the histogram of lengths, of at
most `size` numbers, reaches the driver; there, patterns of one to three lengths that
fill a sequence are enumerated, their repeat counts fitted to the histogram by
non-negative least squares, rounded down to what is there, and the rest packed best
fit, longest first. The plan has a few thousand rows whatever the number of documents.
Pieces are then numbered within their length, over salted groups of about GROUP pieces, so
that a frequent length does not meet in one task, and join the plan by length and number.

Defined cases: a null text counts as empty, and an empty text is the closing id alone;
repeated rows are packed one by one; an empty table gives no sequences; further columns
of the input are not looked at. Texts are tokenized whole.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provenio.llm.common import only, staged

SIZE = 2048
#: Pieces of one length that are numbered together, on average.
GROUP = 20_000
#: Lengths are fitted in steps of SIZE / GRID.
GRID = 512
#: Characters of white space in a row from which a text is not given to tiktoken; it fails at some 1,000,000.
BLANKS = 100_000


def encoder(vocabulary: str) -> Callable[[str], np.ndarray]:
    """The ids that `tokenizers` gives by a vocabulary file of a byte-level BPE; special tokens in a text have their own ids.

    vocabulary: path of the JSON file; its merges as ranks lie beside it under the ending .tiktoken. Plain texts are
    encoded by tiktoken, which is some four times as fast; those in which the two differ go to `tokenizers`: texts that
    hold a special token, and white space so long that tiktoken's pattern overflows.
    """
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(vocabulary.removesuffix(".json") + ".tiktoken", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    exact = Tokenizer.from_file(vocabulary)
    special = [t.content for t in exact.get_added_tokens_decoder().values()]

    def encode(text: str) -> np.ndarray:
        plain = not any(mark in text for mark in special)
        if plain and (len(text) < BLANKS or all(m.end() - m.start() < BLANKS for m in re.finditer(r"\s\s+", text))):
            try:
                return fast.encode_to_numpy(text, disallowed_special=())
            except ValueError:  # the pattern ran out of its stack
                pass
        return np.array(exact.encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def _piece_sums(ids: np.ndarray, size: int) -> list[int]:
    n = len(ids)
    first = n if n <= size else n % size or size
    cuts = [0, *range(first, n + 1, size)]
    return [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(cuts, cuts[1:], strict=False)]


def pieces(docs: DataFrame, vocabulary: str, size: int = SIZE, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32): the pieces of each document, the closing id 0 included."""

    @F.pandas_udf("struct<n:bigint,sums:array<bigint>>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = encoder(vocabulary)
        for texts in batches:
            lengths, sums = [], []
            for t in texts:
                ids = np.append(own(t or ""), 0).astype("<u4")
                lengths.append(len(ids))
                sums.append(_piece_sums(ids, size))
            yield pd.DataFrame({"n": lengths, "sums": sums})

    n, piece = F.col("cut.n"), F.col("piece")
    first = F.when(n <= size, n).when(n % size == 0, size).otherwise(n % size)
    start = F.when(piece == 0, 0).otherwise(first + (piece - 1) * size).cast("long")
    out = only(docs, id_col, text).select(F.col(id_col), cut(F.col(text)).alias("cut"))
    out = out.select(id_col, "cut.n", "cut", F.posexplode("cut.sums").alias("piece", "ids_crc32"))
    return out.select(id_col, "piece", start.alias("start"), F.when(piece == 0, first).otherwise(size).cast("long").alias("length"), "ids_crc32")


# -- The plan, from the histogram alone.


def patterns(grid: int) -> np.ndarray:
    """All rows (a, b, c), a >= b >= c >= 0 and a > 0, that add up to grid."""
    a, b = np.meshgrid(np.arange(grid + 1), np.arange(grid + 1), indexing="ij")
    c = grid - a - b
    keep = (a >= b) & (b >= c) & (c >= 0)
    return np.stack([a[keep], b[keep], c[keep]], axis=1)


def fit_counts(parts: np.ndarray, histogram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Active-set non-negative least squares of the histogram by patterns: (chosen patterns, repeat counts).

    Row 0 of the histogram stands for "no document" and is left out of the fit.
    """
    goal = histogram.astype(float).copy()
    goal[0] = 0
    usable = np.flatnonzero(((parts == 0) | (goal[parts] > 0)).all(axis=1))
    if not len(usable):
        return np.empty(0, int), np.empty(0)
    cols = parts[usable]

    def column(p: int) -> np.ndarray:
        v = np.bincount(cols[p], minlength=len(goal)).astype(float)
        v[0] = 0
        return v

    chosen: list[int] = []
    matrix = np.empty((len(goal), 0))
    x = np.empty(0)
    for _ in range(3 * len(goal)):
        rest = goal - matrix @ x
        rest[0] = 0
        gain = rest[cols].sum(axis=1)
        gain[chosen] = 0
        best = int(gain.argmax())
        if gain[best] <= 1e-6 * max(1.0, goal.max()):
            break
        chosen.append(best)
        matrix = np.column_stack([matrix, column(best)])
        x = np.append(x, 0.0)
        while True:
            gram = matrix.T @ matrix
            gram[np.diag_indices_from(gram)] += 1e-9
            to = np.linalg.solve(gram, matrix.T @ goal)
            if (to > 1e-9).all():
                x = to
                break
            low = to <= 1e-9
            step = np.min(np.where(low, x / np.maximum(x - to, 1e-300), np.inf))
            x = x + min(1.0, step) * (to - x)
            keep = ~(low & (x <= 1e-9))
            if keep.all():
                keep[np.flatnonzero(low)[np.argmin(x[low])]] = False
            chosen = [p for p, k in zip(chosen, keep, strict=True) if k]
            matrix, x = matrix[:, keep], x[keep]
            if not chosen:
                break
    return usable[chosen], x


def plan(counts: dict[int, int], size: int = SIZE, grid: int = GRID) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, longest first; how many such sequences) for a histogram of lengths.

    Every document of the histogram has a place. The number of rows is bounded by size and grid.
    """
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        left[length] += n
    made: list[tuple[tuple[int, ...], int]] = []
    if left[size]:
        made.append(((size,), int(left[size])))
        left[size] = 0
    width = size / grid
    step = np.ceil(np.arange(size + 1) / width).astype(int)
    parts = patterns(grid)
    parts = parts[parts[:, 0] < grid]
    chosen, x = fit_counts(parts, np.bincount(step, weights=left, minlength=grid + 1))
    inside = [list(np.flatnonzero(step == g)[::-1]) for g in range(grid + 1)]

    def longest(g: int) -> int:
        while inside[g] and not left[inside[g][0]]:
            inside[g].pop(0)
        return inside[g][0] if inside[g] else 0

    for p in np.argsort(-x, kind="stable"):
        repeat = int(x[p] + 1e-6)
        while repeat > 0:
            lengths = []
            for g in parts[chosen[p]]:
                if g and (n := longest(int(g))):
                    lengths.append(int(n))
                    left[n] -= 1
                elif g:
                    break
            else:
                need = defaultdict(int)
                for n in lengths:
                    need[n] += 1
                more = min([repeat - 1, *(int(left[n]) // k for n, k in need.items())])
                for n, k in need.items():
                    left[n] -= more * k
                made.append((tuple(sorted(lengths, reverse=True)), more + 1))
                repeat -= more + 1
                continue
            for n in lengths:
                left[n] += 1
            break
    return _best_fit(made, left, size)


def _best_fit(made: list[tuple[tuple[int, ...], int]], left: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """The rest, longest first, each into the fullest sequence that still has room, many equal ones at a time."""
    room: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for lengths, n in made:
        room[size - sum(lengths)].append((lengths, n))
    for length in range(size, 0, -1):
        n = int(left[length])
        while n:
            free = next((r for r in range(length, size) if room.get(r)), None)
            if free is None:
                each = size // length  # new sequences, filled with this length
                if n >= each:
                    room[size - each * length].append(((length,) * each, n // each))
                if n % each:
                    room[size - (n % each) * length].append(((length,) * (n % each), 1))
                break
            lengths, have = room[free].pop()
            each = max(1, min(free // length, n))
            used = min(have, n // each)
            if used < have:
                room[free].append((lengths, have - used))
            room[free - each * length].append((lengths + (length,) * each, used))
            n -= used * each
    joined: dict[tuple[int, ...], int] = defaultdict(int)
    for rows in room.values():
        for lengths, n in rows:
            joined[tuple(sorted(lengths, reverse=True))] += n
    return sorted(joined.items())


def places(planned: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, from, to, each, first_sequence, first_offset): which numbers of a length go where."""
    rows, used, sequence = [], defaultdict(int), 0
    for lengths, repeat in planned:
        offset, i = 0, 0
        while i < len(lengths):
            each = lengths.count(lengths[i])
            n = lengths[i]
            rows.append((n, used[n], used[n] + each * repeat, each, sequence, offset))
            used[n] += each * repeat
            offset += each * n
            i += each
        sequence += repeat
    return rows


def pack(docs: DataFrame, vocabulary: str, size: int = SIZE, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece with its sequence and its place there, gapless from 0."""
    spark = docs.sparkSession
    cut = staged(pieces(docs, vocabulary, size, id_col, text))
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # size rows at most
    salts = spark.createDataFrame([(n, -(-c // GROUP)) for n, c in counts.items()], "length long, salts int")
    salt = F.pmod(F.xxhash64(id_col, "piece"), F.col("salts")).cast("int")
    cut = cut.join(F.broadcast(salts), "length").withColumn("salt", salt).drop("salts")
    groups = cut.groupBy("length", "salt").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = groups.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "salt").orderBy(id_col, "piece")
    numbered = cut.withColumn("number", F.row_number().over(order) - 1).join(offsets, ["length", "salt"])
    numbered = numbered.withColumn("number", F.col("number") + F.col("before"))
    where = spark.createDataFrame(places(plan(counts, size)), "length long, lo long, hi long, each long, sequence long, first long")
    inside = (numbered["length"] == where["length"]) & (F.col("number") >= F.col("lo")) & (F.col("number") < F.col("hi"))
    nth = F.col("number") - F.col("lo")
    return numbered.join(F.broadcast(where), inside).select(  # the plan's rows are bounded by size and grid
        id_col, "piece", "start", numbered["length"], "ids_crc32",
        (F.col("sequence") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("first") + (nth % F.col("each")) * numbered["length"]).cast("long").alias("offset"),
    )
