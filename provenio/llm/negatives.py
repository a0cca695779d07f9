"""Hard negatives by threshold joins over an index that leaves out what suffix norms cover (after L2AP).

Vectors lie in blocks of some thousand. In a block the dimensions come in order of falling energy, in groups. For a
threshold t, a vector's last groups are left out of the index from where the norm of what is left, times the norm of
the same part of the anchor, is under t: what is left out could not reach t by itself. Vectors in order of how far they are
indexed make the lists of each group a prefix, so that the partial scores of a batch of anchors grow by one
product a group. After each group, vectors go whose partial scores plus the norms of the remaining parts stay under
every threshold. What is left over gets its exact score.

Windows: an anchor looks for the first k of a range of scores. Thresholds begin near the top of the range and are lowered until
the window has k rows above the threshold, or the threshold is the range's end. What one block finds raises the threshold
for the next blocks of the task. The k best of each task meet in a ranking. The search runs twice: rows of the anchor's own
label give its positives, and each positive a range of scores in which rows of other labels are its negatives.

Anchors travel in passes of at most PASS bytes, broadcast; blocks are never copied. All else grows with the table
in rows alone. Scores are exact: in double precision where sums are whole numbers there, else in 64-bit or unbounded ones.

Defined cases: rows without id, label or vector, or with an empty vector or a null or non-finite component, take no part;
vectors of another length than the anchor's have no score with it; rows that repeat are rows of their own (each is a
positive, a negative), but an anchor that repeats wholly is one, and no row of an anchor's own id is its positive or
negative; fewer than k rows give fewer ranks; a positive score below zero has an empty range; components beyond 2 to
the 62nd count as it; a score beyond 64 bits is given as the nearest number that fits; an empty table gives no rows. Further
columns of any name play no part. The first search runs when the function is called.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenio.llm.blocks import each_block, opened, packed
from provenio.llm.common import staged

SCALE, POSITIVES, NEGATIVES = 256, 5, 10
#: The range of a negative's score in hundredths of its positive's.
LOWEST, HIGHEST = 30, 90
#: Dimensions that are added at once, and anchors that are searched side by side.
GROUP, BATCH = 8, 64
#: Blocks that a task reads at most.
TASK = 64
#: Bytes of the anchors of a pass, as 64-bit numbers.
PASS = 16 << 20
#: Thresholds lie at these parts of the way from the top of a range to its end.
STEPS = (1 / 8, 1 / 4, 1 / 2, 1.0)
LONG = (1 << 63) - 1
_SLACK = 1 + 1e-9


def kind_of(most_a: int, most_b: int, dims: int) -> type:
    """The numbers in which all sums of products are exact."""
    most = most_a * most_b * dims
    return float if most < 1 << 53 else np.int64 if most < 1 << 63 else object


def under(x: np.ndarray) -> np.ndarray:
    """Whole numbers in double precision, one step lower where that rounds."""
    x = np.asarray(x, float)
    return np.where(np.abs(x) < 1 << 53, x, np.nextafter(x, -np.inf))


def largest(x: np.ndarray) -> int:
    return max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))


def rests(x: np.ndarray) -> np.ndarray:
    """For each row the norms of what is left after 0, 1, ... groups of dimensions."""
    squares = np.add.reduceat(np.square(x.astype(float)), np.arange(0, x.shape[1], GROUP), axis=1)
    left = np.cumsum(squares[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.hstack([left, np.zeros((len(x), 1))])) * _SLACK


class Index:
    """Some vectors of a block, to be asked by thresholds."""

    def __init__(self, x: np.ndarray) -> None:
        self.order = np.argsort(-np.square(x.astype(float)).sum(axis=0), kind="stable")
        self.x = x[:, self.order]
        self.rest, self.most = rests(self.x), largest(x)
        self.work = 0

    def above(self, q: np.ndarray, q_rest: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, vector, score) of all scores of at least t, one t for each anchor; q: anchors in this index's order of dimensions."""
        kind = kind_of(self.most, largest(q), q.shape[1])
        x, q = self.x.astype(kind, copy=False), q.astype(kind, copy=False)
        bound = t / _SLACK - 1e-6 * (t != 0)
        groups = self.rest.shape[1] - 1
        if (bound > 0).all():  # else nothing may be left out
            reach = (q_rest / bound[:, None]).max(axis=0)
            ends = (self.rest * reach >= 1)[:, :groups].sum(axis=1)
        else:
            ends = np.full(len(x), groups)
        live = np.argsort(-ends, kind="stable")
        live = live[ends[live] > 0]
        partial = np.zeros((len(live), len(q)), kind)
        for g in range(groups):
            m = int(np.searchsorted(-ends[live], -g, side="left"))  # those that the list of this group has
            if not m:
                break
            at = slice(g * GROUP, (g + 1) * GROUP)
            partial[:m] += x[live[:m], at] @ q[:, at].T
            self.work += m
            could = partial[:m] + self.rest[live[:m], g + 1][:, None] * q_rest[:, g + 1] >= bound
            stay = np.append(could.any(axis=1), np.ones(len(live) - m, bool))
            if stay.sum() < 0.8 * len(stay):
                live, partial = live[stay], partial[stay]
        could = partial + np.take_along_axis(self.rest[live], ends[live][:, None], axis=1) * q_rest[:, ends[live]].T >= bound
        row, anchor = np.nonzero(could)
        score = partial[row, anchor]
        short = np.flatnonzero(ends[live[row]] < groups)
        if len(short):
            score[short] = (x[live[row[short]]] * q[anchor[short]]).sum(axis=1)
        fine = score >= np.where(np.isfinite(t), t, -np.inf)[anchor]
        return anchor[fine], live[row[fine]], score[fine]


@dataclass
class Asked:
    """Anchors of a pass of one length, and their windows in order of the anchors: scores of low to high."""

    keys: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    of: np.ndarray
    place: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def batches(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(anchors, windows) of BATCH anchors at a time of neighbouring labels."""
        order = np.argsort(self.labels, kind="stable")
        for at in range(0, len(order), BATCH):
            some = np.sort(order[at : at + BATCH])
            yield some, np.flatnonzero(np.isin(self.of, some))


class Best:
    """The k best (score, id) of some windows so far."""

    def __init__(self, windows: int, k: int) -> None:
        self.k, self.n = k, windows
        self.window, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least = np.full(windows, -np.inf)

    def add(self, window: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        w, s, i = np.append(self.window, window), np.append(self.score, score), np.append(self.id, id_)
        order = np.lexsort((i, ~s, w))  # ~ turns the order round, and has no overflow
        w, s, i = w[order], s[order], i[order]
        nth = np.arange(len(w)) - np.searchsorted(w, w)
        keep = nth < self.k
        self.window, self.score, self.id = w[keep], s[keep], i[keep]
        last = nth == self.k - 1
        self.least[w[last]] = under(s[last])


def search_block(index: Index, ids: np.ndarray, labels: np.ndarray, asked: Asked, some: np.ndarray, windows: np.ndarray, best: Best, same: bool) -> None:
    """Add a block's rows to the windows of some anchors; same: of the anchor's label, else of other labels."""
    q = asked.x[some][:, index.order]
    q_rest = rests(q)
    own = np.searchsorted(some, asked.of[windows])  # the anchor of a window, by its place in some
    low, high = asked.low[windows], asked.high[windows]
    lowest, highest = np.where(low == -LONG - 1, -np.inf, under(low)), -under(-high.astype(float))
    cap = q_rest[:, 0] * float(index.rest[:, 0].max(initial=0))
    top, end = np.full(len(some), -np.inf), np.full(len(some), np.inf)
    np.maximum.at(top, own, np.minimum(highest, cap[own]))
    found_before = np.full(len(some), np.inf)
    active = np.flatnonzero(np.bincount(own, minlength=len(some)) > 0)
    for step in STEPS:
        end[:] = np.inf
        np.minimum.at(end, own, np.maximum(lowest, best.least[windows]))
        to = np.maximum(end[active], -cap[active])
        t = end[active] if step == 1 else np.maximum(end[active], top[active] - (top[active] - to) * step)
        ask = t <= top[active]
        going, t = active[ask], t[ask]
        if not len(going):
            return
        a, c, s = index.above(q[going], q_rest[going], t)
        fresh = (s < found_before[going][a]) & (ids[c] != asked.ids[some[going[a]]]) & ((labels[c] == asked.labels[some[going[a]]]) == same)
        a, c, s = going[a[fresh]], c[fresh], s[fresh]
        if len(a):
            order = np.argsort(own, kind="stable")
            first, count = np.searchsorted(own[order], a), np.bincount(own, minlength=len(some))[a]
            pair = np.repeat(np.arange(len(a)), count)
            w = order[np.repeat(first, count) + np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)]
            inside = (s[pair] >= low[w]) & (s[pair] <= high[w])
            score = np.array([min(max(int(x), -LONG - 1), LONG) for x in s[pair][inside]], np.int64) if s.dtype == object else s[pair][inside].astype(np.int64)
            best.add(windows[w[inside]], score, ids[c[pair[inside]]])
        found_before[going] = t
        need = np.full(len(some), np.inf)
        np.minimum.at(need, own, np.maximum(lowest, best.least[windows]))
        active = going[t > need[going]]


def _search(asked: dict[int, Asked], k: int, same: bool):
    """Rows (key, place, score, id): the k best of a task for each window."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {dims: Best(len(x.of), k) for dims, x in asked.value.items()}
        for ids, labels, dims, v in each_block(batches, "ids", "labels", "dims", "v"):
            if dims not in best:
                continue
            own, ids, labels = asked.value[dims], ids.to_numpy(), labels.to_numpy()
            x = opened(v, dims, len(ids))
            if same:
                parts = {int(y): np.flatnonzero(labels == y) for y in np.unique(labels)}
                indexes = {y: (Index(x[at]), at) for y, at in parts.items() if (own.labels == y).any()}
            else:
                indexes = {None: (Index(x), np.arange(len(x)))}
            for some, windows in own.batches():
                if not len(windows):
                    continue
                for y, (index, at) in indexes.items():
                    of = some if y is None else some[own.labels[some] == y]
                    these = windows if y is None else windows[own.labels[own.of[windows]] == y]
                    if len(of) and len(these):
                        search_block(index, ids[at], labels[at], own, of, these, best[dims], same)
        for dims, found in best.items():
            of = asked.value[dims]
            columns = [of.keys[of.of[found.window]], of.place[found.window], found.score, found.id]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "place", "score", "id"])

    return each


def _anchors(blocks: DataFrame) -> DataFrame:
    """Rows (key, id, label, dims, x) of the marked vectors; rows that repeat wholly are one."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, marks, dims, v in each_block(batches, "ids", "labels", "marks", "dims", "v"):
            at = np.flatnonzero(np.frombuffer(marks, np.uint8))
            x = opened(v, dims, len(ids))[at].astype("<i8")
            columns = [ids.take(pa.array(at)), labels.take(pa.array(at)), pa.array([dims] * len(at), pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "label", "dims", "x"])

    rows = blocks.mapInArrow(each, "id long, label long, dims int, x binary").distinct()
    return staged(rows.withColumn("key", F.xxhash64("id", "label", "x")))


def _searched(blocks: DataFrame, anchors: DataFrame, windows: DataFrame, k: int, same: bool) -> DataFrame:
    """Rows (key, place, rank, score, id) of the first k for each window (key, place, low, high)."""
    spark = blocks.sparkSession
    size = anchors.agg(F.count("*"), F.max("dims")).first()
    if not size[0]:
        return spark.createDataFrame([], "key long, place int, rank int, score long, id long")
    passes = -(-size[0] * size[1] * 8 // PASS)
    many = blocks.count()
    tasks = max(1, min(many, max(4 * spark.sparkContext.defaultParallelism, -(-many // TASK))))
    dealt = blocks.select("ids", "labels", "dims", "v").repartition(tasks)
    parts = []
    for p in range(passes):
        mine = anchors.where(F.pmod("key", F.lit(passes)) == p)
        held = mine.toArrow()  # PASS bytes on average
        ranges = windows.join(mine.select("key"), "key", "left_semi").toArrow().to_pandas()
        asked = {}
        for dims in sorted(set(held["dims"].to_pylist())):
            rows = held.filter(pa.compute.equal(held["dims"], dims)).sort_by("key")
            keys = rows["key"].to_numpy()
            own = ranges[ranges["key"].isin(keys)].sort_values(["key", "place"], kind="stable")
            x = np.frombuffer(b"".join(rows["x"].to_pylist()), "<i8").reshape(-1, dims)
            bound = lambda c: own[c].to_numpy(np.int64)  # noqa: B023, E731
            asked[dims] = Asked(keys, rows["id"].to_numpy(), rows["label"].to_numpy(), x, np.searchsorted(keys, own["key"].to_numpy()), own["place"].to_numpy(np.int32), bound("low"), bound("high"))
        sent = spark.sparkContext.broadcast(asked)
        parts.append(dealt.mapInArrow(_search(sent, k, same), "key long, place int, score long, id long"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    order = Window.partitionBy("key", "place").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("key", "place", "rank", "score", "id")


def mine(
    vectors: DataFrame, anchor: Column, label: Column, id_col: str = "vec_id", vector: str = "embedding", scale: int = SCALE, positives: int = POSITIVES,
    negatives: int = NEGATIVES, lowest: int = LOWEST, highest: int = HIGHEST,
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score); anchor: which rows are, label: a whole number."""
    id_ = F.col(f"`{id_col}`")
    rows = vectors.where(id_.isNotNull() & label.isNotNull())
    blocks = packed(rows, id_, F.col(f"`{vector}`"), scale, label=label, mark=anchor)
    anchors = _anchors(blocks)
    all_scores = anchors.select("key", F.lit(1).alias("place"), F.lit(-LONG - 1).alias("low"), F.lit(LONG).alias("high"))
    found = staged(_searched(blocks, anchors, all_scores, positives, same=True).select("key", F.col("rank").alias("place"), F.col("score").alias("positive_score"), F.col("id").alias("positive_id")))
    wide = F.col("positive_score").cast("decimal(38,0)")
    low, high = F.ceil(wide * lowest / 100).cast("decimal(38,0)"), F.floor(wide * highest / 100).cast("decimal(38,0)")
    windows = found.where("positive_score >= 0").select("key", "place", low.cast("long").alias("low"), high.cast("long").alias("high"))
    got = _searched(blocks, anchors, windows, negatives, same=False)
    named = got.join(found, ["key", "place"]).join(anchors.select("key", F.col("id").alias("anchor_id")), "key")
    return named.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
