"""Media columns: copies of pictures by local descriptors, Hamming tables and geometric consensus.

Corners are local maxima of a Harris response at two scales. Round each, a patch is
smoothed, turned to the direction of its intensity centroid, and described by binary
tests of pairs of points; of corners of one picture with the same description, the first
in reading order counts. Descriptors that agree in one of two tables, each of half of their
bits, meet in that table's bucket, so that any two within one bit of each other do, and
match if their other halves differ in FAR bits at most. Matches of two pictures vote for the
shift between their corners; a shift counts from VOTES on, as what stands before and after
an edit may have different ones. Pictures whose agreeing places reach SHARE of the smaller
picture's corners are linked, so that a crop, or a copy with other surroundings, is found
wherever it lies. Classes are the connected components of the links.

Pictures are searched whole, block by block, first those of one block, then those of any two:
pictures of different classes that meet in enough of the smaller one's rarest places are compared
corner by corner, so that no link between classes is lost, and what is joined is not compared again.

The pictures of `pages` are drawn from its html: each word of a block is a dark
rectangle as long as the word, each block begins a line, as on a small print of the page.

Defined cases: a null or empty page has an empty picture; a picture without corners is
linked to equal pictures only, an empty one to none; equal pictures are one node, whose
rows share its class; an id that is null has the class of its picture; an empty table gives
an empty result. Pictures are drawn and searched whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenio.llm.common import bucketed, only, staged
from provenio.llm.dartminhash import components

WIDTH, LINE = 64, 4
RADIUS, PATCH, TURNS, BITS = 10, 8, 16, 128
FAR, VOTES, SHARE = 10, 2, 0.3
#: Places that two pictures have to share among those that the smaller one asks by; it keeps back the others that have to agree.
HITS = 3
#: Corners of a block, about, and meetings of corners that are looked at together.
CORNERS, MEETINGS = 1 << 18, 1 << 20
#: Blocks that a task keeps opened.
OPENED = 3
#: Rows of pixels that are searched at a time, of the pictures that are searched together, and of paper between these.
STRIP, SHEET, GAP = 1 << 13, 1 << 11, 4 * PATCH
#: Pages that are taken out of an Arrow batch at a time.
PAGES = 256

_HIDDEN = re.compile(r"<(script|style|title|noscript)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)", re.S | re.I)
_BREAK = re.compile(r"</?(?:p|div|h[1-6]|li|ul|ol|nav|article|section|footer|header|table|tr|body|br|aside|form|blockquote)\b[^>]*>", re.I)
_TAG = re.compile(r"<[^>]*>")


def draw(html: str | None) -> np.ndarray:
    """A page's picture: rows of WIDTH pixels, 255 is paper. A pixel is two characters wide."""
    text = _TAG.sub(" ", _BREAK.sub("\0", _HIDDEN.sub(" ", html or "")))
    blocks = [w for b in text.split("\0") if (w := b.split())]
    if not blocks:
        return np.zeros((0, WIDTH), np.uint8)
    words = np.fromiter(map(len, blocks), np.int64, len(blocks))
    lengths = np.fromiter(map(len, chain.from_iterable(blocks)), np.int64, int(words.sum())) // 2 + 1
    ends = np.cumsum(lengths + 1)
    last = np.cumsum(words) - 1
    taken = np.diff(ends[last], prepend=0)
    lines = -(-taken // WIDTH)  # a block begins a line
    shift = (np.cumsum(lines) - lines) * WIDTH - (ends[last] - taken)
    begin = ends - lengths - 1 + np.repeat(shift, words)
    ink = np.zeros(int(lines.sum()) * WIDTH + 1, np.int8)
    ink[begin] += 1  # no two words begin, or end, at one pixel
    ink[begin + lengths] -= 1
    ink = np.cumsum(ink[:-1], dtype=np.int8).reshape(-1, WIDTH)
    picture = np.full((len(ink), LINE, WIDTH), 255, np.uint8)
    picture[:, : LINE // 2] = np.where(ink, 55, 255)[:, None]
    return picture.reshape(-1, WIDTH)


def _framed(x: np.ndarray, r: int, fill: float | None = None) -> np.ndarray:
    """x with r more entries at each end of both axes: its outermost ones again, or fill."""
    n, m = x.shape
    y = np.empty((n + 2 * r, m + 2 * r), x.dtype)
    y[r : r + n, r : r + m] = x
    for end, edge in ((slice(0, r), slice(r, r + 1)), (slice(r + m, None), slice(r + m - 1, r + m))):
        y[:, end] = y[:, edge] if fill is None else fill
    for end, edge in ((slice(0, r), slice(r, r + 1)), (slice(r + n, None), slice(r + n - 1, r + n))):
        y[end] = y[edge] if fill is None else fill
    return y


def _box(x: np.ndarray) -> np.ndarray:
    """Sums over squares of five pixels, edges repeated."""
    y = _framed(x, 2)
    two = y[:-1] + y[1:]
    y = two[:-3] + two[2:-1] + y[4:]
    two = y[:, :-1] + y[:, 1:]
    return two[:, :-3] + two[:, 2:-1] + y[:, 4:]


def _highest(x: np.ndarray, r: int) -> np.ndarray:
    """Maxima over squares of 2r + 1 pixels."""
    y = _framed(x, r, -np.inf)
    for axis in (0, 1):
        have, want = 1, 2 * r + 1
        take = lambda z, a, b: z[a:b] if axis == 0 else z[:, a:b]  # noqa: B023, E731
        while have < want:
            step = min(have, want - have)
            n = y.shape[axis] - step
            y, have = np.maximum(take(y, 0, n), take(y, step, n + step)), have + step
    return y


def corners(picture: np.ndarray) -> np.ndarray:
    """Rows and columns of the corners of one scale."""
    if min(picture.shape) < 2 * PATCH + 3:
        return np.zeros((0, 2), np.int64)
    x = np.ascontiguousarray(picture.T, np.float32)  # the long axis last, which is faster; sums stay below 2**24, so they are exact
    gy, gx = np.zeros_like(x), np.zeros_like(x)
    np.subtract(x[2:], x[:-2], out=gx[1:-1])
    np.subtract(x[:, 2:], x[:, :-2], out=gy[:, 1:-1])
    a, b, c = (_box(p) for p in (gx * gx, gy * gy, gx * gy))
    response = a * b - c * c - 0.05 * (a + b) ** 2
    high = (response == _highest(response, RADIUS)) & (response > 1e6)
    col, row = np.nonzero(high[PATCH:-PATCH, PATCH:-PATCH])
    order = np.lexsort((col, row))
    return _apart(np.column_stack([row[order], col[order]]) + PATCH)


def _apart(at: np.ndarray) -> np.ndarray:
    """Corners at least RADIUS apart: of equal ones that are nearer, as repeated words give, the first in reading order."""
    kept: list[tuple[int, int]] = []
    for row, col in at.tolist():
        for r, c in reversed(kept):
            if row - r > RADIUS:
                kept.append((row, col))
                break
            if abs(col - c) <= RADIUS:
                break
        else:
            kept.append((row, col))
    return np.array(kept, np.int64).reshape(-1, 2)


def _tests() -> np.ndarray:
    """For each turn the pairs of points that are compared: TURNS x BITS x (row, column, row, column)."""
    points = np.clip(np.random.default_rng(7).normal(0, PATCH / 2.5, (BITS, 2, 2)), -PATCH * 0.65, PATCH * 0.65)
    angle = 2 * np.pi * np.arange(TURNS) / TURNS
    turn = np.stack([np.stack([np.cos(angle), np.sin(angle)], -1), np.stack([-np.sin(angle), np.cos(angle)], -1)], 1)
    return np.rint(np.einsum("tij,bpj->tbpi", turn, points)).astype(np.int64).reshape(TURNS, BITS, 4)


def describe(picture: np.ndarray, at: np.ndarray, tests: np.ndarray) -> np.ndarray:
    """Descriptors as rows of two 64-bit numbers."""
    if not len(at):
        return np.zeros((0, 2), np.int64)
    n, smooth = len(picture), _box(np.ascontiguousarray(picture.T, np.int16)).ravel()  # column by column
    row, col, span = at[:, 0, None], at[:, 1, None], np.arange(-6, 7)
    patch = smooth[((col + span) * n)[:, None, :] + (row + span)[:, :, None]]
    angle = np.arctan2(patch.sum(2) @ span, patch.sum(1) @ span)
    turn = np.rint(angle / (2 * np.pi) * TURNS).astype(int) % TURNS
    t, own = tests[turn], col * n + row
    bits = smooth[own + t[:, :, 1] * n + t[:, :, 0]] < smooth[own + t[:, :, 3] * n + t[:, :, 2]]
    return np.packbits(bits, axis=1).view(np.int64).reshape(len(at), 2)


def local_features(picture: np.ndarray, tests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column, scale) and descriptor of every corner, in strips that overlap, so that memory is bounded."""
    places, codes = [], []
    for scale in (1, 2):
        p = picture if scale == 1 else _halved(picture)
        lap = 4 * (PATCH + RADIUS)
        for top in range(0, max(1, len(p)), STRIP):
            lo, hi = max(0, top - lap), min(len(p), top + STRIP + lap)
            at = corners(p[lo:hi])
            at = at[(at[:, 0] + lo >= top) & (at[:, 0] + lo < top + STRIP)]
            codes.append(describe(p[lo:hi], at, tests))
            places.append(np.column_stack([(at + [lo, 0]) * scale, np.full(len(at), scale)]))
    return np.concatenate(places), np.concatenate(codes)


def _halved(picture: np.ndarray) -> np.ndarray:
    p = picture[: len(picture) // 2 * 2].astype(np.int32)
    return (p[::2, ::2] + p[1::2, ::2] + p[::2, 1::2] + p[1::2, 1::2]) // 4


def features_of(pictures: list[np.ndarray], tests: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """local_features of each picture with paper round it; many pictures are laid below each other and searched at once."""
    paper = np.full((GAP, WIDTH), 255, np.uint8)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    begin = 0
    while begin < len(pictures):
        end, rows, sheets, tops = begin, GAP, [paper], []
        while end < len(pictures) and (end == begin or rows + len(pictures[end]) + GAP <= SHEET):
            tops.append(rows)
            sheets += [pictures[end], paper]
            rows += len(pictures[end]) + GAP
            end += 1
        at, code = local_features(np.concatenate(sheets), tests)
        of = np.searchsorted(np.array(tops) - GAP // 2, at[:, 0], side="right") - 1
        order = np.argsort(of, kind="stable")
        at, code, of = at[order], code[order], of[order]
        cuts = np.searchsorted(of, np.arange(1, len(tops)))
        for top, a, c in zip(tops, np.split(at, cuts), np.split(code, cuts), strict=True):
            out.append((a - [top, 0, 0], c))
        begin = end
    return out


FOUND = "struct<picture:bigint,places:array<int>,a:array<bigint>,b:array<bigint>>"


def _features_of_pages(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    tests = _tests()
    for pages in batches:
        digests, places, codes, ends = [], [np.zeros(0, np.int32)], [np.zeros((0, 2), np.int64)], [0]
        for begin in range(0, len(pages), PAGES):
            pictures = [draw(html) for html in pages.slice(begin, PAGES).to_pylist()]
            for picture, (at, code) in zip(pictures, features_of(pictures, tests), strict=True):
                first = np.sort(np.unique(code, axis=0, return_index=True)[1]) if len(code) else np.zeros(0, np.int64)
                digests.append(int.from_bytes(hashlib.md5(picture.tobytes()).digest()[:8], "little", signed=True) if picture.size else None)
                places.append((at[first, 0] * WIDTH + at[first, 1]).astype(np.int32))
                codes.append(code[first])
                ends.append(ends[-1] + len(first))
        ends, code = pa.array(ends, pa.int32()), np.concatenate(codes)
        lists = [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(x))) for x in (np.concatenate(places), code[:, 0], code[:, 1])]
        yield pa.StructArray.from_arrays([pa.array(digests, pa.int64()), *lists], ["picture", "places", "a", "b"])


def page_features(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """Rows (id, picture, places, a, b): 64 bits that stand for each page's picture, where its corners are, and the halves of their descriptors."""
    found = only(pages, id_col, html).select(F.col(id_col).alias("id"), F.arrow_udf(_features_of_pages, FOUND)(F.col(html)).alias("f"))
    return found.select("id", "f.*")


def _entries() -> Column:
    """A corner's entries in the two tables, as rows: the half of its descriptor that is the key, marked with the table, and the rest."""
    a, b = F.col("a"), F.col("b")
    return F.array(F.struct(a.alias("key"), b.alias("rest")), F.struct(b.bitwiseXOR(F.lit(0x5DEECE66D)).alias("key"), a.alias("rest")))


def _ranges(low: np.ndarray, n: np.ndarray) -> np.ndarray:
    """low[i], low[i] + 1 and so on, n[i] numbers for each i."""
    return np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Pictures:
    """Pictures and their two tables; ends: where the corners of each end."""

    def __init__(self, node: np.ndarray, label: np.ndarray, ends: np.ndarray, places: np.ndarray, a: np.ndarray, b: np.ndarray):
        self.node, self.label, self.places, self.codes = node, label, places.astype(np.int64), [a, b]
        self.n = np.diff(ends, prepend=0)
        self.begin = ends - self.n
        self.of = np.repeat(np.arange(len(self.n)), self.n)
        self.keys, self.bucket, self.low, self.size, self.whose, self.rest, self.own = [], [], [], [], [], [], []
        for code, rest in zip(self.codes, self.codes[::-1], strict=True):
            order = np.argsort(code)
            keys, bucket = code[order], np.empty(len(code), np.int64)
            new = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
            low = np.flatnonzero(new)
            bucket[order] = np.cumsum(new) - 1
            self.keys.append(keys[low])
            self.bucket.append(bucket)  # of each corner
            self.whose.append(self.of[order].astype(np.int32))  # of the sorted corners, the picture and the rest
            self.rest.append(rest[order])
            self.low.append(np.append(low, 0))  # of each bucket, where it begins among the sorted corners; the last one is empty
            self.size.append(np.append(np.diff(low, append=len(keys)), 0))
            held = self.of * len(self.low[-1]) + bucket  # a picture's own corners in a bucket
            order = np.argsort(held)
            held = held[order]
            begin = np.flatnonzero(np.append(True, held[1:] != held[:-1])[: len(held)])
            self.own.append((held[begin], np.append(begin, 0), np.append(np.diff(begin, append=len(held)), 0), order))
        at = (self.of << 32) + self.places
        order = np.argsort(at, kind="stable")
        new = np.append(True, np.diff(at[order]) != 0)[: len(order)]
        self.first = np.empty(len(order), np.int64)  # of the corners at one place, the first
        self.first[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else 0

    def met_by(self, x: "Pictures") -> list[np.ndarray]:
        """For each table and corner of x, the bucket that it meets here; -1, which stands for the empty one, if it meets none."""
        met = []
        for keys, others, bucket in zip(self.keys, x.keys, x.bucket, strict=True):
            at = np.searchsorted(keys, others)
            met.append(np.where(np.searchsorted(keys, others, "right") > at, at, -1)[bucket])
        return met

    def alone(self, key: int, label: np.ndarray) -> np.ndarray:
        """For each bucket of a table, the label that all its corners have, -1 if they have several."""
        own, low = label[self.whose[key]], self.low[key][:-1]
        least = np.minimum.reduceat(own, low)
        return np.append(np.where(least == np.maximum.reduceat(own, low), least, -1), -1)


def agreeing(x: Pictures, y: Pictures, p: np.ndarray, q: np.ndarray, met: list[np.ndarray]) -> np.ndarray:
    """How many places of each of two pictures, p[i] of x and q[i] of y, have a match whose shift VOTES matches have; of the two numbers the smaller."""
    mine, of = _ranges(x.begin[p], x.n[p]), np.repeat(np.arange(len(p)), x.n[p])
    found = []
    for key, rest in ((0, 1), (1, 0)):
        some = met[key][mine] >= 0
        i, c = mine[some], of[some]
        held, begin, size, order = y.own[key]
        wanted = q[c] * len(y.low[key]) + met[key][i]
        at = np.searchsorted(held, wanted)
        n = np.where(np.append(held, -1)[at] == wanted, size[at], 0)
        c, i, j = np.repeat(c, n), np.repeat(i, n), order[_ranges(begin[at], n)]
        near = np.bitwise_count(x.codes[rest][i] ^ y.codes[rest][j]) <= FAR
        found.append(np.stack([c[near], x.first[i[near]], y.first[j[near]]]))
    c, i, j = np.concatenate(found, axis=1)
    local = lambda z, k, of: z - of.begin[k]
    wide = int(y.n.max(initial=0)) + 1
    code = np.unique((c * (int(x.n.max(initial=0)) + 1) + local(i, p[c], x)) * wide + local(j, q[c], y))
    high, j = code // wide, code % wide
    c, i = high // (int(x.n.max(initial=0)) + 1), high % (int(x.n.max(initial=0)) + 1)
    i, j = i + x.begin[p[c]], j + y.begin[q[c]]
    one, two = x.places[i], y.places[j]
    shift = (one // WIDTH - two // WIDTH) * 2 * WIDTH + one % WIDTH - two % WIDTH
    _, group, n = np.unique((c << 34) + shift, return_inverse=True, return_counts=True)
    keep = n[group] >= VOTES
    c, i, j = c[keep], i[keep], j[keep]
    count = lambda z, n: np.bincount(np.unique(c * n + z) // n, minlength=len(p))
    return np.minimum(count(i, len(x.places) + 1), count(j, len(y.places) + 1))


def votes(one: tuple[np.ndarray, np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray, np.ndarray]) -> int:
    """agreeing of two pictures (places, a, b)."""
    zero = np.zeros(1, np.int64)
    x, y = (Pictures(zero, zero, np.array([len(places)]), places, a, b) for places, a, b in (one, two))
    return int(agreeing(x, y, zero, zero, y.met_by(x))[0])


KINDS = {"node": np.int64, "label": np.int64, "ends": np.int64, "places": np.int32, "a": np.uint64, "b": np.uint64}
BLOCK = "block long, " + ", ".join(f"{c} binary" for c in KINDS)


def _block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (node, places, a, b) of a task as rows of bytes, each a block of 2 * CORNERS corners at most, or of one picture, named by its smallest node.

    A picture's label is the smallest node that the block's own links join it with.
    """
    held: list[pa.RecordBatch] = []
    seen = 0
    for batch in batches:
        n = pc.list_value_length(batch["places"]).to_numpy(zero_copy_only=False)
        begin = 0
        while begin < len(batch):
            end = begin + int(np.searchsorted(np.cumsum(n[begin:]), 2 * CORNERS - seen, "right"))
            if end == begin and held:
                yield _whole(held)
                held, seen = [], 0
                continue
            end = max(end, begin + 1)
            held.append(batch.slice(begin, end - begin))
            seen, begin = seen + int(n[begin:end].sum()), end
    if held:
        yield _whole(held)


def _whole(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(held).combine_chunks()
    flat = lambda c, kind: rows[c].chunk(0).flatten().to_numpy(zero_copy_only=False).astype(kind)
    node, ends = rows["node"].to_numpy(), np.cumsum(pc.list_value_length(rows["places"]).to_numpy()).astype(np.int64)
    corners = [flat("places", np.int32), *(flat(c, np.int64).view(np.uint64) for c in ("a", "b"))]
    x = Pictures(node, node, ends, *corners)
    label, (joined, to) = node.copy(), _links(x, x)
    order = np.argsort(node)
    label[order[np.searchsorted(node, joined, sorter=order)]] = to
    cells = [pa.array([int(node.min())]), *[pa.array([z.tobytes()], pa.binary()) for z in (node, label, ends, *corners)]]
    return pa.RecordBatch.from_arrays(cells, ["block", *KINDS])


def _asked(x: Pictures, y: Pictures, met: list[np.ndarray], mine: np.ndarray, yours: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (number in x, number in y), some pictures of x at a time, that may be linked: of other labels, x's the smaller one.

    Of two linked pictures the smaller has SHARE of its corners, and VOTES of them at least, in buckets of the other: what
    shares fewer cannot be linked. So of the t places that have to agree, a picture keeps back t - HITS, those that meet the
    most corners, asks by all others, and what it meets in HITS of them may be linked. The labels, mine and yours, may be joined
    between two steps; buckets whose corners all have the asking picture's label are not opened.
    """
    meets = [size[bucket] for size, bucket in zip(y.size, met, strict=True)]
    weight = meets[0] + meets[1] - 2 * (x is y)  # a corner meets itself
    order = np.flatnonzero(weight > 0)
    order = order[np.lexsort((weight[order], x.of[order]))]
    m = np.bincount(x.of[order], minlength=len(x.n))
    rank = np.arange(len(order)) - (np.cumsum(m) - m)[x.of[order]]
    needed = np.maximum(VOTES, np.ceil(x.n * SHARE)).astype(np.int64)
    hits = np.minimum(needed, HITS)
    asks = np.sort(order[(rank < (m - needed + hits)[x.of[order]]) & (m >= needed)[x.of[order]]])
    rank = np.empty(len(x.n) + len(y.n), np.int32)
    rank[np.lexsort((np.append(x.node, y.node), np.append(x.n, y.n)))] = np.arange(len(rank))
    while len(asks):
        of = x.of[asks]
        opened = [np.where(y.alone(k, yours)[met[k][asks]] == mine[of], 0, meets[k][asks]) for k in (0, 1)]
        end = int(np.searchsorted(np.cumsum(opened[0] + opened[1]), MEETINGS, "right"))
        if end < len(asks):  # whole pictures, one at least
            end = int(np.searchsorted(of, of[end])) or int(np.searchsorted(of, of[0], "right"))
        part, found = asks[:end], []
        for key, rest in ((0, 1), (1, 0)):
            n = opened[key][:end]
            i, at = np.repeat(part, n), _ranges(y.low[key][met[key][part]], n)
            p, q = np.repeat(of[:end], n), y.whose[key][at]
            keep = (rank[p] < rank[len(x.n) + q]) & (mine[p] != yours[q])
            i, at, p, q = i[keep], at[keep], p[keep], q[keep]
            differ = np.bitwise_count(x.codes[rest][i] ^ y.rest[key][at])
            keep = (differ <= FAR) & (differ >= key)  # equal ones meet in both tables
            found.append(p[keep] * len(y.n) + q[keep])
        pairs, n = np.unique(np.concatenate(found), return_counts=True)
        pairs = pairs[n >= hits[pairs // len(y.n)]]
        yield pairs // len(y.n), pairs % len(y.n)
        asks = asks[end:]


def _links(x: Pictures, y: Pictures) -> tuple[np.ndarray, np.ndarray]:
    """Links of labels of pictures of x and of y, each to the smallest that it is joined with; what is joined is not compared again."""
    names, label = np.unique(np.concatenate([x.label, y.label]), return_inverse=True)
    up = np.arange(len(names))
    root = up.tolist()

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    labels = [label[: len(x.label)].copy(), label[len(x.label) :].copy()]
    for one, two, mine, yours in ((x, y, *labels),) if x is y else ((x, y, *labels), (y, x, *labels[::-1])):
        met = two.met_by(one)
        for p, q in _asked(one, two, met, mine, yours):
            corners = np.cumsum(one.n[p] + two.n[q])
            for own, other in zip(*(np.split(z, np.searchsorted(corners, np.arange(MEETINGS, corners[-1], MEETINGS))) for z in (p, q)), strict=True) if len(p) else ():
                apart = mine[own] != yours[other]
                own, other = own[apart], other[apart]
                near = agreeing(one, two, own, other, met) >= SHARE * one.n[own]
                for u, v in zip(mine[own[near]].tolist(), yours[other[near]].tolist(), strict=True):
                    i, j = find(u), find(v)
                    root[max(i, j)] = min(i, j)
                if near.any():
                    up = np.array(root)
                    while not np.array_equal(up, up[up]):
                        up = up[up]
                    mine[:], yours[:] = up[mine], up[yours]
    joined = np.flatnonzero(up != np.arange(len(up)))
    return names[joined], names[up[joined]]


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (node, hub) from pairs of blocks: of a block and itself those that it came with, of two those between their labels."""
    last: dict[int, Pictures] = {}

    def opened(row: dict, prefix: str) -> Pictures:
        name = row[f"{prefix}block"]
        if name not in last:
            while len(last) >= OPENED:
                del last[next(iter(last))]
            last[name] = Pictures(*[np.frombuffer(row[prefix + c], kind) for c, kind in KINDS.items()])
        last[name] = last.pop(name)
        return last[name]

    for batch in batches:
        for row in batch.to_pylist():
            x = opened(row, "")
            if row["block"] == row["o_block"]:
                links = [z[x.node != x.label] for z in (x.node, x.label)]
            else:
                links = _links(x, opened(row, "o_"))
            yield pa.RecordBatch.from_arrays([pa.array(z, pa.int64()) for z in links], ["node", "hub"])


def _all_links(features: DataFrame, drawn: DataFrame) -> DataFrame:
    """Links (node, hub) that join the pictures of each class, written once.

    Blocks of about CORNERS corners are made of whole buckets of the features' files, without a shuffle, and written once;
    then they meet each other two at a time, where each picture's corners are at hand; so neither entries nor matches nor
    pairs are shuffled.
    """
    spark, size = drawn.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    corners = features.where("picture is not null").groupBy("picture").agg(F.max(F.size("places")).alias("n")).agg(F.sum("n")).first()[0] or 0
    blocks = staged(drawn.where(F.size("places") >= VOTES).coalesce(-(-corners // CORNERS) or 1).mapInArrow(_block, BLOCK))
    other = blocks.select(*[F.col(c).alias(f"o_{c}") for c in blocks.columns])
    was = spark.conf.get(size)
    spark.conf.set(size, "1")  # two blocks at a time
    try:
        return staged(blocks.hint("shuffle_replicate_nl").join(other, F.col("block") <= F.col("o_block")).mapInArrow(_linked, "node long, hub long"))
    finally:
        spark.conf.set(size, was)


def copies(features: DataFrame) -> DataFrame:
    """Rows (id, class_id, n_corners) from rows (id, picture, places, a, b)."""
    features = bucketed(features, "picture")
    drawn = features.where("picture is not null").select(F.col("picture").alias("node"), "places", "a", "b").dropDuplicates(["node"])
    label = components(_all_links(features, drawn))
    placed = features.select("id", F.col("picture").alias("node"), F.size("places").alias("n_corners")).join(label, "node", "left")
    placed = placed.withColumn("label", F.coalesce("label", "node"))
    least = staged(placed.where("label is not null").groupBy("label").agg(F.min("id").alias("class_id")))
    own = F.when(F.col("label").isNull(), F.col("id")).otherwise(F.col("class_id"))
    return placed.join(least, "label", "left").select("id", own.alias("class_id"), "n_corners")
