"""SimHash near-duplicates: fingerprints embedded as bit counts of segments, met in a grid under Manhattan distance.

Fingerprint: a bit is 1 if it is set in over half of the XXH64 hashes (seed 42) of a text's word shingles, repeats
included. Equal fingerprints are one node.

Embedding: a fingerprint becomes 32 numbers, the bits set in each of its 32 segments of two bits. The Manhattan distance
of two such points is never more than the Hamming distance of the fingerprints. Where it is at most 3, one of the two
halves of the points (16 numbers each) differs by at most 1. So the grid has a cell for each point of a half, and a
fingerprint lies in its own cell and, for each of the half's numbers, in the cell that has one more there: of two
halves that differ by 1 in one place, the lower one reaches the other's cell. This range join finds every link.

Verifying: the members of a cell are compared by the bits in which they differ, exactly. A cell gives a forest of its
links, never its pairs; cells of over BLOCK members are dealt into parts, and each two parts meet in a task of their
own. Classes are the connected components of the links.

Defined cases: a null text counts as empty; a text without a word has fingerprint zero, linked like any other; fewer
words than a shingle has make one shingle of all; a class without any non-null id has a null id, and a null id never
names another class; repeated rows are each in the class; an empty table gives an empty result; further columns of any
name play no part. Texts are read whole. Intermediate tables are written when the functions are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenio.llm.common import only, staged
from provenio.llm.dartminhash import components, least_id, ordered_node
from provenio.llm.shingles import slices

SHINGLE, SEED = 3, 42
DISTANCE = 3
#: Members of a cell that are compared at once, and cells of at most so many members that are compared side by side.
BLOCK, SMALL = 8192, 8
#: Hashes whose bits are counted at a time.
STEP = 1 << 16
_PAIRS = 0x55555555


def text_hashes(text: bytes, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """XXH64 of the text's shingles, STEP of them at a time at most."""
    words = text.lower().split()  # of bytes: A to Z alone, and blanks alone
    if not words:
        return
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.append(0, ends[:-1] + 1)
    n = max(1, len(words) - size + 1)
    begins, ends = begins[:n], ends[len(words) - n :]
    for at in range(0, n, STEP):
        cut = zip(begins[at : at + STEP].tolist(), ends[at : at + STEP].tolist(), strict=True)
        yield np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in cut], np.uint64)


def fingerprints(texts: Iterator[bytes], n: int) -> np.ndarray:
    """The fingerprints of n texts."""
    bits, total = np.zeros((n, 64), np.int64), np.zeros(n, np.int64)
    held: list[np.ndarray] = []
    owner: list[int] = []

    def count() -> None:
        if held:
            sizes = np.array([len(x) for x in held])
            each = np.unpackbits(np.concatenate(held).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            np.add.at(bits, owner, np.add.reduceat(each, np.cumsum(sizes) - sizes, axis=0, dtype=np.int32))
            np.add.at(total, owner, sizes)
            held.clear()
            owner.clear()

    waiting = 0
    for i, text in enumerate(texts):
        for h in text_hashes(text):
            held.append(h)
            owner.append(i)
            waiting += len(h)
            if waiting >= STEP:
                count()
                waiting = 0
    count()
    return np.packbits(2 * bits > total[:, None], axis=1, bitorder="little").view("<u8").ravel()


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for raw, starts in slices(batch["text"]):
            cuts = zip(starts.tolist(), [*starts[1:].tolist(), len(raw)], strict=True)
            found = fingerprints((raw[a:b].tobytes() for a, b in cuts), len(starts))
            yield pa.RecordBatch.from_arrays([batch["id"][at : at + len(starts)], pa.array(found.view(np.int64))], ["id", "print"])
            at += len(starts)


def prints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (id long, print long): the fingerprint of each whole text."""
    rows = only(docs, id_col, text).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(_signed, "id long, print long")


def cells(print_: Column) -> Column:
    """The cells of a fingerprint in the grids of both halves, as numbers: a half's counts in 32 bits, and the half."""
    out = []
    for i, half in enumerate((print_.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(print_, 32))):
        half = half.bitwiseAND(F.lit(_PAIRS)) + F.shiftright(half, 1).bitwiseAND(F.lit(_PAIRS))  # two bits for each segment
        own = half + F.lit(i << 32)
        reached = [F.when(F.shiftright(half, 2 * k).bitwiseAND(F.lit(3)) < 2, own + F.lit(1 << 2 * k)) for k in range(16)]
        out += [own, *reached]
    return F.array_compact(F.array(*out))


def forest(found: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (places) that join different numbers that are linked, directly or through others of them; one fewer than the numbers of a component."""
    left, front = np.arange(1, len(found)), [0]
    one, two = [], []
    while len(left):
        if not front:
            front, left = [int(left[0])], left[1:]
        i = front.pop()
        near = np.bitwise_count(found[left] ^ found[i]) <= distance
        if near.any():
            new = left[near]
            one.append(np.full(len(new), i))
            two.append(new)
            front += new.tolist()
            left = left[~near]
    return (np.concatenate(one), np.concatenate(two)) if one else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _cell_links(distance: int):
    """Links (print, other) from rows (cell, a, b, print) in order of the cell and its two parts; a cell may go over batches."""

    def of(key: np.ndarray, found: np.ndarray) -> Iterator[pa.RecordBatch]:
        begin = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1))) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(begin, len(key)))
        group = np.repeat(np.arange(len(begin)), size)
        small = np.repeat(size <= SMALL, size)
        one, two = [], []
        for step in range(1, SMALL):
            at = np.flatnonzero(small[step:] & (group[step:] == group[:-step]))
            if not len(at):
                break
            at = at[np.bitwise_count(found[at] ^ found[at + step]) <= distance]
            one.append(at)
            two.append(at + step)
        for g in np.flatnonzero(size > SMALL):
            x, y = forest(found[begin[g] : begin[g] + size[g]], distance)
            one.append(begin[g] + x)
            two.append(begin[g] + y)
        if any(map(len, one)):
            x, y = found[np.concatenate(one)], found[np.concatenate(two)]
            pairs = [pa.array(np.minimum(x, y).view(np.int64)), pa.array(np.maximum(x, y).view(np.int64))]
            yield pa.RecordBatch.from_arrays(pairs, ["print", "other"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, prints_ = np.zeros((0, 3), np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            if not len(batch):
                continue
            key = np.stack([batch[c].to_numpy().astype(np.int64) for c in ("cell", "a", "b")], axis=1)
            keys, prints_ = np.concatenate([keys, key]), np.concatenate([prints_, batch["print"].to_numpy().view(np.uint64)])
            last = (keys == keys[-1]).all(axis=1)
            whole = len(keys) - int(last[::-1].argmin() if not last.all() else len(keys))  # the last cell may go on
            yield from of(keys[:whole], prints_[:whole])
            keys, prints_ = keys[whole:], prints_[whole:]
        yield from of(keys, prints_)

    return each


def links(found: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (print, other) between different fingerprints (print) of at most so many differing bits: enough to join all that are linked."""
    if not 0 <= distance <= 3:
        raise ValueError("the grid of two halves, one step apart at most, holds for distances of 0 to 3")
    entries = found.select("print", F.explode(cells(F.col("print"))).alias("cell"))
    hot = staged(entries.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK))
    met = entries.join(hot, "cell", "left").withColumn("parts", F.ceil(F.coalesce("n", F.lit(1)) / BLOCK).cast("int"))
    own = F.pmod(F.xxhash64("print", "cell"), F.col("parts")).cast("int")
    met = met.select("cell", "print", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("with"))
    met = met.select("cell", F.least("own", "with").alias("a"), F.greatest("own", "with").alias("b"), "print")
    dealt = met.repartition("cell", "a", "b").sortWithinPartitions("cell", "a", "b")
    return dealt.mapInArrow(_cell_links(distance), "print long, other long").distinct()


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """Rows (id, print, component_id): component_id is the smallest id that links lead to."""
    signed = staged(prints(docs, id_col, text))
    nodes = signed.groupBy("print").agg(F.min("id").alias("least"))
    name = ordered_node(F.col("least"), F.unhex(F.lpad(F.hex("print"), 16, "0")))
    nodes = staged(nodes.select("print", name.alias("node")))
    linked = staged(links(nodes.select("print"), distance))
    named = linked.join(nodes, "print").select("node", F.col("other").alias("print"))
    named = named.join(nodes.withColumnRenamed("node", "hub"), "print").select("node", "hub")
    label = components(named)
    classed = nodes.join(label, "node", "left").select("print", least_id(F.coalesce("label", "node")).alias("component_id"))
    return signed.join(staged(classed), "print").select(F.col("id").alias(id_col), "print", "component_id")
