"""Near-duplicate classes by DartMinHash signatures and banded joining.

Darts: every element owns a strip of the plane for each unit of its weight. Darts land in
a strip as a Poisson process of its own, seeded by the element, one in each unit of rank
on average, each with a coordinate of the signature. A document throws all darts up to a
rank at which its total weight expects enough of them to meet every coordinate, and keeps
the earliest of each coordinate; if one stays empty, it throws on to twice the rank. Two
documents agree in a coordinate with the probability of their weighted Jaccard
similarity. The cost is a number of darts, not of elements times coordinates.

Joining: equal texts are one node, and nodes that share a band of the signature share a
bucket. In each bucket, dealt into blocks of BLOCK members at most, a forest of the most
similar members is compared first; so a group of copies becomes one component by about one
comparison for each member and band. Then, in every bucket that still holds several
components, each member outside its largest component meets all members of other
components, block by block, where their shingles are at hand, so that a group gives links,
never its pairs. Pairs are compared exactly, as multisets of hashed shingles, unless a byte of each coordinate already rules them out: LEAST_ALIKE lies 3.8 deviations
under what a similarity of 0.8 expects. So all links that the bands can show are found or
implied, whatever the size of a bucket. Classes are the connected components of the links.

Similarity is the weighted Jaccard similarity: shingles count as often as they occur, both
in the signatures and in the comparison; with `weighted=False` both take sets.

Defined cases: null texts and texts without a word are alone in their class, except that
equal texts always share one (null apart); a text of fewer than five words has one
shingle of all its words; an id that is null comes last: its class has the smallest id of
those that are not null, and null if there is none; repeated rows are each in the class;
an empty table gives an empty result. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenio.llm.common import only, staged
from provenio.llm.shingles import mix, shingle_sets, slices

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 6
#: Pairs are compared if so many bytes of their sketches agree; 0.8 expects 0.8 of 120, with a deviation of 0.037.
LEAST_ALIKE = 0.66
#: Members that are searched for a forest at a time, and members outside a bucket's largest component that meet so many others at a time.
BLOCK, OUTSIDE, OTHERS = 512, 256, 4096
SIGNED = "id long, node binary, bands array<bigint>, sketch binary"


def _darts(seeds: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(strip, dart, rank) of all darts of strips up to their reach. A strip's darts don't depend on its reach."""
    found = []
    going, rank = np.arange(len(seeds)), np.zeros(len(seeds))
    many = reach > 16
    for n in range(1, 1 << 30):
        going = going[~many[going]] if n == 1 else going
        if not len(going):
            break
        dart = mix(seeds[going] + np.uint64(n * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF))
        rank[going] -= np.log(((dart >> np.uint64(11)) + np.uint64(1)) * 2.0**-53)
        in_reach = rank[going] < reach[going]
        going = going[in_reach]
        found.append((going, dart[in_reach], rank[going]))
    left = np.flatnonzero(many)  # few elements, many darts: all darts of a strip at once
    while len(left):
        n = int(np.ceil(reach[left].max() * 1.2 + 12 * np.sqrt(reach[left].max())))
        rows = max(1, (1 << 20) // n)
        part, left = left[:rows], left[rows:]
        dart = mix(seeds[part][:, None] + np.arange(1, n + 1, dtype=np.uint64)[None, :] * np.uint64(0xA0761D6478BD642F))
        ranks = np.cumsum(-np.log(((dart >> np.uint64(11)) + np.uint64(1)) * 2.0**-53), axis=1)
        in_reach = ranks < reach[part][:, None]
        at, col = np.nonzero(in_reach)
        found.append((part[at], dart[at, col], ranks[at, col]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """Signatures of n weighted sets, k numbers each; all 0 for a set without elements. owner ascends."""
    weight = weight.astype(float)
    strips = np.ceil(weight).astype(np.int64)
    at = np.repeat(np.arange(len(element)), strips)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(strips) - strips, strips)
    own = owner[at]
    seeds = mix(element[at] + nth.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))
    width = np.minimum(1.0, weight[at] - nth)
    total = np.bincount(owner, weight, n)
    reach = np.divide(k * (np.log(k) + 3), total, out=np.zeros(n), where=total > 0)
    out = np.zeros((n, k), np.uint64)
    todo = total > 0
    while todo.any():
        use = np.flatnonzero(todo[own])
        strip, dart, rank = _darts(seeds[use], reach[own[use]])
        strip = use[strip]
        token = mix(dart ^ np.uint64(0x8EBC6AF09C88C6E3))
        inside = (token >> np.uint64(40)) * 2.0**-24 < width[strip]
        strip, dart, rank, token = strip[inside], dart[inside], rank[inside], token[inside]
        place = own[strip] * k + (token % np.uint64(k)).astype(np.int64)
        earliest = np.full(n * k, np.inf)
        np.minimum.at(earliest, place, rank)
        first = rank == earliest[place]
        out.reshape(-1)[place[first]] = dart[first] | np.uint64(1)
        reach = reach * 2
        todo &= (out == 0).any(axis=1)
        out[todo] = 0
    return out


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """One number for each set and band."""
    parts = sig.reshape(len(sig), bands, -1)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(parts.shape[2]):
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, i])
    return key.view(np.int64)


def _signed(bands: int, rows: int, weighted: bool):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for raw, starts in slices(batch["text"]):
                n = len(starts)
                owner, code, times = shingle_sets(raw, starts, SHINGLE)
                sig = signatures(owner, code, times if weighted else np.ones(len(code)), n, bands * rows)
                some = np.bincount(owner, minlength=n) > 0
                ends = np.cumsum(np.append(0, some * bands)).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(ends, mask=np.append(~some, False)), pa.array(band_keys(sig, bands)[some].ravel()))
                short = (sig >> np.uint64(56)).astype(np.uint8)
                sketch = pa.array([x.tobytes() if y else None for x, y in zip(short, some.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch["id"][at : at + n], batch["node"][at : at + n], keys, sketch], ["id", "node", "bands", "sketch"])
                at += n

    return each


def _sets(weighted: bool):
    """Rows (node, items): hashes of the shingles; one that occurs again has further hashes."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for raw, starts in slices(batch["text"]):
                owner, code, times = shingle_sets(raw, starts, SHINGLE)
                if weighted and len(times):
                    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    owner, code = np.repeat(owner, times), np.repeat(code, times)
                    code = np.where(nth == 0, code, mix(code + nth.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB)))
                ends = np.cumsum(np.append(0, np.bincount(owner, minlength=len(starts)))).astype(np.int32)
                items = pa.ListArray.from_arrays(pa.array(ends), pa.array(code.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch["node"][at : at + len(starts)], items], ["node", "items"])
                at += len(starts)

    return each


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (node, hub) whose exact Jaccard similarity suffices."""
    left = sets.select(F.col("node"), F.col("items").alias("a"))
    right = sets.select(F.col("node").alias("hub"), F.col("items").alias("b"))
    both = pairs.join(left, "node").join(right, "hub").withColumn("common", F.size(F.array_intersect("a", "b")))
    return both.where(F.col("common") / (F.size("a") + F.size("b") - F.col("common")) >= similarity).select("node", "hub")


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bytes of the sketches agree, for each row of a and of b."""
    out = np.empty((len(a), len(b)), np.int16)
    for at in range(0, len(a), 16):
        out[at : at + 16] = (a[at : at + 16, None, :] == b[None, :, :]).sum(axis=2)
    return out


def _forest(sketches: np.ndarray) -> np.ndarray:
    """Prim's forest of the most similar members of a block, as pairs of rows; similarities are estimated from the sketches."""
    m, k = sketches.shape
    alike = _alike(sketches, sketches)
    best, link = alike[0].copy(), np.zeros(m, np.int64)
    best[0] = -1
    tree = np.zeros((m - 1, 2), np.int64)
    for i in range(m - 1):
        new = int(best.argmax())
        tree[i] = new, link[new]
        closer = (alike[new] > best) & (best >= 0)
        best[closer], link[closer] = alike[new][closer], new
        best[new] = -1
    return tree[alike[tree[:, 0], tree[:, 1]] >= LEAST_ALIKE * k]


def _grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of one group at a time, from rows in order of the keys; a group may go over batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        parts = [batch[k].to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(len(batch), bool)
        for part in parts:
            new[1:] |= part[1:] != part[:-1]
        new[0] = not held or any(held[-1][k][-1].as_py() != batch[k][0].as_py() for k in keys)
        cuts = [*np.flatnonzero(new).tolist(), len(batch)]
        if cuts[0]:
            held.append(batch.slice(0, cuts[0]))
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held:
                yield pa.Table.from_batches(held)
            held = [batch.slice(a, b - a)]
    if held:
        yield pa.Table.from_batches(held)


def _sketches(group: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(group["sketch"].to_pylist()), np.uint8).reshape(len(group), -1)


def _pairs(left: list[bytes], right: list[bytes]) -> pa.RecordBatch:
    both = [(x, y) if x < y else (y, x) for x, y in zip(left, right, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in both], pa.binary()), pa.array([y for _, y in both], pa.binary())], ["node", "hub"])


def _first_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A forest of each block from rows (key, block, node, sketch)."""
    for group in _grouped(batches, ("key", "block")):
        if len(group) > 1:
            node = group["node"].to_pylist()
            found = _forest(_sketches(group)).tolist()
            yield _pairs([node[x] for x, _ in found], [node[y] for _, y in found])


def _further_links_of(similarity: float):
    """Links (label, label) from rows (key, part, other, outside, node, label, sketch, items).

    Members outside the largest component meet all of other components, the most alike first. Components that a link has
    joined aren't compared again, so that a group gives less links than it has components.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, ("key", "part", "other")):
            outside = group["outside"].to_numpy(zero_copy_only=False)
            a, b = np.flatnonzero(outside), np.flatnonzero(~outside)
            if not len(a) or not len(b):
                continue
            sketches, label = _sketches(group), group["label"].to_pylist()
            names = {x: i for i, x in enumerate(sorted(set(label)))}
            code = np.fromiter((names[x] for x in label), np.int64, len(label))
            alike = _alike(sketches[a], sketches[b])
            x, y = np.nonzero((alike >= LEAST_ALIKE * sketches.shape[1]) & (code[a][:, None] != code[b][None, :]))
            order = np.argsort(-alike[x, y], kind="stable")
            items = group["items"].combine_chunks()
            ends, flat = items.offsets.to_numpy(), items.values.to_numpy()
            sets = lambda i: flat[ends[i] : ends[i + 1]]  # noqa: B023, E731
            root = list(range(len(names)))

            def find(i: int) -> int:
                while root[i] != i:  # noqa: B023
                    root[i] = root[root[i]]  # noqa: B023
                    i = root[i]  # noqa: B023
                return i

            found: list[tuple[bytes, bytes]] = []
            for i, j in zip(a[x[order]].tolist(), b[y[order]].tolist(), strict=True):
                u, v = find(code[i]), find(code[j])
                if u == v:
                    continue
                one, two = sets(i), sets(j)
                if min(len(one), len(two)) < similarity * max(len(one), len(two)):
                    continue
                common = len(np.intersect1d(one, two, assume_unique=True))
                if common >= similarity * (len(one) + len(two) - common):
                    root[u] = v
                    found.append((label[i], label[j]))
            if found:
                yield _pairs([x for x, _ in found], [y for _, y in found])

    return each


def _first_links(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links of the forests among the members (key, node, n, sketch) of buckets of n."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = members.select("key", F.pmod(F.xxhash64("node", "key"), blocks).cast("int").alias("block"), "node", "sketch")
    dealt = dealt.repartition("key", "block").sortWithinPartitions("key", "block")
    pairs = staged(dealt.mapInArrow(_first_pairs, "node binary, hub binary").distinct())
    return staged(_similar(pairs, sets, similarity))


def _further_links(members: DataFrame, label: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links between components (node, hub), by their labels, of members that share a bucket; buckets of the same members count once."""
    placed = staged(members.join(label, "node", "left").withColumn("label", F.coalesce("label", "node")))
    counts = staged(placed.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("sum")))
    several = counts.groupBy("key").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("n"), F.count("*").alias("labels"), F.sum("sum").alias("sum"))
    several = several.where("labels > 1").groupBy("n", "labels", "sum").agg(F.min(F.struct("key", "most")).alias("x"))
    several = several.select("x.key", F.col("x.most.label").alias("largest"), F.col("x.most.n").alias("inside"), "n")
    several = staged(several.select("key", "largest", F.ceil((F.col("n") - F.col("inside")) / OUTSIDE).cast("int").alias("parts"), F.ceil(F.col("n") / OTHERS).cast("int").alias("others")))
    opened = placed.drop("n").join(several, "key").join(sets, "node")
    deal = lambda n: F.pmod(F.xxhash64("node", "key"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ("key", "part", "other", "outside", "node", "label", "sketch", "items")
    left = opened.where("label <> largest").withColumn("part", deal("parts")).withColumn("other", every("others")).withColumn("outside", F.lit(True))
    right = opened.withColumn("other", deal("others")).withColumn("part", every("parts")).withColumn("outside", F.lit(False))
    groups = left.select(*columns).unionByName(right.select(*columns)).repartition("key", "part", "other").sortWithinPartitions("key", "part", "other")
    return staged(groups.mapInArrow(_further_links_of(similarity), "node binary, hub binary").distinct())


def components(links: DataFrame) -> DataFrame:
    """Rows (node, label) of the nodes in links (node, hub): label is the smallest node of the connected component.

    Labels go to neighbours and to the label's own label until none changes; each round is written, so that a lost
    executor costs no earlier one, and its joins, which many nodes of one label meet, have no aggregate on their keys.
    """
    both = links.unionByName(links.select(F.col("hub").alias("node"), F.col("node").alias("hub"))).distinct()
    edges = staged(both)
    labels = staged(edges.groupBy("node").agg(F.least("node", F.min("hub")).alias("label")))
    while True:
        told = edges.join(labels.select(F.col("node").alias("hub"), "label"), "hub").groupBy("node").agg(F.min("label").alias("told"))
        near = labels.join(told, "node").select("node", F.col("label").alias("was"), F.least("label", "told").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("root"))
        now = staged(near.join(up, "label").select("node", "was", F.least("label", "root").alias("label")))
        if now.where("label <> was").isEmpty():
            return now.select("node", "label")
        labels = now.select("node", "label")


_SIGN = -(1 << 63)


def ordered_node(least: Column, text: Column) -> Column:
    """A binary name of a text whose order is that of the smallest id that has it; null ids come last."""
    number = F.lpad(F.hex(least.cast("long").bitwiseXOR(F.lit(_SIGN))), 16, "0")
    return F.unhex(F.concat(F.when(least.isNull(), F.lit("010000000000000000")).otherwise(F.concat(F.lit("00"), number)), F.hex(text)))


def least_id(node: Column) -> Column:
    """The id that ordered_node holds."""
    number = F.conv(F.hex(F.substring(node, 2, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(_SIGN))
    return F.when(F.substring(node, 1, 1) == F.unhex(F.lit("00")), number)


def keyed(id_: Column, node: Column) -> Column:
    """One name for an id, which may be null, and a text."""
    return F.concat(F.coalesce(F.hex(id_), F.lit("-")), F.lit(":"), F.coalesce(F.hex(node), F.lit("-")))


def classes(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS,
    weighted: bool = True,
) -> DataFrame:
    """Rows (id, node, class_id, first): node stands for the text, class_id is the smallest id of the class; first: the row is
    the one, or repeats the one, that the class is named by.
    """
    base = only(docs, id_col, text).select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).withColumn("node", F.unhex(F.md5(F.col("text").cast("binary"))))
    signed = staged(base.mapInArrow(_signed(bands, rows, weighted), SIGNED))
    same = signed.where("node is not null").groupBy("node").agg(F.min("id").alias("least"), F.any_value(F.struct("bands", "sketch")).alias("s"))
    nodes = staged(same.select(F.col("node").alias("md5"), "least", ordered_node(F.col("least"), F.col("node")).alias("node"), "s.*"))
    entries = nodes.where("bands is not null").select("node", F.explode("bands").alias("key"))
    shared = staged(entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    met = staged(entries.join(shared, "key"))
    wanted = staged(met.select("node").distinct().join(nodes.select("node", "md5", "least", "sketch"), "node"))
    members = met.join(wanted.select("node", "sketch"), "node")
    one_each = wanted.select(keyed(F.col("least"), F.col("md5")).alias("name"), F.col("node").alias("of"))  # one row of all that have the text
    texts = base.where("text is not null").withColumn("name", keyed(F.col("id"), F.col("node"))).select("name", "text").join(one_each.hint("shuffle_hash"), "name")
    sets = texts.select(F.col("of").alias("node"), "text").mapInArrow(_sets(weighted), "node binary, items array<bigint>")
    sets = staged(sets.groupBy("node").agg(F.any_value("items").alias("items")))  # rows of one id and text
    first = components(_first_links(members, sets, similarity))
    second = components(_further_links(members, first, sets, similarity))
    second = second.select(F.col("node").alias("label"), F.col("label").alias("root"))
    alone = second.join(first.select(F.col("node").alias("label")), "label", "left_anti").select(F.col("label").alias("node"), "root")
    label = first.join(second, "label", "left").select("node", F.coalesce("root", "label").alias("root")).unionByName(alone)
    root = F.coalesce("root", "node")
    classed = nodes.select("md5", "least", "node").join(label, "node", "left")
    classed = staged(classed.select(F.col("md5").alias("node"), "least", least_id(root).alias("class_id"), (root == F.col("node")).alias("root")))
    own = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("class_id"))
    first = F.col("node").isNull() | (F.col("root") & F.col("id").eqNullSafe(F.col("least")))
    return signed.select("id", "node").join(classed, "node", "left").select(F.col("id").alias(id_col), "node", own.alias("class_id"), first.alias("first"))
