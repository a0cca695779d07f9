"""Language-model scores by a weighted backoff automaton of word n-grams.

The automaton: the root knows every word by its add-one probability. Every n-gram of the
training texts is a state; none is left out, and no number of rows bounds them. Smoothing
is by a Dirichlet prior of weight PRIOR: an arc leads from a state by a word, at
(c(state, word) + PRIOR * p(word at the failure state)) / (c(state) + PRIOR), to the longest
suffix that is a state; the failure arc leads to the next shorter suffix at the price
PRIOR / (c(state) + PRIOR). Probabilities after each state add up to 1.

The corpus is read once into chunks: some megabytes of documents as numbers of the
chunk's distinct words, kept in a table bucketed by chunk, so that what comes back for a
chunk meets it without a shuffle of the texts. In one exchange a chunk sends all its words and n-grams with their counts
in its training texts, dealt by hash to parts, whose number grows with the number of chunks, and hears their counts in the
corpus. No task and no broadcast holds the vocabulary or the n-grams; a hot one has an entry for each chunk.

n-grams are told apart by 48 bits of a hash within their part, which holds some million of
them: the chance that any two in a part are taken for one is some 0.002.

A chunk builds the part of the automaton that its texts can reach, as arrays: its states numbered, their
failure arcs and prices, and the arcs sorted by state and word, each with its probability and the state it leads to.
Every text is traversed from left to right, one state carried, log-probabilities added up: at each word
the arc is taken if the state has it, else the failure arc at its price, down to the root. All texts of
a chunk go in step. A text is cut into strides for that: a stride but the first enters at the root with as
many words as a state can have, which leaves it in the state that the text's traversal is in there.

Defined cases: a null or empty text is the end token alone; A to Z count as a to z;
without any training text N and V are 0 and every token has probability 1; an id may be
null or repeat; an empty table gives an empty result. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenio.llm.common import bucketed, staged
from provenio.llm.shingles import mix, slices, word_hashes

#: The prior's weight: so many words seen after a state weigh as much as all shorter states.
ORDER, PRIOR = 3, 4.0
#: Stands for the end of a text among the hashes of words.
END = np.uint64(0x5851F42D4C957F2D)
#: Bytes of text in a chunk; one longer text is a chunk of its own.
CHUNK = 8 << 20
CHUNKS = "chunk long, ids array<bigint>, held array<boolean>, lengths array<int>, words binary, tokens binary, learnt long"
#: Bits of an n-gram's code within its part.
CODE = 48
#: Words that are traversed in one go; longer texts are cut.
STRIDE = 512
#: Chunks for each part: more make smaller messages and larger tasks.
SHARE = 1
MESSAGE = "part long, of long, codes binary, values binary"
ANSWER = "of long, part long, answer binary, new long"
SCORES = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def squeezed(x: np.ndarray) -> bytes:
    """Numbers as planes of bytes, compressed: the high bytes of small numbers cost next to nothing."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()
    return len(x).to_bytes(4, "little") + pa.compress(planes, "zstd", asbytes=True)


def opened(data: bytes, kind: type) -> np.ndarray:
    n, wide = int.from_bytes(data[:4], "little"), np.dtype(kind).itemsize
    planes = pa.decompress(data[4:], n * wide, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(wide, n).T).view(kind).ravel()


def _ascending(x: np.ndarray) -> bytes:
    return squeezed(np.diff(x, prepend=np.uint64(0)))


# -- Chunks.


def _chunk(at: int, ids: list, held: list, lengths: list[int], hashes: list[np.ndarray]) -> pa.RecordBatch:
    words, tokens, times = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    order = np.argsort(-times, kind="stable")  # frequent words get small numbers, so that the upper bytes are nearly all 0
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    learnt = sum(n + 1 for n, h in zip(lengths, held, strict=True) if not h)
    columns = [[at], [ids], [held], [lengths], [words[order].tobytes()], [squeezed(place[tokens].astype(np.uint32))], [learnt]]
    kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in CHUNKS.split(", ")])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first = TaskContext.get().partitionId() << 32
    ids, held, lengths, hashes, size = [], [], [], [], 0
    for batch in batches:
        own_ids, own_held, at = batch["id"].to_pylist(), batch["held"].to_pylist(), 0
        for raw, starts in slices(batch["text"]):
            if ids and size + len(raw) > CHUNK:
                yield _chunk(first, ids, held, lengths, hashes)
                ids, held, lengths, hashes, size, first = [], [], [], [], 0, first + 1
            owner, words = word_hashes(raw, starts, lower=True)
            ids += own_ids[at : at + len(starts)]
            held += map(bool, own_held[at : at + len(starts)])
            lengths += np.bincount(owner, minlength=len(starts)).tolist()
            hashes.append(words)
            size += len(raw)
            at += len(starts)
    if ids:
        yield _chunk(first, ids, held, lengths, hashes)


def _previous(x: np.ndarray, begins: np.ndarray, at_begin: int) -> np.ndarray:
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[begins] = at_begin
    return out


@dataclass
class Grams:
    """The distinct n-grams of one order in a chunk; END stands before and after each text."""

    codes: np.ndarray  # hash of each n-gram
    at: np.ndarray  # for each token of the stream, the number of the n-gram that ends there, or -1
    context: np.ndarray  # for each n-gram, the number of the n-gram without its last word
    word: np.ndarray  # its last word
    suffix: np.ndarray  # the number of the n-gram without its first word
    own: np.ndarray  # for each n-gram, how often it occurs in the chunk's training texts


def _grams(row: dict, order: int) -> tuple[list[Grams], np.ndarray]:
    """(n-grams of each order, where each text begins)."""
    words = np.append(np.frombuffer(row["words"], np.uint64), END)
    lengths = np.array(row["lengths"], np.int64)
    ends = np.cumsum(lengths)
    at = np.insert(opened(row["tokens"], np.uint32).astype(np.int32), ends, len(words) - 1)
    begins = ends - lengths + np.arange(len(lengths))
    learnt = np.repeat(~np.array(row["held"], bool), lengths + 1)
    none = np.zeros(0, np.int32)
    count = lambda x, n: np.bincount(x[learnt & (x >= 0)], minlength=n)
    levels = [Grams(words, at, none, none, none, count(at, len(words)))]
    for n in range(2, order + 1):
        last = levels[-1]
        before = _previous(last.at, begins, len(words) - 1 if n == 2 else -1)
        held = np.flatnonzero(before >= 0)
        code = mix(last.codes[before[held]] * np.uint64(0xD6E8FEB86659FD93) + words[at[held]] + np.uint64(n))
        codes, first, inverse = np.unique(code, return_index=True, return_inverse=True)
        now = np.full(len(at), -1, np.int32)
        now[held] = inverse
        levels.append(Grams(codes, now, before[held[first]], at[held[first]], last.at[held[first]], count(now, len(codes))))
    return levels, begins


# -- The exchange between chunks and parts.


def _dealt(codes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of the codes by part and code, their parts, their codes within the part)."""
    part = ((codes >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
    inside = codes & np.uint64((1 << CODE) - 1)
    if parts.bit_length() + CODE <= 64:
        order = np.argsort((part.view(np.uint64) << np.uint64(CODE)) | inside)
    else:
        order = np.lexsort((inside, part))
    return order, part[order], inside[order]


COUNT = np.dtype([("n", "<u4"), ("word", "u1")])


def _counted(rows: pa.Table) -> pa.Table:
    """Answers of a part: each n-gram's count in the corpus' training texts; new: how many words they have."""
    rows = rows.sort_by("of")
    codes = [np.cumsum(opened(x, np.uint64), dtype=np.uint64) for x in rows["codes"].to_pylist()]
    cuts = np.cumsum([len(x) for x in codes])[:-1]
    which = np.unique(np.concatenate(codes), return_inverse=True)[1]
    own = np.concatenate([opened(x, COUNT) for x in rows["values"].to_pylist()])
    total = np.bincount(which, own["n"]).astype(np.uint64)  # whole numbers, exact below 2 to the 53rd
    word = np.zeros(len(total), bool)
    word[which[own["word"] > 0]] = True
    answers, new = [squeezed(x) for x in np.split(total[which], cuts)], int((word & (total > 0)).sum())
    return pa.table({
        "of": rows["of"].combine_chunks(), "part": rows["part"].combine_chunks(), "answer": pa.array(answers, pa.binary()), "new": pa.array([new] + [0] * (len(rows) - 1), pa.int64()),
    })


class Chunk:
    """A chunk's n-grams and what it has heard about them."""

    def __init__(self, row: dict, order: int, parts: int) -> None:
        self.number, self.parts, self.row = row["chunk"], parts, row
        self.levels, self.begins = _grams(row, order)
        self.codes = np.concatenate([g.codes for g in self.levels])

    def sent(self) -> pa.Table:
        """Rows (part, of, codes, values): all n-grams with their counts in the chunk's training texts."""
        values = np.zeros(len(self.codes), COUNT)
        values["n"] = np.concatenate([g.own for g in self.levels])
        values["word"][: len(self.levels[0].codes)] = 1  # the end is counted as a token
        order, part, inside = _dealt(self.codes, self.parts)
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
        spans = list(zip(cuts, cuts[1:], strict=False))
        return pa.table({
            "part": pa.array([part[a] for a, _ in spans], pa.int64()), "of": pa.array([self.number] * len(spans), pa.int64()),
            "codes": pa.array([_ascending(inside[a:b]) for a, b in spans], pa.binary()),
            "values": pa.array([squeezed(values[order[a:b]]) for a, b in spans], pa.binary()),
        })

    def counts(self, answers: pa.Table) -> list[np.ndarray]:
        """The counts of the n-grams of each order in the corpus' training texts."""
        own = sorted(zip(answers["part"].to_pylist(), answers["answer"].to_pylist(), strict=True))
        out = np.zeros(len(self.codes), np.int64)
        out[_dealt(self.codes, self.parts)[0]] = np.concatenate([opened(a, np.uint64) for _, a in own]).astype(np.int64)
        return np.split(out, np.cumsum([len(g.codes) for g in self.levels])[:-1])

    def scores(self, answers: pa.Table, n: int, v: int, prior: float) -> pa.Table:
        counts, at = self.counts(answers), self.levels[0].at
        base = np.log10((counts[0] + 1) / (n + v + 1))[at]
        score = Automaton(self.levels, counts, n, v, prior).traverse(at, self.begins, len(counts[0]) - 1)
        sums = lambda x: np.add.reduceat(x, self.begins)  # noqa: E731  every text has its end token
        lengths = np.array(self.row["lengths"], np.int64)
        return pa.table({
            "id": pa.array(self.row["ids"], pa.int64()), "held_out": pa.array(self.row["held"], pa.bool_()), "n_tokens": lengths + 1,
            "n_known": sums((counts[0] > 0)[at].astype(np.int64)), "train_tokens": np.full(len(lengths), n, np.int64),
            "base_score": sums(base), "score": score,
        })


class Automaton:
    """States, arcs and failure arcs of the training texts' n-grams, of those that a chunk holds; state 0 is the root."""

    def __init__(self, levels: list[Grams], counts: list[np.ndarray], n: int, v: int, prior: float) -> None:
        self.words = len(counts[0])
        self.chance = (counts[0] + 1) / (n + v + 1)  # the root's arcs
        self.order = len(levels)
        states = levels[: self.order - 1]
        self.begin = np.cumsum([1, *(len(g.codes) for g in states)])  # the first state of each order
        seen = np.concatenate([[0], *(c for c, _ in zip(counts, states, strict=False))]).astype(np.int64)
        self.fail = np.zeros(len(seen), np.int32)
        for k, g in enumerate(states[1:], 1):
            self.fail[self.begin[k] : self.begin[k + 1]] = self.begin[k - 1] + g.suffix
        self.price = prior / (seen + prior)
        self.price[0] = 1.0
        self.first = np.where(counts[0] > 0, self.begin[0] + np.arange(self.words), 0) if states else np.zeros(self.words, np.int64)  # where the root's arcs lead
        keys, weights, targets, shorter = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.int64)], self.chance
        for k, (g, c) in enumerate(zip(levels[1:], counts[1:], strict=True), 1):
            state = self.begin[k - 1] + g.context.astype(np.int64)
            weight = (c + prior * shorter[g.suffix]) / (seen[state] + prior)
            own = np.flatnonzero(c > 0)
            keys.append(state[own] * self.words + g.word[own])
            weights.append(weight[own])
            targets.append(self.begin[k] + own if k < self.order - 1 else self.begin[k - 1] + g.suffix[own].astype(np.int64))
            shorter = weight
        key = np.concatenate(keys)
        order = np.argsort(key)
        self.arcs, self.weights, self.targets = key[order], np.concatenate(weights)[order], np.concatenate(targets)[order]

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probability of the next word, the state after it) for each state carried."""
        chance, after = np.ones(len(state)), np.zeros(len(state), np.int64)
        todo, state = np.arange(len(state)), state.copy()
        for _ in range(self.order):
            at_root = state[todo] == 0
            root = todo[at_root]
            chance[root] *= self.chance[word[root]]
            after[root] = self.first[word[root]]
            todo = todo[~at_root]
            if not len(todo):
                break
            key = state[todo] * self.words + word[todo]
            at = np.minimum(np.searchsorted(self.arcs, key), max(0, len(self.arcs) - 1))
            found = self.arcs[at] == key if len(self.arcs) else np.zeros(len(todo), bool)
            chance[todo[found]] *= self.weights[at[found]]
            after[todo[found]] = self.targets[at[found]]
            todo = todo[~found]
            chance[todo] *= self.price[state[todo]]
            state[todo] = self.fail[state[todo]]
        return chance, after

    def traverse(self, tokens: np.ndarray, begins: np.ndarray, start: int) -> np.ndarray:
        """log10 of the probability of each text; its tokens end with the end token, which is also what a text starts after (the word `start`)."""
        ends = np.append(begins[1:], len(tokens))
        strides = -(-(ends - begins) // STRIDE)
        text = np.repeat(np.arange(len(begins)), strides)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(strides) - strides, strides)
        counted = begins[text] + nth * STRIDE  # from here on a stride's words count
        at = np.where(nth > 0, counted - (self.order - 1), counted)
        end = np.minimum(counted + STRIDE, ends[text])
        order = np.argsort(at - end, kind="stable")  # the longest first, so that those that go on are a prefix
        text, counted, at, end = text[order], counted[order], at[order], end[order]
        state = np.where(counted == begins[text], self.first[start] if self.order > 1 else 0, 0)
        total = np.zeros(len(text))
        going = len(text)
        while True:
            going = int(np.searchsorted(at[:going] - end[:going], 0)) if going else 0
            if not going:
                break
            chance, state[:going] = self.step(state[:going], tokens[at[:going]])
            total[:going] += np.where(at[:going] >= counted[:going], np.log10(chance), 0.0)
            at[:going] += 1
        return np.bincount(text, total, len(begins))


def scores(
    docs: DataFrame, held_out: Column, id_col: str = "doc_id", text: str = "text", order: int = ORDER, prior: float = PRIOR,
) -> DataFrame:
    """One row for each document: id, held_out, n_tokens, n_known, train_tokens, base_score, score. Learns from the rows that held_out doesn't hold for."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"), held_out.alias("held"))
    chunks = bucketed(rows.mapInArrow(_chunks, CHUNKS), "chunk")
    many, n = chunks.agg(F.count("*"), F.coalesce(F.sum("learnt"), F.lit(0))).first()
    parts = max(1, -(-many // SHARE))

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                yield from Chunk(batch.slice(i, 1).to_pylist()[0], order, parts).sent().to_batches()

    counted = staged(chunks.mapInArrow(sent, MESSAGE).groupBy("part").applyInArrow(_counted, ANSWER))
    v = counted.agg(F.coalesce(F.sum("new"), F.lit(0))).first()[0]

    def score(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        return Chunk(chunk.to_pylist()[0], order, parts).scores(answers, n, v, prior)

    return chunks.groupBy("chunk").cogroup(counted.groupBy("of")).applyInArrow(score, SCORES).withColumnRenamed("id", id_col)
