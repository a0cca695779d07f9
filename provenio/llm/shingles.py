"""Hashed word shingles of many texts at a time, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text and number of texts for each vectorised step; one longer text makes a step of its own.
STEP, TEXTS = 1 << 19, 256
_R = np.uint64(0x9E3779B97F4A7C15)
_R_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, where each begins)."""
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts[:-1])], dtype=np.int64)[: len(texts)]


def slices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, where each text begins) of about STEP bytes, TEXTS texts at most, until all texts are through; null counts as empty.

    The bytes are those of the Arrow buffer, not copies; one longer text is a slice of its own.
    """
    column = pc.fill_null(column, "")
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(column):
        b = min(a + TEXTS, max(a + 1, int(np.searchsorted(offsets, offsets[a] + STEP, side="right")) - 1))
        yield raw[offsets[a] : offsets[b]], offsets[a:b] - offsets[a]
        a = b


def word_hashes(raw: np.ndarray, starts: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, hash) of every word in order; words are divided by blanks, tabs, line ends and the ends of texts.

    lower: A to Z count as a to z. Hashes have 64 bits: of a billion different words, two are taken for one with a
    chance of 0.03.
    """
    if lower:
        raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    word = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    new = np.zeros(len(raw) + 1, bool)
    new[starts] = True
    new[-1] = True
    begin = np.flatnonzero(word & (new[:-1] | np.concatenate([[True], ~word[:-1]])[: len(word)]))
    end = np.flatnonzero(word & (new[1:] | np.concatenate([~word[1:], [True]])[: len(word)])) + 1
    terms = (raw.astype(np.uint64) + np.uint64(1)) * _powers(_R, len(raw))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
    own = (sums[end] - sums[begin]) * _powers(_R_INVERSE, len(raw) + 1)[begin]
    return np.searchsorted(starts, begin, side="right") - 1, mix(own + (end - begin).astype(np.uint64))


def shingle_sets(raw: np.ndarray, starts: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, shingle, times it occurs), once for each text and shingle, by text and shingle.

    A text of fewer words than size, but at least one, has one shingle of all its words.
    """
    owner, words = word_hashes(raw, starts)
    counts = np.bincount(owner, minlength=len(starts))
    if len(words) >= size:
        code = np.zeros(len(words) - size + 1, np.uint64)
        for i in range(size):
            code = code * np.uint64(0xD6E8FEB86659FD93) + words[i : len(code) + i]
        whole = owner[: len(code)] == owner[size - 1 :]
        owners, codes = owner[: len(code)][whole], mix(code[whole])
    else:
        owners, codes = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    ends = np.cumsum(counts)
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        code = np.uint64(counts[i])
        for w in words[ends[i] - counts[i] : ends[i]]:
            code = np.uint64((int(code) * 0xD6E8FEB86659FD93 + int(w)) & 0xFFFFFFFFFFFFFFFF)
        owners, codes = np.append(owners, i), np.append(codes, mix(np.array([code], np.uint64)))
    order = np.lexsort((codes, owners))
    owners, codes = owners[order], codes[order]
    new = np.ones(len(codes), bool)
    new[1:] = (owners[1:] != owners[:-1]) | (codes[1:] != codes[:-1])
    at = np.flatnonzero(new)
    return owners[at], codes[at], np.diff(np.append(at, len(codes)))
