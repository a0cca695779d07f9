"""Language ID by bit-sliced Bloom filters of character n-grams.

Each language has a Bloom filter of the trigrams that are usual in it. All filters have
one size and the same hash functions and lie across each other: word i of the table
holds bit i of every language's filter, so that one look-up for each hash function,
ANDed, returns the set of all languages that contain a trigram. A word is of 64 bits;
each 64 languages have a column of the table. The hits are counted
for each language over the whole text, corrected for the share of hits that the filter
gives by chance, and the language with most corrected hits is predicted.

The filters are learnt from a bounded sample of labelled rows: `per_language` documents
of each language at most are expected, chosen by a hash of the id. A trigram belongs to
a language when at least `min_share` of its documents have it, and at least `ratio` of
the share that it has in any other language.

Defined cases: a null text or one without a letter is `und` with score 0; a text with
letters in which no language has a corrected hit is given the language with most training
documents, at score 0; ties go to the language whose name sorts first; an empty or
unlabelled training set knows no language and gives `und` everywhere; repeated rows are
predicted one by one. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenio.llm.common import only

HASHES = 4
#: Texts are joined to this many characters for each vectorised step.
STEP = 1 << 17
#: Texts that are taken out of an Arrow batch at a time.
TEXTS = 256


@dataclass
class Filters:
    languages: list[str]
    table: np.ndarray  # uint64, a power of two long, a column for each 64 languages
    by_chance: np.ndarray  # for each language, the share of absent trigrams that hit
    largest: int = 0  # the language with most training documents


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, trigram code) of every letter trigram of the lower-cased texts.

    Words stand between blanks; whatever is not a letter is a blank. Codes are exact: 21 bits for each character.
    """
    joined = "\0".join(t.lower() for t in texts)
    codes = np.frombuffer((" " + joined + " ").encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    owner = np.cumsum(codes == 0)
    letter = letters()[codes]
    codes = np.where(letter, codes, 32)
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    keep = letter[1:-1] | (letter[:-2] & letter[2:])
    return owner[1:-1][keep], ((a << 42) | (b << 21) | c)[keep]


_LETTERS: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTERS


def _places(grams: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Where each hash function looks for each trigram."""
    x = grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    step = (x >> np.uint64(40)) | np.uint64(1)
    for i in range(HASHES):
        yield (x + np.uint64(i) * step) & np.uint64(size - 1)


def contains(filters: Filters, grams: np.ndarray) -> np.ndarray:
    """For each trigram, the set of languages that contain it, as bits of a column for each 64 languages."""
    found = np.full((len(grams), filters.table.shape[1]), np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in _places(grams, len(filters.table)):
        found &= filters.table[at]
    return found


def _bit(sets: np.ndarray, i: int) -> np.ndarray:
    """For each set of languages, whether it holds language number i."""
    return (sets[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)


def build(shares: pd.DataFrame, min_share: float, ratio: float, docs: dict[str, int] | None = None) -> Filters:
    """Filters from rows (lang, gram, share of the language's documents); docs: how many training documents a language has."""
    most = shares.groupby("gram")["share"].transform("max")
    kept = shares[(shares["share"] >= min_share) & (shares["share"] >= ratio * most)]
    languages = sorted(kept["lang"].unique())
    size = 1 << max(10, int(np.ceil(np.log2(max(1, kept.groupby("lang").size().max() if len(kept) else 1) * HASHES * 4))))
    table = np.zeros((size, max(1, -(-len(languages) // 64))), np.uint64)
    own = {lang: grams.to_numpy(np.int64) for lang, grams in kept.groupby("lang")["gram"]}
    for i, lang in enumerate(languages):
        for at in _places(own[lang], size):
            np.bitwise_or.at(table[:, i // 64], at, np.uint64(1 << i % 64))
    fill = np.array([_bit(table, i).mean() for i in range(len(languages))])
    largest = min(range(len(languages)), key=lambda i: (-(docs or {}).get(languages[i], 0), i), default=0)
    return Filters(languages, table, fill**HASHES, largest)


def corrected(hits: np.ndarray, n: np.ndarray, by_chance: np.ndarray) -> np.ndarray:
    """Expected number of trigrams really contained, given hits among n (rows: texts, columns: languages)."""
    return np.maximum(0, (hits - n[:, None] * by_chance) / (1 - by_chance))


def predict(filters: Filters, texts: list[str | None]) -> dict[str, np.ndarray]:
    """lang_pred, score and coverage of each text.

    score: the best language's share of the corrected hits of all languages; coverage: of the text's trigrams, the
    share that the best language contains.
    """
    k = len(filters.languages)
    hits, n = np.zeros((len(texts), max(k, 1))), np.zeros(len(texts))
    begin = 0
    while begin < len(texts):  # some texts at a time: memory follows STEP or the longest text
        end, chars = begin, 0
        while end < len(texts) and (end == begin or chars + len(texts[end] or "") <= STEP):
            chars += len(texts[end] or "")
            end += 1
        owner, grams = trigrams([(t or "").replace("\0", " ") for t in texts[begin:end]])
        sets = contains(filters, grams)
        n[begin:end] = np.bincount(owner, minlength=end - begin)
        for i in range(k):
            hits[begin:end, i] = np.bincount(owner, _bit(sets, i).astype(float), end - begin)
        begin = end
    found = corrected(hits[:, :k], n, filters.by_chance) if k else np.zeros((len(texts), 1))
    best, top = found.argmax(axis=1), found.max(axis=1)
    best = np.where(top > 0, best, filters.largest)
    lettered = np.fromiter((n[i] > 0 or any(map(str.isalpha, t or "")) for i, t in enumerate(texts)), bool, len(texts))
    names = np.array([*filters.languages, "und"], object)
    return {
        "lang_pred": names[np.where(lettered, best, k) if k else np.zeros(len(texts), int)],
        "score": np.divide(top, found.sum(axis=1), out=np.zeros(len(texts)), where=top > 0),
        "coverage": np.minimum(1, np.divide(top, n, out=np.zeros(len(texts)), where=n > 0)),
    }


def train(
    labelled: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang",
    per_language: int = 3000, min_share: float = 0.002, ratio: float = 0.1,
) -> Filters:
    """Filters from the rows whose text and language aren't null.

    per_language bounds the sample. Of a language, the trigrams that min_share of its documents have reach the driver:
    1 / min_share times as many at most as a document has on average.
    """
    rows = only(labelled, id_col, text, lang).where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = rows.groupBy(lang).count()
    part = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1_000_000))
    picked = rows.join(F.broadcast(counts), lang).where(part * F.col("count") < F.lit(1_000_000 * per_language).cast("long"))

    def distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, own in batch.groupby(lang):
                once = [np.unique(trigrams([t.replace("\0", " ")])[1]) for t in own[text]]
                codes, n = np.unique(np.concatenate(once), return_counts=True)
                yield pd.DataFrame({"lang": name, "gram": codes, "n": n, "docs": 0})
                yield pd.DataFrame({"lang": [name], "gram": [-1], "n": [0], "docs": [len(own)]})

    seen = picked.select(lang, text).mapInPandas(distinct, "lang string, gram long, n long, docs long")
    seen = seen.groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    totals = seen.where("gram = -1").select("lang", F.col("docs").alias("total"))
    shares = seen.where("gram <> -1").join(F.broadcast(totals), "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("share"))
    usual = shares.where(F.col("share") >= min_share).toPandas()
    return build(usual, min_share, ratio, {r[lang]: r["count"] for r in counts.collect()})


def identify(docs: DataFrame, filters: Filters, text: str = "text") -> DataFrame:
    """docs with a struct `language` of lang_pred, score and coverage. The filters are of bounded size and go with the task."""
    shared = docs.sparkSession.sparkContext.broadcast((filters.languages, filters.table, filters.by_chance, filters.largest))

    def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Filters(*shared.value)
        for texts in batches:
            parts = [predict(own, texts.slice(a, TEXTS).to_pylist()) for a in range(0, len(texts), TEXTS)] or [predict(own, [])]
            columns = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
            yield pa.StructArray.from_arrays([pa.array(columns["lang_pred"], pa.string()), pa.array(columns["score"]), pa.array(columns["coverage"])], list(columns))

    udf = F.arrow_udf(each, "lang_pred string, score double, coverage double")
    return docs.withColumn("language", udf(F.col(f"`{text}`")))
