"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature has a look-up table over its bins. Cyclic boosting takes the features in
turn, fits a shallow tree of at most four leaves to what the log loss still asks for, and
adds it, shrunk, to that feature's table; afterwards the pairs with the largest remaining
gain get tables of two dimensions in the same way. Scoring is one addition for each table.

The model is learnt from a bounded sample of labelled rows (`sample_rows`, chosen by a
hash of the id, with one row for each id), whose features, not texts, come to the driver.
Features look at the whole text.

Defined cases: a null text counts as empty; an empty text has all features 0 and is scored
as such; labels that are null are left out; without any label, every score is 0.5; with
one label alone it is that label's smoothed share; an id that is labelled several times has
the label that most of them give, 1 at a tie; of documents that share an id the one whose
text's MD5 is smallest is learnt from; repeated rows are scored one by one.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provenio.llm.common import only

FEATURES = (
    "log_chars", "log_words", "word_length", "long_words", "upper_share", "upper_words", "symbol_share", "mark_share",
    "digit_share", "repeat_next", "top_word", "distinct_words", "wordless", "stops_per_word", "line_repeats",
    "line_length", "squeezed", "lone_capital",
)
BINS, PAIR_BINS = 32, 12


def features(text: str | None) -> list[float]:
    """Numbers that describe a whole text, in the order of FEATURES."""
    text = text or ""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, chars = len(words), len(text)
    letters = sum(map(len, words))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    upper = sum(map(str.isupper, words))
    raw = text.encode("utf-8", "replace")
    ascii_only = np.frombuffer(raw, np.uint8)
    kinds = np.bincount(ascii_only, minlength=256)
    digits = kinds[48:58].sum()
    caps = kinds[65:91].sum()
    small = kinds[97:123].sum()
    stops = kinds[[44, 46]].sum()
    signs = kinds[33:48].sum() + kinds[58:65].sum() + kinds[91:97].sum() + kinds[123:127].sum() - stops
    marks = kinds[[33, 35, 36, 37, 38, 42, 124]].sum()
    return [
        float(np.log1p(chars)), float(np.log1p(n)), letters / n, sum(len(w) > 15 for w in words) / n, float(caps / max(1, caps + small)),
        upper / n, float(signs / letters), float(marks / letters), float(digits / letters),
        sum(map(str.__eq__, words, itertools.islice(words, 1, None))) / n, counts.most_common(1)[0][1] / n, len(counts) / n**0.9,
        sum(not any(c.isalpha() for c in w) for w in counts) / len(counts), float(stops / n), 1 - len(set(lines)) / len(lines),
        float(np.log1p(max(map(len, lines)))), len(zlib.compress(raw, 1)) / len(raw), sum(w[0].isupper() for w in counts) / len(counts),
    ]


@dataclass
class Model:
    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def plain(self) -> tuple:
        return self.base, self.cuts, self.tables, self.pair_cuts, self.pairs


def _binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(cuts)], axis=1) if len(cuts) else np.zeros((len(x), 0), int)


def _quantiles(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(x[:, i], np.arange(1, bins) / bins, method="higher")) for i in range(x.shape[1])]


def margin(model: Model, x: np.ndarray) -> np.ndarray:
    """The sum of the tables' entries for each row of features."""
    at, total = _binned(x, model.cuts), np.full(len(x), model.base)
    for i, table in enumerate(model.tables):
        total += table[at[:, i]]
    if model.pairs:
        at = _binned(x, model.pair_cuts)
        for a, b, table in model.pairs:
            total += table[at[:, a], at[:, b]]
    return total


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _split(g: np.ndarray, h: np.ndarray, lo: int, hi: int) -> tuple[float, int]:
    """Best place to split bins lo:hi, and what it gains."""
    if hi - lo < 2:
        return 0.0, hi
    left_g, left_h = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
    all_g, all_h = g[lo:hi].sum(), h[lo:hi].sum()
    gains = _gain(left_g, left_h) + _gain(all_g - left_g, all_h - left_h) - _gain(all_g, all_h)
    best = int(gains.argmax())
    return float(gains[best]), lo + best + 1


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of two levels over the bins of a feature: its value in each bin."""
    _, middle = _split(g, h, 0, len(g))
    out = np.zeros(len(g))
    for lo, hi in ((0, middle), (middle, len(g))):
        gain, cut = _split(g, h, lo, hi)
        for a, b in ((lo, cut), (cut, hi)) if gain > 1e-9 else ((lo, hi),):
            out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cross of one cut in each of two features: what it gains, and its value in each cell."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best, out = 0.0, np.zeros_like(g)
    corner = lambda c: (c, c[:, -1:] - c, c[-1:, :] - c, c[-1, -1] - c[:, -1:] - c[-1:, :] + c)
    parts = list(zip(corner(cg), corner(ch), strict=True))
    gains = sum(_gain(a, b) for a, b in parts)[:-1, :-1] - _gain(cg[-1, -1], ch[-1, -1])
    if gains.size:
        i, j = np.unravel_index(int(gains.argmax()), gains.shape)
        best = float(gains[i, j])
        value = [a[i, j] / (b[i, j] + 1.0) for a, b in parts]
        out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = value
    return best, out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.15, pairs: int = 10) -> Model:
    """Cyclic boosting on the log loss; rows of x are features, y is 0 or 1."""
    model = Model()
    if not len(y):
        return model
    share = (y.sum() + 0.5) / (len(y) + 1)
    model.base = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return model
    model.cuts = _quantiles(x, BINS)
    at, total = _binned(x, model.cuts), np.full(len(y), model.base)
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    for _ in range(rounds):
        for i, table in enumerate(model.tables):
            p = sigmoid(total)
            step = rate * _tree(np.bincount(at[:, i], y - p, len(table)), np.bincount(at[:, i], p * (1 - p), len(table)))
            table += step
            total += step[at[:, i]]
    model.pair_cuts = _quantiles(x, PAIR_BINS)
    at = _binned(x, model.pair_cuts)
    wide = [len(c) + 1 for c in model.pair_cuts]

    def sums(a: int, b: int, w: np.ndarray) -> np.ndarray:
        return np.bincount(at[:, a] * wide[b] + at[:, b], w, wide[a] * wide[b]).reshape(wide[a], wide[b])

    p = sigmoid(total)
    gains = sorted(((_quadrants(sums(a, b, y - p), sums(a, b, p * (1 - p)))[0], a, b) for a, b in itertools.combinations(range(x.shape[1]), 2)), reverse=True)
    model.pairs = [(a, b, np.zeros((wide[a], wide[b]))) for gain, a, b in gains[:pairs] if gain > 1e-6]
    for _ in range(rounds // 2):
        for a, b, table in model.pairs:
            p = sigmoid(total)
            step = rate * _quadrants(sums(a, b, y - p), sums(a, b, p * (1 - p)))[1]
            table += step
            total += step[at[:, a], at[:, b]]
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = 20_000) -> Model:
    """A model from the labelled rows of docs. About sample_rows of them are used at most, their features on the driver."""
    marked = only(labels, id_col, label).where(F.col(label).isNotNull() & F.col(id_col).isNotNull())
    marked = marked.groupBy(id_col).agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("double").alias("y"))
    n = marked.count()
    part = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1_000_000))
    picked = marked.where(part < int(1_000_000 * min(1.0, sample_rows / max(1, n))))

    def measure(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in texts])

    got = only(docs, id_col, text).join(F.broadcast(picked), id_col)  # about sample_rows rows, one for each id
    first = Window.partitionBy(id_col).orderBy(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    got = got.withColumn("nth", F.row_number().over(first)).where("nth = 1")
    got = got.select("y", F.pandas_udf(measure, "array<double>")(text).alias("x")).toPandas()
    return fit(np.stack(got["x"].to_numpy()) if len(got) else np.zeros((0, len(FEATURES))), got["y"].to_numpy(float))


def scored(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """docs with the probability of label 1. The tables are of fixed size and go with the task."""
    shared = docs.sparkSession.sparkContext.broadcast(model.plain())

    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Model(*shared.value)
        for texts in batches:
            x = np.array([features(t) for t in texts], float).reshape(len(texts), len(FEATURES))
            yield pd.Series(sigmoid(margin(own, x)))

    return docs.withColumn(into, F.pandas_udf(each, "double")(F.col(f"`{text}`")))
