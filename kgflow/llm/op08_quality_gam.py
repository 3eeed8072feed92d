"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees, boosted in turn over one feature after another, add up to a lookup
table per feature; then, over the pairs of features that explain most of what is
left, to a table per pair.  A score is a sum of table entries, so a batch of texts
is scored by adding one column of looked-up values after another.

Features come from the text alone.  The model is fitted on a bounded sample of
labelled rows; every text is scored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgflow.llm.common import table

#: Most labelled rows that a model is fitted on: those with the smallest hashes of their ids.
MOST_LABELLED = 20_000
THRESHOLD = 0.3
HELD_OUT_OF = 5

#: Read from UTF-8 bytes, so they mean the same in any language: lengths; shares of capitals, signs and digits; how much
#: words and lines repeat (templates, scraped lists); words that end in an odd sign or stand in capitals, and bars between
#: words (tables, menus and keyword stuffing flattened to text).
FEATURES = (
    "log_chars", "log_words", "word_length", "upper_share", "sign_share", "digit_share", "distinct_share", "top_word_share",
    "log_lines", "words_a_line", "distinct_line_share", "same_as_last_share", "sign_end_share", "pipe_share", "capital_word_share",
)
_SPACE = b" \t\n\r\x0b\x0c"
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_PLAIN_ENDS = frozenset(b".,;:?'\")")


def features(text: str | None) -> list[float]:
    """The features of one whole text; null counts as empty, which has zeros throughout."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, solid = len(words), len(raw.translate(None, _SPACE))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    counts = Counter(words)
    share = lambda kinds: 1 - len(raw.translate(None, kinds + _SPACE)) / solid
    odd_ends = sum(c for w, c in counts.items() if w[-1] < 128 and not w[-1:].isalnum() and w[-1] not in _PLAIN_ENDS)
    capital = sum(c for w, c in counts.items() if len(w) > 1 and w.isupper())
    return [
        math.log1p(len(raw)), math.log1p(n), solid / n, share(_UPPER), share(_SIGNS), share(_DIGITS), len(counts) / n, max(counts.values()) / n,
        math.log1p(len(lines)), n / max(1, len(lines)), len(set(lines)) / max(1, len(lines)), sum(map(bytes.__eq__, words[1:], words)) / n,
        odd_ends / n, raw.count(b"|") / n, capital / n,
    ]


@dataclass
class AdditiveModel:
    """score = sigmoid(base + sum of tables[i][bin of feature i] + sum of pair tables)."""

    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(self.cuts)], axis=1) if self.cuts else np.zeros((len(x), 0), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        b, total = self.bins(x), np.full(len(x), self.base)
        for i, t in enumerate(self.tables):
            total += t[b[:, i]]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            total += t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-total))


def _step(g: np.ndarray, h: np.ndarray, leaves: int, l2: float) -> np.ndarray:
    """A regression tree over the ordered bins of one feature: its value at each bin."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    gain = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + l2)
    parts = [(0, len(g))]
    for _ in range(leaves - 1):
        best = (1e-9, None, None)
        for a, b in parts:
            if b - a > 1:
                at = np.arange(a + 1, b)
                gains = gain(a, at) + gain(at, b) - gain(a, b)
                k = int(gains.argmax())
                if gains[k] > best[0]:
                    best = (gains[k], (a, b), int(at[k]))
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + l2)
    return out


def _corner(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """The best tree of one cut on each axis over a table of two features: its gain and its values."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    rg, rh, dg, dh, tg, th = cg[:, -1:], ch[:, -1:], cg[-1:], ch[-1:], cg[-1, -1], ch[-1, -1]
    quads = [(cg, ch), (rg - cg, rh - ch), (dg - cg, dh - ch), (tg - rg - dg + cg, th - rh - dh + ch)]
    gains = sum(a * a / (b + l2) for a, b in quads) - tg * tg / (th + l2)
    i, j = np.unravel_index(int(gains.argmax()), gains.shape)
    v = [a[i, j] / (b[i, j] + l2) for a, b in quads]
    out = np.empty(g.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return float(gains[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, most_bins: int = 32, rounds: int = 150, pairs: int = 6, pair_rounds: int = 40, rate: float = 0.1, leaves: int = 3, l2: float = 2.0) -> AdditiveModel:
    """Cyclic boosting on the log loss.  Without rows, or with one label only, the model is a constant."""
    if not len(y):
        return AdditiveModel()
    p = (y.sum() + 1) / (len(y) + 2)
    model = AdditiveModel(base=float(np.log(p / (1 - p))))
    if y.min() == y.max():
        return model
    model.cuts = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, most_bins + 1)[1:-1])) for i in range(x.shape[1])]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    b, f = model.bins(x), np.full(len(y), model.base)
    slope = lambda: (y - (q := 1 / (1 + np.exp(-f))), q * (1 - q))
    for _ in range(rounds):
        for i, t in enumerate(model.tables):
            g, h = slope()
            add = rate * _step(np.bincount(b[:, i], g, len(t)), np.bincount(b[:, i], h, len(t)), leaves, l2)
            t += add
            f += add[b[:, i]]
    shape = lambda i, j: (len(model.tables[i]), len(model.tables[j]))

    def over(i, j, v):
        return np.bincount(b[:, i] * shape(i, j)[1] + b[:, j], v, shape(i, j)[0] * shape(i, j)[1]).reshape(shape(i, j))

    g, h = slope()
    ranked = sorted(((_corner(over(i, j, g), over(i, j, h), l2)[0], i, j) for i in range(x.shape[1]) for j in range(i)), reverse=True)
    model.pairs = [(i, j) for _, i, j in ranked[:pairs]]
    model.pair_tables = [np.zeros(shape(i, j)) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for (i, j), t in zip(model.pairs, model.pair_tables, strict=True):
            g, h = slope()
            add = rate * _corner(over(i, j, g), over(i, j, h), l2)[1]
            t += add
            f += add[b[:, i], b[:, j]]
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_OF == 0, F.lit(False))


def features_column(text: str) -> Column:
    @F.pandas_udf("array<double>")
    def made(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series([features(x) for x in t])

    return made(text)


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> AdditiveModel:
    """Fits on at most ``most`` labelled documents outside the held-out fold; a null label teaches nothing.

    An id that several rows have teaches once, by the first of its texts in their order,
    so no more than ``most`` rows reach the driver.
    """
    known = labels.where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    taught = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = taught.select("doc_id", "quality", features_column("text").alias("x"))
    got = sorted((r.doc_id, r.quality, r.x) for r in rows.collect())  # at most ``most`` rows of a few numbers
    return fit(np.array([r[2] for r in got], float).reshape(len(got), len(FEATURES)), np.array([r[1] for r in got], float))


def score_column(model: AdditiveModel, text: Column) -> Column:
    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            x = np.array([features(v) for v in t], float).reshape(len(t), len(FEATURES))
            yield pd.Series(model.score(x))

    return score(text)


def classify(docs: DataFrame, model: AdditiveModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 from ``threshold`` on) to every row; columns of those names are replaced.

    Null and empty texts are scored like a text without words, very long ones whole.  Equal
    texts score alike, rows that repeat come out once each, and an empty table gives an
    empty one.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    scored = docs.select(*kept, score_column(model, F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return classify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
