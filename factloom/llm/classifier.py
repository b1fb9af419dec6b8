"""Quality classifier: an additive model with pairwise interactions.

Features of the whole text are cut into bins. Cyclic boosting goes round the
features; each turn fits a tree of at most three leaves to one feature's histogram
of gradients and adds it to that feature's lookup table. Then the pairs of features
with most left to explain get two-dimensional tables from trees with one cut on
each axis. A score is the logistic function of the sum of table entries.

The model is fitted on at most FIT_ROWS labelled rows, the first by a hash of doc_id,
that are not held out (crc32 of doc_id as text, modulo 5, is 0). The sample is all
that reaches the driver; scoring is one narrow pass over all rows. Labels, lang,
source and doc_id are no features.

Null text counts as empty and has a score. A null doc_id is held out. A doc_id with
several labels counts with their mean, one with several texts with one of them.
Without labelled rows every score is 0.5. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import drop_caches, fresh, prepare, text_or_empty, values

FIT_ROWS = 20_000
FOLDS = 5
THRESHOLD = 0.3
BINS = 32
PAIR_BINS = 8
ROUNDS = 120
PAIR_ROUNDS = 40
PAIRS = 8
RATE = 0.1
RIDGE = 1.0
FEATURES = (
    "log_bytes", "log_words", "word_bytes", "letters", "digits", "symbols", "exclamations", "capitals", "other_signs", "not_ascii", "distinct_words", "top_word", "same_as_before",
    "distinct_pairs", "distinct_lines", "line_words", "short_words", "ends_in_sign",
)
_DIGITS, _SYMBOLS, _CAPITALS = b"0123456789", b"#*$%&|<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SMALL, _SPACE = b"abcdefghijklmnopqrstuvwxyz", b" \t\n\r\x0b\x0c"
_HIGH = bytes(range(128, 256))
_WORD_END = re.compile(rb"[^A-Za-z0-9\x80-\xff \t\n\r\x0b\x0c](?=[ \t\n\r\x0b\x0c]|\Z)")


def features(text: str | None) -> list[float]:
    """The numbers of FEATURES for a whole text, from its UTF-8 bytes."""
    data = (text or "").encode()
    words = data.split()
    n, w = len(data), len(words)
    count = lambda chars: n - len(data.translate(None, chars))
    digits, symbols, capitals, small, high, space = (count(c) for c in (_DIGITS, _SYMBOLS, _CAPITALS, _SMALL, _HIGH, _SPACE))
    solid = max(n - space, 1)
    lines = [x for x in data.split(b"\n") if x.strip()]
    most = Counter(words).most_common(1)[0][1] if words else 0
    marks = data.count(b"!")
    return [
        np.log1p(n), np.log1p(w), (n - space) / max(w, 1), (capitals + small + high) / solid, digits / solid, symbols / solid, marks / solid, capitals / max(capitals + small, 1),
        (solid - digits - symbols - capitals - small - high - marks) / solid, high / solid, len(set(words)) / max(w, 1), most / max(w, 1),
        sum(map(bytes.__eq__, words, words[1:])) / max(w - 1, 1), len(set(zip(words, words[1:], strict=False))) / max(w - 1, 1), len(set(lines)) / max(len(lines), 1),
        np.log1p(w / max(len(lines), 1)), sum(1 for x in words if len(x) <= 3) / max(w, 1), len(_WORD_END.findall(data)) / max(w, 1),
    ]


@dataclass
class Model:
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, j], side="right")]
        for a, b, table in self.pairs:
            total += table[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _gain(g, h):
    return g * g / (h + RIDGE)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Values per bin of a tree grown best split first on one feature's histogram."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = None
        for at, (lo, hi) in enumerate(parts):
            if hi - lo < 2:
                continue
            left_g, left_h = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
            right_g, right_h = g[lo:hi].sum() - left_g, h[lo:hi].sum() - left_h
            gains = np.where((left_h > 1e-3) & (right_h > 1e-3), _gain(left_g, left_h) + _gain(right_g, right_h), 0) - _gain(g[lo:hi].sum(), h[lo:hi].sum())
            k = int(gains.argmax())
            if gains[k] > 1e-9 and (best is None or gains[k] > best[0]):
                best = (gains[k], at, lo + k + 1)
        if best is None:
            break
        lo, hi = parts[best[1]]
        parts[best[1] : best[1] + 1] = [(lo, best[2]), (best[2], hi)]
    out = np.empty(len(g))
    for lo, hi in parts:
        out[lo:hi] = -g[lo:hi].sum() / (h[lo:hi].sum() + RIDGE)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree with one cut on each axis of a grid of gradients."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best, out = 0.0, np.zeros_like(g)
    if min(g.shape) < 2:
        return best, out

    def corners(c):
        a = c[:-1, :-1]
        top, left, whole = c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        return a, top - a, left - a, whole - top - left + a

    parts = list(zip(corners(cg), corners(ch), strict=True))
    gains = sum(_gain(x, y) for x, y in parts) - _gain(cg[-1, -1], ch[-1, -1])
    i, j = np.unravel_index(int(gains.argmax()), gains.shape)
    value = [-x[i, j] / (y[i, j] + RIDGE) for x, y in parts]
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = value
    return float(gains[i, j]), out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting of the logistic loss; the same rows in the same order give the same model."""
    model = Model()
    if not len(y):
        return model
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model.base = float(np.log(rate / (1 - rate)))
    total = np.full(len(y), model.base)
    n = x.shape[1]
    model.edges = [_cuts(x[:, j], BINS) for j in range(n)]
    model.coarse = [_cuts(x[:, j], PAIR_BINS) for j in range(n)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -50, 50)))
        return p - y, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(n):
            g, h = slopes()
            size = len(model.tables[j])
            step = RATE * _tree(np.bincount(bins[j], g, size), np.bincount(bins[j], h, size))
            model.tables[j] += step
            total += step[bins[j]]
    coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.coarse)]
    sizes = [len(e) + 1 for e in model.coarse]

    def grid(a: int, b: int) -> tuple[float, np.ndarray]:
        cell, shape = coarse[a] * sizes[b] + coarse[b], (sizes[a], sizes[b])
        g, h = slopes()
        return _quadrants(np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape))

    ranked = sorted(((grid(a, b)[0], a, b) for a in range(n) for b in range(a)), reverse=True)[:PAIRS]
    model.pairs = [(a, b, np.zeros((sizes[a], sizes[b]))) for _, a, b in ranked]
    for _ in range(PAIR_ROUNDS):
        for a, b, table in model.pairs:
            step = RATE * grid(a, b)[1]
            table += step
            total += step[coarse[a], coarse[b]]
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def _measured(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t) for (t,) in values(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(fresh(run), "doc_id bigint, x array<double>")


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Fits the model on the sample of labelled rows. The broadcast side has ``fit_rows`` numbers at most."""
    prepare(docs.sparkSession)
    given = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("double").alias("y")).filter(~held_out(F.col("doc_id")) & F.col("y").isin(0.0, 1.0))
    given = given.groupBy("doc_id").agg(F.avg("y").alias("y"))
    sample = given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi")
    one = _measured(rows).groupBy("doc_id").agg(F.min("x").alias("x"))
    found = sorted(one.join(sample, "doc_id").select("doc_id", "x", "y").collect(), key=lambda r: r.doc_id)
    return fit(np.array([r.x for r in found], np.float64).reshape(len(found), len(FEATURES)), np.array([r.y for r in found], np.float64))


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Each row as ``_row``, with score and predicted."""
    prepare(docs.sparkSession)

    # only the text goes to Python, once; the row waits beside
    def run(texts: pa.Array) -> pa.Array:
        drop_caches()
        return pa.array(model.score(np.array([features(t.as_py()) for t in texts], np.float64).reshape(len(texts), len(FEATURES))), pa.float64())

    scored = docs.select(F.struct("*").alias("_row"), F.arrow_udf(run, "double").asNondeterministic()(text_or_empty()).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_by_score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows predicted 1, with their own columns."""
    return score_documents(docs, train(docs, labels), threshold).filter("predicted = 1").select("_row.*")
