"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature has a lookup table over its bins. Rounds go over the features in turn; each turn fits a
shallow tree (at most four leaves) to the residual along that one feature and adds a fraction of it
to the table. Then the pairs of features that explain most of what is left get tables over both
features' bins, boosted the same way with four-quadrant trees. A document's score is a sum of bins.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .learning import SAMPLE_ROWS, add_columns, edges_of, filter_texts, fold, labelled, sigmoid
from .statistics import FEATURES, describe, labelled_statistics

RIDGE = 1.0


@dataclass
class Additive:
    """edges and tables by feature; pair_edges by feature, pairs: (feature, feature, table)."""

    bias: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for j, (e, t) in enumerate(zip(self.edges, self.tables)):
            total += t[np.searchsorted(e, x[:, j])]
        for a, b, t in self.pairs:
            total += t[np.searchsorted(self.pair_edges[a], x[:, a]), np.searchsorted(self.pair_edges[b], x[:, b])]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.margin(x))


def _gain(g, h):
    return g * g / (h + RIDGE)


def _cut(g: np.ndarray, h: np.ndarray) -> int:
    """The last bin left of the best cut of a run of bins; -1: no cut helps."""
    if len(g) < 2:
        return -1
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = _gain(gl, hl) + _gain(g.sum() - gl, h.sum() - hl)
    b = int(np.argmax(gain))
    return b if gain[b] > _gain(g.sum(), h.sum()) + 1e-9 else -1


def _shallow(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values by bin of a tree of depth two along one feature."""
    first = _cut(g, h)
    spans = [(0, len(g))] if first < 0 else [(0, first + 1), (first + 1, len(g))]
    out = np.zeros(len(g))
    for lo, hi in spans:
        second = _cut(g[lo:hi], h[lo:hi])
        for a, b in [(lo, hi)] if second < 0 else [(lo, lo + second + 1), (lo + second + 1, hi)]:
            out[a:b] = -g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values by bin pair of the best cut of each feature taken together."""
    if min(g.shape) < 2:
        return 0.0, np.zeros(g.shape)
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)

    def parts(c):
        ll, l_, _l, all_ = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        return ll, l_ - ll, _l - ll, all_ - l_ - _l + ll

    pg, ph = parts(cg), parts(ch)
    gain = sum(_gain(a, b) for a, b in zip(pg, ph))
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    value = [-a[i, j] / (b[i, j] + RIDGE) for a, b in zip(pg, ph)]
    out = np.empty(g.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = value
    return float(gain[i, j] - _gain(cg[-1, -1], ch[-1, -1])), out


def fit_additive(x: np.ndarray, y: np.ndarray, *, rounds: int = 120, pair_rounds: int = 60, rate: float = 0.08, bins: int = 32, pair_bins: int = 12, pairs: int = 6) -> Additive:
    """Fits y in {0, 1} by cyclic boosting. With one class or no rows: the (smoothed) share alone."""
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    model = Additive(float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return model
    n = x.shape[1]
    model.edges = [edges_of(x[:, j], bins) for j in range(n)]
    model.pair_edges = [edges_of(x[:, j], pair_bins) for j in range(n)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    at = [np.searchsorted(e, x[:, j]) for j, e in enumerate(model.edges)]
    margin = np.full(len(y), model.bias)
    for _ in range(rounds):
        for j in range(n):
            p = sigmoid(margin)
            size = len(model.tables[j])
            step = rate * _shallow(np.bincount(at[j], p - y, size), np.bincount(at[j], p * (1 - p), size))
            model.tables[j] += step
            margin += step[at[j]]
    at = [np.searchsorted(e, x[:, j]) for j, e in enumerate(model.pair_edges)]
    size = [len(e) + 1 for e in model.pair_edges]

    def both(a: int, b: int, p: np.ndarray):
        k = at[a] * size[b] + at[b]
        return (np.bincount(k, w, size[a] * size[b]).reshape(size[a], size[b]) for w in (p - y, p * (1 - p)))

    p = sigmoid(margin)
    ranked = sorted(combinations(range(n), 2), key=lambda ab: -_quadrants(*both(*ab, p))[0])[:pairs]
    tables = {ab: np.zeros((size[ab[0]], size[ab[1]])) for ab in ranked}
    for _ in range(pair_rounds):
        for a, b in ranked:
            _, step = _quadrants(*both(a, b, sigmoid(margin)))
            tables[a, b] += rate * step
            margin += rate * step[at[a], at[b]]
    model.pairs = [(a, b, t) for (a, b), t in tables.items()]
    return model


def train_quality(docs: DataFrame, labels: DataFrame, *, limit: int = SAMPLE_ROWS, folds: int = 3, held_out: int = 1, **columns: str) -> Additive:
    """Learns labels.quality from at most `limit` labelled rows outside the held-out fold."""
    sample = labelled(docs, labels, "quality", limit=limit, train=fold(F.col("doc_id"), folds) != held_out, **columns)
    return fit_additive(*labelled_statistics(sample))


def _scores(model: Additive, texts: pa.Array) -> np.ndarray:
    found = [describe(x.as_py() or b"")[1] for x in texts.cast(pa.binary() if pa.types.is_string(texts.type) else pa.large_binary())]
    return model.score(np.array(found, float).reshape(-1, len(FEATURES)))


def classify_quality(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", limit: int = SAMPLE_ROWS) -> DataFrame:
    """Score (likelihood of label 1) of every whole text, from its statistics alone.

    Null and empty texts are scored from statistics of zero. Repeated rows and null ids each give a
    row; a null id is never held out. Without labels of both kinds all scores are the labels'
    smoothed share. Other columns are not looked at.

    Returns doc_id, held_out, score, predicted."""
    model = train_quality(docs, labels, limit=limit, doc_id=doc_id, text=text)
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = add_columns(narrow, "text", lambda texts: [pa.array(_scores(model, texts))], [T.StructField("score", T.DoubleType())])
    return rows.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", limit: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that classify_quality() predicts to be good, with their own columns."""
    model = train_quality(docs, labels, limit=limit, doc_id=doc_id, text=text)
    return filter_texts(docs, text, lambda texts: _scores(model, texts) >= 0.5)
