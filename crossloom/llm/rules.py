"""Quality rules: gradient-boosted trees over document statistics.

Trees are grown level by level on binned features with Newton steps. A feature with a monotonic
constraint only splits where the leaf values go its way, and the halves' values are held on either
side of their middle from then on. The forest is flattened into node arrays; a batch of documents
walks all trees with array indexing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .learning import SAMPLE_ROWS, add_columns, edges_of, labelled, sigmoid
from .statistics import BASE, FEATURES, describe, labelled_statistics

#: More of these never makes a document better.
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_word_share": -1, "echo_share": -1, "top_word_share": -1}


@dataclass
class Forest:
    """Node arrays of all trees; a leaf's children are itself. roots: where the trees begin."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.bias), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[node]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.margin(x))


def fit_forest(x: np.ndarray, y: np.ndarray, *, monotone: dict[int, int] | None = None, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 48, ridge: float = 2.0, least: float = 5.0) -> Forest:
    """Boosts the log loss of y in {0, 1}. With one class or no rows: no trees, the (smoothed) share as bias."""
    monotone = monotone or {}
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    nodes: list[list] = []
    roots: list[int] = []
    bias = float(np.log(share / (1 - share))) if len(y) else 4.0
    if len(np.unique(y)) > 1:
        edges = [edges_of(x[:, j], bins) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)], 1)
        wide = max(len(e) for e in edges) + 1
        margin = np.full(len(y), bias)
        for _ in range(trees):
            p = sigmoid(margin)
            g, h = p - y, p * (1 - p)
            first = len(nodes)
            roots.append(first)
            nodes.append([0, np.inf, first, first, -g.sum() / (h.sum() + ridge)])
            where, open_nodes = np.full(len(y), first), {first: (-np.inf, np.inf)}
            for _ in range(depth):
                nxt: dict[int, tuple[float, float]] = {}
                for node, (low, high) in open_nodes.items():
                    rows = np.flatnonzero(where == node)
                    found = _best_split(binned[rows], g[rows], h[rows], wide, edges, monotone, low, high, ridge, least)
                    if found is None:
                        continue
                    j, b, vl, vr = found
                    left, right = len(nodes), len(nodes) + 1
                    nodes += [[0, np.inf, left, left, vl], [0, np.inf, right, right, vr]]
                    nodes[node][:4] = [j, edges[j][b], left, right]
                    goes = binned[rows, j] <= b
                    where[rows[goes]], where[rows[~goes]] = left, right
                    mid, way = (vl + vr) / 2, monotone.get(j, 0)
                    nxt[left] = (low, min(high, mid)) if way > 0 else (max(low, mid), high) if way < 0 else (low, high)
                    nxt[right] = (max(low, mid), high) if way > 0 else (low, min(high, mid)) if way < 0 else (low, high)
                open_nodes = nxt
            for node in range(first, len(nodes)):
                nodes[node][4] *= rate
            margin += np.array([n[4] for n in nodes])[where]
    columns = list(zip(*nodes)) if nodes else [[]] * 5
    kinds = (np.int64, float, np.int64, np.int64, float)
    return Forest(*(np.array(c, k) for c, k in zip(columns, kinds)), np.array(roots, np.int64), depth, bias)


def _best_split(binned, g, h, wide, edges, monotone, low, high, ridge, least):
    """(feature, last bin to the left, left value, right value) of the best admissible split, if any."""
    total_g, total_h = g.sum(), h.sum()
    best, out = total_g**2 / (total_h + ridge) + 1e-6, None
    for j, e in enumerate(edges):
        if not len(e):
            continue
        gl = np.cumsum(np.bincount(binned[:, j], g, wide))[: len(e)]
        hl = np.cumsum(np.bincount(binned[:, j], h, wide))[: len(e)]
        gr, hr = total_g - gl, total_h - hl
        vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)
        gain = -(2 * gl * vl + (hl + ridge) * vl**2) - (2 * gr * vr + (hr + ridge) * vr**2)
        ok = (hl * 4 >= least) & (hr * 4 >= least) & ((vr - vl) * monotone.get(j, 0) >= 0)
        gain = np.where(ok, gain, -np.inf)
        b = int(np.argmax(gain))
        if gain[b] > best:
            best, out = gain[b], (j, b, float(vl[b]), float(vr[b]))
    return out


def train_rules(docs: DataFrame, labels: DataFrame, *, limit: int = SAMPLE_ROWS, **columns: str) -> Forest:
    sample = labelled(docs, labels, "quality", limit=limit, **columns)
    return fit_forest(*labelled_statistics(sample), monotone={FEATURES.index(k): v for k, v in MONOTONE.items()})


def quality_rules(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", limit: int = SAMPLE_ROWS, threshold: float = 0.5) -> DataFrame:
    """Counts, base rules and the forest's verdict for every whole text.

    The forest learns labels.quality from at most `limit` labelled rows. A document is kept if the
    base rules pass and its score is at least threshold. Null or empty text: counts of zero, which the
    base rules fail. Repeated rows, null ids and equal texts each give a row of their own; without
    labels of both kinds all scores are alike (0.98 without any). Other columns are not looked at.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept."""
    forest = train_rules(docs, labels, limit=limit, doc_id=doc_id, text=text)

    def compute(texts: pa.Array) -> list[pa.Array]:
        found = [describe(x.as_py() or b"") for x in texts.cast(pa.binary() if pa.types.is_string(texts.type) else pa.large_binary())]
        base = np.array([x[0] for x in found], np.int64).reshape(-1, len(BASE))
        score = forest.score(np.array([x[1] for x in found], float).reshape(-1, len(FEATURES)))
        return [*(pa.array(base[:, i]) for i in range(len(BASE))), pa.array(score)]

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = add_columns(narrow, "text", compute, [*(T.StructField(x, T.LongType()) for x in BASE), T.StructField("score", T.DoubleType())]).drop("text")
    rows = rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
