"""Toxicity: cumulative-link (proportional-odds) regression of severity grades on sparse text features.

P(grade > k) = sigmoid(w . x - cut[k]) with one weight vector for all thresholds and cuts in rising
order. x says which words, and which beginnings of words (4 and 5 bytes), a text has, by hash in one of 2^BITS
places; every feature counts, and weights have either sign. The labels say only toxic or not. How
severe a toxic text is comes from evidence that its own label has no part in: the labelled rows fall
into two halves, each half's texts are weighed by the weights that the other half's labels give, and the toxic ones'
thirds by that are grades 1, 2 and 3. Weights are fitted to the grades' likelihood by proximal gradient steps with
an L1 penalty, which leaves most places without weight.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .learning import add_columns, filter_texts, labelled, sigmoid
from .textcore import ALNUM, Words, groups

GRADES = 3
#: Labelled rows that the model is fitted on, at most, by label.
SAMPLE = {0: 8_000, 1: 4_000}
#: Features fall into 2^BITS places.
BITS = 18
#: Inflected forms share a beginning; beginnings of so many bytes are features beside the words.
STEMS = (4, 5)
#: How often places may join a fit.
ROUNDS = 4


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) for every word and word beginning."""
    text = np.repeat(np.arange(len(words.bounds) - 1), words.counts())
    stems = [words.stems(k) for k in STEMS]
    hashes = np.concatenate([words.hashes, *(h for _, h in stems)])
    return np.concatenate([text, *(text[i] for i, _ in stems)]), (hashes >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Severity:
    """keys: the places with a weight, in order; cuts: rising thresholds of grades 1, 2, 3;
    threshold: of P(grade > 0), where the rows fitted on part best into toxic and not."""

    keys: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray
    threshold: float = 0.5

    def margin(self, texts: pa.Array) -> np.ndarray:
        """w . x of every text."""
        out = np.zeros(len(texts))
        if not len(self.keys):
            return out
        for first, group in groups(texts):
            text, found = features(Words(group, ALNUM))
            at = np.searchsorted(self.keys, found)
            at[at == len(self.keys)] = 0
            hit = np.flatnonzero(self.keys[at] == found)
            pairs = np.unique(text[hit] * len(self.keys) + at[hit])  # a word counts once in a text
            np.add.at(out, first + pairs // len(self.keys), self.weights[pairs % len(self.keys)])
        return out

    def above(self, texts: pa.Array) -> np.ndarray:
        """P(grade > k) for k = 0, 1, 2, a column each."""
        return sigmoid(self.margin(texts)[:, None] - self.cuts[None, :])


def likelihood(z: np.ndarray, cuts: np.ndarray, grade: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log likelihood of the grades, its gradient by margin, and by cut.

    With s[k] = P(grade > k), a grade g has probability s[g - 1] - s[g], and its log grows with z by 1 - s[g - 1] - s[g]."""
    n = len(z)
    above = np.concatenate([np.ones((n, 1)), sigmoid(z[:, None] - cuts[None, :]), np.zeros((n, 1))], 1)
    at = np.arange(n)
    upper, lower = above[at, grade], above[at, grade + 1]
    p = np.maximum(upper - lower, 1e-12)
    by_cut = np.zeros(len(cuts) + 2)
    np.add.at(by_cut, grade, upper * (1 - upper) / p)
    np.add.at(by_cut, grade + 1, -lower * (1 - lower) / p)
    return float(-np.log(p).mean()), (upper + lower - 1) / n, by_cut[1:-1] / n


#: Pairs that are summed at a time.
PAIRS = 1 << 19


def margins(rows: np.ndarray, places: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """w . x of n documents."""
    return sum((np.bincount(rows[k : k + PAIRS], w[places[k : k + PAIRS]], n) for k in range(0, len(rows), PAIRS)), np.zeros(n))


def slopes(rows: np.ndarray, places: np.ndarray, gz: np.ndarray, size: int) -> np.ndarray:
    """The gradient by place from that by document."""
    return sum((np.bincount(places[k : k + PAIRS], gz[rows[k : k + PAIRS]], size) for k in range(0, len(rows), PAIRS)), np.zeros(size))


def fit_ordinal(rows: np.ndarray, places: np.ndarray, grade: np.ndarray, cuts: np.ndarray, size: int, penalty: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights, cuts) for (document, place) pairs and grades by document.

    Steps go over the places whose slope exceeds the penalty, which alone can leave zero; then all places are
    looked at again, and those that now exceed it join, until none does."""
    n = len(grade)
    w, vw, vc = np.zeros(size), np.full(size, 1e-8), np.full(len(cuts), 1e-8)
    active = np.zeros(size, bool)
    spread = 1e-3 * np.arange(len(cuts))
    for _ in range(30):
        _, gz, gc = likelihood(np.zeros(n), cuts, grade)
        vc += gc**2
        cuts = np.sort(cuts - 0.3 / np.sqrt(vc) * gc)
    for turn in range(ROUNDS + 1):
        _, gz, _ = likelihood(margins(rows, places, w, n), cuts, grade)
        more = ~active & (np.abs(slopes(rows, places, gz, size)) > penalty)
        if turn == ROUNDS or not more.any():
            turn, active, penalty = ROUNDS, w != 0, penalty / 10
        active |= more & (turn < ROUNDS)
        mine = active[places]
        r, number = rows[mine], (np.cumsum(active) - 1).astype(np.int32)[places[mine]]
        v, u, m = w[active], vw[active], int(active.sum())
        for _ in range(steps):
            _, gz, gc = likelihood(margins(r, number, v, n), cuts, grade)
            gv = slopes(r, number, gz, m)
            u, vc = u + gv**2, vc + gc**2
            rate = 0.3 / np.sqrt(u)
            v = v - rate * gv
            v = np.sign(v) * np.maximum(np.abs(v) - rate * penalty, 0)
            cuts = np.maximum.accumulate(np.sort(cuts - 0.3 / np.sqrt(vc) * gc) - spread) + spread
        w[active], vw[active] = v, u
        if turn == ROUNDS:
            return w, cuts


def fit_severity(rows: np.ndarray, places: np.ndarray, toxic: np.ndarray, *, noise: float = 0.19, steps: int = 100) -> Severity:
    """rows, places: (document, place) pairs without repeats; toxic: 0 or 1 by document. The penalty is noise / sqrt(documents),
    about what a place without any bearing on the grades can reach by chance.

    Without both kinds there is nothing to learn: no place has a weight, and all texts get the
    smoothed share of toxic ones (none at all without rows)."""
    n = len(toxic)
    share = (toxic.sum() + 0.5) / (n + 1.0) if n else 1e-6
    flat = np.log(1 / share - 1) + np.arange(GRADES)
    if len(np.unique(toxic)) < 2:
        return Severity(np.zeros(0, np.int64), np.zeros(0), flat)
    toxic = toxic.astype(int)
    size = int(places.max(initial=0)) + 1
    penalty = noise / math.sqrt(n)
    # Each half's evidence from the other half's labels.
    half, evidence = np.arange(n) % 2, np.zeros(n)
    for h in (0, 1):
        if len(np.unique(toxic[half == h])) > 1:
            mine = half[rows] == h
            number = (np.cumsum(half == h) - 1).astype(np.int32)
            w, _ = fit_ordinal(number[rows[mine]], places[mine], toxic[half == h], flat[:1], size, penalty, steps)
            evidence[half != h] = margins(rows, places, w, n)[half != h]
    third = np.quantile(evidence[toxic == 1], [1 / 3, 2 / 3], method="lower")
    grade = np.where(toxic == 1, 1 + (evidence > third[0]) + (evidence > third[1]), 0).astype(int)
    w, cuts = fit_ordinal(rows, places, grade, flat, size, penalty, steps)
    used = np.flatnonzero(w)
    return Severity(used, w[used], cuts, _parting(sigmoid(margins(rows, places, w, n) - cuts[0]), toxic))


def _parting(p: np.ndarray, toxic: np.ndarray) -> float:
    """The middle of the gap in p that parts toxic from not with the highest sum of both hit rates."""
    order = np.argsort(p, kind="stable")
    q, y = p[order], toxic[order]
    good = np.cumsum(y == 0) / max(1, (y == 0).sum()) - np.cumsum(y == 1) / max(1, (y == 1).sum())
    good[:-1][q[1:] == q[:-1]] = -1
    at = int(np.argmax(good[:-1]))
    return float((q[at] + q[at + 1]) / 2)


def train_toxicity(docs: DataFrame, labels: DataFrame, *, sample: dict[int, int] = SAMPLE, **columns: str) -> Severity:
    """Learns labels.toxic from at most as many rows of each label as `sample` has; of them the driver gets the places they have."""
    rows = labelled(docs, labels, "toxic", each=sample, **columns)

    def run(batches):
        for batch in batches:
            texts, rows = batch.column("text"), []
            for _, group in groups(texts):
                text, found = features(Words(group, ALNUM))
                order = np.argsort(text, kind="stable")
                cuts = np.searchsorted(text[order], np.arange(len(group) + 1))
                rows += [np.unique(found[order[a:b]]).astype(np.int32) for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "label", "places"])

    sparse = rows.mapInArrow(run, "doc_id long, label int, places array<int>").groupBy("doc_id").agg(F.max(F.col("label") > 0).cast("int").alias("label"), F.min("places").alias("places"))
    got = sparse.toArrow().sort_by("doc_id")
    lists = got["places"].combine_chunks()
    rows = np.repeat(np.arange(len(got), dtype=np.int32), np.asarray(lists.value_lengths()) if len(got) else 0)
    return fit_severity(rows, np.asarray(lists.flatten()) if len(got) else np.zeros(0, np.int32), got["label"].to_numpy().astype(int))


def grade_toxicity(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", sample: dict[int, int] = SAMPLE) -> DataFrame:
    """Expected severity (0 to 3) of every whole text.

    toxic: P(grade > 0) is at least the threshold that the model has learned. grade: how many thresholds are passed with probability of
    a half or more. Null and empty texts have no word and get the model's floor. Repeated rows and null
    ids each give a row. Without labels of both kinds all texts get the same. Other columns are not
    looked at.

    Returns doc_id, severity, grade, p_toxic, toxic."""
    model = train_toxicity(docs, labels, sample=sample, doc_id=doc_id, text=text)

    def compute(texts: pa.Array) -> list[pa.Array]:
        above = model.above(texts)
        return [pa.array(above.sum(1)), pa.array((above >= 0.5).sum(1).astype(np.int32)), pa.array(above[:, 0]), pa.array(above[:, 0] >= model.threshold)]

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    kinds = {"severity": T.DoubleType(), "grade": T.IntegerType(), "p_toxic": T.DoubleType(), "toxic": T.BooleanType()}
    return add_columns(narrow, "text", compute, [T.StructField(k, v) for k, v in kinds.items()]).drop("text")


def keep_civil(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", sample: dict[int, int] = SAMPLE) -> DataFrame:
    """The documents that grade_toxicity() does not find toxic, with their own columns."""
    model = train_toxicity(docs, labels, sample=sample, doc_id=doc_id, text=text)
    return filter_texts(docs, text, lambda texts: model.above(texts)[:, 0] < model.threshold)
