"""Statistics of whole documents, one pass over the text, in numpy inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: The statistics that models may look at, in order.
FEATURES = (
    "log_words", "mean_word_chars", "symbol_share", "upper_share", "digit_share", "punctuation_share", "wide_share",
    "space_share", "dup_line_share", "repeat_word_share", "distinct_share", "top_word_share", "echo_share",
    "words_per_line", "stop_share", "end_share", "pair_share", "byte_entropy",
)
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_SPACE = [9, 10, 11, 12, 13, 32]
_SYMBOLS = list(b"#*$%&|<>")
_PUNCTUATION = list(b".,;:!?'\"-()[]{}/\\_@^~`+=") + _SYMBOLS
_ENDS = (b".", b"!", b"?", b":", b'"')


def describe(text: bytes) -> tuple[list[int], list[float]]:
    """(BASE, FEATURES) of one text. A text without words has zeros."""
    at = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()  # bytes split at ASCII white space only
    n, spaces = len(words), int(at[_SPACE].sum())
    chars = int(at[:128].sum() + at[192:].sum())
    lines = text.split(b"\n")
    full = [x for x in lines if x and not x.isspace()]
    dup_lines, symbols, repeats = len(full) - len(set(full)), int(at[_SYMBOLS].sum()), 0
    if not n:
        return [0, 0, symbols, 0, 0], [0.0] * len(FEATURES)
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    v = len(seen)
    if n >= 3:
        three = (ids[:-2] * v + ids[1:-1]) * v + ids[2:] if v < 2_000_000 else _ranked(ids, v)
        order = np.sort(three)
        again = order[1:][order[1:] == order[:-1]]
        if len(again):
            hit = np.isin(three, again)
            covered = np.zeros(n, bool)
            covered[:-2] = hit
            covered[1:-1] |= hit
            covered[2:] |= hit
            repeats = int(covered.sum())
    word_chars = chars - spaces
    share = at[at > 0] / len(text)
    top = np.bincount(ids)
    features = [
        np.log1p(n), word_chars / n, symbols / word_chars, int(at[65:91].sum()) / word_chars, int(at[48:58].sum()) / word_chars,
        int(at[_PUNCTUATION].sum()) / word_chars, int(at[192:].sum()) / word_chars, spaces / chars, dup_lines / len(full), repeats / n, v / n, int(top.max()) / n,
        float((ids[1:] == ids[:-1]).sum()) / n, min(n / len(full), 1e4), sum(len(w) <= 3 for w in seen) / v, sum(x.rstrip().endswith(_ENDS) for x in full) / len(full),
        float((ids[2:] == ids[:-2]).sum()) / n, float(-(share * np.log2(share)).sum()),
    ]
    return [n, word_chars, symbols, dup_lines, repeats], [float(x) for x in features]


def _ranked(ids: np.ndarray, v: int) -> np.ndarray:
    """Three-word windows as numbers where v cubed would not fit: pairs are ranked first."""
    _, pairs = np.unique(ids[:-1] * v + ids[1:], return_inverse=True)
    return pairs[:-1].astype(np.int64) * v + ids[2:]


def labelled_statistics(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(features, labels) on the driver of a bounded sample (doc_id, text, label), a row per id in order of the
    ids; of an id's repeated rows the least of each statistic. Plain columns keep the aggregation in hash tables."""
    names = [f"f{i}" for i in range(len(FEATURES))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            found = [describe(x.as_py() or b"")[1] for x in texts.cast(pa.binary() if pa.types.is_string(texts.type) else pa.large_binary())]
            x = np.array(found, float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), *(pa.array(x[:, j].copy()) for j in range(len(FEATURES)))], ["doc_id", "label", *names])

    rows = sample.select("doc_id", "text", "label").mapInArrow(run, "doc_id long, label int, " + ", ".join(f"{n} double" for n in names))
    got = rows.groupBy("doc_id").agg(F.min("label").alias("label"), *(F.min(n).alias(n) for n in names)).toArrow().sort_by("doc_id")
    return np.stack([got[n].to_numpy() for n in names], 1).reshape(-1, len(FEATURES)), got["label"].to_numpy().astype(float)
