"""LM scoring by context-tree weighting over bytes.

A byte is eight binary decisions, the k-th made at the node of its first k bits; every node of every
context of 0 to DEPTH preceding bytes keeps how often it went 0 and 1 over the whole training
corpus. Its estimate is Krichevsky-Trofimov's, and depths are weighted against each other by the
context-tree recursion: a node's weighted probability is half its own estimate of all it has seen
plus half the product of its children's. Scoring mixes the estimates along the path of contexts with
those weights; a context that training never saw at a node adds nothing, the mixture ends above it.

On Spark: tasks count (context, byte) grams and words per partition, one shuffle sums them; the tree is
worked out in partitions dealt by the last two bytes of the context, which hold whole subtrees; contexts of two bytes
with over a thousandth of all grams (and over HOT_GRAMS of them) are dealt by three. Spark sums what the subtrees hand up: the
driver joins the (at most 256^2) nodes of depth one and those of the at most thousand split contexts;
each gram seen anywhere gets one number.
Scoring reads the texts again: tasks hold the most frequent words and grams, at most WORD_ENTRIES and
GRAM_ENTRIES whatever the corpus's size, and look the rest up by a join. No text is ever shuffled.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, cut
from .learning import fold
from .textcore import GROUP_BYTES, NOT_SPACE, Words, groups, lower

#: Bytes of context; a gram (context and byte) must fit 64 bits with the first bit free.
DEPTH = 5
#: What the tasks hold of the model, at most; the rest is joined.
WORD_ENTRIES, GRAM_ENTRIES = 1 << 20, 1 << 21
#: Stands before a text's first byte and after its last; no byte of UTF-8.
EDGE = 0xFF
#: Rows of the counting tasks' tables before they are handed on.
HELD_ROWS = 1_500_000
#: Grams of one two-byte context that a partition takes in any case.
HOT_GRAMS = 250_000
WORD, GRAM = 0, 1
#: Key of the end token among words.
END = 0


def text_grams(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(grams of all texts in order, where each text's grams begin, with the end). A text has a gram for each byte and for its end."""
    edge = bytes([EDGE])
    joined = lower(np.frombuffer(b"".join(edge * depth + t + edge for t in texts), np.uint8)).astype(np.int64)
    n = len(joined) - depth
    keys = np.zeros(n, np.int64)
    for j in range(depth + 1):
        keys = (keys << 8) | joined[j : n + j]
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    inner = np.arange(starts[-1]) + np.repeat(np.arange(len(texts)) * depth, lengths)
    return keys[inner], starts


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def count_batches(batches: Iterator[pa.RecordBatch], depth: int = DEPTH) -> Iterator[pa.RecordBatch]:
    """(kind, key, count in training texts) of text batches, summed within about HELD_ROWS rows.
    Grams that only held-out texts have come with a count of zero."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {WORD: [], GRAM: []}

    def flush() -> Iterator[pa.RecordBatch]:
        for kind, parts in held.items():
            if parts:
                keys, counts = _summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int8)), pa.array(keys), pa.array(counts)], ["kind", "key", "n"])
                parts.clear()

    for batch in batches:
        train = ~batch.column("held_out").to_numpy(zero_copy_only=False)
        for first, texts in groups(batch.column("text")):
            of = train[first : first + len(texts)]
            keys, starts = text_grams(texts, depth)
            held[GRAM].append(_unique(keys, np.repeat(of, np.diff(starts)).astype(np.int64)))
            words = Words(texts, NOT_SPACE)
            keys = words.hashes.view(np.int64)[np.repeat(of, words.counts())]
            held[WORD] += [_unique(keys, np.ones(len(keys), np.int64)), (np.array([END]), np.array([of.sum()]))]
            if sum(len(k) for parts in held.values() for k, _ in parts) > HELD_ROWS:
                yield from flush()
    yield from flush()


def _unique(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(keys) and counts.min() == 1:
        return np.unique(keys, return_counts=True)
    return _summed(keys, counts)


# ---- the tree ----


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log(gamma(x)) for x > 0, by Stirling's series at x + 6."""
    y = x + 6
    out = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    for i in range(6):
        out = out - np.log(x + i)
    return out


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones in a given order."""
    return _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - _log_gamma(n0 + n1 + 1.0) - math.log(math.pi)


class Level:
    """The nodes of one depth: keys (context, bits so far with a leading 1), sorted; counts; estimate of a one."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray) -> None:
        keys, zero, one = [], [], []
        for k in range(8 if len(grams) else 0):
            node = ((grams >> 8) << 8) | (1 << k) | ((grams & 255) >> (8 - k))
            first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            bit = (grams >> (7 - k)) & 1
            keys.append(node[first])
            one.append(np.add.reduceat(counts * bit, first))
            zero.append(np.add.reduceat(counts * (1 - bit), first))
        keys = np.concatenate(keys or [np.zeros(0, np.int64)])
        order = np.argsort(keys, kind="stable")
        self._hold(keys[order], *(np.concatenate(x or [np.zeros(0)])[order].astype(float) for x in (zero, one)))

    def _hold(self, keys: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> None:
        self.keys, self.n0, self.n1 = keys, n0, n1
        self.one = (n1 + 0.5) / (n0 + n1 + 1)
        self.own = log_kt(n0, n1)

    @classmethod
    def of(cls, keys: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> Level:
        """Nodes with these (sorted) keys and counts."""
        out = cls.__new__(cls)
        out._hold(keys, n0, n1)
        return out

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether it is there) of node keys."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys

    def weigh(self, below: Level | None, up: np.ndarray | None) -> None:
        """Weighted probability and own weight, from the children's (up: each child's place here)."""
        self.weigh_sum(None if below is None else np.bincount(up, below.weighted, len(self.keys)))

    def weigh_sum(self, below: np.ndarray | None) -> None:
        """The same from the sum of the children's weighted log probabilities (none: no depth below)."""
        if below is None:
            self.weighted, self.weight = self.own, np.ones(len(self.keys))
            return
        a, b = math.log(0.5) + self.own, math.log(0.5) + below
        self.weighted = np.logaddexp(a, b)
        self.weight = np.exp(a - self.weighted)

    def descend(self, above: Level | None, up: np.ndarray | None) -> None:
        """Mixture so far, share left for here and below, and the mixture if the path ends here."""
        if above is None:
            self.mixed, self.left = np.zeros(len(self.keys)), np.ones(len(self.keys))
        else:
            self.mixed = above.mixed[up] + above.left[up] * above.weight[up] * above.one[up]
            self.left = above.left[up] * (1 - above.weight[up])
        self.last = self.mixed + self.left * self.one


def grow(grams: np.ndarray, counts: np.ndarray, top: int, depth: int) -> tuple[dict[int, Level], dict[int, np.ndarray]]:
    """Levels top..depth over sorted grams with counts above zero, weighted bottom-up; each child's place above it."""
    levels, up = {}, {}
    for d in range(depth, top - 1, -1):
        levels[d] = Level(grams, counts)
        if d < depth:
            up[d + 1], _ = levels[d].find(levels[d + 1].keys & ((1 << (8 * (d + 1))) - 1))
        levels[d].weigh(levels.get(d + 1), up.get(d + 1))
        grams, counts = _summed(grams & ((1 << (8 * d)) - 1), counts)
    return levels, up


def handed_up(level: Level, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(parent node, counts, weighted) that the nodes of depth d hand to the depth above, summed by parent."""
    parent, up = np.unique(level.keys & ((1 << (8 * d)) - 1), return_inverse=True)
    return parent, *(np.bincount(up, x, len(parent)) for x in (level.n0, level.n1, level.weighted))


def _merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    keys, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, *(np.bincount(back, np.concatenate([p[i] for p in parts]), len(keys)) for i in (1, 2, 3))


def crown(sums: tuple[np.ndarray, ...], split: tuple[np.ndarray, ...], depth: int) -> dict[int, Level]:
    """Levels 0 and 1, and of depth two the nodes of split contexts, from what was handed up to them."""
    levels: dict[int, Level] = {}
    if len(split[0]):
        levels[2] = Level.of(*_merged([split])[:3])
        levels[2].weigh_sum(_merged([split])[3])
        sums = _merged([sums, handed_up(levels[2], 2)])
    top = min(1, depth)
    keys, n0, n1, below = _merged([sums])
    levels[top] = Level.of(keys, n0, n1)
    levels[top].weigh_sum(below if depth > top else None)
    if top:
        keys, n0, n1, below = handed_up(levels[1], 1)
        levels[0] = Level.of(keys, n0, n1)
        levels[0].weigh_sum(below)
    for d in sorted(levels):
        up = levels[d - 1].find(levels[d].keys & ((1 << (8 * d)) - 1))[0] if d else None
        levels[d].descend(levels.get(d - 1), up)
    return levels


def gram_values(grams: np.ndarray, levels: dict[int, Level], depth: int) -> np.ndarray:
    """log10 P(byte | context) of grams: each bit from the deepest context that has been at its node."""
    out = np.zeros(len(grams))
    for k in range(8):
        bits = (1 << k) | ((grams & 255) >> (8 - k))
        one, open_ = np.full(len(grams), 0.5), np.arange(len(grams))
        for d in range(depth, -1, -1):
            context = (grams[open_] >> 8) & ((1 << (8 * d)) - 1)
            at, there = levels[d].find((context << 8) | bits[open_])
            one[open_[there]] = levels[d].last[at[there]]
            open_ = open_[~there]
            if not len(open_):
                break
        out += np.log10(np.where((grams >> (7 - k)) & 1 == 1, one, 1 - one))
    return out


# ---- on Spark ----


def _whole(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """(grams, counts) of a partition, sorted."""
    parts = [(b.column("key").to_numpy(), b.column("n").to_numpy()) for b in batches]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(keys)
    return keys[order], counts[order]


def train(docs: DataFrame, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """(words: key, n; grams: key, n, value) over docs with columns text and held_out, both written out."""
    spark = docs.sparkSession
    counted = docs.select("text", "held_out").mapInArrow(lambda b: count_batches(b, depth), "kind byte, key long, n long")
    counted = cut(counted.groupBy("kind", "key").agg(F.sum("n").alias("n")), "ctw-counts")
    words, grams = counted.where(F.col("kind") == WORD).where("n > 0").select("key", "n"), counted.where(F.col("kind") == GRAM).select("key", "n")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(grams.count() / 500_000))
    base = min(2, depth)
    tail = F.expr(f"shiftright(key, 8) & {(1 << (8 * base)) - 1}")
    crowded = grams.groupBy(tail.alias("tail")).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > max(HOT_GRAMS, grams.count() // 1000)).select("tail") if depth > 2 else None
    # At most a thousand contexts can have over a thousandth each.
    hot = np.sort([r["tail"] for r in crowded.collect()]).astype(np.int64) if crowded is not None else np.zeros(0, np.int64)
    suffix = F.when(tail.isin(hot.tolist()), F.expr(f"(shiftright(key, 8) & {(1 << 24) - 1}) + {1 << 24}")).otherwise(tail) if len(hot) else tail
    dealt = grams.withColumn("suffix", suffix).repartition(parts, "suffix").select("key", "n")

    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, dict[int, Level], dict[int, np.ndarray]]]:
        """(depth of the roots, grams, counts, levels, places) of a partition: contexts dealt whole, then split ones."""
        keys, counts = _whole(batches)
        split = np.isin((keys >> 8) & 0xFFFF, hot) if len(hot) else np.zeros(len(keys), bool)
        for top, of in ((base, ~split), (base + 1, split)):
            if of.any():
                k, c = keys[of], counts[of]
                yield top, k, c, *grow(k[c > 0], c[c > 0], top, depth)

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for top, _, _, levels, _ in subtrees(batches):
            x = levels[top]
            rows = (x.keys, x.n0, x.n1, x.weighted) if top < 2 else handed_up(x, top)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows[0]), top > 2)), *(pa.array(v) for v in rows)], ["split", "key", "n0", "n1", "weighted"])

    # Nodes of depth one, at most 256^2, and of depth two under split contexts, at most 256 for each.
    got = dealt.mapInArrow(roots, "split boolean, key long, n0 double, n1 double, weighted double").groupBy("split", "key").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "weighted"))).toArrow()
    columns, split = [got[c].to_numpy() for c in ("key", "n0", "n1", "weighted")], got["split"].to_numpy().astype(bool)
    heads = crown(tuple(c[~split] for c in columns), tuple(c[split] for c in columns), depth)
    shared = spark.sparkContext.broadcast(heads)

    def value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for top, keys, counts, levels, up in subtrees(batches):
            for d in range(top):
                levels[d] = shared.value[d]
            if top < 2:  # the whole tree is in the crown
                levels[top] = shared.value[top]
            for d in range(max(top, 2), depth + 1):
                above = levels[d - 1]
                levels[d].descend(above, up[d] if d > top else above.find(levels[d].keys & ((1 << (8 * d)) - 1))[0])
            for i in range(0, len(keys), 200_000):
                part = slice(i, i + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(keys[part]), pa.array(counts[part]), pa.array(gram_values(keys[part], levels, depth))], ["key", "n", "value"])

    return words, cut(dealt.mapInArrow(value, "key long, n long, value double"), "ctw-grams")


def _frequent(table: DataFrame, entries: int, value: str) -> tuple[np.ndarray, np.ndarray, int]:
    """(keys, values) of the rows with the highest n, at most `entries`, and their least n."""
    bucket = F.floor(F.log2(F.col("n") + 1.0) * 8)
    hist = sorted(((r["b"], r["c"]) for r in table.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("c")).collect()), reverse=True)
    least, room = None, entries
    for b, c in hist:
        if c > room:
            break
        least, room = b, room - c
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0), 1 << 62
    got = table.where(bucket >= least).select("key", F.col(value).cast("double").alias("value")).toArrow()
    keys, values = got["key"].to_numpy(), got["value"].to_numpy()
    order = np.argsort(keys)
    return keys[order], values[order], least


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value or 0, found) of wanted keys."""
    if not len(keys):
        return np.zeros(len(wanted)), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    found = keys[at] == wanted
    return np.where(found, values[at], 0.0), found


def _by_text(keys: np.ndarray, starts: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, list, list]:
    """By text: sum of the known keys' values, number of known; per text the other keys and their counts."""
    n = len(starts) - 1
    some, back = np.unique(keys, return_inverse=True)
    value, found = _lookup(*model, some)
    text = np.repeat(np.arange(n), np.diff(starts))
    known = found[back]
    total, count = np.bincount(text, value[back], n), np.bincount(text, known, n).astype(np.int64)
    rest = np.flatnonzero(~known)
    pair, times = np.unique(text[rest] * (len(some) + 1) + back[rest], return_counts=True)
    cuts = np.searchsorted(pair // (len(some) + 1), np.arange(n + 1))
    names = some[pair % (len(some) + 1)]
    return total, count, [names[a:b] for a, b in zip(cuts, cuts[1:])], [times[a:b] for a, b in zip(cuts, cuts[1:])]


def score_texts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", depth: int = DEPTH, folds: int = 5, held_out: int = 1, word_entries: int = WORD_ENTRIES, gram_entries: int = GRAM_ENTRIES) -> DataFrame:
    """log10 probability of every whole text (A-Z lower-cased) by context-tree weighting, beside a word-unigram score.

    Learns from all texts whose crc32(doc_id as text) mod folds is not held_out. Null text is empty: its
    score is that of the end alone, its tokens are the end token. A null id is a training document.
    Repeated rows all count and each give a row. With nothing to train on, every bit has probability
    one half. Other columns are not looked at.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (fold(F.col(doc_id), folds) == held_out).alias("held_out"), F.col(text).cast("string").alias("text"))
    words, grams = train(rows, depth)
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    base = math.log10(n + 0.5 * (v + 1))
    wk, wv, _ = _frequent(words, word_entries, "n")
    gk, gv, _ = _frequent(grams, gram_entries, "value")
    shared = spark.sparkContext.broadcast(((wk, np.log10(wv + 0.5)), (gk, gv)))
    fields = "rid long, doc_id long, held_out boolean, n_tokens long, n_bytes long, known long, base double, score double, words array<long>, word_n array<long>, grams array<long>, gram_n array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_model, gram_model = shared.value
        longs = pa.list_(pa.int64())
        for batch in batches:
            for first, texts in groups(batch.column("text"), GROUP_BYTES):
                w = Words(texts, NOT_SPACE)
                # Every text's words, then its end token.
                keys = np.insert(w.hashes.view(np.int64), w.bounds[1:], END)
                wt, wn, wr, wc = _by_text(keys, w.bounds + np.arange(len(w.bounds)), word_model)
                gt, _, gr, gc = _by_text(*text_grams(texts, depth), gram_model)
                rid = (uuid.uuid4().int >> 66) + np.arange(len(texts))
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid), part.column("doc_id"), part.column("held_out"), pa.array(w.counts() + 1), pa.array([len(t) for t in texts], pa.int64()), pa.array(wn), pa.array(wt), pa.array(gt), *(pa.array(x, longs) for x in (wr, wc, gr, gc))],
                    [f.split()[0] for f in fields.split(", ")],
                )

    part = cut(rows.mapInArrow(run, fields), "ctw-scored")
    rest = lambda kind, keys, times: part.where(F.size(keys) > 0).select("rid", F.lit(kind).alias("kind"), F.explode(F.arrays_zip(F.col(keys).alias("key"), F.col(times).alias("times"))).alias("x")).select("rid", "kind", "x.key", "x.times")
    rare_words = rest(WORD, "words", "word_n").join(words.withColumnRenamed("n", "c"), "key", "left")
    rare_words = rare_words.select("rid", (F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("base"), F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0).alias("known"), F.lit(0.0).alias("score"))
    rare_grams = rest(GRAM, "grams", "gram_n").join(grams.select("key", "value"), "key", "left")
    rare_grams = rare_grams.select("rid", F.lit(0.0).alias("base"), F.lit(0).cast("long").alias("known"), (F.col("times") * F.coalesce("value", F.lit(8 * math.log10(0.5)))).alias("score"))
    more = rare_words.union(rare_grams).groupBy("rid").agg(*(F.sum(c).alias(f"_{c}") for c in ("base", "known", "score")))
    out = part.drop("words", "word_n", "grams", "gram_n").join(more, "rid", "left")
    plus = lambda c: F.col(c) + F.coalesce(f"_{c}", F.lit(0))
    score = plus("score")
    return out.select(
        "doc_id", "held_out", "n_tokens", plus("known").cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (plus("base") - F.col("n_tokens") * base).alias("base_score"), score.alias("score"),
        "n_bytes", (-score / F.lit(math.log10(2)) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )
