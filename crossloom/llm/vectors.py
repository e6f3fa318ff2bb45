"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors with cosine c are at squared distance 2 - 2c. After a rotation their coordinates are split
into BLOCKS blocks; of a pair within the distance at least one block is within its proportional share.
Each block is range-joined by itself. Its space is cut into cells by medians of a bounded sample, about SIDE vectors
each; every vector is at home in one cell and visits the later ones of which its squared distance is
within the block's budget. In a task cells are halved further, along the widest of all the block's
coordinates, and of two halves only those vectors meet that are within the budget of the other's box.
A pair found in several blocks belongs to
the first of them, so each is verified once, in double precision on the vectors as given. Tasks hand on
counts and a spanning forest of the links they found, never the links.

The rotation is random signs, a Hadamard transform and a permutation: sums in fixed order, so that
every task gets bit-equal coordinates.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import cut
from .components import components

BLOCKS = 8
#: Vectors of a cell that meet in one task, at most, on either side.
SIDE = 65_536
#: Vectors that cells are cut by, at most, for each length; cells bear on speed, not on results.
SAMPLE = 8_192
#: Pairs whose distances are taken at once.
TILE = 1 << 16
SLACK = 1e-9
#: What single precision may be off by in a squared distance of unit vectors' blocks.
ROUGH = 4e-6


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def rotate(x: np.ndarray, seed: int = 11) -> np.ndarray:
    """Rotated rows, padded with zeros to a power of two; each row's result is independent of the others."""
    n, d = x.shape
    size = 1 << max(0, (d - 1).bit_length())
    rng = np.random.default_rng(seed)
    out = np.zeros((n, size))
    out[:, :d] = x
    out *= rng.choice([-1.0, 1.0], size)
    h = 1
    while h < size:
        y = out.reshape(n, size // (2 * h), 2, h)
        out = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, size)
        h *= 2
    return (out / math.sqrt(size))[:, rng.permutation(size)]


def block_count(d: int) -> int:
    return min(BLOCKS, 1 << max(0, (d - 1).bit_length()))


def parts_of(x: np.ndarray) -> np.ndarray:
    """Rotated unit vectors by row, block and coordinate."""
    return rotate(unit(x)).reshape(len(x), block_count(x.shape[1]), -1)


def budget_of(d: int, cosine: float) -> float:
    """A block's share of the squared distance."""
    return (2 - 2 * cosine) / block_count(d) * (1 + 1e-9)


def excess(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each row from a box."""
    return (np.maximum(np.maximum(low - x, x - high), 0) ** 2).sum(1)


def cells(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(axis, value) of the cuts of a complete binary tree, at each node the median of the widest axis of the
    sample's points there; node k has the children 2 k + 1 (up to the value) and 2 k + 2."""
    axis, value = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
    at = {0: np.arange(len(sample))}
    for k in range(len(axis)):
        own = sample[at[k]]
        if len(own):
            axis[k] = np.ptp(own, axis=0).argmax()
            value[k] = np.median(own[:, axis[k]])
        left = own[:, axis[k]] <= value[k]
        at[2 * k + 1], at[2 * k + 2] = at[k][left], at[k][~left]
    return axis, value


def dealt(x: np.ndarray, axis: np.ndarray, value: np.ndarray, budget: float) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """(home cell of each row, (cell, rows that visit it) for every cell): visits go to later cells within the budget."""
    inner, d = len(axis), x.shape[1]
    home = np.zeros(len(x), np.int64)
    while inner and home.min() < inner:
        home = np.where(home < inner, 2 * home + 1 + (x[np.arange(len(x)), axis[np.minimum(home, inner - 1)]] > value[np.minimum(home, inner - 1)]), home)
    out = []
    open_ = [(0, np.arange(len(x)), np.full(d, -np.inf), np.full(d, np.inf))]
    while open_:
        k, rows, low, high = open_.pop()
        if k >= inner:
            rows = rows[home[rows] < k]
            out.append((k - inner, rows))
            continue
        for child in (0, 1):
            lo, hi = low.copy(), high.copy()
            (lo if child else hi)[axis[k]] = value[k]
            open_.append((2 * k + 1 + child, rows[excess(x[rows], lo, hi) <= budget + SLACK], lo, hi))
    return home - inner, out


class Links:
    """Counts and a forest (as labels) of the links within one set of vectors that one block has to find."""

    def __init__(self, x: np.ndarray, weight: np.ndarray, block: int, cosine: float) -> None:
        self.x, self.weight, self.block, self.cosine = x, weight, block, cosine
        self.norm = np.sqrt((x * x).sum(1))
        self.budget = budget_of(x.shape[1], cosine)
        self.parts = parts_of(x)
        self.place = np.ascontiguousarray(self.parts[:, block])
        # Rows and columns whose product is the squared distance in the block.
        squares, one = (self.place**2).sum(1, keepdims=True), np.ones((len(x), 1))
        self.rows = np.concatenate([-2 * self.place, squares, one], 1).astype(np.float32)
        self.columns = np.concatenate([self.place, one, squares], 1).astype(np.float32)
        self.count = np.zeros(len(x), np.int64)
        self.label = np.arange(len(x))
        self.evaluated = 0

    def _tile(self, a: np.ndarray, b: np.ndarray, triangle: bool) -> None:
        self.evaluated += len(a) * len(b)
        mask = self.rows[a] @ self.columns[b].T <= self.budget + ROUGH
        if triangle:
            mask = np.triu(mask, 1)
        i, j = np.divmod(np.flatnonzero(mask), len(b))
        for k in range(0, len(i), 1 << 15):
            self._verify(a[i[k : k + (1 << 15)]], b[j[k : k + (1 << 15)]])

    def _verify(self, i: np.ndarray, j: np.ndarray) -> None:
        for earlier in range(self.block + 1):
            within = ((self.parts[i, earlier] - self.parts[j, earlier]) ** 2).sum(1) <= self.budget
            own = within if earlier == self.block else ~within
            i, j = i[own], j[own]
        near = (self.x[i] * self.x[j]).sum(1) / (self.norm[i] * self.norm[j]) >= self.cosine
        i, j = i[near], j[near]
        if not len(i):
            return
        np.add.at(self.count, i, self.weight[j])
        np.add.at(self.count, j, self.weight[i])
        while True:
            a, b = self.label[i], self.label[j]
            open_ = a != b
            if not open_.any():
                return
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while (up := self.label[self.label]).tobytes() != self.label.tobytes():
                self.label = up

    def _halves(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = self.place[a]
        along = own[:, np.ptp(own, axis=0).argmax()]
        order = np.argpartition(along, len(a) // 2)
        return a[order[: len(a) // 2]], a[order[len(a) // 2 :]]

    def within(self, a: np.ndarray) -> None:
        """All pairs among the rows a."""
        if len(a) ** 2 <= TILE:
            self._tile(a, a, True)
        else:
            one, two = self._halves(a)
            self.within(one)
            self.within(two)
            self.across(one, two)

    def across(self, a: np.ndarray, b: np.ndarray) -> None:
        """All pairs of a row of a and one of b."""
        for _ in range(2):
            if not len(a) or not len(b):
                return
            own, other = self.place[a], self.place[b]
            b = b[excess(other, own.min(0), own.max(0)) <= self.budget + SLACK]
            a, b = b, a
        if not len(a) or not len(b):
            return
        if len(a) * len(b) <= TILE:
            self._tile(a, b, False)
            return
        if len(a) < len(b):
            a, b = b, a
        for half in self._halves(a):
            self.across(half, b)


def link_vectors(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = 0.95) -> DataFrame:
    """Links of vectors with cosine >= `cosine` in double precision, whatever else their rows say.

    A vector that is null, empty, zero, holds null or non-finite components, or has no id links with
    nothing; so do vectors of different lengths. Equal vectors are one class while joining, and link with
    each other. Repeated rows count as vectors of their own. Other columns are not looked at.

    Returns vec_id, n_links, component_id (the least id reachable; null for a null id), kept."""
    spark = vectors.sparkSession
    kind = vectors.schema[embedding].dataType.elementType
    kind = T.FloatType() if isinstance(kind, T.FloatType) else T.DoubleType()
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(T.ArrayType(kind)).alias("x"))
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    good = F.col("vec_id").isNotNull() & F.coalesce(~F.exists("x", bad) & F.exists("x", lambda c: c != 0), F.lit(False))
    rows = rows.withColumn("x", F.when(good, F.col("x")))
    classes = rows.where("x IS NOT NULL").groupBy("x").agg(F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("n"))
    classes = cut(classes.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    side = SIDE
    dtype = np.float32 if isinstance(kind, T.FloatType) else np.float64

    def by_length(batch: pa.RecordBatch):
        """(rows of the batch, their vectors) for each length that occurs."""
        lists = batch.column("x")
        size = np.asarray(lists.value_lengths())
        for d in np.unique(size):
            at = np.flatnonzero(size == d)
            yield at, np.asarray(lists.take(pa.array(at)).flatten()).astype(dtype).reshape(-1, d)

    source = classes.select("cid", "n", "x")
    # One row per length; lengths of which one task can hold all vectors have one cell.
    sizes = {r["d"]: r["n"] for r in source.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    trees: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for d, size in sizes.items():
        depth = max(0, math.ceil(math.log2(size / side)))
        if depth:
            some = source.where(F.size("x") == d).orderBy(F.xxhash64("cid")).limit(SAMPLE).select("x").toArrow()["x"].combine_chunks()
            parts = parts_of(np.asarray(some.flatten()).astype(float).reshape(-1, d))
            trees[d] = [cells(parts[:, b], depth) for b in range(block_count(d))]
    whole = (np.zeros(0, np.int64), np.zeros(0))

    def places(batches, lengths=None):
        """(rows, their vectors, cids and weights; block, cell, whether they visit it)."""
        for batch in batches:
            cid, weight = batch.column("cid").to_numpy(), batch.column("n").to_numpy()
            for at, x in by_length(batch):
                d = x.shape[1]
                if lengths is not None and d not in lengths:
                    continue
                parts = parts_of(x.astype(np.float64))
                for b in range(parts.shape[1]):
                    home, visits = dealt(np.ascontiguousarray(parts[:, b]), *(trees[d][b] if d in trees else whole), budget_of(d, cosine))
                    for cell, rows in [(c, np.flatnonzero(home == c)) for c in np.unique(home)]:
                        yield x[rows], cid[at[rows]], weight[at[rows]], b, int(cell), False
                    for cell, rows in visits:
                        if len(rows):
                            yield x[rows], cid[at[rows]], weight[at[rows]], b, cell, True

    def census(batches):
        for x, _, _, b, cell, visitor in places(batches, set(trees)):
            yield pa.RecordBatch.from_pydict({"d": [x.shape[1]], "b": [b], "c": [cell], "v": [visitor], "n": [len(x)]})

    # By length, block and cell: of 65,536 vectors, about 16 rows come to the driver.
    found = source.mapInArrow(census, "d long, b long, c long, v boolean, n long").groupBy("d", "b", "c", "v").agg(F.sum("n").alias("n")).collect() if trees else []
    shares = {(r["d"], r["b"], r["c"], r["v"]): math.ceil(r["n"] / side) for r in found}

    def deal(batches):
        """Rows by task: of a cell in one share with its visitors all pairs; else each pair of the cell's shares, and each of
        them with each of the visitors' shares."""
        for x, cid, weight, b, cell, visitor in places(batches):
            d = x.shape[1]
            homes, guests = shares.get((d, b, cell, False), 0 if d in trees else 1), shares.get((d, b, cell, True), 0)
            data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(x.itemsize * d), len(x), [None, pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())

            def rows(name: str, home: bool, at: np.ndarray):
                picked = pa.array(at)
                return pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(np.full(len(at), home)), pa.array(cid[at]), pa.array(weight[at]), data.take(picked)], ["task", "home", "cid", "n", "x"])

            if homes <= 1 and guests <= 1:
                if homes:
                    yield rows(f"{d}/{b}/{cell}/a/0/0", not visitor, np.arange(len(x)))
                continue
            mine = ((cid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) % np.uint64(guests if visitor else homes)).astype(np.int64)
            for own in np.unique(mine).tolist():
                at = np.flatnonzero(mine == own)
                if visitor:
                    for other in range(homes):
                        yield rows(f"{d}/{b}/{cell}/v/{other}/{own}", False, at)
                    continue
                for other in range(homes):
                    yield rows(f"{d}/{b}/{cell}/h/{min(own, other)}/{max(own, other)}", own <= other, at)
                for other in range(guests):
                    yield rows(f"{d}/{b}/{cell}/v/{own}/{other}", True, at)

    def join(table: pa.Table) -> pa.Table:
        d, b, _, role, p, q = table["task"][0].as_py().split("/")
        x = np.frombuffer(b"".join(table["x"].to_pylist()), dtype).astype(np.float64).reshape(-1, int(d))
        cid = table["cid"].to_numpy()
        order = np.argsort(cid)
        x, cid = x[order], cid[order]
        home, weight = (table[c].to_numpy()[order] for c in ("home", "n"))
        links = Links(x, weight, int(b), cosine)
        if role == "a" or role == "h" and p == q:
            links.within(np.flatnonzero(home))
        links.across(np.flatnonzero(home), np.flatnonzero(~home))
        hit = np.flatnonzero(links.count)
        return pa.table({"cid": cid[hit], "links": links.count[hit], "root": cid[links.label[hit]]})

    tasks = source.mapInArrow(deal, "task string, home boolean, cid long, n long, x binary")
    linked = cut(tasks.groupBy("task").applyInArrow(join, "cid long, links long, root long"), "vector-links")
    links = linked.groupBy("cid").agg(F.sum("links").alias("links"))
    named = components(linked, "cid", "root").withColumnRenamed("node", "cid")
    owns = classes.select("cid", "x", "least_id", "n").join(links, "cid", "left").join(named, "cid", "left")
    heads = owns.where("component IS NOT NULL").groupBy("component").agg(F.min("least_id").alias("head"))
    owns = owns.join(heads, "component", "left").select(F.col("x").alias("_x"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("head", "least_id").alias("head"))
    out = rows.join(owns, F.col("x") == F.col("_x"), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("head", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
