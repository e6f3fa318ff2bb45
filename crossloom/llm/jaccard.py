"""N-gram Jaccard join in the metric 1 - J, exact, for links of J >= 0.8 and what they connect.

Documents with equal sets are one class (a 128-bit signature). Unrelated sets are all at distance 1, where no
region can tell them apart, so a filter goes first that loses no link: of the leading n - ceil(0.8 n) + k(n)
shingles of the sets' order two linked sets share at least k; of those that others have too, ordered rarest
first, the leading c - k + 1 of both hold a common one. Sets without k of them are linked with nothing and leave
here; most do. Sets that such shingles connect are a first region.

The join itself is by pivot regions. A region of more than REGION shingles is dealt anew, on Spark: some of its
sets are pivots; each set is at home with its nearest pivot, in a ring of the width of the radius r by its
distance d from it. Two linked sets' distances from a pivot differ by r at most, and a set's home pivot is
farther from its partner than the partner's own by 2 r at most: so a set also visits the rings within d - r
and d + r of every pivot not farther than its own plus 2 r, if they come before its home in order (the
partner visits in the other direction). Sets within r of a pivot are linked with it, and a region all of
whose sets are known to be connected is closed. Regions are dealt until they are small. Where
pivots do not part a region (all its sets are about as far from each other), it is dealt into shares of which each
pair is joined. In small regions pivots' balls settle whatever is linked with them, and the boundary (within
2 r) gives the next pivots.

Only shingle hashes move, and whole sets only of the documents that survive the filter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, cut
from .components import components
from .textcore import NOT_SPACE, Words, groups, mix

SHINGLE = 5
#: Shingles of a region that is joined in one task, at most about.
REGION = 200_000
#: Pivots that a larger region is dealt by, about, and how often at most.
PIVOTS, LEVELS = 6, 8
#: Window entries in a partition, about.
DEALT = 1_500_000
#: A shingle that so many of a task's sets have at once is hot: its own partition is told so, and its entries go anywhere.
HOT_HERE = 64
#: One that so many sets have in all is hot too; hot ones connect the sets of each partition before they connect partitions.
HOT = 4096
#: How many sets hot shingles count as having, which puts them last.
MANY = 1 << 40
RADIUS, RINGS, SLACK = 0.2, 6, 1e-9

_C = [np.uint64(int(x) | 1) for x in np.random.default_rng(5).integers(1, 1 << 62, SHINGLE + 2)]


def least_overlap(n):
    """Shingles that a set of n shares with any linked one, at least: ceil(0.8 n)."""
    return -(-4 * n // 5)


def pivots_shared(n):
    """k(n): the pivots that windows of two linked sets share is at least k of the smaller."""
    return n // 5 + 1


def needed(n):
    """Shared pivots without which a set of n cannot be linked; its partners have 0.8 n shingles or more."""
    return pivots_shared(least_overlap(n))


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles of five words (fewer words: of all; none: empty)."""
    words = Words(texts, NOT_SPACE)
    h = words.hashes
    m = max(0, len(h) - SHINGLE + 1)
    rolled = np.zeros(m, np.uint64)
    for j in range(SHINGLE):
        rolled += h[j : j + m] * _C[j]
    rolled = mix(rolled)
    out = []
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist()):
        if b - a >= SHINGLE:
            out.append(np.unique(rolled[a : b - SHINGLE + 1]))
        elif b > a:
            short = np.array([b - a], np.uint64) * _C[SHINGLE]
            for j in range(b - a):
                short = mix(short + h[a + j : a + j + 1] * _C[j])
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    """Two independent 64-bit hashes of each set: equal sets, and in effect only they, have both in common. An empty set has none."""
    size = np.array([len(s) for s in sets], np.int64)
    out = np.zeros((2, len(sets)), np.uint64)
    full = np.flatnonzero(size)
    if len(full):
        items, starts = np.concatenate(sets), (np.cumsum(size) - size)[full]
        out[0, full] = mix(np.add.reduceat(mix(items), starts) + size[full].astype(np.uint64) * _C[SHINGLE])
        out[1, full] = mix(np.add.reduceat(mix(items ^ _C[SHINGLE + 1]) * _C[0], starts) + size[full].astype(np.uint64) * _C[1])
    return tuple(pa.array(h.view(np.int64), mask=size == 0) for h in out)


def _sets_of(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for first, texts in groups(batch.column("text")):
            sets = shingle_sets(texts)
            yield batch.slice(first, len(texts)), sets, *signatures(sets)


def _describe(batches):
    for part, sets, hi, lo in _sets_of(batches):
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), hi, lo], ["doc_id", "n_shingles", "hi", "lo"])


# ---- the filter ----

_ENTRIES, _HOT, _LOOSE = range(3)


def _windows(parts: int, hot_here: int):
    """Each set's window, packed by target partition: hashes and sizes by set, keys by entry. Keys that many of the
    sets at hand have are named to the key's partition, and their entries go to a partition of their own choice."""

    def run(batches):
        seen: set[int] = set()
        held: list[tuple[int, int, np.ndarray]] = []
        size = 0

        def flush():
            if not held:
                return
            count = np.array([len(k) for _, _, k in held])
            sig, n = np.array([s for s, _, _ in held], np.int64), np.array([n for _, n, _ in held], np.int64)
            keys, doc = np.concatenate([k for _, _, k in held]).view(np.int64), np.repeat(np.arange(len(held)), count)
            own, place, times = np.unique(keys, return_inverse=True, return_counts=True)
            hot = times[place] >= hot_here
            packed = []
            for kind, at, salt in ((_ENTRIES, ~hot, 0), (_LOOSE, hot, int(sig.min()) & 0xFFFFFF)):
                k, d = keys[at], doc[at]
                part = ((k & 0xFFFFFFFF) + salt) % parts
                order = np.argsort(part * len(held) + d, kind="stable")
                k, d, part = k[order], d[order], part[order]
                cuts = np.searchsorted(part, np.arange(parts + 1))
                for p in np.flatnonzero(np.diff(cuts)).tolist():
                    a, b = cuts[p], cuts[p + 1]
                    docs, each = np.unique(d[a:b], return_counts=True)
                    packed.append((p, kind, sig[docs].tobytes(), n[docs].astype(np.uint32).tobytes(), each.astype(np.uint32).tobytes(), k[a:b].tobytes()))
            much = np.flatnonzero(times >= hot_here)
            part = (own[much] & 0xFFFFFFFF) % parts
            for p in np.unique(part).tolist():
                at = much[part == p]
                packed.append((p, _HOT, b"", b"", b"", own[at].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*packed), [pa.int32()] * 2 + [pa.binary()] * 4)], ["part", "kind", "sigs", "ns", "times", "keys"])

        for _, sets, sigs, _ in _sets_of(batches):
            for s, sig in zip(sets, sigs.to_pylist()):
                if sig is not None and sig not in seen:  # a task sends equal sets once
                    if len(seen) < 1_000_000:
                        seen.add(sig)
                    held.append((sig, len(s), s[: len(s) - least_overlap(len(s)) + pivots_shared(len(s))]))
                    size += len(held[-1][2])
            if size > 500_000:
                yield from flush()
                held, size = [], 0
        yield from flush()

    return run


def _chunks(arrays: list, names: list[str], size: int = 200_000) -> Iterator[pa.RecordBatch]:
    arrays = [pa.array(a) for a in arrays]
    for i in range(0, len(arrays[0]), size):
        yield pa.RecordBatch.from_arrays([a.slice(i, size) for a in arrays], names)


def _shared(batches):
    """Of a partition's window entries those whose key two or more sets have, with their number; MANY for keys that are
    hot in some task. Loose entries are of such keys and pass through."""
    names = ["sig", "n", "key", "times"]
    sigs, ns, keys, hot = [], [], [], [np.zeros(0, np.int64)]
    for batch in batches:
        for kind, s, n, t, k in zip(*(batch.column(c).to_pylist() for c in ("kind", "sigs", "ns", "times", "keys"))):
            times, k = np.frombuffer(t, np.uint32), np.frombuffer(k, np.int64)
            if kind == _HOT:
                hot.append(k)
                continue
            s, n = np.repeat(np.frombuffer(s, np.int64), times), np.repeat(np.frombuffer(n, np.uint32), times).astype(np.int64)
            if kind == _LOOSE:
                yield from _chunks([s, n, k, np.full(len(k), MANY)], names)
            else:
                sigs.append(s)
                ns.append(n)
                keys.append(k)
    sig, n, key = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (sigs, ns, keys))
    order = np.lexsort((sig, key))
    sig, n, key = sig[order], n[order], key[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (sig[1:] != sig[:-1])])[: len(key)]
    sig, n, key = sig[new], n[new], key[new]
    own, place, times = np.unique(key, return_inverse=True, return_counts=True)
    of = np.where(np.isin(own, np.concatenate(hot)), MANY, times)[place]
    yield from _chunks([sig[of > 1], n[of > 1], key[of > 1], of[of > 1]], names)


def _rarest(batches, hot_from: int):
    """Of a partition's sets those with enough shared keys, at the rarest that must hold a common one.

    A hot key is taken by steps of size (a set is in its own step and the next, so linked sets meet in one):
    all its sets of this partition meet under a key of their own, and one of them under the key itself."""
    parts = [tuple(b.column(c).to_numpy() for c in ("sig", "n", "key", "times")) for b in batches]
    if not parts:
        return
    sig, n, key, times = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((key, times, sig))
    sig, n, key, times = sig[order], n[order], key[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    count = np.diff(np.concatenate([first, [len(sig)]]))
    rank = np.arange(len(sig)) - np.repeat(first, count)
    keep = rank < np.repeat(count, count) - needed(n) + 1
    hot = keep & (times > hot_from)
    keep &= ~hot
    yield from _chunks([key[keep], sig[keep], n[keep]], ["key", "sig", "n"])
    if hot.any():
        step = np.floor(np.log(n[hot]) / math.log(1.25)).astype(np.int64)
        node = np.concatenate([mix((key[hot] + (step + j) * 0x9E3779B97F4A7).view(np.uint64)).view(np.int64) for j in (0, 1)])
        own = np.tile(sig[hot], 2)
        here = mix(node.view(np.uint64) ^ np.uint64(int(sig[0]) & 0xFFFFFFFFFFFFFFFF)).view(np.int64)
        node, lead = np.unique(node, return_index=True)
        nodes, sigs = np.concatenate([here, node]), np.concatenate([own, own[lead]])
        yield from _chunks([nodes, sigs, np.zeros(len(nodes), np.int64)], ["key", "sig", "n"])


def _clumps(batches):
    """Edges from the sets of every key to its first, cut where sizes are too far apart (never where they are 0)."""
    parts = [tuple(b.column(c).to_numpy() for c in ("key", "sig", "n")) for b in batches]
    if not parts:
        return
    key, sig, n = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((sig, n, key))
    key, sig, n = key[order], sig[order], n[order]
    start = np.concatenate([[True], (key[1:] != key[:-1]) | (5 * n[:-1] < 4 * n[1:])])
    head = sig[np.maximum.accumulate(np.where(start, np.arange(len(key)), 0))]
    edge = np.unique(np.stack([head, sig], 1)[head != sig], axis=0)
    if len(edge):
        yield from _chunks([edge[:, 0].copy(), edge[:, 1].copy()], ["a", "b"])


# ---- regions on Spark ----

_PLACED = "cid long, n long, mask int, label long, parent string, region string"


def _overlaps(items: np.ndarray, starts: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    """How many of the pivot's shingles each of the sets side by side in items has."""
    at = np.minimum(np.searchsorted(pivot, items), len(pivot) - 1)
    return np.add.reduceat((pivot[at] == items).astype(np.int64), starts)


def visits(distance: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, int]]]:
    """(home of each row of distances from the pivots, (rows, place) for every place that rows visit).
    A place is a pivot's number times RINGS plus a ring; visited places come before the home."""
    near = distance.argmin(1)
    least = distance[np.arange(len(distance)), near]
    home = near * RINGS + np.minimum(np.floor(least / RADIUS).astype(int), RINGS - 1)
    out = []
    for j in range(distance.shape[1]):
        d = distance[:, j]
        low, high = np.floor((d - RADIUS - SLACK) / RADIUS), np.floor((d + RADIUS + SLACK) / RADIUS)
        close = d <= least + 2 * RADIUS + SLACK
        for k in range(RINGS):
            at = np.flatnonzero(close & (low <= k) & (k <= high) & (j * RINGS + k < home))
            if len(at):
                out.append((at, j * RINGS + k))
    return home, out


def _place(level: int):
    """Rows of large regions beside their region's pivots: homes and visits in the pivots' rings, and links with the
    pivots (rows without region, label: the pivot). Of a pair that visited alike at one level an earlier place has the
    join; mask has the levels at which a row was a visitor."""

    def region(rows: list[dict], parent: str) -> Iterator[pa.RecordBatch]:
        pids, pivots = np.array(rows[0]["pids"], np.int64), [np.frombuffer(p, np.uint64) for p in rows[0]["pivots"]]
        cid, n, mask, label = (np.array([r[c] for r in rows], np.int64) for c in ("cid", "n", "mask", "label"))
        items, starts = np.frombuffer(b"".join(r["items"] for r in rows), np.uint64), np.cumsum(n) - n
        both = np.stack([_overlaps(items, starts, p) for p in pivots], 1)
        union = n[:, None] + np.array([len(p) for p in pivots]) - both
        linked, distance = 100 * both >= 80 * union, 1 - both / union
        # Pivots that are linked with each other name their balls alike.
        own = np.stack([_overlaps(np.concatenate(pivots), np.cumsum([0, *map(len, pivots[:-1])]), p) for p in pivots], 1)
        sizes = np.array([len(p) for p in pivots])
        name = pids.copy()
        for _ in pivots:
            for j in range(len(pivots)):
                name[j] = name[100 * own[:, j] >= 80 * (sizes + sizes[j] - own[:, j])].min()
        near = distance.argmin(1)
        label = np.where((label == cid) & linked[np.arange(len(n)), near], name[near], label)
        home, visited = visits(distance)
        sets = [(np.arange(len(n)), home, False)] + [(at, np.full(len(at), place), True) for at, place in visited]
        for at, place, visitor in sets:
            yield pa.RecordBatch.from_arrays(
                [pa.array(cid[at]), pa.array(n[at]), pa.array((mask[at] | (visitor << level)).astype(np.int32)), pa.array(label[at]), pa.array([parent] * len(at)), pa.array([f"{parent}/{p}" for p in place.tolist()])],
                [f.split()[0] for f in _PLACED.split(", ")],
            )
        i, j = np.nonzero(linked)
        none = pa.nulls(len(i), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(cid[i]), pa.array(n[i]), pa.array(np.zeros(len(i), np.int32)), pa.array(pids[j]), none, none], [f.split()[0] for f in _PLACED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[dict]] = {}
            for row in batch.to_pylist():
                by.setdefault(row["region"], []).append(row)
            for parent, rows in by.items():
                yield from region(rows, parent)

    return run


def _regions(sets: DataFrame, files: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(rows of small regions, links found on the way) of sets (cid, n, region, items), whose regions are disjoint."""
    small, links = [], []
    members = sets.select("cid", "n", F.lit(0).alias("mask"), F.col("cid").alias("label"), "region")
    stat = sets.groupBy("region").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("rows"))
    for level in range(LEVELS + 1):
        large = cut(stat.where(F.col("size") > REGION).select("region", "size", "rows"), "jaccard-large", files)
        if large.limit(1).count() == 0:
            small.append(members)
            return small, links
        small.append(members.join(large, "region", "left_anti"))
        members = cut(members.join(large, "region"), "jaccard-members", files)
        if level == LEVELS:
            small.append(_shares(members))
            return small, links
        items = sets.select("cid", "items")
        chance = (F.xxhash64("cid", F.lit(level)).bitwiseAND((1 << 52) - 1) / float(1 << 52)) * F.col("rows") < PIVOTS
        pivots = members.where(chance).join(items, "cid").groupBy("region")
        pivots = pivots.agg(F.sort_array(F.collect_list(F.struct("cid", "items"))).alias("p")).select("region", F.col("p.cid").alias("pids"), F.col("p.items").alias("pivots"))
        beside = members.join(items, "cid").join(pivots, "region").select("cid", "n", "mask", "label", "region", "items", "pids", "pivots")
        placed = cut(beside.mapInArrow(_place(level), _PLACED), "jaccard-placed", files)
        links.append(placed.where("region IS NULL AND cid <> label").select(F.col("cid").alias("a"), F.col("label").alias("b")))
        rows = placed.where("region IS NOT NULL")
        # Closed are regions of one set, of visitors only, and of sets that are known to be connected.
        stat = rows.groupBy("parent", "region").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("rows"), F.bit_and("mask").alias("common"), F.min("label").alias("low"), F.max("label").alias("high"))
        stat = cut(stat.withColumn("open", F.expr("common = 0 AND low < high")), "jaccard-stat", files)
        cost = stat.groupBy("parent").agg(F.sum(F.when(F.col("open"), F.col("size").cast("double") ** 2).otherwise(0.0)).alias("cost"))
        parted = large.join(cost, large["region"] == cost["parent"]).where(F.col("cost") <= 0.5 * F.col("size").cast("double") ** 2).select("region")
        parted = cut(parted, "jaccard-parted", files)
        small.append(_shares(members.join(parted, "region", "left_anti")))
        stat = stat.where("open").join(parted.withColumnRenamed("region", "parent"), "parent", "left_semi").select("region", "size", "rows")
        members = rows.join(stat.select("region"), "region", "left_semi").select("cid", "n", "mask", "label", "region")
    return small, links


def _shares(members: DataFrame) -> DataFrame:
    """Rows of regions (with their size) that pivots do not part, by pairs of shares. Sets of one label, if it has half of
    the region, are known to be connected; their shares meet the others' only."""
    by = members.groupBy("region", "label").agg(F.sum("n").alias("part")).groupBy("region").agg(F.max_by("label", "part").alias("main"), F.max("part").alias("part"), F.sum("part").alias("whole"))
    rows = members.drop("size", "rows").join(by, "region").withColumn("inner", (F.col("label") == F.col("main")) & (2 * F.col("part") > F.col("whole")))
    mains = F.when(2 * F.col("part") > F.col("whole"), F.ceil(F.col("part") / REGION)).otherwise(0).cast("int")
    rest = F.greatest(F.ceil((F.col("whole") - F.when(2 * F.col("part") > F.col("whole"), F.col("part")).otherwise(0)) / REGION), F.lit(1)).cast("int")
    rows = rows.withColumns({"_mains": mains, "_rest": rest, "_hash": F.xxhash64("cid")})
    share = lambda k: F.pmod("_hash", F.greatest(F.col(k), F.lit(1))).cast("int")
    name = lambda a, b: F.concat("region", F.lit("#"), a.cast("string"), F.lit("-"), b.cast("string"))
    own = F.transform(F.sequence(F.lit(0), F.col("_rest") - 1), lambda o: name(F.least(o, share("_rest")), F.greatest(o, share("_rest"))))
    across = F.transform(F.when(F.col("_mains") > 0, F.sequence(F.lit(0), F.col("_mains") - 1)).otherwise(F.array().cast("array<int>")), lambda m: name(share("_rest"), F.concat(F.lit("m"), m.cast("string"))))
    inner = F.transform(F.sequence(F.lit(0), F.col("_rest") - 1), lambda o: name(o, F.concat(F.lit("m"), share("_mains").cast("string"))))
    return rows.select("cid", "n", "mask", "label", F.explode(F.when(F.col("inner"), inner).otherwise(F.concat(own, across))).alias("region"))


# ---- a region in a task ----


class Clump:
    """Sets of one region, the labels of which say what is known to be connected, and the links found among them."""

    def __init__(self, sets: list[np.ndarray], label: np.ndarray | None = None) -> None:
        self.size = np.array([len(s) for s in sets], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.size)])
        _, self.items = np.unique(np.concatenate(sets), return_inverse=True)
        self.label = np.arange(len(sets)) if label is None else np.unique(label, return_inverse=True)[1]

    def candidates(self) -> np.ndarray:
        """Numbers, equal for sets that can be connected: of the leading n - ceil(0.8 n) + 1 shingles, rarest first,
        linked sets have one in common."""
        times = np.bincount(self.items)
        rank = np.empty(len(times), np.int64)
        rank[np.argsort(times, kind="stable")] = np.arange(len(times))
        doc = np.repeat(np.arange(len(self.size)), self.size)
        order = np.lexsort((rank[self.items], doc))
        place = np.arange(len(order)) - np.repeat(self.starts[:-1], self.size)
        lead = order[place < np.repeat(self.size - least_overlap(self.size) + 1, self.size)]
        item, doc = self.items[lead], doc[lead]
        order = np.argsort(item, kind="stable")
        item, doc = item[order], doc[order]
        same = np.flatnonzero(item[1:] == item[:-1])
        return _connected(len(self.size), doc[same], doc[same + 1])

    def overlaps(self, mark: np.ndarray, within: np.ndarray, items: np.ndarray, starts: np.ndarray, i: int) -> np.ndarray:
        own = self.items[self.starts[i] : self.starts[i + 1]]
        mark[own] = 1
        out = np.add.reduceat(mark[items], starts, dtype=np.int64)
        mark[own] = 0
        return out

    def join(self) -> np.ndarray:
        """Labels: equal for sets that links connect."""
        group = self.candidates()
        order = np.argsort(group, kind="stable")
        mark = np.zeros(int(self.items.max()) + 1 if len(self.items) else 1, np.int8)
        for within in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            if len(within) > 1:
                self._settle(within, mark)
        return self.label

    def _settle(self, within: np.ndarray, mark: np.ndarray) -> None:
        size = self.size[within]
        starts = np.cumsum(size) - size
        items = self.items[np.arange(size.sum()) + np.repeat(self.starts[within] - starts, size)]
        # 0: open, 1: in a ball, 2: must be a pivot, 3: has been one.
        state = np.zeros(len(within), np.int8)
        while True:
            todo = np.flatnonzero((state == 0) | (state == 2))
            if not len(todo) or (self.label[within] == self.label[within[0]]).all():
                return
            p = int(todo[0])
            both = self.overlaps(mark, within, items, starts, int(within[p]))
            union = size + size[p] - both
            linked = 100 * both >= 80 * union  # distance within the radius
            linked[p] = True
            near = 100 * both >= 60 * union  # distance within twice the radius
            state[near & ~linked & (state < 3)] = 2
            state[linked & (state == 0)] = 1
            state[p] = 3
            labels = np.unique(self.label[within[linked]])
            if len(labels) > 1:
                self.label[np.isin(self.label, labels)] = labels[0]


def _connected(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number that edges reach, by number below n."""
    label = np.arange(n)
    while len(a):
        np.minimum.at(label, np.maximum(label[a], label[b]), np.minimum(label[a], label[b]))
        while not np.array_equal(up := label[label], label):
            label = up
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def _verify(batches):
    """All regions of a partition: forests of the links in each."""
    table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
    if table is None or not len(table):
        return
    table = table.sort_by([("region", "ascending"), ("cid", "ascending")])
    cid, label = table["cid"].to_numpy(), table["label"].to_numpy()
    code = table["region"].combine_chunks().dictionary_encode().indices.to_numpy()
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(code)) + 1, [len(code)]])
    data = table["items"]
    a, b = [], []
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        own, place = np.unique(cid[lo:hi], return_index=True)
        if len(own) > 1:
            known = np.unique(label[lo:hi][place], return_inverse=True)[1]
            found = Clump([np.frombuffer(data[lo + i].as_py(), np.uint64) for i in place.tolist()], known).join()
            # One edge from each known label's first set to the first set of all that it is connected with.
            _, first = np.unique(known, return_index=True)
            _, lead, back = np.unique(found[first], return_index=True, return_inverse=True)
            ends = first[lead[back]]
            a.append(own[first][first != ends])
            b.append(own[ends][first != ends])
    if a:
        yield from _chunks([np.concatenate(a), np.concatenate(b)], ["a", "b"])


def _bits(clumps: DataFrame) -> tuple[int, np.ndarray]:
    """A bitmap that has a bit for every set in a clump (and by chance for some others), summed natively; at most 32 MB."""
    bits = 1 << min(28, max(16, (16 * max(1, clumps.count())).bit_length()))
    shift = 64 - int(math.log2(bits))
    place = F.shiftrightunsigned("sig", shift)
    got = clumps.select(F.shiftright(place, 6).alias("w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(sig, {shift}) % 64 AS int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[got["w"].to_numpy()] = got["b"].to_numpy()
    return bits, out.view(np.uint64)


def link_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Connected documents: two link when 100 |A and B| >= 80 |A or B| for their sets of distinct
    five-word shingles (A-Z lower-cased; fewer words: the whole sequence as one shingle).

    Null text and text without words: an empty set, linked with nothing. Documents with equal sets are
    one class throughout. A null id never names a component; rows that only null ids reach have a null
    component, and a null id with an empty set too. Repeated rows each give a row. Other columns are
    not looked at.

    Returns doc_id, n_shingles, component_id (the least id reachable, itself included)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    known = cut(rows.mapInArrow(_describe, "doc_id long, n_shingles long, hi long, lo long"), "jaccard-docs")
    total = known.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(0.4 * total / DEALT))

    files = max(24, parts // 8)  # of the narrow tables, which have a small share of the windows' rows
    packed = rows.mapInArrow(_windows(parts, HOT_HERE), "part int, kind int, sigs binary, ns binary, times binary, keys binary").repartitionById(parts, F.col("part"))
    entries = packed.mapInArrow(_shared, "sig long, n long, key long, times long")
    hot_from = HOT
    rare = entries.repartition(parts, "sig").mapInArrow(lambda b: _rarest(b, hot_from), "key long, sig long, n long")
    edges = cut(rare.repartition(parts, "key").mapInArrow(_clumps, "a long, b long"), "jaccard-clump-edges", files)
    clumps = components(edges, files=files).withColumnRenamed("node", "sig")

    bits, words = _bits(clumps)
    shared_bits = spark.sparkContext.broadcast((bits, words))

    def survivors(batches):
        bits, words = shared_bits.value
        down = 64 - int(math.log2(bits))
        seen: set[tuple[int, int]] = set()
        out: list[tuple] = []
        for _, sets, *sigs in _sets_of(batches):
            for s, h, l in zip(sets, *(x.to_pylist() for x in sigs)):  # noqa: E741
                if h is not None and (h, l) not in seen:
                    place = (h & 0xFFFFFFFFFFFFFFFF) >> down
                    if int(words[place >> 6]) >> (place & 63) & 1:
                        if len(seen) < 1_000_000:
                            seen.add((h, l))
                        out.append((h, l, s.tobytes()))
            if sum(len(x[2]) for x in out) > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary()))], ["hi", "lo", "items"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary()))], ["hi", "lo", "items"])

    classes = known.where("hi IS NOT NULL").groupBy("hi", "lo").agg(F.min("doc_id").alias("least"), F.min("n_shingles").alias("n"))
    classes = cut(classes.withColumn("cid", F.monotonically_increasing_id()), "jaccard-classes", files)
    # The clump of a set goes by half of its signature: sets that have just that in common share a clump, no more.
    named = classes.join(clumps.withColumnRenamed("sig", "hi"), "hi").select("hi", "lo", "cid", "n", F.col("component").cast("string").alias("region"))
    found = rows.mapInArrow(survivors, "hi long, lo long, items binary").dropDuplicates(["hi", "lo"])
    sets = cut(found.join(named, ["hi", "lo"]).select("cid", "n", "region", "items"), "jaccard-sets")
    small, links = _regions(sets, files)
    items, regions = sets.select("cid", "items"), "a long, b long"
    verified = []
    for k, part in enumerate(small):
        # The first regions are disjoint, and their sets stand beside them already.
        whole = sets.withColumn("label", F.col("cid")) if k == 0 and len(small) == 1 else part.join(items, "cid")
        verified.append(whole.select("cid", "label", "region", "items"))
    joined = verified[0]
    for more in verified[1:]:
        joined = joined.union(more)
    links.append(joined.repartition(parts, "region").mapInArrow(_verify, regions))
    every = links[0]
    for more in links[1:]:
        every = every.union(more)
    linked = components(cut(every, "jaccard-links", files), files=files).withColumnRenamed("node", "cid")

    classes = classes.join(linked, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    heads = classes.groupBy("component").agg(F.min("least").alias("head"))
    classes = classes.join(heads, "component").select("hi", "lo", "head")
    out = known.join(classes, ["hi", "lo"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("hi").isNull(), F.col("doc_id")).otherwise(F.col("head")).alias("component_id"))
