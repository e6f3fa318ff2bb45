"""SentencePiece encoding and decoding, with distinct sampled segmentations by Gumbel top-k.

A text's segmentations into pieces of the vocabulary are the paths of a lattice; a path's probability is
in proportion to the product of its pieces' weights. Texts are cut where two bytes meet that no piece has
next to each other, which no piece can cross, so the lattice is a chain of unit lattices. Each
distinct unit of a group of texts gets its lattice once: piece lookup by rolling hash, backward sums
over bytes, all in numpy. That makes the walk from any node a chain of independent choices.

Sampling without replacement is a perturbed A-star search down that tree of choices. A set of paths has
the Gumbel-perturbed log mass as its priority; the best set is taken off, its best path is drawn (its
priority is the path's perturbed log probability), and the rest of it falls apart into the sets that
leave this path at one choice each, with priorities drawn below the taken one's. The first k paths
drawn are a sample without replacement in the order of their perturbed values; with the (k+1)-th value as
threshold, 1 - exp(-exp(log p - threshold)) is a path's inclusion probability.

All randomness is a hash of the row key and a choice's place, so results depend on nothing else.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import bounded_batches
from .learning import free_name
from .textcore import groups, mix

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
GROUP_BYTES = 1 << 20
SCHEMA = "doc_id long, sample int, ids array<int>, log_prob double, perturbed double, inclusion double"
_STEP, _UNIT, _SAMPLE = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB


def _u64(x: int) -> np.uint64:
    return np.uint64(x & 0xFFFFFFFFFFFFFFFF)


def _spelling(model, i: int) -> bytes:
    """What piece i spells (the word mark is a space); control and unknown pieces spell nothing."""
    piece = model.id_to_piece(i)
    if model.is_byte(i):
        return bytes([int(piece[1:-1], 16)])
    return b"" if model.is_control(i) or model.is_unknown(i) else piece.replace("▁", " ").encode()


def _model(proto: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=proto)


@lru_cache(maxsize=2)
def spellings(proto: bytes) -> np.ndarray:
    """What every piece spells, by number; all that decoding needs."""
    model = _model(proto)
    return np.array([_spelling(model, i) for i in range(model.get_piece_size())], object)


class Vocabulary:
    """Pieces as bytes (the word mark is a space), their log weights, hashes of all their beginnings, and
    which bytes some piece has next to each other."""

    def __init__(self, proto: bytes, flat: float) -> None:
        model = _model(proto)
        n = model.get_piece_size()
        self.bytes = [_spelling(model, i) for i in range(n)]
        self.spelled = np.array(self.bytes, object)
        self.byte_id = np.zeros(256, np.int32)
        self.weight = np.zeros(n)
        self.joined = np.zeros((256, 256), bool)
        known: dict[int, int] = {}
        pieces = []
        for i, p in enumerate(self.bytes):
            if model.is_byte(i):
                self.byte_id[p[0]] = i
                self.weight[i] = -flat * math.log(n + 2.0)
            elif p:
                self.weight[i] = -flat * math.log(min(-model.get_score(i), n) + 2.0)
                pieces.append((i, p))
                self.joined[list(p[:-1]), list(p[1:])] = True
        # All beginnings of pieces: hash -> piece, or -1 for a mere beginning; a run that is none ends a search.
        self.longest = max((len(p) for _, p in pieces), default=1)
        data = np.frombuffer(b"".join(p for _, p in pieces), np.uint8)
        size = np.array([len(p) for _, p in pieces], np.int64)
        start, run = np.cumsum(size) - size, _Rolling(data)
        for length in range(1, self.longest + 1):
            known.update(dict.fromkeys(run.hashes(start[size > length], length).tolist(), -1))
        known.update(zip(run.hashes(start, size).tolist(), (i for i, _ in pieces)))
        self.known = HashTable(np.array(list(known), np.uint64), np.array(list(known.values()), np.int32))
        self.table = np.zeros((n, self.longest), np.uint8)
        for i, p in pieces:
            self.table[i, : len(p)] = list(p)


class HashTable:
    """Static map of 64-bit hashes to integers: two rows of slots, then binary search for what is left."""

    BITS = 20

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.slots = []
        rest = np.arange(len(keys), dtype=np.int32)
        for shift in (64 - self.BITS, 64 - 2 * self.BITS):
            slots = np.full(1 << self.BITS, -1, np.int32)
            slots[self._slot(self.keys[rest], shift)] = rest
            self.slots.append((shift, slots))
            rest = rest[slots[self._slot(self.keys[rest], shift)] != rest]

    def _slot(self, h: np.ndarray, shift: int) -> np.ndarray:
        return ((h >> np.uint64(shift)) & np.uint64((1 << self.BITS) - 1)).astype(np.int64)

    def get(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value, whether it is there)."""
        at = self.slots[0][1][self._slot(h, self.slots[0][0])]
        hit = (at >= 0) & (self.keys[at] == h)
        again = np.flatnonzero((at >= 0) & ~hit)
        if len(again):
            second = self.slots[1][1][self._slot(h[again], self.slots[1][0])]
            good = (second >= 0) & (self.keys[second] == h[again])
            at[again[good]], hit[again[good]] = second[good], True
            rest = again[(second >= 0) & ~good]
            if len(rest):
                k = np.minimum(np.searchsorted(self.keys, h[rest]), len(self.keys) - 1)
                good = self.keys[k] == h[rest]
                at[rest[good]], hit[rest[good]] = k[good], True
        return self.values[at], hit


@lru_cache(maxsize=2)
def vocabulary(proto: bytes, flat: float = 1.0) -> Vocabulary:
    return Vocabulary(proto, flat)


class Lattices:
    """The lattices of the distinct units of some texts, and where the units occur.

    Nodes are bytes of the distinct units, each with a last node behind it. Node v's choices are
    edges first[v]:first[v + 1], with target, piece, log probability and running probability."""

    def __init__(self, texts: list[bytes], v: Vocabulary) -> None:
        full = [b" " + t if t else t for t in texts]
        joined = np.frombuffer(b"".join(full), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in full])]).astype(np.int64)
        start = np.ones(len(joined), bool)
        start[1:] = ~v.joined[joined[:-1], joined[1:]] & ((joined[1:] & 0xC0) != 0x80)
        start[offsets[:-1][offsets[:-1] < len(joined)]] = True
        at = np.flatnonzero(start)
        self.bounds = np.searchsorted(at, offsets)  # units of text i are bounds[i]:bounds[i + 1]
        size = np.diff(np.concatenate([at, [len(joined)]]))
        place, self.unit = _distinct(joined, at, size)
        # The distinct units side by side, each with one byte more for its last node.
        size = size[place]
        self.start = np.concatenate([[0], np.cumsum(size + 1)])
        n = int(self.start[-1])
        within = np.arange(n) - np.repeat(self.start[:-1], size + 1)
        left = np.repeat(size, size + 1) - within  # bytes from here to the unit's end
        self.start = self.start[:-1]
        source = np.repeat(at[place], size + 1) + within
        data = np.where(left > 0, joined[np.minimum(source, max(0, len(joined) - 1))], 0).astype(np.uint8) if n else np.zeros(0, np.uint8)
        self.last = left == 0
        self._edges(data, left, v)

    def _edges(self, data: np.ndarray, left: np.ndarray, v: Vocabulary) -> None:
        n = len(data)
        run = _Rolling(data)
        begins = (data & 0xC0) != 0x80  # first bytes of characters
        nodes = np.flatnonzero(begins & (left > 0))
        wide = np.ones(n, np.int64)
        wide[data >= 0xC0], wide[data >= 0xE0], wide[data >= 0xF0] = 2, 3, 4
        alone = np.zeros(n, bool)  # characters that are pieces
        parts = []
        for length in range(1, v.longest + 1):
            nodes = nodes[left[nodes] >= length]
            if not len(nodes):
                break
            piece, hit = v.known.get(run.hashes(nodes, length))
            nodes, piece = nodes[hit], piece[hit]
            found, piece = nodes[piece >= 0], piece[piece >= 0]
            same = (data[found[:, None] + np.arange(length)] == v.table[piece, :length]).all(1)
            found, piece = found[same], piece[same]
            alone[found[wide[found] == length]] = True
            parts.append((found, found + length, piece))
        # The other characters go byte by byte, and so do bytes of broken UTF-8 that no character covers.
        odd = np.flatnonzero(begins & (left > 0) & ~alone)
        covered = np.zeros(n + 4, bool)
        loose = np.zeros(n, bool)
        loose[odd] = True
        for j in range(1, 4):
            covered[np.flatnonzero(begins & (wide > j)) + j] = True
            at = odd[(wide[odd] > j) & (left[odd] > j)] + j
            loose[at[~begins[at]]] = True
        each = np.flatnonzero(loose | (~begins & (left > 0) & ~covered[:n]))
        parts.append((each, each + 1, v.byte_id[data[each]]))
        source, target, piece = (np.concatenate([p[i] for p in parts] or [np.zeros(0, np.int64)]) for i in range(3))
        piece = piece.astype(np.int32)
        key = source * 64 + (target - source)
        order = np.argsort(key + left[source] * (64 * n + 64))
        source, target, piece, key = source[order], target[order], piece[order], key[order]
        weight, total = v.weight[piece], np.zeros(n)
        value = np.zeros(len(source))
        cuts = np.flatnonzero(np.diff(left[source])) + 1
        cuts = np.concatenate([[0], cuts, [len(source)]]) if len(source) else np.array([0])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):  # by bytes left: what lies behind is known
            value[a:b] = weight[a:b] + total[target[a:b]]
            s = source[a:b]
            heads = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            total[s[heads]] = np.logaddexp.reduceat(value[a:b], heads)
        order = np.argsort(key)
        source, self.target, self.piece = source[order], target[order], piece[order]
        self.log_p = np.minimum(value[order] - total[source], 0.0)
        self.first = np.searchsorted(source, np.arange(n + 1))
        up = np.concatenate([[0.0], np.cumsum(np.exp(self.log_p))])
        self.up = up[1:] - up[self.first[source]]
        ends = self.first[1:][np.diff(self.first) > 0] - 1
        self.up[ends] = 2.0  # whatever is left of the choice falls to the last edge

    def walk(self, node: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(edges of all walks to their unit's end, how many each took); step s of a walk uses seed + s."""
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        who, count = np.arange(len(node)), np.zeros(len(node), np.int64)
        step = 0
        while len(who):
            edge = self.first[node]
            many = np.flatnonzero(self.first[node + 1] - edge > 1)
            if len(many):
                u = _uniform(seed[who[many]] + _u64(step * _STEP))
                e = edge[many]
                open_ = np.arange(len(many))
                while len(open_):
                    open_ = open_[u[open_] > self.up[e[open_]]]
                    e[open_] += 1
                edge[many] = e
            steps.append((who, edge))
            count[who] += 1
            node = self.target[edge]
            go = ~self.last[node]
            who, node, step = who[go], node[go], step + 1
        place = np.concatenate([[0], np.cumsum(count)])
        out = np.zeros(int(place[-1]), np.int64)
        for s, (who, edge) in enumerate(steps):
            out[place[who] + s] = edge
        return out, count


_BASE = 0x9E3779B97F4A7C15
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        m = max(n, GROUP_BYTES + 4096)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _powers[k] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(m - 1, base, np.uint64))])
    return _powers[0][:n], _powers[1][:n]


class _Rolling:
    """Hashes of any byte runs of a buffer. They find what may be equal; whoever needs equality compares bytes."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = _power(len(data) + 1)
        self.run = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[data] * up[: len(data)], out=self.run[1:])

    def hashes(self, at: np.ndarray, size) -> np.ndarray:
        return mix((self.run[at + size] - self.run[at]) * self.down[at])


def _distinct(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place, number by unit) of the distinct byte runs at:at + size: found by hash, told apart by bytes."""
    _, place, unit = np.unique(_Rolling(data).hashes(at, size), return_index=True, return_inverse=True)
    like = place[unit]
    same = size == size[like]
    if same.all():
        shift = np.repeat(at[like] - at, size)
        same = np.array_equal(data, data[np.arange(len(data)) + shift])
    if not np.all(same):  # different runs with one hash: by the bytes themselves
        number: dict[bytes, int] = {}
        runs = [data[a : a + n].tobytes() for a, n in zip(at.tolist(), size.tolist())]
        unit = np.array([number.setdefault(r, len(number)) for r in runs], np.int64)
        place = np.unique(unit, return_index=True)[1]
    return place, unit


def _uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1), from hashed places."""
    return ((mix(x) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def _gumbel(x: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(_uniform(x)))


def _below(g, bound):
    """A Gumbel value g moved to where it would be had it been drawn at most `bound`."""
    return -np.logaddexp(-bound, -g)


def sample_texts(texts: list[bytes], keys: np.ndarray, k: int, v: Vocabulary) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to k distinct segmentations: (ids, log probability, perturbed value, inclusion).
    Fewer where the text has fewer; the empty text has one, without pieces."""
    lat = Lattices(texts, v)
    n = len(texts)
    units = np.diff(lat.bounds)
    number = np.arange(len(lat.unit)) - np.repeat(lat.bounds[:-1], units)
    keys = keys.astype(np.uint64)
    place = np.repeat(keys, units) + number.astype(np.uint64) * _u64(_UNIT)
    out: list[list] = [[] for _ in range(n)]
    # By text: sets still to be searched as (priority, path, unit, edges of that unit before the choice, shut edges).
    own = keys.tolist()
    sets: list[list[tuple]] = [[(float(g), None)] for g in _gumbel(keys + np.uint64(1))]
    for t in range(k):
        fresh, count = lat.walk(lat.start[lat.unit], place + _u64((t + 1) * _SAMPLE))
        begins = np.concatenate([[0], np.cumsum(count)])
        for i in range(n):
            if not sets[i]:
                continue
            best = max(range(len(sets[i])), key=lambda j: sets[i][j][0])
            value, origin, *rest = sets[i].pop(best)
            lo, hi = lat.bounds[i], lat.bounds[i + 1]
            if origin is None:
                edges, frozen = fresh[begins[lo] : begins[hi]], 0
            else:
                choice, shut = rest
                edges, frozen = _leave(lat, origin, choice, shut, own[i] + t * _SAMPLE, fresh, begins, lo, hi), choice
                sets[i] += _set_of(lat, edges, choice, shut + (int(edges[choice]),), value, own[i] + (t + 1) * _UNIT)
            log_p = lat.log_p[edges]
            out[i].append([lat.piece[edges], float(log_p.sum()), value])
            # The sets that leave this path behind the frozen part: only the best k - t can matter.
            later = np.arange(frozen + (origin is not None), len(edges))
            if len(later):
                before = np.concatenate([[0.0], np.cumsum(log_p)])[later]
                away = -np.expm1(log_p[later])
                with np.errstate(divide="ignore"):
                    mass = before + np.log(away)
                g = mass + _gumbel(_u64(own[i] + (t + 2) * _SAMPLE) + later.astype(np.uint64) * _u64(_STEP))
                want = min(k - t, len(g))
                for j in np.argpartition(-g, want - 1)[:want]:
                    if away[j] > 1e-12:
                        sets[i].append((float(_below(g[j], value)), edges, int(later[j]), (int(edges[later[j]]),)))
    for i in range(n):
        bound = max((s[0] for s in sets[i]), default=-math.inf)
        out[i] = [(ids, p, g, 1.0 if bound == -math.inf else -math.expm1(-math.exp(min(p - bound, 700.0)))) for ids, p, g in out[i]]
    return out


def _node(lat: Lattices, edge: int) -> int:
    """The node that an edge leaves."""
    return int(np.searchsorted(lat.first, edge, side="right")) - 1


def _set_of(lat: Lattices, edges: np.ndarray, choice: int, shut: tuple[int, ...], bound: float, seed: int) -> list[tuple]:
    """The set of paths that share edges before the choice and take none of the shut edges there, if there are any."""
    node = _node(lat, shut[0])
    free = [e for e in range(lat.first[node], lat.first[node + 1]) if e not in shut]
    if not free:
        return []
    mass = float(lat.log_p[edges[:choice]].sum() + np.logaddexp.reduce(lat.log_p[free]))
    g = mass + float(_gumbel(np.array([_u64(seed + choice)]))[0])
    return [(float(_below(g, bound)), edges, choice, shut)]


def _leave(lat: Lattices, edges: np.ndarray, choice: int, shut: tuple[int, ...], seed: int, fresh: np.ndarray, begins: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """A path drawn from the set: edges before the choice, another edge there, and anew behind it."""
    node = _node(lat, shut[0])
    free = [e for e in range(lat.first[node], lat.first[node + 1]) if e not in shut]
    p = np.exp(lat.log_p[free] - np.logaddexp.reduce(lat.log_p[free]))
    u = float(_uniform(np.array([_u64(seed + 3)]))[0])
    new = free[min(int(np.searchsorted(np.cumsum(p), u)), len(free) - 1)]
    tail, node = [new], int(lat.target[new])
    if not lat.last[node]:
        more, _ = lat.walk(np.array([node]), np.array([_u64(seed + 5)]))
        tail += more.tolist()
    # The unit in which the choice lies: as many units end before it as edges before it reach a last node.
    unit = lo + int(lat.last[lat.target[edges[:choice]]].sum())
    return np.concatenate([edges[:choice], np.array(tail, np.int64), fresh[begins[unit + 1] : begins[hi]]])


def _sent(df: DataFrame, path: str):
    """The vocabulary file (half a megabyte, whatever the table's size), read here and sent to the executors."""
    return df.sparkSession.sparkContext.broadcast(Path(path).read_bytes())


def encode_samples(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = 2, seed: int = 7, flat: float = 1.0, path: str = VOCABULARY, spelled: bool = False) -> DataFrame:
    """k distinct sampled segmentations of every whole text (as many as it has, if fewer).

    A piece's weight is (merge rank + 2) ** -flat; characters that are no piece go byte by byte. Null and
    empty texts have one segmentation, without pieces. The row key is doc_id: rows with one id and
    equal texts get equal samples; null ids share a key. Other columns are not looked at.

    Returns doc_id, sample (0 for the highest perturbed value), ids, log_prob, perturbed, inclusion; if spelled, also
    text_bytes and text_digest (SHA-1) of the text that is decoded from the ids."""
    schema = SCHEMA + (", text_bytes long, text_digest string" if spelled else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, names = vocabulary(proto.value, flat), [f.split()[0] for f in schema.split(", ")]
        for batch in batches:
            ids = batch.column("doc_id")
            keys = mix(np.asarray(ids.fill_null(-1)).astype(np.int64).view(np.uint64) ^ np.uint64(seed))
            for first, group in groups(batch.column("text"), GROUP_BYTES):
                found = sample_texts(group, keys[first : first + len(group)], k, v)
                size = [len(x) for x in found]
                flat_rows = [row for x in found for row in x]
                offsets = np.concatenate([[0], np.cumsum([len(r[0]) for r in flat_rows])]).astype(np.int32)
                pieces = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([r[0] for r in flat_rows]).astype(np.int32)))
                number = np.concatenate([np.arange(s) for s in size]).astype(np.int32)
                columns = [ids.slice(first, len(group)).take(pa.array(np.repeat(np.arange(len(group)), size))), pa.array(number), pieces, *(pa.array([r[j] for r in flat_rows], pa.float64()) for j in (1, 2, 3))]
                if spelled:
                    texts = [spell(r[0], v.spelled) for r in flat_rows]
                    columns += [pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha1(t).hexdigest() for t in texts])]
                yield pa.RecordBatch.from_arrays(columns, names)

    bounded_batches(docs.sparkSession)
    proto = _sent(docs, path)
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(run, schema)


def spell(ids: np.ndarray, pieces: np.ndarray) -> bytes:
    """The text that pieces spell, without the space that encoding puts before it."""
    return b"".join(pieces[ids].tolist())[1:]


def decode(rows: DataFrame, *, ids: str = "ids", out: str = "text", path: str = VOCABULARY) -> DataFrame:
    """rows with the text that ids spell, byte by byte (null ids: null), as column `out`, which takes the
    place of a column of that name."""
    proto, hidden = _sent(rows, path), free_name(rows, "ids")
    kept = [c for c in rows.columns if c != out]
    narrow = rows.withColumn(hidden, F.col(ids)).select(*kept, hidden)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = spellings(proto.value)
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            texts = [spell(r.values.to_numpy(), pieces) if r.is_valid else None for r in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.binary()).view(pa.string())], [*batch.schema.names[:-1], out])

    return narrow.mapInArrow(run, T.StructType([*narrow.schema.fields[:-1], T.StructField(out, T.StringType())]))
