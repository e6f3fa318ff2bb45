"""The similarity joins against all pairs."""

import random

import numpy as np
import pytest

from crossloom.llm import jaccard, vectors
from crossloom.llm.components import components
from tests.llm.helpers import least_reachable, shingles


def plain_jaccard(rows):
    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    heads = least_reachable([r[0] for r in rows], links)
    return sorted(((d, len(s), h if s else d) for (d, _), s, h in zip(rows, sets, heads)), key=str)


def got_jaccard(df):
    return sorted((tuple(r) for r in jaccard.link_documents(df).select("doc_id", "n_shingles", "component_id").collect()), key=str)


def test_jaccard_is_exact(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert got_jaccard(documents) == plain_jaccard(rows)


@pytest.mark.parametrize("levels", [0, 1, 4])
def test_jaccard_with_small_regions(documents, monkeypatch, levels):
    monkeypatch.setattr(jaccard, "REGION", 300)
    monkeypatch.setattr(jaccard, "LEVELS", levels)
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert got_jaccard(documents) == plain_jaccard(rows)


def hot_rows():
    """Near copies of one text at all distances, chains away from it, and strangers that share a passage."""
    rng = random.Random(5)
    base, passage = [f"w{i}" for i in range(120)], [f"p{i}" for i in range(60)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 5])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    for c in range(3):
        w = list(base)
        for i in range(12):
            w[(i * 31 + c * 7) % 120] = f"z{c}-{i}"
            rows.append((500 + 50 * c + i, " ".join(w)))
    rows += [(1000 + i, " ".join(passage + [f"y{rng.randrange(10**6)}" for _ in range(rng.choice([3, 8, 15, 40]))])) for i in range(80)]
    return rows


@pytest.mark.parametrize("settings", [{}, {"HOT_HERE": 3, "HOT": 10}, {"REGION": 3_000}, {"REGION": 1_000, "PIVOTS": 3, "HOT_HERE": 20, "HOT": 40}, {"REGION": 3_000, "LEVELS": 0}])
def test_jaccard_of_a_hot_group(spark, monkeypatch, settings):
    for k, v in settings.items():
        monkeypatch.setattr(jaccard, k, v)
    rows = hot_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got_jaccard(df) == plain_jaccard(rows)


def test_every_link_meets_in_one_place():
    """Of two points within the radius one is at home where the other is at home or visits."""
    rng = np.random.default_rng(0)
    sets = [set(rng.choice(60, rng.integers(5, 40), replace=False).tolist()) for _ in range(40)]
    for s in list(sets):
        for _ in range(4):
            sets.append({x for x in s if rng.random() > 0.08} | set(rng.choice(60, rng.integers(0, 3)).tolist()) or {1})
    gap = lambda a, b: 1 - len(a & b) / len(a | b)
    pivots = sets[::37]
    home, visited = jaccard.visits(np.array([[gap(s, p) for p in pivots] for s in sets]))
    at = [{int(h)} for h in home]
    for rows, place in visited:
        for r in rows.tolist():
            at[r].add(place)
    close = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert len(close) > 100 and all(home[i] in at[j] or home[j] in at[i] for i, j in close)
    assert sum(map(len, at)) < 0.6 * len(sets) * len(pivots) * jaccard.RINGS


def test_unlinked_sets_with_a_passage_cost_little():
    import time

    rng = np.random.default_rng(1)
    passage = rng.integers(1, 1 << 62, 120).astype(np.uint64)
    sets = [np.unique(np.concatenate([passage, rng.integers(1, 1 << 62, 80).astype(np.uint64)])) for _ in range(8_000)]
    began = time.process_time()
    assert len(np.unique(jaccard.Clump(sets).join())) == len(sets)
    assert time.process_time() - began < 10


def test_jaccard_of_nothing(nothing):
    assert got_jaccard(nothing) == []


@pytest.mark.parametrize("n", range(7))
def test_jaccard_of_a_few_words(spark, n):
    """Texts that are handled together may have fewer words in all than a shingle."""
    text = " ".join(f"w{i}" for i in range(n))
    split = [f"w{i}".encode() for i in range(n)] + [b""]
    assert [len(s) for s in jaccard.shingle_sets(split)] == [1] * n + [0]
    rows = [(7, text)]
    assert got_jaccard(spark.createDataFrame(rows, "doc_id long, text string")) == plain_jaccard(rows)


def test_windows_cannot_miss():
    """Two sets at the radius share enough of their windows, whatever the order."""
    rng = random.Random(1)
    for n in range(1, 120):
        for m in range(n, n + n // 4 + 1):
            most = -(-8 * (n + m) // 18)  # the least overlap with J >= 0.8
            if most > n:
                continue
            both = rng.sample(range(10**6), most)
            a = sorted(both + rng.sample(range(10**6, 2 * 10**6), n - most))
            b = sorted(both + rng.sample(range(2 * 10**6, 3 * 10**6), m - most))
            window = lambda s: set(s[: len(s) - jaccard.least_overlap(len(s)) + jaccard.pivots_shared(len(s))])
            assert len(window(a) & window(b)) >= max(jaccard.needed(n), jaccard.needed(m))


def plain_vectors(rows, cosine=0.95):
    def good(x):
        return x is not None and len(x) and all(v is not None and np.isfinite(v) for v in x) and any(v != 0 for v in x)

    ok = [r[0] is not None and good(r[1]) for r in rows]
    x = [np.array(r[1], np.float32).astype(float) if o else None for r, o in zip(rows, ok)]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if ok[i] and ok[j] and len(x[i]) == len(x[j]) and (x[i] * x[j]).sum() / (np.sqrt((x[i] ** 2).sum()) * np.sqrt((x[j] ** 2).sum())) >= cosine]
    count = np.bincount([k for pair in links for k in pair], minlength=len(rows))
    heads = least_reachable([r[0] if o else None for r, o in zip(rows, ok)], links)
    return sorted(((r[0], int(c), h if o else r[0], r[0] is not None and (not o or h == r[0])) for r, c, h, o in zip(rows, count, heads, ok)), key=str)


@pytest.mark.parametrize("side", [65_536, 70, 25])
def test_vectors_are_exact(spark, monkeypatch, side):
    monkeypatch.setattr(vectors, "SIDE", side)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=12).tolist()) for i in range(60)]
    rows += [(100 + i, (np.array(rows[i % 7][1]) + rng.normal(scale=0.1 + 0.02 * (i % 9), size=12)).tolist()) for i in range(80)]
    rows += [(300 + i, rows[3][1]) for i in range(9)] + [(400, [2 * v for v in rows[3][1]]), (5, rows[5][1]), (5, rows[6][1])]
    rows += [(500, None), (501, []), (502, [0.0] * 12), (503, [1.0] * 11 + [None]), (504, [float("nan")] + [1.0] * 11), (505, [float("inf")] + [1.0] * 11), (None, rows[3][1]), (506, [1.0, 2.0]), (507, [2.0, 4.0]), (508, [3.0]), (509, [-3.0])]
    df = spark.createDataFrame([(a, b, 1, 2, "t") for a, b in rows], "vec_id long, embedding array<float>, n int, x long, task string").repartition(3)
    got = sorted((tuple(r) for r in vectors.link_vectors(df).select("vec_id", "n_links", "component_id", "kept").collect()), key=str)
    assert got == plain_vectors(rows)


def test_few_pairs_are_looked_at():
    """Of 50,000 vectors without structure a block takes the distances of less than a tenth of all pairs."""
    x = np.random.default_rng(0).normal(size=(50_000, 64))
    links = vectors.Links(x, np.ones(len(x), np.int64), 3, 0.95)
    links.within(np.arange(len(x)))
    assert links.evaluated < 0.1 * len(x) ** 2 / 2


def test_close_vectors_meet_in_a_cell():
    rng = np.random.default_rng(1)
    x = rng.normal(scale=0.125, size=(4_000, 8))
    axis, value = vectors.cells(x[:500], 5)
    home, visits = vectors.dealt(x, axis, value, 0.0125)
    at = [{int(h)} for h in home]
    for cell, rows in visits:
        for r in rows.tolist():
            at[r].add(cell)
    close = np.argwhere(np.triu(((x[:, None] - x[None]) ** 2).sum(2) <= 0.0125, 1))
    assert len(close) > 300 and all(home[i] in at[j] or home[j] in at[i] for i, j in close)


def test_vectors_of_nothing(spark):
    assert vectors.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(50)] + [(2000, 2000 + i) for i in range(40)] + [(None, 1), (3, None), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    ids = sorted({x for e in real for x in e})
    at = {x: i for i, x in enumerate(ids)}
    assert got == dict(zip(ids, least_reachable(ids, [(at[a], at[b]) for a, b in real])))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
