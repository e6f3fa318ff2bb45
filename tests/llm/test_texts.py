"""Licences, statistics, mixing, archives, language model and pieces against plain versions."""

import math
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from crossloom.llm import contexttree, licences, pieces, rules, warc
from crossloom.llm.common import purge, shared_dir
from crossloom.llm.jaccard import shingle_sets
from crossloom.llm.mixing import mix_sources, source_blocks
from crossloom.llm.statistics import BASE, describe
from crossloom.llm.textcore import NOT_SPACE, Words
from tests.llm.helpers import fold, lower, words


def by_id(df, *columns):
    return sorted((tuple(r) for r in df.select("doc_id", *columns).collect()), key=str)


# ---- licences ----


def test_licences_match_plain_search(spark):
    texts = [
        "Released under the MIT License.", "x under the mit license under the MIT LICENSE", "Licensed under the Apache License, Version 2.0.", "CC BY-NC cc by nc 4.0", "under the mit licenses",
        None, "", "--- ", "This work is licensed under the GNU General Public License, version 3.", licences.TEMPLATES[1][1] + " tail", "the mit license under", "café under the mit license",
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (3, texts[3]), (3, texts[3])]
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "doc_id long, text string, labels string, n_words int")
    want = []
    for d, t in rows:
        w, places = licences.tokens(t or ""), []
        for phrase, label in licences.BASE.items():
            p = phrase.split()
            places += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        at = [i for i, _ in places]
        want.append((d, len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))))
    found = licences.scan_licences(df)
    assert by_id(found, "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(want, key=str)
    got = {r["doc_id"]: r for r in found.collect()}
    assert got[8]["labels"] == "gpl-3" and got[8]["score"] == 1.0 and got[8]["base_labels"] == ""
    assert "mit" in got[9]["labels"] and got[0]["labels"] == "mit" and got[5]["score"] == 0.0
    assert licences.scan_licences(df.limit(0)).count() == 0


def test_matching_statistics():
    a = licences.automaton()
    texts = [licences.tokens(t) for _, t in licences.TEMPLATES] + [p.split() for p in licences.BASE]
    number = {int(h): i for i, h in enumerate(a.hashes)}
    stream = licences.tokens("this work is licensed under the gnu general public license version 2 of the software is furnished to do so hereby granted free mit license")
    from crossloom.llm.textcore import word_hash

    stream = [w for w in stream if word_hash(w) in number]
    occurs = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    for i, (_, size) in enumerate(a.stream([number[word_hash(w)] for w in stream])):
        longest = max(n for n in range(i + 2) if n == 0 or tuple(stream[i - n + 1 : i + 1]) in occurs)
        assert size == longest


def test_altered_template_is_one_span():
    w = licences.TEMPLATES[1][1].split()
    w[10], w[30] = "foo", "bar baz"
    (_, _, spans) = licences.scan_texts(licences.automaton(), [("x " + " ".join(w) + " y").encode()])[0]
    assert len(spans) == 1 and spans[0][0] == "mit" and 0.9 < spans[0][3] < 1


@pytest.mark.parametrize(("text", "labels"), [
    ("this work is licensed under the gnu general public license version 2", []), ("licensed under cc by-nd 4.0", []), ("Creative Commons Attribution-NoDerivatives 4.0 International License", []),
    ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", []), ("licensed under CC BY 4.0.", ["cc-by"]), ("x licensed under cc by-sa 4.0 y", ["cc-by-sa"]),
    ("this work is licensed under the GNU General Public License, version 3 or later", ["gpl-3"]),
])
def test_what_tells_licences_apart(text, labels):
    assert [x[0] for x in licences.scan_texts(licences.automaton(), [text.encode()])[0][2]] == labels


def test_one_changed_word_gives_no_wrong_label():
    a, silent = licences.automaton(), []
    for label, template in licences.TEMPLATES:
        w = licences.tokens(template)
        assert {x[0] for x in licences.scan_texts(a, [template.encode()])[0][2]} == {label}
        if len(w) > 12:
            for i in range(len(w)):
                got = {x[0] for x in licences.scan_texts(a, [" ".join(w[:i] + ["xyzzy"] + w[i + 1 :]).encode()])[0][2]}
                assert got <= {label}
                if not got:
                    silent.append(w[i])
    # Only where the one word that tells two templates apart is gone.
    assert sorted(silent) == ["2", "3", "noncommercial", "sharealike"]


# ---- statistics and rules ----


def plain_base(text):
    text = text or ""
    w = words(text)
    three = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = {k for k, n in Counter(three).items() if n > 1}
    lines = [x for x in text.split("\n") if words(x)]
    return [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len({i + j for i, t in enumerate(three) if t in many for j in range(3)})]


@pytest.mark.parametrize("text", ["", " ", "a", "a b", "x y z x y z x y", "é# * |\n\n é# * |\na\x0bb\na\x0bb", "a a a a", "one\r\none\r\n", "\x1c\x85  x"])
def test_base_counts(text):
    assert describe(text.encode())[0] == plain_base(text)


def test_rules(documents, labels, nothing):
    got = rules.quality_rules(documents, labels, limit=40)
    want = sorted((tuple([r["doc_id"], *(b := plain_base(r["text"])), b[0] < 50 or 100 * b[4] > 50 * b[0]]) for r in documents.collect()), key=str)
    assert by_id(got, *BASE, "base_failed") == want
    assert got.where("kept AND base_failed").count() == 0
    assert rules.quality_rules(nothing, labels.limit(0)).count() == 0
    assert rules.quality_rules(documents, labels.limit(0)).where("NOT base_failed AND NOT kept").count() == 0


def test_forest_is_monotone():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = (x[:, 0] + np.sin(3 * x[:, 1]) + rng.normal(size=3000) > 0).astype(float)
    forest = rules.fit_forest(x, y, monotone={0: 1, 1: -1}, trees=30)
    assert ((forest.score(x) > 0.5) == y).mean() > 0.7
    for j, way in ((0, 1), (1, -1)):
        at = np.repeat(x[:50], 40, 0)
        at[:, j] = np.tile(np.linspace(-3, 3, 40), 50)
        steps = np.diff(forest.margin(at).reshape(50, 40), axis=1) * way
        assert steps.min() >= -1e-9


# ---- mixing ----


def test_mix(documents, nothing):
    rows = [r.asDict() for r in mix_sources(documents).collect()]
    want = sorted(((r["doc_id"], len(words(r["text"]))) for r in documents.collect()), key=str)
    assert sorted(((r["doc_id"], r["size"]) for r in rows), key=str) == want
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    left = sum(sizes.values())
    while True:  # fill, cap, share what is over again
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 3 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
        open_ -= over
    target |= {s: weight[s] * level for s in open_}
    for r in rows:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == sizes[r["source"]]
    for s in order:
        assert abs(taken[s] - target[s]) <= max(3, 0.02 * target[s])
    again = by_id(mix_sources(documents.repartition(5)), "size", "taken")
    assert again == by_id(mix_sources(documents), "size", "taken")
    assert mix_sources(nothing).count() == 0


@pytest.mark.parametrize("one_window", [200_000, 3])
def test_seats_are_highest_quotients(spark, monkeypatch, one_window):
    """Blocks per source against the plain rule, one seat at a time; words taken come within a block a shard of them."""
    from crossloom.operators import ordering

    monkeypatch.setattr(ordering, "ONE_WINDOW", one_window)
    rng = np.random.default_rng(3)
    rows = [(i, " ".join("x" * 1 for _ in range(int(n))), f"s{i % 7}" if i % 7 else None) for i, n in enumerate(rng.integers(50, 400, 70))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = df.selectExpr("source", "CAST(size(split(text, ' ')) AS LONG) AS size")
    per = sorted((r.asDict() for r in source_blocks(sizes, 8).collect()), key=lambda r: r["_rank"])
    total, block = sum(r["source_size"] for r in per), per[0]["block"]
    seats = Counter()
    for _ in range(total // block):
        seats[max(range(len(per)), key=lambda k: (per[k]["target"] / (2 * seats[k] + 1), -k))] += 1
    assert [r["source_blocks"] for r in per] == [seats[k] for k in range(len(per))]
    assert sum(r["target"] for r in per) == pytest.approx(total) and [r["weight"] for r in per] == [1, 2, 3, 1, 2, 3, 1] and per[-1]["source"] is None
    taken = {r["source"]: r["n"] for r in mix_sources(df, block_tokens=8).groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    for k, r in enumerate(per):
        want = min(seats[k] * block, 3 * r["source_size"])
        assert want - 2 * block < taken[r["source"]] <= want


def test_a_source_that_is_taken_three_times_loses_no_word(spark):
    rows = [(i, "w " * (5 + i), "small") for i in range(9)] + [(100 + i, "w " * 997, "zbig") for i in range(20)]
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("source = 'small'").collect()
    assert len(got) == 9 and all(r["taken"] == 3 * r["size"] for r in got)


# ---- archives ----


def test_archives_round_trip(spark):
    big = "é" * 600
    rows = [(1, "http://a", None), (2, "http://b\r\nX: y", big), (3, None, big), (4, "u", "short"), (5, "u", "short"), (3, "u", big), (None, "u", big), (None, "u", "lonely" * 200), (6, "u", "\r\n\r\nWARC/1.1\r\n" * 100)]
    df = spark.createDataFrame([(a, b, c, "response") for a, b, c in rows], "page_id long, url string, html string, record_type string").repartition(3)
    back = warc.archive(df)
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in back.collect()), key=str)
    size = len(big.encode())
    want = [(1, 0, "response", None), (2, size, "revisit", 3), (3, size, "response", None), (4, 5, "response", None), (5, 5, "response", None), (3, size, "response", None), (None, size, "revisit", 3), (None, 1200, "response", None), (6, 1400, "response", None)]
    assert got == sorted(want, key=str)
    assert back.where("record_type = 'response' AND (sha1(payload) <> payload_digest OR octet_length(payload) <> payload_bytes)").count() == 0
    assert {r["url"] for r in back.where("page_id = 2").collect()} == {"http://b%0D%0AX: y"}
    assert warc.archive(df.limit(0)).count() == 0


def test_archive_predicates_reach_the_reader(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://h/{i}", "x" * (500 * i)) for i in range(8)], "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    warc.write_warc(warc.to_records(df), path, max_file_bytes="800")
    files = list((tmp_path / "w").glob("*.warc"))
    assert len(files) > 1 and len(list((tmp_path / "w").glob("_archives-*"))) == 1 and not list((tmp_path / "w").glob("._*"))
    (tmp_path / "w" / f"{'0' * 32}-0.warc").write_bytes(b"WARC/1.1\r\nhalf a rec")  # a lost attempt's
    some = warc.read_warc(spark, path).where("page_id >= 3 AND record_type = 'response' AND url IN ('http://h/4', 'http://h/1')")
    assert "Filter (" not in some._jdf.queryExecution().executedPlan().toString()
    assert [(r["page_id"], len(r["payload"])) for r in some.collect()] == [(4, 2000)]
    bare = warc.read_warc(spark, path, payload="false").collect()
    assert len(bare) == 8 and all(r["payload"] is None for r in bare)


def test_foreign_archives(spark, tmp_path):
    import base64
    import gzip
    import hashlib

    def record(kind, block, *extra):
        lines = [f"WARC-Type: {kind}".encode(), b"WARC-Record-ID: <urn:uuid:0f-%d>" % len(block), *extra, b"Content-Length: %d" % len(block)]
        return b"WARC/1.0\r\n" + b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"

    page = b"<p>" + b"x" * 2000
    plain = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n" + page
    packed = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip\r\n\r\n" + b"".join(b"%x\r\n" % len(c) + c + b"\r\n" for c in (gzip.compress(page)[:20], gzip.compress(page)[20:], b""))
    sha = base64.b32encode(hashlib.sha1(page).digest())
    records = [
        record("warcinfo", b"software: x\r\n"), record("request", b"GET / HTTP/1.1\r\n\r\n"), record("response", plain, b"WARC-Target-URI: <http://a/>", b"WARC-Payload-Digest: sha1:" + sha),
        record("response", packed, b"WARC-Target-URI: http://b/\xff", b"X-Long: one\r\n two"), record("resource", b"abc", b"WARC-Payload-Digest: sha256:00"),
        record("revisit", b"", b"WARC-Refers-To: <urn:uuid:5>", b"WARC-Payload-Digest: sha1:" + sha),
    ]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    digest = hashlib.sha1(page).hexdigest()
    rows = warc.read_warc(spark, f"file://{tmp_path}").collect()
    want = [("warcinfo", None, None, None), ("request", None, None, None), ("response", "http://a/", len(page), digest), ("response", "http://b/ÿ", len(page), digest), ("resource", None, 3, hashlib.sha1(b"abc").hexdigest()), ("revisit", None, None, digest)]
    assert Counter((r["record_type"], r["url"], r["payload_bytes"], r["payload_digest"]) for r in rows) == Counter(want * 2)
    assert all(bytes(r["payload"]) == page for r in rows if r["record_type"] == "response") and {r["page_id"] for r in rows} == {None}
    assert {r["refers_to_id"] for r in rows} == {None, "<urn:uuid:5>"}
    big = warc.read_warc(spark, f"file://{tmp_path}", payload="false").where("payload_bytes > 100 AND record_type = 'response'").collect()
    assert len(big) == 4 and all(r["payload"] is None for r in big)


# ---- context tree ----


def plain_ctw(train, texts, depth):
    """log10 probabilities by the recursion itself, one bit and one context at a time."""
    count = {}
    for t in train:
        s = [255] * depth + list(t) + [255]
        for i in range(depth, len(s)):
            for k in range(8):
                node, bit = (1 << k) | (s[i] >> (8 - k)), (s[i] >> (7 - k)) & 1
                for d in range(depth + 1):
                    count.setdefault((tuple(s[i - d : i]), node), [0, 0])[bit] += 1
    kids = {}
    for c, node in count:
        if c:
            kids.setdefault((c[1:], node), []).append((c, node))
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    weighted, weight = {}, {}
    for c, node in sorted(count, key=lambda x: -len(x[0])):
        own = kt(*count[c, node])
        if len(c) == depth:
            weighted[c, node], weight[c, node] = own, 1.0
        else:
            other = sum(weighted[k] for k in kids[c, node])
            weighted[c, node] = np.logaddexp(math.log(0.5) + own, math.log(0.5) + other)
            weight[c, node] = math.exp(math.log(0.5) + own - weighted[c, node])
    out = []
    for t in texts:
        s, total = [255] * depth + list(t) + [255], 0.0
        for i in range(depth, len(s)):
            for k in range(8):
                node, bit = (1 << k) | (s[i] >> (8 - k)), (s[i] >> (7 - k)) & 1
                mixed, left, p = 0.0, 1.0, 0.5
                for d in range(depth + 1):
                    at = (tuple(s[i - d : i]), node)
                    if at not in count:
                        break
                    one = (count[at][1] + 0.5) / (sum(count[at]) + 1)
                    p = mixed + left * one
                    mixed, left = mixed + left * weight[at] * one, left * (1 - weight[at])
                total += math.log10(p if bit else 1 - p)
        out.append(total)
    return out


@pytest.mark.parametrize(("depth", "entries", "hot"), [(3, 1 << 20, 250_000), (3, 4, 5), (1, 1 << 20, 5), (0, 4, 5)])
def test_context_tree(documents, monkeypatch, depth, entries, hot):
    monkeypatch.setattr(contexttree, "HOT_GRAMS", hot)
    small = documents.where("doc_id IS NULL OR doc_id < 306")
    rows = [(r["doc_id"], r["text"] or "") for r in small.collect()]
    out = [fold(d, 5) == 1 for d, _ in rows]
    train = [t for (_, t), o in zip(rows, out) if not o]
    tokens = Counter(w for t in train for w in words(lower(t)))
    tokens["\n"] = len(train)
    n, v = sum(tokens.values()), len(tokens)
    base = [sum(math.log10((tokens[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*words(lower(t)), "\n"]) for _, t in rows]
    known = [sum(tokens[w] > 0 for w in [*words(lower(t)), "\n"]) for _, t in rows]
    score = plain_ctw([lower(t).encode() for t in train], [lower(t).encode() for _, t in rows], depth)
    want = sorted(zip([d for d, _ in rows], out, [len(words(t)) + 1 for _, t in rows], known, [n] * len(rows), base, score), key=lambda r: str((r[0], r[6])))
    got = contexttree.score_texts(small, depth=depth, word_entries=entries, gram_entries=entries).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()
    got = sorted((tuple(r) for r in got), key=lambda r: str((r[0], r[6])))
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=1e-6)


def test_context_tree_without_training(spark, nothing):
    assert contexttree.score_texts(nothing).count() == 0
    held = next(i for i in range(100) if fold(i, 5) == 1)
    r = contexttree.score_texts(spark.createDataFrame([(held, "ab")], "doc_id long, text string")).first()
    assert r["score"] == pytest.approx(24 * math.log10(0.5)) and r["train_tokens"] == 0 and r["n_known"] == 0


# ---- pieces ----


VOCABULARY = pieces.vocabulary(Path(pieces.VOCABULARY).read_bytes())


def all_paths(text):
    """Every segmentation of text into pieces; characters that are no piece go byte by byte."""
    by = {p: i for i, p in enumerate(VOCABULARY.bytes) if len(p) > 1 or p and i != VOCABULARY.byte_id[p[0]]}

    def rest(at):
        if at == len(text):
            yield ()
            return
        own = [(text[at : at + n], by[text[at : at + n]]) for n in range(1, VOCABULARY.longest + 1) if at + n <= len(text) and text[at : at + n] in by]
        wide = len(text[at:].decode()[0].encode())
        if not any(len(p) == wide for p, _ in own):
            for tail in rest(at + wide):
                yield (*(int(VOCABULARY.byte_id[b]) for b in text[at : at + wide]), *tail)
        for p, i in own:
            for tail in rest(at + len(p)):
                yield (i, *tail)

    return set(rest(0))


@pytest.mark.parametrize("text", ["", "a    b", "x;\r\ny", "so.”  ", "»., \t\t", "日☃ a", "\r\r;\r", "   "])
def test_the_lattice_has_every_segmentation(text):
    lat = pieces.Lattices([text.encode()], VOCABULARY)

    def walks(node):
        if lat.last[node]:
            return [((), 0.0)]
        return [((int(lat.piece[e]), *p), lat.log_p[e] + q) for e in range(lat.first[node], lat.first[node + 1]) for p, q in walks(int(lat.target[e]))]

    whole = [((), 0.0)]
    for u in lat.unit:
        whole = [(a + b, p + q) for a, p in whole for b, q in walks(int(lat.start[u]))]
    full = b" " + text.encode() if text else b""
    assert {p for p, _ in whole} == all_paths(full) and len(whole) == len(all_paths(full))
    weight = {p: sum(VOCABULARY.weight[i] for i in p) for p, _ in whole}
    total = np.logaddexp.reduce(list(weight.values()))
    for p, q in whole:
        assert q == pytest.approx(weight[p] - total, abs=1e-9)


def test_words_that_a_polynomial_hash_would_merge(spark):
    """The Thue-Morse word and its mirror have one polynomial hash modulo 2^64, whatever the odd base."""
    for bits in (10, 11, 12):
        a = "".join("ab"[bin(i).count("1") % 2] for i in range(1 << bits))
        b = a.translate(str.maketrans("ab", "ba"))
        hashes = Words([a.encode(), b.encode()], NOT_SPACE).hashes
        assert len(set(hashes.tolist())) == 2
        sets = shingle_sets([a.encode(), b.encode(), b"x y " + a.encode(), b"x y " + b.encode()])
        assert len({s.tobytes() for s in sets}) == 4
        lat = pieces.Lattices([a.encode(), b.encode()], VOCABULARY)
        assert len(set(lat.unit.tolist())) == 2
        for text, found in zip((a, b), pieces.sample_texts([a.encode(), b.encode()], np.array([1, 2], np.uint64), 1, VOCABULARY)):
            assert b"".join(VOCABULARY.bytes[i] for i in found[0][0]) == b" " + text.encode()
        docs = spark.createDataFrame([(1, a), (2, b), (6, a)], "doc_id long, text string")
        rows = {r["doc_id"]: r for r in contexttree.score_texts(docs).collect()}
        assert rows[1]["n_tokens"] == 2 and rows[1]["train_tokens"] == sum(2 for d in (1, 2, 6) if fold(d, 5) != 1)


def test_words_of_all_sizes_have_their_own_hashes():
    texts = [bytes([65 + (i * j) % 50 for i in range(n)]) for n in range(1, 40) for j in (1, 3, 7)] + [b"a" * n for n in range(1, 40)] + [b"abcdefgh" + b"ijklmnop", b"ijklmnop" + b"abcdefgh"]
    words = Words(texts, NOT_SPACE, fold=False)
    assert len(set(words.hashes.tolist())) == len(set(texts))
    alone = [int(Words([t], NOT_SPACE, fold=False).hashes[0]) for t in texts]
    assert words.hashes.tolist() == alone


def test_decode_over_a_column_of_its_name(spark):
    rows = spark.createDataFrame([(1, "old", [], "x")], "doc_id long, text string, ids array<int>, _ids string")
    out = pieces.decode(rows)
    assert out.columns == ["doc_id", "ids", "_ids", "text"] and out.first()["text"] == ""
    assert pieces.decode(rows, out="ids").first()["ids"] == ""


def test_pieces_round_trip(documents, nothing):
    rows = pieces.decode(pieces.encode_samples(documents), out="back")
    want = Counter((r["doc_id"], r["text"] or "") for r in documents.collect())
    got = [r.asDict() for r in rows.collect()]
    assert Counter((r["doc_id"], r["back"]) for r in got if r["sample"] == 0) == want
    assert all((r["doc_id"], r["back"]) in want for r in got)
    distinct = {}
    for r in got:
        distinct.setdefault((r["doc_id"], r["back"]), []).append(tuple(r["ids"]))
    for (d, text), own in distinct.items():
        copies = want[d, text]
        assert len(set(own)) * copies == len(own)
    assert pieces.encode_samples(nothing).count() == 0


def test_the_queries_decode_what_they_encode(spark, documents, tmp_path):
    """Over whole tables, the long text and broken UTF-8 among them."""
    import hashlib

    from corpus_pipeline import sampled_pieces
    from crossloom.llm.catalog import op10_pieces

    odd = spark.createDataFrame([(400, bytearray(b"\xff\x80a\xc3 b"))], "doc_id long, text binary").selectExpr("doc_id", "CAST(text AS string) AS text")
    docs = documents.select("doc_id", "text").union(odd)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    raw = [(r["doc_id"], bytes(r["b"] or b"")) for r in docs.selectExpr("doc_id", "CAST(text AS binary) AS b").collect()]
    want = Counter((d, len(b), hashlib.sha1(b).hexdigest()) for d, b in raw)
    for rows in (op10_pieces(spark, str(tmp_path)), sampled_pieces(spark, docs, "")):
        got = rows.select("sample", "doc_id", "text_bytes", "text_digest").collect()
        assert Counter(tuple(r)[1:] for r in got if r["sample"] == 0) == want
        assert all(tuple(r)[1:] in want for r in got) and any(r["sample"] == 1 for r in got)
    back = pieces.decode(spark.createDataFrame([([],), (None,)], "ids array<int>"), out="back")
    assert [r["back"] for r in back.collect()] == ["", None]


def test_pieces_depend_on_the_row_only(documents):
    some = documents.where("doc_id < 30")
    key = lambda df: sorted((r["doc_id"], r["sample"], tuple(r["ids"]), r["inclusion"]) for r in df.collect())
    assert key(pieces.encode_samples(some)) == key(pieces.encode_samples(some.repartition(9)))


def test_odd_bytes_round_trip():
    v = VOCABULARY
    for text in (b"", b" ", b"\n\n x\xe2\x96\x81y \t", "日本語 ☃ é\U0001f600".encode(), b"a" * 5000, b"\xff\x80a\xc3"):
        for ids, *_ in pieces.sample_texts([text], np.array([5], np.uint64), 3, v)[0]:
            assert b"".join(v.bytes[i] for i in ids)[1:] == text


def test_samples_follow_the_law_of_drawing_without_replacement():
    v, n = VOCABULARY, 3000
    lat = pieces.Lattices([b"hello"], v)

    def paths(node):
        if lat.last[node]:
            return {(): 0.0}
        return {(int(lat.piece[e]), *p): lat.log_p[e] + q for e in range(lat.first[node], lat.first[node + 1]) for p, q in paths(int(lat.target[e])).items()}

    p = {k: math.exp(x) for k, x in paths(0).items()}
    assert sum(p.values()) == pytest.approx(1)
    first, second, estimate = Counter(), Counter(), 0.0
    for r in pieces.sample_texts([b"hello"] * n, pieces.mix(np.arange(n).astype(np.uint64)), 3, v):
        own = [tuple(x[0].tolist()) for x in r]
        assert len(set(own)) == 3 and r[0][2] >= r[1][2] >= r[2][2]
        first[own[0]] += 1
        second[own[1]] += 1
        estimate += sum(math.exp(x[1]) / x[3] for x in r) / n
    for k in sorted(p, key=lambda k: -p[k])[:3]:
        assert first[k] / n == pytest.approx(p[k], abs=0.035)
        assert second[k] / n == pytest.approx(sum(p[q] * p[k] / (1 - p[q]) for q in p if q != k), abs=0.035)
    assert estimate == pytest.approx(1, abs=0.01)


def test_purge(spark, documents):
    mix_sources(documents).count()
    assert shared_dir(spark)
    purge(spark)
