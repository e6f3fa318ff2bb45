"""License scans by a generalised suffix automaton of licence tokens.

All templates go into one suffix automaton over words. Each text is streamed through it: at every
word the automaton's state and length are the matching statistic, the longest run ending there that
occurs in some template. Runs that cannot grow are anchors; anchors of one template that follow each
other in text and template are chained, and a chain that covers enough of its template is a span, unless the text says
something else where templates differ: another number, or words where a near template has some that this one has not.
Spans of different labels over the same words compete: the one that covers most words (of as many, the larger share) stays, none if two are equal.
Most words stand next to no template word pair, and those are passed over in numpy beforehand:
inside a match every adjacent pair of words is a pair of some template.
"""

from __future__ import annotations

import re
from collections import defaultdict
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .learning import add_columns
from .textcore import ALNUM, Words, groups, word_hash

# Phrases of the base labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Texts of public licences and of the lines that name them.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("mit", "released under the mit license"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache-2", "licensed under the apache license version 2.0"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("cc-by-nc", "licensed under cc by-nc 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by", "licensed under cc by 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "licensed under cc by-sa 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("lgpl-3", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("agpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd-3", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("bsl-1", "Distributed under the Boost Software License, Version 1.0."),
)

#: Shorter runs are no anchors; wider gaps in text or template end a chain; a span covers so much of its template.
LEAST_RUN, MAX_GAP, LEAST_COVER = 3, 12, 0.6
#: Templates alike by so much are near; where one has more words than another tells them apart.
NEAR = 0.7


def tokens(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


class Automaton:
    """A generalised suffix automaton over words (as small integers) of all templates and base phrases."""

    def __init__(self, templates: tuple[tuple[str, str], ...], phrases: dict[str, str]) -> None:
        texts = [tokens(t) for _, t in templates] + [tokens(p) for p in phrases]
        words = sorted({w for t in texts for w in t}, key=word_hash)
        self.hashes = np.array([word_hash(w) for w in words], np.uint64)
        number = {w: i for i, w in enumerate(words)}
        coded = [[number[w] for w in t] for t in texts]
        n = len(words)
        self.pairs = np.unique([a * n + b for t in coded for a, b in zip(t, t[1:])])
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        ends: dict[int, set[tuple[int, int]]] = defaultdict(set)
        last_of = []
        for k, t in enumerate(coded):
            state = 0
            for i, w in enumerate(t):
                state = self._extend(state, w)
                ends[state].add((k, i + 1))
            last_of.append(state)
        for state in sorted(range(1, len(self.size)), key=lambda s: -self.size[s]):
            ends[self.link[state]] |= ends[state]
        m = len(templates)
        #: By template: its words' hashes, which are numbers, and the places where a near template of another label has more words.
        self.words = [self.hashes[t] for t in coded[:m]]
        self.numbers = [np.array([w[0].isdigit() for w in t]) for t in texts[:m]]
        self.seams: list[set[int]] = [set() for _ in range(m)]
        for k in range(m):
            for o in range(m):
                if templates[k][0] != templates[o][0]:
                    alike = SequenceMatcher(None, coded[k], coded[o], autojunk=False)
                    if alike.ratio() >= NEAR:
                        self.seams[k].update(i for kind, i, _, _, _ in alike.get_opcodes() if kind == "insert")
        #: (template, end) of every run that a state stands for, without the phrases'.
        self.ends = [sorted(x for x in ends[s] if x[0] < m) for s in range(len(self.size))]
        self.lengths, self.labels = [len(t) for t in coded[:m]], [label for label, _ in templates]
        #: By state: (length, label) of the phrases that are suffixes of its longest run.
        self.phrases: list[tuple[tuple[int, str], ...]] = [()] * len(self.size)
        own = {}
        for t, p in zip(coded[m:], phrases.values()):
            state = 0
            for w in t:
                state = self.next[state][w]
            own.setdefault(state, []).append((len(t), p))
        for state in sorted(range(1, len(self.size)), key=lambda s: self.size[s]):
            self.phrases[state] = self.phrases[self.link[state]] + tuple(own.get(state, ()))

    def _state(self, size: int, follow: dict[int, int], link: int) -> int:
        self.next.append(follow)
        self.size.append(size)
        self.link.append(link)
        return len(self.size) - 1

    def _extend(self, last: int, w: int) -> int:
        """The state of the run that ends at last, longer by w."""
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.size[q] == self.size[last] + 1 else self._split(last, w, q)
        state = self._state(self.size[last] + 1, {}, 0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[state] = q if self.size[q] == self.size[p] + 1 else self._split(p, w, q)
        return state

    def _split(self, p: int, w: int, q: int) -> int:
        twin = self._state(self.size[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = twin
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = twin
            p = self.link[p]
        return twin

    def stream(self, codes: list[int]):
        """(state, length) of the longest run ending at each word."""
        state, size = 0, 0
        for w in codes:
            while state and w not in self.next[state]:
                state = self.link[state]
                size = self.size[state]
            if w in self.next[state]:
                state, size = self.next[state][w], size + 1
            yield state, size

    def scan(self, codes: list[int], start: int, places: list, anchors: list) -> None:
        """Adds the base places and the anchors of words start.. that have these codes."""
        before = (0, 0)
        for i, (state, size) in enumerate(self.stream(codes), start):
            places += [(i - n + 1, label) for n, label in self.phrases[state] if n <= size]
            if size <= before[1] and before[1] >= LEAST_RUN:
                anchors.append((i - before[1], before[1], before[0]))
            before = (state, size)
        if before[1] >= LEAST_RUN:
            anchors.append((start + len(codes) - before[1], before[1], before[0]))

    def spans(self, anchors: list[tuple[int, int, int]], hashes: np.ndarray, numbers: np.ndarray) -> list[tuple[str, int, int, float]]:
        """(label, first word, last word, share of the template) of the chains that cover enough; hashes, numbers:
        of the text's words their hashes and which are numbers."""
        by: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for at, size, state in sorted(anchors):
            for k, end in self.ends[state]:
                by[k].append((at, end - size, size))
        out: list[tuple[int, int, int, int]] = []
        for k, own in by.items():
            own.sort()
            best: list[tuple[int, int]] = []  # (words covered, anchor before) of the best chain that ends with each
            found: list[tuple[int, int, int]] = []
            low = 0
            for i, (at, t, size) in enumerate(own):
                cover, before = size, -1
                while own[low][0] + max(self.lengths) + MAX_GAP < at:
                    low += 1
                for j in range(low, i):
                    a, b, n = own[j]
                    # Neighbours may overlap by the words that both could claim; those count once.
                    over = max(0, a + n - at, b + n - t)
                    if a < at and b < t and over < size and max(at - a - n, t - b - n) <= MAX_GAP and best[j][0] + size - over > cover:
                        cover, before = best[j][0] + size - over, j
                best.append((cover, before))
                if cover >= LEAST_COVER * self.lengths[k]:
                    chain, j = [], i
                    while j >= 0:
                        chain.append(own[j])
                        j = best[j][1]
                    chain.reverse()
                    if not self._denied(k, chain, hashes, numbers):
                        out.append((cover, chain[0][0], at + size - 1, k))
        # Best chains first; of chains over the same words one label, and none if two are equal.
        out.sort(key=lambda x: (-x[0], self.lengths[x[3]], x[1], x[2], x[3]))
        kept: list[tuple[int, int, int, int]] = []
        settled: list[tuple[int, int, int, int]] = []
        for x in out:
            rivals = [y for y in settled if 2 * (min(x[2], y[2]) - max(x[1], y[1]) + 1) >= min(x[2] - x[1], y[2] - y[1]) + 1]
            if not rivals:
                kept.append(x)
            else:
                ties = [y for y in rivals if y[0] == x[0] and self.lengths[y[3]] == self.lengths[x[3]] and self.labels[y[3]] != self.labels[x[3]]]
                kept = [y for y in kept if y not in ties]
            settled.append(x)
        return sorted(((self.labels[k], first, last, min(1.0, cover / self.lengths[k])) for cover, first, last, k in kept), key=lambda x: (x[1], x[2], x[0]))

    def _denied(self, k: int, chain: list[tuple[int, int, int]], hashes: np.ndarray, numbers: np.ndarray) -> bool:
        """Whether the text contradicts template k somewhere between, before or after the chain's runs."""
        words, digits, seams = self.words[k], self.numbers[k], self.seams[k]
        at, t, _ = chain[0]
        gaps = [(max(0, at - t), at, 0, t, False)]
        for (a, b, n), (at, t, _) in zip(chain, chain[1:]):
            gaps.append((a + n, at, b + n, t, True))
        a, b, n = chain[-1]
        gaps.append((a + n, min(len(hashes), a + n + len(words) - b - n), b + n, len(words), False))
        for i, j, p, q, inner in gaps:
            # The template's numbers here against the text's.
            mine, own = (digits[p:q], numbers[i:j]) if q > p and j > i else (digits[:0], numbers[:0])
            if len(mine) == len(own):
                mine = own = mine & own
            if mine.any() and own.any() and not np.array_equal(words[p:q][mine], hashes[i:j][own]):
                return True
            # Words where another template has more of them.
            more = j - i > q - p if inner else j > i
            if more and any(p <= x <= q for x in seams if inner or 0 < x < len(words)):
                return True
        return False


@lru_cache(maxsize=4)
def automaton(templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: tuple[tuple[str, str], ...] = tuple(BASE.items())) -> Automaton:
    return Automaton(templates, dict(phrases))


def scan_texts(a: Automaton, texts: list[bytes]) -> list[tuple[int, list[tuple[int, str]], list[tuple[str, int, int, float]]]]:
    """(number of words, base places, spans) of each text."""
    words = Words(texts, ALNUM)
    code = np.searchsorted(a.hashes, words.hashes)
    code[code == len(a.hashes)] = 0
    known = a.hashes[code] == words.hashes
    pair = code[:-1] * len(a.hashes) + code[1:]
    at = np.searchsorted(a.pairs, pair)
    at[at == len(a.pairs)] = 0
    follows = known[:-1] & known[1:] & (a.pairs[at] == pair) if len(code) > 1 else np.zeros(0, bool)
    borders = words.bounds[1:-1]
    inner = borders[(borders > 0) & (borders < len(code))]
    follows[inner - 1] = False
    edge = np.flatnonzero(np.diff(np.concatenate([[False], follows, [False]]).astype(np.int8)))
    places: dict[int, list] = defaultdict(list)
    anchors: dict[int, list] = defaultdict(list)
    starts, ends = edge[::2], edge[1::2] + 1  # runs of words, ends exclusive
    long = ends - starts >= LEAST_RUN
    for s, e, t in zip(starts[long].tolist(), ends[long].tolist(), (np.searchsorted(words.bounds, starts[long], side="right") - 1).tolist()):
        a.scan(code[s:e].tolist(), s - int(words.bounds[t]), places[t], anchors[t])
    first = words.bytes[words.starts]
    numbers, bounds = (first >= 48) & (first <= 57), words.bounds.tolist()
    return [(n, places.get(t, []), a.spans(anchors[t], words.hashes[bounds[t] : bounds[t + 1]], numbers[bounds[t] : bounds[t + 1]]) if t in anchors else []) for t, n in enumerate(words.counts().tolist())]


SPAN = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("cover", T.DoubleType())]))


def scan_licences(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Base phrases and licence spans of every whole text.

    Words are runs of ASCII letters (lower-cased), digits and anything beyond ASCII. n_base counts all
    places of base phrases, first_word and last_word are the smallest and largest of their starts
    (null without any). labels has the base labels and those of the spans; both are distinct, sorted,
    comma-joined, empty without any. score is the largest share of a template that a span covers, 1 with
    a base phrase, 0 with neither. Null or empty text: no words. Repeated rows and null ids each give
    a row. Other columns are not looked at.

    Returns doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""

    def compute(texts: pa.Array) -> list[pa.Array]:
        rows = []
        for _, group in groups(texts):
            for n, places, spans in scan_texts(automaton(), group):
                base, at = {label for _, label in places}, [i for i, _ in places]
                score = 1.0 if places else max((x[3] for x in spans), default=0.0)
                rows.append((n, len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | {x[0] for x in spans})), score, [dict(zip(("label", "first", "last", "cover"), x)) for x in spans]))
        columns = list(zip(*rows)) if rows else [()] * len(kinds)
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("cover", pa.float64())]))]
        return [pa.array(c, t) for c, t in zip(columns, types)]

    kinds = {"n_words": T.LongType(), "n_base": T.LongType(), "first_word": T.LongType(), "last_word": T.LongType(), "base_labels": T.StringType(), "labels": T.StringType(), "score": T.DoubleType(), "spans": SPAN}
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return add_columns(narrow, "text", compute, [T.StructField(k, v) for k, v in kinds.items()]).drop("text")
