"""Plain versions of what the operators compute, for small inputs."""

from __future__ import annotations

import re
import zlib

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str | None) -> str:
    return (text or "").translate(LOWER)


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def fold(doc_id, n: int) -> int:
    return 0 if doc_id is None else zlib.crc32(str(doc_id).encode()) % n


def shingles(text: str | None) -> frozenset:
    w = words(lower(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def least_reachable(ids: list, links: list[tuple[int, int]]) -> list:
    """By position: the least id (nulls aside) of the positions that links connect."""
    head = list(range(len(ids)))

    def root(i: int) -> int:
        while head[i] != i:
            i = head[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        head[max(a, b)] = min(a, b)
    out = []
    for i in range(len(ids)):
        own = [x for j, x in enumerate(ids) if root(j) == root(i) and x is not None]
        out.append(min(own) if own else None)
    return out
