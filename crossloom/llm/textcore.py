"""Vectorised handling of texts inside tasks: words, their 64-bit hashes, and text batches of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are handled in groups of about so many bytes (one longer text is a group of its own).
GROUP_BYTES = 1 << 20

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words that end at ASCII white space.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of words of lower-case ASCII letters, digits and anything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_STEP, _SIZE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
_WIDE = 8
#: Keeps the first n bytes of eight.
_FIRST = np.array([(1 << (8 * n)) - 1 for n in range(_WIDE + 1)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def groups(batch: pa.Array, size: int = GROUP_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first text, texts as UTF-8; null: empty) in groups of about `size` bytes."""
    kind = pa.large_binary() if pa.types.is_large_string(batch.type) else pa.binary()
    held, first, out = 0, 0, []
    for i, x in enumerate(batch.cast(kind)):
        b = x.as_py() or b""
        out.append(b)
        held += len(b)
        if held >= size:
            yield first, out
            held, first, out = 0, i + 1, []
    if out:
        yield first, out
    if _trim is not None:
        _trim(0)  # a batch is done: hand what numpy has freed back to the machine, which JVM and workers share


def lower(buffer: np.ndarray) -> np.ndarray:
    return _LOWER[buffer]


class Words:
    """The words of some texts: hash, text and place of each. bounds[i]:bounds[i+1] are text i's words."""

    def __init__(self, texts: list[bytes], inside: np.ndarray, fold: bool = True) -> None:
        joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.bytes = lower(joined) if fold else joined
        mask = np.zeros(len(joined) + 1, bool)
        mask[1:] = inside[self.bytes]
        turn = np.flatnonzero(mask[1:] != mask[:-1])
        self.starts, self.ends = turn[::2], turn[1::2]
        self.offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
        self.bounds = np.searchsorted(self.starts, self.offsets)
        self._padded = np.concatenate([self.bytes, np.zeros(_WIDE, np.uint8)])
        self.hashes = self._hash()

    def _eight(self, at: np.ndarray) -> np.ndarray:
        """The eight bytes from each place on, as one integer."""
        return np.lib.stride_tricks.sliding_window_view(self._padded, _WIDE)[at].view("<u8").ravel()

    def _hash(self) -> np.ndarray:
        """Every eight bytes of a word are mixed with their place before they are added, and its size at the end:
        no equation between words holds for their hashes."""
        size = self.ends - self.starts
        many = -(-size // _WIDE)
        first = np.cumsum(many) - many
        word = np.repeat(np.arange(len(size)), many)
        j = np.arange(len(word)) - first[word]
        at = self.starts[word] + _WIDE * j
        part = self._eight(at) & _FIRST[np.minimum(self.ends[word] - at, _WIDE)]
        place = (j + 1).astype(np.uint64) * _STEP
        mixed = mix(part ^ mix(place)) * (mix(place + _SIZE) | np.uint64(1))
        return mix((np.add.reduceat(mixed, first) if len(size) else np.zeros(0, np.uint64)) + size.astype(np.uint64) * _SIZE)

    def stems(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the words longer than size bytes, hashes of their first size (at most 8) bytes); never a word's hash."""
        long = np.flatnonzero(self.ends - self.starts > size)
        return long, mix(mix(self._eight(self.starts[long]) & _FIRST[size]) + np.uint64((size * int(_STEP)) & 0xFFFFFFFFFFFFFFFF))

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def word_hash(word: str) -> int:
    """The hash that Words gives this word."""
    return int(Words([word.encode()], np.ones(256, bool) & (np.arange(256) != 10), fold=False).hashes[0])
