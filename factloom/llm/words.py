"""Hashes of the words of many texts at once, straight from Arrow's UTF-8 buffers.

A word is a run of bytes other than space, tab, LF, VT, FF and CR, with A-Z lowered. Its hash is the
value of a polynomial over its bytes, taken from prefix sums modulo 2**64, then mixed; so no word ever
becomes a Python object, and a word has the same hash wherever it stands.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15  # odd, so that its powers can be divided by
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_LOWER += 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def _table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 21)
        inverse = pow(_BASE, -1, 1 << 64)
        for key, base in (("up", _BASE), ("down", inverse)):
            out = np.full(size, base, dtype=np.uint64)
            out[0] = 1
            _powers[key] = np.cumprod(out, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(data: np.ndarray, rows: np.ndarray, ink: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes marked in ``ink`` that lie within a row, and the rows' n+1 offsets in them."""
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    edges = rows[(rows > 0) & (rows < len(data))]
    first[edges] = ink[edges]
    last[edges - 1] = ink[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, rows).astype(np.int64)


class Substrings:
    """Hashes of any substrings of a buffer, from prefix sums of its polynomial."""

    def __init__(self, values: np.ndarray) -> None:
        up, self.down = _table(len(values) + 1)
        self.sums = np.empty(len(values) + 1, dtype=np.uint64)
        self.sums[0] = 0
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def hashed(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])


_AS_IS = np.arange(1, 257, dtype=np.uint64)
#: Bytes of words.
WORD = ~_SPACE


def word_spans(raw: np.ndarray, offsets: np.ndarray, ink: np.ndarray = WORD, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends (from the first row's first byte) of all words of the rows, and n+1 offsets of the rows in them.

    ``ink`` marks the bytes that words are made of; without ``lower`` letters keep their case.
    """
    data, rows = raw[int(offsets[0]) : int(offsets[-1])], offsets - offsets[0]
    if not len(data):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
    starts, ends, at = spans(data, rows, ink[data])
    return Substrings((_LOWER if lower else _AS_IS)[data]).hashed(starts, ends), starts, ends, at


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the rows, and n+1 offsets of the rows in them."""
    words, _, _, at = word_spans(raw, offsets)
    return words, at


#: How a byte looks: capital, small or other letter, digit, or itself.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:], _SHAPE[48:58] = ord("A"), ord("a"), ord("a"), ord("0")


def shape_hashes(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hashes of the words' shapes: runs of bytes that look alike count once. One for each of word_hashes."""
    data, rows = _SHAPE[raw[int(offsets[0]) : int(offsets[-1])]], offsets - offsets[0]
    if not len(data):
        return np.zeros(0, np.uint64)
    kept = np.ones(len(data), dtype=bool)
    kept[1:] = (data[1:] != data[:-1]) | _SPACE[data[1:]]
    kept[rows[rows < len(data)]] = True
    ends = np.concatenate(([0], np.cumsum(kept)))
    short, rows = data[kept], ends[rows]
    starts, ends, _ = spans(short, rows, ~_SPACE[short])
    return Substrings(short.astype(np.uint64) + np.uint64(1)).hashed(starts, ends)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Distinct hashes of the runs of ``width`` words; fewer words count as one run; none for no words."""
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + words[k : k + n])
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]
