"""Words of a text and 64-bit hashes of them, for whole texts at a time in numpy.

A word is a run of bytes outside space and \\t \\n \\v \\f \\r, so UTF-8 never needs decoding. A word's hash is a
polynomial over its bytes (each replaced by a random odd constant) modulo 2**64, taken from prefix sums, then mixed.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BLOCK = 1 << 17
_BASE = 0x9E3779B97F4A7C15
_GOLD = U(_BASE)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which each bit of the result depends on all bits of x."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD) | U(1)
_FOLDED = _TABLE.copy()
_FOLDED[ord("A") : ord("Z") + 1] = _TABLE[ord("a") : ord("z") + 1]
with np.errstate(over="ignore"):
    _POWER = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(BLOCK, _BASE, np.uint64))))
    _INVERSE = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(BLOCK, pow(_BASE, -1, 1 << 64), np.uint64))))


def word_spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end."""
    inside = np.zeros(len(text) + 2, np.int8)
    inside[1:-1] = ~SPACE[np.frombuffer(text, np.uint8)]
    edges = np.flatnonzero(np.diff(inside))
    return edges[0::2], edges[1::2]


def span_hashes(text: bytes, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """A hash of each span text[start:end]; spans are in order and don't overlap. fold: A-Z count as a-z."""
    data, table = np.frombuffer(text, np.uint8), _FOLDED if fold else _TABLE
    out = np.zeros(len(starts), np.uint64)
    for low in range(0, len(data), BLOCK):
        high = min(low + BLOCK, len(data))
        first, last = np.searchsorted(ends, low, "right"), np.searchsorted(starts, high, "left")
        if first == last:
            continue
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(table[data[low:high]] * _POWER[: high - low], out=sums[1:])
        a, z = np.maximum(starts[first:last], low) - low, np.minimum(ends[first:last], high) - low
        part = (sums[z] - sums[a]) * _INVERSE[a]
        if starts[first] < low:  # it began in an earlier block
            part[:1] *= U(pow(_BASE, low - int(starts[first]), 1 << 64))
        out[first:last] += part
    return mix(out + (ends - starts).astype(np.uint64) * _GOLD)


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of width words."""
    n = max(0, len(words) - width + 1)
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = mix(out * _GOLD + words[k : k + n])
    return out
