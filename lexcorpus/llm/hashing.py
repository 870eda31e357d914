"""Vectorised hashes of byte ranges and words, for use inside tasks.

``Hashed`` keeps running sums of a polynomial over a block of bytes, so the hash of any range costs
two look-ups. The polynomial is taken modulo the prime 2**61 - 1: modulo a power of two, texts of few
letters can be built that agree for every base (Thue-Morse words). Hashes are mixed before use.
"""

from __future__ import annotations

import numpy as np

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_PRIME = np.uint64((1 << 61) - 1)
_BASE = 0x1342543DE82EF95B % int(_PRIME)
_INVERSE = pow(_BASE, -1, int(_PRIME))
_U = [np.uint64(k) for k in range(64)]  # shifts


def _reduced(x: np.ndarray) -> np.ndarray:
    """``x`` modulo the prime."""
    x = (x & _PRIME) + (x >> _U[61])
    return np.minimum(x, x - _PRIME)  # a difference below zero wraps to a large number


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product modulo the prime of numbers below it, by halves of 31 and 30 bits."""
    low = np.uint64((1 << 31) - 1)
    a1, a0, b1, b0 = a >> _U[31], a & low, b >> _U[31], b & low
    middle = a1 * b0 + a0 * b1  # weighs 2**31; 2**61 is 1
    middle = (middle >> _U[30]) + ((middle & np.uint64((1 << 30) - 1)) << _U[31])
    return _reduced(((a1 * b1) << _U[1]) + middle + a0 * b0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every input bit moves every output bit."""
    x = x + _GOLDEN
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUE = _reduced(mix(np.arange(256, dtype=np.uint64)))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


class Powers:
    """Powers of the base and of its inverse, grown on demand and shared by the blocks of a task."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, np.uint64)

    def to(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < size:
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                powers = np.ones(1, np.uint64)
                while len(powers) < size:  # twice as many by one product
                    powers = np.concatenate([powers, _times(powers, np.uint64(pow(base, len(powers), int(_PRIME))))])
                setattr(self, name, powers)
        return self.up, self.down


class Hashed:
    def __init__(self, data: np.ndarray, powers: Powers):
        up, self._down = powers.to(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        terms = _times(BYTE_VALUE[data], up[: len(data)])
        # running sums of 32 low and 29 high bits cannot overflow
        low, high = np.cumsum(terms & np.uint64((1 << 32) - 1)), np.cumsum(terms >> _U[32])
        self._sums[1:] = _reduced((high >> _U[29]) + ((high & np.uint64((1 << 29) - 1)) << _U[32]) + low)

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of data[start:end], element by element."""
        raw = _times(_reduced(self._sums[end] + (_PRIME - self._sums[start])), self._down[start])
        return mix(raw ^ ((end - start).astype(np.uint64) * _GOLDEN))


def word_ranges(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and where the words of each text begin (one more entry than texts)."""
    solid = np.zeros(len(data) + 2, np.int8)
    solid[1:-1] = ~IS_SPACE[data]
    edge = np.diff(solid)
    starts, ends = edge[:-1] == 1, edge[1:] == -1
    # a text ends where the next begins, also between two letters
    inner = at[(at > 0) & (at < len(data))]
    cut = inner[(solid[inner] == 1) & (solid[inner + 1] == 1)]
    starts[cut] = True
    ends[cut - 1] = True
    first = np.flatnonzero(starts)
    return first, np.flatnonzero(ends) + 1, np.searchsorted(first, at)


def sorted_in_groups(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``values`` sorted within each group ``at[i]:at[i + 1]``, in place."""
    for start, end in zip(at[:-1].tolist(), at[1:].tolist()):
        if end - start > 1:
            values[start:end].sort()
    return values


def group_of(at: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def signed(values: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return values.view(np.int64)
