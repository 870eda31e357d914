"""N-grams of words as byte ranges: joined text, XXH64 of ranges, and an open-addressed table of them."""

from __future__ import annotations

import zlib

import numpy as np
import xxhash

from .hashing import LOWER

_P1, _P2, _P3, _P4, _P5 = (  # the primes that XXH64 is defined with
    np.uint64(p)
    for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)
LONG = 4096  # bytes from which two ranges are compared as strings


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Which bytes belong to a word: all but those in ``ranges`` (both ends included)."""
    solid = np.ones(256, bool)
    for low, high in ranges:
        solid[low : high + 1] = False
    return solid


NOT_SPACE = byte_class((0x20, 0x20), (0x09, 0x0D))
ALPHANUMERIC = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def joined_words(data: np.ndarray, at: np.ndarray, solid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words, A-Z lower-cased, a space after each: bytes, starts, ends, and where each text's words begin.

    Words k to k + n - 1 of one text, joined by a space, are the bytes from ``start[k]`` to ``end[k + n - 1]``.
    """
    data = LOWER[data]
    inside = solid[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    filled = at[:-1] < at[1:]
    head, tail = at[:-1][filled], at[1:][filled] - 1
    first[head], last[tail] = inside[head], inside[tail]  # a text ends where the next begins
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    word_at = np.searchsorted(start, at)
    stop = np.cumsum(end - start + 1) - 1
    joined = np.full(len(data[inside]) + len(stop), 32, np.uint8)
    letters = np.ones(len(joined), bool)
    letters[stop] = False
    joined[letters] = data[inside]
    return joined, stop - (end - start), stop, word_at


def gram_ranges(start: np.ndarray, end: np.ndarray, word_at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of ``n`` words, and where each text's runs begin."""
    count = np.diff(word_at)
    left = np.repeat(word_at[1:], count) - np.arange(len(start))
    head = np.flatnonzero(left >= n)
    return start[head], end[head + n - 1], np.concatenate([[0], np.cumsum(np.maximum(count - n + 1, 0))])


def _lanes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eight, four and one byte from every position on, as little-endian numbers."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    return eights, np.ndarray(len(data) + 1, "<u4", padded, strides=(1,)), padded


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def xxh64(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of ``data[start:end]``, element by element."""
    eights, fours, ones = _lanes(data)
    size = end - start
    out = size.astype(np.uint64) + _P5 + np.uint64(seed)
    place = start.copy()
    for lane in range(3):
        at = np.flatnonzero((size >= 8 * lane + 8) & (size < 32))
        step = _turned(eights[place[at]] * _P2, 31) * _P1
        out[at] = _turned(out[at] ^ step, 27) * _P1 + _P4
        place[at] += 8
    at = np.flatnonzero(((size & 7) >= 4) & (size < 32))
    out[at] = _turned(out[at] ^ (fours[place[at]].astype(np.uint64) * _P1), 23) * _P2 + _P3
    place[at] += 4
    for byte in range(3):
        at = np.flatnonzero(((size & 3) > byte) & (size < 32))
        out[at] = _turned(out[at] ^ (ones[place[at]].astype(np.uint64) * _P5), 11) * _P1
        place[at] += 1
    out = (out ^ (out >> np.uint64(33))) * _P2
    out = (out ^ (out >> np.uint64(29))) * _P3
    out ^= out >> np.uint64(32)
    wide = np.flatnonzero(size >= 32)  # these go through four accumulators: left to the library
    raw = data.tobytes() if len(wide) else b""
    out[wide] = [xxhash.xxh64_intdigest(raw[a:b], seed) for a, b in zip(start[wide].tolist(), end[wide].tolist())]
    return out


def equal_ranges(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes from ``a`` on and from ``b`` on are the same, element by element."""
    eights, _, _ = _lanes(data)
    same = np.ones(len(a), bool)
    going, done = np.flatnonzero((a != b) & (size < LONG)), 0
    while len(going):
        unused = np.uint64(8) * np.maximum(0, 8 - (size[going] - done)).astype(np.uint64)
        same[going] = ((eights[a[going] + done] ^ eights[b[going] + done]) << unused) == 0
        done += 8
        going = going[same[going] & (size[going] > done)]
    for i in np.flatnonzero((a != b) & (size >= LONG)).tolist():
        same[i] = np.array_equal(data[a[i] : a[i] + size[i]], data[b[i] : b[i] + size[i]])
    return same


class GramTable:
    """The distinct ranges of a block, in an open-addressed table with linear probing.

    ``slot`` is the place of each occurrence; ``bucket`` and ``count`` belong to the places. Keys are
    XXH64 values, and an occurrence joins a place only if its bytes equal those that opened it.
    """

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, buckets: int):
        size, key = end - start, xxh64(data, start, end, 0)
        places = 1 << (2 * len(start) + 2).bit_length()
        opened_by = np.full(places, -1)
        self.slot = (key & np.uint64(places - 1)).astype(np.int64)
        going = np.arange(len(start))
        while len(going):
            place = self.slot[going]
            free = opened_by[place] < 0
            opened_by[place[free]] = going[free]  # of several that find a place free, the last one opens it
            other = opened_by[place]
            same = (key[other] == key[going]) & (size[other] == size[going])
            check = np.flatnonzero(same)
            same[check] = equal_ranges(data, start[other[check]], start[going[check]], size[going[check]])
            going = going[~same]
            self.slot[going] = (self.slot[going] + 1) & (places - 1)
        self.used = np.flatnonzero(opened_by >= 0)
        first = opened_by[self.used]
        raw = data.tobytes()
        self.bucket = np.zeros(places, np.int64)
        self.bucket[self.used] = [zlib.crc32(raw[a:b]) % buckets for a, b in zip(start[first].tolist(), end[first].tolist())]
        self.count = np.bincount(self.slot, minlength=places)
