"""Quality rules as a short-circuit cascade.

Every rule names the measures it needs and gives, from those, whether a document fails. On a
bounded sample (``SAMPLE_ROWS`` rows, picked by hash) each rule's time per document and the share
of documents it rejects are measured; rules then run in descending order of rejection per cost, and
a document that one rule rejects is never seen by the next. The order changes the time, never the
verdict, so reruns agree although times vary. Lines and windows that seem equal by hash are compared
byte by byte.

``base_statistics`` are returned for every document and are computed in one vectorised pass; the
rules use them where they can and compute what else they need only for the documents still alive.

A null text has no words and fails. Repeated rows, null ids and an empty table need no care: each
row is judged for itself. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import chunks, text_bytes
from .hashing import Hashed, Powers, group_of, mix, sorted_in_groups, word_ranges

SAMPLE_ROWS = 2000
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


class Texts:
    """Some texts and, computed when first asked for, measures of each."""

    def __init__(self, data: np.ndarray, at: np.ndarray, powers: Powers):
        self.data, self.at, self.powers = data, at, powers
        self.rows = len(at) - 1
        self._known: dict[str, np.ndarray] = {}

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self._known:
            self._known[name] = getattr(self, f"_{name}")()
        return self._known[name]

    def only(self, alive: np.ndarray) -> "Texts":
        """The texts that are still alive, with what is known of them."""
        size = np.diff(self.at)[alive]
        at = np.concatenate([[0], np.cumsum(size)])
        data = self.data[np.repeat(alive, np.diff(self.at))]
        part = Texts(data, at, self.powers)
        part._known = {k: v[alive] for k, v in self._known.items()}
        return part

    def _words(self):
        if not hasattr(self, "_ranges"):
            self._ranges = word_ranges(self.data, self.at)
        return self._ranges

    def _hashes(self) -> Hashed:
        if not hasattr(self, "_hashed"):
            self._hashed = Hashed(self.data, self.powers)
        return self._hashed

    def _sum(self, flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.at[1:]] - total[self.at[:-1]]

    def _n_words(self) -> np.ndarray:
        return np.diff(self._words()[2])

    def _word_chars(self) -> np.ndarray:
        starts, ends, at = self._words()
        points = np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80, dtype=np.int64)])
        sizes = np.concatenate([[0], np.cumsum(points[ends] - points[starts])])
        return sizes[at[1:]] - sizes[at[:-1]]

    def _n_symbols(self) -> np.ndarray:
        return self._sum(_SYMBOL[self.data])

    def _n_upper(self) -> np.ndarray:
        return self._sum(_UPPER[self.data])

    def _n_letters(self) -> np.ndarray:
        """Letters of ASCII and everything beyond it, in code points."""
        low = self.data | 0x20
        return self._sum(((low >= 97) & (low <= 122) & (self.data < 128)) | ((self.data & 0xC0) == 0xC0))

    def _lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text of every line that has a word."""
        breaks = np.flatnonzero(self.data == 10)
        starts = np.sort(np.concatenate([self.at[:-1], breaks + 1]), kind="stable")
        owner_of_break = np.searchsorted(self.at, breaks, "right") - 1
        owner = np.sort(np.concatenate([np.arange(self.rows), owner_of_break]), kind="stable")
        ends = np.sort(np.concatenate([self.at[1:], breaks]), kind="stable")
        words = self._words()[0]
        filled = np.searchsorted(words, starts) < np.searchsorted(words, ends)
        return starts[filled], ends[filled], owner[filled]

    def _n_lines(self) -> np.ndarray:
        return np.bincount(self._lines()[2], minlength=self.rows).astype(np.int64)

    def _n_dup_lines(self) -> np.ndarray:
        starts, ends, owner = self._lines()
        at = np.searchsorted(owner, np.arange(self.rows + 1))
        hashed = self._hashes().ranges(starts, ends)
        same = _repeats(hashed, at)
        for i in np.unique(owner[same]).tolist():  # texts that seem to repeat a line
            part = np.arange(at[i], at[i + 1])
            part = part[np.isin(hashed[part], hashed[part][same[part]])]
            seen: set[bytes] = set()
            for k, line in zip(part.tolist(), self._bytes(starts[part], ends[part])):
                same[k] = line in seen
                seen.add(line)
        return np.bincount(owner[same], minlength=self.rows).astype(np.int64)

    def _bytes(self, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
        return [self.data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())]

    def _n_repeat_words(self) -> np.ndarray:
        starts, ends, at = self._words()
        word = self._hashes().ranges(starts, ends)
        count = len(word) - WINDOW + 1
        if count < 1:
            return np.zeros(self.rows, np.int64)
        key = np.zeros(count, np.uint64)
        for k in range(WINDOW):
            key = mix(key) + word[k : k + count]
        owner = group_of(at)
        inside = owner[:count] == owner[WINDOW - 1 :]
        window, key, owner_of = np.flatnonzero(inside), key[inside], owner[:count][inside]
        window_at = np.searchsorted(owner_of, np.arange(self.rows + 1))
        ordered = sorted_in_groups(key.copy(), window_at)
        twice = np.zeros(len(key), bool)
        twice[1:] = ordered[1:] == ordered[:-1]
        twice[window_at[:-1][window_at[:-1] < len(key)]] = False
        cover = np.zeros(len(word) + 1, np.int64)
        for i in np.unique(owner_of[twice]).tolist():  # texts that repeat a window at all
            part = slice(window_at[i], window_at[i + 1])
            found = np.flatnonzero(np.isin(key[part], ordered[part][twice[part]]))
            first = window[part][found]
            windows = [tuple(self._bytes(starts[w : w + WINDOW], ends[w : w + WINDOW])) for w in first.tolist()]
            times = Counter(windows)
            found = found[np.fromiter((times[w] > 1 for w in windows), bool, len(windows))]
            np.add.at(cover, window[part][found], 1)
            np.add.at(cover, window[part][found] + WINDOW, -1)
        covered = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
        return covered[at[1:]] - covered[at[:-1]]


def _repeats(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """True for each value that occurs earlier in its group."""
    order = np.lexsort((np.arange(len(values)), values, group_of(at)))
    same = np.zeros(len(values), bool)
    owner = group_of(at)[order]
    same[order[1:]] = (values[order][1:] == values[order][:-1]) & (owner[1:] == owner[:-1])
    return same


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Callable[[Texts], np.ndarray]


# Limits are integers on both sides of a comparison, so SQL can state the same verdict.
RULES: tuple[Rule, ...] = (
    Rule("symbols", lambda t: 100 * t["n_symbols"] > 10 * t["word_chars"]),
    Rule("word_length", lambda t: (t["word_chars"] < 2 * t["n_words"]) | (t["word_chars"] > 25 * t["n_words"])),
    Rule("repeated_lines", lambda t: 2 * t["n_dup_lines"] > t["n_lines"]),
    Rule("capitals", lambda t: 10 * t["n_upper"] > 6 * t["n_letters"]),
    Rule("letters", lambda t: 2 * t["n_letters"] < t["word_chars"]),
)

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Measured:
    name: str
    seconds_per_row: float
    rejected: float

    @property
    def value(self) -> float:
        return self.rejected / max(self.seconds_per_row, 1e-9)


def measure(docs: DataFrame, rules: Sequence[Rule] = RULES, rows: int = SAMPLE_ROWS) -> list[Measured]:
    """Cost and rejection rate of every rule on the sample, in the order in which they should run."""
    total = docs.count()
    share = min(1.0, rows / max(total, 1))
    picked = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, found = Powers(), {rule.name: [0.0, 0, 0] for rule in rules}
        for batch in batches:
            for part in chunks(batch, "text"):
                for rule in rules:
                    texts = Texts(*text_bytes(part.column("text")), powers)  # nothing shared: each rule pays for itself
                    start = time.perf_counter()
                    bad = rule.fails(texts)
                    entry = found[rule.name]
                    entry[0] += time.perf_counter() - start
                    entry[1] += texts.rows
                    entry[2] += int(bad.sum())
        names = list(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), *(pa.array([float(found[n][k]) for n in names]) for k in range(3))],
            names=["name", "seconds", "rows", "bad"],
        )

    sums = picked.mapInArrow(run, "name string, seconds double, rows double, bad double").groupBy("name")
    found = sums.agg(F.sum("seconds"), F.sum("rows"), F.sum("bad")).collect()  # one row per rule
    measured = [Measured(n, s / max(r, 1.0), b / max(r, 1.0)) for n, s, r, b in found]
    place = {rule.name: k for k, rule in enumerate(rules)}
    return sorted(measured, key=lambda m: (-m.value, place[m.name]))


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id``, the base statistics, ``base_failed``, ``kept`` and ``rejected_by`` (the first rule that fails)."""
    by_name = {rule.name: rule for rule in rules}
    measured = [m.name for m in measure(docs, rules, sample_rows)]
    order = [by_name[n] for n in measured] + [r for r in rules if r.name not in measured]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for part in chunks(batch, "text"):
                texts = Texts(*text_bytes(part.column("text")), powers)
                base = [texts[name] for name in BASE]
                failed = (texts["n_words"] < MIN_WORDS) | (100 * texts["n_repeat_words"] > MAX_REPEATED_PERCENT * texts["n_words"])
                reason = np.full(texts.rows, None, object)
                reason[failed] = "base"
                alive = np.flatnonzero(~failed)
                left = texts.only(~failed)
                for rule in order:
                    if not len(alive):
                        break
                    bad = rule.fails(left)
                    reason[alive[bad]] = rule.name
                    if bad.any():
                        left, alive = left.only(~bad), alive[~bad]
                why = pa.array(reason.tolist(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(b, pa.int64()) for b in base), pa.array(failed), why.is_null(), why],
                    names=["doc_id", *BASE, "base_failed", "kept", "rejected_by"],
                )

    kinds = ", ".join(f"{name} long" for name in BASE)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, f"doc_id long, {kinds}, base_failed boolean, kept boolean, rejected_by string"
    )
