"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over all terms of the examples.

Examples are a bounded sample of the labelled rows (``EXAMPLES``, picked by hash). Terms are words
and word beginnings, and the vocabulary holds every term of an example. Document frequencies for
IDF are counted over all documents. Terms of a query that no example has are left out of its vector, as
they are no terms of the vocabulary.

The index is inverted and block-max. Examples with equal vectors are one row; rows are ordered by their
number of terms and cut into shards of at most ``SHARD_NUMBERS`` postings, and a shard is unpacked, searched and
dropped (or kept, up to ``KEPT_NUMBERS``) for a batch of queries. The postings of most terms are read for every query that has them. Those of terms that
many rows share are blocks of ``BLOCK`` rows with the largest weight of each term: blocks and rows whose
bound (the largest weights, or the length of both vectors in these terms) cannot reach the k-th cosine found
so far are skipped. Sums in single precision come with a bound on their error; whatever could be among the nearest
within it is computed again in double precision, so the neighbours are exact. The k nearest of all shards are merged.

A row of ``documents`` is tokenised once: its words, as numbers of the vocabulary, are written and serve document
frequencies, example vectors and queries. Neighbours vote with a weight that falls with their distance; votes are
calibrated by a logistic curve fitted on the examples, each without its own vote. Neighbours are the evidence.

A text without any term of the vocabulary (an empty or null one too) has no neighbour; its vote is
the rate among the examples that have none either, or among all if there are none. The score is a function of the text alone:
repeated texts score equally. Labels that are null are left out; a doc labelled twice counts as
toxic if one label says so. Without labels every score is 0. Long texts are scored whole.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import chunks, discard, keep
from .hidden_markov import remainder

EXAMPLES = 20_000
NEIGHBOURS = 15
SHARED = 0.08  # terms that so many rows have keep their postings in blocks
BLOCK = 32  # rows
OPENED = 32  # rows, the most promising first, between two looks at the k-th cosine
WIDE = 1 / 16  # queries that have to open more of the rows are multiplied with all blocks together
SHARD_NUMBERS = 12_000_000  # postings in a shard
KEPT_NUMBERS = 12_000_000  # postings in the unpacked shards that a worker keeps
PIECE = 1 << 18  # postings unpacked at once
STEP = 1 << 15  # postings added up at once
PROBES = 16  # queries
QUERIES = 128  # in one step
PREFIXES = (4, 5)
POSTING = np.dtype([("row", np.int32), ("weight", np.float32)])
WORDS = re.compile(r"[^\W\d_]+")


def terms_of(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


def _words(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def _picked(labels: DataFrame, limit: int) -> DataFrame:
    """``doc_id, toxic``: at most about ``limit`` labelled documents that may be learned from."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(remainder(F.col("doc_id"), 5) != 0)
    share = min(1.0, limit / max(known.count(), 1))
    picked = known.withColumn("doc_id", F.col("doc_id").cast("long"))
    return picked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)


def examples(docs: DataFrame, labels: DataFrame, limit: int = EXAMPLES) -> DataFrame:
    """``doc_id, text, toxic`` of the labelled rows that may be learned from."""
    return docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(_picked(labels, limit)), "doc_id")  # ids and labels of ``limit`` rows


def _vocabulary(rows: DataFrame) -> list[str]:
    """All terms of the examples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[str] = set()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found.update(t for w in set(_words(text)) for t in terms_of(w))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string())], names=["term"])

    terms = rows.select("text").mapInArrow(run, "term string").distinct().toArrow()  # of at most about ``limit`` texts
    return sorted(terms.column("term").to_pylist())


class _Numbers(dict):
    """The vocabulary's numbers; a word it lacks has that of its longest term there, or -1. The shorter terms follow from it."""

    def __init__(self, vocabulary: list[str]):
        super().__init__(zip(vocabulary, range(len(vocabulary))))
        self._others: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        found = self._others.get(word)
        if found is None:
            if len(self._others) > 100_000:
                self._others.clear()
            found = next((self[t] for t in reversed(terms_of(word)[1:]) if t in self), -1)
            self._others[word] = found
        return found


def _shared_numbers(names) -> _Numbers:
    """The broadcast vocabulary, unpacked once per worker."""
    value = names.value
    if "numbers" not in value:
        words = zlib.decompress(value.pop("words")).decode()
        value["numbers"] = _Numbers(words.split("\n") if words else [])
    return value["numbers"]


def _shorter(vocabulary: list[str]) -> np.ndarray:
    """For each term the numbers of the shorter terms that come with it, -1 where there is none."""
    numbers = {t: k for k, t in enumerate(vocabulary)}
    result = np.full((len(PREFIXES), len(vocabulary)), -1, np.int32)
    for k, term in enumerate(vocabulary):
        word, least = (term[:-1], 0) if term.endswith("*") else (term, 1)
        for i, n in enumerate(PREFIXES):
            if len(word) >= n + least and f"{word[:n]}*" != term:
                result[i, k] = numbers.get(f"{word[:n]}*", -1)
    return result


def _grouped(owner: np.ndarray, terms: np.ndarray, times: np.ndarray, rows: int, distinct: int):
    """Where each row's terms begin, its distinct terms in order, and how often they occur."""
    key = owner.astype(np.int64) * max(distinct, 1) + terms
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    sums = np.add.reduceat(times[order], first) if len(first) else times[:0]
    key = key[first]
    owner = key // max(distinct, 1)
    return np.searchsorted(owner, np.arange(rows + 1)), (key - owner * max(distinct, 1)).astype(np.int32), sums.astype(np.int32)


def _keys(texts: list[str | None], numbers: _Numbers, distinct: int):
    """Longest known terms of every text, see ``_grouped``."""
    found = [list(map(numbers.__getitem__, _words(t))) for t in texts]
    owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
    flat = np.fromiter(chain.from_iterable(found), np.int64, len(owner))
    owner, flat = owner[flat >= 0], flat[flat >= 0]
    return _grouped(owner, flat, np.ones(len(flat), np.int32), len(found), distinct)


def _all_terms(at: np.ndarray, keys: np.ndarray, times: np.ndarray, shorter: np.ndarray):
    """The longest terms together with all shorter ones, see ``_grouped``."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    terms = np.concatenate([keys, *(s[keys] for s in shorter)])
    known, times = terms >= 0, np.tile(times, len(shorter) + 1)
    return _grouped(np.tile(owner, len(shorter) + 1)[known], terms[known], times[known], len(at) - 1, shorter.shape[1])


def _lists(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _batch_terms(batch: pa.RecordBatch, shorter: np.ndarray):
    size = batch.column("keys").value_lengths().to_numpy(zero_copy_only=False)
    return _all_terms(np.concatenate([[0], np.cumsum(size)]), _lists(batch.column("keys")), _lists(batch.column("times")), shorter)


def _frequencies(vectors: DataFrame, shorter) -> tuple[np.ndarray, int]:
    """In how many of all documents each term occurs, and how many documents there are."""
    distinct = shorter.value.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows = np.zeros(distinct + 1, np.int64), 0
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                found[:-1] += np.bincount(_batch_terms(part, shorter.value)[1], minlength=distinct)
                rows += part.num_rows
        found[-1] = rows
        seen = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(found[seen])], names=["term", "n"])

    counts = vectors.select("keys", "times").mapInArrow(run, "term long, n long")
    sums = counts.groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row per term of the vocabulary
    result = np.zeros(distinct + 1, np.int64)
    result[sums.column("term").to_numpy()] = sums.column("n").to_numpy()
    return result[:-1], int(result[-1])


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``start``, ``start + 1``, ... of every range, one range behind the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class Shard:
    """Rows ``low``, ``low + 1``, ... by term: postings, and blocks with largest weights for ``shared`` terms."""

    def __init__(self, low: int, rows: int, counts: np.ndarray, shared: int):
        """``counts``: how many postings each term will have; rows are then given in order to ``add``, and ``close`` ends that."""
        self.low, self.rows = low, rows
        self.at = np.concatenate([[0], np.cumsum(counts)])
        self.postings = np.empty(int(self.at[-1]), POSTING)
        self.dense = np.zeros((-(-rows // BLOCK) * BLOCK, shared), np.float32)  # whole blocks
        self.opened = 0  # rows whose shared terms were read
        self._next = self.at[:-1].copy()

    def add(self, owner: np.ndarray, terms: np.ndarray, weights: np.ndarray, place: np.ndarray) -> None:
        heads = place[terms]
        inside = heads >= 0
        self.dense[owner[inside], heads[inside]] = weights[inside]
        rest = np.flatnonzero(~inside)
        rest = rest[np.argsort(terms[rest], kind="stable")]
        sorted_terms = terms[rest]
        first = np.flatnonzero(np.diff(sorted_terms, prepend=-1))
        size = np.diff(np.append(first, len(rest)))
        own = sorted_terms[first]
        to = _ranges(self._next[own], size)
        self.postings["row"][to], self.postings["weight"][to] = owner[rest], weights[rest]
        self._next[own] += size

    def close(self) -> Shard:
        del self._next
        self.postings = self.postings.view(np.int64)  # copied faster than pairs
        blocks = self.dense.reshape(-1, BLOCK, self.dense.shape[1])
        self.largest = blocks.max(axis=1)
        self.length = np.sqrt(np.einsum("ijk,ijk->ij", blocks, blocks, dtype=np.float64))
        return self

    def rest(self, numbers: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Sums of all terms but the shared ones, by row."""
        start, end = self.at[numbers], self.at[numbers + 1]
        some = np.flatnonzero(end > start)
        if not len(some):
            return np.zeros(len(self.dense))
        start, size, factors = start[some], (end - start)[some], weights[some].astype(np.float32)
        pairs, edges = list(zip(start.tolist(), end[some].tolist())), np.cumsum(size)
        result, low = np.zeros(len(self.dense)), 0
        while low < len(pairs):  # a step's arrays stay in the cache
            high = max(low + 1, int(np.searchsorted(edges, edges[low] - size[low] + STEP, "right")))
            read = np.concatenate([self.postings[a:b] for a, b in pairs[low:high]]).view(POSTING)
            values = np.repeat(factors[low:high], size[low:high])
            values *= read["weight"]
            result += np.bincount(read["row"], values, len(result))
            low = high
        return result

    def search(self, score: np.ndarray, head, bounds, wanted: int, floor: float, error: float):
        """Rows opened and their cosines, and what the last of the nearest rows reaches; no rows (None) if too many have to be opened.

        ``score``: sums without shared terms.
        """
        blocks = np.minimum(self.length * math.sqrt(float(head @ head)), bounds[:, None])
        bound = score + blocks.ravel()
        size = min(OPENED, len(bound))
        top = np.argpartition(bound, len(bound) - size)[len(bound) - size :]
        found, cosines = top, score[top] + self.dense[top] @ head
        floor = max(floor, _least(cosines, wanted) - 2 * error)
        bound[top] = 0.0
        more = np.flatnonzero((bound > 0) & (bound + error >= floor))
        if len(more) > WIDE * self.rows:
            return None, None, floor
        more = more[np.argsort(-bound[more])]
        for k in range(0, len(more), OPENED):
            part = more[k : k + OPENED]
            if bound[part[0]] + error < floor:
                break
            found, cosines = np.concatenate([found, part]), np.concatenate([cosines, score[part] + self.dense[part] @ head])
            floor = max(floor, _least(cosines, wanted) - 2 * error)
        self.opened += len(found)
        return (*self._near(found, cosines, floor), floor)

    def _near(self, rows: np.ndarray, cosines: np.ndarray, floor: float):
        near = (cosines > 0) & (cosines >= floor)
        return rows[near] + self.low, cosines[near]

    def search_all(self, vectors, heads: np.ndarray, floors: list[float], error: float):
        """For each query: rows, their cosines up to ``error``, and a bound that the last of its nearest rows reach.

        Every row that can be among the ``wanted`` nearest of a query above its floor is given out. Where the first
        ``PROBES`` queries all have to open too many rows, the others are not tried.
        """
        bounds, result, wide, narrow = heads @ self.largest.T, [], [], False
        sums = np.zeros((len(vectors), len(self.dense)), np.float32)
        for i, (numbers, weights, wanted) in enumerate(vectors):
            result.append((np.zeros(0, np.int64), np.zeros(0), floors[i]))
            if len(numbers):
                score = self.rest(numbers, weights)
                if narrow or len(wide) < PROBES:
                    result[i] = self.search(score, heads[i], bounds[i], wanted, floors[i], error)
                    if result[i][0] is not None:
                        narrow = True
                        continue
                sums[len(wide)] = score
                wide.append(i)
        if wide:
            sums = sums[: len(wide)]
            sums += heads[wide] @ self.dense.T
            for i, cosines in zip(wide, sums):
                self.opened += self.rows
                floor = max(result[i][2], _least(cosines, vectors[i][2]) - 2 * error)
                result[i] = (*self._near(*self._above(cosines, floor), floor), floor)
        return result

    @staticmethod
    def _above(cosines: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
        rows = np.flatnonzero(cosines >= np.float32(floor) - np.float32(1e-6))
        return rows, cosines[rows].astype(np.float64)


def _least(values: np.ndarray, wanted: int) -> float:
    """The ``wanted``-th largest value, or 0 where there are fewer."""
    return float(np.partition(values, len(values) - wanted)[len(values) - wanted]) if len(values) >= wanted else 0.0


class Index:
    """Vectors of the examples by row, and by term in shards."""

    def __init__(self, idf: np.ndarray, ids, toxic, vectors):
        """``vectors``: where each example's terms begin, and all terms and how often they occur."""
        self.idf = idf
        ids, toxic = np.array(ids, np.int64), np.array(toxic, float)
        at, terms, times = vectors
        size = np.diff(at)
        without = toxic[size == 0]
        self.without = (without.sum() + toxic.mean()) / (len(without) + 1.0) if len(toxic) else 0.0
        groups: dict[bytes, list[int]] = {}
        for k in np.flatnonzero(size).tolist():
            a, b = at[k], at[k + 1]
            groups.setdefault(hashlib.sha256(terms[a:b].tobytes() + times[a:b].tobytes()).digest(), []).append(k)
        # rows of like length have like weights, so the largest of a block says much about all of it
        members = sorted((sorted(g, key=lambda k: ids[k]) for g in groups.values()), key=lambda g: size[g[0]])
        groups.clear()
        places = np.array([k for g in members for k in g], np.int64)
        self.ids, self.toxic = ids[places], toxic[places]
        self.first = np.cumsum([0, *map(len, members)])
        one = np.array([g[0] for g in members], np.int64)
        self.rows = len(one)
        self.at = np.concatenate([[0], np.cumsum(size[one])]).astype(np.int64)
        self.given, self.terms, self.times = at, terms, times  # in the order given
        self.begin, self.end = at[one], at[one + 1]
        count = np.zeros(len(idf), np.int64)
        for low, high in self._pieces(0, self.rows):
            count += np.bincount(terms[self._places(low, high)], minlength=len(idf))
        shared = np.flatnonzero(count > SHARED * self.rows)
        self.shared = len(shared)
        self.place = np.full(len(idf), -1, np.int32)
        self.place[shared] = np.arange(len(shared))
        # single precision: every factor and every partial sum is rounded, and a cosine is 1 at most
        self.error = (self.shared + 8) * 2.0**-23
        self.norms = np.ones(self.rows)
        self._logs = 1.0 + np.log(np.arange(1, int(times.max(initial=0)) + 1)) if int(times.max(initial=0)) < 1 << 16 else None
        self._asked, self._weights = np.zeros(len(idf), bool), np.zeros(len(idf))  # of the query that is compared
        self._kept: dict[int, Shard] = {}

    def _pieces(self, low: int, high: int) -> Iterator[tuple[int, int]]:
        """The rows in pieces of about ``PIECE`` postings."""
        while low < high:
            end = min(high, max(low + 1, int(np.searchsorted(self.at, self.at[low] + PIECE, "right")) - 1))
            yield low, end
            low = end

    def _places(self, low: int, high: int) -> np.ndarray:
        """Where the terms of the rows lie."""
        return _ranges(self.begin[low:high], self.end[low:high] - self.begin[low:high])

    def _factors(self, places: np.ndarray) -> np.ndarray:
        times = self.times[places]
        logs = 1.0 + np.log(times, dtype=np.float64) if self._logs is None else self._logs[times.astype(np.intp) - 1]
        return logs * self.idf[self.terms[places]]

    def _shard(self, low: int, high: int) -> Shard:
        counts = np.zeros(len(self.idf), np.int64)
        for a, b in self._pieces(low, high):
            counts += np.bincount(self.terms[self._places(a, b)], minlength=len(counts))
        counts[self.place >= 0] = 0
        shard = Shard(low, high - low, counts, self.shared)
        for a, b in self._pieces(low, high):
            places, size = self._places(a, b), np.diff(self.at[a : b + 1])
            exact = self._factors(places)
            self.norms[a:b] = np.sqrt(np.add.reduceat(exact * exact, self.at[a:b] - self.at[a]))
            exact /= np.repeat(self.norms[a:b], size)
            shard.add(np.repeat(np.arange(a - low, b - low, dtype=np.int32), size), self.terms[places], exact.astype(np.float32), self.place)
        return shard.close()

    def shards(self) -> Iterator[Shard]:
        low = 0
        while low < self.rows:
            high = max(low + 1, int(np.searchsorted(self.at, self.at[low] + SHARD_NUMBERS, "right")) - 1)
            shard = self._kept.get(low)
            if shard is None:
                shard = self._shard(low, high)
                if self.at[high] <= KEPT_NUMBERS:
                    self._kept[low] = shard
            yield shard
            low = high

    def _cosines(self, numbers: np.ndarray, weights: np.ndarray, rows: np.ndarray) -> list[float]:
        """In double precision, to nine places."""
        if not len(rows):
            return []
        begin, end = self.begin[rows], self.end[rows]
        edges = np.cumsum(end - begin)
        self._asked[numbers], self._weights[numbers] = True, weights
        terms = np.concatenate([self.terms[a:b] for a, b in zip(begin.tolist(), end.tolist())])
        both = np.flatnonzero(self._asked[terms])
        owner = np.searchsorted(edges, both, "right")
        products = self._weights[terms[both]] * self._factors(both + (end - edges)[owner])
        self._asked[numbers] = False
        sums = np.bincount(owner, products, len(rows))
        return [round(x, 9) for x in (sums / self.norms[rows]).tolist()]

    def nearest_all(self, queries, k: int = NEIGHBOURS, leave: list[int] | None = None) -> list[list[tuple[float, int]]]:
        """For each query the k nearest examples as (cosine, place), nearest first; ties go to the smaller id.

        ``queries``: where each query's terms begin, and all terms and how often they occur.
        """
        at, terms, times = queries
        vectors, found = [], []
        heads = np.zeros((len(at) - 1, self.shared), np.float32)
        for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
            numbers = terms[a:b].astype(np.int32)
            weights = (1.0 + np.log(times[a:b])) * self.idf[numbers]
            weights = weights / math.sqrt(float(weights @ weights)) if b > a else weights
            place = self.place[numbers]
            heads[i, place[place >= 0]] = weights[place >= 0]
            wanted = k + (int((self.ids == leave[i]).sum()) if leave is not None else 0)
            vectors.append((numbers, weights, wanted))
            found.append(([], [], 0.0))
        for shard in self.shards() if len(terms) else ():
            for i, new in enumerate(shard.search_all(vectors, heads, [f[2] for f in found], self.error)):
                found[i] = ([*found[i][0], new[0]], [*found[i][1], new[1]], new[2])
        result = []
        for i, (numbers, weights, wanted) in enumerate(vectors):
            near = []
            if found[i][0]:
                rows, cosines = np.concatenate(found[i][0]), np.concatenate(found[i][1])
                rows = rows[cosines >= _least(cosines, wanted) - 2 * self.error]
                for row, cosine in zip(rows.tolist(), self._cosines(numbers, weights, rows)):
                    for r in range(self.first[row], min(self.first[row] + wanted, self.first[row + 1])):
                        if cosine > 0 and (leave is None or self.ids[r] != leave[i]):
                            near.append((-cosine, int(self.ids[r]), r))
            result.append([(-c, r) for c, _, r in sorted(near)[:k]])
        return result

    def nearest(self, counts: dict[int, int], k: int = NEIGHBOURS, leave: int | None = None) -> list[tuple[float, int]]:
        return self.nearest_all(_flat([counts]), k, None if leave is None else [leave])[0]

    def vote(self, near: list[tuple[float, int]]) -> float:
        if not near:
            return self.without
        weights = [1.0 / (1.1 - min(c, 1.0)) for c, _ in near]
        toxic = sum(w * self.toxic[r] for w, (_, r) in zip(weights, near))
        return (toxic + 0.5 * self.without) / (sum(weights) + 0.5)


def _flat(counts: list[dict[int, int]]):
    items = [sorted(c.items()) for c in counts]
    pairs = np.array([p for i in items for p in i], np.int64).reshape(-1, 2)
    return np.cumsum([0, *map(len, items)]), pairs[:, 0], pairs[:, 1]


def _logit(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _calibrated(votes: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve, by Newton steps with a little ridge."""
    x = np.stack([_logit(votes), np.ones(len(votes))], axis=1)
    beta, prior = np.array([1.0, 0.0]), np.array([1.0, 0.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-(x @ beta)))
        grad = x.T @ (toxic - p) - 0.5 * (beta - prior)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(2)
        beta = beta + np.linalg.solve(hessian, grad)
    return (float(beta[0]), float(beta[1])) if np.isfinite(beta).all() and beta[0] > 0 else (1.0, 0.0)


def _packed(values: np.ndarray) -> bytes:
    """Differences of the values, compressed by place of their bytes: broadcasts lie on every executor's disk."""
    gaps = np.diff(values.astype(np.int32), prepend=np.int32(0)).astype("<i4")
    return zlib.compress(gaps.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    gaps = np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T).view("<i4")
    return np.cumsum(gaps.ravel(), dtype=np.int32)


def _vectors(docs: DataFrame, names, columns: list[str]) -> DataFrame:
    """``row`` (the given columns), ``id``, ``key`` and a text's longest known terms with their counts."""
    row = F.struct(*[F.col(f"`{c}`") for c in columns]) if columns else F.lit(None).cast("struct<doc_id:long>")
    own = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("key"), "text")
    within = "text" in columns  # then it need not travel twice
    own = own.drop("text") if within else own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _shared_numbers(names)
        for batch in batches:
            if within:
                batch = batch.append_column("text", batch.column("row").field("text"))
            for part in chunks(batch, "text"):
                at, keys, times = _keys(part.column("text").to_pylist(), numbers, len(numbers))
                at = pa.array(at, pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(x, pa.int32())) for x in (keys, times)]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in ("row", "id", "key")] + lists, names=["row", "id", "key", "keys", "times"])

    return own.mapInArrow(run, f"row {own.schema['row'].dataType.simpleString()}, id long, key long, keys array<int>, times array<int>")


def _known(docs: DataFrame, labels: DataFrame, limit: int):
    """The examples' vocabulary, and the same for the workers."""
    vocabulary = _vocabulary(examples(docs, labels, limit))
    return vocabulary, _broadcast_names(docs.sparkSession, vocabulary)


def _broadcast_names(spark: SparkSession, vocabulary: list[str]):
    """Bounded by the examples; compressed, since broadcasts lie on every executor's disk."""
    return spark.sparkContext.broadcast({"words": zlib.compress("\n".join(vocabulary).encode(), 1)})


def _fitted(vectors: DataFrame, labels: DataFrame, vocabulary: list[str], limit: int):
    """The model, and what the workers need of it."""
    spark = vectors.sparkSession
    shorter = _shorter(vocabulary)
    shared = spark.sparkContext.broadcast(shorter)
    frequency, total = _frequencies(vectors, shared)
    idf = np.log(1.0 + total / np.maximum(frequency, 1))
    picked = vectors.select("id", "key", "keys", "times").join(F.broadcast(_picked(labels, limit).withColumnRenamed("doc_id", "id")), "id")
    found = picked.toArrow().sort_by([("id", "ascending"), ("key", "ascending")]).combine_chunks()  # at most about ``limit`` rows
    ids, toxic = found.column("id").to_numpy(), (found.column("toxic").to_numpy() > 0).astype(int)
    flat = [found.column(c).combine_chunks() for c in ("keys", "times")]
    size = flat[0].value_lengths().to_numpy(zero_copy_only=False) if len(found) else np.zeros(0, np.int64)
    vectors_of = (np.concatenate([[0], np.cumsum(size)]), *(f.flatten().to_numpy() for f in flat))
    model = {"vocabulary": vocabulary, "shorter": shorter, "idf": idf, "ids": ids, "toxic": toxic, "curve": (1.0, 0.0)}
    model["counts"] = tuple(_packed(x) for x in vectors_of)
    del found, flat, vectors_of
    share = spark.sparkContext.broadcast(_for_tasks(model))  # bounded by the texts of EXAMPLES examples
    if len(ids):

        def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _shared_index(share)
            own_ids, at = share.value["ids"], index.given
            for batch in batches:
                everywhere = batch.column("id").to_numpy()
                for low in range(0, len(everywhere), QUERIES):
                    places = everywhere[low : low + QUERIES]
                    size = np.diff(at)[places]
                    own = _ranges(at[places], size)
                    queries = np.concatenate([[0], np.cumsum(size)]), index.terms[own], index.times[own]
                    votes = [index.vote(near) for near in index.nearest_all(queries, leave=own_ids[places].tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(votes, pa.float64())], names=["id", "vote"])

        votes = np.zeros(len(ids))
        for place, vote in spark.range(len(ids)).mapInArrow(alone, "id long, vote double").collect():
            votes[place] = vote
        model["curve"] = _calibrated(votes, np.array(toxic, float))
    shared.unpersist()
    return model, share


def fit(docs: DataFrame, labels: DataFrame, limit: int = EXAMPLES) -> dict:
    """What scoring needs: vocabulary, IDF, example vectors and the calibration; bounded by the texts of ``limit`` examples."""
    vocabulary, names = _known(docs, labels, limit)
    vectors = keep(_vectors(docs, names, []), "vectors")
    model, share = _fitted(vectors, labels, vocabulary, limit)
    share.unpersist()
    names.unpersist()
    discard(vectors)
    return model


def _for_tasks(model: dict) -> dict:
    return {k: v for k, v in model.items() if k not in ("vocabulary", "curve")}


def _index(model: dict) -> Index:
    if isinstance(model["counts"], tuple):
        at, keys, times = map(_unpacked, model["counts"])
        parts, low = [], 0
        while low < len(at) - 1:  # about half a million words at once
            high = max(low + 1, int(np.searchsorted(at, at[low] + (1 << 19), "right")) - 1)
            own = slice(at[low], at[high])
            part = _all_terms(at[low : high + 1] - at[low], keys[own], times[own], model["shorter"])
            parts.append((*part[:2], part[2].astype(np.min_scalar_type(int(part[2].max(initial=0))))))
            low = high
        del keys, times
        size = np.concatenate([np.zeros(1, np.int64), *(np.diff(a) for a, _, _ in parts)])
        flat = [np.concatenate([np.zeros(0, kind), *(p[k] for p in parts)]) for k, kind in ((1, np.int32), (2, np.uint8))]
        parts.clear()
        return Index(model["idf"], model["ids"], model["toxic"], (np.cumsum(size), *flat))
    return Index(model["idf"], model["ids"], model["toxic"], _flat(model["counts"]))


def _shared_index(share) -> Index:
    """The index of a broadcast model, built once per worker."""
    model = share.value
    if "index" not in model:
        model["index"] = _index(model)
        del model["counts"]  # of this worker
    return model["index"]


def _scored(vectors: DataFrame, share, curve: tuple[float, float]) -> DataFrame:
    """The columns in ``row``, ``toxicity`` and ``evidence``."""
    names = ("doc_id", "cosine", "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, (slope, offset) = _shared_index(share), curve
        for whole in batches:
            for low in range(0, whole.num_rows, QUERIES):
                batch = whole.slice(low, QUERIES)
                found = index.nearest_all(_batch_terms(batch, share.value["shorter"]))
                logits = [slope * float(_logit(index.vote(near))) + offset for near in found]
                scores = [1 / (1 + math.exp(-x)) if len(share.value["ids"]) else 0.0 for x in logits]
                rows = np.array([r for near in found for _, r in near], np.int64)
                cosines = pa.array([c for near in found for c, _ in near], pa.float64())
                values = [pa.array(index.ids[rows]), cosines, pa.array(index.toxic[rows].astype(np.int32))]
                edges = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                evidence = pa.ListArray.from_arrays(edges, pa.StructArray.from_arrays(values, names=names))
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(scores, pa.float64()), evidence], names=["row", "toxicity", "evidence"])

    kind = vectors.schema["row"].dataType
    out = vectors.select("row", "keys", "times").mapInArrow(
        run, f"row {kind.simpleString()}, toxicity double, evidence array<struct<doc_id:long,cosine:double,toxic:int>>"
    )
    return out.select(*[F.col("row").getField(f.name).alias(f.name) for f in kind.fields], "toxicity", "evidence")


def _plain(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c not in ("toxicity", "evidence")]


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """All columns of ``docs``, ``toxicity`` (0 to 1) and ``evidence`` (the nearest examples and their cosines)."""
    names = _broadcast_names(docs.sparkSession, model["vocabulary"])
    share = docs.sparkSession.sparkContext.broadcast(_for_tasks(model))  # bounded by the texts of EXAMPLES examples
    return _scored(_vectors(docs, names, _plain(docs)), share, model["curve"])


def fit_and_score(docs: DataFrame, labels: DataFrame, columns: list[str] | None = None, limit: int = EXAMPLES) -> DataFrame:
    """``scored(docs, fit(docs, labels))`` with the given columns of ``docs``, reading and tokenising each text once."""
    vocabulary, names = _known(docs, labels, limit)
    vectors = keep(_vectors(docs, names, _plain(docs) if columns is None else columns), "vectors")
    model, share = _fitted(vectors, labels, vocabulary, limit)
    names.unpersist()
    return _scored(vectors, share, model["curve"])


def held_out() -> Column:
    return remainder(F.col("doc_id"), 5) == 0
