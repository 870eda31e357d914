"""N-gram tables and importance resampling against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from lexcorpus.llm import ngrams, resampling

KIND = "doc_id long, text string, weight string, score string, rank int, n_words int, place string"
SHORT = "doc_id long, text string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def features(text, max_n):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    return words, [" ".join(words[i : i + n]) for n in range(1, max_n + 1) for i in range(len(words) - n + 1)]


def plain(rows, target, max_n, buckets, percent, min_words, seed=2024):
    place = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(place(f) for _, t in rows for f in features(t, max_n)[1])
    t = Counter(place(f) for x in target for f in features(x, max_n)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    out = []
    for doc, text in rows:
        words, found = features(text, max_n)
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(place(f)) for f in found)
        out.append([doc, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is not None, r[0]))
    for row in out:
        row.append(None)
    for i, row in enumerate(able[: len(able) * percent // 100]):
        row[5] = i + 1
    return sorted(map(tuple, out), key=str)


def corpus(seed, n):
    dice = random.Random(seed)
    vocabulary = ["law", "Court", "ÉTAT", "straße", "x1", "42", "a", "b"] + [f"w{i}" for i in range(60)]
    seps = [" ", "  ", ", ", "\n", "-", "\x00", "!?"]
    return [(i, "".join(dice.choice(vocabulary) + dice.choice(seps) for _ in range(dice.choice([0, 1, 3, 25, 80])))) for i in range(n)]


@pytest.mark.parametrize("max_n, block", [(1, 1 << 18), (3, 50)])
def test_ranks_equal_plain_python(spark, monkeypatch, max_n, block):
    monkeypatch.setattr(resampling, "BLOCK_GRAMS", block)
    rows = corpus(max_n, 150) + [(900, None), (901, ""), (None, "law court " * 30), (902, "-- ,, \n"), (903, "y" * 9000 + " law" * 40), (3, "law " * 25)]
    target = ["Law court state", None, "", "law LAW état straße"]
    docs = spark.createDataFrame([(d, t, "a", "b", 1, 2, "c") for d, t in rows], KIND).repartition(3)
    aims = spark.createDataFrame([(1, t) for t in target], "item_id long, text string")
    options = {"max_n": max_n, "buckets": 97, "percent": 30, "min_words": 20}
    got = resampling.resampling_ranks(docs, aims, **options)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    want = plain(rows, target, **options)
    assert sorted(map(tuple, got.collect()), key=str) == want
    drawn = {r[0] for r in want if r[5]}
    chosen = resampling.resample(docs, aims, **options).collect()
    assert {r.doc_id for r in chosen} == drawn and len(chosen) == sum(1 for r in want if r[5])
    texts = {d: {x for e, x in rows if e == d} for d in drawn}
    assert all(tuple(r)[2:] == ("a", "b", 1, 2, "c") and r.text in texts[r.doc_id] for r in chosen)


def test_empty_tables(spark):
    empty, some = spark.createDataFrame([], SHORT), spark.createDataFrame([(1, "a b c")], SHORT)
    assert resampling.resampling_ranks(empty, some).collect() == []
    assert resampling.resample(empty, some).collect() == []
    assert [r.rank for r in resampling.resampling_ranks(some, empty).collect()] == [None]
    assert resampling.resample(some, empty, min_words=1).collect() == []  # a tenth of one row is none
    assert [r.doc_id for r in resampling.resample(some, empty, min_words=1, percent=100).collect()] == [1]


def test_ties_and_repeated_rows(spark):
    rows = [(1, "a b c")] * 6 + [(2, "a b c")] * 4
    docs = spark.createDataFrame(rows, SHORT)
    got = resampling.resampling_ranks(docs, docs, min_words=1, percent=70).collect()
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 8))
    assert resampling.resample(docs, docs, min_words=1, percent=70).count() == 7


def packed(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])


def test_ngrams_of_joined_words():
    texts = ["One  two", "", "three", "\n", "É x\ty z", "a", "b"]
    joined, start, end, word_at = ngrams.joined_words(*packed(texts), ngrams.NOT_SPACE)
    raw = joined.tobytes()
    assert [raw[a:b].decode() for a, b in zip(start, end)] == ["one", "two", "three", "É", "x", "y", "z", "a", "b"]
    assert word_at.tolist() == [0, 2, 2, 3, 3, 7, 8, 9]
    low, high, at = ngrams.gram_ranges(start, end, word_at, 2)
    assert [raw[a:b].decode() for a, b in zip(low, high)] == ["one two", "É x", "x y", "y z"]
    assert at.tolist() == [0, 1, 1, 1, 1, 4, 4, 4]


def test_xxh64_equals_the_library():
    dice = np.random.default_rng(1)
    data = dice.integers(0, 256, 3000, dtype=np.uint8)
    start = dice.integers(0, 2900, 500)
    end = start + np.concatenate([np.arange(60), dice.integers(0, 100, 440)])
    raw = data.tobytes()
    for seed in (0, 42):
        assert ngrams.xxh64(data, start, end, seed).tolist() == [xxhash.xxh64_intdigest(raw[a:b], seed) for a, b in zip(start, end)]


def test_table_verifies_bytes_when_keys_collide(monkeypatch):
    words = ["ab", "ba", "ab", "abcdefghij", "abcdefghik", "abcdefghij", "x" * 5000, "x" * 4999 + "y", "x" * 5000, "ba"]
    joined, start, end, _ = ngrams.joined_words(*packed([" ".join(words)]), ngrams.NOT_SPACE)
    monkeypatch.setattr(ngrams, "xxh64", lambda data, start, end, seed: np.full(len(start), 5, np.uint64))
    table = ngrams.GramTable(joined, start, end, 1000)
    assert len(table.used) == len(set(words))
    assert len({(w, s) for w, s in zip(words, table.slot.tolist())}) == len(set(words))
    for word, slot in zip(words, table.slot.tolist()):
        assert table.bucket[slot] == zlib.crc32(word.encode()) % 1000 and table.count[slot] == words.count(word)
