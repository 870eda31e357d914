"""Near-duplicate components against all-pairs comparison of the whole sets."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from lexcorpus.llm import sketches
from lexcorpus.llm.components import components
from lexcorpus.llm.hashing import mix

KIND = "doc_id long, text string, component_id string, n_shingles int"


def shingles(text, words):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not found:
        return frozenset()
    return frozenset(tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1)))


def brute(rows, words, percent=80):
    sets = {}
    for doc, text in rows:
        sets.setdefault(doc, []).append(shingles(text, words))
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[:i]:
            for x in sets[a]:
                for y in sets[b]:
                    if x and y and 100 * len(x & y) >= percent * len(x | y):
                        ra, rb = sorted((find(a), find(b)))
                        root[rb] = ra
    return sorted((d, len(s), find(d), find(d) == d) for d in docs for s in sets[d])


def run(spark, rows, words):
    docs = spark.createDataFrame([(d, t, "clash", 3) for d, t in rows], KIND).repartition(3)
    return sorted(tuple(r) for r in sketches.near_duplicates(docs, words).collect())


def corpus(seed, n):
    dice = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for d in range(n):
        if rows and dice.random() < 0.6:
            words = rows[dice.randrange(len(rows))][1].split(" ")
            for _ in range(dice.choice([0, 0, 1, 2, 4, len(words) // 12])):
                if words:
                    words[dice.randrange(len(words))] = dice.choice(vocabulary).upper()
        else:
            words = [dice.choice(vocabulary) for _ in range(dice.choice([1, 3, 20, 60, 150, 400]))]
        rows.append((d * 3, " ".join(words)))
    return rows


@pytest.mark.parametrize("words", [2, 5])
def test_components_equal_all_pairs(spark, words):
    rows = corpus(words, 160)
    assert run(spark, rows, words) == brute(rows, words)


def test_open_buckets_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(sketches, "STAR_ROUNDS", 1)
    monkeypatch.setattr(sketches, "MEMBERS", 7)
    dice = random.Random(9)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for d in range(70):  # a chain: neighbours are alike, distant ones are not
        base[dice.randrange(100)] = f"x{d}"
        base[dice.randrange(100)] = f"y{d}"
        rows.append((d, " ".join(base)))
    assert run(spark, rows, 2) == brute(rows, 2)


def test_nulls_ties_repeats_and_empty(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "one two"), (7, "ONE TWO"), (9, "a b c"), (9, "a b c"), (10, "É É"), (11, "é é")]
    assert run(spark, rows, 2) == brute(rows, 2)
    docs = spark.createDataFrame([(None, "one two", "", 1), (6, "one two", "", 1)], KIND)
    assert sorted(map(str, sketches.near_duplicates(docs, 2).select("doc_id", "component_id", "kept").collect())) == [
        "Row(doc_id=6, component_id=6, kept=True)",
        "Row(doc_id=None, component_id=None, kept=True)",
    ]
    assert sketches.near_duplicates(spark.createDataFrame([], KIND)).collect() == []


def test_sketch_agreement_estimates_similarity():
    key = mix(np.arange(3000, dtype=np.uint64))
    left, right = np.sort(key[:2400]), np.sort(key[600:])  # similarity 0.6
    table = sketches.sketch(np.concatenate([left, right, key[:1]]), np.array([0, 2400, 4800, 4801]))
    assert (table != 0xFFFFFFFF).all()  # every bin is filled, also for one shingle
    assert abs((table[0] == table[1]).mean() - 0.6) < 0.15


def test_components_of_chain_and_star(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, k) for k in range(101, 140)]
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {**{i: 1 for i in range(2, 61)}, **{k: 100 for k in range(101, 140)}}
