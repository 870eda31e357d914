"""SimHash fingerprints, thresholds and groups against plain Python."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from lexcorpus.llm import simhash
from lexcorpus.llm.queries import QUERIES

KIND = "doc_id long, text string, fingerprint string, component_id int, bucket string"


def plain_fingerprint(text, words=3):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not found:
        return 0
    runs = [" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    values = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << bit for bit in range(64) if 2 * sum(v >> bit & 1 for v in values) > len(values))


def plain_components(marks, distance=3):
    """Smallest id reachable for rows (id, fingerprint); a null id has a node of its own."""
    root = list(range(len(marks)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (a, x) in enumerate(marks):
        for j, (b, y) in enumerate(marks[:i]):
            if (x ^ y).bit_count() <= distance or (a is not None and a == b):
                root[find(i)] = find(j)
    least = {}
    for i, (a, _) in enumerate(marks):
        if a is not None:
            least[find(i)] = min(a, least.get(find(i), a))
    return [least.get(find(i)) for i in range(len(marks))]


def check(spark, rows):
    docs = spark.createDataFrame([(d, t, "clash", 7, "x") for d, t in rows], KIND).repartition(3)
    got = simhash.simhash_groups(docs).collect()
    marks = [(d, plain_fingerprint(t)) for d, t in rows]
    expected = [(d, x, c) for (d, x), c in zip(marks, plain_components(marks))]
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(((r.doc_id, r.fingerprint % (1 << 64), r.component_id) for r in got), key=key) == sorted(expected, key=key)


def test_nulls_short_texts_ties_and_repeated_ids(spark):
    check(
        spark,
        [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "ONE"), (6, "one two"), (7, "one\x0btwo"), (8, "É É É É"), (9, "é é é é")]
        + [(10, "a b c a b c d e f"), (10, "quite another text of some words"), (11, "quite another text of some words")]
        + [(None, "a b c a b c d e f"), (None, "a text that no other row has at all"), (None, None)]
        + [(12, "w" * 5000 + " x y z"), (13, "w" * 5000 + " x y z"), (14, "a b " * 3000)],
    )
    empty = spark.createDataFrame([], KIND)
    assert simhash.simhash_groups(empty).collect() == []
    rows = spark.createDataFrame([(2, "one two", "f", 1, "b"), (1, "one two", "g", 2, "c"), (None, None, "h", 3, "d")], KIND)
    kept = sorted(map(tuple, simhash.first_of_each_group(rows).collect()), key=str)
    assert kept == [(1, "one two", "g", 2, "c"), (None, None, "h", 3, "d")]


def texts(seed, n):
    dice = random.Random(seed)
    rows = []
    for d in range(n):
        if rows and dice.random() < 0.7:
            words = rows[dice.randrange(len(rows))][1].split(" ")
            for _ in range(dice.choice([0, 1, 1, 2])):
                words[dice.randrange(len(words))] = f"w{dice.randrange(300)}"
        else:
            words = [f"w{dice.randrange(300)}" for _ in range(dice.choice([2, 30, 90, 400]))]
        rows.append((d * 2 + 1, " ".join(words)))
    return rows


def test_groups_equal_all_pairs(spark):
    check(spark, texts(5, 220))


def clustered(seed, n):
    """Distinct fingerprints: a dense group, a chain, and random ones."""
    dice = np.random.default_rng(seed)
    value = set(int(v) for v in dice.integers(0, 2**64, n // 3, dtype=np.uint64))
    centre = int(dice.integers(0, 2**64, dtype=np.uint64))
    while len(value) < n:
        near = centre
        for bit in dice.choice(20, 4):  # correlated bits: only some of them move
            near ^= 1 << int(bit)
        value.add(near)
        if dice.random() < 0.02:
            centre ^= 1 << int(dice.integers(64))
    return sorted(value)


@pytest.mark.parametrize("block, small, price", [(1 << 16, 48, 100), (40, 4, 100), (40, 48, 0.01)])
def test_links_hold_all_groups_together(spark, monkeypatch, block, small, price):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "SMALL", small)
    monkeypatch.setattr(simhash, "PROBE_COST", price)  # at a low price parts are skipped for wider probes elsewhere
    value = clustered(block, 700)
    nodes = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in value], "fingerprint long").repartition(4)
    links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.similar_fingerprints(nodes).collect()]
    assert all(a != b for a, b in links) and len(links) < 20 * len(value)  # not all pairs of the dense group
    root = {v: v for v in value}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    groups = plain_components(list(enumerate(value)))
    by_group, by_root = {}, {}
    for i, v in enumerate(value):
        by_group.setdefault(groups[i], set()).add(v)
        by_root.setdefault(find(v), set()).add(v)
    assert sorted(map(sorted, by_group.values())) == sorted(map(sorted, by_root.values()))


def test_thresholds_are_the_cheapest():
    dice = np.random.default_rng(3)
    counts = np.zeros((simhash.PARTS, 1 << simhash.WIDTH), np.int64)
    values = dice.integers(0, 1 << simhash.WIDTH, (simhash.PARTS, 25))
    counts[np.arange(simhash.PARTS)[:, None], values] = dice.choice([1, 1_000, 100_000], values.shape)
    balls = simhash.ball_counts(counts, 3)
    for part in range(simhash.PARTS):  # counts within r bits by their definition
        for value in values[part, :3].tolist():
            differ = np.bitwise_count(np.arange(1 << simhash.WIDTH) ^ value)
            assert balls[part, :, value].tolist() == [int(counts[part, differ <= r].sum()) for r in range(4)]
    probes = np.cumsum([len(m) for m in simhash.masks(3)])
    found = simhash.thresholds(values, balls, 3)
    assert (found.sum(axis=0) == 3 - simhash.PARTS + 1).all() and (found == -1).any()

    def price(row, steps):
        return sum(simhash.PROBE_COST * probes[r] + balls[p, r, values[p, row]] for p, r in enumerate(steps) if r >= 0)

    every = [s for s in np.ndindex(*[5] * simhash.PARTS) if sum(s) == 4]
    for row in range(25):
        assert price(row, found[:, row]) == min(price(row, [x - 1 for x in s]) for s in every)


def test_correlated_bits_share_a_part():
    dice = np.random.default_rng(8)
    bits = dice.integers(0, 2, (4000, 64))
    for base, twins in ((0, (17, 40)), (5, (33, 62))):
        for twin in twins:
            flip = dice.random(4000) < 0.05
            bits[:, twin] = bits[:, base] ^ flip
    groups = simhash.grouped_bits((bits.T @ bits).astype(float), 4000)
    assert sorted(b for g in groups for b in g) == list(range(64))
    assert all(any({base, *twins} <= set(g) for g in groups) for base, twins in ((0, (17, 40)), (5, (33, 62))))


def test_query_equals_plain_python(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    marks = [(d, plain_fingerprint(t)) for d, t in docs]
    expected = sorted((d, f"{x:016x}", c) for (d, x), c in zip(marks, plain_components(marks)))
    assert sorted(map(tuple, QUERIES["op11_simhash_pigeonhole"](spark, folder).collect())) == expected
