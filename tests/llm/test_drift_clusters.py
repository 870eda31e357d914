"""Clusters with geometric bounds against plain Lloyd rounds, and the bounds against sampled points."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from lexcorpus.llm import drift_clusters as dc

KIND = "vec_id long, embedding array<float>, cluster string, distance int, upper string"


def plain(rows, k, rounds, dims, scale=256, seed=2):
    kept = [
        (i, [max(-dc.LIMIT, min(dc.LIMIT, math.floor(scale * float(np.float32(x))))) for x in v])
        for i, v in rows
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    ]
    key = lambda r: hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (key(r), np.array(r[1], np.int32).tobytes()))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        found = [nearest(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            own = [v for (_, v), c in zip(kept, found) if c == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    last = [nearest(v) for _, v in kept]
    total = sum(d for d, _ in last)
    return [
        (i, c, d, sum(e for e, b in last if b == c), total, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest())
        for (i, _), (d, c) in zip(kept, last)
    ]


def check(spark, rows, k, rounds, dims):
    table = spark.createDataFrame([(i, v, "x", 1, "y") for i, v in rows], KIND).repartition(3)
    got = dc.cluster_report(table, k, rounds, dims=dims).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(plain(rows, k, rounds, dims), key=key)


@pytest.mark.parametrize("seed, k, spread", [(1, 9, 0.05), (2, 30, 0.4), (3, 5, 20_000.0)])
def test_rounds_equal_plain_lloyd(spark, seed, k, spread):
    dice = np.random.default_rng(seed)
    centres = dice.normal(size=(7, 6)) * max(1.0, spread)
    rows = [(i, (centres[dice.integers(7)] + dice.normal(size=6) * spread).tolist()) for i in range(300)]
    check(spark, rows, k, 5, 6)


def test_nulls_wrong_lengths_ties_repeats_and_empty(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.0]), (3, [0.5, 0.0]), (None, [1.0, 1.0]), (None, [-1.0, 1.0])]
    unfit = [(5, None), (6, []), (7, [1.0]), (8, [1.0, None]), (9, [float("nan"), 0.0]), (10, [0.0, float("inf")]), (11, [1.0, 2.0, 3.0])]
    check(spark, rows + unfit, 3, 2, 2)
    check(spark, rows + unfit, 40, 5, 2)  # fewer vectors than clusters
    check(spark, [(i, [1.0, 1.0]) for i in range(50)] + [(99, [1e30, -1e30])], 4, 3, 2)  # one vector very often
    assert dc.cluster_report(spark.createDataFrame(unfit_rows(unfit), KIND), 3, 2, dims=2).collect() == []
    assert dc.cluster_report(spark.createDataFrame([], KIND)).collect() == []


def unfit_rows(unfit):
    return [(i, v, "x", 1, "y") for i, v in unfit]


def test_loosening_bounds_every_point_of_the_sphere():
    dice = np.random.default_rng(4)
    saved = []
    for _ in range(300):
        old = dice.normal(size=(4, 3)) * 3
        new = old + dice.normal(size=(4, 3)) * dice.choice([0.0, 0.1, 1.0, 5.0])
        radius = np.abs(dice.normal(size=4)) * dice.choice([0.0, 0.3, 2.0])
        bound = dc.loosening(old, new, radius)
        for i in range(4):
            way = dice.normal(size=(200, 3))
            x = old[i] + way / np.linalg.norm(way, axis=1, keepdims=True) * radius[i] * dice.random((200, 1)) ** 0.2
            for j in range(4):
                closer = np.linalg.norm(x - old[j], axis=1) - np.linalg.norm(x - new[j], axis=1)
                assert closer.max() <= bound[i, j] + 1e-9
                drift = np.linalg.norm(new[j] - old[j])
                assert bound[i, j] <= drift * (1 + 1e-8)
                if i != j and drift:
                    saved.append(bound[i, j] / drift)
    assert np.mean(saved) < 0.7  # well below the full drift


def test_settled_vectors_are_not_scanned():
    dice = np.random.default_rng(6)
    centres = dice.integers(-2000, 2000, (8, 16))
    vectors = (centres[np.arange(4000) % 8] + dice.integers(-60, 60, (4000, 16))).astype(np.int64)
    start = vectors[:8] + 25
    cluster, upper, lower = dc.scan(vectors, start)
    radius = np.array([upper[cluster == c].max(initial=0) for c in range(8)])
    moved = np.stack([vectors[cluster == c].sum(axis=0) // (cluster == c).sum() for c in range(8)])
    step = dc.Step(start, moved, radius)
    again, high, low, scanned = dc.reassign(vectors, cluster, upper, lower, step)
    assert again.tolist() == dc.scan(vectors, moved)[0].tolist() and len(scanned) < 400
    exact = np.sqrt(dc.squared(vectors, moved).astype(float))
    every = np.arange(len(vectors))
    assert (exact[every, again] <= high + 1e-6).all()
    exact[every, again] = np.inf
    assert (exact.min(axis=1) >= low - 1e-6).all()


def test_distances_are_exact_for_large_integers():
    dice = np.random.default_rng(7)
    vectors, centroids = (dice.integers(-dc.LIMIT, dc.LIMIT, (n, 64)) for n in (5, 3))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, c)) for c in centroids] for v in vectors]
    assert dc.squared(vectors, centroids).tolist() == want
    small = [x >> 6 for x in (vectors, centroids)]
    assert dc.squared(*small).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, c)) for c in small[1]] for v in small[0]]
