"""Exact order statistics and top counts against plain Python, with sketches too coarse to answer alone."""

import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lexcorpus.operators import selection_stats as stats


def values(kind, seed, n):
    dice = random.Random(seed)
    if kind == "hot":  # one value holds most rows
        return [7.5 if dice.random() < 0.7 else dice.uniform(-1e6, 1e6) for _ in range(n)]
    if kind == "wide":
        return [dice.choice([-1, 1]) * 10.0 ** dice.randint(-300, 300) * dice.random() for _ in range(n)]
    if kind == "ties":
        return [float(dice.randint(0, 5)) for _ in range(n)]
    return [dice.gauss(0, 1) for _ in range(n)]


@pytest.mark.parametrize("kind", ["hot", "wide", "ties", "normal"])
@pytest.mark.parametrize("accuracy, few", [(10, 20), (10_000, 100_000)])
def test_ranks(spark, monkeypatch, kind, accuracy, few):
    monkeypatch.setattr(stats, "ACCURACY", accuracy)
    monkeypatch.setattr(stats, "FEW", few)
    data = values(kind, 3, 3000)
    df = spark.createDataFrame([(x,) for x in data] + [(None,)] * 5, "x double").repartition(4)
    ranks = [0, 1, 1499, 1500, 2849, 2998, 2999, 3000, -1]
    got = stats.values_at(df, [(F.col("x"), r) for r in ranks])
    want = sorted(data)
    assert got == [want[r] if 0 <= r < 3000 else None for r in ranks]


def test_statistics_of_several_types(spark, monkeypatch):
    monkeypatch.setattr(stats, "ACCURACY", 20)
    monkeypatch.setattr(stats, "FEW", 10)
    dice = random.Random(1)
    rows = [
        (dice.randint(-(2**62), 2**62), Decimal(dice.randint(-999, 999)) / 100, dice.choice([None, float("nan"), dice.random()]), None)
        for _ in range(501)
    ]
    df = spark.createDataFrame(rows, "a long, b decimal(9,2), c double, d int").repartition(3)
    got = {r.metric: r for r in stats.numeric_stats(df, **{c: F.col(c) for c in "abcd"}).collect()}
    for i, name in enumerate("abc"):
        xs = sorted(float(r[i]) if i else r[i] for r in rows if r[i] is not None and r[i] == r[i])
        n, r = len(xs), got[name]
        assert (r.n, r.min, r.max) == (n, float(xs[0]), float(xs[-1]))
        assert r.median == (float(xs[(n - 1) // 2]) + float(xs[n // 2])) / 2 and r.p95 == float(xs[min(n - 1, n * 95 // 100)])
    assert tuple(got["d"]) == ("d", 0, 0.0, 0.0, 0.0, 0.0, 0.0)
    assert stats.numeric_stats(df.limit(0), a=F.col("a")).first().n == 0


@pytest.mark.parametrize("seed, tracked, most", [(1, 400, 640_000), (2, 10, 640_000), (3, 10, 80)])
def test_top_counts_are_exact(spark, monkeypatch, seed, tracked, most):
    monkeypatch.setattr(stats, "MOST_TRACKED", most)
    dice = random.Random(seed)
    data = [f"w{int(dice.paretovariate(0.7)) % 3000}" for _ in range(4000)] + ["tie a"] * 30 + ["tie b"] * 30
    df = spark.createDataFrame([(w, 1) for w in data] + [(None, 1)] * 900, "n string, item int").repartition(5)
    want = sorted(Counter(data).items(), key=lambda p: (-p[1], p[0]))
    for k in (1, 7, 40):
        got = stats.exact_top_k(df.select("n"), "n", k, tracked)
        assert got.columns == ["n", "_n"]
        assert sorted(((r[0], r[1]) for r in got.collect()), key=lambda p: (-p[1], p[0])) == want[:k]
    flat = spark.createDataFrame([(f"v{i}",) for i in range(700)], "w string")
    assert [r.w for r in stats.exact_top_k(flat, "w", 3, tracked).collect()] == ["v0", "v1", "v10"]  # all equal: value order
    assert stats.exact_top_k(flat.limit(0), "w", 3).collect() == []
    assert len(stats.exact_top_k(flat.limit(2), "w", 3).collect()) == 2


def test_few_rows_are_exchanged_for_a_large_vocabulary(spark):
    df = spark.range(400_000).select(F.when(F.col("id") % 4 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("w"))
    assert [tuple(r) for r in stats.exact_top_k(df, "w", 1).collect()] == [("hot", 100_000)]
