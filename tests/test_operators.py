import hashlib
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexcorpus import rules
from lexcorpus.functions.headings import extract_tail
from lexcorpus.operators import counts, extraction, labels, metrics, sampling
from lexcorpus.operators.schema import require_columns

from .test_text_functions import random_texts


def rank(seed, key):
    return (hashlib.md5(f"{seed}:{key}".encode()).hexdigest(), str(key))


@pytest.fixture(scope="module")
def ids(spark):
    # one label holds most of the rows
    return spark.range(5000).select(
        "id", F.when(F.col("id") % 5 < 3, 0).otherwise(F.col("id") % 7).cast("int").alias("label")
    ).cache()


def got_ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_sample_exact(ids):
    want = sorted(range(5000), key=lambda i: rank(42, i))
    for n in (0, 1, 17, 4999, 5000, 6000):
        assert got_ids(sampling.sample_exact(ids, n)) == sorted(want[:n])
    assert got_ids(sampling.sample_exact(ids.repartition(7), 300)) == got_ids(
        sampling.sample_exact(ids.coalesce(1), 300)
    )
    assert got_ids(sampling.slice_rows(ids, 100, 250)) == sorted(want[100:250])
    assert got_ids(sampling.slice_rows(ids, 4990, 9000)) == sorted(want[4990:])
    assert [r.id for r in sampling.shuffle_rows(ids).collect()] == want


def test_sample_needs_no_shuffle_of_rows(ids):
    wide = ids.withColumn("text", F.repeat(F.lit("x"), 10))
    plan = sampling.sample_exact(wide, 100)._jdf.queryExecution().executedPlan().toString()
    top = plan.split("Subquery")[0]
    assert "Exchange" not in top


def test_holdout(ids):
    out = sampling.holdout_split(ids, 1500)
    assert {r["split"]: r["count"] for r in out.groupBy("split").count().collect()} == {
        "test": 1500, "train": 3500,
    }
    with pytest.raises(Exception, match="fewer than 9000"):
        sampling.holdout_split(ids, 9000).collect()


def test_shares(ids):
    parts = [got_ids(sampling.share_rows(ids, i, 3)) for i in range(3)]
    assert sorted(sum(parts, [])) == list(range(5000))


@pytest.mark.parametrize("parts", [1, 9])
def test_stratified(ids, parts):
    rows = ids.union(ids.limit(0)).repartition(parts)
    out = sampling.stratified_split(rows, "label").collect()
    by = Counter(r.label for r in out)
    test = {k: sorted(r.id for r in out if r.label == k and r.split == "test") for k in by}
    assert sum(map(len, test.values())) == 500
    for k, n in by.items():
        order = sorted((r.id for r in out if r.label == k), key=lambda i: rank(42, i))
        assert len(test[k]) in (n // 10, n // 10 + 1) and test[k] == sorted(order[: len(test[k])])


@pytest.mark.parametrize("n", [3, 1200])
def test_per_group(ids, n):
    out = sampling.sample_per_group(ids, "label", n).collect()
    rows = ids.collect()
    for k in {r.label for r in rows}:
        order = sorted((r.id for r in rows if r.label == k), key=lambda i: rank(42, i))
        assert sorted(r.id for r in out if r.label == k) == sorted(order[:n])


@pytest.mark.parametrize("labels_, rows, want", [(30, 14, 42), (75, 4, 30)])
def test_stratified_total_is_exact(spark, labels_, rows, want):
    df = spark.range(labels_ * rows).select("id", (F.col("id") % labels_).alias("label"))
    assert sampling.stratified_split(df, "label").where("split = 'test'").count() == want


@pytest.mark.parametrize("n", [999, 1000, 1001, 1999, 2001])
def test_per_group_with_null_groups_and_repeated_keys(spark, n):
    df = spark.range(6000).select(
        F.when(F.col("id") % 3 < 2, F.col("id") % 3).alias("group"), (F.col("id") % 2).alias("key"), (F.col("id") % 500).alias("value")
    )
    out = sampling.sample_per_group(df, "group", n, 42, "key").groupBy("group").count().collect()
    assert {r.group: r["count"] for r in out} == {k: min(n, 2000) for k in (0, 1, None)}


@pytest.mark.parametrize("n", [1, 10, 1999, 2000, 2001, 5999])
def test_sample_is_exact_with_repeated_and_null_keys(spark, n):
    df = spark.range(6000).select(
        F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("id"), (F.col("id") % 7).alias("value")  # equal rows too
    )
    got = sampling.sample_exact(df, n).collect()
    assert len(got) == n
    again = sampling.sample_exact(df.repartition(5), n).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    out = sampling.holdout_split(df, n)
    assert out.count() == 6000 and out.where("split = 'test'").count() == n
    assert sampling.slice_rows(df, n // 2, n).count() == n - n // 2


def test_strict_holdout_of_nothing(spark):
    with pytest.raises(ValueError, match="fewer than 5"):
        sampling.holdout_split(spark.createDataFrame([], "id int"), 5)


def test_sampling_null_label(spark):
    df = spark.createDataFrame([(i, None if i % 2 else 1) for i in range(40)], "id int, label int")
    out = sampling.stratified_split(df, "label", 0.5).collect()
    assert len(out) == 40
    assert all(r.split == "train" for r in out if r.label is None)
    assert sum(r.split == "test" for r in out) == 10


@pytest.mark.parametrize("n", [0, 1, 2, 20, 100, 333])
def test_length_stats(spark, n):
    vals = [(i * 37) % 50 + 1 for i in range(n)]
    df = spark.createDataFrame([(v,) for v in vals], "v int")
    row = counts.length_stats(df, v=F.col("v"), twice=F.col("v") * 2).where("metric = 'v'").first()
    if n == 0:
        assert list(row)[1:] == [0, 0.0, 0.0, 0.0, 0.0, 0.0]
        return
    s = sorted(vals)
    assert row.n == n and row["min"] == s[0] and row["max"] == s[-1]
    assert row.mean == pytest.approx(statistics.fmean(vals), abs=0.0051)
    assert row.median == statistics.median(vals)
    assert row.p95 == s[min(n - 1, int(n * 0.95))]


def test_terms(spark):
    df = spark.createDataFrame([("Karar çok güzel güzel **gün** ",), ("gün güzel gün",), (None,)], "text string")
    assert {r.term: r.n for r in counts.term_counts(df).collect()} == {"güzel": 3, "gün": 3}
    grams = {r.bigram: r.n for r in counts.bigram_counts(df).collect()}
    assert grams == {"güzel güzel": 1, "güzel gün": 2, "gün güzel": 1}
    assert [tuple(r) for r in counts.top_k(counts.term_counts(df), 1, "term").collect()] == [("gün", 3)]


def test_extraction_reports(spark):
    texts = random_texts(800, 9)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = df.select("id", extract_tail(F.col("text")).alias("a"), extract_tail(F.col("text"), max_len=60).alias("b")).collect()
    want = {r.id: r.b for r in found if r.b is not None}
    got = extraction.with_verdict(df, max_len=60)
    assert {r.id: r.verdict for r in got.collect()} == want
    both = extraction.with_verdict(
        extraction.with_verdict(df, out="a", max_len=None, keep_missing=True), out="b", max_len=60, keep_missing=True
    )
    row = extraction.compare_extractors(both, "a", "b").first()
    a = {r.id: r.a for r in found}
    gone = [len(v) for i, v in a.items() if v is not None and i not in want]
    assert (row.a_count, row.b_count, row.eliminated) == (
        sum(v is not None for v in a.values()), len(want), len(gone),
    )
    assert (row.min_length, row.max_length) == (min(gone), max(gone))
    assert extraction.eliminated_rows(both, "a", "b").count() == len(gone)
    rate = extraction.extraction_rate(both, "b").first()
    assert (rate.total, rate.extracted, rate.remaining) == (800, len(want), 800 - len(want))


def test_expensive_value_is_computed_once(spark):
    df = spark.createDataFrame([(1, "x")], "id int, text string")
    plan = extraction.with_verdict(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("G[\\s\\x1c-\\x1f]*E[\\s\\x1c-\\x1f]*R") == 2 and "Generate" in plan  # one split, one offset scan


def test_headings(spark):
    rows = [("HÜKÜM: a SONUÇ :",), ("KARAR:",), ("k a r a r",), ("none",), ("H Ü K Ü M",)]
    df = spark.createDataFrame(rows, "text string")
    got = {r.heading: (r.n, r.total) for r in extraction.heading_prevalence(df).collect()}
    assert got == {
        "SONUÇ": (1, 5), "HÜKÜM": (1, 5), "KARAR": (1, 5), "GEREĞİ DÜŞÜNÜLDÜ": (0, 5),
        "any": (2, 5), "two_or_more": (1, 5),
    }
    rest = extraction.without_headings(df)
    assert rest.count() == 3
    spaced = {r.heading: r.n for r in extraction.heading_prevalence(rest, rules.SPACED_HEADINGS).collect()}
    assert spaced["K A R A R"] == 1 and spaced["any"] == 2
    empty = {r.heading: r.rate for r in extraction.heading_prevalence(df.limit(0)).collect()}
    assert set(empty.values()) == {0.0} and len(empty) == 6


def test_labels(spark):
    clusters = spark.createDataFrame(
        [(0, "B"), (1, "Temyiz x"), (2, "A"), (3, "B"), (4, "y Temyiz")], "cluster_id int, name string"
    )
    assign = spark.createDataFrame([(str(i), i % 5) for i in range(20)], "id string, cluster_id int")
    merged, moved = labels.merge_clusters(clusters, assign)
    assert sorted(tuple(r) for r in merged.collect()) == [(0, "B"), (1, "Temyiz Davası"), (2, "A")]
    assert {r.id: r.cluster_id for r in moved.collect()} == {
        str(i): [0, 1, 2, 0, 1][i % 5] for i in range(20)
    }
    df = spark.createDataFrame([(i, [5, 9, 2][i % 3]) for i in range(9)], "id int, label int")
    assert {(r.id, r.label) for r in labels.reindex_labels(df).collect()} == {
        (i, [1, 2, 0][i % 3]) for i in range(9)
    }
    names = labels.label_names(labels.distinct_labels(df), clusters)
    assert {r.label: r.name for r in names.collect()} == {5: "LABEL_5", 9: "LABEL_9", 2: "A"}
    looked = labels.lookup_names(labels.lookup_labels(assign.select("id"), assign), clusters)
    assert looked.where("category is null").count() == 0
    half = assign.where("cluster_id < 2")
    assert labels.members(assign, half).count() == 8
    assert labels.complement(assign, half).count() == 12
    both = labels.union_tagged("origin", a=df, b=df.withColumn("extra", F.lit(1)))
    assert both.columns == ["id", "label", "origin", "extra"] and both.count() == 18


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(2,)] * 3, "label int")
    got = {r.label: r.weight for r in labels.class_weights(df, num_labels=3).collect()}
    assert got == pytest.approx({0: 10 / 18, 1: 10 / 3, 2: 10 / 9})
    got = {r.label: r.weight for r in labels.class_weights(df).collect()}
    assert got == pytest.approx({0: 9 / 12, 2: 9 / 6})


def test_metrics(spark):
    pairs = [(i % 3, (i * i) % 4) for i in range(50)]
    df = spark.createDataFrame(pairs, "label int, prediction int")
    row = metrics.classification_metrics(df).first()
    f1 = {}
    for c in {x for p in pairs for x in p}:
        tp = sum(a == b == c for a, b in pairs)
        d = sum(a == c for a, _ in pairs) + sum(b == c for _, b in pairs)
        f1[c] = 2 * tp / d if d else 0.0
    support = Counter(a for a, _ in pairs)
    assert row.accuracy == pytest.approx(sum(a == b for a, b in pairs) / 50)
    assert row.macro_f1 == pytest.approx(sum(f1.values()) / len(f1))
    assert row.weighted_f1 == pytest.approx(sum(f1[c] * n for c, n in support.items()) / 50)


def test_require_columns(spark):
    with pytest.raises(KeyError, match="nope"):
        require_columns(spark.range(1), "id", "nope")


OWN = ["id", "cut", "need", "equal", "n", "b", "o", "_first", "first", "place", "g0", "same_g0", "wanted", "Upto", "short", "k", "h"]


@pytest.mark.parametrize("key, group", [("id", "n"), ("b", "cut"), (("id", "o"), "g0"), ("first", "wanted")])
def test_columns_that_are_called_like_intermediate_values(spark, key, group):
    rows = [tuple([i] + [f"{c}{i % 3}" for c in OWN[1:]]) for i in range(60)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} {'int' if c == 'id' else 'string'}" for c in OWN)).repartition(4)
    for sampled, n in (
        (sampling.sample_exact(df, 25, key=key), 25),
        (sampling.slice_rows(df, 10, 25, key=key), 15),
        (sampling.sample_per_group(df, group, 7, key=key), 21),
        (sampling.holdout_split(df, 25, key=key, out="part").drop("part"), 60),
        (sampling.stratified_split(df, group, key=key, out="part").drop("part"), 60),
    ):
        assert sampled.columns == OWN
        got = sorted(map(tuple, sampled.collect()))
        assert len(set(got)) == len(got) == n and set(got) <= set(rows)
    replaced = sampling.holdout_split(df, 25, key=key, out="cut")  # a column of that name is replaced
    assert sorted(replaced.columns) == sorted(OWN) and replaced.where("cut = 'test'").count() == 25
