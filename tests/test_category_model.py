"""Mini-batch fits against plain Python, saved models, and the choice of a classifier."""

import hashlib

import numpy as np
import pytest
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lexcorpus.operators import features, minibatch, selection
from lexcorpus.plans.category_model import CategoryModel, fit_category_model

from .test_flows import decisions

SIZE = 12


def points(seed, n):
    """Sparse rows around four centers, some empty, some repeated."""
    dice = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        base = 3 * (i % 4)
        vector = {base + j: float(dice.random() + 0.5) for j in range(3)}
        vector[int(dice.integers(SIZE))] = float(dice.random() * 0.3)
        rows.append((str(i), {} if i % 29 == 0 else vector))
    return rows + [(f"copy{i}", rows[i][1]) for i in range(5)]


def as_table(spark, rows, parts):
    schema = StructType([StructField("id", StringType()), StructField("features", VectorUDT())])
    return spark.createDataFrame([(k, SparseVector(SIZE, v)) for k, v in rows], schema).repartition(parts)


def plain_fit(rows, k, seed, batch_rows, batches):
    """The same fit row by row, without an early end."""
    dense = {key: np.array([v.get(j, 0.0) for j in range(SIZE)]) for key, v in rows}
    uniform = lambda turn: int(hashlib.md5(f"{seed}:{turn}".encode()).hexdigest()[:8], 16) / 2**32
    order = lambda s: sorted(dense, key=lambda key: (hashlib.md5(f"{s}:{key}".encode()).hexdigest(), key))
    slices, turn = [], 0
    while len(slices) < batches:
        keys = order(seed + turn)
        slices += [keys[i : i + batch_rows] for i in range(0, len(keys), batch_rows)]
        turn += 1
    first, best = slices[0], None
    cost = lambda cs: sum(min(((dense[x] - c) ** 2).sum() for c in cs) for x in first)
    for attempt in range(3):
        chosen = [dense[first[int(uniform(f"{attempt}:0:0") * len(first))]]]
        while len(chosen) < min(k, len(first)):
            away = [min(((dense[x] - c) ** 2).sum() for c in chosen) for x in first]
            drawn = []
            for trial in range(2 + int(np.log(k))):
                goal, reach, place = uniform(f"{attempt}:{len(chosen)}:{trial}") * sum(away), 0.0, 0
                for place, d in enumerate(away):
                    reach += d
                    if reach > goal:
                        break
                drawn.append(dense[first[place]])
            chosen.append(min(drawn, key=lambda c: cost([*chosen, c])))
        if best is None or cost(chosen) < best[0]:
            best = cost(chosen), [c.copy() for c in chosen]
    centers, seen = best[1], [0] * len(best[1])
    for keys in slices[:batches]:
        own = [min(range(len(centers)), key=lambda c: ((dense[x] - centers[c]) ** 2).sum()) for x in keys]
        for c in range(len(centers)):
            mine = [dense[x] for x, o in zip(keys, own) if o == c]
            if mine:
                seen[c] += len(mine)
                centers[c] = centers[c] + (sum(mine) - len(mine) * centers[c]) / seen[c]
    return np.array(centers)


@pytest.mark.parametrize("batch_rows, batches", [(40, 3), (60, 7), (500, 4)])
def test_minibatch_equals_plain_python_in_any_partitioning(spark, batch_rows, batches):
    rows = points(1, 150)
    want = plain_fit(rows, 4, 11, batch_rows, batches)
    got = [
        minibatch.fit_minibatch(as_table(spark, rows, parts), SIZE, 4, 11, batch_rows=batch_rows, batches=batches, patience=99)
        for parts in (1, 6)
    ]
    assert np.array_equal(got[0], got[1])  # to the last bit
    assert np.allclose(got[0], want, atol=1e-7)


def test_minibatch_is_about_as_good_as_the_full_fit(spark):
    table = as_table(spark, points(2, 400), 4).cache()
    quick = minibatch.fit_minibatch(table, SIZE, 4, 42, batch_rows=64)
    full = np.array(features.fit_clusters(table, 4, 42).clusterCenters())
    assert minibatch.inertia(table, quick) <= 1.05 * minibatch.inertia(table, full)


def test_few_rows_and_none(spark):
    rows = points(3, 8)[:3]
    assert minibatch.fit_minibatch(as_table(spark, rows, 2), SIZE, 10).shape == (3, SIZE)
    empty = as_table(spark, rows, 1).limit(0)
    assert minibatch.fit_minibatch(empty, SIZE, 10).shape == (0, SIZE)


def test_nearest_center_with_ties_and_empty_vectors(spark):
    rows = points(4, 60)
    centers = np.vstack([np.eye(SIZE)[:3], np.eye(SIZE)[:1], np.full((1, SIZE), 0.4)])
    table = as_table(spark, rows, 3)
    got = {r.id: r.c for r in table.select("id", minibatch.nearest_center(centers).alias("c")).collect()}
    for key, v in rows:
        x = np.array([v.get(j, 0.0) for j in range(SIZE)])
        assert got[key] == int(np.argmin(np.round(((centers - x) ** 2).sum(axis=1), 12)))


@pytest.mark.parametrize("method", ["minibatch", "full"])
def test_a_saved_model_assigns_new_texts(spark, tmp_path, method, monkeypatch):
    corpus = spark.createDataFrame(decisions(240), "id string, text string, category string")
    old, new = corpus.where("int(id) < 180"), corpus.where("int(id) >= 180")
    namer = lambda: lambda prompt: "Kategori: " + ("Kira" if "kiracı" in prompt else "Aile" if "nafaka" in prompt else "İş")
    model = fit_category_model(old, 3, text="text", method=method, namer=namer, min_df=2, max_df=0.9)
    model.save(str(tmp_path / "m"))
    for fit in ("fit_minibatch", "fit_clusters", "vocabulary"):
        monkeypatch.setattr(f"lexcorpus.plans.category_model.{fit}", None)
    again = CategoryModel.load(spark, str(tmp_path / "m"))
    assert np.array_equal(again.centers, model.centers) and again.stop == model.stop
    rows = again.categorize(new, "text").collect()
    assert len(rows) == 60 and rows[0].asDict().keys() == {"id", "text", "cluster_id", "category"}
    topics = {0: "Kira", 1: "Aile", 2: "İş"}
    assert all(r.category == topics[int(r.id) % 3] for r in rows)
    same = {r.id: r.cluster_id for r in model.assign(new, "text").collect()}
    assert same == {r.id: r.cluster_id for r in rows}
    with pytest.raises(ValueError, match="method"):
        fit_category_model(old, method="guess")


def plain_macro_f1(pairs):
    classes = {c for pair in pairs for c in pair}
    scores = []
    for c in classes:
        tp = sum(1 for label, guess in pairs if label == guess == c)
        scores.append(2 * tp / (sum(1 for label, _ in pairs if label == c) + sum(1 for _, guess in pairs if guess == c)))
    return sum(scores) / len(scores)


def test_the_entry_with_the_best_macro_f1_is_chosen(spark):
    rows = [(i, t, int(i) % 3 if int(i) % 7 else 0, "x") for i, t, _ in decisions(180)]
    train = spark.createDataFrame(rows, "id string, text string, label int, fold string")
    grid = [{"regParam": 5.0, "elasticNetParam": 1.0}, {"regParam": 0.01}, {"regParam": 0.01}]
    found = selection.select_classifier(train, grid, min_df=2, max_df=0.9)
    per_entry = {}
    for r in found.predictions.collect():
        per_entry.setdefault(r.entry, []).append((r.label, int(r.prediction)))
    assert {e: len(p) for e, p in per_entry.items()} == {0: 180, 1: 180, 2: 180}
    scores = {r.entry: r.macro_f1 for r in found.scores.collect()}
    assert all(abs(scores[e] - plain_macro_f1(p)) < 1e-9 for e, p in per_entry.items())
    assert found.best == 1 and scores[1] > scores[0]  # ties go to the earlier entry
    folds = found.predictions.groupBy("id").agg(F.countDistinct("fold").alias("n")).agg(F.max("n")).first()[0]
    assert folds == 1
    assert found.model.getRegParam() == 0.01 and found.model.numClasses == 3


def test_sums_of_a_batch_are_collected_as_columns(spark, monkeypatch):
    """Row by row, the sums of a batch cost the driver more than the batch costs a task."""
    from pyspark.sql.classic.dataframe import DataFrame as Frame

    def refused(*_):
        raise AssertionError("collected row by row")

    rows = [([0, 2], [0.5, 0.5]), ([1], [1.0]), ([], []), ([2], [0.25])]
    points = spark.createDataFrame(rows, "at array<int>, w array<double>").repartition(3)
    for name in ("toPandas", "collect"):
        monkeypatch.setattr(Frame, name, refused)
    total, count, away = minibatch._step(points, np.array([[1.0, 0.0, 0.0], [0.0, 1.0, 0.0]]))
    assert total.tolist() == [[0.5, 0.0, 0.75], [0.0, 1.0, 0.0]] and count.tolist() == [3.0, 1.0]
    assert away == pytest.approx(0.5 + 0.0 + 1.0 + 1.0625)
