"""Choice of a classifier's parameters by macro-F1 over folds."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from ..session import materialize, scratch_path
from .features import training_rows, vectorize, vocabulary
from .metrics import classification_metrics

FOLDS = 3
PARALLEL_FITS = 4


@dataclass
class Selection:
    """``scores``: a row per entry of the grid; ``predictions``: every row by every entry; the model of the best entry."""

    best: int
    model: LogisticRegressionModel
    terms: DataFrame
    scores: DataFrame
    predictions: DataFrame


def fold_of(key: str, folds: int, seed: int) -> Column:
    """0 to ``folds`` - 1 by a hash of the key: rows of one key are never on both sides."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(folds)).cast("int")


def select_classifier(
    train: DataFrame,
    grid: Sequence[dict],
    text: str = "text",
    label: str = "label",
    key: str = "id",
    folds: int = FOLDS,
    seed: int = 42,
    parallel: int = PARALLEL_FITS,
    **vocab_params,
) -> Selection:
    """Fits every entry of ``grid`` (parameters of the classifier) on all folds but one and predicts that one.

    The predictions of an entry over all folds give its scores; the largest macro-F1 wins, ties go to
    the earlier entry, and that entry is fitted on all rows. Texts become vectors once, and the rows a
    fold is trained on are written once for all entries. Fits run side by side, ``parallel`` at a time.
    The vocabulary is that of all rows of ``train``.
    """
    names = [F.col(key).alias("id"), F.col(text).alias("text"), F.col(label).alias("label")]
    rows = materialize(train.select(*names).withColumn("fold", fold_of("id", folds, seed)), "texts")
    terms = materialize(vocabulary(rows, "text", **vocab_params), "vocabulary")
    rows = materialize(vectorize(rows, terms, "text").drop("text"), "vectors")
    path = scratch_path(train.sparkSession, "predictions")

    def fit_one(data: DataFrame, settings: dict, entry: int, fold: int) -> None:
        model = LogisticRegression(**{**settings, **grid[entry]}).fit(data)
        out = model.transform(rows.where(F.col("fold") == fold)).select("id", "label", "prediction")
        out.write.mode("overwrite").parquet(f"{path}/entry={entry}/fold={fold}")

    with ThreadPoolExecutor(parallel) as pool:
        fits = []
        for fold in range(folds):
            data, settings = training_rows(rows.where(F.col("fold") != fold), "label")
            fits += [pool.submit(fit_one, data, settings, entry, fold) for entry in range(len(grid))]
        for fit in fits:
            fit.result()
    fields = StructType.fromDDL("prediction double, entry int, fold int").fields
    schema = StructType([*rows.select("id", "label").schema.fields, *fields])
    predictions = train.sparkSession.read.schema(schema).parquet(path)
    scores = materialize(classification_metrics(predictions, by=("entry",)), "scores")
    best = scores.orderBy(F.round("macro_f1", 9).desc(), "entry").first()["entry"]  # a row per entry
    data, settings = training_rows(rows, "label")
    return Selection(best, LogisticRegression(**{**settings, **grid[best]}).fit(data), terms, scores, predictions)
