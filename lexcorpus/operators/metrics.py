"""Classification metrics from one pass over the predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def confusion(
    df: DataFrame, prediction: str = "prediction", label: str = "label", by: Sequence[str] = ()
) -> DataFrame:
    """``(by…, label, prediction, n)`` of the rows that have both; see :func:`incomplete_rows` for the others."""
    known = F.col(label).isNotNull() & F.col(prediction).isNotNull()
    return df.where(known).groupBy(
        *by, F.col(label).cast("long").alias("label"), F.col(prediction).cast("long").alias("prediction")
    ).agg(F.count(F.lit(1)).alias("n"))


def incomplete_rows(df: DataFrame, prediction: str = "prediction", label: str = "label") -> DataFrame:
    """One row: how many rows lack a label, and how many only a prediction."""
    return df.agg(
        F.count_if(F.col(label).isNull()).alias("without_label"),
        F.count_if(F.col(label).isNotNull() & F.col(prediction).isNull()).alias("without_prediction"),
    )


def class_scores(
    df: DataFrame, prediction: str = "prediction", label: str = "label", by: Sequence[str] = ()
) -> DataFrame:
    """``(by…, class, tp, support, predicted, precision, recall, f1)`` for every class seen
    in labels or predictions; a score without a denominator is 0."""
    sides = F.inline(
        F.array(
            F.struct(
                F.col("label").alias("class"),
                F.col("n").alias("support"),
                F.lit(0).cast("long").alias("predicted"),
                F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("tp"),
            ),
            F.struct(
                F.col("prediction").alias("class"),
                F.lit(0).cast("long").alias("support"),
                F.col("n").alias("predicted"),
                F.lit(0).cast("long").alias("tp"),
            ),
        )
    )
    per_class = (
        confusion(df, prediction, label, by)
        .select(*by, sides)
        .groupBy(*by, "class")
        .agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))
    )

    def ratio(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    return per_class.select(
        "*",
        ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        ratio(F.col("tp"), F.col("support")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"),
    )


def classification_metrics(
    df: DataFrame, prediction: str = "prediction", label: str = "label", by: Sequence[str] = ()
) -> DataFrame:
    """One row, or one for each value of ``by``: ``(by…, rows, accuracy, macro_f1, weighted_f1)``."""
    return class_scores(df, prediction, label, by).groupBy(*by).agg(
        F.sum("support").alias("rows"),
        F.try_divide(F.sum("tp"), F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
    )
