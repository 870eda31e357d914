"""Counts, histograms, length statistics and vocabulary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import rules
from ..functions.bind import let
from ..functions.text import bigrams, canonicalize, tokens


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    """``(columns…, n)``."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def exploded_counts(df: DataFrame, array: str, out: str) -> DataFrame:
    """``(out, n)`` over the elements of an array column.

    The outer form keeps Catalyst from adding a size filter below, which would
    compute an array that is still an expression once more.
    """
    listed = df.select(F.explode_outer(array).alias(out))
    return value_counts(listed.where(F.col(out).isNotNull()), out)


def top_k(counts: DataFrame, k: int, key: str, by: str = "n") -> DataFrame:
    """The ``k`` largest counts; equal counts in key order."""
    return counts.orderBy(F.desc(by), F.asc(key)).limit(k)


def true_rate(column: str, places: int = 4) -> Column:
    """Share of true values, rounded."""
    return F.round(F.avg(F.col(column).cast("int")), places)


def histogram(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """``(metric, value, n)`` for several integer columns in one pass."""
    pairs = [F.struct(F.lit(m).alias("metric"), c.cast("long").alias("value")) for m, c in metrics.items()]
    return (
        df.select(F.inline(F.array(*pairs)))
        .groupBy("metric", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def stats_of_histogram(hist: DataFrame) -> DataFrame:
    """``(metric, n, mean, median, p95, min, max)`` of a histogram.

    Ranks run over distinct values, not over rows. The median is the mean of
    the middle two, p95 the value at 0-based rank ``min(n - 1, floor(0.95 n))``.
    """
    upto = F.sum("n").over(Window.partitionBy("metric").orderBy("value"))
    total = F.sum("n").over(Window.partitionBy("metric"))
    ranked = hist.where(F.col("value").isNotNull()).withColumn("upto", upto).withColumn("total", total)
    t = F.col("total")

    def at(rank: Column) -> Column:
        inside = (F.col("upto") - F.col("n") <= rank) & (rank < F.col("upto"))
        return F.max(F.when(inside, F.col("value")))

    p95 = F.least(t - 1, F.floor(t * F.lit(0.95)))
    return ranked.groupBy("metric").agg(
        F.max("total").alias("n"),
        F.round(F.sum(F.col("value") * F.col("n")) / F.sum("n"), 2).alias("mean"),
        ((at(F.floor((t - 1) / 2)) + at(F.floor(t / 2))) / 2.0).alias("median"),
        at(p95).cast("double").alias("p95"),
        F.min("value").cast("double").alias("min"),
        F.max("value").cast("double").alias("max"),
    )


def length_stats(df: DataFrame, **metrics: Column) -> DataFrame:
    """Statistics per named integer column; all 0.0 for a metric without values."""
    names = df.sparkSession.createDataFrame([(m,) for m in metrics], "metric string")
    stats = stats_of_histogram(histogram(df, metrics))
    return names.join(stats, "metric", "left").na.fill(0).select(*stats.columns)


def _terms(df: DataFrame, text: str, stop: Sequence[str]) -> Column:
    return tokens(canonicalize(F.col(text), "search"), rules.RESIDUAL_TOKENS, stop)


def term_counts(
    df: DataFrame, text: str = "text", stop: Sequence[str] = rules.RESIDUAL_STOP_WORDS
) -> DataFrame:
    """``(term, n)`` of words that are not stop words."""
    return value_counts(df.select(F.explode(_terms(df, text, stop)).alias("term")), "term")


def bigram_rows(
    df: DataFrame, text: str = "text", stop: Sequence[str] = rules.RESIDUAL_STOP_WORDS
) -> DataFrame:
    """``(bigram)``: a row for each two neighbours once stop words are out, within one text."""
    return df.select(F.explode(let(_terms(df, text, stop), bigrams)).alias("bigram"))


def bigram_counts(
    df: DataFrame, text: str = "text", stop: Sequence[str] = rules.RESIDUAL_STOP_WORDS
) -> DataFrame:
    """``(bigram, n)`` of neighbours once stop words are out, within one text."""
    return value_counts(bigram_rows(df, text, stop), "bigram")
