"""From the corpus to the test and training sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import rules
from ..functions.masking import mask_span
from ..functions.text import canonicalize, still_contains
from ..operators.counts import true_rate, value_counts
from ..operators.extraction import with_verdict
from ..operators.sampling import holdout_split, sample_exact, stratified_split
from ..operators.schema import require_columns
from ..session import materialize
from ..sources.readers import read_corpus
from ..sources.writers import write_corpus

LABELED_COLUMNS = (
    "id", "text", "label", "source", "verdict_text", "verdict_removed", "tail_cues_removed",
    "possible_leakage", "input_char_len", "verdict_char_len",
)
FINETUNE_COLUMNS = ("id", "text", "label", "source")


def prepare_datasets(
    df: DataFrame,
    n_test: int = 15_000,
    seed: int = 42,
    text: str = "text",
    key: str = "id",
    patterns=rules.STRICT,
    strict: bool = True,
) -> DataFrame:
    """Rows with a verdict of 26 to 1,500 characters and ``split`` of exact size.

    The extraction scans every text, so its result is written before the split
    looks at it three times.
    """
    extracted = materialize(with_verdict(df, text, "verdict", patterns), "extracted")
    return holdout_split(extracted, n_test, seed, key, strict)


def build_labeled_frame(
    df: DataFrame,
    assignments: DataFrame | None,
    source: str,
    text: str = "text",
    span: str = "verdict",
    key: str = "id",
    **mask_options,
) -> DataFrame:
    """Labelled rows with the verdict masked out, ten columns.

    With ``assignments(id, cluster_id)`` the rows are joined by key. When the
    rows carry ``cluster_id`` already, pass ``None``: no text is moved then.
    """
    require_columns(df, key, text, span)
    if assignments is None:
        require_columns(df, "cluster_id")
        labeled = df.select(key, text, span, "cluster_id")
    else:
        labeled = df.select(key, text, span).join(assignments.select(key, "cluster_id"), key)
    # rows without a label go before the masking; a masked text is never null
    labeled = labeled.na.drop(subset=["cluster_id"])
    masked = labeled.withColumn("_m", mask_span(F.col(text), F.col(span), **mask_options))
    return masked.select(
        F.col(key).cast("string").alias("id"),
        F.col("_m.text").alias("text"),
        F.col("cluster_id").cast("int").alias("label"),
        F.lit(source).alias("source"),
        F.col("_m.span").alias("verdict_text"),
        F.col("_m.removed").alias("verdict_removed"),
        F.col("_m.cues_removed").alias("tail_cues_removed"),
        still_contains(F.col("_m.text"), F.col("_m.span")).alias("possible_leakage"),
        F.length("_m.text").alias("input_char_len"),
        F.length("_m.span").alias("verdict_char_len"),
    )


def build_finetune_set(
    train: DataFrame,
    gold: DataFrame | None,
    assignments: DataFrame | None,
    results: DataFrame | None = None,
    fraction: float = 0.1,
    seed: int = 42,
    text: str = "text",
    span: str = "verdict",
    key: str = "id",
) -> DataFrame:
    """Labelled rows with ``split``: the training rows divided by label, gold rows in ``test``.

    ``results(id, output)`` adds the model's verdict to the gold rows.
    """
    labeled = build_labeled_frame(train, assignments, "train_regex_masked", text, span, key)
    # filtered after writing: before it, the filter would mask every text a second time
    labeled = materialize(labeled, "labeled").where(F.col("input_char_len") > 0)
    out = stratified_split(labeled, "label", fraction, seed, "id")
    if gold is None:
        return out
    test = build_labeled_frame(gold, assignments, "gold_regex_masked", text, span, key)
    if results is not None:
        llm = results.select(F.col(key).cast("string").alias("id"), F.col("output").alias("llm_verdict_text"))
        test = test.join(llm, "id", "left")
    return out.unionByName(test.withColumn("split", F.lit("test")), allowMissingColumns=True)


def write_cleaned(spark: SparkSession, source: str, target: str, text: str = "text") -> None:
    """Shards of ``source`` with ``text_clean`` and the shard name, written to ``target``."""
    rows = read_corpus(spark, source, shard=True)
    write_corpus(rows.withColumn("text_clean", canonicalize(F.col(text), null_as_empty=True)), target)


def quality_summary(df: DataFrame) -> DataFrame:
    """``(metric, key, value)``: rows per source and label, masking and leakage rates.

    One pass: the rows are counted by everything the summary needs.
    """
    counts = materialize(
        value_counts(df, "source", "label", "verdict_removed", "possible_leakage"), "quality"
    )

    def per(column):
        return counts.groupBy(column).agg(F.sum("n").cast("double").alias("value")).select(
            F.lit(f"rows_per_{column}").alias("metric"), F.col(column).cast("string").alias("key"), "value"
        )

    def rate(column):
        hits = F.sum(F.when(F.col(column), F.col("n")).otherwise(0))
        return counts.agg(F.round(F.try_divide(hits, F.sum("n")), 4).alias("value")).select(
            F.lit("rate").alias("metric"), F.lit(column).alias("key"), "value"
        )

    return (
        per("source")
        .unionByName(per("label"))
        .unionByName(rate("verdict_removed"))
        .unionByName(rate("possible_leakage"))
    )


def quality_rates(df: DataFrame, *by: str) -> DataFrame:
    """Share of rows with a removed verdict and with a possible leak, per group."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        true_rate("verdict_removed").alias("removal_rate"),
        true_rate("possible_leakage").alias("leakage_rate"),
    )


def finetune_columns(df: DataFrame) -> DataFrame:
    """The written form of the set: four columns, and ``split`` as the folder to write by."""
    return df.select(*FINETUNE_COLUMNS, "split")


def quality_rows(df: DataFrame, n: int | None = None, seed: int = 42) -> DataFrame:
    """``n`` rows (all of them when ``n`` is None) of a labelled frame for reading."""
    names = {"text": "model_input_text", "verdict_text": "removed_verdict_text"}
    shown = [F.col(c).alias(names.get(c, c)) for c in LABELED_COLUMNS]
    return (df if n is None else sample_exact(df, n, seed, "id")).select(*shown)
