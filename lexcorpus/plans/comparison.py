"""Side-by-side sets and reports of rule and model extraction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from .. import rules
from ..functions.text import build_prompt, preview
from ..operators.consistency import consistency, mean_score, similarity_report
from ..operators.enrichment import Model, enrich_text, repeat_runs
from ..operators.extraction import with_verdict
from ..operators.sampling import sample_exact
from ..session import materialize

RUNS = 5


def extracted_sample(
    df: DataFrame, n: int | None = None, seed: int = 42, text: str = "text", key: str = "id",
    patterns=rules.STRICT,
) -> DataFrame:
    """``n`` rows with a verdict (all of them when ``n`` is None), with ``verdict``."""
    found = with_verdict(df.select(key, text), text, "verdict", patterns, max_len=None)
    return found if n is None else sample_exact(materialize(found, "extracted"), n, seed, key)


def comparison_set(
    df: DataFrame,
    model_factory: Callable[[], Model],
    n: int | None = None,
    seed: int = 42,
    text: str = "text",
    key: str = "id",
    patterns=rules.STRICT,
    **options,
) -> DataFrame:
    """``(key, text_tail_preview, verdict, hukum_text_llm)`` for reading side by side."""
    rows = extracted_sample(df, n, seed, text, key, patterns)
    shown = rows.select(
        key,
        preview(F.col(text), 500, "right", "...").alias("text_tail_preview"),
        "verdict",
        build_prompt(F.col(text)).alias("prompt"),
    )
    shown = materialize(shown, "compared")
    # written once: a second look must not call the model again
    answers = materialize(enrich_text(shown.select(key, "prompt"), model_factory, "prompt", (key,), **options), "answers")
    llm = answers.select(key, F.col("output").alias("hukum_text_llm"))
    return shown.drop("prompt").join(llm, key, "left")


def consistency_report(
    df: DataFrame,
    model_factory: Callable[[], Model],
    n: int | None = None,
    n_runs: int = RUNS,
    seed: int = 42,
    text: str = "text",
    key: str = "id",
    method: str = "jaccard",
    patterns=rules.STRICT,
    **options,
) -> DataFrame:
    """``(key, verdict, avg_consistency_score, run_1_output … run_n_output)``.

    Outputs of the model are written once: a second look must not call it again.
    """
    rows = materialize(extracted_sample(df, n, seed, text, key, patterns), "sample")
    prompts = rows.select(key, build_prompt(F.col(text)).alias("prompt"))
    runs = materialize(repeat_runs(prompts, n_runs, model_factory, "prompt", key, **options), "runs")
    scored = consistency(runs, n_runs, key, method=method)
    return rows.select(key, "verdict").join(scored, key)


def regex_vs_model(df: DataFrame, a: str = "verdict", b: str = "hukum_text_llm", method: str = "jaccard"):
    """Rows with their similarity, and the mean of it."""
    rows = similarity_report(df, a, b, method)
    return rows, mean_score(rows, "regex_vs_llm_similarity")
