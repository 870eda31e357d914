"""What texts without a known heading talk about."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import canonicalize, head
from ..operators.counts import bigram_counts, term_counts, top_k
from ..operators.extraction import without_headings
from ..operators.sampling import sample_exact
from ..session import materialize

TOP, EXAMPLES, EXAMPLE_CHARS = 40, 5, 500


def residual_vocabulary(
    df: DataFrame,
    sample_size: int | None = None,
    k: int = TOP,
    seed: int = 42,
    text: str = "text",
    key: str = "id",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Top terms, top bigrams and a few examples of the texts without headings.

    The heading scan reads every text once: its keys are written before the
    sample looks at them, and the sampled texts before they are counted.
    ``sample_size=None`` counts all residual texts.
    """
    rest = without_headings(df.select(key, text), text=text)
    if sample_size is None:
        picked = materialize(rest, "residual")
    else:
        keys = materialize(rest.select(key), "residual-keys")
        chosen = materialize(sample_exact(keys, sample_size, seed, key), "residual-sample")
        picked = materialize(df.select(key, text).join(chosen, key, "left_semi"), "residual")
    shown = sample_exact(picked, EXAMPLES, seed, key).select(
        key, head(canonicalize(F.col(text), "search"), EXAMPLE_CHARS).alias("example")
    )
    return (
        top_k(term_counts(picked, text), k, "term"),
        top_k(bigram_counts(picked, text), k, "bigram"),
        shown,
    )
