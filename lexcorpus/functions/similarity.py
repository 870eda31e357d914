"""Similarity of two text columns, 0.0 to 1.0."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType

from .bind import let
from .text import strip, words

METHODS = ("ratio", "levenshtein", "jaccard")


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks ratio; the one measure that Spark has no function for."""
    return pd.Series(
        [1.0 if x == y else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)],
        dtype="float64",
    )


def _levenshtein(a: Column, b: Column) -> Column:
    return F.lit(1.0) - F.try_divide(F.levenshtein(a, b), F.greatest(F.length(a), F.length(b)))


def word_set(c: Column) -> Column:
    return F.array_distinct(words(c))


def jaccard_of_sets(x: Column, y: Column) -> Column:
    """Overlap of two sets of words; 0.0 when both are empty."""
    share = let(
        F.size(F.array_intersect(x, y)), lambda n: F.try_divide(n, F.size(x) + F.size(y) - n)
    )
    return F.coalesce(share, F.lit(0.0))


def _jaccard(a: Column, b: Column) -> Column:
    return let(word_set(a), lambda x: let(word_set(b), lambda y: jaccard_of_sets(x, y)))


def similarity(a: Column, b: Column, method: str = "jaccard", stripped: bool = True) -> Column:
    """Similarity that is 0.0 whenever a side is null or empty, also when both are."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}, expected one of {METHODS}")
    a, b = (F.coalesce(x, F.lit("")) for x in (a, b))
    if stripped:
        a, b = strip(a), strip(b)
    if method == "ratio":
        score = _ratio(a, b)
    elif method == "levenshtein":
        score = _levenshtein(a, b)
    else:
        score = _jaccard(a, b)
    return (
        F.when((a == "") | (b == ""), F.lit(0.0))
        .when(a == b, F.lit(1.0))
        .otherwise(F.coalesce(score, F.lit(0.0)))
    )
