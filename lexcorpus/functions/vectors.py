"""Array helpers for model scores."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def argmax(scores: Column) -> Column:
    """0-based position of the largest score; the first one on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
