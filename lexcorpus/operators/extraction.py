"""Row operators and reports around the heading functions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import rules
from ..functions.bind import let
from ..functions.headings import extract_tail, heading_hits
from ..functions.text import canonicalize
from .schema import require_columns


def keep_not_null(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Add ``value`` as ``name`` and keep the rows where it is not null.

    ``withColumn(...).where(isNotNull)`` makes Catalyst push the filter below
    the projection and compute an expensive value twice. A generator over a
    one-element array computes it once and drops the row when it is null.
    """
    found = F.filter(F.array(value), lambda v: v.isNotNull())
    others = [c for c in df.columns if c != name]
    return df.select(*others, F.explode(found).alias(name))


def with_verdict(
    df: DataFrame,
    text: str = "text",
    out: str = "verdict",
    patterns: Sequence[str] = rules.STRICT,
    max_len: int | None = rules.MAX_VERDICT_CHARS,
    keep_missing: bool = False,
) -> DataFrame:
    """Rows with the extracted operative part; rows without one only on request."""
    require_columns(df, text)
    value = extract_tail(F.col(text), patterns, max_len=max_len)
    return df.withColumn(out, value) if keep_missing else keep_not_null(df, value, out)


def extraction_rate(df: DataFrame, extracted: str = "verdict", *by: str) -> DataFrame:
    """Total, extracted and remaining rows and the rate in percent (2 places), per group."""
    total, hits = F.count(F.lit(1)), F.count(extracted)
    return df.groupBy(*by).agg(
        total.alias("total"),
        hits.alias("extracted"),
        (total - hits).alias("remaining"),
        F.round(F.try_divide(hits * 100.0, total), 2).alias("rate"),
    )


def compare_extractors(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: hits of A and of B, rows only A finds, and their lengths under A."""
    only_a = F.when(F.col(a).isNotNull() & F.col(b).isNull(), F.length(a))
    return df.select(a, b, only_a.alias("n")).agg(
        F.count(a).alias("a_count"),
        F.count(b).alias("b_count"),
        F.count("n").alias("eliminated"),
        F.round(F.avg("n"), 2).alias("mean_length"),
        F.min("n").alias("min_length"),
        F.max("n").alias("max_length"),
    )


def eliminated_rows(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows that extractor A finds and B does not, with the length under A."""
    return df.where(F.col(a).isNotNull() & F.col(b).isNull()).withColumn(
        "eliminated_length", F.length(a)
    )


def heading_prevalence(
    df: DataFrame, patterns: Mapping[str, str] = rules.COLON_HEADINGS, text: str = "text"
) -> DataFrame:
    """``(heading, n, total, rate)`` per heading and for ``any`` and ``two_or_more``.

    One pass: every row turns into the names it counts for, and the names are
    counted before the shuffle. All rows also count under ``total``.
    """
    names = [*patterns, "any", "two_or_more"]
    hits = df.select(heading_hits(canonicalize(F.col(text), "search"), patterns).alias("h"))
    keys = F.concat(
        F.array(F.lit("total")),
        F.col("h"),
        F.when(F.size("h") > 0, F.array(F.lit("any"))).otherwise(F.array()),
        F.when(F.size("h") > 1, F.array(F.lit("two_or_more"))).otherwise(F.array()),
    )
    counts = hits.select(F.explode(keys).alias("k")).groupBy("k").count()
    # a handful of names: back to one row, then one row per name
    row = counts.agg(F.map_from_entries(F.collect_list(F.struct("k", "count"))).alias("m"))
    total = F.coalesce(F.try_element_at("m", F.lit("total")), F.lit(0)).alias("total")
    return (
        row.select("m", total, F.explode(F.array(*[F.lit(n) for n in names])).alias("heading"))
        .withColumn("n", F.coalesce(F.try_element_at("m", F.col("heading")), F.lit(0)))
        .select(
            "heading",
            "n",
            "total",
            F.coalesce(F.try_divide("n", "total"), F.lit(0.0)).alias("rate"),
        )
    )


def without_headings(
    df: DataFrame, patterns: Mapping[str, str] = rules.COLON_HEADINGS, text: str = "text"
) -> DataFrame:
    """Rows whose text holds none of the headings; one alternation, one scan."""
    pattern = rules.any_of(patterns.values())
    value = let(
        F.col(text), lambda t: F.when(~canonicalize(t, "search").rlike(pattern), t)
    )
    return keep_not_null(df, value, text).select(*df.columns)
