"""Corpus audit: silver labels, heading counts, length statistics, examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import rules
from ..functions.headings import classify_rules, extract_section, heading_hits
from ..functions.text import char_count, default_if_blank, fold_tr, head, preview, word_count
from ..operators.counts import stats_of_histogram, top_k
from ..operators.sampling import sample_exact, sample_per_group
from ..operators.schema import require_columns
from ..session import materialize

CSV_COLUMNS = (
    "id", "source", "extraction_mode", "predicted_categories", "decision_excerpt", "text_preview",
)
EXAMPLES, EXAMPLE_CHARS = 3, 320
STATS = ("mean", "median", "p95", "min", "max")


def audit_rows(df: DataFrame, id: str = "id", text: str = "text", source: str = "source") -> DataFrame:
    """One audited row per text. The text is folded once and the section cut once."""
    require_columns(df, id, text, source)
    base = df.select(
        default_if_blank(F.col(id).cast("string"), "").alias("id"),
        default_if_blank(F.col(source), "unknown").alias("source"),
        F.coalesce(text, F.lit("")).alias("_text"),
    ).withColumn("_folded", fold_tr(F.col("_text")))
    cut = base.withColumn("_s", extract_section(F.col("_folded"), folded=True))
    section = F.col("_s.section")
    return cut.select(
        "id",
        "source",
        F.col("_s.mode").alias("extraction_mode"),
        classify_rules(section).alias("predicted_categories"),
        preview(section, 500).alias("decision_excerpt"),
        preview(F.col("_folded"), 200).alias("text_preview"),
        head(section, EXAMPLE_CHARS).alias("example"),
        heading_hits(F.col("_folded"), rules.AUDIT_HEADINGS).alias("headings"),
        char_count(F.col("_text")).alias("char_length"),
        word_count(F.col("_text")).alias("word_length"),
    )


def audit_counts(rows: DataFrame) -> DataFrame:
    """``(part, key, n)``: every counter and both length histograms in one pass.

    Each row lists what it counts for; counts are merged before the shuffle, so
    the result has one row per source, heading, mode, category and length.
    """

    def one(part, key):
        return F.array(F.struct(F.lit(part).alias("part"), key.cast("string").alias("key")))

    def many(part, keys):
        return F.transform(keys, lambda k: F.struct(F.lit(part).alias("part"), k.alias("key")))

    listed = F.concat(
        one("rows", F.lit("")),
        one("source", F.col("source")),
        one("mode", F.col("extraction_mode")),
        many("heading", F.col("headings")),
        many("category", F.col("predicted_categories")),
        one("char_length", F.col("char_length")),
        one("word_length", F.col("word_length")),
    )
    return rows.select(F.inline(listed)).groupBy("part", "key").agg(F.count(F.lit(1)).alias("n"))


def _length_stats(counts: DataFrame) -> DataFrame:
    hist = counts.where(F.col("part").isin("char_length", "word_length")).select(
        F.col("part").alias("metric"), F.col("key").cast("long").alias("value"), "n"
    )
    return stats_of_histogram(hist)


def audit_metrics(rows: DataFrame, top_sources: int = 20) -> DataFrame:
    """The audit in long form: ``(metric, key, value)``."""
    counts = materialize(audit_counts(rows), "audit")
    named = counts.where(F.col("part").isin("rows", "mode", "heading", "category")).select(
        F.col("part").alias("metric"), "key", F.col("n").cast("double").alias("value")
    )
    sources = top_k(counts.where("part = 'source'"), top_sources, "key").select(
        F.lit("source_top").alias("metric"), "key", F.col("n").cast("double").alias("value")
    )
    total = counts.where("part = 'rows'").select("n").scalar()
    rates = counts.where("part = 'heading'").select(
        F.lit("heading_rate").alias("metric"), "key", F.round(F.col("n") / total, 4).alias("value")
    )
    pairs = F.array(*[F.struct(F.lit(s).alias("key"), F.col(s).alias("value")) for s in STATS])
    stats = _length_stats(counts).select("metric", F.inline(pairs))
    return named.unionByName(sources).unionByName(rates).unionByName(stats)


def category_examples(rows: DataFrame, seed: int = 42) -> DataFrame:
    """``(category, id, example)``: at most three section starts per category."""
    listed = rows.select("id", F.explode("predicted_categories").alias("category"), "example")
    return sample_per_group(listed, "category", EXAMPLES, seed, "id")


def audit_report(
    df: DataFrame,
    sample_size: int | None = None,
    seed: int = 42,
    id: str = "id",
    text: str = "text",
    source: str = "source",
    top_sources: int = 20,
) -> tuple[DataFrame, DataFrame]:
    """The report as a table of one row, and the audited rows for the CSV sink.

    The rows are written once; counters and examples read them back.
    """
    picked = df if sample_size is None else sample_exact(df, sample_size, seed, id)
    rows = materialize(audit_rows(picked, id, text, source), "audited")
    counts = materialize(audit_counts(rows), "audit")
    stats = _length_stats(counts)

    def as_map(part):
        entries = F.collect_list(F.struct("key", "n"))
        return counts.where(F.col("part") == part).agg(F.map_from_entries(entries)).scalar()

    def stat(metric):
        empty = F.struct(*[F.lit(0.0).alias(s) for s in STATS])
        return F.coalesce(stats.where(F.col("metric") == metric).select(F.struct(*STATS)).scalar(), empty)

    n_rows = F.coalesce(counts.where("part = 'rows'").select("n").scalar(), F.lit(0))
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col("key").alias("s"))))
    sources = (
        top_k(counts.where("part = 'source'"), top_sources, "key")
        .agg(F.transform(ranked, lambda r: F.struct(r["s"].alias("source"), (-r["o"]).alias("count"))))
        .scalar()
    )
    examples = (
        category_examples(rows, seed)
        .groupBy("category")
        .agg(F.sort_array(F.collect_list("example")).alias("texts"))
        .agg(F.map_from_entries(F.collect_list(F.struct("category", "texts"))))
        .scalar()
    )
    base = df.sparkSession.range(1).select(
        df.agg(F.count(F.lit(1))).scalar().alias("total_rows"),
        n_rows.alias("sample_size"),
        stat("char_length").alias("char_length_stats"),
        stat("word_length").alias("word_length_stats"),
        sources.alias("source_top_20"),
        as_map("heading").alias("heading_counts"),
        as_map("mode").alias("extraction_mode_counts"),
        as_map("category").alias("category_counts"),
        examples.alias("category_examples"),
    )
    rates = F.transform_values("heading_counts", lambda k, v: F.round(v / F.col("sample_size"), 4))
    report = base.withColumn("heading_rates", rates)
    return report, rows.select(*CSV_COLUMNS)
