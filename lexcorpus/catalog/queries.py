"""One query per operator over the test tables. Each reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import rules
from ..functions import text as T
from ..functions.headings import classify_rules, extract_section, heading_hits
from ..functions.masking import mask_span, strip_trailing_cues
from ..functions.vectors import argmax
from ..operators import consistency as agree
from ..operators import counts, enrichment, extraction, features, labels, metrics, minibatch, sampling, selection, selection_stats
from ..plans import audit, categorize, comparison, datasets, vocabulary
from ..plans.category_model import CategoryModel, fit_category_model
from ..session import materialize, scratch_path
from ..sources import readers, writers
from ..sources.result_store import ResultStore
from ..streaming import jobs
from .corpus import assignments, corpus, rendered, source_clusters, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Words left out by run 1..5 of the stand-in for a model that varies.
RUN_WORDS = ("the", "of", "and", "to", "in")
ECHO_CHARS = 300
# Size of the sampled vocabulary report; the sample is its feature.
RESIDUAL_ROWS = 1000


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def echo_model() -> enrichment.Model:
    """Stand-in for a text model: the end of the prompt."""
    return lambda prompt: prompt[-ECHO_CHARS:]


def six(c: Column | str) -> Column:
    return F.round(c, 6)


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.with_verdict(corpus(spark, sf_dir))


# -- text ------------------------------------------------------------------


@query
def canonical_lengths(spark, sf_dir):
    c = F.col("text")
    return corpus(spark, sf_dir).select(
        "id",
        *[T.char_count(T.canonicalize(c, level)).alias(f"{level}_chars") for level in T.LEVELS],
        T.word_count(c).alias("words"),
    )


@query
def canonical_text(spark, sf_dir):
    c = F.col("text")
    return corpus(spark, sf_dir).select(
        "id",
        *[F.md5(T.canonicalize(c, level)).alias(f"{level}_md5") for level in T.LEVELS],
        F.md5(T.fold_tr(c)).alias("folded_md5"),
    )


@query
def prompts_and_previews(spark, sf_dir):
    c = F.col("text")
    return corpus(spark, sf_dir).select(
        "id",
        F.md5(T.build_prompt(c)).alias("prompt_md5"),
        T.preview(c, 50, "right", "...").alias("tail_preview"),
        T.preview(c, 50).alias("head_preview"),
    )


@query
def cleaned_labels(spark, sf_dir):
    raw = F.concat(F.lit(' "Kategori: '), F.col("source"), F.lit("'s\"\n"))
    return corpus(spark, sf_dir).select("id", T.clean_label(raw).alias("name"))


@query
def token_budget(spark, sf_dir):
    cut = corpus(spark, sf_dir).withColumn("b", T.token_budget(F.col("text"), 512))
    return cut.select(
        "id", "b.n_tokens", "b.truncated", F.md5(F.array_join("b.tokens", " ")).alias("tokens_md5")
    )


# -- extraction ------------------------------------------------------------


@query
def extraction_rate_by_source(spark, sf_dir):
    rows = extraction.with_verdict(corpus(spark, sf_dir), keep_missing=True)
    return extraction.extraction_rate(rows, "verdict", "source")


@query
def extract_tail_rows(spark, sf_dir):
    return extraction.with_verdict(corpus(spark, sf_dir), max_len=None).select("id", "verdict")


@query
def extract_bounded_rows(spark, sf_dir):
    return verdicts(spark, sf_dir).select("id", "verdict")


def _both(spark, sf_dir):
    rows = extraction.with_verdict(corpus(spark, sf_dir), out="a", max_len=None, keep_missing=True)
    return extraction.with_verdict(rows, out="b", keep_missing=True)


@query
def compare_extractors(spark, sf_dir):
    return extraction.compare_extractors(_both(spark, sf_dir), "a", "b")


@query
def eliminated_sample(spark, sf_dir):
    gone = extraction.eliminated_rows(_both(spark, sf_dir), "a", "b")
    gone = materialize(gone.select("id", "eliminated_length"), "eliminated")
    return sampling.sample_exact(gone, 20)


@query
def section_rows(spark, sf_dir):
    cut = corpus(spark, sf_dir).withColumn("s", extract_section(F.col("text")))
    return cut.select("id", "s.mode", F.md5("s.section").alias("section_md5"))


@query
def section_modes(spark, sf_dir):
    return counts.value_counts(
        corpus(spark, sf_dir).select(extract_section(F.col("text"))["mode"].alias("mode")), "mode"
    )


@query
def rule_categories(spark, sf_dir):
    found = classify_rules(extract_section(F.col("text"))["section"])
    return counts.exploded_counts(corpus(spark, sf_dir).select(found.alias("c")), "c", "category")


@query
def heading_flags(spark, sf_dir):
    hits = heading_hits(T.fold_tr(F.col("text")), rules.AUDIT_HEADINGS)
    return corpus(spark, sf_dir).select("id", F.array_join(hits, "|").alias("headings"))


@query
def heading_prevalence(spark, sf_dir):
    out = extraction.heading_prevalence(corpus(spark, sf_dir))
    return out.withColumn("rate", six("rate"))


@query
def residual_prevalence(spark, sf_dir):
    rest = extraction.without_headings(corpus(spark, sf_dir))
    out = extraction.heading_prevalence(rest, rules.SPACED_HEADINGS)
    return out.withColumn("rate", six("rate"))


@query
def residual_terms(spark, sf_dir):
    rest = extraction.without_headings(corpus(spark, sf_dir))
    return counts.top_k(counts.term_counts(rest), 40, "term")


@query
def residual_bigrams(spark, sf_dir):
    rest = extraction.without_headings(corpus(spark, sf_dir))
    return counts.top_k(counts.bigram_counts(rest), 40, "bigram")


@query
def residual_sample_terms(spark, sf_dir):
    """Vocabulary of a sample of the texts without headings."""
    terms, _, _ = vocabulary.residual_vocabulary(corpus(spark, sf_dir), RESIDUAL_ROWS)
    return terms


@query
def residual_sample_examples(spark, sf_dir):
    return vocabulary.residual_vocabulary(corpus(spark, sf_dir), RESIDUAL_ROWS)[2]


# -- masking ---------------------------------------------------------------


@query
def mask_rows(spark, sf_dir):
    rows = extraction.with_verdict(corpus(spark, sf_dir), keep_missing=True)
    masked = rows.withColumn("m", mask_span(F.col("text"), F.col("verdict")))
    return masked.select(
        "id",
        F.md5("m.text").alias("text_md5"),
        F.length("m.text").alias("chars"),
        "m.removed",
        "m.cues_removed",
        T.still_contains(F.col("m.text"), F.col("m.span")).alias("leak"),
    )


@query
def trailing_cue_rows(spark, sf_dir):
    rows = corpus(spark, sf_dir).withColumn("m", strip_trailing_cues(F.col("text")))
    return rows.select("id", F.md5("m.text").alias("text_md5"), "m.changed")


def _labeled(spark, sf_dir):
    return datasets.build_labeled_frame(verdicts(spark, sf_dir), assignments(spark, sf_dir), "train_regex_masked")


@query
def labeled_frame(spark, sf_dir):
    return _labeled(spark, sf_dir)


@query
def leakage_rate(spark, sf_dir):
    return datasets.quality_rates(_labeled(spark, sf_dir), "label")


# -- counts and statistics -------------------------------------------------


@query
def length_stats(spark, sf_dir):
    c = F.col("text")
    return counts.length_stats(corpus(spark, sf_dir), chars=T.char_count(c), words=T.word_count(c))


@query
def price_stats(spark, sf_dir):
    """Statistics of columns with very many values."""
    rows = table(spark, sf_dir, "lineitem")
    return selection_stats.numeric_stats(rows, price=F.col("l_extendedprice"), quantity=F.col("l_quantity"), order=F.col("l_orderkey"))


@query
def residual_bigrams_top(spark, sf_dir):
    """The most frequent bigrams without a count of all of them."""
    rest = extraction.without_headings(corpus(spark, sf_dir))
    grams = materialize(counts.bigram_rows(rest), "bigrams")
    return selection_stats.exact_top_k(grams, "bigram", 40)


@query
def value_counts(spark, sf_dir):
    return counts.value_counts(table(spark, sf_dir, "documents"), "source", "lang")


@query
def top_sources(spark, sf_dir):
    n = counts.value_counts(table(spark, sf_dir, "pages").select(F.parse_url("url", F.lit("HOST")).alias("host")), "host")
    return counts.top_k(n, 20, "host")


@query
def audit_metrics(spark, sf_dir):
    return audit.audit_metrics(audit.audit_rows(corpus(spark, sf_dir)))


@query
def audit_predictions(spark, sf_dir):
    rows = audit.audit_rows(corpus(spark, sf_dir)).select(*audit.CSV_COLUMNS)
    return rows.withColumn("predicted_categories", F.array_join("predicted_categories", "|"))


@query
def audit_examples(spark, sf_dir):
    rows = materialize(audit.audit_rows(corpus(spark, sf_dir)), "audited")
    return audit.category_examples(rows)


@query
def audit_report(spark, sf_dir):
    """The report over the whole corpus, written as JSON and read back; every part of it."""
    report, _ = audit.audit_report(corpus(spark, sf_dir))
    path = scratch_path(spark, "report")
    writers.write_json_report(report, path)

    def listed(entries, text):
        return F.array_join(F.array_sort(F.transform(entries, text)), "|")

    def entries(name):
        return F.map_entries(F.from_json(F.to_json(name), "map<string,string>"))

    back = spark.read.schema(report.schema).json(path)
    stats = [
        F.col(f"{part}_length_stats.{name}").alias(f"{part}_{name}") for part in ("char", "word") for name in audit.STATS
    ]
    return back.select(
        "total_rows",
        "sample_size",
        *stats,
        F.array_join(F.transform("source_top_20", lambda x: F.concat(x["source"], F.lit("="), x["count"])), "|").alias("sources"),
        *[
            listed(entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"])).alias(c)
            for c in ("heading_counts", "extraction_mode_counts", "category_counts")
        ],
        listed(
            F.map_entries("heading_rates"), lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"] * 10000).cast("int"))
        ).alias("heading_rates"),
        F.md5(
            listed(F.map_entries("category_examples"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ";")))
        ).alias("examples_md5"),
    )


@query
def quality_summary(spark, sf_dir):
    return datasets.quality_summary(_labeled(spark, sf_dir))


@query
def quality_summary_all(spark, sf_dir):
    """Training and gold rows together."""
    return datasets.quality_summary(_finetune(spark, sf_dir))


@query
def quality_rows(spark, sf_dir):
    out = datasets.quality_rows(_labeled(spark, sf_dir))
    return out.select("id", "label", F.md5("model_input_text").alias("text_md5"), F.md5("removed_verdict_text").alias("span_md5"))


# -- samples and splits ----------------------------------------------------


@query
def sample_exact(spark, sf_dir):
    return sampling.sample_exact(corpus(spark, sf_dir).select("id", "source"), 150)


@query
def slice_rows(spark, sf_dir):
    return sampling.slice_rows(corpus(spark, sf_dir).select("id", "source"), 50, 125)


@query
def shuffle_rows(spark, sf_dir):
    return sampling.shuffle_rows(corpus(spark, sf_dir).select("id", "source"))


@query
def holdout_split(spark, sf_dir):
    return datasets.prepare_datasets(corpus(spark, sf_dir), 50).select("id", "source", "verdict", "split")


@query
def stratified_split(spark, sf_dir):
    rows = assignments(spark, sf_dir)
    return sampling.stratified_split(rows, "cluster_id")


@query
def sample_per_group(spark, sf_dir):
    return sampling.sample_per_group(corpus(spark, sf_dir).select("id", "source"), "source", 10)


@query
def sample_per_group_large(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return sampling.sample_per_group(rows, "l_returnflag", 2000, 42, ("l_orderkey", "l_linenumber"))


@query
def sample_per_group_nulls(spark, sf_dir):
    """A null group is sampled like the others."""
    flag = F.nullif(F.col("l_returnflag"), F.lit("R")).alias("flag")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", flag)
    return sampling.sample_per_group(rows, "flag", 700, 42, ("l_orderkey", "l_linenumber"))


@query
def sample_exact_repeated_keys(spark, sf_dir):
    """The key has three values; the size is exact all the same."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return sampling.sample_exact(rows, 50, 42, "role")


@query
def stratified_split_many_labels(spark, sf_dir):
    """Labels of a few rows each still give the whole share."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 400).alias("label"))
    return sampling.stratified_split(rows, "label")


# Columns of ``orders`` under the names that samples use for their intermediate values.
OWN_NAMES = {
    "id": "o_orderkey", "cut": "o_custkey", "n": "o_orderstatus", "need": "o_totalprice", "equal": "o_orderdate",
    "b": "o_orderpriority", "o": "o_orderkey", "first": "o_custkey", "_first": "o_orderstatus", "place": "o_totalprice",
    "g0": "o_orderpriority", "same_g0": "o_orderkey", "wanted": "o_custkey", "upto": "o_orderstatus",
}


def _own_names(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(*[F.col(c).alias(n) for n, c in OWN_NAMES.items()])


@query
def sample_exact_own_names(spark, sf_dir):
    return sampling.sample_exact(_own_names(spark, sf_dir), 700)


@query
def sample_ties_own_names(spark, sf_dir):
    """The key has a few values, so the last rows are chosen among equal keys: the size and the columns are right."""
    out = sampling.sample_exact(_own_names(spark, sf_dir), 700, 42, "b")
    wrong = F.count_if((F.col("o") != F.col("id")) | (F.col("first") != F.col("cut")) | (F.col("g0") != F.col("b")))
    return out.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("id").alias("ids"), wrong.alias("wrong"))


@query
def slice_rows_own_names(spark, sf_dir):
    return sampling.slice_rows(_own_names(spark, sf_dir), 100, 400)


@query
def sample_per_group_own_names(spark, sf_dir):
    return sampling.sample_per_group(_own_names(spark, sf_dir), "n", 50)


@query
def stratified_split_own_names(spark, sf_dir):
    return sampling.stratified_split(_own_names(spark, sf_dir), "b")


# -- labels ----------------------------------------------------------------


@query
def label_lookup(spark, sf_dir):
    clusters = source_clusters(spark, sf_dir)
    names = materialize(clusters.select("cluster_id", "name").distinct(), "clusters")
    rows = corpus(spark, sf_dir).select("id", "source")
    return labels.lookup_names(labels.lookup_labels(rows, clusters), names)


@query
def labeled_and_unlabeled(spark, sf_dir):
    rows = corpus(spark, sf_dir).select("id", "source")
    known = assignments(spark, sf_dir)
    return labels.union_tagged("side", labeled=labels.members(rows, known), other=labels.complement(rows, known))


@query
def union_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.length("text").alias("chars"), "lang")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.length("html").alias("chars"))
    return labels.union_tagged("origin", documents=docs, pages=pages)


@query
def reindex_labels(spark, sf_dir):
    return labels.reindex_labels(assignments(spark, sf_dir), "cluster_id")


@query
def distinct_labels(spark, sf_dir):
    """Labels of two sets together."""
    train = assignments(spark, sf_dir).select(F.col("cluster_id").alias("label"))
    test = table(spark, sf_dir, "embeddings").select("label")
    return labels.distinct_labels(train.union(test))


@query
def class_weights(spark, sf_dir):
    out = labels.class_weights(assignments(spark, sf_dir), "cluster_id", 8)
    return out.withColumn("weight", six("weight"))


@query
def label_names(spark, sf_dir):
    clusters = materialize(source_clusters(spark, sf_dir).select("cluster_id", "name").distinct(), "clusters")
    known = labels.distinct_labels(assignments(spark, sf_dir), "cluster_id")
    named = clusters.where(F.contains("name", F.lit(rules.MERGE_KEYWORD)))
    return labels.label_names(known.withColumnRenamed("cluster_id", "label"), named)


def _merged(spark, sf_dir):
    clusters = source_clusters(spark, sf_dir)
    names = materialize(clusters.select("cluster_id", "name").distinct(), "clusters")
    return labels.merge_clusters(names, clusters.select("id", "cluster_id"))


@query
def merge_clusters(spark, sf_dir):
    return _merged(spark, sf_dir)[0]


@query
def merged_assignments(spark, sf_dir):
    return _merged(spark, sf_dir)[1]


@query
def merge_clusters_unchanged(spark, sf_dir):
    """No two clusters have one name: ids and names stay, also the one that holds the keyword."""
    clusters = source_clusters(spark, sf_dir)
    number = F.col("cluster_id").cast("string")
    named = F.when(F.col("cluster_id") == 1, F.lit("x Temyiz")).otherwise(F.concat(F.lit("Grup "), number))
    names = materialize(clusters.select("cluster_id", named.alias("name")).distinct(), "clusters")
    merged, moved = labels.merge_clusters(names, clusters.select("id", "cluster_id"))
    return labels.lookup_names(moved, merged)


@query
def label_ids(spark, sf_dir):
    """From the name of a label back to the label."""
    known = labels.distinct_labels(assignments(spark, sf_dir), "cluster_id").withColumnRenamed("cluster_id", "label")
    named = known.sparkSession.createDataFrame([(0, "sıfır"), (5, "beş")], "cluster_id int, name string")
    return labels.label_ids(labels.label_names(known, named))


# -- similarity and runs ---------------------------------------------------


def _without(word: str, c: Column) -> Column:
    return F.replace(c, F.lit(f" {word} "), F.lit(" "))


def _two_texts(spark, sf_dir):
    text = F.col("verdict")
    return verdicts(spark, sf_dir).select(
        "id", text.alias("a"), _without(RUN_WORDS[0], _without(RUN_WORDS[1], text)).alias("b")
    )


@query
def similarity_levenshtein(spark, sf_dir):
    out = agree.similarity_report(_two_texts(spark, sf_dir), "a", "b", "levenshtein", "score")
    return out.select("id", six("score").alias("score"))


@query
def similarity_jaccard(spark, sf_dir):
    out = agree.similarity_report(_two_texts(spark, sf_dir), "a", "b", "jaccard", "score")
    return out.select("id", six("score").alias("score"))


@query
def similarity_ratio(spark, sf_dir):
    out = agree.similarity_report(_two_texts(spark, sf_dir), "a", "b", "ratio", "score")
    return out.select("id", six("score").alias("score"))


@query
def mean_similarity(spark, sf_dir):
    out = agree.similarity_report(_two_texts(spark, sf_dir), "a", "b", "jaccard", "score")
    return agree.mean_score(out, "score")


def _runs(spark, sf_dir):
    """Five outputs per verdict; run i leaves out one frequent word, run 5 is missing for short texts."""
    text = F.col("verdict")
    outputs = [
        F.struct(F.lit(i).alias("run"), _without(w, text).alias("output"))
        for i, w in enumerate(RUN_WORDS, 1)
    ]
    rows = verdicts(spark, sf_dir).select("id", "verdict", F.inline(F.array(*outputs)))
    return rows.where((F.col("run") < 5) | (F.length("verdict") > 300)).select("id", "run", "output")


@query
def runs_wide(spark, sf_dir):
    wide = agree.runs_wide(_runs(spark, sf_dir), 5)
    return wide.select("id", *[F.md5(c).alias(c) for c in wide.columns if c != "id"])


@query
def run_consistency(spark, sf_dir):
    out = agree.consistency(_runs(spark, sf_dir), 5, method="jaccard")
    return out.select("id", six("avg_consistency_score").alias("avg_consistency_score"))


# -- model-backed columns --------------------------------------------------


def _known(spark, sf_dir):
    return assignments(spark, sf_dir).select("id", F.lit("ok").alias("status"))


@query
def pending_records(spark, sf_dir):
    return enrichment.pending(corpus(spark, sf_dir).select("id", "source"), _known(spark, sf_dir))


@query
def repeat_runs(spark, sf_dir):
    rows = corpus(spark, sf_dir).select("id", T.build_prompt(F.col("text")).alias("prompt"))
    runs = enrichment.repeat_runs(rows, 2, echo_model, "prompt")
    return runs.select("id", "run", F.md5("output").alias("output_md5"), "status", "attempts")


@query
def enrich_resume(spark, sf_dir):
    """Labelled rows first, then all rows: the second batch runs only what is missing."""
    rows = corpus(spark, sf_dir).select("id", T.build_prompt(F.col("text")).alias("prompt"))
    path = scratch_path(spark, "results")
    first = labels.members(rows, assignments(spark, sf_dir))
    enrichment.enrich_incremental(first, path, echo_model, "first", "prompt")
    out = enrichment.enrich_incremental(rows, path, echo_model, "second", "prompt")
    batch = enrichment.read_prior(spark, path, enrichment.result_schema(rows)).select("id", "batch")
    named = F.regexp_replace("batch", "-[0-9]+$", "").alias("batch")  # without the number of the chunk
    return out.join(batch, "id").select("id", F.md5("output").alias("output_md5"), "status", named)


@query
def enrich_bucketed(spark, sf_dir):
    """Two batches against a bucketed store, which is then compacted and opened anew."""
    rows = corpus(spark, sf_dir).select("id", T.build_prompt(F.col("text")).alias("prompt"))
    path = scratch_path(spark, "store")
    store = ResultStore(rows, path)
    enrichment.enrich_bucketed(labels.members(rows, assignments(spark, sf_dir)), store, echo_model, "first", "prompt")
    enrichment.enrich_bucketed(rows, store, echo_model, "second", "prompt")
    batch = materialize(store.history().select("id", F.regexp_replace("batch", "-[0-9]+$", "").alias("batch")), "batches")
    store.compact("all")
    store.forget()
    out = ResultStore(rows, path).joined(rows.select("id"))
    return out.join(batch, "id").select("id", F.md5("output").alias("output_md5"), "status", "batch")


@query
def comparison_set(spark, sf_dir):
    out = comparison.comparison_set(corpus(spark, sf_dir), echo_model, n=100)
    return out.select("id", "text_tail_preview", "verdict", "hukum_text_llm")


@query
def consistency_report(spark, sf_dir):
    out = comparison.consistency_report(corpus(spark, sf_dir), echo_model, n=100, n_runs=5)
    return out.select("id", "verdict", "avg_consistency_score", F.md5("run_5_output").alias("run_5_md5"))


# -- features, clusters, classifier ----------------------------------------


@query
def tfidf_vocabulary(spark, sf_dir):
    out = features.vocabulary(verdicts(spark, sf_dir))
    return out.withColumn("idf", six("idf"))


@query
def tfidf_weights(spark, sf_dir):
    rows = materialize(verdicts(spark, sf_dir).select("id", "verdict"), "verdicts")
    out = features.tfidf_weights(rows, features.vocabulary(rows))
    return out.withColumn("weight", six("weight"))


@query
def tfidf_vectors(spark, sf_dir):
    rows = materialize(verdicts(spark, sf_dir).select("id", "verdict"), "verdicts")
    vocab = materialize(features.vocabulary(rows), "vocabulary")
    out = features.vectorize(rows, vocab).select("id", F.unwrap_udt("features").alias("v"))
    long = out.select("id", F.inline(F.arrays_zip(F.col("v.indices").alias("idx"), F.col("v.values").alias("w"))))
    return long.groupBy("id").agg(
        F.count(F.lit(1)).alias("terms"), six(F.sum("w")).alias("total"), F.max("idx").alias("last_idx")
    )


@query
def cluster_sizes(spark, sf_dir):
    rows = materialize(verdicts(spark, sf_dir).select("id", "verdict"), "verdicts")
    out, _, _ = categorize.categorize(rows)
    return counts.value_counts(out, "cluster_id", "category")


@query
def cluster_names(spark, sf_dir):
    rows = materialize(verdicts(spark, sf_dir).select("id", "verdict"), "verdicts")
    _, clusters, _ = categorize.categorize(rows, labeler=lambda texts: f'"Kategori: {len(texts)} {min(texts)[:20]}"')
    return clusters


@query
def cluster_prompt_names(spark, sf_dir):
    """Known clusters named by a model that answers with a part of its prompt."""
    rows = corpus(spark, sf_dir).join(assignments(spark, sf_dir), "id")
    samples = materialize(sampling.sample_per_group(rows, "cluster_id", categorize.SAMPLES_PER_CLUSTER), "samples")
    named = enrichment.name_clusters_by_prompt(samples, lambda: lambda prompt: f'"Kategori: {prompt[-200:]}"\n')
    prompts = enrichment.naming_prompts(samples)
    return named.join(prompts, "cluster_id").select("cluster_id", "name", F.md5("prompt").alias("prompt_md5"))


@query
def categorize_from_map(spark, sf_dir):
    clusters, assigned = _merged(spark, sf_dir)
    out, _, _ = categorize.categorize(corpus(spark, sf_dir).select("id", "source"), (clusters, assigned))
    return out


@query
def classification_metrics(spark, sf_dir):
    scored = table(spark, sf_dir, "embeddings").select(
        argmax(F.col("embedding")).alias("prediction"), "label"
    )
    out = metrics.classification_metrics(scored)
    return out.select("rows", *[six(c).alias(c) for c in ("accuracy", "macro_f1", "weighted_f1")])


@query
def class_scores(spark, sf_dir):
    scored = table(spark, sf_dir, "embeddings").select(
        argmax(F.col("embedding")).alias("prediction"), "label"
    )
    out = metrics.class_scores(scored)
    return out.select(
        "class", "tp", "support", "predicted", *[six(c).alias(c) for c in ("precision", "recall", "f1")]
    )


@query
def cluster_check(spark, sf_dir):
    """Every row has one of the ten clusters and its name."""
    rows = materialize(verdicts(spark, sf_dir).select("id", "verdict"), "verdicts")
    out, _, _ = categorize.categorize(rows)
    return out.agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("id").alias("ids"),
        F.count_if(~F.coalesce(F.col("cluster_id").between(0, 9), F.lit(False))).alias("outside"),
        F.count_if(F.coalesce("category", F.lit("")) == "").alias("unnamed"),
    )


@query
def classifier_check(spark, sf_dir):
    """Rows that were predicted, and whether the reported accuracy is the one of the predictions."""
    scored = materialize(_predicted(spark, sf_dir).select("prediction", "label"), "scored")
    accuracy = metrics.classification_metrics(scored).select("accuracy").scalar()
    hits = F.avg((F.col("prediction") == F.col("label")).cast("double"))
    return scored.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("prediction").isNull() | (F.col("prediction") < 0)).alias("outside"),
        (F.abs(hits - accuracy) < 1e-9).alias("same_accuracy"),
    )


def _not_nearest(spark, path: str, rows: DataFrame) -> DataFrame:
    """Of ``rows(id, verdict, cluster_id, category)``: how many, how many are not at the nearest center of the
    saved model, and how many lack its name; distances by joins of weights with the written centers."""
    read = {n: spark.read.parquet(f"{path}/{n}") for n in ("terms", "centers", "clusters")}
    weights = features.tfidf_weights(rows, read["terms"]).join(read["terms"].select("term", "idx"), "term")
    dots = weights.join(read["centers"].withColumnRenamed("weight", "c"), "idx")
    dots = dots.groupBy("id", "cluster_id").agg(F.sum(F.col("weight") * F.col("c")).alias("dot"))
    norms = read["centers"].groupBy("cluster_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("norm"))
    norms = read["clusters"].join(norms, "cluster_id", "left").na.fill(0.0, ["norm"])  # a row per center
    listed = rows.select("id", F.col("cluster_id").alias("own"), "category").join(
        norms.agg(F.collect_list(F.struct("cluster_id", "norm", "name")).alias("centers")), how="cross"  # one row
    )
    every = listed.select("id", "own", "category", F.inline("centers")).join(dots, ["id", "cluster_id"], "left")
    away = F.col("norm") - 2 * F.coalesce("dot", F.lit(0.0))
    judged = every.groupBy("id").agg(
        F.min(away).alias("least"),
        F.max(F.when(F.col("own") == F.col("cluster_id"), away)).alias("taken"),
        F.max((F.col("own") == F.col("cluster_id")) & F.col("category").eqNullSafe(F.col("name"))).alias("named"),
    )
    return judged.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.coalesce(F.col("taken") > F.col("least") + 1e-9, F.lit(True))).alias("wrong"),
        F.count_if(~F.col("named")).alias("unnamed"),
    )


def _saved_check(spark, sf_dir, method: str, fitted: Callable[[DataFrame], DataFrame]) -> DataFrame:
    rows = materialize(verdicts(spark, sf_dir).select("id", "verdict"), "verdicts")
    path = scratch_path(spark, "model")
    fit_category_model(fitted(rows), method=method).save(path)
    out = CategoryModel.load(spark, path).categorize(rows)
    return _not_nearest(spark, path, materialize(out, "categorized"))


@query
def categorize_saved(spark, sf_dir):
    """A model of half of the rows, saved and loaded, assigns all rows; checked against its written centers."""
    return _saved_check(spark, sf_dir, "minibatch", lambda rows: sampling.share_rows(rows, 0, 2))


@query
def cluster_nearest_check(spark, sf_dir):
    """The full fit: every row is at the nearest of the written centers."""
    return _saved_check(spark, sf_dir, "full", lambda rows: rows)


@query
def minibatch_check(spark, sf_dir):
    """Mini-batch centers are the same in another partitioning, and about as good as those of the full fit."""
    rows = materialize(verdicts(spark, sf_dir).select("id", "verdict"), "verdicts")
    terms = materialize(features.vocabulary(rows), "vocabulary")
    vectors = materialize(features.vectorize(rows, terms).select("id", "features"), "vectors")
    size = terms.count()
    quick, again = (minibatch.fit_minibatch(v, size) for v in (vectors, vectors.repartition(5, "id")))
    full = np.array(features.fit_clusters(vectors).clusterCenters())
    good = minibatch.inertia(vectors, quick) <= 1.05 * minibatch.inertia(vectors, full)
    return vectors.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(quick)).alias("centers"),
        F.lit(bool(np.array_equal(quick, again))).alias("same"),
        F.lit(bool(good)).alias("within_5_percent"),
    )


GRID = ({"regParam": 0.001}, {"regParam": 0.01}, {"regParam": 0.3, "elasticNetParam": 0.5})


def _classified(spark, sf_dir):
    """Written before the labels are numbered and empty texts left out: either would extract and mask all texts again."""
    masked = materialize(_labeled(spark, sf_dir).select("id", "verdict_text", "label"), "masked")
    return materialize(labels.reindex_labels(masked).where(F.length("verdict_text") > 0), "labeled")


@query
def classifier_selection(spark, sf_dir):
    """Scores of all entries recomputed from the written predictions, and whether the best one was taken."""
    found = selection.select_classifier(_classified(spark, sf_dir), GRID, "verdict_text", min_df=2)
    guess, label = F.col("prediction").cast("int"), F.col("label")
    classes = F.explode(F.array_distinct(F.array(label, guess))).alias("class")
    per_class = found.predictions.select("entry", label.alias("l"), guess.alias("p"), classes).groupBy("entry", "class").agg(
        (2 * F.count_if((F.col("l") == F.col("class")) & (F.col("p") == F.col("class")))
         / (F.count_if(F.col("l") == F.col("class")) + F.count_if(F.col("p") == F.col("class")))).alias("f1")
    )
    again = per_class.groupBy("entry").agg(F.avg("f1").alias("again"))
    scores = found.scores.join(again, "entry")
    best = F.max_by("entry", F.struct(F.round("again", 9), -F.col("entry"))) == F.lit(found.best)
    return scores.agg(
        F.sum("rows").alias("predicted"),
        F.count(F.lit(1)).alias("entries"),
        F.count_if(F.abs(F.col("again") - F.col("macro_f1")) > 1e-9).alias("wrong"),
        best.alias("best_taken"),
    )


@query
def classifier_fit_check(spark, sf_dir):
    """At the optimum the weighted probabilities of a class add up to the weight of its rows."""
    rows = _classified(spark, sf_dir)
    terms = materialize(features.vocabulary(rows, "verdict_text", min_df=2), "vocabulary")
    vectors = materialize(features.vectorize(rows, terms, "verdict_text"), "vectors")
    model = features.fit_classifier(vectors, maxIter=300, tol=1e-9)
    weights = labels.class_weights(vectors).select("label", "weight")
    scored = model.transform(vectors.join(weights, "label")).select("label", "weight", vector_to_array("probability").alias("p"))
    long = scored.select("label", "weight", F.posexplode("p").alias("class", "share"))
    gap = F.sum(F.col("weight") * (F.col("share") - (F.col("class") == F.col("label")).cast("double")))
    per_class = long.groupBy("class").agg((F.abs(gap) / F.sum("weight")).alias("gap"), F.count(F.lit(1)).alias("n"))
    return per_class.agg(F.max("n").alias("rows"), F.count(F.lit(1)).alias("classes"), F.count_if(F.col("gap") > 1e-3).alias("off"))


def _predicted(spark, sf_dir):
    split = materialize(sampling.stratified_split(_classified(spark, sf_dir), "label"), "split")
    train, test = (split.where(F.col("split") == s) for s in ("train", "test"))
    scored, _ = features.train_text_classifier(train, test, "verdict_text", min_df=2)
    return scored


@query
def classifier_eval(spark, sf_dir):
    return metrics.classification_metrics(_predicted(spark, sf_dir))


# -- whole flows, sources and sinks ----------------------------------------


def _finetune(spark, sf_dir):
    sets = materialize(datasets.prepare_datasets(corpus(spark, sf_dir), 50), "sets")
    train, gold = (sets.where(F.col("split") == s).drop("split") for s in ("train", "test"))
    results = gold.select("id", F.left("verdict", F.lit(20)).alias("output"))
    return datasets.build_finetune_set(train, gold, assignments(spark, sf_dir), results)


@query
def finetune_set(spark, sf_dir):
    return _finetune(spark, sf_dir).select(
        "id", "label", "source", "split", "verdict_removed", "tail_cues_removed", "possible_leakage",
        F.md5("text").alias("text_md5"), "llm_verdict_text",
    )


@query
def finetune_written(spark, sf_dir):
    """The set as it is handed over: four columns in one folder per split, read back."""
    path = scratch_path(spark, "finetune")
    writers.write_corpus(datasets.finetune_columns(_finetune(spark, sf_dir)), path, "split")
    back = readers.read_corpus(spark, path)
    return back.select("id", F.md5("text").alias("text_md5"), "label", "source", "split")


@query
def cleaned_shards(spark, sf_dir):
    """Shards with their canonical text beside the text; every row keeps the name of its shard."""
    shards, cleaned = scratch_path(spark, "shards"), scratch_path(spark, "cleaned")
    writers.write_corpus(corpus(spark, sf_dir), shards)
    datasets.write_cleaned(spark, shards, cleaned)
    back = readers.read_corpus(spark, cleaned)
    named = F.col("shard").startswith("part-") & F.col("shard").endswith(".parquet")
    return back.select("id", F.md5("text_clean").alias("clean_md5"), named.alias("has_shard"))


@query
def ingest_corpus(spark, sf_dir):
    path = scratch_path(spark, "ingested")
    back = readers.ingest_corpus(spark, f"{sf_dir}/documents.parquet", "parquet", path)
    return back.select("doc_id", F.md5("text").alias("text_md5"), "lang", "source", "n_chars")


@query
def label_map_import(spark, sf_dir):
    """The label map as one JSON document."""
    path = scratch_path(spark, "map-json")
    clusters, assigned = _merged(spark, sf_dir)
    names = F.map_from_entries(F.collect_list(F.struct(F.col("cluster_id").cast("string"), "name")))
    moved = F.map_from_entries(F.collect_list(F.struct("id", "cluster_id")))
    document = clusters.agg(names.alias("cluster_names")).withColumn("data_mapping", assigned.agg(moved).scalar())
    writers.write_json_report(document, path)
    saved = readers.read_label_map(spark, path)
    return labels.lookup_names(saved[1], saved[0])


@query
def peek_rows(spark, sf_dir):
    return readers.peek(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), 10, "doc_id")


@query
def categorize_together(spark, sf_dir):
    """Two sets categorised as one and split again."""
    rows = corpus(spark, sf_dir).select("id", "source")
    train = labels.members(rows, assignments(spark, sf_dir))
    parts, _, _ = categorize.categorize_sets({"train": train, "test": labels.complement(rows, assignments(spark, sf_dir))}, mapping=_merged(spark, sf_dir))
    return labels.union_tagged("part", **parts)


@query
def separator_headings(spark, sf_dir):
    """Separators U+001C to U+001F count as white space inside a heading."""
    spaced = F.replace("text", F.lit("SONUÇ:\n"), F.lit("SONUÇ\x1d:"))
    return extraction.with_verdict(corpus(spark, sf_dir).withColumn("text", spaced)).select("id", "verdict")


@query
def corpus_roundtrip(spark, sf_dir):
    """Split table written by split folder; only the test folder is read back."""
    path = scratch_path(spark, "corpus")
    out = sampling.holdout_split(verdicts(spark, sf_dir).select("id", "verdict"), 50)
    writers.write_corpus(out, path, "split")
    return readers.read_corpus(spark, path, "test", key="id").select("id", "verdict", "split")


@query
def csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "csv")
    rows = verdicts(spark, sf_dir).select("id", "source", "verdict")
    writers.write_csv_report(rows, path)
    return readers.read_table(spark, path, schema=rows.schema)


@query
def label_map_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "map")
    clusters, assigned = _merged(spark, sf_dir)
    writers.write_label_map(clusters, assigned, path)
    saved = tuple(readers.read_corpus(spark, f"{path}/{t}") for t in ("clusters", "assignments"))
    return labels.lookup_names(saved[1], saved[0])


@query
def text_report(spark, sf_dir):
    """Readable blocks, read back as lines."""
    path = scratch_path(spark, "text")
    rows = verdicts(spark, sf_dir)
    block = writers.text_block(
        "DECISION",
        F.col("id"),
        {
            "END OF THE TEXT": T.preview(F.col("text"), 300, "right", "...", "  "),
            "EXTRACTED": F.replace("verdict", F.lit("\n"), F.lit("  ")),
        },
    )
    writers.write_text_report(rows, block, path)
    return spark.read.text(path, lineSep="\n").groupBy(F.md5("value").alias("line_md5")).count()


@query
def stream_extract(spark, sf_dir):
    """The documents as a stream of files, extracted into a table."""
    schema = table(spark, sf_dir, "documents").schema
    source = jobs.read_stream(spark, f"{sf_dir}/documents.parquet", schema)
    out = scratch_path(spark, "stream-out")
    rows = source.select(F.col("doc_id").cast("string").alias("id"), rendered("text").alias("text"))

    def narrow(df: DataFrame) -> DataFrame:
        return extraction.with_verdict(df).select("id", "verdict")

    jobs.stream_extract(rows, out, scratch_path(spark, "stream-log"), narrow).awaitTermination()
    return spark.read.schema("id string, verdict string").parquet(out)


@query
def stream_enrich(spark, sf_dir):
    schema = table(spark, sf_dir, "documents").schema
    source = jobs.read_stream(spark, f"{sf_dir}/documents.parquet", schema)
    out = scratch_path(spark, "stream-results")
    rows = source.select(
        F.col("doc_id").cast("string").alias("id"), T.build_prompt(rendered("text")).alias("prompt")
    )
    query_ = jobs.stream_enrich(rows, out, scratch_path(spark, "stream-log"), echo_model, "prompt")
    query_.awaitTermination()
    return readers.read_results(spark, out).select("id", F.md5("output").alias("output_md5"), "status")


@query
def stream_enrich_state(spark, sf_dir):
    """Every document arrives twice; each id is asked once."""
    schema = table(spark, sf_dir, "documents").schema
    arriving = [jobs.read_stream(spark, f"{sf_dir}/documents.parquet", schema) for _ in range(2)]
    out = scratch_path(spark, "stream-results")
    rows = arriving[0].unionByName(arriving[1]).select(
        F.col("doc_id").cast("string").alias("id"), T.build_prompt(rendered("text")).alias("prompt")
    )
    query_ = jobs.stream_enrich_state(rows, out, scratch_path(spark, "stream-log"), echo_model, "prompt")
    query_.awaitTermination()
    return readers.read_results(spark, out).select("id", F.md5("output").alias("output_md5"), "status")
