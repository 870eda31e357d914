"""Clusters of verdicts, their names, and the categorised sets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..operators.enrichment import name_clusters
from ..operators.features import center_terms, fit_clusters, vectorize, vocabulary
from ..operators.labels import lookup_labels, lookup_names, union_tagged
from ..operators.sampling import sample_per_group
from ..session import materialize

SAMPLES_PER_CLUSTER = 10


def cluster_texts(
    df: DataFrame, k: int = 10, seed: int = 42, text: str = "verdict", key: str = "id", **vocab_params
):
    """``(assigned rows, names by center terms)`` of a TF-IDF k-means fit.

    The texts are read for the vocabulary, the fit and the assignment, so they
    are written once: an extraction behind them does not run again.
    """
    df = materialize(df.select(key, text), "texts")
    vocab = materialize(vocabulary(df, text, **vocab_params), "vocabulary")
    features = vectorize(df, vocab, text)
    model = fit_clusters(features, k, seed)
    assigned = materialize(model.transform(features).select(key, text, "cluster_id"), "assigned")
    return assigned, center_terms(model, vocab)


def categorize(
    df: DataFrame,
    mapping: tuple[DataFrame, DataFrame] | None = None,
    labeler: Callable[[list[str]], str] | None = None,
    k: int = 10,
    seed: int = 42,
    text: str = "verdict",
    key: str = "id",
    **vocab_params,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with ``cluster_id`` and ``category``, the cluster table and the assignments.

    A saved ``mapping`` of clusters and assignments is applied as it is. Without
    one the texts are clustered; ``labeler`` names each cluster from ten sample
    texts, and without a labeler the heaviest terms of its center do.
    """
    if mapping is not None:
        clusters, assignments = mapping
    else:
        assigned, names = cluster_texts(df, k, seed, text, key, **vocab_params)
        if labeler is None:
            clusters = df.sparkSession.createDataFrame(
                sorted(names.items()), "cluster_id int, name string"
            )
        else:
            samples = sample_per_group(assigned, "cluster_id", SAMPLES_PER_CLUSTER, seed, key)
            clusters = materialize(name_clusters(samples, labeler, text), "clusters")
        assignments = assigned.select(key, "cluster_id")
    rows = lookup_names(lookup_labels(df, assignments, "left", key), clusters)
    return rows.select(*df.columns, "cluster_id", "category"), clusters, assignments


def categorize_sets(
    sets: dict[str, DataFrame], tag: str = "_set", **options
) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """Several sets categorised as one, and split back; options as in :func:`categorize`."""
    rows, clusters, assignments = categorize(union_tagged(tag, **sets), **options)
    return {name: split_back(rows, tag, name) for name in sets}, clusters, assignments


def split_back(df: DataFrame, tag: str, value: str) -> DataFrame:
    """The rows of one origin, without the tag."""
    return df.where(F.col(tag) == value).drop(tag)
