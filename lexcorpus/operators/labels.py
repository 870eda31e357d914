"""Label tables: lookups, re-indexing, merging, names, weights, unions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .. import rules
from ..session import materialize
from .schema import require_columns


def lookup_labels(df: DataFrame, assignments: DataFrame, how: str = "left", key: str = "id") -> DataFrame:
    """Add ``cluster_id``; ``inner`` keeps the rows that have one."""
    return df.join(assignments.select(key, "cluster_id"), key, how)


def lookup_names(df: DataFrame, clusters: DataFrame) -> DataFrame:
    """Add ``category``, the name of ``cluster_id``."""
    names = clusters.select("cluster_id", F.col("name").alias("category"))
    return df.join(names, "cluster_id", "left")


def members(df: DataFrame, others: DataFrame, key: str = "id") -> DataFrame:
    return df.join(others, key, "left_semi")


def complement(df: DataFrame, others: DataFrame, key: str = "id") -> DataFrame:
    return df.join(others, key, "left_anti")


def union_tagged(tag: str, **frames: DataFrame) -> DataFrame:
    """Union by column name; missing columns are null and ``tag`` holds the frame's name."""
    parts = [df.withColumn(tag, F.lit(name)) for name, df in frames.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def distinct_labels(df: DataFrame, label: str = "label") -> DataFrame:
    return df.select(label).where(F.col(label).isNotNull()).distinct()


def label_index(df: DataFrame, label: str = "label") -> DataFrame:
    """``(label, new_label)``: sorted distinct labels numbered from 0."""
    rank = F.dense_rank().over(Window.orderBy(label))
    return distinct_labels(df, label).withColumn("new_label", (rank - 1).cast("int"))


def reindex_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """Replace labels by 0..K-1 in label order; contiguous labels stay as they are.

    The index has one row per class; it is written once so that its true size
    decides how the join runs.
    """
    require_columns(df, label)
    index = materialize(label_index(df, label), "labels")
    joined = df.join(index, label, "left")
    return joined.select(
        *[F.col("new_label").alias(c) if c == label else F.col(c) for c in df.columns]
    )


def merge_map(
    clusters: DataFrame, keyword: str = rules.MERGE_KEYWORD, name: str = rules.MERGE_NAME
) -> DataFrame:
    """``(cluster_id, new_id, name)``: clusters of one name share an id.

    Names that hold the keyword are renamed first. New ids count up from 0 in
    the order in which names first appear. Where no two clusters have one name then, nothing
    changes, neither names nor ids. One row per cluster.
    """
    renamed = F.when(F.contains("name", F.lit(keyword)), F.lit(name)).otherwise(F.col("name"))
    named = clusters.select("cluster_id", "name", renamed.alias("_name"))
    twice = F.coalesce(named.groupBy("_name").count().agg(F.max("count") > 1).scalar(), F.lit(False))
    first = named.withColumn("_first", F.min("cluster_id").over(Window.partitionBy("_name")))
    new_id = (F.dense_rank().over(Window.orderBy("_first")) - 1).cast("int")
    return first.select("cluster_id", "name", "_name", new_id.alias("_new")).select(
        "cluster_id",
        F.when(twice, F.col("_new")).otherwise(F.col("cluster_id")).alias("new_id"),
        F.when(twice, F.col("_name")).otherwise(F.col("name")).alias("name"),
    )


def merge_clusters(
    clusters: DataFrame, assignments: DataFrame, key: str = "id", **names: str
) -> tuple[DataFrame, DataFrame]:
    """The cluster table and the assignments after merging clusters of one name.

    An assignment to a cluster that the table lacks is an error.
    """
    mapping = merge_map(clusters, **names)
    merged = mapping.select(F.col("new_id").alias("cluster_id"), "name").distinct()
    unknown = F.raise_error(F.concat(F.lit("unknown cluster "), F.coalesce(F.col("cluster_id").cast("string"), F.lit("null"))))
    moved = assignments.join(mapping.withColumn("_known", F.lit(True)), "cluster_id", "left").select(
        key, F.when(F.col("_known"), F.col("new_id")).otherwise(unknown.cast("int")).alias("cluster_id")
    )
    return merged, moved


def label_names(labels: DataFrame, clusters: DataFrame, label: str = "label") -> DataFrame:
    """``(label, name)`` with ``LABEL_<i>`` for labels that have no name."""
    names = clusters.select(F.col("cluster_id").alias(label), "name")
    fallback = F.concat(F.lit("LABEL_"), F.col(label).cast("string"))
    return labels.select(label).join(names, label, "left").select(
        label, F.coalesce("name", fallback).alias("name")
    )


def label_ids(names: DataFrame, label: str = "label") -> DataFrame:
    """``(name, label)``, the inverse of :func:`label_names`; a name that two labels share is an error."""
    twice = F.raise_error(F.concat(F.lit("two labels are named "), F.col("name")))
    ids = names.groupBy("name").agg(F.min(label).alias(label), F.count(F.lit(1)).alias("n"))
    return ids.select("name", F.when(F.col("n") == 1, F.col(label)).otherwise(twice.cast("int")).alias(label))


def class_weights(df: DataFrame, label: str = "label", num_labels: int | None = None) -> DataFrame:
    """``(label, n, weight)`` with ``weight = sum(c) / (K * c)``, ``c = max(count, 1)``.

    With ``num_labels`` every label of 0..K-1 is listed, seen or not; without,
    the labels seen are. The window runs over one row per class.
    """
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    if num_labels is not None:
        known = df.sparkSession.range(num_labels).select(
            F.col("id").cast(df.schema[label].dataType).alias(label)
        )
        counts = known.join(counts, label, "left")
    every = Window.partitionBy()
    c = F.greatest(F.coalesce("n", F.lit(0)), F.lit(1))
    return (
        counts.select(label, F.coalesce("n", F.lit(0)).alias("n"), c.alias("c"))
        .withColumn("weight", F.sum("c").over(every) / (F.count(F.lit(1)).over(every) * F.col("c")))
        .drop("c")
    )
