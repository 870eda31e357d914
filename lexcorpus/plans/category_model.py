"""Categories as a saved model: vocabulary, centers and names, which assign new texts without a fit."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import rules
from ..operators.enrichment import Model, name_clusters_by_prompt
from ..operators.features import fit_clusters, vectorize, vocabulary
from ..operators.labels import lookup_names
from ..operators.minibatch import fit_minibatch, nearest_center
from ..operators.sampling import sample_per_group
from ..operators.schema import free_names
from ..session import materialize
from .categorize import SAMPLES_PER_CLUSTER

_TERMS = "idx int, term string, tf long, df long, idf double"
_CENTERS = "cluster_id int, idx int, weight double"
_CLUSTERS = "cluster_id int, name string"


@dataclass
class CategoryModel:
    """``terms(idx, term, tf, df, idf)``, a dense row per center, ``clusters(cluster_id, name)``, and how texts are split."""

    terms: DataFrame
    centers: np.ndarray
    clusters: DataFrame
    ngrams: int = 2
    stop: tuple[str, ...] = rules.TFIDF_STOP_WORDS

    def save(self, path: str) -> None:
        """Four tables below ``path``; the centers keep their non-zero weights only."""
        spark = self.terms.sparkSession
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        c, i = np.nonzero(self.centers)
        rows = list(zip(c.tolist(), i.tolist(), self.centers[c, i].tolist()))  # centers x vocabulary at most
        spark.createDataFrame(rows, _CENTERS).write.mode("overwrite").parquet(f"{path}/centers")
        self.clusters.write.mode("overwrite").parquet(f"{path}/clusters")
        settings = json.dumps({"centers": len(self.centers), "ngrams": self.ngrams, "stop": list(self.stop)})
        spark.createDataFrame([(settings,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/settings")

    @staticmethod
    def load(spark: SparkSession, path: str) -> CategoryModel:
        settings = json.loads(spark.read.text(f"{path}/settings", wholetext=True).first()[0])
        terms = spark.read.schema(_TERMS).parquet(f"{path}/terms")
        centers = np.zeros((settings["centers"], terms.count()))
        for r in spark.read.schema(_CENTERS).parquet(f"{path}/centers").toLocalIterator():
            centers[r.cluster_id, r.idx] = r.weight
        clusters = spark.read.schema(_CLUSTERS).parquet(f"{path}/clusters")
        return CategoryModel(terms, centers, clusters, settings["ngrams"], tuple(settings["stop"]))

    def vectors(self, df: DataFrame, text: str = "verdict", out: str = "features") -> DataFrame:
        return vectorize(df, self.terms, text, out, self.stop, self.ngrams)

    def assign(self, df: DataFrame, text: str = "verdict") -> DataFrame:
        """``df`` with ``cluster_id`` of the nearest center: one narrow pass over the texts."""
        (vector,) = free_names([*df.columns, "cluster_id"], "features")
        rows = self.vectors(df, text, vector)
        columns = [c for c in df.columns if c.lower() != "cluster_id"]
        return rows.select(*columns, nearest_center(self.centers, vector).alias("cluster_id"))

    def categorize(self, df: DataFrame, text: str = "verdict") -> DataFrame:
        """``df`` with ``cluster_id`` and ``category``; columns of these names are replaced."""
        rows = self.assign(df.drop("category"), text)
        return lookup_names(rows, self.clusters).select(*rows.columns, "category")


def heaviest_terms(centers: np.ndarray, terms: DataFrame, n: int = 3) -> list[tuple[int, str]]:
    """A name for each center without a language model."""
    words = [r.term for r in terms.orderBy("idx").select("term").collect()]
    return [
        (i, ", ".join(words[j] for j in np.argsort(-center, kind="stable")[:n] if center[j] > 0))
        for i, center in enumerate(centers)
    ]


def fit_category_model(
    df: DataFrame,
    k: int = 10,
    seed: int = 42,
    text: str = "verdict",
    key: str = "id",
    method: str = "minibatch",
    namer: Callable[[], Model] | None = None,
    ngrams: int = 2,
    stop: tuple[str, ...] = rules.TFIDF_STOP_WORDS,
    naming: dict | None = None,
    fit: dict | None = None,
    **vocab_params,
) -> CategoryModel:
    """Vocabulary, centers and names of the texts of ``df``.

    ``method`` is ``minibatch`` or ``full`` (Lloyd over all rows). ``namer`` builds a model that answers the
    naming prompt of a cluster's samples (``naming``: options of its calls); without one the heaviest
    terms of a center name it.
    """
    if method not in ("minibatch", "full"):
        raise ValueError(f"unknown method: {method}")
    spark = df.sparkSession
    rows = materialize(df.select(F.col(key).alias("id"), F.col(text).alias("text")), "texts")
    terms = materialize(vocabulary(rows, "text", ngrams=ngrams, stop=stop, **vocab_params), "vocabulary")
    features = vectorize(rows, terms, "text", "features", stop, ngrams).select("id", "features")
    if method == "full":
        centers = np.array(fit_clusters(features, k, seed, **(fit or {})).clusterCenters())
    else:
        centers = fit_minibatch(features, terms.count(), k, seed, "id", **(fit or {}))
    model = CategoryModel(terms, centers, spark.createDataFrame([], _CLUSTERS), ngrams, tuple(stop))
    if namer is None:
        model.clusters = spark.createDataFrame(heaviest_terms(centers, terms), _CLUSTERS)
    else:
        samples = sample_per_group(model.assign(rows, "text"), "cluster_id", SAMPLES_PER_CLUSTER, seed, "id")
        named = name_clusters_by_prompt(materialize(samples, "samples"), namer, "text", **(naming or {}))
        model.clusters = materialize(named, "clusters")
    return model
