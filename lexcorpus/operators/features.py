"""TF-IDF features from Spark ML parts, with a vocabulary that is a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import rules
from ..functions.bind import let
from ..functions.text import bigrams, tokens
from ..session import materialize
from .labels import class_weights

# Words of two or more letters, digits or underscores.
WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"


def terms(c: Column, stop: Sequence[str] = rules.TFIDF_STOP_WORDS, ngrams: int = 2) -> Column:
    """Lower-cased words without stop words, then (``ngrams=2``) their bigrams."""
    words = tokens(c, WORD_PATTERN, stop, lower_first=True)
    return words if ngrams == 1 else let(words, lambda a: F.concat(a, bigrams(a)))


def vocabulary(
    df: DataFrame,
    text: str = "verdict",
    size: int = 10_000,
    min_df: int = 10,
    max_df: float = 0.8,
    stop: Sequence[str] = rules.TFIDF_STOP_WORDS,
    ngrams: int = 2,
) -> DataFrame:
    """``(idx, term, tf, df, idf)``: the ``size`` most frequent terms that occur in at
    least ``min_df`` texts and in at most the share ``max_df`` of them.

    One pass: a sorted term array shows the first occurrence of a term in its
    text, so term and text frequency come from the same partial aggregate. A
    null term per text counts the texts. ``idf = ln((1 + n) / (1 + df)) + 1``.
    """
    arr = F.sort_array(F.coalesce(terms(F.col(text), stop, ngrams), F.array().cast("array<string>")))
    marked = let(
        arr,
        lambda a: F.transform(
            a,
            lambda t, i: F.struct(
                t.alias("term"),
                F.when((i == 0) | (F.get(a, i - 1) != t), F.lit(1)).otherwise(F.lit(0)).alias("first"),
            ),
        ),
    )
    per_text = F.struct(F.lit(None).cast("string").alias("term"), F.lit(1).alias("first"))
    counts = (
        df.select(F.inline(F.array_append(marked, per_text)))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("tf"), F.sum("first").alias("df"))
        .where(F.col("term").isNull() | (F.col("df") >= min_df))
    )
    counts = materialize(counts, "terms")
    n = counts.where(F.col("term").isNull()).select("df").scalar()
    top = (
        counts.where(F.col("term").isNotNull() & (F.col("df") <= n * F.lit(float(max_df))))
        .orderBy(F.desc("tf"), F.asc("term"))
        .limit(size)
    )
    return top.select(
        (F.row_number().over(Window.orderBy("term")) - 1).alias("idx"),
        "term",
        "tf",
        "df",
        (F.log((n + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf"),
    )


def vectorize(
    df: DataFrame,
    vocab: DataFrame,
    text: str = "verdict",
    out: str = "features",
    stop: Sequence[str] = rules.TFIDF_STOP_WORDS,
    ngrams: int = 2,
) -> DataFrame:
    """Add the L2-normalised TF-IDF vector of a text.

    The vocabulary (``size`` rows at most) is the only thing that reaches the driver.
    """
    rows = vocab.orderBy("idx").select("term", "idf").collect()
    counter = CountVectorizerModel.from_vocabulary(
        [r.term for r in rows], inputCol="_terms", outputCol="_tf"
    )
    weigh = ElementwiseProduct(
        scalingVec=Vectors.dense([r.idf for r in rows]), inputCol="_tf", outputCol="_tfidf"
    )
    norm = Normalizer(p=2.0, inputCol="_tfidf", outputCol=out)
    listed = df.withColumn(
        "_terms", F.coalesce(terms(F.col(text), stop, ngrams), F.array().cast("array<string>"))
    )
    return norm.transform(weigh.transform(counter.transform(listed))).drop("_terms", "_tf", "_tfidf")


def tfidf_weights(
    df: DataFrame,
    vocab: DataFrame,
    key: str = "id",
    text: str = "verdict",
    stop: Sequence[str] = rules.TFIDF_STOP_WORDS,
    ngrams: int = 2,
) -> DataFrame:
    """``(key, term, weight)``: the same vectors in long form, for reports and joins."""
    vocab = materialize(vocab.select("term", "idf"), "vocabulary")
    counted = (
        df.select(key, F.explode(terms(F.col(text), stop, ngrams)).alias("term"))
        .join(vocab, "term")
        .groupBy(key, "term")
        .agg((F.count(F.lit(1)) * F.first("idf")).alias("w"))
    )
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return counted.select(key, "term", (F.col("w") / norm).alias("weight"))


def fit_clusters(features: DataFrame, k: int = 10, seed: int = 42, column: str = "features") -> KMeansModel:
    """k-means over the vectors, which are written once and read back by every iteration."""
    data = materialize(features.select(column), "vectors")
    return KMeans(k=k, seed=seed, featuresCol=column, predictionCol="cluster_id").fit(data)


def center_terms(model: KMeansModel, vocab: DataFrame, n: int = 3) -> dict[int, str]:
    """Heaviest terms of every cluster center: a name without a language model."""
    words = [r.term for r in vocab.orderBy("idx").select("term").collect()]
    return {
        i: ", ".join(words[j] for j in center.argsort()[::-1][:n] if center[j] > 0)
        for i, center in enumerate(model.clusterCenters())
    }


def training_rows(
    train: DataFrame, label: str = "label", column: str = "features", weighted: bool = True
) -> tuple[DataFrame, dict]:
    """Rows to fit a classifier on, written once, and its settings.

    Weights have one row per class; they are written, so the join broadcasts them by their true size.
    """
    data = train.select(label, column)
    settings = {"featuresCol": column, "labelCol": label, "maxIter": 50, "regParam": 0.01}
    if weighted:
        weights = materialize(class_weights(train, label).select(label, "weight"), "weights")
        data = data.join(weights, label)
        settings["weightCol"] = "weight"
    return materialize(data, "vectors"), settings


def fit_classifier(
    train: DataFrame,
    label: str = "label",
    column: str = "features",
    weighted: bool = True,
    **params,
) -> LogisticRegressionModel:
    """Classifier over text vectors with the class-weighted loss."""
    data, settings = training_rows(train, label, column, weighted)
    return LogisticRegression(**{**settings, **params}).fit(data)


def train_text_classifier(
    train: DataFrame, test: DataFrame, text: str = "text", label: str = "label", **vocab_params
) -> tuple[DataFrame, LogisticRegressionModel]:
    """Predictions on ``test`` of a classifier fitted on ``train``; labels are 0..K-1."""
    vocab = materialize(vocabulary(train, text, **vocab_params), "vocabulary")
    model = fit_classifier(vectorize(train, vocab, text), label)
    return model.transform(vectorize(test, vocab, text)), model
