"""Importance resampling towards a target text collection, over hashed n-grams.

Features of a text are its runs of 1 to ``max_n`` words, joined by a space and repeats counted; a
feature's bucket is the CRC32 of its bytes modulo ``buckets``. A bucket's gain compares how often it
occurs in the target and in the corpus (both smoothed by one), and a text's weight is the sum of the
gains of its features. Gumbel noise from a hash of the id turns the largest scores into a draw
without replacement, with probabilities that follow the weights. Reruns agree.

Each block of text interns its n-grams in an open-addressed table (``ngrams.GramTable``): XXH64 keys
whose bytes are verified, so a bucket is computed once for each distinct n-gram. Counting sums the
tables' counts per bucket; weighing gathers the buckets' gains through the slots of the occurrences.
Both passes read every text whole. Only ``buckets`` numbers reach the driver, and only ids and scores
are exchanged to rank.

A null or empty text has no features and the weight 0. A null id is hashed as an empty one and ranks
before other ids of its score. Rows that repeat are rows of their own; of rows with the same score and
id any may come first. An empty target gives all texts gains by the corpus alone, an empty corpus an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import chunks, keep, ordered_index, text_bytes
from .ngrams import ALPHANUMERIC, GramTable, gram_ranges, joined_words

BLOCK_GRAMS = 1 << 18  # occurrences that one table takes


def _tables(part: pa.RecordBatch, max_n: int, buckets: int) -> Iterator[tuple[GramTable, np.ndarray]]:
    """Tables of all n-grams of the texts, each with the row of every occurrence."""
    joined, start, end, word_at = joined_words(*text_bytes(part.column("text")), ALPHANUMERIC)
    for n in range(1, max_n + 1):
        low, high, at = gram_ranges(start, end, word_at, n)
        row = np.repeat(np.arange(part.num_rows), np.diff(at))
        for first in range(0, len(low), BLOCK_GRAMS):
            some = slice(first, first + BLOCK_GRAMS)
            yield GramTable(joined, low[some], high[some], buckets), row[some]


def bucket_counts(texts: DataFrame, max_n: int, buckets: int) -> np.ndarray:
    """Occurrences per bucket over all rows of ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in chunks(batch, "text"):
                for table, _ in _tables(part, max_n, buckets):
                    count = table.count[table.used]
                    total += np.bincount(table.bucket[table.used], count, buckets).astype(np.int64)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["bucket", "n"])

    counts = texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(buckets, np.int64)
    for row in counts.collect():  # a row per bucket
        total[row.bucket] = row.n
    return total


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket: 1000 times the logarithm of its smoothed share in the target over that in the corpus, rounded down."""
    buckets = len(corpus)
    above = (target + 1.0) * (corpus.sum() + float(buckets))
    below = (corpus + 1.0) * (target.sum() + float(buckets))
    return np.floor(1000 * np.log(above / below)).astype(np.int64)


def _weighed(docs: DataFrame, gain: np.ndarray, max_n: int, names: tuple[str, str, str]) -> DataFrame:
    """All columns of ``docs`` and, by the given names, words, features and weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                features = np.zeros(part.num_rows, np.int64)
                weight = np.zeros(part.num_rows, np.int64)
                _, start, _, word_at = joined_words(*text_bytes(part.column("text")), ALPHANUMERIC)
                for table, row in _tables(part, max_n, len(gain)):
                    sums = np.concatenate([[0], np.cumsum(gain[table.bucket][table.slot])])
                    at = np.searchsorted(row, np.arange(part.num_rows + 1))
                    features += np.diff(at)
                    weight += sums[at[1:]] - sums[at[:-1]]
                added = [pa.array(np.diff(word_at)), pa.array(features), pa.array(weight)]
                yield pa.RecordBatch.from_arrays([*part.columns, *added], names=[*part.schema.names, *names])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *(StructField(name, LongType()) for name in names)]))


def gumbel(doc_id: Column, seed: int) -> Column:
    """Noise from the id: 1000 times a standard Gumbel value, rounded down."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def _free(docs: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, with underscores in front until ``docs`` has none of them."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name in taken:
            name = f"_{name}"
        out.append(name)
    return tuple(out)


def _scored(docs: DataFrame, target: DataFrame, max_n: int, buckets: int, seed: int) -> tuple[DataFrame, tuple[str, ...]]:
    gain = gains(bucket_counts(docs, max_n, buckets), bucket_counts(target, max_n, buckets))
    names = _free(docs, "n_words", "n_features", "weight", "score")
    rows = _weighed(docs, gain, max_n, names[:3])
    return rows.withColumn(names[3], F.col(names[2]) + gumbel(F.col("doc_id"), seed)), names


def resampling_ranks(
    docs: DataFrame, target: DataFrame, *, max_n: int = 1, buckets: int = 10_000, percent: int = 10, min_words: int = 20, seed: int = 2024
) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every row of ``docs(doc_id, text)``.

    Of the rows with at least ``min_words`` words, ``percent`` out of 100 (rounded down) are drawn; ``rank``
    counts them from 1, highest score first and ties to the smaller id. Other rows have no rank.
    """
    scored, _ = _scored(docs.select("doc_id", "text"), target, max_n, buckets, seed)
    rows = keep(scored.drop("text"), "scored")
    able = rows.where(F.col("n_words") >= min_words)
    drawn = able.count() * percent // 100
    place = ordered_index(able, F.desc("score"), F.asc("doc_id"), name="rank")
    rank = F.when(F.col("rank") < drawn, F.col("rank") + 1).cast("long")
    ranked = place.withColumn("rank", rank)
    rest = rows.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest)


def resample(
    docs: DataFrame, target: DataFrame, *, max_n: int = 1, buckets: int = 10_000, percent: int = 10, min_words: int = 20, seed: int = 2024
) -> DataFrame:
    """The drawn rows of ``docs``, all their columns as they are, see ``resampling_ranks``.

    The texts are scored in place; only rows that reach the score of the last one drawn are ordered.
    """
    scored, (words, _, _, score) = _scored(docs, target, max_n, buckets, seed)
    able = keep(scored.where(F.col(words) >= min_words), "able")
    drawn = able.count() * percent // 100
    place, last = _free(able, "place", "last")
    ranked = ordered_index(able.select(F.col(score).alias(last), "doc_id"), F.desc(last), F.asc("doc_id"), name=place)
    cut = ranked.where(F.col(place) == drawn - 1).first()
    if cut is None:
        return docs.limit(0)
    sure = able.where(F.col(score) > cut[last])
    ties = ordered_index(able.where(F.col(score) == cut[last]), F.asc("doc_id"), name=place)
    return sure.select(*docs.columns).unionByName(ties.where(F.col(place) < drawn - sure.count()).select(*docs.columns))
