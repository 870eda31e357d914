"""From raw documents to packed training sequences, stage by stage.

``STAGES`` lists (name, function); each function takes ``(spark, docs, sf_dir)`` and returns a
DataFrame that is written as Parquet and read again as the ``docs`` of the next stage. All but the
last return the columns of ``documents``.

Further columns travel through a stage as one struct, so no name of theirs can meet a name that
the stage uses. A null text is an empty one. Different texts of one id, and rows without an id, are
documents of their own; rows that repeat id and text (and for the mix the source) are copies. Empty tables
give empty results.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

ROOT = str(Path(__file__).resolve().parent)
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

import lexcorpus  # noqa: E402
from lexcorpus.llm import toxicity as toxic  # noqa: E402
from lexcorpus.llm.common import keep, numbered, table  # noqa: E402
from lexcorpus.llm.mixing import mixed_rows  # noqa: E402
from lexcorpus.llm.packing import pack  # noqa: E402
from lexcorpus.llm.repeats import cut_repeats  # noqa: E402
from lexcorpus.llm.sketches import near_duplicates  # noqa: E402

# Python workers may start in another folder: ship functions of the package by value.
cloudpickle.register_pickle_by_value(lexcorpus)


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def guarded(stage: Stage) -> Stage:
    """The stage with all columns but ``COLUMNS`` in one struct on the way."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        more = [F.col(f"`{c}`") for c in docs.columns if c not in COLUMNS]
        if not more:
            return stage(spark, docs, sf_dir)
        packed = docs.select(*[c for c in docs.columns if c in COLUMNS], F.struct(*more).alias("further_columns"))
        out = stage(spark, packed, sf_dir)
        return out.select(*[c if c in COLUMNS else F.col("further_columns")[c].alias(c) for c in docs.columns])

    return run_stage


@guarded
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples do not call toxic."""
    rows = toxic.fit_and_score(docs, table(spark, sf_dir, "labels"))
    return rows.where("toxicity < 0.5").select(*docs.columns)


@guarded
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are alike by 0.8 or more; one of exact copies."""
    rows = numbered(docs, "number", nulls=True)
    alike = near_duplicates(rows.select(F.col("number").alias("doc_id"), "text"), words=5)
    kept = alike.where("kept").select(F.col("doc_id").alias("number")).distinct()
    copy = F.row_number().over(Window.partitionBy("number").orderBy(*[c for c in COLUMNS if c in docs.columns and c != "text"]))
    first = rows.join(kept, "number", "left_semi").withColumn("copy", copy).where("copy = 1")
    return first.select(*docs.columns)


@guarded
def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 100-byte windows that occur earlier, also within a text.

    A character that loses a byte goes whole. A document that loses everything goes too, unless
    it was empty before.
    """
    cut = cut_repeats(docs, as_text=True).where("kept != '' or n_bytes = 0")
    text = F.when(F.col("text").isNotNull(), F.col("kept"))
    return cut.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@guarded
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for."""
    return mixed_rows(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of power-of-two lengths."""
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("suffix_array", repeats),
    ("mixing", mixing),
    ("packing", packing),
]

# Tokenisation and shingle similarity have no SQL form; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
