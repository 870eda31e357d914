"""Mixing sources to target weights by pivotal dependent rounding.

Every row of a source shall be taken ``target / source size`` times. The whole part of that number
is taken as it is. The fractional rest is a probability, and probabilities are paired: mass moves
at random from one row of the pair to the other, measured in words so that the pair keeps its
expected words exactly, until one of the two is 0 or 1. What stays fractional goes on to the next
pair. Rows of a source are dealt into blocks by hash, each block leaves at most one fractional row,
and those rows meet in blocks again, level by level, until a source has one. Of that last row the
mix takes the leading words that are still missing, so a source misses its target by less than one
word and no row exceeds the cap.

A block has about ``BLOCK_ROWS`` rows, however large its source is: a source with a third of all
rows is simply more blocks. Random numbers come from the hash of the block, so reruns agree.

Null and empty texts have size 0 and are taken 0 times. A null source is a source of its own, the
last one. Repeated rows are rows of their own. An empty table gives an empty result. Further
columns of the input are not carried; ``mixed_rows`` brings them back.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .common import WORD, keep, ordered_index

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
BLOCK_ROWS = 4096
FAN_IN = 512

_STATE = "doc_id long, _hash long, source string, size long, _whole long, _blocks long, _block long, _p double, _open boolean"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP
) -> DataFrame:
    """``source, source_size, rows, target``: ``share`` of all words dealt by weight, capped and reshared."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    indexed = keep(ordered_index(totals, F.col("source").asc_nulls_last(), name="rank"), "sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = indexed.withColumn("_weight", weight).withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    total = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * share
    level, capped = 0.0, -1
    while True:  # the level only rises, so a capped source stays capped
        full = F.col("_weight") * level >= F.col("_cap") if capped >= 0 else F.col("_cap") <= 0
        taken, left, count = rows.agg(
            F.coalesce(F.sum(F.when(full, F.col("_cap"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("_weight"))), F.lit(0.0)),
            F.coalesce(F.sum(full.cast("long")), F.lit(0)),
        ).first()
        if count == capped or not left:
            break
        level, capped = (total - taken) / left, count
    return rows.select("source", "source_size", "rows", F.least("_cap", F.col("_weight") * level).alias("target"))


def _pivot(rows: pd.DataFrame, level: int, seed: int) -> pd.DataFrame:
    rows = rows.sort_values(["_hash", "doc_id", "size", "_p"], na_position="first", kind="stable").reset_index(drop=True)
    dice = random.Random(f"{seed}:{level}:{rows['_hash'].iloc[0]}:{len(rows)}")
    p, size = rows["_p"].tolist(), rows["size"].tolist()
    held = -1
    for j in range(len(p)):
        if not 0.0 < p[j] < 1.0:
            continue
        if held < 0:
            held = j
            continue
        ratio = size[j] / size[held]
        up = min(1.0 - p[held], p[j] * ratio)
        down = min(p[held], (1.0 - p[j]) * ratio)
        move = up if dice.random() * (up + down) < down else -down
        p[held], p[j] = _snap(p[held] + move), _snap(p[j] - move / ratio)
        if not 0.0 < p[held] < 1.0:
            held = j if 0.0 < p[j] < 1.0 else -1
    rows["_p"] = p
    rows["_open"] = rows.index == held
    return rows


def _pivot_at(level: int, seed: int):
    def step(rows: pd.DataFrame) -> pd.DataFrame:
        return _pivot(rows, level, seed)

    return step


def _snap(p: float) -> float:
    return 0.0 if p < 1e-9 else 1.0 if p > 1 - 1e-9 else p


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
    seed: int = 20,
) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, part_words, taken`` and ``text_hash``, a row per row."""
    sizes = keep(
        docs.select(
            "doc_id", F.xxhash64(F.lit(seed), "doc_id", "text").alias("_hash"), "source", word_count(F.col("text")).alias("size")
        ),
        "sizes",
    )
    targets = keep(source_targets(sizes, weights, share, cap), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    blocks = F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.lit(1))
    rows = (
        sizes.join(targets.withColumn("_ratio", ratio), sizes["source"].eqNullSafe(targets["source"]))
        .drop(targets["source"])
        .select(
            "doc_id",
            "_hash",
            "source",
            "size",
            F.floor("_ratio").cast("long").alias("_whole"),
            blocks.cast("long").alias("_blocks"),
            F.pmod("_hash", blocks).cast("long").alias("_block"),
            F.when(F.col("size") > 0, F.col("_ratio") - F.floor("_ratio")).otherwise(0.0).alias("_p"),
        )
        .withColumn("_open", F.lit(True))
    )
    most = targets.agg(F.max(blocks)).first()[0] or 1
    done, level = [], 0
    while True:
        state = keep(rows.groupBy("source", "_block").applyInPandas(_pivot_at(level, seed), _STATE), f"pivot{level}")
        if most <= 1:
            done.append(state)
            break
        done.append(state.where(~F.col("_open")))
        most, level = -(-most // FAN_IN), level + 1
        rows = state.where("_open").withColumn("_block", F.floor(F.col("_block") / FAN_IN).cast("long"))
    closed = done[0]
    for more in done[1:]:
        closed = closed.unionByName(more)
    copies = F.col("_whole") + F.when(F.col("_p") == 1.0, 1).otherwise(0)
    part = F.when(F.col("_open"), F.round(F.col("_p") * F.col("size"))).otherwise(0).cast("long")
    return (
        closed.join(targets, closed["source"].eqNullSafe(targets["source"]))
        .drop(targets["source"])
        .select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), part.alias("part_words"), F.col("_hash").alias("text_hash"))
        .withColumn("taken", F.col("copies") * F.col("size") + F.col("part_words"))
    )


def mixed_rows(docs: DataFrame, seed: int = 20, **options) -> DataFrame:
    """The mix itself: the rows of ``docs`` as often as they are taken, all their columns kept.

    The row of a source that is taken in part appears once more, cut after its leading words.
    """
    key = ["doc_id", "source", "text_hash"]
    taken = mix_sources(docs, seed=seed, **options).groupBy(*key).agg(
        F.sum("copies").alias("_copies"), F.sum("part_words").alias("_part")
    )
    copy = F.row_number().over(Window.partitionBy(*key).orderBy(F.col("text_hash")))
    rows = docs.withColumn("text_hash", F.xxhash64(F.lit(seed), "doc_id", "text")).withColumn("_copy", copy)
    rows = rows.where("_copy = 1")
    joined = rows.join(
        taken,
        rows["doc_id"].eqNullSafe(taken["doc_id"])
        & rows["source"].eqNullSafe(taken["source"])
        & (rows["text_hash"] == taken["text_hash"]),
    ).drop(taken["doc_id"], taken["source"], taken["text_hash"])
    lengths = F.concat(
        F.array_repeat(F.lit(None).cast("long"), F.col("_copies").cast("int")),
        F.when(F.col("_part") > 0, F.array("_part")).otherwise(F.array().cast("array<bigint>")),
    )
    ends = r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"
    cut = F.when(F.col("_words").isNull(), F.col("text")).otherwise(
        F.array_join(F.slice(F.split("text", ends), 1, F.col("_words").cast("int")), "")
    )
    return (
        joined.withColumn("_words", F.explode(lengths))
        .withColumn("text", cut)
        .select(*docs.columns)
    )
