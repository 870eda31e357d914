"""Chat formatting with cumulative-snapshot collapse.

A service that logs a conversation after every turn logs it many times, each time a little longer.
Each turn is hashed with its place, and the running combination of these hashes names every prefix of a
conversation. A conversation whose whole hash is a proper prefix of another one is dropped by an
anti-join; of equal conversations the one with the smallest id stays. What remains is rendered.

Both sides of the anti-join are distinct before they are exchanged, so a first turn or a
conversation that a third of the log shares is one row. Two 64-bit hashes decide equality. Texts
are moved twice: to order the turns of each conversation, and for conversations that stay. A conversation is one row of the result and has to
fit into one.

Turns are ordered by ``turn`` (null first), then role, then text; a row repeated within a
conversation counts once. A null role is ``user``, a null text is empty. Each distinct row without
``conv_id`` is a conversation of one turn with a null id, which loses ties against others: such rows are
never brought together, however many there are. An empty table gives an empty result. Further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .common import keep

TURN = ("<|", "|>\n", "\n<|end|>\n")  # before the role, after it, after the text
DEFAULT_ROLE = "user"


def _turns(log: DataFrame) -> DataFrame:
    return log.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit(DEFAULT_ROLE)).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def prefixes(log: DataFrame) -> DataFrame:
    """``conv_id, place, hash1, hash2, n_turns``: one row per prefix of each conversation."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    whole = Window.partitionBy("conv_id")
    rows = _turns(log).select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.xxhash64(F.lit(1), "role", "text").alias("h1"),
        F.xxhash64(F.lit(2), "role", "text").alias("h2"),
    )
    rows = rows.distinct()
    placed = rows.where("conv_id is not null").withColumn("place", F.row_number().over(order))
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = placed.select(
        "conv_id",
        "place",
        F.bit_xor(F.xxhash64("place", "h1")).over(running).alias("hash1"),
        F.bit_xor(F.xxhash64("place", "h2")).over(running).alias("hash2"),
        F.max("place").over(whole).alias("n_turns"),
    )
    alone = rows.where("conv_id is null")
    return known.unionByName(
        alone.select("conv_id", F.lit(1).alias("place"), *_single_hashes(), F.lit(1).alias("n_turns"))
    )


def _single_hashes() -> list[Column]:
    """Both hashes of a conversation of one turn."""
    return [F.xxhash64(F.lit(1), F.xxhash64(F.lit(i), "role", "text")).alias(f"hash{i}") for i in (1, 2)]


def _maximal(log: DataFrame) -> DataFrame:
    rows = keep(prefixes(log), "prefixes")
    key = ["place", "hash1", "hash2"]
    ends = rows.where("place = n_turns").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    inner = rows.where("place < n_turns").select(*key).distinct()
    kept = ends.join(inner, key, "left_anti")
    return kept.select("conv_id", F.col("place").cast("long").alias("n_turns"), "copies", "hash1", "hash2")


def maximal(log: DataFrame) -> DataFrame:
    """``conv_id, n_turns, copies``: the conversations that no other one continues; ``copies`` are equal to it, itself included."""
    return _maximal(log).drop("hash1", "hash2")


def rendered(log: DataFrame) -> DataFrame:
    """``conv_id, n_turns, copies, rendered``, a row per maximal conversation."""
    kept = keep(_maximal(log), "maximal")
    turns = _turns(log)
    before, after, end = (F.lit(part) for part in TURN)
    texts = (
        turns.join(kept.select("conv_id"), "conv_id", "left_semi")  # a null id meets nothing
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_set(F.struct("turn", "role", "text"))).alias("turns"))
    )
    parts = F.transform("turns", lambda t: F.concat(before, t["role"], after, t["text"], end))
    known = kept.join(texts.select("conv_id", F.array_join(parts, "").alias("rendered")), "conv_id")
    single = F.min(F.concat(before, "role", after, "text", end)).alias("rendered")
    alone = turns.where("conv_id is null").groupBy(*_single_hashes()).agg(single)
    nameless = kept.where("conv_id is null").join(alone, ["hash1", "hash2"])
    columns = ["conv_id", "n_turns", "copies", "rendered"]
    return known.select(*columns).unionByName(nameless.select(*columns))
