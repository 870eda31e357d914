"""Seeded samples, splits and slices that do not depend on partitioning.

Rows are ordered by ``md5(seed:key)``. A sample is what lies at or below a *cutoff* of that order.
The cutoff is found from narrow rows (hash and key only): counts per hash prefix give the prefix in
which the n-th row lies, and only that prefix is ranked. The rows themselves are then filtered
where they are, without a shuffle, however large the sample is and however the rows are spread over
groups. Sizes are exact for every ``n``: only if several rows share the key of the n-th row, those
rows, and no others, are ordered among themselves by a hash of all their columns. A null key is a
key, a null group is a group.

The rows are looked at three times (twice for the key only). When they come
from an expensive step, write them first (``session.materialize``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from ..session import materialize
from .schema import free_names, require_columns

# 16**4 prefixes: the histogram has at most 65,536 rows per group.
PREFIX_DIGITS = 4
Target = Callable[[Column], Column]


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def hash_order(seed: int, key: str | Sequence[str]) -> Column:
    """``struct<h, k>``: the total order of all samples."""
    text = F.concat_ws(":", *[F.col(c).cast("string") for c in _keys(key)])
    return F.struct(F.md5(F.concat(F.lit(f"{seed}:"), text)).alias("h"), text.alias("k"))


def _constant(value) -> Column:
    if isinstance(value, Row):
        return F.struct(*[F.lit(v).alias(k) for k, v in value.asDict().items()])
    return F.lit(value)


def _same(left: DataFrame, right: DataFrame, on: dict[str, str], how: str = "inner") -> DataFrame:
    """Join in which a null equals a null; ``on`` maps columns of ``left`` to those of ``right``, which are dropped.

    Without columns ``right`` has one row at most, and its values become constants.
    """
    if not on:
        row = right.first()
        return left.withColumns({c: _constant(row[c] if row else None) for c in right.columns})
    renamed = dict(zip(on.values(), free_names([*left.columns, *right.columns], *[f"same_{n}" for n in on.values()])))
    other = right.withColumnsRenamed(renamed)
    return left.join(other, [left[a].eqNullSafe(other[renamed[b]]) for a, b in on.items()], how).drop(*renamed.values())


def _cutoffs(rows: DataFrame, groups: list[str], target: Target, carried: Sequence[str] = ()) -> DataFrame:
    """``(groups…, cut, need, equal)``: per group the order value of row number ``target(total)``.

    ``rows`` has the groups, the order ``o`` and, constant per group, ``carried``. ``equal`` rows
    have the value ``cut``, and ``need`` of them belong to the first rows. A group without
    first rows is left out. Only the rows of one prefix per group are ranked, and equal order
    values are counted first, so neither a hot group nor a hot key is brought together in one task.
    """
    rows = rows.withColumn("b", F.substring("o.h", 1, PREFIX_DIGITS))
    hist = rows.groupBy(*groups, *carried, "b").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*groups).orderBy("b"))
    total = F.sum("n").over(Window.partitionBy(*groups))
    edges = materialize(
        hist.withColumn("upto", upto)
        .withColumn("want", F.least(target(total), total).cast("long"))
        .where((F.col("upto") - F.col("n") < F.col("want")) & (F.col("upto") >= F.col("want")))
        .select(*groups, "b", (F.col("want") - F.col("upto") + F.col("n")).alias("short")),
        "edges",
    )
    inside = _same(rows.drop(*carried), edges, {c: c for c in [*groups, "b"]})
    counted = inside.groupBy(*groups, "b", "short", "o").agg(F.count(F.lit(1)).alias("equal"))
    ranked = counted.withColumn("upto", F.sum("equal").over(Window.partitionBy(*groups, "b").orderBy("o")))
    cut = ranked.where((F.col("upto") >= F.col("short")) & (F.col("upto") - F.col("equal") < F.col("short")))
    need = F.col("short") - F.col("upto") + F.col("equal")
    return materialize(cut.select(*groups, F.col("o").alias("cut"), need.alias("need"), "equal"), "cutoffs")


def _marked(
    df: DataFrame,
    target: Target,
    out: str,
    seed: int,
    key: str | Sequence[str],
    groups: Sequence[str] = (),
    carried: DataFrame | None = None,
) -> DataFrame:
    """``df`` with ``out``: true for the first ``target(total)`` rows of every group.

    ``carried`` is a table of one row per group, the groups named ``g0``, ``g1``, ..., whose further
    columns ``target`` may use. Inside, groups have these names only, and what is added to ``df`` on the
    way takes names that it does not have, so its own columns come back as they are. A column named
    ``out`` is replaced.
    """
    groups = list(groups)
    require_columns(df, *groups, *_keys(key))
    named = {g: f"g{i}" for i, g in enumerate(groups)}
    inner = [F.col(g).alias(n) for g, n in named.items()]
    own = {n: n for n in named.values()}
    order = hash_order(seed, key)
    rows = df.select(*inner, order.alias("o"))
    more = [c for c in carried.columns if c not in own] if carried is not None else []
    if carried is not None:
        rows = _same(rows, carried, own)
    cuts = _cutoffs(rows, list(own), target, more)
    tied = not cuts.where("need < equal").isEmpty()
    columns = [c for c in df.columns if c.lower() != out.lower()]
    cut, need, equal, place = free_names([*df.columns, out], "cut", "need", "equal", "place")
    if not groups and cuts.first() is None:
        return df.withColumn(out, F.lit(False))
    joined = _same(df, cuts.withColumnsRenamed({"cut": cut, "need": need, "equal": equal}), named, "left")
    upto = F.coalesce(order <= F.col(cut), F.lit(False)).alias(out)
    if not tied:
        return joined.select(*columns, upto)
    tie = F.coalesce((order == F.col(cut)) & (F.col(need) < F.col(equal)), F.lit(False))
    sure = joined.where(~tie).select(*columns, upto)
    # rows equal in every column are told apart by their place in the written table
    ties = joined.where(tie).select(*df.columns, need).withColumn(place, F.monotonically_increasing_id())
    ties = materialize(ties, "ties")
    among = F.struct(
        F.md5(F.concat(F.lit(f"{seed}:"), F.to_json(F.struct(*df.columns)))).alias("h"),
        F.lpad(F.col(place).cast("string"), 20, "0").alias("k"),
    )
    last = ties.select(*inner, F.col(need).alias("need"), among.alias("o"))
    last = _cutoffs(last, list(own), lambda _: F.col("need"), ["need"]).select(*own, F.col("cut").alias(cut))
    decided = _same(ties, last, named, "left")
    return sure.unionByName(decided.select(*columns, (among <= F.col(cut)).alias(out)))


def _first(df: DataFrame, n: int, seed: int, key: str | Sequence[str], strict: bool) -> tuple[DataFrame, str]:
    """``df`` with a mark on its first ``n`` rows, and the name of the mark."""
    if strict and df.select(*_keys(key)).count() < n:
        raise ValueError(f"fewer than {n} rows to sample from")
    (mark,) = free_names(df.columns, "first")
    return _marked(df, lambda _: F.lit(n), mark, seed, key), mark


def _as_split(marked: DataFrame, mark: str, out: str) -> DataFrame:
    return marked.withColumn(out, F.when(F.col(mark), F.lit("test")).otherwise(F.lit("train"))).drop(mark)


def sample_exact(
    df: DataFrame, n: int, seed: int = 42, key: str | Sequence[str] = "id", strict: bool = False
) -> DataFrame:
    """Exactly ``min(n, rows)`` rows without replacement. ``strict`` raises if there are fewer than ``n``."""
    marked, mark = _first(df, n, seed, key, strict)
    return marked.where(F.col(mark)).drop(mark)


def holdout_split(
    df: DataFrame,
    n: int,
    seed: int = 42,
    key: str | Sequence[str] = "id",
    strict: bool = True,
    out: str = "split",
) -> DataFrame:
    """Mark exactly ``n`` rows as ``test`` and the others as ``train``."""
    marked, mark = _first(df, n, seed, key, strict)
    return _as_split(marked, mark, out)


def slice_rows(
    df: DataFrame, start: int, end: int, seed: int = 42, key: str | Sequence[str] = "id"
) -> DataFrame:
    """Rows at positions ``[start, end)`` of the seeded order."""
    rows = sample_exact(df, end, seed, key)
    if start <= 0:
        return rows
    marked, mark = _first(rows, start, seed, key, False)
    return marked.where(~F.col(mark)).drop(mark)


def share_rows(df: DataFrame, part: int, parts: int, key: str = "id") -> DataFrame:
    """One of ``parts`` disjoint shares of the rows, for work on several machines."""
    return df.where(F.pmod(F.xxhash64(key), F.lit(parts)) == part)


def stratified_split(
    df: DataFrame,
    label: str,
    fraction: float = 0.1,
    seed: int = 42,
    key: str | Sequence[str] = "id",
    out: str = "split",
) -> DataFrame:
    """Mark ``ceil(fraction * rows)`` labelled rows as ``test``, every label with its share.

    A label gets the whole part of ``fraction`` times its rows; the rows still missing go to the
    labels with the largest remainders (ties: the smaller label). Rows without a label stay in
    ``train``. The table of shares has one row per label.
    """
    sizes = df.select(F.col(label).alias("g0")).where("g0 is not null").groupBy("g0").agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()
    # decimals: 0.1 * 30 is 3, not a little more
    share = F.col("n") * F.lit(str(fraction)).cast("decimal(18,12)")
    base = F.floor(share).cast("long")
    missing = F.ceil(F.sum(share).over(every)).cast("long") - F.sum(base).over(every)
    place = F.row_number().over(Window.orderBy((share - base).desc(), "g0"))
    wanted = materialize(sizes.select("g0", (base + (place <= missing).cast("long")).alias("wanted")), "shares")
    (mark,) = free_names([*df.columns, out], "first")
    return _as_split(_marked(df, lambda _: F.col("wanted"), mark, seed, key, [label], wanted), mark, out)


def sample_per_group(
    df: DataFrame, group: str, n: int, seed: int = 42, key: str | Sequence[str] = "id"
) -> DataFrame:
    """Exactly ``min(n, rows)`` rows of every group (null is one), the first ones of the seeded order."""
    (mark,) = free_names(df.columns, "first")
    return _marked(df, lambda _: F.lit(n), mark, seed, key, [group]).where(F.col(mark)).drop(mark)


def shuffle_rows(df: DataFrame, seed: int = 42, key: str | Sequence[str] = "id") -> DataFrame:
    """All rows in the seeded order (a range-partitioned sort)."""
    return df.orderBy(hash_order(seed, key))
