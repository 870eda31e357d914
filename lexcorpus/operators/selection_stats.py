"""Exact order statistics of any orderable column, and exact top counts, without ordering or counting everything.

Both first ask a mergeable sketch where the answer must lie, then count exactly and prove it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize
from .schema import free_names

# Relative accuracy of the sketch that brackets a rank.
ACCURACY = 10_000
# Values within a bracket that are counted one by one.
FEW = 100_000
# Items that the sketch of frequent ones tracks at first and at most, and candidates per item wanted.
TRACKED, MOST_TRACKED = 10_000, 640_000
CANDIDATES = 8


@dataclass(eq=False)
class _Search:
    """A rank (from 0) of one column, and the closed bracket in which its value is known to lie."""

    column: Column
    rank: int
    low: object = None
    high: object = None
    below: int = 0
    rows: int = 0
    stuck: bool = False  # the sketch narrows it no further: the values are counted

    def inside(self) -> Column:
        return (self.column >= F.lit(self.low)) & (self.column <= F.lit(self.high))


def _brackets(df: DataFrame, open_: list[_Search]) -> None:
    """Narrows each bracket by the sketch of the values in it; one pass for the sketches, one for exact counts."""
    marks = []
    for s in open_:
        at = (s.rank - s.below + 0.5) / s.rows
        ends = [max(0.0, at - 2 / ACCURACY), min(1.0, at + 2 / ACCURACY)]
        marks.append(F.percentile_approx(F.when(s.inside(), s.column), ends, ACCURACY))
    ends = df.agg(*[m.alias(f"m{i}") for i, m in enumerate(marks)]).first()
    counts = []
    for i, s in enumerate(open_):
        low, high = ends[i]
        counts += [F.count_if(s.column < F.lit(low)).alias(f"b{i}"), F.count_if(s.column <= F.lit(high)).alias(f"u{i}")]
    exact = df.agg(*counts).first()
    for i, s in enumerate(open_):
        (low, high), below, upto = ends[i], exact[2 * i], exact[2 * i + 1]
        s.stuck = not below <= s.rank < upto or upto - below == s.rows
        if not s.stuck:  # the new bracket is proven by exact counts
            s.low, s.high, s.below, s.rows = low, high, below, upto - below


def values_at(df: DataFrame, wanted: Sequence[tuple[Column, int]]) -> list:
    """The values at the given ranks (from 0) among the non-null values of each column; null beyond the last one.

    Ranks are narrowed to brackets of values: a sketch proposes a bracket, exact counts prove it, and the
    values inside are taken on to the next round. When few are left, or one value only, they are
    counted one by one. Each round is an aggregation without an exchange of rows, and the distinct
    values of about ``FEW`` rows of a column are brought together in the end.
    """
    searches = [_Search(c, r) for c, r in wanted]  # a few, each some columns of one aggregation
    if not searches:
        return []
    facts = df.agg(*[f(s.column).alias(f"{n}{i}") for i, s in enumerate(searches) for n, f in (("n", F.count), ("l", F.min), ("h", F.max))])
    row = facts.first()
    for i, s in enumerate(searches):
        s.rows, s.low, s.high = row[f"n{i}"], row[f"l{i}"], row[f"h{i}"]
    live = [s for s in searches if 0 <= s.rank < s.rows]
    while open_ := [s for s in live if not s.stuck and s.low != s.high and s.rows > FEW]:
        _brackets(df, open_)
    for s in live:
        if s.low == s.high:
            continue
        counted = df.where(s.inside()).groupBy(s.column.alias("value")).agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.orderBy("value"))  # values of one bracket
        at = counted.withColumn("upto", upto).where(F.col("upto") > s.rank - s.below)
        s.low = s.high = at.agg(F.min("value")).first()[0]
    return [s.low if s in live else None for s in searches]


def numeric_stats(df: DataFrame, **metrics: Column) -> DataFrame:
    """``(metric, n, mean, median, p95, min, max)`` per named numeric column; all 0 for a column without values.

    The same figures as ``counts.length_stats``, for columns of any numeric type and any number of distinct
    values. Nulls and NaN are left out.
    """
    spark = df.sparkSession
    clean = {m: F.when(~F.isnan(c.cast("double")), c) for m, c in metrics.items()}
    facts = [
        f(c).cast("double").alias(f"{name}{i}")
        for i, c in enumerate(clean.values())
        for name, f in (("n", F.count), ("mean", lambda c: F.round(F.avg(c), 2)), ("min", F.min), ("max", F.max))
    ]
    row = df.agg(*facts).first()
    wanted = []
    for i, c in enumerate(clean.values()):
        n = int(row[f"n{i}"])
        wanted += [(c, (n - 1) // 2), (c, n // 2), (c, min(n - 1, n * 95 // 100))]
    found = values_at(df, wanted)
    out = []
    for i, metric in enumerate(clean):
        n = int(row[f"n{i}"])
        if not n:
            out.append((metric, 0, 0.0, 0.0, 0.0, 0.0, 0.0))
            continue
        left, right, p95 = (float(v) for v in found[3 * i : 3 * i + 3])
        out.append((metric, n, row[f"mean{i}"], (left + right) / 2.0, p95, row[f"min{i}"], row[f"max{i}"]))
    return spark.createDataFrame(out, "metric string, n long, mean double, median double, p95 double, min double, max double")


def exact_top_k(df: DataFrame, column: str, k: int, tracked: int = TRACKED) -> DataFrame:
    """``(column, n)`` (``_n`` for a column that is called n): the ``k`` most frequent values with their exact counts, equal counts in value order.

    A sketch of frequent items, merged over tasks, proposes candidates; these alone are recounted, and
    only counts per task and candidate are exchanged, however many values there are. The sketch's
    estimates are upper bounds, and what it does not name occurs at most as often as its smallest
    estimate: if the k-th exact count is above that, or the candidates make up all rows, the result is proven.
    If not, a larger sketch is asked, and in the end everything is counted.
    """
    spark = df.sparkSession
    rows = df.select(column).where(F.col(column).isNotNull())
    (n,) = free_names([column], "n")

    def counted(found: DataFrame) -> DataFrame:
        return found.groupBy(column).agg(F.count(F.lit(1)).alias(n))

    def first(counts: DataFrame) -> DataFrame:
        return counts.orderBy(F.desc(n), F.asc(column)).limit(k)

    tracked = max(tracked, CANDIDATES * k)
    while tracked <= MOST_TRACKED:
        sketch = F.call_function("approx_top_k", F.col(column), F.lit(CANDIDATES * k), F.lit(tracked))
        proposed, total = rows.agg(sketch.alias("top"), F.count(F.lit(1)).alias("total")).first()
        if not total:
            break
        few = spark.createDataFrame([(r[0],) for r in proposed], rows.schema)  # CANDIDATES * k rows at most
        exact = materialize(counted(rows.join(F.broadcast(few), column)), "candidates")
        top = first(exact)
        last, size = top.agg(F.min(n), F.count(F.lit(1))).first()
        if exact.agg(F.sum(n)).first()[0] == total or (size == k and last > min(r[1] for r in proposed)):
            return top
        tracked *= 8
    return first(counted(rows))
