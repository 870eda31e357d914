"""Agreement between repeated runs and between two extractors."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from ..functions.similarity import jaccard_of_sets, similarity, word_set


def runs_wide(runs: DataFrame, n_runs: int, key: str = "id", output: str = "output") -> DataFrame:
    """One row per record with ``run_1_output`` … ``run_n_output``.

    A run number outside 1..n is an error: dropping it would change the score.
    Values are merged before the shuffle, so a record with many rows stays small.
    """
    known = F.when(F.col("run").between(1, n_runs), F.col("run")).otherwise(
        F.raise_error(F.lit(f"run number outside 1..{n_runs}")).cast("int")
    )
    columns = [
        F.max(F.when(F.col("run") == i, F.col(output))).alias(f"run_{i}_output")
        for i in range(1, n_runs + 1)
    ]
    return runs.select(key, known.alias("run"), output).groupBy(key).agg(*columns)


def consistency(
    runs: DataFrame,
    n_runs: int = 5,
    key: str = "id",
    output: str = "output",
    method: str = "jaccard",
    out: str = "avg_consistency_score",
) -> DataFrame:
    """Mean similarity over all pairs of runs of a record, with the runs as columns.

    The ``n (n - 1) / 2`` pairs are columns of one row: no self-join and no
    pair rows. A missing run takes part in no pair; without pairs the score is 0.0.
    """
    wide = runs_wide(runs, n_runs, key, output)
    names = [f"run_{i}_output" for i in range(1, n_runs + 1)]
    if method == "jaccard":  # the word set of a run serves all of its pairs
        wide = wide.select("*", *[word_set(F.col(n)).alias(f"{n}_words") for n in names])
    pairs = []
    for a, b in combinations(names, 2):
        if method == "jaccard":
            score = jaccard_of_sets(F.col(f"{a}_words"), F.col(f"{b}_words"))
        else:
            score = similarity(F.col(a), F.col(b), method, stripped=False)
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        pairs.append(F.when(both, score).alias(f"_{len(pairs)}"))
    scored = wide.select(key, *names, *pairs)
    cols = [F.col(f"_{i}") for i in range(len(pairs))]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0))
    count = sum((c.isNotNull().cast("int") for c in cols), F.lit(0))
    return scored.select(
        key, F.coalesce(F.try_divide(total, count), F.lit(0.0)).alias(out), *names
    )


def similarity_report(
    df: DataFrame, a: str, b: str, method: str = "jaccard", out: str = "regex_vs_llm_similarity"
) -> DataFrame:
    """The rows with a similarity column; :func:`mean_score` gives the mean."""
    return df.withColumn(out, similarity(F.col(a), F.col(b), method))


def mean_score(df: DataFrame, column: str, places: int = 4) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg(column), places).alias("mean_score"))
