"""Tables out: corpus, label map, results, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def write_corpus(df: DataFrame, path: str, split: str | None = None, mode: str = "overwrite") -> None:
    """Parquet; with ``split`` one folder per value of that column, written without a shuffle."""
    writer = df.write.mode(mode)
    if split is not None:
        writer = writer.partitionBy(split)
    writer.parquet(path)


def write_label_map(clusters: DataFrame, assignments: DataFrame, path: str) -> None:
    """``clusters`` and ``assignments`` as Parquet and the names as one JSON object.

    The JSON holds one entry per cluster; assignments have one row per text
    and stay a table.
    """
    clusters.write.mode("overwrite").parquet(f"{path}/clusters")
    assignments.write.mode("overwrite").parquet(f"{path}/assignments")
    entries = F.collect_list(F.struct(F.col("cluster_id").cast("string"), "name"))
    clusters.agg(F.map_from_entries(entries).alias("cluster_names")).coalesce(1).write.mode(
        "overwrite"
    ).json(f"{path}/names")


def append_results(df: DataFrame, path: str, batch: str) -> None:
    """Results of one batch; writing the same batch again replaces it."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def write_csv_report(df: DataFrame, path: str) -> None:
    """CSV with header; arrays are joined by ``|``."""
    arrays = {f.name for f in df.schema.fields if f.dataType.typeName() == "array"}
    flat = df.select(*[F.array_join(c, "|").alias(c) if c in arrays else F.col(c) for c in df.columns])
    flat.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json_report(df: DataFrame, path: str) -> None:
    """A report of one row as one JSON object."""
    df.coalesce(1).write.mode("overwrite").json(path)


def text_block(title: str, key: Column, parts: dict[str, Column], rule: str = "-" * 40) -> Column:
    """Readable block: key line, rule, then one titled part after the other."""
    lines = [F.concat(F.lit(f"{title}: "), key.cast("string")), F.lit(rule)]
    for name, c in parts.items():
        lines += [F.lit(f"{name}:"), c, F.lit("")]
    return F.concat_ws("\n", *lines, F.lit("=" * 80))


def write_text_report(df: DataFrame, block: Column, path: str) -> None:
    """One block per row as plain text."""
    df.select(block.alias("value")).write.mode("overwrite").text(path)
