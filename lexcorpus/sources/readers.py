"""Tables in: corpus, label map, results, spreadsheets."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def _load(spark: SparkSession, path: str, fmt: str, schema: StructType | str | None, **options) -> DataFrame:
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    try:
        return reader.load(path)
    except AnalysisException as exc:
        # no such folder, or a folder without data files
        if exc.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise FileNotFoundError(f"no {fmt} files found in: {path}") from exc
        raise


# Scans above this size are never spread, however many cores there are.
SMALL_BYTES = 256 << 20


def spread_small(df: DataFrame, key: str) -> DataFrame:
    """Spread the rows of a small scan by key when it has fewer splits than there are cores.

    A Parquet file with one row group is read by one task, and everything up
    to the next shuffle would run in it. A scan above ``SMALL_BYTES`` is left alone: a large
    corpus is never shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().optimizedPlan()
    if int(str(plan.stats().sizeInBytes())) > SMALL_BYTES:
        return df
    return df.repartition(2 * cores, key) if df.rdd.getNumPartitions() < cores else df


def read_corpus(
    spark: SparkSession,
    path: str,
    split: str | None = None,
    schema: StructType | str | None = None,
    key: str | None = None,
    shard: bool = False,
    spread: bool = False,
) -> DataFrame:
    """Parquet file or folder; ``split`` reads one partition folder only.

    ``key`` is cast to string, ``shard`` adds the file name each row came from,
    ``spread`` calls :func:`spread_small` with the key.
    """
    df = _load(spark, path, "parquet", schema)
    if split is not None:
        df = df.where(F.col("split") == split)
    if key is not None:
        df = df.withColumn(key, F.col(key).cast("string"))
    if shard:
        df = df.withColumn("shard", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))
    return spread_small(df, key) if spread and key is not None else df


def ingest_corpus(
    spark: SparkSession, source: str, fmt: str, path: str, schema: StructType | str | None = None, **options
) -> DataFrame:
    """Snapshot of a foreign source as Parquet, read back."""
    _load(spark, source, fmt, schema, **options).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_label_map(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``clusters(cluster_id, name)`` and ``assignments(id, cluster_id)``.

    ``path`` is one JSON document with ``cluster_names`` and ``data_mapping``.
    JSON in one document cannot be split among tasks; keep large maps as
    Parquet tables (see ``write_label_map``) and use this for imports only.
    """
    doc = _load(
        spark,
        path,
        "json",
        "cluster_names map<string,string>, data_mapping map<string,int>",
        multiLine=True,
    )
    clusters = doc.select(F.explode("cluster_names").alias("k", "name")).select(
        F.col("k").cast("int").alias("cluster_id"), "name"
    )
    assignments = doc.select(F.explode("data_mapping").alias("id", "cluster_id"))
    return clusters, assignments


def read_results(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """``(id, output…)``: a result table, or with ``fmt="json"`` one map document."""
    if fmt != "json":
        return _load(spark, path, fmt, None)
    doc = _load(spark, path, "text", None, wholetext=True)
    parsed = F.from_json("value", "map<string,string>")
    return doc.select(F.explode(parsed).alias("id", "output"))


def read_table(
    spark: SparkSession, path: str, fmt: str = "csv", schema: StructType | str | None = None
) -> DataFrame:
    """Sheet-like table with a header row (CSV), or Parquet."""
    options = {"header": True, "multiLine": True, "escape": '"'} if fmt == "csv" else {}
    return _load(spark, path, fmt, schema, **options)


def peek(df: DataFrame, n: int, order: str) -> DataFrame:
    """First ``n`` rows in key order."""
    return df.orderBy(order).limit(n)
