"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..session import materialize

# A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

# Bytes of text that one step of a vectorised task works on.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back, see ``session.materialize``."""
    return materialize(df, f"llm-{name}")


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by ``keep`` that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            if folder.getName().startswith("llm-"):
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and where each text begins and the last one ends.

    A null text is an empty one.
    """
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about ``limit`` bytes; a longer text comes alone."""
    _, at = text_bytes(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def ordered_index(df: DataFrame, *order: Column, name: str = "index") -> DataFrame:
    """``df`` with ``index``: 0, 1, ... in the given order.

    Rows are dealt out by range; only one count per partition meets in one place.
    """
    sorted_rows = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    rows = keep(sorted_rows, "ordered")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy("_part")
        .count()
        .select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    )
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return (
        rows.withColumn("_place", place)
        .join(F.broadcast(starts), "_part")  # one row per partition of the sort
        .withColumn(name, F.col("_start") + F.col("_place"))
        .drop("_part", "_start", "_place")
    )


def numbered(docs: DataFrame, name: str, nulls: bool = False) -> DataFrame:
    """``docs`` with ``name``: a number for each distinct id and text, in the order of ``doc_id``.

    Where no id has two texts, that is the id itself. Otherwise ids and texts are numbered anew, different
    texts of one id in the order of their hash. A null id has no number, or with ``nulls`` one for each
    distinct text, after all ids.
    """
    number = F.col("doc_id").cast("long")
    hashed = docs.select(number.alias("id"), F.xxhash64("text").alias("hash"))
    if not nulls:
        hashed = hashed.where("id is not null")
    mixed = hashed.groupBy("id").agg(F.min("hash").alias("low"), F.max("hash").alias("high")).where("id is null or low != high")
    if mixed.isEmpty():
        return docs.withColumn(name, number)
    index = ordered_index(hashed.distinct(), F.asc_nulls_last("id"), F.asc("hash"), name="number")
    index = keep(index, "numbers").withColumnsRenamed({"id": f"{name}_id", "hash": f"{name}_hash", "number": name})
    same = number.eqNullSafe(F.col(f"{name}_id")) & (F.xxhash64("text") == F.col(f"{name}_hash"))
    return docs.join(index, same, "left").drop(f"{name}_id", f"{name}_hash")
