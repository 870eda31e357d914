"""The same operators over files that keep arriving."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators.enrichment import Model, enrich_text, pending, read_prior, result_schema
from ..operators.extraction import with_verdict
from ..operators.schema import free_names
from ..session import materialize
from ..sources.writers import append_results


STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def read_stream(
    spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 1000, glob: str | None = None
) -> DataFrame:
    """New Parquet files of a folder; a batch takes a bounded number of them.

    ``path`` may name one file too. A stream watches folders only, so its folder is watched for that name.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    if glob is None and found and len(found) == 1 and found[0].isFile():
        path, glob = place.getParent().toString(), place.getName()
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def stream_extract(
    source: DataFrame,
    out_path: str,
    checkpoint: str,
    transform: Callable[[DataFrame], DataFrame] = with_verdict,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Apply a narrow transformation to a stream and append the result as Parquet.

    No state and no shuffle; the file sink's log makes each batch count once.
    """
    return (
        transform(source)
        .writeStream.format("parquet")
        .option("path", out_path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stream_enrich(
    source: DataFrame,
    results_path: str,
    checkpoint: str,
    model_factory: Callable[[], Model],
    text: str = "text",
    keys: Sequence[str] = ("id",),
    trigger: dict | None = None,
    **options,
) -> StreamingQuery:
    """Enrich each id once over a stream.

    An id counts as done when the results folder has a good result of it, so
    the results are the only state: nothing grows in memory, and an id that
    failed is tried again when it arrives again. A batch overwrites its own
    folder, so a replayed batch leaves no duplicates.
    """
    schema = result_schema(source, keys)

    def write(batch: DataFrame, batch_id: int) -> None:
        name = f"stream-{batch_id:012d}"
        others = read_prior(batch.sparkSession, results_path, schema)
        others = others.where(others["batch"] != name)
        # keys decide what is pending: texts are moved for those only, and of the results the keys are read
        todo = materialize(pending(batch.select(*keys).distinct(), others, keys), "pending")
        texts = batch.select(*keys, text).join(todo, list(keys), "left_semi").groupBy(*keys).agg(F.min(text).alias(text))
        fresh = enrich_text(materialize(texts, "prompts"), model_factory, text, keys, **options)
        append_results(fresh, results_path, name)

    return (
        source.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stream_enrich_state(
    source: DataFrame,
    results_path: str,
    checkpoint: str,
    model_factory: Callable[[], Model],
    text: str = "text",
    keys: Sequence[str] = ("id",),
    trigger: dict | None = None,
    rounds: int = 3,
    **options,
) -> StreamingQuery:
    """Enrich each id once over a stream, at a cost that does not grow with the history.

    Which ids have arrived is keyed state in RocksDB, on the executors' disks and in the checkpoint:
    an id that is known passes no further, and no earlier result is ever read. An id whose call failed
    goes on with the next micro-batch, in up to ``rounds`` batches, from a folder that holds the failed
    prompts of the last batch only. A batch overwrites its own folders, so a replayed batch leaves
    no duplicates. Of copies that arrive in one batch any one is asked.
    """
    spark = source.sparkSession
    for name, value in STATE_CONF.items():
        spark.conf.set(name, value)
    (tries,) = free_names([*keys, text], "tries")
    first = source.select(*keys, text).dropDuplicates(list(keys))
    schema = StructType([*first.schema.fields, StructField(tries, IntegerType())])

    def failed_path(batch_id: int) -> str:
        return f"{checkpoint}/failed/{batch_id:012d}"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, name = batch.sparkSession, f"stream-{batch_id:012d}"
        again = read_prior(spark, failed_path(batch_id - 1), schema)
        prompts = materialize(batch.withColumn(tries, F.lit(1)).unionByName(again), "prompts")
        append_results(enrich_text(prompts, model_factory, text, keys, **options), results_path, name)
        own = spark.read.schema(result_schema(prompts, keys)).parquet(f"{results_path}/batch={name}")
        failed = prompts.where(F.col(tries) < rounds).join(own.where("status != 'ok'").select(*keys), list(keys), "left_semi")
        failed.withColumn(tries, F.col(tries) + 1).write.mode("overwrite").parquet(failed_path(batch_id))

    return (
        first.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
