"""Model-backed text columns: run, resume, repeat, name."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from ..functions.text import build_samples_prompt, clean_label
from ..session import materialize
from ..sources.result_store import RESULT_FIELDS, ResultStore, latest_results, next_number
from ..sources.writers import append_results
from .schema import free_names, require_columns

Model = Callable[[str], str]

CALLS_PER_TASK = 500
# Calls that run at the same time, over all tasks of a job.
IN_FLIGHT = 64
# Tasks that one chunk of an enrichment gives each core.
CHUNK_WAVES = 2
# Files that the prompts of one chunk are spread over.
CHUNK_FILES = 8


class _Slots:
    """Places for the calls of one task. A call that is given up holds its place until it really ends.

    So the model never sees more calls than there are places. If all places are held by calls that
    were given up, further calls fail at once.
    """

    def __init__(self, places: int):
        self._places, self._free = places, threading.Semaphore(places)
        self._lock, self._given_up = threading.Lock(), 0

    def call(self, model: Model, text: str, limit: float | None) -> str:
        with self._lock:
            if self._given_up == self._places:
                raise TimeoutError("every call that is open has been given up")
        if not self._free.acquire(timeout=limit):
            raise TimeoutError(f"no call has ended within {limit:g} s")
        if limit is None:
            try:
                return model(text)
            finally:
                self._free.release()
        done: list = []
        state = {"left": False, "ended": False}

        def run() -> None:
            try:
                done.append((model(text), None))
            except Exception as exc:
                done.append((None, exc))
            finally:
                with self._lock:
                    state["ended"] = True
                    self._given_up -= state["left"]
                self._free.release()

        thread = threading.Thread(target=run, daemon=True)
        thread.start()
        thread.join(limit)
        with self._lock:
            if not state["ended"]:
                state["left"] = True
                self._given_up += 1
                raise TimeoutError(f"no answer within {limit:g} s")
        answer, error = done[0]
        if error is not None:
            raise error
        return answer


def _call(
    model: Model, text: str | None, retries: int, pause: float, limit: float | None = None, slots: _Slots | None = None
) -> tuple:
    error, slots = None, slots or _Slots(1)
    for attempt in range(1, retries + 1):
        try:
            return slots.call(model, text or "", limit), "ok", attempt, None
        except Exception as exc:  # the model is foreign code: any failure is data
            error = f"{type(exc).__name__}: {exc}"
            if attempt < retries:
                time.sleep(pause)
    return None, "failed", retries, error


def enrich_text(
    df: DataFrame,
    model_factory: Callable[[], Model],
    text: str = "text",
    keys: Sequence[str] = ("id",),
    retries: int = 3,
    pause: float = 2.0,
    concurrency: int = 64,
    partitions: int | None = None,
    limit: float | None = 120.0,
    in_flight: int = IN_FLIGHT,
) -> DataFrame:
    """``(keys…, output, status, attempts, error)``: one model call per row.

    ``model_factory`` runs once per partition and builds the client there. At most ``in_flight`` calls
    run at a time however large the cluster is: there are no more tasks than that, and each has
    its equal share of them (``concurrency`` at most). A call is given up after ``limit`` seconds; it
    still counts until it ends. A failed row gets status ``failed``, never an error text as output.
    Rows are dealt by key into ``partitions`` tasks, by default one for ``CALLS_PER_TASK`` rows:
    bytes say nothing about the time of a call.
    """
    require_columns(df, *keys, text)
    rows = df.select(*keys, text)
    if partitions is None:
        partitions = -(-rows.select(*keys).count() // CALLS_PER_TASK)
    partitions = max(1, min(partitions, in_flight))
    concurrency = min(concurrency, in_flight // partitions)
    rows = rows.repartition(partitions, *keys)
    fields = [f for f in rows.schema.fields if f.name in keys]
    schema = T.StructType(fields + T._parse_datatype_string(RESULT_FIELDS).fields)
    names = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, slots = model_factory(), _Slots(concurrency)

        def answered(batch: pd.DataFrame, calls: list) -> pd.DataFrame:
            answers = pd.DataFrame([c.result() for c in calls], columns=["output", "status", "attempts", "error"])
            return pd.concat([batch[names].reset_index(drop=True), answers], axis=1)

        with ThreadPoolExecutor(concurrency) as pool:
            waiting = None  # the calls of the next batch begin before the slowest of this one ends
            for batch in batches:
                calls = [pool.submit(_call, model, t, retries, pause, limit, slots) for t in batch[text]]
                if waiting is not None:
                    yield answered(*waiting)
                waiting = (batch, calls)
            if waiting is not None:
                yield answered(*waiting)

    return rows.mapInPandas(run, schema)


def result_schema(df: DataFrame, keys: Sequence[str] = ("id",)) -> T.StructType:
    """Columns of a results folder for the rows of ``df``."""
    types = {f.name: f.dataType for f in df.schema.fields}
    fields = T._parse_datatype_string(RESULT_FIELDS + ", batch string").fields
    return T.StructType([T.StructField(k, types[k]) for k in keys] + fields)


def read_prior(spark, path: str, schema: T.StructType) -> DataFrame:
    """Results written so far; empty when there are none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def pending(df: DataFrame, results: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Rows without a good result. Failed rows are pending again."""
    done = results.where(F.col("status") == "ok").select(*keys)  # copies do no harm to an anti-join
    return df.join(done, list(keys), "left_anti")


def _in_chunks(
    df: DataFrame,
    todo: DataFrame,
    text: str,
    keys: Sequence[str],
    chunk_rows: int | None,
    ask: Callable[[DataFrame, int], None],
) -> None:
    """Hands the prompts of the keys of ``todo`` to ``ask(prompts, number)``, chunk by chunk.

    Keys are cut by hash into chunks of about ``chunk_rows``, by default enough for ``CHUNK_WAVES`` tasks
    on every core. The prompts are written once, a folder per chunk, and each chunk reads its own folder
    only. Of copies of a key the smallest text is asked.
    """
    spark = df.sparkSession
    if chunk_rows is None:
        chunk_rows = CALLS_PER_TASK * CHUNK_WAVES * spark.sparkContext.defaultParallelism
    chunks = -(-todo.count() // chunk_rows)
    if not chunks:
        return
    chunk, file = free_names([*keys, text], "chunk", "file")
    dealt = (
        df.select(*keys, text)
        .join(todo, list(keys), "left_semi")
        .withColumn(chunk, F.pmod(F.xxhash64(*keys), F.lit(chunks)).cast("int"))
        .withColumn(file, F.pmod(F.xxhash64(F.lit(1), *keys), F.lit(CHUNK_FILES)).cast("int"))
        .repartition(chunk, file)
    )
    prompts = materialize(dealt.groupBy(chunk, file, *keys).agg(F.min(text).alias(text)).drop(file), "prompts", chunk)
    for k in range(chunks):
        ask(prompts.where(F.col(chunk) == k).drop(chunk), k)


def enrich_incremental(
    df: DataFrame,
    results_path: str,
    model_factory: Callable[[], Model],
    batch: str,
    text: str = "text",
    keys: Sequence[str] = ("id",),
    out: str = "output",
    chunk_rows: int | None = None,
    **options,
) -> DataFrame:
    """Run the model for pending rows, append the results, join all of them back.

    Pending keys are found from the keys alone and cut into chunks, see ``_in_chunks``.
    Each chunk is committed to a folder of its own, ``batch=<name>-<number>``, before the next one
    begins, so a batch that breaks off keeps what it has finished and goes on from there when it
    is run again. The history is exchanged for each join; see ``enrich_bucketed`` for a large one.
    """
    spark = df.sparkSession
    schema = result_schema(df, keys)
    prior = read_prior(spark, results_path, schema)
    todo = materialize(pending(df.select(*keys).distinct(), prior, keys), "pending")
    last = prior.where(F.col("batch").startswith(f"{batch}-")).agg(F.max("batch")).first()[0]
    start = next_number([last] if last else [], batch)

    def ask(prompts: DataFrame, number: int) -> None:
        fresh = enrich_text(prompts, model_factory, text, keys, **options)
        append_results(fresh, results_path, f"{batch}-{start + number:06d}")

    _in_chunks(df, todo, text, keys, chunk_rows, ask)
    results = latest_results(read_prior(spark, results_path, schema), keys)
    answers = results.select(*keys, F.col("output").alias(out), "status")
    return df.join(answers, list(keys), "left")


def enrich_bucketed(
    df: DataFrame,
    store: ResultStore,
    model_factory: Callable[[], Model],
    batch: str,
    text: str = "text",
    out: str = "output",
    chunk_rows: int | None = None,
    **options,
) -> DataFrame:
    """``enrich_incremental`` against a bucketed store: the history is read where it lies, never exchanged."""
    todo = materialize(store.pending(df), "pending")
    start = next_number(store.batches(), batch)

    def ask(prompts: DataFrame, number: int) -> None:
        store.append(enrich_text(prompts, model_factory, text, store.keys, **options), f"{batch}-{start + number:06d}")

    _in_chunks(df, todo, text, store.keys, chunk_rows, ask)
    return store.joined(df, out)


def repeat_runs(
    df: DataFrame,
    n_runs: int,
    model_factory: Callable[[], Model],
    text: str = "text",
    key: str = "id",
    **options,
) -> DataFrame:
    """``(key, run, output, status, attempts, error)`` with runs 1..n of the same rows."""
    runs = F.explode(F.sequence(F.lit(1), F.lit(n_runs))).alias("run")
    rows = df.select(key, text, runs)
    return enrich_text(rows, model_factory, text, (key, "run"), **options)


def name_clusters(
    samples: DataFrame,
    labeler: Callable[[list[str]], str],
    text: str = "text",
    attempts: int = 3,
    pause: float = 2.0,
) -> DataFrame:
    """``(cluster_id, name)`` from the sample texts of each cluster.

    ``samples`` holds a few rows per cluster (see ``sample_per_group``), so the
    lists are short. A labeler that keeps failing gives ``Kategori_<id>``.
    """
    lists = samples.groupBy("cluster_id").agg(F.sort_array(F.collect_list(text)).alias("texts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names = [_call(lambda _: labeler(list(t)), "", attempts, pause)[0] for t in batch["texts"]]
            yield pd.DataFrame({"cluster_id": batch["cluster_id"], "name": names})

    return _cleaned_names(lists.mapInPandas(run, "cluster_id int, name string"))


def _cleaned_names(named: DataFrame) -> DataFrame:
    fallback = F.concat(F.lit("Kategori_"), F.col("cluster_id").cast("string"))
    return named.select("cluster_id", F.coalesce(clean_label(F.col("name")), fallback).alias("name"))


def naming_prompts(samples: DataFrame, text: str = "text") -> DataFrame:
    """``(cluster_id, prompt)``: the instruction and the numbered sample texts of each cluster, in text order."""
    texts = F.sort_array(F.collect_list(text))
    return samples.groupBy("cluster_id").agg(build_samples_prompt(texts).alias("prompt"))


def name_clusters_by_prompt(
    samples: DataFrame, model_factory: Callable[[], Model], text: str = "text", **options
) -> DataFrame:
    """``(cluster_id, name)``: the model's cleaned reply to each cluster's prompt; options as in ``enrich_text``.

    A model that keeps failing gives ``Kategori_<id>``.
    """
    asked = enrich_text(naming_prompts(samples, text), model_factory, "prompt", ("cluster_id",), **options)
    return _cleaned_names(asked.withColumnRenamed("output", "name"))
