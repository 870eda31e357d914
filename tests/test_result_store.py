"""Bucketed results, the limit on open calls, and streams whose cost does not follow their history."""

import os
import re
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lexcorpus.operators import enrichment
from lexcorpus.sources.result_store import ResultStore
from lexcorpus.streaming import jobs

KIND = "id int, text string"


def upper():
    return str.upper


def no_model():
    def call(_):
        raise AssertionError("no call expected")

    return call


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def branches_with_history(plan):
    """Names of the nodes above each scan of the history, up to the root."""
    found = []
    lines = plan.splitlines()
    depth = lambda line: len(re.match(r"[\s:+\-|]*", line)[0])
    for i, line in enumerate(lines):
        if "FileScan parquet" in line and "lexcorpus_results_" in line:
            path, level = [], depth(line)
            for above in reversed(lines[:i]):
                if depth(above) < level:
                    level = depth(above)
                    path.append(above[level:].split("(")[-1] if above[level:].startswith("*(") else above[level:])
            found.append(path)
    return found


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(i, f"text {i}") for i in range(200)], KIND).repartition(5)


def test_history_is_never_exchanged(spark, rows, tmp_path):
    store = ResultStore(rows, str(tmp_path / "s"), buckets=7)
    enrichment.enrich_bucketed(rows.where("id < 120"), store, upper, "a", pause=0.0)
    for df in (store.pending(rows), store.answers(rows), store.joined(rows)):
        paths = branches_with_history(plan_of(df))
        assert paths and not any("Exchange" in node for path in paths for node in path), plan_of(df)
    out = enrichment.enrich_bucketed(rows, store, upper, "b", pause=0.0)
    assert sorted(map(tuple, out.collect())) == sorted((i, f"text {i}", f"TEXT {i}", "ok") for i in range(200))
    by_batch = {r.batch: r.n for r in store.history().groupBy("batch").agg(F.count("*").alias("n")).collect()}
    assert by_batch == {"a-000000": 120, "b-000000": 80}


def test_a_store_is_opened_again_with_its_layout(spark, rows, tmp_path):
    path = str(tmp_path / "it's a store")
    store = ResultStore(rows, path, buckets=3)
    store.append(enrichment.enrich_text(rows, upper), "a")
    store.forget()
    again = ResultStore(rows, path, buckets=50)
    assert again.buckets == 3 and again.history().count() == 200 and again.pending(rows).count() == 0
    with pytest.raises(ValueError, match="kept by"):
        ResultStore(rows, path, keys=("text",))
    assert enrichment.enrich_bucketed(rows, again, no_model, "b").where("status = 'ok'").count() == 200


def test_a_batch_written_again_replaces_itself_and_failures_are_pending(spark, rows, tmp_path):
    store = ResultStore(rows, str(tmp_path / "s"), buckets=4)
    some = rows.where("id < 10")

    def half():
        def call(text):
            if int(text.split()[1]) % 2:
                raise ValueError("odd")
            return text

        return call

    for _ in range(2):
        store.append(enrichment.enrich_text(some, half, retries=1), "a-000000")
    assert store.history().count() == 10
    assert sorted(r.id for r in store.pending(some).collect()) == [1, 3, 5, 7, 9]
    out = enrichment.enrich_bucketed(some, store, upper, "a")
    assert {r.id: r.output for r in out.collect()} == {i: f"TEXT {i}" if i % 2 else f"text {i}" for i in range(10)}
    assert store.batches() == ["a-000000", "a-000001"]
    before = sorted(map(tuple, store.joined(rows).collect()), key=str)
    store.compact("all")
    assert store.batches() == ["all-000000"] and store.history().count() == 10
    assert sorted(map(tuple, store.joined(rows).collect()), key=str) == before


def test_null_keys_several_keys_and_clashing_names(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, "a", "x", "u"), (1, "b", "y", "u"), (None, "a", "z", "u"), (2, None, "", "u"), (1, "a", "w", "u")],
        "chunk int, file string, text string, _chunk string",
    )
    store = ResultStore(df, str(tmp_path / "s"), keys=("chunk", "file"), buckets=2)
    out = enrichment.enrich_bucketed(df, store, upper, "a", chunk_rows=1)
    got = {(r.chunk, r.file, r.text): r.output for r in out.collect()}
    assert got[(1, "a", "x")] == got[(1, "a", "w")] == "W" and got[(1, "b", "y")] == "Y"  # the smallest text is asked
    assert len(got) == 5
    empty = ResultStore(df, str(tmp_path / "e"), keys=("chunk", "file"), buckets=2)
    assert enrichment.enrich_bucketed(df.limit(0), empty, no_model, "a").collect() == []


class Counting:
    """A model that notes how many of its calls are open at a time, over all workers."""

    def __init__(self, folder, wait):
        self.folder, self.wait = folder, wait

    def __call__(self):
        def call(text):
            mark = f"{self.folder}/open/{os.getpid()}-{text.replace(' ', '')}-{time.monotonic_ns()}"
            Path(mark).touch()
            Path(f"{self.folder}/seen/{len(os.listdir(f'{self.folder}/open'))}").touch()
            time.sleep(self.wait)
            os.remove(mark)
            return text

        return call


@pytest.mark.parametrize("options", [{"partitions": 8}, {"partitions": 20}, {"partitions": 1}, {"concurrency": 2, "partitions": 2}])
def test_open_calls_are_limited_over_all_tasks(spark, rows, tmp_path, options):
    for name in ("open", "seen"):
        (tmp_path / name).mkdir()
    out = enrichment.enrich_text(rows.limit(80), Counting(str(tmp_path), 0.02), in_flight=6, **options)
    assert out.where("status = 'ok'").count() == 80
    seen = max(map(int, os.listdir(tmp_path / "seen")))
    assert 2 <= seen <= min(6, options.get("concurrency", 6) * options["partitions"])


def test_calls_that_were_given_up_still_count(spark, rows, tmp_path):
    for name in ("open", "seen"):
        (tmp_path / name).mkdir()
    slow = Counting(str(tmp_path), 1.0)
    out = enrichment.enrich_text(rows.limit(12), slow, in_flight=4, partitions=2, limit=0.1, retries=3, pause=0.05).collect()
    assert {r.status for r in out} == {"failed"} and all("Timeout" in r.error for r in out)
    assert max(map(int, os.listdir(tmp_path / "seen"))) <= 4


def test_prompts_are_read_by_chunk(spark, rows, monkeypatch):
    asked = []
    enrichment._in_chunks(rows, rows.select("id"), "text", ["id"], 50, lambda prompts, k: asked.append((k, prompts)))
    assert [k for k, _ in asked] == [0, 1, 2, 3]
    files = [set(p.inputFiles()) for _, p in asked]
    assert all("PartitionFilters: [isnotnull(chunk" in plan_of(p) for _, p in asked)
    assert sorted(r.id for _, p in asked for r in p.collect()) == list(range(200)) and files


# -- streams ---------------------------------------------------------------------------------------


def test_stream_never_reads_its_history(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(30):
        part = [(j, f"text {j}") for j in (3 * i, 3 * i + 1, max(0, 3 * i - 1))]  # one of them has arrived before
        spark.createDataFrame(part, KIND).coalesce(1).write.mode("append").parquet(source)
        time.sleep(0.01)
    read = []
    before = enrichment.read_prior

    def watched(session, path, schema):
        found = before(session, path, schema)
        read.append((path, found.count()))
        return found

    jobs.read_prior, kept = watched, jobs.read_prior
    try:
        stream = jobs.read_stream(spark, source, KIND, files_per_batch=1)
        query = jobs.stream_enrich_state(stream, out, str(tmp_path / "log"), upper)
        query.awaitTermination()
    finally:
        jobs.read_prior = kept
    progress = [p for p in query.recentProgress if p.numInputRows]
    assert len(progress) == 30 and {p.numInputRows for p in progress} == {3}
    assert len(read) == 30 and all(n == 0 and "/failed/" in path for path, n in read)
    got = spark.read.parquet(out).select("id", "output").collect()
    want = {j for i in range(30) for j in (3 * i, 3 * i + 1, max(0, 3 * i - 1))}
    assert sorted(map(tuple, got)) == sorted((j, f"TEXT {j}") for j in want)


def test_stream_survives_the_loss_of_old_results_and_retries_failures(spark, tmp_path):
    source, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    marks = tmp_path / "marks"
    marks.mkdir()

    def moody():
        def call(text):
            tries = marks / text.replace(" ", "")
            n = len(tries.read_text()) if tries.exists() else 0
            tries.write_text("x" * (n + 1))
            if text == "text 1" and n < 1 or text == "text 2":
                raise ValueError("not now")
            return text.upper()

        return call

    def arrive(*ids):
        spark.createDataFrame([(i, f"text {i}") for i in ids], KIND).coalesce(1).write.mode("append").parquet(source)
        stream = jobs.read_stream(spark, source, KIND)
        jobs.stream_enrich_state(stream, out, log, moody, retries=1, rounds=3).awaitTermination()

    arrive(1, 2, 3)
    for file in Path(out).rglob("*.parquet"):  # whoever reads an old result now, fails
        file.write_bytes(b"gone")
    arrive(4, 3)
    arrive(5)
    arrive(6, 2)
    arrive(7)
    later = [str(p) for p in sorted(Path(out).glob("batch=*"))[1:]]
    got = sorted((r.id, r.status) for p in later for r in spark.read.parquet(p).collect())
    assert got == [(1, "ok"), (2, "failed"), (2, "failed"), (4, "ok"), (5, "ok"), (6, "ok"), (7, "ok")]
    assert len((marks / "text2").read_text()) == 3  # in three batches, then no more
    assert len((marks / "text3").read_text()) == 1
