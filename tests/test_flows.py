import json
import time
from difflib import SequenceMatcher
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from lexcorpus.catalog import queries
from lexcorpus.functions.headings import classify_rules, extract_section
from lexcorpus.functions.similarity import similarity
from lexcorpus.functions.vectors import argmax
from lexcorpus.operators import consistency, enrichment, features
from lexcorpus.operators.extraction import with_verdict
from lexcorpus.plans import audit, categorize, comparison, datasets
from lexcorpus.sources import readers, writers
from lexcorpus.streaming import jobs

from .test_text_functions import random_texts


def decisions(n):
    """Invented decisions: body, heading, verdict."""
    topics = ["kira alacağı tahliye kiracı", "boşanma velayet nafaka", "işçi kıdem tazminatı fesih"]
    out = []
    for i in range(n):
        topic = topics[i % 3]
        body = f"Taraflar arasındaki {topic} uyuşmazlığı incelendi. " * (3 + i % 5)
        verdict = f"{topic} yönünden davanın kabulüne, yargılama giderine, sayı {i} oybirliğiyle karar verildi."
        out.append((str(i), body + "\nHÜKÜM:\n" + verdict, "src" + str(i % 2)))
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(decisions(300), "id string, text string, source string").repartition(4).cache()


def test_similarity(spark):
    pairs = [
        ("tide", "diet"), ("diet", "tide"), ("", ""), (None, "a"), ("a", None), (" aynı ", "aynı"),
        ("hüküm", "hukum"), ("ab" * 150, "ba" * 150), ("bir iki üç", "iki üç dört"), ("x", "x"), ("\xa0", "a"),
    ]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    cols = [similarity(F.col("a"), F.col("b"), m).alias(m) for m in ("ratio", "levenshtein", "jaccard")]
    got = df.select("i", *cols).orderBy("i").collect()
    for r, (a, b) in zip(got, pairs):
        a, b = (a or "").strip(), (b or "").strip()
        assert r.ratio == (SequenceMatcher(None, a, b).ratio() if a and b else 0.0)
    assert got[6].levenshtein == pytest.approx(1 - 2 / 5) and got[5].levenshtein == 1.0
    assert got[8].jaccard == pytest.approx(2 / 4) and got[2].jaccard == 0.0
    raw = df.select("i", similarity(F.col("a"), F.col("b"), "ratio", stripped=False).alias("v")).collect()
    assert raw[5].v == SequenceMatcher(None, " aynı ", "aynı").ratio()
    with pytest.raises(ValueError):
        similarity(F.col("a"), F.col("b"), "cosine")


@pytest.mark.parametrize("method", ["ratio", "levenshtein"])
def test_consistency(spark, method):
    outputs = {
        "one": ["abc"], "same": ["abc def"] * 5, "mixed": ["abc", "abd", "", "xyz abc", "abc"],
        "long": [("ab" * 100)[:k] for k in (199, 200, 150, 100, 200)],
    }
    rows = [(k, i + 1, o) for k, outs in outputs.items() for i, o in enumerate(outs)]
    df = spark.createDataFrame(rows, "id string, run int, output string")
    got = {r.id: r for r in consistency.consistency(df, 5, method=method).collect()}

    def sim(a, b):
        if not a or not b:
            return 0.0
        return SequenceMatcher(None, a, b).ratio()

    if method == "ratio":
        for k, outs in outputs.items():
            pairs = [sim(a, b) for a, b in combinations(outs, 2)]
            assert got[k].avg_consistency_score == pytest.approx(sum(pairs) / len(pairs) if pairs else 0.0)
    assert got["one"].avg_consistency_score == 0.0 and got["same"].avg_consistency_score == 1.0
    assert got["mixed"].run_4_output == "xyz abc" and got["one"].run_2_output is None
    with pytest.raises(Exception, match="outside 1..3"):
        consistency.runs_wide(df, 3).collect()


def flaky_factory():
    calls = {}

    def model(text):
        calls[text] = calls.get(text, 0) + 1
        if "never" in text:
            raise ValueError("no answer")
        if "second" in text and calls[text] < 2:
            raise TimeoutError("slow")
        return text.upper()

    return model


def upper_model():
    return str.upper


def test_calls_are_dealt_by_rows_and_given_up(spark):
    rows = spark.range(10_000).select("id", F.lit("x").alias("text")).coalesce(1)
    assert enrichment.enrich_text(rows, upper_model).rdd.getNumPartitions() == 20
    slow = lambda: (lambda text: time.sleep(5) or text)
    row = enrichment.enrich_text(rows.limit(1), slow, retries=1, limit=0.2).first()
    assert row.status == "failed" and row.error.startswith("TimeoutError")


def test_a_batch_that_breaks_off_keeps_finished_chunks(spark, tmp_path):
    path, mark = str(tmp_path / "results"), tmp_path / "mark"
    df = spark.range(40).select("id", F.col("id").cast("string").alias("text"))

    def breaking():
        if mark.exists() and len(list(tmp_path.glob("results/*/*.parquet"))) > 1:
            raise RuntimeError("client lost")
        return str.upper

    mark.touch()
    with pytest.raises(Exception, match="client lost"):
        enrichment.enrich_incremental(df, path, breaking, "b", chunk_rows=10)
    done = readers.read_results(spark, path).count()
    assert 0 < done < 40
    mark.unlink()
    out = enrichment.enrich_incremental(df, path, breaking, "b", chunk_rows=10)
    assert out.where("status = 'ok'").count() == 40 and readers.read_results(spark, path).count() == 40


def test_enrich(spark):
    df = spark.createDataFrame([(1, "first"), (2, "second"), (3, "never"), (4, None)], "id int, text string")
    got = {r.id: r for r in enrichment.enrich_text(df, flaky_factory, pause=0.0, partitions=2).collect()}
    assert (got[1].output, got[1].status, got[1].attempts) == ("FIRST", "ok", 1)
    assert (got[2].output, got[2].attempts) == ("SECOND", 2)
    assert (got[3].output, got[3].status, got[3].attempts, got[3].error) == (
        None, "failed", 3, "ValueError: no answer",
    )
    assert got[4].output == ""


def test_resume(spark, tmp_path):
    path = str(tmp_path / "results")
    df = spark.createDataFrame([(1, "a"), (2, "never"), (3, "c")], "id int, text string")
    opts = dict(pause=0.0)
    first = enrichment.enrich_incremental(df.where("id < 3"), path, flaky_factory, "b1", **opts)
    assert {(r.id, r.output, r.status) for r in first.collect()} == {(1, "A", "ok"), (2, None, "failed")}
    # the failed row is tried again, the good one is not; a repeated batch leaves no duplicates
    for _ in range(2):
        second = enrichment.enrich_incremental(df, path, lambda: (lambda t: t + "!"), "b2", **opts)
        assert {(r.id, r.output) for r in second.collect()} == {(1, "A"), (2, "never!"), (3, "c!")}
    done = readers.read_results(spark, path)
    assert done.count() == 4
    assert enrichment.pending(df, done).count() == 0


def test_repeat_runs_and_report(spark, corpus):
    runs = enrichment.repeat_runs(corpus.limit(3), 4, upper_model)
    assert runs.count() == 12 and runs.select("run").distinct().count() == 4
    report = comparison.consistency_report(corpus, upper_model, n=7, n_runs=3)
    rows = report.collect()
    assert len(rows) == 7 and {r.avg_consistency_score for r in rows} == {1.0}
    side = comparison.comparison_set(corpus, upper_model, n=5).collect()
    assert len(side) == 5 and all(r.text_tail_preview.startswith("...") and r.hukum_text_llm for r in side)
    table, mean = comparison.regex_vs_model(
        spark.createDataFrame([("abcd", "abcd"), ("abcd", None)], "verdict string, hukum_text_llm string")
    )
    assert mean.first().mean_score == 0.5


def test_prepare_and_labeled_frame(spark, corpus):
    out = datasets.prepare_datasets(corpus, 40).cache()
    want = {i: t.split("HÜKÜM:\n")[1] for i, t, _ in decisions(300)}
    assert {r.id: r.verdict for r in out.collect()} == want
    assert out.where("split = 'test'").count() == 40
    assign = out.select("id", (F.col("id").cast("int") % 3).alias("cluster_id")).where("id <> '7'")
    frame = datasets.build_labeled_frame(out, assign, "tag")
    assert tuple(frame.columns) == datasets.LABELED_COLUMNS
    texts = {i: t for i, t, _ in decisions(300)}
    for r in frame.collect():
        text = texts[r.id].split("\nHÜKÜM")[0].strip()
        assert (r.text, r.verdict_removed, r.tail_cues_removed) == (text, True, True)
        assert r.possible_leakage == (want[r.id] in text) and r.label == int(r.id) % 3
        assert (r.input_char_len, r.verdict_char_len) == (len(text), len(want[r.id]))
    assert frame.count() == out.count() - 1
    carried = datasets.build_labeled_frame(out.join(assign, "id"), None, "tag")
    assert carried.exceptAll(frame).count() == 0 and carried.count() == frame.count()


def test_mask_is_computed_once(spark, corpus):
    rows = corpus.withColumn("verdict", F.lit("x")).withColumn("cluster_id", F.lit(1))
    plan = datasets.build_labeled_frame(rows, None, "t")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("substring_index") == 1


def test_finetune_set(spark, corpus):
    sets = datasets.prepare_datasets(corpus, 30)
    assign = sets.select("id", (F.col("id").cast("int") % 3).alias("cluster_id"))
    results = sets.where("split = 'test'").select("id", F.lit("LLM").alias("output"))
    parts = [sets.where(F.col("split") == s).drop("split") for s in ("train", "test")]
    out = datasets.build_finetune_set(*parts, assign, results).cache()
    n = out.count()
    assert n == sets.count() and out.select("id").distinct().count() == n
    gold = out.where("source = 'gold_regex_masked'")
    assert gold.count() == 30 and gold.where("split = 'test' and llm_verdict_text = 'LLM'").count() == 30
    train = out.where("source = 'train_regex_masked'")
    assert train.where("split = 'test'").count() == -(-train.count() // 10)
    summary = {(r.metric, r.key): r.value for r in datasets.quality_summary(out).collect()}
    assert summary[("rows_per_source", "gold_regex_masked")] == 30.0
    assert summary[("rate", "verdict_removed")] == 1.0
    assert datasets.quality_rows(out, 25).count() == 25


def test_audit(spark, tmp_path):
    texts = random_texts(400, 12)
    rows = [(i if i % 9 else None, t, ["s1", "", None, "s2"][i % 4]) for i, t in enumerate(texts)] + [(999, None, "s1")]
    df = spark.createDataFrame(rows, "id int, text string, source string")
    report, predictions = audit.audit_report(df, None)
    writers.write_json_report(report, str(tmp_path / "report"))
    got = json.loads("".join(p.read_text() for p in (tmp_path / "report").glob("*.json")))
    section = extract_section(F.coalesce("text", F.lit("")))
    modes, cats = {}, {}
    for r in df.select(section["mode"].alias("m"), classify_rules(section["section"]).alias("c")).collect():
        modes[r.m] = modes.get(r.m, 0) + 1
        for c in r.c:
            cats[c] = cats.get(c, 0) + 1
    assert got["extraction_mode_counts"] == modes and got["category_counts"] == cats
    assert got["total_rows"] == got["sample_size"] == 401
    assert got["source_top_20"][0] == {"source": "unknown", "count": 200}
    assert got["char_length_stats"]["max"] == max(len(t) for t in texts)
    assert all(1 <= len(v) <= 3 for v in got["category_examples"].values())
    assert set(got["category_examples"]) == set(cats)
    long = {(r.metric, r.key): r.value for r in audit.audit_metrics(audit.audit_rows(df)).collect()}
    for name, n in got["heading_counts"].items():
        assert long[("heading", name)] == n
        assert long[("heading_rate", name)] == got["heading_rates"][name] == pytest.approx(n / 401, abs=6e-5)
    writers.write_csv_report(predictions, str(tmp_path / "csv"))
    back = readers.read_table(spark, str(tmp_path / "csv"))
    assert back.columns == list(audit.CSV_COLUMNS) and back.count() == 401
    for rows in (df, df.where("id is null")):
        small, _ = audit.audit_report(rows, 25)
        assert small.first().sample_size == 25


def test_vocabulary_and_vectors(spark):
    docs = ["elma armut elma", "armut kiraz", "elma kiraz ve kiraz", "muz", "", None, "Elma ARMUT muz"]
    df = spark.createDataFrame(list(enumerate(docs)), "id int, verdict string")
    vocab = features.vocabulary(df, size=6, min_df=2, max_df=0.5)
    rows = {r.term: r for r in vocab.collect()}
    assert {t: (r.tf, r.df) for t, r in rows.items()} == {
        "elma": (4, 3), "armut": (3, 3), "kiraz": (3, 2), "muz": (2, 2), "elma armut": (2, 2),
    }
    assert [r.term for r in vocab.orderBy("idx").collect()] == sorted(rows)
    import math

    assert rows["elma"].idf == pytest.approx(math.log(8 / 4) + 1)
    vec = features.vectorize(df, vocab)
    weights = {(r.id, r.term): r.weight for r in features.tfidf_weights(df, vocab).collect()}
    order = sorted(rows)
    for r in vec.collect():
        dense = {order[i]: v for i, v in zip(r.features.indices, r.features.values)}
        assert dense == pytest.approx({t: w for (i, t), w in weights.items() if i == r.id})
        if dense:
            assert sum(v * v for v in dense.values()) == pytest.approx(1.0)
    want = {"elma": 2 * rows["elma"].idf, "armut": rows["armut"].idf, "elma armut": rows["elma armut"].idf}
    assert weights[(0, "elma")] == pytest.approx(want["elma"] / math.sqrt(sum(v * v for v in want.values())))


def test_categorize(spark, corpus, tmp_path):
    rows = with_verdict(corpus).cache()
    out, clusters, assign = categorize.categorize(rows, k=3, min_df=2, max_df=0.9)
    assert clusters.count() == 3 and assign.count() == rows.count()
    topics = out.select("cluster_id", (F.col("id").cast("int") % 3).alias("t")).distinct()
    assert topics.count() == 3  # every cluster is one topic
    named, named_clusters, _ = categorize.categorize(
        rows, k=3, min_df=2, max_df=0.9, labeler=lambda texts: f'"Kategori: {len(texts)}"'
    )
    assert {r.name for r in named_clusters.collect()} == {"10"}

    def broken(texts):
        raise RuntimeError("down")

    samples = out.select("cluster_id", "verdict").limit(20)
    got = enrichment.name_clusters(samples, broken, "verdict", pause=0.0).collect()
    assert all(r.name == f"Kategori_{r.cluster_id}" for r in got)
    writers.write_label_map(clusters, assign, str(tmp_path / "map"))
    saved = tuple(spark.read.parquet(str(tmp_path / "map" / t)) for t in ("clusters", "assignments"))
    again, _, _ = categorize.categorize(rows, mapping=saved)
    assert again.exceptAll(out).count() == 0
    tagged = out.withColumn("origin", F.lit("a"))
    assert categorize.split_back(tagged, "origin", "a").columns == out.columns


def test_classifier(spark, corpus):
    from lexcorpus.operators.metrics import classification_metrics

    rows = with_verdict(corpus).withColumn("label", (F.col("id").cast("int") % 3).cast("double"))
    test = rows.where("id % 5 = 0")
    scored, _ = features.train_text_classifier(rows.where("id % 5 <> 0"), test, "verdict", min_df=2)
    assert classification_metrics(scored).first().macro_f1 == 1.0


def test_argmax(spark):
    df = spark.createDataFrame([([0.1, 0.7, 0.7],), ([3.0],), (None,)], "a array<double>")
    assert [r[0] for r in df.select(argmax(F.col("a"))).collect()] == [1, 0, None]


def test_sources_and_sinks(spark, corpus, tmp_path):
    path = str(tmp_path / "corpus")
    writers.write_corpus(datasets.prepare_datasets(corpus, 20), path, "split")
    test = readers.read_corpus(spark, path, "test", key="id", shard=True)
    assert test.count() == 20 and test.first().shard.endswith(".parquet")
    plan = test._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan
    for bad in (str(tmp_path / "none"),):
        with pytest.raises(FileNotFoundError):
            readers.read_corpus(spark, bad)
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        readers.read_corpus(spark, str(tmp_path / "empty"))
    doc = {"cluster_names": {"0": "İş", "1": "Ceza"}, "data_mapping": {"a": 1, "b": 0}}
    (tmp_path / "map.json").write_text(json.dumps(doc, ensure_ascii=False, indent=2))
    clusters, assign = readers.read_label_map(spark, str(tmp_path / "map.json"))
    assert {r.cluster_id: r.name for r in clusters.collect()} == {0: "İş", 1: "Ceza"}
    assert {r.id: r.cluster_id for r in assign.collect()} == {"a": 1, "b": 0}
    (tmp_path / "res.json").write_text(json.dumps({"a": "x\ny", "b": "ç"}, ensure_ascii=False, indent=2))
    assert {r.id: r.output for r in readers.read_results(spark, str(tmp_path / "res.json"), "json").collect()} == {
        "a": "x\ny", "b": "ç",
    }
    sheet = spark.createDataFrame([(1, 'say "hi",\nç'), (2, "b")], "id int, t string")
    writers.write_csv_report(sheet, str(tmp_path / "sheet"))
    back = readers.read_table(spark, str(tmp_path / "sheet"), schema="id int, t string")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, sheet.collect()))
    snap = readers.ingest_corpus(
        spark, str(tmp_path / "sheet"), "csv", str(tmp_path / "snap"), "id int, t string",
        header=True, multiLine=True, escape='"',
    )
    assert snap.count() == 2
    assert [r.id for r in readers.peek(corpus.select(F.col("id").cast("int")), 3, "id").collect()] == [0, 1, 2]
    block = writers.text_block("ID", F.col("id"), {"TEXT": F.col("t")})
    writers.write_text_report(sheet, block, str(tmp_path / "txt"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "txt").glob("part*")))
    assert "ID: 2\n" + "-" * 40 + "\nTEXT:\nb\n" in text
    writers.append_results(sheet, str(tmp_path / "res"), "x")
    writers.append_results(sheet, str(tmp_path / "res"), "x")
    assert readers.read_results(spark, str(tmp_path / "res")).count() == 2


def test_streams(spark, corpus, tmp_path):
    src = str(tmp_path / "in")
    corpus.repartition(4).write.parquet(src)
    stream = jobs.read_stream(spark, src, corpus.schema, files_per_batch=2)
    for _ in range(2):  # a second run finds nothing new
        query = jobs.stream_extract(stream, str(tmp_path / "out"), str(tmp_path / "ck1"))
        query.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    batch = with_verdict(corpus)
    assert out.count() == batch.count() and out.exceptAll(batch).count() == 0
    corpus.limit(10).write.mode("append").parquet(src)  # ids that are done already
    query = jobs.stream_enrich(
        jobs.read_stream(spark, src, corpus.schema, files_per_batch=2),
        str(tmp_path / "res"), str(tmp_path / "ck2"), upper_model,
    )
    query.awaitTermination()
    res = readers.read_results(spark, str(tmp_path / "res"))
    assert res.count() == 300 and res.select("id").distinct().count() == 300
    assert res.select("batch").distinct().count() >= 2


@pytest.mark.parametrize("name", ["stream_extract", "stream_enrich", "stream_enrich_state"])
@pytest.mark.parametrize("files", [0, 3])  # 0: one file without a folder
def test_stream_queries_read_a_file_or_a_folder(spark, tmp_path, name, files):
    text = "word " * 30 + ".\nTha" + " more" * 20
    rows = spark.createDataFrame([(i, f"{text} {i}", "en", "src1", 1) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    path = tmp_path / "documents.parquet"
    if files:
        rows.repartition(files).write.parquet(str(path))
    else:
        rows.toPandas().to_parquet(path)
        (tmp_path / "labels.parquet").write_bytes(b"not read")
    out = queries.QUERIES[name](spark, str(tmp_path))
    assert sorted(int(r.id) for r in out.collect()) == list(range(40))


def test_classifier_rows_are_masked_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def span(k):
        seen.add(1)
        return "" if k % 10 == 0 else f"span {k}"

    masked = spark.range(60).select(
        F.col("id").cast("string"), F.udf(span)("id").alias("verdict_text"), (F.col("id") % 3 * 5).cast("int").alias("label")
    )
    monkeypatch.setattr(queries, "_labeled", lambda *_: masked)
    rows = queries._classified(spark, "")
    assert sorted((int(r.id), r.label) for r in rows.collect()) == [(k, k % 3) for k in range(60) if k % 10]
    assert seen.value == 60
