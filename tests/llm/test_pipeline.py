"""Stages of the pipeline on repeated ids and clashing names, and its pieces against plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from lexcorpus.llm.mixing import mix_sources

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["text_hash", "_copy", "_words", "_copies", "kept", "n_bytes", "removed", "doc", "spans", "toxicity", "evidence", "number", "copy", "first", "size"]


def words_of(dice, n):
    return " ".join(f"word{dice.randrange(4000)}" for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    dice, path = random.Random(11), tmp_path_factory.mktemp("pipeline")
    texts = [words_of(dice, dice.randint(20, 150)) + (" vile" if i % 5 == 0 else "") for i in range(40)]
    rows = [(i, t, "en", "abc"[i % 3], len(t)) for i, t in enumerate(texts)]
    rows += [(90, texts[1], "en", "a", 1), (91, None, "en", "b", None), (92, "", None, None, 0)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(path / "documents.parquet"))
    labels = [(i, 1, int(i % 5 == 0)) for i in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path)


def test_ids_with_several_texts_lose_nothing(spark, folder):
    dice = random.Random(5)
    a, b, c = (words_of(dice, 60) for _ in range(3))
    rows = [(1, a, "en", "s"), (1, b, "en", "s"), (2, c, "en", "s"), (2, c, "en", "s"), (3, a, "de", "s"), (None, c + " x", "en", "s")]
    rows += [(None, b, "en", "s"), (None, words_of(dice, 50), None, "s"), (4, None, None, None), (None, None, None, None)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], COLUMNS)
    kept = [(r.doc_id, r.text) for r in pipeline.near_dedup(spark, docs, folder).collect()]
    want = [(1, a), (1, b), (2, c), rows[7][:2], (4, None)]
    # a text without words is alike to none; rows that repeat a null text without id or with one stay apart
    assert sorted(kept, key=str) == sorted([*want, (None, None)], key=str)
    both = [(1, a, "en", "x", 0), (1, a, "en", "y", 0), (1, b, "en", "y", 0), (2, c, "en", None, 0)]
    mixed = pipeline.mixing(spark, spark.createDataFrame(both, COLUMNS), folder).collect()
    taken = Counter((r.doc_id, r.source, r.text) for r in mixed)
    sizes = {r.source: (r.target, sum(len(m.text.split()) for m in mixed if m.source == r.source)) for r in mix_sources(spark.createDataFrame(both, COLUMNS)).collect()}
    assert {s for _, s, _ in taken} == {"x", "y", None}
    assert all(abs(target - words) <= 1 for target, words in sizes.values())


def test_clashing_names_come_back_as_they_are(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    rows = [(*r, *[f"{c} {r.doc_id}" for c in CLASHES]) for r in docs]
    now = spark.createDataFrame(rows, COLUMNS + "".join(f", `{c}` string" for c in CLASHES))
    for name, stage in pipeline.STAGES[:-1]:
        columns = now.columns
        now = pipeline.keep(stage(spark, now, folder), f"test-{name}")
        assert now.columns == columns
        found = now.collect()
        assert found and all(r[c] == f"{c} {r.doc_id}" for r in found for c in CLASHES)
    assert pipeline.packing(spark, now, folder).count()


def test_pieces_equal_a_plain_pass_over_the_mix(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in pipeline.STAGES[:3]:
        docs = pipeline.keep(stage(spark, docs, folder), f"plain-{name}")
    left = docs.collect()
    targets = {r.source: r.target for r in mix_sources(docs).collect()}
    mixed = pipeline.mixing(spark, docs, folder).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    words = Counter()
    for r in mixed:
        words[r.source] += count(r.text)
    assert all(abs(words[s] - target) <= 1 for s, target in targets.items())
    whole = {r.doc_id: r.text for r in left}
    assert all((whole[r.doc_id] or "").startswith(r.text or "") for r in mixed)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in mixed:
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        start = 0
        for bit in reversed(range(11)):
            while len(ids) - start >= 1 << bit:
                want[(r.doc_id, start, tuple(ids[start : start + (1 << bit)]))] += 1
                start += 1 << bit
    pieces = pipeline.run(spark, folder).collect()
    assert Counter((p.doc_id, p.start, tuple(p.ids)) for p in pieces) == want
