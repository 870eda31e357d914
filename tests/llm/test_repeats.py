"""Removal of repeated byte windows against a brute-force version."""

from __future__ import annotations

import hashlib
import random

from lexcorpus.llm.repeats import cut_repeats, digest

KIND = "doc_id long, text string, lang string, kept string"


def brute(rows, depth):
    texts = [(d, (t or "").encode()) for d, t in rows]
    first = {}
    for doc, text in texts:
        if doc is None:
            continue
        for s in range(len(text) - depth + 1):
            w = text[s : s + depth]
            first[w] = min(first.get(w, (doc, s)), (doc, s))
    out = []
    for doc, text in texts:
        gone = [False] * len(text)
        for s in range(len(text) - depth + 1):
            if doc is not None and first[text[s : s + depth]] < (doc, s):
                gone[s : s + depth] = [True] * depth
        kept = bytes(b for b, g in zip(text, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, depth, gram):
    docs = spark.createDataFrame([(d, t, "x", "clash") for d, t in rows], KIND).repartition(3)
    got = digest(cut_repeats(docs, depth, gram)).collect()
    return sorted((tuple(r) for r in got), key=str)


def texts(seed, n, alphabet):
    dice = random.Random(seed)
    passages = ["".join(dice.choice(alphabet) for _ in range(dice.randint(5, 90))) for _ in range(6)]
    out = []
    for _ in range(n):
        parts = [dice.choice(passages) if dice.random() < 0.5 else "".join(dice.choice(alphabet) for _ in range(dice.randint(0, 40))) for _ in range(dice.randint(0, 6))]
        out.append("".join(parts))
    return out


def test_random_texts(spark):
    for seed, alphabet in ((1, "ab"), (2, "abcdefgh é\n"), (3, "a")):
        rows = list(enumerate(texts(seed, 40, alphabet)))
        random.Random(seed).shuffle(rows)
        assert run(spark, rows, 20, 7) == brute(rows, 20)


def test_nulls_ties_repeats_and_empty(spark):
    long = "".join(random.Random(4).choice("abcdefghij") for _ in range(30_000))
    rows = [(1, None), (2, ""), (3, long), (5, long), (5, long), (None, long[:200]), (None, "short"), (7, "x" * 99), (8, "x" * 99), (9, "y" * 300)]
    assert run(spark, rows, 100, 32) == brute(rows, 100)
    assert digest(cut_repeats(spark.createDataFrame([], KIND))).collect() == []


def test_different_texts_of_one_id_are_documents_of_their_own(spark):
    dice = random.Random(8)
    word = lambda n: "".join(dice.choice("abcdefghij") for _ in range(n))
    shared, long, short, other, last = word(300), word(4000) + "X", word(50) + "Y", word(1500), word(200) + "Z"
    rows = [(1, shared), (2, long + shared), (2, short + shared), (2, other), (2, other), (3, last + other[:400]), (None, shared)]
    docs = spark.createDataFrame([(d, t, "mine", "own", [1]) for d, t in rows], "doc_id long, text string, doc string, spans string, _doc array<int>")
    got = cut_repeats(docs.repartition(4)).collect()
    kept = {(r.doc_id, r.text): bytes(r.kept).decode() for r in got}
    assert kept == {
        (1, shared): shared, (2, long + shared): long, (2, short + shared): short, (2, other): other,
        (3, last + other[:400]): last, (None, shared): shared,
    }
    assert len(got) == 7 and all((r.doc, r.spans, r["_doc"]) == ("mine", "own", [1]) for r in got)
