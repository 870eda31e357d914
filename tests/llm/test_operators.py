"""The other corpus operators against brute-force versions, round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexcorpus.llm import cascade, hidden_markov, merkle, mixing, packing, snapshots, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KIND = "doc_id long, text string, lang string, source string, score double, copies int"
ODD = [None, "", " \t\n", "one", "İé ß\x85 x\xa0y", "a " * 3000, "Zz " * 40 + "\n\nend", "line one\nline one\n\n\nline one", "\r\n\x0b\x0c"]


def documents(spark, texts, sources=("a", "b", None)):
    rows = [(i * 7, t, "en", sources[i % len(sources)], 0.5, 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, KIND).repartition(3)


def prose(seed, n, words=(0, 5, 30, 200)):
    dice = random.Random(seed)
    stock = [f"w{int(dice.paretovariate(0.9))}" for _ in range(500)] + ["The", "the", "É", "\n", "b.\n"]
    return [" ".join(dice.choice(stock) for _ in range(dice.choice(words))) for _ in range(n)]


@pytest.fixture(scope="module")
def mixed(spark):
    texts = ODD + prose(1, 120)
    return texts, documents(spark, texts)


# -- mixing -----------------------------------------------------------------


def test_mixing_meets_targets(spark, mixed, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 8)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    texts, docs = mixed
    rows = mixing.mix_sources(docs).collect()
    size = {i * 7: len(WORD.findall(t or "")) for i, t in enumerate(texts)}
    assert {r.doc_id: r.size for r in rows} == size and len(rows) == len(texts)
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
        assert 0 <= r.taken <= 2 * r["size"]
    total = sum(size.values())
    assert sum(v[0].target for v in by.values()) == pytest.approx(1.5 * total)
    for group in by.values():
        assert group[0].source_size == sum(r["size"] for r in group)
        assert abs(sum(r.taken for r in group) - group[0].target) <= 1 and group[0].target <= 2 * group[0].source_size + 1e-6
        assert sum(r.part_words > 0 for r in group) <= 1
    again = mixing.mix_sources(docs.repartition(5)).collect()
    assert {(r.doc_id, r.taken) for r in again} == {(r.doc_id, r.taken) for r in rows}
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns
    words = sum(len(WORD.findall(r.text or "")) for r in out.collect())
    assert words == sum(r.taken for r in rows)


def test_weights_follow_code_points_and_caps(spark):
    rows = [(i, "w " * 10, "", s, 0.0, 0) for i, s in enumerate(["b"] * 10 + ["a"] * 90 + [None] * 100)]
    got = {r.source: r.target for r in mixing.mix_sources(spark.createDataFrame(rows, KIND)).collect()}
    # shares of 3000 words by 5, 2, 1: b would pass its cap of 200, a its cap of 1800
    assert got == {"a": pytest.approx(1800), "b": pytest.approx(200), None: pytest.approx(1000)}
    assert mixing.mix_sources(spark.createDataFrame([], KIND)).collect() == []


# -- packing ----------------------------------------------------------------


def test_packing_round_trip(spark, mixed):
    from tokenizers import Tokenizer

    texts = [*mixed[0], "x <|endoftext|> y", "'re don't ''s 12a ½ ١ 你好    é \x85\xa0", "🙂" * 50]
    files = packing.default_vocabulary()
    slow = Tokenizer.from_file(files["vocabulary"])
    pieces = packing.pack(documents(spark, texts), capacity=64).collect()
    by = defaultdict(list)
    for p in pieces:
        by[p.doc_id].append(p)
    assert len({p.sequence_id for p in pieces}) == len(pieces)
    for i, text in enumerate(texts):
        ids = slow.encode(text or "", add_special_tokens=False).ids + [0]
        parts = sorted(by[i * 7], key=lambda p: p.start)
        assert [x for p in parts for x in p.ids] == ids
        assert all(p.length & (p.length - 1) == 0 and p.length <= 64 and p.offset == 0 for p in parts)
        assert all(p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes()) and p.doc_tokens == len(ids) for p in parts)
    assert packing.pack(spark.createDataFrame([], KIND)).collect() == []
    batches = packing.bucket_batches(packing.pack(documents(spark, texts), capacity=64), 256)
    assert all(r["sum(length)"] <= 256 for r in batches.groupBy("batch", "bucket").sum("length").collect())


# -- quality ----------------------------------------------------------------


def test_quality_statistics(spark, mixed):
    texts = [*mixed[0], "a b c d e f g h " * 6, "### $$ |x|<y>&%", "l\nl\n l\nm\nl", "A" * 500]
    for r in cascade.judge(documents(spark, texts)).collect():
        text = texts[r.doc_id // 7] or ""
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert r.kept == (r.rejected_by is None) and not (r.base_failed and r.kept)
    assert cascade.judge(spark.createDataFrame([], KIND)).collect() == []


def test_order_of_rules_never_changes_the_verdict(spark, monkeypatch):
    clean = " ".join(f"Word{i} stands here." for i in range(40))
    docs = documents(spark, [clean, clean.replace(" ", " ### "), clean.upper(), "same line here\n" * 3 + clean])
    first = {r.doc_id: r.kept for r in cascade.judge(docs).collect()}
    assert first == {0: True, 7: False, 14: False, 21: True}
    backwards = lambda rows, rules, size: [cascade.Measured(r.name, 1.0, 0.0) for r in reversed(rules)]
    monkeypatch.setattr(cascade, "measure", backwards)
    assert {r.doc_id: r.kept for r in cascade.judge(docs).collect()} == first


def test_rules_run_by_rejection_per_cost(spark):
    slow = cascade.Rule("slow", lambda t: (sum(i for i in range(200_000)) < 0) | (t["n_words"] >= 0))
    never = cascade.Rule("never", lambda t: t["n_words"] < 0)
    quick = cascade.Rule("quick", lambda t: t["n_words"] >= 0)
    order = cascade.measure(documents(spark, prose(5, 20)), (never, slow, quick))
    assert [m.name for m in order] == ["quick", "slow", "never"]


# -- language model ---------------------------------------------------------


def test_forward_equals_the_sum_over_paths():
    dice = np.random.default_rng(3)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    emit = norm(dice.random((4, 2)), 0)
    model = hidden_markov.Model(["a", "b", "c"], np.array([1, 1, 1]), 3, 3, norm(dice.random(2), 0), norm(dice.random((2, 2)), 1), emit)
    sequences = [[0, 1, 3], [2], [1, 1, 0, 2, 3]]
    flat, at = np.array(sum(sequences, [])), np.cumsum([0, *map(len, sequences)])
    for got, seq in zip(hidden_markov.forward(flat, at, model), sequences):
        total = 0.0
        for path in np.ndindex(*[2] * len(seq)):
            p = model.start[path[0]] * emit[seq[0], path[0]]
            for k in range(1, len(seq)):
                p *= model.step[path[k - 1], path[k]] * emit[seq[k], path[k]]
            total += p
        assert got == pytest.approx(math.log(total))
    start, step, counts, score = hidden_markov.expected(flat, at, model)
    assert start.sum() == pytest.approx(3) and counts.sum() == pytest.approx(len(flat)) and step.sum() == pytest.approx(len(flat) - 3)
    assert counts.sum(axis=1) == pytest.approx(np.bincount(flat, minlength=4)) and score == pytest.approx(hidden_markov.forward(flat, at, model).sum())


def test_counts_added_in_steps_are_the_same(monkeypatch):
    dice = np.random.default_rng(5)
    emit = dice.random((40, 3))
    model = hidden_markov.Model([f"w{k}" for k in range(39)], np.ones(39, int), 39, 39, np.full(3, 1 / 3), np.full((3, 3), 1 / 3), emit / emit.sum(axis=0))
    size = dice.integers(1, 90, 50)
    at = np.concatenate([[0], np.cumsum(size)])
    symbols = dice.integers(0, 40, at[-1]).astype(np.uint16)
    whole = hidden_markov.expected(symbols, at, model)
    monkeypatch.setattr(hidden_markov, "STEP", 64)
    for a, b in zip(whole, hidden_markov.expected(symbols, at, model)):
        assert a == pytest.approx(b, rel=1e-12)
    assert whole[2].sum(axis=1) == pytest.approx(np.bincount(symbols, minlength=40))


def test_language_model_scores(spark):
    dice = random.Random(2)
    tongues = [[f"{p}{i}" for i in range(40)] for p in ("x", "y")]
    texts = [*ODD, *(" ".join(dice.choice(tongues[k % 2]) for _ in range(40)) for k in range(150))]
    docs = documents(spark, texts)
    rows = {r.doc_id: r for r in hidden_markov.score_corpus(docs, alphabet=60, states=3).collect()}
    tokens = {i * 7: [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), b"\n"] for i, t in enumerate(texts)}
    counts = Counter(w for k, t in tokens.items() if zlib.crc32(str(k).encode()) % 10 for w in t)
    n, v, sums = sum(counts.values()), len(counts), [0.0, 0.0]
    for k, words in tokens.items():
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        r = rows[k]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(counts[w] > 0 for w in words), n)
        assert r.base_score == pytest.approx(base) and r.held_out == (zlib.crc32(str(k).encode()) % 10 == 0)
        if r.held_out:
            sums = [sums[0] + base, sums[1] + r.score]
    assert sums[1] > sums[0]  # the states learn which tongue a text is in
    assert hidden_markov.score_corpus(spark.createDataFrame([], KIND)).collect() == []


@pytest.mark.parametrize("sizes", [(300, 1), (1000,), (1, 40, 1000, 7, 300, 128, 129)])
def test_expected_counts_are_those_of_whole_texts(sizes):
    """Against forward and backward sums in plain Python, by lanes far shorter than the texts and by none."""
    dice = np.random.default_rng(5)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    states, alphabet = 3, 6
    emit, step = norm(dice.random((alphabet, states)) ** 4 + 1e-6, 0), norm(dice.random((states, states)) ** 3, 1)
    words = [f"w{k}" for k in range(alphabet - 1)]
    model = hidden_markov.Model(words, np.ones(alphabet - 1, int), 5, 5, norm(dice.random(states), 0), step, emit)
    texts = [dice.integers(0, alphabet, n).tolist() for n in sizes]
    starts, steps, counts, scores = np.zeros(states), np.zeros((states, states)), np.zeros((alphabet, states)), []
    for text in texts:
        ahead, score = [], 0.0
        for t, symbol in enumerate(text):
            row = [(model.start[k] if not t else sum(ahead[-1][j] * step[j, k] for j in range(states))) * emit[symbol, k] for k in range(states)]
            score += math.log(sum(row))
            ahead.append([x / sum(row) for x in row])
        scores.append(score)
        behind = [1.0] * states
        for t in range(len(text) - 1, -1, -1):
            both = [ahead[t][k] * behind[k] for k in range(states)]
            for k in range(states):
                counts[text[t], k] += both[k] / sum(both)
                starts[k] += both[k] / sum(both) if t == 0 else 0.0
            if t:
                pairs = np.array([[ahead[t - 1][j] * step[j, k] * emit[text[t], k] * behind[k] for k in range(states)] for j in range(states)])
                steps += pairs / pairs.sum()
                behind = [sum(step[j, k] * emit[text[t], k] * behind[k] for k in range(states)) for j in range(states)]
                behind = [x / sum(behind) for x in behind]
    flat, at = np.array(sum(texts, []), np.int32), np.cumsum([0, *sizes])
    for long, lane in ((10**9, 512), (128, 64), (16, 7), (1, 1)):
        assert hidden_markov.forward(flat, at, model, long, lane) == pytest.approx(scores)
        for kind, near in ((np.float64, 1e-6), (np.float32, 1e-3)):
            found = hidden_markov.expected(flat, at, model, long, lane, kind)
            assert found[0] == pytest.approx(starts, rel=near, abs=near) and found[1] == pytest.approx(steps, rel=near, abs=near)
            assert found[2] == pytest.approx(counts, rel=near, abs=near) and found[3] == pytest.approx(sum(scores), rel=near)
    assert found[0].sum() == pytest.approx(len(sizes), rel=1e-5) and found[1].sum() == pytest.approx(sum(sizes) - len(sizes), rel=1e-5)


def test_training_does_not_depend_on_the_layout(spark, monkeypatch):
    docs = documents(spark, [*ODD, *prose(3, 80, (0, 5, 700))])
    whole = {r.doc_id: r.score for r in hidden_markov.score_corpus(docs, alphabet=60, states=3, passes=4).collect()}
    monkeypatch.setattr(hidden_markov, "BLOCK_TOKENS", 900)
    small = {r.doc_id: r.score for r in hidden_markov.score_corpus(docs.repartition(7), alphabet=60, states=3, passes=4).collect()}
    assert small == pytest.approx(whole, rel=1e-4)


def test_every_pass_covers_every_training_text(spark, monkeypatch):
    seen, improved = [], hidden_markov._improved

    def counted(encoded, model):
        seen.append((encoded.selectExpr("sum(size(symbols))").first()[0], model.total))
        return improved(encoded, model)

    monkeypatch.setattr(hidden_markov, "_improved", counted)
    monkeypatch.setattr(hidden_markov, "WARM_UP_TOKENS", 50, raising=False)  # a sample has no place in training
    hidden_markov.score_corpus(documents(spark, prose(9, 60)), alphabet=60, states=3).collect()
    assert len(seen) == hidden_markov.PASSES and all(tokens == total > 50 for tokens, total in seen)


@pytest.mark.parametrize("words", [["a", "b", "\n"], [*(f"w{k}" for k in range(70_000)), "a", "b", "\n"]])
def test_symbols_are_written_as_bytes(spark, words):
    model = hidden_markov.Model(words, np.ones(len(words), int), len(words), len(words), *[np.zeros(0)] * 3)
    docs = spark.createDataFrame([(1, 10, "a B zz b"), (2, 20, None), (3, 30, "b")], "doc_id long, row long, text string")
    encoded = hidden_markov.encode(docs, model)
    first = len(words) - 3
    want = {10: [first, first + 1, first + 3, first + 1, first + 2], 20: [first + 2], 30: [first + 1, first + 2]}
    assert {r.row: r.symbols for r in encoded.select("row", "symbols").collect()} == want
    assert dict(encoded.dtypes)["packed"] == "binary" and encoded.where("get(rare, 0).token = 'zz'").count() == 1
    batches = encoded.select("row", "packed").toArrow().to_batches()
    for batch in (batches, [b.slice(1) for b in batches]):
        for rows, symbols, at in hidden_markov._blocks(iter(batch), hidden_markov._kind(words)):
            got = [symbols[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
            assert got == [want[r] for r in rows.column("row").to_pylist()]


# -- toxicity ---------------------------------------------------------------


def test_nearest_examples_are_exact():
    dice = random.Random(8)
    terms = [f"t{i}" for i in range(60)]
    counts = [Counter({dice.randrange(60): dice.randint(1, 4) for _ in range(dice.randint(0, 6))}) for _ in range(400)]
    model = {"vocabulary": terms, "idf": np.linspace(1, 3, 60), "ids": list(range(400)), "toxic": [i % 2 for i in range(400)], "counts": counts}
    index = toxicity._index(model)

    def dense(c):
        x = np.zeros(60)
        for k, n in c.items():
            x[k] = (1 + math.log(n)) * model["idf"][k]
        return x / max(np.linalg.norm(x), 1e-12)

    grid = np.stack([dense(c) for c in counts])
    for c in counts[:60]:
        cosine = np.round(grid @ dense(c), 9)
        want = sorted(((-s, i) for i, s in enumerate(cosine.tolist()) if s > 0))[: toxicity.NEIGHBOURS]
        got = [(-s, int(index.ids[r])) for s, r in index.nearest(c)]
        assert [i for _, i in got] == [i for _, i in want]
        assert [s for s, _ in got] == pytest.approx([s for s, _ in want])


@pytest.mark.parametrize("numbers", [1_000_000, 900])
def test_blocks_are_skipped_and_nothing_is_lost(monkeypatch, numbers):
    dice = np.random.default_rng(4)
    monkeypatch.setattr(toxicity, "SHARD_NUMBERS", numbers)  # one shard, or many
    monkeypatch.setattr(toxicity, "KEPT_NUMBERS", 2 * numbers)
    # families with words of their own and words that many share, and half of the vectors twice: ties at the last place
    counts = [Counter({k: int(dice.integers(1, 3)) for k in [*dice.choice(12, 4, replace=False).tolist(), *range(40 + i % 30 * 8, 48 + i % 30 * 8)]}) for i in range(600)]
    counts += counts[:300] + [Counter()]
    idf = np.concatenate([np.full(40, 0.3), np.full(300, 2.0)])
    index = toxicity._index({"idf": idf, "ids": list(range(901)), "toxic": [0] * 901, "counts": counts})
    grid = np.zeros((901, 340))
    for i, c in enumerate(counts):
        for k, n in c.items():
            grid[i, k] = (1 + math.log(n)) * idf[k]
    grid /= np.maximum(np.linalg.norm(grid, axis=1), 1e-12)[:, None]
    asked = [*range(0, 900, 7), 900]
    for got, i in zip(index.nearest_all(toxicity._flat([counts[i] for i in asked])), asked):
        cosine = np.round(grid @ grid[i], 9).tolist()
        want = sorted((-s, k) for k, s in enumerate(cosine) if s > 0)[: toxicity.NEIGHBOURS]
        assert [int(index.ids[r]) for _, r in got] == [k for _, k in want]
        assert [s for s, _ in got] == pytest.approx([-s for s, _ in want], abs=2e-9)
    alone = index.nearest_all(toxicity._flat(counts[:5]), leave=[0, 1, 2, 3, 4])
    assert all(i not in {int(index.ids[r]) for _, r in near} for i, near in enumerate(alone))
    if numbers == 1_000_000:
        (shard,) = index.shards()
        assert index.shared and 0 < shard.opened < 0.5 * shard.rows * (len(asked) + 5)


@pytest.mark.parametrize("numbers", [1_000_000, 700])
def test_queries_multiplied_untried_find_the_same(monkeypatch, numbers):
    dice = np.random.default_rng(9)
    for name, value in (("SHARD_NUMBERS", numbers), ("KEPT_NUMBERS", numbers), ("PIECE", 100), ("STEP", 50), ("PROBES", 2)):
        monkeypatch.setattr(toxicity, name, value)  # rows and postings are handled in small pieces
    # terms that nearly all rows share decide, so every query has to open most rows
    counts = [Counter({k: int(dice.integers(1, 9)) for k in [*dice.choice(20, 12, replace=False).tolist(), 20 + i % 200]}) for i in range(300)]
    idf = np.concatenate([np.full(20, 2.0), np.full(200, 0.1)])
    index = toxicity._index({"idf": idf, "ids": list(range(300)), "toxic": [0] * 300, "counts": counts})
    tried = []
    search = toxicity.Shard.search
    monkeypatch.setattr(toxicity.Shard, "search", lambda *a: tried.append(1) or search(*a))
    grid = np.zeros((300, 220))
    for i, c in enumerate(counts):
        for k, n in c.items():
            grid[i, k] = (1 + math.log(n)) * idf[k]
    grid /= np.linalg.norm(grid, axis=1)[:, None]
    for i, got in enumerate(index.nearest_all(toxicity._flat(counts[:100]))):
        want = sorted((-s, k) for k, s in enumerate(np.round(grid @ grid[i], 9).tolist()))[: toxicity.NEIGHBOURS]
        assert [int(index.ids[r]) for _, r in got] == [k for _, k in want]
        assert [s for s, _ in got] == pytest.approx([-s for s, _ in want], abs=2e-9)
    if numbers == 1_000_000:
        assert len(tried) == 2


def test_texts_are_not_shuffled_for_their_labels(spark):
    docs = documents(spark, ["one two", "three four", None])
    labels = spark.createDataFrame([(7, 1), (14, 0)], "doc_id long, toxic int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = toxicity.examples(docs, labels)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and {r.doc_id for r in rows.collect()} <= {7, 14}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_one_vocabulary_finds_the_longest_term():
    words = ["abcd*", "abcde*", "abcdefg", "xy"]
    numbers = toxicity._Numbers(words)
    found = [numbers[w] for w in ("abcdefg", "abcdefz", "abcdzzz", "abcd", "xy", "q", "abcdefz")]
    assert found == [2, 1, 0, -1, 3, -1, 1] and len(numbers) == len(words)


def test_one_pass_scores_as_two(spark):
    texts = [f"common{i % 3} word{i % 7} vile{'ness' * (i % 2)} x{i % 11}" for i in range(120)]
    docs = documents(spark, [*texts, None, ""]).withColumn("keys", F.lit("own")).withColumn("row", F.lit(1))
    labels = spark.createDataFrame([(i * 7, i % 2) for i in range(120)], "doc_id long, toxic int")
    two = toxicity.scored(docs, toxicity.fit(docs, labels))
    one = toxicity.fit_and_score(docs, labels)
    assert one.columns == two.columns == [*docs.columns, "toxicity", "evidence"]
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_toxic_texts_are_found(spark):
    dice = random.Random(6)
    texts = []
    for i in range(400):
        words = [f"w{dice.randrange(300)}" for _ in range(dice.randint(5, 60))]
        if i % 5 == 0:
            words[dice.randrange(len(words))] = dice.choice(["vile", "Vileness,", "foul"])
        texts.append(" ".join(words))
    docs = documents(spark, [*texts, None, ""])
    labels = spark.createDataFrame([(i * 7, int(i % 5 == 0)) for i in range(300)] + [(None, 1), (7, None), (7, 0)], "doc_id long, toxic int")
    out = toxicity.scored(docs, toxicity.fit(docs, labels))
    assert out.columns == [*docs.columns, "toxicity", "evidence"]
    for r in out.collect():
        assert 0 <= r.toxicity <= 1 and (r.toxicity >= 0.5) == (r.doc_id // 7 % 5 == 0 and r.doc_id // 7 < 400)
    nothing = toxicity.scored(docs, toxicity.fit(docs, labels.limit(0)))
    assert {r.toxicity for r in nothing.collect()} == {0.0}
    empty = docs.limit(0)
    assert toxicity.scored(empty, toxicity.fit(empty, labels)).collect() == []


def test_every_term_of_an_example_counts(spark):
    dice = random.Random(12)
    stock = ["sun", *(f"q{a}{b}" for a in "abcdefghijkl" for b in "abcdefghijkl")]
    texts = [" ".join(dice.sample(stock, 30)) + (" vile" if i % 2 else " mild") for i in range(200)]
    labels = spark.createDataFrame([(i * 7, i % 2) for i in range(200)], "doc_id long, toxic int")
    docs = documents(spark, [*texts, *(t.replace(" vile", "").replace(" mild", "") for t in texts[:20])])
    model = toxicity.fit(docs, labels)
    learned = {int(i) for i in model["ids"]}
    # half of the examples are toxic, so no term is three times as frequent among them
    assert set(model["vocabulary"]) >= {"vile", "mild", "sun"}
    rows = toxicity.scored(docs, model).collect()
    assert len({r.toxicity for r in rows}) > 100
    for r in rows:
        own = r.doc_id if r.doc_id < 1400 else r.doc_id - 1400  # the last are copies without the telling word
        if own in learned:
            assert r.evidence[0].doc_id == own and len(r.evidence) == toxicity.NEIGHBOURS
    pure = toxicity.scored(docs, toxicity.fit(docs, labels.where("toxic = 1")))
    assert all(r.toxicity >= 0.5 for r in pure.collect())


# -- fingerprints -----------------------------------------------------------


def test_fingerprints_and_edits(spark, mixed):
    texts = [*mixed[0], mixed[0][30]]
    docs = documents(spark, texts)
    rows = {r.doc_id: r for r in merkle.compare_with_edits(docs).collect()}
    roots = defaultdict(set)
    for i, text in enumerate(texts):
        text, after = text or "", texts[(i + 1) % len(texts)] or ""
        half, r = len(text) // 2, rows[i * 7]
        other = text[: len(text) - half] + after[:half]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(other.encode()).hexdigest()
        assert r.edited_fingerprint == merkle.tree(other)[0].hex()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and (r.near_next == 1) == (text == after)
        roots[text].add(r.fingerprint)
    assert all(len(v) == 1 for v in roots.values()) and len(set.union(*roots.values())) == len(roots)
    one = spark.createDataFrame([(None, "x y", "", "", 0.0, 0)], KIND)
    assert merkle.compare_with_edits(one).first().near_next == 1.0
    assert merkle.compare_with_edits(docs.limit(0)).collect() == []


def test_differing_branches_locate_an_edit():
    text = "\n".join(" ".join(f"p{i}w{j}" for j in range(50)) for i in range(30))
    at = text.index("p17w20")
    changed = text[:at] + "CHANGED" + text[at + 6 :]
    left, right = merkle.tree(text), merkle.tree(changed)
    ((start, end),) = merkle.edits(left, right)
    assert start <= at and end >= at + 7 and end - start < 600
    assert merkle.likeness(left, right) > 0.9 and merkle.edits(left, left) == []


# -- archives ---------------------------------------------------------------


def test_archive_round_trip(spark, tmp_path):
    big = "<html>" + "é" * 300
    pages = [
        (1, "http://b.example.com/x?q=1", big), (2, "https://A.Example.com:8080/", "small"), (3, "http://b.example.com/x?q=1", big),
        (4, None, None), (5, "not a url", ""), (6, "http://[broken", big + "!"), (None, "http://c.org/ü\r\n", big), (1, "http://z.net", big),
        (9, "http://b.example.com/x?q=1", "small"), (10, "http://b.example.com", "x" * 100_000),
    ]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, payload string").repartition(3)
    folder = str(tmp_path / "warc")
    captures = warc.write_archives(df, folder)
    shards = warc.write_index(captures, folder, lines=2)
    rows = warc.fetch(warc.lookup(captures.select("key"), shards, folder), folder).collect()
    want = Counter()
    for page, _, html in pages:
        raw = (html or "").encode()
        revisit = html == big and page == 3
        want[page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", 1 if revisit else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows) == want
    by_page = {r.page_id: r for r in rows}
    assert by_page[10].payload == b"x" * 100_000 and by_page[3].payload is None
    one = warc.lookup(spark.createDataFrame([(warc.url_key("https://b.example.com/x?q=1#top"),), ("none",)], "key string"), shards, folder)
    assert sorted(r.page_id for r in one.collect()) == [1, 3, 9]
    assert warc.url_key("http://www.a.org") == "org,a,www)/"
    assert warc.write_and_read(df.limit(0)).collect() == []


# -- conversations ----------------------------------------------------------


def test_snapshots_collapse(spark):
    turns = [("user", "hi"), ("assistant", "hello"), ("user", None), ("assistant", "bye")]
    log = [(1, k, r, t) for k, (r, t) in enumerate(turns[:2])] + [(2, k, r, t) for k, (r, t) in enumerate(turns)]
    log += [(3, k, r, t) for k, (r, t) in enumerate(turns)] + [(4, 0, "user", "hi"), (4, 1, "assistant", "other")]
    log += [(5, 7, "user", "hi"), (5, 7, "user", "hi"), (6, None, None, ""), (None, 0, "user", "alone")]
    df = spark.createDataFrame([(*r, 1) for r in log], "conv_id long, turn long, role string, text string, copies int").repartition(3)
    rows = {r.conv_id: (r.n_turns, r.copies) for r in snapshots.rendered(df).collect()}
    assert rows == {2: (4, 2), 4: (2, 1), 6: (1, 1), None: (1, 1)}
    text = {r.conv_id: r.rendered for r in snapshots.rendered(df).collect()}
    assert text[4] == "<|user|>\nhi\n<|end|>\n<|assistant|>\nother\n<|end|>\n" and text[6] == "<|user|>\n\n<|end|>\n"
    assert snapshots.rendered(df.limit(0)).collect() == []


def test_rows_without_conversation_are_single_turns(spark):
    log = [(1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (2, 0, "user", "one"), (None, 0, "user", "hi"), (None, 3, None, "hi")]
    log += [(None, 0, "user", "one"), (None, 1, "user", "one"), (None, 1, "user", "one")]
    log += [(None, 5, "user", "two"), (None, 6, "assistant", "two"), (None, None, None, None)]
    df = spark.createDataFrame(log, "conv_id long, turn long, role string, text string").repartition(3)
    rows = Counter((r.conv_id, r.n_turns, r.copies, r.rendered.count("two")) for r in snapshots.rendered(df).collect())
    # "hi" continues in 1; "one" equals 2 and stands there twice more; the others stay for themselves
    assert rows == {(1, 2, 1, 0): 1, (2, 1, 3, 0): 1, (None, 1, 1, 1): 2, (None, 1, 1, 0): 1}
    many = spark.range(3000).select(
        F.lit(None).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text")
    )
    assert snapshots.rendered(many.unionByName(df)).count() == 3005


def test_tied_turns_are_ordered_by_whole_text(spark):
    log = []
    for k in range(40):  # hashes put the two texts of about half of the pairs the other way round
        head = f"{k} " + "same words " * 10
        log += [(2 * k, 0, "user", head + "a"), (2 * k + 1, 0, "user", head + "a"), (2 * k + 1, 0, "user", head + "b")]
    df = spark.createDataFrame(log, "conv_id long, turn long, role string, text string")
    rows = {r.conv_id: (r.n_turns, r.copies) for r in snapshots.rendered(df).collect()}
    assert rows == {2 * k + 1: (2, 1) for k in range(40)}


# -- pipeline ---------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as pipeline

    dice = random.Random(4)
    words = [f"word{i}" for i in range(3000)]
    base = [" ".join(dice.choice(words) for _ in range(dice.randint(30, 120))) for _ in range(60)]
    shared = " ".join(dice.choice(words) for _ in range(60))
    texts = [t + (" vile" if i % 6 == 0 else "") for i, t in enumerate(base)]
    texts += [base[1], base[2] + " x", base[3] + " " + shared, base[4] + "\n" + shared, None, ""]
    rows = [(i, t, "en", "ab"[i % 2], len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, int(i % 6 == 0)) for i in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    seen, now = {}, spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in pipeline.STAGES[:-1]:
        before = now
        now = pipeline.keep(stage(spark, now, str(tmp_path)), f"test-{name}")
        assert now.columns == before.columns
        seen[name] = {r.doc_id: r.text for r in now.collect()}
    clean = {i for i in range(len(texts)) if i >= 60 or i % 6}
    assert set(seen["toxicity"]) == clean
    assert set(seen["near_dedup"]) == clean - {60, 61}
    left = seen["suffix_array"]
    assert set(left) >= clean - {60, 61, 62, 63} and shared in left[62] and shared not in left[63]
    assert all(left[i] == base[i] for i in clean if i < 60)
    assert set(seen["mixing"]) <= set(left)
    packed = pipeline.run(spark, str(tmp_path)).collect()
    assert packed and all(p.length == len(p.ids) and p.length & (p.length - 1) == 0 for p in packed)
