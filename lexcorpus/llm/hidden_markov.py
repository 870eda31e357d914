"""Hidden Markov language model, trained by Baum-Welch over the whole corpus.

Tokens are words and one end per text. Their exact counts over all training texts are a table of
the corpus. The latent model's alphabet is the most frequent tokens (``ALPHABET`` at most, all of
one count or none), one symbol each, and one symbol for all others, known or not. Inside that last symbol a token has its smoothed
share of the counts, so the model is a distribution over all known tokens and one unknown, like
the base score. The alphabet bounds the model (``ALPHABET * STATES`` numbers), not the corpus:
the tokens behind the last symbol are joined with the count table, however many there are.

Training: every partition runs the scaled forward-backward recursion over its texts and gives out
expected counts of states, steps and symbols; these are added up by symbol, combined before the
exchange, and re-estimated. The start is random; each of the ``PASSES`` runs over every training
text, from its first token to its last. Scoring runs the scaled forward recursion over whole texts,
which gives their exact likelihood.

All texts of a block advance together, a lane each. Texts of more than ``LONG`` tokens, unless ``WIDTH``
texts of the block are as long, are laid out as several lanes of ``LANE`` tokens. That cuts nothing: the product of its steps tells what each lane
does to any state it is entered with, so the states at all lane edges follow exactly, forwards and
backwards, and the step over an edge is counted like any other.

A null text is an empty one: a single end token. Repeated rows are rows of their own. A null id
has the remainder of an empty string and belongs to the held-out part. Without training texts
every token is unknown.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .common import chunks, keep

ALPHABET = 1 << 15
STATES = 8
PASSES = 10
LONG, LANE, WIDTH = 2048, 256, 64  # layout only, the result is the same
BLOCK_TOKENS = 1 << 20
STEP = 1 << 16  # tokens counted at once
END = "\n"  # no word contains white space
SMOOTHING = 0.1


def remainder(doc_id: Column, divisor: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


@dataclass
class Model:
    """``words`` in order of their symbol; symbol ``len(words)`` is everything else."""

    words: list[str]
    counts: np.ndarray  # of the words
    total: int  # N: training tokens
    distinct: int  # V: distinct training tokens
    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray  # symbols x states

    @property
    def rest(self) -> float:
        """Smoothed mass of the last symbol: its tokens, and the unknown one."""
        seen = self.total - int(self.counts.sum())
        return seen + SMOOTHING * (self.distinct - len(self.words) + 1)


def token_counts(docs: DataFrame) -> DataFrame:
    """``token, c`` over all rows of ``docs``; each task counts what it holds before the exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()
        rows = 0

        def flush() -> pa.RecordBatch:
            names, counts = list(found), list(found.values())
            if rows:
                names.append(END.encode())
                counts.append(rows)
            return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], names=["token", "c"])

        for batch in batches:
            for part in chunks(batch, "text"):
                for text in part.column("text").cast(pa.binary()).to_pylist():
                    found.update((text or b"").lower().split())
                rows += part.num_rows
                if len(found) > 200_000:
                    yield flush()
                    found, rows = Counter(), 0
        yield flush()

    partial = docs.select("text").mapInArrow(run, "token string, c long")
    return partial.groupBy("token").agg(F.sum("c").alias("c"))


def _symbols(part: pa.RecordBatch, alphabet: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, list[Counter]]:
    """Symbols of all texts, where each text's begin, and the counts of the words behind the last symbol."""
    other, end = len(alphabet), alphabet.get(END.encode(), len(alphabet))
    symbols, at, rare = [], [0], []
    for text in part.column("text").cast(pa.binary()).to_pylist():
        words = (text or b"").lower().split()
        own = np.empty(len(words) + 1, np.int32)
        own[:-1] = np.fromiter(map(alphabet.get, words, repeat(other)), np.int32, len(words))
        own[-1] = end
        symbols.append(own)
        at.append(at[-1] + len(own))
        rare.append(Counter([words[k] for k in np.flatnonzero(own[:-1] == other).tolist()]))
    return np.concatenate(symbols) if symbols else np.zeros(0, np.int32), np.array(at), rare


class Lanes:
    """Sequences side by side, longest first. Tokens are in the order of their time, so one step of all is one slice."""

    def __init__(self, symbols: np.ndarray, at: np.ndarray):
        size = np.diff(at)
        self.order = np.argsort(-size, kind="stable")
        rank = np.empty_like(self.order)
        rank[self.order] = np.arange(len(size))
        alive = np.searchsorted(-size[self.order], -np.arange(int(size.max(initial=0))), "left")
        self.edge = np.concatenate([[0], np.cumsum(alive)])
        kind = np.int32 if len(symbols) < 1 << 31 else np.int64
        self._rank = np.repeat(rank.astype(kind), size)
        time = np.arange(len(symbols), dtype=kind) - np.repeat(at[:-1].astype(kind), size)
        place = self.edge.astype(kind)[time] + self._rank
        self._place, self.symbols = place, np.empty(len(symbols), np.intp)  # looked up as they are
        self.symbols[place] = symbols

    def slices(self) -> list[tuple[int, int]]:
        return list(pairwise(self.edge.tolist()))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of ``values`` by lane, in the lanes' own order."""
        result = np.empty(len(self.order))
        result[self.order] = np.bincount(self._rank, values[self._place], len(self.order))
        return result


def _lane_edges(at: np.ndarray, long: int | None, lane: int) -> tuple[np.ndarray, np.ndarray]:
    """Where lanes begin (and the last one ends), and the text of each lane. Without ``long`` the block decides."""
    size = np.diff(at)
    if long is None:  # a step of many texts costs less than the products of their lanes
        long = max(LONG, int(np.partition(size, len(size) - WIDTH)[len(size) - WIDTH])) if len(size) >= WIDTH else LONG
    parts = np.where(size > long, -(-size // lane), 1)
    text = np.repeat(np.arange(len(size)), parts)
    inner = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
    return np.append(at[:-1][text] + inner * lane, at[-1]), text


def _products(symbols: np.ndarray, at: np.ndarray, model: Model) -> np.ndarray:
    """``[lane, out, in]``: the state after a lane that is entered in one state, up to one factor by lane."""
    lanes, states = Lanes(symbols, at), len(model.start)
    emit = np.take(np.ascontiguousarray(model.emit.T, np.float64), lanes.symbols, axis=1)
    ended, step = np.empty((len(lanes.order), states, states)), np.ascontiguousarray(model.step.T)
    grid = np.zeros((states, states, 0))  # out, in, lane: those that go on
    for t, (low, high) in enumerate(lanes.slices()):
        count = high - low
        if t == 0:
            grid = np.eye(states)[:, :, None] * emit[:, None, low:high]
        else:
            if count < grid.shape[2]:
                ended[count : grid.shape[2]] = grid[:, :, count:].transpose(2, 0, 1)
                grid = np.ascontiguousarray(grid[:, :, :count])
            grid = (step @ grid.reshape(states, -1)).reshape(states, states, count)
            grid *= emit[:, None, low:high]
        if t % 4 == 3:  # a double has room for a few steps
            grid /= grid.sum(axis=(0, 1))
    ended[: grid.shape[2]] = grid.transpose(2, 0, 1)
    found = np.empty_like(ended)
    found[lanes.order] = ended
    return found


def _edges(symbols: np.ndarray, at: np.ndarray, text: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By lane: the states it is entered with, those before (0 where a text begins), and what lies behind its end."""
    states, count = len(model.start), len(text)
    enter = np.repeat(model.start[:, None], count, axis=1)
    before, behind = np.zeros((states, count)), np.ones((states, count))
    inner = np.zeros(count, bool)  # lanes that are not a whole text
    inner[1:] |= text[1:] == text[:-1]
    inner[:-1] |= text[1:] == text[:-1]
    which = np.flatnonzero(inner)
    if not len(which):
        return enter, before, behind
    size = np.diff(at)
    tokens = np.repeat(inner, size)
    product = _products(symbols[tokens], np.concatenate([[0], np.cumsum(size[which])]), model)
    ends = np.empty((len(which), states))
    for k, lane in enumerate(which.tolist()):
        if k and text[lane] == text[lane - 1]:
            before[:, lane] = ends[k - 1]
            enter[:, lane] = ends[k - 1] @ model.step
        end = product[k] @ enter[:, lane]
        ends[k] = end / end.sum()
    for k in range(len(which) - 2, -1, -1):
        lane = which[k]
        if text[lane] == text[which[k + 1]]:
            value = model.step @ (behind[:, which[k + 1]] @ product[k + 1])
            behind[:, lane] = value / (ends[k] @ value)
    return enter, before, behind


def _advance(lanes: Lanes, emit: np.ndarray, enter: np.ndarray, step: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Fills ``rows`` with the scaled forward states of all tokens (``rows`` may be ``emit``); their scales."""
    scales, last = np.empty(emit.shape[1], emit.dtype), 0
    state, onwards = enter[:, lanes.order].astype(emit.dtype), np.ascontiguousarray(step.T, emit.dtype)
    for t, (low, high) in enumerate(lanes.slices()):
        state = onwards @ rows[:, last : last + high - low] if t else state[:, : high - low]
        here = np.multiply(state, emit[:, low:high], out=rows[:, low:high])
        here /= np.sum(here, axis=0, out=scales[low:high])
        last = low
    return scales


def forward(symbols: np.ndarray, at: np.ndarray, model: Model, long: int | None = None, lane: int = LANE) -> np.ndarray:
    """Natural log likelihood of every text."""
    edges, text = _lane_edges(at, long, lane)
    lanes = Lanes(symbols, edges)
    enter, _, _ = _edges(symbols, edges, text, model)
    emit = np.take(np.ascontiguousarray(model.emit.T), lanes.symbols, axis=1)
    scales = _advance(lanes, emit, enter, model.step, emit)
    return np.bincount(text, lanes.sums(np.log(scales)), len(at) - 1)


def expected(
    symbols: np.ndarray, at: np.ndarray, model: Model, long: int | None = None, lane: int = LANE, kind: type = np.float64
) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, steps and emissions of the texts, and their log likelihood. ``kind``: precision of a step."""
    edges, text = _lane_edges(at, long, lane)
    lanes = Lanes(symbols, edges)
    enter, before, behind = _edges(symbols, edges, text, model)
    ahead = np.take(np.ascontiguousarray(model.emit.T, kind), lanes.symbols, axis=1)
    rows = np.empty_like(ahead)
    scales = _advance(lanes, ahead, enter, model.step, rows)
    before, behind = before[:, lanes.order].astype(kind), behind[:, lanes.order].astype(kind)
    states, onwards = len(model.start), np.ascontiguousarray(model.step, kind)
    step, slices = np.zeros((states, states)), lanes.slices()
    for t in range(len(slices) - 1, -1, -1):
        low, high = slices[t]
        count = high - low
        here, next_ = rows[:, low:high], ahead[:, low:high]
        next_ *= behind[:, :count]
        next_ /= scales[low:high]
        here *= behind[:, :count]  # now the posterior of the state
        last = rows[:, slices[t - 1][0] : slices[t - 1][0] + count] if t else before
        step += last @ next_.T
        if t:
            np.matmul(onwards, next_, out=behind[:, :count])
    begins = np.concatenate([[True], text[1:] != text[:-1]])[lanes.order] if len(text) else np.zeros(0, bool)
    start = rows[:, : len(begins)][:, begins].sum(axis=1, dtype=np.float64)
    emit = np.zeros((states, len(model.emit)))
    for low in range(0, len(symbols), STEP):  # a step's arrays stay in the cache
        places = lanes.symbols[low : low + STEP]
        for k in range(states):
            emit[k] += np.bincount(places, rows[k, low : low + STEP], len(model.emit))
    return start, step * model.step, emit.T, float(np.log(scales, dtype=np.float64).sum())


def _kind(words: list[str]) -> np.dtype:
    """How symbols are written: the last one is ``len(words)``."""
    return np.dtype("<u2" if len(words) < 1 << 16 else "<i4")


def _unpacked(column: pa.BinaryArray, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all rows of a column of bytes, and where each row's begin."""
    offsets, data = column.buffers()[1:]
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    size = int(at[-1] - at[0]) // kind.itemsize
    return np.frombuffer(data, kind, size, int(at[0])) if size else np.zeros(0, kind), (at - at[0]) // kind.itemsize


def _blocks(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of encoded texts with about ``BLOCK_TOKENS`` tokens at once, or one longer text; their symbols and edges."""
    held, tokens = [], 0

    def block() -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        return rows, *_unpacked(rows.column("packed"), kind)

    for batch in batches:
        edges = _unpacked(batch.column("packed"), kind)[1]
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(edges, edges[low] + BLOCK_TOKENS - tokens, "right")) - 1)
            held.append(batch.slice(low, high - low))
            tokens += int(edges[high] - edges[low])
            low = high
            if tokens >= BLOCK_TOKENS or low < batch.num_rows:
                yield block()
                held, tokens = [], 0
    if held:
        yield block()


def _expectations(encoded: DataFrame, shared, states: int) -> DataFrame:
    """One row per symbol with its expected count by state; starts, steps and the score as negative symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**shared.value)
        start, step, emit, score = np.zeros(states), np.zeros((states, states)), np.zeros_like(model.emit), 0.0
        for _, symbols, at in _blocks(batches, _kind(model.words)):
            part = expected(symbols, at, model, kind=np.float32)
            start, step, emit, score = start + part[0], step + part[1], emit + part[2], score + part[3]
        seen = np.flatnonzero(emit.any(axis=1))
        rows = np.concatenate([emit[seen], step, start[None], np.full((1, states), score / states)])
        names = np.concatenate([seen, -1 - np.arange(states + 2)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.int64()), *(pa.array(rows[:, k]) for k in range(states))],
            names=["symbol", *(f"s{k}" for k in range(states))],
        )

    columns = [f"s{k}" for k in range(states)]
    return (
        encoded.select("packed").mapInArrow(run, "symbol long, " + ", ".join(f"{c} double" for c in columns))
        .groupBy("symbol")
        .agg(*[F.sum(c).alias(c) for c in columns])
    )


def encode(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, row, packed, rare, symbols`` of every row of ``docs(doc_id, row, text)``, texts of like length together.

    Symbols are written as bytes in ``packed``, see ``_kind``: a list of numbers costs the reader of every pass several
    times as much. ``symbols`` shows them as numbers; they are only computed where that column is read. ``rare`` counts the tokens behind the last symbol as ``(token, times)``.
    """
    kind = _kind(model.words)
    shared = docs.sparkSession.sparkContext.broadcast(model.words)  # bounded by ALPHABET

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet = {w.encode(): k for k, w in enumerate(shared.value)}
        for batch in batches:
            for part in chunks(batch, "text"):
                symbols, at, rare = _symbols(part, alphabet)
                tokens = pa.array([w for times in rare for w in times], pa.binary()).cast(pa.string())
                times = pa.array([n for times in rare for n in times.values()], pa.int64())
                edges = np.cumsum([0, *map(len, rare)])
                buffers = [None, pa.py_buffer((at * kind.itemsize).astype(np.int32)), pa.py_buffer(symbols.astype(kind))]
                lists = pa.Array.from_buffers(pa.binary(), len(at) - 1, buffers)
                rest = pa.ListArray.from_arrays(
                    pa.array(edges.astype(np.int32)), pa.StructArray.from_arrays([tokens, times], names=["token", "times"])
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("row"), lists, rest], names=["doc_id", "row", "packed", "rare"]
                )

    rows = docs.select(F.col("doc_id").cast("long"), "row", "text").mapInArrow(
        run, "doc_id long, row long, packed binary, rare array<struct<token:string,times:long>>"
    )
    width = kind.itemsize
    number = ", ".join(f"substring(packed, {width} * k - {j}, 1)" for j in range(width))
    symbols = f"transform(sequence(1, octet_length(packed) div {width}), k -> cast(conv(hex(concat({number})), 16, 10) as int))"
    return keep(rows.sortWithinPartitions(F.octet_length("packed")), "encoded").withColumn("symbols", F.expr(symbols))


def _improved(encoded: DataFrame, model: Model) -> Model:
    """The model after one pass of Baum-Welch."""
    spark, states = encoded.sparkSession, len(model.start)
    shared = spark.sparkContext.broadcast(vars(model))  # bounded by ALPHABET * STATES
    emit, tail = np.zeros_like(model.emit), np.zeros((states + 2, states))
    for symbol, *values in _expectations(encoded, shared, states).collect():  # a row per symbol of the alphabet
        if symbol >= 0:
            emit[symbol] = values
        else:
            tail[-1 - symbol] = values
    shared.unpersist()
    base = np.append(model.counts, model.rest).astype(float)
    emit += 2.0 * (base / max(base.sum(), 1))[:, None]  # every state can emit every symbol
    step, start = tail[:states] + 0.1, tail[states] + 0.1
    return Model(
        model.words,
        model.counts,
        model.total,
        model.distinct,
        start / start.sum(),
        step / step.sum(axis=1, keepdims=True),
        emit / emit.sum(axis=0),
    )


def first_model(counts: DataFrame, alphabet: int = ALPHABET, states: int = STATES) -> Model:
    """Counts of the corpus, and states that differ by random factors only."""
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # tokens by count, and the least count that still fits: a row per distinct count, never one per token
    upto = F.sum("n").over(Window.orderBy(F.desc("c")))
    fits = counts.groupBy("c").agg(F.count("*").alias("n")).withColumn("upto", upto).where(F.col("upto") <= alphabet)
    least = fits.agg(F.min("c")).first()[0]
    top = counts.where(F.col("c") >= least).collect() if least is not None else []  # at most ``alphabet`` rows
    top = sorted(top, key=lambda r: (-r.c, r.token))
    words, seen = [r.token for r in top], np.array([r.c for r in top], np.int64)
    model = Model(words, seen, total, distinct, np.full(states, 1 / states), np.zeros(0), np.zeros(0))
    dice = np.random.default_rng(11)
    emit = np.append(seen, model.rest)[:, None] * dice.gamma(1.0, size=(len(words) + 1, states))
    model.emit = emit / emit.sum(axis=0)
    model.step = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    return model


def train(encoded: DataFrame, model: Model, passes: int = PASSES) -> Model:
    """``model`` after ``passes`` passes over all rows of ``encoded``."""
    if model.total:
        for _ in range(passes):
            model = _improved(encoded, model)
    return model


def score(encoded: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """``doc_id, row, n_tokens, n_known, base_score, score`` of every row that ``encode`` gave.

    Tokens of the alphabet are scored in the task; the others are joined with the counts. ``row``
    tells rows apart.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(vars(model))  # bounded by ALPHABET * STATES
    scale = model.total + SMOOTHING * (model.distinct + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**shared.value)
        base = np.append(np.log10((model.counts + SMOOTHING) / scale), 0.0)
        for rows, symbols, at in _blocks(batches, _kind(model.words)):
            text = np.repeat(np.arange(len(at) - 1), np.diff(at))
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"),
                    rows.column("row"),
                    pa.array(np.diff(at)),
                    pa.array(np.bincount(text, symbols < len(model.words), len(at) - 1).astype(np.int64)),
                    pa.array(np.bincount(text, base[symbols], len(at) - 1)),
                    pa.array(forward(symbols, at, model) / np.log(10)),
                ],
                names=["doc_id", "row", "n_tokens", "n_known", "base_score", "score"],
            )

    first = encoded.select("doc_id", "row", "packed").mapInArrow(
        run, "doc_id long, row long, n_tokens long, n_known long, base_score double, score double"
    )
    c = F.coalesce("c", F.lit(0))
    rare = (
        encoded.select("row", F.explode("rare").alias("r"))
        .select("row", "r.token", "r.times")
        .join(counts, "token", "left")
        .groupBy("row")
        .agg(
            F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("known"),
            F.sum("times").alias("times"),
            F.sum(F.col("times") * F.log10(c + SMOOTHING)).alias("log"),
        )
    )
    share = lambda mass: F.coalesce(F.col("log") - F.col("times") * math.log10(mass), F.lit(0.0))
    return first.join(rare, "row", "left").select(
        "doc_id",
        "row",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        (F.col("base_score") + share(scale)).alias("base_score"),
        (F.col("score") + share(model.rest)).alias("score"),
    )


def score_corpus(docs: DataFrame, alphabet: int = ALPHABET, states: int = STATES, passes: int = PASSES) -> DataFrame:
    """Trains on the rows whose ``crc32(doc_id) mod 10`` is not 0 and scores all of them."""
    held_out = remainder(F.col("doc_id"), 10) == 0
    counts = keep(token_counts(docs.where(~held_out).select("text")), "counts")
    model = first_model(counts, alphabet, states)
    encoded = encode(docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text"), model)
    model = train(encoded.where(~held_out).select("packed", "symbols"), model, passes)
    return score(encoded, model, counts).select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.total).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
