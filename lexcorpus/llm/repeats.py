"""Repeated byte windows by a depth-limited radix sort of suffixes.

Every suffix of every text is ordered through its first ``depth`` bytes only, by passes over
digits, most significant first; what is equal after the last digit is a group of equal windows,
and all but the earliest member of a group are repeats. Suffixes that follow each other share
most digits and stay one row, a run, until a digit tells them apart.

* First pass. The digit of a suffix is the ``GRAM`` bytes with the smallest hash inside its window:
  equal windows have the same one at the same place, and a run of about 35 suffixes shares it. Runs
  whose windows cover equal bytes are equal throughout, so every run but the earliest is covered
  whole. A digit that only one distinct run has is done: its windows occur nowhere else.
* Second pass, over the earliest runs of digits that several different runs share (where a shared
  passage begins or ends, or a phrase is common). Runs are cut to ``STEP`` places around the first
  digit, and the second digit is the bytes that all windows of such a place have in common.
* Last pass, over what is still shared: the suffixes themselves, ordered by the first and the second
  half of their window.

Before each exchange a task orders what it holds and settles all but the earliest member of each
group on the spot, so a passage that a third of all documents share costs one row per task. After
the exchange the sorted rows are streamed with one row of memory. Digits are 64-bit hashes, and two
of them decide equality.

Order of windows: by ``doc_id``, then by start. Rows with the same ``doc_id`` and text are copies of
one document, and what one of them loses all lose. Different texts of one ``doc_id`` are documents of
their own, in the order of a hash of their text. A row without id has no place in the order: it
is left whole and takes nothing from others. A null text is an empty one; texts below ``depth``
bytes lose nothing. A text longer than a task's block is cut into overlapping blocks, which leaves
the result as it is. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from .common import CHUNK_BYTES, chunks, keep, numbered, text_bytes
from .hashing import Hashed, Powers, group_of, mix, signed

DEPTH = 100
GRAM = 32
FLUSH_ROWS = 1 << 18
STEP = 16
_PLACE_BITS = np.uint64(24)
_PLACE = np.uint64((1 << 24) - 1)

COVERED, RUN, SHARED = 0, 1, 2
_ROWS = "kind int, digit1 long, digit2 long, doc long, lo long, size long, near long, piece binary"
_NUMBERS = ("digit1", "digit2", "doc", "lo", "size", "near")
_SCHEMA = pa.schema([("kind", pa.int32()), *((n, pa.int64()) for n in _NUMBERS), ("piece", pa.binary())])


class _Runs:
    """Rows of the passes: the numbers of ``_NUMBERS`` and, in the second pass, the bytes of the run's windows."""

    def __init__(self, numbers: list[np.ndarray], piece: pa.Array):
        self.numbers, self.piece = numbers, piece
        self.digit1, self.digit2, self.doc, self.lo, self.size, self.near = numbers

    @classmethod
    def of(cls, *numbers: np.ndarray, piece: pa.Array | None = None) -> "_Runs":
        return cls([n.astype(np.int64, copy=False) for n in numbers], pa.nulls(len(numbers[0]), pa.binary()) if piece is None else piece)

    @classmethod
    def joined(cls, parts: list["_Runs"]) -> "_Runs":
        columns = [np.concatenate(c) for c in zip(*(p.numbers for p in parts))]
        return cls(columns, pa.concat_arrays([p.piece for p in parts]))

    @classmethod
    def read(cls, batch: pa.RecordBatch) -> "_Runs":
        return cls([batch.column(n).to_numpy(zero_copy_only=False) for n in _NUMBERS], batch.column("piece"))

    def __len__(self) -> int:
        return len(self.doc)

    def take(self, which: np.ndarray) -> "_Runs":
        which = np.flatnonzero(which) if which.dtype == bool else which
        return _Runs([n[which] for n in self.numbers], self.piece.take(pa.array(which)))

    def batch(self, kind: int) -> pa.RecordBatch:
        kinds = pa.array(np.full(len(self), kind, np.int32))
        return pa.RecordBatch.from_arrays([kinds, *(pa.array(n) for n in self.numbers), self.piece], schema=_SCHEMA)


def _covered(rows: _Runs, depth: int) -> Iterator[pa.RecordBatch]:
    """The bytes of these runs as covered, overlapping ones of a document joined."""
    if len(rows):
        doc, lo, end = joined(rows.doc, rows.lo, rows.lo + rows.size + depth)
        spread = signed(mix(doc.view(np.uint64) + mix(lo.view(np.uint64))))
        none = np.zeros_like(lo)
        yield _Runs.of(spread, none, doc, lo, end - lo, none).batch(COVERED)


def joined(doc: np.ndarray, lo: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((lo, doc))
    doc, lo, end = doc[order], lo[order], end[order]
    parts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    # one running maximum over all documents: ends are lifted by the document's number
    lift = (np.cumsum(np.concatenate([[True], doc[1:] != doc[:-1]])) - 1) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + lift) - lift
    new = np.ones(len(doc), bool)
    new[1:] = lo[1:] > reach[:-1]
    new[parts] = True
    first = np.flatnonzero(new)
    return doc[first], lo[first], reach[np.concatenate([first[1:] - 1, [len(doc) - 1]])]


def _settle(rows: _Runs, depth: int) -> Iterator[pa.RecordBatch]:
    """Earliest member of each group as a row to exchange, the others as covered."""
    rows = rows.take(np.lexsort((rows.lo, rows.doc, rows.digit2, rows.digit1)))
    new = np.ones(len(rows), bool)
    new[1:] = (rows.digit1[1:] != rows.digit1[:-1]) | (rows.digit2[1:] != rows.digit2[:-1])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = (rows.doc != rows.doc[first]) | (rows.lo != rows.lo[first])
    yield from _covered(rows.take(later), depth)
    yield rows.take(new).batch(RUN)


class _Pending:
    """Rows of a task, settled whenever there are enough of them."""

    def __init__(self, depth: int):
        self.depth, self.parts, self.rows = depth, [], 0

    def add(self, rows: _Runs) -> Iterator[pa.RecordBatch]:
        self.parts.append(rows)
        self.rows += len(rows)
        if self.rows >= FLUSH_ROWS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield from _settle(_Runs.joined(self.parts), self.depth)
        self.parts, self.rows = [], 0


def _blocks(part: pa.RecordBatch, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Bytes, text starts, ids and the place of the first byte in its text."""
    data, at = text_bytes(part.column("text"))
    ids = part.column("doc").to_numpy(zero_copy_only=False)
    if len(data) <= 2 * CHUNK_BYTES:
        yield data, at, ids, 0
        return
    for start in range(0, len(data), CHUNK_BYTES):  # one long text
        piece = data[start : start + CHUNK_BYTES + depth - 1]
        yield piece, np.array([0, len(piece)]), ids, start


def runs(data: np.ndarray, at: np.ndarray, depth: int, gram: int, powers: Powers):
    """``(digit1, digit2, text, lo, hi, place)``: runs of window starts with the same first digit, and where that is."""
    count = len(data) - gram + 1
    width = depth - gram + 1
    starts = np.arange(max(0, len(data) - depth + 1))
    owner = group_of(at)
    starts = starts[owner[starts] == owner[starts + depth - 1]] if len(starts) else starts
    if not len(starts):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty, empty, empty
    hashed = Hashed(data, powers)
    place = np.arange(count)
    value = (hashed.ranges(place, place + gram) & ~_PLACE) | place.astype(np.uint64)
    padded = np.full(-(-count // width) * width, ~np.uint64(0))
    padded[:count] = value
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = (np.minimum(behind[starts], ahead[starts + width - 1]) & _PLACE).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (least[1:] != least[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    lo, hi, least = starts[first], starts[np.concatenate([first[1:] - 1, [len(starts) - 1]])], least[first]
    digit1 = hashed.ranges(least, least + gram)
    digit2 = mix(hashed.ranges(lo, hi + depth) + (least - lo).astype(np.uint64))
    return signed(digit1), signed(digit2), owner[lo], lo, hi, least


def _order(rows: DataFrame, depth: int) -> DataFrame:
    """Covered rows, and the earliest runs of first digits that several runs share."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: _Runs | None = None  # earliest row of the group that may go on
        alone = False  # whether that row is the only run of its first digit so far
        for batch in batches:
            rows = _Runs.read(batch)
            done = batch.column("kind").to_numpy() == COVERED
            if done.any():
                yield rows.take(done).batch(COVERED)
                rows = rows.take(~done)
            if not len(rows):
                continue
            held = last is not None
            if held:
                rows = _Runs.joined([last, rows])
            change1 = np.ones(len(rows), bool)
            change1[1:] = rows.digit1[1:] != rows.digit1[:-1]
            change2 = change1.copy()
            change2[1:] |= rows.digit2[1:] != rows.digit2[:-1]
            first = np.flatnonzero(change2)
            rep = first[np.cumsum(change2) - 1]
            later = (rows.doc != rows.doc[rep]) | (rows.lo != rows.lo[rep])
            yield from _covered(rows.take(later), depth)
            number = np.cumsum(change1[first]) - 1  # of the first digit, for each distinct run
            shared = np.bincount(number)[number] > 1
            if held and not alone:
                shared[number == 0] = True
                shared[0] = False  # given out before
            if shared.any():
                yield rows.take(first[shared]).batch(SHARED)
            final = number == number[-1]
            alone = bool(final.sum() == 1 and not (held and not alone and number[-1] == 0))
            last = rows.take(first[-1:])

    exchanged = rows.repartition("digit1").sortWithinPartitions("digit1", "digit2", "doc", "lo")
    return exchanged.mapInArrow(stream, _ROWS)


def _repeat(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each position ``count`` times, and 0, 1, ... within it."""
    which = np.repeat(np.arange(len(count)), count)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)


def _parts_of(data: np.ndarray, at: np.ndarray, ids: np.ndarray, owner, lo, size, near, depth: int, powers: Powers) -> _Runs:
    """Runs cut to ``STEP`` places around their first digit; the digits are what the windows share, and all they cover."""
    hashed = Hashed(data, powers)
    base = at[owner]
    place = lo + size + near  # of the first digit
    count = (size + near) // STEP - near // STEP + 1
    run, inner = _repeat(count)
    step = near[run] // STEP + inner
    farthest = np.minimum(size[run] + near[run], step * STEP + STEP - 1)
    nearest = np.maximum(near[run], step * STEP)
    start, last = place[run] - farthest, place[run] - nearest
    origin = base[run]
    core = origin + place[run] - step * STEP
    digit1 = mix(hashed.ranges(core, core - (STEP - 1) + depth) + step.astype(np.uint64))
    digit2 = mix(hashed.ranges(origin + start, origin + last + depth) + farthest.astype(np.uint64))
    raw = data.tobytes()
    edges = zip((origin + start).tolist(), (origin + last + depth).tolist())
    piece = pa.array([raw[a:b] for a, b in edges], pa.binary())
    none = np.zeros_like(start)
    return _Runs.of(signed(digit1), signed(digit2), ids[owner[run]], start, last - start, none, piece=piece)


def repeated_spans(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM) -> DataFrame:
    """``doc, spans``: the covered bytes of every document that has some, in order of their start.

    ``docs`` has ``doc`` (long, not null) and ``text``.
    """
    if not STEP < depth or not 0 < gram <= depth:
        raise ValueError(f"depth must be above {STEP} and at least gram")

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, pending = Powers(), _Pending(depth)
        for batch in batches:
            for part in chunks(batch, "text"):
                for data, at, ids, base in _blocks(part, depth):
                    digit1, digit2, owner, lo, hi, place = runs(data, at, depth, gram, powers)
                    yield from pending.add(_Runs.of(digit1, digit2, ids[owner], lo - at[owner] + base, hi - lo, place - hi))
        yield from pending.flush()

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, pending = Powers(), _Pending(depth)
        for batch in batches:
            for part in chunks(batch, "text"):
                data, at = text_bytes(part.column("text"))
                ids = part.column("doc").to_numpy(zero_copy_only=False)
                owner = np.repeat(np.arange(len(ids)), part.column("runs").value_lengths().to_numpy(zero_copy_only=False))
                fields = (part.column("runs").flatten().field(k).to_numpy(zero_copy_only=False) for k in range(3))
                yield from pending.add(_parts_of(data, at, ids, owner, *fields, depth, powers))
        yield from pending.flush()

    def last_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, pending = Powers(), _Pending(depth)
        half = depth // 2
        for batch in batches:
            for part in chunks(batch, "piece"):
                data, at = text_bytes(part.column("piece"))
                rows = _Runs.read(part)
                run, inner = _repeat(rows.size + 1)
                place = at[run] + inner
                hashed = Hashed(data, powers)
                digits = (signed(hashed.ranges(a, b)) for a, b in ((place, place + half), (place + half, place + depth)))
                none = np.zeros_like(place)
                yield from pending.add(_Runs.of(*digits, rows.doc[run], rows.lo[run] + inner, none, none))
        yield from pending.flush()

    span = ("doc", "lo", "size")
    first = keep(_order(docs.mapInArrow(first_pass, _ROWS), depth).drop("digit1", "digit2", "piece"), "runs")
    shared = first.where(F.col("kind") == SHARED).groupBy("doc").agg(F.collect_list(F.struct("lo", "size", "near")).alias("runs"))
    second = keep(_order(docs.join(shared, "doc").mapInArrow(second_pass, _ROWS), depth), "parts")
    rest = second.where(F.col("kind") == SHARED).mapInArrow(last_pass, _ROWS)
    covered = first.where(F.col("kind") == COVERED).select(*span)
    for rows in (second, _order(rest, depth)):
        covered = covered.unionByName(rows.where(F.col("kind") == COVERED).select(*span))
    return covered.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("lo", "size"))).alias("spans"))


def cut_repeats(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM, as_text: bool = False) -> DataFrame:
    """All columns of ``docs`` and ``kept`` (the text's bytes that are no repeats), ``n_bytes``, ``removed``.

    ``removed`` lists start and end of every maximal removed run. With ``as_text``, ``kept`` is a
    string without those bytes that no longer belong to a whole character. Columns of ``docs`` that
    have one of these three names are replaced; all others come back as they are.
    """
    fields = [f for f in docs.schema.fields if f.name.lower() not in ("kept", "n_bytes", "removed")]
    taken = {f.name.lower() for f in fields}
    doc, listed = (next(n for n in (f"{'_' * k}{name}" for k in range(len(taken) + 1)) if n not in taken) for name in ("doc", "spans"))
    rows = numbered(docs.select(*[F.col(f"`{f.name}`") for f in fields]), doc)
    keyed = rows.where(F.col(doc).isNotNull()).select(F.col(doc).alias("doc"), "text")
    spans = keep(repeated_spans(keyed, depth, gram), "spans").withColumnsRenamed({"doc": doc, "spans": listed})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            kept, removed = [], []
            for text, spans in zip(texts, batch.column(listed).to_pylist()):
                text = text or b""
                found: list[list[int]] = []
                for span in spans or ():
                    lo, end = span["lo"], min(span["lo"] + span["size"], len(text))
                    if lo >= end:
                        continue
                    if found and lo <= found[-1][1]:
                        found[-1][1] = max(found[-1][1], end)
                    else:
                        found.append([lo, end])
                edges = [0, *(e for span in found for e in span), len(text)]
                rest = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                kept.append(rest.decode("utf-8", "ignore") if as_text else rest)
                removed.append(found)
            columns = [batch.column(f.name) for f in fields]
            yield pa.RecordBatch.from_arrays(
                [
                    *columns,
                    pa.array(kept, pa.string() if as_text else pa.binary()),
                    pa.array([len(t or b"") for t in texts], pa.int64()),
                    pa.array(removed, pa.list_(pa.list_(pa.int64()))),
                ],
                names=[*(f.name for f in fields), "kept", "n_bytes", "removed"],
            )

    made = f"kept {'string' if as_text else 'binary'}, n_bytes long, removed array<array<bigint>>"
    return rows.join(spans, doc, "left").mapInArrow(cut, StructType([*fields, *StructType.fromDDL(made).fields]))


def digest(cut: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    size = F.aggregate("removed", F.lit(0).cast("long"), lambda total, span: total + span[1] - span[0])
    return cut.select(
        "doc_id",
        "n_bytes",
        size.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
