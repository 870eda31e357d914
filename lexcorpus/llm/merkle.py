"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces.

A text is cut by its content: paragraphs end with a line break, pieces within a paragraph end after
a word whose hash has its lowest three bits clear (eight words on average), and sections end with a
paragraph whose hash does. Leaves are digests of pieces, a paragraph's digest is that of its
leaves' digests and so on up to the root. Cuts depend on what stands there and not on what stands before,
so an edit changes the branches above it and leaves the others.

Equal roots mean equal texts. ``compare`` walks two trees from the roots down, passes over equal
branches, and gives the share of text (characters of both texts) that lies in common leaves, and
the spans of the others. ``fingerprint`` is the root as lower-case hex SHA-256.

A null text is an empty one; its tree has no branch. Texts of any length are cut whole. Documents
are ordered by id, null first; rows with the same id follow each other by the hash of their text.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

WORD_END = re.compile(r"([^\x20\x09-\x0D]+)[\x20\x09-\x0D]*")
PIECE_MASK = 7
LONGEST_PIECE = 64  # words, so that repeated words do not make one piece without end
Node = tuple[bytes, int, tuple]  # digest, characters, children


def _hash(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def _parent(children: list[Node]) -> Node:
    return _hash(b"\x01" + b"".join(c[0] for c in children)), sum(c[1] for c in children), tuple(children)


def _pieces(paragraph: str) -> list[Node]:
    out, start, end, words = [], 0, 0, 0
    for match in WORD_END.finditer(paragraph):
        end, words = match.end(), words + 1
        if not crc32(match[1].encode()) & PIECE_MASK or words == LONGEST_PIECE:
            out.append(_leaf(paragraph[start:end]))
            start, words = end, 0
    if start < len(paragraph):
        out.append(_leaf(paragraph[start:]))
    return out


def _leaf(text: str) -> Node:
    return _hash(b"\x00" + text.encode()), len(text), ()


def tree(text: str | None) -> Node:
    sections, paragraphs = [], []
    for paragraph in re.findall(r"[^\n]*\n|[^\n]+", text or ""):
        paragraphs.append(_parent(_pieces(paragraph)))
        if not paragraphs[-1][0][0] & PIECE_MASK:
            sections.append(_parent(paragraphs))
            paragraphs = []
    if paragraphs:
        sections.append(_parent(paragraphs))
    return _parent(sections)


def _changed(left: Node, right: Node) -> tuple[list[Node], list[Node]]:
    """Leaves of both that do not stand in a branch both have."""
    if left[0] == right[0]:
        return [], []
    common = Counter(c[0] for c in left[2]) & Counter(c[0] for c in right[2])
    rest = []
    for node in (left, right):
        open_, own = Counter(common), []
        for child in node[2]:
            if open_[child[0]] > 0:
                open_[child[0]] -= 1
            else:
                own.append(child)
        rest.append(own)
    return rest[0], rest[1]


def likeness(left: Node, right: Node) -> float:
    """Share of the characters of both texts that lie in common branches, 1.0 for equal texts."""
    if left[0] == right[0]:
        return 1.0
    total = left[1] + right[1]
    a, b = [left], [right]
    while a and b and (a[0][2] or b[0][2]):  # section, paragraph and leaf level
        a, b = _changed((b"a", 0, tuple(c for n in a for c in n[2])), (b"b", 0, tuple(c for n in b for c in n[2])))
    apart = sum(n[1] for n in a) + sum(n[1] for n in b)
    return max(0.0, 1.0 - apart / total) if total else 1.0


def edits(left: Node, right: Node) -> list[tuple[int, int]]:
    """Spans of the right text (first and last character + 1) in branches that the left one lacks."""
    leaves: Counter = Counter()

    def collect(node: Node) -> None:
        if not node[2]:
            leaves[node[0]] += 1
        for child in node[2]:
            collect(child)

    collect(left)
    spans: list[list[int]] = []

    def walk(node: Node, at: int) -> None:
        if not node[2]:
            if leaves[node[0]] > 0:
                leaves[node[0]] -= 1
            elif spans and spans[-1][1] == at:
                spans[-1][1] = at + node[1]
            elif node[1]:
                spans.append([at, at + node[1]])
        for child in node[2]:
            walk(child, at)
            at += child[1]

    if left[0] != right[0]:
        walk(right, 0)
    return [(a, b) for a, b in spans]


def fingerprints(docs: DataFrame) -> DataFrame:
    """All columns of ``docs``, ``fingerprint`` (the root) and ``n_chars_hashed``."""
    root = F.pandas_udf(lambda texts: texts.map(lambda t: tree(t)[0].hex()), "string")
    return docs.withColumn("fingerprint", root("text"))


def _bounds(docs: DataFrame) -> np.ndarray:
    """Ids at which ranges of about equal row counts begin; fewer than there are shuffle partitions."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = docs.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.25 / parts)
    return np.unique(np.array(found, np.float64))


def with_next(docs: DataFrame, step: Callable[..., dict], schema: str) -> DataFrame:
    """Runs ``step(doc_id, text, state, next text, next state)`` over the documents in order of their id.

    Rows are dealt into ranges of ids and sorted there. The first row of each range is sent to the
    range before it too, and that of the first range to the last, so texts are moved once.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"))
    bounds = _bounds(rows)

    def ranges(ids: pa.Array) -> np.ndarray:
        known = ids.fill_null(0).to_numpy(zero_copy_only=False)
        part = np.searchsorted(bounds, known.astype(np.float64), "right").astype(np.int32)
        part[ids.is_null().to_numpy(zero_copy_only=False)] = 0
        return part

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array(ranges(batch.column("doc_id"))), batch.column("doc_id"), batch.column("hash")], names=["part", "doc_id", "hash"]
            )

    first = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "hash")  # null ids first
    keys = rows.select("doc_id", "hash").mapInArrow(find, "part int, doc_id long, hash long")
    found = keys.groupBy("part").agg(F.min(first).alias("first")).collect()  # one row per range
    firsts = {r.part: (r["first"].doc_id, r["first"].hash) for r in found}
    parts = sorted(firsts)
    before = {p: parts[k - 1] for k, p in enumerate(parts)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "guard", "doc_id", "text", "hash"]
        for batch in batches:
            part = ranges(batch.column("doc_id"))
            keys = zip(part.tolist(), batch.column("doc_id").to_pylist(), batch.column("hash").to_pylist())
            ends = np.array([firsts[p] == (d, h) for p, d, h in keys], bool)
            columns = [batch.column(n) for n in names[2:]]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.zeros(len(part), bool)), *columns], names=names)
            if ends.any():
                to = np.array([before[p] for p in part[ends].tolist()], np.int32)
                again = [c.filter(pa.array(ends)) for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(np.ones(len(to), bool)), *again], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, closed = None, None  # the row that waits for its next one; the range that is finished
        for batch in batches:
            out = []
            for part, guard, doc_id, text in zip(*(batch.column(n).to_pylist() for n in ("part", "guard", "doc_id", "text"))):
                if part == closed:
                    continue  # further copies of the guard
                row = (doc_id, text or "", {})
                if held is not None:
                    out.append(step(*held, *row[1:]))
                held = row
                if guard:
                    held, closed = None, part
            if out:
                names = list(out[0])
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], kinds[n]) for n in names], names=names)

    kinds = {f.name: to_arrow_type(f.dataType) for f in StructType.fromDDL(schema).fields}
    sent = rows.mapInArrow(deal, "part int, guard boolean, doc_id long, text string, hash long")
    dealt = sent.repartition(max(1, len(parts)), "part").sortWithinPartitions("part", "guard", "doc_id", "hash")
    return dealt.mapInArrow(run, schema)


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half] if half else text


def _compare(doc_id, text: str, state: dict, following: str, next_state: dict) -> dict:
    own = state.get("tree") or tree(text)
    after = next_state["tree"] = tree(following)
    changed = edited(text, following)
    other = tree(changed)
    return {
        "doc_id": doc_id,
        "n_chars": len(text),
        "edited_sha256": hashlib.sha256(changed.encode()).hexdigest(),
        "fingerprint": own[0].hex(),
        "edited_fingerprint": other[0].hex(),
        "near_edited": likeness(own, other),
        "near_next": likeness(own, after),
        "edits": [{"start": a, "end": b} for a, b in edits(own, other)],
    }


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and its edited text, their likeness, and where the branches differ."""
    return with_next(
        docs,
        _compare,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, edits array<struct<start:long,end:long>>",
    )
