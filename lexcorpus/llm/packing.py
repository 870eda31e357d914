"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are powers of two: as many of the longest
length as fit, then the binary digits of the rest, longest first. A piece is a sequence of its own,
so no sequence crosses documents and none is padded, and sequences of equal length form a bucket
that is batched without waste. Nothing is shuffled: the decomposition of a document depends on its
length alone.

A null or empty text is one end token. Texts of any length are tokenised whole. Repeated rows,
null ids and empty tables need no care: each row is packed for itself. Clashing column names
cannot occur, as only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .common import chunks

CAPACITY = 1024
END = 0
SPECIAL = "<|endoftext|>"

_PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("ids", pa.list_(pa.int32())),
    ]
)


class Encoder:
    """Ids of a byte-level vocabulary.

    ``ranks`` is the same vocabulary as ``vocabulary`` in the form of the faster library, used for
    every text without the special token; ids are equal, which the tests check.
    """

    def __init__(self, vocabulary: str, ranks: str | None, pattern: str | None):
        self._vocabulary, self._slow, self._fast = vocabulary, None, None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self._fast = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self._fast is not None and SPECIAL not in text:
            return np.array(self._fast.encode_ordinary(text), np.uint32)
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self._vocabulary)
        return np.array(self._slow.encode(text, add_special_tokens=False).ids, np.uint32)


def default_vocabulary() -> dict[str, str | None]:
    import public_tokenizers

    return {
        "vocabulary": public_tokenizers.path("byte_bpe_50k.json"),
        "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"),
        "pattern": public_tokenizers.PATTERN,
    }


def piece_lengths(tokens: int, capacity: int = CAPACITY) -> list[int]:
    rest = tokens % capacity
    return [capacity] * (tokens // capacity) + [1 << bit for bit in reversed(range(rest.bit_length())) if rest >> bit & 1]


def pack(docs: DataFrame, vocabulary: dict[str, str | None] | None = None, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, if asked for, ``ids`` (array).

    ``capacity`` must be a power of two. ``sequence_id`` holds log2 of the bucket in its lowest bits.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    files = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(**files)
        for batch in batches:
            for part in chunks(batch, "text"):
                rows = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = np.append(encoder.ids(text or ""), np.uint32(END)).astype("<u4")
                    start = 0
                    for length in piece_lengths(len(ids), capacity):
                        piece = ids[start : start + length]
                        kept = piece.astype(np.int32) if with_ids else None
                        rows.append((doc_id, start, length, zlib.crc32(piece.tobytes()), len(ids), kept))
                        start += length
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, field.type) for column, field in zip(zip(*rows), _PIECES)], schema=_PIECES
                )

    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids array<int>"
    pieces = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, kind)
    number = F.monotonically_increasing_id() * F.lit(32) + F.round(F.log2("length")).cast("long")
    result = pieces.withColumn("sequence_id", number).withColumn("offset", F.lit(0).cast("long"))
    return result if with_ids else result.drop("ids")


def bucket_batches(pieces: DataFrame, tokens: int = 1 << 16) -> DataFrame:
    """``pieces`` with ``bucket`` (the length) and ``batch``: batches of one bucket hold ``tokens`` tokens.

    Batches are counted within a partition of the input, so nothing is gathered; the last batch of
    a bucket in a partition may be smaller.
    """
    part = F.shiftright(F.shiftright("sequence_id", 5), 33)
    place = F.row_number().over(Window.partitionBy("_part", "length").orderBy("sequence_id"))
    return (
        pieces.withColumn("_part", part)
        .withColumn("batch", F.concat_ws("-", F.col("_part"), F.floor((place - 1) * F.col("length") / tokens)))
        .withColumn("bucket", F.col("length"))
        .drop("_part")
    )
