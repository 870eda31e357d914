"""WARC archives with a two-level capture index.

``write_archives`` turns pages into WARC 1.1 records, one gzip member each, in files of the shared
folder. Of pages with equal payloads the one with the smallest id is stored, the others are revisit
records that name it. Files are written by tasks under names of their own; only those that a
finished task reports are part of the archive, so a task that is run again leaves nothing wrong behind.

``write_index`` sorts the captures by reversed-host URL key, packs ``BLOCK_LINES`` lines each into
compressed blocks, and keeps, per shard, a sparse directory with the first key of every block.
``lookup`` sends a key to the shards whose key range holds it (their bounds, one per shard, are all that
the driver knows), finds the block by binary search in the directory, reads that range of the shard
and searches the block. ``fetch`` reads the records' ranges, sorted by file and offset.

Null payloads are empty ones; payloads below ``LEAST_SHARED`` bytes are never revisits. Pages with
the same id and payload are all stored if that id is the smallest. A null id is always stored and
nobody's original. A null URL has the empty key. Malformed URLs are their own key. Very long pages
are one record. An empty table gives an empty result. One URL may have any number of captures:
they are sorted by id behind their key and spread over blocks and shards.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from ..session import scratch_path
from .common import keep

LEAST_SHARED = 100
BLOCK_LINES = 1000
FILE_BYTES = 1 << 30
READ_BYTES = 16 << 20
DATE = "2024-01-01T00:00:00Z"  # the pages table has no capture time
CAPTURE = "key string, page_id long, file string, offset long, length long"


def url_key(url: str | None) -> str:
    """``com,example,blog)/path?query`` of ``https://blog.example.com/path?query#top``."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname, parts.port
    except ValueError:
        return url
    if not host:
        return url
    key = ",".join(reversed(host.rstrip(".").split("."))) + (f":{port}" if port else "") + ")" + (parts.path or "/")
    return key + (f"?{parts.query}" if parts.query else "")


def _record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    revisit = refers_to is not None
    name = f"urn:page:{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url}#{digest}')}"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{name}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http;msgtype=response",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._' + chr(39))}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload (empty for a revisit) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


class _Files:
    """Opens the files of one folder through whatever file system its address names."""

    def __init__(self, folder: str):
        self._system, self._folder = fs.FileSystem.from_uri(folder)
        self._name, self._file = None, None

    def create(self, name: str):
        self._system.create_dir(self._folder, recursive=True)
        return self._system.open_output_stream(f"{self._folder}/{name}", compression=None)

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self._name:
            self.close()
            self._name, self._file = name, self._system.open_input_file(f"{self._folder}/{name}")
        self._file.seek(offset)
        return self._file.read(length)

    def whole(self, name: str) -> bytes:
        with self._system.open_input_stream(f"{self._folder}/{name}", compression=None) as stream:
            return stream.read()

    def close(self) -> None:
        if self._file is not None:
            self._file.close()
        self._name, self._file = None, None


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes all pages and returns their captures: ``key, page_id, file, offset, length``."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload"))
    heads = keep(
        rows.select("page_id", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").alias("bytes")), "heads"
    ).where(F.col("page_id").isNotNull() & (F.col("bytes") >= LEAST_SHARED))
    originals = heads.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    revisits = keep(
        heads.join(originals, "digest").where("page_id != refers_to").select("page_id", "digest", "refers_to").distinct(), "revisits"
    )
    marked = rows.withColumn("digest", F.sha2("payload", 256)).join(revisits, ["page_id", "digest"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, out, name, offset = _Files(folder), None, "", 0
        for batch in batches:
            found = []
            for page_id, url, raw, digest, refers_to in zip(
                *(batch.column(n).to_pylist() for n in ("page_id", "url", "payload", "digest", "refers_to"))
            ):
                if out is None or offset >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, offset = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                    out = files.create(name)
                member = gzip.compress(_record(page_id, url, raw, digest, refers_to), 6, mtime=0)
                out.write(member)
                found.append((url_key(url), page_id, name, offset, len(member)))
                offset += len(member)
            yield _captures(found)
        if out is not None:
            out.close()

    return keep(marked.mapInArrow(run, CAPTURE), "captures")


def _captures(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    columns = zip(*rows) if rows else [()] * 5
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds)], names=["key", "page_id", "file", "offset", "length"]
    )


def write_index(captures: DataFrame, folder: str, lines: int = BLOCK_LINES) -> DataFrame:
    """Sorted, compressed blocks and their sparse directories; returns ``shard, low, high``, a row per shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, out, waiting, directory = _Files(folder), None, [], []
        name, offset, low, high = f"index-{uuid.uuid4().hex}", 0, None, None

        def flush() -> None:
            nonlocal offset, low, high
            member = zlib.compress(json.dumps(waiting).encode(), 6)
            out.write(member)
            directory.append((waiting[0][0], offset, len(member)))
            offset += len(member)
            low, high = waiting[0][0] if low is None else low, waiting[-1][0]

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                out = out or files.create(f"{name}.blocks")
                waiting.append(row)
                if len(waiting) == lines:
                    flush()
                    waiting = []
        if waiting:
            flush()
        if out is not None:
            out.close()
            with files.create(f"{name}.directory") as stream:
                stream.write(zlib.compress(json.dumps(directory).encode()))
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([low]), pa.array([high])], names=["shard", "low", "high"])

    # keys are compared by code point, as Python does
    order = ("key", "page_id", "file", "offset")
    ordered = captures.select("key", "page_id", "file", "offset", "length").repartitionByRange(*order).sortWithinPartitions(*order)
    return keep(ordered.mapInArrow(run, "shard string, low string, high string"), "shards")


def lookup(keys: DataFrame, shards: DataFrame, folder: str) -> DataFrame:
    """Captures of every distinct ``key``."""
    bounds = sorted((r.low, r.high, r.shard) for r in shards.collect())  # one row per shard
    lows, highs = [b[0] for b in bounds], [b[1] for b in bounds]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for key in batch.column("key").to_pylist():
                first, last = bisect.bisect_left(highs, key), bisect.bisect_right(lows, key)
                found += [(key, bounds[k][2]) for k in range(first, last)]
            names, where = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(where, pa.string())], names=["key", "shard"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, shard, directory, firsts, block, rows, names = _Files(folder), None, [], [], None, [], []
        for batch in batches:
            found: list[tuple] = []
            for key, at in zip(batch.column("key").to_pylist(), batch.column("shard").to_pylist()):
                if at != shard:
                    shard, block = at, None
                    directory = json.loads(zlib.decompress(files.whole(f"{shard}.directory")))
                    firsts = [d[0] for d in directory]
                # captures of the key may begin in the block before the first one that starts with it
                for number in range(max(0, bisect.bisect_left(firsts, key) - 1), bisect.bisect_right(firsts, key)):
                    if number != block:
                        _, offset, length = directory[number]
                        rows, block = json.loads(zlib.decompress(files.read(f"{shard}.blocks", offset, length))), number
                        names = [r[0] for r in rows]
                    found += rows[bisect.bisect_left(names, key) : bisect.bisect_right(names, key)]
                if len(found) > 50_000:
                    yield _captures(found)
                    found = []
            yield _captures(found)
        files.close()

    wanted = keys.select("key").distinct().mapInArrow(send, "key string, shard string")
    # as many tasks as shards: the size of the keys says nothing about the blocks that are read for them
    return wanted.repartition(max(1, len(bounds)), "shard").sortWithinPartitions("shard", "key").mapInArrow(search, CAPTURE)


def fetch(captures: DataFrame, folder: str, size: int | None = None) -> DataFrame:
    """The records behind captures: ``page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to`` and their place.

    ``payload`` is null for a revisit; ``payload_bytes`` and ``payload_digest`` are those of the full payload.
    ``size`` is the length of all records together, summed here if it is not known; there is a task
    for each ``READ_BYTES`` of them, whatever the size of the captures themselves.
    """
    if size is None:
        captures = keep(captures, "captures")
        size = captures.agg(F.sum("length")).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(folder)
        for batch in batches:
            rows = []
            for page_id, name, offset, length in zip(*(batch.column(n).to_pylist() for n in ("page_id", "file", "offset", "length"))):
                fields, payload = parse_record(gzip.decompress(files.read(name, offset, length)))
                kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
                if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"record at {name}:{offset} is damaged")
                refers = fields.get("WARC-Refers-To")
                rows.append(
                    (
                        page_id,
                        fields.get("WARC-Target-URI"),
                        payload if kind == "response" else None,
                        int(fields["X-Payload-Length"]),
                        digest,
                        kind,
                        int(refers[len("<urn:page:") : -1]) if refers else None,
                        name,
                        offset,
                        length,
                    )
                )
            kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            columns = zip(*rows) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", "offset", "length"],
            )
        files.close()

    return (
        captures.repartitionByRange(max(1, -(-size // READ_BYTES)), "file", "offset")
        .sortWithinPartitions("file", "offset")
        .mapInArrow(
            run,
            "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, "
            "refers_to long, file string, offset long, length long",
        )
    )


def archive_folder(pages: DataFrame) -> str:
    return scratch_path(pages.sparkSession, "llm-warc")


def write_and_read(pages: DataFrame) -> DataFrame:
    """Archives all pages, indexes them, and reads every record back through the index by its URL."""
    folder = archive_folder(pages)
    captures = write_archives(pages, folder)
    shards = write_index(captures, folder)
    size = captures.agg(F.sum("length")).first()[0] or 0
    return fetch(lookup(captures.select("key"), shards, folder), folder, size)
