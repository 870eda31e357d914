"""Near-duplicates by fast similarity sketching, banding and exact verification.

A sketch has ``COORDINATES`` bins. In round i every shingle is thrown into a random bin with a
random value of that round; in the second half of the rounds, round i throws all of them into bin
i. Bins keep their smallest value, an earlier round beating a later one, and a set stops when no
bin is empty: large sets after one or two rounds, and every set at the latest after twice as many
rounds as bins. Two sets agree in a bin with the probability of their Jaccard similarity, with the
concentration of independent samples, at a cost near one pass over the set.

Documents with equal sets are one node. Sketches of nodes are cut into ``BANDS`` bands; nodes that
share a band are candidates. At similarity 0.8 a pair misses all 32 bands of 4 bins with a
probability of 5e-8. Within a band's bucket, nodes are compared with one leader each, never all with
all, and linked if the whole sets say so. What this leaves open, and only that, goes on: buckets whose nodes still lie in different components
get another leader, and after ``STAR_ROUNDS`` of them their nodes are compared in blocks, where sketches
that agree in less than ``FLOOR`` of the bins are passed over (a pair of similarity 0.8 falls below
it with a probability under 1e-9).

A null or empty text has no set and no link. Rows with the same id share a component. A null id
has no component and is kept. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import chunks, discard, keep, text_bytes
from .components import components
from .hashing import LOWER, Hashed, Powers, group_of, mix, signed, sorted_in_groups, word_ranges

COORDINATES = 128
BANDS = 32
FLOOR = 0.56
STAR_ROUNDS = 2
BLOCK_SHINGLES = 1_000_000
MEMBERS = 512  # nodes that one leader, or one block, is compared with in one go
_EMPTY = np.uint32(0xFFFFFFFF)


def shingle_sets(data: np.ndarray, at: np.ndarray, words: int, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, and where each text's begin."""
    data = LOWER[data]
    starts, ends, word_at = word_ranges(data, at)
    word = Hashed(data, powers).ranges(starts, ends)
    count = np.diff(word_at)
    owner = group_of(word_at)
    left = word_at[1:][owner] - np.arange(len(word))  # words from here to the end of the text
    taken = np.minimum(left, words)
    first = (left >= words) | ((left == count[owner]) & (count[owner] < words))
    key = np.zeros(len(word), np.uint64)
    for k in range(words):
        more = np.flatnonzero(taken > k)
        key[more] = mix(key[more]) + word[more + k]
    key = mix(key[first] + taken[first].astype(np.uint64))
    set_at = np.searchsorted(owner[first], np.arange(len(at)))
    sorted_in_groups(key, set_at)
    owner = owner[first]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    return key[new], np.searchsorted(owner[new], np.arange(len(at)))


def sketch(key: np.ndarray, at: np.ndarray, bins: int = COORDINATES) -> np.ndarray:
    """A row of ``bins`` values for every set; an empty set's row is all ones."""
    rows = len(at) - 1
    table = np.full((rows, bins), _EMPTY)
    flat = table.ravel()
    owner = group_of(at)
    for turn in range(2 * bins):
        if not len(key):
            break
        value = mix(key ^ mix(np.array([turn], np.uint64)))
        place = (value % np.uint64(bins)).astype(np.int64) if turn < bins else np.full(len(key), turn - bins)
        seen = np.uint32(turn << 23) | (value >> np.uint64(41)).astype(np.uint32)
        np.minimum.at(flat, owner * bins + place, seen)
        open_rows = (table == _EMPTY).any(axis=1)
        if not open_rows.all():
            going = open_rows[owner]
            key, owner = key[going], owner[going]
    return table


def bands(table: np.ndarray, count: int = BANDS) -> np.ndarray:
    """One hash per row and band."""
    width = table.shape[1] // count
    grid = table.reshape(len(table), count, width).astype(np.uint64)
    found = np.broadcast_to(mix(np.arange(count, dtype=np.uint64)), grid.shape[:2]).copy()
    for k in range(width):
        found = mix(found ^ grid[:, :, k])
    return found


def _nested(numbers: np.ndarray) -> pa.Array:
    rows, width = numbers.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(numbers.ravel()))


def _binary(numbers: np.ndarray, at: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(numbers).view(np.uint8)
    offsets = (at * numbers.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


def _sketched(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, n_shingles, key1, key2, bands, sketch``: the two keys stand for the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for part in chunks(batch, "text"):
                key, at = shingle_sets(*text_bytes(part.column("text")), words, powers)
                table = sketch(key, at)
                sums = []
                for seed in (1, 2):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(key ^ mix(np.array([seed], np.uint64))))])
                    sums.append(pa.array(signed(total[at[1:]] - total[at[:-1]])))
                short = (mix(table.astype(np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16)
                rows = np.arange(len(at), dtype=np.int64) * table.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(at)), *sums, _nested(signed(bands(table))), _binary(short.ravel(), rows)],
                    names=["doc_id", "n_shingles", "key1", "key2", "bands", "sketch"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_shingles long, key1 long, key2 long, bands array<bigint>, sketch binary"
    )


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """``node, hashes`` (sorted distinct 64-bit shingle hashes) of the given documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for part in chunks(batch, "text"):
                key, at = shingle_sets(*text_bytes(part.column("text")), words, powers)
                yield pa.RecordBatch.from_arrays([part.column("node"), _binary(key, at)], names=["node", "hashes"])

    return docs.mapInArrow(run, "node long, hashes binary")


def _alike(own: np.ndarray, other: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the similarity."""
    small, large = sorted((own, other), key=len)
    if 100 * len(small) < percent * len(large):
        return False
    place = np.minimum(np.searchsorted(large, small), len(large) - 1)
    common = int((large[place] == small).sum())
    return 100 * common >= percent * (len(small) + len(large) - common)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose whole sets reach the similarity.

    Rows of one ``a`` come together in salted parts of about ``MEMBERS`` pairs, its own set first.
    """
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).alias("parts"))
    leaders = counts.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)))
    salted = pairs.join(counts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("long"))
    rows = (
        leaders.select("a", "part", F.col("a").alias("node"), F.lit(0).alias("kind"))
        .unionByName(salted.select("a", "part", F.col("b").alias("node"), F.lit(1).alias("kind")))
        .join(sets, "node")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, own = None, None
        for batch in batches:
            found: list[tuple[int, int]] = []
            for a, node, kind, raw in zip(*(batch.column(n).to_pylist() for n in ("a", "node", "kind", "hashes"))):
                hashes = np.frombuffer(raw, np.uint64)
                if not kind:
                    leader, own = a, hashes
                    continue
                assert leader == a, "a leader's set comes before its members"
                if _alike(own, hashes, percent):
                    found.append((a, node))
            a, b = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt = rows.repartition("a", "part").sortWithinPartitions("a", "part", "kind", "node")
    return dealt.mapInArrow(run, "a long, b long")


def _merged(component: DataFrame | None, links: DataFrame) -> DataFrame:
    """``node, component`` with further links: only the components that they join are looked at again."""
    if component is None:
        return components(links)
    for end in ("a", "b"):
        root = component.select(F.col("node").alias(end), F.col("component").alias("root"))
        links = links.join(root, end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
    joined = components(links.where("a != b"))
    moved = joined.select(F.col("node").alias("component"), F.col("component").alias("root"))
    # a root is no node of the table, so the rows of ``joined`` are new ones
    old = component.join(moved, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    return keep(old.unionByName(joined), "components")


def _open(buckets: DataFrame, component: DataFrame) -> DataFrame:
    """``bucket, node, component`` of the buckets whose nodes lie in several components."""
    rows = buckets.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = rows.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    return keep(rows.join(mixed.select("bucket"), "bucket"), "open")


def _star_pairs(rows: DataFrame, turn: int) -> DataFrame:
    """Pairs of each bucket's leader with the nodes of other components.

    The first leader is the smallest node; later ones have the smallest hash of their round.
    """
    rank = F.xxhash64("node", F.lit(turn)) if turn else F.col("node")
    lead = rows.groupBy("bucket").agg(F.min(F.struct(rank.alias("rank"), "node", "component")).alias("lead"))
    return (
        rows.join(lead, "bucket")
        .where("component != lead.component")
        .select(F.least("node", "lead.node").alias("b"), F.greatest("node", "lead.node").alias("a"))
        .distinct()
    )


def _block_links(rows: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between the components of open buckets, every pair that shares a band considered.

    Nodes that hang together over open buckets are a group. A group is dealt into blocks of bounded
    rows and bytes, every two blocks meet in one task with the nodes' whole sets, and the task gives out
    links only, one for each two components that it finds joined.
    """
    lead = rows.groupBy("bucket").agg(F.min("node").alias("b"))
    group = components(rows.join(lead, "bucket").select(F.col("node").alias("a"), "b")).withColumnRenamed("component", "group")
    members = (
        rows.select("node", "component")
        .distinct()
        .join(group, "node", "left")
        .withColumn("group", F.coalesce("group", "node"))
        .join(nodes, "node")
    )
    members = keep(members, "members")
    blocks = F.ceil(F.greatest(F.count("*") / MEMBERS, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("long")
    sized = members.groupBy("group").agg(blocks.alias("blocks"))
    # block i meets block j in task (min, max): a node goes to every task its block takes part in
    dealt = (
        members.join(sized, "group")
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("long"))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .join(sets, "node")
        .select(
            "group",
            F.least("block", "other").alias("low"),
            F.greatest("block", "other").alias("high"),
            (F.col("block") > F.col("other")).alias("upper"),
            *("node", "component", "sketch", "bands", "hashes"),
        )
    )
    task = ("group", "low", "high")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            key = np.stack([batch.column(n).to_numpy() for n in task])
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            edges = [0, *cuts.tolist(), batch.num_rows]
            for start, end in zip(edges[:-1], edges[1:]):
                if end == start:
                    continue
                if held and any(held[0].column(n)[0] != batch.column(n)[start] for n in task):
                    yield _across(held, percent)
                    held = []
                held.append(batch.slice(start, end - start))
        if held:
            yield _across(held, percent)

    return dealt.repartition(*task).sortWithinPartitions(*task, "node").mapInArrow(compare, "a long, b long")


def _across(parts: list[pa.RecordBatch], percent: int) -> pa.RecordBatch:
    whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
    get = lambda name: whole.column(name).to_numpy(zero_copy_only=False)
    node, label, upper = get("node"), get("component").copy(), get("upper")
    one = whole.column("low")[0] == whole.column("high")[0]
    sketches = np.stack([np.frombuffer(s, np.uint16) for s in whole.column("sketch").to_pylist()])
    banded = whole.column("bands").flatten().to_numpy().reshape(len(node), -1)
    hashes = [np.frombuffer(s, np.uint64) for s in whole.column("hashes").to_pylist()]
    size = np.array([len(h) for h in hashes])
    found: list[tuple[int, int]] = []
    others = np.flatnonzero(upper)
    for i in range(len(node)) if one else np.flatnonzero(~upper).tolist():
        rest = np.arange(i + 1, len(node)) if one else others
        rest = rest[label[rest] != label[i]]
        rest = rest[100 * np.minimum(size[rest], size[i]) >= percent * np.maximum(size[rest], size[i])]
        rest = rest[(banded[rest] == banded[i]).any(axis=1)]
        agree = (sketches[rest] == sketches[i]).mean(axis=1)
        near = agree >= FLOOR
        for j in rest[near][np.argsort(-agree[near], kind="stable")].tolist():
            if label[i] != label[j] and _alike(hashes[i], hashes[j], percent):
                found.append((max(node[i], node[j]), min(node[i], node[j])))
                label[label == label[j]] = label[i]
    a, b = zip(*found) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, a row per row of ``docs``.

    Two documents are linked if their sets of ``words``-word shingles have a Jaccard similarity of
    ``percent`` or more; ``component_id`` is the smallest id reachable over links.
    """
    sketched = keep(_sketched(docs, words), "sketches")
    filled = sketched.where("doc_id is not null and n_shingles > 0")
    classes = filled.groupBy("key1", "key2", "n_shingles").agg(F.min("doc_id").alias("node"))
    member = keep(
        filled.select("doc_id", "key1", "key2", "n_shingles").distinct().join(classes, ["key1", "key2", "n_shingles"]),
        "classes",
    )
    own = member.where("doc_id = node")
    nodes = keep(
        sketched.join(own.select("doc_id", "key1", "key2", "node"), ["doc_id", "key1", "key2"])
        .dropDuplicates(["node", "key1", "key2"])
        .select("node", "n_shingles", "bands", "sketch"),
        "nodes",
    )
    banded = nodes.select("node", F.explode("bands").alias("bucket"))
    crowded = banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    buckets = keep(banded.join(crowded, "bucket"), "buckets")
    involved = buckets.select("node").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(involved, "node")
    sets = keep(_sets(texts, words), "sets")

    # documents of one id that have several sets
    several = member.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("high")).where("b < high")
    component = components(member.join(several, "doc_id").select(F.col("node").alias("a"), "b"))
    for turn in range(STAR_ROUNDS + 1):
        rows = _open(buckets, component)
        if rows.isEmpty():
            break
        if turn < STAR_ROUNDS:
            found = keep(_verified(keep(_star_pairs(rows, turn), "pairs"), sets, percent), "found")
        else:
            found = keep(_block_links(rows, nodes, sets, percent), "found")
        discard(rows)
        if not found.isEmpty():
            component = _merged(component, found)

    discard(buckets, sets, nodes)
    of_doc = member.join(component, "node", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "node")).alias("component"))
    result = sketched.select("doc_id", "n_shingles").join(of_doc, "doc_id", "left")
    component_id = F.coalesce("component", "doc_id")
    return result.select(
        "doc_id",
        "n_shingles",
        component_id.alias("component_id"),
        F.coalesce(F.col("doc_id") == component_id, F.lit(True)).alias("kept"),
    )
