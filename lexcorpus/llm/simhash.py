"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint has 64 bits; a bit is 1 if it is set in more than half of the XXH64 values of a text's
word shingles (repeats counted). Two texts are linked if at most ``distance`` bits differ.

Bits are grouped into ``PARTS`` parts of equal width, bits that are correlated over all distinct
fingerprints together. A fingerprint gets a threshold for each part, -1 (not probed) to ``distance``,
whose sum is ``distance - PARTS + 1``: if every part of another fingerprint differed by more than its
threshold, the whole would differ by more than ``distance``. So probing every part within its
threshold finds all links, and thresholds are free to avoid the values that very many fingerprints
share: dynamic programming takes the cheapest ones, the candidate counts coming from exact counts per
part and value (2 ** (64 / PARTS) numbers a part, whatever the size of the corpus).

Rows of one part and value are a bucket. Its fingerprints lie in blocks of at most ``BLOCK``, each in
one task that holds the block (8 bytes a fingerprint) while the probes stream past it. Every pair is
verified on all 64 bits, and a task gives out only links that join something: one for each
fingerprint at most, never all pairs of a group of copies. Texts with equal fingerprints are one
node throughout. Comparisons grow with the square of the distinct fingerprints, divided by 65,536
and by a cost of about two nanoseconds.

A null or empty text has the fingerprint zero and is linked like any other. Rows with the same id
share a component, whatever their texts. A row without an id takes part in the links; its component is
that of its fingerprint (null if no linked row has an id). An empty table gives an empty result, and
further columns of the table are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import chunks, keep, text_bytes
from .components import components
from .ngrams import NOT_SPACE, gram_ranges, joined_words, xxh64

SEED = 42
PARTS = 4
WIDTH = 64 // PARTS
BLOCK = 1 << 16  # fingerprints of a bucket that one task holds
PROBE_COST = 100  # of one probed value, in comparisons
SMALL = 48  # rows of a bucket that are compared all at once
SHINGLES = 1 << 18  # values whose bits are counted at a time


# -- fingerprints ---------------------------------------------------------------------------------


def _majority(value: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each group of values: the bits that are set in more than half of them."""
    size = np.diff(at)
    ones = np.zeros((64, len(size)), np.int64)
    owner = np.repeat(np.arange(len(size)), size)
    for low in range(0, len(value), SHINGLES):
        part, group = value[low : low + SHINGLES], owner[low : low + SHINGLES]
        head = np.flatnonzero(np.diff(group, prepend=-1))
        for bit in range(64):
            ones[bit, group[head]] += np.add.reduceat((part >> np.uint64(bit)) & np.uint64(1), head).astype(np.int64)
    found = np.zeros(len(size), np.uint64)
    for bit in range(64):
        found |= (2 * ones[bit] > size).astype(np.uint64) << np.uint64(bit)
    return found


def simhash(data: np.ndarray, at: np.ndarray, words: int) -> np.ndarray:
    """Fingerprint of each text; fewer than ``words`` words are one shingle, no words give zero."""
    joined, start, end, word_at = joined_words(data, at, NOT_SPACE)
    low, high, gram_at = gram_ranges(start, end, word_at, words)
    found = _majority(xxh64(joined, low, high, SEED), gram_at)
    count = np.diff(word_at)
    short = np.flatnonzero((count > 0) & (count < words))
    found[short] = xxh64(joined, start[word_at[short]], end[word_at[short + 1] - 1], SEED)
    return found


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``doc_id, fingerprint`` (the 64 bits as a long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                found = simhash(*text_bytes(part.column("text")), words)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fingerprint"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fingerprint long")


# -- parts and thresholds -------------------------------------------------------------------------


def _bits(value: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(value).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _together(nodes: DataFrame) -> np.ndarray:
    """How many distinct fingerprints have bits i and j set, for all i and j."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((64, 64), np.int64)
        for batch in batches:
            bits = _bits(batch.column("fingerprint").to_numpy()).astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4096)), pa.array(total.ravel())], names=["cell", "n"])

    rows = nodes.select("fingerprint").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(4096)
    for row in rows:  # 4,096 rows
        total[row.cell] = row.n
    return total.reshape(64, 64)


def grouped_bits(together: np.ndarray, n: int) -> list[list[int]]:
    """The 64 bits in ``PARTS`` groups: each begins with the closest pair left and takes the bit closest to its own."""
    share = together / max(n, 1)
    own = np.diag(share)
    spread = np.sqrt(np.outer(own * (1 - own), own * (1 - own)))
    close = np.abs(np.divide(share - np.outer(own, own), spread, out=np.zeros((64, 64)), where=spread > 0))
    np.fill_diagonal(close, 0)
    left, groups = list(range(64)), []
    for _ in range(PARTS):
        inner = close[np.ix_(left, left)]
        i, j = np.unravel_index(np.argmax(inner), inner.shape)
        group = [left[i], left[j if i != j else (i + 1) % len(left)]]
        while len(group) < WIDTH:
            rest = [b for b in left if b not in group]
            group.append(rest[int(np.argmax(close[np.ix_(rest, group)].sum(axis=1)))])
        left = [b for b in left if b not in group]
        groups.append(sorted(group))
    return groups


def part_values(value: np.ndarray, groups: list[list[int]]) -> np.ndarray:
    """A row per part: the bits of the part as one number."""
    out = np.zeros((len(groups), len(value)), np.int64)
    for part, group in enumerate(groups):
        for place, bit in enumerate(group):
            out[part] |= (((value >> np.uint64(bit)) & np.uint64(1)) << np.uint64(place)).astype(np.int64)
    return out


def _value_counts(nodes: DataFrame, groups: list[list[int]]) -> np.ndarray:
    """Distinct fingerprints per part and value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(PARTS << WIDTH, np.int64)
        for batch in batches:
            values = part_values(batch.column("fingerprint").to_numpy().view(np.uint64), groups)
            for part in range(PARTS):
                total += np.bincount(values[part] + (part << WIDTH), minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["cell", "n"])

    cells = nodes.select("fingerprint").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    total = np.zeros(PARTS << WIDTH, np.int64)
    found = cells.toPandas()  # at most PARTS * 2 ** WIDTH rows: 262,144
    total[found["cell"]] = found["n"]
    return total.reshape(PARTS, 1 << WIDTH)


def ball_counts(counts: np.ndarray, radius: int) -> np.ndarray:
    """``[part, r, value]``: fingerprints whose part differs from ``value`` by at most r bits."""
    exact = np.zeros((len(counts), radius + 1, counts.shape[1]), np.int64)
    exact[:, 0] = counts
    values = np.arange(counts.shape[1])
    for bit in range(counts.shape[1].bit_length() - 1):
        turned = exact[:, :, values ^ (1 << bit)]
        exact[:, 1:] += turned[:, :-1]  # a set of r bits without this one, or with it
    return np.cumsum(exact, axis=1)


def masks(radius: int) -> list[np.ndarray]:
    """For r from 0 to ``radius``: all numbers of WIDTH bits with exactly r bits set."""
    numbers = np.arange(1 << WIDTH)
    set_bits = np.bitwise_count(numbers)
    return [numbers[set_bits == r] for r in range(radius + 1)]


def thresholds(values: np.ndarray, balls: np.ndarray, distance: int) -> np.ndarray:
    """``[part, fingerprint]``: the cheapest thresholds with sum ``distance - PARTS + 1``.

    ``best[s]`` is the least cost of the parts so far when their thresholds plus one add up to s.
    """
    probed = np.cumsum([len(m) for m in masks(distance)])
    rows, need = values.shape[1], distance + 1
    best = np.full((need + 1, rows), np.inf)
    best[0] = 0
    taken = np.zeros((PARTS, need + 1, rows), np.int8)
    for part in range(PARTS):
        cost = np.zeros((need + 1, rows))
        for r in range(distance + 1):
            cost[r + 1] = PROBE_COST * probed[r] + balls[part, r, values[part]]
        longer = np.full((need + 1, rows), np.inf)
        for total in range(need + 1):
            for step in range(total + 1):
                price = best[total - step] + cost[step]
                better = price < longer[total]
                longer[total][better] = price[better]
                taken[part, total][better] = step
        best = longer
    out, total, every = np.zeros((PARTS, rows), np.int8), np.full(rows, need), np.arange(rows)
    for part in reversed(range(PARTS)):
        step = taken[part, total, every]
        out[part] = step - 1
        total = total - step
    return out


# -- probing --------------------------------------------------------------------------------------

# Places in a bucket's order: a block's own fingerprints come before the probes from elsewhere.
_KEPT, _PROBING, _PROBE = 0, 1, 2


def _blocks_of(counts: np.ndarray) -> np.ndarray:
    return np.maximum(1, -(-counts // BLOCK))


def _bucket_rows(nodes: DataFrame, groups: list[list[int]], counts: np.ndarray, distance: int) -> DataFrame:
    """``bucket, block, role, fingerprint``: each fingerprint in its block, and as a probe wherever it has to be."""
    shared = nodes.sparkSession.sparkContext.broadcast(counts)  # PARTS * 2 ** WIDTH numbers: 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        balls, blocks, rings = ball_counts(counts, distance), _blocks_of(counts), masks(distance)
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                value = batch.column("fingerprint").to_numpy()[low : low + 4096].view(np.uint64)
                values = part_values(value, groups)
                limit = thresholds(values, balls, distance)
                for part in range(PARTS):
                    home = (value * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % blocks[part, values[part]]
                    yield rows(part, values[part], home, np.where(limit[part] >= 0, _PROBING, _KEPT), value)
                    for r, ring in enumerate(rings):
                        who = np.flatnonzero(limit[part] >= r)
                        where = (values[part, who][:, None] ^ ring).ravel()
                        who = np.repeat(who, len(ring))
                        some = counts[part, where] > 0
                        where, who = where[some], who[some]
                        times = blocks[part, where]
                        block = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                        where, who = np.repeat(where, times), np.repeat(who, times)
                        if r == 0:  # in its own block it is there already
                            away = block != home[who]
                            where, who, block = where[away], who[away], block[away]
                        if len(who):
                            yield rows(part, where, block, np.full(len(who), _PROBE), value[who])

    def rows(part: int, where: np.ndarray, block: np.ndarray, role: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
        columns = [
            pa.array((where + (part << WIDTH)).astype(np.int32)),
            pa.array(block.astype(np.int32)),
            pa.array(role.astype(np.int8)),
            pa.array(value.view(np.int64)),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["bucket", "block", "role", "fingerprint"])

    return nodes.select("fingerprint").mapInArrow(run, "bucket int, block int, role tinyint, fingerprint long")


class _Links:
    """Fingerprints that are known to hang together, and the links that have joined them."""

    def __init__(self, value: np.ndarray):
        self.value = value
        self.label = np.arange(len(value))

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Adds links between rows: labels sink to the smallest one that is reachable."""
        while len(a):
            low = np.minimum(self.label[a], self.label[b])
            before = self.label.copy()
            for end in (a, b):
                np.minimum.at(self.label, before[end], low)
                np.minimum.at(self.label, end, low)
            while (self.label[self.label] != self.label).any():
                self.label = self.label[self.label]
            apart = self.label[a] != self.label[b]
            a, b = a[apart], b[apart]

    def found(self) -> pa.RecordBatch:
        moved = np.flatnonzero(self.value != self.value[self.label])
        a, b = self.value[moved], self.value[self.label[moved]]
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def _small_links(value: np.ndarray, bucket: np.ndarray, distance: int) -> pa.RecordBatch:
    """Links of many small buckets: each row is compared with the next, the one after it, ..."""
    links, a, b = _Links(value), [], []
    going, step = np.arange(len(value)), 1
    while len(going):
        going = going[going + step < len(value)]
        going = going[bucket[going] == bucket[going + step]]
        near = going[np.bitwise_count(value[going] ^ value[going + step]) <= distance]
        a.append(near)
        b.append(near + step)
        step += 1
    links.join(np.concatenate(a), np.concatenate(b))
    return links.found()


def _probe(held: np.ndarray, probes: np.ndarray, distance: int) -> pa.RecordBatch:
    """Links between a block and probes: a probe passes over what it is joined with already."""
    links = _Links(np.concatenate([held, probes]))
    for i in range(len(held), len(links.value)):
        hit = np.flatnonzero(np.bitwise_count(held ^ links.value[i]) <= distance)
        joined = np.unique(links.label[hit])
        if len(joined):
            low = min(int(joined[0]), int(links.label[i]))
            links.label[i] = low
            if len(joined) > 1 or joined[0] != low:
                links.label[np.isin(links.label, joined)] = low
    return links.found()


def _links(rows: DataFrame, distance: int) -> DataFrame:
    """``a, b``: fingerprints that a chain of links joins, enough of them to hold all groups together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, np.zeros(0, np.uint64)
        for batch in batches:
            bucket, block, role = (batch.column(n).to_numpy().astype(np.int64) for n in ("bucket", "block", "role"))
            value = batch.column("fingerprint").to_numpy().view(np.uint64)
            keys = (bucket << 32) | block
            head = np.flatnonzero(np.diff(keys, prepend=-1))
            size = np.diff(np.append(head, len(keys)))
            # buckets that lie within the batch and are small
            whole = size <= SMALL
            whole[[0, -1]] = False
            small = np.repeat(whole, size)
            if small.any():
                yield _small_links(value[small], keys[small], distance)
            for first, count in zip(head[~whole].tolist(), size[~whole].tolist()):
                part = slice(first, first + count)
                if keys[first] != key:
                    key, held = keys[first], np.zeros(0, np.uint64)
                own, probing = role[part] != _PROBE, role[part] != _KEPT
                # fingerprints of the block come first: a probe meets those before it, and they meet
                # the later ones as probes themselves
                held = np.concatenate([held, value[part][own]])
                if probing.any():
                    yield _probe(held, value[part][probing], distance)

    dealt = rows.repartition("bucket", "block").sortWithinPartitions("bucket", "block", "role")
    return dealt.mapInArrow(run, "a long, b long")


# -- groups ---------------------------------------------------------------------------------------


def similar_fingerprints(nodes: DataFrame, distance: int = 3) -> DataFrame:
    """``a, b``: pairs whose components are those of all ``fingerprint`` values of ``nodes`` linked within ``distance`` bits.

    The two of a pair hang together, at times over others of their bucket.
    """
    groups = grouped_bits(_together(nodes), nodes.count())
    counts = _value_counts(nodes, groups)
    return _links(_bucket_rows(nodes, groups, counts, distance), distance)


def simhash_groups(docs: DataFrame, words: int = 3, distance: int = 3) -> DataFrame:
    """``doc_id, fingerprint`` (long) and ``component_id`` (the smallest id reachable) of every row."""
    rows = keep(fingerprints(docs, words), "fingerprints")
    nodes = keep(rows.select("fingerprint").distinct(), "distinct")
    # rows of one id that have several fingerprints hang together
    known = rows.where("doc_id is not null").select("doc_id", "fingerprint").distinct()
    several = known.groupBy("doc_id").agg(F.min("fingerprint").alias("b"), F.max("fingerprint").alias("top")).where("b < top")
    same_id = known.join(several, "doc_id").select(F.col("fingerprint").alias("a"), "b")
    links = similar_fingerprints(nodes, distance).unionByName(same_id)
    component = components(links).withColumnRenamed("node", "fingerprint")
    least = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    part = F.coalesce("component", "fingerprint")
    named = least.join(component, "fingerprint", "left").select("fingerprint", "least", part.alias("component"))
    named = keep(named, "named")
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "component").select("fingerprint", "component_id")
    return rows.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def first_of_each_group(docs: DataFrame, words: int = 3, distance: int = 3) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group, all their columns as they are.

    Of groups without any id every row stays.
    """
    groups = simhash_groups(docs, words, distance).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(groups, "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))


def hexadecimal(column: str):
    """The 64 bits of a long as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))
