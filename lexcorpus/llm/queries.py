"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import cascade, drift_clusters, hidden_markov, merkle, mixing, packing, repeats, resampling, simhash, sketches, snapshots, toxicity, warc
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken", "source", "copies", "part_words")


@query
def op9_pack_powers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


@query
def op10_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.judge(table(spark, sf_dir, "documents"))


@query
def op7_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats.digest(repeats.cut_repeats(docs))


@query
def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=2)


@query
def op4_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hidden_markov.score_corpus(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op6_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_with_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op5_toxic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = toxicity.fit_and_score(docs, table(spark, sf_dir, "labels"), ["doc_id"])
    return rows.select(
        "doc_id",
        toxicity.held_out().alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
        "evidence",
    )


@query
def op11_simhash_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"), words=3, distance=3)
    return groups.select("doc_id", simhash.hexadecimal("fingerprint").alias("fingerprint"), "component_id")


@query
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return resampling.resampling_ranks(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


# CRC32 of each distinct word: a table of 256 entries, then a step per byte
ORACLE["op13_importance_resampling"] = r"""
WITH steps AS MATERIALIZED (
    SELECT list(list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0],
        lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS entry
    FROM range(256) AS r(i)),
words AS MATERIALIZED (
    SELECT 'd' AS kind, doc_id AS id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
    FROM documents
    UNION ALL
    SELECT 't', item_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'))
    FROM benchmark),
bytes AS (
    SELECT word, [4294967295::BIGINT] || list_transform(range(0, octet_length(encode(word))),
        lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT) AS said
    FROM (SELECT DISTINCT word FROM words)),
buckets AS MATERIALIZED (
    SELECT word, xor(list_reduce(said, lambda c, b: xor(c >> 8, entry[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
    FROM bytes, steps),
counts AS MATERIALIZED (
    SELECT bucket, count(*) FILTER (kind = 'd') AS s, count(*) FILTER (kind = 't') AS t
    FROM words JOIN buckets USING (word) GROUP BY bucket),
totals AS (SELECT sum(s)::DOUBLE AS s_all, sum(t)::DOUBLE AS t_all FROM counts),
gains AS MATERIALIZED (
    SELECT bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::BIGINT AS gain
    FROM counts, totals),
weights AS (
    SELECT id, count(*) AS n_features, sum(gain)::BIGINT AS weight
    FROM words JOIN buckets USING (word) JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY id),
scores AS (
    SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln(
            (('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
    FROM documents LEFT JOIN weights ON id = doc_id),
ranks AS (
    SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n
    FROM scores WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank
FROM scores LEFT JOIN ranks USING (doc_id)
"""


@query
def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift_clusters.cluster_report(table(spark, sf_dir, "embeddings"))


def _lloyd_sql(k: int, rounds: int, dims: int, scale: int, seed: int) -> str:
    """All rounds one after the other: distances to all centroids, then floors of the means."""
    parts = [
        f"""kept AS MATERIALIZED (
    SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = {dims} AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))))""",
        f"""c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c, v FROM kept
    ORDER BY sha256('{seed}:' || vec_id) LIMIT {k})""",
    ]
    for turn in range(rounds + 1):
        parts.append(f"""a{turn} AS MATERIALIZED (
    SELECT vec_id, any_value(v) AS v, min(struct_pack(d := d, c := c)) AS best FROM (
        SELECT vec_id, kept.v AS v, c, list_sum(list_transform(range(1, {dims + 1}),
            lambda i: (kept.v[i] - c{turn}.v[i]) * (kept.v[i] - c{turn}.v[i])))::BIGINT AS d
        FROM kept CROSS JOIN c{turn})
    GROUP BY vec_id)""")
        if turn < rounds:
            parts.append(f"""m{turn} AS MATERIALIZED (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (
        SELECT best.c AS c, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{turn}, range(1, {dims + 1}) AS r(i) GROUP BY ALL)
    GROUP BY c),
c{turn + 1} AS MATERIALIZED (
    SELECT c, coalesce(m{turn}.v, c{turn}.v) AS v FROM c{turn} LEFT JOIN m{turn} USING (c))""")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, c::INTEGER AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
    (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON c = best.c"""


ORACLE["op12_centroid_clusters"] = _lloyd_sql(k=40, rounds=5, dims=64, scale=256, seed=2)


@query
def op2_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.write_and_read(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE["op2_warc_index"] = """
SELECT page_id, payload_bytes, payload_digest, record_type, refers_to
FROM (
    SELECT page_id, payload_bytes, payload_digest,
        CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
    FROM (
        SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
            sha256(coalesce(html, '')) AS payload_digest,
            min(page_id) OVER (PARTITION BY sha256(coalesce(html, ''))) AS first
        FROM pages))
"""


@query
def op8_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.rendered(table(spark, sf_dir, "conversations"))


ORACLE["op8_chat_snapshots"] = """
WITH turns AS (
    SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations),
chats AS (
    SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn NULLS FIRST, role, text) AS said
    FROM turns WHERE conv_id IS NOT NULL GROUP BY conv_id
    UNION ALL
    SELECT NULL, [struct_pack(role := role, text := text)] FROM turns WHERE conv_id IS NULL),
classes AS (SELECT min(conv_id) AS conv_id, count(*) AS copies, said FROM chats GROUP BY said),
inner_prefixes AS (
    SELECT DISTINCT said[1:n] AS said
    FROM (SELECT said, unnest(generate_series(1, len(said) - 1)) AS n FROM classes))
SELECT conv_id, len(said) AS n_turns, copies,
    array_to_string(['<|' || t.role || '|>' || chr(10) || t.text || chr(10) || '<|end|>' || chr(10) FOR t IN said], '')
        AS rendered
FROM classes WHERE NOT EXISTS (SELECT 1 FROM inner_prefixes p WHERE p.said = classes.said)
"""
