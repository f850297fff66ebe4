"""Registered queries of the operators: each applies
its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dunegrid.llm import (digest, main_text, maxent, merkle, mixing, near_dup, packing, quality, resample, sharding, token_orc,
                          top_k, warc)
from dunegrid.llm.common import table
from dunegrid.session import scratch_table_path


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _scratch(spark: SparkSession, name: str) -> str:
    return scratch_table_path(spark, name)


def op1_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.digests(table(spark, sf_dir, "documents"))


def op2_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark, "token-orc")
    token_orc.write_token_orc(table(spark, sf_dir, "documents"), path, tokenizer_file("byte_bpe_50k.json"), 0)
    return token_orc.documents(spark, path)


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_dup.groups(table(spark, sf_dir, "documents"), words=3, percent=85)
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return main_text.extract(pages, main_text.learn(pages))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(table(spark, sf_dir, "embeddings"), 5, 50)


OP5_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS nth FROM s
)
SELECT query_id, CAST(nth AS INTEGER) AS rank, vec_id, score FROM r WHERE nth <= 5
"""


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), _scratch(spark, "warc"), min_bytes=0)


# Base 32 of the 160-bit digest: 32 times 5 bits out of its hexadecimal form.
OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, payload, upper(sha1(payload)) || '0' AS h FROM p),
f AS (SELECT payload, min(page_id) AS first_id FROM p GROUP BY payload)
SELECT page_id, CAST(strlen(d.payload) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(h, (5 * i) // 4 + 1, 2) AS INT) >> CAST(3 - (5 * i) % 4 AS INT)) & 31) + 1 AS BIGINT), 1)), '')
    AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d JOIN f ON f.payload = d.payload
"""


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), 2, 4096)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.decide(table(spark, sf_dir, "documents"), (3, 1, 2), 1.5, 2.0)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_rows(table(spark, sf_dir, "documents"), 24)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.ranks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=1, buckets=10_000,
                          seed=2024, percent=10, least_words=20)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), merkle.every_seventh(), fanout=2)


def op13_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.scores(table(spark, sf_dir, "documents"))


# CRC-32 byte by byte over a table made from its polynomial.
CRC_TABLE = """crc_table AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
)"""
CRC = """xor(list_reduce(list_concat([4294967295], list_transform(range(0, strlen({0})),
    lambda i: CAST('0x' || substr(hex(encode({0})), 2 * i + 1, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS BIGINT) + 1])), 4294967295)"""
OP11_SQL = f"""
WITH {CRC_TABLE}, words AS MATERIALIZED (
  SELECT doc_id, CAST(unnest(n.w) AS VARCHAR) AS w FROM (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents) n
), target AS MATERIALIZED (
  SELECT CAST(unnest(n.w) AS VARCHAR) AS w FROM (
    SELECT regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) n
), feature AS MATERIALIZED (
  SELECT w, CAST({CRC.format("w")} AS BIGINT) % 10000 AS bucket
  FROM (SELECT w FROM words UNION SELECT w FROM target), crc_table
), s AS (SELECT bucket, count(*) AS n FROM words JOIN feature USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM target JOIN feature USING (w) GROUP BY bucket),
totals AS (SELECT (SELECT count(*) FROM words) + 10000 AS s, (SELECT count(*) FROM target) + 10000 AS t),
gain AS (
  SELECT b.bucket, CAST(floor(1000 * ln((CAST(coalesce(t.n, 0) + 1 AS DOUBLE) * CAST(totals.s AS DOUBLE))
    / (CAST(coalesce(s.n, 0) + 1 AS DOUBLE) * CAST(totals.t AS DOUBLE)))) AS BIGINT) AS g
  FROM (SELECT unnest(range(10000)) AS bucket) b LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), totals
), weights AS (
  SELECT doc_id, count(*) AS n, CAST(sum(g) AS BIGINT) AS g
  FROM words JOIN feature USING (w) JOIN gain USING (bucket) GROUP BY doc_id
), scored AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_features,
    CASE WHEN n IS NULL THEN 0 ELSE CAST((g - ((g % n) + n) % n) AS BIGINT) // n END AS weight,
    CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) AS h
  FROM documents d LEFT JOIN weights w ON w.doc_id = d.doc_id
), drawn AS (
  SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM scored
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n
  FROM drawn WHERE n_features >= 20
)
SELECT d.doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score,
  CASE WHEN rank <= 10 * n // 100 THEN CAST(rank AS BIGINT) END AS rank
FROM drawn d LEFT JOIN ranked r ON r.doc_id = d.doc_id
"""
OP12_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || {0}, '-')"
OP12_LEAF = "sha256(" + " || ".join(OP12_FIELD.format(c) for c in ("doc_id", "source", "lang", "{0}", "text")) + ")"
OP12_SQL = f"""
WITH RECURSIVE {CRC_TABLE}, leaf AS MATERIALIZED (
  SELECT doc_id, lang, {OP12_LEAF.format("n_chars")} AS leaf, {OP12_LEAF.format("(n_chars + 1)")} AS other,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n,
    CAST({CRC.format("CAST(doc_id AS VARCHAR)")} AS BIGINT) % 7 = 0 AS altered
  FROM documents, crc_table
), tree AS (
  SELECT lang, 0 AS level, idx, leaf AS h, n FROM leaf
  UNION ALL
  SELECT lang, level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 1) // 2
  FROM tree WHERE n > 1 GROUP BY lang, level, idx // 2
), sub AS MATERIALIZED (
  SELECT lang, level AS depth, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n
  FROM tree WHERE n = 1
), top AS (
  SELECT 0 AS level, idx, subroot AS h, n FROM sub
  UNION ALL
  SELECT level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 1) // 2
  FROM top WHERE n > 1 GROUP BY level, idx // 2
), near AS MATERIALIZED (
  SELECT a.lang, a.level, a.idx, CASE WHEN b.idx < a.idx THEN b.h ELSE '' END AS before,
    CASE WHEN b.idx > a.idx THEN b.h ELSE '' END AS after
  FROM tree a LEFT JOIN tree b ON a.lang IS NOT DISTINCT FROM b.lang AND a.level = b.level
    AND b.idx = a.idx + 1 - 2 * (a.idx % 2)
  WHERE a.n > 1
), far AS MATERIALIZED (
  SELECT a.level, a.idx, CASE WHEN b.idx < a.idx THEN b.h ELSE '' END AS before,
    CASE WHEN b.idx > a.idx THEN b.h ELSE '' END AS after
  FROM top a LEFT JOIN top b ON a.level = b.level AND b.idx = a.idx + 1 - 2 * (a.idx % 2)
  WHERE a.n > 1
), path AS MATERIALIZED (
  SELECT l.doc_id, s.level AS step, s.before, s.after
  FROM leaf l JOIN near s ON l.lang IS NOT DISTINCT FROM s.lang AND s.idx = l.idx // CAST(pow(2, s.level) AS BIGINT)
  UNION ALL
  SELECT l.doc_id, sub.depth + s.level, s.before, s.after
  FROM leaf l JOIN sub ON l.lang IS NOT DISTINCT FROM sub.lang JOIN far s ON s.idx = sub.idx // CAST(pow(2, s.level) AS BIGINT)
), proof AS (
  SELECT doc_id, sha256(string_agg(before || after, '' ORDER BY step)) AS proof_sha256, count(*) AS steps FROM path GROUP BY doc_id
), climb AS (
  SELECT doc_id, 0 AS step, CASE WHEN altered AND n_chars IS NOT NULL THEN other ELSE leaf END AS folded
  FROM leaf JOIN documents USING (doc_id)
  UNION ALL
  SELECT c.doc_id, c.step + 1, sha256(p.before || c.folded || p.after)
  FROM climb c JOIN path p ON p.doc_id = c.doc_id AND p.step = c.step
), root AS (SELECT h AS root FROM top WHERE n = 1)
SELECT l.doc_id, l.leaf, sub.subroot, root.root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256,
  c.folded AS folded_root, c.folded = root.root AS verified
FROM leaf l JOIN sub ON l.lang IS NOT DISTINCT FROM sub.lang LEFT JOIN proof p ON p.doc_id = l.doc_id
  JOIN climb c ON c.doc_id = l.doc_id AND c.step = coalesce(p.steps, 0), root
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_digest": op1_digest,
    "op2_token_orc": op2_token_orc,
    "op3_near_dup": op3_near_dup,
    "op4_main_text": op4_main_text,
    "op5_top_k": op5_top_k,
    "op6_warc": op6_warc,
    "op7_packing": op7_packing,
    "op8_mixing": op8_mixing,
    "op9_sharding": op9_sharding,
    "op10_quality": op10_quality,
    "op11_resample": op11_resample,
    "op12_merkle": op12_merkle,
    "op13_maxent": op13_maxent,
}
ORACLES: dict[str, str] = {"op5_top_k": OP5_SQL, "op6_warc": OP6_SQL, "op11_resample": OP11_SQL,
                           "op12_merkle": OP12_SQL}
