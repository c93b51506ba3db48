"""The queries of this subpackage with production parameters over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import bayes_quality, chat, embed_graph, minhash, packing, piece_scan, quality_rules, secret_scan, sharding, toxicity

SHARD_BYTES = 1 << 20


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents"), SHARD_BYTES)


def op2_embedding_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_graph.near_vectors(_table(spark, sf_dir, "embeddings"))


def op3_piece_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_scan.digests(*piece_scan.encode(_table(spark, sf_dir, "documents")))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.verdicts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], said.schema)
    return chat.digests(chat.read_back(chat.expand(said.union(extra))))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find(_table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(_table(spark, sf_dir, "documents")))


def op9_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return bayes_quality.posterior(docs, labels, F.col("source"), F.col("lang"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_measures(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_extendible_sharding": op1_extendible_sharding,
    "op2_embedding_graph": op2_embedding_graph,
    "op3_piece_scan": op3_piece_scan,
    "op4_minhash_dedup": op4_minhash_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_secret_scan": op7_secret_scan,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_quality_bayes": op9_quality_bayes,
    "op10_quality_rules": op10_quality_rules,
}

#: A bucket of the directory is the shallowest prefix of 60 hash bits whose bytes fit (keys are unique in the tables).
OP1_SQL = f"""
WITH r AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes,
         CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h
  FROM documents),
n AS (
  SELECT d, h >> (60 - d) AS p, sum(n_bytes) AS shard_bytes, count(*) AS shard_docs
  FROM r, range(0, 61) AS t(d) GROUP BY ALL),
f AS (
  SELECT doc_id, n_bytes, h, min(d) AS depth FROM r, range(0, 61) AS t(d)
  JOIN n USING (d) WHERE n.p = h >> (60 - d) AND (shard_bytes <= {SHARD_BYTES} OR shard_docs = 1) GROUP BY ALL)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes,
       CASE WHEN depth = 0 THEN '' ELSE lpad(bin(h >> (60 - depth)), CAST(depth AS INT), '0') END AS shard,
       CAST(depth AS INT) AS depth, CAST(shard_bytes AS BIGINT) AS shard_bytes, CAST(shard_docs AS BIGINT) AS shard_docs
FROM f JOIN n ON n.d = f.depth AND n.p = f.h >> (60 - f.depth)
"""

OP6_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (
  SELECT *, length(replace(text, '␛', '␛␛'))
         + len(regexp_extract_all(text, '</?s>|\[/?INST\]|<</?SYS>>|\[/?ROLE'))
         + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 5 ELSE 14 + 2 * strlen(role) END AS n
  FROM c),
s AS (
  SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS stop,
         max(turn) OVER (PARTITION BY conv_id) AS last_turn FROM f)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(CAST(sum(length(text)) FILTER (role = 'assistant') AS BIGINT), 0) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(stop) FILTER (role = 'assistant' OR turn = last_turn) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""

OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
g AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
m AS (SELECT doc_id, g FROM g GROUP BY ALL HAVING count(*) > 1),
p AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g JOIN m USING (doc_id, g)) GROUP BY doc_id),
s AS (
  SELECT doc_id, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(p.n, 0) AS n_repeat_words, len(regexp_extract_all(t, '[A-Z]')) AS n_capitals
  FROM d LEFT JOIN p USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 30 * n_words OR (n_dup_lines >= 5 AND 2 * n_dup_lines > n_lines)
            OR 2 * n_capitals > word_chars OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM b
"""

OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh FROM w),
x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b USING (g) WHERE a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r AS (SELECT a, a AS m FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.m),
c AS (SELECT a AS doc_id, min(m) AS m FROM r GROUP BY a)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, coalesce(least(m, doc_id), doc_id) AS component_id,
       coalesce(least(m, doc_id), doc_id) = doc_id AS kept
FROM s LEFT JOIN c USING (doc_id)
"""

OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[64]) AS v FROM embeddings
  WHERE len(embedding) = 64 AND list_sum(list_transform(embedding, lambda x: x * x)) > 0),
e AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND array_cosine_similarity(a.v, b.v) >= 0.95),
r AS (SELECT a, a AS m FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.m),
c AS (SELECT a AS vec_id, min(m) AS m FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(m, vec_id) AS component_id, coalesce(m, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)
"""

ORACLES: dict[str, str] = {
    "op1_extendible_sharding": OP1_SQL,
    "op2_embedding_graph": OP2_SQL,
    "op4_minhash_dedup": OP4_SQL,
    "op6_chat_formatting": OP6_SQL,
    "op10_quality_rules": OP10_SQL,
}
