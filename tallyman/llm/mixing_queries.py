"""op1: all documents mixed to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyman.llm.mixing import BLOCK_TOKENS, MAX_PASSES, SEED, STEPS, TARGET_ENTROPY, mix_sources
from tallyman.workload.registry import Workload

work = Workload()


def _key(seed: str, *parts: str) -> str:
    text = " || ':' || ".join([f"'{seed}'", *[f"coalesce(CAST({p} AS VARCHAR), '')" for p in parts]])
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


_H = "ln(sum(pow(p, a))) - a * sum(pow(p, a) * ln(p)) / sum(pow(p, a))"

_SQL = rf"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS tokens,
    {_key(SEED, "doc_id")} AS key FROM documents
), units AS (
  SELECT source, key, CAST(sum(tokens) AS BIGINT) AS tokens FROM docs GROUP BY ALL
), places AS (
  SELECT source, key, CAST(sum(tokens) OVER w AS BIGINT) AS after, CAST(sum(tokens) OVER w AS BIGINT) - tokens AS before
  FROM units WINDOW w AS (PARTITION BY source ORDER BY key)
), totals AS (
  SELECT source, CAST(sum(tokens) AS BIGINT) AS total FROM units GROUP BY source
), shares AS (
  SELECT total / CAST((SELECT sum(total) FROM totals) AS DOUBLE) AS p FROM totals WHERE total > 0
), coarse AS (
  SELECT max(i) AS i FROM (
    SELECT i FROM (SELECT i, i / 1024.0::DOUBLE AS a, p FROM shares, range(1025) r(i)) GROUP BY i, a
    HAVING {_H} >= {TARGET_ENTROPY} * ln((SELECT count(*) FROM shares)) - 1e-12)
), fine AS (
  SELECT max(i) AS i FROM (
    SELECT i FROM (
      SELECT c.i * 1024 + r.i AS i, (c.i * 1024 + r.i) / {STEPS}.0::DOUBLE AS a, p
      FROM shares, coarse c, range(1025) r(i) WHERE c.i * 1024 + r.i <= {STEPS}) GROUP BY i, a
    HAVING {_H} >= {TARGET_ENTROPY} * ln((SELECT count(*) FROM shares)) - 1e-12)
), exponent AS (
  SELECT CASE WHEN (SELECT count(*) FROM shares) < 2 THEN {STEPS} ELSE greatest(coalesce((SELECT i FROM fine), 0),
    least({STEPS}, ceil(greatest(0, (SELECT CASE WHEN max(p) > min(p)
      THEN 1 - ln({MAX_PASSES}) / ln(max(p) / min(p)) ELSE 0 END FROM shares)) * {STEPS}))) END / {STEPS}.0::DOUBLE AS a
), plan AS (
  SELECT *, CASE WHEN total > 0 THEN quota // total ELSE 1 END AS passes FROM (
    SELECT source, total, CASE WHEN total > 0 THEN greatest(total, CAST(floor(total * pow(
      CAST((SELECT max(total) FROM totals) AS DOUBLE) / total, 1 - a) + 1e-6) AS BIGINT)) ELSE 0 END AS quota
    FROM totals, exponent)
), cuts AS (
  SELECT s.source, s.total, s.quota, s.passes,
    (SELECT max(key) FROM places u WHERE u.source IS NOT DISTINCT FROM s.source AND after <= quota - passes * total) AS last_key
  FROM plan s
), used AS (
  SELECT d.doc_id, d.source, d.tokens AS n_tokens, unnest(range(s.passes + CAST(coalesce(d.key <= s.last_key, false) AS INT))) AS pass,
    u.before, s.total, s.quota
  FROM docs d JOIN places u ON d.source IS NOT DISTINCT FROM u.source AND d.key = u.key
  JOIN cuts s ON d.source IS NOT DISTINCT FROM s.source
), blocks AS (
  SELECT greatest(1, (CAST(sum(quota) AS BIGINT) + {BLOCK_TOKENS - 1}) // {BLOCK_TOKENS}) AS n FROM plan
), dealt AS (
  SELECT doc_id, source, n_tokens, pass, CASE WHEN quota > 0 THEN least(floor(
    CAST(pass * total + before AS DOUBLE) / CAST(quota AS DOUBLE) * CAST(n AS DOUBLE)), n - 1) ELSE 0 END AS block,
    {_key(SEED + "-block", "doc_id", "pass")} AS ordered
  FROM used, blocks
)
SELECT doc_id, source, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(pass AS INTEGER) AS pass, CAST(block AS BIGINT) AS block,
  row_number() OVER (PARTITION BY block ORDER BY CASE WHEN n_tokens > 0 THEN 0 ELSE 1 + ordered % 1024 END, ordered, doc_id) - 1 AS position
FROM dealt
"""


@work.query("op1_source_mixing", _SQL)
def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
