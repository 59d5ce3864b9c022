"""op7: rules on all documents and their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyman.llm import host_rules as rules
from tallyman.workload.registry import Workload

work = Workload()

_SQL = rf"""
WITH docs AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, g) AS n FROM (
    SELECT doc_id, s, array_to_string(w[s:s + 2], ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS s FROM docs))
), repeats AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([s, s + 1, s + 2]) AS p FROM windows WHERE n > 1) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM docs)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id
), measured AS (
  SELECT d.doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM docs d LEFT JOIN lines l ON l.doc_id = d.doc_id LEFT JOIN repeats r ON r.doc_id = d.doc_id
), ruled AS (
  SELECT *, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEAT_PERCENT} * n_words AS base_failed,
    100 * n_symbols > {rules.MAX_SYMBOLS_PER_100} * n_words
      OR n_dup_lines >= {rules.LEAST_DUP_LINES} AND 100 * n_dup_lines > {rules.MAX_DUP_LINE_PERCENT} * n_lines AS more_failed
  FROM measured
), hosts AS (
  SELECT source, count(*) AS n, sum(CASE WHEN base_failed OR more_failed THEN 1 ELSE 0 END) AS bad
  FROM ruled WHERE source IS NOT NULL GROUP BY source
), prior AS (
  SELECT m, least(greatest(CASE WHEN v > 0 THEN m * (1 - m) / v - 1 ELSE {rules.STRONGEST_PRIOR} END, 1), {rules.STRONGEST_PRIOR}) AS s
  FROM (SELECT avg(bad / n) AS m, var_pop(bad / n) AS v FROM hosts)
), verdicts AS (
  SELECT source, (bad + m * s) / (n + s) AS rate FROM hosts, prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND CASE WHEN v.rate > {rules.BLOCK_RATE} THEN false WHEN v.rate < {rules.TRUST_RATE} THEN true
    ELSE NOT more_failed END AS kept
FROM ruled r LEFT JOIN verdicts v ON v.source = r.source
"""


@work.query("op7_host_rules", _SQL)
def op7_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return judged.drop("failed", "host_rate")
