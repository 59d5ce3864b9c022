"""op12: benchmark passages in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyman.llm.decontamination import contamination
from tallyman.workload.registry import Workload

work = Workload()

_WORDS = (
    r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents
), items AS (
  SELECT item_id, {_WORDS} AS w FROM benchmark
), windows AS MATERIALIZED (
  SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS g FROM (
    SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM items WHERE len(w) > 0)
), lengths AS (
  SELECT DISTINCT n FROM windows
), places AS (
  SELECT r, n, s, array_to_string(w[s:s + n - 1], ' ') AS g FROM (
    SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM docs, lengths)
), hits AS MATERIALIZED (
  SELECT p.r, p.n, p.s, x.item_id FROM places p JOIN windows x ON x.g = p.g AND x.n = p.n
), words AS (
  SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS q FROM hits) GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS items_sha256
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs d LEFT JOIN words x ON x.r = d.r LEFT JOIN named y ON y.r = d.r
"""


@work.query("op12_benchmark_decontamination", _SQL)
def op12_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    )
