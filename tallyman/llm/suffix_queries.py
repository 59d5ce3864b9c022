"""op8: repeated passages of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyman.llm.suffixes import MIN_WORDS, repeated_passages
from tallyman.workload.registry import Workload

work = Workload()

_SQL = rf"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL
), passages AS (
  SELECT doc_id, s - 1 AS start, md5(array_to_string(w[s:s + {MIN_WORDS - 1}], ' ')) AS p
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {MIN_WORDS - 2})) AS s FROM words WHERE len(w) >= {MIN_WORDS})
), marked AS (
  SELECT doc_id, start, p, start - min(start) OVER (PARTITION BY doc_id, p) >= {MIN_WORDS} AS again FROM passages
), places AS (
  SELECT p, min(doc_id) AS origin FROM marked GROUP BY p HAVING min(doc_id) < max(doc_id) OR bool_or(again)
), hits AS (
  SELECT doc_id, start, origin, doc_id > origin OR again AS later FROM marked JOIN places USING (p)
), runs AS (
  SELECT doc_id, min(start) AS start, max(start) + {MIN_WORDS} AS stop, arg_min(origin, start) AS origin FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY start) AS island FROM (
      SELECT *, CASE WHEN start - lag(start) OVER (PARTITION BY doc_id ORDER BY start) <= {MIN_WORDS} THEN 0 ELSE 1 END AS fresh
      FROM hits))
  GROUP BY doc_id, island
), cuts AS (
  SELECT doc_id, min(start) AS a, max(start) + {MIN_WORDS} AS b FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY start) AS island FROM (
      SELECT *, CASE WHEN start - lag(start) OVER (PARTITION BY doc_id ORDER BY start) <= {MIN_WORDS} THEN 0 ELSE 1 END AS fresh
      FROM hits WHERE later))
  GROUP BY doc_id, island
)
SELECT r.doc_id, r.start, r.stop, r.origin, CAST(coalesce(sum(c.b - c.a), 0) AS BIGINT) AS n_cut
FROM runs r LEFT JOIN cuts c ON r.doc_id = c.doc_id AND r.start <= c.a AND c.b <= r.stop
GROUP BY ALL
"""


@work.query("op8_repeated_passages", _SQL)
def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n_cut = F.aggregate(
        F.zip_with("cut_to", "cut_from", lambda b, a: b - a), F.lit(0).cast("long"), lambda x, y: x + y
    )
    return runs.select("doc_id", "start", "stop", "origin", n_cut.alias("n_cut"))
