"""op9: near-duplicate classes of all embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyman.llm.vectors import near_duplicate_vectors
from tallyman.workload.registry import Workload

work = Workload()

_SQL = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) > 0
), links AS MATERIALIZED (
  SELECT x.vec_id AS a, y.vec_id AS b FROM vectors x JOIN vectors y ON x.label = y.label AND x.vec_id <> y.vec_id
  WHERE list_cosine_similarity(x.v, y.v) >= 0.98
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), counted AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT r.a AS vec_id, coalesce(max(c.n), 0) AS n_links, min(r.b) AS component_id, r.a = min(r.b) AS kept
FROM reach r LEFT JOIN counted c ON c.a = r.a GROUP BY r.a
"""


@work.query("op9_embedding_near_dups", _SQL)
def op9_embedding_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
