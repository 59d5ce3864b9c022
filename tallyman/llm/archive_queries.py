"""op6: all pages through ARC and WARC archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyman.llm.archives import MIN_REVISIT_BYTES, archive_pages
from tallyman.workload.registry import Workload

work = Workload()

_SQL = f"""
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {MIN_REVISIT_BYTES} AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {MIN_REVISIT_BYTES} AND page_id > first THEN first END AS refers_to
FROM (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
    min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
  FROM pages)
"""


@work.query("op6_arc_to_warc", _SQL)
def op6_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
