"""op13: whitened coordinates of all embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyman.llm.whitening import whiten
from tallyman.workload.registry import Workload

work = Workload()


@work.query("op13_embedding_whitening")
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
