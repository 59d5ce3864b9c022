"""op2: all documents in 24 shards of nearly equal bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyman.llm.sharding import shard_documents
from tallyman.workload.registry import Workload

work = Workload()


@work.query("op2_minimax_sharding")
def op2_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), shards=24)
