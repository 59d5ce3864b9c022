"""op10: a quality score for every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyman.llm.quality import THRESHOLD, fold_of, score_quality
from tallyman.workload.registry import Workload

work = Workload()


@work.query("op10_quality_classifier")
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_quality(docs, labels).select(F.col("row.doc_id").alias("doc_id"), "score")
    return scored.select(
        "doc_id",
        F.coalesce(fold_of("doc_id") == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
