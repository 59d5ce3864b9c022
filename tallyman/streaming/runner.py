"""Draining what a stream holds now into a batch DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyman.session import scratch_path


def drain_appended(stream: DataFrame, label: str) -> DataFrame:
    """Run an append-mode stream over everything available and read back its output files."""
    spark = stream.sparkSession
    out = scratch_path(spark, label)
    (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", scratch_path(spark, f"{label}-state"))
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.schema(stream.schema).parquet(out)


def drain_updated(stream: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Run an aggregate over everything available and return its last row of each key.

    Update mode gives each micro-batch's changed rows, windows that are still open among
    them. Every batch is a folder of its own that a repeated batch writes anew, so nothing is
    held by the driver; the newest batch of a key wins.
    """
    spark = stream.sparkSession
    out, schema = scratch_path(spark, label), stream.schema

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/drained={number}")

    (
        stream.writeStream.outputMode("update")
        .foreachBatch(keep)
        .option("checkpointLocation", scratch_path(spark, f"{label}-state"))
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    # An empty folder stands for a stream that had nothing, and keeps the path readable.
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{out}/drained=-1")
    rows = spark.read.schema(T.StructType(schema.fields + [T.StructField("drained", T.LongType())])).parquet(out)
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*schema.names), "drained").alias("row"))
    return last.select("row.*")
