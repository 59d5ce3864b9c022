"""JSON feeds: product corpora and resource readings.

What is no valid JSON of the wanted shape becomes a row of its own with ``status``
``unparsable`` and the text in ``raw``; all other rows are ``ok`` and have no ``raw``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The fields of one resource reading; all but the first two may be null.
READING_SCHEMA = """
metric string, phase string, mem_available_mb bigint, mem_total_mb bigint,
swap_used_mb bigint, disk_free_gb bigint, disk_total_gb bigint, run string, at timestamp
"""


def read_product_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of top-level JSON arrays, one row each.

    An array cannot be split, so a file is one task: ship a corpus as many files.
    """
    fields = T.StructType.fromDDL(schema)
    files = spark.read.text(path, wholetext=True).filter(F.trim("value") != "")
    parsed = files.select("value", F.from_json("value", T.ArrayType(fields)).alias("items"))
    return parsed.select(
        F.explode(F.coalesce("items", F.array(F.lit(None).cast(fields)))).alias("item"),
        F.when(F.col("items").isNull(), F.col("value")).alias("raw"),
    ).select("item.*", _status(), "raw")


def read_readings(spark: SparkSession, path: str) -> DataFrame:
    """Resource readings, one JSON object per line."""
    return _parsed(spark.read.text(path))


def stream_readings(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """The same readings as a stream over a growing folder."""
    return _parsed(spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path))


def _parsed(lines: DataFrame) -> DataFrame:
    schema = T.StructType.fromDDL(READING_SCHEMA).add("_broken", T.StringType())
    item = F.from_json("value", schema, {"columnNameOfCorruptRecord": "_broken"})
    rows = lines.filter(F.trim("value") != "").select(item.alias("item")).select("item.*")
    return rows.withColumnRenamed("_broken", "raw").withColumn("status", _status())


def _status():
    return F.when(F.col("raw").isNull(), "ok").otherwise("unparsable").alias("status")
