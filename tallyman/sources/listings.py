"""Text listings: checksum files and digest locks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: 64 lowercase hex digits, two spaces, the rest of the line.
CHECKSUM_LINE = r"^([0-9a-f]{64})  (.+)$"


def _text(spark: SparkSession, path: str) -> DataFrame:
    """Lines with ``at``, which orders them as they stand in the files."""
    return spark.read.text(path).select(
        F.col("value").alias("line"),
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("at"),
    )


def parse_checksums(lines: DataFrame, line: str = "line") -> DataFrame:
    """``(sha256, path, status, line)``; lines of another shape are kept as ``malformed``."""
    digest = F.regexp_extract(line, CHECKSUM_LINE, 1)
    good = digest != ""
    return lines.select(
        F.when(good, digest).alias("sha256"),
        F.when(good, F.regexp_extract(line, CHECKSUM_LINE, 2)).alias("path"),
        F.when(good, "ok").otherwise("malformed").alias("status"),
        F.col(line).alias("line"),
    )


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    return parse_checksums(spark.read.text(path).withColumnRenamed("value", "line"))


def parse_lock(lines: DataFrame, line: Column, at: Column) -> DataFrame:
    """``(ref, digest)`` from lock lines; of several lines for one ref the first counts.

    ``#`` starts a comment. A ref without a second word is pinned without a digest (null),
    which is not the same as being absent.
    """
    fields = F.filter(
        F.split(F.substring_index(line, "#", 1), r"\s+"), lambda word: word != ""
    )
    return (
        lines.select(fields.alias("f"), at.alias("at"))
        .filter(F.size("f") > 0)
        .select(
            F.element_at("f", 1).alias("ref"), F.try_element_at("f", F.lit(2)).alias("digest"), "at"
        )
        .groupBy("ref")
        .agg(F.min_by(F.struct("digest"), "at").alias("first"))
        .select("ref", "first.digest")
    )


def read_lock(spark: SparkSession, path: str) -> DataFrame:
    lines = _text(spark, path)
    return parse_lock(lines, F.col("line"), F.col("at"))
