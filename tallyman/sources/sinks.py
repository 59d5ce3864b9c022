"""Writing buckets, checksum files and quarantines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class RefusedError(ValueError):
    """A result holds rows that must not be written; the message counts them by status."""


def require_ok(df: DataFrame, status: str = "status", ok: tuple[str, ...] = ("ok",)) -> DataFrame:
    """``df`` itself, or :class:`RefusedError` naming each bad status and how often it occurs."""
    bad = df.filter(~F.col(status).isin(*ok)).groupBy(status).count().orderBy(status).collect()
    if bad:
        raise RefusedError(", ".join(f"{row[0]} x{row[1]}" for row in bad))
    return df


def write_buckets(assigned: DataFrame, path: str, mode: str = "overwrite", refused: str | None = None) -> None:
    """One folder per ``(root, bucket)``; a bucket's rows are in that folder only.

    Rows without a bucket are written to ``refused``, with their status if they have one, so that
    they can be packed again with another limit or looked into. Without such a path they are
    refused before anything is written: ``assigned`` is looked through for them first, so
    it should be staged. The rebalance hint gathers small buckets' rows into few files and lets
    AQE split a bucket with very many rows over several tasks.
    """
    unplaced = assigned.filter(F.col("bucket").isNull())
    if refused is not None:
        unplaced.write.mode(mode).parquet(refused)
        assigned = assigned.filter(F.col("bucket").isNotNull())
    elif unknown := unplaced.count():
        raise RefusedError(f"without a bucket x{unknown}")
    (
        assigned.hint("rebalance", "root", "bucket")
        .write.mode(mode)
        .partitionBy("root", "bucket")
        .parquet(path)
    )


def read_buckets(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None
) -> DataFrame:
    """Written buckets; ``root`` stays the string it was, even one that looks like a number.

    With the ``schema`` that was written, folders are listed once and nothing is inferred.
    """
    if schema is None:
        schema = spark.read.parquet(path).schema
        schema["root"].dataType = T.StringType()
    return spark.read.schema(schema).parquet(path)


def write_checksums(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``<sha256>  <path>`` lines, sorted by path across the written files."""
    df.orderBy("path").select(F.concat("sha256", F.lit("  "), "path").alias("value")).write.mode(
        mode
    ).text(path)


def quarantine(df: DataFrame, good: Column, path: str, by: str) -> None:
    """Rows with a ``verdict`` of ``verified`` or ``quarantine``, kept by ``by`` value.

    Written with dynamic overwrite: a value's new rows replace all its earlier ones, good or
    bad, so none stays verified that is bad now. Values not in ``df`` keep theirs. A null
    ``good`` is bad.
    """
    (
        df.withColumn("verdict", F.when(good, "verified").otherwise("quarantine"))
        .hint("rebalance", by)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(by)
        .parquet(path)
    )
