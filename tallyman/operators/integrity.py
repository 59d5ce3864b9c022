"""Checks of files, trees and tables against what was pinned."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How much of a dump's end is looked at, and the line that must be there.
DUMP_TAIL_BYTES = 200
DUMP_TRAILER = "-- Dump completed"


def verify_pins(expected: DataFrame, actual: DataFrame, key: str = "path") -> DataFrame:
    """``(key, expected, actual, status)``: verified, mismatch or missing.

    Files that were not declared are ignored.
    """
    have = actual.select(key, F.col("sha256").alias("actual"), F.lit(True).alias("present"))
    return (
        expected.select(key, F.col("sha256").alias("expected"))
        .join(have, key, "left")
        .select(
            key,
            "expected",
            "actual",
            F.when(F.col("present").isNull(), "missing")
            .when(F.col("expected").eqNullSafe(F.col("actual")), "verified")
            .otherwise("mismatch")
            .alias("status"),
        )
    )


def tree_diff(expected: DataFrame, actual: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """``(path, expected, actual, status)``: identical, changed, only_expected, only_actual.

    ``exclude`` names exact paths and is applied to both sides alike.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        kept = df.filter(~F.col("path").isin(*exclude)) if exclude else df
        return kept.select("path", F.col("sha256").alias(name), F.lit(True).alias(f"in_{name}"))

    return (
        side(expected, "expected")
        .join(side(actual, "actual"), "path", "full")
        .select(
            "path",
            "expected",
            "actual",
            F.when(F.col("in_actual").isNull(), "only_expected")
            .when(F.col("in_expected").isNull(), "only_actual")
            .when(F.col("expected").eqNullSafe(F.col("actual")), "identical")
            .otherwise("changed")
            .alias("status"),
        )
    )


def measure(df: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """Several aggregates of one table in one pass, as rows ``(label, actual)``."""
    labels = list(measures)
    wide = df.agg(*[m.cast("long").alias(f"m{i}") for i, m in enumerate(measures.values())])
    pairs = F.array(*[
        F.struct(F.lit(label).alias("label"), F.col(f"m{i}").alias("actual"))
        for i, label in enumerate(labels)
    ])
    return wide.select(F.inline(pairs))


def check_counts(pins: DataFrame, measured: DataFrame) -> DataFrame:
    """Every pin ``(label, expected)`` against its measurement: ok, mismatch or unmeasured."""
    have = measured.withColumn("present", F.lit(True))
    return pins.join(have, "label", "left").select(
        "label",
        "expected",
        "actual",
        F.when(F.col("present").isNull(), "unmeasured")
        .when(F.col("expected").eqNullSafe(F.col("actual")), "ok")
        .otherwise("mismatch")
        .alias("status"),
    )


def check_floors(values: DataFrame, floors: DataFrame) -> DataFrame:
    """Floors ``(label, floor)`` against ``(label, actual)``: ok, below_floor or missing."""
    return floors.join(values, "label", "left").select(
        "label",
        "floor",
        "actual",
        F.when(F.col("actual").isNull(), "missing")
        .when(F.col("actual") >= F.col("floor"), "ok")
        .otherwise("below_floor")
        .alias("status"),
    )


def at_least(df: DataFrame, n: int) -> DataFrame:
    """``(counted, enough)``: rows counted up to ``n + 1``; ``enough`` when over ``n``.

    No column is read (Parquet answers from its footers), and each task hands on one count.
    """
    counted = df.agg(F.least(F.count(F.lit(1)), F.lit(n + 1).cast("long")).alias("counted"))
    return counted.select("counted", (F.col("counted") > n).alias("enough"))


def dump_complete(lines: DataFrame) -> DataFrame:
    """``(file, complete)`` from ``(file, line_no, line)``.

    Complete when a line starting with the trailer stands in the file's last 200 bytes; a
    line cut by that boundary counts from the boundary on. Only the last lines of a file
    can reach into them, and the rank filter is applied before the shuffle, so a huge dump
    sends a few rows per task.
    """
    latest = Window.partitionBy("file").orderBy(F.desc("line_no"))
    tail = (
        lines.select("file", "line_no", F.encode("line", "utf-8").alias("raw"))
        .withColumn("nth", F.row_number().over(latest))
        .filter(F.col("nth") <= DUMP_TAIL_BYTES)
        .withColumn(
            "reach",
            F.sum(F.octet_length("raw") + F.lit(1)).over(
                latest.rowsBetween(Window.unboundedPreceding, Window.currentRow)
            ),
        )
    )
    cut = F.greatest(F.col("reach") - F.lit(DUMP_TAIL_BYTES), F.lit(0)).cast("int")
    seen = F.substring("raw", cut + F.lit(1), F.lit(len(DUMP_TRAILER)))
    hit = (cut <= F.octet_length("raw")) & (seen == F.encode(F.lit(DUMP_TRAILER), "utf-8"))
    return tail.groupBy("file").agg(F.bool_or(hit).alias("complete"))


def required_files(
    entries: DataFrame, dirs: DataFrame, names: Sequence[str], sized: str, min_size: int
) -> DataFrame:
    """Required files that are absent, or too small: ``(root, dir, name, size, status)``.

    Every directory in ``dirs (root, dir)`` needs every name; the one called ``sized`` must
    also exceed ``min_size``. Only entries bearing a required name take part in the join.
    """
    wanted = dirs.select("root", "dir", F.explode(F.array(*[F.lit(n) for n in names])).alias("name"))
    name = F.substring_index("path", "/", -1)
    have = (
        entries.filter((F.col("kind") == "file") & name.isin(*names))
        .select("root", F.col("path").alias("full"), "size")
    )
    full = F.when(F.col("dir") == "", F.col("name")).otherwise(F.concat_ws("/", "dir", "name"))
    small = (F.col("name") == sized) & (F.col("size") <= min_size)
    return (
        wanted.withColumn("full", full)
        .join(have, ["root", "full"], "left")
        .filter(F.col("size").isNull() | small)
        .select(
            "root",
            "dir",
            "name",
            "size",
            F.when(F.col("size").isNull(), "missing").otherwise("too_small").alias("status"),
        )
    )


def ownership_audit(
    entries: DataFrame, uid: int, gid: int, first: int | None = None
) -> DataFrame:
    """Entries not owned by ``uid:gid``; with ``first``, that many in path order."""
    odd = entries.filter(
        ~F.col("uid").eqNullSafe(F.lit(uid)) | ~F.col("gid").eqNullSafe(F.lit(gid))
    ).select("root", "path", "uid", "gid")
    return odd if first is None else odd.orderBy("root", "path").limit(first)
