"""Streaming audit counts, digest dedup and resource peaks.

Each function takes a streaming or a batch DataFrame and returns one of the same kind, so
that a stream drained to its end can be compared with the batch result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyman.operators.audit import entry_problems

# Fixed value: how often the resources of a run are sampled.
SAMPLE_PERIOD = "20 seconds"


def running_audit(entries: DataFrame, profile: str = "archive") -> DataFrame:
    """Violations counted so far: ``(root, category, n)``.

    The checks look at one entry each, so only the counts are state: one row per root and
    category. Each task counts before the shuffle.
    """
    return (
        entries.select("root", F.inline(entry_problems(profile)))
        .groupBy("root", "category")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def unique_digests(blobs: DataFrame, at: str | None = None, lateness: str = "1 hour") -> DataFrame:
    """The first blob of each digest.

    Without ``at`` every digest ever seen stays in the state. With it, the state is dropped
    once a digest has not been seen for ``lateness`` of event time.
    """
    if at is None:
        return blobs.dropDuplicates(["digest"])
    return blobs.withWatermark(at, lateness).dropDuplicatesWithinWatermark(["digest"])


def resource_windows(
    readings: DataFrame, lateness: str = "10 minutes", period: str = SAMPLE_PERIOD
) -> DataFrame:
    """Per run and tumbling window the first and the least free disk and memory.

    ``(run, window_start, window_end, first_disk_gb, least_disk_gb, least_mem_mb, peak_swap_mb,
    samples)``.
    """
    return (
        readings.withWatermark("at", lateness)
        .groupBy("run", F.window("at", period))
        .agg(
            F.min_by("disk_free_gb", "at").alias("first_disk_gb"),
            F.min("disk_free_gb").alias("least_disk_gb"),
            F.min("mem_available_mb").alias("least_mem_mb"),
            F.max("swap_used_mb").alias("peak_swap_mb"),
            F.count(F.lit(1)).alias("samples"),
        )
        .select(
            "run",
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "first_disk_gb",
            "least_disk_gb",
            "least_mem_mb",
            "peak_swap_mb",
            "samples",
        )
    )


def peaks_from_windows(windows: DataFrame) -> DataFrame:
    """Peak disk use per run: free at the start minus the least ever free.

    Windows are already aggregated, so this is a batch aggregate over few rows.
    """
    return windows.groupBy("run").agg(
        (F.min_by("first_disk_gb", "window_start") - F.min("least_disk_gb")).alias("peak_disk_gb"),
        F.max("peak_swap_mb").alias("peak_swap_mb"),
        F.min("least_mem_mb").alias("least_mem_mb"),
        F.sum("samples").alias("samples"),
    )
