"""Selection, ordering and rewriting of entries, datasets and text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyman.functions import origin_rebased, strip_prefix, without_definers
from tallyman.operators.ordered import with_row_number

# Fixed value: the write permission of others.
WORLD_WRITABLE = 0o002


def lazy_split(datasets: DataFrame, prepare_inputs: bool) -> DataFrame:
    """The datasets only a prepare step reads, or exactly all the others."""
    lazy = F.coalesce("prepare_input", F.lit(False))
    return datasets.filter(lazy if prepare_inputs else ~lazy)


def order_by_cost(images: DataFrame) -> DataFrame:
    """``rank`` by cost: unmeasured first, then dearest, then by benchmark and service.

    The rank is numbered over a distributed sort, not in a single-partition window.
    """
    order = [F.desc_nulls_first("build_minutes"), F.asc("benchmark"), F.asc("service")]
    return with_row_number(images, order, "rank")


def strip_paths(entries: DataFrame, strip: str) -> DataFrame:
    """Entries with ``strip``'s depth removed from their paths; the stripped root goes."""
    return entries.withColumn("path", strip_prefix("path", strip)).filter(F.col("path") != "")


def clear_world_writable(entries: DataFrame) -> DataFrame:
    """Files and directories lose the world-writable bit; ``mode_before`` keeps the old mode.

    A symlink's mode means nothing and is left alone.
    """
    fix = F.col("kind").isin("file", "dir") & (
        F.col("mode").bitwiseAND(F.lit(WORLD_WRITABLE)) != 0
    )
    return (
        entries.withColumn("mode_before", F.col("mode"))
        .withColumn("corrected", fix)
        .withColumn(
            "mode",
            F.when(fix, F.col("mode").bitwiseAND(F.lit(~WORLD_WRITABLE))).otherwise(F.col("mode")),
        )
    )


def rebase_links(df: DataFrame, column: str, origin: str, target: str) -> DataFrame:
    """``column`` with ``origin`` rewritten to ``target``; ``changed`` marks touched rows."""
    rewritten = origin_rebased(F.col(column), origin, target)
    return df.withColumn("changed", ~rewritten.eqNullSafe(F.col(column))).withColumn(
        column, rewritten
    )


def strip_definers(df: DataFrame, column: str = "line") -> DataFrame:
    """``column`` without definer clauses."""
    return df.withColumn(column, without_definers(F.col(column)))
