"""Packing a tree or an archive into buckets, and proving the result.

Nothing is written here. ``Packing.problems`` must be empty before ``write_buckets`` is
called: one refused entry means no bucket is written at all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyman.operators.audit import audit_assignment, entry_violations
from tallyman.operators.ordered import CHUNK_ROWS
from tallyman.operators.packing import (
    bucket_report,
    pack_first_fit,
    pack_next_fit,
    pad_unused,
)
from tallyman.operators.rollup import expand_pieces, frontier, with_ancestors
from tallyman.operators.select import clear_world_writable, strip_paths
from tallyman.session import stage


@dataclass(frozen=True)
class Packing:
    """``assigned`` pieces or entries, ``members`` of each bucket with ancestors and padding,
    a ``report`` per bucket, and ``problems (root, path, category)``, empty when all is well."""

    assigned: DataFrame
    members: DataFrame
    report: DataFrame
    problems: DataFrame


def _refused(assigned: DataFrame) -> DataFrame:
    return assigned.filter(F.col("status") != "ok").select(
        "root", "path", F.col("status").alias("category")
    )


def _padded(members: DataFrame, assigned: DataFrame, entries: DataFrame, max_buckets: int):
    """Members with the padding of unused buckets, and the roots that cannot be padded."""
    padding = pad_unused(assigned, entries, max_buckets)
    extra = padding.filter(F.col("status") == "padding").select(
        "root", "bucket", "path", F.lit("dir").alias("kind")
    )
    bare = padding.filter(F.col("status") == "unpaddable").select(
        "root",
        F.concat(F.lit("needs max_buckets="), F.col("needed").cast("string")).alias("path"),
        F.col("status").alias("category"),
    )
    return members.unionByName(extra), bare


def pack_tree(
    entries: DataFrame, limit: int, max_buckets: int, chunk_rows: int = CHUNK_ROWS
) -> Packing:
    """A tree ``(root, path, kind, size)`` into at most ``max_buckets`` of ``limit`` bytes."""
    pieces = frontier(entries, limit)
    assigned = stage(pack_first_fit(pieces, limit, max_buckets, chunk_rows), "assigned")
    members = stage(with_ancestors(expand_pieces(assigned, entries)), "members")
    full, bare = _padded(members, assigned, entries, max_buckets)
    audit = audit_assignment(entries, full).select("root", "path", "category")
    return Packing(
        assigned=assigned,
        members=full,
        report=bucket_report(assigned, max_buckets),
        problems=_refused(assigned).unionByName(bare).unionByName(audit),
    )


def pack_archive(
    entries: DataFrame,
    strip: str,
    limit: int,
    max_buckets: int,
    chunk_rows: int = CHUNK_ROWS,
    min_entries: int = 0,
) -> Packing:
    """Archive entries in order, stripped and corrected, into forward-only buckets.

    ``entries (root, seq, path, kind, size, mode, link_target, ...)``. World-writable modes
    are cleared; every other violation of the archive profile is a problem, and so are an
    archive without entries (``empty_archive``), a root with fewer than ``min_entries``
    (``below_floor``), and what the audit of the assignment finds. Members keep their header:
    every further column of the entries, with the corrected mode. Directories that come along
    have the header of their last own entry, or none.
    """
    kept = stage(clear_world_writable(strip_paths(entries, strip)), "kept-entries")
    header = [c for c in kept.columns if c not in ("root", "seq", "path", "kind")]
    assigned = stage(pack_next_fit(kept, limit, max_buckets, chunk_rows), "assigned")
    placed = assigned.filter(F.col("bucket").isNotNull())
    members = stage(with_ancestors(placed.select("root", "bucket", "path", "kind")), "members")
    full, bare = _padded(members, assigned, kept, max_buckets)
    violations = entry_violations(kept, "archive").select(
        "root", F.col("detail").alias("path"), "category"
    )
    counts = kept.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    few = counts.filter(F.col("n") < min_entries).select(
        "root",
        F.concat("n", F.lit(f" of {min_entries} entries")).alias("path"),
        F.lit("below_floor").alias("category"),
    )
    nothing = kept.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(
        F.lit(None).cast("string").alias("root"),
        F.lit(None).cast("string").alias("path"),
        F.lit("empty_archive").alias("category"),
    )
    audit = audit_assignment(kept, full).select("root", "path", "category")
    return Packing(
        assigned=assigned,
        members=_with_headers(full, placed, kept, header),
        report=bucket_report(assigned, max_buckets),
        problems=_refused(assigned)
        .unionByName(bare)
        .unionByName(violations)
        .unionByName(few)
        .unionByName(nothing)
        .unionByName(audit),
    )


def _with_headers(full: DataFrame, placed: DataFrame, kept: DataFrame, header: list[str]) -> DataFrame:
    """Members with the columns ``header`` of their entries."""
    leaves = (
        placed.filter(F.col("kind") != "dir")
        .select("root", "seq", "bucket", "path", "kind")
        .join(kept.select("root", "seq", *header), ["root", "seq"])
    )
    own = (
        kept.filter(F.col("kind") == "dir")
        .groupBy("root", "path")
        .agg(F.max_by(F.struct(*header), "seq").alias("header"))
        .select("root", "path", "header.*")
    )
    dirs = full.filter(F.col("kind") == "dir").join(own, ["root", "path"], "left")
    names = ["root", "bucket", "path", "kind", *header]
    return leaves.select(*names).unionByName(dirs.select(*names))
