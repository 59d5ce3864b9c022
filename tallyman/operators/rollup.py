"""Subtree sizes and the frontier of pieces that fit a limit.

Entries are rows ``(root, path, kind, size, ...)``; ``path`` is relative to the root and
every directory has a row of its own (:func:`with_directories` adds missing ones).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyman.functions import basename, entry_cost, parent, prefixes
from tallyman.session import stage


def with_directories(entries: DataFrame) -> DataFrame:
    """``entries`` plus a ``dir`` row, size 0, for every directory only their paths imply."""
    rows = entries.select("root", "path", "kind", F.col("size").cast("long"))
    stated = rows.filter(F.col("kind") == "dir").select("root", "path")
    implied = (
        rows.select("root", parent("path").alias("path"))
        .filter(F.col("path") != "")
        .distinct()
        .select("root", F.explode(prefixes("path")).alias("path"))
        .distinct()
        .join(stated, ["root", "path"], "left_anti")
    )
    return rows.unionByName(
        implied.select(
            "root", "path", F.lit("dir").alias("kind"), F.lit(0).cast("long").alias("size")
        )
    )


def member_name(root: Column, path: Column) -> Column:
    """The name a tree entry is packed under: the root's last component and the path."""
    top = basename(F.rtrim(root, F.lit("/")))
    return F.when(path == "", top).otherwise(F.concat_ws("/", top, path))


def tree_cost(entries: DataFrame) -> DataFrame:
    """Entries with ``cost``, the bytes each occupies on its own."""
    return entries.withColumn(
        "cost",
        entry_cost(F.col("size"), F.col("kind"), member_name(F.col("root"), F.col("path"))),
    )


def directory_sizes(entries: DataFrame) -> DataFrame:
    """``(root, path, kind, bytes, nodes)`` per directory, everything beneath it included.

    The root itself is the row with path ``''``, whether or not the entries state it. File
    costs are first summed per holding
    directory, so what is exploded to its ancestors is one row per directory rather than one
    per entry. Partial aggregation collapses the shared top levels before the shuffle, so a
    root holding everything is not a hot key.
    """
    costed = tree_cost(entries.filter(F.col("path") != ""))
    holder = F.when(F.col("kind") == "dir", F.col("path")).otherwise(parent("path"))
    held = costed.groupBy("root", holder.alias("dir")).agg(
        F.sum("cost").alias("cost"), F.count(F.lit(1)).alias("nodes")
    )
    above = F.concat(
        F.array(F.lit("")),
        F.when(F.col("dir") == "", F.array().cast("array<string>")).otherwise(prefixes("dir")),
    )
    own_cost = entry_cost(F.lit(0), F.lit("dir"), member_name(F.col("root"), F.col("path")))
    is_root = F.col("path") == ""
    return (
        held.select("root", F.explode(above).alias("path"), "cost", "nodes")
        .groupBy("root", "path")
        .agg(F.sum("cost").alias("bytes"), F.sum("nodes").alias("nodes"))
        .select(
            "root",
            "path",
            F.lit("dir").alias("kind"),
            (F.col("bytes") + F.when(is_root, own_cost).otherwise(0)).alias("bytes"),
            (F.col("nodes") + F.when(is_root, 1).otherwise(0)).alias("nodes"),
        )
    )


def leaf_sizes(entries: DataFrame) -> DataFrame:
    """The same columns for everything that is no directory; nothing is shuffled."""
    return (
        tree_cost(entries.filter(F.col("kind") != "dir"))
        .select("root", "path", "kind", F.col("cost").alias("bytes"))
        .withColumn("nodes", F.lit(1).cast("long"))
    )


def subtree_sizes(entries: DataFrame) -> DataFrame:
    """Directory and leaf sizes together: every node of the tree."""
    return directory_sizes(entries).unionByName(leaf_sizes(entries))


def frontier(entries: DataFrame, limit: int) -> DataFrame:
    """The largest pieces that fit ``limit``: ``(root, path, kind, bytes, status)``.

    The root is always opened, and so is every directory over the limit. A node whose
    holder is opened is a piece unless it is a directory that is opened itself. Status is
    ``ok``, ``oversize_file`` (cannot be divided) or ``empty_dir`` (opened, nothing inside).

    Directory sizes are computed once and staged. Opened directories are few, at most the
    total over the limit per level, and staged too, so the semi join knows their size: when
    they are small the leaves stay where they were read.
    """
    over = F.col("bytes") > F.lit(limit)
    dirs = stage(directory_sizes(entries), "directories")
    is_open = over | (F.col("path") == "")
    opened = stage(dirs.filter(is_open), "opened")
    candidates = dirs.filter(~is_open).unionByName(leaf_sizes(entries))
    pieces = (
        candidates.withColumn("holder", parent("path"))
        .join(
            opened.select("root", F.col("path").alias("holder")), ["root", "holder"], "left_semi"
        )
        .select(
            "root",
            "path",
            "kind",
            "bytes",
            F.when(over, "oversize_file").otherwise("ok").alias("status"),
        )
    )
    bare = opened.filter(F.col("nodes") == 1).select(
        "root", "path", "kind", "bytes", F.lit("empty_dir").alias("status")
    )
    return pieces.unionByName(bare)


def expand_pieces(assigned: DataFrame, entries: DataFrame) -> DataFrame:
    """Every entry in the bucket of the piece it belongs to: ``(root, bucket, path, kind)``.

    ``assigned`` are rows ``(root, path, bucket)``. A directory finds its piece through its
    own prefixes; any other entry through the directory holding it, or is a piece itself.
    """
    placed = assigned.filter(F.col("bucket").isNotNull()).select(
        "root", F.col("path").alias("piece"), "bucket"
    )
    dirs = entries.filter(F.col("kind") == "dir").select("root", "path", "kind")
    homes = stage(
        dirs.select("root", "path", F.explode(prefixes("path")).alias("piece"))
        .join(placed, ["root", "piece"])
        .select("root", "path", "bucket"),
        "homes",
    )
    leaves = entries.filter(F.col("kind") != "dir").select("root", "path", "kind")
    within = (
        leaves.withColumn("holder", parent("path"))
        .join(homes.withColumnRenamed("path", "holder"), ["root", "holder"])
        .select("root", "bucket", "path", "kind")
    )
    alone = leaves.join(
        placed.withColumnRenamed("piece", "path"), ["root", "path"]
    ).select("root", "bucket", "path", "kind")
    return (
        homes.select("root", "bucket", "path", F.lit("dir").alias("kind"))
        .unionByName(within)
        .unionByName(alone)
    )


def with_ancestors(members: DataFrame) -> DataFrame:
    """Members plus, in each bucket, every directory above a member; no repeats.

    Parents are made distinct before they are expanded, so a full directory contributes one
    row per bucket and not one per file.
    """
    above = (
        members.select("root", "bucket", parent("path").alias("path"))
        .filter(F.col("path") != "")
        .distinct()
        .select("root", "bucket", F.explode(prefixes("path")).alias("path"))
        .withColumn("kind", F.lit("dir"))
    )
    dirs = members.filter(F.col("kind") == "dir").unionByName(above).distinct()
    return members.filter(F.col("kind") != "dir").unionByName(dirs)

