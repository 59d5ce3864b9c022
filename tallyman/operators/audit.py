"""Structural audits of entries and of their assignment to buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyman.functions import normalise, parent, prefixes

# The privilege bits and the permission of others.
SETUID_SETGID = 0o6000
WORLD_WRITABLE = 0o002
# The categories.
ESCAPING_PATH = "absolute or traversing path"
ESCAPING_LINK = "symlink escapes the tree"
HARD_LINK = "hard link"
ODD_KIND = "not a regular file, directory or symlink"
PRIVILEGED = "setuid/setgid"
OPEN_TO_ALL = "world-writable"
#: Examples kept per category.
EXAMPLES = 3
PROFILES = ("archive", "tree")


def _octal(mode: Column) -> Column:
    digits = F.conv(mode.cast("string"), 10, 8)
    return F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits)


def entry_problems(profile: str) -> Column:
    """``array<struct<category, detail>>`` of what is wrong with one entry."""
    if profile not in PROFILES:
        raise ValueError(f"profile must be one of {PROFILES}")
    path, kind, mode, link = F.col("path"), F.col("kind"), F.col("mode"), F.col("link_target")
    privileged = mode.bitwiseAND(F.lit(SETUID_SETGID)) != 0
    holder = parent(path)
    target = normalise(F.when(holder == "", link).otherwise(F.concat(holder, F.lit("/"), link)))
    escapes = link.startswith("/") | target.startswith("..")
    arrow = F.concat(path, F.lit(" -> "), link)
    moded = F.concat(path, F.lit(" ("), _octal(mode), F.lit(")"))

    def when(test: Column, category: str, detail: Column) -> Column:
        return F.when(
            test, F.struct(F.lit(category).alias("category"), detail.alias("detail"))
        )

    climbs = path.startswith("/") | F.array_contains(F.split(path, "/"), "..")
    known = kind.isin("file", "dir", "symlink", "hardlink")
    found = [
        when(climbs, ESCAPING_PATH, path),
        when((kind == "symlink") & escapes, ESCAPING_LINK, arrow),
        when(~known, ODD_KIND, path),
    ]
    if profile == "archive":
        found += [
            when(kind == "hardlink", HARD_LINK, arrow),
            when((kind == "file") & privileged, PRIVILEGED, moded),
        ]
    else:
        moded_kind = kind.isin("file", "dir", "hardlink")
        open_to_all = mode.bitwiseAND(F.lit(WORLD_WRITABLE)) != 0
        found += [
            when(moded_kind & privileged, PRIVILEGED, moded),
            when(moded_kind & open_to_all, OPEN_TO_ALL, moded),
        ]
    return F.array_compact(F.array(*found))


def entry_violations(entries: DataFrame, profile: str = "archive") -> DataFrame:
    """One row per violation: ``(root, seq, category, detail)``."""
    return entries.select("root", "seq", F.inline(entry_problems(profile)))


def audit_entries(entries: DataFrame, profile: str = "archive") -> DataFrame:
    """Per root and category the exact count and the first three examples by ``seq``.

    Two profiles. *archive*: setuid and setgid are refused on files only, hard links are
    refused, world-writable modes are left to ``clear_world_writable``. *tree*: privilege
    bits on directories and world-writable modes are refused too; a hard link is just a
    file. Symlink targets are resolved lexically in both, there being no disk to ask; a
    target whose normal form starts with ``..`` escapes, ``..x`` included.

    Columns ``(root, category, n, examples)``, examples joined by ``; ``. The count is
    aggregated before the shuffle and the rank limit is too, so a category that fits every
    entry moves three rows per task.
    """
    hits = entry_violations(entries, profile)
    counts = hits.groupBy("root", "category").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("root", "category").orderBy("seq")
    shown = (
        hits.withColumn("nth", F.row_number().over(order))
        .filter(F.col("nth") <= EXAMPLES)
        .groupBy("root", "category")
        .agg(F.sort_array(F.collect_list(F.struct("nth", "detail"))).alias("kept"))
        .select(
            "root",
            "category",
            F.array_join(F.transform("kept", lambda k: k["detail"]), "; ").alias("examples"),
        )
    )
    return counts.join(shown, ["root", "category"])


def audit_assignment(
    entries: DataFrame, assigned: DataFrame, ancestors_in: str = "root"
) -> DataFrame:
    """What is wrong with an assignment: ``(root, path, category, copies)``.

    ``missing`` entries are in no bucket, ``extra`` ones are not in the tree, a
    ``duplicate_file`` ships more than once (directories may repeat), and an
    ``implicit_ancestor`` is a directory above a member that is no member itself: of any
    bucket of the root, or with ``ancestors_in="bucket"`` of the same bucket.
    """
    if ancestors_in not in ("root", "bucket"):
        raise ValueError("ancestors_in must be 'root' or 'bucket'")
    both = entries.select(
        "root", "path", F.lit(1).alias("known"), F.lit(0).alias("copies"),
        (F.col("kind") == "dir").cast("int").alias("is_dir"),
    ).unionByName(
        assigned.select(
            "root", "path", F.lit(0).alias("known"), F.lit(1).alias("copies"),
            (F.col("kind") == "dir").cast("int").alias("is_dir"),
        )
    )
    seen = both.groupBy("root", "path").agg(
        F.max("known").alias("known"),
        F.sum("copies").alias("copies"),
        F.max("is_dir").alias("is_dir"),
    )
    category = (
        F.when(F.col("copies") == 0, "missing")
        .when(F.col("known") == 0, "extra")
        .when((F.col("copies") > 1) & (F.col("is_dir") == 0), "duplicate_file")
    )
    listed = seen.withColumn("category", category).filter(F.col("category").isNotNull()).select(
        "root", "path", "category", "copies"
    )
    scope = ["root", "bucket"] if ancestors_in == "bucket" else ["root"]
    holders = (
        assigned.select(*scope, parent("path").alias("path"))
        .filter(F.col("path") != "")
        .distinct()
        .select(*scope, F.explode(prefixes("path")).alias("path"))
        .distinct()
    )
    implicit = holders.join(assigned.select(*scope, "path").distinct(), [*scope, "path"], "left_anti")
    return listed.unionByName(
        implicit.groupBy("root", "path").agg(
            F.lit("implicit_ancestor").alias("category"), F.count(F.lit(1)).alias("copies")
        )
    )
