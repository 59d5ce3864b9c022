"""Comparing two versions of rankings, pages, tables and file sets."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyman.operators.ordered import with_row_number
from tallyman.session import stage


def compare_rankings(left: DataFrame, right: DataFrame, digits: int = 6) -> DataFrame:
    """``(query, status, moved, differing)``: identical, permuted or different.

    Both sides are ``(query, position, id, score)``. ``permuted`` means every document kept
    its score and documents only changed places with equal scores. That holds exactly when
    position by position the (rounded) scores agree and document by document they do, so
    two equi joins decide it and no tie group is gathered. ``moved`` counts positions
    showing another document; ``differing`` counts disagreements that are not such moves.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(
            "query", "position", F.struct("id", F.round("score", digits).alias("s")).alias(name)
        )

    a, b = side(left, "a"), side(right, "b")
    by_place = a.join(b, ["query", "position"], "full").select(
        "query",
        (~F.col("a.id").eqNullSafe(F.col("b.id"))).cast("long").alias("moved"),
        (~F.col("a.s").eqNullSafe(F.col("b.s"))).cast("long").alias("differing"),
    )
    c = a.select("query", F.col("a.id").alias("id"), F.col("a.s").alias("x"), F.lit(1).alias("in_a"))
    d = b.select("query", F.col("b.id").alias("id"), F.col("b.s").alias("y"), F.lit(1).alias("in_b"))
    by_doc = c.join(d, ["query", "id"], "full").select(
        "query",
        F.lit(0).cast("long").alias("moved"),
        (
            F.col("in_a").isNull()
            | F.col("in_b").isNull()
            | ~F.col("x").eqNullSafe(F.col("y"))
        ).cast("long").alias("differing"),
    )
    return (
        by_place.unionByName(by_doc)
        .groupBy("query")
        .agg(F.sum("moved").alias("moved"), F.sum("differing").alias("differing"))
        .select(
            "query",
            F.when(F.col("differing") > 0, "different")
            .when(F.col("moved") > 0, "permuted")
            .otherwise("identical")
            .alias("status"),
            "moved",
            "differing",
        )
    )


def page_diff(
    left: DataFrame,
    right: DataFrame,
    normalise: Callable[[Column], Column] = lambda line: line,
    samples: int = 3,
) -> DataFrame:
    """``(page, only_left, only_right, sample)`` for pages ``(page, content)``.

    ``normalise`` is applied to both sides alike. Lines are compared as a multiset: a line
    that merely moved is no difference, which is weaker than a sequential diff. Counts are
    aggregated per page and line on both sides at once; ``sample`` holds the first differing
    lines in text order, joined by newlines, each led by ``<`` or ``>``.
    """
    def lines(df: DataFrame, sign: int) -> DataFrame:
        return df.select(
            "page",
            F.explode(F.split(normalise(F.col("content")), "\n")).alias("line"),
            F.lit(sign).alias("n"),
        )

    # Written once: the lines are exploded and shuffled for counts and samples together.
    unbalanced = stage(
        lines(left, 1)
        .unionByName(lines(right, -1))
        .groupBy("page", "line")
        .agg(F.sum("n").alias("n"))
        .filter(F.col("n") != 0),
        "unbalanced-lines",
    )
    first = Window.partitionBy("page").orderBy("line")
    shown = (
        unbalanced.withColumn("nth", F.row_number().over(first))
        .filter(F.col("nth") <= samples)
        .select(
            "page",
            "nth",
            F.concat(F.when(F.col("n") > 0, "< ").otherwise("> "), "line").alias("text"),
        )
        .groupBy("page")
        .agg(F.sort_array(F.collect_list(F.struct("nth", "text"))).alias("s"))
        .select("page", F.array_join(F.transform("s", lambda x: x["text"]), "\n").alias("sample"))
    )
    counts = unbalanced.groupBy("page").agg(
        F.sum(F.greatest("n", F.lit(0))).alias("only_left"),
        F.sum(F.greatest(-F.col("n"), F.lit(0))).alias("only_right"),
    )
    pages = left.select("page").union(right.select("page")).distinct()
    return pages.join(counts, "page", "left").join(shown, "page", "left").select(
        "page",
        F.coalesce("only_left", F.lit(0)).alias("only_left"),
        F.coalesce("only_right", F.lit(0)).alias("only_right"),
        "sample",
    )


def field_diff(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """``(field, differing)`` per non-key field, and the rows on one side only.

    The latter are the rows ``<only_left>`` and ``<only_right>``. One full outer join and
    one aggregate, whatever the number of fields. Nulls are equal to nulls.
    """
    fields = [c for c in left.columns if c not in key and c in right.columns]
    a = left.select(*key, F.struct(*fields).alias("a"))
    b = right.select(*key, F.struct(*fields).alias("b"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    wide = a.join(b, list(key), "full").agg(
        *[
            F.count_if(both & ~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}"))).alias(f"d{i}")
            for i, f in enumerate(fields)
        ],
        F.count_if(F.col("b").isNull()).alias("l"),
        F.count_if(F.col("a").isNull()).alias("r"),
    )
    pairs = [(f, f"d{i}") for i, f in enumerate(fields)]
    pairs += [("<only_left>", "l"), ("<only_right>", "r")]
    return wide.select(
        F.inline(F.array(*[
            F.struct(F.lit(name).alias("field"), F.col(c).alias("differing")) for name, c in pairs
        ]))
    )


def reset_above(current: DataFrame, baseline: DataFrame, key: str, boundary: int) -> DataFrame:
    """``current`` with every row at or above ``boundary`` replaced by the baseline's.

    Two pushed-down filters and a union; doing it again changes nothing.
    """
    return current.filter(F.col(key) < boundary).unionByName(
        baseline.filter(F.col(key) >= boundary)
    )


def best_version(observed: DataFrame, candidates: DataFrame) -> DataFrame:
    """``(version, files, matching, rank, lead)`` per candidate, best first.

    ``observed (path, sha256)``; ``candidates (version, path, sha256)``. ``lead`` is by how
    many matches a version beats the next one, null for the last.
    """
    have = observed.select("path", "sha256", F.lit(1).alias("hit"))
    per_version = (
        candidates.join(have, ["path", "sha256"], "left")
        .groupBy("version")
        .agg(F.count(F.lit(1)).alias("files"), F.count("hit").alias("matching"))
    )
    ranked = with_row_number(per_version, [F.desc("matching"), F.asc("version")], "rank")
    below = ranked.select((F.col("rank") - 1).alias("rank"), F.col("matching").alias("next"))
    return ranked.join(below, "rank", "left").select(
        "version", "files", "matching", "rank", (F.col("matching") - F.col("next")).alias("lead")
    )
