"""Cutting and assembly: the documented layout, random folds, and broken parts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tallyman.operators import ranges

RANGE = "archive string, name string, start long, end long"


def cut(total, part, protected):
    pos, out = 0, [0]
    while total - pos > part:
        at = pos + part
        inside = [r for r in protected if r[0] < at < r[1]]
        if inside:
            at = inside[0][0] if inside[0][0] > pos else inside[0][1]
        out.append(at)
        pos = at
    return out


def test_documented_layout(spark):
    """Two large indexes of one 95 GB archive, cut at 9 GiB."""
    total, part = 95_199_730_590, 9 * 2**30
    archives = spark.createDataFrame([("w", total)], "archive string, total long")
    protected = spark.createDataFrame(
        [("w", "title", 74_440_368_308, 77_599_056_052), ("w", "text", 77_599_387_200, 93_605_531_200)],
        RANGE,
    )
    parts = ranges.cut_ranges(archives, protected, part)
    got = [(r.part, round((r.end - r.start) / 2**30, 2)) for r in parts.orderBy("part").collect()]
    assert got == [*[(i, 9.0) for i in range(7)], (7, 6.33), (8, 2.94), (9, 14.91), (10, 1.48)]
    found = {r.name: (r.home, r.spans) for r in ranges.containment(parts, protected).collect()}
    assert found == {"title": (8, 1), "text": (9, 1)}
    over = ranges.sub_chunks(parts, 10 * 2**30, 8 * 2**30).filter("chunk IS NOT NULL")
    named = ranges.part_names(over, F.lit("w.zim"))
    assert [(r.name, round(r.bytes / 2**30, 2)) for r in named.orderBy("chunk").collect()] == [
        ("w.zimaj.part00", 7.45), ("w.zimaj.part01", 7.45),
    ]
    assert ranges.part_coverage(parts, archives).first().status == "exact"


@pytest.mark.parametrize("chunk_rows", [2, 8, 1 << 18])
def test_cuts_match_the_plain_walk(spark, chunk_rows):
    rng = random.Random(11)
    archives, rows, want = [], [], {}
    for name, n in [("dense", 150), ("sparse", 20), ("bare", 0)]:
        pos, mine = 0, []
        for i in range(n):
            pos += rng.choice([0, 0, 5, 90]) if name == "dense" else rng.randint(50, 900)
            size = rng.choice([1, 10, 60, 350])
            mine.append((pos, pos + size))
            pos += size
        total = pos + rng.randint(1, 500)
        archives.append((name, total))
        rows += [(name, f"{name}{i}", *r) for i, r in enumerate(mine)]
        edges = [*cut(total, 100, mine), total]
        want |= {(name, i): (a, b) for i, (a, b) in enumerate(zip(edges, edges[1:]))}
    parts = ranges.cut_ranges(
        spark.createDataFrame(archives, "archive string, total long"),
        spark.createDataFrame(rows, RANGE),
        100,
        chunk_rows,
    )
    assert {(r.archive, r.part): (r.start, r.end) for r in parts.collect()} == want


@pytest.mark.parametrize("chunk_rows", [4, 1 << 18])
def test_containment_finds_every_overlap(spark, chunk_rows):
    rng = random.Random(4)
    edges = sorted({0, 1000, *[rng.randint(1, 999) for _ in range(12)]})
    parts = list(zip(edges, edges[1:]))
    held = [(a, a + rng.choice([1, 20, 300])) for a in rng.sample(range(700), 40)]
    got = ranges.containment(
        spark.createDataFrame([("x", i, a, b) for i, (a, b) in enumerate(parts)],
                              "archive string, part int, start long, end long"),
        spark.createDataFrame([("x", f"r{i}", a, b) for i, (a, b) in enumerate(held)], RANGE),
        chunk_rows,
    )
    want = {}
    for i, (a, b) in enumerate(held):
        touched = [p for p, (s, e) in enumerate(parts) if s < b and a < e]
        home = touched[0] if len(touched) == 1 else None
        want[f"r{i}"] = (home, len(touched), touched[0], touched[-1])
    assert {r.name: (r.home, r.spans, r.first_part, r.last_part) for r in got.collect()} == want


def test_a_range_over_very_many_parts_is_one_row(spark):
    n = 300_000
    parts = spark.range(n).select(
        F.lit("x").alias("archive"), F.col("id").cast("int").alias("part"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 10).alias("end")
    )
    held = spark.createDataFrame([("x", "all", 0, 10 * n), ("x", "most", 15, 10 * n - 15), ("x", "one", 41, 49)], RANGE)
    got = ranges.containment(parts, held)
    found = {r.name: (r.home, r.spans, r.first_part, r.last_part) for r in got.collect()}
    assert found == {"all": (None, n, 0, n - 1), "most": (None, n - 2, 1, n - 2), "one": (4, 1, 4, 4)}
    assert "Generate" not in got._jdf.queryExecution().toString()


def test_containment_reports_ranges_in_gaps(spark, rows):
    parts = spark.createDataFrame([("x", 0, 0, 10), ("x", 1, 20, 30)], "archive string, part int, start long, end long")
    held = [("x", "in", 2, 5), ("x", "gap", 12, 15), ("x", "edge", 20, 20), ("x", "empty gap", 15, 15), ("y", "other", 0, 1)]
    got = ranges.containment(parts, spark.createDataFrame(held, RANGE))
    assert rows(got, "name", "home", "spans") == sorted(
        [("in", 0, 1), ("gap", None, 0), ("edge", 1, 1), ("empty gap", None, 0), ("other", None, 0)], key=repr
    )


def test_sub_chunks_are_near_equal(spark, rows):
    parts = spark.createDataFrame([("x", 0, 0, 10), ("x", 1, 10, 33)],
                                  "archive string, part int, start long, end long")
    assert rows(ranges.sub_chunks(parts, 10, 10)) == sorted([
        ("x", 0, None, 0, 10), ("x", 1, 0, 10, 8), ("x", 1, 1, 18, 8), ("x", 1, 2, 26, 7),
    ], key=repr)
    with pytest.raises(ValueError):
        ranges.sub_chunks(parts, 5, 6)


def test_fixed_chunks(spark, rows):
    files = spark.createDataFrame([("f", 25), ("empty", 0)], "name string, bytes long")
    assert rows(ranges.fixed_chunks(files, 10)) == [
        ("f", 0, "f.part-00", 0, 10), ("f", 1, "f.part-01", 10, 10), ("f", 2, "f.part-02", 20, 5),
    ]


def test_whole_file_wins_over_parts(spark, rows):
    outputs = spark.createDataFrame([("a",), ("b",), ("c",), ("d.part-x",)], "output string")
    files = spark.createDataFrame(
        [("a", 7), ("a.part-00", 3), ("b.part-00", 4), ("b.part-01", 5), ("bb.part-00", 9),
         ("d.part-x.part-00", 2)],
        "name string, bytes long",
    )
    assert rows(ranges.resolve_parts(outputs, files)) == [
        ("a", 1, 7, "whole"), ("b", 2, 9, "parts"), ("c", 0, None, "missing"), ("d.part-x", 1, 2, "parts"),
    ]


@pytest.mark.parametrize(
    "files,archive,want",
    [
        ([("a.zimaa", 5), ("a.zimab", 6)], None, ("a.zim", 2, 11, "join")),
        ([("a.zimaa", 5), ("a.zimab", 6)], 11, ("a.zim", 2, 11, "already_whole")),
        ([("a.zimaa", 5), ("a.zimab", 6)], 10, ("a.zim", 2, 11, "join")),
        ([("a.zimaa", 5), ("a.zimab.part00", 2), ("a.zimab.part01", 3)], None, ("a.zim", 2, 10, "join")),
        ([("a.zimaa", 5), ("a.zimab.part01", 3)], None, ("a.zim", 1, 5, "join")),
        ([("a.zimaa", 5), ("b.zimaa", 6)], None, (None, None, None, "ambiguous")),
        ([("readme", 5)], None, (None, None, None, "nothing")),
        ([("a.zimaa.part00", 5)], None, (None, None, None, "nothing")),
    ],
)
def test_assembly_plan(spark, files, archive, want):
    parts = spark.createDataFrame([("d", n, b) for n, b in files], "dir string, name string, bytes long")
    done = spark.createDataFrame([("d", "a.zim", archive)] if archive else [],
                                 "dir string, name string, bytes long")
    row = ranges.assembly_plan(parts, done).first()
    assert (row.stem, row.parts, row.expected, row.action) == want


@pytest.mark.parametrize(
    "parts,status",
    [
        ([(0, 4), (4, 10)], "exact"),
        ([(0, 4), (5, 10)], "short"),
        ([(0, 5), (4, 10)], "long"),
        ([(0, 4), (5, 11)], "misplaced"),
        ([(0, 5), (0, 5)], "misplaced"),
        ([], "short"),
    ],
)
def test_coverage(spark, parts, status):
    df = spark.createDataFrame([("x", i, a, b) for i, (a, b) in enumerate(parts)],
                               "archive string, part int, start long, end long")
    row = ranges.part_coverage(df, spark.createDataFrame([("x", 10)], "archive string, total long")).first()
    assert row.status == status
    assert (row.breaks == 0) == (status == "exact" or not parts)
