"""Packing against plain-Python folds on random trees, and one case per refusal."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyman.operators import jumps, ordered, packing, rollup
from tallyman.operators.audit import audit_assignment
from tallyman.sources import RefusedError, read_buckets, require_ok, write_buckets

ENTRY = "root string, path string, kind string, size long"


def cost(size):
    return 512 + -(-size // 512) * 512


def random_tree(seed, root="srv/data", n=120):
    rng = random.Random(seed)
    dirs, out = [""], {}
    for i in range(n):
        holder = rng.choice(dirs[-6:])
        name = rng.choice(["a", "a.txt", "b", "zz"]) + str(i)
        path = f"{holder}/{name}" if holder else name
        kind = rng.choice(["dir", "file", "file", "file", "symlink"])
        if kind == "dir":
            dirs.append(path)
        out[path] = (kind, rng.choice([0, 100, 700, 5000, 40_000]) if kind == "file" else 0)
    return [(root, p, k, s) for p, (k, s) in out.items()]


def walk(entries, limit):
    """Pieces of one root by recursive descent, in traversal order."""
    kinds = {p: k for _, p, k, _ in entries}
    sizes = {p: s for _, p, _, s in entries}
    below = {}
    for p in kinds:
        below.setdefault(p.rpartition("/")[0], []).append(p)

    top = entries[0][0].rpartition("/")[2]

    def total(p):
        named = len(f"{top}/{p}".encode())
        own = cost(named + 1) if named > 100 else 0
        if kinds[p] == "dir":
            return own + 512 + sum(total(c) for c in below.get(p, []))
        return own + (cost(sizes[p]) if kinds[p] == "file" else 512)

    def descend(p):
        for c in sorted(below.get(p, []), key=lambda x: x.split("/")):
            size = total(c)
            if size <= limit or kinds[c] != "dir":
                yield c, size
            else:
                yield from descend(c)

    return list(descend(""))


def fit(sizes, limit, most):
    used, spots = [], []
    for size in sizes:
        spot = next((i for i, u in enumerate(used) if u + size <= limit), None)
        if spot is None and len(used) < most:
            used.append(0)
            spot = len(used) - 1
        if spot is not None:
            used[spot] += size
        spots.append(spot)
    return spots


def roll(costs, rolls, limit, most):
    bucket = used = 0
    spots = []
    for c, r in zip(costs, rolls):
        if bucket < most and r and used and used + c > limit:
            bucket, used = bucket + 1, 0
        spots.append(bucket if bucket < most else None)
        used += c
    return spots


@pytest.mark.parametrize("seed", range(60))
def test_first_fit_step_is_the_plain_fold(spark, seed):
    rng = random.Random(seed)
    limit, most = rng.choice([(1000, 5), (1000, 400), (50, 1), (300, 9)])
    sizes = [rng.choice([1, 7, 30, 49, 299, rng.randint(1, limit)]) for _ in range(rng.randint(1, 600))]
    sizes = [min(s, limit) for s in sizes]
    fold = packing.first_fit(limit, most)
    state, spots = fold.init, []
    cut = rng.randint(0, len(sizes))
    for piece in (sizes[:cut], sizes[cut:]):
        after, _, out = fold.step(state, {"bytes": np.array(piece, dtype=np.int64)})
        if piece:
            skipped = fold.skip(state, {"total": sum(piece), "least": min(piece)})
            assert skipped is None or skipped == after
        state = after
        spots += [None if s < 0 else int(s) for s in out["spot"]]
    assert spots == fit(sizes, limit, most)


@pytest.mark.parametrize("limit,chunk_rows", [(1000, 4), (50, 16), (9000, 8), (300, 1 << 18), (1, 4), (1 << 40, 8)])
def test_chains_are_the_plain_fold(spark, limit, chunk_rows):
    """Keys of one row and of hundreds, a null one; rows without cost, over the limit, and that never open."""
    rng = random.Random(limit)
    data, want = [], {}
    for key, n in [("a", 1), ("b", 260), (None, 60), ("c", 2), ("d", 0), ("e", 33)]:
        costs = [rng.choice([0, 0, 1, 30, 299, 1200]) for _ in range(n)]
        rolls = [rng.random() < (0.7 if key != "e" else 0.05) for _ in costs]
        data += [(key, i, c, r) for i, (c, r) in enumerate(zip(costs, rolls))]
        want |= {(key, i): (spot, sum(costs[: i + 1])) for i, spot in enumerate(roll(costs, rolls, limit, 1 << 30))}
    df = spark.createDataFrame(data, "k string, seq long, cost long, rolls boolean").repartition(3)
    chunked = ordered.ordered_chunks(df, ["k", "seq"], chunk_rows)
    got = jumps.chain_of_cuts(chunked, ["k"], packing.next_fit(limit), ("seq", "cost")).collect()
    assert {(r.k, r.seq): r.nth for r in got} == {key: spot for key, (spot, _) in want.items()}
    assert {(r.k, r.seq) for r in got if r["first"]} == {(k, s) for k, s in want if s == 0}
    assert {(r.k, r.seq) for r in got if r.cut} == {(k, s) for k, s in want if s and want[k, s][0] > want[k, s - 1][0]}


def jobs_of(spark, work):
    spark.sparkContext.setJobGroup("counted", "counted")
    try:
        before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
        work()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted")) - before
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_jobs_of_a_chain_grow_with_the_logarithm_of_its_chunks(spark):
    df = spark.range(4096).select(F.lit("k").alias("k"), F.col("id").alias("seq"), (F.col("id") % 97 + 1).alias("cost"), F.lit(True).alias("rolls"))
    counts = {}
    for chunk_rows in (256, 64, 16):
        chunked = ordered.ordered_chunks(df, ["k", "seq"], chunk_rows)
        work = lambda: jumps.chain_of_cuts(chunked, ["k"], packing.next_fit(2000), ("seq",)).count()  # noqa: E731,B023
        counts[4096 // chunk_rows] = jobs_of(spark, work)
    # Each four times as many chunks cost two more rounds of doubling, not four times the jobs.
    few, more, many = counts[16], counts[64], counts[256]
    assert abs((more - few) - (many - more)) <= 4 and many < 2 * few


@pytest.mark.parametrize("chunk_rows", [4, 32, 1 << 18])
def test_pack_first_fit_matches_descent_and_fold(spark, chunk_rows):
    """Several roots, one with most of the pieces; chunks small enough to need rounds."""
    trees = {r: random_tree(s, r, n) for s, (r, n) in enumerate([("x/r0", 400), ("r1", 60), ("r2", 5)])}
    entries = spark.createDataFrame([e for t in trees.values() for e in t], ENTRY)
    limit, most = 60_000, 6
    pieces = rollup.frontier(entries, limit)
    packed = packing.pack_first_fit(pieces, limit, most, chunk_rows)
    got = {(r.root, r.path): (r.bytes, r.bucket, r.status) for r in packed.collect()}
    want = {}
    for root, tree in trees.items():
        found = walk(tree, limit)
        for (p, size), spot in zip(found, fit([s for _, s in found], limit, most)):
            want[root, p] = (size, spot, "overflow" if spot is None else "ok")
    assert got == want
    assert any(status == "overflow" for _, _, status in want.values())


@pytest.mark.parametrize("chunk_rows", [4, 1 << 18])
def test_pack_next_fit_matches_fold(spark, chunk_rows):
    rng = random.Random(5)
    rows, want = [], {}
    for root, n in [("big", 300), ("small", 7)]:
        kinds = [rng.choice(["file", "file", "dir", "symlink"]) for _ in range(n)]
        sizes = [rng.choice([0, 600, 9000, 70_000]) if k == "file" else 0 for k in kinds]
        costs = [cost(s) if k == "file" else 512 for k, s in zip(kinds, sizes)]
        spots = roll(costs, [k == "file" for k in kinds], 64_000, 8)
        for i in range(n):
            rows.append((root, i, f"p{i}", kinds[i], sizes[i]))
            want[root, i] = (f"p{i}", kinds[i], costs[i], spots[i])
    entries = spark.createDataFrame(rows, "root string, seq long, path string, kind string, size long")
    packed = packing.pack_next_fit(entries, 64_000, 8, chunk_rows)
    got = {(r.root, r.seq): (r.path, r.kind, r.bytes, r.bucket) for r in packed.collect()}
    assert got == want
    assert packed.filter((F.col("status") == "overflow") != F.col("bucket").isNull()).count() == 0


@pytest.mark.parametrize("key", ["one", "two"])
def test_first_fit_ends_when_nothing_fits(spark, key):
    """A chunk without room leaves the state empty, which is a state like any other."""
    pieces = spark.createDataFrame(
        [(key, f"p{i}", 50 if i < 6 else 5, "ok") for i in range(8)], "root string, path string, bytes long, status string"
    )
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(f"ends-{key}", "first-fit over chunks of two")
    try:
        got = {r.path: (r.bucket, r.status) for r in packing.pack_first_fit(pieces, 10, 1, chunk_rows=2).collect()}
        assert len(tracker.getJobIdsForGroup(f"ends-{key}")) < 20
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {f"p{i}": (None, "oversize_file") if i < 6 else (0, "ok") for i in range(8)}


@pytest.mark.parametrize("chunk_rows", [8, 1 << 18])
def test_shards_never_split_a_key(spark, chunk_rows):
    rng = random.Random(3)
    sizes = {k: rng.choice([0, 10, 400, 1500]) for k in range(200)}
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "k long, b long")
    got = {r.k: r.shard for r in packing.shard_by_key(df, "k", "b", 1000, chunk_rows).collect()}
    keys = sorted(sizes)
    assert [got[k] for k in keys] == roll([sizes[k] for k in keys], [True] * 200, 1000, 10**9)


def test_tree_order_is_by_components(spark):
    df = spark.createDataFrame([("r", p, 700, "ok") for p in ["a.txt", "a/x"]],
                               "root string, path string, bytes long, status string")
    packed = packing.pack_first_fit(df, 700, 2)
    assert {r.path: r.bucket for r in packed.collect()} == {"a/x": 0, "a.txt": 1}


def test_refusals(spark, rows):
    limit = 100 * 1024
    entries = spark.createDataFrame(
        [("r", "big.bin", "file", 500 * 1024), ("r", "d", "dir", 0), ("r", "d/ok", "file", 10)], ENTRY
    )
    pieces = rollup.frontier(entries, limit)
    assert rows(pieces, "path", "status") == [("big.bin", "oversize_file"), ("d", "ok")]
    packed = packing.pack_first_fit(pieces, limit, 2)
    with pytest.raises(RefusedError, match="oversize_file x1"):
        require_ok(packed)
    four = spark.createDataFrame([("r", f"f{i}", "file", 100 * 1024) for i in range(4)], ENTRY)
    packed = packing.pack_first_fit(
        rollup.frontier(four, 150 * 1024), 150 * 1024, 2
    )
    with pytest.raises(RefusedError, match="overflow x2"):
        require_ok(packed)


def test_an_opened_directory_without_children(spark, rows):
    # Only a long name makes a bare directory exceed a limit this small.
    entries = spark.createDataFrame([("r", "d" * 150, "dir", 0), ("r", "f", "file", 0)], ENTRY)
    pieces = rollup.frontier(entries, 600)
    assert rows(pieces, "path", "status") == [("d" * 150, "empty_dir"), ("f", "ok")]


def test_root_is_opened_even_when_it_fits(spark, rows):
    entries = spark.createDataFrame(
        [("srv/x", "a", "dir", 0), ("srv/x", "a/f", "file", 5), ("srv/x", "b", "dir", 0)], ENTRY
    )
    sizes = rollup.subtree_sizes(entries)
    assert rows(sizes, "path", "bytes", "nodes") == [
        ("", 512 + 512 + 1024 + 512, 4), ("a", 1536, 2), ("a/f", 1024, 1), ("b", 512, 1),
    ]
    assert rows(rollup.frontier(entries, 10**9), "path") == [("a",), ("b",)]


def test_members_round_trip_and_audit_clean(spark, tmp_path, rows):
    entries = spark.createDataFrame(random_tree(9, "r", 200), ENTRY)
    limit = 50_000
    pieces = rollup.frontier(entries, limit)
    packed = require_ok(packing.pack_first_fit(pieces, limit, 500, chunk_rows=16))
    members = rollup.with_ancestors(rollup.expand_pieces(packed, entries))
    assert audit_assignment(entries, members).count() == 0
    assert audit_assignment(entries, members, ancestors_in="bucket").count() == 0
    write_buckets(members, str(tmp_path / "out"))
    back = read_buckets(spark, str(tmp_path / "out"))
    assert rows(back, "root", "bucket", "path", "kind") == rows(members, "root", "bucket", "path", "kind")
    files = back.filter("kind <> 'dir'")
    assert files.count() == files.select("path").distinct().count()


def test_padding(spark, rows):
    members = spark.createDataFrame([("r", 0, "a/f", "file"), ("s", 0, "f", "file")],
                                    "root string, bucket int, path string, kind string")
    entries = spark.createDataFrame(
        [("r", "a", "dir", 0), ("r", "b", "dir", 0), ("r", "a/f", "file", 1), ("s", "f", "file", 1)], ENTRY
    )
    assert rows(packing.pad_unused(members, entries, 2)) == [
        ("r", 1, "a", "padding", 1), ("r", 1, "b", "padding", 1), ("s", None, None, "unpaddable", 1),
    ]


@pytest.mark.parametrize("chunk_rows", [2, 1 << 18])
def test_row_number_and_running_sum(spark, chunk_rows):
    rng = random.Random(1)
    data = [(rng.randint(0, 50), i, rng.randint(0, 9)) for i in range(300)]
    df = spark.createDataFrame(data, "k long, i long, v long").repartition(7)
    want = sorted(data)
    numbered = ordered.with_row_number(df, ["k", "i"], "n", chunk_rows)
    assert [tuple(r) for r in numbered.orderBy("n").select("k", "i", "n").collect()] == [
        (k, i, n) for n, (k, i, _) in enumerate(want, 1)
    ]
    summed = ordered.with_running_sum(df, ["k", "i"], F.col("v"), "s", chunk_rows)
    total, expected = 0, []
    for k, i, v in want:
        total += v
        expected.append((k, i, total))
    assert [tuple(r) for r in summed.orderBy("k", "i").select("k", "i", "s").collect()] == expected


def test_chunk_rows_must_be_a_power_of_two(spark):
    with pytest.raises(ValueError):
        ordered.ordered_chunks(spark.range(3), ["id"], 3)


def test_empty_input(spark):
    none = spark.createDataFrame([], ENTRY)
    packed = packing.pack_first_fit(rollup.frontier(none, 1000), 1000, 2)
    assert packed.count() == 0
    assert ordered.with_row_number(none, ["path"]).count() == 0
