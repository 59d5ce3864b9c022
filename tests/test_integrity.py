"""Pins, diffs, counts, audits, sources and sinks."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from tallyman.operators import audit, integrity, select
from tallyman.sources import (
    RefusedError,
    file_inventory,
    manifest_layers,
    quarantine,
    read_buckets,
    read_checksums,
    read_lock,
    read_product_json,
    read_readings,
    require_ok,
    write_buckets,
    write_checksums,
)

SUMS = "path string, sha256 string"
ENTRY = "root string, seq long, path string, kind string, mode int, link_target string"


def test_inventory_holds_every_file(spark, tmp_path, rows):
    """Empty and hidden files are files too; a link back up is not followed."""
    (tmp_path / "d" / "e").mkdir(parents=True)
    files = {"d/a b": b"hello", "d/.hidden": b"h", "d/xdeep.bin": b"", "_under": b"u", "empty": b"", "d/e/deep.bin": b"x" * 9}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    (tmp_path / "d" / "loop").symlink_to(tmp_path)
    got = {r.path: r for r in file_inventory(spark, str(tmp_path)).collect()}
    assert {p.removeprefix(f"{tmp_path}/"): (r.length, r.sha256, r.status) for p, r in got.items()} == {
        name: (len(c), hashlib.sha256(c).hexdigest(), "hashed") for name, c in files.items()
    }
    assert all(r.modified is not None for r in got.values())
    listed = file_inventory(spark, str(tmp_path), hashes=False, glob="dee?.bin")
    assert rows(listed, "length", "sha256", "status") == [(9, None, "listed")]


def test_checksum_lists_round_trip(spark, tmp_path, rows):
    digest = "0" * 64
    sums = spark.createDataFrame([("b c", digest), ("a", digest)], SUMS)
    write_checksums(sums, str(tmp_path / "s"))
    assert rows(read_checksums(spark, str(tmp_path / "s")), "path", "status") == [("a", "ok"), ("b c", "ok")]
    (tmp_path / "bad").write_text(f"{digest} one-space\n{digest.replace('0', 'A')}  upper\n{digest}  ok\n")
    got = read_checksums(spark, str(tmp_path / "bad"))
    assert [r.status for r in got.collect()] == ["malformed", "malformed", "ok"]


def test_lock_first_line_wins(spark, tmp_path, rows):
    (tmp_path / "lock").write_text(
        "# header\n\nreg/a:1  sha256:aa  # pinned\nreg/b:1\n  reg/c:1 sha256:cc extra\n"
        "reg/a:1 sha256:later\nreg/b:1 sha256:later\n#reg/d:1 sha256:dd\n"
    )
    assert rows(read_lock(spark, str(tmp_path / "lock"))) == [
        ("reg/a:1", "sha256:aa"), ("reg/b:1", None), ("reg/c:1", "sha256:cc"),
    ]


@pytest.mark.parametrize(
    "text,want",
    [
        ('{"layers": [{"digest": "sha256:1", "size": 3, "annotations": {"org.opencontainers.image.title": "a"}}]}',
         [("a", "ok")]),
        ('{"layers": [{"digest": "sha256:1", "size": 3}]}', [(None, "empty_artifact")]),
        ('{"layers": [{"digest": "x", "size": 3, "annotations": {"org.opencontainers.image.title": "../etc"}},'
         ' {"digest": "y", "size": 3, "annotations": {"org.opencontainers.image.title": ".."}}]}',
         [("..", "refused"), ("../etc", "refused")]),
        ("{}", [(None, "empty_artifact")]),
        ("<html>", [(None, "not_json")]),
    ],
)
def test_manifest_layers(spark, rows, text, want):
    df = spark.createDataFrame([("r", text)], "ref string, manifest string")
    assert rows(manifest_layers(df), "title", "status") == want


def test_json_feeds(spark, tmp_path):
    (tmp_path / "p.json").write_text('[{"id": 1,\n "name": "x"}, {"id": 2}]')
    got = read_product_json(spark, str(tmp_path / "p.json"), "id long, name string")
    assert sorted((r.id, r.name, r.status) for r in got.collect()) == [(1, "x", "ok"), (2, None, "ok")]
    (tmp_path / "bad.json").write_text('[{"id": 3}, {')
    bad = read_product_json(spark, str(tmp_path / "bad.json"), "id long, name string").first()
    assert (bad.id, bad.status, bad.raw) == (None, "unparsable", '[{"id": 3}, {')
    (tmp_path / "r.json").write_text('{"metric": "resources", "phase": "start", "mem_total_mb": null}\n')
    row = read_readings(spark, str(tmp_path / "r.json")).first()
    assert (row.metric, row.mem_total_mb, row.disk_free_gb, row.status) == ("resources", None, None, "ok")
    (tmp_path / "broken.json").write_text('{"metric": \n')
    row = read_readings(spark, str(tmp_path / "broken.json")).select("status", "raw").first()
    assert (row.status, row.raw) == ("unparsable", '{"metric": ')


def test_quarantine_replaces_only_its_own_values(spark, tmp_path, rows):
    path = str(tmp_path / "q")
    schema = "name string, sha string, good boolean"
    quarantine(spark.createDataFrame([("a", "1", False), ("b", "1", False)], schema), F.col("good"), path, "name")
    quarantine(spark.createDataFrame([("a", "2", None), ("c", "2", True)], schema), F.col("good"), path, "name")
    back = spark.read.parquet(path)
    assert rows(back, "verdict", "name", "sha") == [
        ("quarantine", "a", "2"), ("quarantine", "b", "1"), ("verified", "c", "2"),
    ]
    # A value that turns bad leaves nothing verified behind, and the other way round.
    again = spark.createDataFrame([("a", "3", True), ("c", "3", False)], schema)
    quarantine(again, F.col("good"), path, "name")
    assert rows(spark.read.parquet(path), "verdict", "name", "sha") == [
        ("quarantine", "b", "1"), ("quarantine", "c", "3"), ("verified", "a", "3"),
    ]


def test_unplaced_rows_are_refused_before_anything_is_written(spark, tmp_path):
    path = str(tmp_path / "buckets")
    rows = spark.createDataFrame([("r", 0, "a"), ("r", None, "b")], "root string, bucket int, path string")
    with pytest.raises(RefusedError, match="without a bucket x1"):
        write_buckets(rows, path)
    assert not (tmp_path / "buckets").exists()
    write_buckets(rows.filter("bucket IS NOT NULL"), path)
    assert read_buckets(spark, path, rows.schema).count() == 1


def test_unplaced_rows_are_written_beside_when_asked(spark, rows, tmp_path):
    path, refused = str(tmp_path / "buckets"), str(tmp_path / "refused")
    schema = "root string, bucket int, path string, status string"
    packed = [("r", 0, "a", "ok"), ("r", None, "b", "oversize_file"), ("r", None, "c", "overflow")]
    write_buckets(spark.createDataFrame(packed, schema), path, refused=refused)
    assert rows(read_buckets(spark, path), "path", "bucket") == [("a", 0)]
    assert rows(spark.read.parquet(refused), "path", "status") == [("b", "oversize_file"), ("c", "overflow")]


def test_require_ok(spark):
    df = spark.createDataFrame([("ok",), ("bad",), ("bad",)], "status string")
    with pytest.raises(RefusedError, match="bad x2"):
        require_ok(df)
    assert require_ok(df.filter("status = 'ok'")).count() == 1


def test_verify_and_diff(spark, rows):
    expected = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("config", "1")], SUMS)
    actual = spark.createDataFrame([("a", "1"), ("b", "2"), ("x", "1"), ("config", "9"), ("v/config", "9")], SUMS)
    assert rows(integrity.verify_pins(expected, actual), "path", "status") == [
        ("a", "verified"), ("b", "mismatch"), ("c", "missing"), ("config", "mismatch"),
    ]
    # Excluding one exact path must not hide another that ends alike.
    assert rows(integrity.tree_diff(expected, actual, ["config"]), "path", "status") == [
        ("a", "identical"), ("b", "changed"), ("c", "only_expected"), ("v/config", "only_actual"), ("x", "only_actual"),
    ]


def test_counts_and_floors(spark, rows):
    df = spark.createDataFrame([(1,), (5,)], "k long")
    measured = integrity.measure(df, {"n": F.count(F.lit(1)), "top": F.max("k"), "over": F.count_if(F.col("k") > 9)})
    pins = spark.createDataFrame([("n", 2), ("top", 4), ("over", 0), ("gone", 1)], "label string, expected long")
    assert rows(integrity.check_counts(pins, measured), "label", "status") == [
        ("gone", "unmeasured"), ("n", "ok"), ("over", "ok"), ("top", "mismatch"),
    ]
    floors = spark.createDataFrame([("n", 2), ("top", 6), ("gone", 0)], "label string, floor long")
    assert rows(integrity.check_floors(measured, floors), "label", "status") == [
        ("gone", "missing"), ("n", "ok"), ("top", "below_floor"),
    ]
    assert integrity.at_least(spark.range(1000), 10).first()[:] == (11, True)
    assert integrity.at_least(spark.range(10), 10).first()[:] == (10, False)


@pytest.mark.parametrize(
    "lines",
    [
        ["a", "-- Dump completed on x"],
        ["-- Dump completed", "z" * 181],
        ["-- Dump completed", "z" * 182],
        ["xx-- Dump completed" + "z" * 180],
        ["xx-- Dump completed" + "z" * 182],
        ["xx-- Dump completed" + "z" * 183],
        ["é" * 50, "-- Dump completed", "é" * 90, ""],
        ["é" * 50, "-- Dump completed", "é" * 91, ""],
        ["x -- Dump completed"],
        [""] * 300,
        [""] * 300 + ["-- Dump completed"] + [""] * 182,
        [""] * 300 + ["-- Dump completed"] + [""] * 183,
    ],
)
def test_dump_trailer_by_bytes(spark, lines):
    tail = ("\n".join(lines) + "\n").encode()[-200:]
    want = any(line.startswith(b"-- Dump completed") for line in tail.split(b"\n"))
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line_no int, line string")
    assert integrity.dump_complete(df.repartition(3)).first().complete == want


def test_required_files_and_owner(spark, rows):
    entries = spark.createDataFrame(
        [("r", "car/m.x", "file", 500, 0, 0), ("r", "car/m.y", "dir", 0, 0, 7), ("r", "foot/m.x", "file", 5, 3, 0)],
        "root string, path string, kind string, size long, uid int, gid int",
    )
    dirs = spark.createDataFrame([("r", "car"), ("r", "foot")], "root string, dir string")
    assert rows(integrity.required_files(entries, dirs, ["m.x", "m.y"], "m.x", 100), "dir", "name", "status") == [
        ("car", "m.y", "missing"), ("foot", "m.x", "too_small"), ("foot", "m.y", "missing"),
    ]
    assert rows(integrity.ownership_audit(entries, 0, 0), "path") == [("car/m.y",), ("foot/m.x",)]
    assert rows(integrity.ownership_audit(entries, 0, 0, first=1), "path") == [("car/m.y",)]


CASES = [
    ("/etc/x", "file", 0o644, None, {"absolute or traversing path"}, {"absolute or traversing path"}),
    ("a/../b", "dir", 0o755, None, {"absolute or traversing path"}, {"absolute or traversing path"}),
    ("a..b", "file", 0o644, None, set(), set()),
    ("a/h", "hardlink", 0o4777, "a/f", {"hard link"}, {"setuid/setgid", "world-writable"}),
    ("a/in", "symlink", 0o777, "../b/f", set(), set()),
    ("a/up", "symlink", 0o777, "../../f", {"symlink escapes the tree"}, {"symlink escapes the tree"}),
    ("a/abs", "symlink", 0o777, "/f", {"symlink escapes the tree"}, {"symlink escapes the tree"}),
    ("quirk", "symlink", 0o777, "..x", {"symlink escapes the tree"}, {"symlink escapes the tree"}),
    ("a/b/ok", "symlink", 0o777, "./../../c/./d", set(), set()),
    ("setgid", "dir", 0o2775, None, set(), {"setuid/setgid"}),
    ("suid", "file", 0o4755, None, {"setuid/setgid"}, {"setuid/setgid"}),
    ("ww", "file", 0o666, None, set(), {"world-writable"}),
    ("pipe", "fifo", 0o4666, None, *[{"not a regular file, directory or symlink"}] * 2),
]


@pytest.mark.parametrize("profile,column", [("archive", 4), ("tree", 5)])
def test_audit_profiles(spark, profile, column):
    df = spark.createDataFrame([("r", i, *c[:4]) for i, c in enumerate(CASES)], ENTRY)
    got = {}
    for r in audit.entry_violations(df, profile).collect():
        got.setdefault(CASES[r.seq][0], set()).add(r.category)
    assert got == {c[0]: c[column] for c in CASES if c[column]}


def test_audit_counts_all_and_shows_three(spark):
    df = spark.createDataFrame([("r", i, f"f{i:03}", "file", 0o4755, None) for i in range(500)], ENTRY)
    (row,) = audit.audit_entries(df.repartition(7)).collect()
    assert (row.category, row.n) == ("setuid/setgid", 500)
    assert row.examples == "f000 (4755); f001 (4755); f002 (4755)"
    with pytest.raises(ValueError):
        audit.entry_problems("other")


def test_audit_assignment(spark, rows):
    entries = spark.createDataFrame(
        [("r", "a", "dir"), ("r", "a/f", "file"), ("r", "a/g", "file"), ("r", "b", "file")],
        "root string, path string, kind string",
    )
    assigned = spark.createDataFrame(
        [("r", 0, "a", "dir"), ("r", 0, "a/f", "file"), ("r", 1, "a/f", "file"), ("r", 1, "c/d/x", "file"),
         ("r", 0, "b", "file")],
        "root string, bucket int, path string, kind string",
    )
    faults = [("a/f", "duplicate_file"), ("a/g", "missing"), ("c", "implicit_ancestor"),
              ("c/d", "implicit_ancestor"), ("c/d/x", "extra")]
    assert rows(audit.audit_assignment(entries, assigned), "path", "category") == faults
    assert rows(audit.audit_assignment(entries, assigned, "bucket"), "path", "category") == sorted(
        [*faults, ("a", "implicit_ancestor")], key=repr
    )


def test_selection(spark, rows):
    df = spark.createDataFrame([("r", "m/a", "dir", 0o777), ("r", "m", "dir", 0o755), ("r", "m/l", "symlink", 0o777)],
                               "root string, path string, kind string, mode int")
    assert rows(select.strip_paths(df, "zz"), "path") == [("a",), ("l",)]
    assert rows(select.clear_world_writable(df), "path", "mode", "corrected") == [
        ("m", 0o755, False), ("m/a", 0o775, True), ("m/l", 0o777, False),
    ]
    images = spark.createDataFrame([("b", "x", 5), ("a", "x", None), ("a", "b", 5), ("c", "y", 90)],
                                   "benchmark string, service string, build_minutes int")
    ranked = select.order_by_cost(images).orderBy("rank").collect()
    assert [(r.benchmark, r.service) for r in ranked] == [("a", "x"), ("c", "y"), ("a", "b"), ("b", "x")]
    flags = spark.createDataFrame([("a", True), ("b", False), ("c", None)], "f string, prepare_input boolean")
    assert rows(select.lazy_split(flags, True), "f") == [("a",)]
    assert rows(select.lazy_split(flags, False), "f") == [("b",), ("c",)]
