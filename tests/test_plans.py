"""Whole jobs on small inputs."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from tallyman.operators.rollup import directory_sizes, with_directories
from tallyman.plans import pack_archive, pack_tree, plan_pull

ENTRY = "root string, path string, kind string, size long"
ARCHIVE = "root string, seq long, path string, kind string, size long, mode int, link_target string"


def test_tree_packs_clean_and_pads(spark, rows):
    files = [("r", f"d{i % 3}/f{i}", "file", 3000) for i in range(12)]
    entries = with_directories(spark.createDataFrame(files, ENTRY))
    packing = pack_tree(entries, 20_000, 5, chunk_rows=2)
    assert packing.problems.isEmpty()
    report = packing.report.orderBy("bucket").collect()
    assert [r.bucket for r in report] == [0, 1, 2]
    assert all(r.bytes <= 20_000 and (r.used, r.ceiling) == (3, 5) for r in report)
    padding = packing.members.filter("bucket >= 3")
    assert rows(padding, "bucket", "path") == [(b, f"d{i}") for b in (3, 4) for i in range(3)]


def test_one_bad_file_is_a_problem(spark, rows):
    entries = spark.createDataFrame([("r", "big", "file", 10**6), ("r", "d", "dir", 0)], ENTRY)
    assert rows(pack_tree(entries, 10_000, 1).problems, "path", "category") == [
        ("big", "missing"), ("big", "oversize_file"),
    ]


def test_archive_reports_everything_at_once(spark, rows):
    entries = spark.createDataFrame(
        [
            ("r", 1, "media", "dir", 0, 0o755, None),
            ("r", 2, "media/a", "file", 900, 0o666, None),
            ("r", 3, "media/s", "file", 900, 0o4755, None),
            ("r", 4, "media/l", "hardlink", 0, 0o644, "media/a"),
        ],
        ARCHIVE,
    )
    packing = pack_archive(entries, "media", 4096, 3)
    assert rows(packing.problems, "path", "category") == [
        ("l -> media/a", "hard link"), ("needs max_buckets=1", "unpaddable"), ("s (4755)", "setuid/setgid"),
    ]
    assert rows(packing.assigned, "seq", "path", "bucket") == [(2, "a", 0), (3, "s", 0), (4, "l", 0)]


def test_stated_and_implied_directories(spark, rows):
    entries = spark.createDataFrame(
        [("r", "", "dir", 0), ("r", "a", "dir", 0), ("r", "a/b/c", "file", 1)], ENTRY
    )
    full = with_directories(entries)
    assert rows(full, "path", "kind") == [("", "dir"), ("a", "dir"), ("a/b", "dir"), ("a/b/c", "file")]
    assert rows(directory_sizes(full), "path", "bytes", "nodes") == [
        ("", 512 * 5, 4), ("a", 512 * 4, 3), ("a/b", 512 * 3, 2),
    ]


def test_pull_stops_on_an_unusable_manifest(spark, rows):
    titled = {"org.opencontainers.image.title": "a"}
    good = json.dumps({"artifactType": "x", "layers": [{"digest": "d", "size": 4, "annotations": titled}]})
    bare = json.dumps({"artifactType": "x", "layers": []})
    manifests = spark.createDataFrame([("good", good), ("moved", good), ("bare", bare)], "ref string, manifest string")
    lock = spark.createDataFrame(
        [("good", "sha256:" + hashlib.sha256(good.encode()).hexdigest()), ("moved", "sha256:0"), ("lost", None)],
        "ref string, digest string",
    )
    refs = spark.createDataFrame([(r,) for r in ("good", "moved", "bare", "lost", "new")], "ref string")
    local = spark.createDataFrame([], "ref string, title string, have long, have_digest string")
    pull = plan_pull(refs, manifests, lock, local)
    assert rows(pull.decisions, "ref", "decision", "reason") == [
        ("bare", "fatal", "empty_artifact"), ("good", "pull", "digest_matches"), ("lost", "fatal", "pinned_but_missing"),
        ("moved", "fatal", "digest_moved"), ("new", "derive", "not_cached"),
    ]
    assert rows(pull.transfers) == [("good", "a", "fetch", 0, 4)]
    waived = plan_pull(refs, manifests, lock, local, allow_mismatch=True)
    assert rows(waived.decisions.filter(F.col("warned")), "ref", "decision") == [("moved", "pull")]
    assert rows(waived.transfers, "ref") == [("good",), ("moved",)]
