"""Catalog rules, provenance and lock decisions: one changed thing, one answer."""

from __future__ import annotations

import copy
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tallyman.operators.catalog_rules import validate_catalog
from tallyman.operators.provenance import input_set_digest, lock_decision, reuse_reason
from tallyman.sources import CATALOG_SCHEMA, catalog_tables

GOOD = {
    "benchmark": "web", "service": "shop",
    "datasets": [
        {"filename": "a.tar", "sha256": "a" * 64, "urls": ["https://x/a", "https://y/a"], "prepare_input": True},
        {"filename": "b.tar", "sha256": "b" * 64, "urls": ["https://x/b"], "prepare_input": True},
    ],
    "prepare": {"script": "derive.sh", "outputs": ["media.tar"]},
    "media": {"archive": "media.tar", "dest": "/opt/media/", "chown": "", "limit_kb": 10, "max_buckets": 2,
              "strip": "/pub/"},
    "build": {"args": {"A": "1"}},
    "build_minutes": 87,
}


def frame(spark, *docs):
    lines = spark.createDataFrame([(json.dumps(d),) for d in docs], "j string")
    return lines.select(F.from_json("j", CATALOG_SCHEMA).alias("d")).select("d.*")


def changed(*path, value="__drop__", **more):
    doc = copy.deepcopy(GOOD)
    at = doc
    for step in path[:-1]:
        at = at[step]
    if value == "__drop__":
        del at[path[-1]]
    else:
        at[path[-1]] = value
    doc.update(more)
    return doc


SAVED = {"source": {"kind": "docker-save", "dataset": "a.tar", "tag": "t"}}


def saved(**source):
    doc = copy.deepcopy(GOOD)
    for key in ("prepare", "media", "build"):
        del doc[key]
    for d in doc["datasets"]:
        d["prepare_input"] = False
    doc["source"] = {"kind": "docker-save", "dataset": "a.tar", "tag": "t", **source}
    return doc


@pytest.mark.parametrize(
    "doc,codes",
    [
        (GOOD, []),
        ({"benchmark": "b", "service": "s"}, []),
        (saved(), []),
        (changed("datasets", 0, "filename"), ["dataset_missing_filename"]),
        (changed("datasets", 0, "sha256"), ["dataset_missing_sha256"]),
        (changed("datasets", 1, "urls"), ["dataset_missing_urls"]),
        (changed("datasets", 1, "urls", value=[]), ["dataset_empty_urls"]),
        (changed("datasets", 0, "sha256", value="A" * 64), ["dataset_bad_sha256"]),
        (changed("datasets", 0, "sha256", value="a" * 63), ["dataset_bad_sha256"]),
        (changed("source", value={"kind": "zip"}), ["prepare_without_build", "source_kind"]),
        (changed("source", value={"tag": "t"}), ["stray_source_keys"]),
        (saved(dataset=None), ["save_missing_dataset"]),
        (saved(tag=None), ["save_missing_tag"]),
        (saved(dataset="c.tar"), ["save_unknown_dataset"]),
        ({**saved(), "build": {"args": {}}}, ["save_with_build_section"]),
        (changed("prepare", "script"), ["prepare_missing_script"]),
        (changed("prepare", "outputs", value=[]), ["media_unknown_archive", "prepare_empty_outputs"]),
        (changed("prepare"), ["media_unknown_archive", "prepare_input_without_prepare"]),
        (changed("media", "archive", value="a.tar"), []),
        (changed("media", "archive", value="zzz"), ["media_unknown_archive"]),
        (changed("media", "dest", value="opt"), ["media_relative_dest"]),
        (changed("media", "chown", value="app"), ["media_bad_chown"]),
        (changed("media", "chown"), ["media_missing_chown"]),
        (changed("media", "limit_kb"), ["media_missing_limit_kb"]),
        (changed("media", "max_buckets"), ["media_missing_max_buckets"]),
        (changed("build_minutes", value=None), []),
        (changed("build_minutes", value=0), []),
        (changed("build_minutes", value=-1), ["bad_build_minutes"]),
        (changed("build_minutes", value=1.5), ["bad_build_minutes"]),
        (changed("build_minutes", value=5, run={"healthcheck_timeout_s": 900}), ["retired_healthcheck_timeout"]),
    ],
)
def test_rules(spark, doc, codes):
    assert sorted(r.code for r in validate_catalog(frame(spark, doc)).collect()) == codes


def test_inventory_rules(spark, rows):
    inventory = spark.createDataFrame(
        [("web", "shop", "image.toml"), ("web", "bare", "README")], "benchmark string, service string, path string"
    )
    got = validate_catalog(frame(spark, GOOD), inventory)
    assert rows(got, "service", "code", "detail") == [
        ("bare", "manifest_missing", ""), ("shop", "script_not_found", "derive.sh"),
    ]


def test_tables(spark, rows):
    tables = catalog_tables(frame(spark, GOOD, {"benchmark": "b", "service": "s"}))
    assert rows(tables["images"], "name", "source_kind", "build_minutes", "reachability_timeout_s") == [
        ("b-s", "build", None, 30), ("web-shop", "build", 87, 30),
    ]
    assert rows(tables["dataset_urls"], "filename", "url_idx", "url") == [
        ("a.tar", 0, "https://x/a"), ("a.tar", 1, "https://y/a"), ("b.tar", 0, "https://x/b"),
    ]
    assert rows(tables["packing_spec"], "strip", "dest", "chown", "min_entries", "restore_needs_media") == [
        ("pub", "/opt/media", "", 0, False)
    ]
    assert rows(tables["outputs"], "output") == [("media.tar",)]
    assert rows(tables["build_args"], "arg", "value") == [("A", "1")]


def test_input_set_digest_ignores_order(spark):
    turned = copy.deepcopy(GOOD)
    turned["datasets"].reverse()
    single = changed("datasets", 1, "prepare_input", value=False)
    got = [r[0] for r in frame(spark, GOOD, turned, single).select(input_set_digest()).collect()]
    want = hashlib.sha256(f"a.tar:{'a' * 64}\nb.tar:{'b' * 64}".encode()).hexdigest()
    assert got == [want, want, None]


CURRENT = {"script_sha256": "s", "outputs": [("o", 5), ("p", 7)], "prepare_input_sha256": "x",
           "prepare_inputs_digest": None}
STAMP = {"script_sha256": "s", "outputs": {"o": 5, "p": 7}, "prepare_input_sha256": "x"}


@pytest.mark.parametrize(
    "current,stamp,reason,detail",
    [
        ({}, STAMP, None, None),
        ({}, {**STAMP, "prepare_inputs_digest": None}, None, None),
        ({"outputs": [("o", None), ("p", None)]}, None, "missing_outputs", "o, p"),
        ({}, None, "no_stamp", None),
        ({}, "{cut", "unreadable_stamp", None),
        ({"script_sha256": "t", "prepare_input_sha256": "y"}, STAMP, "script_changed", None),
        ({"prepare_input_sha256": None}, STAMP, "pin_changed", None),
        ({"prepare_inputs_digest": "d"}, STAMP, "pin_set_changed", None),
        ({"outputs": [("o", 5), ("p", 8)]}, STAMP, "output_size_changed", "p is 8 bytes, was 7"),
        ({"outputs": [("q", 5)]}, STAMP, "output_size_changed", "q is 5 bytes, was unknown"),
    ],
)
def test_reuse_reason(spark, current, stamp, reason, detail):
    now = {**CURRENT, **current}
    df = spark.createDataFrame(
        [("i", now["script_sha256"], now["outputs"], now["prepare_input_sha256"], now["prepare_inputs_digest"])],
        "image string, script_sha256 string, outputs array<struct<name: string, size: long>>, "
        "prepare_input_sha256 string, prepare_inputs_digest string",
    )
    text = stamp if isinstance(stamp, str) else json.dumps(stamp)
    stamps = spark.createDataFrame([] if stamp is None else [("i", text)], "image string, stamp string")
    assert tuple(reuse_reason(df, stamps).first()) == ("i", reason, detail)


@pytest.mark.parametrize(
    "pin,resolved,waiver,want",
    [
        (None, (True, "d"), {}, ("pull", False, "unpinned")),
        ([None], (True, "d"), {}, ("pull", False, "pinned_without_digest")),
        (["d"], (True, "d"), {}, ("pull", False, "digest_matches")),
        (["d"], (True, "e"), {}, ("fatal", False, "digest_moved")),
        (["d"], (True, "e"), {"allow_mismatch": True}, ("pull", True, "digest_moved")),
        (["d"], (True, "e"), {"allow_miss": True}, ("fatal", False, "digest_moved")),
        (["d"], (False, "d"), {"allow_mismatch": True}, ("fatal", False, "not_an_artifact")),
        (None, None, {}, ("derive", False, "not_cached")),
        ([None], None, {}, ("fatal", False, "pinned_but_missing")),
        (["d"], None, {"allow_miss": True}, ("derive", True, "pinned_but_missing")),
        (["d"], None, {"allow_mismatch": True}, ("fatal", False, "pinned_but_missing")),
    ],
)
def test_lock_decisions(spark, pin, resolved, waiver, want):
    refs = spark.createDataFrame([("r",)], "ref string")
    lock = spark.createDataFrame([("r", *pin)] if pin else [], "ref string, digest string")
    found = spark.createDataFrame(
        [("r", *resolved)] if resolved else [], "ref string, is_artifact boolean, digest string"
    )
    assert tuple(lock_decision(refs, lock, found, **waiver).first())[1:] == want
