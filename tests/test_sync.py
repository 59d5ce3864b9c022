"""Transfer plans, registry answers and stalls."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from tallyman.operators import sync

T0 = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize(
    "size,local,want",
    [
        (10, None, ("fetch", 0, 10)),
        (10, (0, "d"), ("fetch", 0, 10)),
        (10, (4, "d"), ("resume", 4, 6)),
        (10, (10, "d"), ("skip", 0, 0)),
        (10, (10, "e"), ("restart", 0, 10)),
        (10, (10, None), ("restart", 0, 10)),
        (10, (11, "d"), ("restart", 0, 10)),
        (0, (0, "d"), ("skip", 0, 0)),
        (0, None, ("fetch", 0, 0)),
    ],
)
def test_transfer_plan(spark, size, local, want):
    layers = spark.createDataFrame([("r", "t", "d", size)], "ref string, title string, digest string, size long")
    have = spark.createDataFrame([("r", "t", *local)] if local else [],
                                 "ref string, title string, have long, have_digest string")
    assert tuple(sync.transfer_plan(layers, have).first())[2:] == want


@pytest.mark.parametrize(
    "tries,want",
    [
        ([(0, 1, "fetch_error"), (0, 2, "ok")], ("verified", 0, 2, None, 0)),
        ([(0, 1, "fetch_error"), (0, 2, "sha_mismatch"), (1, 1, "ok")], ("fatal", 0, 2, None, 0)),
        ([(1, 1, "ok"), (0, 3, "fetch_error")], ("verified", 1, 1, None, 0)),
        ([(0, 1, "fetch_error"), (1, 1, "fetch_error"), (0, 2, "fetch_error")],
         ("exhausted", None, None, "e01; e02; e11", 0)),
        ([(0, 1, "fetch_error"), (0, 4, "ok")], ("exhausted", None, None, "e01", 1)),
        ([(0, 4, "ok"), (0, None, "ok")], ("exhausted", None, None, None, 2)),
    ],
)
def test_resolve_attempts(spark, tries, want):
    df = spark.createDataFrame([("d", u, a, o, f"e{u}{a}") for u, a, o in tries],
                               "dataset string, url_idx int, attempt int, outcome string, error string")
    assert tuple(sync.resolve_attempts(df).first())[1:] == want


@pytest.mark.parametrize(
    "entries,want",
    [
        ([("m0", "linux", "arm64"), ("m1", "linux", "amd64")], ("m1", "picked")),
        ([("m0", None, None), ("m1", "linux", "arm64")], ("m0", "picked")),
        ([("m0", "unknown", "unknown"), ("m1", "linux", "arm64")], ("m1", "picked")),
        ([("m0", "windows", "amd64"), ("m1", "linux", "arm64")], ("m0", "picked")),
        ([("m0", "unknown", "unknown")], (None, "unavailable")),
    ],
)
def test_pick_manifest(spark, entries, want):
    df = spark.createDataFrame([("i", n, *e) for n, e in enumerate(entries)],
                               "image string, position int, digest string, os string, arch string")
    assert tuple(sync.pick_manifest(df).first())[1:] == want


def test_published_state(spark, rows):
    images = spark.createDataFrame([(n,) for n in "abcdef"], "image string")
    label = {"org.opencontainers.image.revision": "abc"}
    answers = spark.createDataFrame(
        [("a", 200, label), ("b", 200, {}), ("c", 404, None), ("d", 401, None), ("e", 500, None)],
        "image string, code int, labels map<string, string>",
    )
    assert rows(sync.published_state(images, answers)) == [
        ("a", "published", "abc"), ("b", "published", None), ("c", "unpublished", None),
        ("d", "unpublished", None), ("e", "unavailable", None), ("f", "unavailable", None),
    ]


def test_dedup(spark, rows):
    blobs = spark.createDataFrame([("x", 1, 5), ("x", 1, 2), ("y", 2, 3)] + [("hot", 9, i) for i in range(99)],
                                  "digest string, size long, seq long")
    stored = spark.createDataFrame([("y",)], "digest string")
    assert rows(sync.dedup_digests(blobs, stored)) == [("hot", 9, 0, 99), ("x", 1, 2, 2)]


def test_drift_uses_the_last_hop(spark, rows):
    base = spark.createDataFrame([("same", 9, "m"), ("grown", 9, "m"), ("gone", 9, "m"), ("down", 9, "m")],
                                 "url string, length long, modified string")
    probes = spark.createDataFrame(
        [("same", 0, 302, 0, None), ("same", 1, 200, 9, "m"), ("grown", 0, 200, 10, "m"),
         ("new", 0, 200, 1, "m"), ("down", 0, 200, 9, "m"), ("down", 1, 503, 0, None)],
        "url string, hop int, code int, length long, modified string",
    )
    assert rows(sync.drift(base, probes), "url", "status") == [
        ("down", "unreachable"), ("gone", "unreachable"), ("grown", "changed"), ("new", "new"), ("same", "match"),
    ]


def walk(rows, tick, after, floor):
    """Plain fold of one transfer's ``(at_s, bytes)``."""
    start = last = rows[0][0]
    got, out = 0, []
    for at, n in rows:
        got += n
        if at - last >= tick:
            last = at
            stalled = got / (at - start) < floor and at - start >= after
            out.append((at, got, stalled))
            if stalled:
                break
    return out


@pytest.mark.parametrize("chunk_rows", [4, 1 << 18])
def test_ticks_match_the_plain_fold(spark, chunk_rows):
    rng = random.Random(2)
    data, want = [], {}
    for transfer, n in [(0, 400), *[(i, rng.randint(1, 30)) for i in range(1, 9)]]:
        at, rows = 0, []
        for _ in range(n):
            at += rng.choice([0, 1, 5, 40])
            rows.append((at, rng.choice([0, 10, 2000])))
        data += [(transfer, T0 + dt.timedelta(seconds=a), i, b) for i, (a, b) in enumerate(rows)]
        want[transfer] = walk(rows, 30, 60, 40.0)
    df = spark.createDataFrame(data, "transfer long, at timestamp, seq long, bytes long").repartition(5)
    got = sync.progress_ticks(df, 30, 60, 40.0, chunk_rows)
    zero = int(T0.replace(tzinfo=dt.timezone.utc).timestamp()) * 1_000_000
    found = {k: [] for k in want}
    for r in got.orderBy("transfer", "at_us").collect():
        found[r.transfer].append(((r.at_us - zero) // 1_000_000, r.got, r.stalled))
    assert found == want
    assert any(s for ticks in want.values() for *_, s in ticks)


def test_layer_totals(spark):
    df = spark.createDataFrame([("i", 3 * 2**30), ("i", 2**29)], "image string, size long")
    assert sync.layer_totals(df, 2**31).first().asDict() == {
        "image": "i", "layers": 2, "bytes": 3 * 2**30 + 2**29, "largest": 3 * 2**30, "gib": 3.5, "over_ceiling": True,
    }
