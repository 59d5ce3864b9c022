"""A drained stream equals the batch operator."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from tallyman.operators.audit import audit_entries
from tallyman.operators.sync import dedup_digests, stalled
from tallyman.sources import read_readings, stream_readings
from tallyman.streaming import (
    drain_appended,
    drain_updated,
    peaks_from_windows,
    resource_windows,
    running_audit,
    stall_alerts,
    unique_digests,
)
from tallyman.streaming.stored import StoredDedup, drain_against_store
from tallyman.workload import sync as sync_queries

T0 = dt.datetime(2024, 1, 1)


def as_stream(spark, df, path, files=4):
    """``df`` written as several files and read one file per micro-batch, in order."""
    for n, part in enumerate(df.randomSplit([1.0] * files, seed=1) if files > 1 else [df]):
        part.coalesce(1).write.mode("append").parquet(f"{path}/{n}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def test_running_audit(spark, tmp_path, rows):
    data = [("r", i, f"p{i}", "file", 0o4755 if i % 3 == 0 else 0o644, None) for i in range(50)]
    data += [("s", i, f"h{i}", "hardlink", 0o644, "x") for i in range(9)]
    df = spark.createDataFrame(data, "root string, seq long, path string, kind string, mode int, link_target string")
    got = drain_updated(running_audit(as_stream(spark, df, str(tmp_path))), ["root", "category"], "audit")
    assert rows(got, "root", "category", "n") == rows(audit_entries(df), "root", "category", "n")


def test_unique_digests(spark, tmp_path, rows):
    df = spark.createDataFrame([(f"d{i % 7}", i % 7, i, T0) for i in range(80)],
                               "digest string, size int, seq long, at timestamp")
    want = rows(dedup_digests(df), "digest", "size")
    assert rows(drain_appended(unique_digests(as_stream(spark, df, str(tmp_path / "a"))), "d"), "digest", "size") == want
    bounded = unique_digests(as_stream(spark, df, str(tmp_path / "b")), at="at")
    assert rows(drain_appended(bounded, "d"), "digest", "size") == want


def test_arrivals_against_a_store(spark, tmp_path, rows):
    schema = "digest string, size long, seq long"
    data = [(f"d{i % 23}", i % 23, 500 - i) for i in range(120)] + [(None, 1, 1)]
    df = spark.createDataFrame(data, schema)
    stored = spark.createDataFrame([(f"d{i}",) for i in range(0, 40, 5)] + [(None,)], "digest string")
    want = rows(dedup_digests(df.filter("digest IS NOT NULL"), stored))
    # Few bits: nearly every digest may be stored, and is looked up.
    for bits in (1 << 16, 64):
        work = StoredDedup(spark, stored, str(tmp_path / f"w{bits}"), bits)
        for n in (0, 1, 1, 2, 0, 1, 2):  # batches are repeated after a restart
            work.take(df.filter(F.col("seq") % 3 == n), n)
        assert rows(work.result(df.schema)) == want
        fresh = spark.read.parquet(str(tmp_path / f"w{bits}" / "arrivals")).filter("fresh")
        assert fresh.count() == fresh.select("digest").distinct().count() == len(want)
    stream = as_stream(spark, df, str(tmp_path / "in"))
    got = drain_against_store(stream, stored, str(tmp_path / "out"), str(tmp_path / "state"), 1 << 16)
    assert rows(got) == want


def progress(spark):
    rng = random.Random(8)
    data = []
    for transfer in range(6):
        at = 0
        for i in range(40):
            at += rng.choice([1, 20, 45])
            data.append((transfer, T0 + dt.timedelta(seconds=at), i, rng.choice([0, 50, 3000])))
    return spark.createDataFrame(data, "transfer long, at timestamp, seq long, bytes long")


def test_stall_alerts_in_order(spark, tmp_path, rows):
    df = progress(spark)
    path = str(tmp_path)
    for n in range(4):  # Each micro-batch holds the next ten rows of every transfer.
        df.filter((F.col("seq") >= 10 * n) & (F.col("seq") < 10 * n + 10)).coalesce(1).write.parquet(f"{path}/b{n}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
    got = drain_appended(stall_alerts(stream, 30, 60, 40.0), "alerts")
    want = stalled(df, tick_s=30, after_s=60, min_bytes_per_s=40.0)
    columns = ["transfer", "at_us", "elapsed_us", "got"]
    assert rows(got, *columns) == rows(want, *columns)
    assert got.count() > 0


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    schema = "transfer string, at timestamp, seq long, bytes long"
    at = lambda s: T0 + dt.timedelta(seconds=s)
    first = spark.createDataFrame([("t", at(0), 0, 5), ("t", at(40), 2, 5)], schema)
    later = spark.createDataFrame([("t", at(10), 1, 10**9), ("t", at(90), 3, 5)], schema)
    for n, df in enumerate([first, later]):
        df.coalesce(1).write.parquet(f"{tmp_path}/b{n}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/*")
    (row,) = drain_appended(stall_alerts(stream, 30, 60, 100.0), "late").collect()
    assert (row.elapsed_us, row.got, row.late, row.status) == (90_000_000, 15, 1, "stalled")


def test_what_is_over_leaves_no_state(spark, tmp_path):
    """A transfer that stalls and one that doesn't, both silent from then on, and one that goes on."""
    at = lambda s: T0 + dt.timedelta(seconds=s)
    schema = "transfer string, at timestamp, seq long, bytes long"
    batches = [
        [("slow", at(0), 0, 5), ("slow", at(90), 1, 5), ("fast", at(0), 0, 10**6), ("fast", at(50), 2, 10**6)],
        [("fast", at(10), 1, 7), ("fast", at(95), 3, 10**6)],
        [("other", at(4000), 0, 9)],
        [("slow", at(4100), 2, 5), ("other", at(4110), 1, 10**6)],
    ]
    for n, data in enumerate(batches):
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{tmp_path}/in/b{n}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    alerts = stall_alerts(stream, 30, 60, 100.0, idle_s=600, lateness="1 minute")
    query = (
        alerts.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = {(r.transfer, r.status): (r.elapsed_us, r.got, r.late) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    # The transfer that never stalls tells of its late row as well; a row after the end begins anew.
    assert got == {("slow", "stalled"): (90_000_000, 10, 0), ("fast", "ended"): (95_000_000, 3 * 10**6, 1)}
    left = spark.read.format("statestore").option("stateVarName", "clock").load(f"{tmp_path}/state")
    assert sorted(r[0] for r in left.select("key.transfer").collect()) == ["other", "slow"]


def test_resource_windows(spark, tmp_path, rows):
    def line(run, second, free):
        at = (T0 + dt.timedelta(seconds=second)).isoformat()
        return f'{{"metric":"resources","phase":"p","disk_free_gb":{free},"run":"{run}","at":"{at}"}}\n'

    (tmp_path / "a.json").write_text("".join(line("r", s, 100 - s) for s in range(0, 45, 5)))
    (tmp_path / "b.json").write_text(line("r", 61, 90) + line("other", 4000, 1))
    windows = resource_windows(stream_readings(spark, str(tmp_path), 1), "1 minute")
    stream = drain_updated(windows, ["run", "window_start"], "w")
    batch = resource_windows(read_readings(spark, str(tmp_path)), "1 minute")
    # Windows that the watermark has not passed are there as well.
    assert rows(stream) == rows(batch)
    peak = peaks_from_windows(stream).filter("run = 'r'").first()
    assert (peak.run, peak.peak_disk_gb, peak.samples) == ("r", 40, 10)


def test_arriving_parts_are_written_by_many_tasks(spark, tmp_path, monkeypatch, rows):
    docs = [(i, f"text {i % 50}", "en", "s", 7) for i in range(120)]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    table.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    paths = {}
    monkeypatch.setattr(sync_queries, "scratch_path", lambda _, name: paths.setdefault(name, f"{tmp_path}/{name}"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        got = rows(sync_queries.r5_dedup_stream(spark, str(tmp_path)), "digest", "size", "seq", "copies")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == rows(sync_queries.r5_dedup_digests(spark, str(tmp_path)), "digest", "size", "seq", "copies")
    for n in range(3):
        assert len(spark.read.parquet(f"{paths['arriving']}/{n}").inputFiles()) > 1
    batches = [p.name for p in (tmp_path / "deduped" / "bloom").iterdir() if p.is_dir()]
    assert sorted(batches) == ["batch=-1", "batch=0", "batch=1", "batch=2"]
