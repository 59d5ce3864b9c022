"""Transfer planning and registry queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyman.operators.sync import (
    dedup_digests,
    drift,
    layer_totals,
    pick_manifest,
    progress_ticks,
    published_state,
    resolve_attempts,
    stalled,
    transfer_plan,
)
from tallyman.session import scratch_path, stage
from tallyman.streaming.stored import drain_against_store
from tallyman.workload.fixtures import events, layers, table
from tallyman.workload.registry import Workload

work = Workload()

LAYERS_SQL = """
layers AS (
  SELECT source AS ref, 'doc_' || doc_id AS title, sha256(text) AS digest,
         octet_length(encode(text))::BIGINT AS size, doc_id AS seq FROM documents)
"""


@work.query(
    "r1_transfer_plan",
    "WITH " + LAYERS_SQL + """
SELECT ref, title, action, CASE action WHEN 'resume' THEN size // 2 ELSE 0 END::BIGINT AS "offset",
       CASE action WHEN 'skip' THEN 0 WHEN 'resume' THEN size - size // 2 ELSE size END::BIGINT AS bytes_left
FROM (SELECT *, CASE seq % 6 WHEN 0 THEN 'fetch' WHEN 1 THEN CASE WHEN size < 2 THEN 'fetch' ELSE 'resume' END
                             WHEN 2 THEN 'skip' WHEN 5 THEN 'fetch' ELSE 'restart' END AS action FROM layers)
""",
)
def r1_transfer_plan(spark, sf_dir):
    wanted = layers(spark, sf_dir)
    k = F.pmod("seq", F.lit(6))
    have = (
        F.when(k == 1, F.expr("size div 2"))
        .when(k == 4, F.col("size") + 9)
        .when(k == 5, F.lit(0).cast("long"))
        .otherwise(F.col("size"))
    )
    local = wanted.filter(k != 0).select(
        "ref", "title", have.alias("have"),
        F.when(k == 2, F.col("digest")).otherwise(F.lit("other")).alias("have_digest"),
    )
    return transfer_plan(wanted, local)


@work.query(
    "r2_resolve_attempts",
    """
WITH numbered AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events),
tries AS (
  SELECT user_id AS dataset, k // 4 AS url_idx, k % 4 + 1 AS attempt, event_id,
         CASE WHEN user_id % 5 = 0 THEN 'fetch_error' ELSE CASE event_type WHEN 'purchase' THEN 'ok' WHEN 'signup' THEN 'sha_mismatch'
              ELSE 'fetch_error' END END AS outcome
  FROM numbered),
decided AS (
  SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY url_idx, attempt) AS n
  FROM tries WHERE outcome <> 'fetch_error' AND attempt <= 3)
SELECT d.dataset,
       CASE WHEN w.outcome IS NULL THEN 'exhausted' WHEN w.outcome = 'ok' THEN 'verified' ELSE 'fatal' END
         AS status,
       w.url_idx::INTEGER AS url_idx, w.attempt::INTEGER AS attempt,
       CASE WHEN w.outcome IS NULL THEN
         (SELECT string_agg('event ' || event_id, '; ' ORDER BY url_idx, attempt) FROM tries t
          WHERE t.dataset = d.dataset AND attempt <= 3) END AS errors,
       (SELECT count(*) FROM tries t WHERE t.dataset = d.dataset AND attempt > 3) AS ignored
FROM (SELECT DISTINCT dataset FROM tries) d
LEFT JOIN decided w ON w.dataset = d.dataset AND w.n = 1
""",
)
def r2_resolve_attempts(spark, sf_dir):
    # Four tries of each URL, the last of them one too many; every fifth user gets nowhere.
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    k = F.col("k")
    attempts = (
        events(spark, sf_dir)
        .withColumn("nth", F.row_number().over(order))
        .withColumn("k", F.col("nth") - 1)
        .select(
            F.col("user_id").alias("dataset"),
            F.expr("CAST(k div 4 AS int)").alias("url_idx"),
            (F.pmod(k, F.lit(4)) + 1).alias("attempt"),
            F.when(F.pmod("user_id", F.lit(5)) == 0, "fetch_error")
            .when(F.col("event_type") == "purchase", "ok")
            .when(F.col("event_type") == "signup", "sha_mismatch")
            .otherwise("fetch_error")
            .alias("outcome"),
            F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("error"),
        )
    )
    return resolve_attempts(attempts)


@work.query(
    "r3_pick_manifest",
    """
WITH entries AS (
  SELECT s_nationkey AS image, s_suppkey AS position, s_name AS digest,
         CASE s_suppkey % 5 WHEN 0 THEN 'amd64' WHEN 1 THEN 'arm64' WHEN 2 THEN 'amd64'
              WHEN 3 THEN 'unknown' END AS arch,
         CASE s_suppkey % 5 WHEN 2 THEN 'windows' ELSE 'linux' END AS os
  FROM supplier),
usable AS (
  SELECT *, row_number() OVER (
      PARTITION BY image
      ORDER BY CASE WHEN arch = 'amd64' AND os = 'linux' THEN 0 ELSE 1 END, position) AS n
  FROM entries WHERE arch IS NULL OR arch <> 'unknown')
SELECT i.image, u.digest, CASE WHEN u.image IS NULL THEN 'unavailable' ELSE 'picked' END AS status
FROM (SELECT DISTINCT image FROM entries) i LEFT JOIN usable u ON u.image = i.image AND u.n = 1
""",
)
def r3_pick_manifest(spark, sf_dir):
    k = F.pmod("s_suppkey", F.lit(5))
    arch = F.when(k.isin(0, 2), "amd64").when(k == 1, "arm64").when(k == 3, "unknown")
    entries = table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("image"),
        F.col("s_suppkey").alias("position"),
        F.col("s_name").alias("digest"),
        F.when(k == 2, "windows").otherwise("linux").alias("os"),
        arch.alias("arch"),
    )
    return pick_manifest(entries)


@work.query(
    "r4_published_state",
    """
SELECT c_name AS image,
       CASE c_custkey % 7 WHEN 0 THEN 'unpublished' WHEN 1 THEN 'unpublished' WHEN 2 THEN 'unpublished'
            WHEN 3 THEN 'unavailable' WHEN 4 THEN 'unavailable' ELSE 'published' END AS state,
       CASE c_custkey % 7 WHEN 5 THEN sha256(c_name) END AS revision
FROM customer
""",
)
def r4_published_state(spark, sf_dir):
    k = F.pmod("c_custkey", F.lit(7))
    images = table(spark, sf_dir, "customer").withColumn("image", F.col("c_name"))
    code = (
        F.when(k == 0, 401).when(k == 1, 403).when(k == 2, 404).when(k == 3, 503).otherwise(200)
    )
    labels = F.when(
        k != 6,
        F.create_map(
            F.lit("org.opencontainers.image.revision"), F.sha2(F.col("c_name").cast("binary"), 256)
        ),
    )
    answers = images.filter(k != 4).select("image", code.alias("code"), labels.alias("labels"))
    return published_state(images, answers)


@work.query(
    "r5_dedup_digests",
    "WITH " + LAYERS_SQL + """
SELECT digest, size, min(seq) AS seq, count(*)::BIGINT AS copies FROM layers
WHERE digest NOT IN (SELECT digest FROM layers WHERE seq % 10 = 0) GROUP BY digest, size
""",
)
def r5_dedup_digests(spark, sf_dir):
    blobs = layers(spark, sf_dir)
    stored = blobs.filter(F.pmod("seq", F.lit(10)) == 0).select("digest").distinct()
    return dedup_digests(blobs.select("digest", "size", "seq"), stored)


@work.query(
    "r5_dedup_stream",
    "WITH " + LAYERS_SQL + """
SELECT digest, size, min(seq) AS seq, count(*)::BIGINT AS copies FROM layers
WHERE digest NOT IN (SELECT digest FROM layers WHERE seq % 10 = 0) GROUP BY digest, size
""",
)
def r5_dedup_stream(spark, sf_dir):
    """The same with blobs that arrive in three batches, the last after a restart."""
    # Texts are read and hashed once; every task then writes its own rows of a part.
    blobs = stage(layers(spark, sf_dir).select("digest", "size", "seq"), "blobs")
    stored = blobs.filter(F.pmod("seq", F.lit(10)) == 0).select("digest").distinct()
    stored = stage(stored, "stored")
    arriving, path, checkpoint = (scratch_path(spark, n) for n in ("arriving", "deduped", "deduped-state"))
    for parts in ((0, 1), (2,)):
        files = 1
        for n in parts:
            blobs.filter(F.pmod("seq", F.lit(3)) == n).write.parquet(f"{arriving}/{n}")
            files = max(files, len(spark.read.schema(blobs.schema).parquet(f"{arriving}/{n}").inputFiles()))
        # As many files a batch as the larger part has: a batch for each part, oldest files first.
        stream = spark.readStream.schema(blobs.schema).option("maxFilesPerTrigger", files)
        stream = stream.option("recursiveFileLookup", True).parquet(arriving)
        found = drain_against_store(stream, stored, path, checkpoint, bits=1 << 20)
    return found


@work.query(
    "r6_drift",
    """
WITH e AS (
  SELECT user_id || '/' || (event_id % 3) AS url, ts, event_id, event_type,
         floor(value / 20)::BIGINT AS length, ts < TIMESTAMP '2024-01-15' AS old,
         (user_id + event_id) % 3 = 0 AND user_id % 10 = 0 AS skipped
  FROM events),
base AS (SELECT url, arg_max(length, event_id) AS length FROM e WHERE old AND NOT skipped GROUP BY url),
last AS (
  SELECT url, arg_max(length, event_id) AS length, arg_max(event_type, event_id) AS t
  FROM e WHERE NOT old GROUP BY url),
good AS (SELECT url, length FROM last WHERE t <> 'error')
SELECT coalesce(b.url, g.url) AS url,
       CASE WHEN g.url IS NULL THEN 'unreachable' WHEN b.url IS NULL THEN 'new'
            WHEN b.length = g.length THEN 'match' ELSE 'changed' END AS status,
       b.length AS was_length, g.length AS length
FROM base b FULL JOIN good g ON b.url = g.url
UNION ALL
SELECT l.url, 'unreachable', NULL, NULL FROM last l
WHERE l.url NOT IN (SELECT url FROM good) AND l.url NOT IN (SELECT url FROM base)
""",
)
def r6_drift(spark, sf_dir):
    seen = events(spark, sf_dir).select(
        F.concat_ws(
            "/", F.col("user_id").cast("string"), F.pmod("event_id", F.lit(3)).cast("string")
        ).alias("url"),
        F.col("event_id").alias("hop"),
        F.when(F.col("event_type") == "error", 503).otherwise(200).alias("code"),
        F.floor(F.col("value") / 20).cast("long").alias("length"),
        F.lit("m").alias("modified"),
        (F.col("ts") < F.lit("2024-01-15 00:00:00+00:00").cast("timestamp")).alias("old"),
        (
            (F.pmod(F.col("user_id") + F.col("event_id"), F.lit(3)) == 0)
            & (F.pmod("user_id", F.lit(10)) == 0)
        ).alias("skipped"),
    )
    baseline = (
        seen.filter(F.col("old") & ~F.col("skipped"))
        .groupBy("url")
        .agg(F.max_by("length", "hop").alias("length"), F.max_by("modified", "hop").alias("modified"))
    )
    return drift(baseline, seen.filter(~F.col("old")))


# Ticks by a recursive walk: the next tick is the first row far enough after the last one.
TICKS_SQL = """
WITH RECURSIVE log AS (
  SELECT user_id AS transfer, epoch_us(ts) AS at_us, event_id AS seq, round(value)::BIGINT AS bytes FROM events),
begun AS (SELECT transfer, min(at_us) AS t0 FROM log GROUP BY 1),
walk AS (
  SELECT transfer, t0, t0 AS at_us, false AS stop FROM begun
  UNION ALL
  SELECT w.transfer, w.t0, n.at_us,
         n.at_us - w.t0 >= 172800000000
         AND (SELECT sum(bytes) FROM log l WHERE l.transfer = w.transfer AND l.at_us <= n.at_us) * 1000000.0
             / (n.at_us - w.t0) < 0.00085
  FROM walk w, LATERAL (
    SELECT min(at_us) AS at_us FROM log l
    WHERE l.transfer = w.transfer AND l.at_us >= w.at_us + 21600000000) n
  WHERE n.at_us IS NOT NULL AND NOT w.stop),
ticks AS (
  SELECT w.transfer, w.at_us, w.at_us - w.t0 AS elapsed_us,
         (SELECT sum(bytes) FROM log l WHERE l.transfer = w.transfer AND l.at_us <= w.at_us)::BIGINT AS got,
         w.stop AS stalled
  FROM walk w WHERE w.at_us > w.t0)
"""
TICK = {"tick_s": 21_600, "after_s": 172_800, "min_bytes_per_s": 0.00085}


def progress(spark, sf_dir):
    return events(spark, sf_dir).select(
        F.col("user_id").alias("transfer"),
        F.col("ts").alias("at"),
        F.col("event_id").alias("seq"),
        F.round("value").cast("long").alias("bytes"),
    )


@work.query(
    "r7_progress_ticks",
    TICKS_SQL + "SELECT transfer, at_us, elapsed_us, got, stalled FROM ticks",
)
def r7_progress_ticks(spark, sf_dir):
    return progress_ticks(progress(spark, sf_dir), **TICK).drop("rate")


@work.query(
    "r7_stalled",
    TICKS_SQL + "SELECT transfer, at_us, elapsed_us, got FROM ticks WHERE stalled",
)
def r7_stalled(spark, sf_dir):
    return stalled(progress(spark, sf_dir), **TICK).drop("rate")


@work.query(
    "r8_layer_totals",
    "WITH " + LAYERS_SQL + """
SELECT ref AS image, count(*)::BIGINT AS layers, sum(size)::BIGINT AS bytes, max(size) AS largest,
       round(sum(size) / 1073741824.0::DOUBLE, 6) AS gib, max(size) > 20000 AS over_ceiling
FROM layers GROUP BY ref
""",
)
def r8_layer_totals(spark, sf_dir):
    return layer_totals(layers(spark, sf_dir).withColumnRenamed("ref", "image"), 20_000)
