"""Planning transfers, and deciding what a registry or a mirror holds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyman.operators.jumps import Chain, chain_of_cuts
from tallyman.operators.ordered import CHUNK_ROWS, ordered_chunks
from tallyman.session import stage

# What a registry answers for something never published, and its limits.
UNPUBLISHED_CODES = (401, 403, 404)
GIB = 2**30
TRIES_PER_URL = 3
STALL_TICK_S = 30
STALL_AFTER_S = 60
STALL_BYTES_PER_S = 102_400


def transfer_plan(layers: DataFrame, local: DataFrame) -> DataFrame:
    """``(ref, title, action, offset, bytes_left)`` for layers against local files.

    ``layers (ref, title, digest, size)``, ``local (ref, title, have, have_digest)``. The
    digest is consulted only when the length is right: ``skip`` if it matches, ``restart``
    if not; ``restart`` too when the file is longer. Shorter files ``resume`` at their
    length; absent or empty ones are ``fetch``.
    """
    have = F.coalesce("have", F.lit(0).cast("long"))
    complete = (F.col("have") == F.col("size")) & (F.col("digest") == F.col("have_digest"))
    action = (
        F.when(complete, "skip")
        .when(have == 0, "fetch")
        .when(have < F.col("size"), "resume")
        .otherwise("restart")
    )
    offset = F.when(F.col("action") == "resume", have).otherwise(F.lit(0).cast("long"))
    left = F.when(F.col("action") == "skip", F.lit(0).cast("long")).otherwise(
        F.col("size") - offset
    )
    return (
        layers.join(local, ["ref", "title"], "left")
        .withColumn("action", action)
        .select("ref", "title", "action", offset.alias("offset"), left.alias("bytes_left"))
    )


def resolve_attempts(attempts: DataFrame, tries_per_url: int = TRIES_PER_URL) -> DataFrame:
    """``(dataset, status, url_idx, attempt, errors, ignored)`` from download attempts.

    ``attempts (dataset, url_idx, attempt, outcome, error)``, outcome ``fetch_error``,
    ``sha_mismatch`` or ``ok``. URLs count in order, ``tries_per_url`` tries each; attempts
    beyond these (or without a number) decide nothing, and ``ignored`` counts them. The first try that is
    not a fetch error decides: ``verified`` or ``fatal`` (a wrong digest is never retried
    elsewhere). With none the dataset is ``exhausted``, its errors joined in order.

    The deciding try is a ``min``; only exhausted datasets gather their errors, at most
    ``tries_per_url`` per URL.
    """
    counts = F.coalesce(F.col("attempt").between(1, tries_per_url), F.lit(False))
    tried = attempts.filter(counts)
    at = F.struct("url_idx", "attempt")
    decides = F.col("outcome") != "fetch_error"
    verdict = attempts.groupBy("dataset").agg(
        F.min(F.when(counts & decides, F.struct("url_idx", "attempt", "outcome"))).alias("won"),
        F.count(F.when(~counts, 1)).alias("ignored"),
    )
    lost = verdict.filter(F.col("won").isNull()).select("dataset")
    errors = (
        tried.join(lost, "dataset", "left_semi")
        .groupBy("dataset")
        .agg(F.array_sort(F.collect_list(F.struct(at.alias("at"), F.col("error").alias("e")))).alias("all"))
        .select("dataset", F.array_join(F.transform("all", lambda x: x["e"]), "; ").alias("errors"))
    )
    return verdict.join(errors, "dataset", "left").select(
        "dataset",
        F.when(F.col("won").isNull(), "exhausted")
        .when(F.col("won.outcome") == "ok", "verified")
        .otherwise("fatal")
        .alias("status"),
        F.col("won.url_idx").alias("url_idx"),
        F.col("won.attempt").alias("attempt"),
        "errors",
        "ignored",
    )


def pick_manifest(entries: DataFrame) -> DataFrame:
    """``(image, digest, status)`` from index entries ``(image, position, digest, os, arch)``.

    Entries of architecture ``unknown`` are attestations and never picked. linux/amd64 wins
    over the first listed; an index with nothing left is ``unavailable``. One partial
    aggregate per image, so a huge index is no hot key.
    """
    usable = ~F.col("arch").eqNullSafe(F.lit("unknown"))
    native = F.coalesce((F.col("arch") == "amd64") & (F.col("os") == "linux"), F.lit(False))
    best = F.min(
        F.when(usable, F.struct((~native).alias("other"), F.col("position"), F.col("digest")))
    )
    return (
        entries.groupBy("image")
        .agg(best.alias("pick"))
        .select(
            "image",
            F.col("pick.digest").alias("digest"),
            F.when(F.col("pick").isNull(), "unavailable").otherwise("picked").alias("status"),
        )
    )


def published_state(images: DataFrame, answers: DataFrame) -> DataFrame:
    """``(image, state, revision)``: published, unpublished or unavailable.

    ``answers (image, code, labels map)``. 401, 403 and 404 mean nothing is published; any
    other error, or no answer, means it could not be asked. A published image without the
    label has a null revision, which is not the same as being unpublished.
    """
    return images.select("image").join(answers, "image", "left").select(
        "image",
        F.when(F.col("code") == 200, "published")
        .when(F.col("code").isin(*UNPUBLISHED_CODES), "unpublished")
        .otherwise("unavailable")
        .alias("state"),
        F.when(
            F.col("code") == 200,
            F.try_element_at("labels", F.lit("org.opencontainers.image.revision")),
        ).alias("revision"),
    )


def dedup_digests(blobs: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """One row per digest not already stored, the one with the smallest ``seq``.

    Copies collapse in each task before the shuffle, so a digest held by a third of the
    rows moves one row per task. Columns ``(digest, size, seq, copies)``.
    """
    first = blobs.groupBy("digest").agg(
        F.min_by("size", "seq").alias("size"),
        F.min("seq").alias("seq"),
        F.count(F.lit(1)).alias("copies"),
    )
    return first if stored is None else first.join(stored.select("digest"), "digest", "left_anti")


def drift(baseline: DataFrame, probes: DataFrame) -> DataFrame:
    """``(url, status, ...)``: match, changed, unreachable or new, per URL.

    ``baseline (url, length, modified)``; ``probes (url, hop, code, length, modified)``, one
    row per response of a redirect chain. Only the last hop speaks for the file, since a
    redirect answers with length zero. A baseline URL without a good last answer is
    ``unreachable``, neither changed nor unchanged.
    """
    last = (
        probes.groupBy("url")
        .agg(F.max_by(F.struct("code", "length", "modified"), "hop").alias("p"))
        .select("url", F.when(F.col("p.code") == 200, F.col("p")).alias("p"))
    )
    known = baseline.select("url", F.struct("length", "modified").alias("b"))
    rows = known.join(last, "url", "full")
    same = F.col("b.length").eqNullSafe(F.col("p.length")) & F.col("b.modified").eqNullSafe(
        F.col("p.modified")
    )
    return rows.select(
        "url",
        F.when(F.col("p").isNull(), "unreachable")
        .when(F.col("b").isNull(), "new")
        .when(same, "match")
        .otherwise("changed")
        .alias("status"),
        F.col("b.length").alias("was_length"),
        F.col("p.length").alias("length"),
    )


def ticking(tick_s: int) -> Chain:
    """Ticks of a transfer: the first row at least ``tick_s`` after the tick before."""

    def places(columns, upto):
        at = columns["at_us"]
        return at, at, np.ones(len(at), bool)

    return Chain(reads=("at_us",), places=places, reach=max(tick_s * 1_000_000, 1) - 1, weight="bytes")


def progress_ticks(
    progress: DataFrame,
    tick_s: int = STALL_TICK_S,
    after_s: int = STALL_AFTER_S,
    min_bytes_per_s: float = STALL_BYTES_PER_S,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Report ticks per transfer: ``(transfer, at_us, elapsed_us, got, rate, stalled)``.

    ``progress (transfer, at, seq, bytes)`` are byte increments; the first row starts the
    clock. A tick falls on the first row at least ``tick_s`` after the one before. The rate
    is the mean since the start. A tick below the rate once ``after_s`` have passed is a
    stall, and ends the transfer. Ticks depend on times alone, so they are a chain of
    cuts; rates need the start and a running sum, and the first stall is a minimum.
    """
    rows = progress.select(
        "transfer", F.unix_micros("at").alias("at_us"), "seq", F.col("bytes").cast("long")
    )
    chunked = ordered_chunks(rows, ["transfer", "at_us", "seq"], chunk_rows, "progress")
    marked = chain_of_cuts(chunked, ["transfer"], ticking(tick_s), ("at_us", "seq", "bytes")).filter("first OR cut")
    begun = marked.filter("first").select(
        F.col("transfer").alias("t"), F.col("at_us").alias("started"), (F.col("upto") - F.col("bytes")).alias("base")
    )
    elapsed, got = F.col("at_us") - F.col("started"), F.col("upto") - F.col("base")
    rate = F.when(elapsed > 0, got * F.lit(1_000_000.0) / elapsed).otherwise(F.lit(float("inf")))
    ticks = (
        marked.filter("cut")
        .join(begun, F.col("transfer").eqNullSafe(F.col("t")))
        .select("transfer", "at_us", "nth", elapsed.alias("elapsed_us"), got.alias("got"), rate.alias("rate"))
        .withColumn("stalled", (F.col("rate") < min_bytes_per_s) & (F.col("elapsed_us") >= after_s * 1_000_000))
    )
    ticks = stage(ticks, "ticks")
    ends = ticks.filter("stalled").groupBy("transfer").agg(F.min("nth").alias("end")).withColumnRenamed("transfer", "t")
    return (
        ticks.join(ends, F.col("transfer").eqNullSafe(F.col("t")), "left")
        .filter(F.col("end").isNull() | (F.col("nth") <= F.col("end")))
        .select("transfer", "at_us", "elapsed_us", "got", "rate", "stalled")
    )


def stalled(progress: DataFrame, **settings) -> DataFrame:
    """The stall of each stalled transfer; see :func:`progress_ticks`."""
    return progress_ticks(progress, **settings).filter("stalled").drop("stalled")


def layer_totals(layers: DataFrame, ceiling: int) -> DataFrame:
    """Per image: layers, bytes, GiB, the largest layer, and whether it is over ``ceiling``."""
    return (
        layers.groupBy("image")
        .agg(
            F.count(F.lit(1)).alias("layers"),
            F.sum("size").alias("bytes"),
            F.max("size").alias("largest"),
        )
        .withColumn("gib", F.round(F.col("bytes") / F.lit(GIB), 6))
        .withColumn("over_ceiling", F.col("largest") > F.lit(ceiling))
    )

