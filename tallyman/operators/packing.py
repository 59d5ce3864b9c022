"""Assigning pieces and archive entries to size-bounded buckets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyman.functions import components, entry_cost
from tallyman.operators.jumps import Chain, chain_of_cuts
from tallyman.operators.ordered import CHUNK_ROWS, Fold, ordered_chunks, run_fold


class _Room:
    """Free bytes per bucket in a max-tree: lowest bucket with room in O(log buckets)."""

    def __init__(self, limit: int, buckets: int, used: tuple[int, ...]):
        self.limit, self.open, self.width = limit, len(used), 1
        while self.width < max(buckets, 1):
            self.width *= 2
        self.best = [-1] * (2 * self.width)
        for i in range(buckets):
            self.best[self.width + i] = limit - used[i] if i < len(used) else limit
        for i in range(self.width - 1, 0, -1):
            self.best[i] = max(self.best[2 * i], self.best[2 * i + 1])

    def find(self, size: int) -> int:
        if self.best[1] < size:
            return -1
        at = 1
        while at < self.width:
            at *= 2
            if self.best[at] < size:
                at += 1
        return at - self.width

    def take(self, bucket: int, nbytes: int) -> None:
        best, at = self.best, self.width + bucket
        best[at] -= nbytes
        while at > 1:
            at //= 2
            best[at] = max(best[2 * at], best[2 * at + 1])
        self.open = max(self.open, bucket + 1)

    def free(self, bucket: int) -> int:
        return self.best[self.width + bucket]

    def widest_before(self, bucket: int) -> int:
        """The most free bytes in any bucket below ``bucket``; -1 without one."""
        at, widest = self.width + bucket, -1
        while at > 1:
            if at % 2:
                widest = max(widest, self.best[at - 1])
            at //= 2
        return widest

    def used(self) -> tuple[int, ...]:
        return tuple(self.limit - self.free(i) for i in range(self.open))


def first_fit(limit: int, max_buckets: int) -> Fold:
    """First-fit over ``bytes``; the state is the bytes used per open bucket.

    Pieces are placed one by one only where something happens: one that fits an earlier
    bucket, or one that does not fit the newest. The run between two such pieces goes to
    the newest bucket, or with every bucket full to none, by array arithmetic.
    """

    def step(state, columns):
        sizes = columns["bytes"]
        n = len(sizes)
        spots = np.full(n, -1, dtype=np.int64)
        room = _Room(limit, max_buckets, state)
        i, look = 0, 16
        while i < n:
            size = int(sizes[i])
            spot = room.find(size)
            if spot >= 0:
                room.take(spot, size)
                spots[i] = spot
            i += 1
            ahead = sizes[i : i + look]
            if spot < 0:
                # Nothing has room for this size: pass over all that is too large.
                hits = np.flatnonzero(ahead <= room.best[1])
                run = int(hits[0]) if len(hits) else len(ahead)
            else:
                newest = room.open - 1
                hits = np.flatnonzero(ahead <= room.widest_before(newest))
                run = int(hits[0]) if len(hits) else len(ahead)
                upto = np.cumsum(ahead[:run])
                run = int(np.searchsorted(upto, room.free(newest), side="right"))
                if run:
                    room.take(newest, int(upto[run - 1]))
                    spots[i : i + run] = newest
            i += run
            look = min(2 * look, 1 << 16) if run == len(ahead) else max(16, 2 * run)
        return room.used(), np.arange(n), {"spot": spots}

    def skip(state, chunk):
        """A chunk lands whole in one bucket when nothing in it fits an earlier one."""
        used = list(state)
        for bucket, taken in enumerate(used):
            if taken + chunk["least"] <= limit:
                if taken + chunk["total"] > limit:
                    return None
                used[bucket] += chunk["total"]
                return tuple(used)
        if len(used) == max_buckets:
            return tuple(used)
        if chunk["total"] > limit:
            return None
        return (*used, chunk["total"])

    return Fold(
        init=(),
        reads=("bytes",),
        step=step,
        output="spot long",
        carry=("path", "bytes"),
        skip=skip,
        summary=(F.sum("bytes").alias("total"), F.min("bytes").alias("least")),
    )


def _placed(folded: DataFrame, *columns: str | Column) -> DataFrame:
    """A fold's ``spot`` as ``bucket`` and ``status``; a negative spot is an overflow."""
    found = F.col("spot") >= 0
    return folded.select(
        *columns,
        F.when(found, F.col("spot")).cast("int").alias("bucket"),
        F.when(found, "ok").otherwise("overflow").alias("status"),
    )


def pack_first_fit(
    pieces: DataFrame, limit: int, max_buckets: int, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Pieces in tree order, each to the lowest bucket with room, else to a new one.

    ``(root, path, bytes, bucket, status)``. A piece no bucket can take once ``max_buckets``
    are open is ``overflow``; pieces that arrive with a status other than ``ok`` keep it
    and take no bucket; one larger than ``limit`` is an ``oversize_file``. Tree order compares
    paths component by component.
    """
    status = F.when((F.col("status") == "ok") & (F.col("bytes") > limit), "oversize_file")
    pieces = pieces.withColumn("status", F.coalesce(status, "status"))
    good = pieces.filter(F.col("status") == "ok").select("root", "path", "bytes")
    chunked = ordered_chunks(good, ["root", components("path")], chunk_rows, "pieces")
    refused = pieces.filter(F.col("status") != "ok").select(
        "root", "path", "bytes", F.lit(None).cast("int").alias("bucket"), "status"
    )
    folded = run_fold(chunked, ["root"], first_fit(limit, max_buckets))
    return _placed(folded, "root", "path", "bytes").unionByName(refused)


def next_fit(limit: int) -> Chain:
    """Forward-only buckets over ``cost``; only rows with ``rolls`` open a new one.

    A row opens the next bucket if the bucket holds something already and would hold more than
    ``limit`` with it: if what lies before it is over the bucket's begin, and what lies up to
    it is over begin plus limit.
    """

    def places(columns, upto):
        return upto - columns["cost"], upto, columns["rolls"].astype(bool)

    return Chain(reads=("cost", "rolls"), places=places, reach=limit, weight="cost")


def pack_next_fit(
    entries: DataFrame, limit: int, max_buckets: int, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Archive entries in ``seq`` order; a file that would overflow opens the next bucket.

    Directories and links stay in the current bucket whatever it holds, and a file larger
    than the limit takes a bucket that is still empty. ``(root, seq, path, kind, bytes,
    bucket, status)``; from the entry that needs bucket ``max_buckets`` on, every entry is
    ``overflow`` without a bucket.
    """
    costed = entries.select(
        "root",
        "seq",
        "path",
        "kind",
        entry_cost(F.col("size"), F.col("kind")).alias("cost"),
        (F.col("kind") == "file").alias("rolls"),
    )
    chunked = ordered_chunks(costed, ["root", "seq"], chunk_rows, "archive")
    placed = chain_of_cuts(chunked, ["root"], next_fit(limit), ("seq", "path", "kind", "cost"))
    spot = F.when(F.col("nth") < max_buckets, F.col("nth")).otherwise(-1)
    return _placed(placed.withColumn("spot", spot), "root", "seq", "path", "kind", F.col("cost").alias("bytes"))


def shard_by_key(
    df: DataFrame, key: str, size: str, limit: int, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """``(key, bytes, shard)``: key-ordered shards of at most ``limit`` bytes.

    A key's rows never split; a key over the limit is a shard of its own.
    """
    per_key = df.groupBy(F.col(key)).agg(F.sum(size).cast("long").alias("cost"))
    rows = per_key.select(
        F.lit("table").alias("root"), F.col(key).alias("seq"), "cost", F.lit(True).alias("rolls")
    )
    chunked = ordered_chunks(rows, ["seq"], chunk_rows, "shards")
    placed = chain_of_cuts(chunked, ["root"], next_fit(limit), ("seq", "cost"))
    return placed.select(
        F.col("seq").alias(key), F.col("cost").alias("bytes"), F.col("nth").alias("shard")
    )


def top_directories(entries: DataFrame) -> DataFrame:
    """The distinct directories at the top of each root."""
    return (
        entries.filter((F.col("kind") == "dir") & (F.instr("path", "/") == 0))
        .select("root", "path")
        .distinct()
    )


def pad_unused(members: DataFrame, entries: DataFrame, max_buckets: int) -> DataFrame:
    """One row per padding member: ``(root, bucket, path, status, needed)``.

    A bucket nothing was assigned to gets every top-level directory (status ``padding``).
    A root with unused buckets and no such directory yields one ``unpaddable`` row with a
    null bucket, and ``needed`` names the bucket count that works.
    """
    used = members.filter(F.col("bucket").isNotNull()).select("root", "bucket").distinct()
    counts = used.groupBy("root").agg(F.count(F.lit(1)).cast("int").alias("needed"))
    spare = (
        counts.select(
            "root", "needed", F.explode(F.sequence(F.lit(0), F.lit(max_buckets - 1))).alias("bucket")
        )
        .join(used, ["root", "bucket"], "left_anti")
    )
    tops = top_directories(entries)
    padding = spare.join(tops, "root").select(
        "root", "bucket", "path", F.lit("padding").alias("status"), "needed"
    )
    bare = (
        counts.filter(F.col("needed") < max_buckets)
        .join(tops.select("root").distinct(), "root", "left_anti")
        .select(
            "root",
            F.lit(None).cast("int").alias("bucket"),
            F.lit(None).cast("string").alias("path"),
            F.lit("unpaddable").alias("status"),
            "needed",
        )
    )
    return padding.unionByName(bare)


def bucket_report(assigned: DataFrame, max_buckets: int) -> DataFrame:
    """Entries and bytes per bucket, how many are used, the ceiling and the root's total.

    What has no bucket is a row with a null bucket, and part of the total.
    """
    per_bucket = assigned.groupBy("root", "bucket").agg(
        F.count(F.lit(1)).alias("entries"), F.sum("bytes").alias("bytes")
    )
    per_root = per_bucket.groupBy("root").agg(
        F.count("bucket").cast("int").alias("used"), F.sum("bytes").alias("total_bytes")
    )
    return per_bucket.join(per_root, "root").select(
        "root",
        "bucket",
        "entries",
        "bytes",
        "used",
        F.lit(max_buckets).alias("ceiling"),
        "total_bytes",
    )
