"""Arriving blobs held against a store, batch by batch.

Each micro-batch is one folder of first arrivals and one of Bloom bits, named by its number and
written anew when it is repeated; it reads only what earlier batches wrote. A digest whose bits
aren't all set is new without a look into the store; the others are looked up exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyman.operators.sync import dedup_digests
from tallyman.session import broadcast_if_small, stage

#: Bits of the Bloom filter, for about a tenth as many digests, and bits set by each.
BLOOM_BITS = 1 << 24
BLOOM_HASHES = 4
_BITS = T.StructType([T.StructField(n, T.LongType()) for n in ("slot", "bits", "batch")])


def _places(digests: DataFrame, bits: int) -> DataFrame:
    """``(digest, slot, bit)``: the bits of each digest."""
    place = [F.pmod(F.xxhash64(F.lit(j), "digest"), F.lit(bits)) for j in range(BLOOM_HASHES)]
    each = digests.select("digest", F.explode(F.array_distinct(F.array(*place))).alias("place"))
    one = F.expr("shiftleft(1L, CAST(place & 63 AS INT))")
    return each.select("digest", F.shiftright("place", 6).alias("slot"), one.alias("bit"))


def bloom_bits(digests: DataFrame, bits: int = BLOOM_BITS) -> DataFrame:
    """``(slot, bits)``: a Bloom filter as rows of 64 bits, so that it has no size limit."""
    return _places(digests, bits).groupBy("slot").agg(F.bit_or("bit").alias("bits"))


def maybe_in(digests: DataFrame, bloom: DataFrame, bits: int = BLOOM_BITS) -> DataFrame:
    """The digests all of whose bits are set in ``bloom (slot, bits)``: all that are in it, and few others."""
    merged = bloom.groupBy("slot").agg(F.bit_or("bits").alias("bits"))
    met = _places(digests, bits).join(merged, "slot", "left")
    missing = F.coalesce(F.col("bits").bitwiseAND(F.col("bit")), F.lit(0).cast("long")) == 0
    return met.groupBy("digest").agg(F.max(missing).alias("missing")).filter(~F.col("missing")).select("digest")


class StoredDedup:
    """First arrivals ``(digest, size, seq, copies, fresh)`` of digests that ``stored`` doesn't hold.

    ``take`` is called for each micro-batch of ``(digest, size, seq)``; a repeated number replaces
    what it wrote. ``fresh`` rows are to be stored, the others add to the copies of
    an earlier batch. Null digests are never stored and never fresh; they are left out.
    """

    def __init__(self, spark: SparkSession, stored: DataFrame, path: str, bits: int = BLOOM_BITS):
        self.spark, self.path, self.bits = spark, path, bits
        self.stored = stored.select("digest").filter("digest IS NOT NULL")
        # Batch -1 is the store itself, written anew at each start.
        self._keep(bloom_bits(self.stored, bits), "bloom", -1)

    def _keep(self, df: DataFrame, name: str, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={number}")

    def _arrivals(self, schema: T.StructType) -> DataFrame:
        self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{self.path}/arrivals/batch=-1")
        named = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
        return self.spark.read.schema(named).parquet(f"{self.path}/arrivals")

    def take(self, batch: DataFrame, number: int) -> None:
        arrived = stage(dedup_digests(batch.filter("digest IS NOT NULL")), "arrived")
        kept = T.StructType([*arrived.schema.fields, T.StructField("fresh", T.BooleanType())])
        before = self._arrivals(kept).filter((F.col("batch") < number) & F.col("fresh")).select("digest")
        bloom = self.spark.read.schema(_BITS).parquet(f"{self.path}/bloom").filter(F.col("batch") < number)
        maybe = broadcast_if_small(stage(maybe_in(arrived, bloom, self.bits), "maybe"))
        # The store is filtered where it is read; only what it shares with the batch goes on.
        known = self.stored.join(maybe, "digest", "left_semi").distinct().withColumn("status", F.lit("stored"))
        earlier = before.join(maybe, "digest", "left_semi").withColumn("status", F.lit("earlier"))
        found = known.unionByName(earlier).groupBy("digest").agg(F.max("status").alias("status"))
        told = arrived.join(found, "digest", "left").filter(F.col("status").isNull() | (F.col("status") == "earlier"))
        rows = stage(told.withColumn("fresh", F.col("status").isNull()).drop("status"), "told")
        self._keep(rows, "arrivals", number)
        self._keep(bloom_bits(rows.filter("fresh"), self.bits), "bloom", number)

    def result(self, schema: T.StructType) -> DataFrame:
        """One row per new digest of all batches: that with the smallest ``seq``, and how many copies came."""
        kept = T.StructType([*schema.fields, *T.StructType.fromDDL("copies long, fresh boolean").fields])
        rows = self._arrivals(kept).filter("batch >= 0")
        return rows.groupBy("digest").agg(
            F.min_by("size", "seq").alias("size"), F.min("seq").alias("seq"), F.sum("copies").alias("copies")
        )


def drain_against_store(
    blobs: DataFrame, stored: DataFrame, path: str, checkpoint: str, bits: int = BLOOM_BITS
) -> DataFrame:
    """Run a stream ``(digest, size, seq)`` over what it has and give all new digests so far.

    With the same ``path`` and ``checkpoint`` a later call goes on where the last one stopped.
    """
    work = StoredDedup(blobs.sparkSession, stored, path, bits)
    blobs = blobs.select("digest", "size", "seq")
    query = blobs.writeStream.foreachBatch(work.take).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query.start().awaitTermination()
    return work.result(blobs.schema)
