"""Identity of input sets, reuse of derived artifacts and decisions against a lock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STAMP_SCHEMA = """
script_sha256 string, outputs map<string, bigint>, prepare_input_sha256 string,
prepare_inputs_digest string, _corrupt string
"""


def input_set_digest(datasets: Column | str = "datasets") -> Column:
    """Order-independent digest of an image's prepare inputs; null when there are fewer than 2.

    The datasets are an array in the image's own row, so this needs no shuffle.
    """
    lines = F.transform(
        F.filter(datasets, lambda d: F.coalesce(d["prepare_input"], F.lit(False))),
        lambda d: F.concat(d["filename"], F.lit(":"), d["sha256"]),
    )
    return F.when(
        F.size(lines) >= 2, F.sha2(F.array_join(F.array_sort(lines), "\n").cast("binary"), 256)
    )


def reuse_reason(current: DataFrame, stamps: DataFrame) -> DataFrame:
    """``(image, reason, detail)``: why derived outputs cannot be reused; null when they can.

    ``current`` holds ``image, script_sha256, outputs array<struct<name, size>>`` (size null
    when the output is absent, else the sum of its parts), ``prepare_input_sha256`` and
    ``prepare_inputs_digest``; ``stamps`` holds ``image, stamp`` as JSON text. Checks run in
    a fixed order and compare null-safe: neither side having a pin is agreement.
    """
    recorded = stamps.select(
        "image",
        F.lit(True).alias("stamped"),
        F.from_json("stamp", STAMP_SCHEMA, {"columnNameOfCorruptRecord": "_corrupt"}).alias("was"),
    )
    absent = F.transform(
        F.filter("outputs", lambda o: o["size"].isNull()), lambda o: o["name"]
    )
    resized = F.filter(
        "outputs",
        lambda o: ~o["size"].eqNullSafe(F.try_element_at(F.col("was.outputs"), o["name"])),
    )
    first = F.try_element_at(resized, F.lit(1))
    old_size = F.try_element_at(F.col("was.outputs"), first["name"])
    same = lambda name: F.col(name).eqNullSafe(F.col(f"was.{name}"))
    reason = (
        F.when(F.size(absent) > 0, "missing_outputs")
        .when(F.col("stamped").isNull(), "no_stamp")
        .when(F.col("was").isNull() | F.col("was._corrupt").isNotNull(), "unreadable_stamp")
        .when(~same("script_sha256"), "script_changed")
        .when(~same("prepare_input_sha256"), "pin_changed")
        .when(~same("prepare_inputs_digest"), "pin_set_changed")
        .when(F.size(resized) > 0, "output_size_changed")
    )
    detail = (
        F.when(F.col("reason") == "missing_outputs", F.array_join(absent, ", "))
        .when(
            F.col("reason") == "output_size_changed",
            F.concat(
                first["name"],
                F.lit(" is "),
                first["size"].cast("string"),
                F.lit(" bytes, was "),
                F.coalesce(old_size.cast("string"), F.lit("unknown")),
            ),
        )
    )
    return (
        current.join(recorded, "image", "left")
        .withColumn("reason", reason)
        .select("image", "reason", detail.alias("detail"))
    )


def lock_decision(
    refs: DataFrame,
    lock: DataFrame,
    resolved: DataFrame,
    allow_mismatch: bool = False,
    allow_miss: bool = False,
) -> DataFrame:
    """``(ref, decision, warned, reason)`` with decision ``pull``, ``derive`` or ``fatal``.

    ``lock (ref, digest)`` holds each ref once; ``resolved (ref, is_artifact, digest)`` has
    a row per ref whose manifest was found. The two waivers are separate: one lets a moved
    digest pass with a warning, the other a pinned ref that is gone.
    """
    pins = lock.select("ref", F.col("digest").alias("pin"), F.lit(True).alias("pinned"))
    found = resolved.select(
        "ref", "is_artifact", F.col("digest").alias("got"), F.lit(True).alias("found")
    )
    rows = refs.select("ref").join(pins, "ref", "left").join(found, "ref", "left")
    pinned, hit = F.col("pinned").isNotNull(), F.col("found").isNotNull()
    reason = (
        F.when(hit & ~F.coalesce("is_artifact", F.lit(False)), "not_an_artifact")
        .when(hit & ~pinned, "unpinned")
        .when(hit & F.col("pin").isNull(), "pinned_without_digest")
        .when(hit & (F.col("pin") == F.col("got")), "digest_matches")
        .when(hit, "digest_moved")
        .when(pinned, "pinned_but_missing")
        .otherwise("not_cached")
    )
    waived = (
        (F.col("reason") == "digest_moved") & F.lit(allow_mismatch)
    ) | ((F.col("reason") == "pinned_but_missing") & F.lit(allow_miss))
    decision = (
        F.when(F.col("reason").isin("unpinned", "pinned_without_digest", "digest_matches"), "pull")
        .when(F.col("reason") == "not_cached", "derive")
        .when(waived & (F.col("reason") == "digest_moved"), "pull")
        .when(waived, "derive")
        .otherwise("fatal")
    )
    return rows.withColumn("reason", reason).select(
        "ref", decision.alias("decision"), waived.alias("warned"), "reason"
    )
