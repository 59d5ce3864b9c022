"""What to do about cached artifacts: trust, transfer, derive or stop."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyman.operators.provenance import lock_decision
from tallyman.operators.sync import transfer_plan
from tallyman.session import stage
from tallyman.sources import TITLE_KEY, manifest_layers

__all__ = ["Pull", "TITLE_KEY", "plan_pull"]


@dataclass(frozen=True)
class Pull:
    """``decisions`` per ref and ``transfers`` per layer of the refs to pull."""

    decisions: DataFrame
    transfers: DataFrame


def plan_pull(
    refs: DataFrame, manifests: DataFrame, lock: DataFrame, local: DataFrame, **waivers: bool
) -> Pull:
    """Decide every ref against the lock, then plan the layers of those to pull.

    ``manifests (ref, manifest)`` holds the text found at each ref: its sha256 is the digest
    compared with the lock, and an ``artifactType`` in it makes it an artifact. A ref with an
    unusable manifest (``empty_artifact``, ``not_json``, ``refused``) turns ``fatal`` and
    transfers nothing.
    """
    resolved = manifests.select(
        "ref",
        F.contains("manifest", F.lit('"artifactType"')).alias("is_artifact"),
        F.concat(F.lit("sha256:"), F.sha2(F.col("manifest").cast("binary"), 256)).alias("digest"),
    )
    layers = manifest_layers(manifests)
    unusable = (
        layers.filter(F.col("status") != "ok")
        .groupBy("ref")
        .agg(F.min("status").alias("unusable"))
    )
    decided = lock_decision(refs, lock, resolved, **waivers).join(unusable, "ref", "left")
    stops = (F.col("decision") == "pull") & F.col("unusable").isNotNull()
    decisions = stage(
        decided.select(
            "ref",
            F.when(stops, "fatal").otherwise(F.col("decision")).alias("decision"),
            "warned",
            F.when(stops, F.col("unusable")).otherwise(F.col("reason")).alias("reason"),
        ),
        "decisions",
    )
    pulled = decisions.filter(F.col("decision") == "pull").select("ref")
    wanted = layers.join(pulled, "ref", "left_semi").select("ref", "title", "digest", "size")
    return Pull(decisions, transfer_plan(wanted, local))
