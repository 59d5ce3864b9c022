"""Which pinned datasets must be fetched, given what is on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyman.operators.integrity import verify_pins
from tallyman.operators.select import lazy_split
from tallyman.sources import catalog_tables


def plan_fetch(catalog: DataFrame, files: DataFrame, prepare_inputs: bool = False) -> DataFrame:
    """``(filename, expected, actual, status, action)`` per distinct pinned dataset.

    ``files (filename, sha256)`` is an inventory. Datasets only a prepare step reads are left
    out unless ``prepare_inputs`` asks for exactly them. A verified file is used as it is, a
    missing one fetched, and one with another digest quarantined before it is fetched again.
    """
    datasets = lazy_split(catalog_tables(catalog)["datasets"], prepare_inputs)
    pins = datasets.select("filename", "sha256").distinct()
    action = (
        F.when(F.col("status") == "verified", "use")
        .when(F.col("status") == "missing", "fetch")
        .otherwise("quarantine_and_fetch")
    )
    return verify_pins(pins, files, "filename").withColumn("action", action)
