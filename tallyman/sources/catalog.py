"""The artifact catalog: one nested row per image, flattened to relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Numbers that a validation rule must see as written are read as strings.
CATALOG_SCHEMA = """
benchmark string,
service string,
datasets array<struct<filename: string, sha256: string, urls: array<string>,
                      prepare_input: boolean>>,
source struct<kind: string, dataset: string, tag: string>,
prepare struct<script: string, outputs: array<string>>,
media struct<archive: string, strip: string, dest: string, chown: string, limit_kb: bigint,
             max_buckets: int, min_entries: bigint, restore_needs_media: boolean>,
build struct<args: map<string, string>>,
build_minutes string,
run struct<healthcheck: string, reachability_timeout_s: string, healthcheck_timeout_s: string>
"""

DEFAULT_TIMEOUT_S = 30


def read_catalog(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Nested catalog rows from JSON lines or Parquet, never inferring the schema.

    JSON rows have a ``broken`` column: the line, where it is no JSON or has a value of a wrong
    type. Such a value is null, and without any JSON so is the whole row.
    """
    if fmt != "json":
        return spark.read.schema(CATALOG_SCHEMA).format(fmt).load(path)
    schema = T.StructType.fromDDL(CATALOG_SCHEMA).add("broken", T.StringType())
    item = F.from_json("value", schema, {"columnNameOfCorruptRecord": "broken"})
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(item.alias("item")).select("item.*")


def parsable(catalog: DataFrame) -> DataFrame:
    """The rows that are an image: all but lines without any JSON."""
    if "broken" not in catalog.columns:
        return catalog
    lost = F.col("broken").isNotNull() & F.col("benchmark").isNull() & F.col("service").isNull()
    return catalog.filter(~lost)


def catalog_tables(catalog: DataFrame) -> dict[str, DataFrame]:
    """``images``, ``datasets``, ``dataset_urls``, ``outputs``, ``build_args``, ``packing_spec``.

    Each is one pass of projections and explodes with the defaults filled in; nothing is
    shuffled, and each prunes the nested columns it does not use. Lines without any JSON are in
    none of them; ``validate_catalog`` names them.
    """
    key = ["benchmark", "service"]
    catalog = parsable(catalog)
    images = catalog.select(
        *key,
        F.concat_ws("-", "benchmark", "service").alias("name"),
        F.coalesce("source.kind", F.lit("build")).alias("source_kind"),
        F.col("source.dataset").alias("source_dataset"),
        F.col("source.tag").alias("source_tag"),
        F.col("prepare.script").alias("prepare_script"),
        F.expr("try_cast(build_minutes AS int)").alias("build_minutes"),
        F.col("run.healthcheck").alias("healthcheck"),
        F.coalesce(
            F.expr("try_cast(run.reachability_timeout_s AS int)"), F.lit(DEFAULT_TIMEOUT_S)
        ).alias("reachability_timeout_s"),
    )
    datasets = catalog.select(*key, F.posexplode("datasets").alias("position", "d")).select(
        *key,
        "position",
        "d.filename",
        "d.sha256",
        F.coalesce("d.prepare_input", F.lit(False)).alias("prepare_input"),
    )
    urls = (
        catalog.select(*key, F.explode("datasets").alias("d"))
        .select(*key, "d.filename", F.posexplode("d.urls").alias("url_idx", "url"))
    )
    outputs = catalog.select(*key, F.posexplode("prepare.outputs").alias("position", "output"))
    args = catalog.select(*key, F.explode("build.args").alias("arg", "value"))
    spec = catalog.filter(F.col("media").isNotNull()).select(
        *key,
        "media.archive",
        F.trim(F.coalesce("media.strip", F.lit("")), F.lit("/")).alias("strip"),
        F.rtrim("media.dest", F.lit("/")).alias("dest"),
        "media.chown",
        "media.limit_kb",
        "media.max_buckets",
        F.coalesce("media.min_entries", F.lit(0).cast("long")).alias("min_entries"),
        F.coalesce("media.restore_needs_media", F.lit(False)).alias("restore_needs_media"),
    )
    return {
        "images": images,
        "datasets": datasets,
        "dataset_urls": urls,
        "outputs": outputs,
        "build_args": args,
        "packing_spec": spec,
    }
