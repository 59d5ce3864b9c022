"""Artifact manifests as layer rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the annotation that names the file a layer becomes.
TITLE_KEY = "org.opencontainers.image.title"

LAYERS = "array<struct<digest: string, size: bigint, annotations: map<string, string>>>"
MANIFEST_SCHEMA = f"layers {LAYERS}, _corrupt string"


def _title(layer: Column) -> Column:
    return F.try_element_at(layer["annotations"], F.lit(TITLE_KEY))


def manifest_layers(manifests: DataFrame, ref: str = "ref", text: str = "manifest") -> DataFrame:
    """``(ref, position, digest, size, title, status)`` for the layers that become files.

    Untitled layers are skipped. A title that is not a bare file name is ``refused``. A
    manifest without any titled layer is one ``empty_artifact`` row, and text that is not
    JSON one ``not_json`` row.
    """
    parsed = manifests.select(
        F.col(ref).alias("ref"),
        F.from_json(
            F.col(text), MANIFEST_SCHEMA, {"columnNameOfCorruptRecord": "_corrupt"}
        ).alias("m"),
    )
    titled = F.filter(
        F.transform(
            F.coalesce("m.layers", F.array().cast(LAYERS)),
            lambda layer, n: F.struct(
                n.alias("position"),
                layer["digest"].alias("digest"),
                layer["size"].alias("size"),
                _title(layer).alias("title"),
            ),
        ),
        lambda layer: F.coalesce(layer["title"], F.lit("")) != "",
    )
    rows = parsed.select("ref", F.col("m._corrupt").isNotNull().alias("bad"), titled.alias("layers"))
    bare = ~F.contains("layer.title", F.lit("/")) & ~F.col("layer.title").isin(".", "..")
    return rows.select("ref", "bad", F.explode_outer("layers").alias("layer")).select(
        "ref",
        "layer.position",
        "layer.digest",
        "layer.size",
        "layer.title",
        F.when(F.col("bad"), "not_json")
        .when(F.col("layer").isNull(), "empty_artifact")
        .when(bare, "ok")
        .otherwise("refused")
        .alias("status"),
    )
