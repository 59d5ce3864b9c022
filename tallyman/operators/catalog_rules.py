"""All rule violations of a catalog, where stopping at the first would hide the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyman.sources.catalog import parsable

# Fixed value: a digest pin.
SHA256 = r"^[0-9a-f]{64}$"
_NAMES = "array<string>"


def _rule(test: Column, code: str, detail: Column | str = "") -> Column:
    """A violation when ``test`` is true; a null test is no violation."""
    text = F.lit(detail) if isinstance(detail, str) else F.coalesce(detail, F.lit(""))
    return F.when(test, F.struct(F.lit(code).alias("code"), text.alias("detail")))


def _dataset_rules() -> Column:
    def one(d: Column, n: Column) -> Column:
        where = F.concat(F.lit("datasets["), n.cast("string"), F.lit("]"))
        return F.array(
            _rule(d["filename"].isNull(), "dataset_missing_filename", where),
            _rule(d["sha256"].isNull(), "dataset_missing_sha256", where),
            _rule(d["urls"].isNull(), "dataset_missing_urls", where),
            _rule(~d["sha256"].rlike(SHA256), "dataset_bad_sha256", where),
            _rule(F.size(d["urls"]) == 0, "dataset_empty_urls", where),
        )

    return F.flatten(F.transform(F.coalesce("datasets", F.array()), one))


def _image_rules() -> Column:
    files = F.coalesce(F.transform("datasets", lambda d: d["filename"]), F.array().cast(_NAMES))
    outputs = F.coalesce("prepare.outputs", F.array().cast(_NAMES))
    kind = F.coalesce("source.kind", F.lit("build"))
    saved = kind == "docker-save"
    prepare, media = F.col("prepare"), F.col("media")
    lazy = F.filter("datasets", lambda d: F.coalesce(d["prepare_input"], F.lit(False)))
    rules = [
        _rule(~kind.isin("build", "docker-save"), "source_kind", kind),
        _rule(saved & F.col("source.dataset").isNull(), "save_missing_dataset"),
        _rule(saved & F.col("source.tag").isNull(), "save_missing_tag"),
        _rule(
            saved & ~F.array_contains(files, F.col("source.dataset")),
            "save_unknown_dataset",
            F.col("source.dataset"),
        ),
        _rule(saved & F.col("build.args").isNotNull(), "save_with_build_section"),
        _rule(
            ~saved & (F.col("source.dataset").isNotNull() | F.col("source.tag").isNotNull()),
            "stray_source_keys",
        ),
        _rule(prepare.isNotNull() & (kind != "build"), "prepare_without_build"),
        _rule(prepare.isNotNull() & F.col("prepare.script").isNull(), "prepare_missing_script"),
        _rule(prepare.isNotNull() & F.col("prepare.outputs").isNull(), "prepare_missing_outputs"),
        _rule(F.size("prepare.outputs") == 0, "prepare_empty_outputs"),
        _rule(
            prepare.isNull() & (F.size(lazy) > 0),
            "prepare_input_without_prepare",
            F.array_join(F.transform(lazy, lambda d: d["filename"]), ", "),
        ),
        *[
            _rule(media.isNotNull() & F.col(f"media.{name}").isNull(), f"media_missing_{name}")
            for name in ("archive", "dest", "chown", "limit_kb", "max_buckets")
        ],
        _rule(
            ~F.array_contains(F.concat(files, outputs), F.col("media.archive")),
            "media_unknown_archive",
            F.col("media.archive"),
        ),
        _rule(~F.col("media.dest").startswith("/"), "media_relative_dest", F.col("media.dest")),
        _rule(
            (F.col("media.chown") != "") & ~F.contains("media.chown", F.lit(":")),
            "media_bad_chown",
            F.col("media.chown"),
        ),
        _rule(~F.col("build_minutes").rlike(r"^\d+$"), "bad_build_minutes", F.col("build_minutes")),
        _rule(F.col("run.healthcheck_timeout_s").isNotNull(), "retired_healthcheck_timeout"),
    ]
    return F.array(*rules)


def validate_catalog(catalog: DataFrame, inventory: DataFrame | None = None) -> DataFrame:
    """``(benchmark, service, code, detail)``, one row per violated rule.

    All rules but two look at one nested row, so they are one projection without a shuffle.
    With ``inventory (benchmark, service, path)`` of the image folders, prepare scripts that
    are not there (``script_not_found``) and folders without a catalog row
    (``manifest_missing``) are reported too. Lines that are no JSON are ``unparsable``, those
    with a value of a wrong type ``wrong_type``.
    """
    key = ["benchmark", "service"]
    found = F.array_compact(F.concat(_image_rules(), _dataset_rules()))
    rows = parsable(catalog).select(*key, F.inline(found))
    if "broken" in catalog.columns:
        named = F.col("benchmark").isNotNull() | F.col("service").isNotNull()
        broken = catalog.filter(F.col("broken").isNotNull()).select(
            *key,
            F.when(named, "wrong_type").otherwise("unparsable").alias("code"),
            F.col("broken").alias("detail"),
        )
        rows = rows.unionByName(broken)
    catalog = parsable(catalog)
    if inventory is None:
        return rows
    scripts = catalog.filter(F.col("prepare.script").isNotNull()).select(
        *key, F.col("prepare.script").alias("path")
    )
    absent = scripts.join(inventory.select(*key, "path"), [*key, "path"], "left_anti").select(
        *key, F.lit("script_not_found").alias("code"), F.col("path").alias("detail")
    )
    folders = inventory.select(*key).distinct().join(catalog.select(*key), key, "left_anti")
    bare = folders.select(
        *key, F.lit("manifest_missing").alias("code"), F.lit("").alias("detail")
    )
    return rows.unionByName(absent).unionByName(bare)
