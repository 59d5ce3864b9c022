"""Catalog, ordering, provenance and lock queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyman.operators.catalog_rules import validate_catalog
from tallyman.operators.provenance import input_set_digest, lock_decision, reuse_reason
from tallyman.operators.select import lazy_split, order_by_cost
from tallyman.plans import plan_fetch, plan_pull
from tallyman.session import scratch_path
from tallyman.sources import catalog_tables, read_catalog, read_lock
from tallyman.workload.files import LOCK_SQL, written_lock
from tallyman.workload.fixtures import IMAGES_SQL, catalog, hex_digest, table
from tallyman.workload.registry import Workload

work = Workload()


def written_catalog(spark, sf_dir, faults=False):
    """The catalog written as JSON lines and read back with its schema."""
    path = scratch_path(spark, "catalog")
    catalog(spark, sf_dir, faults).write.json(path)
    if faults:  # lines that are cut off, and lines with a number that is none
        part = table(spark, sf_dir, "part")
        cut = part.filter("p_partkey % 40 = 31").select(F.concat(F.lit('{"benchmark": "b'), F.col("p_partkey").cast("string")))
        typed = part.filter("p_partkey % 40 = 32").select(
            F.concat(F.lit('{"benchmark":"odd","service":"s'), F.col("p_partkey").cast("string"), F.lit('","media":7}'))
        )
        cut.toDF("value").unionByName(typed.toDF("value")).write.mode("append").text(path)
    return read_catalog(spark, path)


DATASETS_SQL = "WITH " + IMAGES_SQL + """,
datasets AS (
  SELECT benchmark, service, k::INTEGER AS position, 'd' || p_partkey || '_' || k || '.tar' AS filename,
         sha256(p_name || '-' || k) AS sha256, p_partkey % 3 = 0 AND k < 2 AS prepare_input, p_partkey
  FROM images, range(0, 3) AS r(k))
"""


@work.query(
    "s1_catalog_images",
    "WITH " + IMAGES_SQL + """
SELECT benchmark, service, benchmark || '-' || service AS name, 'build' AS source_kind,
       NULL::VARCHAR AS source_dataset, NULL::VARCHAR AS source_tag, 'derive.sh' AS prepare_script,
       CASE WHEN p_partkey % 7 <> 0 THEN p_size END AS build_minutes, NULL::VARCHAR AS healthcheck,
       CASE WHEN p_partkey % 5 = 0 THEN 90 ELSE 30 END AS reachability_timeout_s
FROM images
""",
)
def s1_catalog_images(spark, sf_dir):
    return catalog_tables(written_catalog(spark, sf_dir))["images"]


@work.query("s1_catalog_datasets", DATASETS_SQL + "SELECT * EXCLUDE (p_partkey) FROM datasets")
def s1_catalog_datasets(spark, sf_dir):
    return catalog_tables(written_catalog(spark, sf_dir))["datasets"]


@work.query(
    "s1_catalog_urls",
    DATASETS_SQL + """
SELECT benchmark, service, filename, i::INTEGER AS url_idx,
       'https://' || chr((97 + i)::INTEGER) || '.example/' || p_partkey || '/' || position AS url
FROM datasets, range(0, 2) AS r(i)
""",
)
def s1_catalog_urls(spark, sf_dir):
    return catalog_tables(written_catalog(spark, sf_dir))["dataset_urls"]


@work.query(
    "s1_catalog_outputs",
    "WITH " + IMAGES_SQL
    + "SELECT benchmark, service, 0 AS position, 'out_' || p_partkey || '.tar' AS output FROM images",
)
def s1_catalog_outputs(spark, sf_dir):
    return catalog_tables(written_catalog(spark, sf_dir))["outputs"]


@work.query(
    "s1_catalog_build_args",
    "WITH " + IMAGES_SQL
    + "SELECT benchmark, service, 'BRAND' AS arg, p_brand AS \"value\" FROM images",
)
def s1_catalog_build_args(spark, sf_dir):
    return catalog_tables(written_catalog(spark, sf_dir))["build_args"]


@work.query(
    "s1_catalog_packing_spec",
    "WITH " + IMAGES_SQL + """
SELECT benchmark, service, 'out_' || p_partkey || '.tar' AS archive, 'pub/media' AS strip,
       '/opt/x' AS dest, 'app:app' AS chown, p_size::BIGINT * 1024 AS limit_kb,
       (p_partkey % 14 + 1)::INTEGER AS max_buckets,
       CASE WHEN p_partkey % 2 = 0 THEN p_partkey ELSE 0 END AS min_entries,
       false AS restore_needs_media
FROM images
""",
)
def s1_catalog_packing_spec(spark, sf_dir):
    return catalog_tables(written_catalog(spark, sf_dir))["packing_spec"]


@work.query(
    "f2_lazy_split",
    DATASETS_SQL + """
SELECT filename, prepare_input, CASE WHEN prepare_input THEN 'lazy' ELSE 'eager' END AS fetched
FROM datasets
""",
)
def f2_lazy_split(spark, sf_dir):
    datasets = catalog_tables(catalog(spark, sf_dir))["datasets"].select("filename", "prepare_input")
    lazy, eager = lazy_split(datasets, True), lazy_split(datasets, False)
    return lazy.withColumn("fetched", F.lit("lazy")).unionByName(
        eager.withColumn("fetched", F.lit("eager"))
    )


@work.query(
    "f3_order_by_cost",
    "WITH " + IMAGES_SQL + """
SELECT benchmark, service, m AS build_minutes,
       row_number() OVER (ORDER BY m IS NOT NULL, -m, benchmark, service)::BIGINT AS rank
FROM (SELECT *, CASE WHEN p_partkey % 7 <> 0 THEN p_size END AS m FROM images)
""",
)
def f3_order_by_cost(spark, sf_dir):
    images = catalog_tables(catalog(spark, sf_dir))["images"]
    return order_by_cost(images.select("benchmark", "service", "build_minutes"))


@work.query(
    "i7_input_set_digest",
    DATASETS_SQL + """
SELECT benchmark, service,
       sha256(string_agg(filename || ':' || sha256, chr(10) ORDER BY filename || ':' || sha256)
              FILTER (prepare_input)) AS digest
FROM datasets GROUP BY ALL
""",
)
def i7_input_set_digest(spark, sf_dir):
    return catalog(spark, sf_dir).select(
        "benchmark", "service", input_set_digest("datasets").alias("digest")
    )


@work.query(
    "i8_reuse_reason",
    """
WITH cases AS (
  SELECT p_partkey AS k, 'img_' || p_partkey AS image, p_size,
         CASE WHEN p_partkey % 11 = 0 THEN 'missing_outputs' WHEN p_partkey % 13 = 0 THEN 'no_stamp'
              WHEN p_partkey % 17 = 0 THEN 'unreadable_stamp' WHEN p_partkey % 19 = 0 THEN 'script_changed'
              WHEN p_partkey % 23 = 0 THEN 'pin_changed'
              WHEN p_partkey % 29 = 0 THEN 'pin_set_changed'
              WHEN p_partkey % 31 = 0 THEN 'output_size_changed' END AS reason
  FROM part)
SELECT image, reason,
       CASE reason WHEN 'missing_outputs' THEN 'a.tar'
                   WHEN 'output_size_changed' THEN 'b.tar is ' || (p_size * 7 + 1) || ' bytes, was '
                     || CASE WHEN k % 2 = 0 THEN 'unknown' ELSE (p_size * 7 + 2)::VARCHAR END END AS detail
FROM cases
""",
)
def i8_reuse_reason(spark, sf_dir):
    by = lambda n: F.pmod("p_partkey", F.lit(n)) == 0
    part = table(spark, sf_dir, "part").withColumn(
        "image", F.concat(F.lit("img_"), F.col("p_partkey").cast("string"))
    )
    script, a, b = hex_digest(F.col("p_name")), F.col("p_size") * 1000, F.col("p_size") * 7 + 1
    pin = F.when(F.pmod("p_partkey", F.lit(3)) == 0, hex_digest(F.col("p_brand")))
    pin_set = F.when(F.pmod("p_partkey", F.lit(3)) == 1, hex_digest(F.col("p_type")))
    current = part.select(
        "image",
        script.alias("script_sha256"),
        F.array(
            F.struct(F.lit("a.tar").alias("name"), F.when(~by(11), a.cast("long")).alias("size")),
            F.struct(F.lit("b.tar").alias("name"), b.cast("long").alias("size")),
        ).alias("outputs"),
        pin.alias("prepare_input_sha256"),
        pin_set.alias("prepare_inputs_digest"),
    )
    old_b = F.when(by(31), F.when(by(2), F.lit(None).cast("int")).otherwise(b + 1)).otherwise(b)
    stamp = F.to_json(
        F.struct(
            F.when(by(19), F.lit("old")).otherwise(script).alias("script_sha256"),
            F.struct(a.alias("a.tar"), old_b.alias("b.tar")).alias("outputs"),
            F.when(by(23), F.lit("other")).otherwise(pin).alias("prepare_input_sha256"),
            F.when(by(29), F.lit("other")).otherwise(pin_set).alias("prepare_inputs_digest"),
        )
    )
    stamps = part.filter(~by(13)).select(
        "image", F.when(by(17), F.lit("{cut off")).otherwise(stamp).alias("stamp")
    )
    return reuse_reason(current, stamps)


DECISION_SQL = "WITH " + LOCK_SQL + """,
facts AS (
  SELECT 'reg/img:' || p_partkey AS ref, p_partkey AS k, l.ref IS NOT NULL AS pinned, l.digest AS pin,
         'sha256:' || sha256(CASE WHEN p_partkey % 17 = 0 THEN 'moved' ELSE p_name END) AS got
  FROM part LEFT JOIN lock l ON l.ref = 'reg/img:' || p_partkey),
reasons AS (
  SELECT *, CASE WHEN k % 4 = 0 AND pinned THEN 'pinned_but_missing' WHEN k % 4 = 0 THEN 'not_cached'
                 WHEN k % 13 = 0 THEN 'not_an_artifact' WHEN NOT pinned THEN 'unpinned'
                 WHEN pin IS NULL THEN 'pinned_without_digest' WHEN pin = got THEN 'digest_matches'
                 ELSE 'digest_moved' END AS reason
  FROM facts)
SELECT ref, reason,
       CASE WHEN reason = 'not_cached' THEN 'derive'
            WHEN reason IN ('unpinned', 'pinned_without_digest', 'digest_matches') THEN 'pull'
            WHEN reason = 'digest_moved' AND {mismatch} THEN 'pull'
            WHEN reason = 'pinned_but_missing' AND {miss} THEN 'derive' ELSE 'fatal' END AS decision,
       (reason = 'digest_moved' AND {mismatch}) OR (reason = 'pinned_but_missing' AND {miss}) AS warned
FROM reasons
"""


def _decide(spark, sf_dir, **waivers):
    part = table(spark, sf_dir, "part").withColumn(
        "ref", F.concat(F.lit("reg/img:"), F.col("p_partkey").cast("string"))
    )
    by = lambda n: F.pmod("p_partkey", F.lit(n)) == 0
    got = F.when(by(17), F.lit("moved")).otherwise(F.col("p_name"))
    resolved = part.filter(~by(4)).select(
        "ref", (~by(13)).alias("is_artifact"), F.concat(F.lit("sha256:"), hex_digest(got)).alias("digest")
    )
    return lock_decision(part, read_lock(spark, written_lock(spark, sf_dir)), resolved, **waivers)


@work.query("i9_lock_decision", DECISION_SQL.replace("{mismatch}", "false").replace("{miss}", "false"))
def i9_lock_decision(spark, sf_dir):
    return _decide(spark, sf_dir)


@work.query(
    "i9_lock_decision_mismatch_waived",
    DECISION_SQL.replace("{mismatch}", "true").replace("{miss}", "false"),
)
def i9_lock_decision_mismatch_waived(spark, sf_dir):
    return _decide(spark, sf_dir, allow_mismatch=True)


@work.query(
    "i9_lock_decision_miss_waived",
    DECISION_SQL.replace("{mismatch}", "false").replace("{miss}", "true"),
)
def i9_lock_decision_miss_waived(spark, sf_dir):
    return _decide(spark, sf_dir, allow_miss=True)


# Which rule each faulty row breaks, by the row's remainder.
VIOLATIONS_SQL = "WITH " + IMAGES_SQL + """,
broken(v, code, detail) AS (VALUES
  (1, 'dataset_missing_filename', 'datasets[1]'), (2, 'dataset_missing_sha256', 'datasets[1]'),
  (3, 'dataset_missing_urls', 'datasets[1]'), (4, 'dataset_bad_sha256', 'datasets[1]'),
  (5, 'dataset_empty_urls', 'datasets[1]'), (6, 'source_kind', 'zip'),
  (6, 'prepare_without_build', ''), (7, 'save_missing_dataset', ''), (8, 'save_missing_tag', ''),
  (9, 'save_unknown_dataset', 'other.tar'), (10, 'save_with_build_section', ''),
  (11, 'stray_source_keys', ''), (12, 'prepare_without_build', ''),
  (13, 'prepare_missing_script', ''), (14, 'prepare_missing_outputs', ''),
  (15, 'prepare_empty_outputs', ''), (16, 'prepare_input_without_prepare', NULL),
  (17, 'media_missing_archive', ''), (18, 'media_missing_dest', ''), (19, 'media_missing_chown', ''),
  (20, 'media_missing_limit_kb', ''), (21, 'media_missing_max_buckets', ''),
  (22, 'media_unknown_archive', 'nope.tar'), (23, 'media_relative_dest', 'opt/x'),
  (24, 'media_bad_chown', 'app'), (25, 'bad_build_minutes', '-3'), (26, 'bad_build_minutes', '1.5'),
  (27, 'retired_healthcheck_timeout', ''), (28, 'media_bad_chown', 'app'),
  (28, 'retired_healthcheck_timeout', '')),
violations AS (
  SELECT benchmark, service, code,
         coalesce(detail, 'd' || p_partkey || '_0.tar, d' || p_partkey || '_1.tar') AS detail
  FROM images JOIN broken ON p_partkey % 40 = v)
"""


@work.query("i12_validate_catalog", VIOLATIONS_SQL + """
SELECT * FROM violations
UNION ALL
SELECT NULL, NULL, 'unparsable', '{"benchmark": "b' || p_partkey FROM part WHERE p_partkey % 40 = 31
UNION ALL
SELECT 'odd', 's' || p_partkey, 'wrong_type', '{"benchmark":"odd","service":"s' || p_partkey || '","media":7}'
FROM part WHERE p_partkey % 40 = 32
""")
def i12_validate_catalog(spark, sf_dir):
    return validate_catalog(written_catalog(spark, sf_dir, faults=True))


@work.query(
    "i12_validate_with_inventory",
    VIOLATIONS_SQL + """
SELECT * FROM violations
UNION ALL
SELECT benchmark, service, 'script_not_found', 'derive.sh' FROM images
WHERE p_partkey % 37 = 0 AND p_partkey % 40 NOT IN (7, 8, 9, 10, 13, 16)
UNION ALL
SELECT benchmark, 'bare_' || service, 'manifest_missing', '' FROM images WHERE p_partkey % 50 = 0
""",
)
def i12_validate_with_inventory(spark, sf_dir):
    rows = catalog(spark, sf_dir, faults=True)
    key = F.regexp_extract("service", r"(\d+)$", 1).cast("long")
    script = F.when(F.pmod(key, F.lit(37)) == 0, "image.toml").otherwise("derive.sh")
    folders = rows.select("benchmark", "service", script.alias("path")).unionByName(
        rows.filter(F.pmod(key, F.lit(50)) == 0).select(
            "benchmark", F.concat(F.lit("bare_"), "service").alias("service"), F.lit("x").alias("path")
        )
    )
    return validate_catalog(rows, folders)


@work.query(
    "plan_fetch",
    DATASETS_SQL + """
SELECT filename, sha256 AS expected,
       CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 6 = 0 THEN 'other' ELSE sha256 END AS actual,
       CASE WHEN p_partkey % 5 = 0 THEN 'missing' WHEN p_partkey % 6 = 0 THEN 'mismatch' ELSE 'verified' END
         AS status,
       CASE WHEN p_partkey % 5 = 0 THEN 'fetch' WHEN p_partkey % 6 = 0 THEN 'quarantine_and_fetch' ELSE 'use' END
         AS action
FROM datasets WHERE NOT prepare_input
""",
)
def plan_fetch_query(spark, sf_dir):
    rows = catalog(spark, sf_dir)
    key = F.regexp_extract("filename", r"^d(\d+)_", 1).cast("long")
    files = (
        catalog_tables(rows)["datasets"]
        .filter(F.pmod(key, F.lit(5)) != 0)
        .select(
            "filename",
            F.when(F.pmod(key, F.lit(6)) == 0, "other").otherwise(F.col("sha256")).alias("sha256"),
        )
    )
    return plan_fetch(rows, files)


def _pull(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn(
        "ref", F.concat(F.lit("reg/img:"), F.col("p_partkey").cast("string"))
    )
    by = lambda n: F.pmod("p_partkey", F.lit(n))

    def layer(n: int):
        return F.struct(
            hex_digest(F.concat("p_name", F.lit(str(n)))).alias("digest"),
            (F.col("p_size") * 100 + n).cast("long").alias("size"),
            F.create_map(F.lit("org.opencontainers.image.title"), F.lit("ab"[n] + ".bin")).alias(
                "annotations"
            ),
        )

    layers = F.array(layer(0), layer(1))
    manifests = part.filter(by(4) != 0).select(
        "ref",
        "p_partkey",
        F.to_json(
            F.struct(
                F.when(by(13) != 0, F.lit("application/x")).alias("artifactType"),
                F.when(by(9) != 0, layers).alias("layers"),
            )
        ).alias("manifest"),
    )
    pin = F.when(by(17) == 0, F.lit("sha256:old")).otherwise(
        F.concat(F.lit("sha256:"), hex_digest(F.coalesce("manifest", F.lit(""))))
    )
    lock = (
        part.filter(by(5) != 0)
        .join(manifests.select("ref", "manifest"), "ref", "left")
        .select("ref", F.when(by(7) != 0, pin).alias("digest"))
    )
    local = part.filter(by(3) != 0).select(
        "ref",
        F.lit("a.bin").alias("title"),
        (F.col("p_size") * F.when(by(3) == 1, 50).otherwise(100)).cast("long").alias("have"),
        hex_digest(F.concat("p_name", F.lit("0"))).alias("have_digest"),
    )
    return plan_pull(part, manifests, lock, local)


PULL_SQL = """
WITH facts AS (
  SELECT 'reg/img:' || p_partkey AS ref, p_partkey AS k, p_size::BIGINT AS p_size,
         CASE WHEN p_partkey % 4 = 0 AND p_partkey % 5 <> 0 THEN 'pinned_but_missing'
              WHEN p_partkey % 4 = 0 THEN 'not_cached' WHEN p_partkey % 13 = 0 THEN 'not_an_artifact'
              WHEN p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 17 = 0 THEN 'digest_moved'
              WHEN p_partkey % 9 = 0 THEN 'empty_artifact' WHEN p_partkey % 5 = 0 THEN 'unpinned'
              WHEN p_partkey % 7 = 0 THEN 'pinned_without_digest' ELSE 'digest_matches' END AS reason
  FROM part),
decisions AS (
  SELECT *, CASE WHEN reason IN ('unpinned', 'pinned_without_digest', 'digest_matches') THEN 'pull'
                 WHEN reason = 'not_cached' THEN 'derive' ELSE 'fatal' END AS decision FROM facts)
"""


@work.query(
    "plan_pull_decisions", PULL_SQL + "SELECT ref, decision, false AS warned, reason FROM decisions"
)
def plan_pull_decisions(spark, sf_dir):
    return _pull(spark, sf_dir).decisions


@work.query(
    "plan_pull_transfers",
    PULL_SQL + """
SELECT ref, title, action, CASE WHEN action = 'resume' THEN 50 * p_size ELSE 0 END AS "offset",
       CASE action WHEN 'skip' THEN 0 WHEN 'resume' THEN 50 * p_size ELSE size END AS bytes_left
FROM (
  SELECT *, 'a.bin' AS title, 100 * p_size AS size,
         CASE k % 3 WHEN 0 THEN 'fetch' WHEN 1 THEN 'resume' ELSE 'skip' END AS action FROM decisions
  UNION ALL SELECT *, 'b.bin', 100 * p_size + 1, 'fetch' FROM decisions)
WHERE decision = 'pull'
""",
)
def plan_pull_transfers(spark, sf_dir):
    return _pull(spark, sf_dir).transfers
