"""The given tables reshaped to the schemas the operators take.

Every reshaping is one pass over the table, and states its perturbations by modulo so that
SQL can state them too. The ``*_SQL`` strings are the same shapes as SQL views.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyman.functions import components
from tallyman.operators.ordered import with_row_number, with_running_sum
from tallyman.operators.rollup import with_directories

TREE_LIMIT = 131_072
ARCHIVE_LIMIT = 262_144
#: Buckets there may be at least; more where the total asks for them.
LEAST_BUCKETS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with ``ts`` as an instant: its wall clock read as UTC in any session."""
    return table(spark, sf_dir, "events").withColumn("ts", utc_instant("ts"))


def utc_instant(name: str) -> Column:
    since = f"CAST({name} - TIMESTAMP_NTZ'1970-01-01 00:00:00' AS INTERVAL SECOND)"
    return F.expr(f"timestamp_micros(CAST(CAST({since} AS DECIMAL(20, 6)) * 1000000 AS BIGINT))")


def document_path() -> Column:
    return F.concat_ws(
        "/",
        "lang",
        "source",
        F.pmod("doc_id", F.lit(10)).cast("string"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")),
    )


def tree_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of one tree, with their directories."""
    files = table(spark, sf_dir, "documents").select(
        F.lit("corpus").alias("root"),
        document_path().alias("path"),
        F.lit("file").alias("kind"),
        F.octet_length("text").cast("long").alias("size"),
    )
    return with_directories(files)


TREE_SQL = """
files AS (
  SELECT 'corpus' AS root,
         lang || '/' || source || '/' || (doc_id % 10) || '/doc_' || doc_id || '.txt' AS path,
         'file' AS kind, octet_length(encode(text))::BIGINT AS size
  FROM documents),
tree AS (
  SELECT * FROM files
  UNION ALL
  SELECT DISTINCT 'corpus', array_to_string(string_split(path, '/')[1:d], '/'), 'dir', 0::BIGINT
  FROM files, range(1, 4) AS r(d))
"""


def archive_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree in archive order, with modes, owners, links and deliberate faults."""
    digits = F.regexp_extract("path", r"doc_(\d+)\.txt$", 1)
    entries = tree_entries(spark, sf_dir).withColumn(
        "doc", F.nullif(digits, F.lit("")).cast("long")
    )

    def by(n: int) -> Column:
        return F.coalesce(F.pmod("doc", F.lit(n)) == 0, F.lit(False))

    shaped = entries.select(
        "root",
        "path",
        F.when(by(79), "hardlink").when(by(89) | by(83), "symlink").otherwise(F.col("kind")).alias(
            "kind"
        ),
        F.when(by(79) | by(89) | by(83), F.lit(0).cast("long")).otherwise(F.col("size")).alias(
            "size"
        ),
        F.when(F.col("kind") == "dir", F.when(F.col("path").endswith("/7"), 0o2775).otherwise(0o755))
        .when(by(97), 0o666)
        .when(by(101), 0o4755)
        .otherwise(0o644)
        .alias("mode"),
        F.when(by(61), 0).otherwise(1000).alias("uid"),
        F.when(by(59), 0).otherwise(1000).alias("gid"),
        F.when(by(79), F.lit("media/original"))
        .when(by(89), F.lit("../x"))
        .when(by(83), F.lit("../../../../../etc/x"))
        .alias("link_target"),
    )
    return with_row_number(shaped, [components("path")])


ARCHIVE_SQL = TREE_SQL + """,
docs_of_tree AS (
  SELECT *, TRY_CAST(nullif(regexp_extract(path, 'doc_([0-9]+)\\.txt$', 1), '') AS BIGINT) AS doc
  FROM tree),
archive AS (
  SELECT root, path,
         CASE WHEN doc % 79 = 0 THEN 'hardlink' WHEN doc % 89 = 0 OR doc % 83 = 0 THEN 'symlink'
              ELSE kind END AS kind,
         CASE WHEN doc % 79 = 0 OR doc % 89 = 0 OR doc % 83 = 0 THEN 0 ELSE size END AS size,
         CASE WHEN kind = 'dir' THEN CASE WHEN path LIKE '%/7' THEN 1533 ELSE 493 END
              WHEN doc % 97 = 0 THEN 438 WHEN doc % 101 = 0 THEN 2541 ELSE 420 END AS mode,
         CASE WHEN doc % 61 = 0 THEN 0 ELSE 1000 END AS uid,
         CASE WHEN doc % 59 = 0 THEN 0 ELSE 1000 END AS gid,
         CASE WHEN doc % 79 = 0 THEN 'media/original' WHEN doc % 89 = 0 THEN '../x'
              WHEN doc % 83 = 0 THEN '../../../../../etc/x' END AS link_target,
         row_number() OVER (ORDER BY string_split(path, '/')) AS seq
  FROM docs_of_tree)
"""


def hex_digest(column: Column) -> Column:
    return F.sha2(column.cast("binary"), 256)


def catalog(spark: SparkSession, sf_dir: str, faults: bool = False) -> DataFrame:
    """One nested catalog row per part; with ``faults`` each rule is broken by some of them."""
    key = F.col("p_partkey")
    v = F.pmod(key, F.lit(40)) if faults else F.lit(39)
    saved = v.isin(7, 8, 9, 10, 12)
    lazy = ((F.pmod(key, F.lit(3)) == 0) & ~saved) | (v == 16)
    name = lambda n: F.concat(F.lit("d"), key.cast("string"), F.lit(f"_{n}.tar"))
    digest = lambda n: hex_digest(F.concat("p_name", F.lit(f"-{n}")))
    null = F.lit(None).cast("string")

    def urls(n: int) -> Column:
        return F.array(*[
            F.concat(F.lit(f"https://{host}.example/"), key.cast("string"), F.lit(f"/{n}"))
            for host in ("a", "b")
        ])

    def dataset(filename: Column, sha: Column, links: Column, flag: Column) -> Column:
        return F.struct(
            filename.alias("filename"), sha.alias("sha256"), links.alias("urls"),
            flag.alias("prepare_input"),
        )

    no_urls = F.lit(None).cast("array<string>")
    datasets = F.array(
        dataset(name(0), digest(0), urls(0), lazy),
        dataset(
            F.when(v == 1, null).otherwise(name(1)),
            F.when(v == 2, null).when(v == 4, F.upper(digest(1))).otherwise(digest(1)),
            F.when(v == 3, no_urls)
            .when(v == 5, F.array().cast("array<string>"))
            .otherwise(urls(1)),
            lazy,
        ),
        dataset(name(2), digest(2), urls(2), F.lit(False)),
    )
    tag = F.concat(F.lit("site:"), key.cast("string"))
    source = F.when(
        saved,
        F.struct(
            F.lit("docker-save").alias("kind"),
            F.when(v == 7, null).when(v == 9, F.lit("other.tar")).otherwise(name(0)).alias("dataset"),
            F.when(v == 8, null).otherwise(tag).alias("tag"),
        ),
    ).when(
        v.isin(6, 11),
        F.struct(
            F.when(v == 6, F.lit("zip")).otherwise(F.lit("build")).alias("kind"),
            F.when(v == 11, name(0)).alias("dataset"),
            null.alias("tag"),
        ),
    )
    output = F.concat(F.lit("out_"), key.cast("string"), F.lit(".tar"))
    prepare = F.when(
        ~(v.isin(7, 8, 9, 10, 16)),
        F.struct(
            F.when(v == 13, null).otherwise(F.lit("derive.sh")).alias("script"),
            F.when(v == 14, F.lit(None).cast("array<string>"))
            .when(v == 15, F.array().cast("array<string>"))
            .otherwise(F.array(output))
            .alias("outputs"),
        ),
    )
    media = F.when(
        ~(saved | v.isin(13, 14, 15, 16)),
        F.struct(
            F.when(v == 17, null).when(v == 22, F.lit("nope.tar")).otherwise(output).alias("archive"),
            F.lit("/pub/media/").alias("strip"),
            F.when(v == 18, null).when(v == 23, F.lit("opt/x")).otherwise(F.lit("/opt/x/")).alias("dest"),
            F.when(v == 19, null).when(v.isin(24, 28), F.lit("app")).otherwise(F.lit("app:app")).alias("chown"),
            F.when(v != 20, (F.col("p_size") * 1024).cast("long")).alias("limit_kb"),
            F.when(v != 21, F.pmod(key, F.lit(14)).cast("int") + 1).alias("max_buckets"),
            F.when(F.pmod(key, F.lit(2)) == 0, key).alias("min_entries"),
            F.lit(None).cast("boolean").alias("restore_needs_media"),
        ),
    )
    build = F.when(
        ~saved | (v == 10), F.struct(F.create_map(F.lit("BRAND"), F.col("p_brand")).alias("args"))
    )
    minutes = (
        F.when(v == 25, F.lit("-3"))
        .when(v == 26, F.lit("1.5"))
        .when(F.pmod(key, F.lit(7)) == 0, null)
        .otherwise(F.col("p_size").cast("string"))
    )
    run = F.struct(
        null.alias("healthcheck"),
        F.when(F.pmod(key, F.lit(5)) == 0, F.lit("90")).alias("reachability_timeout_s"),
        F.when(v.isin(27, 28), F.lit("900")).alias("healthcheck_timeout_s"),
    )
    return table(spark, sf_dir, "part").select(
        F.lower(F.translate("p_brand", "# ", "__")).alias("benchmark"),
        F.concat(F.lit("svc"), key.cast("string")).alias("service"),
        datasets.alias("datasets"),
        source.alias("source"),
        prepare.alias("prepare"),
        media.alias("media"),
        build.alias("build"),
        minutes.alias("build_minutes"),
        run.alias("run"),
    )


IMAGES_SQL = """
images AS (
  SELECT lower(translate(p_brand, '# ', '__')) AS benchmark, 'svc' || p_partkey AS service, *
  FROM part)
"""


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as layers of one image per source."""
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("ref"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("title"),
        hex_digest(F.col("text")).alias("digest"),
        F.octet_length("text").cast("long").alias("size"),
        F.col("doc_id").alias("seq"),
    )


def conversation_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as neighbouring byte ranges of four archives.

    ``(archive, name, turns, start, end)``. One distributed running sum over all archives,
    less what came before each.
    """
    per_conv = (
        table(spark, sf_dir, "conversations")
        .groupBy("conv_id")
        .agg(
            F.sum(F.octet_length("text").cast("long")).alias("bytes"),
            F.count(F.lit(1)).alias("turns"),
        )
        .withColumn(
            "archive", F.concat(F.lit("talks_"), F.pmod("conv_id", F.lit(4)).cast("string"))
        )
    )
    summed = with_running_sum(per_conv, ["archive", "conv_id"], F.col("bytes"), "upto")
    base = summed.groupBy("archive").agg(F.min(F.col("upto") - F.col("bytes")).alias("base"))
    return summed.join(base, "archive").select(
        "archive",
        F.concat(F.lit("conv_"), F.col("conv_id").cast("string")).alias("name"),
        "turns",
        (F.col("upto") - F.col("bytes") - F.col("base")).alias("start"),
        (F.col("upto") - F.col("base")).alias("end"),
    )


CONVERSATION_SQL = """
per_conv AS (
  SELECT conv_id, 'talks_' || (conv_id % 4) AS archive, sum(octet_length(encode(text)))::BIGINT AS bytes,
         count(*) AS turns
  FROM conversations GROUP BY ALL),
talks AS (
  SELECT archive, 'conv_' || conv_id AS name, turns, (sum(bytes) OVER w - bytes)::BIGINT AS s,
         (sum(bytes) OVER w)::BIGINT AS e
  FROM per_conv WINDOW w AS (PARTITION BY archive ORDER BY conv_id)),
whole AS (SELECT archive, max(e) AS total FROM talks GROUP BY archive)
"""
