"""Sources, sinks, selection and integrity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyman.operators.audit import audit_assignment, audit_entries, entry_violations
from tallyman.operators.integrity import (
    at_least,
    check_counts,
    check_floors,
    dump_complete,
    measure,
    ownership_audit,
    required_files,
    tree_diff,
    verify_pins,
)
from tallyman.operators.packing import pack_first_fit
from tallyman.operators.rollup import frontier, with_ancestors
from tallyman.operators.select import (
    clear_world_writable,
    rebase_links,
    strip_definers,
    strip_paths,
)
from tallyman.session import scratch_path, stage
from tallyman.sources import (
    file_inventory,
    manifest_layers,
    quarantine,
    read_buckets,
    read_checksums,
    read_lock,
    read_product_json,
    read_readings,
    write_buckets,
    write_checksums,
)
from tallyman.workload.fixtures import (
    ARCHIVE_SQL,
    TREE_LIMIT,
    TREE_SQL,
    archive_entries,
    document_path,
    events,
    hex_digest,
    table,
    tree_entries,
)
from tallyman.workload.packing import (
    FIT_SQL,
    MEMBERS_SQL,
    TREE_CEILING,
    _fill,
    tree_assignment,
    tree_ceiling,
)
from tallyman.workload.registry import Workload

work = Workload()

PATH_SQL = "lang || '/' || source || '/' || (doc_id % 10) || '/doc_' || doc_id || '.txt'"
PAIR_SQL = f"""
expected AS (SELECT {PATH_SQL} AS path, sha256(text) AS sha FROM documents),
actual AS (
  SELECT {PATH_SQL} AS path, sha256(CASE WHEN doc_id % 33 = 0 THEN text || 'x' ELSE text END) AS sha
  FROM documents WHERE doc_id % 50 <> 0
  UNION ALL
  SELECT 'new/' || {PATH_SQL}, sha256(text) FROM documents WHERE doc_id % 111 = 5)
"""


def checksum_pair(spark, sf_dir):
    """Expected digests of all documents, and actual ones with losses, edits and additions."""
    docs = table(spark, sf_dir, "documents")
    by = lambda n: F.pmod("doc_id", F.lit(n))
    expected = docs.select(document_path().alias("path"), hex_digest(F.col("text")).alias("sha256"))
    edited = F.when(by(33) == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    kept = docs.filter(by(50) != 0).select(
        document_path().alias("path"), hex_digest(edited).alias("sha256")
    )
    added = docs.filter(by(111) == 5).select(
        F.concat(F.lit("new/"), document_path()).alias("path"),
        hex_digest(F.col("text")).alias("sha256"),
    )
    return expected, kept.unionByName(added)


# --- sources and sinks ---


@work.query(
    "s2_inventory_digests",
    """
SELECT octet_length(encode(body))::BIGINT AS length, sha256(body) AS sha256, 'hashed' AS status
FROM (SELECT string_agg(text, chr(10) ORDER BY doc_id) || chr(10) AS body
      FROM documents GROUP BY doc_id // 20)
""",
)
def s2_inventory_digests(spark, sf_dir):
    path = scratch_path(spark, "files")
    (
        table(spark, sf_dir, "documents")
        .groupBy(F.expr("doc_id div 20").alias("g"))
        .agg(F.sort_array(F.collect_list(F.struct("doc_id", "text"))).alias("docs"))
        .select(F.array_join(F.transform("docs", lambda d: d["text"]), "\n").alias("value"))
        .write.option("maxRecordsPerFile", 1)
        .text(path)
    )
    return file_inventory(spark, path, glob="part-*").select("length", "sha256", "status")


@work.query(
    "s3_read_checksums",
    f"""
SELECT CASE WHEN ok THEN sha256(text) END AS sha256, CASE WHEN ok THEN p END AS path,
       CASE WHEN ok THEN 'ok' ELSE 'malformed' END AS status,
       sha256(text) || CASE WHEN ok THEN '  ' ELSE ' ' END || p AS line
FROM (SELECT *, doc_id % 40 <> 0 AS ok, replace({PATH_SQL}, '_', ' ') AS p FROM documents)
""",
)
def s3_read_checksums(spark, sf_dir):
    path = scratch_path(spark, "sums")
    gap = F.when(F.pmod("doc_id", F.lit(40)) != 0, "  ").otherwise(" ")
    table(spark, sf_dir, "documents").select(
        F.concat(
            hex_digest(F.col("text")), gap, F.translate(document_path(), "_", " ")
        ).alias("value")
    ).write.text(path)
    return read_checksums(spark, path)


LOCK_SQL = """
lock AS (
  SELECT 'reg/img:' || p_partkey AS ref,
         CASE WHEN p_partkey % 7 <> 0 THEN 'sha256:' || sha256(p_name) END AS digest
  FROM part WHERE p_partkey % 5 <> 0)
"""


def written_lock(spark, sf_dir):
    """A lock file derived from the parts: comments, missing digests and repeated refs."""
    part = table(spark, sf_dir, "part")
    by = lambda n: F.pmod("p_partkey", F.lit(n)) == 0
    ref = F.concat(F.lit("reg/img:"), F.col("p_partkey").cast("string"))
    pin = F.when(by(7), F.lit("")).otherwise(F.concat(F.lit(" sha256:"), hex_digest(F.col("p_name"))))
    note = F.when(by(3), F.lit("   # re-pinned")).otherwise(F.lit(""))
    lines = F.array_compact(
        F.array(
            F.when(by(5), F.concat(F.lit("# "), ref)),
            F.when(~by(5), F.concat(ref, pin, note)),
            F.when(~by(5) & by(11), F.concat(ref, F.lit("\tsha256:later"))),
        )
    )
    path = scratch_path(spark, "lock")
    part.orderBy("p_partkey").select(F.explode(lines).alias("value")).write.text(path)
    return path


@work.query("s4_read_lock", "WITH " + LOCK_SQL + "SELECT * FROM lock")
def s4_read_lock(spark, sf_dir):
    return read_lock(spark, written_lock(spark, sf_dir))


@work.query(
    "s5_manifest_layers",
    """
WITH cells AS (
  SELECT 'reg/img:' || p_partkey AS ref, k AS position, p_partkey AS key,
         'sha256:' || sha256(p_name || k) AS digest, (p_size * 1000 + k)::BIGINT AS size,
         CASE WHEN key % 9 = 0 THEN NULL WHEN k = 0 THEN 'disk.img'
              WHEN k = 1 AND key % 5 = 0 THEN 'a/b' WHEN k = 1 THEN 'notes.txt'
              WHEN k = 2 THEN CASE WHEN key % 7 = 0 THEN '..' ELSE '' END END AS title
  FROM part, range(0, 4) AS r(k))
SELECT ref, position::INTEGER AS position, digest, size, title,
       CASE WHEN title LIKE '%/%' OR title IN ('.', '..') THEN 'refused' ELSE 'ok' END AS status
FROM cells WHERE title <> '' AND key % 23 <> 0
UNION ALL
SELECT 'reg/img:' || p_partkey, NULL, NULL, NULL, NULL,
       CASE WHEN p_partkey % 23 = 0 THEN 'not_json' ELSE 'empty_artifact' END
FROM part WHERE p_partkey % 23 = 0 OR p_partkey % 9 = 0
""",
)
def s5_manifest_layers(spark, sf_dir):
    by = lambda n: F.pmod("p_partkey", F.lit(n)) == 0
    titles = [
        F.lit("disk.img"),
        F.when(by(5), "a/b").otherwise("notes.txt"),
        F.when(by(7), "..").otherwise(""),
        F.lit(None).cast("string"),
    ]

    def layer(n: int):
        title = F.when(~by(9), titles[n])
        return F.struct(
            F.concat(F.lit("sha256:"), hex_digest(F.concat("p_name", F.lit(str(n))))).alias("digest"),
            (F.col("p_size") * 1000 + n).cast("long").alias("size"),
            F.when(
                title.isNotNull(), F.create_map(F.lit("org.opencontainers.image.title"), title)
            ).alias("annotations"),
        )

    body = F.to_json(F.struct(F.array(*[layer(n) for n in range(4)]).alias("layers")))
    manifests = table(spark, sf_dir, "part").select(
        F.concat(F.lit("reg/img:"), F.col("p_partkey").cast("string")).alias("ref"),
        F.when(by(23), F.lit("<html>busy</html>")).otherwise(body).alias("manifest"),
    )
    return manifest_layers(manifests)


@work.query(
    "s6_read_product_json",
    """
SELECT p_partkey, p_name, p_brand, p_size, p_retailprice, 'ok' AS status, NULL::VARCHAR AS raw FROM part
UNION ALL
SELECT DISTINCT NULL::BIGINT, NULL, NULL, NULL::INTEGER, NULL::DOUBLE, 'unparsable', '[{"p_partkey": ' || p_size || ' ' FROM part
""",
)
def s6_read_product_json(spark, sf_dir):
    path = scratch_path(spark, "products")
    fields = ["p_partkey", "p_name", "p_brand", "p_size", "p_retailprice"]
    (
        table(spark, sf_dir, "part")
        .groupBy(F.expr("p_partkey div 500").alias("g"))
        .agg(F.collect_list(F.to_json(F.struct(*fields))).alias("items"))
        .select(F.concat(F.lit("["), F.array_join("items", ",\n"), F.lit("]")).alias("value"))
        .write.option("maxRecordsPerFile", 1)
        .text(path)
    )
    broken = table(spark, sf_dir, "part").select("p_size").distinct()
    (
        broken.select(F.concat(F.lit('[{"p_partkey": '), F.col("p_size").cast("string")).alias("value"))
        .write.mode("append").option("maxRecordsPerFile", 1).option("lineSep", " ").text(path)
    )
    return read_product_json(
        spark, path, "p_partkey long, p_name string, p_brand string, p_size int, p_retailprice double"
    )


def readings(samples):
    """Events as resource readings of one run per user."""
    v = F.floor("value").cast("long")
    return samples.select(
        F.lit("resources").alias("metric"),
        F.col("event_type").alias("phase"),
        F.when(F.col("event_type") != "error", v * 10).alias("mem_available_mb"),
        F.lit(4096).cast("long").alias("mem_total_mb"),
        F.when(F.pmod("event_id", F.lit(4)) != 0, v).alias("swap_used_mb"),
        (F.lit(1000) - v).cast("long").alias("disk_free_gb"),
        F.lit(1000).cast("long").alias("disk_total_gb"),
        F.concat(F.lit("run"), F.col("user_id").cast("string")).alias("run"),
        F.col("ts").alias("at"),
    )


READINGS_SQL = """
readings AS (
  SELECT 'resources' AS metric, event_type AS phase,
         CASE WHEN event_type <> 'error' THEN floor(value)::BIGINT * 10 END AS mem_available_mb,
         4096::BIGINT AS mem_total_mb,
         CASE WHEN event_id % 4 <> 0 THEN floor(value)::BIGINT END AS swap_used_mb,
         1000 - floor(value)::BIGINT AS disk_free_gb, 1000::BIGINT AS disk_total_gb,
         'run' || user_id AS run, ts
  FROM events)
"""


@work.query(
    "s7_read_readings",
    "WITH " + READINGS_SQL + """
SELECT * EXCLUDE (ts), epoch_us(ts) AS at_us, NULL::VARCHAR AS raw, 'ok' AS status FROM readings
UNION ALL
SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, '{"run": ' || event_id, 'unparsable'
FROM events WHERE event_id % 100 = 7
""",
)
def s7_read_readings(spark, sf_dir):
    path = scratch_path(spark, "readings")
    readings(events(spark, sf_dir)).write.option(
        "timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    ).json(path)
    broken = table(spark, sf_dir, "events").filter("event_id % 100 = 7")
    broken.select(F.concat(F.lit('{"run": '), F.col("event_id").cast("string")).alias("value")).write.mode("append").text(path)
    return (
        read_readings(spark, path).withColumn("at_us", F.unix_micros("at")).drop("at")
    )


def written_buckets(spark, packed):
    """``packed`` as it is read back: what has a bucket from there, the rest from beside it."""
    packed = stage(packed, "packed")
    path, refused = scratch_path(spark, "buckets"), scratch_path(spark, "refused")
    write_buckets(packed, path, refused=refused)
    back = read_buckets(spark, path, packed.schema).unionByName(spark.read.schema(packed.schema).parquet(refused))
    return back.select("root", "bucket", "path", "bytes", "status")


@work.query(
    "k1_write_buckets",
    _fill(FIT_SQL + "SELECT root, bucket, path, bytes, status FROM packed", TREE_LIMIT, TREE_CEILING),
)
def k1_write_buckets(spark, sf_dir):
    pieces = frontier(tree_entries(spark, sf_dir), TREE_LIMIT)
    return written_buckets(spark, pack_first_fit(pieces, TREE_LIMIT, tree_ceiling(spark, sf_dir)))


@work.query(
    "k1_refused_pieces",
    _fill(FIT_SQL + "SELECT root, bucket, path, bytes, status FROM packed", 16_384, 30),
)
def k1_refused_pieces(spark, sf_dir):
    """Files larger than a bucket, and more pieces than all buckets hold."""
    return written_buckets(spark, pack_first_fit(frontier(tree_entries(spark, sf_dir), 16_384), 16_384, 30))


@work.query(
    "k2_write_checksums",
    f"SELECT sha256(text) AS sha256, {PATH_SQL} AS path, 'ok' AS status FROM documents",
)
def k2_write_checksums(spark, sf_dir):
    path = scratch_path(spark, "written-sums")
    write_checksums(checksum_pair(spark, sf_dir)[0], path)
    return read_checksums(spark, path).drop("line")


@work.query(
    "k3_quarantine",
    "WITH " + PAIR_SQL + """
SELECT e.path, string_split(e.path, '/')[2] AS source,
       CASE WHEN a.sha = e.sha THEN 'verified' ELSE 'quarantine' END AS verdict
FROM expected e LEFT JOIN actual a USING (path)
""",
)
def k3_quarantine(spark, sf_dir):
    expected, actual = checksum_pair(spark, sf_dir)
    checked = verify_pins(expected, actual).withColumn(
        "source", F.element_at(F.split("path", "/"), 2)
    )
    path = scratch_path(spark, "quarantine")
    quarantine(checked, F.col("status") == "verified", path, by="source")
    return spark.read.parquet(path).select("path", "source", "verdict")


@work.query(
    "k3_quarantine_twice",
    "WITH " + PAIR_SQL + """
SELECT e.path, string_split(e.path, '/')[2] AS source,
       CASE WHEN coalesce(a.sha = e.sha, false) = (string_split(e.path, '/')[2] NOT LIKE '%3') THEN 'verified' ELSE 'quarantine' END AS verdict
FROM expected e LEFT JOIN actual a USING (path)
""",
)
def k3_quarantine_twice(spark, sf_dir):
    """Two runs; in the second, sources that end in 3 come again with their verdicts turned round."""
    expected, actual = checksum_pair(spark, sf_dir)
    source = F.element_at(F.split("path", "/"), 2)
    checked = stage(verify_pins(expected, actual).withColumn("source", source), "checked")
    good = F.coalesce(F.col("status") == "verified", F.lit(False))
    path = scratch_path(spark, "quarantine")
    quarantine(checked, good, path, by="source")
    quarantine(checked.filter("source LIKE '%3'"), ~good, path, by="source")
    return spark.read.parquet(path).select("path", "source", "verdict")


# --- selection ---


@work.query(
    "f4_strip_prefix",
    "WITH " + TREE_SQL + """
SELECT array_to_string(string_split(path, '/')[3:], '/') AS path, kind, size FROM tree
WHERE len(string_split(path, '/')) > 2
""",
)
def f4_strip_prefix(spark, sf_dir):
    return strip_paths(tree_entries(spark, sf_dir), "any/thing").drop("root")


@work.query(
    "f5_clear_world_writable",
    "WITH " + ARCHIVE_SQL + """
SELECT path, mode AS mode_before,
       CASE WHEN kind IN ('file', 'dir') AND (mode & 2) <> 0 THEN mode - 2 ELSE mode END::INTEGER AS mode,
       kind IN ('file', 'dir') AND (mode & 2) <> 0 AS corrected
FROM archive
""",
)
def f5_clear_world_writable(spark, sf_dir):
    return clear_world_writable(archive_entries(spark, sf_dir)).select(
        "path", "mode_before", "mode", "corrected"
    )


@work.query(
    "f6_rebase_links",
    """
SELECT page_id, CASE WHEN host = 'site:80' THEN 'http://mirror:8080' || rest ELSE 'https://' || host || rest END AS url,
       host = 'site:80' AS changed
FROM (SELECT page_id, regexp_replace(url, '^https?://[^/?#]+', '') AS rest,
             CASE page_id % 3 WHEN 0 THEN 'site:80' WHEN 1 THEN 'site:8080' ELSE 'site' END AS host
      FROM pages)
""",
)
def f6_rebase_links(spark, sf_dir):
    k = F.pmod("page_id", F.lit(3))
    origin = (
        F.when(k == 0, "https://site:80").when(k == 1, "https://site:8080").otherwise("https://site")
    )
    pages = table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_replace("url", F.lit(r"^https?://[^/?#]+"), origin).alias("url")
    )
    return rebase_links(pages, "url", "https://site:80", "http://mirror:8080")


@work.query(
    "f7_strip_definers",
    """
SELECT c_custkey, 'CREATE ' || CASE WHEN c_custkey % 4 = 0 THEN '' ELSE ' ' END
       || ' VIEW ' || c_name || CASE WHEN c_custkey % 3 = 0 THEN ' /*  */' ELSE '' END AS line
FROM customer
""",
)
def f7_strip_definers(spark, sf_dir):
    clause = F.when(
        F.pmod("c_custkey", F.lit(4)) != 0,
        F.concat(F.lit("DEFINER=`"), "c_mktsegment", F.lit("`@`%` ")),
    ).otherwise(F.lit(""))
    tail = F.when(
        F.pmod("c_custkey", F.lit(3)) == 0, F.lit(" /* DEFINER=`root`@`localhost` */")
    ).otherwise(F.lit(""))
    lines = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.concat(F.lit("CREATE "), clause, F.lit(" VIEW "), "c_name", tail).alias("line"),
    )
    return strip_definers(lines)


# --- integrity ---


@work.query(
    "i1_verify_pins",
    "WITH " + PAIR_SQL + """
SELECT e.path, e.sha AS expected, a.sha AS actual,
       CASE WHEN a.path IS NULL THEN 'missing' WHEN a.sha = e.sha THEN 'verified'
            ELSE 'mismatch' END AS status
FROM expected e LEFT JOIN actual a USING (path)
""",
)
def i1_verify_pins(spark, sf_dir):
    return verify_pins(*checksum_pair(spark, sf_dir))


@work.query(
    "i2_tree_diff",
    "WITH " + PAIR_SQL + """
SELECT path, max(es) AS expected, max(acs) AS actual,
       CASE WHEN max(es) = max(acs) THEN 'identical' WHEN max(acs) IS NULL THEN 'only_expected'
            WHEN max(es) IS NULL THEN 'only_actual' ELSE 'changed' END AS status
FROM (SELECT path, sha AS es, NULL AS acs FROM expected UNION ALL SELECT path, NULL, sha FROM actual)
WHERE path NOT IN ('en/src1/1/doc_1.txt', 'config.php')
GROUP BY path
""",
)
def i2_tree_diff(spark, sf_dir):
    expected, actual = checksum_pair(spark, sf_dir)
    return tree_diff(expected, actual, exclude=["en/src1/1/doc_1.txt", "config.php"])


@work.query(
    "i3_check_counts",
    """
WITH measured AS (
  SELECT 'orders' AS label, count(*) AS actual FROM orders UNION ALL
  SELECT 'orders_max', max(o_orderkey) FROM orders UNION ALL
  SELECT 'orders_open', count(*) FILTER (o_orderstatus = 'O') FROM orders UNION ALL
  SELECT 'lineitem', count(*) FROM lineitem UNION ALL
  SELECT 'lineitem_returned', count(*) FILTER (l_returnflag = 'R') FROM lineitem UNION ALL
  SELECT 'documents', count(*) FROM documents UNION ALL
  SELECT 'documents_max', max(doc_id) FROM documents)
SELECT label, actual + CASE WHEN label = 'lineitem' THEN 1 ELSE 0 END AS expected,
       CASE WHEN label <> 'documents_max' THEN actual END AS actual,
       CASE WHEN label = 'documents_max' THEN 'unmeasured' WHEN label = 'lineitem' THEN 'mismatch'
            ELSE 'ok' END AS status
FROM measured
""",
)
def i3_check_counts(spark, sf_dir):
    orders, lines, docs = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "documents"))
    measured = (
        measure(orders, {
            "orders": F.count(F.lit(1)),
            "orders_max": F.max("o_orderkey"),
            "orders_open": F.count_if(F.col("o_orderstatus") == "O"),
        })
        .unionByName(measure(lines, {
            "lineitem": F.count(F.lit(1)),
            "lineitem_returned": F.count_if(F.col("l_returnflag") == "R"),
        }))
        .unionByName(measure(docs, {"documents": F.count(F.lit(1))}))
    )
    # Pins counted another way: by group, then summed; one is off by one on purpose.
    by_status = orders.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("top")
    )
    by_flag = lines.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    by_source = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top"))
    pins = (
        measure(by_status, {
            "orders": F.sum("n"),
            "orders_max": F.max("top"),
            "orders_open": F.sum(F.when(F.col("o_orderstatus") == "O", F.col("n")).otherwise(0)),
        })
        .unionByName(measure(by_flag, {
            "lineitem": F.sum("n") + 1,
            "lineitem_returned": F.sum(F.when(F.col("l_returnflag") == "R", F.col("n")).otherwise(0)),
        }))
        .unionByName(measure(by_source, {"documents": F.sum("n"), "documents_max": F.max("top")}))
        .withColumnRenamed("actual", "expected")
    )
    return check_counts(pins, measured)


@work.query(
    "i4_check_floors",
    """
WITH sizes AS (SELECT source AS label, sum(octet_length(encode(text)))::BIGINT AS actual
               FROM documents GROUP BY 1),
floors AS (
  SELECT source AS label, count(*) * 2400 AS floor FROM documents GROUP BY 1
  UNION ALL SELECT DISTINCT 'gone_' || source, 1 FROM documents)
SELECT label, floor, actual,
       CASE WHEN actual IS NULL THEN 'missing' WHEN actual < floor THEN 'below_floor' ELSE 'ok' END AS status
FROM floors LEFT JOIN sizes USING (label)
""",
)
def i4_check_floors(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    sizes = docs.groupBy(F.col("source").alias("label")).agg(
        F.sum(F.octet_length("text").cast("long")).alias("actual")
    )
    counts = docs.groupBy(F.col("source").alias("label")).agg(
        (F.count(F.lit(1)) * 2400).alias("floor")
    )
    gone = docs.select(
        F.concat(F.lit("gone_"), "source").alias("label"), F.lit(1).cast("long").alias("floor")
    ).distinct()
    return check_floors(sizes, counts.unionByName(gone))


@work.query(
    "i5_at_least",
    """
SELECT 'documents' AS label, least(count(*), 501) AS counted, count(*) > 500 AS enough FROM documents
UNION ALL SELECT 'lineitem', least(count(*), 50000001), count(*) > 50000000 FROM lineitem
""",
)
def i5_at_least(spark, sf_dir):
    few = at_least(table(spark, sf_dir, "documents"), 500)
    many = at_least(table(spark, sf_dir, "lineitem"), 50_000_000)
    return few.select(F.lit("documents").alias("label"), "*").unionByName(
        many.select(F.lit("lineitem").alias("label"), "*")
    )


@work.query(
    "i6_dump_complete",
    """
SELECT 'doc_' || doc_id AS file,
       contains(hex(tail), '0A2D2D2044756D7020636F6D706C65746564')
       OR starts_with(hex(tail), '2D2D2044756D7020636F6D706C65746564') AS complete
FROM (SELECT doc_id, encode(body)[-200:] AS tail
      FROM (SELECT doc_id, text || chr(10)
                   || CASE WHEN doc_id % 3 <> 0 THEN '-- Dump completed on a day' || chr(10) ELSE '' END
                   || CASE WHEN doc_id % 7 = 0 THEN repeat('z', 150 + (doc_id % 60)::INTEGER) || chr(10)
                           ELSE '' END AS body
            FROM documents))
""",
)
def i6_dump_complete(spark, sf_dir):
    by = lambda n: F.pmod("doc_id", F.lit(n))
    body = F.concat(
        "text",
        F.when(by(3) != 0, F.lit("\n-- Dump completed on a day")).otherwise(F.lit("")),
        F.when(
            by(7) == 0,
            F.concat(F.lit("\n"), F.repeat(F.lit("z"), (F.lit(150) + by(60)).cast("int"))),
        ).otherwise(F.lit("")),
    )
    lines = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("file"),
        F.posexplode(F.split(body, "\n")).alias("line_no", "line"),
    )
    return dump_complete(lines)


# A violation is stated by which fault the entry was given, and an escape by counting steps up.
FAULTS_SQL = ARCHIVE_SQL + """,
octal AS (SELECT 438 AS mode, '0666' AS o UNION ALL SELECT 2541, '4755' UNION ALL SELECT 1533, '2775'),
faults AS (
  SELECT root, seq, 'hard link' AS category, path || ' -> ' || link_target AS detail, 'archive' AS profile
  FROM archive WHERE kind = 'hardlink'
  UNION ALL
  SELECT root, seq, 'symlink escapes the tree', path || ' -> ' || link_target, 'both'
  FROM archive WHERE kind = 'symlink'
    AND len(regexp_extract_all(link_target, '\\.\\./')) > len(string_split(path, '/')) - 1
  UNION ALL
  SELECT root, seq, 'setuid/setgid', path || ' (' || o || ')',
         CASE WHEN kind = 'file' THEN 'both' ELSE 'tree' END
  FROM archive JOIN octal USING (mode) WHERE mode >= 1024 AND kind IN ('file', 'dir', 'hardlink')
  UNION ALL
  SELECT root, seq, 'world-writable', path || ' (' || o || ')', 'tree'
  FROM archive JOIN octal USING (mode) WHERE (mode & 2) <> 0 AND kind IN ('file', 'dir', 'hardlink'))
"""
AUDIT_SQL = FAULTS_SQL + """
SELECT root, category, count(*)::BIGINT AS n,
       array_to_string(array_agg(detail ORDER BY seq)[1:3], '; ') AS examples
FROM faults WHERE profile IN ('both', '{profile}') GROUP BY root, category
"""


@work.query("i10_audit_archive", "WITH " + AUDIT_SQL.replace("{profile}", "archive"))
def i10_audit_archive(spark, sf_dir):
    return audit_entries(archive_entries(spark, sf_dir), "archive")


@work.query("i10_audit_tree", "WITH " + AUDIT_SQL.replace("{profile}", "tree"))
def i10_audit_tree(spark, sf_dir):
    return audit_entries(archive_entries(spark, sf_dir), "tree")


@work.query(
    "i10_entry_violations",
    "WITH " + FAULTS_SQL + "SELECT root, seq, category, detail FROM faults WHERE profile <> 'tree'",
)
def i10_entry_violations(spark, sf_dir):
    return entry_violations(archive_entries(spark, sf_dir))


@work.query(
    "i11_audit_assignment",
    _fill(
        MEMBERS_SQL
        + """,
marked AS (
  SELECT *, TRY_CAST(nullif(regexp_extract(path, 'doc_([0-9]+)\\.txt$', 1), '') AS BIGINT) AS doc
  FROM full_members),
faulty AS (
  SELECT bucket, path, kind FROM marked
  WHERE coalesce(doc % 43 <> 0, true) AND NOT (kind = 'dir' AND path LIKE '%/3')
  UNION ALL SELECT bucket + 1, path, kind FROM marked WHERE doc % 53 = 0 AND doc % 43 <> 0
  UNION ALL SELECT bucket, path || '.orig', kind FROM marked WHERE doc % 47 = 0)
SELECT path, 'missing' AS category, 0::BIGINT AS copies FROM tree WHERE path NOT IN (SELECT path FROM faulty)
UNION ALL
SELECT path, 'extra', count(*) FROM faulty WHERE path NOT IN (SELECT path FROM tree) GROUP BY path
UNION ALL
SELECT path, 'duplicate_file', count(*) FROM faulty
WHERE kind <> 'dir' AND path IN (SELECT path FROM tree) GROUP BY path HAVING count(*) > 1
UNION ALL
SELECT a, 'implicit_ancestor', 1
FROM (SELECT DISTINCT array_to_string(string_split(path, '/')[1:d], '/') AS a
      FROM faulty, range(1, 4) AS r(d) WHERE d < len(string_split(path, '/')))
WHERE a NOT IN (SELECT path FROM faulty)
""",
        TREE_LIMIT,
        TREE_CEILING,
    ),
)
def i11_audit_assignment(spark, sf_dir):
    entries, _, members = tree_assignment(spark, sf_dir)
    digits = F.regexp_extract("path", r"doc_(\d+)\.txt$", 1)
    full = stage(with_ancestors(members), "members").withColumn("doc", F.nullif(digits, F.lit("")).cast("long"))

    def by(n: int):
        return F.coalesce(F.pmod("doc", F.lit(n)) == 0, F.lit(False))

    lost = (F.col("kind") == "dir") & F.col("path").endswith("/3")
    faulty = (
        full.filter(~by(43) & ~lost)
        .unionByName(full.filter(by(53) & ~by(43)).withColumn("bucket", F.col("bucket") + 1))
        .unionByName(full.filter(by(47)).withColumn("path", F.concat("path", F.lit(".orig"))))
    )
    return audit_assignment(entries, stage(faulty, "faulty")).drop("root")


@work.query(
    "i13_required_files",
    """
WITH files AS (
  SELECT lang || '/' || source AS dir, 'part_' || (doc_id % 10) || '.bin' AS name,
         sum(octet_length(encode(text)))::BIGINT AS size
  FROM documents GROUP BY 1, 2),
wanted AS (
  SELECT DISTINCT lang || '/' || source AS dir, 'part_' || k || '.bin' AS name
  FROM documents, range(0, 10) AS r(k))
SELECT 'corpus' AS root, dir, name, size, CASE WHEN size IS NULL THEN 'missing' ELSE 'too_small' END AS status
FROM wanted LEFT JOIN files USING (dir, name)
WHERE size IS NULL OR (name = 'part_0.bin' AND size <= 9000)
""",
)
def i13_required_files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("dir", F.concat_ws("/", "lang", "source"))
    name = F.concat(F.lit("part_"), F.pmod("doc_id", F.lit(10)).cast("string"), F.lit(".bin"))
    entries = docs.groupBy(
        F.lit("corpus").alias("root"), F.concat_ws("/", "dir", name).alias("path")
    ).agg(F.sum(F.octet_length("text").cast("long")).alias("size")).withColumn("kind", F.lit("file"))
    dirs = docs.select(F.lit("corpus").alias("root"), "dir").distinct()
    return required_files(
        entries, dirs, [f"part_{k}.bin" for k in range(10)], sized="part_0.bin", min_size=9000
    )


@work.query(
    "i14_ownership_audit",
    "WITH " + ARCHIVE_SQL + """
SELECT root, path, uid, gid FROM archive WHERE uid <> 1000 OR gid <> 1000
""",
)
def i14_ownership_audit(spark, sf_dir):
    return ownership_audit(archive_entries(spark, sf_dir), 1000, 1000)


@work.query(
    "i14_ownership_first",
    "WITH " + ARCHIVE_SQL + """
SELECT root, path, uid, gid FROM archive WHERE uid <> 1000 OR gid <> 1000 ORDER BY path LIMIT 10
""",
)
def i14_ownership_first(spark, sf_dir):
    return ownership_audit(archive_entries(spark, sf_dir), 1000, 1000, first=10)
