"""Roll-up and packing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyman.functions import entry_cost
from tallyman.operators.packing import (
    bucket_report,
    pack_first_fit,
    pack_next_fit,
    pad_unused,
    shard_by_key,
)
from tallyman.operators.rollup import (
    expand_pieces,
    frontier,
    subtree_sizes,
    tree_cost,
    with_ancestors,
)
from tallyman.plans import pack_archive, pack_tree
from tallyman.session import stage
from tallyman.workload.fixtures import (
    ARCHIVE_LIMIT,
    ARCHIVE_SQL,
    LEAST_BUCKETS,
    TREE_LIMIT,
    TREE_SQL,
    archive_entries,
    table,
    tree_entries,
)
from tallyman.workload.registry import Workload

work = Workload()

COST_SQL = TREE_SQL + """,
costed AS (
  SELECT *, CASE WHEN kind IN ('dir', 'symlink') THEN 512
                 ELSE 512 + ((size + 511) // 512) * 512 END
          + CASE WHEN octet_length(encode('corpus/' || path)) > 100
                 THEN 512 + ((octet_length(encode('corpus/' || path)) + 1 + 511) // 512) * 512
                 ELSE 0 END AS cost
  FROM tree)
"""
SIZES_SQL = COST_SQL + """,
sizes AS (
  SELECT n.root, n.path, n.kind, sum(e.cost)::BIGINT AS bytes, count(*)::BIGINT AS nodes
  FROM costed n JOIN costed e ON e.path = n.path OR starts_with(e.path, n.path || '/')
  GROUP BY ALL
  UNION ALL
  SELECT 'corpus', '', 'dir', (sum(cost) + 512)::BIGINT, (count(*) + 1)::BIGINT FROM costed)
"""
PIECES_SQL = SIZES_SQL + """,
holders AS (
  SELECT s.*, CASE WHEN path LIKE '%/%' THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS up
  FROM sizes s WHERE path <> ''),
pieces AS (
  SELECT h.root, h.path, h.kind, h.bytes,
         CASE WHEN h.bytes > {limit} THEN 'oversize_file' ELSE 'ok' END AS status
  FROM holders h JOIN sizes p ON p.path = h.up
  WHERE (h.up = '' OR p.bytes > {limit}) AND (h.bytes <= {limit} OR h.kind <> 'dir'))
"""
# Buckets enough for any packing in which no two neighbours fit in one.
ROOM_SQL = f"room AS MATERIALIZED (SELECT greatest({LEAST_BUCKETS}, 2 * sum(cost) // {{limit}} + 2)::INTEGER AS n FROM %s)"
TREE_CEILING = ARCHIVE_CEILING = "(SELECT n FROM room)"
FIT_SQL = """
WITH RECURSIVE """ + PIECES_SQL + ",\n" + ROOM_SQL % "costed" + """,
line AS (
  SELECT *, row_number() OVER (ORDER BY string_split(path, '/')) AS n FROM pieces
  WHERE status = 'ok'),
fit AS (
  SELECT 0::BIGINT AS n, []::BIGINT[] AS used, NULL::INTEGER AS bucket
  UNION ALL
  SELECT l.n,
         CASE WHEN f.spot <= len(f.used)
              THEN list_transform(f.used, lambda u, i: CASE WHEN i = f.spot THEN u + l.bytes ELSE u END)
              WHEN len(f.used) < {buckets} THEN list_append(f.used, l.bytes)
              ELSE f.used END,
         CASE WHEN f.spot <= len(f.used) OR len(f.used) < {buckets} THEN (f.spot - 1)::INTEGER END
  FROM (SELECT f0.*, coalesce(list_position(list_transform(f0.used, lambda u: u + l0.bytes <= {limit}), true),
                              len(f0.used) + 1) AS spot
        FROM fit f0 JOIN line l0 ON l0.n = f0.n + 1) f
  JOIN line l ON l.n = f.n + 1),
packed AS (
  SELECT l.root, l.path, l.bytes, f.bucket,
         CASE WHEN f.bucket IS NULL THEN 'overflow' ELSE 'ok' END AS status
  FROM line l JOIN fit f ON f.n = l.n
  UNION ALL
  SELECT root, path, bytes, NULL, status FROM pieces WHERE status <> 'ok')
"""


def _fill(sql: str, limit: int, buckets: int | str = 0) -> str:
    return sql.replace("{buckets}", str(buckets)).replace("{limit}", str(limit))


def _ceiling(total: int | None, limit: int) -> int:
    return max(LEAST_BUCKETS, 2 * (total or 0) // limit + 2)


def tree_ceiling(spark, sf_dir, limit=TREE_LIMIT):
    """Buckets enough for the whole tree."""
    costs = tree_cost(tree_entries(spark, sf_dir))
    return _ceiling(costs.agg(F.sum("cost")).first()[0], limit)


def archive_ceiling(entries, limit=ARCHIVE_LIMIT):
    costs = entries.select(entry_cost(F.col("size"), F.col("kind")).alias("cost"))
    return _ceiling(costs.agg(F.sum("cost")).first()[0], limit)


@work.query(
    "p1_entry_cost",
    "WITH " + COST_SQL + " SELECT path, kind, size, cost::BIGINT AS cost FROM costed",
)
def p1_entry_cost(spark, sf_dir):
    return tree_cost(tree_entries(spark, sf_dir)).select("path", "kind", "size", "cost")


@work.query("p2_subtree_sizes", "WITH " + SIZES_SQL + " SELECT path, kind, bytes, nodes FROM sizes")
def p2_subtree_sizes(spark, sf_dir):
    return subtree_sizes(tree_entries(spark, sf_dir)).select("path", "kind", "bytes", "nodes")


@work.query(
    "p3_frontier",
    _fill("WITH " + PIECES_SQL + " SELECT path, kind, bytes, status FROM pieces", TREE_LIMIT),
)
def p3_frontier(spark, sf_dir):
    return frontier(tree_entries(spark, sf_dir), TREE_LIMIT).drop("root")


@work.query(
    "p3_frontier_oversize",
    _fill("WITH " + PIECES_SQL + " SELECT path, kind, bytes, status FROM pieces", 16_384),
)
def p3_frontier_oversize(spark, sf_dir):
    return frontier(tree_entries(spark, sf_dir), 16_384).drop("root")


@work.query(
    "p4_pack_first_fit",
    _fill(FIT_SQL + "SELECT path, bytes, bucket, status FROM packed", TREE_LIMIT, TREE_CEILING),
)
def p4_pack_first_fit(spark, sf_dir):
    pieces = frontier(tree_entries(spark, sf_dir), TREE_LIMIT)
    return pack_first_fit(pieces, TREE_LIMIT, tree_ceiling(spark, sf_dir)).drop("root")


@work.query(
    "p4_pack_overflow",
    _fill(FIT_SQL + "SELECT path, bytes, bucket, status FROM packed", 32_768, 40),
)
def p4_pack_overflow(spark, sf_dir):
    pieces = frontier(tree_entries(spark, sf_dir), 32_768)
    return pack_first_fit(pieces, 32_768, 40).drop("root")


NEXT_SQL = """
WITH RECURSIVE """ + ARCHIVE_SQL + """,
line AS (
  SELECT *, CASE WHEN kind IN ('dir', 'symlink') THEN 512
                 ELSE 512 + ((size + 511) // 512) * 512 END AS cost FROM archive),
""" + ROOM_SQL % "line" + """,
sums AS (SELECT *, sum(cost) OVER (ORDER BY seq) AS upto FROM line),
starts AS (
  SELECT 0 AS bucket, 1::BIGINT AS seq, 0::HUGEINT AS base
  UNION ALL
  SELECT s.bucket + 1, x.seq, x.upto - x.cost
  FROM starts s, LATERAL (
    SELECT seq, upto, cost FROM sums
    WHERE kind = 'file' AND seq > s.seq AND upto - s.base > {limit} ORDER BY seq LIMIT 1) x
  WHERE s.bucket < {buckets}),
placed AS (
  SELECT c.seq, c.path, c.kind, c.cost::BIGINT AS bytes, max(s.bucket) AS spot
  FROM sums c JOIN starts s ON c.seq >= s.seq GROUP BY ALL),
packed AS (
  SELECT seq, path, kind, bytes, CASE WHEN spot < {buckets} THEN spot END AS bucket,
         CASE WHEN spot < {buckets} THEN 'ok' ELSE 'overflow' END AS status FROM placed)
"""


@work.query(
    "p5_pack_next_fit",
    _fill(NEXT_SQL + "SELECT * FROM packed", ARCHIVE_LIMIT, ARCHIVE_CEILING),
)
def p5_pack_next_fit(spark, sf_dir):
    entries = stage(archive_entries(spark, sf_dir), "archive-entries")
    return pack_next_fit(entries, ARCHIVE_LIMIT, archive_ceiling(entries)).drop("root")


@work.query("p5_pack_next_fit_overflow", _fill(NEXT_SQL + "SELECT * FROM packed", 131_072, 12))
def p5_pack_next_fit_overflow(spark, sf_dir):
    return pack_next_fit(archive_entries(spark, sf_dir), 131_072, 12).drop("root")


@work.query(
    "p5_shard_by_key",
    """
WITH RECURSIVE keys AS (
  SELECT l_orderkey, (sum(l_quantity)::BIGINT * 64) AS bytes FROM lineitem GROUP BY 1),
sums AS (SELECT *, sum(bytes) OVER (ORDER BY l_orderkey) AS upto FROM keys),
starts AS (
  SELECT 0::BIGINT AS shard, (SELECT min(l_orderkey) FROM keys) AS k, 0::HUGEINT AS base
  UNION ALL
  SELECT s.shard + 1, x.l_orderkey, x.upto - x.bytes
  FROM starts s, LATERAL (
    SELECT * FROM sums WHERE l_orderkey > s.k AND upto - s.base > 1000000
    ORDER BY l_orderkey LIMIT 1) x)
SELECT c.l_orderkey, c.bytes::BIGINT AS bytes, max(s.shard)::BIGINT AS shard
FROM sums c JOIN starts s ON c.l_orderkey >= s.k GROUP BY ALL
""",
)
def p5_shard_by_key(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", (F.col("l_quantity").cast("long") * 64).alias("bytes")
    )
    return shard_by_key(lines, "l_orderkey", "bytes", 1_000_000)


def tree_assignment(spark, sf_dir, limit=TREE_LIMIT, buckets=None):
    """Entries of the tree and the members of each bucket, before ancestors are added."""
    entries = stage(tree_entries(spark, sf_dir), "tree-entries")
    buckets = buckets or tree_ceiling(spark, sf_dir, limit)
    packed = stage(pack_first_fit(frontier(entries, limit), limit, buckets), "packed")
    return entries, packed, stage(expand_pieces(packed, entries), "expanded")


MEMBERS_SQL = FIT_SQL + """,
members AS (
  SELECT t.root, p.bucket, t.path, t.kind FROM tree t
  JOIN packed p ON t.path = p.path OR starts_with(t.path, p.path || '/')
  WHERE p.bucket IS NOT NULL),
full_members AS (
  SELECT * FROM members
  UNION
  SELECT root, bucket, array_to_string(string_split(path, '/')[1:d], '/'), 'dir'
  FROM members, range(1, 4) AS r(d) WHERE d < len(string_split(path, '/')))
"""


@work.query(
    "p6_with_ancestors",
    _fill(MEMBERS_SQL + "SELECT bucket, path, kind FROM full_members", TREE_LIMIT, TREE_CEILING),
)
def p6_with_ancestors(spark, sf_dir):
    _, _, members = tree_assignment(spark, sf_dir)
    return with_ancestors(members).select("bucket", "path", "kind")


@work.query(
    "p7_pad_unused",
    _fill(
        MEMBERS_SQL
        + """
SELECT u.bucket::INTEGER AS bucket, t.path, 'padding' AS status,
       (SELECT count(DISTINCT bucket) FROM members)::INTEGER AS needed
FROM (SELECT unnest(range(0, {buckets})) AS bucket) AS u, tree t
WHERE u.bucket NOT IN (SELECT bucket FROM members) AND t.kind = 'dir' AND t.path NOT LIKE '%/%'
""",
        TREE_LIMIT,
        TREE_CEILING,
    ),
)
def p7_pad_unused(spark, sf_dir):
    entries = tree_entries(spark, sf_dir)
    buckets = tree_ceiling(spark, sf_dir)
    packed = stage(pack_first_fit(frontier(entries, TREE_LIMIT), TREE_LIMIT, buckets), "packed")
    return pad_unused(packed, entries, buckets).drop("root")


@work.query(
    "p7_unpaddable",
    """
SELECT CAST(NULL AS INTEGER) AS bucket, CAST(NULL AS VARCHAR) AS path, 'unpaddable' AS status,
       count(DISTINCT s.source)::INTEGER AS needed, s.root
FROM (SELECT lang AS root, source FROM documents) s GROUP BY s.root
HAVING count(DISTINCT s.source) < 64
""",
)
def p7_unpaddable(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    flat = docs.select(
        F.col("lang").alias("root"),
        F.concat_ws("_", "source", F.col("doc_id").cast("string")).alias("path"),
        F.lit("file").alias("kind"),
        F.regexp_extract("source", r"(\d+)$", 1).cast("int").alias("bucket"),
    )
    return pad_unused(flat, flat, 64)


REPORT_SQL = """
SELECT bucket, count(*)::BIGINT AS entries, sum(bytes)::BIGINT AS bytes,
       (SELECT count(DISTINCT bucket) FROM packed)::INTEGER AS used, ({buckets})::INTEGER AS ceiling,
       (SELECT sum(bytes) FROM packed)::BIGINT AS total_bytes
FROM packed GROUP BY bucket
"""


@work.query("p8_bucket_report", _fill(FIT_SQL + REPORT_SQL, TREE_LIMIT, TREE_CEILING))
def p8_bucket_report(spark, sf_dir):
    pieces = frontier(tree_entries(spark, sf_dir), TREE_LIMIT)
    buckets = tree_ceiling(spark, sf_dir)
    packed = stage(pack_first_fit(pieces, TREE_LIMIT, buckets), "packed")
    return bucket_report(packed, buckets).drop("root")


@work.query("p8_bucket_report_overflow", _fill(FIT_SQL + REPORT_SQL, 32_768, 40))
def p8_bucket_report_overflow(spark, sf_dir):
    """Too few buckets: what has none is a row of its own."""
    pieces = frontier(tree_entries(spark, sf_dir), 32_768)
    return bucket_report(stage(pack_first_fit(pieces, 32_768, 40), "packed"), 40).drop("root")


@work.query(
    "plan_pack_tree_members",
    _fill(
        MEMBERS_SQL
        + """
SELECT root, bucket, path, kind FROM full_members
UNION ALL
SELECT t.root, u.bucket::INTEGER, t.path, 'dir' FROM (SELECT unnest(range(0, {buckets})) AS bucket) AS u, tree t
WHERE u.bucket NOT IN (SELECT bucket FROM members) AND t.kind = 'dir' AND t.path NOT LIKE '%/%'
""",
        TREE_LIMIT,
        TREE_CEILING,
    ),
)
def plan_pack_tree_members(spark, sf_dir):
    entries = stage(tree_entries(spark, sf_dir), "tree-entries")
    return pack_tree(entries, TREE_LIMIT, tree_ceiling(spark, sf_dir)).members


@work.query(
    "plan_pack_tree_problems",
    _fill(
        MEMBERS_SQL
        + """
SELECT root, path, status AS category FROM packed WHERE status <> 'ok'
UNION ALL SELECT root, path, 'missing' FROM tree WHERE path NOT IN (SELECT path FROM full_members)
""",
        32_768,
        40,
    ),
)
def plan_pack_tree_problems(spark, sf_dir):
    return pack_tree(tree_entries(spark, sf_dir), 32_768, 40).problems


@work.query(
    "plan_pack_archive_report",
    _fill(
        NEXT_SQL
        + """
SELECT 'corpus' AS root, bucket, count(*)::BIGINT AS entries, sum(bytes)::BIGINT AS bytes,
       (SELECT count(DISTINCT bucket) FROM packed)::INTEGER AS used, ({buckets})::INTEGER AS ceiling,
       (SELECT sum(bytes) FROM packed)::BIGINT AS total_bytes
FROM packed GROUP BY bucket
""",
        ARCHIVE_LIMIT,
        ARCHIVE_CEILING,
    ),
)
def plan_pack_archive_report(spark, sf_dir):
    entries = stage(archive_entries(spark, sf_dir), "archive-entries")
    return pack_archive(entries, "", ARCHIVE_LIMIT, archive_ceiling(entries)).report


ARCHIVE_MEMBERS_SQL = NEXT_SQL + """,
clean AS (
  SELECT *, CASE WHEN kind IN ('file', 'dir') THEN mode & ~2 ELSE mode END AS fixed FROM archive),
placed_members AS (SELECT p.bucket, c.* FROM packed p JOIN clean c USING (seq) WHERE p.bucket IS NOT NULL),
dirs AS (
  SELECT DISTINCT bucket, array_to_string(string_split(path, '/')[1:d], '/') AS path
  FROM placed_members, range(1, 5) AS r(d)
  WHERE d < len(string_split(path, '/')) OR (kind = 'dir' AND d = len(string_split(path, '/')))
  UNION
  SELECT u.bucket::INTEGER, path FROM (SELECT unnest(range(0, {buckets})) AS bucket) u, archive
  WHERE u.bucket NOT IN (SELECT bucket FROM placed_members) AND kind = 'dir' AND path NOT LIKE '%/%')
"""


@work.query(
    "plan_pack_archive_members",
    _fill(
        ARCHIVE_MEMBERS_SQL
        + """
SELECT bucket, path, kind, size, fixed::INTEGER AS mode, uid, gid, link_target FROM placed_members WHERE kind <> 'dir'
UNION ALL
SELECT d.bucket, d.path, 'dir', c.size, c.fixed::INTEGER, c.uid, c.gid, c.link_target
FROM dirs d LEFT JOIN clean c ON c.path = d.path AND c.kind = 'dir'
""",
        ARCHIVE_LIMIT,
        ARCHIVE_CEILING,
    ),
)
def plan_pack_archive_members(spark, sf_dir):
    entries = stage(archive_entries(spark, sf_dir), "archive-entries")
    packing = pack_archive(entries, "", ARCHIVE_LIMIT, archive_ceiling(entries))
    return packing.members.select("bucket", "path", "kind", "size", "mode", "uid", "gid", "link_target")
