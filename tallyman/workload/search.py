"""Corpus, search and comparison queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyman.functions import origin_rebased
from tallyman.operators.compare import (
    best_version,
    compare_rankings,
    field_diff,
    page_diff,
    reset_above,
)
from tallyman.operators.ordered import with_row_number
from tallyman.operators.search import (
    bm25_topk,
    build_postings,
    read_postings,
    to_search_docs,
    write_postings,
)
from tallyman.session import scratch_path
from tallyman.workload.fixtures import document_path, events, hex_digest, table
from tallyman.workload.registry import Workload

work = Workload()

TOKENS_SQL = r"""
tokens AS (
  SELECT doc_id::VARCHAR AS id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '') AS words
  FROM documents),
placed AS (
  SELECT id, unnest(words) AS term, unnest(range(0, len(words))) AS position FROM tokens),
postings AS (
  SELECT term, id, count(*)::INTEGER AS tf, string_agg(position::VARCHAR, ',' ORDER BY position) AS positions
  FROM placed GROUP BY ALL),
terms AS (SELECT term, count(*)::BIGINT AS df FROM postings GROUP BY term),
docs AS (SELECT id, len(words)::BIGINT AS length FROM tokens)
"""


def corpus(spark, sf_dir):
    return to_search_docs(table(spark, sf_dir, "documents"), "doc_id", ["text"])


@work.query(
    "c1_to_search_docs",
    """
SELECT p_partkey::VARCHAR AS id, p_name || ' ' || p_brand || ' ' || p_type AS contents,
       '{"p_brand":"' || p_brand || '","p_size":' || p_size || '}' AS raw
FROM part
""",
)
def c1_to_search_docs(spark, sf_dir):
    return to_search_docs(
        table(spark, sf_dir, "part"), "p_partkey", ["p_name", "p_brand", "p_type"], ["p_brand", "p_size"]
    )


@work.query("c2_postings", "WITH " + TOKENS_SQL + "SELECT term, id, tf, positions, length FROM postings JOIN docs USING (id)")
def c2_postings(spark, sf_dir):
    postings = build_postings(corpus(spark, sf_dir)).postings
    return postings.withColumn(
        "positions", F.array_join(F.col("positions").cast("array<string>"), ",")
    )


@work.query("c2_terms", "WITH " + TOKENS_SQL + "SELECT term, df FROM terms")
def c2_terms(spark, sf_dir):
    return build_postings(corpus(spark, sf_dir), positions=False).terms


BM25_SQL = "WITH " + TOKENS_SQL + r""",
asked AS (
  SELECT item_id AS query, term, count(*) AS asked
  FROM (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '')) AS term
        FROM benchmark) GROUP BY ALL),
corpus AS (SELECT count(*) AS n, avg(length) AS avg_length FROM docs),
scored AS (
  SELECT a.query, p.id,
         round(sum(a.asked * ln(1.0::DOUBLE + (c.n - t.df + 0.5::DOUBLE) / (t.df + 0.5::DOUBLE))
             * p.tf * 2.2::DOUBLE
             / (p.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * d.length / c.avg_length))), 6) AS score
  FROM asked a JOIN terms t USING (term) JOIN postings p USING (term) JOIN docs d ON d.id = p.id, corpus c
  GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id)::INTEGER AS position FROM scored)
SELECT query, id, score, position FROM ranked WHERE position <= 10
"""


@work.query("c3_bm25_topk", BM25_SQL)
def c3_bm25_topk(spark, sf_dir):
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text")
    index = build_postings(corpus(spark, sf_dir), positions=False).staged()
    return bm25_topk(index, queries, 10)


@work.query("c3_bm25_stored_index", BM25_SQL)
def c3_bm25_stored_index(spark, sf_dir):
    path = scratch_path(spark, "index")
    write_postings(build_postings(corpus(spark, sf_dir)), path, buckets=8)
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text")
    return bm25_topk(read_postings(spark, path), queries, 10)


@work.query(
    "c4_compare_rankings",
    """
WITH scores AS (
  SELECT user_id AS query, event_id AS id, floor(value / 4) AS a,
         CASE WHEN user_id % 3 = 2 AND event_id % 5 = 0 THEN floor(value / 4) + 1 ELSE floor(value / 4) END AS b
  FROM events),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY a DESC, id) AS pa,
         row_number() OVER (PARTITION BY query
                            ORDER BY b DESC, CASE WHEN query % 3 = 1 THEN -id ELSE id END) AS pb
  FROM scores),
places AS (
  SELECT x.query, count(*) FILTER (x.id <> y.id) AS moved, count(*) FILTER (x.a <> y.b) AS differing
  FROM ranked x JOIN ranked y ON x.query = y.query AND x.pa = y.pb GROUP BY 1),
docs AS (SELECT query, count(*) FILTER (a <> b) AS rescored FROM scores GROUP BY 1)
SELECT query, CASE WHEN differing + rescored > 0 THEN 'different' WHEN moved > 0 THEN 'permuted'
                   ELSE 'identical' END AS status,
       moved, differing + rescored AS differing
FROM places JOIN docs USING (query)
""",
)
def c4_compare_rankings(spark, sf_dir):
    rows_in = events(spark, sf_dir)
    base = F.floor(F.col("value") / 4).cast("double")
    third = F.pmod("user_id", F.lit(3))
    bumped = base + F.when((third == 2) & (F.pmod("event_id", F.lit(5)) == 0), 1.0).otherwise(0.0)
    turned = F.when(third == 1, -F.col("event_id")).otherwise(F.col("event_id"))

    # A global position ranks within each query too, and both sides have the same rows.
    def ranking(score, tie):
        rows = rows_in.select(
            F.col("user_id").alias("query"), F.col("event_id").alias("id"), score.alias("score"), tie.alias("tie")
        )
        return with_row_number(rows, ["query", F.desc("score"), "tie"], "position").drop("tie")

    return compare_rankings(ranking(base, F.col("event_id")), ranking(bumped, turned))


@work.query(
    "c5_page_diff",
    """
WITH a AS (SELECT page_id AS page, replace(html, '</a>', '</a> http://up:1/x') AS content FROM pages),
b AS (
  SELECT page_id AS page, replace(html, '</a>', '</a> http://up:1/x')
         || CASE WHEN page_id % 4 = 0 THEN chr(10) || '<p>added</p>' ELSE '' END
         || CASE WHEN page_id % 6 = 0 THEN chr(10) || '<p>more</p>' ELSE '' END AS content
  FROM pages),
lines AS (
  SELECT page, unnest(string_split(content, chr(10))) AS line, 1 AS n FROM a
  UNION ALL SELECT page, unnest(string_split(content, chr(10))), -1 FROM b),
diffs AS (SELECT page, line, sum(n) AS n FROM lines GROUP BY ALL HAVING sum(n) <> 0)
SELECT p.page_id AS page, coalesce(sum(n) FILTER (n > 0), 0)::BIGINT AS only_left,
       coalesce(-sum(n) FILTER (n < 0), 0)::BIGINT AS only_right,
       array_to_string(list(CASE WHEN n > 0 THEN '< ' ELSE '> ' END || line ORDER BY line)
                       FILTER (n IS NOT NULL)[1:3], chr(10)) AS sample
FROM pages p LEFT JOIN diffs d ON d.page = p.page_id GROUP BY 1
""",
)
def c5_page_diff(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    by = lambda n: F.pmod("page_id", F.lit(n)) == 0

    def linked(origin: str):
        return F.replace("html", F.lit("</a>"), F.lit(f"</a> {origin}/x"))

    left = pages.select(F.col("page_id").alias("page"), linked("http://up:1").alias("content"))
    right = pages.select(
        F.col("page_id").alias("page"),
        F.concat(
            linked("http://ours:8080"),
            F.when(by(4), F.lit("\n<p>added</p>")).otherwise(F.lit("")),
            F.when(by(6), F.lit("\n<p>more</p>")).otherwise(F.lit("")),
        ).alias("content"),
    )
    return page_diff(
        left, right, lambda line: origin_rebased(line, "http://ours:8080", "http://up:1")
    )


@work.query(
    "c6_field_diff",
    """
WITH b AS (
  SELECT c_custkey, CASE WHEN c_custkey % 20 = 0 THEN c_name || '!' ELSE c_name END AS c_name, c_nationkey,
         CASE WHEN c_custkey % 30 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal, c_mktsegment
  FROM customer WHERE c_custkey % 40 <> 1
  UNION ALL SELECT -c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 70 = 2),
j AS (SELECT a.*, b.c_name AS n2, b.c_nationkey AS k2, b.c_acctbal AS a2, b.c_mktsegment AS m2
      FROM customer a JOIN b USING (c_custkey))
SELECT 'c_name' AS field, count(*) FILTER (c_name IS DISTINCT FROM n2) AS differing FROM j
UNION ALL SELECT 'c_nationkey', count(*) FILTER (c_nationkey IS DISTINCT FROM k2) FROM j
UNION ALL SELECT 'c_acctbal', count(*) FILTER (c_acctbal IS DISTINCT FROM a2) FROM j
UNION ALL SELECT 'c_mktsegment', count(*) FILTER (c_mktsegment IS DISTINCT FROM m2) FROM j
UNION ALL SELECT '<only_left>', count(*) FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM b)
UNION ALL SELECT '<only_right>', count(*) FROM b WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)
""",
)
def c6_field_diff(spark, sf_dir):
    left = table(spark, sf_dir, "customer")
    by = lambda n: F.pmod("c_custkey", F.lit(n))
    right = (
        left.filter(by(40) != 1)
        .withColumn(
            "c_name",
            F.when(by(20) == 0, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name")),
        )
        .withColumn("c_acctbal", F.when(by(30) != 0, F.col("c_acctbal")))
        .unionByName(left.filter(by(70) == 2).withColumn("c_custkey", -F.col("c_custkey")))
    )
    return field_diff(left, right, ["c_custkey"])


@work.query(
    "c7_reset_above",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders",
)
def c7_reset_above(spark, sf_dir):
    baseline = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"
    )
    boundary = int(baseline.agg(F.max("o_orderkey")).first()[0] * 0.9)
    key = F.col("o_orderkey")
    touched = key >= boundary
    current = baseline.filter(~touched | (F.pmod(key, F.lit(3)) != 0)).withColumn(
        "o_totalprice",
        F.when(touched & (F.pmod(key, F.lit(5)) == 0), F.lit(0.0)).otherwise(F.col("o_totalprice")),
    )
    return reset_above(current, baseline, "o_orderkey", boundary)


@work.query(
    "c8_best_version",
    """
WITH files AS (SELECT doc_id, k FROM documents, range(0, 5) AS r(k)),
counts AS (
  SELECT 'v' || k AS version, count(*)::BIGINT AS files,
         count(*) FILTER (doc_id % (k + 2) <> 0)::BIGINT AS matching FROM files GROUP BY 1)
SELECT *, row_number() OVER w::BIGINT AS rank, matching - lead(matching) OVER w AS lead FROM counts
WINDOW w AS (ORDER BY matching DESC, version)
""",
)
def c8_best_version(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    observed = docs.select(document_path().alias("path"), hex_digest(F.col("text")).alias("sha256"))
    k = F.col("k")
    candidates = docs.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4)))).select(
        F.concat(F.lit("v"), k.cast("string")).alias("version"),
        document_path().alias("path"),
        F.when(F.pmod("doc_id", k + 2) != 0, hex_digest(F.col("text")))
        .otherwise(hex_digest(F.concat("text", F.lit("-"), k.cast("string"))))
        .alias("sha256"),
    )
    return best_version(observed, candidates)
