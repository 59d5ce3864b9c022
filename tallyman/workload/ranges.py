"""Range cutting, naming and assembly queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyman.operators.ranges import (
    assembly_plan,
    containment,
    cut_ranges,
    fixed_chunks,
    part_coverage,
    part_names,
    resolve_parts,
    sub_chunks,
)
from tallyman.plans import split_archives
from tallyman.session import stage
from tallyman.workload.fixtures import CONVERSATION_SQL, conversation_ranges, table
from tallyman.workload.registry import Workload

work = Workload()

PART = 20_000
SLICE = 9_000

CUT_SQL = "WITH RECURSIVE " + CONVERSATION_SQL + f""",
shield AS (SELECT * FROM talks WHERE turns >= 3),
cuts AS (
  SELECT archive, 0::BIGINT AS pos FROM whole
  UNION ALL
  SELECT c.archive,
         coalesce((SELECT CASE WHEN s > c.pos THEN s ELSE e END FROM shield h
                   WHERE h.archive = c.archive AND s < c.pos + {PART} AND c.pos + {PART} < e),
                  c.pos + {PART})
  FROM cuts c JOIN whole w ON w.archive = c.archive WHERE w.total - c.pos > {PART}),
parts AS (
  SELECT c.archive, (row_number() OVER p - 1)::INTEGER AS part, pos AS s,
         coalesce(lead(pos) OVER p, total)::BIGINT AS e
  FROM cuts c JOIN whole w ON w.archive = c.archive
  WINDOW p AS (PARTITION BY c.archive ORDER BY pos))
"""


def _archives(talks):
    return talks.groupBy("archive").agg(F.max("end").alias("total"))


def _split(spark, sf_dir):
    talks = stage(conversation_ranges(spark, sf_dir), "talks")
    shield = talks.filter("turns >= 3")
    return split_archives(
        _archives(talks), shield, F.concat("archive", F.lit(".zim")), PART, 16_000, 7_000
    )


@work.query("p9_cut_ranges", CUT_SQL + 'SELECT archive, part, s AS "start", e AS "end" FROM parts')
def p9_cut_ranges(spark, sf_dir):
    talks = conversation_ranges(spark, sf_dir)
    return cut_ranges(_archives(talks), talks.filter("turns >= 3"), PART)


@work.query(
    "p10_containment",
    "WITH " + CONVERSATION_SQL + f""",
slices AS (
  SELECT archive, k::INTEGER AS part, k * {SLICE} AS s, least((k + 1) * {SLICE}, total) AS e
  FROM whole w, LATERAL (SELECT unnest(range(0, (w.total + {SLICE} - 1) // {SLICE})) AS k) x
  WHERE k % 7 <> 3)
SELECT t.archive, t.name, t.s AS "start", t.e AS "end",
       max(CASE WHEN p.s <= t.s AND t.e <= p.e THEN p.part END)::INTEGER AS home,
       count(p.part)::BIGINT AS spans, min(p.part)::INTEGER AS first_part, max(p.part)::INTEGER AS last_part
FROM talks t LEFT JOIN slices p ON p.archive = t.archive AND p.s < greatest(t.e, t.s + 1) AND t.s < p.e
GROUP BY ALL
""",
)
def p10_containment(spark, sf_dir):
    talks = conversation_ranges(spark, sf_dir)
    files = _archives(talks).select(F.col("archive").alias("name"), F.col("total").alias("bytes"))
    parts = fixed_chunks(files, SLICE).select(
        F.col("name").alias("archive"),
        F.col("chunk").alias("part"),
        F.col("offset").alias("start"),
        (F.col("offset") + F.col("bytes")).alias("end"),
    )
    # Some slices are lost, so that ranges stand in gaps.
    return containment(parts.filter("part % 7 <> 3"), talks)


CHUNK_SQL = CUT_SQL + """,
chunks AS (
  SELECT archive, part, CASE WHEN b > 16000 THEN i END::BIGINT AS chunk,
         (s + i * (b // n) + least(i, b % n))::BIGINT AS "offset",
         (b // n + CASE WHEN i < b % n THEN 1 ELSE 0 END)::BIGINT AS bytes
  FROM (SELECT *, e - s AS b, CASE WHEN e - s > 16000 THEN (e - s + 6999) // 7000 ELSE 1 END AS n
        FROM parts) p, LATERAL (SELECT unnest(range(0, p.n)) AS i) x)
"""


@work.query("p11_sub_chunks", CHUNK_SQL + "SELECT * FROM chunks")
def p11_sub_chunks(spark, sf_dir):
    return sub_chunks(_split(spark, sf_dir).parts, 16_000, 7_000)


@work.query(
    "plan_split_files",
    CHUNK_SQL + """
SELECT *, archive || '.zim' || chr((97 + part // 26)::INTEGER) || chr((97 + part % 26)::INTEGER)
          || CASE WHEN chunk IS NULL THEN '' ELSE '.part' || printf('%02d', chunk) END AS name,
       'ok' AS status
FROM chunks
""",
)
def plan_split_files(spark, sf_dir):
    return _split(spark, sf_dir).files


@work.query(
    "plan_split_homes",
    CUT_SQL + """
SELECT t.archive, t.name, t.s AS "start", t.e AS "end", p.part AS home, 1::BIGINT AS spans,
       p.part AS first_part, p.part AS last_part
FROM shield t JOIN parts p ON p.archive = t.archive AND p.s <= t.s AND t.e <= p.e
""",
)
def plan_split_homes(spark, sf_dir):
    return _split(spark, sf_dir).homes


@work.query(
    "p12_fixed_chunks",
    """
SELECT 'doc_' || doc_id AS name, k::INTEGER AS chunk,
       'doc_' || doc_id || '.part-' || CASE WHEN k < 100 THEN lpad(k::VARCHAR, 2, '0') ELSE k::VARCHAR END
         AS chunk_name,
       (k * 200)::BIGINT AS "offset", least(200, b - k * 200)::BIGINT AS bytes
FROM (SELECT doc_id, octet_length(encode(text))::BIGINT AS b FROM documents) d,
     LATERAL (SELECT unnest(range(0, (d.b + 199) // 200)) AS k) x
""",
)
def p12_fixed_chunks(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("name"),
        F.octet_length("text").cast("long").alias("bytes"),
    )
    return fixed_chunks(files, 200)


@work.query(
    "p13_part_names",
    """
SELECT part::BIGINT AS part, chunk::BIGINT AS chunk,
       CASE WHEN part < 676 THEN
         'talks.zim' || chr((97 + part // 26)::INTEGER) || chr((97 + part % 26)::INTEGER)
         || CASE WHEN chunk IS NULL THEN '' ELSE '.part' || printf('%02d', chunk) END END AS name,
       CASE WHEN part < 676 THEN 'ok' ELSE 'unnameable' END AS status
FROM (SELECT doc_id AS part, CASE WHEN n_chars > 1000 THEN n_chars % 120 END AS chunk FROM documents)
""",
)
def p13_part_names(spark, sf_dir):
    chunks = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("part"),
        F.when(F.col("n_chars") > 1000, F.pmod("n_chars", F.lit(120))).alias("chunk"),
    )
    return part_names(chunks, F.lit("talks.zim"))


@work.query(
    "p14_resolve_parts",
    """
SELECT 'doc_' || doc_id AS output,
       CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 0 END::BIGINT AS parts,
       CASE doc_id % 4 WHEN 0 THEN n_chars WHEN 1 THEN 3 * n_chars + 3 WHEN 2 THEN n_chars END::BIGINT AS bytes,
       CASE doc_id % 4 WHEN 0 THEN 'whole' WHEN 1 THEN 'parts' WHEN 2 THEN 'whole' ELSE 'missing' END AS status
FROM documents
""",
)
def p14_resolve_parts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    kind = F.pmod("doc_id", F.lit(4))

    def piece(n: int):
        return F.struct(
            F.concat(name, F.lit(f".part-0{n}")).alias("name"),
            (F.col("n_chars") + F.lit(n)).alias("bytes"),
        )

    whole = F.array(F.struct(name.alias("name"), F.col("n_chars").alias("bytes")))
    pieces = F.array(*[piece(n) for n in range(3)])
    files = docs.select(
        F.inline(
            F.when(kind == 0, whole)
            .when(kind == 1, pieces)
            .when(kind == 2, F.concat(whole, pieces))
            .otherwise(F.array(F.struct(F.concat(name, F.lit("x")).alias("name"), F.col("n_chars").alias("bytes"))))
        )
    )
    return resolve_parts(docs.select(name.alias("output")), files)


@work.query(
    "p15_assembly_plan",
    """
SELECT dir, CASE WHEN k = 'one' THEN 'a.zim' END AS stem,
       CASE WHEN k = 'one' THEN 2 END::BIGINT AS parts,
       CASE WHEN k = 'one' THEN n_chars + 2 * n_chars + 1 END::BIGINT AS expected,
       CASE WHEN k = 'none' THEN 'nothing' WHEN k = 'two' THEN 'ambiguous'
            WHEN doc_id % 2 = 0 AND doc_id % 13 <> 0 THEN 'already_whole' ELSE 'join' END AS action
FROM (SELECT *, 'd' || doc_id AS dir,
             CASE WHEN doc_id % 11 = 0 THEN 'none' WHEN doc_id % 7 = 0 THEN 'two' ELSE 'one' END AS k
      FROM documents)
""",
)
def p15_assembly_plan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn(
        "dir", F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    )

    def file(name: str, size):
        return F.struct(F.lit(name).alias("name"), size.alias("bytes"))

    n = F.col("n_chars")
    divided = F.array(
        file("a.zimaa", n), file("a.zimab.part00", n), file("a.zimab.part01", n + 1)
    )
    plain = F.array(file("a.zimaa", n), file("a.zimab", n * 2 + 1))
    by = lambda k: F.pmod("doc_id", F.lit(k)) == 0
    own = F.when(by(5), divided).otherwise(plain)
    files = docs.select(
        "dir",
        F.inline(
            F.when(by(11), F.array(file("readme", n)))
            .when(by(7), F.concat(own, F.array(file("b.zimaa", n))))
            .otherwise(own)
        ),
    )
    archives = docs.filter(by(2)).select(
        "dir",
        F.lit("a.zim").alias("name"),
        (F.when(by(13), n).otherwise(n * 3 + 1)).alias("bytes"),
    )
    return assembly_plan(files, archives)


@work.query(
    "p16_part_coverage",
    CUT_SQL + """
SELECT archive, count(*)::BIGINT AS parts, sum(e - s)::BIGINT AS bytes, total, 0::BIGINT AS breaks,
       'exact' AS status
FROM parts JOIN whole USING (archive) GROUP BY archive, total
""",
)
def p16_part_coverage(spark, sf_dir):
    return _split(spark, sf_dir).coverage


@work.query(
    "p16_part_coverage_faults",
    """
SELECT 'd' || doc_id AS archive, CASE WHEN doc_id % 5 = 1 THEN 1 ELSE 2 END::BIGINT AS parts,
       CASE doc_id % 5 WHEN 1 THEN h WHEN 2 THEN n_chars + 1 ELSE n_chars END::BIGINT AS bytes,
       n_chars AS total,
       CASE doc_id % 5 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 0 END::BIGINT AS breaks,
       CASE doc_id % 5 WHEN 1 THEN 'short' WHEN 2 THEN 'long' WHEN 3 THEN 'misplaced' ELSE 'exact' END
         AS status
FROM (SELECT doc_id, n_chars + 10 AS n_chars, (n_chars + 10) // 2 AS h FROM documents)
""",
)
def p16_part_coverage_faults(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("archive"),
        F.pmod("doc_id", F.lit(5)).alias("k"),
        (F.col("n_chars") + 10).alias("total"),
    ).withColumn("h", F.expr("total div 2"))
    k, h, total = F.col("k"), F.col("h"), F.col("total")

    def part(lo, hi):
        return F.struct(lo.alias("start"), hi.alias("end"))

    zero = F.lit(0).cast("long")
    parts = docs.select(
        "archive",
        F.inline(
            F.when(k == 1, F.array(part(zero, h)))
            .when(k == 2, F.array(part(zero, h + 1), part(h, total)))
            .when(k == 3, F.array(part(zero, h), part(h + 1, total + 1)))
            .otherwise(F.array(part(zero, h), part(h, total)))
        ),
    )
    return part_coverage(parts, docs.select("archive", "total"))
