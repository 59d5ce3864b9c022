"""Nulls, empty and long texts, ties, repeated rows, empty tables, and clashing columns."""

from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F

from tallyman.llm.archives import archive_pages
from tallyman.llm.host_rules import judge_documents
from tallyman.llm.main_text import extract_main_text
from tallyman.llm.mixing import mix_sources, mixed_documents
from tallyman.llm.near_dups import drop_near_duplicates, near_duplicates
from tallyman.llm.packing import pack_documents
from tallyman.llm.packing_queries import tokenizer_path
from tallyman.llm.quality import drop_low_quality, score_quality
from tallyman.llm.sharding import shard_documents
from tallyman.llm.suffixes import cut_repeats, repeated_passages
from tallyman.llm.vectors import near_duplicate_vectors

CLASHING = ("row", "text_key", "key", "doc", "node", "n", "score", "block", "part", "size", "start", "spans", "id", "__id", "__key", "__had", "__spans", "__kept", "kept_id", "component", "emptied")
LONG = " ".join(f"word{i}" for i in range(60))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, LONG, "a"),
        (2, LONG + " more", "a"),
        (3, None, "a"),
        (4, "", None),
        (5, " \n\t ", "b"),
        (6, "one", "b"),
        (6, "one", "b"),
        (None, LONG, "b"),
        (None, None, None),
        (7, "x " * 30_000, "c"),
        (8, "word0", "c"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for name in CLASHING:
        df = df.withColumn(name, F.lit("clash"))
    return df.withColumn("lang", F.lit("en"))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (2, 0), (6, 1), (6, 0), (None, 1), (8, None)], "doc_id long, quality int")


def test_near_duplicates(docs, rows):
    got = rows(near_duplicates(docs, shingle=3, percent=85).drop("text_key", "component"))
    assert got == sorted(
        [
            (1, 58, 1, True), (2, 59, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True),
            (6, 1, 6, True), (6, 1, 6, True), (None, 58, 1, False), (None, 0, None, True), (7, 1, 7, True),
            (8, 1, 8, True),
        ],
        key=repr,
    )
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert rows(kept, "doc_id") == sorted([(1,), (3,), (4,), (5,), (6,), (None,), (7,), (8,)], key=repr)
    assert near_duplicates(docs.limit(0)).count() == 0 and drop_near_duplicates(docs.limit(0)).count() == 0


def test_repeated_passages(docs, rows):
    got = rows(repeated_passages(docs), "doc_id", "start", "stop", "origin", "cut_from", "cut_to")
    # A null id comes before all others; the run of x repeats itself from its 51st word on.
    assert (1, 0, 60, None, [0], [60]) in got and (2, 0, 60, None, [0], [60]) in got
    assert (None, 0, 60, None, [], []) in got and (7, 0, 30_000, 7, [50], [30_000]) in got
    assert len(got) == 4
    cut = cut_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    texts = {r.doc_id: r.text for r in cut.filter("doc_id IS NOT NULL").collect()}
    assert texts[1] == "" and texts[2] == "more" and texts[3] is None and texts[7].split() == ["x"] * 50
    assert repeated_passages(docs.limit(0)).count() == 0 and cut_repeats(docs.limit(0)).count() == 0


def some(seed, n):
    return " ".join(f"w{(i * i * seed + 7 * i) % 9973}x{seed}" for i in range(n))


def test_unlike_texts_of_one_id_are_told_apart(spark, rows):
    a = some(3, 100)
    near = a + " tail"
    docs = spark.createDataFrame([(1, a), (5, near), (5, some(5, 100)), (7, some(7, 90)), (7, some(7, 90) + " z")], "doc_id long, text string")
    got = rows(near_duplicates(docs), "doc_id", "component_id", "kept")
    assert got == [(1, 1, True), (5, 1, False), (5, 5, True), (7, 7, True), (7, 7, True)]
    left = rows(drop_near_duplicates(docs), "doc_id", "text")
    # Of two near duplicates that share the smallest id one goes as well.
    assert len(left) == 3 and left[:2] == [(1, a), (5, some(5, 100))] and left[2][1].startswith(some(7, 90))
    docs = spark.createDataFrame([(1, a), (5, some(3, 80) + " tail"), (5, some(5, 200)), (6, None)], "doc_id long, text string")
    cut = {r.text for r in cut_repeats(docs).collect()}
    assert cut == {a, "tail", some(5, 200), None}


def test_pipeline_on_edge_rows(spark, docs, labels, tmp_path):
    import corpus_pipeline

    full = docs.withColumn("n_chars", F.length("text").cast("long"))
    for name, table in (("rows", full), ("empty", full.limit(0))):
        table.coalesce(1).write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.coalesce(1).write.parquet(str(tmp_path / name / "labels.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    left = full
    for name in ("quality", "near_duplicates", "repeated_passages", "mixture"):
        left = stages[name](spark, left, str(tmp_path / "rows"))
        assert left.columns == full.columns and left.filter("`__key` = 'clash'").count() == left.count()
    assert corpus_pipeline.run(spark, str(tmp_path / "rows")).select("doc_id").distinct().count() > 0
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0


def test_mixing(docs, rows):
    used = mix_sources(docs)
    first = used.filter("pass = 0")
    assert rows(first, "doc_id") == rows(docs, "doc_id")
    for block in {r.block for r in used.collect()}:
        places = sorted(r.position for r in used.filter(F.col("block") == block).collect())
        assert places == list(range(len(places)))
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert rows(mixed, "doc_id") == rows(used, "doc_id")
    assert mix_sources(docs.limit(0)).count() == 0 and mixed_documents(docs.limit(0)).count() == 0


def test_sharding(docs):
    got = shard_documents(docs, 3).collect()
    assert len(got) == docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        text = texts[r.doc_id] if r.doc_id is not None else (LONG if r["size"] > 8 else None)
        assert r["size"] == 8 + len((text or "").encode())
        assert r.text_crc32 == (None if text is None else zlib.crc32(text.encode()))
    by_text = {}
    for r in got:
        if r.text_crc32 is not None:
            by_text.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())
    for shard in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert shard_documents(docs.limit(0), 3).count() == 0


def test_packing(docs):
    got = pack_documents(docs, tokenizer_path()).collect()
    assert sum(r.piece == 0 for r in got) == docs.count()
    assert sorted(r.length for r in got if r.doc_id in (3, 4, 5)) == [1, 1, 1]
    assert sum(r.length for r in got if r.doc_id == 7) == 30_001
    fills = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert fills.setdefault(r.sequence_id, 0) == r.offset
        fills[r.sequence_id] += r.length
    assert max(fills.values()) <= 2048
    assert pack_documents(docs.limit(0), tokenizer_path()).count() == 0


def test_quality(docs, labels):
    scored = score_quality(docs, labels).collect()
    assert len(scored) == docs.count() and all(0 <= r.score <= 1 for r in scored)
    assert {r.score for r in score_quality(docs, labels.limit(0)).collect()} == {0.5}
    kept = drop_low_quality(docs, labels, threshold=0.0)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert drop_low_quality(docs.limit(0), labels).count() == 0


def test_host_rules(docs, rows):
    got = {(r.doc_id, r.n_words): r for r in judge_documents(docs).collect()}
    assert got[1, 60].base_failed is False and got[1, 60].word_chars == len(LONG.replace(" ", ""))
    assert got[7, 30_000].n_repeat_words == 30_000 and got[7, 30_000].base_failed
    for key in ((3, 0), (4, 0), (5, 0), (6, 1), (None, 0)):
        assert got[key].base_failed and not got[key].kept
    assert judge_documents(docs).count() == docs.count() and judge_documents(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def pages(spark):
    long = "<article><p>" + LONG + "</p></article>"
    rows = [
        (3, "http://b/ c", long), (1, None, long), (2, "http://a", long), (2, "http://a", long), (4, "http://d", None),
        (5, "http://e", ""), (6, "http://f", "<p>ä\r\n\r\nWARC/1.1\r\n</p>"), (7, "http://f", "<p>ä\r\n\r\nWARC/1.1\r\n</p>"),
        (None, "http://g", long), (8, "http://h", "<p>" + "z " * 100_000),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name in (*CLASHING, "content", "text", "payload", "origin"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def test_archives(pages, rows):
    got = rows(archive_pages(pages), "page_id", "record_type", "refers_to")
    assert got == sorted(
        [
            (1, "response", None), (2, "revisit", 1), (2, "revisit", 1), (3, "revisit", 1), (None, "revisit", 1),
            (4, "response", None), (5, "response", None), (6, "response", None), (7, "response", None), (8, "response", None),
        ],
        key=repr,
    )
    sizes = {r.page_id: r.payload_bytes for r in archive_pages(pages).collect()}
    assert sizes[4] == sizes[5] == 0 and sizes[8] == 200_003 and sizes[6] == len("<p>ä\r\n\r\nWARC/1.1\r\n</p>".encode())
    assert archive_pages(pages.limit(0)).count() == 0


def test_main_text(pages):
    got = {r.page_id: r for r in extract_main_text(pages).collect()}
    assert got[1].text == LONG and got[1].url is None and got[1].n_chars == len(LONG)
    assert got[4].text == got[5].text == "" and got[8].n_chars == 199_999
    assert extract_main_text(pages).count() == pages.count() and extract_main_text(pages.limit(0)).count() == 0


def test_vectors(spark, rows):
    nan, inf = float("nan"), float("inf")
    data = [
        (5, [1.0, 0.0], 1), (3, [2.0, 0.0], 1), (4, [1.0, 0.1], 1), (4, [1.0, 0.1], 1), (6, [1.0, 0.0], 2), (7, [1.0, 0.0], None),
        (8, None, 1), (9, [], 1), (10, [0.0, 0.0], 1), (11, [nan, 1.0], 1), (12, [inf, 1.0], 1), (13, [None, 1.0], 1),
        (14, [0.0, 1.0], 1), (None, [1.0, 0.05], 1), (None, None, None), (15, [1.0, 0.0, 0.0], 1),
    ]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    for name in (*CLASHING, "links", "cell", "usable", "vec"):
        df = df.withColumn(name, F.lit("clash"))
    got = rows(near_duplicate_vectors(df))
    linked = [(5, 4, 3, False), (3, 4, 3, True), (4, 4, 3, False), (4, 4, 3, False), (None, 4, 3, False)]
    alone = [(i, 0, i, True) for i in (6, 7, 8, 9, 10, 11, 12, 13, 14, 15, None)]
    assert got == sorted(linked + alone, key=repr)
    assert near_duplicate_vectors(df.limit(0)).count() == 0
