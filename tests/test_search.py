"""Search and comparison against plain Python."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyman.functions import origin_rebased
from tallyman.operators import compare, search

DOCS = "id string, contents string"


def corpus(seed=0, n=60):
    rng = random.Random(seed)
    words = ["the"] * 20 + [f"w{i}" for i in range(30)]
    docs = [(f"d{i}", " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(n)]
    return [*docs, ("empty", ""), ("long", "the cat " * 500)]


def test_postings(spark, monkeypatch):
    monkeypatch.setattr(search, "BATCH_TOKENS", 50)
    docs = corpus()
    index = search.build_postings(spark.createDataFrame(docs, DOCS))
    want = {}
    for i, text in docs:
        for at, term in enumerate(text.split()):
            want.setdefault((term, i), []).append(at)
    got = {(r.term, r.id): (r.tf, r.positions, r.length) for r in index.postings.collect()}
    sizes = {i: len(text.split()) for i, text in docs}
    assert got == {k: (len(v), v, sizes[k[1]]) for k, v in want.items()}
    df = Counter(term for term, _ in want)
    assert {r.term: r.df for r in index.terms.collect()} == df
    assert {r.id: r.length for r in index.docs.collect()} == sizes


@pytest.mark.parametrize("stored", [False, True])
def test_bm25(spark, tmp_path, stored, rows):
    docs = corpus(1)
    queries = [(1, "the w3 w3"), (2, "W7, w9"), (3, "absent"), (4, "cat")]
    index = search.build_postings(spark.createDataFrame(docs, DOCS))
    if stored:
        search.write_postings(index, str(tmp_path / "i"), buckets=4)
        index = search.read_postings(spark, str(tmp_path / "i"))
    got = search.bm25_topk(index, spark.createDataFrame(queries, "query int, text string"), 5)
    texts = {i: text.split() for i, text in docs}
    mean = sum(map(len, texts.values())) / len(texts)
    want = []
    for q, text in queries:
        scores = Counter()
        for term in text.lower().replace(",", "").split():
            df = sum(term in t for t in texts.values())
            idf = math.log(1 + (len(texts) - df + 0.5) / (df + 0.5))
            for i, t in texts.items():
                if tf := t.count(term):
                    scores[i] += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean))
        best = sorted(((-round(s, 6), i) for i, s in scores.items()))[:5]
        want += [(q, i, -s, n) for n, (s, i) in enumerate(best, 1)]
    found = [(q, i, pytest.approx(s, abs=2e-6), n) for q, i, s, n in want]
    assert rows(got, "query", "id", "score", "position") == sorted(found, key=lambda r: (r[0], r[1]))


def test_frequent_terms_are_met_where_a_document_can_still_win(spark, rows):
    rng = random.Random(5)
    common = [f"c{i}" for i in range(6)]
    docs = []
    for i in range(900):
        body = [rng.choice(common) for _ in range(rng.choice([5, 30, 200]))]
        body += [f"r{rng.randrange(40)}" for _ in range(rng.randrange(3))] * rng.choice([1, 1, 3])
        docs.append((f"d{i:03}", " ".join(body)))
    queries = [(q, " ".join([*common, f"r{q}", f"r{q + 1}"])) for q in range(12)] + [(50, "c0"), (51, "c1 c2"), (52, "nothing")]
    index = search.build_postings(spark.createDataFrame(docs, DOCS), positions=False).staged()
    asked = spark.createDataFrame(queries, "query int, text string")
    met, matching = search.scored_pairs(index, asked.filter("query < 50"), 5)
    assert met < matching / 2
    texts = {i: Counter(t.split()) for i, t in docs}
    size = {i: sum(c.values()) for i, c in texts.items()}
    mean = sum(size.values()) / len(size)
    want = []
    for q, text in queries:
        scores = Counter()
        for term in text.split():
            df = sum(term in c for c in texts.values())
            idf = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
            for i, c in texts.items():
                if c[term]:
                    scores[i] += idf * c[term] * 2.2 / (c[term] + 1.2 * (0.25 + 0.75 * size[i] / mean))
        best = sorted((-round(s, 6), i) for i, s in scores.items())[:5]
        want += [(q, i, n) for n, (_, i) in enumerate(best, 1)]
    assert rows(search.bm25_topk(index, asked, 5), "query", "id", "position") == sorted(want, key=repr)


@pytest.mark.parametrize("stored", [False, True])
def test_postings_are_kept_once_for_all_queries(spark, tmp_path, monkeypatch, stored, rows):
    docs = [(f"d{i:03}", " ".join(["c0"] * (1 + i % 7) + ["c1"] * (i % 5) + [f"r{i % 9}"])) for i in range(200)]
    index = search.build_postings(spark.createDataFrame(docs, DOCS))
    if stored:
        search.write_postings(index, str(tmp_path / "i"), buckets=4)
        index = search.read_postings(spark, str(tmp_path / "i"))
    most = index.postings.count()
    staged, stage = {}, search.stage

    def counted(df, label):
        staged[label] = (kept := stage(df, label)).count()
        return kept

    monkeypatch.setattr(search, "stage", counted)
    asked = spark.createDataFrame([(q, "c0 c1") for q in range(60)], "query int, text string")
    got = search.bm25_topk(index, asked, 3)
    best = rows(got.filter("query = 0"), "id", "score", "position")
    assert len(best) == 3
    for q in (1, 59):
        assert rows(got.filter(F.col("query") == q), "id", "score", "position") == best
    # Pairs of a query and a document were kept, 60 times 200 of them.
    assert max(staged.values()) <= most


def test_search_docs(spark):
    df = spark.createDataFrame([(1, "x", None, "z")], "k long, a string, b string, c string")
    row = search.to_search_docs(df, "k", ["a", "b", "c"], ["k", "a"]).first()
    assert tuple(row) == ("1", "x z", '{"k":1,"a":"x"}')


@pytest.mark.parametrize(
    "right,status",
    [
        ([("a", 3.0), ("b", 2.0), ("c", 2.0), ("d", 1.0)], "identical"),
        ([("a", 3.0), ("c", 2.0), ("b", 2.0), ("d", 1.0)], "permuted"),
        ([("a", 3.0000000001), ("b", 2.0), ("c", 2.0), ("d", 1.0)], "identical"),
        ([("b", 3.0), ("a", 2.0), ("c", 2.0), ("d", 1.0)], "different"),
        ([("a", 3.0), ("b", 2.0), ("c", 2.0)], "different"),
        ([("a", 3.0), ("b", 2.0), ("x", 2.0), ("d", 1.0)], "different"),
        ([("a", 4.0), ("b", 2.0), ("c", 2.0), ("d", 1.0)], "different"),
    ],
)
def test_rankings(spark, right, status):
    def ranking(items):
        return spark.createDataFrame([(1, n, i, s) for n, (i, s) in enumerate(items, 1)],
                                     "query int, position int, id string, score double")

    left = ranking([("a", 3.0), ("b", 2.0), ("c", 2.0), ("d", 1.0)])
    assert compare.compare_rankings(left, ranking(right)).first().status == status


def test_pages(spark, rows):
    schema = "page int, content string"
    left = spark.createDataFrame([(1, "a\nb\nb\nhttp://x:1/p"), (2, "same"), (3, "only")], schema)
    right = spark.createDataFrame([(1, "b\na\nc\nhttp://y:2/p"), (2, "same")], schema)
    got = compare.page_diff(left, right, lambda c: origin_rebased(c, "http://y:2", "http://x:1"))
    assert rows(got) == [(1, 1, 1, "< b\n> c"), (2, 0, 0, None), (3, 1, 0, "< only")]


def test_fields(spark, rows):
    schema = "k int, a string, b double"
    left = spark.createDataFrame([(1, "x", None), (2, "y", 1.0), (3, "z", 1.0)], schema)
    right = spark.createDataFrame([(1, "x", None), (2, "q", None), (4, "z", 1.0)], schema)
    assert rows(compare.field_diff(left, right, ["k"])) == [
        ("<only_left>", 1), ("<only_right>", 1), ("a", 1), ("b", 1),
    ]


def test_reset_is_idempotent(spark, rows):
    base = spark.createDataFrame([(i, "b") for i in range(10)], "k int, v string")
    current = base.filter("k <> 8").withColumn("v", F.lit("c")).union(spark.createDataFrame([(99, "c")], base.schema))
    once = compare.reset_above(current, base, "k", 7)
    assert rows(once) == [*[(i, "c") for i in range(7)], (7, "b"), (8, "b"), (9, "b")]
    assert rows(compare.reset_above(once, base, "k", 7)) == rows(once)


def test_best_version(spark):
    observed = spark.createDataFrame([("f", "1"), ("g", "1"), ("h", "1")], "path string, sha256 string")
    candidates = spark.createDataFrame(
        [("v1", "f", "1"), ("v1", "g", "2"), ("v2", "f", "1"), ("v2", "g", "1"), ("v3", "f", "9")],
        "version string, path string, sha256 string",
    )
    got = compare.best_version(observed, candidates).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [("v2", 2, 2, 1, 1), ("v1", 2, 1, 2, 1), ("v3", 1, 0, 3, None)]
