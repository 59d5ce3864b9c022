"""Benchmark windows in documents against a plain version, and the edge cases."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tallyman.llm.decontamination import contamination, decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RAW = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text):
    return WORD.findall((text or "").translate(str.maketrans(UPPER, UPPER.lower())))


def plainly(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, named = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    named |= windows[tuple(w[i : i + n])]
        digest = hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(named), digest, bool(hit), hit))
    return out


def cut(text, hit):
    if not hit:
        return text
    parts, last, out = list(RAW.finditer(text)), 0, []
    out.append(text[: parts[0].start()])
    for i, m in enumerate(parts):
        end = parts[i + 1].start() if i + 1 < len(parts) else len(text)
        if i not in hit:
            out.append(text[m.start() : end])
    return "".join(out)


def made_up(seed):
    rng = random.Random(seed)
    some = lambda n: [rng.choice(["Ä", "ab", "Cd", "é9", "x", "yy", "The"]) for _ in range(n)]
    join = lambda w: "".join(x + rng.choice([" ", ", ", "\n", "-"]) for x in w)
    items = [(i, join(some(rng.choice([0, 3, 6, 9, 10, 11, 25])))) for i in range(14)]
    items += [(3, join(some(12))), (None, join(some(15))), (90, None), (91, ""), (92, " .,! "), (93, items[5][1])]
    docs = []
    for i in range(40):
        body = some(rng.choice([0, 2, 8, 40]))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(body) + 1)
            body[at:at] = words(rng.choice(items)[1])[: rng.randrange(30)]
        docs.append((i, join(body)))
    docs += [(5, docs[4][1]), (5, docs[4][1]), (None, items[0][1]), (50, None), (51, ""), (52, "x " * 20_000)]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_against_a_plain_version(spark, rows, seed):
    docs, items = made_up(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for name in ("row", "id", "k1", "words", "hashes", "found", "runs", "n_hit", "window"):
        df = df.withColumn(name, F.lit("clash"))
    bench = bench.withColumn("item", F.lit("clash")).withColumn("n", F.lit("clash"))
    want = plainly(docs, items)
    assert rows(contamination(df, bench)) == sorted((w[:-1] for w in want), key=repr)
    left = decontaminate(df, bench, "documents")
    assert left.columns == df.columns
    assert rows(left, "doc_id", "text") == sorted((d for d, w in zip(docs, want) if not w[5]), key=repr)
    spans = decontaminate(df, bench, "spans")
    assert spans.columns == df.columns
    assert rows(spans, "doc_id", "text") == sorted(((d[0], cut(d[1], w[6])) for d, w in zip(docs, want)), key=repr)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    none = contamination(docs, bench.limit(0)).collect()
    assert [(r.n_hit, r.n_items, r.contaminated, r.items_sha256) for r in none] == [(0, 0, False, hashlib.sha256(b"").hexdigest())] * 2
    assert contamination(docs.limit(0), bench).count() == 0
    assert decontaminate(docs, bench.limit(0)).collect() == docs.collect()


def test_a_mask_that_holds_all_changes_nothing(spark, rows, monkeypatch):
    from tallyman.llm import decontamination as module

    docs, items = made_up(3)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(module, "MOST_BITS", 64)
    monkeypatch.setattr(module, "BROADCAST_WINDOWS", 0)
    assert rows(contamination(df, bench)) == sorted((w[:-1] for w in plainly(docs, items)), key=repr)
