from __future__ import annotations

import itertools
import posixpath

import pytest
from pyspark.sql import functions as F

from tallyman import functions as tf


def values(spark, inputs, build, ddl="v string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, {ddl}")
    return [r.out for r in df.select("i", build(F.col("v")).alias("out")).orderBy("i").collect()]


def test_normalise_is_posix_normpath(spark):
    parts = ["a", "b", ".", "..", ""]
    paths = ["/".join(p) for n in (1, 2, 3, 4) for p in itertools.product(parts, repeat=n)]
    # A path of exactly two leading slashes is implementation-defined; nothing here needs it.
    paths = [p for p in paths if not (p.startswith("//") and not p.startswith("///"))]
    assert values(spark, paths, tf.normalise) == [posixpath.normpath(p) for p in paths]


def test_path_pieces(spark):
    paths = ["a", "a/b", "a/b/c.txt"]
    assert values(spark, paths, tf.parent) == ["", "a", "a/b"]
    assert values(spark, paths, tf.basename) == ["a", "b", "c.txt"]
    assert values(spark, paths, tf.prefixes) == [["a"], ["a", "a/b"], ["a", "a/b", "a/b/c.txt"]]
    assert values(spark, paths, tf.ancestors) == [[], ["a"], ["a", "a/b"]]


def test_strip_prefix_counts_components_without_comparing(spark):
    paths = ["x/y/z", "q/r/z", "x/y", "x"]
    assert values(spark, paths, lambda c: tf.strip_prefix(c, "x/y")) == ["z", "z", "", ""]
    assert values(spark, paths, lambda c: tf.strip_prefix(c, "")) == paths


def test_entry_cost(spark):
    sizes = [0, 1, 512, 513, 95_199_730_590]
    got = values(spark, sizes, lambda c: tf.entry_cost(c, F.lit("file")), "v long")
    assert got == [512, 1024, 1024, 1536, 512 + -(-95_199_730_590 // 512) * 512]
    got = values(spark, sizes, lambda c: tf.entry_cost(c, F.lit("dir")), "v long")
    assert got == [512] * 5


@pytest.mark.parametrize("name,extra", [("n" * 100, 0), ("n" * 101, 1024), ("é" * 51, 1024), ("é" * 50, 0)])
def test_long_names_are_charged_by_bytes(spark, name, extra):
    got = values(spark, [name], lambda c: tf.entry_cost(F.lit(0), F.lit("file"), c))
    assert got == [512 + extra]


def test_part_letters(spark):
    got = values(spark, [0, 25, 26, 675, 676, -1], tf.part_letters, "v long")
    assert got == ["aa", "az", "ba", "zz", None, None]


def test_origin_is_replaced_whole(spark):
    lines = [
        'href="http://a:80/x" http://a:80',
        "http://a:8080/x",
        "http://a:80.example/x",
        "https://a:80/x",
        None,
    ]
    got = values(spark, lines, lambda c: tf.origin_rebased(c, "http://a:80", "http://b$1"))
    assert got == ['href="http://b$1/x" http://b$1', *lines[1:]]
    again = values(spark, got, lambda c: tf.origin_rebased(c, "http://a:80", "http://b$1"))
    assert again == got


def test_definers_and_words(spark):
    assert values(spark, ["a DEFINER=`u`@`%` b DEFINER=`v`@`h`"], tf.without_definers) == ["a  b "]
    assert values(spark, ["Été, 2 CATS--x!", ""], tf.words) == [["été", "2", "cats", "x"], []]
