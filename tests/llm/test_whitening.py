"""Singular values and directions against LAPACK's, whitening against a plain version."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyman.llm import whitening
from tallyman.llm.bidiagonal import bidiagonalise, dqds, right_singular_vectors
from tallyman.llm.whitening import whiten


def matrices():
    rng = np.random.default_rng(7)
    for d in (1, 2, 3, 8, 33, 64, 120):
        yield rng.standard_normal((d, d))
    yield np.diag([3.0, 3.0, 3.0, 1.0])
    yield np.eye(12)
    yield np.diag(10.0 ** -np.arange(12))
    graded = rng.standard_normal((20, 20)) * 10.0 ** -np.arange(20)
    yield np.linalg.qr(graded, mode="r")
    low = rng.standard_normal((15, 4)) @ rng.standard_normal((4, 15))
    yield low
    u, v = (np.linalg.qr(rng.standard_normal((10, 10)))[0] for _ in range(2))
    yield u @ np.diag([5, 5, 5 - 1e-9, 5 - 1e-5, 2, 2, 2, 1, 1e-7, 1e-7]) @ v
    yield np.zeros((5, 5))


@pytest.mark.parametrize("which", range(14))
def test_singular_values_and_vectors(which):
    r = next(itertools.islice(matrices(), which, None))
    d = len(r)
    diagonal, above, p = bidiagonalise(r)
    b = np.diag(diagonal) + np.diag(above, 1)
    scale = np.abs(r).max() or 1.0
    assert np.abs(p.T @ p - np.eye(d)).max() < 1e-13
    assert np.abs(b.T @ b - p.T @ r.T @ r @ p).max() < 1e-12 * d * scale**2
    values = dqds(diagonal, above)
    want = np.linalg.svd(b, compute_uv=False)
    assert np.abs(values - want).max() < 1e-13 * d * scale
    _, picked, vectors = right_singular_vectors(r, 16)
    assert len(picked) == (want[:16] > want.max() * np.finfo(float).eps * d).sum()
    if len(picked):
        assert np.abs(vectors @ vectors.T - np.eye(len(picked))).max() < 1e-10
        residual = vectors @ (r.T @ r) - picked[:, None] ** 2 * vectors
        assert np.abs(residual).max() < 1e-11 * d * scale**2


def test_small_values_keep_relative_accuracy():
    # The product of the values is that of the diagonal, of which nothing is rounded.
    diagonal, above = 2.0 ** -np.arange(0, 40, 2.0), 2.0 ** -np.arange(3, 41, 2.0)
    values = dqds(diagonal, above)
    assert math.isclose(np.log(values).sum(), np.log(diagonal).sum(), rel_tol=1e-13)


def plainly(rows, most=16):
    usable = {}
    for i, (key, v) in enumerate(rows):
        if v and all(c is not None and math.isfinite(c) for c in v):
            usable[i] = (key, tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v))
    fit = sorted({x for _, x in usable.values()})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(d)]
    centred = np.array([[float(n * x[k] - sums[k]) / n for k in range(d)] for x in fit])
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:most]
    out = {}
    for i, (key, x) in usable.items():
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        c = np.array([float(n * a - s) / n for a, s in zip(x, sums)])
        for j, k in enumerate(order):
            out[i, j + 1] = (key, n, deviation, c @ vectors[:, k] / math.sqrt(values[k]), values[k] / np.trace(cov))
    return out


@pytest.mark.parametrize("d,parts", [(5, 1), (24, 7)])
def test_against_a_plain_version(spark, d, parts, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_CELLS", 40 * d)
    rng = np.random.default_rng(d)
    made = (rng.standard_normal((150, d)) * np.linspace(2, 0.5, d)).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(made)]
    rows += [(200, rows[3][1]), (200, rows[3][1]), (None, rows[9][1]), (201, None), (202, []), (203, [float("nan")] * d), (204, [None] * d),
             (205, [float("inf")] + rows[0][1][1:])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(parts)
    for name in ("id", "x", "size", "component", "n"):
        df = df.withColumn(name, F.lit("clash"))
    got = whiten(df).collect()
    want = plainly(rows)
    assert len(got) == len(want)
    signs = {}
    by = {}
    for key, n, dev, w, share in want.values():
        by.setdefault((key, n, dev), []).append((w, share))
    mine = {}
    for r in got:
        mine.setdefault((r.vec_id, r.n, r.deviation), []).append((r.component, r.whitened, r.explained))
        assert r.identity_error < 1e-9
    assert mine.keys() == by.keys()
    for key, ws in by.items():
        k = min(16, d)
        times = len(ws) // k
        for (c, w, share), (w2, share2) in zip(sorted(mine[key])[::times], ws[:k]):
            assert math.isclose(share, share2, rel_tol=1e-9)
            if abs(w) > 1e-6:
                assert signs.setdefault(c, w * w2 > 0) == (w * w2 > 0)
            assert math.isclose(abs(w), abs(w2), rel_tol=1e-7, abs_tol=1e-8)


def test_cases_without_components(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert whiten(df).count() == 0 and whiten(df.limit(0)).count() == 0
    flat = spark.createDataFrame([(1, [1.0, 2.0, 5.0]), (2, [3.0, 2.0, 5.0]), (3, [1.0]), (4, [2.0])], "vec_id long, embedding array<double>")
    got = {(r.vec_id, r.component): (r.n, round(abs(r.whitened), 9), r.explained) for r in whiten(flat).collect()}
    assert got == {(i, 1): (2, 1.0, 1.0) for i in (1, 2, 3, 4)}
    far = spark.createDataFrame([(1, [2.0**50]), (2, [0.0]), (3, [2.0**57])], "vec_id long, embedding array<double>")
    got = whiten(far).collect()
    assert [(r.vec_id, r.deviation, abs(round(r.whitened, 12))) for r in sorted(got)] == [(1, None, 1.0), (2, None, 1.0)]
