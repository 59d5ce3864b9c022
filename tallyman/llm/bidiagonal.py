"""Singular values and right singular vectors of a small square matrix, to high accuracy.

Householder reflections make the matrix bidiagonal. The differential qd algorithm with shifts
(dqds) finds its singular values to high relative accuracy, also small ones. The vector of each
comes from a twisted factorisation of the shifted tridiagonal: its two ends are eliminated
towards the row where they meet with the smallest pivot. Vectors of values that lie close
together are made orthogonal by inverse iteration within their cluster.
"""

from __future__ import annotations

import numpy as np

_EPS = np.finfo(np.float64).eps
#: Values of squares nearer than this, relative to the largest, share a cluster.
CLUSTER = 1e-3


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(diagonal, superdiagonal, P)`` with ``r = Q B P.T``, B upper bidiagonal, P orthogonal."""
    a = np.array(r, np.float64)
    d = a.shape[1]
    p = np.eye(d)
    for k in range(d):
        v = _reflector(a[k:, k])
        if v is not None:
            a[k:, k:] -= np.outer(v, 2 * (v @ a[k:, k:]))
        if k < d - 2:
            v = _reflector(a[k, k + 1 :])
            if v is not None:
                a[k:, k + 1 :] -= np.outer(2 * (a[k:, k + 1 :] @ v), v)
                p[:, k + 1 :] -= np.outer(2 * (p[:, k + 1 :] @ v), v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), p


def _reflector(x: np.ndarray) -> np.ndarray | None:
    """The unit vector whose reflection takes ``x`` to its first axis; None if it lies there."""
    scale = np.abs(x).max(initial=0.0)
    if len(x) < 2 or scale == 0 or not np.any(x[1:]):
        return None
    v = x / scale
    v[0] += np.copysign(np.linalg.norm(v), v[0])
    return v / np.linalg.norm(v)


def dqds(diagonal: np.ndarray, superdiagonal: np.ndarray) -> np.ndarray:
    """Singular values of an upper bidiagonal matrix, falling."""
    scale = max(np.abs(diagonal).max(initial=0.0), np.abs(superdiagonal).max(initial=0.0))
    if scale == 0:
        return np.zeros(len(diagonal))
    q = [float(x) for x in (diagonal / scale) ** 2]
    e = [float(x) for x in (superdiagonal / scale) ** 2]
    found: list[float] = []
    blocks = [(q, e, 0.0)]
    while blocks:
        q, e, sigma = blocks.pop()
        while q:
            n = len(q)
            if n == 1:
                found.append(q[0] + sigma)
                break
            if e[-1] <= _EPS * _EPS * (sigma + q[-1]):
                found.append(q[-1] + sigma)
                q, e = q[:-1], e[:-1]
                continue
            at = next((i for i in range(n - 2, -1, -1) if e[i] <= _EPS * _EPS * (sigma + min(q[i], q[i + 1]))), None)
            if at is not None:
                blocks.append((q[: at + 1], e[:at], sigma))
                q, e = q[at + 1 :], e[at + 1 :]
                continue
            q, e, sigma = _shifted_sweep(q, e, sigma)
    return np.sqrt(np.sort(np.maximum(found, 0.0))[::-1]) * scale


def _shifted_sweep(q: list[float], e: list[float], sigma: float) -> tuple[list[float], list[float], float]:
    """One dqds transform with the largest of some shifts that keeps all pivots positive."""
    low = q[-1] + e[-1]
    high = q[-2] + (e[-2] if len(e) > 1 else 0.0)
    coupling = e[-1] * q[-2]
    half = (high - low) / 2
    shift = low - coupling / (abs(half) + np.sqrt(half * half + coupling)) if half >= 0 else high - coupling / (
        abs(half) + np.sqrt(half * half + coupling)
    )
    shift = max(0.0, float(shift))
    for attempt in range(6):
        if attempt == 5:
            shift = 0.0
        qq, ee, least, late = _sweep(q, e, shift)
        if least >= 0:
            return qq, ee, sigma + shift
        # If only the last pivot failed, shift plus pivot is close to the least value from below.
        shift = max(0.0, (shift + least) * (1 - 2 * _EPS)) if late else shift / 4
    return qq, ee, sigma


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float, bool]:
    """``(q, e, least pivot, whether no pivot but the last was negative)`` after one transform."""
    n = len(q)
    qq, ee = [0.0] * n, [0.0] * (n - 1)
    d = q[0] - shift
    least = d
    for i in range(n - 1):
        if d < 0:
            return qq, ee, d, False
        s = d + e[i]
        qq[i] = s
        t = q[i + 1] / s if s > 0 else 0.0
        ee[i] = e[i] * t
        d = d * t - shift
        least = min(least, d)
    qq[-1] = d
    return qq, ee, least, d < 0


def _twisted(diagonal: np.ndarray, superdiagonal: np.ndarray, shift: float) -> tuple[np.ndarray, float]:
    """An eigenvector of ``B.T B`` near ``shift`` (not of length 1) and the pivot at its twist."""
    n = len(diagonal)
    tiny = _EPS * max(np.abs(diagonal).max(), np.abs(superdiagonal).max(initial=0.0)) * 1e-8 or 1e-300
    a = np.where(np.abs(diagonal) < tiny, tiny, diagonal)
    big, low = a * a, superdiagonal / a[:-1]
    floor = tiny * tiny
    s, p = np.empty(n), np.empty(n)
    down, up = np.empty(n - 1), np.empty(n - 1)
    s[0] = -shift
    for i in range(n - 1):
        pivot = s[i] + big[i]
        pivot = pivot if abs(pivot) > floor else floor
        down[i] = big[i] * low[i] / pivot
        s[i + 1] = down[i] * low[i] * s[i] - shift
    p[-1] = big[-1] - shift
    for i in range(n - 2, -1, -1):
        pivot = big[i] * low[i] * low[i] + p[i + 1]
        pivot = pivot if abs(pivot) > floor else floor
        t = big[i] / pivot
        up[i] = low[i] * t
        p[i] = p[i + 1] * t - shift
    gamma = s + p + shift
    r = int(np.argmin(np.abs(gamma)))
    z = np.zeros(n)
    z[r] = 1.0
    for i in range(r - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(r, n - 1):
        z[i + 1] = -up[i] * z[i]
    return z, float(gamma[r])


def _solve(diagonal: np.ndarray, superdiagonal: np.ndarray, shift: float, b: np.ndarray) -> np.ndarray:
    """``(B.T B - shift) x = b`` by elimination with exchanges of neighbouring rows."""
    n = len(diagonal)
    main = diagonal**2 - shift
    main[1:] += superdiagonal**2
    off = diagonal[:-1] * superdiagonal
    floor = _EPS * max(np.abs(diagonal).max(), np.abs(superdiagonal).max(initial=0.0)) ** 2 or 1e-300
    upper = np.zeros((n, 3))
    x = b.copy()
    row = np.array([main[0], off[0] if n > 1 else 0.0, 0.0])
    for i in range(n - 1):
        below = np.array([off[i], main[i + 1], off[i + 1] if i + 2 < n else 0.0])
        if abs(below[0]) > abs(row[0]):
            row, below = below, row
            x[i], x[i + 1] = x[i + 1], x[i]
        if abs(row[0]) < floor:
            row[0] = floor
        f = below[0] / row[0]
        upper[i] = row
        row = np.array([below[1] - f * row[1], below[2] - f * row[2], 0.0])
        x[i + 1] -= f * x[i]
    upper[-1] = row
    if abs(upper[-1, 0]) < floor:
        upper[-1, 0] = floor
    for i in range(n - 1, -1, -1):
        after = upper[i, 1] * x[i + 1] if i + 1 < n else 0.0
        after += upper[i, 2] * x[i + 2] if i + 2 < n else 0.0
        x[i] = (x[i] - after) / upper[i, 0]
    return x


def right_singular_vectors(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(all values falling, the first ones, their vectors as rows)``.

    At most ``most`` of the values, and none that is zero to double precision, have vectors.
    """
    diagonal, superdiagonal, p = bidiagonalise(r)
    values = dqds(diagonal, superdiagonal)
    floor = values.max(initial=0.0) * _EPS * max(1, len(values))
    picked = values[:most][values[:most] > floor]
    squares = picked**2
    rows: list[np.ndarray] = []
    cluster = 0
    rng = np.random.default_rng(5)
    for k, square in enumerate(squares):
        if k == 0 or squares[k - 1] - square > CLUSTER * squares[0]:
            cluster = k
        z, _ = _twisted(diagonal, superdiagonal, float(square))
        norm = np.linalg.norm(z)
        z = z / norm if np.isfinite(norm) and norm > 0 else rng.standard_normal(len(diagonal))
        near = np.array(rows[cluster:k])
        if len(near):
            # Another start where the vector found is one of those before it.
            start = z - near.T @ (near @ z)
            z = start if np.linalg.norm(start) > 1e-2 else rng.standard_normal(len(z))
        for _ in range(3 if len(near) else 1):
            z = _solve(diagonal, superdiagonal, float(square), z / np.linalg.norm(z))
            z /= np.linalg.norm(z)
            for _ in range(2 if len(near) else 0):
                z -= near.T @ (near @ z)
                z /= np.linalg.norm(z)
        rows.append(z)
    vectors = np.array(rows).reshape(len(rows), len(diagonal)) @ p.T
    return values, picked, vectors
