"""Whitening of embeddings by the singular values of their centred rows.

Entries become whole numbers on a fixed grid, so that sums, means and deviations are exact.
Tasks reduce blocks of centred rows to triangles by QR, and triangles are reduced a few at a time
until one is left; the covariance is never formed from products of large numbers. That triangle,
as wide as a vector is long, gives singular values and directions (``bidiagonal``). A second and
third pass measure how far the covariance of the whitened vectors is from the identity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyman.llm.bidiagonal import right_singular_vectors
from tallyman.session import stage

#: Entries times GRID, rounded down, plus ORIGIN.
GRID = 64
ORIGIN = 1_000_000
#: Components of a vector at most.
COMPONENTS = 16
#: Lengths of vectors that a table may have; each is whitened by itself.
MOST_LENGTHS = 16
#: Numbers that one QR block, and one group of triangles, may hold.
BLOCK_CELLS = 1 << 20


@dataclass(frozen=True)
class Mean:
    """``n`` different vectors of one length and their sums by dimension."""

    n: int
    sums: tuple[int, ...]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - sums / n`` with one rounding for each entry where whole numbers of 64 bits suffice."""
        return self.scaled(x).astype(np.float64) / self.n

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """``n * x - sums``, exactly: as 64-bit numbers, or as Python's where they don't suffice."""
        most = max((abs(s) for s in self.sums), default=0)
        reach = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
        if self.n * reach + most < 1 << 62:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)


@dataclass(frozen=True)
class Axes:
    """Directions as rows, each already divided by its deviation, and shares of all variance."""

    mean: Mean
    rows: np.ndarray
    explained: np.ndarray

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.mean.centred(x) @ self.rows.T


def gridded(vector: Column) -> Column:
    """Entries as long on the grid; null for a vector that is null, or with a null or non-finite
    entry, or one whose place on the grid is beyond 2**62."""
    place = lambda v: F.floor(v.cast("double") * GRID)
    good = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < 2.0**56)
    usable = vector.isNotNull() & F.forall(vector, good)
    return F.when(usable, F.transform(vector, lambda v: F.when(good(v), place(v).cast("long") + ORIGIN)))


def _blocks(batch: pa.RecordBatch, at: str = "x") -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(length, row numbers, matrix of longs)`` for each length in a batch."""
    column = batch.column(at)
    lengths = np.diff(column.offsets.to_numpy())
    starts = column.offsets.to_numpy()[:-1]
    flat = column.values.to_numpy(zero_copy_only=False)
    for size in np.unique(lengths):
        rows = np.flatnonzero(lengths == size)
        yield int(size), rows, flat[starts[rows][:, None] + np.arange(size)[None, :]]


def _totals(df: DataFrame, parts: Callable[[int, np.ndarray], np.ndarray], kind: str) -> DataFrame:
    """``(size, at, value)``: sums over all rows of an array made from each block of vectors.

    A task adds up its own blocks and gives one row for each entry at its end.
    """
    to = pa.int64() if kind == "long" else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for size, _, x in _blocks(batch):
                part = parts(size, x)
                if part is not None:
                    sums[size] = sums[size] + part if size in sums else part
        for size, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(total), size), pa.int32()),
                    pa.array(np.arange(len(total)), pa.int32()),
                    pa.array(total, to),
                ],
                ["size", "at", "value"],
            )

    made = df.mapInArrow(run, f"size int, at int, value {kind}")
    exact = F.col("value").cast("decimal(38,0)") if kind == "long" else F.col("value")
    return made.groupBy("size", "at").agg(F.sum(exact).alias("value"))


def _collected(totals: DataFrame) -> dict[int, list]:
    """The sums by length, in order: as many numbers as one result has."""
    out: dict[int, dict[int, object]] = {}
    for r in totals.collect():
        out.setdefault(r["size"], {})[r["at"]] = r["value"]
    return {size: [by[i] for i in range(len(by))] for size, by in out.items()}


def _means(fit: DataFrame) -> dict[int, Mean]:
    """Counts and exact sums: the upper and lower halves of the entries are added up apart."""

    def parts(size: int, x: np.ndarray) -> np.ndarray:
        return np.concatenate(([len(x)], (x >> 31).sum(0), (x & 0x7FFFFFFF).sum(0)))

    out = {}
    for size, sums in _collected(_totals(fit, parts, "long")).items():
        n, high, low = int(sums[0]), sums[1 : size + 1], sums[size + 1 :]
        out[size] = Mean(n, tuple((int(h) << 31) + int(w) for h, w in zip(high, low)))
    return out


def _triangles(fit: DataFrame, means: dict[int, Mean]) -> dict[int, np.ndarray]:
    """One triangle R for each length, with R'R the sum of outer products of the centred rows."""

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for size, _, x in _blocks(batch):
                if size == 0:
                    continue
                step = max(size, BLOCK_CELLS // size)
                for a in range(0, len(x), step):
                    centred = means[size].centred(x[a : a + step])
                    held[size] = _stacked(held.get(size), centred)
        if held:
            yield _rows_of(held)

    schema = "size int, task long, r array<double>"
    rest = stage(fit.mapInArrow(reduce_rows, schema.replace("task long, ", "")).withColumn("task", F.spark_partition_id().cast("long")).select("size", "task", "r"), "triangles")
    widest = max(means, default=1) or 1
    fan = int(max(2, min(32, 16 * BLOCK_CELLS // (widest * widest))))
    tasks = rest.agg(F.max("task")).first()[0]
    while tasks:

        def reduce_group(group: pa.Table) -> pa.Table:
            size, one = group["size"][0].as_py(), None
            for r in group.sort_by("task")["r"]:
                one = _stacked(one, np.asarray(r.as_py()).reshape(-1, size))
            task = group["task"][0].as_py() // fan
            return pa.table({"size": pa.array([size], pa.int32()), "task": pa.array([task], pa.int64()), "r": pa.array([one.ravel()], pa.list_(pa.float64()))})

        key = F.floor(F.col("task") / fan).alias("group")
        rest = stage(rest.groupBy("size", key).applyInArrow(reduce_group, schema), "triangles")
        tasks //= fan
    return {r["size"]: np.asarray(r["r"]).reshape(-1, r["size"]) for r in rest.collect()}


def _stacked(one: np.ndarray | None, other: np.ndarray) -> np.ndarray:
    """The triangle of both on top of each other."""
    return np.linalg.qr(other if one is None else np.vstack((one, other)), mode="r")


def _rows_of(held: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(held), pa.int32()), pa.array([r.ravel() for r in held.values()], pa.list_(pa.float64()))], ["size", "r"]
    )


def _axes(mean: Mean, triangle: np.ndarray, most: int) -> Axes:
    size = triangle.shape[1]
    square = np.zeros((size, size))
    square[: len(triangle)] = triangle
    values, picked, vectors = right_singular_vectors(square, most)
    deviation = picked / np.sqrt(mean.n)
    return Axes(mean, vectors / deviation[:, None], picked**2 / (values**2).sum())


def _identity_errors(fit: DataFrame, axes: dict[int, Axes]) -> dict[int, float]:
    """For each length the largest entry of the whitened vectors' covariance less the identity."""
    live = {size: a for size, a in axes.items() if len(a.rows)}

    def sums(size: int, x: np.ndarray) -> np.ndarray | None:
        return live[size].whiten(x).sum(0) if size in live else None

    middles = {size: np.array(s) / live[size].mean.n for size, s in _collected(_totals(fit, sums, "double")).items()}

    def products(size: int, x: np.ndarray) -> np.ndarray | None:
        if size not in live:
            return None
        w = live[size].whiten(x) - middles[size]
        return (w.T @ w).ravel()

    out = {}
    for size, s in _collected(_totals(fit, products, "double")).items():
        k = len(live[size].rows)
        out[size] = float(np.abs(np.array(s).reshape(k, k) / live[size].mean.n - np.eye(k)).max())
    return out


def whiten(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """A row per vector and component: id, component, n, deviation, whitened, explained, identity_error.

    A vector that is null, or has a null or non-finite entry, or one beyond 2**56, has no rows.
    The fit list is each distinct vector once. Components are numbered from 1 by falling
    variance; one whose variance is zero to double precision doesn't exist, so a single vector,
    equal ones and empty ones have no rows. Where components have equal variances any basis may
    come out, the same for all rows. Vectors of another length are whitened by themselves, of at
    most ``MOST_LENGTHS`` lengths (more raise ValueError). A ``deviation`` beyond a long is null.
    Repeated rows and ids, also null, get rows each. An empty table gives no rows; other
    columns are not looked at.
    """
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), gridded(F.col(f"`{vector_col}`")).alias("x"))
    rows = rows.filter(F.size("x") > 0)
    fit = stage(rows.groupBy("x").agg(F.lit(1).alias("one")).select("x"), "fit")
    lengths = [r[0] for r in fit.select(F.size("x")).distinct().limit(MOST_LENGTHS + 1).collect()]
    if len(lengths) > MOST_LENGTHS:
        raise ValueError(f"vectors of more than {MOST_LENGTHS} lengths")
    means = _means(fit)
    triangles = _triangles(fit, means)
    axes = {size: _axes(means[size], triangles[size], components) for size in means}
    errors = _identity_errors(fit, axes)
    kind = vectors.schema[id_col].dataType.simpleString()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, at, x in _blocks(batch):
                a = axes[size]
                k = len(a.rows)
                if k == 0:
                    continue
                step = max(1, BLOCK_CELLS // max(size, k))
                for i in range(0, len(at), step):
                    ids, part = at[i : i + step], x[i : i + step]
                    m = len(ids)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("id").take(pa.array(np.repeat(ids, k))),
                            pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                            pa.array(np.full(m * k, a.mean.n), pa.int64()),
                            pa.array(_deviations(a.mean.scaled(part), k), pa.int64()),
                            pa.array(a.whiten(part).ravel(), pa.float64()),
                            pa.array(np.tile(a.explained, m), pa.float64()),
                            pa.array(np.full(m * k, errors[size]), pa.float64()),
                        ],
                        ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                    )

    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return rows.mapInArrow(project, schema).withColumnRenamed("id", id_col)


def _deviations(scaled: np.ndarray, times: int) -> list | np.ndarray:
    """The sum of squares of each row, so many times over; None beyond a long."""
    reach = max(abs(int(scaled.max(initial=0))), abs(int(scaled.min(initial=0))))
    if scaled.shape[1] * reach * reach < 1 << 63:
        return np.repeat((scaled.astype(np.int64) ** 2).sum(1), times)
    whole = (scaled.astype(object) ** 2).sum(1)
    return [int(v) if v < 1 << 63 else None for v in whole for _ in range(times)]
