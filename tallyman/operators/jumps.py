"""Chains of cut points by pointer jumping.

Each row that may be cut at has one successor, the first row that must open the next part if a part
begins here. The cuts are the rows on the way from a key's first row. Rows lie in sorted
chunks. In one job each chunk follows its own pointers to where they leave it; what leaves a chunk
is looked up in the chunk it leads to, again all at once. That makes a graph whose steps lead
from chunk to chunk, and doubling it finds the steps taken: its rounds grow with the logarithm of
the chunks. A last job marks the cuts inside all chunks. No job waits for the rows of another chunk.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyman.operators.ordered import Columns, in_order, segments
from tallyman.session import small_table, stage


@dataclass(frozen=True)
class Chain:
    """Successors by two numbers that never fall from row to row of a key.

    ``places(columns, upto)`` gets the ``reads`` columns of some rows of one key in order and
    the running sum of ``weight`` up to and with each. It returns ``(begin, end, may)``: the
    successor of a row with ``begin`` x is the first one of those that ``may`` be cut at whose
    ``begin`` is over x and whose ``end`` is over x + ``reach``. A key's first row
    begins the first part, whether it may be cut at or not.
    """

    reads: Sequence[str]
    places: Callable[[Columns, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
    reach: int
    weight: str


def _successors(x: np.ndarray, begin: np.ndarray, end: np.ndarray, reach: int) -> np.ndarray:
    """Where each part that begins at ``x`` ends, among rows that may be cut at; past the last if nowhere."""
    return np.maximum(np.searchsorted(begin, x, "right"), np.searchsorted(end, x + reach, "right"))


def _exits(begin: np.ndarray, end: np.ndarray, reach: int) -> np.ndarray:
    """For each row the last one that its pointers reach in this chunk."""
    n = len(begin)
    to = _successors(begin, begin, end, reach)
    own = np.arange(n)
    to = np.where(to < n, to, own)
    while True:
        further = to[to]
        if (further == to).all():
            return to
        to = further


class _Chunks:
    """Summaries of the chunks of keys that have several, as the driver holds them: a row each."""

    def __init__(self, rows: list, keys: Sequence[str]):
        self.by_key: dict[tuple, tuple[list, list, list]] = {}
        for row in sorted(rows, key=lambda r: r["_chunk"]):
            chunk, begin, end = self.by_key.setdefault(tuple(row[k] for k in keys), ([], [], []))
            chunk.append(row["_chunk"])
            # What no row of a chunk may be cut at leaves the numbers as they were.
            begin.append(max(row["begin"], begin[-1]) if begin else row["begin"])
            end.append(max(row["end"], end[-1]) if end else row["end"])

    def leads_to(self, key: tuple, x: int, reach: int) -> int | None:
        """The first chunk with a row that a part beginning at ``x`` ends before."""
        chunk, begin, end = self.by_key[key]
        at = max(bisect_right(begin, x), bisect_right(end, x + reach))
        return chunk[at] if at < len(chunk) else None


def chain_of_cuts(chunked: DataFrame, keys: Sequence[str], chain: Chain, carry: Sequence[str]) -> DataFrame:
    """``keys``, ``carry``, ``upto``, ``first``, ``cut``, ``nth``: each row with its place in the chain.

    ``chunked`` comes from ``ordered_chunks`` with the keys first in its order. ``upto`` is the
    running sum of the weight over all rows up to this one, of other keys too. ``nth`` counts the
    cuts of the key up to this row; ``first`` marks a key's first row.
    """
    spark = chunked.sparkSession
    names, reads, reach, places = list(keys), list(chain.reads), chain.reach, chain.places
    weight = chain.weight
    # One row per chunk comes to the driver and goes back as a small table.
    totals = sorted((r[0], r[1]) for r in chunked.groupBy("_chunk").agg(F.sum(weight).cast("long")).collect())
    bases, running = [], 0
    for number, total in totals:
        bases.append((number, running))
        running += total or 0
    based = chunked.join(small_table(spark, bases, "_chunk long, _base long"), "_chunk")
    narrow = based.select(*dict.fromkeys([*names, *reads, weight, "_pos", "_chunk", "_base"]))

    def parts_of(rows: pa.Table, only: set | None = None):
        """``(key, slice, upto, begin, end, may)`` of each key, or each of some, in a whole chunk's rows."""
        rows, columns = in_order(rows, [*dict.fromkeys([*reads, weight, "_base"])])
        upto = np.cumsum(columns[weight].astype(np.int64)) + (int(columns["_base"][0]) if len(rows) else 0)
        for a, b, key in segments(rows, names):
            if only is None or key in only:
                part = {n: columns[n][a:b] for n in columns}
                yield (key, slice(a, b), upto[a:b], *places(part, upto[a:b]))

    key_fields = [chunked.schema[k] for k in names]
    found = T.StructType([*key_fields, *T.StructType.fromDDL("_chunk long, begin long, end long, start long").fields])
    found_arrow = to_arrow_schema(found)

    def summary(rows: pa.Table) -> pa.Table:
        chunk, out = rows["_chunk"][0].as_py(), []
        for key, _, _, begin, end, may in parts_of(rows, several):
            last = np.flatnonzero(may)[-1:]
            least = np.iinfo(np.int64).min
            out.append({**dict(zip(names, key)), "_chunk": chunk, "start": int(begin[0]),
                        "begin": int(begin[last[0]]) if len(last) else least, "end": int(end[last[0]]) if len(last) else least})
        return pa.Table.from_pylist(out, schema=found_arrow)

    # Keys with several chunks: a chunk begins at most one that goes on, so they are fewer than chunks.
    held = stage(chunked.select(*names, "_chunk").distinct(), "keys")
    several = {tuple(r[k] for k in names) for r in held.groupBy(*names).agg(F.count("*").alias("n")).filter("n > 1").collect()}
    reached = None
    chunks = _Chunks([], names)
    if several:
        # Whole chunks, as sums run over all their rows.
        long = narrow.join(_of_keys(held, several, key_fields).select("_chunk").distinct(), "_chunk", "left_semi")
        rows = long.groupBy("_chunk").applyInArrow(summary, found).collect()
        chunks = _Chunks(rows, names)
        starts = {}
        for row in sorted(rows, key=lambda r: r["_chunk"]):
            starts.setdefault(tuple(row[k] for k in names), row["start"])
        reached = _reached(spark, long, names, key_fields, chunks, starts, lambda rows: parts_of(rows, several), reach)

    inner = [*names, *carry]
    out = T.StructType(
        [chunked.schema[c] for c in inner] + T.StructType.fromDDL("upto long, first boolean, cut boolean, within long, _chunk long").fields
    )
    out_arrow = to_arrow_schema(out)
    spans = {key: held[0][0] for key, held in chunks.by_key.items()}

    def mark(_: tuple, rows: pa.Table, entries: pa.Table | None) -> pa.Table:
        if rows.num_rows == 0:
            return out_arrow.empty_table()
        chunk = rows["_chunk"][0].as_py()
        entry = {tuple(e[k] for k in names): e["x"] for e in entries.to_pylist()}
        n = rows.num_rows
        first, cut, within, all_upto = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for key, where, upto, begin, end, may in parts_of(rows):
            opens = spans.get(key, chunk) == chunk
            first[where.start] = opens
            x = entry.get(key, int(begin[0]) if opens and key not in spans else None)
            rows_to_cut = np.flatnonzero(may)
            begins, ends = begin[rows_to_cut], end[rows_to_cut]
            while x is not None:
                at = int(_successors(np.int64(x), begins, ends, reach))
                if at >= len(begins):
                    break
                cut[where.start + rows_to_cut[at]] = True
                x = int(begins[at])
            within[where] = np.cumsum(cut[where])
            all_upto[where] = upto
        sorted_rows, _ = in_order(rows, [])
        picked = sorted_rows.select(inner)
        for name, column in (("upto", all_upto), ("first", first), ("cut", cut), ("within", within), ("_chunk", np.full(n, chunk))):
            picked = picked.append_column(name, pa.array(column))
        return picked.cast(out_arrow)

    wanted = based.select(*dict.fromkeys([*inner, *reads, weight, "_pos", "_chunk", "_base"]))
    entry_schema = T.StructType([*key_fields, T.StructField("x", T.LongType()), T.StructField("_chunk", T.LongType())])
    entries = reached if reached is not None else spark.createDataFrame([], entry_schema)
    marked = stage(
        wanted.groupBy("_chunk").cogroup(entries.groupBy("_chunk")).applyInArrow(mark, out), "marked"
    )
    cuts = marked.filter("cut").groupBy(*names, "_chunk").agg(F.count("*").alias("n"))
    before, sums = [], {}
    if spans:
        # Only of keys with several chunks: a row per chunk.
        for r in sorted(_of_keys(cuts, several, key_fields).collect(), key=lambda r: r["_chunk"]):
            sums.setdefault(tuple(r[k] for k in names), {})[r["_chunk"]] = r["n"]
        for key, (numbers, _, _) in chunks.by_key.items():
            running = 0
            for number in numbers:
                before.append((*key, number, running))
                running += sums.get(key, {}).get(number, 0)
    offsets = small_table(
        spark, before, T.StructType([T.StructField(f"k{i}", f.dataType) for i, f in enumerate(key_fields)] + T.StructType.fromDDL("c long, before long").fields)
    )
    same = F.col("_chunk") == F.col("c")
    for i, k in enumerate(names):
        same &= F.col(k).eqNullSafe(F.col(f"k{i}"))
    return marked.join(offsets, same, "left").select(
        *inner, "upto", "first", "cut", (F.col("within") + F.coalesce("before", F.lit(0))).alias("nth")
    )


def _of_keys(df: DataFrame, some: set[tuple], fields: list[T.StructField]) -> DataFrame:
    """Rows of ``df`` whose keys are in ``some``, null ones too."""
    kinds = T.StructType([T.StructField(f"_k{i}", f.dataType) for i, f in enumerate(fields)])
    same = F.lit(True)
    for i, f in enumerate(fields):
        same &= F.col(f.name).eqNullSafe(F.col(f"_k{i}"))
    return df.join(small_table(df.sparkSession, list(some), kinds), same, "left_semi")


def _reached(spark, long: DataFrame, names, key_fields, chunks: _Chunks, starts: dict, parts_of, reach: int) -> DataFrame:
    """``keys, x, _chunk``: where the chain of each key enters its chunks."""
    node = T.StructType([*key_fields, *T.StructType.fromDDL("x long, _chunk long").fields])
    node_arrow = to_arrow_schema(node)

    def leave(rows: pa.Table) -> pa.Table:
        """The places from which pointers leave a chunk, each once, with the chunk that they lead to."""
        out = []
        for key, _, _, begin, end, may in parts_of(rows):
            at = np.flatnonzero(may)
            last = np.unique(begin[at][_exits(begin[at], end[at], reach)])
            out += [
                {**dict(zip(names, key)), "x": int(x), "_chunk": to}
                for x in last
                if (to := chunks.leads_to(key, int(x), reach)) is not None
            ]
        return pa.Table.from_pylist(out, schema=node_arrow)

    begun = [(*key, x, to) for key, x in starts.items() if (to := chunks.leads_to(key, x, reach)) is not None]
    first = spark.createDataFrame(begun, node)
    nodes = stage(long.groupBy("_chunk").applyInArrow(leave, node).unionByName(first).distinct(), "places")
    edge = T.StructType([*key_fields, *T.StructType.fromDDL("x long, _chunk long, to_x long, to_chunk long").fields])
    edge_arrow = to_arrow_schema(edge)

    def follow(_: tuple, rows: pa.Table, places: pa.Table) -> pa.Table:
        """From each place to the one at which its pointers leave the chunk."""
        asked: dict[tuple, list[int]] = {}
        for p in places.to_pylist():
            asked.setdefault(tuple(p[k] for k in names), []).append(p["x"])
        out = []
        if rows.num_rows:
            chunk = rows["_chunk"][0].as_py()
            for key, _, _, begin, end, may in parts_of(rows):
                if key not in asked:
                    continue
                at = np.flatnonzero(may)
                begins, ends = begin[at], end[at]
                xs = np.array(asked[key], np.int64)
                last = begins[_exits(begins, ends, reach)[_successors(xs, begins, ends, reach)]]
                for x, to_x in zip(xs.tolist(), last.tolist()):
                    to = chunks.leads_to(key, to_x, reach)
                    out.append({**dict(zip(names, key)), "x": x, "_chunk": chunk, "to_x": to_x if to is not None else None, "to_chunk": to})
        return pa.Table.from_pylist(out, schema=edge_arrow)

    edges = stage(
        long.groupBy("_chunk").cogroup(nodes.groupBy("_chunk")).applyInArrow(follow, edge).filter("to_x IS NOT NULL"), "steps"
    )
    reached = first
    rounds = max((len(held[0]) for held in chunks.by_key.values()), default=1).bit_length()
    for k in range(rounds):
        # Twice the steps each round, for those reached and for the pointers.
        reached = stage(reached.unionByName(_step(reached, edges, names)).distinct(), "reached")
        if k + 1 < rounds:
            ahead = edges.select(*names, F.col("x").alias("from_x"), F.col("_chunk").alias("from_chunk"), F.col("to_x").alias("x"), F.col("to_chunk").alias("_chunk"))
            further = _joined(ahead, edges, names).select(
                *names, F.col("from_x").alias("x"), F.col("from_chunk").alias("_chunk"), "to_x", "to_chunk"
            )
            edges = stage(further, "steps")
    return reached


def _joined(left: DataFrame, edges: DataFrame, names: Sequence[str]) -> DataFrame:
    """``left`` with ``to_x`` and ``to_chunk`` of the edges at its ``x``."""
    other = edges.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(names)), F.col("x").alias("_x"), "to_x", "to_chunk")
    kept = left.select(*(c for c in left.columns if c not in ("to_x", "to_chunk")))
    same = F.col("x") == F.col("_x")
    for i, k in enumerate(names):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return kept.join(other, same).drop("_x", *(f"_k{i}" for i in range(len(names))))


def _step(reached: DataFrame, edges: DataFrame, names: Sequence[str]) -> DataFrame:
    return _joined(reached, edges, names).select(*names, F.col("to_x").alias("x"), F.col("to_chunk").alias("_chunk"))
