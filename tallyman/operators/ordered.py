"""Distributed order: row numbers, running sums and order-dependent folds.

None of these uses a window over a whole key, so one key holding most of the rows still
spreads over the cluster.

A fold (first-fit, next-fit, cutting, stall detection) is sequential by nature. Here the
rows are range-sorted once and cut into bounded chunks. The driver carries only the fold's
state from chunk to chunk: two or three integers per key, or for first-fit one per open bucket. Chunks whose effect follows from
their summary are skipped without being read; the others are folded a few at a time in a
task. When every chunk's starting state is known, one parallel job produces the output.
Keys that fit in one chunk, the usual case, need no rounds at all.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyman.session import small_table, stage

#: Rows one fold task may hold. A power of two, so that a chunk never spans partitions.
CHUNK_ROWS = 1 << 18
#: Neighbouring chunks of a key folded in one round, a few narrow columns of each.
ROUND_CHUNKS = 8
_PARTITION_BITS = 33

State = tuple[int, ...]


def ordered_chunks(
    df: DataFrame,
    order: Sequence[Column | str],
    chunk_rows: int = CHUNK_ROWS,
    label: str = "ordered",
) -> DataFrame:
    """``df`` range-sorted by ``order`` and staged, with ``_pos`` and ``_chunk``.

    ``_pos`` grows in sort order and is unique; ``_chunk`` groups at most ``chunk_rows``
    neighbouring rows.
    """
    if chunk_rows < 1 or chunk_rows & (chunk_rows - 1):
        raise ValueError("chunk_rows must be a power of two")
    bits = chunk_rows.bit_length() - 1
    return stage(
        df.orderBy(*order)
        .withColumn("_pos", F.monotonically_increasing_id())
        .withColumn("_chunk", F.shiftright("_pos", bits)),
        label,
    )


def _partition_offsets(chunked: DataFrame, amount: Column) -> DataFrame:
    """Per sorted partition, the total of ``amount`` in all partitions before it.

    One row per partition of the sort, so it is collected and handed back as a small table.
    """
    totals = sorted(
        (row.part, row.total)
        for row in chunked.groupBy(F.shiftright("_pos", _PARTITION_BITS).alias("part"))
        .agg(F.sum(amount).alias("total"))
        .collect()
    )
    rows, running = [], 0
    for part, total in totals:
        rows.append((part, running))
        running += total
    return small_table(chunked.sparkSession, rows, "_part long, _base long")


def with_row_number(
    df: DataFrame,
    order: Sequence[Column | str],
    name: str = "seq",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """A gap-free 1-based number in sort order, without a single-partition window."""
    chunked = ordered_chunks(df, order, chunk_rows, "numbered")
    base = _partition_offsets(chunked, F.lit(1))
    within = F.col("_pos").bitwiseAND(F.lit((1 << _PARTITION_BITS) - 1))
    return (
        chunked.withColumn("_part", F.shiftright("_pos", _PARTITION_BITS))
        .join(base, "_part")
        .withColumn(name, F.col("_base") + within + F.lit(1))
        .drop("_part", "_base", "_pos", "_chunk")
    )


def with_running_sum(
    df: DataFrame,
    order: Sequence[Column | str],
    amount: Column,
    name: str,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """The sum of ``amount`` over all rows up to and including this one, in sort order.

    Sums run inside each chunk, in parallel; what came before a chunk is added from a table
    with one row per chunk.
    """
    chunked = ordered_chunks(df.withColumn("_amount", amount), order, chunk_rows, "running")
    totals = chunked.groupBy("_chunk").agg(F.sum("_amount").alias("total")).collect()
    rows, running = [], 0
    for chunk, total in sorted((row[0], row.total) for row in totals):
        rows.append((chunk, running))
        running += total
    before = small_table(df.sparkSession, rows, "_chunk long, _base long")
    within = Window.partitionBy("_chunk").orderBy("_pos")
    return (
        chunked.join(before, "_chunk")
        .withColumn(name, F.col("_base") + F.sum("_amount").over(within))
        .drop("_chunk", "_pos", "_base", "_amount")
    )


Columns = dict[str, np.ndarray]


@dataclass(frozen=True)
class Fold:
    """An order-dependent fold.

    ``step(state, columns)`` gets the ``reads`` columns of one key's rows in one chunk, in
    order, as arrays. It returns the state after them, the indices of the rows it has output
    for, and the output columns named in ``output``. ``carry`` names columns handed through
    from those rows. ``skip(state, summary)`` returns the state after a chunk when the
    ``summary`` aggregates alone decide it, else ``None``.
    """

    init: State
    reads: Sequence[str]
    step: Callable[[State, Columns], tuple[State, np.ndarray, Columns]]
    output: str
    carry: Sequence[str] = ()
    skip: Callable[[State, dict], State | None] = lambda state, summary: None
    summary: Sequence[Column] = field(default_factory=tuple)


def segments(rows: pa.Table, keys: Sequence[str]) -> list[tuple[int, int, tuple]]:
    """``(start, stop, key)`` of each run of one key in sorted rows."""
    n = rows.num_rows
    turns = np.zeros(n, dtype=bool)
    turns[0] = True
    for key in keys:
        codes = pc.dictionary_encode(rows[key].combine_chunks(), null_encoding="encode").indices
        codes = codes.to_numpy()
        turns[1:] |= codes[1:] != codes[:-1]
    starts = np.flatnonzero(turns)
    stops = np.append(starts[1:], n)
    return [
        (int(a), int(b), tuple(rows[k][int(a)].as_py() for k in keys))
        for a, b in zip(starts, stops)
    ]


def in_order(rows: pa.Table, reads: Sequence[str]) -> tuple[pa.Table, Columns]:
    rows = rows.sort_by("_pos")
    return rows, {name: rows[name].to_numpy() for name in reads}


def _with_key_types(chunked: DataFrame, names: Sequence[str], tail: str) -> T.StructType:
    fields = [T.StructField(n, chunked.schema[n].dataType) for n in names]
    return T.StructType(fields + T.StructType.fromDDL(tail).fields)


def _starting_states(chunked: DataFrame, keys: Sequence[str], fold: Fold) -> dict:
    """``(key..., chunk) -> state`` for every chunk of the keys that have several.

    The driver sees one summary row per chunk, i.e. rows / chunk_rows of them, and only of
    keys that span chunks. A round opens, per key, the next ``ROUND_CHUNKS`` chunks from the
    first undecided one on. It reads only the columns the fold reads and returns the state
    after each chunk.
    """
    per_chunk = chunked.groupBy(*keys, "_chunk").agg(*(fold.summary or [F.count("_pos").alias("n")]))
    facts = [c for c in per_chunk.columns if c not in keys]
    summaries = (
        per_chunk.groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct(*facts))).alias("chunks"))
        .filter(F.size("chunks") > 1)
        .collect()
    )
    todo = {tuple(row[k] for k in keys): [c.asDict() for c in row.chunks] for row in summaries}
    state = {key: tuple(fold.init) for key in todo}
    at = dict.fromkeys(todo, 0)
    starts: dict = {}
    # Tasks get these, not the fold: it holds Columns, which stay on the driver.
    key_names, step, reads = list(keys), fold.step, list(fold.reads)
    schema = _with_key_types(chunked, keys, "_chunk long, _state array<bigint>")
    arrow_schema = to_arrow_schema(schema)
    narrow = chunked.select(*dict.fromkeys([*keys, *fold.reads, "_pos", "_chunk"]))
    wanted = _with_key_types(chunked, keys, "_chunk long")
    spark = chunked.sparkSession
    after: dict = {}

    while True:
        opened: dict = {}
        plan: list[tuple] = []
        for key, chunks in todo.items():
            while at[key] < len(chunks):
                chunk = chunks[at[key]]
                number = chunk["_chunk"]
                starts[(*key, number)] = state[key]
                if at[key] == len(chunks) - 1:
                    at[key] += 1
                    break
                known = after.pop((*key, number), None)
                if known is None:
                    known = fold.skip(state[key], chunk)
                if known is None:
                    opened[key] = state[key]
                    near = chunks[at[key] : at[key] + ROUND_CHUNKS]
                    plan += [(*key, c["_chunk"]) for c in near]
                    break
                state[key] = tuple(known)
                at[key] += 1
        if not opened:
            return starts
        current = dict(opened)

        def advance(rows: pa.Table) -> pa.Table:
            rows, columns = in_order(rows, reads)
            running, out = None, []
            for a, b, (*key, chunk) in segments(rows, [*key_names, "_chunk"]):
                running = current[tuple(key)] if running is None else running
                running, _, _ = step(running, {n: c[a:b] for n, c in columns.items()})
                out.append({
                    **dict(zip(key_names, key)),
                    "_chunk": chunk,
                    "_state": [int(v) for v in running],
                })
            return pa.Table.from_pylist(out, schema=arrow_schema)

        moved = (
            narrow.filter(F.col("_chunk").isin(sorted({p[-1] for p in plan})))
            .join(small_table(spark, plan, wanted), [*keys, "_chunk"])
            .groupBy(*keys)
            .applyInArrow(advance, schema)
            .collect()
        )
        for row in moved:
            after[(*(row[k] for k in keys), row["_chunk"])] = tuple(row["_state"])


def run_fold(chunked: DataFrame, keys: Sequence[str], fold: Fold) -> DataFrame:
    """Fold every key's rows in order: columns ``keys``, ``fold.carry`` and ``fold.output``."""
    starts = chunked.sparkSession.sparkContext.broadcast(_starting_states(chunked, keys, fold))
    kept = [*keys, *fold.carry]
    schema = _with_key_types(chunked, kept, fold.output)
    arrow_schema = to_arrow_schema(schema)
    new = T.StructType.fromDDL(fold.output).names
    init, step, reads, key_names = tuple(fold.init), fold.step, list(fold.reads), list(keys)

    def produce(rows: pa.Table) -> pa.Table:
        chunk = rows["_chunk"][0].as_py()
        rows, columns = in_order(rows, reads)
        where, made = [], {name: [] for name in new}
        for a, b, key in segments(rows, key_names):
            before = starts.value.get((*key, chunk), init)
            _, index, out = step(before, {n: c[a:b] for n, c in columns.items()})
            where.append(index + a)
            for name in new:
                made[name].append(out[name])
        picked = rows.select(kept).take(pa.array(np.concatenate(where)))
        for name in new:
            picked = picked.append_column(name, pa.array(np.concatenate(made[name])))
        return picked.cast(arrow_schema)

    needed = dict.fromkeys([*kept, *fold.reads, "_pos", "_chunk"])
    return chunked.select(*needed).groupBy("_chunk").applyInArrow(produce, schema)
