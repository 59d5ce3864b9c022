"""Repeated passages by sparse suffix arrays.

Only suffixes that start at content-selected places are retained: the minimiser among the
``anchor``-word hashes of every ``min_words`` words. Equal passages select equal places, so a
passage of ``min_words`` words or more that occurs twice has a retained suffix in common, at
the same distance from its start. Retained suffixes are ordered by the hash of their first
``anchor`` words; one without an equal neighbour is done. The others are extended to the left
and right: every ``min_words``-word passage that contains the suffix's start, and whose
minimiser it is, gets its hash, and equal hashes are repeats. Each passage has one minimiser,
so each is compared once, and the answer is exact but for 64-bit collisions.

Neighbours in the order are met by aggregates on the hash instead of by a sort through one
task: a passage that a third of all documents share is combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyman.llm.words import column_words, is_space, text_buffers, window_hashes
from tallyman.session import stage

#: Words a passage has at least to count as repeated.
MIN_WORDS = 50
#: Words of a suffix that are hashed for the first comparison.
ANCHOR_WORDS = 20

#: Stands for a null document id inside the operator, so that groups and joins keep its row.
_NO_ID = -(1 << 63)


def minimisers(grams: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leftmost minima of every ``span`` hashes in a row: places, first and last window."""
    if len(grams) < span:
        none = np.zeros(0, np.int64)
        return none, none, none
    chosen = sliding_window_view(grams, span).argmin(1) + np.arange(len(grams) - span + 1)
    edge = np.flatnonzero(np.diff(chosen)) + 1
    first = np.concatenate(([0], edge))
    last = np.concatenate((edge, [len(chosen)])) - 1
    return chosen[first], first, last


def _retain(min_words: int, anchor: int):
    span = min_words - anchor + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, words in column_words(batch.column("text")):
                grams = window_hashes(words.hashes, anchor, 1)
                found, times = [], []
                for a, b in zip(words.offsets[:-1], words.offsets[1:], strict=True):
                    own = grams[a : max(a, b - anchor + 1)]
                    # A text that repeats itself names a suffix once.
                    once, n = np.unique(own[minimisers(own, span)[0]], return_counts=True)
                    found.append(once.view(np.int64))
                    times.append(n)
                part = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc"),
                        part.column("k1"),
                        part.column("k2"),
                        pa.array(words.counts.astype(np.int64)),
                        pa.array(found, pa.list_(pa.int64())),
                        pa.array(times, pa.list_(pa.int64())),
                    ],
                    ["doc", "k1", "k2", "n_words", "suffixes", "times"],
                )

    return run


def _extend(min_words: int, anchor: int):
    span = min_words - anchor + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column("doc").to_numpy(zero_copy_only=False)
            keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2")]
            wanted = batch.column("wanted")
            for at, to, words in column_words(batch.column("text")):
                grams = window_hashes(words.hashes, anchor, 1)
                passages = window_hashes(words.hashes, min_words, 2)
                for i in range(to - at):
                    a, b = words.offsets[i], words.offsets[i + 1]
                    own = grams[a : max(a, b - anchor + 1)]
                    places, first, last = minimisers(own, span)
                    keep = np.isin(own[places].view(np.int64), wanted[at + i].values.to_numpy())
                    first, last = first[keep], last[keep]
                    lengths = last - first + 1
                    starts = np.repeat(first - np.cumsum(lengths) + lengths, lengths)
                    starts = starts + np.arange(len(starts))
                    if not len(starts):
                        continue
                    hashes = passages[a + starts]
                    # Only a text's first passage needs the second half of its class.
                    named = [
                        pa.array(np.full(len(starts), keys[0][at + i], np.int64)),
                        pa.array(np.full(len(starts), keys[1][at + i], np.int64), mask=starts > 0),
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(starts), docs[at + i], np.int64)),
                            pa.array(starts.astype(np.int32)),
                            pa.array(hashes.view(np.int64)),
                            pa.array(_again(hashes, starts, min_words)),
                            *named,
                        ],
                        ["doc", "start", "passage", "again", "k1", "k2"],
                    )

    return _joined(run)


def _joined(run, rows: int = 1 << 16):
    """Small batches of a run put together."""

    def out(batches):
        held, size = [], 0
        for batch in run(batches):
            held.append(batch)
            size += batch.num_rows
            if size >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return out


def _again(hashes: np.ndarray, starts: np.ndarray, apart: int) -> np.ndarray:
    """Whether the passage began in this text before, ``apart`` words or more to the left."""
    _, first, back = np.unique(hashes, return_index=True, return_inverse=True)
    return starts - starts[first][back] >= apart


def _spans(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            starts, later, origin = (batch.column(c) for c in ("starts", "later", "origin"))
            whole, copy = batch.column("whole_of"), batch.column("copy_of")
            for i in range(batch.num_rows):
                doc, n = batch.column("doc")[i].as_py(), batch.column("n_words")[i].as_py()
                key = batch.column("k1")[i].as_py()
                if copy[i].is_valid:
                    out.append((doc, 0, n, copy[i].as_py(), [0], [n], key))
                    continue
                at = starts[i].values.to_numpy() if starts[i].is_valid else np.zeros(0, np.int32)
                order = np.argsort(at, kind="stable")
                at = at[order].astype(np.int64)
                gone = np.asarray(later[i].values, bool)[order] if len(at) else np.zeros(0, bool)
                first = origin[i].values.to_numpy()[order] if len(at) else at
                if whole[i].is_valid:
                    runs = [(0, n, whole[i].as_py())]
                else:
                    runs = [(a, b, first[k]) for a, b, k in _merge(at, min_words)]
                cut = [(a, b) for a, b, _ in _merge(at[gone], min_words)]
                for a, b, source in runs:
                    mine = [(x, y) for x, y in cut if a <= x and y <= b]
                    out.append((doc, a, b, source, [x for x, _ in mine], [y for _, y in mine], key))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()]
            columns = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["doc", "start", "stop", "origin", "cut_from", "cut_to", "k1"],
            )

    return run


def _merge(starts: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Runs covered by windows at sorted ``starts``: begin, end, index of the first window."""
    if not len(starts):
        return []
    heads = np.concatenate(([0], np.flatnonzero(np.diff(starts) > size) + 1))
    tails = np.concatenate((heads[1:], [len(starts)])) - 1
    return [(int(starts[h]), int(starts[t]) + size, int(h)) for h, t in zip(heads, tails, strict=True)]


def repeated_passages(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = MIN_WORDS,
    anchor_words: int = ANCHOR_WORDS,
) -> DataFrame:
    """A row per maximal run of words that repeats: id, start, stop, origin, cut_from, cut_to, text_key.

    ``start`` and ``stop`` count words (stop excluded). A word belongs to a run if some
    ``min_words`` words around it occur in another document, or in this one without overlap.
    ``origin`` is the smallest id that has the run's first passage. ``cut_from``/``cut_to``
    are the parts of the run that are copies: their passages occur in a document with a
    smaller id, or at least ``min_words`` words to the left. Cutting them leaves one of each.

    Null and empty texts, and texts of fewer than ``min_words`` words, have no rows. Rows with
    the same id count as one document: they are no repeats of each other. Each of their texts has
    its own runs, named by ``text_key``. A null id
    counts as an id of its own, smaller than all others. Words are compared as they are
    written. An empty table gives no rows; other columns are not looked at. Memory of a task
    follows the longest text.
    """
    if not 0 < anchor_words < min_words:
        raise ValueError("anchor_words must lie between 0 and min_words")
    text = F.col(text_col)
    source = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc"),
        F.xxhash64(text).alias("k1"),
        F.xxhash64(F.lit("second"), text).alias("k2"),
        text.alias("text"),
    ).filter(text.isNotNull())
    retained = stage(
        source.mapInArrow(
            _retain(min_words, anchor_words),
            "doc long, k1 long, k2 long, n_words long, suffixes array<long>, times array<long>",
        ).filter("n_words >= %d" % min_words),
        "suffixes",
    )
    # Equal texts are one text here; their copies are runs over the whole text.
    same = stage(
        retained.groupBy("k1", "k2").agg(
            F.min("doc").alias("rep"), F.max("doc").alias("top"), F.max("n_words").alias("n_words")
        ),
        "equal-texts",
    )
    reps = same.select("k1", "k2", F.col("rep").alias("doc"))
    heads = retained.join(reps, ["k1", "k2", "doc"], "left_semi").dropDuplicates(["doc", "k1", "k2"])
    each = F.inline(F.arrays_zip(F.col("suffixes").alias("suffix"), F.col("times").alias("n")))
    suffix = heads.select("doc", "k1", "k2", each)
    # Staged for a shuffle of its own on both sides of the join, so that a hot suffix can be split.
    shared = stage(suffix.groupBy("suffix").agg(F.sum("n").alias("n")).filter("n > 1").select("suffix"), "shared")
    wanted = (
        suffix.select("doc", "k1", "k2", "suffix")
        .join(shared, "suffix")
        .groupBy("doc", "k1", "k2")
        .agg(F.collect_set("suffix").alias("wanted"))
    )
    passages = stage(
        source.join(wanted, ["doc", "k1", "k2"])
        .dropDuplicates(["doc", "k1", "k2"])
        .select("doc", "k1", "k2", "text", "wanted")
        .mapInArrow(
            _extend(min_words, anchor_words),
            "doc long, start int, passage long, again boolean, k1 long, k2 long",
        ),
        "passages",
    )
    places = passages.groupBy("passage").agg(
        F.min("doc").alias("origin"), F.max("doc").alias("last"), F.max("again").alias("again_any")
    )
    # Staged, so that the join has a shuffle of its own on both sides and a passage that very many
    # documents share can be split.
    places = stage(places.filter("origin < last OR again_any").select("passage", "origin"), "places")
    # Texts that share an id are told apart by their hash.
    found = passages.drop("k2").join(places, "passage").groupBy("doc", "k1").agg(
        F.collect_list(
            F.struct("start", ((F.col("doc") > F.col("origin")) | F.col("again")).alias("later"), "origin")
        ).alias("hits")
    )
    # A run over a whole text starts with the text's first passage, which may stand in an earlier
    # document that is no copy: then that one is the origin for the whole class.
    twice = same.filter("rep < top").drop("top")
    firsts = (
        passages.filter("start = 0")
        .select("k1", "k2", "passage")
        .join(twice, ["k1", "k2"])
        .join(places, "passage")
        .filter("origin < rep")
        .groupBy("k1", "k2")
        .agg(F.min("origin").alias("first"))
    )
    classes = stage(
        twice.join(firsts, ["k1", "k2"], "left").withColumn("first", F.coalesce("first", "rep")), "classes"
    )
    copies = (
        retained.select("doc", "k1", "k2")
        .distinct()
        .join(classes, ["k1", "k2"])
        .select(
            "doc",
            "k1",
            "n_words",
            F.when(F.col("doc") == F.col("rep"), F.col("first")).alias("whole_of"),
            F.when(F.col("doc") > F.col("rep"), F.col("first")).alias("copy_of"),
        )
        .groupBy("doc", "k1")
        .agg(F.max("n_words").alias("n_words"), F.min("whole_of").alias("whole_of"), F.min("copy_of").alias("copy_of"))
    )
    runs = (
        found.join(copies, ["doc", "k1"], "full_outer")
        .select(
            "doc",
            "k1",
            F.coalesce("n_words", F.lit(0)).alias("n_words"),
            "whole_of",
            "copy_of",
            F.col("hits.start").alias("starts"),
            F.col("hits.later").alias("later"),
            F.col("hits.origin").alias("origin"),
        )
        .mapInArrow(
            _spans(min_words),
            "doc long, start long, stop long, origin long, cut_from array<long>, cut_to array<long>, k1 long",
        )
    )
    real = lambda c: F.when(F.col(c) != _NO_ID, F.col(c))
    return runs.select(
        real("doc").alias(id_col), "start", "stop", real("origin").alias("origin"), "cut_from", "cut_to", F.col("k1").alias("text_key")
    )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removes word ranges; a removed range goes with the white space behind it."""
    for batch in batches:
        column = batch.column("text")
        data, begins = text_buffers(column)
        spans = batch.column("spans")
        out, emptied = [], np.zeros(batch.num_rows, bool)
        for i in range(batch.num_rows):
            if not column[i].is_valid or not spans[i].is_valid:
                out.append(column[i].as_py())
                continue
            own = data[begins[i] : begins[i + 1]]
            space = is_space(own)
            word = ~space
            starts = np.flatnonzero(word & np.concatenate(([True], space[:-1])))
            where = np.concatenate((starts, [len(own)]))
            keep = np.ones(len(own), bool)
            for span in spans[i].as_py():
                for a, b in zip(span["cut_from"], span["cut_to"], strict=True):
                    if a < len(starts):
                        keep[where[a] : where[min(b, len(starts))]] = False
            out.append(own[keep].tobytes().decode("utf-8"))
            emptied[i] = not (keep & word).any()
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.array(out, pa.string()), pa.array(emptied)], ["row", "text", "emptied"]
        )


def cut_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = MIN_WORDS,
    anchor_words: int = ANCHOR_WORDS,
    drop_emptied: bool = False,
) -> DataFrame:
    """``docs`` with the copies of repeated passages cut out of the texts.

    One occurrence of each passage stays. All columns and all rows are kept; a text that was
    a copy throughout becomes empty, or goes with ``drop_emptied``. Rows with the same id are cut each by its own text. Null
    texts stay null. Columns may have any name; an empty table stays empty.
    """
    cut = repeated_passages(docs, id_col, text_col, min_words, anchor_words)
    cut = cut.filter(F.size("cut_from") > 0).groupBy(F.coalesce(id_col, F.lit(_NO_ID)).alias("cut_id"), "text_key").agg(
        F.collect_list(F.struct("cut_from", "cut_to")).alias("spans")
    )
    others = [c for c in docs.columns if c != text_col]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"),
        F.col(f"`{text_col}`").alias("text"),
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_NO_ID)).alias("id"),
        F.xxhash64(F.col(f"`{text_col}`")).alias("key"),
    )
    same = (F.col("id") == F.col("cut_id")) & (F.col("key") == F.col("text_key"))
    packed = rows.join(cut, same, "left").select("row", "text", "spans")
    row_type = packed.schema["row"].dataType.simpleString()
    done = packed.mapInArrow(_cut, f"row {row_type}, text string, emptied boolean")
    if drop_emptied:
        done = done.filter(~F.col("emptied"))
    return done.select(
        *[F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns]
    )
