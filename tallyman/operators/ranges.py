"""Cutting large files into byte ranges, naming the parts, and checking them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyman.functions import chunk_suffix, part_letters
from tallyman.operators.ordered import (
    CHUNK_ROWS,
    Fold,
    ordered_chunks,
    run_fold,
    with_row_number,
    with_running_sum,
)


def cutting(part_bytes: int) -> Fold:
    """Walk the cuts through sorted, disjoint protected ranges; the state is the last cut.

    A chunk of ranges decides the cuts that fall before its end. One that ends before the
    next regular cut decides nothing and is skipped.
    """

    def step(state, columns):
        (pos,) = state
        starts, ends, total = columns["start"], columns["end"], int(columns["total"][0])
        last, cuts = int(ends[-1]), []
        while total - pos > part_bytes and pos + part_bytes < last:
            cut = pos + part_bytes
            at = int(np.searchsorted(starts, cut)) - 1
            if at >= 0 and cut < ends[at]:
                cut = int(starts[at] if starts[at] > pos else ends[at])
            cuts.append(cut)
            pos = cut
        index = np.zeros(len(cuts), dtype=np.int64)
        return (pos,), index, {"cut": np.array(cuts, dtype=np.int64)}

    def skip(state, chunk):
        if state[0] + part_bytes >= chunk["until"]:
            return state
        return None

    return Fold(
        init=(0,),
        reads=("start", "end", "total"),
        step=step,
        output="cut long",
        skip=skip,
        summary=(F.max("end").alias("until"),),
    )


def cut_ranges(
    archives: DataFrame, protected: DataFrame, part_bytes: int, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """``(archive, part, start, end)``: parts at most ``part_bytes`` long, ranges kept whole.

    ``archives (archive, total)``; ``protected (archive, start, end)``, disjoint. A cut that
    would fall inside a range moves back to its start; a range that already starts the part
    becomes a part of its own, however long.

    Only cuts near ranges need the fold; the regular cuts after an archive's last range are
    arithmetic. Parts are numbered over a distributed sort and joined to the cut before, so
    an archive of very many parts is no hot key.
    """
    rows = protected.join(archives, "archive").select("archive", "start", "end", "total")
    chunked = ordered_chunks(rows, ["archive", "start"], chunk_rows, "ranges")
    near = run_fold(chunked, ["archive"], cutting(part_bytes))
    last = near.groupBy("archive").agg(F.max("cut").alias("last"))
    tail = archives.join(last, "archive", "left").withColumn(
        "last", F.coalesce("last", F.lit(0).cast("long"))
    )
    step = F.lit(part_bytes).cast("long")
    after = tail.filter(F.col("total") - F.col("last") > step).select(
        "archive",
        F.explode(F.sequence(F.col("last") + step, F.col("total") - F.lit(1), step)).alias("cut"),
    )
    ends = archives.select("archive", F.col("total").alias("cut"))
    edges = near.unionByName(after).unionByName(ends)
    numbered = with_row_number(edges, ["archive", "cut"], "n", chunk_rows)
    first = numbered.groupBy("archive").agg(F.min("n").alias("first"))
    before = numbered.select("archive", (F.col("n") + 1).alias("n"), F.col("cut").alias("start"))
    return (
        numbered.join(before, ["archive", "n"], "left")
        .join(first, "archive")
        .select(
            "archive",
            (F.col("n") - F.col("first")).cast("int").alias("part"),
            F.coalesce("start", F.lit(0).cast("long")).alias("start"),
            F.col("cut").alias("end"),
        )
    )


def containment(parts: DataFrame, protected: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``(archive, name, start, end, home, spans, first_part, last_part)`` per protected range.

    ``home`` is the part that holds the range whole, else null and ``spans`` counts the
    parts it touches, with ``first_part`` and ``last_part``. A range that no part touches has
    ``spans`` 0; an empty one lies in the part that holds its start. Parts of one archive don't
    overlap each other; gaps between them may be left. Ranges may overlap as they like.

    A sweep in place of a join of intervals: parts are numbered over a distributed sort, and two
    running counts say how many parts end at or before a range's start and how many begin before
    its end. What lies between is what it touches, so a range over a million parts is still
    one row, and only its first and last part are looked up by number.
    """
    keys = ["archive", "name", "start", "end"]
    every = protected.select(*keys).distinct()
    within = F.greatest("end", F.col("start") + 1)
    known = parts.filter("archive IS NOT NULL")

    def before(edge: Column, point: Column, part_first: bool, name: str) -> DataFrame:
        """How many parts, over all archives in order, have their ``edge`` before a range's ``point``."""
        sides = known.select("archive", edge.alias("at"), F.lit(0 if part_first else 1).alias("turn"), F.lit(1).alias("one")).unionByName(
            every.select(*keys, point.alias("at"), F.lit(1 if part_first else 0).alias("turn"), F.lit(0).alias("one")),
            allowMissingColumns=True,
        )
        counted = with_running_sum(sides, [F.asc_nulls_first("archive"), "at", "turn"], F.col("one"), name, chunk_rows)
        return counted.filter("one = 0").select(*keys, name)

    numbered = with_row_number(known.select("archive", "part", "start", "end"), ["archive", "start", "end"], "n", chunk_rows)
    ended = before(F.col("end"), F.col("start"), True, "ended").alias("e")
    begun = before(F.col("start"), within, False, "begun").alias("b")
    same = F.expr(" AND ".join(f"e.`{k}` <=> b.`{k}`" for k in keys))
    counts = ended.join(begun, same).select(*[F.col(f"e.{k}") for k in keys], "ended", "begun")
    # A null archive has no parts.
    spans = F.when(F.col("archive").isNotNull(), F.greatest(F.col("begun") - F.col("ended"), F.lit(0))).otherwise(0)
    counts = counts.withColumn("spans", spans.cast("long"))
    first = numbered.select((F.col("n") - 1).alias("ended"), F.col("part").alias("first_part"), F.col("start").alias("ps"), F.col("end").alias("pe"))
    last = numbered.select(F.col("n").alias("begun"), F.col("part").alias("last_part"))
    met = counts.filter("spans > 0").join(first, "ended", "left").join(last, "begun", "left")
    whole = (F.col("spans") == 1) & (F.col("ps") <= F.col("start")) & (F.col("end") <= F.col("pe"))
    found = met.select(*keys, F.when(whole, F.col("first_part")).alias("home"), "spans", "first_part", "last_part")
    none = F.lit(None).cast(parts.schema["part"].dataType)
    apart = counts.filter("spans = 0").select(
        *keys, none.alias("home"), "spans", none.alias("first_part"), none.alias("last_part")
    )
    return found.unionByName(apart)


def sub_chunks(parts: DataFrame, max_part: int, sub: int) -> DataFrame:
    """Parts over ``max_part`` divided near-equally: ``(archive, part, chunk, offset, bytes)``.

    A part of ``b`` bytes becomes ``ceil(b / sub)`` chunks, the first ``b mod n`` of them one
    byte longer. A part that fits is one row with a null ``chunk``.
    """
    if sub > max_part:
        raise ValueError("sub chunks must not exceed the part ceiling")
    size = F.col("end") - F.col("start")
    sized = parts.withColumn("b", size).withColumn(
        "n",
        F.when(
            F.col("b") > max_part, F.expr(f"CAST((b + {sub - 1}L) div {sub}L AS bigint)")
        ).otherwise(F.lit(1).cast("long")),
    )
    base, extra = F.expr("b div n"), F.col("b") % F.col("n")
    return sized.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).select(
        "archive",
        "part",
        F.when(F.col("b") > max_part, F.col("i")).alias("chunk"),
        (F.col("start") + F.col("i") * base + F.least(F.col("i"), extra)).alias("offset"),
        (base + F.when(F.col("i") < extra, 1).otherwise(0)).alias("bytes"),
    )


def fixed_chunks(files: DataFrame, chunk_bytes: int) -> DataFrame:
    """Plain equal slices ``(name, chunk, chunk_name, offset, bytes)`` of ``files (name, bytes)``.

    Chunk names carry ``.part-NN``, wider from 100 on. An empty file has no chunk.
    """
    step = F.lit(chunk_bytes).cast("long")
    digits = F.col("chunk").cast("string")
    return (
        files.filter(F.col("bytes") > 0)
        .withColumn("offset", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, step)))
        .withColumn("chunk", F.expr(f"CAST(offset div {chunk_bytes}L AS int)"))
        .select(
            "name",
            "chunk",
            F.concat(
                "name",
                F.lit(".part-"),
                F.when(F.col("chunk") < 100, F.lpad(digits, 2, "0")).otherwise(digits),
            ).alias("chunk_name"),
            "offset",
            F.least(step, F.col("bytes") - F.col("offset")).alias("bytes"),
        )
    )


def part_names(chunks: DataFrame, stem: Column) -> DataFrame:
    """``name`` and ``status`` for chunks: stem, two letters, and ``.partNN`` when divided.

    Part 676 and up cannot be named: the name is null and the status ``unnameable``.
    """
    whole = F.concat(stem, part_letters(F.col("part")))
    name = F.when(F.col("chunk").isNull(), whole).otherwise(
        F.concat(whole, chunk_suffix(F.col("chunk")))
    )
    return chunks.withColumn("name", name).withColumn(
        "status", F.when(F.col("name").isNull(), "unnameable").otherwise("ok")
    )


def resolve_parts(outputs: DataFrame, files: DataFrame) -> DataFrame:
    """``(output, parts, bytes, status)``: how each declared output is present on disk.

    The file of that name wins (``whole``), else its ``.part-*`` files count together
    (``parts``), else it is ``missing`` with null bytes. Sizes add up the same either way.
    """
    stem = F.regexp_extract("name", r"^(.*)\.part-[^/]*$", 1)
    # A name with several ".part-" belongs to every prefix of it that is declared.
    holders = files.select(
        "bytes",
        F.col("name").alias("output"),
        F.lit(True).alias("whole"),
    ).unionByName(
        files.filter(stem != "").select(
            "bytes",
            F.explode(_part_stems(F.col("name"))).alias("output"),
            F.lit(False).alias("whole"),
        )
    )
    per_output = holders.groupBy("output").agg(
        F.max(F.when(F.col("whole"), F.col("bytes"))).alias("whole_bytes"),
        F.sum(F.when(~F.col("whole"), F.col("bytes"))).alias("part_bytes"),
        F.count_if(~F.col("whole")).alias("n"),
    )
    is_whole = F.col("whole_bytes").isNotNull()
    return outputs.select("output").join(per_output, "output", "left").select(
        "output",
        F.when(is_whole, F.lit(1).cast("long")).otherwise(F.coalesce("n", F.lit(0))).alias("parts"),
        F.coalesce("whole_bytes", "part_bytes").alias("bytes"),
        F.when(is_whole, "whole").when(F.col("n") > 0, "parts").otherwise("missing").alias("status"),
    )


def _part_stems(name: Column) -> Column:
    """The prefixes of ``name`` that end just before a ``.part-``."""
    pieces = F.split(name, r"\.part-")
    return F.transform(
        F.sequence(F.lit(1), F.size(pieces) - 1),
        lambda n: F.array_join(F.slice(pieces, F.lit(1), n), ".part-"),
    )


def assembly_plan(files: DataFrame, archives: DataFrame) -> DataFrame:
    """Per directory what joining its parts needs: ``(dir, stem, parts, expected, action)``.

    ``files (dir, name, bytes)`` are parts ``<stem>XX`` with a stem ending in ``.zim``, or
    chunks ``<stem>XX.partNN`` of them; ``archives (dir, name, bytes)`` are finished ones.
    A part weighs its own file plus its chunks, which count only when chunk ``00`` is there.

    The action is ``already_whole`` when the archive has exactly the expected size, ``join``
    otherwise, ``ambiguous`` for a directory holding parts of several archives, and
    ``nothing`` for one without an undivided part to tell the archive's name.
    """
    part = F.regexp_extract("name", r"^(.*\.zim[^/]{2})(\.part..)?$", 1)
    chunk = F.regexp_extract("name", r"^.*\.zim[^/]{2}\.part(..)$", 1)
    per_part = (
        files.select("dir", "bytes", part.alias("part"), chunk.alias("chunk"))
        .groupBy("dir", "part")
        .agg(
            F.sum(F.when(F.col("chunk") == "", F.col("bytes"))).alias("own"),
            F.sum(F.when(F.col("chunk") != "", F.col("bytes"))).alias("chunked"),
            F.bool_or(F.col("chunk") == "00").alias("opens"),
        )
        .withColumn("own", F.when(F.col("part") != "", F.col("own")))
        .withColumn("chunked", F.when(F.col("opens"), F.col("chunked")))
    )
    zero = F.lit(0).cast("long")
    per_stem = (
        per_part.withColumn(
            "stem", F.when(F.col("part") != "", F.left("part", F.length("part") - F.lit(2)))
        )
        .groupBy("dir", "stem")
        .agg(
            F.count_if(F.col("own").isNotNull() | F.col("chunked").isNotNull()).alias("parts"),
            F.sum(F.coalesce("own", zero) + F.coalesce("chunked", zero)).alias("expected"),
            F.bool_or(F.col("own").isNotNull()).alias("named"),
        )
    )
    named = F.when(F.col("named"), F.struct("stem", "parts", "expected"))
    per_dir = per_stem.groupBy("dir").agg(
        F.count_if("named").alias("stems"), F.max(named).alias("one")
    )
    single = F.col("stems") == 1
    rows = per_dir.select(
        "dir",
        "stems",
        *[F.when(single, F.col(f"one.{c}")).alias(c) for c in ("stem", "parts", "expected")],
    )
    done = archives.select("dir", F.col("name").alias("stem"), F.col("bytes").alias("have"))
    return rows.join(done, ["dir", "stem"], "left").select(
        "dir",
        "stem",
        "parts",
        "expected",
        F.when(F.col("stems") > 1, "ambiguous")
        .when((F.col("stems") == 0) | (F.col("expected") == 0), "nothing")
        .when(F.col("have") == F.col("expected"), "already_whole")
        .otherwise("join")
        .alias("action"),
    )


def part_coverage(parts: DataFrame, archives: DataFrame) -> DataFrame:
    """Whether parts tile their archive: ``(archive, parts, bytes, total, breaks, status)``.

    ``breaks`` counts part edges without a matching neighbour. Edges are matched by
    aggregating starts and ends at each offset, so no window runs over an archive. Exact
    means no break and the sizes adding up to the total; otherwise ``short``, ``long`` or
    ``misplaced`` by the sum of sizes.
    """
    edges = parts.select(
        "archive", F.col("start").alias("at"), F.lit(1).alias("opens"), F.lit(0).alias("closes")
    ).unionByName(
        parts.select(
            "archive", F.col("end").alias("at"), F.lit(0).alias("opens"), F.lit(1).alias("closes")
        )
    )
    bounds = archives.select("archive", "total")
    per_offset = edges.groupBy("archive", "at").agg(
        F.sum("opens").alias("opens"), F.sum("closes").alias("closes")
    )
    broken = (
        per_offset.join(bounds, "archive")
        .withColumn("need_open", F.when(F.col("at") == F.col("total"), 0).otherwise(1))
        .withColumn("need_close", F.when(F.col("at") == 0, 0).otherwise(1))
        .groupBy("archive")
        .agg(
            F.count_if(
                (F.col("opens") != F.col("need_open")) | (F.col("closes") != F.col("need_close"))
            ).alias("breaks")
        )
    )
    sums = parts.groupBy("archive").agg(
        F.count(F.lit(1)).alias("parts"), F.sum(F.col("end") - F.col("start")).alias("bytes")
    )
    return (
        bounds.join(sums, "archive", "left")
        .join(broken, "archive", "left")
        .select(
            "archive",
            F.coalesce("parts", F.lit(0)).alias("parts"),
            F.coalesce("bytes", F.lit(0)).alias("bytes"),
            "total",
            F.coalesce("breaks", F.lit(0)).alias("breaks"),
        )
        .withColumn(
            "status",
            F.when(F.col("bytes") < F.col("total"), "short")
            .when(F.col("bytes") > F.col("total"), "long")
            .when(F.col("breaks") > 0, "misplaced")
            .otherwise("exact"),
        )
    )
