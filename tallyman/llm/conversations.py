"""Faults of conversations and the cheapest edits that repair their structure.

Rows are sorted by conversation and turn over the whole cluster, and each task reads its range as a
stream. A conversation that lies within one range and is not long is repaired there. Of the others,
the two at a range's ends and long ones, the rows go on: segments of bounded length become pieces
(``edit_paths.Piece``) in parallel, pieces are joined a few at a time, and at the end the
repaired text of each is hashed as a stream, since a digest can't be split. So no task holds more
of a conversation than a segment, or than the letters of its edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyman.llm.edit_paths import START, Piece, Repair
from tallyman.session import stage

#: Rows, and bytes of text, of a conversation that is repaired at once; rows of a segment.
MOST_ROWS = 4096
MOST_BYTES = 32 << 20
#: Pieces joined at once.
FAN = 16
#: Rows of an Arrow batch that is given out.
OUT_ROWS = 2048

_NONE = object()
_SPACES = " \t\n\x0b\x0c\r"
_ENDINGS = (".", "!", "?")
_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_PIECE = (
    "rows long, blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, "
    "first_role string, last_role string, paths array<struct<start:int,stop:int,cost:long,letters:string>>"
)
_FACTS = ("rows", "blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn", "first_role", "last_role")


def damaged(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``(conv, turn, role, text, dropped)`` with the faults that are planted by row.

    A dropped row stays as a mark, so that its conversation is known. Null roles and texts,
    and nulls in the name that decides, are one space.
    """
    space = F.lit(" ")
    rows = conversations.select(
        F.col(f"`{conv_col}`").alias("conv"),
        F.col(f"`{turn_col}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`"), space).alias("role"),
        F.coalesce(F.col(f"`{text_col}`"), space).alias("text"),
    )
    name = F.concat_ws(":", F.coalesce(F.col("conv").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    rows = rows.withColumn("fault", F.crc32(name) % 20)
    text = F.when(F.col("fault") <= 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    made = rows.select("conv", "turn", role.alias("role"), text.alias("text"), (F.col("fault") == 0).alias("dropped"), "fault")
    twice = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return made.withColumn("copy", F.explode(twice)).drop("fault", "copy")


def _fault(role: str, text: str, seen: set) -> tuple[bool, bool, bool]:
    """Whether a row is blank, or else a duplicate, or else truncated; it is seen from now on."""
    known = (role, text) in seen
    seen.add((role, text))
    return _first_fault(text, known)


def _first_fault(text: str, known: bool) -> tuple[bool, bool, bool]:
    bare = text.rstrip(_SPACES)
    if not bare:
        return True, False, False
    return False, known, not known and not bare.endswith(_ENDINGS)


def _digest(letters: str, rows: list[tuple[str, str]]) -> str:
    repair, lines = Repair(letters), []
    for role, text in rows:
        lines += repair.row(role, text)
    lines += repair.end()
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def _result(piece: Piece) -> dict:
    cost, letters = piece.repair()
    return {
        "gaps": piece.gaps, "blank": piece.blank, "duplicate": piece.duplicate, "truncated": piece.truncated,
        "illegal": piece.illegal, "cost": cost, "audit": letters,
    }


def _stream(schema: pa.Schema, most_rows: int, most_bytes: int, out_rows: int):
    """Finishes conversations that lie within a sorted range and are not long; hands on the others' rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out: list[dict] = []
        number, held, size, opened, first = 0, [], 0, False, True
        conv: object = _NONE

        def hand_on() -> None:
            nonlocal number
            for turn, role, text, dropped in held:
                out.append({"conv": conv, "part": part, "at": number, "turn": turn, "role": role, "text": text, "dropped": dropped})
                number += 1
            held.clear()

        def finish() -> None:
            seen: set = set()
            live = [(turn, role, text) for turn, role, text, dropped in held if not dropped]
            piece = Piece.of([(turn, role[:1], *_fault(role, text, seen)) for turn, role, text in live], (START,))
            found = _result(piece)
            found["repaired_sha256"] = _digest(found["audit"], [(role, text) for _, role, text in live])
            out.append({"conv": conv, **found})
            held.clear()

        def sent() -> Iterator[pa.RecordBatch]:
            while out:
                some, out[:out_rows] = out[:out_rows], []
                yield pa.RecordBatch.from_pylist(some, schema=schema)

        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("conv", "turn", "role", "text", "dropped")]
            for key, *row in zip(*columns):
                if conv is _NONE:
                    conv = key
                if key != conv:
                    # The first conversation of a range may have begun in another.
                    hand_on() if first or opened else finish()
                    conv, size, opened, first = key, 0, False, False
                    if len(out) >= out_rows:
                        yield from sent()
                held.append(tuple(row))
                size += len(row[2])
                if len(held) >= most_rows or size >= most_bytes:
                    opened, size = True, 0
                    hand_on()
                    yield from sent()
        # The last one may go on in another.
        hand_on()
        yield from sent()

    return run


def _piece_row(piece: Piece, **more: object) -> dict:
    paths = [
        {"start": start, "stop": stop, "cost": cost, "letters": letters} for (start, stop), (cost, letters) in piece.paths.items()
    ]
    return {**{n: getattr(piece, n) for n in _FACTS}, "paths": paths, **more}


def _piece(row: dict) -> Piece:
    paths = {(p["start"], p["stop"]): (p["cost"], p["letters"]) for p in row["paths"]}
    return Piece(*(row[n] for n in _FACTS), paths)


def _segments(schema: pa.Schema):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("at")
        rows = [
            (turn, initial, *((False,) * 3 if dropped else flags))
            for turn, initial, dropped, *flags in zip(
                *(group[n].to_pylist() for n in ("turn", "initial", "dropped", "blank", "duplicate", "truncated"))
            )
            if not dropped
        ]
        keys = {n: group[n][0].as_py() for n in ("conv", "part", "block")}
        return pa.Table.from_pylist([_piece_row(Piece.of(rows), **keys)], schema=schema)

    return run


def _join(schema: pa.Schema, fan: int):
    def run(group: pa.Table) -> pa.Table:
        whole = None
        rows = group.sort_by("rank").to_pylist()
        for row in rows:
            whole = _piece(row) if whole is None else whole.joined(_piece(row))
        row = _piece_row(whole, conv=rows[0]["conv"], rank=rows[0]["rank"] // fan)
        return pa.Table.from_pylist([row], schema=schema)

    return run


def _finish(schema: pa.Schema, out_rows: int):
    """From a conversation's piece and then its rows in order: its result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        found = repair = digest = None
        empty = True

        def take(lines: Iterator[str]) -> None:
            nonlocal empty
            for line in lines:
                digest.update(("" if empty else "\n").encode() + line.encode())
                empty = False

        def close() -> None:
            if found is not None:
                take(repair.end())
                out.append({**found, "repaired_sha256": digest.hexdigest()})

        for batch in batches:
            for row in batch.to_pylist():
                if row["audit"] is not None:
                    close()
                    found = {n: row[n] for n in ("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")}
                    repair, digest, empty = Repair(row["audit"]), hashlib.sha256(), True
                elif not row["dropped"]:
                    take(repair.row(row["role"], row["text"]))
            while len(out) >= out_rows:
                some, out[:out_rows] = out[:out_rows], []
                yield pa.RecordBatch.from_pylist(some, schema=schema)
        close()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def repair_conversations(
    conversations: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    damage: bool = True,
) -> DataFrame:
    """A row per conversation: id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    With ``damage`` faults are planted first, by the checksum of id and turn. Rows stand by turn,
    null turns first; rows of one turn by the md5 of ``role:text``. Null roles and texts
    are one space, so the text is blank and the role neither user nor assistant. The role's
    first letter counts; an empty role has none. Empty texts are blank; a text of any length is one
    row. Repeated rows are duplicates. A null id is a conversation. One of which no row is left
    has zeros, no edits and the digest of an empty string. An empty table gives no rows; other
    columns are not looked at.
    """
    if damage:
        rows = damaged(conversations, conv_col, turn_col, role_col, text_col)
    else:
        rows = conversations.select(
            F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
            F.coalesce(F.col(f"`{role_col}`"), F.lit(" ")).alias("role"), F.coalesce(F.col(f"`{text_col}`"), F.lit(" ")).alias("text"),
            F.lit(False).alias("dropped"),
        )
    conv = T.StructType([T.StructField("conv", rows.schema["conv"].dataType)])
    rows = rows.withColumn("tie", F.md5(F.concat_ws(":", "role", "text")))
    order = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), F.asc("tie")]
    schema = T.StructType(
        conv.fields + T.StructType.fromDDL(f"part int, at long, turn long, role string, text string, dropped boolean, {_RESULT}").fields
    )
    seen = stage(
        rows.orderBy(*order).select("conv", "turn", "role", "text", "dropped")
        .mapInArrow(_stream(to_arrow_schema(schema), MOST_ROWS, MOST_BYTES, OUT_ROWS), schema),
        "conversations",
    )
    names = T.StructType.fromDDL(_RESULT).names
    done = seen.filter("part IS NULL").select("conv", *names)
    rest = seen.filter("part IS NOT NULL").select("conv", "part", "at", "turn", "role", "text", "dropped")
    results = done.unionByName(_long(rest, conv))
    return results.select(F.col("conv").alias(conv_col), *names)


def _long(rows: DataFrame, conv: T.StructType) -> DataFrame:
    """The results of conversations whose rows, numbered by part and place, are given."""
    key = [F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit("second"), "role", "text").alias("h2")]
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    ended = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    narrow = rows.select(
        "conv", "part", "at", F.floor(F.col("at") / MOST_ROWS).alias("block"), "turn", "dropped",
        F.substring("role", 1, 1).alias("initial"), blank.alias("blank"), ended.alias("ended"), *key,
    )
    place = F.struct("part", "at")
    firsts = (
        narrow.filter(~F.col("dropped")).groupBy("conv", "h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n"))
        .filter("n > 1").select(F.col("conv").alias("c"), F.col("h1").alias("a"), F.col("h2").alias("b"), "first")
    )
    same = narrow["conv"].eqNullSafe(firsts["c"]) & (narrow["h1"] == firsts["a"]) & (narrow["h2"] == firsts["b"])
    known = F.coalesce(place > F.col("first"), F.lit(False))
    duplicate = ~F.col("blank") & known
    flagged = narrow.join(firsts, same, "left").select(
        "conv", "part", "at", "block", "turn", "dropped", "initial", "blank",
        duplicate.alias("duplicate"), (~F.col("blank") & ~known & ~F.col("ended")).alias("truncated"),
    )
    segment = T.StructType(conv.fields + T.StructType.fromDDL(f"part int, block long, {_PIECE}").fields)
    pieces = stage(flagged.groupBy("conv", "part", "block").applyInArrow(_segments(to_arrow_schema(segment)), segment), "segments")
    rank = F.row_number().over(Window.partitionBy("conv").orderBy("part", "block")) - 1
    facts = T.StructType.fromDDL(_PIECE).names
    ranked = pieces.select("conv", "part", "block").withColumn("rank", rank.cast("long"))
    # A segment is named by part and block alone: a part is a task, and its rows are numbered through.
    pieces = pieces.select("conv", "part", "block", *facts).join(
        ranked.select(F.col("conv").alias("c"), F.col("part").alias("p"), F.col("block").alias("k"), "rank"),
        F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")) & (F.col("block") == F.col("k")),
    ).select("conv", "rank", *facts)
    joined = T.StructType(conv.fields + T.StructType.fromDDL(f"rank long, {_PIECE}").fields)
    while True:
        pieces = stage(
            pieces.groupBy("conv", F.floor(F.col("rank") / FAN).alias("group")).applyInArrow(_join(to_arrow_schema(joined), FAN), joined),
            "pieces",
        )
        if pieces.filter("rank > 0").isEmpty():
            break
    found = pieces.mapInArrow(_results, T.StructType(conv.fields + T.StructType.fromDDL(_RESULT.rpartition(",")[0]).fields))
    told = found.withColumn("part", F.lit(-1)).unionByName(
        rows.select("conv", "part", "at", "role", "text", "dropped"), allowMissingColumns=True
    )
    # Rows of a conversation follow its piece; they pass by one at a time.
    ordered = told.repartition("conv").sortWithinPartitions("conv", "part", "at")
    result = T.StructType(conv.fields + T.StructType.fromDDL(_RESULT).fields)
    return ordered.mapInArrow(_finish(to_arrow_schema(result), OUT_ROWS), result)


def _results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        made = [{"conv": r["conv"], **_result(_piece(r))} for r in rows]
        names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
        kinds = {n: pa.int64() for n in names} | {"conv": batch.schema.field("conv").type, "audit": pa.string()}
        yield pa.RecordBatch.from_pylist(made, schema=pa.schema([(n, kinds[n]) for n in names]))
