"""Path arithmetic on ``/``-separated strings, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def components(path: Column | str) -> Column:
    """``a/b/c`` as an array. Arrays compare element by element, which is tree order."""
    return F.split(_col(path), "/")


def basename(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", -1)


def parent(path: Column | str) -> Column:
    """The directory holding ``path``; ``''`` (the root) for a top-level name."""
    p = _col(path)
    return F.when(
        F.instr(p, "/") > 0, F.left(p, F.length(p) - F.length(basename(p)) - F.lit(1))
    ).otherwise(F.lit(""))


def prefixes(path: Column | str) -> Column:
    """Every non-empty leading path of ``path``, itself included."""
    parts = components(path)
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
    )


def ancestors(path: Column | str) -> Column:
    """Every directory above ``path``, without the root and without ``path``."""
    p = _col(path)
    return F.when(F.instr(p, "/") > 0, prefixes(parent(p))).otherwise(
        F.array().cast("array<string>")
    )


def strip_prefix(path: Column | str, strip: Column | str) -> Column:
    """Drop as many leading components as ``strip`` has, without comparing them.

    ``strip`` is a literal string or a column. ``''`` means nothing is left: the entry is
    the stripped directory itself and callers drop the row.
    """
    p = _col(path)
    if isinstance(strip, str):
        if not strip:
            return p
        depth: Column = F.lit(len(strip.split("/")))
    else:
        depth = F.when(F.length(strip) == 0, F.lit(0)).otherwise(F.size(F.split(strip, "/")))
    parts = components(p)
    return F.array_join(F.slice(parts, depth + F.lit(1), F.size(parts)), "/")


def normalise(path: Column | str) -> Column:
    """Lexical normal form: ``.`` and empty parts go, ``..`` eats the part before it.

    Leading ``..`` parts of a relative path are kept (that is what an escape looks like);
    an empty result is ``.``. Absolute paths keep their slash and cannot climb above it.
    """
    p = _col(path)
    absolute = p.startswith("/")

    def step(done: Column, part: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        dead_end = F.coalesce(last == F.lit(".."), F.size(done) == 0)
        return (
            F.when(part.isin("", "."), done)
            .when(part != "..", F.array_append(done, part))
            .when(~dead_end, F.slice(done, F.lit(1), F.size(done) - F.lit(1)))
            .when(absolute, done)
            .otherwise(F.array_append(done, part))
        )

    joined = F.array_join(
        F.aggregate(components(p), F.array().cast("array<string>"), step), "/"
    )
    return (
        F.when(absolute, F.concat(F.lit("/"), joined))
        .when(joined == "", F.lit("."))
        .otherwise(joined)
    )
