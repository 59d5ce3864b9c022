"""Names of the files a split archive ships as."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: two letters, aa..zz.
LETTER_NAMES = 26 * 26


def part_letters(index: Column) -> Column:
    """``0 -> aa``, ``675 -> zz``, null beyond (the part cannot be named)."""
    first = F.chr(F.lit(97) + F.floor(index / F.lit(26)).cast("long"))
    second = F.chr(F.lit(97) + F.pmod(index, F.lit(26)).cast("long"))
    return F.when((index >= 0) & (index < LETTER_NAMES), F.concat(first, second))


def chunk_suffix(index: Column) -> Column:
    """``.part07``; wider when a part has more than 100 chunks."""
    digits = index.cast("string")
    return F.concat(
        F.lit(".part"), F.when(index < 100, F.lpad(digits, 2, "0")).otherwise(digits)
    )
