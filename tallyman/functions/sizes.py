"""What one archive member costs: a header block plus the padded payload."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the archive format: 512-byte blocks, names of 100 bytes.
BLOCK_BITS = 9
BLOCK = 1 << BLOCK_BITS
NAME_BYTES = 100


def padded(size: Column) -> Column:
    """``size`` rounded up to whole blocks, in integer arithmetic."""
    blocks = F.shiftright(size.cast("long") + F.lit(BLOCK - 1), BLOCK_BITS)
    return F.shiftleft(blocks, BLOCK_BITS)


def long_name_cost(name: Column) -> Column:
    """The extra member a name over 100 UTF-8 bytes needs."""
    nbytes = F.octet_length(name).cast("long")
    return F.when(nbytes > NAME_BYTES, F.lit(BLOCK) + padded(nbytes + F.lit(1))).otherwise(
        F.lit(0).cast("long")
    )


def entry_cost(size: Column, kind: Column, name: Column | None = None) -> Column:
    """Bytes an entry occupies. Directories and symlinks carry no payload.

    With ``name`` the long-name member is charged too (tree packing); without it only the
    header and payload are (archive packing).
    """
    payload = F.when(kind.isin("dir", "symlink"), F.lit(0)).otherwise(
        padded(F.coalesce(size, F.lit(0)))
    )
    own = payload + F.lit(BLOCK).cast("long")
    return own if name is None else own + long_name_cost(name)
