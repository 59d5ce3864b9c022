"""Splitting large files into named parts without cutting what must stay whole."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from tallyman.operators.ordered import CHUNK_ROWS
from tallyman.operators.ranges import (
    containment,
    cut_ranges,
    part_coverage,
    part_names,
    sub_chunks,
)
from tallyman.session import stage


@dataclass(frozen=True)
class Split:
    """``parts``, the named ``files`` they ship as, the ``homes`` of protected ranges
    (a null home means it was cut) and the ``coverage`` per archive."""

    parts: DataFrame
    files: DataFrame
    homes: DataFrame
    coverage: DataFrame


def split_archives(
    archives: DataFrame,
    protected: DataFrame,
    stem: Column,
    part_bytes: int,
    max_part: int,
    sub_bytes: int,
    chunk_rows: int = CHUNK_ROWS,
) -> Split:
    """The layout is planned and checked before anything is written."""
    parts = stage(cut_ranges(archives, protected, part_bytes, chunk_rows), "parts")
    return Split(
        parts=parts,
        files=part_names(sub_chunks(parts, max_part, sub_bytes), stem),
        homes=containment(parts, protected),
        coverage=part_coverage(parts, archives),
    )
