"""Words, shingles and their 64-bit hashes, computed over whole Arrow columns at once.

A word is a run of bytes other than 0x20 and 0x09-0x0D. A null text has no words. A slice of
rows is worked on at a time, so memory follows the longest single text and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text forms a slice of its own.
SLICE_BYTES = 1 << 21

_ONE = np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeds(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(seed * 7919 + 1))


@dataclass
class Words:
    """The words of a slice of texts, in order.

    ``hashes[offsets[i]:offsets[i + 1]]`` belong to text ``i``; ``starts`` and ``ends`` are
    byte places in ``data``, where text ``i`` begins at ``begins[i]``.
    """

    hashes: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray
    begins: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def owners(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, and where each row begins; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, where, data = column.buffers()
    begins = np.frombuffer(where, np.int64, len(column) + 1, column.offset * 8) if where else np.zeros(1, np.int64)
    every = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = int(begins[0]) if len(begins) else 0
    return every[first : int(begins[-1])], begins - first


def slices(begins: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes each; at least one row."""
    at, n = 0, len(begins) - 1
    while at < n:
        to = int(np.searchsorted(begins, begins[at] + size, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def _powers(base: int, n: int) -> np.ndarray:
    """``base ** 0`` to ``base ** (n - 1)``, modulo 2**64."""
    out = np.full(max(n, 1), base & _MASK, np.uint64)
    out[0] = _ONE
    return np.cumprod(out, dtype=np.uint64)[:n]


#: Classes of bytes: 0 white space, 1 all others.
WORD = np.where(is_space(np.arange(256)), 0, 1).astype(np.uint8)


def split_words(
    data: np.ndarray, begins: np.ndarray, lower: bool = False, kinds: np.ndarray = WORD
) -> Words:
    """Words of the texts whose bytes are ``data``: runs of one class of ``kinds`` that isn't 0."""
    n = len(data)
    kind = kinds[data]
    edge = np.zeros(n + 1, bool)
    edge[begins] = True
    turn = np.ones(n + 1, bool)
    turn[1:-1] = kind[1:] != kind[:-1]
    turn |= edge
    starts = np.flatnonzero((kind != 0) & turn[:n])
    ends = np.flatnonzero((kind != 0) & turn[1:]) + 1
    letters = seeds(256, 17)[lowered(data) if lower else data]
    letters *= _powers(_BASE, n)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(letters, out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * _powers(pow(_BASE, -1, _MASK + 1), n)[starts]
    hashes = mix(hashes ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    return Words(hashes, np.searchsorted(starts, begins), starts, ends, data, begins)


def column_words(
    column: pa.Array, lower: bool = False, kinds: np.ndarray = WORD
) -> Iterator[tuple[int, int, Words]]:
    """``(first row, end row, words)`` for each slice of a string column."""
    data, begins = text_buffers(column)
    for at, to in slices(begins):
        part = begins[at : to + 1]
        yield at, to, split_words(data[part[0] : part[-1]], part - part[0], lower, kinds)


def window_hashes(hashes: np.ndarray, size: int, seed: int) -> np.ndarray:
    """One hash for each ``size`` words in a row, text borders disregarded."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    c = int(seeds(1, seed)[0]) | 1
    if size <= 8:
        out = np.zeros(n, np.uint64)
        for j in range(size):
            out += hashes[j : j + n] * np.uint64(pow(c, j, _MASK + 1))
        return mix(out)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * _powers(c, len(hashes)), out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * _powers(pow(c, -1, _MASK + 1), n))


def shingle_sets(words: Words, size: int) -> list[np.ndarray]:
    """For each text its distinct ``size``-word shingles as sorted hashes.

    A text with fewer words, but at least one, has one shingle: the whole sequence.
    """
    whole = window_hashes(words.hashes, size, 3)
    out = []
    for a, b in zip(words.offsets[:-1], words.offsets[1:], strict=True):
        if b - a >= size:
            x = np.sort(whole[a : b - size + 1])
            out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
        elif b > a:
            out.append(mix(window_hashes(words.hashes[a:b], int(b - a), 5) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
