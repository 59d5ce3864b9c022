"""Packing of tokenised documents into sequences by the linear grouping scheme.

Lengths are whole numbers up to the sequence length, so the corpus is described for the plan
by how many pieces have each length: at most as many figures as a sequence has tokens.
Large lengths, in falling order, form groups of equal cardinality and are rounded up to their
group's largest. That leaves few sizes, for which configurations (what goes into one sequence)
are optimised one after another by a knapsack over the sequence. Actual pieces then take the
places of rounded ones, which leaves slack; small pieces go best-fit, largest first, into the
least slack that holds them. Several numbers of groups are tried, and the plan with the fewest
sequences is used. A plan gives, for each length, runs of ranks and their places; every piece
looks up its own rank's place.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyman.llm.words import slices, text_buffers
from tallyman.session import stage

#: Tokens of a sequence.
CAPACITY = 2048
#: Pieces of up to this share of a sequence are small.
SMALL_SHARE = 1 / 4
#: Numbers of groups that are tried.
GROUPINGS = (48, 384, 1024)
#: Bytes of distinct words a task remembers; more make it start anew.
BYTES_KEPT = 8 << 20
#: Bytes of text that are split and encoded at once; a longer text is encoded alone.
TEXT_BYTES = 4 << 20


_BETWEEN = b"\x01"
#: Words of letters that lower-casing and composing treat one by one: ASCII and U+00C0 to U+00FF.
_PLAIN_WORD = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch
#: Byte-level vocabularies write bytes that don't print as further characters, in order from U+0100 on.
_WRITTEN = {b: 256 + i for i, b in enumerate([*range(33), *range(127, 161), 173])}
#: Signs that are tokens of their own behind an ASCII letter; the apostrophe may begin one.
_SIGNS = bytes(c for c in range(33, 127) if not (chr(c).isalnum() or chr(c) == "'"))


def _lowered(word: bytes) -> bytes:
    """Lower-cased as the tokenizer would, where that is sure; else as it is."""
    if word.isascii():
        return word.lower()
    return word.decode("utf-8").lower().encode() if _PLAIN_WORD(word) else word


def _parts(word: bytes) -> tuple[bytes, ...]:
    """What a word's ids are put together from, lower-cased."""
    if b"<|" in word:  # may be a special token
        return (word,)
    core = word.rstrip(_SIGNS)
    if len(core) == len(word) or not core[-1:].isalpha():
        return (_lowered(word),)
    return (_lowered(core), word[len(core) :])


class WordTokens:
    """Token ids word by word, each distinct word encoded once.

    For tokenizers that lower-case, and never join what white space separates, nor letters and
    signs (apostrophes aside).
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.held = 0
        self.begins, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def learn(self, words: list[bytes]) -> None:
        """Makes new words known, each as its core, or its core and the signs behind that."""
        index = self.index
        whole: dict[bytes, bytes] = {}
        ended: dict[bytes, tuple[bytes, ...]] = {}
        for word in words:
            if word.isalpha():
                whole[word] = word.lower()
            else:
                parts = _parts(word)
                if len(parts) == 1:
                    whole[word] = parts[0]
                else:
                    ended[word] = parts
        missing = {*whole.values(), *(p for parts in ended.values() for p in parts)}.difference(index)
        self._encode(list(missing))
        index.update(zip(whole, map(index.__getitem__, whole.values()), strict=True))
        self.held += sum(map(len, whole)) + sum(map(len, ended)) + sum(map(len, missing))
        # Words of two parts: their ids are gathered from where the parts' are.
        known = np.array([index[p] for parts in ended.values() for p in parts], np.int64)
        ids, counts = self._gather(known)
        self._append(list(ended), ids, counts.reshape(-1, 2).sum(1))

    def _gather(self, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of known words, one after another, and how many each has."""
        counts = self.counts[known]
        ends = np.cumsum(counts)
        place = np.repeat(self.begins[known] - ends + counts, counts)
        return self.ids[place + np.arange(len(place))], counts

    def _append(self, words: list[bytes], ids: np.ndarray, counts: np.ndarray) -> None:
        self.index.update(zip(words, range(len(self.counts), len(self.counts) + len(words)), strict=True))
        self.begins = np.concatenate((self.begins, len(self.ids) + np.cumsum(counts) - counts))
        self.counts = np.concatenate((self.counts, counts))
        self.ids = np.concatenate((self.ids, ids)).astype(np.uint32)

    def _encode(self, words: list[bytes]) -> None:
        """Makes these words known.

        Words of plain letters go straight to the vocabulary's merges, as nothing before them
        would change or split them. Of others many are encoded as one text, with a sign between.
        """
        letters = list(filter(_PLAIN_WORD, words))
        words = list(set(words).difference(letters))
        merge, found, sizes = self.tokenizer.model.tokenize, [], []
        for word in letters:
            tokens = merge(_lowered(word).decode("latin-1").translate(_WRITTEN))
            sizes.append(len(tokens))
            found += [t.id for t in tokens]
        self._append(letters, np.array(found, np.uint32), np.array(sizes, np.int64))
        plain = [w for w in words if _BETWEEN not in w]
        texts = [b" \x01 ".join(plain[i : i + 200]).decode("utf-8") for i in range(0, len(plain), 200)]
        (mark,) = self.tokenizer.encode(_BETWEEN.decode(), add_special_tokens=False).ids
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            own = np.array(e.ids, np.uint32)
            between = own == mark
            counts.append(np.diff(np.concatenate(([-1], np.flatnonzero(between), [len(own)]))) - 1)
            ids.append(own[~between])
        odd = [w for w in words if _BETWEEN in w]
        for word in odd:
            ids.append(np.array(self.tokenizer.encode(word.decode("utf-8"), add_special_tokens=False).ids, np.uint32))
            counts.append(np.array([len(ids[-1])]))
        self._append(plain + odd, np.concatenate(ids), np.concatenate(counts))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(ids of all texts, where each text's begin and the last ends)``.

        Arrow splits the texts and finds their distinct words; only those are looked up. White
        space at a text's ends makes empty words, which have no ids.
        """
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary.cast(pa.large_binary()).to_pylist()
        if self.held > BYTES_KEPT:
            self.clear()
        known = np.fromiter((self.index.get(w, -1) for w in distinct), np.int64, len(distinct))
        new = np.flatnonzero(known < 0)
        missing = [distinct[i] for i in new.tolist()]
        self.learn(missing)
        known[new] = np.fromiter(map(self.index.__getitem__, missing), np.int64, len(new))
        ids, counts = self._gather(known[words.indices.to_numpy()])
        offsets = split.offsets.to_numpy().astype(np.int64)
        return ids, np.concatenate(([0], np.cumsum(counts)))[offsets - offsets[0]]


def _pieces(tokenizer_path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tokens = TaskContext.get().partitionId(), WordTokens(tokenizer_path)
        ranks = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            docs, column = batch.column("doc"), batch.column("text").cast(pa.large_string()).fill_null("")
            _, begins = text_buffers(column)
            for at, to in slices(begins, TEXT_BYTES):
                owner, piece, start, length, crc = [], [], [], [], []
                found, edges = tokens.encode(column.slice(at, to - at))
                for i, (first, last) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
                    ids = np.append(found[first:last], np.uint32(end_id)).astype("<u4")
                    for k, a in enumerate(range(0, len(ids), capacity)):
                        own = ids[a : a + capacity]
                        owner.append(at + i)
                        piece.append(k)
                        start.append(a)
                        length.append(len(own))
                        crc.append(zlib.crc32(own.tobytes()))
                rank = _ranks(np.array(length), ranks)
                yield pa.RecordBatch.from_arrays(
                    [
                        docs.take(pa.array(owner, pa.int64())),
                        pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array(crc, pa.int64()),
                        pa.array([part] * len(owner), pa.int32()),
                        pa.array(rank),
                    ],
                    ["doc", "piece", "start", "length", "ids_crc32", "part", "rank"],
                )

    return run


def _ranks(lengths: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The rank of each piece among those of its length; ``seen`` is carried on."""
    order = np.argsort(lengths, kind="stable")
    ordered = lengths[order]
    heads = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    counts = np.diff(np.concatenate((heads, [len(ordered)])))
    out = np.empty(len(lengths), np.int64)
    out[order] = np.arange(len(ordered)) - np.repeat(heads, counts) + seen[ordered]
    seen[ordered[heads]] += counts
    return out


@dataclass
class Plan:
    """Places for runs of ranks: ``(length, first rank, count, first sequence, offset)``."""

    capacity: int
    runs: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0
    #: By slack: blocks ``(first sequence, count)`` of sequences that have it.
    slack: dict[int, list[tuple[int, int]]] = field(default_factory=dict)

    def open(self, count: int) -> int:
        first = self.sequences
        self.sequences += count
        return first

    def leave(self, slack: int, first: int, count: int) -> None:
        if count and slack:
            self.slack.setdefault(slack, []).append((first, count))


def make_plan(counts: np.ndarray, capacity: int, groups: int, small: int) -> Plan:
    """A plan for ``counts[length]`` pieces of each length."""
    plan = Plan(capacity)
    lengths = np.arange(capacity, small, -1)
    held = counts[lengths]
    ends = np.cumsum(held)
    total = int(ends[-1]) if len(ends) else 0
    # Groups of equal cardinality over the large pieces in falling order.
    edges = sorted({total * g // groups for g in range(groups + 1)})
    at = [(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    length_at = lambda p: int(lengths[np.searchsorted(ends, p, "right")])
    sizes = [length_at(a) for a, _ in at]
    used = [a for a, _ in at]
    for config, times in _configurations(sizes, [b - a for a, b in at], capacity):
        slots = []
        for g, copies in config:
            for _ in range(copies):
                slots.append(used[g])
                used[g] += times
        _substitute(plan, slots, times, lengths, held, ends)
    for length in range(small, 0, -1):
        _best_fit(plan, length, int(counts[length]))
    return plan


def _configurations(sizes: list[int], left: list[int], capacity: int) -> Iterator[tuple[list[tuple[int, int]], int]]:
    """Fullest sequences first: the largest size left, and what fills the rest best."""
    left = list(left)
    for head in range(len(sizes)):
        while left[head]:
            left[head] -= 1
            filled = _fill(sizes, left, capacity - sizes[head], head)
            left[head] += 1
            config = dict(filled)
            config[head] = config.get(head, 0) + 1
            times = min(left[g] // n for g, n in config.items())
            for g, n in config.items():
                left[g] -= n * times
            yield sorted(config.items()), times


def _fill(sizes: list[int], left: list[int], room: int, start: int) -> list[tuple[int, int]]:
    """A multiset of the sizes from ``start`` on that fills ``room`` as far as possible."""
    came = np.full(room + 1, -1, np.int64)
    came[0] = len(sizes)
    for g in range(start, len(sizes)):
        size, copies = sizes[g], left[g]
        if size > room or not copies:
            continue
        reached = np.flatnonzero(came >= 0)
        for _ in range(min(copies, room // size)):
            nxt = reached[reached + size <= room] + size
            nxt = nxt[came[nxt] < 0]
            if not len(nxt):
                break
            came[nxt] = g
            reached = nxt
        if came[room] >= 0:
            break
    at = int(np.flatnonzero(came >= 0)[-1])
    found: dict[int, int] = {}
    while at:
        g = int(came[at])
        found[g] = found.get(g, 0) + 1
        at -= sizes[g]
    return list(found.items())


def _substitute(plan: Plan, slots: list[int], times: int, lengths, held, ends) -> None:
    """Puts actual pieces into ``times`` sequences; slot ``s`` takes those from ``slots[s]`` on."""
    cuts = {0, times}
    for first in slots:
        inner = ends[np.searchsorted(ends, first, "right") : np.searchsorted(ends, first + times, "left")]
        cuts.update(int(e) - first for e in inner)
    cuts = sorted(cuts)
    base = plan.open(times)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        offset = 0
        for first in slots:
            k = int(np.searchsorted(ends, first + a, "right"))
            rank = first + a - int(ends[k] - held[k])
            plan.runs.append((int(lengths[k]), rank, b - a, base + a, offset))
            offset += int(lengths[k])
        plan.leave(plan.capacity - offset, base + a, b - a)


def _best_fit(plan: Plan, length: int, count: int) -> None:
    """``count`` small pieces of one length into the least slack; new sequences if there is none."""
    rank = 0
    while rank < count:
        fits = [s for s in plan.slack if s >= length]
        if fits:
            slack = min(fits)
            first, bins = plan.slack[slack].pop()
            if not plan.slack[slack]:
                del plan.slack[slack]
        else:
            slack = plan.capacity
            bins = -(-(count - rank) // (slack // length))
            first = plan.open(bins)
        each = slack // length
        whole = min(bins, (count - rank) // each)
        offset = plan.capacity - slack
        if whole:
            for k in range(each):
                plan.runs.append((length, rank + k * whole, whole, first, offset + k * length))
            rank += each * whole
            plan.leave(slack - each * length, first, whole)
        some = 0
        if whole < bins and rank < count:
            some = min(each, count - rank)
            for k in range(some):
                plan.runs.append((length, rank + k, 1, first + whole, offset + k * length))
            rank += some
            plan.leave(slack - some * length, first + whole, 1)
        rest = bins - whole - bool(some)
        plan.leave(slack, first + bins - rest, rest)


def best_plan(counts: np.ndarray, capacity: int = CAPACITY) -> Plan:
    small = int(capacity * SMALL_SHARE)
    plans = (make_plan(counts, capacity, groups, small) for groups in GROUPINGS)
    return min(plans, key=lambda p: p.sequences)


def _place(runs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = runs.value
        keys = (table[:, 0] << 48) + table[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            own = table[np.searchsorted(keys, (length << 48) + rank, "right") - 1]
            columns = [batch.column(c) for c in ("doc", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(own[:, 3] + rank - own[:, 1]), pa.array(own[:, 4])],
                ["doc", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 0,
    capacity: int = CAPACITY,
) -> DataFrame:
    """A row per piece: id, piece, start, length, ids_crc32, sequence_id and offset.

    A document is its token ids and ``end_id``; one longer than ``capacity`` is cut into pieces
    of that length, the last of which may be shorter. Null and empty texts are ``end_id`` alone.
    Every row is packed, repeated rows and null ids too. An empty table gives no rows. The
    tokenizer must treat white space as a border of words; its file must be on all executors.
    """
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").alias("text"))
    pieces = stage(
        source.mapInArrow(
            _pieces(tokenizer_path, end_id, capacity),
            "doc long, piece int, start long, length long, ids_crc32 long, part int, rank long",
        ),
        "pieces",
    )
    by_part = stage(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    counts = np.zeros(capacity + 1, np.int64)
    for row in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        counts[row.length] = row.n
    runs = np.array(sorted(best_plan(counts, capacity).runs), np.int64).reshape(-1, 5)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("base"))
    placed = ranked.drop("part", "base").mapInArrow(
        _place(docs.sparkSession.sparkContext.broadcast(runs)),
        "doc long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
    return placed.withColumnRenamed("doc", id_col)
