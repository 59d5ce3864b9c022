"""Minimax contiguous shards over ordered groups, in DataFrame operations only.

Equal texts form a group that no shard border may cut. Groups are ordered by a hash of the
text, and the shards are consecutive runs of that order whose largest is as small as possible.
The smallest feasible capacity is found by binary search with a greedy check, and the cuts that
keep to it are laid as evenly as it allows. The check needs
sums over the order, not the groups themselves: the order is held as a tree of hash prefixes.
First only prefixes larger than the largest group and than an even shard are opened, until a hot
group stands alone; then only those in which a border of the smallest capacity may still fall,
at most ``OPENED`` a round. So the driver holds a bounded number of sums a round, whatever the
number of documents, and one group of a third of all bytes opens a prefix a level.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyman.session import stage

#: Bits of the hash at the root of the tree, and by which a prefix is opened further.
ROOT_BITS = 10
FAN_BITS = 5
KEY_BITS = 60
#: Prefixes opened in one round at most.
OPENED = 1024
#: Rows of a shard that one window task numbers, about.
SLOT_ROWS = 50_000
ID_PARTS = 64


def order_key(text: Column, doc: Column) -> Column:
    """60 bits that place a group in the order; a null text is a group of its own row's id."""
    named = F.when(text.isNull(), F.xxhash64(F.lit("null"), doc)).otherwise(F.xxhash64(text))
    return F.shiftrightunsigned(named, 64 - KEY_BITS)


class _Order:
    """The order as nodes, sorted by key.

    A node is ``(first key, bits still open, size, is one group, size of its largest group)``.
    """

    def __init__(self, groups: DataFrame):
        self.groups = groups
        self.nodes = self._read(KEY_BITS - ROOT_BITS)

    def _read(self, open_bits: int, heads: list[int] | None = None, bits: int = 0) -> np.ndarray:
        """All nodes with these open bits, or those within the nodes of ``bits`` named by ``heads``."""
        groups = self.groups
        if heads is not None:
            groups = groups.filter(F.shiftright("key", bits).isin(heads))
        found = groups.groupBy(F.shiftright("key", open_bits).alias("head")).agg(
            F.sum("size").alias("size"),
            F.min("key").alias("low"),
            F.max("key").alias("high"),
            F.max("size").alias("most"),
        )
        rows = [(r.low, open_bits, r.size, r.low == r.high, r.most) for r in found.collect()]
        return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)

    def refine(self, at: np.ndarray) -> None:
        """Opens the nodes at these places that have the most open bits; none is a single group."""
        bits = int(self.nodes[at, 1].max())
        at = at[self.nodes[at, 1] == bits]
        heads = [int(k) >> bits for k in self.nodes[at, 0]]
        rest = np.delete(self.nodes, at, axis=0)
        self.nodes = np.concatenate([rest, self._read(max(bits - FAN_BITS, 0), heads, bits)])
        self.nodes = self.nodes[np.argsort(self.nodes[:, 0], kind="stable")]


def _borders(sizes: np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """Greedy check: where shards of at most ``capacity`` end, or None if they don't suffice."""
    ends = np.cumsum(sizes)
    at, out = 0, []
    for _ in range(shards):
        before = int(ends[at - 1]) if at else 0
        nxt = int(np.searchsorted(ends, before + capacity, "right"))
        if nxt == at:
            return None
        out.append(nxt)
        at = nxt
        if at == len(sizes):
            return out
    return None


def _smallest(sizes: np.ndarray, shards: int) -> int:
    low, high = max(int(sizes.max()), -(-int(sizes.sum()) // shards)), int(sizes.sum())
    while low < high:
        middle = (low + high) // 2
        if _borders(sizes, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return low


def _reach(ends: np.ndarray, whole: np.ndarray, capacity: int, shards: int) -> np.ndarray:
    """Where the greedy shards of ``capacity`` end, in bytes; nodes that are not whole can be cut anywhere."""
    at, out = 0, []
    for _ in range(shards):
        at += capacity
        node = int(np.searchsorted(ends, at, "right"))
        if node == len(ends):
            at = int(ends[-1])
        elif whole[node]:
            at = int(ends[node - 1]) if node else 0
        out.append(at)
    return np.array(out)


def _least(ends: np.ndarray, single: np.ndarray, low: int, high: int, shards: int) -> int:
    """Smallest capacity in a range that would do if open nodes could be cut anywhere."""
    while low < high:
        middle = (low + high) // 2
        if _reach(ends, single, middle, shards)[-1] < ends[-1]:
            low = middle + 1
        else:
            high = middle
    return low


def _unsure(ends: np.ndarray, single: np.ndarray, low: int, high: int, shards: int) -> tuple[np.ndarray, bool]:
    """Open nodes in which greedy borders of capacities ``low`` to ``high`` may fall, and if these are all.

    Borders are taken from the left, as each depends on those before it, until ``OPENED`` nodes.
    """
    first = np.searchsorted(ends, _reach(ends, np.ones(len(ends), bool), low, shards), "right")
    last = np.searchsorted(ends, _reach(ends, single, high, shards), "right")
    found: dict[int, None] = {}
    for a, b in zip(first, last, strict=True):
        own = a + np.flatnonzero(~single[a : b + 1])
        fresh = [int(i) for i in own if int(i) not in found]
        if len(found) + len(fresh) > OPENED:
            return np.array(sorted(found or fresh[:OPENED]), np.int64), False
        found.update(dict.fromkeys(fresh))
    return np.array(sorted(found), np.int64), True


def minimax_borders(groups: DataFrame, shards: int) -> tuple[list[int], int]:
    """First keys of the shards after the first, and the capacity, for ``groups(key, size)``.

    ``groups`` has one row per key. Fewer borders than ``shards - 1`` leave shards empty.
    """
    return _search(_Order(groups), shards)


def _search(order: _Order, shards: int) -> tuple[list[int], int]:
    if not len(order.nodes):
        return [], 0
    # No capacity is below the largest group or an even shard: larger nodes are opened first.
    floor = max(int(order.nodes[:, 4].max()), -(-int(order.nodes[:, 2].sum()) // shards))
    while True:
        large = (order.nodes[:, 2] > floor) & (order.nodes[:, 3] == 0)
        if not large.any():
            break
        order.refine(np.flatnonzero(large))
    while True:
        sizes, single = order.nodes[:, 2], order.nodes[:, 3].astype(bool)
        ends = np.cumsum(sizes)
        # With nodes kept whole, this capacity is feasible; as if open nodes could be cut
        # anywhere, none below the other is. They differ by the largest open node at most.
        high = _smallest(sizes, shards)
        low = _least(ends, single, floor, high, shards)
        if low == high:
            break
        at, whole = _unsure(ends, single, low, high, shards)
        if not whole:
            # A large group that may or may not fit before a border leaves all later ones open:
            # one capacity is decided at a time.
            middle = (low + high) // 2
            at, _ = _unsure(ends, single, middle, middle, shards)
        order.refine(at)
    # Among the partitions of that capacity, an even one: open what lies where it would be cut.
    while True:
        sizes, single = order.nodes[:, 2], order.nodes[:, 3].astype(bool)
        borders = _even_borders(sizes, high, shards)
        near = {i for b in borders for i in (b - 1, b) if 0 <= i < len(sizes) and not single[i]}
        if not near:
            return [int(order.nodes[b, 0]) for b in borders], high
        order.refine(np.array(sorted(near)))


def _even_borders(sizes: np.ndarray, capacity: int, shards: int) -> list[int]:
    """Borders of shards of at most ``capacity``, each near the mean of what is left."""
    ends = np.cumsum(sizes)
    at, out = 0, []
    for k in range(shards, 1, -1):
        before = int(ends[at - 1]) if at else 0
        most = int(np.searchsorted(ends, before + capacity, "right"))
        aim = before + (int(ends[-1]) - before) / k
        best = int(np.searchsorted(ends, aim, "left"))
        if best < len(ends) and (best == at or ends[best] - aim <= aim - ends[best - 1]):
            best += 1
        best = min(max(best, at + 1), most)
        if best < most and best < len(sizes) and _borders(sizes[best:], capacity, k - 1) is None:
            best = most
        at = best
        if at >= len(sizes):
            break
        out.append(at)
    return out


def shard_documents(
    docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """A row per document: id, size, text_crc32, law, shard, slot and grown_shard.

    The law is ``bytes``: a document counts the UTF-8 bytes of its text (null: none) plus 8, and
    the largest shard is as small as the order allows. Equal texts share a shard; null texts
    form groups by id. ``slot`` numbers a shard's rows from 0 without gaps; equal rows take
    any of their slots. ``grown_shard`` is null under this
    law. ``text_crc32`` is null for a null text. An empty table gives no rows.
    """
    doc, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    rows = stage(
        docs.select(
            doc.alias("doc"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            order_key(text, doc).alias("key"),
        ),
        "sizes",
    )
    groups = stage(rows.groupBy("key").agg(F.sum("size").alias("size")), "groups")
    borders, _ = minimax_borders(groups, shards)
    shard = F.lit(0)
    for border in borders:
        shard = shard + (F.col("key") >= F.lit(border)).cast("int")
    # Slots: rows are numbered within blocks of a shard, and blocks by the sums before them. A
    # block is a range of keys and a part of the ids, so a group of equal texts is split too.
    bits = min((rows.count() // (SLOT_ROWS * ID_PARTS)).bit_length(), 30)
    placed = rows.withColumn("shard", shard).withColumn(
        "block", F.shiftright("key", KEY_BITS - bits) * ID_PARTS + F.pmod(F.xxhash64("doc", "key"), F.lit(ID_PARTS))
    )
    sums = placed.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("shard", "block").orderBy("key", "doc", "size", "text_crc32")
    numbered = placed.withColumn("row", F.row_number().over(inner)).join(bases, ["shard", "block"])
    return numbered.select(
        F.col("doc").alias(id_col),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("base") + F.col("row") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
