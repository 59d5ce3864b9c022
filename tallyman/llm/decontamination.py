"""Benchmark decontamination by n-grams of words, in DataFrame operations only.

The benchmark's windows of normalised words form a set of strings. It reaches the scan of the
documents twice. First as a bit mask, a literal of bounded size: each place of a text is looked
up by the hash of its first words and, if that bit is set, by the hash of its whole window. The
few places that pass carry their window out of the scan, so that no text is shuffled. Then as
a table, broadcast while its size is proven small, that the windows are joined with by their
strings: a hash decides nothing.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyman.session import stage

#: Words of a window.
SIZE = 10
#: Bits of the mask: so many for each window, and at most.
BITS_PER_WINDOW = 32
MOST_BITS = 1 << 20
#: The table of windows is broadcast up to this size.
BROADCAST_WINDOWS = 500_000
BROADCAST_BYTES = 64 << 20

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """A-Z to a-z, all other characters as they are."""
    return F.translate(text, _UPPER, _UPPER.lower())


def words_of(text: Column) -> Column:
    """The normalised words of a text: letters, digits and all beyond ASCII; none for a null."""
    return F.array_remove(F.split(F.coalesce(lowered(text), F.lit("")), _BETWEEN), "")


def _first_words(hashes: str, i: Column, length: int) -> Column:
    """A hash of the first three words at most of the window of ``length`` words at ``i``."""
    out = F.get(hashes, i).bitwiseXOR(F.lit(length * 0x9E3779B97F4A7C1))
    for k in range(1, min(3, length)):
        out = out.bitwiseXOR(F.shiftleft(F.get(hashes, i + k), k))
    return out


def _one_bit(key: Column) -> Column:
    """The bit that the last six bits of ``key`` name."""
    ones = F.from_json(F.lit(json.dumps([1 << i if i < 63 else -(1 << 63) for i in range(64)])), "array<bigint>")
    return F.element_at(ones, (key.bitwiseAND(F.lit(63)) + 1).cast("int"))


class _Mask:
    """A set of hashes as bits of a literal array of longs."""

    def __init__(self, slots: dict[int, int], bits: int):
        self.bits = bits
        self.literal = F.from_json(F.lit(json.dumps([slots.get(i, 0) for i in range(bits // 64)])), "array<bigint>")

    def holds(self, key: Column) -> Column:
        slot = F.shiftrightunsigned(key, 6).bitwiseAND(F.lit(self.bits // 64 - 1)).cast("int")
        return F.get(self.literal, slot).bitwiseAND(_one_bit(key)) != 0


def _masks(windows: DataFrame, count: int) -> tuple[_Mask, _Mask]:
    """Masks of the windows' first words and of whole windows; at most MOST_BITS / 64 rows are collected each."""
    bits = min(MOST_BITS, 1 << max(10, (count * BITS_PER_WINDOW - 1).bit_length()))
    made = []
    for key in ("head", "whole"):
        slot = F.shiftrightunsigned(key, 6).bitwiseAND(F.lit(bits // 64 - 1))
        rows = windows.groupBy(slot.alias("slot")).agg(F.bit_or(_one_bit(F.col(key))).alias("bits")).collect()
        made.append(_Mask({r.slot: r.bits for r in rows}, bits))
    return made[0], made[1]


def benchmark_windows(benchmark: DataFrame, item_col: str, text_col: str, size: int) -> DataFrame:
    """``(item, n, window)``: every ``size`` words in a row of an item; of a shorter one all its words."""
    items = benchmark.select(
        F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("item"), words_of(F.col(f"`{text_col}`")).alias("words")
    ).filter(F.size("words") > 0)
    n = F.least(F.lit(size), F.size("words"))
    places = items.select("item", "words", n.alias("n")).select(
        "item",
        "n",
        F.explode_outer(F.transform(F.sequence(F.lit(1), F.size("words") - F.col("n") + 1), lambda p: F.slice("words", p, F.col("n")))).alias("w"),
    )
    return places.select("item", "n", F.array_join("w", " ").alias("window"))


def _scan(docs: DataFrame, masks: tuple[_Mask, _Mask], lengths: list[int]) -> DataFrame:
    """``docs`` with n_words and candidates: places and windows that both masks let pass."""
    worded = docs.select("*", words_of(F.col("text")).alias("words"))
    hashed = worded.select("*", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))

    def places(n: int) -> Column:
        at = F.sequence(F.lit(0), F.size("hashes") - n)
        passed = F.filter(at, lambda i: masks[0].holds(_first_words("hashes", i, n)))
        return F.when(F.size("hashes") >= n, passed).otherwise(F.array().cast("array<int>"))

    def windows_of(n: int) -> Column:
        window = lambda i: F.array_join(F.slice("words", i + 1, n), " ")
        taken = lambda i: F.struct(i.alias("at"), F.lit(n).alias("n"), window(i).alias("window"))
        return F.filter(F.transform(f"places_{n}", taken), lambda c: masks[1].holds(F.xxhash64(c["window"])))

    placed = hashed.select("*", *(places(n).alias(f"places_{n}") for n in lengths))
    windows = [windows_of(n) for n in lengths]
    found = F.concat(*windows) if windows else F.array().cast("array<struct<at:int,n:int,window:string>>")
    return placed.select(
        "id", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("second"), "text").alias("k2"),
        F.size("words").cast("long").alias("n_words"), found.alias("found"),
    )


def _small(windows: DataFrame, count: int, size: int) -> DataFrame:
    return F.broadcast(windows) if count <= BROADCAST_WINDOWS and size <= BROADCAST_BYTES else windows


def _merged(hits: Column) -> Column:
    """Sorted places as runs that neither overlap nor touch: an array of (start, stop)."""
    run = "array<struct<start:int,stop:int>>"
    start = F.struct(F.array().cast(run).alias("done"), F.lit(-1).alias("start"), F.lit(-1).alias("stop"))
    closed = lambda a: F.when(
        a["start"] >= 0, F.concat(a["done"], F.array(F.struct(a["start"].alias("start"), a["stop"].alias("stop"))))
    ).otherwise(a["done"])

    def step(a: Column, h: Column) -> Column:
        end = h["at"] + h["n"]
        apart = h["at"] > a["stop"]
        return F.struct(
            F.when(apart, closed(a)).otherwise(a["done"]).alias("done"),
            F.when(apart, h["at"]).otherwise(a["start"]).alias("start"),
            F.when(apart, end).otherwise(F.greatest(a["stop"], end)).alias("stop"),
        )

    return F.aggregate(hits, start, step, closed)


def _hits(
    docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, size: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scanned documents, hit texts (k1, k2, runs, windows, s1, s2) and pairs (wid, item)."""
    named = stage(benchmark_windows(benchmark, item_col, item_text_col, size), "benchmark-windows")
    # Written once, so that the numbers stay.
    windows = stage(
        named.groupBy("window").agg(F.first("n").alias("n")).withColumn("wid", F.monotonically_increasing_id()), "windows"
    )
    whole = windows.select("*", F.xxhash64("window").alias("whole"), F.transform(F.split("window", " "), lambda w: F.xxhash64(w)).alias("hashes"))
    facts = windows.agg(
        F.count("*").alias("n"), F.sum(F.octet_length("window") + 32).alias("bytes"), F.collect_set("n").alias("lengths")
    ).first()
    lengths = sorted(facts.lengths)
    head = F.lit(None).cast("long")
    for n in lengths:
        head = F.when(F.col("n") == n, _first_words("hashes", F.lit(0), n)).otherwise(head)
    masks = _masks(whole.withColumn("head", head), facts.n)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    scanned = stage(_scan(rows, masks, lengths), "scanned")
    # Equal texts are looked up once.
    texts = scanned.filter(F.size("found") > 0).groupBy("k1", "k2").agg(F.first("found").alias("found"))
    places = texts.select("k1", "k2", F.explode("found").alias("f")).select("k1", "k2", "f.*")
    met = places.join(_small(windows.select("window", "wid"), facts.n, facts.bytes or 0), "window")
    spans = F.sort_array(F.collect_list(F.struct("at", "n")))
    hit = met.groupBy("k1", "k2").agg(_merged(spans).alias("runs"), F.sort_array(F.collect_set("wid")).alias("wids"))
    hit = hit.select("*", F.xxhash64("wids").alias("s1"), F.xxhash64(F.lit("second"), "wids").alias("s2"))
    ids = named.join(_small(windows.select("window", "wid"), facts.n, facts.bytes or 0), "window").select("wid", "item").distinct()
    return scanned, stage(hit, "hits"), ids


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    size: int = SIZE,
) -> DataFrame:
    """A row per document: id, n_words, n_hit, n_items, items_sha256, contaminated.

    A document's word is hit if it lies in any occurrence of a benchmark window of ``size``
    words; an item of fewer words is one window. Words are compared with A-Z lower-cased.
    ``n_items`` counts items, told apart by id, of which a window occurs; ``items_sha256`` is
    the digest of their ids, sorted as strings and joined by commas. A null or empty text and
    one without words has none and isn't hit; such an item has no window. A null item id counts
    as one item and is written as an empty string. Repeated rows and ids get a row each, by
    their own text. Ids may be null. Without benchmark items nothing is hit; without documents
    there are no rows. Other columns are not looked at.
    """
    scanned, hit, ids = _hits(docs, benchmark, id_col, text_col, item_col, item_text_col, size)
    # Texts that hold the same windows name the same items: those are put together once.
    alike = hit.groupBy("s1", "s2").agg(F.first("wids").alias("wids")).select("s1", "s2", F.explode("wids").alias("wid"))
    items = alike.join(ids, "wid").select("s1", "s2", "item").distinct()
    named = items.groupBy("s1", "s2").agg(
        F.count("*").alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list("item")), ","), 256).alias("items_sha256")
    )
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["stop"] - r["start"])
    told = hit.select("k1", "k2", n_hit.alias("n_hit"), "s1", "s2").join(named, ["s1", "s2"]).drop("s1", "s2")
    out = scanned.select("id", "k1", "k2", "n_words").join(told, ["k1", "k2"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return out.select(
        F.col("id").alias(id_col),
        "n_words",
        zero("n_hit").alias("n_hit"),
        zero("n_items").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (zero("n_hit") > 0).alias("contaminated"),
    )


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    remove: str = "spans",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    size: int = SIZE,
) -> DataFrame:
    """``docs`` without benchmark windows; all columns as they were.

    ``remove="documents"`` drops documents of which any word is hit. ``remove="spans"`` takes
    hit words out of their texts, each with the signs that follow it; all else of the text stays
    as it is. Nulls, empty texts and repeated rows: as in :func:`contamination`.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove: documents or spans, not {remove}")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(
        row, F.xxhash64(f"`{text_col}`").alias("k1"), F.xxhash64(F.lit("second"), f"`{text_col}`").alias("k2")
    )
    _, hit, _ = _hits(docs, benchmark, text_col, text_col, item_col, item_text_col, size)
    if remove == "documents":
        return rows.join(hit.select("k1", "k2"), ["k1", "k2"], "left_anti").select("row.*")
    text = F.col("row").getField(text_col)
    met = rows.join(hit.select("k1", "k2", "runs"), ["k1", "k2"], "left").select(
        "row", "runs",
        F.when(F.col("runs").isNotNull(), F.array_remove(F.split(text, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), "")).alias("words"),
        F.when(F.col("runs").isNotNull(), F.split(text, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", -1)).alias("between"),
    )
    gone = lambda i: F.exists("runs", lambda r: (i >= r["start"]) & (i < r["stop"]))
    rest = F.transform("words", lambda w, i: F.when(gone(i), F.lit("")).otherwise(F.concat(w, F.get("between", i + 1))))
    cut = F.when(F.col("runs").isNull(), text).otherwise(F.concat(F.get("between", F.lit(0)), F.array_join(rest, "")))
    made = met.select("row", cut.alias("cut"))
    return made.select(
        *(F.col("cut").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns)
    )
