"""Near-duplicate documents by MinHash bands, odd sketches and an exact check.

Each document's shingle set gives ``bands * rows`` MinHash samples; a band of equal samples
makes two documents candidates. A second set of samples, the least shingle of each of
``BINS`` parts of the hash range, is folded into an odd sketch: a bitmap in which every sample
turns one bit over. The XOR of two sketches has about as many bits set as samples differ, and
tells high similarities apart precisely. Candidates whose sketches rule the threshold out go;
the others are compared on their full sets.

No bucket is turned into all of its pairs. Documents with equal sets form one class first. In
each bucket the members meet its smallest class. Only buckets that still hold several
components are compared in blocks: the members outside of the largest component against all
members, sketch by sketch in a task's arrays, and only what the sketches let pass comes out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyman.llm.graph import components
from tallyman.llm.words import column_words, mix, seeds, shingle_sets
from tallyman.session import stage

BANDS = 20
ROWS = 4
#: Bits of an odd sketch, and parts of the hash range whose least shingles it holds.
SKETCH_BITS = 2048
BINS = 4096
#: Standard deviations that a candidate may lie beyond the threshold.
SLACK = 5
#: Rows of a bucket that are compared as one block.
BLOCK = 512


def band_keys(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """A key for each band of MinHash samples of non-empty sets."""
    n, k = len(sets), bands * rows
    values = np.concatenate(sets)
    begins = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    keys = np.empty((n, bands), np.uint64)
    factor, shift = seeds(k, 11) | np.uint64(1), seeds(k, 12)
    for band in range(bands):
        key = np.full(n, seeds(bands, 13)[band], np.uint64)
        for i in range(band * rows, band * rows + rows):
            hashed = (values ^ shift[i]) * factor[i]
            hashed ^= hashed >> np.uint64(32)
            hashed *= factor[k - 1 - i]
            key = mix(key ^ np.minimum.reduceat(hashed, begins)) + np.uint64(1)
        keys[:, band] = key
    return keys


def odd_sketch(shingles: np.ndarray) -> np.ndarray:
    """The odd sketch of a set of sorted hashes, as 64-bit words."""
    part = shingles // np.uint64((1 << 64) // BINS)
    samples = shingles[np.concatenate(([True], part[1:] != part[:-1]))]
    bits = np.bincount((mix(samples) % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def most_odd_bits(total, percent: int, m=np):
    """Bits that may be set in the XOR of two sketches whose sets have ``total`` shingles together.

    ``m`` gives exp, sqrt and pow: numpy's, or those of Spark's columns. At the threshold the
    union has total / (1 + J) shingles. The expected number of samples that differ follows from
    how full the parts are; no more bits than samples can turn over.
    """
    j = percent / 100
    load = total / ((1 + j) * BINS)
    apart = BINS * (1 - m.exp(-load)) * (1 - j) * (2 - m.exp(-load * ((1 + j) / 2)))
    apart = apart + SLACK * m.sqrt(2 * apart * (1 - m.exp(-2 * load)) + 1)
    half = SKETCH_BITS / 2
    odd = half * (1 - m.exp(-apart / half))
    return apart, odd + SLACK * (SKETCH_BITS / 4) ** 0.5


def _describe(shingle: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, words in column_words(batch.column("text"), lower=True):
                sets = shingle_sets(words, shingle)
                sizes = np.array([len(s) for s in sets], np.int64)
                prints = np.zeros((2, len(sets)), np.uint64)
                for i, s in enumerate(sets):
                    prints[:, i] = mix(s).sum(dtype=np.uint64), mix(s + np.uint64(77)).sum(dtype=np.uint64)
                keys, sketches = [None] * len(sets), [None] * len(sets)
                full = np.flatnonzero(sizes)
                if len(full):
                    own = band_keys([sets[i] for i in full], bands, rows).view(np.int64)
                    for j, i in enumerate(full):
                        keys[i], sketches[i] = own[j], odd_sketch(sets[i])
                part = batch.slice(at, to - at)
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc"), part.column("text_key"), pa.array(sizes)]
                    + [pa.array(p.view(np.int64)) for p in prints]
                    + [pa.array(keys, longs), pa.array(sketches, longs)],
                    ["doc", "text_key", "n", "fp1", "fp2", "bands", "sketch"],
                )

    return run


def _confirm(shingle: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a"), batch.column("b")
            left = _sets(batch.column("text_a"), shingle)
            right = _sets(batch.column("text_b"), shingle)
            linked = [
                100 * (both := len(np.intersect1d(x, y, assume_unique=True)))
                >= percent * (len(x) + len(y) - both)
                for x, y in zip(left, right, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [a.filter(pa.array(linked)), b.filter(pa.array(linked))], ["a", "b"]
            )

    return run


def _sets(column: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    for _, _, words in column_words(column, lower=True):
        yield from shingle_sets(words, shingle)


def _block_pairs(percent: int):
    def arrays(rows):
        items = rows.values
        get = lambda c: items.field(c).to_numpy()
        wide = lambda c: items.field(c).flatten().to_numpy().reshape(len(items), -1)
        asks = items.field("asks").to_numpy(zero_copy_only=False)
        return get("node"), get("comp"), get("n"), wide("sketch").view(np.uint64), wide("bands"), asks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i in range(batch.num_rows):
                x, y = arrays(batch.column("ask")[i]), arrays(batch.column("other")[i])
                bucket = batch.column("bucket")[i].as_py()
                for k in range(0, len(x[0]), 32):
                    node, comp, n, sketch, bands, _ = (c[k : k + 32] for c in x)
                    small, large = np.minimum.outer(n, y[2]), np.maximum.outer(n, y[2])
                    ok = (comp[:, None] != y[1][None, :]) & (100 * small >= percent * large)
                    # Of two that ask each other, the smaller one does.
                    ok &= ~y[5][None, :] | (node[:, None] < y[0][None, :])
                    p, q = np.nonzero(ok)
                    odd = np.bitwise_count(sketch[p] ^ y[3][q]).sum(1)
                    samples, bits = most_odd_bits((n[p] + y[2][q]).astype(float), percent)
                    near = odd <= np.minimum(samples, bits)
                    p, q = p[near], q[near]
                    # Pairs that share several buckets come out of the first of them.
                    first = (bands[p] == y[4][q]).argmax(1)
                    own = bands[p, first] == bucket
                    p, q = p[own], q[own]
                    a.append(np.minimum(node[p], y[0][q]))
                    b.append(np.maximum(node[p], y[0][q]))
            both = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

    return run


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """A row per document: id, n_shingles, component_id, kept, text_key and component.

    Documents are linked if ``100 * |A & B| >= percent * |A | B|`` for their sets of ``shingle``
    words in a row, A-Z in lower case. A text of fewer words is one shingle; without words (or
    null) its set is empty, and it is linked with nothing. ``component_id`` is the smallest id
    that links lead to. Bands miss a pair at the threshold with a chance of
    ``(1 - (percent / 100) ** rows) ** bands``: 4e-7 at 85 %, 3e-5 at 80 %.

    Rows with the same id take part one by one, each by its own text. ``component`` names a group
    of linked texts (null for an empty set): ids alone can't where they occur twice. A null id is linked by its text as any other;
    ids that are null are never the smallest of a component, so ``component_id`` is null only
    where all are, and one such row per text is kept. An empty table gives an empty result;
    other columns are not looked at. Memory of a task follows the longest text.
    """
    text = F.col(f"`{text_col}`")
    keyed = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc"), F.xxhash64(text).alias("text_key"), text.alias("text")
    )
    described = stage(
        keyed.mapInArrow(
            _describe(shingle, bands, rows),
            "doc long, text_key long, n long, fp1 long, fp2 long, bands array<long>, sketch array<long>",
        ),
        "signatures",
    )
    members = described.select("doc", "text_key", "n", "fp1", "fp2")
    first = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "text_key"))
    heads = members.filter("n > 0").groupBy("fp1", "fp2").agg(first.alias("head"))
    heads = heads.select(
        "fp1", "fp2", F.col("head.doc").alias("doc"), F.col("head.text_key").alias("text_key")
    )
    classes = stage(
        described.join(
            heads.withColumnsRenamed({"doc": "head_doc", "text_key": "head_key"}), ["fp1", "fp2"]
        )
        .filter(F.col("doc").eqNullSafe(F.col("head_doc")) & (F.col("text_key") == F.col("head_key")))
        .dropDuplicates(["fp1", "fp2"])
        # A number of its own for each class: an id may stand for several. Written once, it stays.
        .withColumn("node", F.monotonically_increasing_id())
        .select("node", "doc", "text_key", "fp1", "fp2", "n", "bands", "sketch"),
        "classes",
    )
    links = _links(classes, keyed, shingle, percent)
    tree = components(links)
    named = classes.select("node", "doc", "fp1", "fp2").join(tree, "node", "left")
    named = named.select("doc", "fp1", "fp2", F.coalesce("component", "node").alias("component"))
    lowest = named.groupBy("component").agg(F.min("doc").alias("component_id"))
    named = stage(named.join(lowest, "component").select("fp1", "fp2", "component_id", "component"), "named-classes")
    empty = members.filter("n = 0").select("*", F.col("doc").alias("component_id"), F.lit(None).cast("long").alias("component"))
    linked = members.filter("n > 0").join(named, ["fp1", "fp2"])
    both = linked.select(*empty.columns).unionByName(empty)
    return both.select(
        F.col("doc").alias(id_col),
        F.col("n").alias("n_shingles"),
        "component_id",
        F.col("doc").eqNullSafe(F.col("component_id")).alias("kept"),
        "text_key",
        "component",
    )


def _links(classes: DataFrame, keyed: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Confirmed pairs of classes that connect all classes which share a bucket and are similar."""
    bucketed = classes.select("node", "doc", F.explode("bands").alias("bucket"))
    # The hub is the class of the smallest id: what others were copied from shares most buckets with
    # each of them, so they meet the same hub in many, and few pairs differ.
    first = F.min(F.struct("doc", "node")).alias("first")
    hubs = bucketed.groupBy("bucket").agg(first, F.count("*").alias("m")).select("bucket", F.col("first.node").alias("a"), "m")
    bucketed = bucketed.select("node", "bucket")
    left = stage(bucketed.join(hubs.filter("m > 1").select("bucket", "a"), "bucket"), "buckets")
    texts = _texts(left.select("node").distinct(), classes, keyed)
    pairs = left.filter("node != a").select("a", F.col("node").alias("b")).distinct()
    found = stage(_confirmed(_sketched(pairs, classes, percent), texts, shingle, percent), "links")
    # Many bands give a class many hubs; only buckets that still fall apart go on.
    members = stage(_with_components(left.select("node", "bucket"), found), "bucket-components")
    split = members.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    open_ = members.join(split.filter("low < high").select("bucket"), "bucket", "left_semi")
    apart = _blocks(stage(open_, "open"), classes, percent)
    return stage(found.unionByName(_confirmed(apart, texts, shingle, percent)), "all-links")


def _texts(nodes: DataFrame, classes: DataFrame, keyed: DataFrame) -> DataFrame:
    """A text of each class: the documents' texts are shuffled once, here."""
    heads = classes.join(nodes, "node").select("node", F.col("doc").alias("head"), F.col("text_key").alias("key"))
    met = keyed.join(heads, (F.col("text_key") == F.col("key")) & F.col("doc").eqNullSafe(F.col("head")))
    return stage(met.dropDuplicates(["node", "text_key", "doc"]).select("node", "text"), "texts")


def _with_components(members: DataFrame, links: DataFrame) -> DataFrame:
    tree = components(links)
    return members.join(tree, "node", "left").select(
        "node", "bucket", F.coalesce("component", "node").alias("comp")
    )


def _odd_bits(a: str, b: str) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(pairs, F.lit(0), lambda x, y: x + y)


def _sketched(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose set sizes and odd sketches leave the threshold possible."""
    side = lambda c: classes.select(
        F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}")
    )
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    near = F.lit(100) * F.least("n_a", "n_b") >= F.lit(percent) * F.greatest("n_a", "n_b")
    bound = F.least(*most_odd_bits(F.col("n_a") + F.col("n_b"), percent, F))
    return met.filter(near & (_odd_bits("sketch_a", "sketch_b") <= bound)).select("a", "b")


def _confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs that reach the threshold on their full sets."""
    side = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"))
    return (
        pairs.join(side("a"), "a")
        .join(side("b"), "b")
        .select("a", "b", "text_a", "text_b")
        .mapInArrow(_confirm(shingle, percent), "a long, b long")
    )


def _blocks(members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs across the components of each bucket, found block by block.

    Blocks are cut by hash and hold about ``BLOCK`` rows. Those of the largest component ask
    nothing; every other member asks all blocks of its bucket.
    """
    sizes = members.groupBy("bucket", "comp").agg(F.count("*").alias("k"))
    tops = sizes.groupBy("bucket").agg(
        F.max_by("comp", F.struct("k", "comp")).alias("main"), F.sum("k").alias("m"), F.max("k").alias("most")
    )
    tops = tops.select(
        "bucket",
        "main",
        F.ceil(F.col("m") / BLOCK).cast("int").alias("all_blocks"),
        F.ceil((F.col("m") - F.col("most")) / BLOCK).cast("int").alias("ask_blocks"),
    )
    rows = members.join(tops, "bucket").join(classes.select("node", "n", "sketch", "bands"), "node")
    rows = rows.withColumn("asks", F.col("comp") != F.col("main"))
    item = F.struct("node", "comp", "n", "sketch", "bands", "asks").alias("item")
    mine = lambda blocks: F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int")
    each = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    ask = rows.filter("asks").select(
        "bucket", mine("ask_blocks").alias("i"), each("all_blocks").alias("j"), item
    )
    other = rows.select("bucket", each("ask_blocks").alias("i"), mine("all_blocks").alias("j"), item)
    units = (
        ask.withColumn("side", F.lit("ask"))
        .unionByName(other.withColumn("side", F.lit("other")))
        .groupBy("bucket", "i", "j")
        .agg(
            F.collect_list(F.when(F.col("side") == "ask", F.col("item"))).alias("ask"),
            F.collect_list(F.when(F.col("side") == "other", F.col("item"))).alias("other"),
        )
        .filter("size(ask) > 0 AND size(other) > 0")
    )
    found = units.select("bucket", "ask", "other").mapInArrow(_block_pairs(percent), "a long, b long")
    return found.distinct()


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80
) -> DataFrame:
    """``docs`` with one document of each group of near duplicates: that with the smallest id.

    Of rows equal in id and text one stays, and of unlike texts of that smallest id the first by
    hash. Empty and null texts are no duplicates of anything, but of such rows with one id one
    stays. An unlike text stays whatever other text has its id. All columns are kept, of
    any name; an empty table stays empty.
    """
    result = near_duplicates(docs, id_col, text_col, shingle, percent).filter("kept")
    kept = result.select(F.col(f"`{id_col}`").alias("kept_id"), F.col("text_key").alias("kept_key"), "component")
    linked = kept.filter("component IS NOT NULL").groupBy("component").agg(F.min(F.struct("kept_id", "kept_key")).alias("k")).select("k.*")
    alone = kept.filter("component IS NULL").select("kept_id", "kept_key").distinct()
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.xxhash64(F.col(f"`{text_col}`")).alias("key"),
    )
    met = rows.join(linked.unionByName(alone), F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("key") == F.col("kept_key")))
    return met.dropDuplicates(["id", "key"]).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
