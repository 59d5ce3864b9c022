"""Search documents, postings and ranked search.

Analyzer: lower case, runs of letters and digits. Scoring: BM25 with k1 = 1.2 and b = 0.75,
scores rounded so that the ranking does not depend on the order of addition, ties broken by
document id. These are parameters of this library.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyman.functions import words
from tallyman.session import broadcast_if_small, stage

SCORE_DIGITS = 6
#: Tokens inverted at once; a longer document is inverted alone.
BATCH_TOKENS = 2_000_000


def to_search_docs(
    rows: DataFrame, doc_id: str, contents: Sequence[str], keep: Sequence[str] = ()
) -> DataFrame:
    """``(id, contents, raw)``: text columns joined by spaces, ``keep`` stored as JSON."""
    raw = F.to_json(F.struct(*keep)) if keep else F.lit(None).cast("string")
    return rows.select(
        F.col(doc_id).cast("string").alias("id"),
        F.concat_ws(" ", *contents).alias("contents"),
        raw.alias("raw"),
    )


@dataclass(frozen=True)
class Postings:
    """An index.

    ``postings (term, id, tf, positions, length)``, ``terms (term, df)`` and
    ``docs (id, length)``. A posting repeats its document's length, so that scoring joins
    nothing but the query terms. A stored index has its postings, terms and ``blocks`` in so
    many ``buckets`` by ``term_bucket``. A block is a term's postings of one class of
    lengths: ``blocks (term, block, df, most_tf, least_length)`` bounds what any of them scores.
    """

    postings: DataFrame
    terms: DataFrame
    docs: DataFrame
    buckets: int | None = None
    blocks: DataFrame | None = None

    def staged(self) -> Postings:
        """The same index with its postings and lengths written once, for several uses."""
        postings = stage(self.postings, "postings")
        return Postings(postings, _document_frequencies(postings), stage(self.docs, "lengths"))


def _document_frequencies(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _block() -> Column:
    """The class of lengths a posting falls into: those of one number of binary digits."""
    return F.length(F.bin("length")).alias("block")


def _blocks(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term", _block()).agg(
        F.count(F.lit(1)).alias("df"), F.max("tf").alias("most_tf"), F.min("length").alias("least_length")
    )


def _postings_of(tokens: pa.ListArray, ids: pa.Array, positions: bool) -> pa.RecordBatch:
    """Group each document's tokens by term with one stable sort over the whole batch."""
    offsets = tokens.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    lengths = np.diff(offsets)
    flat = tokens.flatten().dictionary_encode()
    doc = np.repeat(np.arange(len(lengths)), lengths)
    group = doc * max(len(flat.dictionary), 1) + flat.indices.to_numpy()
    order = np.argsort(group, kind="stable")
    turns = np.flatnonzero(np.diff(group[order], prepend=-1))
    first = order[turns]
    edges = np.append(turns, len(order))
    columns = {
        "term": flat.dictionary.take(flat.indices.take(pa.array(first))),
        "id": ids.take(pa.array(doc[first])),
        "tf": pa.array(np.diff(edges).astype(np.int32)),
        "length": pa.array(lengths[doc[first]]),
    }
    if positions:
        at = (np.arange(len(doc)) - offsets[:-1][doc])[order]
        columns["positions"] = pa.ListArray.from_arrays(
            pa.array(edges.astype(np.int32)), pa.array(at.astype(np.int32))
        )
    return pa.RecordBatch.from_pydict(columns)


def build_postings(docs: DataFrame, positions: bool = True) -> Postings:
    """Tokenise ``docs (id, contents)`` into postings, term and document tables.

    A document is one row, so its postings are made where it is read, without a shuffle;
    Arrow batches are regrouped by tokens, so that long documents do not pile up in one.
    Only the document frequencies are shuffled, as partial counts.
    """
    tokens = docs.select("id", words(F.col("contents")).alias("tokens"))

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = batch.column("tokens").offsets.to_numpy()[1:]
            start = 0
            while start < batch.num_rows:
                base = ends[start - 1] if start else batch.column("tokens").offsets[0].as_py()
                stop = max(start + 1, int(np.searchsorted(ends, base + BATCH_TOKENS, "right")))
                part = batch.slice(start, stop - start)
                yield _postings_of(part.column("tokens"), part.column("id"), positions)
                start = stop

    schema = "term string, id string, tf int, length long"
    postings = tokens.mapInArrow(
        invert, schema + ", positions array<int>" if positions else schema
    )
    terms = _document_frequencies(postings)
    lengths = tokens.select("id", F.size("tokens").cast("long").alias("length"))
    return Postings(postings, terms, lengths)


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int").alias("term_bucket")


def write_postings(index: Postings, path: str, buckets: int = 64) -> None:
    """Write the index, postings partitioned by term hash.

    The rebalance hint lets AQE split the bucket of a very frequent term over several tasks.
    """
    spark = index.docs.sparkSession

    def write(table: DataFrame, name: str) -> DataFrame:
        (
            table.withColumn("term_bucket", _bucket(F.col("term"), buckets))
            .hint("rebalance", "term_bucket")
            .sortWithinPartitions("term_bucket", "term")
            .write.mode("overwrite")
            .partitionBy("term_bucket")
            .parquet(f"{path}/{name}")
        )
        return spark.read.schema(table.schema).parquet(f"{path}/{name}")

    # Terms are counted from what was written: the documents are inverted once.
    blocks = write(_blocks(write(index.postings, "postings")), "blocks")
    write(blocks.groupBy("term").agg(F.sum("df").alias("df")), "terms")
    index.docs.write.mode("overwrite").parquet(f"{path}/docs")
    spark.range(1).select(F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{path}/layout")


def read_postings(spark: SparkSession, path: str) -> Postings:
    return Postings(
        spark.read.parquet(f"{path}/postings"),
        spark.read.parquet(f"{path}/terms"),
        spark.read.parquet(f"{path}/docs"),
        spark.read.parquet(f"{path}/layout").first().buckets,
        spark.read.parquet(f"{path}/blocks"),
    )


#: The rarest terms of a query are scored first, until they have so many times ``k`` postings.
SEED_POSTINGS = 4
#: Asked terms by block, narrow rows, that may be broadcast.
BOUND_ROWS = 500_000


@dataclass(frozen=True)
class _Search:
    """A search in steps: the threshold, what must be scored, and what is looked up.

    ``found (id, block, term, part)`` has the postings of asked terms by document: what follows
    groups and joins them by ``id``, so that nothing else is shuffled before the best are taken.
    """

    found: DataFrame
    asked: DataFrame
    thresholds: DataFrame
    bounded: DataFrame
    k: int

    def essential(self) -> DataFrame:
        """``(id, block, query, weight, part)``: the postings of terms that alone can reach the threshold."""
        mine = self.bounded.filter("essential").select("query", "term", "block", "weight")
        return self.found.join(broadcast_if_small(mine, BOUND_ROWS), ["term", "block"])

    def open_(self) -> DataFrame:
        """``(id, open)``: the queries whose threshold a document can still reach.

        Its score by essential terms is known; the others can add their bounds in its block.
        """
        rest = F.sum(F.when(~F.col("essential"), F.col("bound"))).alias("rest")
        rests = self.bounded.groupBy("query", "block").agg(F.coalesce(rest, F.lit(0.0)).alias("rest"))
        least = rests.join(self.thresholds, "query", "left").select(
            "query", "block", (F.col("threshold") - F.col("rest")).alias("least")
        )
        sums = self.essential().groupBy("id", "block", "query").agg(F.sum(F.col("weight") * F.col("part")).alias("sure"))
        reached = sums.join(broadcast_if_small(least, BOUND_ROWS), ["query", "block"]).filter(
            F.col("least").isNull() | (F.col("sure") >= F.col("least"))
        )
        return reached.groupBy("id").agg(F.collect_set("query").alias("open"))

    def lookups(self) -> DataFrame:
        """``(id, block, query, weight, part)``: all postings of open documents for their open queries."""
        mine = broadcast_if_small(self.bounded.select("query", "term", "block", "weight"), BOUND_ROWS)
        theirs = self.found.join(self.open_(), "id").alias("theirs")
        mine = mine.alias("mine")
        same = (F.col("theirs.term") == F.col("mine.term")) & (F.col("theirs.block") == F.col("mine.block"))
        return theirs.join(mine, same & F.array_contains("open", F.col("query"))).select(
            "id", "theirs.block", "query", "weight", "part"
        )


def _search(index: Postings, queries: DataFrame, k: int, k1: float, b: float) -> _Search:
    asked = (
        queries.select("query", F.explode(words(F.col("text"))).alias("term"))
        .groupBy("query", "term")
        .agg(F.count(F.lit(1)).alias("asked"))
    )
    asked = stage(asked, "asked-terms")
    named = broadcast_if_small(asked.select("term").distinct())
    if index.buckets:
        # At most as many rows as the index has buckets.
        wanted = asked.select(_bucket(F.col("term"), index.buckets)).distinct().collect()
        here = F.col("term_bucket").isin([r.term_bucket for r in wanted])
        postings = index.postings.filter(here)
    else:
        postings = index.postings
    # The index is read once; every step after it meets the postings of asked terms alone.
    hits = postings.join(named, "term", "left_semi").select("term", "id", "tf", "length", _block())
    hits = stage(hits, "hits")
    if index.buckets:
        blocks = index.blocks.filter(here).drop("term_bucket").join(named, "term", "left_semi")
    else:
        blocks = _blocks(hits)
    blocks = stage(blocks, "blocks")
    n_docs, avg_length = index.docs.agg(F.count(F.lit(1)), F.avg("length")).first()

    def tf_part(tf: str, length: str) -> Column:
        norm = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col(length) / F.lit(avg_length or 1.0))
        return F.col(tf) * F.lit(k1 + 1.0) / (F.col(tf) + norm)

    terms = blocks.groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.ln(
        F.lit(1.0) + (F.lit(n_docs) - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5))
    ) * F.col("asked")
    weighted = stage(asked.join(terms, "term").select("query", "term", "df", weight.alias("weight")), "asked")
    part = tf_part("tf", "length")

    # The rarest terms give k documents whose whole scores set the threshold.
    rarest = Window.partitionBy("query").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("df").over(rarest), F.lit(0))
    seeds = weighted.withColumn("before", before).filter(F.col("before") < SEED_POSTINGS * k)
    seeded = hits.join(broadcast_if_small(seeds.select("query", "term", "weight")), "term")
    seeded = seeded.groupBy("query", "id").agg(F.sum(F.col("weight") * part).alias("sure"))
    best = Window.partitionBy("query").orderBy(F.desc("sure"), F.asc("id"))
    first = seeded.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k)
    first = stage(first.select("query", "id"), "seeds")
    theirs = hits.join(broadcast_if_small(first), "id")
    sums = theirs.join(broadcast_if_small(weighted.select("query", "term", "weight")), ["query", "term"])
    sums = sums.groupBy("query", "id").agg(F.sum(F.col("weight") * part).alias("more"))
    # Sums that round to the same digits tie, so what comes that close is looked at.
    slack = 2 * 10.0**-SCORE_DIGITS
    lowest = sums.groupBy("query").agg(F.count("*").alias("n"), F.min("more").alias("low")).filter(F.col("n") >= k)
    thresholds = stage(lowest.select("query", (F.col("low") - F.lit(slack)).alias("threshold")), "thresholds")

    bound = F.col("weight") * tf_part("most_tf", "least_length")
    bounded = weighted.join(blocks.drop("df"), "term").select("query", "term", "block", "weight", bound.alias("bound"))
    # In each block the terms with the least bounds that together stay below the threshold.
    upto = Window.partitionBy("query", "block").orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, 0)
    bounded = bounded.withColumn("upto", F.sum("bound").over(upto)).join(broadcast_if_small(thresholds), "query", "left")
    essential = F.col("threshold").isNull() | (F.col("upto") >= F.col("threshold"))
    bounded = stage(bounded.select("query", "term", "block", "weight", "bound", essential.alias("essential")), "bounded")
    found = hits.select("id", "block", "term", part.alias("part")).repartition("id")
    return _Search(found, weighted, thresholds, bounded, k)


def bm25_topk(
    index: Postings, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75
) -> DataFrame:
    """``(query, id, score, position)``: the best ``k`` documents of each ``(query, text)``, exactly.

    A term asked twice counts twice. Documents that hold a query's rarest terms set a threshold, the
    k-th best of their whole scores. Blocks of postings bound what a term can add: in
    each block the terms that together stay below the threshold need no scoring of their
    own, so a document without any other term is never met, and frequent terms are looked up
    only in documents that can still reach the threshold. Of a stored index only the buckets of
    asked terms are read. Their postings are shuffled once, by document, however many queries ask
    for a term. Small sides, by a bounded count, are broadcast; otherwise joins shuffle and
    AQE splits frequent terms.
    """
    search = _search(index, queries, k, k1, b)
    total = F.round(F.sum(F.col("weight") * F.col("part")), SCORE_DIGITS).alias("score")
    scored = search.lookups().groupBy("query", "id", "block").agg(total).drop("block")
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc("id"))
    return scored.withColumn("position", F.row_number().over(best)).filter(F.col("position") <= k)


def scored_pairs(
    index: Postings, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75
) -> tuple[int, int]:
    """``(postings met by a search, postings that match its queries)``, each counted by query."""
    search = _search(index, queries, k, k1, b)
    matching = search.asked.agg(F.sum("df")).first()[0] or 0
    return search.essential().count() + search.lookups().count(), matching
