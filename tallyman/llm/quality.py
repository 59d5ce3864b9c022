"""A quality classifier: random-indexing word vectors, pooled per document, and a small network.

Every word has a sparse ternary index vector, made from its hash. A word's vector is the sum
of the index vectors of its neighbours, over all documents of the corpus. Words share a fixed
number of rows by hash, so the vectors are a matrix of fixed size, whatever the corpus: each
task sums its own, and the sums are added block by block. A document is the mean of its words'
vectors, weighted by inverse document frequency. A network of two layers, fitted in numpy on a
bounded sample of labelled documents, turns that into a score, whose temperature is set on
documents the network was not fitted to.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyman.llm.words import Words, column_words, is_space, mix, seeds

#: Rows that words share by hash, and the length of a vector.
VOCABULARY = 1 << 15
DIMENSIONS = 48
#: Places of an index vector that are not zero, and neighbours on either side that count.
NON_ZERO = 2
REACH = 2
#: Rows of the matrix that are added up as one block.
BLOCK = 128
#: Labelled documents the network is fitted on, at most: those with the smallest hash of the id.
MAX_LABELLED = 20_000
#: A score from here on predicts label 1.
THRESHOLD = 0.3
HIDDEN = 32

#: Classes of bytes: white space, letters, digits, all other signs.
_CODE = np.arange(256)
_LETTER = ((_CODE | 32) >= 97) & ((_CODE | 32) <= 122) | (_CODE >= 128)
KINDS = np.where(is_space(_CODE), 0, np.where(_LETTER, 1, np.where((_CODE >= 48) & (_CODE <= 57), 2, 3)))
KINDS = KINDS.astype(np.uint8)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """For each row of the vocabulary the places of its index vector, and their signs."""
    rows = mix(np.arange(VOCABULARY, dtype=np.uint64)[:, None] ^ seeds(NON_ZERO, 21)[None, :])
    places = (rows % np.uint64(DIMENSIONS)).astype(np.int64)
    return places, np.where(rows >> np.uint64(63), 1.0, -1.0)


def rows_of(words: Words) -> np.ndarray:
    return (words.hashes % np.uint64(VOCABULARY)).astype(np.int64)


def _add_contexts(words: Words, total: np.ndarray, places: np.ndarray, signs: np.ndarray) -> None:
    rows, owner = rows_of(words), words.owners()
    flat = total[:, :DIMENSIONS]
    for step in range(1, REACH + 1):
        same = np.flatnonzero(owner[step:] == owner[:-step])
        left, right = rows[same], rows[same + step]
        for a, b in ((left, right), (right, left)):
            for k in range(NON_ZERO):
                found = np.bincount(
                    a * DIMENSIONS + places[b, k], signs[b, k], VOCABULARY * DIMENSIONS
                )
                flat += found.reshape(VOCABULARY, DIMENSIONS).astype(np.int64)
    seen = np.unique(owner * VOCABULARY + rows) % VOCABULARY
    total[:, DIMENSIONS] += np.bincount(seen, minlength=VOCABULARY)


def _context_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((VOCABULARY, DIMENSIONS + 1), np.int64)
    places, signs = index_vectors()
    n = 0
    for batch in batches:
        for _, _, words in column_words(batch.column("text"), kinds=KINDS):
            _add_contexts(words, total, places, signs)
        n += batch.num_rows
    packed = [zlib.compress(total[i : i + BLOCK].tobytes(), 1) for i in range(0, VOCABULARY, BLOCK)]
    yield pa.RecordBatch.from_arrays(
        [pa.array(range(len(packed)), pa.int32()), pa.array(packed, pa.binary()), pa.array([n] * len(packed), pa.int64())],
        ["block", "sums", "n"],
    )


def _add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    counts: dict[int, int] = {}
    for batch in batches:
        for block, packed, n in zip(*(batch.column(c).to_pylist() for c in ("block", "sums", "n")), strict=True):
            own = np.frombuffer(zlib.decompress(packed), np.int64)
            sums[block] = sums[block] + own if block in sums else own
            counts[block] = counts.get(block, 0) + n
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(list(sums), pa.int32()),
            pa.array([zlib.compress(x.tobytes(), 1) for x in sums.values()], pa.binary()),
            pa.array([counts[b] for b in sums], pa.int64()),
        ],
        ["block", "sums", "n"],
    )


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The matrix of word vectors, each of length 1 times its inverse document frequency.

    It has ``VOCABULARY`` rows and one more column for the frequency, however large the corpus.
    """
    blocks = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(
        _context_blocks, "block int, sums binary, n long"
    )
    added = blocks.repartition("block").mapInArrow(_add_blocks, "block int, sums binary, n long").collect()
    total = np.zeros((VOCABULARY, DIMENSIONS + 1))
    n = 0
    for row in added:
        own = np.frombuffer(zlib.decompress(row.sums), np.int64).reshape(BLOCK, DIMENSIONS + 1)
        total[row.block * BLOCK : (row.block + 1) * BLOCK] = own
        n = row.n
    weight = np.log((1 + n) / (1 + total[:, -1])) + 1
    length = np.linalg.norm(total[:, :-1], axis=1)
    vectors = total[:, :-1] / np.maximum(length, 1e-9)[:, None]
    return np.concatenate([vectors * weight[:, None], weight[:, None]], 1).astype(np.float32)


def pooled(words: Words, vectors: np.ndarray) -> np.ndarray:
    """A row per text: the weighted mean of its words' vectors, and three figures of the pool.

    These are the share of words equal to the one before (index vectors that agree), the share
    of distinct words, and the logarithm of the number of words. All are 0 without words.
    """
    n = len(words.offsets) - 1
    out = np.zeros((n, DIMENSIONS + 3), np.float64)
    full = np.flatnonzero(words.counts)
    if not len(full):
        return out
    rows, owner, counts = rows_of(words), words.owners(), words.counts[full]
    sums = np.add.reduceat(vectors[rows], words.offsets[full], axis=0)
    out[full, :DIMENSIONS] = sums[:, :-1] / sums[:, -1:]
    same = np.zeros(len(rows), bool)
    same[1:] = (words.hashes[1:] == words.hashes[:-1]) & (owner[1:] == owner[:-1])
    out[full, DIMENSIONS] = np.add.reduceat(same.astype(np.int64), words.offsets[full]) / counts
    distinct = np.bincount(np.unique(owner * VOCABULARY + rows) // VOCABULARY, minlength=n)
    out[full, DIMENSIONS + 1] = distinct[full] / counts
    out[full, DIMENSIONS + 2] = np.log1p(counts)
    return out


@dataclass
class Network:
    """Standardised inputs, a layer of tanh units, one logit, and its temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit_network(x: np.ndarray, y: np.ndarray, check: np.ndarray, epochs: int = 60, seed: int = 5) -> Network:
    """Fits on the rows outside ``check`` with Adam; those inside set the temperature.

    With no rows the score is 0.5 throughout; with one label it stays near that label.
    """
    rng = np.random.default_rng(seed)
    width = x.shape[1]
    mean, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(width), np.ones(width))
    shapes = ((width, HIDDEN), (HIDDEN,), (HIDDEN,), ())
    weights = [rng.normal(0, width**-0.5, shapes[0]), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(())]
    if not len(x):
        return Network(mean, scale, weights[0], weights[1], weights[2] * 0, 0.0)
    fit = np.flatnonzero(~check) if (~check).any() else np.arange(len(x))
    z = (x - mean) / scale
    first, second, step = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes], 0
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(fit), max(1, len(fit) // 256)):
            hidden = np.tanh(z[at] @ weights[0] + weights[1])
            off = (1 / (1 + np.exp(-(hidden @ weights[2] + weights[3]))) - y[at]) / len(at)
            back = off[:, None] * weights[2] * (1 - hidden**2)
            slopes = [z[at].T @ back + 1e-4 * weights[0], back.sum(0), hidden.T @ off + 1e-4 * weights[2], off.sum()]
            step += 1
            for k, g in enumerate(slopes):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                weights[k] = weights[k] - 3e-3 * (first[k] / (1 - 0.9**step)) / (
                    np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8
                )
    net = Network(mean, scale, weights[0], weights[1], weights[2], float(weights[3]))
    net.temperature = _temperature(net.logits(x[check]), y[check])
    return net


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of the smallest log loss on a grid; 1 without rows."""
    if not len(y):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 81))
    loss = [np.mean(np.logaddexp(0, logits / t) - y * logits / t) for t in grid]
    return float(grid[int(np.argmin(loss))])


def _pool(vectors):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, words in column_words(batch.column("text"), kinds=KINDS):
                rows = pooled(words, vectors.value)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("label").slice(at, to - at),
                        batch.column("fold").slice(at, to - at),
                        pa.array(list(rows), pa.list_(pa.float64())),
                    ],
                    ["label", "fold", "x"],
                )

    return run


def _score(vectors, net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, words in column_words(batch.column("text"), kinds=KINDS):
                part = batch.slice(at, to - at)
                scores = net.scores(pooled(words, vectors.value))
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("text"), pa.array(scores)], ["row", "text", "score"])

    return run


def fold_of(id_col: str):
    """The remainder that splits documents into folds; fold 0 is never learnt from."""
    return F.crc32(F.col(f"`{id_col}`").cast("string")) % 5


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_labelled: int = MAX_LABELLED,
) -> DataFrame:
    """``(row, score)``: each row of ``docs`` as a struct, and its score from 0 to 1.

    Word statistics cover all documents. The network is fitted on at most ``max_labelled``
    labelled documents of folds 1 to 4 (of the id's CRC-32 modulo 5), fold 1 setting the
    temperature. Of rows with one id the text that comes first by hash is learnt from. A document
    labelled twice with different labels counts as label 0; null
    labels and null ids teach nothing. Null and empty texts are scored as texts without words.
    Without labels every score is 0.5. Repeated rows are scored alike; an empty table gives no
    rows. No column but the text enters a score.
    """
    vectors = docs.sparkSession.sparkContext.broadcast(word_vectors(docs, text_col))
    known = (
        labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
        .filter("id IS NOT NULL AND label IN (0, 1)")
        .groupBy("id")
        .agg(F.min("label").alias("label"))
        .withColumn("fold", fold_of("id"))
        .filter("fold != 0")
        .orderBy(F.xxhash64("id"), "id")
        .limit(max_labelled)
    )
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    # Rows that share an id: the one whose text comes first by hash, wherever it is read.
    first = F.min_by(F.struct("text", "label", "fold"), F.struct(F.xxhash64("text"), "text")).alias("row")
    sample = (
        texts.join(F.broadcast(known), "id")
        .groupBy("id")
        .agg(first)
        .select("row.text", "row.label", "row.fold")
        .mapInArrow(_pool(vectors), "label int, fold long, x array<double>")
        .toPandas()
    )
    x = np.array(sample["x"].tolist(), np.float64).reshape(len(sample), DIMENSIONS + 3)
    order = np.lexsort(x.T)  # the rows arrive in no fixed order
    y, fold = sample["label"].to_numpy(float)[order], sample["fold"].to_numpy()[order]
    net = fit_network(x[order], y, fold == 1)
    # The text goes through the workers once, beside the other columns.
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    packed = docs.select(F.struct(*others).alias("row"), F.col(f"`{text_col}`").alias("text"))
    scored = packed.mapInArrow(
        _score(vectors, net), f"row {packed.schema['row'].dataType.simpleString()}, text string, score double"
    )
    whole = [F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns]
    return scored.select(F.struct(*whole).alias("row"), "score")


def drop_low_quality(
    docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text_col: str = "text", **names
) -> DataFrame:
    """``docs`` without the rows that score below ``threshold``; columns as they are.

    Null and empty texts are scored like texts without words, repeated rows alike, very long ones
    whole. Columns may have any name; an empty table stays empty.
    """
    kept = score_quality(docs, labels, text_col=text_col, **names).filter(F.col("score") >= threshold)
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
