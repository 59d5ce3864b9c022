"""Near-duplicate vectors: spherical k-means cells, cosine products by blocks within cells.

Equal vectors form one class first. Spherical k-means on a bounded sample gives the cells, and
every class is assigned to its nearest. Two linked vectors may lie on either side of a border,
but then neither is farther from the border's plane than the two are apart. So a vector is a
guest in each earlier cell whose border is within that distance, and no link is lost; a
smaller ``margin`` trades links for fewer guests. In a cell the members are compared in blocks
by matrix products: a task holds two blocks, and gives out each member's number of links and
the root it hangs on, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyman.llm.graph import components
from tallyman.session import stage

#: Vectors that the cells are learnt from, at most: those with the smallest hash.
SAMPLE = 20_000
#: Vectors of one label a cell is meant to hold, and cells at most.
CELL_ROWS = 2048
MAX_CELLS = 512
#: Members of a cell that are compared as one block.
BLOCK = 1024


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """``k`` or fewer centres of length 1 for rows of length 1."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        length = np.linalg.norm(sums, axis=1)
        live = length > 1e-9
        centres = sums[live] / length[live, None]
    return centres


def _unit_rows(column) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in column])
    return x / np.linalg.norm(x, axis=1)[:, None]


def _assign(centres: dict[int, np.ndarray], margin: float):
    """Each class in its nearest cell (guest 0) and, as a guest, in the earlier ones near by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vec").to_pylist()
            row, cell, guest = [], [], []
            for size in {len(v) for v in vectors}:
                at = np.array([i for i, v in enumerate(vectors) if len(v) == size])
                if size not in centres:
                    row.append(at)
                    cell.append(np.zeros(len(at), np.int64))
                    guest.append(np.zeros(len(at), np.int64))
                    continue
                c = centres[size]
                near = _unit_rows([vectors[i] for i in at]) @ c.T
                home = near.argmax(1)
                apart = np.sqrt(np.maximum(2 - 2 * (c @ c.T), 1e-18))
                far = (near.max(1)[:, None] - near) / apart[home]
                visits = (far <= margin) & (np.arange(len(c))[None, :] < home[:, None])
                i, j = np.nonzero(visits)
                row += [at, at[i]]
                cell += [home, j]
                guest += [np.zeros(len(at), np.int64), np.ones(len(i), np.int64)]
            row = np.concatenate(row) if row else np.zeros(0, np.int64)
            own = batch.take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [
                    *own.columns,
                    pa.array(np.concatenate(cell) if cell else row, pa.int64()),
                    pa.array(np.concatenate(guest) if guest else row, pa.int64()),
                ],
                [*batch.schema.names, "cell", "guest"],
            )

    return run


def _compare(least: float):
    def run(key: tuple, members: pd.DataFrame) -> pd.DataFrame:
        i, j = key[-2], key[-1]
        x = _unit_rows(members["vec"])
        guest, block = members["guest"].to_numpy() == 1, members["mine"].to_numpy()
        node, weight = members["node"].to_numpy(), members["n"].to_numpy()
        # Links are bounded below in steps of rows, so that a block's products stay small.
        root = np.arange(len(x))
        linked = np.zeros((len(x), len(x)), bool)
        for a in range(0, len(x), 512):
            part = slice(a, a + 512)
            hit = x[part] @ x.T >= least
            hit &= ~(guest[part, None] & guest[None, :])
            if i != j:
                hit &= block[part, None] != block[None, :]
            linked[part] = hit
        np.fill_diagonal(linked, False)
        links = linked @ weight
        while True:
            low = np.where(linked, root[None, :], len(x)).min(1, initial=len(x))
            new = np.minimum(root, low)
            new = np.minimum(new, new[new])
            if (new == root).all():
                break
            root = new
        some = links > 0
        return pd.DataFrame({"node": node[some], "links": links[some], "root": node[root[some]]})

    return run


def near_duplicate_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    least: float = 0.98,
    margin: float | None = None,
) -> DataFrame:
    """A row per vector: id, n_links, component_id, kept.

    Vectors of equal label (and length) are linked from a cosine of ``least`` on, in double
    precision. ``n_links`` counts the other rows linked directly, equal vectors included;
    ``component_id`` is the smallest id that links lead to. A vector that is null, empty, zero
    or has null or non-finite components, and one whose label is null, has no links. A null id
    takes part as any other, but is never the smallest of a component; ``component_id`` is null
    only where all are. Repeated rows are vectors of their own. An empty table gives no rows.
    """
    vec, label = F.col(f"`{vector_col}`"), F.col(f"`{label_col}`").cast("string")
    finite = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    norm = F.aggregate(vec, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    usable = label.isNotNull() & vec.isNotNull() & finite & (norm > 0) & (norm < float("inf"))
    rows = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        label.alias("label"),
        vec.alias("vec"),
        F.coalesce(usable, F.lit(False)).alias("usable"),
        F.xxhash64(label, vec).alias("k1"),
        F.xxhash64(F.lit("second"), label, vec).alias("k2"),
    )
    heads = rows.filter("usable").groupBy("k1", "k2").agg(
        F.min("id").alias("id"), F.count("*").alias("n"), F.first("vec").alias("vec"), F.first("label").alias("label")
    )
    classes = stage(heads.withColumn("node", F.coalesce("id", "k1")), "vector-classes")
    chord = math.sqrt(2 - 2 * least) + 1e-6
    centres = _cells(classes)
    members = stage(
        classes.select("label", "node", "n", "vec").mapInArrow(
            _assign(centres, chord if margin is None else margin),
            f"label string, node long, n long, vec {classes.schema['vec'].dataType.simpleString()}, cell long, guest long",
        ),
        "cells",
    )
    members = members.withColumn("width", F.size("vec"))
    place = ["label", "width", "cell"]
    sizes = members.groupBy(*place).agg(F.count("*").alias("m"))
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    dealt = (
        members.join(sizes.select(*place, blocks.alias("blocks")), place)
        .withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("i", F.least("mine", "other"))
        .withColumn("j", F.greatest("mine", "other"))
    )
    met = stage(
        dealt.select(*place, "i", "j", "mine", "node", "n", "vec", "guest")
        .groupBy(*place, "i", "j")
        .applyInPandas(_compare(least), "node long, links long, root long"),
        "links",
    )
    counts = met.groupBy("node").agg(F.sum("links").alias("links"))
    tree = components(met.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = classes.select("node", "id", "k1", "k2", "n").join(counts, "node", "left").join(tree, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    lowest = named.groupBy("component").agg(F.min("id").alias("component_id"))
    named = named.join(lowest, "component").select(
        "k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "component_id", F.lit(True).alias("usable")
    )
    done = rows.select("id", "k1", "k2", "usable").join(named, ["k1", "k2", "usable"], "left")
    component = F.when(F.col("usable"), F.col("component_id")).otherwise(F.col("id"))
    return done.select(
        F.col("id").alias(id_col),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def _cells(classes: DataFrame) -> dict[int, np.ndarray]:
    """Centres for each length of vectors, learnt from at most ``SAMPLE`` vectors."""
    facts = classes.agg(F.count("*").alias("n"), F.approx_count_distinct("label").alias("labels")).first()
    k = min(MAX_CELLS, max(1, round(facts.n / max(1, facts.labels) / CELL_ROWS)))
    if k == 1:
        return {}
    sample = classes.orderBy("k1", "k2").select("vec").limit(SAMPLE).collect()
    lengths = {len(r.vec) for r in sample}
    return {
        size: spherical_kmeans(_unit_rows([r.vec for r in sample if len(r.vec) == size]), k) for size in lengths
    }
