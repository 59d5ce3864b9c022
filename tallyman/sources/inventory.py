"""Files as rows: path, length, modification time and digest.

Spark's own file sources leave out empty files and names starting with ``.`` or ``_``, which
an inventory must not. So folders are listed by tasks, level by level, and files are hashed
as streams, which also has no size limit.
"""

from __future__ import annotations

import fnmatch
import hashlib
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyman.session import stage

LISTED = "path string, kind string, length long, modified_us long"
HASHED = "path string, length long, modified_us long, sha256 string, status string"
ROWS_PER_BATCH = 10_000

Batches = Iterator[pa.RecordBatch]


def _listing(root: str) -> Callable[[Batches], Batches]:
    """A task function that lists the folders of each batch; paths are the store's own."""
    schema = pa.schema(
        [("path", pa.string()), ("kind", pa.string()), ("length", pa.int64()), ("modified_us", pa.int64())]
    )

    def run(batches: Batches) -> Batches:
        store, _ = fs.FileSystem.from_uri(root)
        local = store.type_name == "local"
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                found = store.get_file_info(fs.FileSelector(folder, recursive=False))
                # A link is neither a file nor a folder of the tree; following it may loop.
                kept = [i for i in found if not (local and os.path.islink(i.path))]
                dirs = [i.type == fs.FileType.Directory for i in kept]
                table = pa.Table.from_pydict(
                    {
                        "path": [i.path for i in kept],
                        "kind": ["dir" if d else "file" for d in dirs],
                        "length": [None if d else i.size for i, d in zip(kept, dirs)],
                        "modified_us": [i.mtime_ns // 1000 if i.mtime_ns else None for i in kept],
                    },
                    schema=schema,
                )
                yield from table.to_batches(max_chunksize=ROWS_PER_BATCH)

    return run


def _digest(store: fs.FileSystem, path: str) -> str | None:
    try:
        with store.open_input_stream(path) as stream:
            return hashlib.file_digest(stream, "sha256").hexdigest()
    except OSError:
        return None


def _hashing(root: str) -> Callable[[Batches], Batches]:
    """A task function that adds digests to the files of each batch."""

    def run(batches: Batches) -> Batches:
        store, _ = fs.FileSystem.from_uri(root)
        for batch in batches:
            digests = [_digest(store, path) for path in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "path": batch.column("path"),
                "length": batch.column("length"),
                "modified_us": batch.column("modified_us"),
                "sha256": pa.array(digests, pa.string()),
                "status": pa.array(["hashed" if d else "unreadable" for d in digests], pa.string()),
            })

    return run


def file_inventory(
    spark: SparkSession, path: str, *, hashes: bool = True, glob: str | None = None
) -> DataFrame:
    """``(path, length, modified, sha256, status)`` for every regular file under ``path``.

    Hidden and empty files included, links not followed. Each level's folders are spread
    over the tasks; so are the files to hash. Without ``hashes`` nothing is opened and the
    status is ``listed``; else it is ``hashed``, or ``unreadable`` with a null digest.
    ``glob`` selects by file name.
    """
    _, base = fs.FileSystem.from_uri(path)
    level = spark.createDataFrame([(base,)], "path string")
    found: DataFrame | None = None
    while True:
        listed = stage(level.mapInArrow(_listing(path), LISTED), "listing")
        files = listed.filter(F.col("kind") == "file")
        found = files if found is None else found.unionByName(files)
        folders = listed.filter(F.col("kind") == "dir").select("path")
        if folders.isEmpty():
            break
        level = folders.repartition(spark.sparkContext.defaultParallelism)
    if glob:
        name = F.substring_index("path", "/", -1)
        found = found.filter(name.rlike("^" + fnmatch.translate(glob)))
    shown = F.concat(F.lit(path.rstrip("/")), F.substring("path", len(base.rstrip("/")) + 1, 1 << 30))
    about = [shown.alias("path"), "length", F.timestamp_micros("modified_us").alias("modified")]
    if not hashes:
        return found.select(
            *about, F.lit(None).cast("string").alias("sha256"), F.lit("listed").alias("status")
        )
    spread = found.drop("kind").repartition(spark.sparkContext.defaultParallelism)
    return spread.mapInArrow(_hashing(path), HASHED).select(*about, "sha256", "status")
