"""Helpers that several operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as a pattern class, and its negation: a word.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes up to which a table is broadcast, by its counted rows and the kinds of its columns.
BROADCAST_BYTES = 16 << 20
#: Bytes of the texts that a worker takes at once, about; a single text is never cut.
BATCH_BYTES = 2 << 20
#: Rows that an Arrow batch has at most: rows hold whole texts, and each task holds a batch or two beside the heap.
ARROW_ROWS = "1000"
#: Deletes the shuffle files of a plan when it has ended; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows from which on a small table is worth a task of its own.
TASK_ROWS = 1 << 16

#: Paths that ``shared_path`` has given.
_paths: list[str] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is configured."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    own = spark.conf.get("spark.sql.warehouse.dir", "spark-warehouse").rstrip("/") + "/_checkpoints"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


@contextmanager
def shuffles_cleared(spark: SparkSession) -> Iterator[None]:
    """Plans that are made and run within delete their shuffle files at their end."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def saved(df: DataFrame) -> DataFrame:
    """Cuts the lineage: the rows are written to the shared checkpoint folder and read from there."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    with shuffles_cleared(spark):
        # a plan of its own: df may be run again
        return df.select("*").checkpoint(eager=True)


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path below the shared folder; ``cleared`` deletes it with all others."""
    _paths.append(f"{checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}")
    return _paths[-1]


def cleared(spark: SparkSession) -> int:
    """Deletes what operators of this session have written below the shared folder, checkpoints apart: for the end of a job, when its results are written.

    DataFrames that operators have returned can't be read any more then. Gives the number of paths.
    """
    paths, _paths[:] = list(_paths), []
    for path in paths:
        removed(spark, path)
    return len(paths)


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared path, and the path there."""
    uri = "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path
    return fs.FileSystem.from_uri(uri)


def written(df: DataFrame, kind: str) -> DataFrame:
    """As ``saved``, as Parquet: for wide rows, which take less room so and are read by columns."""
    path = shared_path(df.sparkSession, kind)
    with shuffles_cleared(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a path below the shared folder that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks for a table of so many rows: one for each ``TASK_ROWS``, and one for each core at least."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def power_of_two(n: float) -> int:
    """The smallest power of two that is at least n."""
    return 1 << max(0, int(n) - 1).bit_length()


def small(df: DataFrame, items: Column | None = None) -> DataFrame:
    """For a join with a larger table: broadcast if it is small, so that the larger one need not move.

    Its rows are counted, so it is a saved table; ``items`` has the elements of a row that holds a list. Texts and
    digests count 64 bytes, other values 16, and a row 32 more.
    """
    n = df.agg(F.coalesce(F.sum(items), F.lit(0)) if items is not None else F.count(F.lit(1))).first()[0]
    width = 32 + sum(64 if kind in ("string", "binary") else 16 for _, kind in df.dtypes)
    return F.broadcast(df) if n * width <= BROADCAST_BYTES else df


def batches_of(texts: pa.Array, most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """First and last row (that one excluded) of parts of about so many bytes."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(ends):
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most))
        yield at, max(to, at + 1)
        at = max(to, at + 1)


def packed(df: DataFrame) -> DataFrame:
    """Each row as one struct, row, so that its columns never clash with an operator's own."""
    ready(df.sparkSession)
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))


def only(df: DataFrame, **columns: Column | str) -> DataFrame:
    """The named columns alone, so that further columns of the input never clash with an operator's own.

    Every operator begins here or with ``packed``, so the session is made ready by the way.
    """
    ready(df.sparkSession)
    return df.select(*((F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()))


def text_of(column: Column | str) -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def ready(spark: SparkSession) -> None:
    """Bounds the rows of Arrow batches, and sends this package to the executors, once a session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    context = spark.sparkContext
    if getattr(context, "_corvane_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    handle, path = tempfile.mkstemp(prefix="corvane-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(top.rglob("*.py")):
            archive.write(file, file.relative_to(top.parent))
    context.addPyFile(path)
    context._corvane_shipped = True
