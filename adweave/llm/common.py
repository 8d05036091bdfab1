"""What several operators share: shared-folder tables, text batches, hold-out rule."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session, or the context's checkpoint folder.

    If neither is set, a temporary folder in local mode, where all is one machine; on a cluster that raises.
    """
    sc = spark.sparkContext
    if at := sc.getConf().get("spark.checkpoint.dir"):
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(at)
        return at
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="adweave-"))
    return sc._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write df as a Parquet table in the shared folder and return the table read back."""
    path = f"{shared_dir(df.sparkSession)}/adweave-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._adweave_path = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete the tables of stored frames that nothing reads any more."""
    for f in frames:
        jvm = f.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(f._adweave_path)
        path.getFileSystem(f.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def tidy() -> None:
    """Collect the driver's garbage: Spark deletes the shuffle files and checkpoints of frames only after that."""
    gc.collect()
    give_back()
    if (spark := SparkSession.getActiveSession()) is not None:
        spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Give memory that the process no longer uses back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a libc without malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small intermediate frame with a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for rows that no model learns from: crc32 of the id as text, mod 3, is 1."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % 3 == 1


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_chunks(batches: Iterable[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts have about `most` bytes together, one row at least."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if total and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if len(sizes) > start:
            yield batch.slice(start)


def lean(run: Callable) -> Callable:
    """run for mapInArrow; after each task the worker, which Spark keeps, gives back the memory it no longer uses."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped


#: A frame of so many narrow rows at most (some MB) may be broadcast.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it is counted to have so many rows at most, else df as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
