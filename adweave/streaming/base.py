"""Running a stateful stream over a file source to its end, into a table in the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir of the session, or the context's checkpoint folder.

    If neither is set, a temporary folder in local mode, where all is one machine; on a cluster that raises.
    """
    sc = spark.sparkContext
    if at := sc.getConf().get("spark.checkpoint.dir"):
        return at
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="adweave-"))
    return sc._jsc.sc().getCheckpointDir().get()


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A file stream over a Parquet table, in the table's own schema.

    A table may be a single file, which a stream only takes by a pattern.
    """
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def arriving(rows: DataFrame, arrival: Column, files: int = 5, closing: DataFrame | None = None) -> tuple[str, int]:
    """The folder of a file source that gets rows in the order of arrival (a number), in `files` instalments, and what of `arrival` an instalment spans.

    closing: rows of an instalment after all others; with a far time they let the watermark pass the rest.
    """
    spark = rows.sparkSession
    at = f"{shared_folder(spark)}/arriving-{uuid.uuid4().hex}"
    rows = rows.withColumn("__at", arrival)
    rows.write.parquet(f"{at}-all")  # once, so that an instalment doesn't make all rows anew
    rows = spark.read.schema(rows.schema).parquet(f"{at}-all")
    low, high = rows.agg(F.min("__at"), F.max("__at")).first()
    span = 1 if low is None else -(-(high - low + 1) // files)
    for k in range(files if low is not None else 0):
        rows.filter((F.col("__at") >= low + k * span) & (F.col("__at") < low + (k + 1) * span)).drop("__at").write.mode("append").parquet(at)
    if closing is not None:
        closing.write.mode("append").parquet(at)
    return at, span


def read_arriving(spark: SparkSession, path: str, schema: StructType, per_batch: int) -> DataFrame:
    """The stream over such a folder, so many files a micro-batch, the oldest first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def drained(stream: DataFrame, mode: str = "append", at: str | None = None) -> DataFrame:
    """The rows that a stream emits until its source is read up, as a stored table.

    Progress and state are in the shared folder, so a lost executor costs a retried task.
    In update mode a key can come more than once, as it does to any sink. at: the folder
    of a stream that is to go on where it ended.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    at = at or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/rows/batch={number}")

    query = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{at}/state").foreachBatch(write).start()
    query.awaitTermination()
    if (failed := query.exception()) is not None:
        raise failed
    return spark.read.schema(stream.schema).parquet(f"{at}/rows/*")
