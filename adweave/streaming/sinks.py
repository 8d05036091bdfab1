"""Sinks for micro-batches that may be replayed: a ledger of batches, and what a batch of matches writes."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import shared_folder

#: Tables that a batch writes, by name, in order; a function makes one from those written before it.
Writes = Callable[[DataFrame], dict[str, DataFrame | Callable[[dict[str, DataFrame]], DataFrame]]]


class LedgerSink:
    """Writes each micro-batch's tables, and then a line of the ledger; only batches in the ledger are read.

    writes: gives the tables that a batch writes, by name. A batch lies in folders of its
    own, overwritten by a second try; a batch in the ledger is left as it is, so a replay,
    also of other rows under its number, changes nothing.
    """

    def __init__(self, spark: SparkSession, writes: Writes, path: str | None = None) -> None:
        self.spark, self.writes = spark, writes
        self.path = path or f"{shared_folder(spark)}/sink-{uuid.uuid4().hex}"
        self.schemas: dict = {}

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def batches(self) -> list[int]:
        """Numbers of the batches that count."""
        files, at = self._files(), self._path("ledger")
        return sorted(int(f.getPath().getName()) for f in files.listStatus(at)) if files.exists(at) else []

    def write(self, batch: DataFrame, number: int) -> None:
        """For foreachBatch."""
        tables, done = self.writes(batch), number in self.batches()
        stored: dict[str, DataFrame] = {}
        for name, rows in tables.items():
            rows = rows(stored) if callable(rows) else rows
            self.schemas[name] = rows.schema
            stored[name] = rows
            if not done:
                at = f"{self.path}/{name}/batch={number}"
                rows.write.mode("overwrite").parquet(at)
                stored[name] = self.spark.read.schema(rows.schema).parquet(at)
        if done:
            return
        self._files().create(self._path(f"ledger/{number}"), False).close()  # fails if another writer was first

    def run(self, stream: DataFrame) -> None:
        """Write a stream until its source is read up; a sink of the same path goes on where the last one ended."""
        query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{self.path}/state").foreachBatch(self.write).start()
        query.awaitTermination()
        if (failed := query.exception()) is not None:
            raise failed
        if not self.schemas:  # no batch: what an empty one would write
            empty: dict[str, DataFrame] = {}
            for name, rows in self.writes(self.spark.createDataFrame([], stream.schema)).items():
                empty[name] = rows(empty) if callable(rows) else rows
            self.schemas = {k: v.schema for k, v in empty.items()}

    def table(self, name: str) -> DataFrame:
        paths = [f"{self.path}/{name}/batch={n}" for n in self.batches()]
        return self.spark.read.schema(self.schemas[name]).parquet(*paths) if paths else self.spark.createDataFrame([], self.schemas[name])


def generated_id(keys: list[str]) -> Column:
    """An id that a row's keys determine, so that a second try gives the same."""
    return F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in keys]))


def matches_with_alerts(keys: list[str], dealers: DataFrame) -> Writes:
    """Writes of a batch of matches: `matches`, one a key, with a generated id, their dealer null where `dealers` (distributor_id) doesn't have it; and `alerts` of violations, which carry that id."""

    def alerts(stored: dict[str, DataFrame]) -> DataFrame:
        return stored["matches"].filter("status = 'violation'").select(F.col("id").alias("match_ref"), "distributor_id", F.lit("compliance_violation").alias("alert"))

    def writes(batch: DataFrame) -> dict[str, DataFrame | Callable]:
        known = dealers.select("distributor_id").distinct().withColumn("__known", F.lit(True))
        rows = batch.join(known, "distributor_id", "left").withColumn("distributor_id", F.when(F.col("__known"), F.col("distributor_id")))
        rows = rows.groupBy(*keys).agg(F.max("distributor_id").alias("distributor_id"), F.first("status").alias("status"))
        return {"matches": rows.select(generated_id(keys).alias("id"), *keys, "distributor_id", "status"), "alerts": alerts}  # ids are longer than keys, so they aren't shuffled

    return writes
