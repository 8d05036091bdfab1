"""Table functions to call from SQL, with a table as argument."""

from __future__ import annotations

import math

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, PartitioningColumn, OrderingColumn
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructType

#: Threshold where there are too few rows, and how many are enough.
DEFAULT_THRESHOLD, ENOUGH = 40, 10


def _keys(rows: AnalyzeArgument, known: set[str]) -> StructType:
    """The table's columns other than the known ones."""
    return StructType([f for f in rows.dataType.fields if f.name not in known])


def _values(row: Row, known: set[str]) -> tuple:
    return tuple(v for k, v in row.asDict().items() if k not in known)


class OptimalThreshold:
    """optimal_threshold(TABLE(t) PARTITION BY .., enough): for each partition the mean score of its correct rows less half their sample deviation, rounded; DEFAULT_THRESHOLD under `enough` rows.

    t has columns score, was_correct and n (how many rows are alike, so that a partition's
    rows are its distinct scores). Its other columns, the partition's, come first in the result.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, enough: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("the first argument must be a table")
        names = {f.name for f in rows.dataType.fields}
        if missing := {"score", "was_correct", "n"} - names:
            raise ValueError(f"the table lacks {sorted(missing)}")
        return AnalyzeResult(schema=_keys(rows, names & {"score", "was_correct", "n"}).add("rows", LongType()).add("threshold", IntegerType()))

    def __init__(self) -> None:
        self.n, self.good, self.total, self.squares, self.enough, self.keys = 0, 0, 0.0, 0.0, ENOUGH, ()

    def eval(self, row: Row, enough: int = ENOUGH) -> None:
        self.enough, self.keys = enough, _values(row, {"score", "was_correct", "n"})
        self.n += row["n"]
        if row["was_correct"] and row["score"] is not None:
            k, x = row["n"], float(row["score"])
            self.good, self.total, self.squares = self.good + k, self.total + k * x, self.squares + k * x * x

    def terminate(self):
        threshold = DEFAULT_THRESHOLD
        if self.n >= self.enough and self.good:
            mean = self.total / self.good
            spread = math.sqrt(max(0.0, (self.squares - self.total * mean) / (self.good - 1))) if self.good > 1 else 0.0
            threshold = math.floor(mean - 0.5 * spread + 0.5)
        yield *self.keys, self.n, threshold


class LinkCounts:
    """link_counts(TABLE(t) PARTITION BY org): how many rows got a dealer by their parent (updated) and how many still have none (orphans).

    t has columns own and of_parent, the dealer's id of a row and that of the row it hangs
    on, and n, how many rows are alike; its other columns come first in the result.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or not {"own", "of_parent", "n"} <= {f.name for f in rows.dataType.fields}:
            raise ValueError("link_counts takes a table with own, of_parent and n")
        return AnalyzeResult(schema=_keys(rows, {"own", "of_parent", "n"}).add("updated", LongType()).add("orphans", LongType()))

    def __init__(self) -> None:
        self.updated, self.orphans, self.keys = 0, 0, ()

    def eval(self, row: Row) -> None:
        self.keys = _values(row, {"own", "of_parent", "n"})
        if row["own"] is None:
            if row["of_parent"] is None:
                self.orphans += row["n"]
            else:
                self.updated += row["n"]

    def terminate(self):
        yield *self.keys, self.updated, self.orphans


class InFirstTier:
    """first_tier(TABLE(t) PARTITION BY key ORDER BY tier): the first row of each key whose attempt succeeded, by rank; K4's ladder run as a table function.

    t has columns key, tier and ok. Without a success the last attempt is given.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or not {"key", "tier", "ok"} <= {f.name for f in rows.dataType.fields}:
            raise ValueError("first_tier takes a table with key, tier and ok")
        return AnalyzeResult(
            schema=StructType().add("key", LongType()).add("tier", IntegerType()).add("ok", BooleanType()).add("attempts", IntegerType()),
            partitionBy=[PartitioningColumn("key")],
            orderBy=[OrderingColumn("tier")],
        )

    def __init__(self) -> None:
        self.row, self.attempts = None, 0

    def eval(self, row: Row) -> None:
        if self.row is None or not self.row[2]:
            self.row, self.attempts = (row["key"], row["tier"], bool(row["ok"])), self.attempts + 1

    def terminate(self):
        if self.row is not None:
            yield (*self.row, self.attempts)


def register(spark: SparkSession) -> None:
    """Make optimal_threshold, link_counts and first_tier known to the session's SQL."""
    from pyspark.sql.functions import udtf

    for name, kind in (("optimal_threshold", OptimalThreshold), ("link_counts", LinkCounts), ("first_tier", InFirstTier)):
        spark.udtf.register(name, udtf(kind))
