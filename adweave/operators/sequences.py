"""Order-dependent logic: streaks, latches, ladders, tiles, running deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def streaks(df: DataFrame, key: str, order: list[str], success: Column) -> DataFrame:
    """df with streak, the number of failures in a row up to each row; a success resets it."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = df.withColumn("__ok", success).withColumn("__island", F.sum(F.col("__ok").cast("int")).over(w))
    v = Window.partitionBy(key, "__island").orderBy(*order)
    return marked.withColumn("streak", F.sum((~F.col("__ok")).cast("long")).over(v)).drop("__ok", "__island")


def latch(df: DataFrame, key: str, order: list[str], amount: Column, cap: float) -> DataFrame:
    """df with spent, the running total, and tripped: the cap was reached now or before. A cap of 0 or less never trips."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    spent = df.withColumn("spent", F.sum(amount).over(w))
    return spent.withColumn("tripped", F.max((F.col("spent") >= cap) & F.lit(cap > 0)).over(w))


def first_hit_else_best(df: DataFrame, key: str, order: str, hit: Column, score: Column, value: str) -> DataFrame:
    """For each key the value of the first row (by order) that is a hit, else that of the highest score."""
    first = F.min(F.when(hit, F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    best = F.max(F.struct(score.alias("s"), (-F.col(order)).alias("o"), F.col(value).alias("v")))
    return df.groupBy(key).agg(F.coalesce(first["v"], best["v"]).alias(value), first.isNotNull().alias("hit"))


def tiles(df: DataFrame, height: Column, tile: int, overlap: int) -> DataFrame:
    """A row per tile: its number and top, stepping tile - overlap until the bottom is covered."""
    step = tile - overlap
    n = F.greatest(F.ceil((height - overlap) / step), F.lit(1)).cast("int")
    return df.select("*", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: i * step)).alias("tile", "top"))


def until_superset(df: DataFrame, key: str, order: list[str], item: str, wanted: int) -> DataFrame:
    """Rows up to and with the first one at which a key has shown wanted distinct items."""
    w = Window.partitionBy(key).orderBy(*order)
    first = F.row_number().over(Window.partitionBy(key, item).orderBy(*order)) == 1
    seen = df.withColumn("__f", first.cast("int")).withColumn("__n", F.sum("__f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return seen.filter((F.col("__n") - F.col("__f")) < wanted).drop("__f", "__n")
