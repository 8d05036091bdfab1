"""Joins that need more than an equality: text containment, tiers, containment of sets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A reference table of so many rows at most is broadcast; a larger one must come through an equality first.
BROADCAST_ROWS = 100_000


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it is counted to have so many rows at most, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def grams(text: Column, n: int) -> Column:
    """Distinct runs of n characters of a text."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n))))


def _inside(inner: DataFrame, outer: DataFrame, gram: int) -> DataFrame:
    """x and y for each string x of inner that a string y of outer contains. Both have distinct, non-empty strings (s).

    Every x is looked up by one run of characters of its own, the one that the fewest y
    hold; an x shorter than a run is looked up as a whole.
    """
    short = [r[0] for r in inner.select(F.length("s").alias("k")).filter(F.col("k") < gram).distinct().collect()]  # fewer than gram numbers
    runs = outer.select(F.col("s").alias("y"), F.explode(F.concat(*[grams(F.col("s"), k) for k in (gram, *short)])).alias("g")).filter(F.length("g") > 0).distinct()
    often = runs.groupBy("g").agg(F.count("*").alias("n"))
    probes = inner.select(F.col("s").alias("x"), F.explode(F.when(F.length("s") < gram, F.array("s")).otherwise(grams(F.col("s"), gram))).alias("g"))
    probes = probes.join(often, "g").groupBy("x").agg(F.min_by("g", F.struct("n", "g")).alias("g"))
    return probes.join(runs, "g").filter(F.contains("y", F.col("x"))).select("x", "y")


def contains_first(rows: DataFrame, id_col: str, text_col: str, names: DataFrame, name_col: str, order_col: str, out_cols: list[str], gram: int = 3) -> DataFrame:
    """Each row with the first name (by order_col) that its text contains or that contains its text.

    Exact names win over contained ones; letter case doesn't count. Empty texts match the
    first name, empty names every text. Null texts and null names match nothing. Rows
    without a match have nulls. Candidates come from hash joins of distinct strings on
    runs of gram characters, one rare run a string, not from a cross product.
    """
    text = F.lower(F.col(text_col))
    cols = [F.col(c).alias(f"__v_{c}") for c in out_cols]
    right = names.filter(F.col(name_col).isNotNull()).select(F.lower(F.col(name_col)).alias("n"), F.struct(F.col(order_col).alias("o"), *cols).alias("v")).groupBy("n").agg(F.min("v").alias("v"))
    texts, known = rows.filter((text != "") & text.isNotNull()).select(text.alias("s")).distinct(), right.filter("n <> ''").select(F.col("n").alias("s"))
    pairs = _inside(known, texts, gram).select(F.col("y").alias("t"), F.col("x").alias("n")).unionByName(_inside(texts, known, gram).select(F.col("x").alias("t"), F.col("y").alias("n")))
    hits = pairs.join(right, "n").select("t", F.struct((F.col("t") != F.col("n")).alias("other"), "v").alias("b"))
    of_empty = right.filter("n = ''").select(F.struct(F.lit(True).alias("other"), "v").alias("b"))  # one row at most
    first = right.agg(F.struct(F.lit(True).alias("other"), F.min("v").alias("v")).alias("b")).filter("b.v is not null")
    hits = hits.unionByName(texts.select(F.col("s").alias("t")).crossJoin(F.broadcast(of_empty))).unionByName(first.select(F.lit("").alias("t"), "b"))
    best = hits.groupBy("t").agg(F.min("b").alias("__b"))
    return rows.withColumn("__t", text).join(best.withColumnRenamed("t", "__t"), "__t", "left").select(*rows.columns, *[F.col(f"__b.v.__v_{c}").alias(c) for c in out_cols])


def tiered(rows: DataFrame, key: str, tiers: list[tuple[str, DataFrame]], value: str) -> DataFrame:
    """rows with the value of the first tier that has key, and the tier's label ('none' if no tier has it)."""
    out, parts = rows, []
    for label, tier in tiers:
        name = f"__{label}"
        out = out.join(tier.select(F.col(key), F.col(value).alias(name)).filter(F.col(value).isNotNull()).dropDuplicates([key]), key, "left")
        parts.append((label, name))
    found = F.coalesce(*[F.col(n) for _, n in parts]).alias(value)
    which = F.lit("none")
    for label, n in reversed(parts):
        which = F.when(F.col(n).isNotNull(), label).otherwise(which)
    return out.select(*rows.columns, found, which.alias("tier"))


def first_superset(requested: DataFrame, covered: DataFrame, group: str, key: str, order: str, newest: int) -> DataFrame:
    """The newest group (by order, among the newest so many) whose keys hold all requested ones; no row if none or nothing is requested."""
    wanted = requested.select(key).filter(F.col(key).isNotNull()).distinct()
    groups = covered.select(group, order).distinct().orderBy(F.desc(order), F.desc(group)).limit(newest)
    n = wanted.agg(F.count("*").alias("__n"))
    have = covered.join(F.broadcast(groups.select(group)), group, "left_semi").select(group, order, key).distinct().join(wanted, key, "left_semi").groupBy(group, order).agg(F.count("*").alias("__k"))
    return have.crossJoin(n).filter((F.col("__k") == F.col("__n")) & (F.col("__n") > 0)).orderBy(F.desc(order), F.desc(group)).limit(1).select(group)


def first_per(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key; Spark cuts the groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


def maybe_single(df: DataFrame, key: str, value: object) -> dict | None:
    """The one row with key equal to value, None if there is none; raises if there are several."""
    rows = df.filter(F.col(key) == value).limit(2).collect()
    if len(rows) > 1:
        raise LookupError(f"several rows with {key} = {value!r}")
    return rows[0].asDict() if rows else None


def single(df: DataFrame, key: str, value: object) -> dict:
    """As maybe_single, but raises if there is no row."""
    row = maybe_single(df, key, value)
    if row is None:
        raise LookupError(f"no row with {key} = {value!r}")
    return row


def resolved_in_tiers(rows: DataFrame, key: str, tiers: list[tuple[str, Callable[[DataFrame], DataFrame]]], value: str) -> DataFrame:
    """rows (one a key) with value and tier. Each tier is a function from the keys that are still open to key and value; what no tier knows has nulls."""
    open_, parts = rows.select(key), []
    for label, tier in tiers:
        got = tier(open_).select(key, value).filter(F.col(value).isNotNull()).dropDuplicates([key]).withColumn("tier", F.lit(label))
        parts.append(got)
        open_ = open_.join(got.select(key), key, "left_anti")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return rows.join(found, key, "left")
