"""Upserts, cascades and other writes as rewrites of a keyed table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(target: DataFrame, source: DataFrame, keys: list[str], update: dict[str, Callable[[Column, Column], Column]] | None = None) -> DataFrame:
    """target after the rows of source: new keys inserted, columns of known ones replaced.

    update: how a column comes of (old, new); other columns take the new value unless it
    is null. source needs one row a key.
    """
    update = update or {}
    t = target.select(*[F.col(c).alias(f"t_{c}") for c in target.columns], F.lit(True).alias("__t"))
    s = source.select(*[F.col(c).alias(f"s_{c}") for c in source.columns], F.lit(True).alias("__s"))
    on = [F.col(f"t_{k}").eqNullSafe(F.col(f"s_{k}")) for k in keys]
    j = t.join(s, on, "full_outer")
    out = []
    for c in target.columns:
        old, new = F.col(f"t_{c}"), F.col(f"s_{c}") if c in source.columns else F.lit(None)
        if c in keys:
            out.append(F.when(F.col("__t"), old).otherwise(new).alias(c))
        elif c in update:
            both = F.col("__t") & F.col("__s")
            out.append(F.when(both, update[c](old, new)).otherwise(F.when(F.col("__t"), old).otherwise(new)).alias(c))
        else:
            out.append(F.coalesce(new, old).alias(c))
    return j.select(*out)


def delete_cascade(deleted: DataFrame, key: str, children: list[tuple[DataFrame, str, str]]) -> list[DataFrame]:
    """The children after the rows of deleted went. A child is (frame, its foreign key, 'cascade' or 'set null')."""
    gone = deleted.select(F.col(key).alias("__k")).distinct()
    out = []
    for child, fk, rule in children:
        if rule == "cascade":
            out.append(child.join(gone, child[fk] == gone["__k"], "left_anti"))
        else:
            j = child.join(gone, child[fk] == gone["__k"], "left")
            out.append(j.select(*[F.when(F.col("__k").isNull(), F.col(c)).alias(c) if c == fk else F.col(c) for c in child.columns]))
    return out


def checked_fk(rows: DataFrame, fk: str, dim: DataFrame, dim_key: str) -> DataFrame:
    """rows with foreign keys that the dimension lacks set to null, as a bulk insert retries them."""
    known = dim.select(F.col(dim_key).alias("__d")).distinct()
    j = rows.join(known, rows[fk] == known["__d"], "left")
    return j.select(*[F.when(F.col("__d").isNotNull(), F.col(c)).alias(c) if c == fk else F.col(c) for c in rows.columns])


def merged_maps(old: Column, new: Column) -> Column:
    """Shallow merge of two maps, the new one winning."""
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.coalesce(F.map_contains_key(new, k), F.lit(False))), new)


def prune(cache: DataFrame, active: DataFrame, key: str) -> DataFrame:
    """cache without rows whose key isn't active; the whole cache if nothing is active."""
    if active.isEmpty():
        return cache
    return cache.join(active.select(key).distinct(), key, "left_semi")
