"""Embedding near-dedup with an inverted multi-index [operator 13].

Equal vectors collapse into one class. Codebooks of either half of the vectors, fitted on
a bounded sample, give a product grid; every class is in one cell. A class visits, nearest
first, the cells that a vector with the cosine asked for can be in, up to the reach that
gives the target recall; of two cells, the members of the smaller number visit the other,
so a pair meets at most once. Where members and visitors of a cell are many, they are
dealt out in chunks, and a task takes a chunk of members and a chunk of either: a cell
with a third of all rows is many tasks. A task verifies cosines by a matrix product and
returns link counts and a spanning forest, no pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, lean, read_table, small, stored, tidy
from .components import components
from .multi_index import Grid, fit, unit

#: Links have this cosine or more.
LEAST = 0.9
#: Share of the pairs at the cosine LEAST that the traversal is to find; pairs beyond it are found more often.
RECALL = 0.99
#: Codebooks are fitted on so many classes at most, chosen by a hash, and on so many bytes.
SAMPLE, SAMPLE_BYTES = 20_000, 1 << 26
#: Classes of a cell, about, and most codes of a codebook.
PER_CELL, CODES = 150, 256
#: Vectors of a chunk, about.
CHUNK = 1024

PACKED = "vec_id long, x binary, size int"
INDEXED = "rep long, copies long, x binary, size int, cell int, visits array<int>"
FOUND = "rep long, n long, other long"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column("v")
        kind = "<f4" if pa.types.is_float32(lists.type.value_type) else "<f8"
        flat, at = lists.values.to_numpy(zero_copy_only=False).astype(kind), lists.offsets.to_numpy()
        ok = lists.is_valid().to_numpy(zero_copy_only=False)
        raws = [flat[s:e].tobytes() if good else None for good, s, e in zip(ok, at, at[1:])]
        sizes = [int(e - s) if good else None for good, s, e in zip(ok, at, at[1:])]
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(raws, pa.binary()), pa.array(sizes, pa.int32())], names=["vec_id", "x", "size"])


def packed(df: DataFrame) -> DataFrame:
    """vec_id, x (the vector's bytes) and size of every row; x is null where the vector can't be linked: no id, null, empty, zero, or with a null or non-finite component."""
    kind = "float" if df.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    v = F.col("embedding").cast(f"array<{kind}>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    ok = F.col("vec_id").isNotNull() & finite & F.exists(v, lambda c: c != 0)
    return df.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(ok, v).alias("v")).mapInArrow(lean(_packed), PACKED)


def matrix(raws: list[bytes], size: int) -> np.ndarray:
    """Unit vectors of packed rows of one size."""
    return unit(np.frombuffer(b"".join(raws), "<f4" if len(raws[0]) == 4 * size else "<f8").reshape(-1, size))


def _indexed(grid: Grid):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 2048):
                part = b.slice(s, 2048)
                sizes = part.column("size").to_numpy()
                for size in np.unique(sizes):
                    rows = part.take(pa.array(np.flatnonzero(sizes == size)))
                    own, who, cells = grid.traverse(matrix(rows.column("x").to_pylist(), int(size)))
                    up = cells > own[who]
                    who, cells = who[up], cells[up]
                    by = np.argsort(who, kind="stable")
                    ends = np.concatenate([[0], np.cumsum(np.bincount(who, minlength=len(own)))])
                    visits = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(cells[by], pa.int32()))
                    yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("rep", "copies", "x", "size")), pa.array(own, pa.int32()), visits], names=["rep", "copies", "x", "size", "cell", "visits"])

    return run


def indexed(classes: DataFrame) -> DataFrame:
    """Every class with its cell and the cells it visits, stored."""
    n, longest = classes.agg(F.count("*"), F.max("size")).first()
    most = max(2, min(SAMPLE, SAMPLE_BYTES // (8 * (longest or 1))))
    rows = classes.orderBy(F.xxhash64("rep"), "rep").limit(most).select("x", "size").collect()
    sample = np.zeros((len(rows), longest or 2))
    for i, r in enumerate(rows):
        sample[i, : r.size] = matrix([r.x], r.size)
    k = min(CODES, 2 ** max(0, round(math.log2(max(n, 1) / PER_CELL) / 2)))
    grid = fit(sample, k, LEAST, RECALL) if len(rows) else Grid(np.zeros((1, 1)), np.zeros((1, 1)))
    return stored(classes.select("rep", "copies", "x", "size").mapInArrow(lean(_indexed(grid)), INDEXED), "multi-index")


def tiles(index: DataFrame) -> DataFrame:
    """A row for each class and tile it is in: size, cell, a, b, right (of chunk b and not a), rep, copies, x.

    A cell's members are chunks 0 .. own - 1, its visitors chunks own .. all - 1; tile
    (a, b) has two chunks, a of members, a <= b.
    """
    home = index.groupBy("size", "cell").agg(F.count("*").alias("members"))
    come = index.select("size", F.explode("visits").alias("cell")).groupBy("size", "cell").agg(F.count("*").alias("visitors"))
    own = F.ceil(F.col("members") / CHUNK)
    shape = stored(home.join(come, ["size", "cell"], "left").select("size", "cell", own.cast("int").alias("own"), (own + F.ceil(F.coalesce("visitors", F.lit(0)) / CHUNK)).cast("int").alias("all")), "shape")
    shape, salt = small(shape), F.xxhash64("rep")
    cols = ("size", "cell", "a", "b", "right", "rep", "copies", "x")
    inside = index.drop("visits").join(shape, ["size", "cell"]).withColumn("chunk", F.pmod(salt, "own").cast("int"))
    inside = inside.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("all") - 1))).withColumns({"a": F.least("chunk", "o"), "b": F.greatest("chunk", "o")})
    visits = index.select("size", "rep", "copies", "x", F.explode("visits").alias("cell")).join(shape, ["size", "cell"])
    visits = visits.withColumns({"b": (F.col("own") + F.pmod(salt, F.col("all") - F.col("own"))).cast("int"), "a": F.explode(F.sequence(F.lit(0), F.col("own") - 1)), "right": F.lit(True)})
    return inside.withColumn("right", F.col("chunk") > F.col("o")).select(*cols).union(visits.select(*cols))


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest node that it is joined with by the edges (i, j)."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _tile(t: pa.Table) -> pa.Table:
    size, a, b = (t.column(c)[0].as_py() for c in ("size", "a", "b"))
    x, copies, right = matrix(t.column("x").to_pylist(), size), t.column("copies").to_numpy(), t.column("right").to_numpy()
    rep = t.column("rep").to_numpy()
    left, other = np.flatnonzero(~right), np.flatnonzero(right)
    other = left if a == b else other
    hit = x[left] @ x[other].T >= LEAST
    if a == b:
        np.fill_diagonal(hit, False)
    n = np.zeros(len(rep), np.int64)
    n[left] += hit @ copies[other]
    if a != b:
        n[other] += hit.T @ copies[left]
    i, j = np.nonzero(hit)
    top = forest(left[i], other[j], len(rep))
    linked = np.flatnonzero(n)
    return pa.table({"rep": rep[linked], "n": n[linked], "other": rep[top[linked]]})


def vector_links(df: DataFrame) -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id (the smallest id reachable) and kept of every row.

    Links are the pairs with a cosine of LEAST or more, in double precision, that the index
    finds; each found pair is verified, none is kept below it. Vectors of different lengths
    aren't compared. Vectors that are null, empty, zero or have a null or non-finite
    component link with nothing, nor do rows without an id (their component is null, and
    they are kept). Rows with equal ids are vectors of their own with one component where
    they are linked. Only vec_id and embedding are read; an empty table gives no rows.
    """
    rows = stored(packed(df), "vectors")
    key = F.md5("x").alias("key")
    classes = stored(rows.filter("x is not null").groupBy(key).agg(F.first("x").alias("x"), F.first("size").alias("size"), F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "classes")
    # a row of its own for each class: ids that occur twice may lead two classes
    named = stored(classes.withColumn("id", F.col("rep")).withColumn("rep", F.monotonically_increasing_id()), "named")
    forget(classes)
    index = indexed(named)
    found = stored(tiles(index).groupBy("size", "cell", "a", "b").applyInArrow(_tile, FOUND), "found")
    forget(index)
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    comp = components(found.filter("rep <> other").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    linked = named.select("key", "rep", "id", "copies").join(small(counts), "rep", "left").join(small(comp.withColumnRenamed("node", "rep")), "rep", "left")
    linked = stored(linked.filter("n is not null or copies > 1"), "linked")
    least = linked.filter("comp is not null").groupBy("comp").agg(F.min("id").alias("least"))
    touched = linked.join(small(least), "comp", "left").select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least", "id").alias("component_id"))
    tidy()
    out = rows.select("vec_id", key).join(small(touched), "key", "left")
    component = F.coalesce("component_id", "vec_id").alias("component_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op13_multi_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links(read_table(spark, sf_dir, "embeddings"))


#: Every pair's cosine; components by the smallest label that travels along links.
OP13_SQL = f"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, embedding,
    CASE WHEN len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y))) = len(embedding) AND len(list_filter(embedding, lambda y: y <> 0)) > 0 AND vec_id IS NOT NULL
      THEN list_transform(embedding, lambda y: CAST(y AS DOUBLE)) END AS x
  FROM embeddings
), links AS MATERIALIZED (
  SELECT a.r AS r, b.r AS s, b.vec_id AS other FROM v a JOIN v b ON a.r <> b.r AND len(a.x) = len(b.x)
  WHERE list_dot_product(a.x, b.x) / sqrt(list_dot_product(a.x, a.x)) / sqrt(list_dot_product(b.x, b.x)) >= {LEAST}
), reach(r, s) AS (
  SELECT r, s FROM links UNION SELECT reach.r, links.s FROM reach JOIN links ON links.r = reach.s
), near AS (SELECT r, min(vec_id) AS least FROM (SELECT reach.r, v.vec_id FROM reach JOIN v ON v.r = reach.s) GROUP BY r),
counts AS (SELECT r, count(*) AS n FROM links GROUP BY r)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id, coalesce(vec_id <= least, true) AS kept
FROM v LEFT JOIN near USING (r) LEFT JOIN counts USING (r)
"""
