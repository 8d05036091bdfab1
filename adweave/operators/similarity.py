"""Similarity joins of hashes and vectors, exact, without cross joins and without broadcasts that grow.

A reference of few rows goes to the tasks as one array of a checked size. Beyond that,
hashes within a small distance meet by multi-index hashing, and vectors by a pivot index;
where no index can prune, both sides are dealt out in chunks, and a task takes one chunk
of either.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Reference hashes and vectors that go to every task as an array, at most (0.5 MB, and 8 MB at 1,024 components).
FEW_HASHES, FEW_VECTORS = 65_536, 1_024
#: Rows of a chunk, about.
CHUNK = 4_096
#: Bits of a part of a hash from which multi-index hashing prunes enough.
PART_BITS = 8
#: Pivots of the vector index.
PIVOTS = 64
#: Angles and cosines in bounds may be wrong by so much; far above rounding.
SLACK = 1e-6

BITS = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)  # numpy before 2.0 has no count of bits


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of 64-bit numbers."""
    x = np.bitwise_xor.outer(a.view(np.uint64), b.view(np.uint64))
    return BITS[np.ascontiguousarray(x).view(np.uint16).reshape(*x.shape, 4)].sum(-1, dtype=np.uint8)


def near_any(own: np.ndarray, ref: np.ndarray, most: int, step: int = 256) -> np.ndarray:
    """Whether each number of own is within `most` bits of any of ref; rows that have met one are left out of the later steps."""
    found = np.zeros(len(own), bool)
    for s in range(0, len(ref), step):
        left = np.flatnonzero(~found)
        if not len(left):
            break
        found[left] = (distances(own[left], ref[s : s + step]) <= most).any(1)
    return found


def deal(left: DataFrame, right: DataFrame, salt: tuple[str, str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows of both sides (same columns) with the tiles they are in: keys, a, b and `right`.

    Within each value of keys, a side of n rows is n / CHUNK chunks, by a hash of its salt
    column; tile (a, b) has chunk a of the left and chunk b of the right side. Keys that
    only one side has are left out.
    """
    n = [x.groupBy(*keys).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias(c)) for x, c in ((left, "na"), (right, "nb"))]
    if keys:
        shape = n[0].join(n[1], list(keys))
        a, b = left.join(shape, list(keys)), right.join(shape, list(keys))
    else:
        na, nb = (max(1, x.first()[0]) for x in n)
        a, b = (x.withColumns({"na": F.lit(na), "nb": F.lit(nb)}) for x in (left, right))
    own = lambda c, m: F.pmod(F.xxhash64(c), F.col(m)).cast("int")
    all_ = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    a = a.withColumn("a", own(salt[0], "na")).withColumn("b", all_("nb")).withColumn("right", F.lit(False))
    b = b.withColumn("b", own(salt[1], "nb")).withColumn("a", all_("na")).withColumn("right", F.lit(True))
    return a.drop("na", "nb").unionByName(b.drop("na", "nb"))


def parts(h: Column, n: int, bits: int) -> Column:
    """The n parts of a hash of so many bits, each with its number."""
    edges = [round(i * bits / n) for i in range(n + 1)]
    return F.array(*[F.struct(F.lit(i).alias("i"), F.shiftrightunsigned(h, s).bitwiseAND(F.lit(-1 if e - s == 64 else (1 << (e - s)) - 1)).alias("v")) for i, (s, e) in enumerate(zip(edges, edges[1:]))])


def hashes_near(rows: DataFrame, col: str, reference: DataFrame, ref_col: str, most: int, bits: int = 64) -> DataFrame:
    """The distinct values of rows' col (long) within `most` bits of any value of the reference; nulls are near nothing.

    Tight limits: of most + 1 parts of two such hashes one is equal (multi-index hashing).
    """
    own = rows.select(F.col(col).cast("long").alias("h")).filter("h is not null").distinct()
    ref = reference.select(F.col(ref_col).cast("long").alias("r")).filter("r is not null").distinct()
    few = ref.limit(FEW_HASHES + 1).count()
    if few <= FEW_HASHES:
        known = np.array([r[0] for r in ref.collect()], np.int64)

        def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(near_any(b.column(0).to_numpy(), known, most)))

        return own.mapInArrow(direct, "h long")
    if bits // (most + 1) >= PART_BITS:
        key = ("i", "v")
        a = own.select("h", F.inline(parts(F.col("h"), most + 1, bits)))
        b = ref.select("r", F.inline(parts(F.col("r"), most + 1, bits)))
        return a.join(b, list(key)).filter(F.bit_count(F.col("h").bitwiseXOR(F.col("r"))) <= most).select("h").distinct()

    def tile(t: pa.Table) -> pa.Table:
        right, h = t.column("right").to_numpy(), t.column("h").to_numpy()
        mine = h[~right]
        return pa.table({"h": mine[near_any(mine, h[right], most)]})

    tiles = deal(own, ref.withColumnRenamed("r", "h"), ("h", "h"))
    return tiles.groupBy("a", "b").applyInArrow(tile, "h long").distinct()


# vectors


def _matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of lists of one length."""
    lists = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def rounded(x: np.ndarray, digits: int = 6) -> np.ndarray:
    return np.floor(x * 10**digits + 0.5) / 10**digits


Judge = Callable[[np.ndarray, np.ndarray, np.ndarray], list]


def _any_at(least: float) -> Judge:
    def judge(own: np.ndarray, ref: np.ndarray, cos: np.ndarray) -> list:
        hit = (cos >= least) & (own[:, None] != ref)
        k = np.flatnonzero(hit.any(1))
        first = hit[k].argmax(1)
        return [own[k], ref[first], cos[k, first]]

    return judge


def _best(own: np.ndarray, ref: np.ndarray, cos: np.ndarray) -> list:
    order = np.argsort(ref, kind="stable")
    at = cos[:, order].argmax(1)  # the first of the largest, so the smallest reference
    top = cos[np.arange(len(own)), order[at]]
    k = np.flatnonzero(top > 0)
    return [own[k], ref[order[at[k]]], top[k]]


def _compare(rows: DataFrame, reference: DataFrame, judge: Judge, reach: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """id, ref and score of what judge takes of each chunk pair. rows, reference: id (long) and v (unit vectors of one length).

    reach: from the cosines of a row to all pivots, the angle from which a reference can
    no longer matter to it.
    """
    out = "id long, ref long, score double"
    count = reference.limit(FEW_VECTORS + 1).count()
    if count == 0:
        return rows.sparkSession.createDataFrame([], out)
    if count <= FEW_VECTORS:
        known = reference.collect()
        ids, m = np.array([r["id"] for r in known], np.int64), np.array([r["v"] for r in known], np.float64)

        def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in judge(b.column("id").to_numpy(), ids, rounded(_matrix(b.column("v")) @ m.T))], names=["id", "ref", "score"])

        return rows.mapInArrow(direct, out)
    pivots = np.array([r.v for r in reference.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect()], np.float64)
    angles = lambda x: np.arccos(np.clip(x @ pivots.T, -1, 1))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                far = angles(_matrix(b.column("v")))
                cell = far.argmin(1)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(cell, pa.int32()), pa.array(far.min(1))], names=["id", "v", "cell", "far"])

    kind = dict(reference.dtypes)["v"]
    placed = reference.mapInArrow(place, f"id long, v {kind}, cell int, far double")
    ring = {r.cell: (r.least, r.most) for r in placed.groupBy("cell").agg(F.min("far").alias("least"), F.max("far").alias("most")).collect()}  # PIVOTS rows at most
    used = np.array(sorted(ring))
    low, high = (np.array([ring[c][k] for c in used]) for k in (0, 1))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cells whose ring the row's own reach meets: by the triangle inequality no other reference can matter."""
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("v"))
                far, own = angles(x), reach(x @ pivots.T)[:, None]
                meets = (far[:, used] - high <= own + SLACK) & (low - far[:, used] <= own + SLACK)
                who, cell = np.nonzero(meets)
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(who)), b.column("v").take(pa.array(who)), pa.array(used[cell], pa.int32())], names=["id", "v", "cell"])

    def tile(t: pa.Table) -> pa.Table:
        right, ids, x = t.column("right").to_numpy(), t.column("id").to_numpy(), _matrix(t.column("v"))
        return pa.table(dict(zip(("id", "ref", "score"), judge(ids[~right], ids[right], rounded(x[~right] @ x[right].T)))))

    visits = rows.mapInArrow(visit, f"id long, v {kind}, cell int")
    return deal(visits, placed.drop("far"), ("id", "id"), ("cell",)).groupBy("cell", "a", "b").applyInArrow(tile, out)


def vectors_near(rows: DataFrame, reference: DataFrame, least: float) -> DataFrame:
    """Ids of the rows (id, v) with a cosine, at six digits, of `least` or more to a reference (id, v) of another id. All are unit vectors of one length."""
    angle = math.acos(max(-1.0, min(1.0, least - SLACK)))
    return _compare(rows, reference, _any_at(least), lambda cos: np.full(len(cos), angle)).select("id").distinct()


def best_vector(rows: DataFrame, reference: DataFrame) -> DataFrame:
    """id, ref and score: the reference of the largest cosine (six digits) above 0 for each row, of equal ones the smallest id.

    Pivots are references themselves: the nearest one bounds how far the best can be.
    """
    found = _compare(rows, reference, _best, lambda cos: np.arccos(np.clip(cos.max(1) - SLACK, -1, 1)))
    top = found.groupBy("id").agg(F.max(F.struct("score", (-F.col("ref")).alias("m"))).alias("b"))
    return top.select("id", (-F.col("b.m")).alias("ref"), "b.score")
