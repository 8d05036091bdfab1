"""Centroid clustering with dual trees [operator 11].

Vectors become integers, are dealt out in blocks of neighbours (the signed coordinate of
the largest size, a cross-polytope hash, is the leading key) and stored with a cover tree
for each block: a forest over all vectors, built once. In each round of Lloyd's iteration
a tree over the centroids meets the trees of all blocks; pairs of nodes are pruned by
bounds on their distances, a node with one centroid left counts as a whole, and leaf pairs
are compared exactly. A task sends sums and counts for each centroid only. All sums and
distances are exact integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, lean, read_table, stored
from .cover_tree import Tree, build, centroid_tree, nearest, spread, squares

#: Centroids, rounds, components, and the factor before rounding down, of op11.
CENTROIDS, ROUNDS, SIZE, FACTOR = 40, 5, 64, 256
#: Vectors of a block.
BLOCK = 1024
#: Largest size of an integer component; beyond, squared distances may not fit in 64 bits.
LARGEST = 2**27

KEPT = "vec_id long, x binary, cell int"
BLOCKS = "ids array<long>, x binary, nodes binary, lengths binary"
SUMS = "cluster int, n long, total array<long>"
ASSIGNED = "vec_id long, cluster int, distance long"


def _kept(size: int, factor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("v")
            flat = np.asarray(lists.values.to_numpy(zero_copy_only=False), np.float64)[lists.offsets[0].as_py() : lists.offsets[len(lists)].as_py()] if len(lists) else np.zeros(0)
            with np.errstate(over="ignore"):
                x = np.floor(flat * factor).reshape(-1, size)
            if len(x) and np.abs(x).max() > LARGEST:
                raise ValueError(f"a component is beyond {LARGEST // factor} in size: squared distances would not fit in 64 bits")
            x = x.astype("<i4")
            lead = np.abs(x).argmax(1) if len(x) else np.zeros(0, int)
            cell = 2 * lead + (x[np.arange(len(x)), lead] < 0)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(cell, pa.int32())], names=["vec_id", "x", "cell"])

    return run


def vectors(df: DataFrame, size: int = SIZE, factor: int = FACTOR) -> DataFrame:
    """vec_id, x (little-endian 32-bit integers floor(factor * component)) and cell of the rows whose vector has exactly size components, none null or non-finite."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter((F.size("v") == size) & finite)
    return rows.mapInArrow(lean(_kept(size, factor)), KEPT)


def _blocks(size: int):
    def block(ids: list, raws: list[bytes]) -> pa.RecordBatch:
        t = build(np.frombuffer(b"".join(raws), "<i4").reshape(-1, size).astype(np.int64))
        nodes = np.stack([t.at, t.start, t.end, t.first, t.count]).astype("<i4").tobytes()
        return pa.RecordBatch.from_arrays(
            [pa.array([[ids[i] for i in t.order]], pa.list_(pa.int64())), pa.array([t.points.astype("<i4").tobytes()]), pa.array([nodes]), pa.array([np.stack([t.radius, t.up]).astype("<f8").tobytes()])],
            names=["ids", "x", "nodes", "lengths"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, raws = [], []
        for b in batches:
            ids += b.column("vec_id").to_pylist()
            raws += b.column("x").to_pylist()
            while len(ids) >= BLOCK:
                yield block(ids[:BLOCK], raws[:BLOCK])
                ids, raws = ids[BLOCK:], raws[BLOCK:]
        if ids:
            yield block(ids, raws)

    return run


def _trees(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, Tree]]:
    for b in batches:
        for i in range(b.num_rows):
            x = np.frombuffer(b.column("x")[i].as_py(), "<i4").reshape(-1, size).astype(np.int64)
            nodes = np.frombuffer(b.column("nodes")[i].as_py(), "<i4").reshape(5, -1).astype(np.int64)
            yield b.column("ids")[i].values, Tree(x, np.arange(len(x)), *nodes, *np.frombuffer(b.column("lengths")[i].as_py(), "<f8").reshape(2, -1))


def _summed(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, number = centroid_tree(centroids)
        n, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for _, t in _trees(batches, centroids.shape[1]):
            whole, point, place, _ = nearest(t, centres, number)
            for node, at in whole:
                np.add.at(n, number[at], t.end[node] - t.start[node])
                np.add.at(total, number[at], t.total[t.end[node]] - t.total[t.start[node]])
            np.add.at(n, number[place], 1)
            np.add.at(total, number[place], t.points[point])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(n)), pa.int32()), pa.array(n), pa.array([*total], pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    return run


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, number = centroid_tree(centroids)
        for ids, t in _trees(batches, centroids.shape[1]):
            whole, point, place, _ = nearest(t, centres, number)
            at = np.empty(len(t.points), np.int64)
            at[point] = place
            for node, p in whole:
                which, points = spread(t.start[node], t.end[node] - t.start[node])
                at[points] = p[which]
            far = squares(t.points, np.arange(len(at)), centres.points, at)
            yield pa.RecordBatch.from_arrays([ids, pa.array(number[at], pa.int32()), pa.array(far)], names=["vec_id", "cluster", "distance"])

    return run


def forest(kept: DataFrame, size: int = SIZE) -> DataFrame:
    """The stored blocks of kept vectors, each with its cover tree. Ranges of cells are split by a hash of the id, so no cell is one task's."""
    return stored(kept.repartitionByRange("cell", F.xxhash64("vec_id", "x")).mapInArrow(lean(_blocks(size)), BLOCKS), "forest")


def start_centroids(kept: DataFrame, k: int, seed: str = "2:") -> np.ndarray:
    """The k vectors with the smallest sha256 of seed and id, in the order of the hash (ties: of the vector's bytes)."""
    first = kept.filter("vec_id is not null").select(F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256).alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return np.array([np.frombuffer(r.x, "<i4") for r in first], np.int64)


def lloyd_round(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: componentwise floor(sum / count) of their vectors; those without a vector stay."""
    part = blocks.mapInArrow(lean(_summed(centroids)), SUMS).filter("n > 0").select("cluster", "n", F.posexplode("total").alias("i", "part"))
    out = centroids.copy()
    for r in part.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("part").alias("total")).collect():  # a row for each component of each centroid
        out[r.cluster, r.i] = r.total // r.n
    return out


def cluster(df: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, size: int = SIZE, factor: int = FACTOR) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster and distance (squared) of every kept vector, stored, and the final centroids.

    Only vec_id and embedding are read; vectors that are null, of another length or with a
    null or non-finite component are left out. Rows with equal ids count as vectors of
    their own. A row with a null id is clustered but is no starting centroid. Fewer than k
    kept vectors give as many centroids; equal centroids keep their numbers, the smallest
    gets the vectors. An empty table gives no rows. Components beyond LARGEST / factor in
    size raise ValueError, as distances would not fit in a long.
    """
    kept = stored(vectors(df, size, factor), "vectors")
    centroids = start_centroids(kept, k)
    if not len(centroids):
        return df.sparkSession.createDataFrame([], ASSIGNED), centroids
    blocks = forest(kept, size)
    forget(kept)
    for _ in range(rounds):
        centroids = lloyd_round(blocks, centroids)
    out = stored(blocks.mapInArrow(lean(_assigned(centroids)), ASSIGNED), "assigned")
    forget(blocks)
    return out, centroids


def clustered(df: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, size: int = SIZE, factor: int = FACTOR) -> DataFrame:
    """cluster()'s rows with cluster_inertia, inertia and centroid_sha256 (of the centroid's components as decimal integers joined by commas)."""
    rows, centroids = cluster(df, k, rounds, size, factor)
    sums = {r.cluster: r.total for r in rows.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}  # a row for each centroid
    digest = [(c, total, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, total in sums.items()]
    about = df.sparkSession.createDataFrame(digest, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_dual_tree_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(read_table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    """DuckDB SQL of op11: every distance in every round."""
    steps = [
        f"v AS (SELECT vec_id, list_transform(embedding, lambda y: CAST(floor({FACTOR} * CAST(y AS DOUBLE)) AS BIGINT)) AS x FROM embeddings"
        f" WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y))) = {SIZE})",
        f"c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id), x) - 1 AS INTEGER) AS cluster, x FROM v WHERE vec_id IS NOT NULL QUALIFY cluster < {CENTROIDS})",
        "e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, x FROM v)",
    ]
    for i in range(ROUNDS + 1):
        steps.append(
            f"a{i} AS MATERIALIZED (SELECT r, vec_id, e.x, min(struct_pack(d := CAST(list_sum(list_transform(list_zip(e.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), c := cluster)) AS best"
            f" FROM e, c{i} c GROUP BY ALL)"
        )
        if i < ROUNDS:
            steps += [
                f"s{i} AS (SELECT best.c AS cluster, i, sum(x[i]) AS s, count(*) AS n FROM a{i}, range(1, {SIZE + 1}) t(i) GROUP BY ALL)",
                f"m{i} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM s{i} GROUP BY cluster)",
                f"c{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m ON m.cluster = c.cluster)",
            ]
    return (
        f"WITH {', '.join(steps)} SELECT vec_id, cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,"
        f" sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.cluster = a.best.c"
    )


OP11_SQL = _oracle()
