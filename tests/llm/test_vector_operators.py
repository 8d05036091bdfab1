"""Clustering and near-duplicate links of vectors against brute force."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from adweave.llm import clustering, vector_dedup
from adweave.llm.cover_tree import build, centroid_tree, nearest
from adweave.llm.multi_index import Grid, codebook, fit, unit

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)


# clustering


def by_hand(rows, k, rounds, size, factor=256):
    ok = [(i, [math.floor(factor * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), n) for n, (i, _) in enumerate(ok) if i is not None)[:k]
    centres = [list(ok[n][1]) for _, n in first]
    assign = lambda: [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres)) for _, v in ok]
    for _ in range(rounds):
        at = assign()
        for j in range(len(centres)):
            if own := [v for (_, v), (_, x) in zip(ok, at) if x == j]:
                centres[j] = [sum(z) // len(own) for z in zip(*own)]
    return [(i, j, d) for (i, _), (d, j) in zip(ok, assign())], centres


def test_clustering(spark, monkeypatch):
    """Clumps, equal rows, ties, equal centroids and odd rows, over many blocks."""
    monkeypatch.setattr(clustering, "BLOCK", 37)
    rng = np.random.default_rng(3)
    clumps = rng.normal(size=(6, 5))
    rows = [(i, [float(x) for x in clumps[i % 6] + rng.normal(scale=0.02 * (i % 4), size=5)]) for i in range(300)]
    rows += [(300 + i, [1.0, 0.0, 0.0, 0.0, (-1.0) ** i]) for i in range(60)]
    rows += [(7, rows[7][1]), (8, rows[9][1]), (None, rows[3][1]), (None, None), (900, None), (901, [1.0] * 4), (902, [1.0, None, 0.0, 0.0, 0.0]), (903, [math.nan] * 5), (904, [math.inf] * 5), (905, [])]
    df = table(spark, rows).withColumn("cluster", F.lit("clash")).withColumn("x", F.lit("clash"))
    for k, rounds in ((9, 4), (1, 1), (400, 2)):
        want, centres = by_hand(rows, k, rounds, 5)
        got = clustering.clustered(df, k=k, rounds=rounds, size=5).collect()
        key = lambda r: (str(r[0]), *r[1:])
        assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=key) == sorted(want, key=key)
        assert {r.inertia for r in got} == {sum(d for *_, d in want)}
        for r in got:
            assert r.cluster_inertia == sum(d for _, j, d in want if j == r.cluster)
            assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centres[r.cluster])).encode()).hexdigest()
    assert clustering.clustered(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="64 bits"):
        clustering.clustered(table(spark, [(1, [1e9] * 5)]), size=5).collect()


def test_cover_tree_and_pruning():
    """Children lie within half their parent's scale of their points and apart from each other; clumps cost fewer distances than points times centroids."""
    rng = np.random.default_rng(5)
    points = (rng.integers(0, 8, (700, 1)) * 4000 + rng.integers(-9, 10, (700, 6))).astype(np.int64)
    t = build(points)
    assert sorted(t.order) == list(range(700)) and (t.points == points[t.order]).all()
    for k in range(len(t.at)):
        own = t.points[t.start[k] : t.end[k]]
        assert np.sqrt(((own - t.points[t.at[k]]) ** 2).sum(1)).max() <= t.radius[k] + 1e-6
        if t.count[k]:
            kids = range(t.first[k], t.first[k] + t.count[k])
            half = 2.0 ** (math.ceil(math.log2(t.radius[k])) - 1)
            assert t.at[kids[0]] == t.at[k] and sum(t.end[j] - t.start[j] for j in kids) == len(own)
            assert all(t.radius[j] <= half for j in kids)
            assert all(math.dist(t.points[t.at[i]], t.points[t.at[j]]) > half for i in kids for j in kids if i < j)
    centroids = points[::35]
    centres, number = centroid_tree(centroids)
    whole, point, place, work = nearest(t, centres, number)
    got = np.full(700, -1)
    got[point] = number[place]
    for node, at in whole:
        for n, p in zip(node, at):
            assert (got[t.start[n] : t.end[n]] == -1).all()
            got[t.start[n] : t.end[n]] = number[p]
    assert (got == ((t.points[:, None] - centroids) ** 2).sum(2).argmin(1)).all() and work < 700 * len(centroids) / 2


# near-duplicate links


def links_by_hand(rows):
    ok = [n for n, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    vec = {n: np.float32(rows[n][1]).astype(float) for n in ok}
    near = {n: [m for m in ok if m != n and len(vec[m]) == len(vec[n]) and vec[n] @ vec[m] / math.sqrt(vec[n] @ vec[n]) / math.sqrt(vec[m] @ vec[m]) >= 0.9] for n in ok}
    out = []
    for n, (i, _) in enumerate(rows):
        seen, todo = {n}, [n]
        while todo:
            todo += (new := set(near.get(todo.pop(), ())) - seen)
            seen |= new
        least = min((rows[m][0] for m in seen if rows[m][0] is not None), default=None)
        out.append((i, len(near.get(n, ())), least, i is None or i == least))
    return out


def clumps(rng, n, size):
    """n vectors, a third of them near copies of one vector, others of ten."""
    base = rng.normal(size=(11, size))
    return [(i, [float(x) for x in (base[0] + rng.normal(scale=0.1, size=size) if i % 3 == 0 else base[1 + i % 10] + rng.normal(scale=0.25 if i % 2 else 2, size=size))]) for i in range(n)]


@pytest.mark.parametrize("per_cell", [10_000, 20])
def test_vector_links(spark, monkeypatch, per_cell):
    """One cell and many, chunks of a hot cell, copies, scaled copies, odd rows; every found link is a real one."""
    monkeypatch.setattr(vector_dedup, "CHUNK", 40)
    monkeypatch.setattr(vector_dedup, "PER_CELL", per_cell)
    monkeypatch.setattr(vector_dedup, "RECALL", 1.0)
    rng = np.random.default_rng(8)
    rows = clumps(rng, 400, 12)
    rows += [(500 + i, rows[7][1]) for i in range(100)] + [(1000 + i, [3.5 * x for x in rows[8][1]]) for i in range(3)]
    rows += [(5, rows[6][1]), (5, rows[5][1]), (None, rows[0][1]), (None, None), (2000, None), (2001, []), (2002, [0.0] * 12), (2003, [None, *[1.0] * 11]), (2004, [math.nan] * 12), (2005, [math.inf] * 12), (2006, [1.0]), (2007, [2.0]), (2008, [1e-30] * 12), (2009, [1e30] * 12)]
    df = table(spark, rows).withColumns({"x": F.lit("clash"), "n_links": F.lit("clash")})
    key = lambda r: [str(x) for x in r]
    got = sorted((tuple(r) for r in vector_dedup.vector_links(df).collect()), key=key)
    assert got == sorted(links_by_hand(rows), key=key)
    assert vector_dedup.vector_links(df.limit(0)).count() == 0


def test_recall_of_the_hardest_pairs(spark, monkeypatch):
    """Partners at cosines of 0.9 to 0.92 in a table without other links: the recall is above 0.9, in 256 cells."""
    monkeypatch.setattr(vector_dedup, "PER_CELL", 10)
    rng = np.random.default_rng(9)
    x = unit(rng.normal(size=(1500, 64)))
    way = rng.normal(size=x.shape)
    way = unit(way - (way * x).sum(1, keepdims=True) * x)
    cos = rng.uniform(0.901, 0.92, (1500, 1))
    both = np.concatenate([x, cos * x + np.sqrt(1 - cos * cos) * way])
    got = vector_dedup.vector_links(table(spark, [(i, [float(v) for v in r]) for i, r in enumerate(both)])).collect()
    want = ((both @ both.T) >= 0.9).sum() - len(both)
    assert 0.95 * want <= sum(r.n_links for r in got) <= want


def test_traversal_visits_the_nearest_cells_first():
    rng = np.random.default_rng(4)
    x = unit(rng.normal(size=(300, 8)))
    grid = fit(x, 8, 0.9, 0.99)
    own, who, cells = grid.traverse(x)
    from adweave.llm.multi_index import borders

    (a, fa), (b, fb) = (borders(h, c) for h, c in zip(grid.halves(x), (grid.left, grid.right)))
    for r in range(300):
        far = fa[r][:, None] + fb[r][None]
        seen = cells[who == r]
        assert (own[r], seen[0]) == (a[r] * len(grid.right) + b[r],) * 2
        assert sorted(seen) == list(np.flatnonzero(far.ravel() <= grid.reach)) and (np.diff(far.ravel()[seen]) >= 0).all()
    whole = Grid(codebook(x[:, :4], 8, rng), codebook(x[:, 4:], 8, rng), reach=4.0)
    assert len(whole.traverse(x)[1]) > 300 * 32
