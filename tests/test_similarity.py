"""Similarity joins on every path against brute force."""

import numpy as np
import pytest

from adweave.operators import similarity


def plan_of(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("few", [65_536, 0], ids=["array", "index"])
@pytest.mark.parametrize("most,bits", [(0, 64), (3, 64), (12, 32), (20, 64)])
def test_hashes(spark, monkeypatch, few, most, bits):
    monkeypatch.setattr(similarity, "FEW_HASHES", few)
    monkeypatch.setattr(similarity, "CHUNK", 40)
    rng = np.random.default_rng(most)
    ref = rng.integers(0, 2**bits, 150, dtype=np.uint64)
    own = np.concatenate([ref[:60], rng.integers(0, 2**bits, 60, dtype=np.uint64)])
    for i in range(60):  # some bits away
        for b in rng.choice(bits, rng.integers(0, most + 3), replace=False):
            own[i] ^= np.uint64(1) << np.uint64(b)
    signed = lambda x: [int(v) for v in x.view(np.int64)]
    rows = spark.createDataFrame([(h,) for h in [*signed(own), *signed(own[:5]), None]], "h long")
    refs = spark.createDataFrame([(h,) for h in [*signed(ref), None, signed(ref)[0]]], "r long")
    got = similarity.hashes_near(rows, "h", refs, "r", most, bits)
    near = {h for h, x in zip(signed(own), own) if min(bin(int(x) ^ int(r)).count("1") for r in ref) <= most}
    assert sorted(r.h for r in got.collect()) == sorted(near)
    assert "Cartesian" not in plan_of(got) and "NestedLoop" not in plan_of(got)
    assert similarity.hashes_near(rows, "h", refs.limit(0), "r", most, bits).count() == 0
    assert similarity.hashes_near(rows.limit(0), "h", refs, "r", most, bits).count() == 0


@pytest.mark.parametrize("few", [1024, 0], ids=["array", "pivots"])
def test_vectors(spark, monkeypatch, few):
    monkeypatch.setattr(similarity, "FEW_VECTORS", few)
    monkeypatch.setattr(similarity, "CHUNK", 30)
    monkeypatch.setattr(similarity, "PIVOTS", 6)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(8, 16))
    x = base[rng.integers(0, 8, 260)] + rng.normal(scale=0.3, size=(260, 16))
    x[200] = x[7]
    x /= np.linalg.norm(x, axis=1)[:, None]
    table = lambda ids: spark.createDataFrame([(int(i), [float(v) for v in x[i]]) for i in ids], "id long, v array<double>")
    rows, ref = table(range(260)), table(range(0, 260, 2))
    cos = np.floor(x @ x[::2].T * 1e6 + 0.5) / 1e6
    for least in (0.2, 0.8, 0.97):
        hit = (cos >= least) & (np.arange(260)[:, None] != np.arange(0, 260, 2))
        got = similarity.vectors_near(rows, ref, least)
        assert sorted(r.id for r in got.collect()) == np.flatnonzero(hit.any(1)).tolist()
        assert "Cartesian" not in plan_of(got) and "NestedLoop" not in plan_of(got)
    best = {r.id: (r.ref, r.score) for r in similarity.best_vector(rows, ref).collect()}
    assert best == {i: (2 * int(c.argmax()), c.max()) for i, c in enumerate(cos) if c.max() > 0}
    assert similarity.best_vector(rows, ref.limit(0)).count() == 0 and similarity.best_vector(rows.limit(0), ref).count() == 0


def test_pivots_prune(spark, monkeypatch):
    """Rows of one cluster visit their own cell alone."""
    monkeypatch.setattr(similarity, "FEW_VECTORS", 0)
    monkeypatch.setattr(similarity, "PIVOTS", 4)
    dealt = []
    real = similarity.deal
    monkeypatch.setattr(similarity, "deal", lambda a, b, *x: dealt.append(a.count()) or real(a, b, *x))
    rng = np.random.default_rng(3)
    x = np.repeat(np.eye(4), 50, axis=0) + rng.normal(scale=0.01, size=(200, 4))
    x /= np.linalg.norm(x, axis=1)[:, None]
    t = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    similarity.vectors_near(t, t, 0.95).count()
    assert dealt[0] < 4 * 200
