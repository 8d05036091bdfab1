"""Operators, functions and sources on small fixtures."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from adweave.functions import images, scores, text
from adweave.operators.funnel import funnel
from adweave.operators.joins import contains_first, first_superset, tiered
from adweave.operators.merges import delete_cascade, merged_maps, prune, upsert
from adweave.operators.sequences import latch, streaks, tiles, until_superset
from adweave.sources.files import data_uri_bytes, html_links, paged_source, read_csv, read_manifest, resolved, sitemap_locations


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_reuse_coverage(spark):
    """The newest scan that covers all requested dealers; keys ignore case and last slashes."""
    cov = spark.createDataFrame([("a", 1, "https://x.com/One/"), ("a", 1, "https://x.com/two"), ("b", 2, "https://x.com/one"), ("c", 3, "https://x.com/TWO"), ("c", 3, "https://x.com/one//")], "scan string, at int, url string")
    req = spark.createDataFrame([("https://x.com/one",), (" https://x.com/two/ ",), (None,)], "url string")
    key = lambda d: d.withColumn("k", text.coverage_key(F.col("url")))
    assert [r.scan for r in first_superset(key(req), key(cov), "scan", "k", "at", 15).collect()] == ["c"]
    none = spark.createDataFrame([(None,)], "url string")
    assert first_superset(key(none), key(cov), "scan", "k", "at", 15).count() == 0
    only = key(req).unionByName(key(spark.createDataFrame([("https://z.com",)], "url string")))
    assert first_superset(only, key(cov), "scan", "k", "at", 15).count() == 0


def test_contains_first(spark):
    names = spark.createDataFrame([(1, "Main Street Motors"), (2, "Street"), (3, "Motors")], "o int, name string")
    rows = spark.createDataFrame([(1, "street"), (2, "Motors of Main Street"), (3, ""), (4, "zzz"), (5, None)], "id int, t string")
    got = {r.id: r.o for r in contains_first(rows, "id", "t", names, "name", "o", ["o"]).collect()}
    assert got == {1: 2, 2: 2, 3: 1, 4: None, 5: None}


def test_contains_first_of_short_names(spark):
    """Random short strings against brute force, with repeats, empty and null ones."""
    import random

    rng = random.Random(3)
    word = lambda: rng.choice([None, "", *["".join(rng.choice("abZ") for _ in range(rng.randint(1, 6))) for _ in range(12)]])
    for blank in (True, False):
        names = [(i, n) for i in range(25) if (n := word()) != "" or blank]
        rows = [(i, word()) for i in range(80)]
        got = {r.id: r.o for r in contains_first(spark.createDataFrame(rows, "id int, t string"), "id", "t", spark.createDataFrame(names, "o int, name string"), "name", "o", ["o"]).collect()}
        for i, t in rows:
            hits = [] if t is None else [(t.lower() != n.lower(), o) for o, n in names if n is not None and (n.lower() in t.lower() or t.lower() in n.lower())]
            want = min(o for o, n in names if n is not None) if t == "" else min(hits)[1] if hits else None
            assert got[i] == want, (t, names)


def test_tiers(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    a, b = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string"), spark.createDataFrame([(1, "y"), (2, "z")], "k int, v string")
    assert {(r.k, r.v, r.tier) for r in tiered(rows, "k", [("a", a), ("b", b)], "v").collect()} == {(1, "x", "a"), (2, "z", "b"), (3, None, "none")}


def test_writes(spark):
    old = spark.createDataFrame([(1, "a", 1), (None, "n", 1)], "k int, v string, n int")
    new = spark.createDataFrame([(1, "b", 1), (2, "c", 1), (None, None, 1)], "k int, v string, n int")
    got = {r.k: (r.v, r.n) for r in upsert(old, new, ["k"], {"n": lambda o, n: o + n}).collect()}
    assert got == {1: ("b", 2), None: ("n", 2), 2: ("c", 1)}
    child = spark.createDataFrame([(10, 1), (11, 2), (12, None)], "id int, k int")
    cascade, nulled = delete_cascade(spark.createDataFrame([(1,)], "k int"), "k", [(child, "k", "cascade"), (child, "k", "set null")])
    assert {r.id for r in cascade.collect()} == {11, 12}
    assert {(r.id, r.k) for r in nulled.collect()} == {(10, None), (11, 2), (12, None)}
    assert prune(child, spark.createDataFrame([], "k int"), "k").count() == 3
    assert prune(child, spark.createDataFrame([(2,)], "k int"), "k").count() == 1
    m = merged_maps(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(3)))
    assert one(spark, m) == {"a": 1, "b": 3}


def test_sequences(spark):
    e = spark.createDataFrame([("h", i, ok) for i, ok in enumerate([False, False, True, False])], "host string, i int, ok boolean")
    assert [r.streak for r in streaks(e, "host", ["i"], F.col("ok")).orderBy("i").collect()] == [1, 2, 0, 1]
    cost = spark.createDataFrame([("s", i, x) for i, x in enumerate([1.0, 4.0, -3.0])], "s string, i int, usd double")
    assert [r.tripped for r in latch(cost, "s", ["i"], F.col("usd"), 5).orderBy("i").collect()] == [False, True, True]
    assert not any(r.tripped for r in latch(cost, "s", ["i"], F.col("usd"), 0).collect())
    assert [r.top for r in tiles(spark.createDataFrame([(2500,)], "h int"), F.col("h"), 1000, 200).orderBy("tile").collect()] == [0, 800, 1600]
    seen = spark.createDataFrame([("p", i, x) for i, x in enumerate("aabac")], "p string, i int, a string")
    assert until_superset(seen, "p", ["i"], "a", 2).count() == 3


def test_conditional_theta_deals_out_rows_without_a_dealer(spark):
    """One left join on a key that is never null, so that such rows aren't in one task."""
    from adweave.plans import registry

    plan = registry.QUERIES["c3_conditional_theta"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert plan.count("Join LeftOuter") == 1 and "coalesce(concat(id:" in plan and "concat(none:" in plan


def test_scores(spark):
    v = lambda c: one(spark, c)
    lit = lambda x: F.lit(float(x))
    assert v(F.bround(scores.ensemble(lit(85), lit(50), F.lit(False)))) == 60
    assert v(scores.gate_score(F.lit(4))) == 65 and v(scores.gate_score(F.lit(3))) == 50
    assert v(scores.match_band(F.lit(80))) == "strong"
    assert v(scores.calibrated(F.lit(99.9), F.lit(1.15))) == 100
    assert v(scores.rate(F.lit(1), F.lit(0), 100.0)) == 100.0
    assert v(scores.hamming_score(F.lit(16.0))) == 75.0


def test_funnel_vetoes(spark):
    base = dict(downloaded=True, screenshot=False, hash_distance=3.0, cosine=0.9, relevance=0.9, visual=95.0, hashed=95.0, hash_exact=False, detection=0.0, gates_passed=5, gate_brand=True, gate_product=True, asset_visible=None, factor=1.0, threshold=60)
    cases = [({}, "matched"), ({"downloaded": False}, "download_failed"), ({"hash_distance": 40.0}, "hash_rejected"), ({"hash_distance": 40.0, "screenshot": True, "detection": 90.0}, "matched"), ({"cosine": 0.1}, "clip_rejected"), ({"hash_distance": None, "cosine": None}, "matched"), ({"relevance": 0.1}, "filter_rejected"), ({"visual": 10.0, "hashed": 10.0}, "below_threshold"), ({"visual": 70.0, "hashed": 50.0, "gates_passed": 3}, "verification_rejected"), ({"asset_visible": False}, "asset_invisible_rejected")]
    schema = "i int, downloaded boolean, screenshot boolean, hash_distance double, cosine double, relevance double, visual double, hashed double, hash_exact boolean, detection double, gates_passed int, gate_brand boolean, gate_product boolean, asset_visible boolean, factor double, threshold int"
    rows = [(i, *[(base | d)[k] for k in base]) for i, (d, _) in enumerate(cases)]
    got = {r.i: r.stage for r in funnel(spark.createDataFrame(rows, schema)).collect()}
    assert [got[i] for i in range(len(cases))] == [s for _, s in cases]


def test_distractors_are_found_once_a_kind(spark, tmp_path):
    """No row for each part and candidate: what is ranked has a row for each type, brand and candidate."""
    from adweave.plans import registry

    parts = spark.range(20_000).selectExpr("id AS p_partkey", "concat('b', id % 5) AS p_brand", "concat('t', id % 2) AS p_type").coalesce(1)
    parts.write.parquet(str(tmp_path / "part.parquet"))
    got = registry.QUERIES["c33_distractors"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(id" not in plan
    rows = {}
    for r in got.collect():
        rows.setdefault(r.id, []).append((r.rn, r.other))
    assert len(rows) == 20_000 and sorted(rows[0]) == [(1, 2), (2, 4), (3, 6), (4, 8)] and sorted(rows[9_993]) == [(1, 1), (2, 5), (3, 7), (4, 9)]


def test_text(spark):
    v = lambda c: one(spark, c)
    assert v(text.normal_url(F.lit("HTTPS://Ex.com/a/b/?x=1#y"))).lower() == "https://ex.com/a/b"
    assert v(text.normal_url(F.lit("https://ex.com/"))) == "https://ex.com/"
    assert v(text.hostname(F.lit("not a url"))) == ""
    assert v(text.without_suffix(F.lit("Joe's Cars | Boston"))) == "Joe's Cars"
    assert v(text.without_suffix(F.lit("| Boston"))) == "| Boston"
    assert v(text.first_filled(F.lit(""), F.lit(None), F.lit(0))) == "0"
    assert v(text.epoch_time(F.lit("1700000000000"))) == v(text.epoch_time(F.lit("1700000000"))) == "2023-11-14T22:13:20"
    assert v(text.epoch_time(F.lit("soon"))) == "soon"
    assert json.loads(v(text.embedded_json(F.lit('x ```json\n{"a": 1}\n``` y')))) == {"a": 1}
    assert v(text.is_promo(F.lit("https://x.com/big-sale/now"))) and not v(text.is_promo(F.lit("https://x.com/wholesale")))


def test_exact_sums(spark):
    """Sums don't hang on the order of rows: ten times 0.1 is 1, and 0.3 + 0.2 + 0.1 is 0.6."""
    rows = [("a", 0.1)] * 10 + [("b", 0.1), ("b", 0.2), ("b", 0.3), ("b", None), ("c", None), ("d", float("inf")), ("d", 1.0), ("e", 1e-20), ("e", 1e-20), ("f", 1e300)]
    df = spark.createDataFrame(rows, "k string, x double").coalesce(1)
    got = {r.k: r.s for r in df.groupBy("k").agg(scores.exact_sum(F.col("x")).alias("s")).collect()}
    assert got == {"a": 1.0, "b": 0.6, "c": None, "d": float("inf"), "e": 2e-20, "f": 1e300}
    assert [r.s for r in df.filter("k = 'x'").agg(scores.exact_sum(F.col("x")).alias("s")).collect()] == [None]


def test_whole_means_are_not_cut(spark, tmp_path):
    from adweave.plans import registry

    rng = random.Random(1)
    cents = [rng.randint(1000, 9000) for _ in range(64)]
    cents.append(-sum(cents) % 6500)
    plain = 0.0
    for x in cents:
        plain += x / 100
    assert sum(cents) == 49 * 100 * 65 and plain / 65 < 49
    rows = [(1, "view", "2024-01-10", x / 100) for x in cents]
    spark.createDataFrame(rows, "user_id long, event_type string, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    assert registry.QUERIES["h17_safe_math"](spark, str(tmp_path)).first().clamped == 49


def test_sources(spark, tmp_path):
    (tmp_path / "d.csv").write_bytes(b'Name, Website URL,note\r\n"A ""x"", B",http://a,"two\nlines"\r\nshort\r\n,,\r\n')
    rows = read_csv(spark, str(tmp_path / "d.csv")).collect()
    assert [r.asDict() for r in rows] == [{"name": 'A "x", B', "website_url": "http://a", "note": "two\nlines"}, {"name": "short", "website_url": "", "note": ""}]
    (tmp_path / "m.json").write_text(json.dumps({"version": 1, "cases": [{"id": "a", "expected": {"is_match": True}}, {"id": "b"}]}))
    got = {(r.id, r.m) for r in read_manifest(spark, str(tmp_path / "m.json"), "id string, expected struct<is_match: boolean>").select("id", F.col("expected.is_match").alias("m")).collect()}
    assert got == {("a", True), ("b", None)}
    v = lambda c: one(spark, c)
    assert v(sitemap_locations(F.lit("<urlset><url><loc> http://a/1 </loc></url><x:loc>http://a/2</x:loc>"))) == ["http://a/1", "http://a/2"]
    assert v(html_links(F.lit("<a href='/x'> <a href=\"#t\"><a href='mailto:a@b'><a href='/x'><a href = \"http://b\">"))) == ["/x", "http://b"]
    base = F.lit("https://h.com/dir/page?q=1")
    assert [v(resolved(base, F.lit(x))) for x in ("http://o/", "//cdn/x", "/r", "rel")] == ["http://o/", "https://cdn/x", "https://h.com/r", "https://h.com/dir/rel"]
    assert v(data_uri_bytes(F.lit("data:image/png;base64,aGk="))) == b"hi" and v(data_uri_bytes(F.lit("http://x"))) is None


def test_paged_source(spark):
    def fetch(source, token):
        at = token or 0
        return [(source, at * 2 + i) for i in range(2)], at + 1 if at < 5 else None

    spark.dataSource.register(paged_source("adweave_paged", "source int, n int", fetch, sources=2, most=3))
    rows = spark.read.format("adweave_paged").load().collect()
    assert sorted((r.source, r.n) for r in rows) == [(s, n) for s in range(2) for n in range(6)]


def test_image_hashes(spark):
    rng = np.random.default_rng(0)
    a = rng.integers(0, 255, (64, 64)).astype(np.uint8)
    b = np.clip(a.astype(int) + 3, 0, 255).astype(np.uint8)
    other = rng.integers(0, 255, (64, 64)).astype(np.uint8)
    far = lambda x, y: sum(bin((p ^ q) & (2**64 - 1)).count("1") for p, q in zip(images.hashes(x), images.hashes(y))) / 4
    assert far(a, a) == 0 and far(a, b) < 6 < far(a, other)
    df = spark.createDataFrame([(bytearray(a.tobytes()), 64), (None, 64), (bytearray(b"x"), 64)], "p binary, w int")
    got = df.select(images.image_hashes("p", "w").alias("h")).select("h.*").collect()
    assert tuple(got[0]) == images.hashes(a) and got[1].phash is None and got[2].phash is None


def test_image_hashes_of_a_batch(spark):
    """Images of a batch are hashed in stacks of one size, each as if alone; rows that are no image change no other."""
    rng = np.random.default_rng(1)
    made = [rng.integers(0, 255, (40 + k % 2, 50)).astype(np.uint8) for k in range(300)]
    stack = images.stacked_hashes(np.stack(made[::2]))
    assert [tuple(x) for x in stack.tolist()] == [images.hashes(x) for x in made[::2]]
    rows = [(i, None if i % 7 == 3 else bytearray(x.tobytes()), 50) for i, x in enumerate(made)]
    df = spark.createDataFrame(rows, "i int, p binary, w int").coalesce(1)
    for r in df.select("i", images.image_hashes("p", "w").alias("h")).select("i", "h.*").collect():
        assert tuple(r)[1:] == ((None,) * 4 if r.i % 7 == 3 else images.hashes(made[r.i]))



def test_plans_prune_and_push_down(spark):
    """Filters and columns reach the scan."""
    from adweave.plans import registry

    plan = registry.QUERIES["f1_latest"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    assert "l_extendedprice" not in plan.split("ReadSchema: struct<")[1].split(">")[0]


@pytest.mark.parametrize("status,want", [("daily", "2024-01-11"), ("weekly", "2024-01-17"), ("biweekly", "2024-01-17"), ("monthly", "2024-02-01")])
def test_next_run(spark, status, want):
    """2024-01-10 is a Wednesday; its time has passed."""
    got = one(spark, text.next_run(F.lit("2024-01-10").cast("date"), F.lit(status), F.lit(2), F.lit(True)))
    assert str(got) == want


def test_manifest_documents(spark, tmp_path):
    """Cases of several groups are several documents, none of which holds all, and all are read again."""
    from adweave.sources.files import write_manifest

    at = str(tmp_path / "manifest")
    write_manifest(spark.range(2500).select(F.struct("id").alias("x")), at, F.floor(F.col("x.id") / 1000))
    sizes = [len(json.loads(f.read_text())["cases"]) for f in (tmp_path / "manifest").glob("*.json")]
    assert sorted(sizes) == [500, 1000, 1000]
    got = read_manifest(spark, at, "id long").collect()
    assert sorted(r.id for r in got) == list(range(2500)) and {r.version for r in got} == {2}
