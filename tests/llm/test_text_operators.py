"""Line dedup, packing, near dedup, decontamination, language ID and toxicity on small fixtures."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from adweave.llm import gru, language_id, near_dedup, packing, toxicity
from adweave.llm.components import components
from adweave.llm.decontamination import contaminated
from adweave.llm.line_dedup import dedup_lines
from adweave.llm.near_dedup import bucket_pairs, leader_pairs, near_duplicates, open_pairs, prefix_index, shingle_sets

LONG = "lorem ipsum dolor " * 4000


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))


# line dedup


def lines_by_hand(rows, min_sites, whole_copies):
    sites = {}
    for _, text, site in rows:
        for x in (text or "").split("\n"):
            if x.strip(" ") and site is not None:
                sites.setdefault(x.strip(" "), set()).add(site)
    out = {}
    for i, text, _ in rows:
        if text is None:
            out[i] = (None, 0, 0)
            continue
        parts = text.split("\n")
        left = [x for x in parts if len(sites.get(x.strip(" "), ())) < min_sites]
        if whole_copies and not any(x.strip(" ") for x in left):
            left = parts
        out[i] = ("\n".join(left), len(parts), len(parts) - len(left))
    return out


def test_line_dedup(spark):
    rng = random.Random(0)
    rows = []
    for i in range(120):
        own = [words(rng, 6) for _ in range(5)]
        if i % 2:
            own.insert(rng.randrange(5), "  Share this page ")
        if i % 3 == 0:
            own.append(f"near the threshold {i % 2}")
        rows.append((i, "\n".join(own), None if i % 17 == 0 else f"s{i % 12}"))
    rows += [(200, None, "s1"), (201, "", "s1"), (202, "Share this page", "s3"), (203, "\n\n", "s2"), (204, LONG, "s2"), (205, words(rng, 3) + "\nShare this page\nShare this page\n" + words(rng, 30), "s4")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_removed", F.lit("clash")).withColumn("h1", F.lit(1))
    for whole in (False, True):
        got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in dedup_lines(df, min_sites=6, whole_copies=whole).collect()}
        assert got == lines_by_hand(rows, 6, whole)
        assert got[202] == (("Share this page", 1, 0) if whole else ("", 1, 1)) and got[205][2] == 2
    assert dedup_lines(df.limit(0), min_sites=6).count() == 0


def test_pipeline_exempts_whole_copies_only(spark):
    import corpus_pipeline

    footer = "a long shared footer line, over half of every short page"
    rows = [(i, f"own {i}\n{footer}", f"s{i}") for i in range(9)] + [(20, f"\n{footer} \n", "s1"), (21, None, "s2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_chars", F.length("text"))
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.line_dedup(spark, df, "").collect()}
    whole = rows[9][1]
    assert got == {**{i: (f"own {i}", 5) for i in range(9)}, 20: (whole, len(whole)), 21: (None, None)}


# packing


def test_buckets_are_optimal():
    rng = np.random.default_rng(3)
    for k in (1, 2, 3, 4, 9):
        for size in (1, 2, 8, 9):
            lengths = np.sort(rng.choice(np.arange(1, 60), size, replace=False))
            counts = rng.integers(1, 20, size)
            cost = lambda bounds: sum(n * (min(b for b in bounds if b >= t) - t) for t, n in zip(lengths, counts))
            best = min(cost((*c, lengths[-1])) for r in range(min(k, size)) for c in itertools.combinations(lengths[:-1], r))
            got = packing.choose_buckets(lengths, counts, k)
            assert got[-1] == lengths[-1] and len(got) <= k and got == sorted(set(got)) and cost(got) == best
    assert packing.choose_buckets(np.zeros(0, int), np.zeros(0, int), 3) == []
    many = np.arange(1, 30_001) * 7
    got = packing.choose_buckets(many, rng.integers(1, 9, len(many)), 16)
    assert len(got) == 16 and got[-1] == many[-1]


def test_packing(spark):
    from adweave.llm.token_output import load_tokenizer

    rng = random.Random(1)
    rows = [(i, words(rng, rng.choice([1, 5, 40, 200])), 1) for i in range(300)] + [(300, None, 1), (301, "", 1), (302, LONG, 1), (5, "same id", 1)] + [(None, "no id", 1)] * 120
    df = spark.createDataFrame(rows, "doc_id long, text string, bucket int")
    got = packing.pack(df, n_buckets=4, batch_tokens=1000, shard_rows=50).collect()
    assert len(got) == len(rows)
    n = lambda t: len(load_tokenizer().encode(t or "", add_special_tokens=False).ids) + 1
    want = sorted((-1 if i is None else i, n(t)) for i, t, _ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in got) == want
    lengths = sorted(x for _, x in want)
    distinct = sorted(set(lengths))
    pad = lambda bounds: sum(min(b for b in bounds if b >= x) - x for x in lengths)
    if len(distinct) < 60:
        assert sum(r.padding for r in got) == min(pad((*c, distinct[-1])) for r in range(4) for c in itertools.combinations(distinct[:-1], r))
    batches = {}
    for r in got:
        assert r.n_tokens + r.padding == r.bucket_len and r.padding >= 0
        batches.setdefault(r.batch_id, []).append(r)
    assert all(max(r.n_tokens for r in got if r.bucket == k) == b for k, b in {(r.bucket, r.bucket_len) for r in got})
    for rows_ in batches.values():
        assert len({r.bucket for r in rows_}) == 1 and sorted(r.slot for r in rows_) == list(range(len(rows_)))
        assert len(rows_) == 1 or sum(r.bucket_len for r in rows_) <= 1000
    assert max(sum(r.doc_id is None for r in b) for b in batches.values()) < 120
    assert packing.pack(df.limit(0)).count() == 0


# near dedup


def by_hand(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(sorted(sets), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j]):
            a, b = sorted((root(i), root(j)))
            up[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_near_dedup(spark):
    rng = random.Random(2)
    rows = []
    for g in range(6):
        base = words(rng, 80).split()
        for v in range(8):
            t = list(base)
            for _ in range(v):
                t[rng.randrange(80)] = words(rng, 1)
            rows.append((len(rows), " ".join(t)))
    rows += [(100 + i, t) for i, t in enumerate([None, "", "  \n", "one two", "ONE two", "one  two", "one two three", "é É", "É é", rows[0][1].upper(), LONG, LONG + " end"])]
    rows += [(200 + i, rows[3][1]) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rep", F.lit("clash")).withColumn("key", F.lit(0))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df).collect()}
    assert got == by_hand(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in near_duplicates(df).collect())
    assert near_duplicates(df.limit(0)).count() == 0
    null = near_duplicates(spark.createDataFrame([(None, "a b"), (1, "a b")], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in null} == {(None, None, True), (1, 1, True)}


def test_prefix_pairs_lose_no_link(spark):
    rng = random.Random(4)
    base = words(rng, 60).split()
    texts = []
    for i in range(40):
        t = list(base)
        for _ in range(i % 7):
            t[rng.randrange(60)] = words(rng, 1)
        texts.append(" ".join(t[: rng.choice([60, 58, 50])]))
    sets = [set(s.tolist()) for s in shingle_sets([t.encode() for t in texts])]
    links = {(i, j) for i, j in itertools.combinations(range(40), 2) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) and i % 3 != j % 3}
    table = spark.createDataFrame([(i, [x - 2**63 for x in s]) for i, s in enumerate(sets)], "doc_id long, shingles array<long>")
    comp = spark.createDataFrame([(i, i % 3) for i in range(40)], "rep long, comp long")
    where = prefix_index(table, comp.select("rep")).join(comp, "rep")
    rows = bucket_pairs(where).collect()
    got = {(r.a, r.b) for r in rows}
    assert links and links <= got and len(got) == len(rows) <= open_pairs(where)
    assert all((r.ca, r.cb) == (r.a % 3, r.b % 3) and r.ca != r.cb for r in rows)
    parts = [(r.a, r.b) for i in range(5) for r in bucket_pairs(where, i, 5).collect()]
    assert set(parts) == got and max(sum(1 for _ in bucket_pairs(where, i, 5).collect()) for i in range(5)) < len(got)
    led = leader_pairs(where.withColumn("order", F.lit(0))).collect()
    assert len(led) == len({r.a for r in led}) and all(r.ca != r.cb and (min(r.a, r.b), max(r.a, r.b)) in got for r in led)


@pytest.mark.parametrize("gain,least", [(0.001, 1 << 22), (2.0, 50_000)], ids=["leaders", "parts"])
def test_near_dedup_of_a_large_varied_group(spark, monkeypatch, gain, least):
    """Copies of one text that differ from one another as much as from it; what leaders leave comes in parts."""
    monkeypatch.setattr(near_dedup, "LEAST_PART", least)
    monkeypatch.setattr(near_dedup, "GAIN", gain)
    seen, real = [], near_dedup.bucket_pairs
    monkeypatch.setattr(near_dedup, "bucket_pairs", lambda where, part=0, parts=1: seen.append(parts) or real(where, part, parts))
    rng = random.Random(7)
    base = words(rng, 120).split()
    rows = []
    for i in range(150):
        t = list(base)
        for _ in range(rng.randrange(1, 7)):
            t[rng.randrange(120)] = words(rng, 1)
        rows.append((i * 3 + 1, " ".join(t)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == by_hand(rows) and (gain < 1 or max(seen) > 1)


def test_rounds_that_save_nothing_end(spark, monkeypatch):
    """Pairs that fit one part are tested once a round of leaders has hardly made them fewer, with the same result."""
    rounds, real = [], near_dedup.leader_pairs
    monkeypatch.setattr(near_dedup, "leader_pairs", lambda where: rounds.append(1) or real(where))
    monkeypatch.setattr(near_dedup, "PAIRS", 0)
    monkeypatch.setattr(near_dedup, "GAIN", 0.0)
    monkeypatch.setattr(near_dedup, "open_pairs", lambda where: 1000 if len(rounds) < 9 else 0)
    rng = random.Random(5)
    base = words(rng, 60).split()
    rows = [(i, " ".join([*base[: 60 - i], *words(rng, i + 1).split()])) for i in range(12)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == by_hand(rows) and len(rounds) == 2  # one by bands, one by the prefix index


def test_buckets_that_stay_open(spark):
    """Rows of buckets of one component are read no more, and rounds work on what the one before left."""
    rows = spark.createDataFrame([(k, r, 9, 9) for k, r in [(1, 1), (1, 2), (2, 2), (2, 3), (3, 1), (3, 4)]], "key long, rep long, n long, left long")
    label = lambda *comps: spark.createDataFrame(list(zip(range(1, 5), comps)), "rep long, comp long")
    first = near_dedup.opened(near_dedup.stored(rows, "t"), label(1, 1, 3, 4))
    assert sorted((r.key, r.rep, r.comp) for r in first.collect()) == [(2, 2, 1), (2, 3, 3), (3, 1, 1), (3, 4, 4)]
    second = near_dedup.opened(first, label(1, 1, 1, 4))
    assert sorted((r.key, r.rep, r.comp) for r in second.collect()) == [(3, 1, 1), (3, 4, 4)]


def test_parts_meet_a_pair_whose_side_changes(spark):
    """A component that the first parts make larger than the largest one takes no pair away from the parts after."""
    rng = random.Random(11)
    base = words(rng, 60).split()
    near = [" ".join([words(rng, 1), *base[1:]]) for _ in range(12)]
    sets = [s.view(np.int64).tolist() for s in shingle_sets([t.encode() for t in near])]
    for _ in range(2):
        reps = rng.sample(range(1, 100), 12)
        table = near_dedup.stored(spark.createDataFrame(list(zip(reps, sets)), "doc_id long, shingles array<long>"), "t")
        comps = [min(reps[:3]) if i < 3 else r for i, r in enumerate(reps)]
        label = near_dedup.stored(spark.createDataFrame(list(zip(reps, comps)), "rep long, comp long"), "t")
        where = near_dedup.stored(spark.createDataFrame([(1, r, len(s), len(s), c) for r, s, c in zip(reps, sets, comps)], "key long, rep long, n long, left long, comp long"), "t")
        met, real = set(), near_dedup.bucket_pairs

        def seen(w, part=0, parts=1):
            out = real(w, part, parts)
            met.update((r.a, r.b) for r in out.collect())
            return out

        near_dedup.bucket_pairs = seen
        try:
            out = near_dedup.paired(table, where, label, 4)
        finally:
            near_dedup.bucket_pairs = real
        assert {r.comp for r in out.collect()} == {min(reps)}
        assert met == {tuple(sorted(p)) for (p, (i, j)) in ((q, ij) for q, ij in zip(itertools.combinations(reps, 2), itertools.combinations(range(12), 2))) if j >= 3}


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (7, 7)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 102: 100}


# decontamination

ITEMS = [(1, "If Mary has 3 apples and gives Paul 2 apples of 5 kg, how many apples does Mary keep after 3 days?"), (2, "The old harbour master counted every lantern twice before the autumn fog rolled over the narrow bay."), (3, None), (4, ""), (5, "too short")]
DOCS = [
    (10, "Q: If Anna has 7 apples and gives Tom 4 apples of 9 lb, how many apples does Anna keep after 7 weeks?"),
    (11, "If Anna has 7 apples and gives Tom 4 apples of 9 lb, how many apples does Zed keep after 8 days?"),
    (12, "x y z THE OLD HARBOUR MASTER COUNTED EVERY LANTERN TWICE BEFORE THE AUTUMN FOG ROLLED over the narrow bay. More."),
    (13, "The old harbour master slept."),
    (14, None),
    (15, ""),
    (16, "1 2 3 4 5 6 7 8 9 10 11 12 13 14"),
    (17, LONG + " the old harbour\nmaster counted every lantern, twice before the autumn fog rolled over the narrow bay"),
]


@pytest.mark.parametrize("lookup", [1_000_000, 0])
def test_decontamination(spark, lookup):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("doc_id", F.lit(0))
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, items, lookup_windows=lookup).collect()}
    assert got == {(10, 1), (12, 2), (17, 2)}
    assert contaminated(docs.limit(0), items, lookup_windows=lookup).count() == 0
    assert contaminated(docs, items.limit(0), lookup_windows=lookup).count() == 0


@pytest.mark.parametrize("lookup", [1_000_000, 0])
def test_decontamination_of_short_items(spark, lookup):
    items = [(1, "What is the capital of France?"), (2, "Add 3 and 4"), (3, "12 15 18 21 24 27 30 33 36 39"), (4, "which grey river crosses seven quiet northern towns"), (5, "Name the old painter whose blue horses hung above the narrow kitchen door"), (6, " ".join(map(str, range(100, 170))))]
    docs = [
        (10, "quiz: what is the capital of France? Paris"),
        (11, "what is the capital of the moon"),
        (12, "now add 7 and 9 please"),
        (13, "row 12 15 18 21 24 27 30 33 36 39 end"),
        (14, "row 12 15 18 21 24 27 30 33 36 40 end"),
        (15, "x which grey river passes seven quiet northern towns y"),
        (16, "which grey river crosses nothing at all"),
        (17, "Name the old painter whose red horses hung above the narrow kitchen door"),
        (18, "z name the old painter whose large blue horses hung above the narrow door"),
        (20, "table " + " ".join(map(str, range(100, 175)))),
        (19, "seven quiet northern towns, and " + "far away " * 30 + "which grey river crosses"),
    ]
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), lookup_windows=lookup).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(10, 1), (12, 2), (13, 3), (15, 4), (17, 5), (18, 5), (20, 6)]
    assert all(0 < r.share <= 1 for r in got)


# language ID


def test_forward_sums_all_segmentations():
    vocab = np.unique(np.array([language_id._prefix([p])[0, -1] for p in ("a", "b", "ab", "ba", "▁", "▁a")], np.uint64))
    p = np.random.default_rng(0).random((len(vocab) + 2, 2))
    p[-1] = 0
    model = language_id.Model(vocab, p, ["x", "y"])
    prob = {w: p[np.searchsorted(vocab, language_id._prefix([w])[0, -1])] for w in ("a", "b", "ab", "ba", "▁", "▁a")}

    def total(s):
        return np.ones(2) if not s else sum((prob.get(s[:k], p[len(vocab)] * (k == 1 and s[:k] not in prob)) * total(s[k:]) for k in range(1, len(s) + 1)), np.zeros(2))

    for w in ("ab", "aba", "zb", "b"):
        assert np.allclose(model.log_p([w])[0], np.log(total("▁" + w)))
    assert np.allclose(model.log_p(["ab" * 40, "b"])[1], np.log(total("▁b")))


def test_long_unknown_runs_do_not_underflow():
    vocab = np.unique(np.array([language_id._prefix([x])[0, -1] for x in ("a", "b", "ab", "▁", "▁a")], np.uint64))
    p = np.random.default_rng(1).random((len(vocab) + 2, 2)) * 1e-6
    p[-2], p[-1] = language_id.UNKNOWN, 0
    model = language_id.Model(vocab, p, ["x", "y"])
    blank = p[np.searchsorted(vocab, language_id._prefix(["▁"])[0, -1])]
    for n in (35, 36, 63, 300):
        want = np.log(blank) + n * np.log(language_id.UNKNOWN)
        assert np.allclose(model.log_p(["語" * n])[0], want)
    score = list(language_id._identify(model, [])(iter([pa.RecordBatch.from_pydict({"text": ["ab " + "語" * 70]})])))[0].column("score")[0].as_py()
    assert 0 <= score <= 1
    fitted = language_id.fit({"x": {"ab" * 20: 3, "語" * 60: 1}, "y": {"b": 2}}, vocab)
    assert np.isfinite(fitted.p).all() and np.isclose(fitted.p[: len(vocab)].sum(0), 1).all()


def test_language_id(spark):
    rng = random.Random(5)
    mk = lambda syl, n: " ".join("".join(rng.choice(syl) for _ in range(rng.randint(1, 3))) for _ in range(n))
    syllables = {"xx": ["the", "ing", "on", "er"], "yy": ["ción", "os", "la", "ue"]}
    rows = [(i, mk(syllables[g], 40), g) for i, g in enumerate(["xx", "yy"] * 60)] + [(500, None, "xx"), (501, "", None), (502, "123 !!", "xx"), (503, mk(syllables["yy"], 9000), None), (504, "oncher", None), (505, "²½ ⅷ ₃", "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(df, language_id.train(df)).collect()}
    assert len(got) == len(rows)
    assert all(got[i][0] == g for i, _, g in rows[:120])
    assert got[500] == got[501] == got[502] == got[505] == ("und", 0.0) and got[503][0] == "yy"
    assert all(0 <= s <= 1 for _, s in got.values())
    nothing = language_id.train(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in language_id.identify(df, nothing).collect()} == {"und"}
    assert language_id.identify(df.limit(0), nothing).count() == 0


# toxicity


def test_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in gru.init(9, 30, 3, 4).items()}
    w = rng.integers(1, 9, (6, 5))
    w[4:, 0] = 0
    begin, grams = np.array([0, 0, 2, 3, 5, 7, 8, 10, 12, 14]), rng.integers(0, 30, 14)
    y, weight = rng.integers(0, 2, 5).astype(float), rng.random(5)
    _, g = gru.gradients(p, w, grams, begin, y, weight)
    for k in p:
        for _ in range(3):
            i = tuple(rng.integers(0, s) for s in p[k].shape)
            old, e = p[k][i], 1e-5
            p[k][i] = old + e
            up, _ = gru.gradients(p, w, grams, begin, y, weight)
            p[k][i] = old - e
            down, _ = gru.gradients(p, w, grams, begin, y, weight)
            p[k][i] = old
            assert abs((up - down) / 2 / e - g[k][i]) < 1e-5


def test_windows_cover_everything():
    for n in (0, 1, 23, 24, 25, 36, 100):
        starts = toxicity.window_starts(n)
        covered = {i for s in starts for i in range(s, min(s + toxicity.WINDOW, n))}
        assert covered == set(range(n))
        at, real, owner = toxicity.windows_of(np.array([n]))
        assert set(at[real].tolist()) == covered and len(owner) == len(starts)


def test_toxicity(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(240):
        t = words(rng, 70).split()
        if i % 3 == 0:
            for _ in range(3):
                t.insert(rng.randrange(len(t)), rng.choice(["nastyx", "vilex", "nastyzo"]))
        rows.append((i, " ".join(t)))
        labels.append((i, int(i % 3 == 0)))
    rows += [(900, None), (901, ""), (902, "..."), (903, words(rng, 5000) + " nastyx " + words(rng, 20)), (904, rows[1][1]), (905, rows[1][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("predicted", F.lit("clash"))
    lab = spark.createDataFrame(labels + [(1, None)], "doc_id long, toxic int")
    model = toxicity.train(df, lab)
    got = {r.doc_id: (r.score, r.predicted) for r in toxicity.score_toxicity(df, model).collect()}
    assert len(got) == len(rows)
    assert np.mean([got[i][1] == y for i, y in labels]) > 0.95
    assert got[903][1] == 1 and got[900] == got[901] == got[902] and got[900][1] == 0 and got[904] == pytest.approx(got[905], abs=1e-6)
    assert toxicity.score_toxicity(df.limit(0), model).count() == 0
    blank = toxicity.train(df, lab.limit(0))
    assert {r.predicted for r in toxicity.score_toxicity(df, blank).collect()} == {0}
