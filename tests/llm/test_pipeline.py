"""The pipeline's stages and the registered queries against brute force on small rows."""

import hashlib
import random
import zlib

import pytest

from test_text_operators import by_hand, lines_by_hand

SYLLABLES = {"xx": ["the", "ing", "on", "er"], "yy": ["ción", "os", "la", "ue"]}
ITEM = "the old harbour master counted every lantern twice before the autumn fog rolled over the narrow bay"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """documents with nulls, empty and long texts, copies, repeated and null ids, and a column that clashes; benchmark."""
    rng = random.Random(11)
    say = lambda g, n: " ".join("".join(rng.choice(SYLLABLES[g]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows = []
    for i in range(120):
        g = "xx" if i % 2 else "yy"
        text = "\n".join(say(g, 30) for _ in range(3))
        if i % 4 == 0:
            text += "\nshare this page with all of your friends"
        rows.append((i, text, g, f"s{i % 11}"))
    base = rows[7][1].split(" ")
    rows += [(200 + k, " ".join([*base[: 40 + k], "erthe", *base[41 + k :]]), "xx", f"s{k}") for k in range(5)]  # near copies of 7
    rows += [(220 + k, rows[9][1], "xx", f"s{k}") for k in range(9)]  # whole copies on nine sites
    rows += [(240, rows[11][1] + "\n" + ITEM, "xx", "s1"), (241, say("yy", 20) + " " + ITEM.upper(), "yy", "s2")]
    rows += [(250, None, "xx", "s1"), (251, "", None, None), (252, "123 !!", "xx", "s2"), (253, say("yy", 6000), None, None), (5, say("yy", 50), "yy", "s3"), (None, say("xx", 60), "xx", "s4")]
    at = tmp_path_factory.mktemp("tables")
    df = spark.createDataFrame([(*r, len(r[1] or ""), "clash") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, comp string")
    df.repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def plain(df):
    return sorted(((r.doc_id, r.text, r.n_chars) for r in df.collect()), key=str)


def test_stages(spark, tables):
    """Each stage on all that its predecessor kept."""
    import corpus_pipeline
    from adweave.llm.token_output import load_tokenizer

    steps = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    kept = steps["language_id"](spark, docs, tables).cache()
    want = [r for r in plain(docs) if r[1] and any(map(str.isalpha, r[1]))]
    assert plain(kept) == want and kept.columns == docs.columns

    rows = [(r.doc_id if r.doc_id is not None else -1, r.text, r.source) for r in kept.collect()]
    unique = [(i, *r[1:]) for i, r in enumerate(rows)]  # rows with one id are separate documents
    lines = steps["line_dedup"](spark, kept, tables).cache()
    by = lines_by_hand(unique, 8, True)
    assert sorted(r.text for r in lines.collect()) == sorted(t for t, _, _ in by.values())
    assert lines.columns == docs.columns and all(r.n_chars == len(r.text) for r in lines.collect())
    assert not any("share this page" in r.text for r in lines.collect())

    near = steps["near_dedup"](spark, lines, tables).cache()
    single = {r.doc_id: r.text for r in lines.collect() if r.doc_id not in (None, 5)}
    groups = by_hand(sorted(single.items()))
    stay = {i for i, (_, c) in groups.items() if i == c}
    assert {r.doc_id for r in near.collect()} - {None, 5} == stay and near.columns == docs.columns
    assert near.filter("doc_id = 5").count() == 2 and near.filter("doc_id is null").count() == 1
    assert {200, 204, 221, 228}.isdisjoint(stay) and {7, 9} <= stay

    clean = steps["decontaminate"](spark, near, tables).cache()
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in near.collect()} - {240, 241} and clean.columns == docs.columns

    packed = steps["packing"](spark, clean, tables).collect()
    count = lambda t: len(load_tokenizer().encode(t, add_special_tokens=False).ids) + 1
    assert sorted((str(r.doc_id), r.n_tokens) for r in packed) == sorted((str(r.doc_id), count(r.text)) for r in clean.collect())

    whole = corpus_pipeline.run(spark, tables).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in whole) == sorted((str(r.doc_id), r.n_tokens) for r in packed)
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, docs.limit(0), tables).count() == 0


def test_registered_queries(spark, tables):
    """What the contracts of op3, op4, op5, op7 and op9 say, on the small tables."""
    from adweave.llm.queries import QUERIES
    from adweave.llm.token_output import load_tokenizer

    docs = spark.read.parquet(f"{tables}/documents.parquet").collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    got = QUERIES["op4_language_id"](spark, tables).collect()
    assert len(got) == len(docs) and all(bool(r.held_out) == held(r.doc_id) for r in got if r.doc_id is not None)
    want = {d.doc_id: d.lang for d in docs if d.lang and d.text and d.doc_id not in (None, 5, 240, 241, 252)}
    assert all(r.lang_pred == want[r.doc_id] for r in got if r.doc_id in want) and all(0 <= r.score <= 1 for r in got)

    single = {d.doc_id: d.text for d in docs if d.doc_id not in (None, 5)}
    near = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op5_minhash_near_dedup"](spark, tables).collect() if r.doc_id not in (None, 5)}
    assert near == by_hand(sorted(single.items()))

    ids = lambda t: [*load_tokenizer().encode(t or "", add_special_tokens=False).ids, 0]
    at = 0
    rows = sorted(QUERIES["op3_token_output"](spark, tables).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((d.doc_id for d in docs), key=lambda i: -1 if i is None else i)
    texts = {}
    for d in docs:
        texts.setdefault(d.doc_id, []).append(d.text)
    for r in rows:
        own = [ids(t) for t in texts[r.doc_id]]
        assert r.start == at and (r.n_tokens, r.ids_crc32) in [(len(x), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in x))) for x in own]
        at += r.n_tokens

    for r in QUERIES["op7_media_fingerprints"](spark, tables).collect():
        if r.doc_id in single:
            raw = (single[r.doc_id] or "").encode()
            full = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
