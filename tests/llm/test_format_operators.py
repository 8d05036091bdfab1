"""Token output, media, HTML extraction and chat formatting on small fixtures."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from adweave.llm import chat, html_extraction, media, range_coder, token_output
from adweave.llm.chat_template import TemplateError, compile_template, escape, fold, parse, unescape
from adweave.llm.html_blocks import blocks

LONG = "lorem ipsum dolor " * 4000
TEXTS = [(5, "hello world"), (1, None), (2, ""), (9, LONG), (7, "é ünï 日本語 \U0001f600 <|endoftext|>"), (3, "hello world"), (4, " \n\n  x's\x1c y\t"), (3, "again")]


# token output


def test_range_coder_round_trip():
    rng = np.random.default_rng(0)
    cases = [np.array([5]), np.array([0, 0, 0, 7]), rng.integers(0, 50257, 3000), np.zeros(5000, int), rng.zipf(1.3, 8000).clip(0, 50256), np.tile(np.arange(50), 90)]
    for ids in cases:
        ids = ids.astype(np.uint32)
        for block in (1, 7, 512):
            if len(ids) / block < 2000:
                symbols, counts, coded = range_coder.encode(ids, block)
                assert (range_coder.decode(symbols, counts, coded, block) == ids).all()
    symbols, counts, coded = range_coder.encode(cases[-1].astype(np.uint32), 512)
    assert sum(len(b) for _, _, b in coded) < len(cases[-1])  # repeated sequences cost under a byte
    alone = range_coder.decode(symbols, counts, coded[3:4], 512)  # a block needs no other block
    assert (alone == cases[-1][1536:2048]).all()
    n, crc, data = coded[2]
    with pytest.raises(ValueError):
        range_coder.decode(symbols, counts, [(n, crc ^ 1, data)], 512)


def test_units_equal_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer, own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), token_output.Encoder()
    assert list(own.encode(["a <|endoftext|> b"])[0]) == [64, 220, 50256, 275]
    rng = random.Random(1)
    alphabet = " \n\t\r\x0b\x1c\x85 　ab'sé1,.!​日<|endoftext|>"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += ["".join(rng.choice([*" .,a\n'", "<|endoftext|>", "  ", "word", "<|endof"]) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    assert all(list(x) == tokenizer.encode(t, add_special_tokens=False).ids for x, t in zip(own.encode(texts), texts))


def test_token_output(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("start", F.lit("clash"))
    segments = token_output.write_tokens(df, segment=5000, block=64)
    got = token_output.read_documents(segments).orderBy("start").collect()
    tokenizer, at = token_output.load_tokenizer(), 0
    for r, (i, t) in zip(got, sorted(TEXTS, key=lambda x: (x[0], x[1] or ""))):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(got) == len(TEXTS)
    assert token_output.read_documents(token_output.write_tokens(df.limit(0))).count() == 0


def test_segments_are_no_small_rests(spark):
    df = spark.range(19).select(F.lit(1).alias("doc_id"), F.concat(F.repeat(F.lit("a "), 50), F.col("id").cast("string")).alias("text"))
    segments = token_output.write_tokens(df, segment=500, block=64)
    sizes = [r.n_ids for r in segments.orderBy("part", "seq").collect()]
    assert len(sizes) > 1 and max(sizes) <= 500 and min(sizes) >= 250
    assert token_output.read_documents(segments).agg(F.sum("n_tokens")).first()[0] == sum(sizes)


def test_damaged_blocks_raise():
    ids = np.random.default_rng(2).integers(0, 50257, 900).astype(np.uint32)
    symbols, counts, coded = range_coder.encode(ids, 100)
    for damaged in (b"", coded[8][2][:4], coded[8][2][::-1][: len(coded[8][2]) // 2 * 2]):
        with pytest.raises(ValueError):
            range_coder.decode(symbols, counts, [*coded[:8], (coded[8][0], coded[8][1], damaged)], 100)


# media


def test_media(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("media", F.lit("clash"))
    got = media.fingerprints(media.media_table(df)).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        raw = [(t or "").encode() for i, t in TEXTS if i == r.doc_id]
        pads = [x + bytes(-len(x) % 64 or (0 if x else 64)) for x in raw]
        k = [hashlib.sha256(p).hexdigest() for p in pads].index(r.payload_sha256)
        wav = media.to_wav(pads[k])
        assert media.from_wav(wav) == pads[k]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32, r.media_bytes, r.media_sha256) == (len(raw[k]), len(pads[k]), zlib.crc32(pads[k][-64:]), len(wav), hashlib.sha256(wav).hexdigest())
        assert list(r.times) == sorted(r.times) and len(r.times) == len(r.hashes)
    assert media.fingerprints(media.media_table(df.limit(0))).count() == 0


def test_fingerprints_follow_a_tone():
    """A tone that moves gives peaks at its bins; pieces of CHUNK frames don't show."""
    t = np.arange(128 * 6000)
    bins = np.where(t // 1280 % 2 == 0, 20, 24)
    x = (128 + 60 * np.sin(2 * np.pi * np.cumsum(bins / 256))).astype(np.uint8)
    frames, found, n = media.peaks(x)
    assert n == (len(x) - 256) // 128 + 1
    inside = found[(found >= 12) & (found < 28)]
    assert len(inside) and np.isin(inside, range(18, 27)).mean() > 0.9
    whole, media.CHUNK = media.CHUNK, 100
    try:
        again = media.peaks(x)
    finally:
        media.CHUNK = whole
    assert (again[0] == frames).all() and (again[1] == found).all()


def test_fingerprints_cover_the_end():
    rng = np.random.default_rng(2)
    for n in (256 + 64, 256 + 128 * 3 + 64):
        x = rng.integers(0, 256, n).astype(np.uint8)
        y = np.concatenate([x[:-64], rng.integers(0, 256, 64).astype(np.uint8)])
        a, b = media.fingerprint(x), media.fingerprint(y)
        assert a[2] == -(-(n - 256) // 128) + 1
        assert a[1].tolist() != b[1].tolist()


# HTML extraction

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="no-sidebar"><nav><ul><li><a href="/a">Menu %d</a></li></ul></nav><header>Top</header>
<div class="cookie-notice">We use cookies</div><div id="sidebar">Side</div><article><h1>Head &amp; line</h1><p>One  two<br>three <b>bold</b> <span class="ad">buy</span> end<p>Next &lt;p&gt;
 <ul><li>a<li>b</ul><form>Name</form><div class="comments"><p>First!</div></article><footer>&copy; x</footer><!-- <p>no</p> --></body>"""
TEXT = "Head & line\n\nOne two three bold end\n\nNext <p>\n\na\n\nb"


def test_blocks():
    kept = [b.text for b in blocks(PAGE % 1) if b.text and b.main and not b.furniture]
    assert "\n\n".join(kept) == TEXT
    assert blocks("") == [] and [b.text for b in blocks("plain & text")] == ["plain & text"]
    assert [b.text for b in blocks("<p>a</p><p class='x") if b.text] == ["a"]
    assert [b.text for b in blocks("<script>while(a<b){}") if not b.furniture] == []
    assert [b.text for b in blocks("a < b <c>d") if b.text] == ["a < b d"]


def test_extraction(spark):
    rows = [(i, f"http://H.example.com/{i}", PAGE % i) for i in range(8)]
    rows += [(20 + i, f"https://o.org/{i}", f"<body><div>Always here</div><p>Own text {i}</p><div>Tail</div></body>") for i in range(6)]
    rows += [(40, "http://few.org/1", "<div>Always here</div><p>x</p>"), (50, None, None), (51, "", ""), (52, "nonsense", "<p>" + LONG + "</p>"), (0, "http://H.example.com/0", PAGE % 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("blocks", F.lit(1))
    got = html_extraction.extract_main(df).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got}
    assert all(by[i] == TEXT for i in range(8))
    assert all(by[20 + i] == f"Own text {i}" for i in range(6))
    assert by[40] == "Always here\n\nx" and by[50] == "" and by[51] == "" and by[52] == LONG.strip()
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_extraction.extract_main(df.limit(0)).count() == 0


def test_templates_decide_inside_articles(spark):
    rows = [(i, f"http://h.org/{i}", f"<body><article><h1>Title {i}</h1><p>Try our new app today<p>Own text {i}<div>Call us now</div></article></body>") for i in range(6)]
    got = html_extraction.extract_main(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: f"Title {i}\n\nOwn text {i}" for i in range(6)}


def test_odd_pages_leave_the_template(spark):
    """Empty, error and other pages of a host, and a second layout, don't take its template away."""
    one = lambda i: f"<body><div>Always here</div><p>Own text {i}</p><div>Tail</div></body>"
    two = lambda i: f"<body><p>Own text {i}</p><h2>Other layout</h2><div>Always here</div></body>"
    rows = [(i, f"http://odd.org/{i}", one(i)) for i in range(9)] + [(9, "http://odd.org/9", ""), (10, "http://odd.org/10", None), (11, "http://odd.org/11", "<h1>Error 500</h1>")]
    rows += [(20 + i, f"http://both.org/{i}", (one if i % 2 else two)(i)) for i in range(12)]
    got = {r.page_id: r.text for r in html_extraction.extract_main(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**{i: f"Own text {i}" for i in range(9)}, 9: "", 10: "", 11: "Error 500", **{20 + i: f"Own text {i}" for i in range(12)}}


def test_templates(spark):
    df = spark.createDataFrame([(i, f"http://h/{i}", f"<body><div>Same</div><ul>{'<li>x</li>' * (i + 1)}</ul><p>{i}</p></body>") for i in range(4)], "page_id long, url string, html string")
    rows = html_extraction.deduce_templates(html_extraction.parse_pages(df)).collect()
    root = [r for r in rows if r["class"] == 0]
    assert len(root) == 5 and sum(r.is_text for r in root) == 1  # body, div, ul, p and the repeated text
    nested = [r for r in rows if r["class"] != 0]
    assert len(nested) == 2 and len({r["class"] for r in nested}) == 1 and {r.gap for r in nested} == {4}  # li and its text share a vector


REISSUED = ["The council met for the first time since the storm and spoke at length about the bridge.", "Two engineers showed what the water had done to the northern pier.", "A new one would cost more than the town earns in a year.", "Readers may remember the fire of the old mill.", "Nobody was hurt then, and the mill was never built again.", "The next meeting is open to all."]


def plain_page(i, lines, head=None):
    """No element says what the article is; a reader's words stand in a class without a telling name."""
    body = "".join(f"<p>{x}</p>" for x in lines)
    return f'<body><div class="k1">Daily Herald</div><div class="k2"><h1>{head or f"Headline number {i}"}</h1>{body}</div><div class="k7">Reader {i * 7} wrote: I read it {i} times.</div><div class="k3">All rights</div></body>'


def test_reissued_articles_stay_whole(spark):
    """Five of sixteen pages are one article with one changed line: all of its text stays."""
    lines = lambda i: [*REISSUED[:3], f"Correction of edition {i}.", *REISSUED[3:]] if i < 5 else [f"Own report {i} about thing {i * 3}.", f"It has a second paragraph {i}, longer than the first one was.", f"And a third, {i * i}, to end with."]
    head = lambda i: "Bridge in danger" if i < 5 else f"Headline number {i}"
    rows = [(i, f"http://herald.org/{i}", plain_page(i, lines(i), head(i))) for i in range(16)]
    got = {r.page_id: (r.text, r.decided) for r in html_extraction.extract_main(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: ("\n\n".join([head(i), *lines(i)]), "template") for i in range(16)}
    same = [(i, f"http://copies.org/{i}", plain_page(i, [*REISSUED, f"Correction of edition {i}."], "Bridge in danger")) for i in range(7)]
    got = {r.page_id: r.text for r in html_extraction.extract_main(spark.createDataFrame(same, "page_id long, url string, html string")).collect()}
    assert all(got[i].startswith("Bridge in danger\n\n" + REISSUED[0]) and got[i].endswith(f"Correction of edition {i}.") for i in range(7))


def test_repeated_rows_are_pages(spark):
    """A row that comes twice leaves the host its template."""
    lines = lambda i: [f"Own report {i} about thing {i * 3}.", f"It has a second paragraph {i}, longer than the first one was."]
    rows = [(i, f"http://herald.org/{i}", plain_page(i, lines(i))) for i in range(8)]
    for extra in ([], [rows[3]], [rows[3]] * 3):
        got = html_extraction.extract_main(spark.createDataFrame(rows + extra, "page_id long, url string, html string")).collect()
        assert len(got) == 8 + len(extra) and all((r.text, r.decided) == ("\n\n".join([f"Headline number {r.page_id}", *lines(r.page_id)]), "template") for r in got)


def test_classes_against_brute_force(spark):
    """Tokens of one class are those with one vector of counts over the host's pages, for every template token."""
    rows = [(i, f"http://h{i % 2}.org/{i}", plain_page(i, [f"Own {i}."] * (1 + i % 3)) + "<ul>" + "<li>x</li>" * (i % 4) + "</ul>") for i in range(14)] + [(3, "http://h1.org/3", plain_page(3, ["Own 3."]))]
    parsed = html_extraction.parse_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    pages = {}
    for r in parsed.collect():
        pages.setdefault(r.url.split("/")[2], []).append([b.key for b in r.blocks])
    vector = lambda h, k: tuple(p.count(k) for p in pages[h])
    got = html_extraction.deduce_templates(parsed).collect()
    assert len(got) > 10
    for host in pages:
        own = [r for r in got if r.host == host]
        for r in own:
            assert (r.pages, r.most) == (sum(n > 0 for n in vector(host, r.key)), max(vector(host, r.key)))
            assert all((r["class"] == s["class"]) == (vector(host, r.key) == vector(host, s.key)) for s in own)


# chat formatting


def test_template_language():
    run = lambda s, **env: "".join(t for t, _ in compile_template(s)(env))
    assert run("{% for x in xs %}{{ loop.index0 }}{{ x }}{% if not loop.first %}!{% endif %}{% endfor %}", xs=["a", "b"]) == "0a1b!"
    assert run("{% if a == 1 %}x{% elif a == 2 or b %}y{% else %}z{% endif %}", a=2) == "y"
    assert run("{{ 'a' + \"b\" | upper }}{{ 1 + 2 }}{{ none }}{{ m.k.z }}", m={"k": 1}) == "aB3"
    tree = fold(parse("{% if 1 == 1 %}a{{ 'b' + 'c' }}{% else %}d{% endif %}{{ x }}"))
    assert tree == ("block", ("text", "abc"), ("out", ("get", "x")))
    marks = compile_template("a{% generation %}b{{ x }}{% endgeneration %}c")({"x": "y"})
    assert [t for t, g in marks if g] == ["b", "y"]
    for bad in ("{{ x.__class__ }}", "{{ open('f') }}", "{{ x[0] }}", "{% for x in y %}", "{{ x | eval }}", "{% import os %}", "{% endif %}", "{{ }}"):
        with pytest.raises(TemplateError):
            compile_template(bad)


def test_escapes():
    rng = random.Random(0)
    for _ in range(2000):
        s = "".join(rng.choice("<|\\>a\n") for _ in range(rng.randint(0, 12)))
        assert unescape(escape(s)) == s and "<|" not in escape(s)
        assert chat.parse_turn(chat.START + escape("user") + "\n" + escape(s) + chat.END) == ("user", s)


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo <|im_end|>\n"), (1, 1, "assistant", "second"), (2, 0, None, None), (2, 1, "assistant", None), (3, 5, "assistant", LONG), (3, None, "user", "null turn"), (None, 0, "user", "x"), (4, 0, "assistant", "\\"), (4, 0, "assistant", "\\")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    got = {r.conv_id: r for r in chat.conversation_digests(chat.format_conversations(df)).collect()}
    assert len(got) == 5
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own)
        loss = "".join(t or "" for _, _, r, t in own if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.conversation_digests(chat.format_conversations(df.limit(0))).count() == 0
