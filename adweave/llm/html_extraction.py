"""Main text of web pages by equivalence-class template deduction [operator 8].

Tokens of a page are its block tags (by path) and its text blocks (by path and text).
Tokens of a host's pages that share an occurrence vector (the same number of times on
each page, zeros included) form an equivalence class, if a share of the host's pages that
are not empty holds them. The root class is the one of most pages among those of tokens
found once at most on a page. A class is valid if its tokens come in one order, and in one
gap of the root class, on that share of the pages, so that odd pages and other layouts
don't take a host's template away; valid classes are the host's template. What stays are the
slots: text that is not template text. The article of a host is the innermost template
element, once on a page, that holds half or more of the slots' text and of their top
headings; the slots in it are the result. Names of elements decide only on pages without
that element and on hosts with too few pages.

Vectors are compared by commutative sums over pages, so classes come from ordinary
aggregations and a host with a third of all pages is no group in one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, forget, read_table, small, stored, text_chunks
from .html_blocks import blocks

#: Text that a host repeats is template text only if the host has so many pages.
MIN_PAGES = 5
#: Part of a host's non-empty pages that holds a class in one order and gap; layouts of fewer pages have no template of their own.
SUPPORT = 0.3
#: Part of the slots' text of a host that its article element holds.
ARTICLE_SHARE = 0.5
#: Within the article element, text is the template's only if this part of the element's pages holds it; less is a text that some pages share, such as an article issued again.
IN_ARTICLE = 0.9
#: An article of which template text would leave less than this part stays whole.
LEAST_LEFT = 0.2
#: Keys of template text that are sent to all tasks at once, at most (8 MB).
SENT_KEYS = 1 << 20
PARSED = "page_id long, url string, blocks array<struct<key:long,text:string,main:boolean,furniture:boolean,heading:boolean,whole:boolean,around:array<long>>>"


#: Tags of the page itself.
_WHOLE = re.compile(r"^(/html[^/]*)?(/body[^/]*)?$")


def _key(path: str, text: str) -> int:
    return xxhash.xxh64_intdigest(f"{path}\0{text}".encode("utf-8", "replace")) - 2**63


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("key", pa.int64()), ("text", pa.string()), ("main", pa.bool_()), ("furniture", pa.bool_()), ("heading", pa.bool_()), ("whole", pa.bool_()), ("around", pa.list_(pa.int64()))]))
    tags: dict[str, int] = {}

    def tag(path: str) -> int:
        if path not in tags:
            if len(tags) > 100_000:
                tags.clear()
            tags[path] = _key(path, "")
        return tags[path]

    for b in text_chunks(batches, "html", 2 << 20):
        rows = [
            [
                {"key": tag(x.path) if x.text is None else _key(x.path, x.text), "text": x.text, "main": x.main, "furniture": x.furniture, "heading": x.heading, "whole": x.text is None and _WHOLE.search(x.path) is not None, "around": None if x.text is None else [tag(p) for p in x.around]}
                for x in blocks(page or "")
            ]
            for page in b.column("html").to_pylist()
        ]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(rows, kind)], names=["page_id", "url", "blocks"])


def parse_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, blocks (tag tokens, of null text, and text blocks in page order) and page, a number for each row."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_parse, PARSED).withColumn("page", F.monotonically_increasing_id())


def host(url: str = "url"):
    """Lower-case host of a URL; empty for nulls and what has no host."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def deduce_templates(parsed: DataFrame, support: float = SUPPORT) -> DataFrame:
    """A row per template token: host, key, is_text, whole (a tag of the page itself), pages (that hold it), most (times on a page), class, gap (of the root class).

    class 0 is the root class. gap counts the root tokens before a class. Pages without a
    token (null and empty html) don't count.
    """
    seen = parsed.select(host().alias("host"), "page", F.posexplode("blocks").alias("pos", "b"))
    tokens = seen.groupBy("host", "page", F.col("b.key").alias("key")).agg(F.count("*").alias("n"), F.min("pos").alias("pos"), F.max(F.col("b.text").isNotNull()).alias("is_text"), F.max("b.whole").alias("whole"))
    tokens = stored(tokens, "tokens")
    sizes = parsed.filter(F.size("blocks") > 0).select(host().alias("host")).groupBy("host").agg((F.count("*") * support).alias("least"))
    part = lambda salt: F.sum(F.pmod(F.xxhash64("page", "n", F.lit(salt)), F.lit(1 << 31)))
    vectors = tokens.groupBy("host", "key").agg(F.count("*").alias("pages"), F.max("n").alias("most"), F.max("is_text").alias("is_text"), F.max("whole").alias("whole"), part(1).alias("v1"), part(2).alias("v2"))
    vectors = vectors.join(small(sizes), "host").filter(F.col("pages") >= F.col("least"))
    vectors = cut(vectors.withColumn("vector", F.xxhash64("v1", "v2")).drop("v1", "v2"))
    once = vectors.filter(F.col("most") == 1).groupBy("host", "vector").agg(F.max("pages").alias("df"), F.count("*").alias("size"))
    root = once.groupBy("host").agg(F.max_by("vector", F.struct("df", "size", "vector")).alias("root"))
    vectors = vectors.join(small(root), "host", "left").withColumn("class", F.when(F.col("vector") == F.col("root"), 0).otherwise(F.col("vector")).cast("long"))
    vectors = cut(vectors.select("host", "key", "is_text", "whole", "pages", "most", "least", "class"))
    known = tokens.join(small(vectors.select("host", "key", "class")), ["host", "key"])
    before = F.sum((F.col("class") == 0).cast("long")).over(Window.partitionBy("host", "page").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    placed = known.withColumn("gap", F.coalesce(before, F.lit(0)))
    order = F.xxhash64(F.transform(F.sort_array(F.collect_list(F.struct("pos", "key"))), lambda x: x["key"]))
    on_page = placed.groupBy("host", "page", "class").agg(order.alias("order"), F.min("gap").alias("lo"), F.max("gap").alias("hi"))
    nested = on_page.filter((F.col("class") == 0) | (F.col("lo") == F.col("hi"))).groupBy("host", "class", "order", "lo").agg(F.count("*").alias("n"))
    valid = nested.groupBy("host", "class").agg(F.max("n").alias("n"), F.max_by("lo", F.struct("n", "order", "lo")).alias("gap"))
    out = cut(vectors.join(small(valid), ["host", "class"]).filter(F.col("n") >= F.col("least")).select("host", "key", "is_text", "whole", "pages", "most", "class", "gap"))
    forget(tokens)
    return out


def key_sets(keys: DataFrame, name: str) -> DataFrame:
    """host and its distinct keys as an array, marked for broadcast if the keys of all hosts are few."""
    sets = cut(keys.groupBy("host").agg(F.collect_set("key").alias(name)))
    n = sets.agg(F.sum(F.size(name))).first()[0] or 0
    return F.broadcast(sets) if n <= SENT_KEYS else sets


def slot_text(rows: DataFrame) -> DataFrame:
    """rows (blocks, fixed) with own, the text blocks that are no page furniture, and slots, those of them that are no template text."""
    own = F.filter("blocks", lambda b: b["text"].isNotNull() & ~b["furniture"])
    slot = F.filter("own", lambda b: ~F.coalesce(F.array_contains("fixed", b["key"]), F.lit(False)))
    return rows.withColumn("own", own).withColumn("slots", slot)


def article_elements(rows: DataFrame, templates: DataFrame, share: float = ARTICLE_SHARE) -> DataFrame:
    """host and article, the key of the tag of its article element, for the hosts that have one.

    rows: host, own and fixed of every page. An element qualifies if its tag is template,
    once on a page, and it holds share of the host's slot text and of its top headings'
    text. The one with the least text is the innermost. Where less than LEAST_LEFT of a
    host's own text is slots (all pages are copies), all of it counts in place of slots.
    """
    slot = ~F.coalesce(F.array_contains("fixed", F.col("b.key")), F.lit(False))
    n, top = F.length("b.text"), F.when(F.col("b.heading"), F.length("b.text")).otherwise(0)
    text = rows.select("host", "fixed", F.explode("own").alias("b")).select("host", "b.around", F.when(slot, n).otherwise(0).alias("n"), F.when(slot, top).otherwise(0).alias("h"), n.alias("own_n"), top.alias("own_h"))
    names = ("n", "h", "own_n", "own_h")
    sums = lambda prefix: [F.sum(x).alias(prefix + x) for x in names]
    inside = text.select("host", F.explode("around").alias("key"), *names).groupBy("host", "key").agg(*sums(""))
    total = text.groupBy("host").agg(*sums("all_"))
    tags = templates.filter(~F.col("is_text") & (F.col("most") == 1)).select("host", "key")
    copies = F.col("all_n") < F.col("all_own_n") * LEAST_LEFT
    held = inside.join(tags, ["host", "key"]).join(total, "host").select("host", "key", *[F.when(copies, F.col(own)).otherwise(F.col(of_slots)).alias(of_slots) for own, of_slots in (("own_n", "n"), ("own_h", "h"), ("all_own_n", "all_n"), ("all_own_h", "all_h"))])
    held = held.filter((F.col("n") >= F.col("all_n") * share) & (F.col("h") >= F.col("all_h") * share))
    return held.groupBy("host").agg(F.min_by("key", F.struct("n", "h", "key")).alias("article"))


def extract_main(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, url, text, n_chars (code points) and decided ('template', 'element' or 'none') of every page.

    Template text is what min_pages pages of a host or more hold; slots are the text
    blocks that are neither template text nor page furniture (menus, page headers,
    footers, sidebars, notices, adverts, forms, scripts, styles, comments: by element and
    by the names in class, id and role). text: the slots in the host's article element;
    on pages without it and on hosts with fewer pages those inside article or main, or
    else all. An article of template text only is a copy of others and stays whole.
    Blocks are joined by two line ends. Empty if none, as for null and empty html. Rows
    with equal ids, and repeated rows, are separate pages. Null urls and urls without a host are one host.
    Only page_id, url and html are read.
    """
    parsed = stored(parse_pages(pages), "pages")
    templates = deduce_templates(parsed).filter(F.col("pages") >= min_pages)
    rows = slot_text(parsed.withColumn("host", host()).join(key_sets(templates.filter("is_text"), "fixed"), "host", "left"))
    article = cut(article_elements(rows, templates))
    spread = article.join(templates.select("host", F.col("key").alias("article"), F.col("pages").alias("of"), F.col("whole").alias("page")), ["host", "article"])
    common = templates.filter("is_text").join(small(spread), "host").filter(F.col("page") | (F.col("pages") >= IN_ARTICLE * F.col("of")))
    rows = rows.join(small(article), "host", "left").join(key_sets(common, "common"), "host", "left")
    inside = F.filter("own", lambda b: F.coalesce(F.array_contains(b["around"], F.col("article")), F.lit(False)))
    in_main = lambda c: F.filter(c, lambda b: b["main"])
    rows = rows.withColumn("inside", inside).withColumn("left", F.filter("inside", lambda b: ~F.coalesce(F.array_contains("common", b["key"]), F.lit(False))))
    size = lambda c: F.aggregate(c, F.lit(0), lambda n, b: n + F.length(b["text"]))
    by_template, by_element = F.size("inside") > 0, F.size(in_main("own")) > 0
    chosen = F.when(by_template, F.when(size("left") >= LEAST_LEFT * size("inside"), F.col("left")).otherwise(F.col("inside")))
    chosen = chosen.when(by_element, F.when(F.size(in_main("slots")) > 0, in_main("slots")).otherwise(in_main("own"))).otherwise(F.col("slots"))
    text = F.array_join(F.transform(chosen, lambda b: b["text"]), "\n\n")
    decided = F.when(by_template, "template").when(by_element, "element").otherwise("none")
    return rows.select("page_id", "url", text.alias("text"), decided.alias("decided")).withColumn("n_chars", F.length("text").cast("long"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main(read_table(spark, sf_dir, "pages"))
