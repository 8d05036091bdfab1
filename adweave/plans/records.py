"""Lookups, payloads, keyed writes, orders and roll-ups over the proxy tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules, scores, text
from ..operators.joins import first_per, resolved_in_tiers
from ..operators.similarity import vectors_near
from ..streaming.base import shared_folder
from .base import Registry, Tables, case
from .reporting import _SCOPE, scoped

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
c = F.col
n_if = lambda x: F.count_if(x)


@R.add("a2_point_lookup", "SELECT k AS key, c_name AS name FROM (VALUES (7), (-1), (12)) v(k) LEFT JOIN customer ON c_custkey = k")
def point_lookup(t: Tables) -> DataFrame:
    """A2: rows by key, null where there is none."""
    keys = t.spark.createDataFrame([(7,), (-1,), (12,)], "key long")
    return keys.join(t.customer.filter(c("c_custkey").isin(7, -1, 12)).select(c("c_custkey").alias("key"), c("c_name").alias("name")), "key", "left")


@R.add("a4_accuracy_view", "SELECT source_type, channel, count(*) AS total, count(*) FILTER (was_correct) AS correct FROM feedback WHERE channel = '1-URGENT' AND created_at >= TIMESTAMP '1996-01-01' GROUP BY 1, 2 HAVING count(*) >= 2")
def accuracy_view(t: Tables) -> DataFrame:
    """A4: a view with filters that are added as given."""
    given = {"channel": "1-URGENT", "source_type": None}
    f = t.feedback.filter(c("created_at") >= F.lit("1996-01-01").cast("timestamp_ntz"))
    for k, v in given.items():
        f = f if v is None else f.filter(c(k) == v)
    return f.groupBy("source_type", "channel").agg(F.count("*").alias("total"), n_if(c("was_correct")).alias("correct")).filter("total >= 2")


_ADS = """a AS (SELECT o_orderkey AS ad, CASE WHEN o_orderkey % 5 = 0 THEN 'Dealer ' || o_custkey ELSE 'Page ' || o_custkey END AS name, o_orderkey % 11 = 0 AS bare,
  CASE o_orderkey % 4 WHEN 0 THEN ['http://i/' || o_orderkey] WHEN 1 THEN ['http://r/' || o_orderkey] ELSE [] END AS images, CASE WHEN o_orderkey % 6 = 0 THEN ['http://p/' || o_orderkey] ELSE [] END AS videos,
  CASE WHEN o_orderkey % 7 = 0 THEN ['http://c/' || o_orderkey, 'ftp://c/' || o_orderkey] ELSE [] END AS cards, o_orderkey % 1000 * 1000000 AS started FROM orders),
m AS (SELECT *, CASE WHEN bare THEN [] ELSE list_filter(list_concat(images, videos, cards), lambda u: starts_with(u, 'http')) END AS media FROM a)"""


def ads(t: Tables) -> DataFrame:
    """Nested ad payloads as JSON lines, written and read again, then flattened: ad, name, started, format, media."""
    k, s = c("o_orderkey"), c("o_orderkey").cast("string")
    url = lambda p: F.concat(F.lit(p), s)
    none = lambda kind: F.array().cast(f"array<{kind}>")
    image, video, card = "struct<original_image_url:string,resized_image_url:string>", "struct<video_hd_url:string,video_sd_url:string,video_preview_image_url:string>", "struct<original_image_url:string,image_url:string,video_hd_url:string>"
    images = F.when(k % 4 == 0, F.array(F.struct(url("http://i/").alias("original_image_url"), F.lit("http://x").alias("resized_image_url")))).when(k % 4 == 1, F.array(F.struct(F.lit("").alias("original_image_url"), url("http://r/").alias("resized_image_url")))).otherwise(none(image))
    videos = F.when(k % 6 == 0, F.array(F.struct(F.lit(None).cast("string").alias("video_hd_url"), F.lit("").alias("video_sd_url"), url("http://p/").alias("video_preview_image_url")))).otherwise(none(video))
    one = lambda a, b: F.struct(a.alias("original_image_url"), b.alias("image_url"), F.lit(None).cast("string").alias("video_hd_url"))
    cards = F.when(k % 7 == 0, F.array(one(url("http://c/"), F.lit(None).cast("string")), one(F.lit(""), url("ftp://c/")))).otherwise(none(card))
    snap = F.when(k % 11 != 0, F.struct(images.alias("images"), videos.alias("videos"), cards.alias("cards")))
    dealer, page = F.concat(F.lit("Dealer "), c("o_custkey").cast("string")), F.concat(F.lit("Page "), c("o_custkey").cast("string"))
    raw = t.orders.select(
        F.when(k % 3 == 0, k).alias("adArchiveID"), F.when(k % 3 != 0, k).alias("ad_archive_id"), F.when(k % 5 == 0, "").otherwise(page).alias("pageName"), F.when(k % 5 == 0, dealer).alias("page_name"),
        F.when(k % 2 == 0, (k % 1000 * 1000000).cast("string")).otherwise((k % 1000 * 1000000 * 1000).cast("string")).alias("startDate"), snap.alias("snapshot"),
    )
    at = f"{shared_folder(t.spark)}/ads-{uuid.uuid4().hex}"
    raw.write.json(at)
    p = t.spark.read.schema(f"adArchiveID long, ad_archive_id long, pageName string, page_name string, startDate string, snapshot struct<images:array<{image}>,videos:array<{video}>,cards:array<{card}>>").json(at)
    flat = lambda col, *keys: F.transform(F.coalesce(col, F.array()), lambda x: text.first_filled(*[x[key] for key in keys]))
    i = flat(c("snapshot.images"), "original_image_url", "resized_image_url")
    v = flat(c("snapshot.videos"), "video_hd_url", "video_sd_url", "video_preview_image_url")
    d = flat(c("snapshot.cards"), "original_image_url", "image_url", "video_hd_url")
    kind = F.when(F.size(d) > 1, "carousel").when(F.size(v) > 0, "video").otherwise("image")
    media = F.filter(F.concat(i, v, d), lambda u: F.coalesce(u, F.lit("")).startswith("http"))
    started = F.when(c("startDate").cast("long") > 10_000_000_000, (c("startDate").cast("long") / 1000).cast("long")).otherwise(c("startDate").cast("long"))
    return p.select(F.coalesce("adArchiveID", "ad_archive_id").alias("ad"), text.first_filled(c("pageName"), c("page_name")).alias("name"), started.alias("started"), kind.alias("format"), media.alias("media"))


@R.add(
    "a9_ad_payload",
    f"""WITH {_ADS} SELECT ad, name, CASE WHEN started * 1000 > 10000000000 OR ad % 2 = 0 THEN started ELSE started * 1000 END AS started, CASE WHEN bare THEN 'image' WHEN len(cards) > 1 THEN 'carousel' WHEN len(videos) > 0 THEN 'video' ELSE 'image' END AS format, len(media)::BIGINT AS n_media, array_to_string(media, ' ') AS media FROM m""",
)
def ad_payload(t: Tables) -> DataFrame:
    """Aliased keys, seconds or milliseconds, media of images, videos and cards, carousel before video before image."""
    return ads(t).select("ad", "name", "started", "format", F.size("media").cast("long").alias("n_media"), F.array_join("media", " ").alias("media"))


@R.add("c39_fallback_images", f"""WITH {_ADS} SELECT ad, CASE WHEN len(media) > 0 THEN media[1] ELSE 'http://f/' || ad END AS image, len(media) = 0 AS by_fallback FROM m WHERE len(media) > 0 OR ad % 2 = 0""")
def fallback_images(t: Tables) -> DataFrame:
    """Images looked up only for ads without media; ads that still have none go."""
    a = ads(t).select("ad", "media")
    lookup = t.orders.filter("o_orderkey % 2 = 0").select(c("o_orderkey").alias("ad"), F.concat(F.lit("http://f/"), c("o_orderkey").cast("string")).alias("image"))
    with_media = a.filter(F.size("media") > 0).select("ad", c("media")[0].alias("image"), F.lit(False).alias("by_fallback"))
    return with_media.unionByName(a.filter(F.size("media") == 0).select("ad").join(lookup, "ad").withColumn("by_fallback", F.lit(True)))


@R.add("a13_search_pages", "WITH x AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 300000 ORDER BY o_orderkey LIMIT 2000) SELECT o_orderkey, i // 100 AS page FROM x")
def search_pages(t: Tables) -> DataFrame:
    """An equality and a lower bound pushed to the scan, at most 20 pages of 100."""
    x = t.orders.filter((c("o_orderstatus") == "O") & (c("o_totalprice") >= 300000)).select("o_orderkey").orderBy("o_orderkey").limit(2000)
    return x.select("o_orderkey", F.floor((F.row_number().over(Window.orderBy("o_orderkey")) - 1) / 100).alias("page"))  # two thousand rows


@R.add("a23_bulk_update", "SELECT match_id, price, coalesce(status = 'violation' AND score >= 96, false) AS is_processed FROM matches")
def bulk_update(t: Tables) -> DataFrame:
    """Rows of a list of ids are marked, the others stay; repeated and null ids in the list don't count."""
    ids = t.matches.filter("status = 'violation' AND score >= 96").select("match_id", "price").distinct().withColumn("hit", F.lit(True))
    return t.matches.join(ids, ["match_id", "price"], "left").select("match_id", "price", F.coalesce("hit", F.lit(False)).alias("is_processed"))


@R.add(
    "a27_compliance_push",
    """SELECT d.distributor_id, coalesce(round(g.ok * 100.0 / nullif(g.n, 0), 1), 0.0) AS score, coalesce(g.v, 0) AS open_violations, coalesce(g.v, 0) > 0 AS flagged
    FROM dealers d LEFT JOIN (SELECT distributor_id, count(*) AS n, count(*) FILTER (status='violation') AS v, count(*) FILTER (status='compliant') AS ok FROM matches GROUP BY 1) g USING (distributor_id) WHERE d.status = 'active'""",
)
def compliance_push(t: Tables) -> DataFrame:
    """Score over all matches of an active dealer (0.0 without any), open violations, and the flag from the first one."""
    g = t.matches.groupBy("distributor_id").agg(F.count("*").alias("n"), n_if(c("status") == "violation").alias("v"), n_if(c("status") == "compliant").alias("ok"))
    n, v, ok = (F.coalesce(x, F.lit(0)) for x in ("n", "v", "ok"))
    return t.dealers.filter("status = 'active'").join(g, "distributor_id", "left").select("distributor_id", scores.rate(ok, n).alias("score"), v.alias("open_violations"), (v > 0).alias("flagged"))


@R.add(
    "a28_sink_limits",
    """WITH v AS (SELECT d.org_id, m.match_id, row_number() OVER (PARTITION BY d.org_id ORDER BY m.score DESC, m.match_id, m.price) AS rn, count(*) OVER (PARTITION BY d.org_id) AS n FROM matches m JOIN dealers d USING (distributor_id) WHERE m.status = 'violation'),
    s AS (SELECT * FROM (VALUES ('mail', 20), ('chat', 10), ('crm', 15), ('team', 20)) x(sink, most)) SELECT org_id, sink, match_id, CAST(rn AS INTEGER) AS place, greatest(n - most, 0) AS more FROM v JOIN s ON rn <= most""",
)
def sink_limits(t: Tables) -> DataFrame:
    """The violations that each sink shows, 20, 10, 15 or 20 of them, and how many more there are."""
    sinks = t.spark.createDataFrame([("mail", 20), ("chat", 10), ("crm", 15), ("team", 20)], "sink string, most int")
    v = t.matches.filter("status = 'violation'").join(t.dealers.select("distributor_id", "org_id"), "distributor_id").select("org_id", "match_id", "score", "price")
    w = Window.partitionBy("org_id").orderBy(F.desc("score"), "match_id", "price")
    top = v.withColumn("place", F.row_number().over(w)).filter("place <= 20")
    x = top.join(v.groupBy("org_id").agg(F.count("*").alias("n")), "org_id").join(F.broadcast(sinks), c("place") <= c("most"))  # four rows
    return x.select("org_id", "sink", "match_id", "place", F.greatest(c("n") - c("most"), F.lit(0)).alias("more"))


@R.add(
    "l9_report",
    """SELECT 'preamble' AS section, 'all' AS name, count(*) AS total, count(*) FILTER (status='violation') AS violations, round(count(*) FILTER (status='compliant') * 100.0 / count(*), 1) AS rate FROM matches
    UNION ALL SELECT 'dealer', d.name, count(*), count(*) FILTER (m.status='violation'), round(count(*) FILTER (m.status='compliant') * 100.0 / count(*), 1) FROM matches m JOIN dealers d USING (distributor_id) GROUP BY 2
    UNION ALL SELECT 'channel', channel, count(*), count(*) FILTER (status='violation'), round(count(*) FILTER (status='compliant') * 100.0 / count(*), 1) FROM matches GROUP BY 2
    UNION ALL SELECT 'detail', match_id || ' ' || status, 1, CAST(status = 'violation' AS BIGINT), CASE WHEN status = 'compliant' THEN 100.0 ELSE 0.0 END FROM matches""",
)
def compliance_report(t: Tables) -> DataFrame:
    """L9 with the sections of A25: preamble, detail, dealers and channels."""
    m = t.matches.join(t.dealers.select("distributor_id", "name"), "distributor_id", "left")
    ok, bad = n_if(c("status") == "compliant"), n_if(c("status") == "violation")
    total = F.count("*")
    part = lambda section, name, df: df.groupBy(name.alias("name")).agg(total.alias("total"), bad.alias("violations"), scores.rate(ok, total).alias("rate")).select(F.lit(section).alias("section"), "name", "total", "violations", "rate")
    detail = t.matches.select(F.lit("detail").alias("section"), F.concat(c("match_id").cast("string"), F.lit(" "), "status").alias("name"), F.lit(1).cast("long").alias("total"), (c("status") == "violation").cast("long").alias("violations"), F.when(c("status") == "compliant", 100.0).otherwise(0.0).alias("rate"))
    return part("preamble", F.lit("all"), t.matches).unionByName(part("dealer", c("name"), m.filter(c("name").isNotNull()))).unionByName(part("channel", c("channel"), t.matches)).unionByName(detail)


_KINDS = [*rules.UPLOAD_TYPES, *rules.LAYERED_TYPES, "", "text/html", "application/pdf", "IMAGE/PNG"]
_NAMES = ["a.png", "a.PSD", "a.html", "noext", "a.jpeg"]


@R.add(
    "a33_upload_checks",
    f"""WITH f AS (SELECT page_id, {_NAMES}[page_id % {len(_NAMES)} + 1] AS name, {_KINDS}[page_id % {len(_KINDS)} + 1] AS kind, CASE WHEN page_id % 17 = 0 THEN 0 ELSE length(html) * 5000 END AS size, CASE WHEN page_id % 7 = 0 THEN '8BPS' ELSE substr(html, 1, 4) END AS magic FROM pages)
    SELECT page_id, CASE WHEN NOT (lower(kind) IN ({", ".join(f"'{x}'" for x in (*rules.UPLOAD_TYPES, *rules.LAYERED_TYPES, ""))}) OR ends_with(lower(name), '.psd')) THEN 'type' WHEN size > 25 * 1024 * 1024 THEN 'size' WHEN size = 0 THEN 'empty' ELSE 'taken' END AS result,
    ends_with(lower(name), '.psd') OR lower(kind) IN ({", ".join(f"'{x}'" for x in rules.LAYERED_TYPES)}) OR magic = '8BPS' AS flatten FROM f""",
)
def upload_checks(t: Tables) -> DataFrame:
    """Type or extension, 25 MB and not empty; layered files, by extension, type or first bytes, are to be flattened."""
    at = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (c("page_id") % len(xs) + 1).cast("int"))
    name, kind, size = at(_NAMES), at(_KINDS), F.when(c("page_id") % 17 == 0, 0).otherwise(F.length("html") * 5000)
    magic = F.when(c("page_id") % 7 == 0, "8BPS").otherwise(F.substring("html", 1, 4))
    return t.pages.select("page_id", F.coalesce(rules.upload_error(name, kind, size, magic), F.lit("taken")).alias("result"), rules.is_layered(name, kind, magic).alias("flatten"))


@R.add("b20_lift_nested", "SELECT event_id, CAST(props->>'$.k' AS BIGINT) + CASE WHEN event_id % 3 = 0 THEN 1000 ELSE 0 END AS k FROM events")
def lift_nested(t: Tables) -> DataFrame:
    """A key at the top level, else the one nested in metadata."""
    k = F.get_json_object("props", "$.k").cast("long")
    doc = F.when(c("event_id") % 3 == 0, F.to_json(F.struct((k + 1000).alias("k"), F.struct(k.alias("k")).alias("metadata")))).otherwise(F.to_json(F.struct(F.struct(k.alias("k")).alias("metadata"))))
    return t.events.select("event_id", F.coalesce(F.get_json_object(doc, "$.k"), F.get_json_object(doc, "$.metadata.k")).cast("long").alias("k"))


@R.add(
    "c16_slug_index",
    """WITH x AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN replace(c_name, 'Customer', 'SUPPLIER') ELSE replace(replace(c_name, 'Customer', 'supplier'), '#', '-') END AS n FROM customer)
    SELECT c_custkey, coalesce(a.distributor_id, b.distributor_id) AS dealer, CASE WHEN a.distributor_id IS NOT NULL THEN 'name' WHEN b.distributor_id IS NOT NULL THEN 'slug' END AS by_ FROM x LEFT JOIN dealers a ON lower(x.n) = lower(a.name) LEFT JOIN dealers b ON regexp_replace(lower(x.n), '[^a-z0-9]+', '', 'g') = regexp_replace(lower(b.name), '[^a-z0-9]+', '', 'g')""",
)
def slug_index(t: Tables) -> DataFrame:
    """A second index by slug over the names, asked where the name itself isn't known."""
    n = F.when(c("c_custkey") % 2 == 0, F.replace("c_name", F.lit("Customer"), F.lit("SUPPLIER"))).otherwise(F.replace(F.replace("c_name", F.lit("Customer"), F.lit("supplier")), F.lit("#"), F.lit("-")))
    x = t.customer.select("c_custkey", F.lower(n).alias("k"), text.alnum(n).alias("slug"))
    j = x.join(t.dealers.select(F.lower("name").alias("k"), c("distributor_id").alias("a")), "k", "left").join(t.dealers.select(text.alnum(c("name")).alias("slug"), c("distributor_id").alias("b")), "slug", "left")
    return j.select("c_custkey", F.coalesce("a", "b").alias("dealer"), F.when(c("a").isNotNull(), "name").when(c("b").isNotNull(), "slug").alias("by_"))


_NAMED = """x AS (SELECT c_custkey, c_nationkey AS run, CASE WHEN c_nationkey < 3 OR c_custkey % 4 = 0 THEN '' WHEN c_custkey % 4 = 1 THEN c_name ELSE c_name || ' Store' END AS actor, CASE c_custkey % 3 WHEN 1 THEN replace(c_name, '#', ' ') WHEN 2 THEN 'Other ' || c_custkey END AS name,
  CASE WHEN c_custkey % 5 <> 0 THEN 'CUSTOMER-' || substr(c_name, 10) END AS slug FROM customer),
y AS (SELECT *, regexp_replace(lower(actor), '[^a-z0-9]+', '', 'g') AS a, regexp_replace(lower(coalesce(name, '')), '[^a-z0-9]+', '', 'g') AS n, regexp_replace(lower(coalesce(slug, '')), '[^a-z0-9]+', '', 'g') AS s, max(CASE WHEN actor <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY run) AS named FROM x)"""


def _named(t: Tables) -> DataFrame:
    k = c("c_custkey")
    actor = F.when((c("c_nationkey") < 3) | (k % 4 == 0), "").when(k % 4 == 1, c("c_name")).otherwise(F.concat("c_name", F.lit(" Store")))
    name = F.when(k % 3 == 1, F.replace("c_name", F.lit("#"), F.lit(" "))).when(k % 3 == 2, F.concat(F.lit("Other "), k.cast("string")))
    return t.customer.select("c_custkey", c("c_nationkey").alias("run"), actor.alias("actor"), name.alias("name"), F.when(k % 5 != 0, F.concat(F.lit("CUSTOMER-"), F.substring("c_name", 10, 100))).alias("slug"))


@R.add("c17_name_filter", f"WITH {_NAMED} SELECT c_custkey FROM y WHERE named = 0 OR (a <> '' AND ((n = '' AND s = '') OR (n <> '' AND (contains(a, n) OR contains(n, a))) OR (s <> '' AND contains(a, s))))")
def name_filter(t: Tables) -> DataFrame:
    """C17: names by letters and digits either way, or the slug within the name; a run in which nothing has a name passes as a whole."""
    x = _named(t)
    runs = x.groupBy("run").agg(F.max(c("actor") != "").alias("named"))
    return x.join(runs, "run").filter(~c("named") | text.name_matches(c("actor"), c("name"), c("slug"))).select("c_custkey")


@R.add("d38_named_ads", f"WITH {_NAMED} SELECT run, count(*) FILTER (actor <> '') AS named_ads, count(*) AS total FROM y GROUP BY 1")
def named_ads(t: Tables) -> DataFrame:
    """How many ads of a run have any name."""
    return _named(t).groupBy("run").agg(n_if(c("actor") != "").alias("named_ads"), F.count("*").alias("total"))


@R.add(
    "c20_cosine_semi",
    """WITH a AS (SELECT min(vec_id) AS asset FROM embeddings GROUP BY label), v AS (SELECT asset, e.embedding AS ae FROM a JOIN embeddings e ON e.vec_id = a.asset)
    SELECT vec_id FROM embeddings e WHERE EXISTS (SELECT 1 FROM v WHERE v.asset <> e.vec_id AND round(list_sum(list_transform(list_zip(e.embedding, v.ae), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 6) >= 0.25)""",
)
def cosine_semi(t: Tables) -> DataFrame:
    """C20: vectors with a cosine of a least value to a reference vector other than themselves."""
    e = t.embeddings.select(c("vec_id").alias("id"), c("embedding").alias("v"), "label")
    few = e.groupBy("label").agg(F.min("id").alias("id")).select("id")
    return vectors_near(e.select("id", "v"), e.join(few, "id").select("id", "v"), 0.25).select(c("id").alias("vec_id"))


@R.add(
    "c23_growing_names",
    """WITH n AS (SELECT p_partkey, p_brand, lower(trim(p_name)) AS k, row_number() OVER (PARTITION BY p_brand, lower(trim(p_name)) ORDER BY p_partkey) AS rn FROM part WHERE p_partkey % 2 = 0)
    SELECT p_partkey FROM n WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM part o WHERE o.p_partkey % 2 = 1 AND o.p_brand = n.p_brand AND lower(trim(o.p_name)) = n.k)""",
)
def growing_names(t: Tables) -> DataFrame:
    """New names within a campaign; the first of a batch is known to the rows after it."""
    k = F.lower(F.trim("p_name")).alias("k")
    old, new = t.part.filter("p_partkey % 2 = 1").select("p_brand", k), t.part.filter("p_partkey % 2 = 0").select("p_partkey", "p_brand", k)
    return new.join(old, ["p_brand", "k"], "left_anti").groupBy("p_brand", "k").agg(F.min("p_partkey").alias("p_partkey")).select("p_partkey")


@R.add(
    "c27_crm_upsert",
    """WITH n AS (SELECT c_custkey AS id, lower(replace(c_name, 'Customer', 'Supplier')) AS k FROM customer), old AS (SELECT distributor_id, lower(name) AS k, CASE WHEN distributor_id % 2 = 0 THEN distributor_id + 3 END AS ext FROM dealers)
    SELECT id, coalesce(a.distributor_id, b.distributor_id) AS dealer, CASE WHEN a.distributor_id IS NOT NULL THEN 'by id' WHEN b.distributor_id IS NOT NULL THEN 'by name' ELSE 'insert' END AS action FROM n LEFT JOIN old a ON a.ext = n.id LEFT JOIN old b ON b.ext IS NULL AND b.k = n.k""",
)
def crm_upsert(t: Tables) -> DataFrame:
    """A known external id first, then the name among rows without one, else an insert."""
    old = t.dealers.select("distributor_id", F.lower("name").alias("k"), F.when(c("distributor_id") % 2 == 0, c("distributor_id") + 3).alias("ext"))
    new = t.customer.select(c("c_custkey").alias("id"), F.lower(F.replace("c_name", F.lit("Customer"), F.lit("Supplier"))).alias("k"))
    j = new.join(old.select(c("ext").alias("id"), c("distributor_id").alias("a")), "id", "left").join(old.filter("ext is null").select("k", c("distributor_id").alias("b")), "k", "left")
    return j.select("id", F.coalesce("a", "b").alias("dealer"), F.when(c("a").isNotNull(), "by id").when(c("b").isNotNull(), "by name").otherwise("insert").alias("action"))


@R.add(
    "c32_baseline",
    """WITH b AS (SELECT doc_id % 3 AS runner, doc_id, CAST(doc_id % 2 AS INTEGER) AS quality, 0 AS toxic FROM labels WHERE doc_id % 5 <> 0) SELECT l.doc_id % 3 AS runner, l.doc_id, concat_ws(',', CASE WHEN l.quality IS DISTINCT FROM b.quality THEN 'quality' END, CASE WHEN l.toxic IS DISTINCT FROM b.toxic THEN 'toxic' END) AS changed
    FROM labels l JOIN b ON b.doc_id = l.doc_id AND b.runner = l.doc_id % 3""",
)
def baseline(t: Tables) -> DataFrame:
    """Current cases against the baseline's by runner and case, with the fields that differ."""
    now = t.labels.select((c("doc_id") % 3).alias("runner"), "doc_id", "quality", "toxic")
    then = t.labels.filter("doc_id % 5 <> 0").select((c("doc_id") % 3).alias("runner"), "doc_id", (c("doc_id") % 2).cast("int").alias("q0"), F.lit(0).alias("t0"))
    j = now.join(then, ["runner", "doc_id"])
    return j.select("runner", "doc_id", F.concat_ws(",", F.when(~c("quality").eqNullSafe(c("q0")), "quality"), F.when(~c("toxic").eqNullSafe(c("t0")), "toxic")).alias("changed"))


@R.add("c34_parent_child", "SELECT p.job_id, count(k.job_id) AS children, count(k.job_id) FILTER (k.status = 'completed') AS done FROM jobs p LEFT JOIN jobs k ON k.job_id - k.job_id % 8 = p.job_id AND k.job_id <> p.job_id WHERE p.job_id % 8 = 0 GROUP BY 1")
def parent_child(t: Tables) -> DataFrame:
    """Parents with how many children they have and how many are done."""
    kids = t.jobs.filter("job_id % 8 <> 0").groupBy((c("job_id") - c("job_id") % 8).alias("job_id")).agg(F.count("*").alias("children"), n_if(c("status") == "completed").alias("done"))
    return t.jobs.filter("job_id % 8 = 0").select("job_id").join(kids, "job_id", "left").select("job_id", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("children", "done")])


@R.add(
    "c36_resolver",
    """SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'cached ' || s_suppkey WHEN s_acctbal > 5000 THEN 'stored ' || s_suppkey WHEN s_suppkey % 3 = 0 THEN 'fetched ' || s_suppkey WHEN s_suppkey % 5 <> 0 THEN 'rendered ' || s_suppkey END AS page,
    CASE WHEN s_suppkey % 4 = 0 THEN 'cache' WHEN s_acctbal > 5000 THEN 'column' WHEN s_suppkey % 3 = 0 THEN 'http' WHEN s_suppkey % 5 <> 0 THEN 'render' END AS tier FROM supplier""",
)
def resolver(t: Tables) -> DataFrame:
    """Cache, stored column, fetch, render; each tier is only asked for what is still open."""
    say = lambda word: F.concat(F.lit(word), c("s_suppkey").cast("string")).alias("page")
    stored = t.supplier.filter("s_acctbal > 5000").select("s_suppkey", say("stored "))
    cache = t.supplier.filter("s_suppkey % 4 = 0").select("s_suppkey", say("cached "))
    tiers = [("cache", lambda k: k.join(cache, "s_suppkey")), ("column", lambda k: k.join(stored, "s_suppkey")), ("http", lambda k: k.filter("s_suppkey % 3 = 0").select("s_suppkey", say("fetched "))), ("render", lambda k: k.filter("s_suppkey % 5 <> 0").select("s_suppkey", say("rendered ")))]
    return resolved_in_tiers(t.supplier.select("s_suppkey"), "s_suppkey", tiers, "page")


@R.add(
    "c38_label_patch",
    """WITH p AS (SELECT doc_id + CASE WHEN doc_id % 30 = 0 THEN 100000000 ELSE 0 END AS doc_id, 'c' || doc_id % 4 AS category, CASE WHEN doc_id % 6 <> 0 THEN 1 END AS toxic FROM labels WHERE doc_id % 3 = 0)
    SELECT coalesce(l.doc_id, p.doc_id) AS doc_id, CASE WHEN p.doc_id IS NOT NULL THEN p.category ELSE 'old' END AS category, CASE WHEN p.doc_id IS NOT NULL THEN p.toxic ELSE l.toxic END AS toxic, CASE WHEN l.doc_id IS NULL THEN 'unmatched' WHEN p.doc_id IS NULL THEN 'kept' ELSE 'patched' END AS outcome FROM labels l FULL JOIN p ON l.doc_id = p.doc_id""",
)
def label_patch(t: Tables) -> DataFrame:
    """Patches by case id overwrite, a key that a patch lacks goes, patches without a case are reported."""
    far = F.when(c("doc_id") % 30 == 0, 100000000).otherwise(0)
    p = t.labels.filter("doc_id % 3 = 0").select((c("doc_id") + far).alias("doc_id"), F.concat(F.lit("c"), (c("doc_id") % 4).cast("string")).alias("category"), F.when(c("doc_id") % 6 != 0, 1).alias("new"), F.lit(True).alias("p"))
    j = t.labels.select("doc_id", "toxic", F.lit(True).alias("l")).join(p, "doc_id", "full")
    return j.select("doc_id", F.coalesce("category", F.lit("old")).alias("category"), F.when(c("p"), c("new")).otherwise(c("toxic")).alias("toxic"), F.when(c("l").isNull(), "unmatched").when(c("p").isNull(), "kept").otherwise("patched").alias("outcome"))


@R.add("c40_two_viewports", "SELECT user_id, event_id % 97 AS src, min(event_id % 2) AS viewport, count(*) AS seen FROM events GROUP BY 1, 2")
def two_viewports(t: Tables) -> DataFrame:
    """An image counts for the first viewport that shows its source."""
    return t.events.groupBy("user_id", (c("event_id") % 97).alias("src")).agg(F.min(c("event_id") % 2).alias("viewport"), F.count("*").alias("seen"))


@R.add("d7_scoped_accuracy", f"SELECT a.source_type, m.channel, count(*) AS total, count(*) FILTER (m.was_correct) AS correct, round(avg(m.score), 2) AS avg_score FROM matches m JOIN assets a USING (asset_id) WHERE {_SCOPE} GROUP BY 1, 2 ORDER BY total DESC, source_type, channel")
def scoped_accuracy(t: Tables) -> DataFrame:
    """Accuracy of an organisation by source type and channel, largest first."""
    m = scoped(t).join(t.assets.select("asset_id", "source_type"), "asset_id")
    return m.groupBy("source_type", "channel").agg(F.count("*").alias("total"), n_if(c("was_correct")).alias("correct"), F.round(F.avg("score"), 2).alias("avg_score")).orderBy(F.desc("total"), "source_type", "channel")


@R.add("d25_cache_tokens", "SELECT o_orderpriority AS source, CAST(sum(o_orderkey % 5000) AS BIGINT) AS fresh, CAST(sum(o_custkey % 900) AS BIGINT) AS written, CAST(sum(o_orderkey % 700) AS BIGINT) AS read_, round(CAST(sum(o_orderkey % 5000 + o_custkey % 900 + o_orderkey % 700) AS DOUBLE) * 3 / 1000000, 4) AS uncached_usd, count(*) FILTER (o_orderkey % 700 > 0) AS cached_calls FROM orders GROUP BY 1")
def cache_tokens(t: Tables) -> DataFrame:
    """Token sums, what they would cost without a cache, and calls that read from it."""
    k, u = c("o_orderkey"), c("o_custkey")
    return t.orders.groupBy(c("o_orderpriority").alias("source")).agg(
        F.sum(k % 5000).alias("fresh"), F.sum(u % 900).alias("written"), F.sum(k % 700).alias("read_"), F.round(F.sum(k % 5000 + u % 900 + k % 700).cast("double") * 3 / 1000000, 4).alias("uncached_usd"), n_if(k % 700 > 0).alias("cached_calls")
    )


@R.add(
    "d29_host_outcomes",
    """SELECT 'h' || user_id % 30 AS host, count(*) FILTER (event_type = 'error') AS blocked, count(*) FILTER (event_type = 'click') AS timeout, count(*) FILTER (event_type NOT IN ('error', 'click')) AS images, min_by(event_type || ' ' || event_id, event_id) FILTER (event_type IN ('error', 'click')) AS reason FROM events GROUP BY 1""",
)
def host_outcomes(t: Tables) -> DataFrame:
    """Dealers with their pages as nested arrays, exploded twice; outcomes of a host and its first reason that is filled."""
    kind = c("event_type")
    page = F.struct("event_id", case(kind, {"error": "blocked", "click": "timeout"}, "images").alias("outcome"), F.when(kind.isin("error", "click"), F.concat(kind, F.lit(" "), c("event_id").cast("string"))).otherwise("").alias("reason"))
    stats = t.events.groupBy("user_id", F.floor(c("event_id") / 1000).alias("scan")).agg(F.collect_list(page).alias("pages")).select("scan", F.array(F.struct(F.concat(F.lit("https://H"), (c("user_id") % 30).cast("string"), F.lit("/")).alias("base_url"), "pages")).alias("blocked_details"))
    dealers = stats.select(F.explode("blocked_details").alias("d")).select(text.hostname(c("d.base_url")).alias("host"), F.explode("d.pages").alias("p"))
    n = lambda v: n_if(c("p.outcome") == v).alias(v)
    return dealers.groupBy("host").agg(n("blocked"), n("timeout"), n("images"), F.min_by(F.nullif("p.reason", F.lit("")), F.when(c("p.reason") != "", c("p.event_id"))).alias("reason"))


@R.add("d35_pending_quota", "SELECT org_id, count(*) FILTER (status = 'running' OR (status = 'pending' AND created_at >= TIMESTAMP '1998-07-01 00:03:00' - INTERVAL 5 MINUTE)) AS concurrent, count(*) FILTER (status = 'pending' AND created_at < TIMESTAMP '1998-07-01 00:03:00' - INTERVAL 5 MINUTE) AS stale FROM jobs GROUP BY 1")
def pending_quota(t: Tables) -> DataFrame:
    """Pending jobs hold a place for five minutes only."""
    fresh = c("created_at") >= F.lit("1998-06-30 23:58:00").cast("timestamp_ntz")
    pending = c("status") == "pending"
    return t.jobs.groupBy("org_id").agg(n_if((c("status") == "running") | (pending & fresh)).alias("concurrent"), n_if(pending & ~fresh).alias("stale"))


@R.add("d40_hit_rate", "SELECT count(*) FILTER (event_type = 'view') AS hits, count(*) FILTER (event_type = 'click') AS misses, round(count(*) FILTER (event_type = 'view') * 100.0 / nullif(count(*) FILTER (event_type IN ('view', 'click')), 0), 1) AS rate FROM events")
def hit_rate(t: Tables) -> DataFrame:
    """Cache hits over lookups, 0 without any."""
    g = t.events.agg(n_if(c("event_type") == "view").alias("hits"), n_if(c("event_type") == "click").alias("misses"))
    return g.withColumn("rate", scores.rate(c("hits"), c("hits") + c("misses")))


@R.add("d42_linked_dealers", "SELECT org_id, count(*) FILTER (distributor_id % 2 = 0) AS linked, count(*) AS dealers FROM dealers GROUP BY 1")
def linked_dealers(t: Tables) -> DataFrame:
    """Dealers with an external id."""
    ext = F.when(c("distributor_id") % 2 == 0, c("distributor_id") + 3)
    return t.dealers.groupBy("org_id").agg(n_if(ext.isNotNull()).alias("linked"), F.count("*").alias("dealers"))


@R.add("e4_duplicate_rows", "SELECT p_partkey, row_number() OVER (PARTITION BY lower(trim(p_type)) ORDER BY p_partkey) > 1 AS duplicate FROM part")
def duplicate_rows(t: Tables) -> DataFrame:
    """The second and later rows of a name are flagged; the first ones by an aggregation, so no name is one task."""
    k = F.lower(F.trim("p_type"))
    first = t.part.groupBy(k.alias("k")).agg(F.min("p_partkey").alias("first"))
    return t.part.select("p_partkey", k.alias("k")).join(first, "k").select("p_partkey", (c("p_partkey") > c("first")).alias("duplicate"))


@R.add("e8_flushed_deltas", "WITH x AS (SELECT user_id, event_type, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 10 AS flush FROM events) SELECT user_id, flush, count(*) FILTER (event_type = 'error') AS failed, count(*) AS done, CAST(sum(count(*)) OVER (PARTITION BY user_id ORDER BY flush) AS BIGINT) AS total FROM x GROUP BY 1, 2")
def flushed_deltas(t: Tables) -> DataFrame:
    """Counters flushed every ten rows, as deltas and running totals; what is left is flushed at the end."""
    w = Window.partitionBy("user_id")
    x = t.events.select("user_id", "event_type", F.floor((F.row_number().over(w.orderBy("ts", "event_id")) - 1) / 10).alias("flush"))
    g = x.groupBy("user_id", "flush").agg(n_if(c("event_type") == "error").alias("failed"), F.count("*").alias("done"))
    return g.withColumn("total", F.sum("done").over(w.orderBy("flush")))


@R.add(
    "e12_ladder_pick",
    """WITH s AS (SELECT *, min(CASE WHEN event_type = 'purchase' OR (event_type = 'click' AND value > 20) THEN event_id END) OVER (PARTITION BY user_id) AS stop FROM events), v AS (SELECT * FROM s WHERE stop IS NULL OR event_id <= stop)
    SELECT user_id, coalesce(min(event_id) FILTER (event_type = 'purchase'), max(event_id) FILTER (value > 20), min(event_id)) AS pick FROM v GROUP BY 1""",
)
def ladder_pick(t: Tables) -> DataFrame:
    """Attempts up to the first stop; the first with images, else the latest with evidence, else the first."""
    stop = t.events.groupBy("user_id").agg(F.min(F.when((c("event_type") == "purchase") | ((c("event_type") == "click") & (c("value") > 20)), c("event_id"))).alias("stop"))
    v = t.events.join(stop, "user_id").filter(c("stop").isNull() | (c("event_id") <= c("stop")))
    return v.groupBy("user_id").agg(F.coalesce(F.min(F.when(c("event_type") == "purchase", c("event_id"))), F.max(F.when(c("value") > 20, c("event_id"))), F.min("event_id")).alias("pick"))


_ORDER = {"error": 0, "purchase": 1, "click": 2, "view": 3}


@R.add("f6_status_order", "SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 ELSE 9 END AS place FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY place, event_id) <= 5")
def status_order(t: Tables) -> DataFrame:
    """a declared order of states, others last, ties in input order; the first five of each user."""
    return first_per(t.events.select("user_id", "event_id", case(c("event_type"), _ORDER, 9).alias("place")), ["user_id"], [c("place").asc(), c("event_id").asc()], 5)


@R.add("f9_by_frequency", "SELECT l_partkey AS page, count(*) AS hits FROM lineitem GROUP BY 1 ORDER BY hits DESC, page LIMIT 25")
def by_frequency(t: Tables) -> DataFrame:
    """pages by hits, most first; the limit is the feature."""
    return t.lineitem.groupBy(c("l_partkey").alias("page")).agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), "page").limit(25)


@R.add("g6_ordered_dedup", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'http://b/' || event_id % 7 || ' http://a/' || event_id % 5 ELSE 'http://a/' || event_id % 5 || ' http://b/' || event_id % 7 END AS urls FROM events")
def ordered_dedup(t: Tables) -> DataFrame:
    """Valid entries of a list, each once, in the order given."""
    a, b = F.concat(F.lit(" http://a/"), (c("event_id") % 5).cast("string")), F.concat(F.lit("http://b/"), (c("event_id") % 7).cast("string"), F.lit("  "))
    given = F.when(c("event_id") % 4 == 0, F.array(b, F.lit("no url"), a, b)).otherwise(F.array(a, F.lit(""), b, a))
    return t.events.select("event_id", F.array_join(F.array_distinct(F.filter(F.transform(given, lambda x: F.trim(x)), lambda x: x.startswith("http"))), " ").alias("urls"))


@R.add("g7_coverage_union", "SELECT DISTINCT scan_job_id AS scan, distributor_id AS k FROM matches WHERE distributor_id IS NOT NULL AND score >= 50 UNION SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_quantity < 5 AND l_returnflag = 'A'")
def coverage_union(t: Tables) -> DataFrame:
    """Dealers with images, and those that succeeded with none, of each scan."""
    images = t.matches.filter(c("distributor_id").isNotNull() & (c("score") >= 50)).select(c("scan_job_id").alias("scan"), c("distributor_id").alias("k"))
    outcomes = t.lineitem.select("l_orderkey", F.create_map(c("l_suppkey"), F.struct(c("l_returnflag").alias("status"), c("l_quantity").alias("n"))).alias("o"))
    empty = outcomes.select(c("l_orderkey").alias("scan"), F.explode(F.map_keys(F.map_filter("o", lambda _, v: (v["status"] == "A") & (v["n"] < 5)))).alias("k"))
    return images.unionByName(empty).distinct()


@R.add("i21_reset", "SELECT s_suppkey, CASE WHEN s_suppkey % 6 = 0 THEN 'plain' ELSE 'proxy' END AS strategy, CASE WHEN s_suppkey % 6 = 0 THEN 0 ELSE s_suppkey % 9 END AS failures FROM supplier")
def reset(t: Tables) -> DataFrame:
    """Learned state of the listed keys goes back to its default."""
    state = t.supplier.select("s_suppkey", F.lit("proxy").alias("strategy"), (c("s_suppkey") % 9).alias("failures"))
    keys = t.supplier.filter("s_suppkey % 6 = 0").select("s_suppkey", F.lit(True).alias("r"))
    return state.join(keys, "s_suppkey", "left").select("s_suppkey", F.when(c("r"), "plain").otherwise(c("strategy")).alias("strategy"), F.when(c("r"), 0).otherwise(c("failures")).alias("failures"))


@R.add("i22_reuse_window", "SELECT job_id FROM jobs WHERE status = 'completed' AND created_at >= TIMESTAMP '1995-06-17' - to_days(CASE source WHEN '1-URGENT' THEN 14 ELSE 7 END) AND created_at <= TIMESTAMP '1995-06-17'")
def reuse_window(t: Tables) -> DataFrame:
    """Completed scans that are fresh enough, 7 days or by source 14."""
    now = F.lit("1995-06-17").cast("timestamp_ntz")
    days = F.coalesce(F.create_map(F.lit("1-URGENT"), F.lit(14))[c("source")], F.lit(7))
    return t.jobs.filter((c("status") == "completed") & (c("created_at") >= now - F.make_interval(days=days)) & (c("created_at") <= now)).select("job_id")


@R.add("j1_insert_defaults", "SELECT c_custkey, c_name AS name, 'active' AS status, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END, 'GENERAL') AS kind, DATE '2024-01-01' AS created FROM customer")
def insert_defaults(t: Tables) -> DataFrame:
    """Defaults for what an insert leaves out."""
    given = t.customer.select("c_custkey", c("c_name").alias("name"), F.when(c("c_custkey") % 3 == 0, c("c_mktsegment")).alias("kind"))
    defaults = {"status": F.lit("active"), "kind": F.lit("GENERAL"), "created": F.lit("2024-01-01").cast("date")}
    return given.select("c_custkey", "name", *[(F.coalesce(c(k), v) if k in given.columns else v).alias(k) for k, v in defaults.items()])


@R.add("j4_mark_read", "SELECT count(*) FILTER (event_type = 'error' AND event_id % 2 = 0) AS updated, count(*) FILTER (event_type = 'error') AS read_now, count(*) AS alerts FROM events")
def mark_read(t: Tables) -> DataFrame:
    """An update by predicate and how many rows it changed."""
    old = (c("event_type") == "error") & (c("event_id") % 2 == 1)
    hit = (c("event_type") == "error") & ~old
    rows = t.events.select(hit.alias("updated"), F.when(hit, True).otherwise(old).alias("is_read"))
    return rows.agg(n_if(c("updated")).alias("updated"), n_if(c("is_read")).alias("read_now"), F.count("*").alias("alerts"))


@R.add(
    "j10_insert_limit",
    """WITH u AS (SELECT c_nationkey AS org, count(*) AS used FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1), n AS (SELECT c_custkey, c_nationkey AS org, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn FROM customer WHERE c_custkey % 2 = 1)
    SELECT c_custkey, coalesce(used, 0) + rn <= 45 AS accepted FROM n LEFT JOIN u USING (org)""",
)
def insert_limit(t: Tables) -> DataFrame:
    """Rows of a bulk insert are taken until the plan's limit, with what is there already."""
    used = t.customer.filter("c_custkey % 2 = 0").groupBy("c_nationkey").agg(F.count("*").alias("used"))
    new = t.customer.filter("c_custkey % 2 = 1").withColumn("rn", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")))
    return new.join(used, "c_nationkey", "left").select("c_custkey", (F.coalesce("used", F.lit(0)) + c("rn") <= 45).alias("accepted"))


def run_cases(cases: DataFrame, runner: Callable[[pd.DataFrame], pd.DataFrame], columns: str, key: str) -> DataFrame:
    """The rows (columns) of a runner over batches of cases; of a batch that fails, each case by itself, with the error's text in error."""

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            try:
                yield runner(part).assign(error=None)
            except Exception:
                for i in range(len(part)):
                    try:
                        yield runner(part.iloc[i : i + 1]).assign(error=None)
                    except Exception as e:  # a case's failure is its result
                        yield pd.DataFrame({key: part[key].iloc[i : i + 1], "error": [str(e)]}).reindex(columns=[*names, "error"])

    names = [x.split()[0] for x in columns.split(", ")]
    return cases.mapInPandas(batches, f"{columns}, error string")


@R.add("k5_runner", "SELECT item_id, CASE WHEN item_id % 10 <> 3 THEN length(text) % 101 END AS score, CASE WHEN item_id % 10 = 3 THEN 'no image' END AS error FROM benchmark")
def runner(t: Tables) -> DataFrame:
    """K5: a runner as a plug-in; cases that fail don't take others along."""

    def judge(part: pd.DataFrame) -> pd.DataFrame:
        if (part["item_id"] % 10 == 3).any():
            raise ValueError("no image")
        return pd.DataFrame({"item_id": part["item_id"], "score": part["text"].str.len() % 101})

    return run_cases(t.benchmark.select("item_id", "text"), judge, "item_id long, score long", "item_id")


@R.add(
    "a30_markdown",
    """WITH k AS (SELECT doc_id % 3 AS runner, count(*) FILTER (quality=1 AND toxic=1) AS tp, count(*) FILTER (toxic=1) AS p FROM labels GROUP BY 1) SELECT runner, '| ' || runner || ' | ' || tp || ' | ' || CASE WHEN p > 0 AND tp * 10 >= p * 2 THEN 'pass' ELSE '**fail**' END || ' |' AS line FROM k""",
)
def markdown(t: Tables) -> DataFrame:
    """A line of a Markdown table for each runner."""
    k = t.labels.groupBy((c("doc_id") % 3).alias("runner")).agg(n_if((c("quality") == 1) & (c("toxic") == 1)).alias("tp"), n_if(c("toxic") == 1).alias("p"))
    return k.select("runner", F.format_string("| %d | %d | %s |", c("runner"), c("tp"), F.when((c("p") > 0) & (c("tp") * 10 >= c("p") * 2), "pass").otherwise("**fail**")).alias("line"))
