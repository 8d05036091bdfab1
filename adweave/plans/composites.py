"""Pipelines whole: advert ingestion, the evaluation gate, the containment fallback, the choice among assets."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules, scores, text
from ..operators.funnel import funnel
from ..operators.joins import contains_first, first_per, resolved_in_tiers
from ..sources.files import read_csv, sitemap_locations
from ..streaming.base import shared_folder
from .analysis import _ELIGIBLE, _NOT_BLOCKED, eligible, images
from .base import Registry, Tables
from .pipelines import _PAIRS
from .records import _ADS, ads

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
c = F.col


@R.add(
    "l6_ad_ingestion",
    f"""WITH {_ADS}, x AS (SELECT ad, ad % 25 AS run, CASE WHEN ad % 25 >= 20 THEN '' ELSE name END AS actor, media FROM m),
    y AS (SELECT *, regexp_replace(lower(actor), '[^a-z0-9]+', '', 'g') AS a, 'page' || run % 5 AS n, 'dealer' || run AS s, max(CASE WHEN actor <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY run) AS named FROM x),
    f AS (SELECT * FROM y WHERE named = 0 OR (a <> '' AND (contains(a, n) OR contains(n, a) OR contains(a, s)))),
    i AS (SELECT *, CASE WHEN len(media) > 0 THEN media ELSE ['http://f/' || ad] END AS images, len(media) = 0 AS by_fallback FROM f WHERE len(media) > 0 OR ad % 2 = 0),
    d AS (SELECT distributor_id, 'dealer ' || distributor_id AS k FROM dealers),
    b AS (SELECT actor, arg_min(d.distributor_id, (lower(actor) <> k, d.distributor_id)) AS by_brand FROM (SELECT DISTINCT actor FROM i WHERE actor <> '') z JOIN d ON contains(lower(actor), k) OR contains(k, lower(actor)) GROUP BY 1),
    j AS (SELECT i.*, o.distributor_id AS by_source, b.by_brand, [['Instagram'], ['facebook', 'instagram'], ['FACEBOOK'], []][ad % 4 + 1] AS platforms FROM i LEFT JOIN dealers o ON o.distributor_id = ad % 1000 LEFT JOIN b ON b.actor = i.actor)
    SELECT ad, unnest(images) AS image, coalesce(by_source, by_brand, 0) AS dealer, CASE WHEN by_source IS NOT NULL THEN 'source' WHEN by_brand IS NOT NULL THEN 'brand' ELSE 'none' END AS attribution, by_fallback,
    CASE WHEN list_contains(list_transform(platforms, lambda p: lower(p)), 'instagram') AND NOT list_contains(list_transform(platforms, lambda p: lower(p)), 'facebook') THEN 'instagram' ELSE 'facebook' END AS channel FROM j""",
)
def ad_ingestion(t: Tables) -> DataFrame:
    """Adverts from their nested payloads (A9, H41); those of other pages go, unless no advert of a run has a name (C17); media, or looked-up images where there is none (C39), and adverts without either go; the dealer by the page asked for, else by the brand (C15, C14); the channel by platforms (H42); a row an image."""
    run = c("ad") % 25
    x = ads(t).select("ad", run.alias("run"), F.when(run >= 20, "").otherwise(c("name")).alias("actor"), "media")
    named = x.groupBy("run").agg(F.max(c("actor") != "").alias("named"))
    name, slug = F.concat(F.lit("Page "), (c("run") % 5).cast("string")), F.concat(F.lit("dealer-"), c("run").cast("string"))
    x = x.join(named, "run").filter(~c("named") | text.name_matches(c("actor"), name, slug))
    lookup = t.orders.filter("o_orderkey % 2 = 0").select(c("o_orderkey").alias("ad"), F.concat(F.lit("http://f/"), c("o_orderkey").cast("string")).alias("found"))
    bare = F.size("media") == 0
    x = x.join(lookup, "ad", "left").filter(~bare | c("found").isNotNull()).select("ad", "actor", F.when(bare, F.array("found")).otherwise(c("media")).alias("images"), bare.alias("by_fallback"))
    brands = t.dealers.select(F.concat(F.lit("dealer "), c("distributor_id").cast("string")).alias("k"), "distributor_id")
    actors = x.select("actor").filter("actor <> ''").distinct()
    by_brand = contains_first(actors, "actor", "actor", brands, "k", "distributor_id", ["distributor_id"]).select("actor", c("distributor_id").alias("by_brand"))
    by_source = t.dealers.select(c("distributor_id").alias("page"), c("distributor_id").alias("by_source"))
    x = x.withColumn("page", c("ad") % 1000).join(by_source, "page", "left").join(by_brand, "actor", "left")
    lists = [["Instagram"], ["facebook", "instagram"], ["FACEBOOK"], []]
    platforms = F.element_at(F.array(*[F.array(*[F.lit(p) for p in xs]).cast("array<string>") for xs in lists]), (c("ad") % 4 + 1).cast("int"))
    how = F.when(c("by_source").isNotNull(), "source").when(c("by_brand").isNotNull(), "brand").otherwise("none")
    return x.select("ad", F.explode("images").alias("image"), F.coalesce("by_source", "by_brand", F.lit(0)).alias("dealer"), how.alias("attribution"), "by_fallback", rules.ad_channel(platforms, F.lit("facebook")).alias("channel"))


# What a run may lose against its baseline, in points and per cent.
RECALL_DROP, PRECISION_DROP, LATENCY_RISE = 2.0, 5.0, 20.0


def measured(cases: DataFrame) -> DataFrame:
    """Metrics of each runner over cases (runner, known, failed, said, truth, latency in whole milliseconds).

    Cases that the manifest doesn't know are skipped, failed ones are errors. p95 is the
    latency at index round-half-even(0.95 (n - 1)) in order, from the counts of each
    latency, so no runner's cases are sorted in one task.
    """
    ok = c("known") & ~c("failed")
    n = lambda cond: F.count_if(cond)
    g = cases.groupBy("runner").agg(n(~c("known")).alias("skipped"), n(c("known") & c("failed")).alias("errors"), n(ok & c("said") & c("truth")).alias("tp"), n(ok & c("said") & ~c("truth")).alias("fp"), n(ok & ~c("said") & c("truth")).alias("fn"))
    counts = cases.groupBy("runner", "latency").agg(F.count("*").alias("k"))  # some thousand latencies at most
    w = Window.partitionBy("runner")
    upto = F.sum("k").over(w.orderBy("latency"))
    at = F.bround(0.95 * (F.sum("k").over(w) - 1)).cast("long")
    p = counts.select("runner", "latency", upto.alias("upto"), (upto - c("k")).alias("before"), at.alias("at")).filter((c("before") <= c("at")) & (c("at") < c("upto"))).select("runner", c("latency").alias("p95"))
    g = g.withColumns({"precision": F.try_divide("tp", c("tp") + c("fp")), "recall": F.try_divide("tp", c("tp") + c("fn"))})
    f1 = F.coalesce(F.try_divide(2 * c("precision") * c("recall"), c("precision") + c("recall")), F.lit(0.0))
    return g.withColumn("f1", f1).join(p, "runner")


_MEASURED = """SELECT runner, count(*) FILTER (NOT known) AS skipped, count(*) FILTER (known AND failed) AS errors, count(*) FILTER (known AND NOT failed AND said AND truth) AS tp, count(*) FILTER (known AND NOT failed AND said AND NOT truth) AS fp,
  count(*) FILTER (known AND NOT failed AND NOT said AND truth) AS fn, list_sort(list(latency))[CAST(round_even(0.95 * (count(*) - 1), 0) AS BIGINT) + 1] AS p95"""


@R.add(
    "l8_evaluation_gate",
    f"""WITH x AS (SELECT l.doc_id % 3 AS runner, d.doc_id IS NOT NULL AS known, l.doc_id % 41 = 0 AS failed, quality = 1 AS said, toxic = 1 AS truth, l.doc_id * 37 % 900 + CASE WHEN l.doc_id % 3 = 1 THEN 200 ELSE 0 END AS latency, l.doc_id % 2 = 0 AS old
      FROM labels l LEFT JOIN (SELECT DISTINCT doc_id FROM documents WHERE lang IS NOT NULL) d USING (doc_id)),
    a AS ({_MEASURED} FROM x GROUP BY 1), b AS ({_MEASURED} FROM (SELECT * REPLACE (latency - CASE WHEN runner = 1 THEN 200 ELSE 0 END AS latency) FROM x WHERE old) GROUP BY 1),
    r AS (SELECT a.*, a.tp / nullif(a.tp + a.fp, 0)::DOUBLE AS p, a.tp / nullif(a.tp + a.fn, 0)::DOUBLE AS r, b.tp / nullif(b.tp + b.fp, 0)::DOUBLE AS p0, b.tp / nullif(b.tp + b.fn, 0)::DOUBLE AS r0, b.p95 AS p950 FROM a JOIN b USING (runner)),
    q AS (SELECT *, coalesce((r - r0) * 100 < -2.0, false) AS bad_r, coalesce((p - p0) * 100 < -5.0, false) AS bad_p, coalesce((p95 - p950) * 100.0 / nullif(p950, 0) > 20.0, false) AS bad_l FROM r)
    SELECT runner, skipped, errors, round(coalesce(p, 0), 6) AS precision, round(coalesce(r, 0), 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1, p95,
    concat_ws(',', CASE WHEN bad_r THEN 'recall' END, CASE WHEN bad_p THEN 'precision' END, CASE WHEN bad_l THEN 'latency' END) AS failed, NOT (bad_r OR bad_p OR bad_l) AS passes FROM q""",
)
def evaluation_gate(t: Tables) -> DataFrame:
    """Results joined to their manifest (C31), confusion counts, precision, recall and F1 (D33), p95 (D34), each against the baseline's (C32); what fell or rose too far fails the gate."""
    i = c("doc_id")
    known = t.documents.filter("lang IS NOT NULL").select("doc_id").distinct().withColumn("known", F.lit(True))
    x = t.labels.join(known, "doc_id", "left").select((i % 3).alias("runner"), F.coalesce("known", F.lit(False)).alias("known"), (i % 41 == 0).alias("failed"), (c("quality") == 1).alias("said"), (c("toxic") == 1).alias("truth"), (i * 37 % 900).alias("latency"), (i % 2 == 0).alias("old"))
    slow = F.when(c("runner") == 1, 200).otherwise(0)
    now, base = measured(x.withColumn("latency", c("latency") + slow)), measured(x.filter("old"))
    j = now.join(base.select("runner", c("precision").alias("p0"), c("recall").alias("r0"), c("p95").alias("p950")), "runner")
    fell = lambda a, b, most: F.coalesce((c(a) - c(b)) * 100 < -most, F.lit(False))
    bad = {"recall": fell("recall", "r0", RECALL_DROP), "precision": fell("precision", "p0", PRECISION_DROP), "latency": F.coalesce(F.try_divide((c("p95") - c("p950")) * 100.0, c("p950")) > LATENCY_RISE, F.lit(False))}
    six = lambda k: F.round(F.coalesce(k, F.lit(0.0)), 6).alias(k)
    failed = F.concat_ws(",", *[F.when(v, k) for k, v in bad.items()])
    return j.select("runner", "skipped", "errors", six("precision"), six("recall"), six("f1"), "p95", failed.alias("failed"), (failed == "").alias("passes"))


# Least confidence, most assets, and the bands of the containment fallback.
CONTAINED, MOST_ASSETS = 70, 10
PAGES_A_SCAN, COST_CAP = 100, 20.0


@R.add(
    "l10_containment_fallback",
    f"""WITH m AS (SELECT *, scan_job_id % 5 <> 0 AND score >= 90 AS matched FROM matches), pg AS (SELECT scan_job_id AS page, count(*) AS images, count(*) FILTER (matched) AS hits FROM m GROUP BY 1),
    k AS (SELECT *, page // {PAGES_A_SCAN} AS scan, page % 17 = 0 AS timed_out, CASE WHEN page % 7 <> 0 THEN 'http://shot/' || page ELSE '' END AS evidence, page % 13 AS assets FROM pg),
    l AS (SELECT *, sum(images * 0.5) OVER (PARTITION BY scan ORDER BY page ROWS UNBOUNDED PRECEDING) AS spent FROM k),
    r AS (SELECT * FROM l WHERE hits = 0 AND NOT timed_out AND spent < {COST_CAP} AND evidence <> '' AND images > 0 AND assets <= {MOST_ASSETS}),
    j AS (SELECT page, evidence, unnest(range(0, assets)) AS asset FROM r), s AS (SELECT *, (page * 31 + asset * 17) % 101 AS confidence FROM j)
    SELECT page, evidence, asset, confidence, CASE WHEN confidence >= 75 THEN 'strong' WHEN confidence >= 65 THEN 'partial' ELSE 'weak' END AS type FROM s WHERE confidence >= {CONTAINED}""",
)
def containment_fallback(t: Tables) -> DataFrame:
    """Every asset against the whole page, only for pages with images and evidence but no match, that did not time out, of campaigns of ten assets at most, while the scan's cost is under its cap (a latch: cost only grows)."""
    hit = (c("scan_job_id") % 5 != 0) & (c("score") >= 90)
    g = t.matches.groupBy(c("scan_job_id").alias("page")).agg(F.count("*").alias("images"), F.count_if(hit).alias("hits"))
    g = g.withColumns({"timed_out": c("page") % 17 == 0, "evidence": F.when(c("page") % 7 != 0, F.concat(F.lit("http://shot/"), c("page").cast("string"))).otherwise(""), "assets": c("page") % 13})
    spent = F.sum(c("images") * 0.5).over(Window.partitionBy(F.floor(c("page") / PAGES_A_SCAN)).orderBy("page").rowsBetween(Window.unboundedPreceding, 0))  # a scan has so many pages at most
    run = (c("hits") == 0) & ~c("timed_out") & (c("spent") < COST_CAP) & (c("evidence") != "") & (c("images") > 0) & c("assets").between(1, MOST_ASSETS)
    j = g.withColumn("spent", spent).filter(run).select("page", "evidence", F.explode(F.sequence(F.lit(0).cast("long"), c("assets") - 1)).alias("asset"))
    s = j.withColumn("confidence", (c("page") * 31 + c("asset") * 17) % 101).filter(c("confidence") >= CONTAINED)
    return s.withColumn("type", F.when(c("confidence") >= 75, "strong").when(c("confidence") >= 65, "partial").otherwise("weak"))


#: Assets that a judge is shown at once, at most.
SHOWN = 8


@R.add(
    "l11_multi_asset",
    """WITH g AS (SELECT user_id, list(event_id ORDER BY event_id) AS assets, min(CAST(props->>'$.k' AS INTEGER)) % 9 AS pick, max(value) AS v FROM events GROUP BY 1)
    SELECT user_id, CASE WHEN pick BETWEEN 1 AND len(assets) THEN assets[pick] END AS asset, CAST(greatest(0, least(100, round_even(v * 3, 0))) AS INTEGER) AS score FROM g""",
)
def multi_asset(t: Tables) -> DataFrame:
    """A 1-based choice among the first assets, 0 or out of range is none; score rounded and clamped. A user's other events are cut before the shuffle."""
    g = t.events.groupBy("user_id").agg((F.min(F.get_json_object("props", "$.k").cast("int")) % 9).alias("pick"), F.max("value").alias("v"))
    shown = first_per(t.events.select("user_id", c("event_id").alias("asset")), ["user_id"], [c("asset").asc()], SHOWN)
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("asset"))
    j = g.join(shown.withColumn("pick", place), ["user_id", "pick"], "left")
    return j.select("user_id", "asset", F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.bround(c("v") * 3))).cast("int").alias("score"))


def _rules(t: Tables) -> DataFrame:
    """How many rules of each type a campaign has (D31): names of its assets of even size are required elements, of odd size forbidden ones."""
    odd = c("size") % 2 == 1
    return t.assets.groupBy("campaign_id").agg(F.count_if(~odd).alias("required"), F.count_if(odd).alias("forbidden"))


def _written(x: DataFrame, rules_: DataFrame, keys: list[str]) -> DataFrame:
    """Judged pairs through the funnel; of the matched ones those whose campaign forbids more than it requires are violations, written with an alert each (L2)."""
    g = funnel(x).groupBy("stage", "campaign_id", (c("final_score") >= 75).alias("strong")).agg(F.count("*").alias("n"))  # so the rules meet a few rows
    hit = c("stage") == "matched"
    each = lambda cond, v=c("n"): F.sum(F.when(cond, v).otherwise(0)).cast("long")
    sums = [F.sum("n").alias("n"), each(hit & c("strong")).alias("strong"), each(hit, c("n") * (c("required") + c("forbidden"))).alias("rules"), each(hit & (c("forbidden") > c("required"))).alias("alerts")]
    return g.join(rules_, "campaign_id", "left").groupBy(*keys).agg(*sums)


_RULES = "ru AS (SELECT campaign_id, count(*) FILTER (size % 2 = 0) AS required, count(*) FILTER (size % 2 = 1) AS forbidden FROM assets GROUP BY 1)"
_SUMS = """count(*) AS n, count(*) FILTER (stage = 'matched' AND final_score >= 75) AS strong, CAST(sum(CASE WHEN stage = 'matched' THEN required + forbidden ELSE 0 END) AS BIGINT) AS rules,
    count(*) FILTER (stage = 'matched' AND forbidden > required) AS alerts FROM z JOIN assets a USING (asset_id) LEFT JOIN ru USING (campaign_id)"""


@R.add("l4_post_scan_rules", f"WITH {_PAIRS}, {_RULES} SELECT stage, a.campaign_id, {_SUMS} WHERE z.match_id % 3 <> 0 AND {_NOT_BLOCKED} AND {_ELIGIBLE} GROUP BY 1, 2")
def post_scan(t: Tables) -> DataFrame:
    """L4: unprocessed images of a scan against the assets for their source, with the campaign's rules (D31) and the alerts that the matches are written with."""
    return _written(eligible(images(t), "facebook").filter(~c("is_processed")), _rules(t), ["stage", "campaign_id"])


@R.add("l12_without_campaign_rules", f"WITH {_PAIRS}, {_RULES} SELECT stage, {_SUMS} WHERE a.org_id = 3 AND {_NOT_BLOCKED} GROUP BY 1")
def without_campaign(t: Tables) -> DataFrame:
    """All assets of the organisation that have a campaign, whatever their source, with the rules of each asset's campaign."""
    seen = F.coalesce("capture_method", F.lit("")) != "blocked_evidence"
    return _written(images(t).filter((c("org_id") == 3) & c("campaign_id").isNotNull() & seen), _rules(t), ["stage"])


@R.add(
    "c36_write_back",
    """WITH x AS (SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'cache' WHEN s_acctbal > 5000 THEN 'column' WHEN s_suppkey % 3 = 0 THEN 'http' WHEN s_suppkey % 5 <> 0 THEN 'render' ELSE 'open' END AS tier FROM supplier),
    y AS (SELECT 1 AS round, tier FROM x UNION ALL SELECT 2, CASE WHEN tier IN ('http', 'render') THEN 'cache' ELSE tier END FROM x) SELECT round, tier, count(*) AS n FROM y GROUP BY 1, 2""",
)
def write_back(t: Tables) -> DataFrame:
    """What is fetched or rendered is written back to the cache, so that the next round finds it there; a tally by tier of both rounds."""
    k = c("s_suppkey")
    say = lambda word: F.concat(F.lit(word), k.cast("string")).alias("page")
    column = t.supplier.filter("s_acctbal > 5000").select("s_suppkey", say("stored "))

    def run(cache: DataFrame) -> DataFrame:
        tiers = [("cache", lambda o: o.join(cache, "s_suppkey")), ("column", lambda o: o.join(column, "s_suppkey")), ("http", lambda o: o.filter(k % 3 == 0).select("s_suppkey", say("fetched "))), ("render", lambda o: o.filter(k % 5 != 0).select("s_suppkey", say("rendered ")))]
        return resolved_in_tiers(t.supplier.select("s_suppkey"), "s_suppkey", tiers, "page")

    at = f"{shared_folder(t.spark)}/resolved-{uuid.uuid4().hex}"
    t.supplier.filter(k % 4 == 0).select("s_suppkey", say("cached ")).write.parquet(f"{at}/cache/round=0")
    kept, tallies = t.spark.read.schema("s_suppkey long, page string"), []
    for i in (1, 2):
        got = run(kept.parquet(f"{at}/cache/*"))
        got.write.parquet(f"{at}/got/round={i}")
        got = t.spark.read.parquet(f"{at}/got/round={i}")
        got.filter(c("tier").isin("http", "render")).select("s_suppkey", "page").write.parquet(f"{at}/cache/round={i}")
        tallies.append(got.groupBy(F.coalesce("tier", F.lit("open")).alias("tier")).agg(F.count("*").alias("n")).select(F.lit(i).alias("round"), "tier", "n"))
    return tallies[0].unionByName(tallies[1])


#: Children of a sitemap index that are followed, at most.
FOLLOWED = 5


@R.add("a15_sitemap_index", f"SELECT page_id, 'https://s/' || page_id || '/' || k || '/' || i AS loc FROM pages, (SELECT unnest(range(0, {FOLLOWED})) AS k), (SELECT unnest(range(0, 2)) AS i) WHERE page_id % 3 <> 0 UNION ALL SELECT page_id, 'https://s/' || page_id || '/own' FROM pages WHERE page_id % 3 = 0")
def sitemap_index(t: Tables) -> DataFrame:
    """Documents that are an index are followed to their first five children, joined by URL; malformed ones are read by pattern."""
    url = lambda *xs: F.concat(F.lit("https://s/"), c("page_id").cast("string"), *[F.lit(f"/{x}") for x in xs])
    entry = lambda u: F.concat(F.lit("<loc>"), u, F.lit("</loc>"))
    index = F.concat(F.lit("<sitemapindex>"), *[F.concat(F.lit("<sitemap>"), entry(url(i)), F.lit("</sitemap>")) for i in range(7)], F.lit("</sitemapindex>"))
    top = F.when(c("page_id") % 3 != 0, index).otherwise(F.concat(F.lit("<urlset><url>"), entry(url("own")), F.lit("</url>")))  # not closed: malformed
    docs = t.pages.select("page_id", top.alias("xml"))
    child = t.pages.select("page_id", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("k"))
    of_child = F.concat(F.lit("https://s/"), c("page_id").cast("string"), F.lit("/"), c("k").cast("string"))
    children = child.select(of_child.alias("url"), F.concat(F.lit("<urlset>"), *[F.concat(F.lit("<url>"), entry(F.concat(of_child, F.lit(f"/{i}"))), F.lit("</url>")) for i in range(2)], F.lit("</urlset>")).alias("xml"))
    is_index = F.contains("xml", F.lit("<sitemapindex"))
    own = docs.filter(~is_index).select("page_id", F.explode(sitemap_locations(c("xml"))).alias("loc"))
    links = docs.filter(is_index).select("page_id", F.explode(F.slice(sitemap_locations(c("xml")), 1, FOLLOWED)).alias("url"))
    return own.unionByName(links.join(children, "url").select("page_id", F.explode(sitemap_locations(c("xml"))).alias("loc")))


@R.add(
    "a25_report_sections",
    """WITH m AS (SELECT m.*, d.name FROM matches m LEFT JOIN dealers d USING (distributor_id)), r AS (
    SELECT 'preamble' AS section, 'all' AS name, count(*) AS n, count(*) FILTER (status = 'compliant') AS ok FROM m UNION ALL SELECT 'dealer', coalesce(name, 'Unknown'), count(*), count(*) FILTER (status = 'compliant') FROM m GROUP BY 2
    UNION ALL SELECT 'channel', coalesce(nullif(channel, ''), 'unknown'), count(*), count(*) FILTER (status = 'compliant') FROM m GROUP BY 2 UNION ALL SELECT 'detail', match_id || ', "' || price || '"', 1, CAST(status = 'compliant' AS INTEGER) FROM m)
    SELECT section, name, CAST(n AS VARCHAR) AS total, CAST(round(ok * 100.0 / n, 1) AS VARCHAR) || '%' AS rate FROM r""",
)
def report_sections(t: Tables) -> DataFrame:
    """Preamble, details, dealers and channels as CSV, a folder a section, read back; quotes and commas survive."""
    at = f"{shared_folder(t.spark)}/report-{uuid.uuid4().hex}"
    m = t.matches.join(t.dealers.select("distributor_id", "name"), "distributor_id", "left")
    ok = F.count_if(c("status") == "compliant").alias("ok")
    names = {"preamble": F.lit("all"), "dealer": F.coalesce("name", F.lit("Unknown")), "channel": F.coalesce(F.nullif(c("channel"), F.lit("")), F.lit("unknown"))}
    sections = {k: m.groupBy(v.alias("of")).agg(F.count("*").alias("n"), ok) for k, v in names.items()}
    sections["detail"] = m.select(F.concat(c("match_id").cast("string"), F.lit(', "'), c("price").cast("string"), F.lit('"')).alias("of"), F.lit(1).alias("n"), (c("status") == "compliant").cast("int").alias("ok"))
    out = None
    for k, g in sections.items():
        g.select(c("of").alias("Name"), c("n").cast("string").alias("Total"), F.concat(scores.rate(c("ok"), c("n")).cast("string"), F.lit("%")).alias("Rate")).write.option("header", True).option("escape", '"').csv(f"{at}/{k}")
        part = read_csv(t.spark, f"{at}/{k}").select(F.lit(k).alias("section"), "name", "total", "rate")
        out = part if out is None else out.unionByName(part)
    return out
