"""Composite pipelines, sources and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators.funnel import funnel
from ..operators.joins import first_per
from ..sources.files import html_links, read_csv, read_manifest, resolved, sitemap_locations, write_manifest
from ..streaming.base import drained, read_stream, shared_folder
from .base import Registry, Tables

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
c = F.col

_PAIRS = """p AS (SELECT match_id, price, asset_id, distributor_id, match_id % 50 <> 0 AS downloaded, match_id % 4 = 0 AS screenshot, CASE WHEN match_id % 17 <> 0 THEN match_id % 33 END AS hash_distance, CASE WHEN match_id % 19 <> 0 THEN (match_id % 100) / 100.0::DOUBLE END AS cosine,
  (asset_id % 100) / 50.0::DOUBLE AS relevance, score AS visual, CAST(match_id % 101 AS DOUBLE) AS hashed, match_id % 101 > 96 AS hash_exact, CAST(asset_id % 101 AS DOUBLE) AS detection, CAST(asset_id % 6 AS INTEGER) AS gates_passed,
  match_id % 5 <> 0 AS gate_brand, match_id % 7 <> 0 AS gate_product, CASE status WHEN 'violation' THEN match_id % 3 = 0 WHEN 'compliant' THEN true END AS asset_visible, CASE WHEN match_id % 4 = 0 THEN 65 ELSE 60 END AS threshold, 0.95::DOUBLE AS factor FROM matches),
f AS (SELECT *, visual * (0.5::DOUBLE/0.65::DOUBLE) + hashed * (0.15::DOUBLE/0.65::DOUBLE) AS f0 FROM p), g AS (SELECT *, CASE WHEN visual > 60 AND hashed > 60 THEN least(100.0, f0 + 5) ELSE f0 END AS f1 FROM f),
h AS (SELECT *, CASE WHEN hash_exact THEN greatest(f1, 85.0) ELSE f1 END AS f2 FROM g), r AS (SELECT *, CASE WHEN screenshot THEN detection WHEN visual >= 75 AND hashed <= 55 THEN least(f2, hashed + 10.0) ELSE f2 END AS raw FROM h),
s AS (SELECT *, CASE WHEN NOT downloaded THEN 'download_failed' WHEN NOT screenshot AND hash_distance > 28 THEN 'hash_rejected' WHEN NOT screenshot AND cosine < 0.40 THEN 'clip_rejected' WHEN NOT screenshot AND relevance < 0.75 THEN 'filter_rejected'
  WHEN raw < threshold THEN 'below_threshold' WHEN raw BETWEEN 60 AND 80 AND NOT (gate_brand AND gate_product AND gates_passed >= 4) THEN 'verification_rejected' WHEN asset_visible = false THEN 'asset_invisible_rejected' ELSE 'matched' END AS stage FROM r),
z AS (SELECT *, CASE WHEN stage = 'matched' THEN greatest(0, least(100, CAST(trunc((CASE WHEN raw BETWEEN 60 AND 80 THEN CAST([0,0,25,50,65,80][gates_passed + 1] AS DOUBLE) ELSE raw END) * factor) AS INTEGER))) END AS final_score FROM s)"""


def judged_pairs(t: Tables) -> DataFrame:
    """Pairs of images and assets with the scores that a judge would give."""
    i, a = c("match_id"), c("asset_id")
    return t.matches.select(
        "match_id",
        "price",
        "asset_id",
        "distributor_id",
        (i % 50 != 0).alias("downloaded"),
        (i % 4 == 0).alias("screenshot"),
        F.when(i % 17 != 0, i % 33).alias("hash_distance"),
        F.when(i % 19 != 0, (i % 100) / 100.0).alias("cosine"),
        ((a % 100) / 50.0).alias("relevance"),
        c("score").alias("visual"),
        (i % 101).cast("double").alias("hashed"),
        (i % 101 > 96).alias("hash_exact"),
        (a % 101).cast("double").alias("detection"),
        (a % 6).cast("int").alias("gates_passed"),
        (i % 5 != 0).alias("gate_brand"),
        (i % 7 != 0).alias("gate_product"),
        F.when(c("status") == "violation", i % 3 == 0).when(c("status") == "compliant", True).alias("asset_visible"),
        F.when(i % 4 == 0, 65).otherwise(60).alias("threshold"),
        F.lit(0.95).alias("factor"),
    )


@R.add("l1_funnel", f"WITH {_PAIRS} SELECT match_id, price, stage, final_score, CASE WHEN final_score >= 90 THEN 'exact' WHEN final_score >= 75 THEN 'strong' WHEN final_score >= 65 THEN 'partial' WHEN final_score >= 50 THEN 'weak' WHEN final_score IS NOT NULL THEN 'none' END AS match_type FROM z")
def match_funnel(t: Tables) -> DataFrame:
    """L1."""
    return funnel(judged_pairs(t)).select("match_id", "price", "stage", "final_score", "match_type")


@R.add("d26_funnel_counts", f"WITH {_PAIRS} SELECT stage, count(*) AS n, count(*) FILTER (screenshot) AS screenshots FROM z GROUP BY 1")
def funnel_counts(t: Tables) -> DataFrame:
    return funnel(judged_pairs(t)).groupBy("stage").agg(F.count("*").alias("n"), F.count_if(c("screenshot")).alias("screenshots"))


@R.add(
    "l2_match_write",
    """WITH o AS (SELECT asset_id, scan_job_id % 50 AS url, max_by(status, (match_id, price)) AS status FROM matches WHERE match_id % 2 = 1 GROUP BY 1, 2), n AS (SELECT asset_id, scan_job_id % 50 AS url, max_by(status, (match_id, price)) AS status FROM matches WHERE match_id % 2 = 0 GROUP BY 1, 2)
    SELECT asset_id, url, coalesce(n.status, o.status) AS status, CASE WHEN n.status IS NOT NULL AND o.status <> n.status THEN o.status END AS previous,
    CASE WHEN o.status <> n.status AND n.status = 'violation' THEN 'compliance_drift' WHEN o.status IS NULL AND n.status = 'violation' THEN 'compliance_violation' END AS alert FROM o FULL JOIN n USING (asset_id, url)""",
)
def match_write(t: Tables) -> DataFrame:
    """L2: upsert of matches by asset and URL, previous status on drift, alerts that follow."""
    m = t.matches.withColumn("url", c("scan_job_id") % 50)
    last = lambda k: F.max_by(F.when(c("match_id") % 2 == k, c("status")), F.when(c("match_id") % 2 == k, F.struct("match_id", "price")))
    x = m.groupBy("asset_id", "url").agg(last(1).alias("old"), last(0).alias("new"))  # stored and new matches come together in one aggregation
    drifted = c("old") != c("new")
    bad = c("new") == "violation"
    return x.select("asset_id", "url", F.coalesce("new", "old").alias("status"), F.when(drifted, c("old")).alias("previous"), F.when(drifted & bad, "compliance_drift").when(c("old").isNull() & bad, "compliance_violation").alias("alert"))


@R.add(
    "l7_page_discovery",
    f"""WITH l AS (SELECT page_id, url, unnest(list_distinct(list_filter(regexp_extract_all(html, 'href\\s*=\\s*["'']([^"'']*)["'']', 1), lambda u: u <> '' AND NOT regexp_matches(u, '^(#|mailto:|tel:|javascript:)')))) AS link FROM pages),
    a AS (SELECT page_id, regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1) || link AS target FROM l WHERE starts_with(link, '/'))
    SELECT page_id, target FROM (SELECT *, lower(regexp_extract(target, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)) AS path FROM a) WHERE len(list_filter({list(text.BLOCKED_EXTENSIONS)}, lambda x: ends_with(path, x))) = 0 AND len(list_filter({list(text.BLOCKED_PATHS)}, lambda x: contains(path, x))) = 0 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY contains(lower(target), 'of') DESC, target) <= 4""",
)
def page_discovery(t: Tables) -> DataFrame:
    """Links of a page, resolved, scannable, promising ones first, four at most."""
    links = t.pages.select("page_id", "url", F.explode(html_links(c("html"))).alias("link")).filter(c("link").startswith("/"))
    x = links.select("page_id", resolved(c("url"), c("link")).alias("target"))
    return first_per(x.filter(text.is_scannable(c("target"))), ["page_id"], [F.desc(F.contains(F.lower("target"), F.lit("of"))), F.asc("target")], 4)


@R.add("a15_sitemap", "SELECT page_id, 'https://' || page_id || '.example.com/' || i AS loc FROM pages, (SELECT unnest(range(0, 3)) AS i)")
def sitemap(t: Tables) -> DataFrame:
    """Locations of sitemap documents, with and without a namespace prefix."""
    url = lambda i: F.concat(F.lit("https://"), c("page_id").cast("string"), F.lit(f".example.com/{i}"))
    tag = F.when(c("page_id") % 2 == 0, "loc").otherwise("s:loc")
    xml = F.concat(F.lit("<urlset>"), *[F.concat(F.lit("<url><"), tag, F.lit(">\n "), url(i), F.lit(" </"), tag, F.lit("></url>")) for i in range(3)], F.lit("</urlset>"))
    return t.pages.select("page_id", F.explode(sitemap_locations(xml)).alias("loc"))


@R.add("a6_csv", """SELECT c_custkey, 'He said "' || c_name || '", twice' AS quoted_name, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS market_segment FROM customer""")
def csv_round_trip(t: Tables) -> DataFrame:
    """A CSV with quotes written and read again, headers normalised."""
    at = f"{shared_folder(t.spark)}/csv-{uuid.uuid4().hex}"
    rows = t.customer.select(c("c_custkey").alias("C CustKey"), F.concat(F.lit('He said "'), "c_name", F.lit('", twice')).alias(" Quoted-Name"), F.when(c("c_custkey") % 3 == 0, "").otherwise(c("c_mktsegment")).alias("Market Segment"))
    rows.write.option("header", True).option("quote", '"').option("escape", '"').csv(at)
    return read_csv(t.spark, at).select(c("c_custkey").cast("long").alias("c_custkey"), "quoted_name", "market_segment")


@R.add("a8_manifest", "SELECT 2 AS version, p_partkey AS id, p_brand AS category, p_size % 2 = 0 AS is_match FROM part")
def manifest_round_trip(t: Tables) -> DataFrame:
    """JSON documents with nested cases, one for each thousand ids, written and read again."""
    at = f"{shared_folder(t.spark)}/manifest-{uuid.uuid4().hex}"
    cases = t.part.select(F.struct(c("p_partkey").alias("id"), c("p_brand").alias("category"), F.struct((c("p_size") % 2 == 0).alias("is_match")).alias("expected")).alias("x"))
    write_manifest(cases, at, F.floor(c("x.id") / 1000))
    return read_manifest(t.spark, at, "id long, category string, expected struct<is_match: boolean>").select("version", "id", "category", "expected.is_match")


@R.add("a31_geojson", """SELECT s_suppkey, '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || s_nationkey || ',' || s_suppkey || ']},"properties":{"name":"' || s_name || '"}}' AS feature FROM supplier""")
def geojson(t: Tables) -> DataFrame:
    f = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(c("s_nationkey").cast("long"), c("s_suppkey")).alias("coordinates")).alias("geometry"), F.struct(c("s_name").alias("name")).alias("properties"))
    return t.supplier.select("s_suppkey", F.to_json(f).alias("feature"))


@R.add("a12_incremental", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderdate > TIMESTAMP '2000-01-01' ORDER BY o_orderdate, o_orderkey LIMIT 2000")
def incremental(t: Tables) -> DataFrame:
    """Rows past the high-watermark, oldest first, a page of 2000."""
    return t.orders.filter((c("o_orderstatus") == "F") & (c("o_orderdate") > F.lit("2000-01-01").cast("timestamp_ntz"))).orderBy("o_orderdate", "o_orderkey").limit(2000).select("o_orderkey")


@R.add("i6_progress", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def progress(t: Tables) -> DataFrame:
    """Running totals of a stream in complete mode; the last state of each key."""
    g = read_stream(t.spark, f"{t.sf_dir}/events.parquet").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("s"))
    last = drained(g, "update").groupBy("event_type").agg(F.max_by("s", "n").alias("s"), F.max("n").alias("n"))
    return last.select("event_type", "n", F.round("s", 4).alias("total"))


@R.add("i13_watermark", "SELECT CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS n FROM events GROUP BY 1")
def watermarked(t: Tables) -> DataFrame:
    """Day windows under a watermark; a later count of a day replaces an earlier one."""
    s = read_stream(t.spark, f"{t.sf_dir}/events.parquet").select(c("ts").cast("timestamp").alias("ts"))
    g = s.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"))
    return drained(g.select(F.to_date("w.start").alias("day"), "n"), "update").groupBy("day").agg(F.max("n").alias("n"))
