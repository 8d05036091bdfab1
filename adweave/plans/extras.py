"""Further sources, sinks and roll-ups over the proxy tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules, scores
from ..functions.text import hostname
from ..operators.joins import first_per
from ..sources.files import read_csv
from ..streaming.base import shared_folder
from .base import Registry, Tables

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
c = F.col


@R.add(
    "a10_post_images",
    """WITH p AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'Video' ELSE 'Image' END AS type, 'http://i/' || event_id AS main, ['http://i/' || event_id, 'http://i/' || (event_id % 7)] AS kids FROM events)
    SELECT event_id, unnest(list_distinct(list_concat([main], kids))) AS image FROM p WHERE lower(type) <> 'video'""",
)
def post_images(t: Tables) -> DataFrame:
    """A10: images of posts and of their children, each once; videos dropped."""
    url = lambda x: F.concat(F.lit("http://i/"), x.cast("string"))
    p = t.events.select("event_id", F.when(c("event_id") % 5 == 0, "Video").otherwise("Image").alias("type"), url(c("event_id")).alias("main"), F.array(url(c("event_id")), url(c("event_id") % 7)).alias("kids"))
    return p.filter(F.lower("type") != "video").select("event_id", F.explode(F.array_distinct(F.concat(F.array("main"), "kids"))).alias("image"))


@R.add(
    "a17_page_elements",
    """WITH x AS (SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)">', 1) AS srcs FROM pages), y AS (SELECT page_id, unnest(list_distinct(srcs)) AS src, srcs FROM x)
    SELECT page_id, src FROM y WHERE length(src) > 3 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY list_position(srcs, src)) <= 50""",
)
def page_elements(t: Tables) -> DataFrame:
    """A17 on static HTML: elements by pattern, small ones dropped, each once, fifty a page at most."""
    srcs = F.regexp_extract_all("html", F.lit('<li><a href="([^"]*)">'), F.lit(1))
    kept = F.slice(F.filter(F.array_distinct(srcs), lambda s: F.length(s) > 3), 1, 50)
    return t.pages.select("page_id", F.explode(kept).alias("src"))


@R.add("a19_queue_pick", "SELECT source, min_by(job_id, (created_at, job_id)) AS job_id, 'running' AS status FROM jobs WHERE status = 'pending' GROUP BY 1")
def queue_pick(t: Tables) -> DataFrame:
    """A19 in batch form: the oldest pending job of each queue is claimed."""
    return t.jobs.filter("status = 'pending'").groupBy("source").agg(F.min_by("job_id", F.struct("created_at", "job_id")).alias("job_id")).withColumn("status", F.lit("running"))


_CASES = "case verdict WHEN 'true_positive' THEN 'clear_positive' WHEN 'true_negative' THEN 'different_brand' WHEN 'false_negative' THEN 'modified_positive' ELSE 'borderline_false' END"


@R.add(
    "a20_labelled_cases",
    f"""WITH m AS (SELECT match_id, min(asset_id) AS asset_id FROM matches GROUP BY 1), f AS (SELECT match_id, verdict, count(*) AS n FROM feedback GROUP BY ALL),
    i AS (SELECT match_id, CASE WHEN match_id % 4 <> 0 THEN 'https://img/' || match_id END AS image_url, CASE WHEN match_id % 8 = 0 THEN 'https://shot/' || match_id END AS shot, CASE WHEN match_id % 3 = 0 THEN 'https://page/' || match_id END AS page FROM m),
    x AS (SELECT match_id, a.name, {_CASES} AS category, coalesce(image_url, shot, page) AS discovered, verdict IN ('true_positive', 'false_negative') AS is_match, n FROM f LEFT JOIN m USING (match_id) LEFT JOIN assets a USING (asset_id) LEFT JOIN i USING (match_id))
    SELECT * FROM x WHERE discovered IS NOT NULL AND name IS NOT NULL""",
)
def labelled_cases(t: Tables) -> DataFrame:
    """Feedback with its match, asset and discovered image (the image, else the screenshot, else the page), its category and expectation; cases without asset or image are no cases. Of matches of one id the smallest asset counts."""
    f = t.feedback.groupBy("match_id", "verdict").agg(F.count("*").alias("n"))
    m = t.matches.groupBy("match_id").agg(F.min("asset_id").alias("asset_id"))
    i, url = c("match_id"), lambda kind: F.concat(F.lit(f"https://{kind}/"), c("match_id").cast("string"))
    found = m.select("match_id", "asset_id", F.when(i % 4 != 0, url("img")).alias("image_url"), F.when(i % 8 == 0, url("shot")).alias("shot"), F.when(i % 3 == 0, url("page")).alias("page"))
    x = f.join(found, "match_id", "left").join(t.assets.select("asset_id", "name"), "asset_id", "left")
    x = x.select("match_id", "name", rules.category(c("verdict")).alias("category"), F.coalesce("image_url", "shot", "page").alias("discovered"), c("verdict").isin("true_positive", "false_negative").alias("is_match"), "n")
    return x.filter("discovered IS NOT NULL AND name IS NOT NULL")


@R.add(
    "a28_notification",
    """WITH v AS (SELECT d.org_id, m.match_id, m.price, row_number() OVER (PARTITION BY d.org_id ORDER BY m.score DESC, m.match_id, m.price) AS rn FROM matches m JOIN dealers d USING (distributor_id) WHERE m.status = 'violation')
    SELECT org_id, count(*) AS violations, string_agg(CAST(match_id AS VARCHAR), ',' ORDER BY rn) FILTER (rn <= 10) AS shown, greatest(count(*) - 10, 0) AS more FROM v GROUP BY 1""",
)
def notification(t: Tables) -> DataFrame:
    """Violations of an organisation, ten of them by name; the cut is the feature."""
    v = t.matches.filter("status = 'violation'").join(t.dealers.select("distributor_id", "org_id"), "distributor_id").select("org_id", "match_id", "score", "price")
    top = first_per(v, ["org_id"], [F.desc("score"), F.asc("match_id"), F.asc("price")], 10)
    shown = F.transform(F.sort_array(F.collect_list(F.struct((-c("score")).alias("s"), "match_id", "price"))), lambda x: x["match_id"].cast("string"))
    n = v.groupBy("org_id").agg(F.count("*").alias("violations"))
    return n.join(top.groupBy("org_id").agg(F.array_join(shown, ",").alias("shown")), "org_id").select("org_id", "violations", "shown", F.greatest(c("violations") - 10, F.lit(0)).alias("more"))


@R.add("a34_pick_list", "SELECT n_name AS value, lower(n_name) AS key FROM nation WHERE n_nationkey % 4 <> 1")
def pick_list(t: Tables) -> DataFrame:
    """Options of a list without hidden ones."""
    options = F.array(F.struct(c("n_name").alias("value"), (c("n_nationkey") % 4 == 1).alias("hidden")))
    return t.nation.select(F.explode(options).alias("o")).filter(~c("o.hidden")).select("o.value", F.lower("o.value").alias("key"))


@R.add(
    "a25_report_csv",
    """SELECT channel, CAST(count(*) AS VARCHAR) AS total, CAST(round(count(*) FILTER (status='compliant') * 100.0 / count(*), 1) AS VARCHAR) || '%' AS rate FROM matches GROUP BY 1""",
)
def report_csv(t: Tables) -> DataFrame:
    """The channel section of the report as CSV, read back."""
    at = f"{shared_folder(t.spark)}/report-{uuid.uuid4().hex}"
    g = t.matches.groupBy("channel").agg(F.count("*").alias("total"), F.count_if(c("status") == "compliant").alias("ok"))
    rows = g.select("channel", c("total").cast("string").alias("total"), F.concat(scores.rate(c("ok"), c("total")).cast("string"), F.lit("%")).alias("rate"))
    rows.coalesce(1).write.option("header", True).option("escape", '"').csv(at)  # a handful of rows
    return read_csv(t.spark, at)


@R.add(
    "d32_outcomes",
    """WITH g AS (SELECT user_id % 30 AS job, list(CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'ok' WHEN 'click' THEN 'partial' ELSE 'blocked' END) AS o FROM events GROUP BY 1)
    SELECT job, len(list_filter(o, lambda x: x = 'ok')) AS ok, len(list_filter(o, lambda x: x = 'partial')) AS partial, len(list_filter(o, lambda x: x IN ('failed','blocked'))) AS failed FROM g""",
)
def outcomes(t: Tables) -> DataFrame:
    """Outcomes of a job's dealers, counted without gathering them."""
    kind = c("event_type")
    return t.events.groupBy((c("user_id") % 30).alias("job")).agg(F.count_if(kind == "purchase").alias("ok"), F.count_if(kind == "click").alias("partial"), F.count_if(~kind.isin("purchase", "click")).alias("failed"))


@R.add("d39_categories", "SELECT p_type AS category, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM part), 2) AS share FROM part GROUP BY 1 ORDER BY n DESC, category")
def categories(t: Tables) -> DataFrame:
    """Counts by category, largest first, and their share."""
    total = t.part.agg(F.count("*").alias("all"))
    return t.part.groupBy(c("p_type").alias("category")).agg(F.count("*").alias("n")).crossJoin(total).select("category", "n", F.round(c("n") * 100.0 / c("all"), 2).alias("share")).orderBy(F.desc("n"), "category")  # one row


@R.add(
    "d44_seats",
    """SELECT n_regionkey AS org_id, count(*) FILTER (c_acctbal >= 0) AS members, count(*) FILTER (c_acctbal < 0 AND c_custkey % 3 <> 0) AS invites, count(*) FILTER (c_acctbal >= 0) + count(*) FILTER (c_acctbal < 0 AND c_custkey % 3 <> 0) <= CASE n_regionkey WHEN 0 THEN 100 WHEN 1 THEN 300 ELSE 250 END AS within
    FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey""",
)
def seats(t: Tables) -> DataFrame:
    """Seats in use against the plan's, unknown plans as the default one."""
    plans = t.spark.createDataFrame([(0, 100), (1, 300)], "org_id int, most int")
    x = t.customer.join(t.nation.select(c("n_nationkey").alias("c_nationkey"), c("n_regionkey").alias("org_id")), "c_nationkey")
    g = x.groupBy("org_id").agg(F.count_if(c("c_acctbal") >= 0).alias("members"), F.count_if((c("c_acctbal") < 0) & (c("c_custkey") % 3 != 0)).alias("invites"))
    return g.join(F.broadcast(plans), "org_id", "left").select("org_id", "members", "invites", (c("members") + c("invites") <= F.coalesce("most", F.lit(250))).alias("within"))  # two rows


@R.add("d43_extensions", "SELECT coalesce(nullif(regexp_extract(lower(url), '\\.([a-z0-9]+)(?:[?#]|$)', 1), ''), 'none') AS ext, count(*) AS n FROM pages GROUP BY 1")
def extensions(t: Tables) -> DataFrame:
    """Files by extension."""
    ext = F.coalesce(F.nullif(F.regexp_extract(F.lower("url"), r"\.([a-z0-9]+)(?:[?#]|$)", 1), F.lit("")), F.lit("none"))
    return t.pages.groupBy(ext.alias("ext")).agg(F.count("*").alias("n"))


@R.add(
    "h6_usernames",
    """WITH x AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'https://www.instagram.com/' || lower(c_mktsegment) || '/?hl=en' WHEN 1 THEN '@' || lower(c_mktsegment) ELSE c_mktsegment END AS u FROM customer)
    SELECT c_custkey, CASE WHEN contains(u, 'instagram.com') THEN regexp_extract(u, 'instagram\\.com/([^/?]+)', 1) WHEN starts_with(u, '@') THEN substr(u, 2) END AS username FROM x""",
)
def usernames(t: Tables) -> DataFrame:
    m = c("c_custkey") % 3
    u = F.when(m == 0, F.concat(F.lit("https://www.instagram.com/"), F.lower("c_mktsegment"), F.lit("/?hl=en"))).when(m == 1, F.concat(F.lit("@"), F.lower("c_mktsegment"))).otherwise(c("c_mktsegment"))
    x = t.customer.select("c_custkey", u.alias("u"))
    return x.select("c_custkey", F.when(F.contains("u", F.lit("instagram.com")), F.regexp_extract("u", r"instagram\.com/([^/?]+)", 1)).when(c("u").startswith("@"), F.substring("u", 2, 1000)).alias("username"))


@R.add(
    "h15_relative_times",
    """WITH x AS (SELECT event_id, date_diff('second', ts, TIMESTAMP '2024-02-01') AS s FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events))
    SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' ELSE (s // 86400) || 'd ago' END AS ago FROM x""",
)
def relative_times(t: Tables) -> DataFrame:
    s = F.unix_timestamp(F.lit("2024-02-01").cast("timestamp")) - F.unix_timestamp(F.date_trunc("second", c("ts")))
    part = lambda n, u: F.concat(F.floor(s / n).cast("string"), F.lit(f"{u} ago"))
    return t.events.select("event_id", F.when(s < 60, "just now").when(s < 3600, part(60, "m")).when(s < 86400, part(3600, "h")).otherwise(part(86400, "d")).alias("ago"))


@R.add(
    "l3_site_scan",
    """WITH p AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host, length(html) AS size FROM pages), k AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY size DESC, page_id) AS place FROM p),
    s AS (SELECT *, CASE WHEN size < 2000 THEN 'empty' WHEN page_id % 11 = 0 THEN 'blocked' ELSE 'scanned' END AS outcome FROM k WHERE place <= 4)
    SELECT host, count(*) FILTER (outcome = 'scanned') AS scanned, count(*) FILTER (outcome = 'blocked') AS blocked, count(*) FILTER (outcome = 'empty') AS empty_, CASE WHEN count(*) FILTER (outcome = 'scanned') = 0 AND count(*) FILTER (outcome = 'blocked') > 0 THEN 'blocked'
      WHEN count(*) FILTER (outcome = 'scanned') = 0 THEN 'empty' WHEN count(*) FILTER (outcome = 'blocked') > 0 THEN 'partial' ELSE 'ok' END AS status, max_by(page_id, (size, page_id)) AS slowest FROM s GROUP BY 1""",
)
def site_scan(t: Tables) -> DataFrame:
    """L3: up to four pages of a site, their outcomes, the site's status and slowest page."""
    p = t.pages.select("page_id", hostname(c("url")).alias("host"), F.length("html").alias("size"))
    s = first_per(p, ["host"], [F.desc("size"), F.asc("page_id")], 4)
    s = s.withColumn("outcome", F.when(c("size") < 2000, "empty").when(c("page_id") % 11 == 0, "blocked").otherwise("scanned"))
    n = lambda v: F.count_if(c("outcome") == v)
    g = s.groupBy("host").agg(n("scanned").alias("scanned"), n("blocked").alias("blocked"), n("empty").alias("empty_"), F.max_by("page_id", F.struct("size", "page_id")).alias("slowest"))
    return g.withColumn("status", F.when((c("scanned") == 0) & (c("blocked") > 0), "blocked").when(c("scanned") == 0, "empty").when(c("blocked") > 0, "partial").otherwise("ok"))
