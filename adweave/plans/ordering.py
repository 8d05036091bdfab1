"""Windows, sorts, limits, sets and keyed rewrites over the proxy tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.joins import first_per
from ..operators.merges import checked_fk, delete_cascade, merged_maps
from ..operators.sequences import first_hit_else_best, latch, streaks, tiles, until_superset
from .base import Registry, Tables

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
c = F.col


@R.add(
    "e1_dedup_view",
    """SELECT match_id, asset_id, distributor_id, score FROM matches QUALIFY row_number() OVER (PARTITION BY asset_id, coalesce(distributor_id, -match_id) ORDER BY score DESC, last_seen DESC NULLS LAST, created_at DESC, match_id, price) = 1""",
)
def dedup_view(t: Tables) -> DataFrame:
    """The best match of an asset and dealer; rows without a dealer stay apart."""
    key = F.coalesce("distributor_id", -c("match_id"))
    return first_per(t.matches.withColumn("k", key), ["asset_id", "k"], [F.desc("score"), F.desc_nulls_last("last_seen"), F.desc("created_at"), F.asc("match_id"), F.asc("price")]).select("match_id", "asset_id", "distributor_id", "score")


@R.add(
    "e2_prune_within_scan",
    "SELECT match_id, price FROM matches QUALIFY row_number() OVER (PARTITION BY scan_job_id, asset_id % 3, distributor_id IS NULL ORDER BY score DESC, match_id, price) > 1",
)
def prune_within_scan(t: Tables) -> DataFrame:
    """What a scan's prune deletes; here rows without a dealer do collapse."""
    w = Window.partitionBy("scan_job_id", c("asset_id") % 3, c("distributor_id").isNull()).orderBy(F.desc("score"), "match_id", "price")
    return t.matches.withColumn("rn", F.row_number().over(w)).filter("rn > 1").select("match_id", "price")


@R.add(
    "e3_first_by_host",
    "WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host FROM pages) SELECT host, min_by(url, page_id) AS url, min(page_id) AS page_id, count(*) - 1 AS later FROM p GROUP BY 1",
)
def first_by_host(t: Tables) -> DataFrame:
    """The first row of a key in input order, and how many duplicates follow."""
    h = F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1))
    return t.pages.groupBy(h.alias("host")).agg(F.min_by("url", "page_id").alias("url"), F.min("page_id").alias("page_id"), (F.count("*") - 1).alias("later"))


@R.add(
    "e6_streaks",
    """WITH x AS (SELECT user_id, event_id, ts, event_type <> 'error' AS ok, sum(CAST(event_type <> 'error' AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events)
    SELECT event_id, CAST(sum(CAST(NOT ok AS INTEGER)) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS BIGINT) AS streak FROM x""",
)
def failure_streaks(t: Tables) -> DataFrame:
    return streaks(t.events, "user_id", ["ts", "event_id"], c("event_type") != "error").select("event_id", "streak")


@R.add(
    "e7_latch",
    """WITH x AS (SELECT event_id, user_id, ts, CAST(sum(CAST(value * 100 AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) % 5 AS INTEGER) AS jitter FROM events)
    SELECT event_id, spent, max(CAST(spent >= 50000 AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) = 1 AS tripped, jitter FROM x""",
)
def cost_latch(t: Tables) -> DataFrame:
    """Running totals, a latch on the cap, positional jitter."""
    out = latch(t.events, "user_id", ["ts", "event_id"], F.round(c("value") * 100).cast("long"), 50_000)
    return out.select("event_id", "spent", "tripped", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) % 5).alias("jitter"))


@R.add(
    "e10_tiles",
    """WITH x AS (SELECT p_partkey, 500 + p_size * 90 AS h FROM part), y AS (SELECT p_partkey, unnest(range(0, CAST(greatest(ceil((h - 200) / 800.0), 1) AS BIGINT))) AS i FROM x)
    SELECT p_partkey, CAST(i AS INTEGER) AS tile, CAST(i * 800 AS INTEGER) AS top FROM y""",
)
def page_tiles(t: Tables) -> DataFrame:
    x = t.part.select("p_partkey", (500 + c("p_size") * 90).alias("h"))
    return tiles(x, c("h"), 1000, 200).select("p_partkey", "tile", "top")


@R.add(
    "e11_early_exit",
    """SELECT user_id, coalesce(min_by(event_id, event_id) FILTER (event_type='purchase' AND value >= 15), max_by(event_id, (value, -event_id))) AS event_id, count(*) FILTER (event_type='purchase' AND value >= 15) > 0 AS hit FROM events GROUP BY 1""",
)
def early_exit(t: Tables) -> DataFrame:
    """The first good attempt, else the best one."""
    e = t.events.withColumn("o", c("event_id"))
    return first_hit_else_best(e, "user_id", "o", (c("event_type") == "purchase") & (c("value") >= 15), c("value"), "event_id")


@R.add("f1_latest", "SELECT match_id, CAST(created_at AS DATE) AS day FROM matches ORDER BY created_at DESC, match_id DESC LIMIT 50")
def latest(t: Tables) -> DataFrame:
    """the newest rows; a limit is the feature."""
    return t.matches.orderBy(F.desc("created_at"), F.desc("match_id")).limit(50).select("match_id", F.to_date("created_at").alias("day"))


@R.add("f2_page", "SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 20 OFFSET 40")
def page(t: Tables) -> DataFrame:
    """the third page of the oldest jobs."""
    return t.orders.orderBy("o_orderdate", "o_orderkey").offset(40).limit(20).select("o_orderkey")


@R.add(
    "f5_review_order",
    """WITH x AS (SELECT match_id, price, score, status FROM matches ORDER BY match_id DESC, price LIMIT 100) SELECT match_id, CASE WHEN score BETWEEN 60 AND 80 THEN 0 WHEN status = 'violation' THEN 1 ELSE 2 END AS bucket,
    CAST(row_number() OVER (ORDER BY CASE WHEN score BETWEEN 60 AND 80 THEN 0 WHEN status = 'violation' THEN 1 ELSE 2 END, match_id DESC, price) AS INTEGER) AS place FROM x""",
)
def review_order(t: Tables) -> DataFrame:
    """a stable sort by bucket of the newest hundred rows."""
    x = t.matches.orderBy(F.desc("match_id"), "price").limit(100)
    bucket = F.when(c("score").between(60, 80), 0).when(c("status") == "violation", 1).otherwise(2)
    x = x.withColumn("bucket", bucket)
    return x.select("match_id", "bucket", F.row_number().over(Window.orderBy("bucket", F.desc("match_id"), "price")).alias("place"))  # a hundred rows


@R.add(
    "f8_pool_fill",
    """WITH x AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host, contains(url, '?') AS promo FROM pages) SELECT host, page_id FROM x QUALIFY row_number() OVER (PARTITION BY host ORDER BY promo DESC, page_id) <= 4""",
)
def pool_fill(t: Tables) -> DataFrame:
    """F8: up to four pages of a site, promotional ones first."""
    x = t.pages.select("page_id", F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)).alias("host"), F.contains("url", F.lit("?")).alias("promo"))
    return first_per(x, ["host"], [F.desc("promo"), F.asc("page_id")], 4).select("host", "page_id")


@R.add(
    "g1_union_first",
    """WITH x AS (SELECT job_id, 1 AS bucket FROM jobs WHERE status='running' AND job_id % 3 = 0 UNION ALL SELECT job_id, 2 FROM jobs WHERE job_id % 2 = 0 UNION ALL SELECT job_id, 3 FROM jobs WHERE status='pending') SELECT job_id, min(bucket) AS bucket FROM x GROUP BY 1""",
)
def union_first(t: Tables) -> DataFrame:
    """G1: union of three buckets, the first one wins."""
    j = t.jobs
    parts = [j.filter("status = 'running' and job_id % 3 = 0"), j.filter("job_id % 2 = 0"), j.filter("status = 'pending'")]
    u = None
    for i, p in enumerate(parts, 1):
        p = p.select("job_id", F.lit(i).alias("bucket"))
        u = p if u is None else u.unionByName(p)
    return u.groupBy("job_id").agg(F.min("bucket").alias("bucket"))


@R.add(
    "g2_array_sets",
    """WITH g AS (SELECT user_id, list_sort(list_distinct(list(event_type) FILTER (event_id % 2 = 0))) AS a, list_sort(list_distinct(list(event_type) FILTER (event_id % 2 = 1))) AS b FROM events GROUP BY 1)
    SELECT user_id, array_to_string(list_sort(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))), ',') AS both_, array_to_string(list_sort(list_filter(coalesce(a, []), lambda x: NOT list_contains(coalesce(b, []), x))), ',') AS only_a,
    len(list_filter(['view','click'], lambda x: NOT list_contains(coalesce(a, []), x))) = 0 AS has_all FROM g""",
)
def array_sets(t: Tables) -> DataFrame:
    """G2, G3 and G5."""
    pick = lambda k: F.collect_set(F.when(c("event_id") % 2 == k, c("event_type")))
    g = t.events.groupBy("user_id").agg(pick(0).alias("a"), pick(1).alias("b"))
    return g.select("user_id", F.array_join(F.sort_array(F.array_union("a", "b")), ",").alias("both_"), F.array_join(F.sort_array(F.array_except("a", "b")), ",").alias("only_a"), (F.size(F.array_except(F.array(F.lit("view"), F.lit("click")), "a")) == 0).alias("has_all"))


@R.add("g4_distinct_pairs", "SELECT DISTINCT asset_id, distributor_id FROM matches WHERE distributor_id IS NOT NULL AND channel <> ''")
def distinct_pairs(t: Tables) -> DataFrame:
    return t.matches.filter(c("distributor_id").isNotNull() & (c("channel") != "")).select("asset_id", "distributor_id").distinct()


@R.add(
    "j3_partial_update",
    """SELECT match_id, price, coalesce(CASE WHEN match_id % 4 = 0 THEN 'approved' END, status) AS status, CASE WHEN match_id % 4 = 0 THEN DATE '2001-01-01' END AS reviewed, status || CASE WHEN match_id % 4 = 0 THEN ',flagged' ELSE '' END AS issues FROM matches""",
)
def partial_update(t: Tables) -> DataFrame:
    """New values where given, derived review date, an appended issue."""
    m = t.matches
    new = F.when(c("match_id") % 4 == 0, F.lit("approved"))
    issues = F.when(new.isNotNull(), F.array_append(F.array("status"), F.lit("flagged"))).otherwise(F.array("status"))
    return m.select("match_id", "price", F.coalesce(new, "status").alias("status"), F.when(new.isNotNull(), F.lit("2001-01-01").cast("date")).alias("reviewed"), F.array_join(issues, ",").alias("issues"))


@R.add(
    "j5_cascade",
    """SELECT (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 0)) AS matches_left, (SELECT count(*) FROM orders WHERE o_custkey % 10 <> 0) AS jobs_left,
    (SELECT count(*) FROM lineitem WHERE l_suppkey % 20 <> 0) AS linked""",
)
def cascade(t: Tables) -> DataFrame:
    """What deletes leave, with cascade and with keys set to null."""
    gone = t.orders.filter("o_custkey % 10 = 0")
    kept, = delete_cascade(gone, "o_orderkey", [(t.lineitem, "l_orderkey", "cascade")])
    nulled, = delete_cascade(t.supplier.filter("s_suppkey % 20 = 0"), "s_suppkey", [(t.lineitem.select("l_suppkey"), "l_suppkey", "set null")])
    a, b, d = kept.agg(F.count("*").alias("matches_left")), t.orders.filter("o_custkey % 10 <> 0").agg(F.count("*").alias("jobs_left")), nulled.agg(F.count("l_suppkey").alias("linked"))
    return a.crossJoin(b).crossJoin(d)  # one row each


@R.add("j7_merge_maps", "SELECT user_id, min(event_id) AS a, CASE WHEN user_id % 2 = 0 THEN max(event_id) ELSE min(value)::BIGINT END AS b, CASE WHEN user_id % 2 = 0 THEN max(event_id) END AS d FROM events GROUP BY 1")
def merge_maps(t: Tables) -> DataFrame:
    """Shallow merge of JSON-like maps, the new values win."""
    g = t.events.groupBy("user_id").agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi"), F.bround(F.min("value")).cast("long").alias("v"))
    old = F.create_map(F.lit("a"), "lo", F.lit("b"), "v")
    new = F.when(c("user_id") % 2 == 0, F.create_map(F.lit("b"), "hi", F.lit("d"), "hi")).otherwise(F.create_map().cast("map<string,bigint>"))
    m = merged_maps(old, new)
    return g.select("user_id", *[F.try_element_at(m, F.lit(k)).alias(k) for k in "abd"])


@R.add("a21_checked_insert", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) THEN l_suppkey END AS l_suppkey FROM lineitem")
def checked_insert(t: Tables) -> DataFrame:
    """Dangling dealer keys become null, as a bulk insert retries them."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return checked_fk(rows, "l_suppkey", t.supplier.filter("s_acctbal > 0"), "s_suppkey")


@R.add(
    "i7_early_stop",
    """WITH f AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 AS first FROM events), s AS (SELECT *, sum(CAST(first AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM f)
    SELECT event_id, user_id FROM s WHERE n - CAST(first AS INTEGER) < 4""",
)
def early_stop(t: Tables) -> DataFrame:
    """Events up to the one at which a user has shown four kinds."""
    return until_superset(t.events, "user_id", ["ts", "event_id"], "event_type", 4).select("event_id", "user_id")


@R.add(
    "i3_idle",
    """SELECT job_id, CASE WHEN status = 'running' THEN CASE WHEN job_id % 4 = 0 THEN 'no heartbeat' ELSE 'stale heartbeat' END ELSE 'stuck pending' END AS reason FROM jobs
    WHERE (status = 'running' AND (CASE WHEN job_id % 4 <> 0 THEN created_at + to_hours(CAST(job_id % 48 AS INTEGER)) END < TIMESTAMP '1998-06-01' - INTERVAL 30 MINUTE OR (job_id % 4 = 0 AND created_at < TIMESTAMP '1998-06-01' - INTERVAL 30 MINUTE)))
    OR (status = 'pending' AND created_at < TIMESTAMP '1998-06-01' - INTERVAL 15 MINUTE)""",
)
def idle(t: Tables) -> DataFrame:
    """Jobs whose heartbeat, or creation, is too old."""
    now = F.lit("1998-06-01").cast("timestamp_ntz")
    beat = F.when(c("job_id") % 4 != 0, c("created_at") + F.make_interval(hours=(c("job_id") % 48).cast("int")))
    old = lambda x, m: x < now - F.expr(f"interval {m} minutes")
    run = (c("status") == "running") & (old(beat, 30) | (beat.isNull() & old(c("created_at"), 30)))
    pend = (c("status") == "pending") & old(c("created_at"), 15)
    return t.jobs.filter(run | pend).select("job_id", F.when(c("status") == "running", F.when(beat.isNull(), "no heartbeat").otherwise("stale heartbeat")).otherwise("stuck pending").alias("reason"))


@R.add("i20_windows", "SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def day_windows(t: Tables) -> DataFrame:
    """Tumbling days."""
    g = t.events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.to_date("w.start").alias("day"), "event_type", "n", "total")


@R.add(
    "i11_drift",
    """WITH x AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old FROM events) SELECT event_id, old, event_type AS new, event_type = 'error' AS alert, CASE WHEN event_type = 'error' THEN 'critical' ELSE 'none' END AS severity FROM x WHERE old <> '' AND old <> event_type""",
)
def drift(t: Tables) -> DataFrame:
    """Changes of status, an alert only for changes into violation."""
    old = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    x = t.events.select("event_id", old.alias("old"), c("event_type").alias("new")).filter((c("old") != "") & (c("old") != c("new")))
    return x.select("event_id", "old", "new", (c("new") == "error").alias("alert"), F.when(c("new") == "error", "critical").otherwise("none").alias("severity"))


@R.add(
    "i9_hit_cache",
    """SELECT user_id, count(*) AS hits, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS kinds, CAST(max(ts) AS DATE) AS last_hit, greatest(75, 65 + 10) AS admission FROM events WHERE event_type <> 'error' GROUP BY 1""",
)
def hit_cache(t: Tables) -> DataFrame:
    """Hits, kinds seen and last hit of a page; the admission threshold."""
    return t.events.filter("event_type <> 'error'").groupBy("user_id").agg(F.count("*").alias("hits"), F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("kinds"), F.to_date(F.max("ts")).alias("last_hit"), F.lit(75).alias("admission"))
