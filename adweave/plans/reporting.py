"""Aggregations: dashboard statistics, trends, thresholds, coverage, costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scores import REGULAR, clamp, default_threshold, rate
from .base import Registry, Tables

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
c = F.col
n_if = lambda x: F.count_if(x)


def scoped(t: Tables, org: int = 1) -> DataFrame:
    """Matches of an organisation: by its dealer or by its asset; those with neither never."""
    own = lambda dim, key, flag: dim.filter(c("org_id") == org).select(key, F.lit(True).alias(flag))
    m = t.matches.join(own(t.dealers, "distributor_id", "by_dealer"), "distributor_id", "left").join(own(t.assets, "asset_id", "by_asset"), "asset_id", "left")
    return m.filter(c("by_dealer") | c("by_asset")).drop("by_dealer", "by_asset")


_SCOPE = "(m.distributor_id IN (SELECT distributor_id FROM dealers WHERE org_id = 1) OR m.asset_id IN (SELECT asset_id FROM assets WHERE org_id = 1))"


@R.add(
    "d16_compliance_trend",
    """SELECT CAST(created_at AS DATE) AS day, count(*) AS total, count(*) FILTER (status = 'compliant') AS compliant,
    count(*) FILTER (status = 'violation') AS violations, round(count(*) FILTER (status = 'compliant') * 100.0 / count(*), 1) AS rate
    FROM matches WHERE distributor_id IN (SELECT distributor_id FROM dealers WHERE org_id = 1) GROUP BY 1""",
)
def compliance_trend(t: Tables) -> DataFrame:
    own = t.matches.join(t.dealers.filter(c("org_id") == 1).select("distributor_id"), "distributor_id", "left_semi")
    out = own.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("total"), n_if(c("status") == "compliant").alias("compliant"), n_if(c("status") == "violation").alias("violations"))
    return out.withColumn("rate", rate(c("compliant"), c("total")))


@R.add(
    "d1_match_stats",
    """SELECT count(*) AS total, count(*) FILTER (status='compliant') AS compliant, count(*) FILTER (status='violation') AS violations,
    count(*) FILTER (status='pending') AS pending, count(*) FILTER (score >= 90) AS exact, count(*) FILTER (score >= 75 AND score < 90) AS strong,
    count(*) FILTER (score >= 65 AND score < 75) AS partial, round(avg(score), 2) AS avg_score FROM matches""",
)
def match_stats(t: Tables) -> DataFrame:
    s = c("score")
    return t.matches.agg(
        F.count("*").alias("total"),
        *[n_if(c("status") == v).alias(a) for v, a in (("compliant", "compliant"), ("violation", "violations"), ("pending", "pending"))],
        n_if(s >= 90).alias("exact"),
        n_if((s >= 75) & (s < 90)).alias("strong"),
        n_if((s >= 65) & (s < 75)).alias("partial"),
        F.round(F.avg("score"), 2).alias("avg_score"),
    )


@R.add(
    "d2_scoped_stats",
    f"""SELECT count(*) AS total, count(*) FILTER (status='compliant') AS compliant, coalesce(round(avg(score), 2), 0) AS avg_score,
    coalesce(round(avg(CASE WHEN score <> 0 AND score IS NOT NULL THEN score END), 2), 0) AS avg_nonzero FROM matches m WHERE {_SCOPE}""",
)
def scoped_stats(t: Tables) -> DataFrame:
    """D2 and D5, whose mean leaves zero scores out."""
    return scoped(t).agg(F.count("*").alias("total"), n_if(c("status") == "compliant").alias("compliant"), F.coalesce(F.round(F.avg("score"), 2), F.lit(0.0)).alias("avg_score"), F.coalesce(F.round(F.avg(F.when(c("score") != 0, c("score"))), 2), F.lit(0.0)).alias("avg_nonzero"))


@R.add(
    "d3_dashboard",
    """SELECT (SELECT count(*) FROM assets WHERE org_id = 1) AS assets, (SELECT count(*) FROM dealers WHERE org_id = 1 AND status = 'active') AS active_dealers,
    (SELECT count(*) FROM jobs WHERE org_id = 1 AND status = 'running') AS running, (SELECT count(*) FROM events WHERE event_type = 'error' AND event_id % 2 = 0) AS unread_alerts,
    (SELECT count(DISTINCT campaign_id) FROM assets WHERE org_id = 1) AS campaigns""",
)
def dashboard(t: Tables) -> DataFrame:
    """One-row aggregates side by side."""
    parts = [
        t.assets.filter("org_id = 1").agg(F.count("*").alias("assets")),
        t.dealers.filter("org_id = 1 and status = 'active'").agg(F.count("*").alias("active_dealers")),
        t.jobs.filter("org_id = 1 and status = 'running'").agg(F.count("*").alias("running")),
        t.events.filter("event_type = 'error' and event_id % 2 = 0").agg(F.count("*").alias("unread_alerts")),
        t.assets.filter("org_id = 1").agg(F.countDistinct("campaign_id").alias("campaigns")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out


@R.add(
    "d6_accuracy_stats",
    """SELECT source_type, channel, verdict, count(*) AS total, count(*) FILTER (was_correct) AS correct,
    round(count(*) FILTER (was_correct) * 100.0 / nullif(count(*), 0), 2) AS accuracy, round(avg(confidence), 4) AS avg_confidence FROM feedback GROUP BY ALL""",
)
def accuracy_stats(t: Tables) -> DataFrame:
    """D6."""
    g = t.feedback.groupBy("source_type", "channel", "verdict").agg(F.count("*").alias("total"), n_if(c("was_correct")).alias("correct"), F.round(F.avg("confidence"), 4).alias("avg_confidence"))
    return g.withColumn("accuracy", F.round(c("correct") * 100.0 / F.nullif(c("total"), F.lit(0)), 2))


@R.add(
    "d8_optimal_threshold",
    """SELECT source_type, CASE WHEN count(*) < 20 THEN 40 ELSE CAST(round_even(avg(confidence) FILTER (was_correct) - 0.5 * stddev_samp(confidence) FILTER (was_correct), 0) AS INTEGER) END AS threshold,
    round(count(*) FILTER (verdict = 'false_positive') * 100.0 / count(*), 2) AS fp_rate, round(count(*) FILTER (verdict = 'false_negative') * 100.0 / count(*), 2) AS fn_rate
    FROM feedback GROUP BY 1""",
)
def optimal_threshold(t: Tables) -> DataFrame:
    ok = F.when(c("was_correct"), c("confidence"))
    g = t.feedback.groupBy("source_type").agg(
        F.count("*").alias("n"), F.avg(ok).alias("mean"), F.stddev_samp(ok).alias("sd"), n_if(c("verdict") == "false_positive").alias("fp"), n_if(c("verdict") == "false_negative").alias("fn")
    )
    return g.select(
        "source_type",
        F.when(c("n") < 20, 40).otherwise(F.bround(c("mean") - 0.5 * c("sd")).cast("int")).alias("threshold"),
        F.round(c("fp") * 100.0 / c("n"), 2).alias("fp_rate"),
        F.round(c("fn") * 100.0 / c("n"), 2).alias("fn_rate"),
    )


@R.add(
    "d9_adaptive_threshold",
    """WITH g AS (SELECT source_type, channel, count(*) AS n, avg(confidence) FILTER (was_correct) AS mean, stddev_pop(confidence) FILTER (was_correct) AS sd,
      count(*) FILTER (verdict='false_positive') * 100.0 / count(*) AS fp, count(*) FILTER (verdict='false_negative') * 100.0 / count(*) AS fn FROM feedback GROUP BY 1, 2),
    b AS (SELECT *, CAST(trunc(mean - 0.5 * sd) AS INTEGER) AS base FROM g)
    SELECT source_type, channel, n, CASE WHEN n < 20 THEN 60 ELSE greatest(15, least(85, coalesce(base, 60)
      + CASE WHEN fp > 25 THEN 15 WHEN fp > 15 THEN 10 WHEN fp > 10 THEN 5 ELSE 0 END - CASE WHEN fn > 25 THEN 15 WHEN fn > 15 THEN 10 WHEN fn > 10 THEN 5 ELSE 0 END)) END AS threshold,
      CASE WHEN n >= 100 THEN 'high' WHEN n >= 50 THEN 'medium' ELSE 'low' END AS confidence_label FROM b""",
)
def adaptive_threshold(t: Tables) -> DataFrame:
    """Threshold of every source type and channel, by error ladders, from 15 to 85."""
    ok = F.when(c("was_correct"), c("confidence"))
    share = lambda v: n_if(c("verdict") == v) * 100.0 / F.count("*")
    g = t.feedback.groupBy("source_type", "channel").agg(F.count("*").alias("n"), F.avg(ok).alias("mean"), F.stddev_pop(ok).alias("sd"), share("false_positive").alias("fp"), share("false_negative").alias("fn"))
    ladder = lambda x: F.when(x > 25, 15).when(x > 15, 10).when(x > 10, 5).otherwise(0)
    default = default_threshold(c("source_type"))
    base = F.coalesce((c("mean") - 0.5 * c("sd")).cast("int"), default)
    level = clamp(base + ladder(c("fp")) - ladder(c("fn")), 15, 85).cast("int")
    return g.select("source_type", "channel", "n", F.when(c("n") < 20, default).otherwise(level).alias("threshold"), F.when(c("n") >= 100, "high").when(c("n") >= 50, "medium").otherwise("low").alias("confidence_label"))


@R.add(
    "d11_threshold_recommendation",
    """WITH g AS (SELECT source_type, channel, count(*) AS n, avg(confidence) FILTER (was_correct AND confidence <> 0) AS mean, stddev_pop(confidence) FILTER (was_correct AND confidence <> 0) AS sd,
      count(*) FILTER (verdict='false_positive') * 100.0 / count(*) AS fp, count(*) FILTER (verdict='false_negative') * 100.0 / count(*) AS fn FROM feedback GROUP BY 1, 2 HAVING count(*) >= 10),
    b AS (SELECT *, coalesce(CAST(trunc(mean - 0.5 * sd) AS INTEGER), 60) AS r FROM g)
    SELECT source_type, channel, CASE WHEN fp > 20 THEN least(100, r + 10) WHEN fn > 20 THEN greatest(10, r - 10) ELSE r END AS recommended FROM b""",
)
def threshold_recommendation(t: Tables) -> DataFrame:
    ok = F.when(c("was_correct") & (c("confidence") != 0), c("confidence"))
    share = lambda v: n_if(c("verdict") == v) * 100.0 / F.count("*")
    g = t.feedback.groupBy("source_type", "channel").agg(F.count("*").alias("n"), F.avg(ok).alias("mean"), F.stddev_pop(ok).alias("sd"), share("false_positive").alias("fp"), share("false_negative").alias("fn"))
    r = F.coalesce((c("mean") - 0.5 * c("sd")).cast("int"), F.lit(REGULAR))  # no correct prediction with a score: the regular threshold is the start
    g = g.filter(c("n") >= 10)
    return g.select("source_type", "channel", F.when(c("fp") > 20, F.least(F.lit(100), r + 10)).when(c("fn") > 20, F.greatest(F.lit(10), r - 10)).otherwise(r).alias("recommended"))


@R.add(
    "d12_calibration",
    """WITH g AS (SELECT channel, count(*) AS n, avg(confidence) FILTER (was_correct) AS good, avg(confidence) FILTER (NOT was_correct) AS bad FROM feedback GROUP BY 1)
    SELECT channel, CASE WHEN n < 20 OR good IS NULL THEN 1.0::DOUBLE ELSE round((CASE WHEN bad > 60 THEN 0.85::DOUBLE WHEN bad > 50 THEN 0.90::DOUBLE WHEN bad > 40 THEN 0.95::DOUBLE ELSE 1.0::DOUBLE END)
      * (CASE WHEN good < 50 THEN 1.15::DOUBLE WHEN good < 60 THEN 1.10::DOUBLE WHEN good < 70 THEN 1.05::DOUBLE ELSE 1.0::DOUBLE END), 3) END AS factor FROM g""",
)
def calibration(t: Tables) -> DataFrame:
    g = t.feedback.groupBy("channel").agg(F.count("*").alias("n"), F.avg(F.when(c("was_correct"), c("confidence"))).alias("good"), F.avg(F.when(~c("was_correct"), c("confidence"))).alias("bad"))
    down = F.when(c("bad") > 60, 0.85).when(c("bad") > 50, 0.90).when(c("bad") > 40, 0.95).otherwise(1.0)
    up = F.when(c("good") < 50, 1.15).when(c("good") < 60, 1.10).when(c("good") < 70, 1.05).otherwise(1.0)
    return g.select("channel", F.when((c("n") < 20) | c("good").isNull(), 1.0).otherwise(F.round(down * up, 3)).alias("factor"))


@R.add("d14_by_channel", f"SELECT coalesce(nullif(channel, '5-LOW'), 'unknown') AS channel, count(*) AS n FROM matches m WHERE {_SCOPE} GROUP BY 1 ORDER BY n DESC")
def by_channel(t: Tables) -> DataFrame:
    return scoped(t).groupBy(F.coalesce(F.nullif(c("channel"), F.lit("5-LOW")), F.lit("unknown")).alias("channel")).agg(F.count("*").alias("n")).orderBy(F.desc("n"))


@R.add(
    "d15_top_dealers",
    """SELECT coalesce(d.name, 'Unknown') AS name, g.n FROM (SELECT distributor_id, count(*) AS n FROM matches WHERE distributor_id IS NOT NULL GROUP BY 1 ORDER BY n DESC, distributor_id LIMIT 10) g
    LEFT JOIN dealers d USING (distributor_id)""",
)
def top_dealers(t: Tables) -> DataFrame:
    """The ten dealers with most matches."""
    top = t.matches.filter(c("distributor_id").isNotNull()).groupBy("distributor_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "distributor_id").limit(10)
    return top.join(t.dealers.select("distributor_id", "name"), "distributor_id", "left").select(F.coalesce("name", F.lit("Unknown")).alias("name"), "n")


@R.add(
    "d17_accuracy_trend",
    """SELECT CAST(created_at AS DATE) AS day, count(*) AS total, count(*) FILTER (was_correct) AS correct, round(count(*) FILTER (was_correct) * 100.0 / count(*), 1) AS accuracy
    FROM feedback GROUP BY ROLLUP (CAST(created_at AS DATE))""",
)
def accuracy_trend(t: Tables) -> DataFrame:
    """Daily accuracy, and overall in the row without a day."""
    g = t.feedback.withColumn("day", F.to_date("created_at")).rollup("day").agg(F.count("*").alias("total"), n_if(c("was_correct")).alias("correct"))
    return g.withColumn("accuracy", rate(c("correct"), c("total")))


@R.add(
    "d18_report",
    """SELECT channel, distributor_id, CAST(created_at AS DATE) AS day, count(*) AS total, count(*) FILTER (status='compliant') AS compliant, count(*) FILTER (status='violation') AS violations,
    CAST(grouping(channel)*4 + grouping(distributor_id)*2 + grouping(CAST(created_at AS DATE)) AS BIGINT) AS level
    FROM matches WHERE distributor_id IS NOT NULL GROUP BY GROUPING SETS ((), (channel), (distributor_id), (CAST(created_at AS DATE)))""",
)
def report(t: Tables) -> DataFrame:
    """Report totals, by channel, by dealer and by day, from one pass over the matches."""
    m = t.matches.filter(c("distributor_id").isNotNull()).withColumn("day", F.to_date("created_at"))
    keys = [c("channel"), c("distributor_id"), c("day")]
    g = m.groupingSets([[], [keys[0]], [keys[1]], [keys[2]]], *keys)
    return g.agg(F.count("*").alias("total"), n_if(c("status") == "compliant").alias("compliant"), n_if(c("status") == "violation").alias("violations"), F.grouping_id().alias("level"))


@R.add(
    "d19_dealer_counts",
    """SELECT d.distributor_id, d.name, coalesce(g.n, 0) AS matches, coalesce(g.v, 0) AS violations, coalesce(g.v, 0) > 0 AS has_violations, round(coalesce(g.ok * 100.0 / nullif(g.n, 0), 0), 1) AS rate
    FROM dealers d LEFT JOIN (SELECT distributor_id, count(*) AS n, count(*) FILTER (status='violation') AS v, count(*) FILTER (status='compliant') AS ok FROM matches GROUP BY 1) g USING (distributor_id)""",
)
def dealer_counts(t: Tables) -> DataFrame:
    """Counts onto the dimension, 0 and rate 0.0 where there are none."""
    g = t.matches.groupBy("distributor_id").agg(F.count("*").alias("n"), n_if(c("status") == "violation").alias("v"), n_if(c("status") == "compliant").alias("ok"))
    j = t.dealers.join(g, "distributor_id", "left")
    zero = lambda x: F.coalesce(c(x), F.lit(0))
    return j.select("distributor_id", "name", zero("n").alias("matches"), zero("v").alias("violations"), (zero("v") > 0).alias("has_violations"), rate(zero("ok"), zero("n")).alias("rate"))


@R.add(
    "d21_campaign_stats",
    """SELECT campaign_no, count(*) AS scans, count(*) FILTER (status='completed') AS completed, count(*) FILTER (status='running') AS running, count(*) FILTER (status IN ('pending','review')) AS pending_review,
    CAST(max(created_at) AS DATE) AS last_scan, max_by(job_id, (created_at, job_id)) AS last_job FROM jobs GROUP BY 1""",
)
def campaign_stats(t: Tables) -> DataFrame:
    """Pivoted counts and the latest scan of each campaign."""
    return t.jobs.groupBy("campaign_no").agg(
        F.count("*").alias("scans"),
        n_if(c("status") == "completed").alias("completed"),
        n_if(c("status") == "running").alias("running"),
        n_if(c("status").isin("pending", "review")).alias("pending_review"),
        F.to_date(F.max("created_at")).alias("last_scan"),
        F.max_by("job_id", F.struct("created_at", "job_id")).alias("last_job"),
    )


@R.add(
    "d20_assets_per_campaign",
    "SELECT campaign_id, count(*) AS assets, count(*) FILTER (len(platforms) = 0 OR list_contains(platforms, 'facebook')) AS facebook_eligible, min(name) AS first_name FROM assets GROUP BY 1",
)
def assets_per_campaign(t: Tables) -> DataFrame:
    """D20 with the array eligibility of B8."""
    ok = (F.coalesce(F.size("platforms"), F.lit(0)) == 0) | F.array_contains("platforms", "facebook")
    return t.assets.groupBy("campaign_id").agg(F.count("*").alias("assets"), n_if(ok).alias("facebook_eligible"), F.min("name").alias("first_name"))


@R.add(
    "d23_scan_summary",
    """SELECT scan_job_id, count(*) AS total, count(*) FILTER (status='violation') AS violations,
    CASE WHEN count(*) FILTER (status='compliant') = 0 AND count(*) FILTER (status='violation') = 0 THEN count(*) ELSE count(*) FILTER (status='compliant') END AS compliant,
    CASE WHEN count(*) FILTER (status IN ('compliant','violation')) = 0 THEN 100.0::DOUBLE ELSE round(count(*) FILTER (status='compliant') * 100.0 / count(*) FILTER (status IN ('compliant','violation')), 1) END AS rate
    FROM matches GROUP BY 1""",
)
def scan_summary(t: Tables) -> DataFrame:
    g = t.matches.groupBy("scan_job_id").agg(F.count("*").alias("total"), n_if(c("status") == "violation").alias("violations"), n_if(c("status") == "compliant").alias("ok"))
    none = (c("ok") == 0) & (c("violations") == 0)
    return g.select("scan_job_id", "total", "violations", F.when(none, c("total")).otherwise(c("ok")).alias("compliant"), rate(c("ok"), c("ok") + c("violations"), 100.0).alias("rate"))


@R.add(
    "d24_cost_by_vendor",
    """SELECT source AS vendor, CAST(round(sum(CAST(cost AS DECIMAL(18,2))), 4) AS DOUBLE) AS cost, count(*) AS items, count(*) FILTER (cost > 100000) AS large FROM jobs GROUP BY 1 ORDER BY cost DESC""",
)
def cost_by_vendor(t: Tables) -> DataFrame:
    """D24 and F10."""
    return t.jobs.groupBy(c("source").alias("vendor")).agg(F.sum(c("cost").cast("decimal(18,2)")).cast("double").alias("cost"), F.count("*").alias("items"), n_if(c("cost") > 100000).alias("large")).orderBy(F.desc("cost"))


_STATUS = """CASE WHEN scanned = 0 AND blocked > 0 THEN 'blocked' WHEN scanned = 0 AND failed > 0 THEN 'failed' WHEN scanned = 0 THEN 'empty' WHEN blocked > 0 OR failed > 0 THEN 'partial' ELSE 'ok' END"""


@R.add(
    "d27_rollup",
    f"""WITH page AS (SELECT user_id % 40 AS scan, user_id AS dealer, event_id, value, count(*) FILTER (event_type IN ('view','click')) AS scanned, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'purchase') AS blocked
      FROM events GROUP BY ALL),
    dealer AS (SELECT scan, dealer, CAST(sum(scanned) AS BIGINT) AS scanned, CAST(sum(failed) AS BIGINT) AS failed, CAST(sum(blocked) AS BIGINT) AS blocked, max(value) AS slowest, max_by(event_id, (value, event_id)) AS slowest_page FROM page GROUP BY 1, 2),
    s AS (SELECT *, {_STATUS} AS status FROM dealer)
    SELECT scan, CAST(sum(scanned) AS BIGINT) AS scanned, CAST(sum(failed) AS BIGINT) AS failed, CAST(sum(blocked) AS BIGINT) AS blocked, max_by(slowest_page, (slowest, slowest_page)) AS slowest_page,
      array_to_string(list_sort(list_distinct(list(status))), ',') AS statuses, count(*) AS dealers FROM s GROUP BY 1""",
)
def rollup(t: Tables) -> DataFrame:
    """Pages to dealers to scans, with the slowest page and dealer status."""
    kind = c("event_type")
    page = t.events.select((c("user_id") % 40).alias("scan"), c("user_id").alias("dealer"), "event_id", "value", kind.isin("view", "click").cast("long").alias("scanned"), (kind == "error").cast("long").alias("failed"), (kind == "purchase").cast("long").alias("blocked"))
    sums = [F.sum(x).alias(x) for x in ("scanned", "failed", "blocked")]
    dealer = page.groupBy("scan", "dealer").agg(*sums, F.max(F.struct("value", "event_id")).alias("slow"))
    status = F.when((c("scanned") == 0) & (c("blocked") > 0), "blocked").when((c("scanned") == 0) & (c("failed") > 0), "failed").when(c("scanned") == 0, "empty").when((c("blocked") > 0) | (c("failed") > 0), "partial").otherwise("ok")
    return dealer.withColumn("status", status).groupBy("scan").agg(*sums, F.max("slow")["event_id"].alias("slowest_page"), F.array_join(F.sort_array(F.collect_set("status")), ",").alias("statuses"), F.count("*").alias("dealers"))


@R.add(
    "d30_dominant_failure",
    """SELECT user_id, CASE WHEN b = 0 AND t = 0 AND cr = 0 THEN 'empty' WHEN b >= t AND b >= cr THEN 'blocked' WHEN t >= cr THEN 'timeout' ELSE 'crashed' END AS dominant
    FROM (SELECT user_id, count(*) FILTER (event_type='error') AS b, count(*) FILTER (event_type='click') AS t, count(*) FILTER (event_type='view') AS cr FROM events GROUP BY 1)""",
)
def dominant_failure(t: Tables) -> DataFrame:
    """The most frequent failure, ties in the order blocked, timeout, crashed."""
    g = t.events.groupBy("user_id").agg(*[n_if(c("event_type") == v).alias(a) for v, a in (("error", "b"), ("click", "t"), ("view", "cr"))])
    top = F.greatest("b", "t", "cr")
    return g.select("user_id", F.when(top == 0, "empty").when(c("b") == top, "blocked").when(c("t") == top, "timeout").otherwise("crashed").alias("dominant"))


@R.add(
    "d31_rules_by_type",
    "SELECT campaign_id, coalesce(array_to_string(list_sort(list(name) FILTER (size % 2 = 0)), '|'), '') AS required, coalesce(array_to_string(list_sort(list(name) FILTER (size % 2 = 1)), '|'), '') AS forbidden FROM assets GROUP BY 1",
)
def rules_by_type(t: Tables) -> DataFrame:
    pick = lambda odd: F.array_join(F.sort_array(F.collect_list(F.when(c("size") % 2 == odd, c("name")))), "|")
    return t.assets.groupBy("campaign_id").agg(pick(0).alias("required"), pick(1).alias("forbidden"))


@R.add(
    "d33_confusion",
    """WITH k AS (SELECT count(*) FILTER (quality=1 AND toxic=1) AS tp, count(*) FILTER (quality=0 AND toxic=1) AS fp, count(*) FILTER (quality=1 AND toxic=0) AS fn, count(*) FILTER (quality=0 AND toxic=0) AS tn,
      avg(doc_id) FILTER (quality=1) AS mean_pos, avg(doc_id) FILTER (quality=0) AS mean_neg FROM labels)
    SELECT tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall,
      round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(mean_pos, 4) AS mean_pos, round(mean_neg, 4) AS mean_neg FROM k""",
)
def confusion(t: Tables) -> DataFrame:
    """Confusion counts, precision, recall, F1 and means, 0 for empty denominators."""
    q, x = c("quality") == 1, c("toxic") == 1
    k = t.labels.agg(n_if(q & x).alias("tp"), n_if(~q & x).alias("fp"), n_if(q & ~x).alias("fn"), n_if(~q & ~x).alias("tn"), F.avg(F.when(q, c("doc_id"))).alias("mean_pos"), F.avg(F.when(~q, c("doc_id"))).alias("mean_neg"))
    div = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    tp, fp, fn = c("tp"), c("fp"), c("fn")
    return k.select("tp", "fp", "fn", "tn", div(tp, tp + fp).alias("precision"), div(tp, tp + fn).alias("recall"), div(2.0 * tp, 2 * tp + fp + fn).alias("f1"), F.round("mean_pos", 4).alias("mean_pos"), F.round("mean_neg", 4).alias("mean_neg"))


@R.add(
    "d34_latency_p95",
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, max(value) FILTER (i = CAST(round_even(0.95 * (n - 1), 0) AS BIGINT)) AS p95, round(avg(value), 6) AS mean FROM r GROUP BY 1""",
)
def latency_p95(t: Tables) -> DataFrame:
    """The value at index round-half-even(0.95 (n - 1)). Counts by powers of two and sixteenths of them say in which range it is; only that range's values are sorted."""
    v = c("value")
    step = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(F.abs(v), F.lit(1e-300)))) - 4)
    range_ = F.when(v == 0, F.lit(0.0)).otherwise(F.floor(v / step) * step).alias("range")
    ranges = t.events.groupBy("event_type", range_).agg(F.count("*").alias("k"))
    w = Window.partitionBy("event_type")
    upto = F.sum("k").over(w.orderBy("range"))
    at = F.bround(0.95 * (F.sum("k").over(w) - 1)).cast("long")
    one = ranges.select("event_type", "range", (upto - c("k")).alias("lo"), upto.alias("hi"), at.alias("at")).filter((c("lo") <= c("at")) & (c("at") < c("hi")))
    values = t.events.select("event_type", "value", range_).join(one, ["event_type", "range"]).groupBy("event_type", "value", "lo", "at").agg(F.count("*").alias("k"))
    end = c("lo") + F.sum("k").over(w.orderBy("value"))
    p = values.select("event_type", "value", "at", end.alias("end"), (end - c("k")).alias("begin")).filter((c("begin") <= c("at")) & (c("at") < c("end"))).select("event_type", c("value").alias("p95"))
    return t.events.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean")).join(p, "event_type")


@R.add(
    "d35_quota",
    """SELECT org_id, count(*) AS total, count(*) FILTER (date_trunc('month', created_at) = DATE '1998-10-01') AS this_month,
    count(*) FILTER (status = 'running' OR (status = 'pending' AND created_at >= TIMESTAMP '1998-10-01')) AS concurrent FROM jobs GROUP BY 1""",
)
def quota(t: Tables) -> DataFrame:
    """Scans of a month, of all time, and concurrent ones."""
    month = F.date_trunc("month", c("created_at")) == F.lit("1998-10-01").cast("timestamp")
    live = (c("status") == "running") | ((c("status") == "pending") & (c("created_at") >= F.lit("1998-10-01").cast("timestamp_ntz")))
    return t.jobs.groupBy("org_id").agg(F.count("*").alias("total"), n_if(month).alias("this_month"), n_if(live).alias("concurrent"))


@R.add("d37_retention", "SELECT org_id, count(*) AS purged, count(*) FILTER (status = 'completed') AS purged_completed FROM jobs WHERE created_at < TIMESTAMP '1997-01-01' - to_days(CAST(30 * (org_id + 1) AS INTEGER)) GROUP BY 1")
def retention(t: Tables) -> DataFrame:
    """Jobs past each organisation's own retention time."""
    limit = F.date_sub(F.lit("1997-01-01").cast("date"), 30 * (c("org_id") + 1)).cast("timestamp_ntz")
    return t.jobs.filter(c("created_at") < limit).groupBy("org_id").agg(F.count("*").alias("purged"), n_if(c("status") == "completed").alias("purged_completed"))


@R.add(
    "d41_diagnosis",
    """SELECT org_id, count(*) AS jobs, concat_ws('; ', CASE WHEN count(*) FILTER (status='pending') > 500 THEN 'many pending' END, CASE WHEN count(*) FILTER (status='running') > 1000 THEN 'many running' END,
    CASE WHEN avg(cost) > 225000 THEN 'costly' END) AS issues FROM jobs GROUP BY 1""",
)
def diagnosis(t: Tables) -> DataFrame:
    """Counts and the messages of the conditions that hold."""
    g = t.jobs.groupBy("org_id").agg(F.count("*").alias("jobs"), n_if(c("status") == "pending").alias("p"), n_if(c("status") == "running").alias("r"), F.avg("cost").alias("a"))
    return g.select("org_id", "jobs", F.concat_ws("; ", F.when(c("p") > 500, "many pending"), F.when(c("r") > 1000, "many running"), F.when(c("a") > 225000, "costly")).alias("issues"))
