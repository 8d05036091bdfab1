"""Filters, predicates, projections and scalar functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules, scores, text
from .base import Registry, Tables

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
c = F.col


@R.add("b1_optional_filters", "SELECT match_id, channel, score FROM matches WHERE channel IN ('1-URGENT','2-HIGH') AND score BETWEEN 60 AND 80 AND distributor_id IS NOT NULL AND last_seen IS NULL AND created_at < TIMESTAMP '1998-01-01'")
def optional_filters(t: Tables) -> DataFrame:
    """Filters that are added as given, all pushed to the scans."""
    out = t.matches
    for cond in (c("channel").isin("1-URGENT", "2-HIGH"), c("score").between(60, 80), c("distributor_id").isNotNull(), c("last_seen").isNull(), c("created_at") < F.lit("1998-01-01").cast("timestamp_ntz")):
        out = out.filter(cond)
    return out.select("match_id", "channel", "score")


@R.add("b5_json_predicates", "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events WHERE props->>'$.k' IS NOT NULL AND coalesce(props->>'$.capture', '') <> 'blocked' AND (lower(event_type) = lower('ERROR') OR CAST(props->>'$.k' AS BIGINT) > 95)")
def json_predicates(t: Tables) -> DataFrame:
    """JSON paths, case-insensitive equality, disjunctions."""
    k = F.get_json_object("props", "$.k")
    ok = k.isNotNull() & (F.coalesce(F.get_json_object("props", "$.capture"), F.lit("")) != "blocked")
    return t.events.filter(ok & ((F.lower("event_type") == F.lower(F.lit("ERROR"))) | (k.cast("long") > 95))).select("event_id", k.cast("long").alias("k"))


@R.add("b8_eligible_assets", "SELECT asset_id, len(platforms)::INTEGER AS n FROM assets WHERE len(platforms) = 0 OR list_contains(platforms, 'facebook')")
def eligible_assets(t: Tables) -> DataFrame:
    return t.assets.filter((F.coalesce(F.size("platforms"), F.lit(0)) == 0) | F.array_contains("platforms", "facebook")).select("asset_id", F.size("platforms").alias("n"))


@R.add("b10_search", "SELECT distributor_id, name, region FROM dealers WHERE contains(lower(name), '07') OR contains(lower(region), 'an')")
def search(t: Tables) -> DataFrame:
    return t.dealers.filter(F.contains(F.lower("name"), F.lit("07")) | F.contains(F.lower("region"), F.lit("an"))).select("distributor_id", "name", "region")


@R.add(
    "b12_validation",
    """SELECT c_custkey, concat_ws(';', CASE WHEN c_acctbal < 0 THEN 'negative balance' END, CASE WHEN length(c_name) > 100 THEN 'name too long' END, CASE WHEN NOT regexp_matches(c_name, '^Customer#[0-9]+$') THEN 'bad name' END,
    CASE WHEN c_mktsegment NOT IN ('BUILDING','AUTOMOBILE','MACHINERY') THEN 'bad segment' END) AS errors FROM customer""",
)
def validation(t: Tables) -> DataFrame:
    """Every broken rule of a row."""
    rules = {"negative balance": c("c_acctbal") < 0, "name too long": F.length("c_name") > 100, "bad name": ~c("c_name").rlike("^Customer#[0-9]+$"), "bad segment": ~c("c_mktsegment").isin("BUILDING", "AUTOMOBILE", "MACHINERY")}
    return t.customer.select("c_custkey", F.concat_ws(";", *[F.when(v, k) for k, v in rules.items()]).alias("errors"))


@R.add(
    "b15_fallbacks",
    """WITH m AS (SELECT *, CASE match_id % 3 WHEN 0 THEN 'data:image/png;base64,AAAA' WHEN 1 THEN 'https://data:' || match_id END AS shot FROM matches)
    SELECT match_id, coalesce(last_seen, CAST(created_at AS DATE)) AS seen, coalesce(nullif(CASE WHEN score < 20 THEN '' ELSE channel END, ''), nullif(status, ''), 'none') AS named,
    CASE WHEN NOT starts_with(shot, 'data:') THEN shot END AS shown, substr(channel, 1, 4) || CASE WHEN length(channel) > 4 THEN '...' ELSE '' END AS short FROM m""",
)
def fallbacks(t: Tables) -> DataFrame:
    """B13 to B16 and B19."""
    shot = F.when(c("match_id") % 3 == 0, "data:image/png;base64,AAAA").when(c("match_id") % 3 == 1, F.concat(F.lit("https://data:"), c("match_id").cast("string")))
    named = text.first_filled(F.when(c("score") < 20, "").otherwise(c("channel")), c("status"), F.lit("none"))
    return t.matches.select("match_id", F.coalesce("last_seen", F.to_date("created_at")).alias("seen"), named.alias("named"), rules.shown_url(shot).alias("shown"), text.truncated(c("channel"), 4, "...").alias("short"))


_LOOKS = "[NULL, 'exact', 'resized', 'cropped', 'modified', 'unknown']"


@R.add(
    "b17_bands",
    f"""WITH l AS (SELECT *, {_LOOKS}[match_id % 6 + 1] AS look FROM matches)
    SELECT match_id, CASE WHEN score >= 90 THEN 'exact' WHEN score >= 75 THEN 'strong' WHEN score >= 65 THEN 'partial' WHEN score >= 50 THEN 'weak' ELSE 'none' END AS band,
    CASE WHEN look = 'exact' AND score >= 90 THEN 'exact' WHEN look IN ('exact', 'resized') AND score >= 75 THEN 'strong' WHEN look IN ('exact', 'resized', 'cropped', 'modified') AND score >= 65 THEN 'partial' WHEN score >= 50 THEN 'weak' ELSE 'none' END AS band2,
    CASE WHEN score >= 80 THEN 'green' WHEN score >= 60 THEN 'amber' ELSE 'red' END AS colour, NOT coalesce(CASE status WHEN 'violation' THEN false WHEN 'compliant' THEN true END = false, false) AS passes
    FROM l""",
)
def bands(t: Tables) -> DataFrame:
    """B17, B18, B23 (only an explicit false vetoes), B25 and the colours of A26."""
    look = F.element_at(F.array(*[F.lit(x) for x in (None, "exact", "resized", "cropped", "modified", "unknown")]), (c("match_id") % 6 + 1).cast("int"))
    visible = F.when(c("status") == "violation", False).when(c("status") == "compliant", True)
    return t.matches.select("match_id", scores.match_band(c("score")).alias("band"), scores.appearance_band(look, c("score")).alias("band2"), F.when(c("score") >= 80, "green").when(c("score") >= 60, "amber").otherwise("red").alias("colour"), (~visible.eqNullSafe(F.lit(False))).alias("passes"))


@R.add(
    "b21_url_predicates",
    f"""WITH u AS (SELECT page_id, url AS u FROM pages UNION ALL SELECT page_id, unnest(list_distinct(list_filter(regexp_extract_all(html, 'href="(/[^"/?#][^"?#]*)"', 1), lambda x: regexp_matches(x, '^[A-Za-z0-9/._-]+$')))) FROM pages
      UNION ALL SELECT page_id, 'https://a.example' || {list(text.BLOCKED_PATHS)}[page_id % {len(text.BLOCKED_PATHS)} + 1] || 'x' || page_id % 3 || {[*text.BLOCKED_EXTENSIONS, "", ".html"]}[page_id % {len(text.BLOCKED_EXTENSIONS) + 2} + 1] FROM pages),
    p AS (SELECT page_id, u, lower(CASE WHEN starts_with(u, '/') THEN u ELSE regexp_extract(u, '^[a-z]+://[^/?#]*([^?#]*)', 1) END) AS path FROM u)
    SELECT page_id, u AS url, len(list_intersect(regexp_split_to_array(path, '[/\\-_.]'), {list(text.PROMO_WORDS)})) > 0 AS promo,
    len(list_filter({list(text.BLOCKED_EXTENSIONS)}, lambda x: ends_with(path, x))) = 0 AND len(list_filter({list(text.BLOCKED_PATHS)}, lambda x: contains(path, x))) = 0 AS scannable FROM p""",
)
def url_predicates(t: Tables) -> DataFrame:
    """B21 and B22 over the pages' URLs, the paths they link to, and a URL for each blocked part and extension."""
    at = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (c("page_id") % len(xs) + 1).cast("int"))
    links = F.filter(F.array_distinct(F.regexp_extract_all("html", F.lit('href="(/[^"/?#][^"?#]*)"'), 1)), lambda x: x.rlike("^[A-Za-z0-9/._-]+$"))
    made = F.concat(F.lit("https://a.example"), at(text.BLOCKED_PATHS), F.lit("x"), (c("page_id") % 3).cast("string"), at([*text.BLOCKED_EXTENSIONS, "", ".html"]))
    u = t.pages.select("page_id", F.explode(F.concat(F.array("url", made), links)).alias("url"))
    return u.select("page_id", "url", text.is_promo(c("url")).alias("promo"), text.is_scannable(c("url")).alias("scannable"))


@R.add(
    "b24_ownership",
    """SELECT m.match_id FROM matches m LEFT JOIN dealers d USING (distributor_id) LEFT JOIN assets a USING (asset_id)
    WHERE (d.org_id = 2 OR a.org_id = 2 OR (m.distributor_id IS NULL AND a.asset_id IS NULL))""",
)
def ownership(t: Tables) -> DataFrame:
    m = t.matches.join(t.dealers.select("distributor_id", c("org_id").alias("d_org")), "distributor_id", "left").join(t.assets.select("asset_id", c("org_id").alias("a_org")), "asset_id", "left")
    return m.filter((c("d_org") == 2) | (c("a_org") == 2) | (c("distributor_id").isNull() & c("a_org").isNull())).select("match_id")


@R.add(
    "b27_labels",
    """SELECT event_type || '_kind' AS raw, array_to_string(list_transform(string_split(replace(event_type || '_kind', '_', ' '), ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS label,
    count(*) || ' event' || CASE WHEN count(*) <> 1 THEN 's' ELSE '' END AS counted FROM events GROUP BY event_type""",
)
def labels(t: Tables) -> DataFrame:
    g = t.events.groupBy("event_type").agg(F.count("*").alias("n"))
    raw = F.concat("event_type", F.lit("_kind"))
    return g.select(raw.alias("raw"), text.label(raw).alias("label"), F.concat(c("n").cast("string"), F.lit(" event"), F.when(c("n") != 1, "s").otherwise("")).alias("counted"))


@R.add(
    "b28_ordered_patterns",
    """SELECT page_id, coalesce(nullif(regexp_extract(url, '^https?://[^/]+/([a-z]{2})/', 1), ''), nullif(regexp_extract(url, '/([0-9]+)', 1), ''), 'none') AS first_hit,
    CASE WHEN starts_with(substr(url, 9), 'http') THEN substr(url, 9) ELSE 'https://' || substr(url, 9) END AS completed FROM pages""",
)
def ordered_patterns(t: Tables) -> DataFrame:
    """B28 and B30."""
    return t.pages.select(
        "page_id",
        F.coalesce(F.nullif(F.regexp_extract("url", "^https?://[^/]+/([a-z]{2})/", 1), F.lit("")), F.nullif(F.regexp_extract("url", "/([0-9]+)", 1), F.lit("")), F.lit("none")).alias("first_hit"),
        text.complete_scheme(F.substring("url", 9, 10_000)).alias("completed"),
    )


@R.add(
    "b29_identity",
    """WITH x AS (SELECT page_id, nullif(regexp_extract(html, 'rel="canonical" href="[^"]*/([a-z]+)"', 1), '') AS canon, lower(coalesce(list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '')[1], '')) AS slug FROM pages)
    SELECT page_id, slug, CASE WHEN canon IS NOT NULL THEN canon = 'en' ELSE slug = 'en' END AS same FROM x""",
)
def identity(t: Tables) -> DataFrame:
    """The canonical slug decides, the final URL's if there is none."""
    canon = F.nullif(F.regexp_extract("html", 'rel="canonical" href="[^"]*/([a-z]+)"', 1), F.lit(""))
    slug = text.page_slug(c("url"))
    return t.pages.select("page_id", slug.alias("slug"), F.when(canon.isNotNull(), canon == "en").otherwise(slug == "en").alias("same"))


@R.add(
    "b31_boxes",
    """WITH b AS (SELECT match_id, CAST(score AS INTEGER) * 7 AS x, CAST(match_id % 900 AS INTEGER) AS y, CAST(score AS INTEGER) * 3 AS w, CAST(match_id % 97 AS INTEGER) AS h FROM matches)
    SELECT match_id, least(w, 600 - x) AS w, least(h, 950 - y) AS h, CASE WHEN y < 0.15 * 950 THEN 'header' WHEN y < 0.5 * 950 THEN 'above' WHEN y < 0.8 * 950 THEN 'middle' ELSE 'footer' END AS place,
    round(greatest(0, least(x + w, 400) - greatest(x, 100)) * greatest(0, least(y + h, 500) - greatest(y, 50)) * 1.0 / least(w * h, 300 * 450), 6) > 0.5 AS overlaps
    FROM b WHERE w >= 50 AND h >= 30 AND least(w, 600 - x) > 0 AND least(h, 950 - y) > 0 AND least(w, 600 - x) * least(h, 950 - y) // 3 >= 2000""",
)
def boxes(t: Tables) -> DataFrame:
    """Clipped boxes, their place on the page, overlap over half the smaller box."""
    b = t.matches.select("match_id", (c("score").cast("int") * 7).alias("x"), (c("match_id") % 900).cast("int").alias("y"), (c("score").cast("int") * 3).alias("bw"), (c("match_id") % 97).cast("int").alias("bh"))
    w, h = F.least("bw", 600 - c("x")), F.least("bh", 950 - c("y"))
    both = F.greatest(F.lit(0), F.least(c("x") + c("bw"), F.lit(400)) - F.greatest("x", F.lit(100))) * F.greatest(F.lit(0), F.least(c("y") + c("bh"), F.lit(500)) - F.greatest("y", F.lit(50)))
    place = F.when(c("y") < 0.15 * 950, "header").when(c("y") < 0.5 * 950, "above").when(c("y") < 0.8 * 950, "middle").otherwise("footer")
    smaller = F.least(c("bw") * c("bh"), F.lit(300 * 450))
    size = F.floor(w * h / 3)  # bytes of a crop of so many pixels
    return b.filter((c("bw") >= rules.CROP_WIDTH) & (c("bh") >= rules.CROP_HEIGHT) & (w > 0) & (h > 0) & (size >= rules.CROP_BYTES)).select("match_id", w.alias("w"), h.alias("h"), place.alias("place"), (F.round(both / smaller, 6) > 0.5).alias("overlaps"))


@R.add(
    "h1_url_parts",
    """WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS path FROM pages)
    SELECT page_id, host, regexp_extract(url, '^([a-z]+)://', 1) || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END AS normal, regexp_replace(host, '^www\\.', '') AS domain,
    nullif(regexp_replace(lower(trim(url)), '/+$', ''), '') AS coverage_key, regexp_replace(lower(url), '[^a-z0-9]+', '', 'g') AS alnum, substr(md5(url), 1, 12) AS digest FROM p""",
)
def url_parts(t: Tables) -> DataFrame:
    """H1 to H4, H7, H8 and H46."""
    h = text.hostname(c("url"))
    return t.pages.select("page_id", h.alias("host"), text.normal_url(c("url")).alias("normal"), text.base_domain(h).alias("domain"), text.coverage_key(c("url")).alias("coverage_key"), text.alnum(c("url")).alias("alnum"), F.substring(F.md5("url"), 1, 12).alias("digest"))


@R.add(
    "h9_titles",
    """WITH x AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t FROM pages), y AS (SELECT page_id, t || ' | ' || substr(t, 1, 5) AS t FROM x)
    SELECT page_id, CASE WHEN trim(regexp_replace(t, '\\s*[|]\\s*[^|]+$', '')) = '' THEN t ELSE regexp_replace(t, '\\s*[|]\\s*[^|]+$', '') END AS base, replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS plain FROM y""",
)
def titles(t: Tables) -> DataFrame:
    """H9 and H10."""
    x = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    x = F.concat(x, F.lit(" | "), F.substring(x, 1, 5))
    return t.pages.select("page_id", text.without_suffix(x).alias("base"), text.unescaped(x).alias("plain"))


@R.add(
    "h11_times",
    """SELECT event_id, strftime(make_timestamp(CAST(event_id % 1000 * 1000000 AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%S') AS iso,
    date_trunc('month', ts)::DATE AS month, CAST(ts AS DATE) AS day, date_diff('day', CAST(ts AS DATE), DATE '2024-02-01') AS days_left FROM events""",
)
def times(t: Tables) -> DataFrame:
    """Unix times in seconds or milliseconds, month, day and days left."""
    seconds = c("event_id") % 1000 * 1000000
    value = F.when(seconds * 1000 > 1e10, seconds * 1000).otherwise(seconds).cast("string")
    day = F.to_date("ts")
    return t.events.select("event_id", text.epoch_time(value).alias("iso"), F.trunc(day, "month").alias("month"), day.alias("day"), F.datediff(F.lit("2024-02-01").cast("date"), day).cast("long").alias("days_left"))


@R.add(
    "h12_next_run",
    """WITH x AS (SELECT job_id, CAST(created_at AS DATE) AS d, CAST(job_id % 7 AS INTEGER) AS wd, job_id % 2 = 1 AS passed, ['daily','weekly','biweekly','monthly'][CAST(job_id % 4 AS INTEGER) + 1] AS f FROM jobs),
    y AS (SELECT *, CASE WHEN (wd - (isodow(d) - 1) + 7) % 7 = 0 AND passed THEN 7 ELSE (wd - (isodow(d) - 1) + 7) % 7 END AS ahead FROM x)
    SELECT job_id, CAST(CASE f WHEN 'daily' THEN d + CAST(passed AS INTEGER) WHEN 'weekly' THEN d + CAST(ahead AS INTEGER) WHEN 'biweekly' THEN d + CAST(ahead + CASE WHEN ahead < 7 THEN 7 ELSE 0 END AS INTEGER)
      ELSE CAST(date_trunc('month', d) + INTERVAL 1 MONTH AS DATE) END AS DATE) AS next_run FROM y""",
)
def next_run(t: Tables) -> DataFrame:
    f = F.element_at(F.array(*[F.lit(x) for x in ("daily", "weekly", "biweekly", "monthly")]), (c("job_id") % 4).cast("int") + 1)
    return t.jobs.select("job_id", text.next_run(F.to_date("created_at"), f, (c("job_id") % 7).cast("int"), c("job_id") % 2 == 1).alias("next_run"))


@R.add(
    "h16_embedded_json",
    """WITH x AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'Result:' || chr(10) || '```json' || chr(10) || props || chr(10) || '```' WHEN 1 THEN 'Answer ' || props || ' end' ELSE props END AS t FROM events)
    SELECT event_id, CAST(regexp_extract(t, '"k": ([0-9]+)', 1) AS BIGINT) AS k FROM x""",
)
def embedded_json(t: Tables) -> DataFrame:
    m = c("event_id") % 3
    x = F.when(m == 0, F.concat(F.lit("Result:\n```json\n"), "props", F.lit("\n```"))).when(m == 1, F.concat(F.lit("Answer "), "props", F.lit(" end"))).otherwise(c("props"))
    return t.events.select("event_id", F.get_json_object(text.embedded_json(x), "$.k").cast("long").alias("k"))


@R.add(
    "h17_safe_math",
    """SELECT user_id, coalesce(round(sum(value) / nullif(count(*) FILTER (event_type = 'purchase'), 0), 6), -1) AS per_purchase, round(stddev_pop(value), 6) AS sd, greatest(10, least(90, CAST(trunc(avg(value)) AS INTEGER))) AS clamped,
    round((sum(value) FILTER (ts >= TIMESTAMP '2024-01-15') - sum(value) FILTER (ts < TIMESTAMP '2024-01-15')) / nullif(sum(value) FILTER (ts < TIMESTAMP '2024-01-15'), 0) * 100, 4) AS delta FROM events GROUP BY 1""",
)
def safe_math(t: Tables) -> DataFrame:
    """H17 to H20; sums are exact, since a mean just below a whole number would be cut to the one before."""
    late = c("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")
    total, a, b = (scores.exact_sum(x) for x in (c("value"), F.when(late, c("value")), F.when(~late, c("value"))))
    return t.events.groupBy("user_id").agg(
        F.coalesce(F.round(F.try_divide(total, F.count_if(c("event_type") == "purchase")), 6), F.lit(-1.0)).alias("per_purchase"),
        F.round(F.stddev_pop("value"), 6).alias("sd"),
        scores.clamp(F.try_divide(total, F.count("value")).cast("int"), 10, 90).cast("int").alias("clamped"),
        F.round(F.try_divide(a - b, b) * 100, 4).alias("delta"),
    )


@R.add(
    "h22_hash_scores",
    """WITH h AS (SELECT part.p_partkey AS id, CAST(hash_a AS BIGINT) AS a FROM part, LATERAL (SELECT (p_partkey * 2654435761) % 4294967296 AS hash_a)),
    d AS (SELECT id, (bit_count(xor(a, 305419896::BIGINT)) + bit_count(xor(a, 2271560481::BIGINT)) + bit_count(xor(a, 19088743::BIGINT)) + bit_count(xor(a, 4275878552::BIGINT))) / 4.0 AS d FROM h)
    SELECT id, CAST(d AS DOUBLE) AS distance, round_even(greatest(0.0, 100 - CAST(d AS DOUBLE) * 100 / 64), 0) AS score, CASE WHEN d < 5 THEN 'exact' WHEN d < 15 THEN 'similar' WHEN d < 25 THEN 'related' ELSE 'different' END AS class FROM d""",
)
def hash_scores(t: Tables) -> DataFrame:
    """Mean Hamming distance of four hashes, its score and class."""
    a = (c("p_partkey") * 2654435761) % 4294967296
    d = sum((F.bit_count(a.bitwiseXOR(F.lit(k).cast("long"))) for k in (305419896, 2271560481, 19088743, 4275878552)), F.lit(0)) / 4
    x = t.part.select(c("p_partkey").alias("id"), d.cast("double").alias("distance"))
    return x.select("id", "distance", scores.hamming_score(c("distance")).alias("score"), scores.hash_class(c("distance")).alias("class"))


_ENSEMBLE = """CASE WHEN v >= 75 AND h <= 55 THEN least(CASE WHEN e THEN greatest(CASE WHEN v > 60 AND h > 60 THEN least(100.0, f + 5) ELSE f END, 85.0) ELSE CASE WHEN v > 60 AND h > 60 THEN least(100.0, f + 5) ELSE f END END, h + 10.0)
  ELSE CASE WHEN e THEN greatest(CASE WHEN v > 60 AND h > 60 THEN least(100.0, f + 5) ELSE f END, 85.0) ELSE CASE WHEN v > 60 AND h > 60 THEN least(100.0, f + 5) ELSE f END END END"""


@R.add(
    "h32_ensemble",
    f"""WITH x AS (SELECT match_id, score AS v, CAST(match_id % 101 AS DOUBLE) AS h, match_id % 101 > 96 AS e FROM matches), y AS (SELECT *, v * (0.5::DOUBLE/0.65::DOUBLE) + h * (0.15::DOUBLE/0.65::DOUBLE) AS f FROM x), z AS (SELECT *, {_ENSEMBLE} AS s FROM y)
    SELECT match_id, CAST(round_even(s, 0) AS INTEGER) AS score, s >= 60 AS matched, greatest(0, least(100, CAST(trunc(s * 0.95::DOUBLE) AS INTEGER))) AS calibrated,
    [0,0,25,50,65,80][CAST(match_id % 6 AS INTEGER) + 1] AS gate FROM z""",
)
def ensemble(t: Tables) -> DataFrame:
    """Ensemble with bonus and veto, calibrated score, gate curve."""
    x = t.matches.select("match_id", c("score").alias("v"), (c("match_id") % 101).cast("double").alias("h"), (c("match_id") % 101 > 96).alias("e"))
    s = scores.ensemble(c("v"), c("h"), c("e"))
    return x.select("match_id", F.bround(s).cast("int").alias("score"), (s >= scores.REGULAR).alias("matched"), scores.calibrated(s, F.lit(0.95)).alias("calibrated"), scores.gate_score(c("match_id") % 6).alias("gate"))


@R.add(
    "h35_ladders",
    """SELECT event_id, CASE event_type WHEN 'view' THEN 'click' WHEN 'click' THEN 'purchase' WHEN 'purchase' THEN 'error' WHEN 'error' THEN 'error' ELSE 'view' END AS next_step,
    CASE WHEN CAST(props->>'$.k' AS INTEGER) >= 90 THEN 'blocked' WHEN CAST(props->>'$.k' AS INTEGER) >= 60 THEN 'slow' ELSE 'plain' END AS strategy,
    CASE WHEN event_type = 'error' AND value > 20 THEN 'timeout' WHEN event_type = 'error' THEN 'network' ELSE 'none' END AS failure FROM events""",
)
def ladders(t: Tables) -> DataFrame:
    """Rungs, classes and steps by value of an event; the rules themselves are in plans/rules.py."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = c("event_type")
    step = F.when(kind == "view", "click").when(kind == "click", "purchase").when(kind.isin("purchase", "error"), "error").otherwise("view")
    return t.events.select("event_id", step.alias("next_step"), F.when(k >= 90, "blocked").when(k >= 60, "slow").otherwise("plain").alias("strategy"), F.when((kind == "error") & (c("value") > 20), "timeout").when(kind == "error", "network").otherwise("none").alias("failure"))


@R.add(
    "h37_token_cost",
    """SELECT o_orderkey, CAST(round(CAST(((CAST(o_orderkey % 5000 AS DECIMAL(9,0)) + 1.25 * CAST(o_custkey % 900 AS DECIMAL(9,0)) + 0.10 * CAST(o_orderkey % 700 AS DECIMAL(9,0))) * CASE WHEN starts_with(o_orderpriority, '1') THEN 3.0 ELSE 5.0 END
    + CAST(o_custkey % 300 AS DECIMAL(9,0)) * CASE WHEN starts_with(o_orderpriority, '1') THEN 15.0 ELSE 25.0 END) AS DECIMAL(18,4)) * 0.000001, 6) AS DOUBLE) AS usd FROM orders""",
)
def token_cost(t: Tables) -> DataFrame:
    """H37 with the prefix prices of C28: the first price whose name begins the model's, else the default."""
    one = c("o_orderpriority").startswith("1")
    k, u = c("o_orderkey"), c("o_custkey")
    return t.orders.select("o_orderkey", scores.token_cost(k % 5000, u % 900, k % 700, u % 300, F.when(one, 3.0).otherwise(5.0), F.when(one, 15.0).otherwise(25.0)).alias("usd"))


@R.add(
    "h38_text_codes",
    """SELECT s_suppkey, CAST(list_sum(list_transform(string_split(s_name, ''), lambda x: ascii(x))) AS INTEGER) AS code, replace(replace(s_name, '#', '%23'), ' ', '%20') AS encoded,
    coalesce(nullif(regexp_extract(s_name, '([0-9]+)$', 1), ''), '0')::BIGINT AS number FROM supplier""",
)
def text_codes(t: Tables) -> DataFrame:
    """Character sums, URL encoding with %20; and a number out of a name."""
    return t.supplier.select("s_suppkey", text.char_sum(c("s_name")).alias("code"), F.replace(F.url_encode("s_name"), F.lit("+"), F.lit("%20")).alias("encoded"), F.coalesce(F.nullif(F.regexp_extract("s_name", "([0-9]+)$", 1), F.lit("")), F.lit("0")).cast("long").alias("number"))


@R.add(
    "h40_media",
    """WITH x AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN [] ELSE ['http://a/' || event_id, 'ftp://b'] END AS images, ['https://v/' || event_id] AS videos, event_id % 3 AS cards FROM events)
    SELECT event_id, array_to_string(CASE WHEN len(list_filter(images, lambda u: starts_with(u, 'http'))) = 0 THEN videos ELSE list_filter(images, lambda u: starts_with(u, 'http')) END, ' ') AS media,
    CASE WHEN cards > 1 THEN 'carousel' WHEN len(images) = 0 THEN 'video' ELSE 'image' END AS format FROM x""",
)
def media(t: Tables) -> DataFrame:
    """Http media, videos where there is no image, format of a creative."""
    images = F.when(c("event_id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("http://a/"), c("event_id").cast("string")), F.lit("ftp://b")))
    web = F.filter(images, lambda u: u.startswith("http"))
    videos = F.array(F.concat(F.lit("https://v/"), c("event_id").cast("string")))
    return t.events.select("event_id", F.array_join(F.when(F.size(web) == 0, videos).otherwise(web), " ").alias("media"), F.when(c("event_id") % 3 > 1, "carousel").when(F.size(images) == 0, "video").otherwise("image").alias("format"))


@R.add(
    "h47_trails",
    """SELECT user_id, CASE WHEN count(*) > 1 AND count(*) FILTER (event_type='purchase') = 0 THEN string_agg(event_type || '=' || CAST(event_id AS VARCHAR), ' -> ' ORDER BY event_id) END AS trail FROM events GROUP BY 1""",
)
def trails(t: Tables) -> DataFrame:
    steps = F.sort_array(F.collect_list(F.struct("event_id", "event_type")))
    g = t.events.groupBy("user_id").agg(steps.alias("s"), F.count_if(c("event_type") == "purchase").alias("p"))
    joined = F.array_join(F.transform("s", lambda x: F.concat(x["event_type"], F.lit("="), x["event_id"].cast("string"))), " -> ")
    return g.select("user_id", F.when((F.size("s") > 1) & (c("p") == 0), joined).alias("trail"))
