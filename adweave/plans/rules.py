"""Rules of the domain, each over rows that show every case of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..streaming.limits import LADDER
from .base import Registry, Tables

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
c = F.col

_MESSAGES = [
    "", "net::ERR_ABORTED at https://a", "net::ERR_CERT_DATE_INVALID", "Target closed while ERR_ABORTED", "page.goto: TargetClosedError", "ERR_TOO_MANY_REDIRECTS then ERR_BLOCKED_BY_CLIENT", "odd failure | second line",
    "BrowserType.launch: | Executable doesn't exist at /x", "please run PLAYWRIGHT   install", "x" * 250,
]


def _at(xs: list, by: str):
    return F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col(by) % len(xs) + 1).cast("int"))


def _list(xs) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


@R.add(
    "h31_failures",
    f"""WITH m AS (SELECT event_id, event_type = 'view' AS timed_out, replace({_list(_MESSAGES)}[event_id % {len(_MESSAGES)} + 1], ' | ', chr(10)) AS message FROM events),
    s AS (SELECT *, len(list_filter({_list(rules.CLOSED_MARKERS)}, lambda x: contains(message, x))) > 0 AS closed, list_filter({_list(rules.BLOCK_SIGNATURES)}, lambda x: contains(message, x))[1] AS signature, lower(regexp_replace(message, '\\s+', ' ', 'g')) AS flat FROM m)
    SELECT event_id, CASE WHEN timed_out THEN 'timeout' WHEN closed THEN 'crashed' WHEN signature IS NOT NULL THEN 'blocked' ELSE 'crashed' END AS outcome,
    coalesce(CASE WHEN timed_out THEN '' WHEN closed THEN 'browser_closed' WHEN signature IS NOT NULL THEN signature WHEN message = '' THEN 'unknown' ELSE substr(split_part(message, chr(10), 1), 1, 200) END, '') AS reason,
    len(list_filter({_list(rules.NO_BROWSER_MARKERS)}, lambda x: contains(flat, x))) > 0 AS no_browser FROM s""",
)
def failures(t: Tables) -> DataFrame:
    """Outcome and reason of a failed page from the signatures in its message; whether the browser is missing."""
    message = F.replace(_at(_MESSAGES, "event_id"), F.lit(" | "), F.lit("\n"))
    outcome, reason = rules.failure(c("event_type") == "view", message)
    return t.events.select("event_id", outcome.alias("outcome"), F.coalesce(reason, F.lit("")).alias("reason"), rules.browser_missing(message).alias("no_browser"))


_STATUS = [200, 204, 301, 399, 400, 401, 403, 404, 429, 451, 500, 503, 599, 600, 100]


@R.add(
    "h36_preflight",
    f"""WITH s AS (SELECT page_id, {_STATUS}[page_id % {len(_STATUS)} + 1] AS status, {_list((*LADDER, "other"))}[page_id % {len(LADDER) + 1} + 1] AS now FROM pages),
    p AS (SELECT *, CASE WHEN status IN (401, 403, 451) THEN 'screenshotone_only' WHEN status = 429 THEN 'playwright_then_screenshotone' WHEN status BETWEEN 200 AND 399 OR status BETWEEN 500 AND 599 THEN 'playwright_desktop' ELSE 'playwright_then_screenshotone' END AS suggested FROM s)
    SELECT page_id, status, suggested, {_list((*LADDER[1:], LADDER[-1], LADDER[0]))}[page_id % {len(LADDER) + 1} + 1] AS next FROM p""",
)
def preflight(t: Tables) -> DataFrame:
    """The strategy that a probe's status suggests; the rung above the present one."""
    return t.pages.select("page_id", _at(_STATUS, "page_id").alias("status"), rules.preflight_strategy(_at(_STATUS, "page_id")).alias("suggested"), rules.next_strategy(_at([*LADDER, "other"], "page_id")).alias("next"))


_CHANNELS = ["website", "google_ads", "facebook", "instagram", "youtube"]


@R.add(
    "h39_source_types",
    f"""WITH a AS (SELECT match_id, price, {_list(_CHANNELS)}[match_id % 5 + 1] AS channel, CASE match_id % 4 WHEN 0 THEN '{{"comparison": {{"asset_found": true}}}}' WHEN 1 THEN '{{"comparison": {{"asset_found": false}}}}' WHEN 2 THEN '{{}}' END AS analysis FROM matches)
    SELECT match_id, price, CASE WHEN coalesce(CAST(analysis->>'$.comparison.asset_found' AS BOOLEAN), false) THEN 'page_screenshot' WHEN channel = 'website' THEN 'website_banner' WHEN channel IN ('google_ads', 'facebook', 'instagram') THEN 'ad' ELSE 'unknown' END AS source_type FROM a""",
)
def source_types(t: Tables) -> DataFrame:
    """What a match was found in, from its analysis and its channel."""
    analysis = F.when(c("match_id") % 4 == 0, '{"comparison": {"asset_found": true}}').when(c("match_id") % 4 == 1, '{"comparison": {"asset_found": false}}').when(c("match_id") % 4 == 2, "{}")
    found = F.get_json_object(analysis, "$.comparison.asset_found").cast("boolean")
    return t.matches.select("match_id", "price", rules.source_type(found, _at(_CHANNELS, "match_id")).alias("source_type"))


@R.add(
    "h42_platforms",
    """WITH p AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN ['Instagram'] WHEN 1 THEN ['FACEBOOK', 'INSTAGRAM'] WHEN 2 THEN ['facebook'] WHEN 3 THEN [] WHEN 4 THEN ['audience_network', 'INSTAGRAM'] END AS platforms FROM events)
    SELECT event_id, CASE WHEN coalesce(list_contains(list_transform(platforms, lambda x: lower(x)), 'instagram') AND NOT list_contains(list_transform(platforms, lambda x: lower(x)), 'facebook'), false) THEN 'instagram' ELSE 'facebook' END AS channel FROM p""",
)
def platforms(t: Tables) -> DataFrame:
    """Adverts that run on instagram and not on facebook are routed to instagram."""
    k, lists = c("event_id") % 6, [["Instagram"], ["FACEBOOK", "INSTAGRAM"], ["facebook"], [], ["audience_network", "INSTAGRAM"]]
    p = F.lit(None).cast("array<string>")
    for i, xs in enumerate(lists):
        p = F.when(k == i, F.array(*[F.lit(x) for x in xs]).cast("array<string>")).otherwise(p)
    return t.events.select("event_id", rules.ad_channel(p, F.lit("facebook")).alias("channel"))


_URLS = ["https://m.f.example/profile.php?id={}", "https://f.example/{}", "https://f.example/{}/about?id=x1", "https://f.example/name.{}", "https://f.example/profile.php?ref=1&id=00&x={}", "https://f.example", "https://f.example/0", "https://f.example//{}?id="]


@R.add(
    "h45_page_ids",
    f"""WITH u AS (SELECT s_suppkey, replace({_list(_URLS)}[s_suppkey % {len(_URLS)} + 1], '{{}}', CAST(s_suppkey * 7919 AS VARCHAR)) AS url FROM supplier),
    p AS (SELECT *, regexp_extract(url, '[?&]id=([^&#]+)', 1) AS q, regexp_extract(url, '^[a-z]+://[^/?#]*/+([^/?#]+)', 1) AS slug FROM u)
    SELECT s_suppkey, url, CASE WHEN regexp_full_match(q, '[0-9]+') AND CAST(q AS HUGEINT) > 0 THEN q WHEN regexp_full_match(slug, '[0-9]+') AND CAST(slug AS HUGEINT) > 0 THEN slug ELSE 'none' END AS page FROM p""",
)
def page_ids(t: Tables) -> DataFrame:
    """The numeric id that a profile URL holds."""
    url = F.replace(_at(_URLS, "s_suppkey"), F.lit("{}"), (c("s_suppkey") * 7919).cast("string"))
    return t.supplier.select("s_suppkey", url.alias("url"), F.coalesce(rules.page_id(url), F.lit("none")).alias("page"))
