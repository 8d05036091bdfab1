"""Rules of the domain over URLs, status codes, messages, platforms and uploads, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..streaming.limits import LADDER

# Signatures of messages, in order of precedence; upload types; channels of adverts.
CLOSED_MARKERS = ("Target page, context or browser has been closed", "Target closed", "TargetClosedError")
BLOCK_SIGNATURES = ("ERR_ABORTED", "ERR_BLOCKED_BY_CLIENT", "ERR_BLOCKED_BY_RESPONSE", "ERR_HTTP_RESPONSE_CODE_FAILURE", "ERR_TOO_MANY_REDIRECTS", "ERR_SSL_PROTOCOL_ERROR", "ERR_CERT_")
NO_BROWSER_MARKERS = ("browsertype.launch: executable doesn't exist", "looks like playwright was just installed or updated", "playwright install", "chrome-headless-shell")
UPLOAD_TYPES = ("image/png", "image/jpeg", "image/jpg", "image/gif", "image/webp", "image/svg+xml")
LAYERED_TYPES = ("image/vnd.adobe.photoshop", "image/x-photoshop", "application/x-photoshop")
LAYERED_EXTENSION, LAYERED_MAGIC = ".psd", "8BPS"
UPLOAD_BYTES = 25 * 1024 * 1024
AD_CHANNELS = ("google_ads", "facebook", "instagram")
VERDICT_CATEGORIES = {"true_positive": "clear_positive", "false_positive": "borderline_false", "true_negative": "different_brand", "false_negative": "modified_positive"}
OTHER_CATEGORY = "borderline_false"
CROP_WIDTH, CROP_HEIGHT, CROP_BYTES = 50, 30, 2000


def failure(timed_out: Column, message: Column) -> tuple[Column, Column]:
    """Outcome (timeout, blocked or crashed) and reason of a failed page: a timeout first, then a closed browser, then the first blocking signature in the message, else its first line."""
    message = F.coalesce(message, F.lit(""))
    closed = F.lit(False)
    for m in CLOSED_MARKERS:
        closed = closed | F.contains(message, F.lit(m))
    signature = F.coalesce(*[F.when(F.contains(message, F.lit(s)), s) for s in BLOCK_SIGNATURES])
    line = F.when(message == "", "unknown").otherwise(F.substring(F.element_at(F.split(message, "\r\n|\r|\n"), 1), 1, 200))
    outcome = F.when(timed_out, "timeout").when(closed, "crashed").when(signature.isNotNull(), "blocked").otherwise("crashed")
    return outcome, F.when(timed_out, F.lit(None)).when(closed, "browser_closed").otherwise(F.coalesce(signature, line))


def browser_missing(message: Column) -> Column:
    """Whether a message says that the browser isn't installed, whatever its line ends and letter case."""
    flat = F.lower(F.trim(F.regexp_replace(F.coalesce(message, F.lit("")), r"\s+", " ")))
    out = F.lit(False)
    for m in NO_BROWSER_MARKERS:
        out = out | F.contains(flat, F.lit(m))
    return out


def preflight_strategy(status: Column) -> Column:
    """The strategy that the HTTP status of a first probe suggests."""
    plain, shot, both = LADDER[0], LADDER[3], LADDER[2]
    return F.when(status.isin(401, 403, 451), shot).when(status == 429, both).when(status.between(200, 399) | status.between(500, 599), plain).otherwise(both)


def next_strategy(strategy: Column) -> Column:
    """One rung up; the last one stays, unknown ones begin at the first."""
    out = F.lit(LADDER[0])
    for here, above in zip(LADDER, (*LADDER[1:], LADDER[-1])):
        out = F.when(strategy == here, above).otherwise(out)
    return out


def source_type(found_on_page: Column, channel: Column) -> Column:
    """What a match was found in: an asset found on the page counts before the channel."""
    return F.when(F.coalesce(found_on_page, F.lit(False)), "page_screenshot").when(channel == "website", "website_banner").when(channel.isin(*AD_CHANNELS), "ad").otherwise("unknown")


def ad_channel(platforms: Column, channel: Column) -> Column:
    """instagram for adverts that run there and not on facebook; else the channel of the run."""
    low = F.transform(F.coalesce(platforms, F.array().cast("array<string>")), lambda p: F.lower(p))
    return F.when(F.coalesce(F.array_contains(low, "instagram"), F.lit(False)) & ~F.coalesce(F.array_contains(low, "facebook"), F.lit(False)), "instagram").otherwise(channel)


def page_id(url: Column) -> Column:
    """The numeric id of a profile URL: the first query value `id` if it is digits over 0, else the first path segment if that is; null otherwise."""
    query = F.regexp_extract(url, r"[?&]id=([^&#]+)", 1)
    slug = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*/+([^/?#]+)", 1)
    digits = lambda x: x.rlike("^[0-9]+$") & x.rlike("[1-9]")
    return F.when(digits(query), query).when(digits(slug), slug)


def upload_error(name: Column, kind: Column, size: Column, magic: Column) -> Column:
    """Why an upload is refused (type, size, empty), the first reason; null if it is taken."""
    kind = F.lower(F.coalesce(kind, F.lit("")))
    taken = kind.isin(*UPLOAD_TYPES, *LAYERED_TYPES, "") | F.lower(name).endswith(LAYERED_EXTENSION)
    return F.when(~taken, "type").when(size > UPLOAD_BYTES, "size").when(size == 0, "empty")


def is_layered(name: Column, kind: Column, magic: Column) -> Column:
    """Whether an upload is a layered file, by extension, type or first bytes, so that it must be flattened."""
    return F.lower(name).endswith(LAYERED_EXTENSION) | F.lower(F.coalesce(kind, F.lit(""))).isin(*LAYERED_TYPES) | (magic == LAYERED_MAGIC)


def category(verdict: Column) -> Column:
    """Category of a labelled case by its verdict."""
    out = F.lit(OTHER_CATEGORY)
    for k, v in VERDICT_CATEGORIES.items():
        out = F.when(F.lower(verdict) == k, v).otherwise(out)
    return out


def shown_url(url: Column) -> Column:
    """url, or null where it holds the data itself."""
    return F.when(~url.startswith("data:"), url)
