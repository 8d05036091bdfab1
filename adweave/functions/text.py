"""URL, text, date and JSON helpers as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of promotional paths, page paths and extensions that are not scanned.
PROMO_WORDS = tuple(
    "promo promotion promotions deal deals offer offers special specials sale sales shop store buy campaign featured new latest clearance rebate rebates incentive incentives savings "
    "financing coupon coupons discount discounts inventory products services catalog events seasonal limited exclusive".split()
)
BLOCKED_EXTENSIONS = (".jpg", ".jpeg", ".png", ".gif", ".svg", ".webp", ".ico", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".zip", ".gz", ".css", ".js", ".json", ".xml", ".txt", ".mp4", ".mp3", ".woff", ".woff2", ".ttf", ".eot")
BLOCKED_PATHS = (
    "/wp-content/", "/wp-admin/", "/cdn-cgi/", "/api/", "/cart", "/checkout", "/login", "/signin", "/account", "/privacy", "/terms", "/sitemap", "/feed", "/rss", "/tag/", "/author/", "/page/", "#", "/blog",
)


def hostname(url: Column) -> Column:
    """Lower-case host, empty if the URL has none."""
    return F.coalesce(F.lower(F.expr("null") if url is None else F.try_parse_url(url, F.lit("HOST"))), F.lit(""))


def normal_url(url: Column) -> Column:
    """Scheme, host and path without query, fragment and last slash; a bare host keeps /."""
    path = F.coalesce(F.regexp_replace(F.try_parse_url(url, F.lit("PATH")), "/+$", ""), F.lit(""))
    return F.concat(F.try_parse_url(url, F.lit("PROTOCOL")), F.lit("://"), F.lower(F.try_parse_url(url, F.lit("HOST"))), F.when(path == "", "/").otherwise(path))


def base_domain(host: Column) -> Column:
    return F.regexp_replace(F.lower(host), "^www\\.", "")


def page_slug(url: Column) -> Column:
    """First segment of the path, lower case; empty if there is none."""
    return F.lower(F.coalesce(F.element_at(F.filter(F.split(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/"), lambda x: x != ""), 1), F.lit("")))


def coverage_key(url: Column) -> Column:
    """Trimmed, lower-case URL without last slashes; null if blank."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(url)), "/+$", ""), F.lit(""))


def alnum(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def without_suffix(text: Column) -> Column:
    """text without its last part after a vertical bar, unless nothing would be left."""
    cut = F.regexp_replace(text, r"\s*[\x7C]\s*[^\x7C]+$", "")
    return F.when(F.trim(cut) == "", text).otherwise(cut)


def unescaped(text: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def complete_scheme(url: Column) -> Column:
    return F.when(url.startswith("http"), url).otherwise(F.concat(F.lit("https://"), url))


def is_promo(url: Column, words: tuple[str, ...] = PROMO_WORDS) -> Column:
    path = F.lower(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))
    return F.arrays_overlap(F.split(path, r"[/\-_.]"), F.array(*[F.lit(w) for w in words]))


def is_scannable(url: Column) -> Column:
    """Whether a URL is a page to scan: no blocked extension at the end of its path, no blocked part anywhere in it."""
    path = F.lower(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))
    blocked = f"(?:{'|'.join(map(re.escape, BLOCKED_EXTENSIONS))})$|{'|'.join(map(re.escape, BLOCKED_PATHS))}"
    return ~path.rlike(blocked)


def truncated(text: Column, n: int, mark: str = "") -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(mark))).otherwise(text)


def first_filled(*values: Column) -> Column:
    """First value that is neither null nor the empty string; 0 counts as filled."""
    return F.coalesce(*[F.nullif(v.cast("string"), F.lit("")) for v in values])


def name_matches(actor: Column, name: Column, slug: Column) -> Column:
    """Whether an advertiser's name is the expected one: letters and digits of either within the other's, or those of the slug within it. True without expectations, false without a name."""
    a, n, s = (alnum(F.coalesce(x, F.lit(""))) for x in (actor, name, slug))
    by_name = (n != "") & (F.contains(a, n) | F.contains(n, a))
    return (a != "") & (((n == "") & (s == "")) | by_name | ((s != "") & F.contains(a, s)))


def label(name: Column) -> Column:
    """snake_case as a title."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def embedded_json(text: Column) -> Column:
    """The JSON object in a text: a fenced block, else what stands between the outer braces, else the text."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.nullif(fenced, F.lit("")), F.nullif(braces, F.lit("")), text)


def epoch_time(value: Column) -> Column:
    """ISO time of a Unix time in seconds or, above 1e10, milliseconds; other text as it is."""
    n = F.try_to_number(value, F.lit("99999999999999999")).cast("double")
    seconds = F.when(n > 1e10, n / 1000).otherwise(n)
    return F.coalesce(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss"), value)


def char_sum(text: Column) -> Column:
    """Sum of the character codes of an ASCII text."""
    return F.aggregate(F.split(text, ""), F.lit(0), lambda s, x: s + F.coalesce(F.ascii(x), F.lit(0)))


def next_run(today: Column, frequency: Column, weekday: Column, passed: Column) -> Column:
    """Date of the next scheduled run. weekday: 0 is Monday; passed: today's time is over."""
    ahead = F.pmod(weekday - F.weekday(today), F.lit(7))
    ahead = F.when((ahead == 0) & passed, 7).otherwise(ahead)
    weekly = F.date_add(today, ahead.cast("int"))
    return (
        F.when(frequency == "daily", F.date_add(today, passed.cast("int")))
        .when(frequency == "weekly", weekly)
        .when(frequency == "biweekly", F.when(ahead < 7, F.date_add(weekly, 7)).otherwise(weekly))
        .otherwise(F.add_months(F.trunc(today, "month"), 1))
    )
