"""Paged sources, batch and stream, and table functions called from SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import table_functions
from ..sources.paged import file_fetch, file_pages, file_sources, paged_source, register, write_pages
from ..streaming.base import drained, shared_folder
from .base import Registry, Tables

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
c = F.col

_COLUMNS = "event_id long, source string, modified long"
PAGE, MOST = 200, 3


def _service(t: Tables, rows: DataFrame) -> str:
    """The events as a paged service: a source each kind, pages by number; gives its folder."""
    folder = f"{shared_folder(t.spark)}/service-{uuid.uuid4().hex}"
    _publish(rows, folder)
    register(t.spark, paged_source("adweave_creatives", _COLUMNS, file_fetch([x.split()[0] for x in _COLUMNS.split(", ")]), file_sources, file_pages, "source", "modified", MOST))
    return folder


def _publish(rows: DataFrame, folder: str) -> None:
    x = rows.select("event_id", F.unix_micros(c("ts").cast("timestamp")).alias("modified"), "event_type")
    write_pages(x, folder, c("event_type"), F.floor(c("event_id") / PAGE))


@R.add("a11_paged_creatives", f"SELECT event_id, event_type AS source FROM events WHERE event_id // {PAGE} < {MOST}")
def paged(t: Tables) -> DataFrame:
    """A plugged-in paged service, read along its page tokens, three pages a source at most."""
    return t.spark.read.format("adweave_creatives").option("folder", _service(t, t.events)).load().select("event_id", "source")


@R.add("a12_pushed_watermark", "SELECT event_id, event_type AS source FROM events WHERE event_type = 'click' AND epoch_us(ts) > epoch_us(TIMESTAMP '2024-01-10 00:00:00')")
def pushed(t: Tables) -> DataFrame:
    """One source's rows newer than a watermark; both filters reach the reader."""
    rows = t.spark.read.format("adweave_creatives").option("folder", _service(t, t.events)).option("most", 1 << 30).load()
    since = 1_704_844_800_000_000
    return rows.filter((c("source") == "click") & (c("modified") > since)).select("event_id", "source")


@R.add("a11_paged_stream", "SELECT event_id, event_type AS source FROM events")
def paged_stream(t: Tables) -> DataFrame:
    """A11 as a stream: it is stopped, pages are added, and it goes on with the next page of each source."""
    cut = t.events.agg(F.max("event_id")).first()[0] // PAGE // 2
    folder = _service(t, t.events.filter(F.floor(c("event_id") / PAGE) < cut))
    state = f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"
    for more in (None, t.events.filter(F.floor(c("event_id") / PAGE) >= cut)):
        if more is not None:
            _publish(more, folder)
        stream = t.spark.readStream.format("adweave_creatives").option("folder", folder).load()
        rows = drained(stream, at=state)
    return rows.select("event_id", "source")


@R.add(
    "k2_optimal_threshold",
    """SELECT source_type, channel, count(*) AS rows, CASE WHEN count(*) < 20 OR count(*) FILTER (was_correct AND confidence IS NOT NULL) = 0 THEN 40
    ELSE CAST(floor(avg(confidence) FILTER (was_correct) - 0.5 * coalesce(stddev_samp(confidence) FILTER (was_correct), 0) + 0.5) AS INTEGER) END AS threshold FROM feedback GROUP BY 1, 2""",
)
def threshold_function(t: Tables) -> DataFrame:
    """A table function from SQL, over the counts of equal scores of each partition."""
    table_functions.register(t.spark)
    view = f"scores_{uuid.uuid4().hex}"
    t.feedback.groupBy("source_type", "channel", c("confidence").cast("double").alias("score"), "was_correct").agg(F.count("*").alias("n")).createOrReplaceTempView(view)
    return t.spark.sql(f"SELECT * FROM optimal_threshold(TABLE({view}) PARTITION BY (source_type, channel), 20)")


@R.add(
    "k2_link_counts",
    """SELECT j.org_id, count(*) FILTER (a.org_id = j.org_id) AS updated, count(*) FILTER (a.org_id IS DISTINCT FROM j.org_id) AS orphans FROM matches m JOIN jobs j ON m.scan_job_id = j.job_id LEFT JOIN assets a USING (asset_id)
    WHERE m.distributor_id IS NULL GROUP BY 1""",
)
def link_function(t: Tables) -> DataFrame:
    """What a link through the asset's organisation would update, and what stays an orphan, by a table function."""
    table_functions.register(t.spark)
    m = t.matches.filter(c("distributor_id").isNull()).join(t.jobs.select(c("job_id").alias("scan_job_id"), "org_id"), "scan_job_id")
    m = m.join(t.assets.select("asset_id", c("org_id").alias("a_org")), "asset_id", "left")
    view = f"links_{uuid.uuid4().hex}"
    m.groupBy("org_id", c("distributor_id").cast("long").alias("own"), F.when(c("a_org") == c("org_id"), c("a_org")).cast("long").alias("of_parent")).agg(F.count("*").alias("n")).createOrReplaceTempView(view)
    return t.spark.sql(f"SELECT * FROM link_counts(TABLE({view}) PARTITION BY org_id)")


@R.add(
    "k4_ladder",
    """WITH a AS (SELECT user_id, event_id % 6 AS tier, bool_or(event_type = 'purchase' AND event_id % 5 = 0) AS ok FROM events GROUP BY 1, 2),
    f AS (SELECT user_id, min(tier) FILTER (ok) AS first, max(tier) AS last FROM a GROUP BY 1)
    SELECT user_id AS key, CAST(coalesce(first, last) AS INTEGER) AS tier, first IS NOT NULL AS ok, CAST((SELECT count(*) FROM a WHERE a.user_id = f.user_id AND a.tier <= coalesce(first, last)) AS INTEGER) AS attempts FROM f""",
)
def ladder(t: Tables) -> DataFrame:
    """K4: attempts of a page by rung; the first success wins, and later rungs aren't tried."""
    table_functions.register(t.spark)
    view = f"attempts_{uuid.uuid4().hex}"
    ok = (c("event_type") == "purchase") & (c("event_id") % 5 == 0)
    t.events.groupBy(c("user_id").alias("key"), (c("event_id") % 6).cast("int").alias("tier")).agg(F.bool_or(ok).alias("ok")).createOrReplaceTempView(view)
    return t.spark.sql(f"SELECT * FROM first_tier(TABLE({view}))")
