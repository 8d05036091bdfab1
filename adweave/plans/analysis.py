"""Analyses that feed the match funnel with different images and assets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.funnel import funnel
from ..operators.joins import first_per
from .base import Registry, Tables
from .pipelines import _PAIRS, judged_pairs

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
c = F.col

_NOT_BLOCKED, _ELIGIBLE = "z.match_id % 13 <> 0", "(len(a.platforms) = 0 OR list_contains(a.platforms, 'facebook'))"


def images(t: Tables) -> DataFrame:
    """Judged pairs with what the analyses choose by: is_processed and capture_method of the image, the asset's organisation and platforms."""
    i = c("match_id")
    pairs = judged_pairs(t).withColumn("is_processed", i % 3 == 0).withColumn("capture_method", F.when(i % 13 == 0, "blocked_evidence").when(i % 2 == 0, "plain"))
    return pairs.join(t.assets.select("asset_id", "org_id", "platforms", "campaign_id"), "asset_id")


def eligible(x: DataFrame, source: str) -> DataFrame:
    """Images that were captured, with assets for the source or for any."""
    seen = F.coalesce("capture_method", F.lit("")) != "blocked_evidence"
    return x.filter(seen & ((F.size("platforms") == 0) | F.array_contains("platforms", source)))


def summary(x: DataFrame, *more: Column) -> DataFrame:
    return funnel(x).groupBy("stage").agg(F.count("*").alias("n"), F.count_if(c("final_score") >= 75).alias("strong"), *more)


@R.add("l4_post_scan", f"WITH {_PAIRS} SELECT stage, count(*) AS n, count(*) FILTER (final_score >= 75) AS strong, count(DISTINCT a.campaign_id) AS campaigns FROM z JOIN assets a USING (asset_id) WHERE z.match_id % 3 <> 0 AND {_NOT_BLOCKED} AND {_ELIGIBLE} GROUP BY 1")
def post_scan(t: Tables) -> DataFrame:
    """L4: unprocessed images of a scan against the assets for their source, counted by stage."""
    return summary(eligible(images(t), "facebook").filter(~c("is_processed")), F.countDistinct("campaign_id").alias("campaigns"))


@R.add(
    "l5_rematch",
    f"WITH {_PAIRS} SELECT z.match_id, z.price, z.asset_id, final_score FROM z JOIN assets a USING (asset_id) WHERE {_NOT_BLOCKED} AND {_ELIGIBLE} AND stage = 'matched' AND a.org_id = 2 QUALIFY row_number() OVER (PARTITION BY z.asset_id, z.distributor_id ORDER BY final_score DESC, z.match_id, z.price) = 1",
)
def rematch(t: Tables) -> DataFrame:
    """Images of earlier scans, processed or not, against another campaign's assets; the best match of an asset and dealer stays."""
    x = funnel(eligible(images(t), "facebook").filter("org_id = 2")).filter("stage = 'matched'")
    return first_per(x, ["asset_id", "distributor_id"], [F.desc("final_score"), c("match_id").asc(), c("price").asc()]).select("match_id", "price", "asset_id", "final_score")


@R.add("l12_without_campaign", f"WITH {_PAIRS} SELECT stage, count(*) AS n, count(*) FILTER (final_score >= 75) AS strong FROM z JOIN assets a USING (asset_id) WHERE a.org_id = 3 AND {_NOT_BLOCKED} GROUP BY 1")
def without_campaign(t: Tables) -> DataFrame:
    """All assets of the organisation that have a campaign, whatever their source."""
    return summary(images(t).filter((c("org_id") == 3) & c("campaign_id").isNotNull() & (F.coalesce("capture_method", F.lit("")) != "blocked_evidence")))


@R.add(
    "l13_reprocess",
    f"WITH {_PAIRS}, u AS (SELECT z.* FROM z JOIN assets a USING (asset_id) WHERE z.match_id % 3 <> 0 AND a.org_id = 1 ORDER BY z.match_id, z.price LIMIT 200) SELECT match_id, price, stage, true AS is_processed FROM u",
)
def reprocess(t: Tables) -> DataFrame:
    """The first so many unprocessed images of an organisation; the limit is the feature."""
    u = images(t).filter((c("org_id") == 1) & ~c("is_processed")).orderBy("match_id", "price").limit(200)
    return funnel(u).select("match_id", "price", "stage", F.lit(True).alias("is_processed"))
