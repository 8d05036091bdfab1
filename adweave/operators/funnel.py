"""The staged match funnel: each pair leaves at the first stage that rejects it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores

# Labels of the funnel's stages, in order.
STAGES = ("download_failed", "hash_rejected", "clip_rejected", "filter_rejected", "below_threshold", "verification_rejected", "asset_invisible_rejected", "matched")


@dataclass
class Limits:
    """Thresholds in force."""

    hash_distance: float = 28
    cosine: float = 0.40
    relevance: float = 0.75
    borderline: tuple[int, int] = (60, 80)


def funnel(pairs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """pairs with stage, final_score and match_type.

    Columns read: downloaded, screenshot, hash_distance, cosine, relevance, visual, hashed,
    hash_exact, detection, gates_passed, gate_brand, gate_product, asset_visible, factor and
    threshold. Screenshots skip the stages on hash, vector and relevance. Scores in the
    borderline band are verified by the gates, whose curve then replaces the score. Only an
    explicit false of asset_visible rejects. Nulls of hash_distance and cosine (an empty
    cache) skip their stages.
    """
    c = F.col
    shot = c("screenshot")
    raw = F.when(shot, c("detection").cast("double")).otherwise(scores.ensemble(c("visual"), c("hashed"), c("hash_exact")))
    x = pairs.withColumn("__raw", raw)
    border = c("__raw").between(*limits.borderline)
    passed = c("gate_brand") & c("gate_product") & (c("gates_passed") >= 4)
    score = F.when(border, scores.gate_score(c("gates_passed")).cast("double")).otherwise(c("__raw"))
    stage = (
        F.when(~c("downloaded"), STAGES[0])
        .when(~shot & (c("hash_distance") > limits.hash_distance), STAGES[1])
        .when(~shot & (c("cosine") < limits.cosine), STAGES[2])
        .when(~shot & (c("relevance") < limits.relevance), STAGES[3])
        .when(c("__raw") < c("threshold"), STAGES[4])
        .when(border & ~passed, STAGES[5])
        .when(c("asset_visible").eqNullSafe(F.lit(False)), STAGES[6])
        .otherwise(STAGES[7])
    )
    x = x.withColumn("stage", stage).withColumn("final_score", F.when(c("stage") == "matched", scores.calibrated(score, c("factor"))))
    return x.withColumn("match_type", F.when(c("stage") == "matched", scores.match_band(c("final_score")))).drop("__raw")
