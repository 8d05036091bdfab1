"""Score formulas as columns: bands, rates, ensembles, gates, thresholds, costs."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values in force: score bands, gate curve, thresholds, ensemble weights, token rates.
EXACT, STRONG, PARTIAL, WEAK = 90, 75, 65, 50
GATE_CURVE = {0: 0, 1: 0, 2: 25, 3: 50, 4: 65, 5: 80}
REGULAR, SCREENSHOT = 60, 65
VISUAL_WEIGHT, HASH_WEIGHT, AGREEMENT_BONUS = 0.5, 0.15, 5
CACHE_WRITE, CACHE_READ = Decimal("1.25"), Decimal("0.10")


def match_band(score: Column) -> Column:
    """exact, strong, partial, weak or none by score."""
    return F.when(score >= EXACT, "exact").when(score >= STRONG, "strong").when(score >= PARTIAL, "partial").when(score >= WEAK, "weak").otherwise("none")


def appearance_band(appearance: Column, score: Column) -> Column:
    """Band by how the judge says an asset appears (exact, resized, cropped, modified) and by score."""
    whole = appearance.isin("exact", "resized")
    return F.when((appearance == "exact") & (score >= EXACT), "exact").when(whole & (score >= STRONG), "strong").when((whole | appearance.isin("cropped", "modified")) & (score >= PARTIAL), "partial").when(score >= WEAK, "weak").otherwise("none")


def rate(part: Column, total: Column, when_empty: float = 0.0) -> Column:
    """Percent with one digit, when_empty where the total is 0."""
    return F.when(total > 0, F.round(part * 100.0 / total, 1)).otherwise(F.lit(when_empty))


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def exact_sum(x: Column) -> Column:
    """Sum of doubles by their decimals, so that it doesn't hang on the order of rows; the plain sum if one of them has over 16 digits before the point or 12 behind it, or is no number."""
    d = x.try_cast("decimal(28,12)")
    return F.when(F.count_if(x.isNotNull() & ~d.cast("double").eqNullSafe(x)) == 0, F.sum(d).cast("double")).otherwise(F.sum(x))


def hamming_score(distance: Column) -> Column:
    """Similarity of a mean Hamming distance of 64-bit hashes."""
    return F.bround(F.greatest(F.lit(0.0), 100 - distance * 100 / 64))


def hash_class(distance: Column) -> Column:
    return F.when(distance < 5, "exact").when(distance < 15, "similar").when(distance < 25, "related").otherwise("different")


def ensemble(visual: Column, hashed: Column, exact: Column) -> Column:
    """Unrounded score of a visual and a hash score, with bonus and veto."""
    total = VISUAL_WEIGHT + HASH_WEIGHT
    f = visual * (VISUAL_WEIGHT / total) + hashed * (HASH_WEIGHT / total)
    f = F.when((visual > 60) & (hashed > 60), F.least(F.lit(100.0), f + AGREEMENT_BONUS)).otherwise(f)
    f = F.when(exact, F.greatest(f, F.lit(85.0))).otherwise(f)
    return F.when((visual >= 75) & (hashed <= 55), F.least(f, hashed + 10.0)).otherwise(f)


def gate_score(passed: Column) -> Column:
    out = F.lit(None).cast("int")
    for k, v in GATE_CURVE.items():
        out = F.when(passed == k, v).otherwise(out)
    return out


def calibrated(score: Column, factor: Column) -> Column:
    """Score times factor, cut to an integer from 0 to 100."""
    return clamp((score * factor).cast("int"), 0, 100).cast("int")


def default_threshold(source_type: Column) -> Column:
    return F.when(source_type == "page_screenshot", SCREENSHOT).otherwise(REGULAR)


def token_cost(fresh: Column, written: Column, read: Column, out: Column, rate_in: Column, rate_out: Column) -> Column:
    """Price in dollars of tokens at rates per million, cache tokens at their multipliers; exact decimals up to the end."""
    n = lambda x: x.cast("decimal(12,0)")
    r = lambda x: x.cast("decimal(8,2)")
    total = (n(fresh) + F.lit(CACHE_WRITE) * n(written) + F.lit(CACHE_READ) * n(read)) * r(rate_in) + n(out) * r(rate_out)
    return F.round(total * F.lit(Decimal("0.000001")), 6).cast("double")


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors as doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
