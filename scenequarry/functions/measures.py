"""Small numeric and labelling rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: thresholds and labels. ---
Z95 = 1.959964
CONFIDENCE_BANDS = ((0.85, "High"), (0.6, "Medium"), (0.0, "Low"))
FINDING_LABELS = ((0.9, "High confidence"), (0.75, "Likely"))
FINDING_DEFAULT = "Possible"
# --- End of fixed values. ---


def wilson_bounds(correct: Column, total: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson score interval of a proportion, clamped to 0..1; (0, 0) when nothing was counted."""
    n = total.cast("double")
    p = F.try_divide(correct.cast("double"), n)
    denom = 1 + F.try_divide(F.lit(z * z), n)
    centre = (p + F.try_divide(F.lit(z * z), 2 * n)) / denom
    half = F.lit(z) * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z), 4 * n * n)) / denom
    low = F.when(n > 0, F.greatest(F.lit(0.0), centre - half)).otherwise(0.0)
    high = F.when(n > 0, F.least(F.lit(1.0), centre + half)).otherwise(0.0)
    return low, high


def percent(share: Column) -> Column:
    """A 0..1 share as a whole percentage, halves to even."""
    return F.bround(share * 100).cast("int")


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def usable_confidence(confidence: Column) -> Column:
    """Confidence clamped to 0..1; null when missing or not finite."""
    finite = ~F.isnan(confidence) & (F.abs(confidence) != float("inf"))
    return F.when(finite, clamp(confidence, 0.0, 1.0))


def confidence_band(confidence: Column) -> Column:
    value = usable_confidence(confidence)
    (high, high_name), (medium, medium_name), (_, low_name) = CONFIDENCE_BANDS
    return F.when(value >= high, F.lit(high_name)).when(value >= medium, F.lit(medium_name)).when(
        value.isNotNull(), F.lit(low_name)
    )


def finding_label(peak: Column) -> Column:
    (high, high_name), (likely, likely_name) = FINDING_LABELS
    return F.when(peak >= high, F.lit(high_name)).when(peak >= likely, F.lit(likely_name)).otherwise(
        F.lit(FINDING_DEFAULT)
    )


def plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, F.lit("")).otherwise(F.lit("s")))


def kleene_false(flag: Column) -> Column:
    """A null condition counts as false."""
    return F.coalesce(flag, F.lit(False))
