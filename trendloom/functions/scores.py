"""Score expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), x))


def combine_scores(a: Column, b: Column) -> Column:
    """Mean of the scores that are present; ``NULL`` when both are missing."""
    return F.coalesce((a + b) / 2.0, a, b)


def signed_score(label: Column, probability: Column) -> Column:
    """Model label and probability as one number: negative, positive, or zero."""
    up = F.upper(label)
    return (
        F.when(probability.isNull() | label.isNull(), F.lit(None).cast("double"))
        .when(up.contains("NEG"), -probability)
        .when(up.contains("POS"), probability)
        .otherwise(F.lit(0.0))
    )


def sentiment_label(score: Column) -> Column:
    """Bounds are inclusive: 0.3 is positive and -0.3 is negative."""
    return (
        F.when(score.isNull(), "unknown")
        .when(score >= 0.3, "positive")
        .when(score <= -0.3, "negative")
        .otherwise("neutral")
    )


def confidence(token_count: Column) -> Column:
    """0.7, a tenth more for long answers, a tenth less for very short ones."""
    n = F.coalesce(token_count, F.lit(0))
    raw = F.when(n >= 100, 0.8).when((n > 0) & (n < 30), 0.6).otherwise(0.7)
    return clamp(raw, 0.1, 1.0)
