"""Scores of postings: recency, composite, percentile, band."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

UNDATED, HALF_LIFE, FIT, LIKELIHOOD, RECENCY, LEAST_SAMPLES = 50.0, 14.0, 0.45, 0.30, 0.25, 8


def recency(age: Column, half_life: float = HALF_LIFE) -> Column:
    """100 for today, halved each ``half_life`` days; 50 undated; always 100 without a half-life."""
    if half_life <= 0:
        return F.when(age.isNull(), UNDATED).otherwise(100.0)
    return F.when(age.isNull(), UNDATED).otherwise(100.0 * F.pow(F.lit(0.5), F.greatest(age, F.lit(0)) / half_life))


def composite(fit: Column, likelihood: Column, fresh: Column, weights: tuple[float, float, float] = (FIT, LIKELIHOOD, RECENCY)) -> Column:
    """Merit of fit and likelihood, of which staleness takes away at most the weight of recency; two decimals, halves up."""
    total = sum(weights)
    f, k, r = (w / total for w in weights) if total > 0 else (FIT, LIKELIHOOD, RECENCY)
    merit = (f * F.coalesce(fit, F.lit(0)) + k * F.coalesce(likelihood, F.lit(0))) / (f + k)
    return F.floor(merit * ((1 - r) + r * fresh / 100.0) * 100.0 + 0.5) / 100.0


def with_percentile(df: DataFrame, value: str, to: str = "percentile") -> DataFrame:
    """Midpoint percentile of ``value`` among all rows; null under eight rows or for a null value.

    Counts are taken per distinct value first, so the ranking window runs
    over distinct values and no task holds all rows.
    """
    per = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("ll_v")).agg(F.count(F.lit(1)).alias("ll_n"))
    # composites have two decimals between 0 and 100: at most 10,001 distinct values meet in this window
    below = F.coalesce(F.sum("ll_n").over(Window.orderBy("ll_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("ll_n").over(Window.partitionBy())
    ranked = per.select("ll_v", F.when(total >= LEAST_SAMPLES, F.bround(100.0 * (below + 0.5 * F.col("ll_n")) / total).cast("int")).alias(to))
    return df.join(F.broadcast(ranked), F.col(value) == F.col("ll_v"), "left").drop("ll_v")


def band(percentile: Column, score: Column) -> Column:
    alone = F.when(score >= 78, "strong").when(score >= 62, "worth a look").when(score >= 48, "marginal").otherwise("weak")
    return F.when(percentile.isNull(), alone).when(percentile >= 90, "top 10% of everything seen").when(percentile >= 75, "top quarter").when(percentile >= 50, "above your median").otherwise("below your median")
