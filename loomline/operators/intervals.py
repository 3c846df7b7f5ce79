"""Joins of days with the intervals that hold them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def best_interval(points: DataFrame, intervals: DataFrame, point: str, day: str, interval: str, start: str, end: str, key: str, slack: int = 90) -> DataFrame:
    """Each point (point, day, key) with the shortest interval (interval, start, end, key) of its key that holds its day.

    Intervals are ``slack`` days wider on each side; one without an end is
    open, one without a start holds nothing.  The best is an aggregate by
    point, of equal length the earlier start, then the smaller interval.
    """
    far = F.lit("9999-12-31").cast("date")
    spans = intervals.where(F.col(start).isNotNull()).select(F.col(key), interval, F.col(start).alias("ll_start"), F.col(end).alias("ll_end"))
    held = points.join(spans, key).where((F.col(day) >= F.date_sub("ll_start", slack)) & (F.col("ll_end").isNull() | (F.col(day) <= F.date_add("ll_end", slack))))
    rank = F.struct(F.datediff(F.coalesce("ll_end", far), "ll_start").alias("d"), F.col("ll_start"), F.col(interval))
    return held.groupBy(point).agg(F.min_by(interval, rank).alias(interval))
