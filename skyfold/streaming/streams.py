"""Streaming forms of batch operators (an addition: the batch engine they mirror has no streams).

A stream keeps only bounded state: windows close at the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.functions.vec import not_nan


def windowed_error_statistics(errors: DataFrame, time: str, window: str = "1 hour", late: str = "10 minutes", column: str = "nadir_equiv_error_m", threshold_m: float = 250.0) -> DataFrame:
    """Count, mean, rms, largest error and percent below the threshold of each tumbling window."""
    e = F.col(column)
    got = errors.withWatermark(time, late).groupBy(F.window(time, window)).agg(
        F.count(e).alias("n"), F.avg(e).alias("mean_error_m"), F.sqrt(F.avg(e * e)).alias("rms_error_m"), F.max(e).alias("max_error_m"), F.avg(F.when(not_nan(e) & (e < threshold_m), 100.0).otherwise(0.0)).alias("percent_within")
    )
    return got.select(F.col("window.start").alias("start"), F.col("window.end").alias("stop"), "n", "mean_error_m", "rms_error_m", "max_error_m", "percent_within")


def sessions(events: DataFrame, time: str, key: str, gap_us: int, late: str = "1 day") -> DataFrame:
    """Sessions of each key: a step of the gap or more begins a new one.

    session_window() merges rows whose step is exactly the gap, so it gets a gap one microsecond shorter.
    """
    got = events.withWatermark(time, late).groupBy(key, F.session_window(time, f"{gap_us - 1} microseconds")).agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("start"), F.max(time).alias("stop"))
    return got.select(key, "start", "stop", "n")


def first_arrivals(rows: DataFrame, time: str, keys: list[str], late: str) -> DataFrame:
    """One row a key within the watermark: the first to arrive (keep_latest() keeps the latest of a batch)."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
