"""Range joins by buckets: an interval join as an equi-join, so Spark needs no nested loops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def points_in_intervals(points: DataFrame, intervals: DataFrame, point: str, start: str, stop: str, bucket: int, on: list[str] | None = None, how: str = "inner", closed: bool = False) -> DataFrame:
    """points x intervals with start <= point < stop (<= if closed), each match once.

    An interval is repeated for each bucket it touches, so bucket should be near the usual interval's length; a hot key
    spreads over its buckets. how: inner or left. Interval columns must have other names than point columns (but for `on`).
    """
    on = on or []
    b = lambda c: F.floor(c / bucket).cast("long")
    left = points.withColumn("_b", b(F.col(point)))
    right = intervals.where(F.col(stop) >= F.col(start)).withColumn("_b", F.explode(F.sequence(b(F.col(start)), b(F.col(stop))))).withColumnsRenamed({c: f"_r_{c}" for c in on})
    last = F.col(point) <= F.col(stop) if closed else F.col(point) < F.col(stop)
    cond = (left["_b"] == right["_b"]) & (F.col(point) >= F.col(start)) & last
    for c in on:
        cond = cond & (F.col(c) == F.col(f"_r_{c}"))
    return left.join(right, cond, how).drop(left["_b"]).drop(right["_b"]).drop(*[f"_r_{c}" for c in on])
