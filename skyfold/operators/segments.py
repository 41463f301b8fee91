"""Order-dependent operators over time series: segmentation at gaps, latest rows, differences and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyfold.functions.vec import NAN, not_nan, safe_div


def split_at_gaps(rows: DataFrame, by: list[str], time_us: str, gap_us: int, order: list[str] | None = None, seconds_component: bool = False) -> DataFrame:
    """All columns and `segment`, from 0 in each key: a new one where the step reaches the gap.

    seconds_component compares the step's seconds within its day, without fractions, as timedelta.seconds gives them.
    """
    w = Window.partitionBy(*by).orderBy(time_us, *(order or []))
    step = F.col(time_us) - F.lag(time_us).over(w)
    if seconds_component:
        step = F.pmod(F.floor(step / 1_000_000), F.lit(86_400)) * 1_000_000
    return rows.withColumn("_new", F.when(step >= gap_us, 1).otherwise(0)).withColumn("segment", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")


def keep_latest(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*by).orderBy(*[c.desc_nulls_last() for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def seconds_from_first(time_us: str, w) -> Column:
    return (F.col(time_us) - F.first(time_us).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))) / 1e6


def gradient(value: Column, time_s: Column, w) -> Column:
    """Second-order differences on uneven steps, one-sided at the ends; a lone sample: NaN."""
    f0, f2, t0, t2 = F.lag(value).over(w), F.lead(value).over(w), F.lag(time_s).over(w), F.lead(time_s).over(w)
    hs, hd = time_s - t0, t2 - time_s
    inner = safe_div(hs * hs * f2 + (hd * hd - hs * hs) * value - hd * hd * f0, hs * hd * (hs + hd))
    return F.when(t0.isNull() & t2.isNull(), F.lit(NAN)).when(t0.isNull(), safe_div(f2 - value, hd)).when(t2.isNull(), safe_div(value - f0, hs)).otherwise(inner)


def rates(rows: DataFrame, by: list[str], order: list[str], time_us: str, value: str, out: str, unwrap_degrees: bool = False) -> DataFrame:
    """All columns and the rate of change per second, in the order given (not by time).

    unwrap_degrees first removes jumps of over 180 degrees between samples that are numbers.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    rows = rows.withColumn("_t", F.col(time_us).cast("double") / 1e6).withColumn("_v", F.col(value))
    if unwrap_degrees:
        before = F.last(F.when(not_nan(F.col(value)), F.col(value)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        d = F.col(value) - F.col("_p")
        wrapped = F.pmod(d + 180.0, F.lit(360.0)) - 180.0
        wrapped = F.when((wrapped == -180.0) & (d > 0), F.lit(180.0)).otherwise(wrapped)
        rows = rows.withColumn("_p", before).withColumn("_j", F.when(not_nan(F.col(value)) & F.col("_p").isNotNull() & (F.abs(d) >= 180.0), wrapped - d).otherwise(0.0))
        rows = rows.withColumn("_v", F.col(value) + F.sum("_j").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_p", "_j")
    return rows.withColumn(out, gradient(F.col("_v"), F.col("_t"), w)).drop("_t", "_v")


def mean_step(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Mean first difference of each key, and whether all differences are positive."""
    w = Window.partitionBy(*by).orderBy(*order)
    d = rows.withColumn("_d", F.lead(value).over(w) - F.col(value))
    return d.groupBy(*by).agg(F.avg("_d").alias("mean_step"), F.coalesce(F.bool_and(F.col("_d") > 0), F.lit(True)).alias("increasing"))
