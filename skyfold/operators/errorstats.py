"""Nadir-equivalent geolocation errors, their statistics and verification against a requirement."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfold.functions.vec import NAN, Vec, apply, clip, matrix, not_nan, safe_div

from .ranks import numbered, percentiles, value_counts

EARTH_M = 6378137.0
#: Thresholds (m) of the statistics.
THRESHOLDS = (100, 250, 500, 750, 1000)
CORRELATION_NAMES = ("correlation", "ccv", "im_ccv")


@dataclass(frozen=True)
class Requirement:
    """At least `percent` of the errors lie strictly below `threshold_m`."""

    threshold_m: float = 250.0
    percent: float = 39.0


def filter_correlation(matches: DataFrame, least: float | None) -> DataFrame:
    """Rows whose correlation reaches least; NaN does not. Without such a column all rows stay."""
    name = next((c for c in CORRELATION_NAMES if c in matches.columns), None)
    return matches if least is None or name is None else matches.where(not_nan(F.col(name)) & (F.col(name) >= least))


def uen_boresight(boresight: Vec, lat_deg: Column, lon_deg: Column) -> Vec:
    """An Earth-fixed vector as (up, east, north)."""
    lat, lon = F.radians(lat_deg), F.radians(lon_deg)
    rows = (Vec(F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)), Vec(-F.sin(lon), F.cos(lon), F.lit(0.0)), Vec(-F.sin(lat) * F.cos(lon), -F.sin(lat) * F.sin(lon), F.cos(lat)))
    return apply(rows, boresight)


def scale_factors(radius_m: Column, theta: Column) -> tuple[Column, Column]:
    """(view plane, cross view): factors that bring errors at angle theta off nadir to those at nadir; NaN beyond the limb."""
    f, h = radius_m / EARTH_M, radius_m - EARTH_M
    under = 1 - f * f * F.sin(theta) * F.sin(theta)
    t = F.when(under < 0, F.lit(NAN)).otherwise(F.greatest(F.sqrt(F.greatest(under, F.lit(0.0))), F.lit(1e-10)))
    view = safe_div(h / EARTH_M, safe_div(f * F.cos(theta), t) - 1)
    cross = safe_div(h / EARTH_M, F.cos(theta) * (f * F.cos(theta) - t))
    return view, cross


def nadir_equivalent(matches: DataFrame) -> DataFrame:
    """All columns and ns_error_m, ew_error_m, vp_error_m, xvp_error_m, nadir_equiv_error_m (NaN at exact nadir).

    matches: lat_error_deg, lon_error_deg, gcp_lat_deg, gcp_lon_deg, position (array of 3, m, Earth-fixed), boresight
    (array of 3, unit, instrument frame), rotation (array of 9, instrument to Earth-fixed, row-major).
    """
    r = Vec(*(F.col("position")[i] for i in range(3)))
    b = apply(matrix([F.col("rotation")[i] for i in range(9)]), Vec(*(F.col("boresight")[i] for i in range(3))))
    ns = EARTH_M * F.radians("lat_error_deg")
    ew = EARTH_M * F.cos(F.radians("gcp_lat_deg")) * F.radians("lon_error_deg")
    s = uen_boresight(b, F.col("gcp_lat_deg"), F.col("gcp_lon_deg"))
    theta = F.acos(clip(-safe_div(b.dot(r), r.norm()), -1.0, 1.0))
    step = matches.withColumns({"ns_error_m": ns, "ew_error_m": ew, "_be": s.y, "_bn": s.z, "_r": r.norm(), "_theta": theta})
    n = F.sqrt(F.col("_be") * F.col("_be") + F.col("_bn") * F.col("_bn"))
    view, cross = scale_factors(F.col("_r"), F.col("_theta"))
    step = step.withColumns(
        {
            "vp_error_m": safe_div(F.col("ew_error_m") * F.col("_be") + F.col("ns_error_m") * F.col("_bn"), n) * view,
            "xvp_error_m": safe_div(F.col("ew_error_m") * F.col("_bn") - F.col("ns_error_m") * F.col("_be"), n) * cross,
        }
    )
    total = F.sqrt(F.col("vp_error_m") * F.col("vp_error_m") + F.col("xvp_error_m") * F.col("xvp_error_m"))
    return step.withColumn("nadir_equiv_error_m", total).drop("_be", "_bn", "_r", "_theta")


def percent_below(error: Column, threshold: float) -> Column:
    """Share of rows strictly below, in percent; NaN is not below; no rows: 0."""
    return F.coalesce(F.avg(F.when(not_nan(error) & (error < threshold), 100.0).otherwise(0.0)), F.lit(0.0))


def statistics(errors: DataFrame, column: str = "nadir_equiv_error_m", by: list[str] | None = None) -> DataFrame:
    """One row (or one for each key): count, mean, median, rms, std (population), min, max, percentiles, percent below.

    Percentiles interpolate linearly. Any NaN makes the moments NaN.
    """
    keys, shares = by or [], (50, 25, 75, 90, 95, 99)
    counts = value_counts(errors, column, keys)
    v, c = F.col("_v"), F.col("_c")
    n, mean, square = F.sum(F.when(v.isNotNull(), c)), F.sum(v * c), F.sum(v * v * c)
    means = counts.groupBy(*keys).agg(safe_div(mean, n).alias("_mean"))
    if keys:
        of = [F.col(f"_m_{k}").eqNullSafe(F.col(f"`{k}`")) for k in keys]
        centred = counts.join(means.withColumnsRenamed({k: f"_m_{k}" for k in keys}), of)
    else:
        centred = counts.join(F.broadcast(means), F.lit(True))  # one row
    aside = (v - F.col("_mean")) * (v - F.col("_mean"))
    aggs = [
        F.coalesce(n, F.lit(0)).alias("num_measurements"), safe_div(mean, n).alias("mean_error_m"), F.sqrt(safe_div(square, n)).alias("rms_error_m"),
        F.sqrt(safe_div(F.sum(aside * c), n)).alias("std_error_m"),
        F.min(v).alias("min_error_m"), F.max(v).alias("max_error_m"),
        *(F.coalesce(F.try_divide(F.sum(F.when(not_nan(v) & (v < float(t)), c * 100.0).otherwise(0.0)), F.sum(c)), F.lit(0.0)).alias(f"percent_under_{t}m") for t in THRESHOLDS),
    ]
    got, order = centred.groupBy(*keys).agg(*aggs), percentiles(counts, [p / 100 for p in shares], keys)
    if keys:
        same = [F.col(f"_b_{k}").eqNullSafe(F.col(f"`{k}`")) for k in keys]
        both = got.join(order.withColumnsRenamed({k: f"_b_{k}" for k in keys}), same, "left")
    else:
        both = got.join(F.broadcast(order), F.lit(True), "left")  # one row each
    at = {f"p{p}_error_m": F.get("percentiles", F.lit(i)) for i, p in enumerate(shares)}
    at["median_error_m"] = at.pop("p50_error_m")
    return both.withColumns(at).select(*keys, "num_measurements", "mean_error_m", "median_error_m", "rms_error_m", "std_error_m", "min_error_m", "max_error_m", *[f"p{p}_error_m" for p in shares[1:]], *[f"percent_under_{t}m" for t in THRESHOLDS])


def union_matches(*tables: DataFrame) -> DataFrame:
    """All rows, `table_index` and `measurement` telling their place; a column that only some tables have is null in others.

    measurement counts from 0 in each table, by what the table's own column of that name orders (else by a hash of the row).
    """
    out = None
    for i, t in enumerate(tables):
        if "measurement" in t.columns:
            t = numbered(t.withColumnRenamed("measurement", "_own"), "_own", "measurement").drop("_own")
        else:
            t = numbered(t.withColumn("_own", F.xxhash64(*[F.col(f"`{c}`") for c in t.columns])), "_own", "measurement").drop("_own")
        t = t.withColumn("table_index", F.lit(i))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def verdict(errors: DataFrame, need: Requirement = Requirement(), column: str = "nadir_equiv_error_m") -> DataFrame:
    """One row: passed, percent_within, num_measurements, warning (null if passed). Exactly at the percentage passes; no rows fail."""
    got = errors.agg(F.count(F.lit(1)).alias("num_measurements"), percent_below(F.col(column), need.threshold_m).alias("percent_within"))
    passed = (F.col("num_measurements") > 0) & (F.col("percent_within") >= need.percent)
    text = F.format_string(f"%.1f%% of measurements are below {need.threshold_m:g} m; {need.percent:g}%% are required", "percent_within")
    return got.select(passed.alias("passed"), "percent_within", "num_measurements", F.when(~passed, text).alias("warning"))


def per_gcp(errors: DataFrame, need: Requirement = Requirement(), column: str = "nadir_equiv_error_m") -> DataFrame:
    """All columns and whether each measurement is strictly within the threshold."""
    return errors.withColumn("within_threshold", not_nan(F.col(column)) & (F.col(column) < need.threshold_m))


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """Statistics of two runs side by side: one row a metric with both values and the change."""

    def long(df: DataFrame, name: str) -> DataFrame:
        one = statistics(df)
        return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias(name)) for c in one.columns])).alias("s")).select("s.*")

    return long(before, "before").join(long(after, "after"), "metric").withColumn("change", F.col("after") - F.col("before"))


def report(errors: DataFrame, need: Requirement = Requirement()) -> str:
    """The verification as text; the rows shown are bounded by `take`."""
    v = verdict(errors, need).first()
    rows = per_gcp(errors, need).select("measurement", "nadir_equiv_error_m", "within_threshold").orderBy("measurement").take(100)
    lines = [f"{'measurement':>12} {'error m':>12} within", *(f"{r[0]:>12} {r[1]:>12.2f} {'yes' if r[2] else 'no'}" for r in rows)]
    return "\n".join([*lines, f"{v.percent_within:.1f}% below {need.threshold_m:g} m: {'PASS' if v.passed else 'FAIL'}"])
