"""Queries of geolocation error statistics, verification and parameter sweeps, over line items as measurements."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyfold.functions import constants as K
from skyfold.operators import errorstats as S
from skyfold.operators import sweep as W

from .registry import query, r, rs, table

A, E2 = K.WGS84_A_KM, K.WGS84_E2
#: A measurement: errors in degrees from discount and tax, a control point, a satellite about 420 km above it, a boresight near nadir, the identity.
_LAT, _LON = "(l_suppkey * 1.7::DOUBLE) % 120.0::DOUBLE - 60", "(l_partkey * 137.508::DOUBLE) % 360.0::DOUBLE - 180"
MATCH = f"""m AS (SELECT l_orderkey * 8 + l_linenumber AS measurement, l_orderkey, l_suppkey, (l_discount - 0.05) * 0.05::DOUBLE AS dlat, (l_tax - 0.04) * 0.06::DOUBLE AS dlon, {_LAT} AS lat, {_LON} AS lon,
  cos(radians({_LAT})) * cos(radians({_LON})) * 6798137.0::DOUBLE AS rx, cos(radians({_LAT})) * sin(radians({_LON})) * 6798137.0::DOUBLE AS ry, sin(radians({_LAT})) * 6798137.0::DOUBLE AS rz, l_quantity AS q FROM lineitem),
v AS (SELECT *, -rx / 6798137 + 0.0008::DOUBLE * q AS ux, -ry / 6798137 + 0.0003::DOUBLE * q AS uy, -rz / 6798137 - 0.0005::DOUBLE * q AS uz FROM m),
b AS (SELECT *, ux / sqrt(ux*ux + uy*uy + uz*uz) AS bx, uy / sqrt(ux*ux + uy*uy + uz*uz) AS by_, uz / sqrt(ux*ux + uy*uy + uz*uz) AS bz FROM v),
w AS (SELECT *, -sin(radians(lon)) * bx + cos(radians(lon)) * by_ AS be, -sin(radians(lat)) * cos(radians(lon)) * bx - sin(radians(lat)) * sin(radians(lon)) * by_ + cos(radians(lat)) * bz AS bn,
  sqrt(rx*rx + ry*ry + rz*rz) AS l, 6378137.0::DOUBLE * radians(dlat) AS ns, 6378137.0::DOUBLE * cos(radians(lat)) * radians(dlon) AS ew FROM b),
t AS (SELECT *, acos(greatest(-1, least(1, -(bx*rx + by_*ry + bz*rz) / l))) AS th, l / 6378137 AS f, (l - 6378137) / 6378137 AS h, sqrt(be*be + bn*bn) AS n FROM w),
s AS (SELECT *, greatest(sqrt(1 - f*f*sin(th)*sin(th)), 1e-10) AS k FROM t WHERE f*f*sin(th)*sin(th) <= 1),
e AS (SELECT measurement, l_orderkey, l_suppkey, ns, ew, (ew*be + ns*bn) / n * (h / (f*cos(th)/k - 1)) AS vp, (ew*bn - ns*be) / n * (h / (cos(th) * (f*cos(th) - k))) AS xvp FROM s),
err AS (SELECT *, sqrt(vp*vp + xvp*xvp) AS err FROM e)"""


def matches(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    lat, lon, q = F.col("gcp_lat_deg"), F.col("gcp_lon_deg"), F.col("l_quantity")
    m = li.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("measurement"), "l_orderkey", "l_suppkey", "l_quantity", ((F.col("l_discount") - 0.05) * 0.05).alias("lat_error_deg"), ((F.col("l_tax") - 0.04) * 0.06).alias("lon_error_deg"),
        (F.col("l_suppkey") * 1.7 % 120.0 - 60).alias("gcp_lat_deg"), (F.col("l_partkey") * 137.508 % 360.0 - 180).alias("gcp_lon_deg"), (F.col("l_discount") * 10).alias("correlation"),
    )
    up = [F.cos(F.radians(lat)) * F.cos(F.radians(lon)), F.cos(F.radians(lat)) * F.sin(F.radians(lon)), F.sin(F.radians(lat))]
    m = m.withColumn("position", F.array(*[c * 6798137.0 for c in up]))
    p = F.col("position")
    m = m.withColumn("u", F.array(-p[0] / 6798137 + 0.0008 * q, -p[1] / 6798137 + 0.0003 * q, -p[2] / 6798137 - 0.0005 * q))
    u = F.col("u")
    m = m.withColumn("u_norm", F.sqrt(u[0] * u[0] + u[1] * u[1] + u[2] * u[2])).withColumn("boresight", F.array(*[u[i] / F.col("u_norm") for i in range(3)]))
    return m.withColumn("rotation", F.array(*[F.lit(float(i in (0, 4, 8))) for i in range(9)])).drop("u", "u_norm")


def errors(spark, sf_dir):
    return S.nadir_equivalent(matches(spark, sf_dir))


@query(f"WITH {MATCH} SELECT measurement, {rs('ns', 3)} AS ns_error_m, {rs('ew', 3)} AS ew_error_m, {rs('vp', 3)} AS vp_error_m, {rs('xvp', 3)} AS xvp_error_m, {rs('err', 3)} AS nadir_equiv_error_m FROM err")
def nadir_equivalent_errors(spark, sf_dir):
    e = errors(spark, sf_dir)
    return e.select("measurement", *[r(F.col(c), 3).alias(c) for c in ("ns_error_m", "ew_error_m", "vp_error_m", "xvp_error_m", "nadir_equiv_error_m")])


@query(f"WITH {MATCH} SELECT measurement, {rs('err', 3)} AS nadir_equiv_error_m, err < 250 AS within_threshold FROM err")
def verify_per_gcp(spark, sf_dir):
    """The flagship: nadir-equivalent error and verdict of every measurement."""
    return S.per_gcp(errors(spark, sf_dir)).select("measurement", r(F.col("nadir_equiv_error_m"), 3).alias("nadir_equiv_error_m"), "within_threshold")


_STATS = """count(err) AS num_measurements, round(avg(err), 3) AS mean_error_m, round(quantile_cont(err, 0.5), 3) AS median_error_m, round(sqrt(avg(err * err)), 3) AS rms_error_m, round(stddev_pop(err), 3) AS std_error_m,
round(min(err), 3) AS min_error_m, round(max(err), 3) AS max_error_m, """ + ", ".join(f"round(quantile_cont(err, {p / 100}), 3) AS p{p}_error_m" for p in (25, 75, 90, 95, 99)) + ", " + ", ".join(f"round(avg(CASE WHEN err < {t} THEN 100.0::DOUBLE ELSE 0 END), 6) AS percent_under_{t}m" for t in S.THRESHOLDS)  # fmt: skip


def _rounded(df):
    digits = lambda c: 6 if c.startswith("percent") else 3
    return df.select(*[F.round(c, digits(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(f"WITH {MATCH} SELECT {_STATS} FROM err")
def error_statistics(spark, sf_dir):
    return _rounded(S.statistics(errors(spark, sf_dir)))


@query(f"WITH {MATCH} SELECT l_suppkey, {_STATS} FROM err GROUP BY l_suppkey")
def error_statistics_by_source(spark, sf_dir):
    return _rounded(S.statistics(errors(spark, sf_dir), by=["l_suppkey"]))


@query("""SELECT l_returnflag, count(*) AS num_measurements, round(avg(e - 1e8::DOUBLE), 4) AS mean_error_m, round(stddev_pop(e), 4) AS std_error_m, round(min(e) - 1e8::DOUBLE, 4) AS min_error_m, round(max(e) - 1e8::DOUBLE, 4) AS max_error_m
  FROM (SELECT l_returnflag, 1e8::DOUBLE + (l_orderkey % 7) / 10.0::DOUBLE + l_linenumber / 100.0::DOUBLE AS e FROM lineitem) GROUP BY l_returnflag""")
def error_statistics_far_from_zero(spark, sf_dir):
    """Small spreads of large errors: a difference of means of squares would lose them."""
    e = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.lit(1e8) + F.col("l_orderkey") % 7 / 10.0 + F.col("l_linenumber") / 100.0).alias("nadir_equiv_error_m"))
    s = S.statistics(e, by=["l_returnflag"])
    return s.select("l_returnflag", "num_measurements", F.round("std_error_m", 4).alias("std_error_m"), *[F.round(F.col(c) - 1e8, 4).alias(c) for c in ("mean_error_m", "min_error_m", "max_error_m")])


@query(f"""WITH {MATCH}, p AS (SELECT count(*) AS num_measurements, avg(CASE WHEN err < 250 THEN 100.0::DOUBLE ELSE 0 END) AS w FROM err)
  SELECT w >= 39 AS passed, round(w, 6) AS percent_within, num_measurements, CASE WHEN w < 39 THEN printf('%.1f%% of measurements are below 250 m; 39%% are required', w) END AS warning FROM p""")
def verification_verdict(spark, sf_dir):
    v = S.verdict(errors(spark, sf_dir))
    return v.withColumn("percent_within", F.round("percent_within", 6))


@query(f"WITH {MATCH.replace('FROM lineitem)', 'FROM lineitem WHERE l_discount * 10 >= 0.5::DOUBLE)')} SELECT {_STATS} FROM err")
def statistics_after_correlation_filter(spark, sf_dir):
    """Measurements of too small a correlation left out first."""
    kept = S.filter_correlation(matches(spark, sf_dir), 0.5)
    return _rounded(S.statistics(S.nadir_equivalent(kept)))


@query(f"""WITH {MATCH}, a AS (SELECT avg(err) AS mean_error_m, sqrt(avg(err*err)) AS rms_error_m, max(err) AS max_error_m FROM err WHERE measurement % 2 = 0), c AS (SELECT avg(err) AS mean_error_m, sqrt(avg(err*err)) AS rms_error_m, max(err) AS max_error_m FROM err WHERE measurement % 2 = 1)
  SELECT metric, round(b, 3) AS before, round(d, 3) AS after, round(d - b, 3) + 0.0::DOUBLE AS change FROM (SELECT unnest(['mean_error_m', 'rms_error_m', 'max_error_m']) AS metric, unnest([a.mean_error_m, a.rms_error_m, a.max_error_m]) AS b, unnest([c.mean_error_m, c.rms_error_m, c.max_error_m]) AS d FROM a, c)""")
def compare_results(spark, sf_dir):
    e = errors(spark, sf_dir)
    got = S.compare(e.where("measurement % 2 = 0"), e.where("measurement % 2 = 1")).where(F.col("metric").isin("mean_error_m", "rms_error_m", "max_error_m"))
    return got.select("metric", F.round("before", 3).alias("before"), F.round("after", 3).alias("after"), r(F.col("change"), 3).alias("change"))


@query("""WITH a AS (SELECT 0 AS table_index, row_number() OVER (ORDER BY n_nationkey) - 1 AS measurement, n_name AS name, NULL::DOUBLE AS height FROM nation), b AS (SELECT 1 AS table_index, row_number() OVER (ORDER BY s_suppkey) - 1 AS measurement, s_name AS name, s_acctbal AS height FROM supplier)
  SELECT * FROM a UNION ALL SELECT * FROM b""")
def union_of_match_tables(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("measurement"), F.col("n_name").alias("name"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("measurement"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("height"))
    return S.union_matches(n, s).select("table_index", F.col("measurement").cast("long").alias("measurement"), "name", "height")


# --- sweeps --------------------------------------------------------------------------------------------------------

SWEEP = W.Sweep((W.Parameter("tilt", "constant", 10.0, (-5.0, 5.0), 2.0, "arcseconds"), W.Parameter("az", "offset", 0.0, (-30.0, 60.0), 10.0, "arcseconds", "value"), W.Parameter("clock", "time", 1.0, (-4.0, 4.0), 1.0, "milliseconds")))


@query(f"""WITH g AS (SELECT a, b, c FROM unnest([-5.0::DOUBLE, 0, 5]) x(a), unnest([-30.0::DOUBLE, 15, 60]) y(b), unnest([-4.0::DOUBLE, 0, 4]) z(c))
  SELECT row_number() OVER (ORDER BY a, b, c) - 1 AS param_idx, {rs('radians((10 + a) / 3600) * 1e6', 6)} AS tilt_urad, {rs('radians(b / 3600) * 1e6', 6)} AS az_urad, {rs('(1 + c) * 1e-3', 9)} AS clock_s FROM g""")
def parameter_grid(spark, sf_dir):
    s = W.parameter_sets(spark, SWEEP)
    return s.select("param_idx", r(F.col("tilt_pitch") * 1e6).alias("tilt_urad"), r(F.col("az") * 1e6).alias("az_urad"), r(F.col("clock"), 9).alias("clock_s"))


@query(f"""WITH o AS (SELECT 0 AS p, unnest([5.0::DOUBLE, 10, 15]) AS tilt, 0.0::DOUBLE AS az, 1.0::DOUBLE AS clock UNION ALL SELECT 1, 10, unnest([-30.0::DOUBLE, 15, 60]), 1 UNION ALL SELECT 2, 10, 0, unnest([-3.0::DOUBLE, 1, 5]))
  SELECT row_number() OVER (ORDER BY p, tilt, az, clock) - 1 AS param_idx, {rs('radians(tilt / 3600) * 1e6', 6)} AS tilt_urad, {rs('radians(az / 3600) * 1e6', 6)} AS az_urad, {rs('clock * 1e-3', 9)} AS clock_s FROM o""")
def single_offset_sets(spark, sf_dir):
    s = W.parameter_sets(spark, SWEEP.with_strategy("single"))
    return s.select("param_idx", r(F.col("tilt_roll") * 1e6).alias("tilt_urad"), r(F.col("az") * 1e6).alias("az_urad"), r(F.col("clock"), 9).alias("clock_s"))


@query()
def random_parameter_sets(spark, sf_dir):
    """Normal draws with bounded offsets, from a seed."""
    return W.parameter_sets(spark, W.Sweep(SWEEP.parameters, "random", 20, 3, 42))


@query("""WITH s AS (SELECT unnest(range(27)) AS param_idx) SELECT event_id, param_idx, epoch_us(ts) + CASE param_idx % 3 WHEN 0 THEN -3000 WHEN 1 THEN 1000 ELSE 5000 END AS ugps,
  round(value + radians(CASE (param_idx // 3) % 3 WHEN 0 THEN -30 WHEN 1 THEN 15 ELSE 60 END / 3600.0::DOUBLE), 9) AS value FROM events, s""")
def apply_offsets(spark, sf_dir):
    """Every set applied to telemetry: an angle added, times shifted."""
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    e = table(spark, sf_dir, "events").select("event_id", us.alias("ugps"), "value")
    all_ = W.expand(W.parameter_sets(spark, SWEEP), e)
    got = W.apply_offset(W.apply_offset(all_, SWEEP.parameters[1], F.col("az")), SWEEP.parameters[2], F.col("clock"))
    return got.select("event_id", "param_idx", "ugps", F.round("value", 9).alias("value"))


PAIRS = "pr AS (SELECT l_suppkey % 20 AS param_idx, l_partkey % 9 AS pair_idx, l_extendedprice / 100 AS e FROM lineitem)"


def pair_errors(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).alias("param_idx"), (F.col("l_partkey") % 9).alias("pair_idx"), (F.col("l_extendedprice") / 100).alias("nadir_equiv_error_m"))


@query(f"WITH {PAIRS} SELECT param_idx, pair_idx, count(*) AS n_measurements, round(avg(e), 4) AS mean_error_m, round(sqrt(avg(e*e)), 4) AS rms_error_m, round(stddev_pop(e), 4) AS std_error_m, round(min(e), 4) AS min_error_m, round(max(e), 4) AS max_error_m FROM pr GROUP BY ALL")
def sweep_pair_metrics(spark, sf_dir):
    got = W.pair_metrics(pair_errors(spark, sf_dir))
    return got.select("param_idx", "pair_idx", "n_measurements", *[F.round(c, 4).alias(c) for c in got.columns[3:]])


SETS = f"{PAIRS}, rm AS (SELECT param_idx, pair_idx, sqrt(avg(e*e)) AS rms FROM pr GROUP BY ALL), st AS (SELECT param_idx, avg(CASE WHEN rms < 570 THEN 100.0::DOUBLE ELSE 0 END) AS pct, avg(rms) AS m, min(rms) AS lo, max(rms) AS hi FROM rm GROUP BY param_idx)"


@query(f"WITH {SETS} SELECT param_idx, round(pct, 6) AS percent_under_570m, round(m, 4) AS mean_rms_m, round(lo, 4) AS best_pair_rms_m, round(hi, 4) AS worst_pair_rms_m FROM st")
def sweep_set_metrics(spark, sf_dir):
    got = W.set_metrics(W.pair_metrics(pair_errors(spark, sf_dir)), 570.0)
    return got.select("param_idx", F.round("percent_under_570m", 6).alias("percent_under_570m"), *[F.round(c, 4).alias(c) for c in got.columns[2:]])


@query(f"WITH {SETS} SELECT param_idx, round(m, 4) AS mean_rms_m, row_number() OVER (ORDER BY m, param_idx) AS rank FROM st QUALIFY rank <= 10")
def sweep_top_sets(spark, sf_dir):
    return W.top_sets(W.set_metrics(W.pair_metrics(pair_errors(spark, sf_dir)), 570.0)).select("param_idx", F.round("mean_rms_m", 4).alias("mean_rms_m"), "rank")


@query(f"""WITH {SETS} SELECT count(*) AS n_sets, arg_min(param_idx, m) AS best_param_idx, round(min(m), 4) AS best_rms_m, round(max(m), 4) AS worst_rms_m, round(avg(m), 4) AS mean_rms_all_m, round(max(pct), 6) AS best_percent, max(pct) >= 39 AS met_threshold,
  CASE WHEN max(pct) >= 39 THEN 'use the best set' ELSE 'widen the bounds or revise the calibration' END AS recommendation FROM st""")
def sweep_summary(spark, sf_dir):
    s = W.summary(W.set_metrics(W.pair_metrics(pair_errors(spark, sf_dir)), 570.0), 39.0, 570.0)
    return s.select("n_sets", "best_param_idx", *[F.round(c, 4).alias(c) for c in ("best_rms_m", "worst_rms_m", "mean_rms_all_m")], F.round("best_percent", 6).alias("best_percent"), "met_threshold", "recommendation")
