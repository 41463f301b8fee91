"""Queries of time scales, over event and shipping times (which cross leap seconds)."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyfold.functions import constants as K
from skyfold.functions import timeconv as T

from .registry import query, r, rs, table

_ROWS = ", ".join(f"({n}, {u}, {g}, {o})" for n, u, g, o in T.leap_rows())
LEAP = f"leap(nsec, unix, ugps, shift) AS (VALUES {_ROWS})"
#: Shipping times as uGPS, by the last leap row not after them.
SHIP = f"""{LEAP}, ship AS (SELECT l_orderkey, l_linenumber, l_shipdate, epoch_us(l_shipdate) + l_linenumber * 1234567 AS u FROM lineitem),
g AS (SELECT s.*, u - shift AS ugps, leap.nsec FROM ship s ASOF JOIN leap ON s.u >= leap.unix)"""


def shipping(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    ts = F.col("l_shipdate").cast("timestamp_ntz") + F.make_dt_interval(secs=(F.col("l_linenumber") * 1.234567).cast("decimal(18,6)"))
    return rows.select("l_orderkey", "l_linenumber", ts.alias("ts")).withColumn("ugps", T.adapt(F.col("ts"), "dt64", "ugps"))


@query(f"WITH {SHIP} SELECT l_orderkey, l_linenumber, ugps FROM g")
def ugps_from_datetime(spark, sf_dir):
    return shipping(spark, sf_dir).select("l_orderkey", "l_linenumber", "ugps")


@query(f"WITH {SHIP} SELECT l_orderkey, l_linenumber, u AS unix_us FROM g")
def datetime_from_ugps(spark, sf_dir):
    """There and back: the SQL gives the original times."""
    back = T.adapt(F.col("ugps"), "ugps", "dt64")
    return shipping(spark, sf_dir).select("l_orderkey", "l_linenumber", F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), back).alias("unix_us"))


@query(f"WITH {LEAP}, t AS (SELECT event_id, 504489610000000 + (event_id - 5000) * 317 AS ugps FROM events), j AS (SELECT t.*, t.ugps + shift AS u, nxt FROM t ASOF JOIN (SELECT *, lead(ugps) OVER (ORDER BY ugps) AS nxt FROM leap) l ON t.ugps >= l.ugps) SELECT event_id, CASE WHEN nxt - ugps < 1000000 THEN u - (1000000 - (nxt - ugps)) ELSE u END AS unix_us FROM j")
def datetime_within_leap_second(spark, sf_dir):
    """Microseconds around a leap second; within it, the next whole second."""
    e = table(spark, sf_dir, "events").select("event_id", (F.lit(504489610000000) + (F.col("event_id") - 5000) * 317).alias("ugps"))
    return e.select("event_id", T.ugps_to_unix_us(F.col("ugps")).alias("unix_us"))


@query(f"WITH {SHIP} SELECT l_orderkey, l_linenumber, {rs('(ugps - (nsec - 19) * 1000000)::DOUBLE / 8.64e10', 9)} AS gps_days FROM g")
def gps_days(spark, sf_dir):
    return shipping(spark, sf_dir).select("l_orderkey", "l_linenumber", r(T.adapt(F.col("ugps"), "ugps", "gpsd"), 9).alias("gps_days"))


@query(f"WITH {SHIP} SELECT l_orderkey, l_linenumber, 0 AS off_by_3_us FROM g")
def ugps_from_gps_days(spark, sf_dir):
    """Through fractional days (of about 0.2 us) and back: how many times 3 us the result is off."""
    days = T.adapt(F.col("ugps"), "ugps", "gpsd")
    back = T.adapt(days, "gpsd", "ugps")
    return shipping(spark, sf_dir).select("l_orderkey", "l_linenumber", F.floor(F.abs(back - F.col("ugps")) / 3).cast("int").alias("off_by_3_us"))


_EPOCHS = ["jd", "mjd", "sorce", "tcte", "tsis", "tsis2", "ctim"]


@query(f"WITH {SHIP} SELECT l_orderkey, l_linenumber, " + ", ".join(f"{rs(f'(ugps - (nsec - 19) * 1000000)::DOUBLE / 8.64e10 - ({K.EPOCH_DAYS[e]}::DOUBLE)', 6)} AS {e}" for e in _EPOCHS) + " FROM g")
def epoch_days(spark, sf_dir):
    return shipping(spark, sf_dir).select("l_orderkey", "l_linenumber", *[r(T.adapt(F.col("ugps"), "ugps", e), 6).alias(e) for e in _EPOCHS])


_TAI = "(ugps::DOUBLE / 1e6 - 630763181 + 32.184::DOUBLE)"
_M = f"(6.239996::DOUBLE + 1.99096871e-7::DOUBLE * {_TAI})"
_ET = f"{_TAI} + 1.657e-3::DOUBLE * sin({_M} + 1.671e-2::DOUBLE * sin({_M}))"


@query(f"WITH {SHIP} SELECT l_orderkey, l_linenumber, {rs(_ET, 4)} AS et FROM g")
def ephemeris_time(spark, sf_dir):
    return shipping(spark, sf_dir).select("l_orderkey", "l_linenumber", r(T.adapt(F.col("ugps"), "ugps", "et"), 4).alias("et"))


@query(f"WITH {SHIP} SELECT l_orderkey, l_linenumber, {rs('ugps::DOUBLE / 1e6', 4)} AS gps, {rs('ugps::DOUBLE / 1e6 + 694656019', 4)} AS tai, 0 AS et_off, 0 AS tai_off, 0 AS gps_off FROM g")
def seconds_scales(spark, sf_dir):
    """ugps -> et -> gps and tai; and those back to ugps: how many times 3 us each is off."""
    s = shipping(spark, sf_dir).withColumn("et", T.adapt(F.col("ugps"), "ugps", "et"))
    off = lambda c: F.floor(F.abs(c - F.col("ugps")) / 3).cast("int")
    s = s.withColumns({"tai_": T.adapt(F.col("et"), "et", "tai"), "gps_": T.adapt(F.col("et"), "et", "gps")})
    return s.select(
        "l_orderkey", "l_linenumber", r(F.col("gps_"), 4).alias("gps"), r(F.col("tai_"), 4).alias("tai"),
        off(T.adapt(F.col("et"), "et", "ugps")).alias("et_off"), off(T.adapt(F.col("tai_"), "tai", "ugps")).alias("tai_off"), off(T.adapt(F.col("gps_"), "gps", "ugps")).alias("gps_off"),
    )


@query(f"WITH {SHIP} SELECT l_orderkey, l_linenumber, strftime(make_timestamp(u), '%Y-%m-%d %H:%M:%S.%f') AS utc, ugps FROM g")
def utc_strings(spark, sf_dir):
    """uGPS to text, and the text parsed again."""
    s = shipping(spark, sf_dir).select("l_orderkey", "l_linenumber", T.ugps_to_utc(F.col("ugps")).alias("utc"))
    return s.withColumn("ugps", T.utc_to_ugps(F.col("utc")))


@query("SELECT 504489610000000 + u AS ugps, CASE WHEN u >= 1000000 THEN '1996-01-01 00:00:00.' ELSE '1995-12-31 23:59:60.' END || lpad((u % 1000000)::VARCHAR, 6, '0') AS utc FROM (SELECT (event_id % 8000) * 250 AS u FROM events)")
def utc_leap_second_strings(spark, sf_dir):
    """Second 60 appears within a leap second, and is understood."""
    e = table(spark, sf_dir, "events").select((F.lit(504489610000000) + F.col("event_id") % 8000 * 250).alias("ugps"))
    s = e.select(T.ugps_to_utc(F.col("ugps")).alias("utc"))
    return s.select(T.utc_to_ugps(F.col("utc")).alias("ugps"), "utc")


@query(f"WITH {LEAP} SELECT nsec, unix, ugps, shift FROM leap")
def leap_second_table(spark, sf_dir):
    return T.leap_table(spark).withColumnRenamed("offset", "shift")


@query("SELECT unnest(range(1000000000000000, 1000000600000000, 67000)) AS ugps")
def time_grid(spark, sf_dir):
    return T.time_grid(spark, 1000000000000000, 1000000600000000, 67000)


@query("SELECT event_id, event_id * 65536.0::DOUBLE / 65536.0::DOUBLE + 100 AS et, round(value * 65536.0::DOUBLE, 3) AS ticks FROM events")
def spacecraft_clock(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", T.ticks_to_et(F.col("event_id") * 65536.0, start_et=100.0).alias("et"), F.round(T.et_to_ticks(F.col("value") + 100.0, start_et=100.0), 3).alias("ticks"))
