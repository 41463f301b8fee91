"""Time scales as Column expressions, composed along the shortest path of a graph of formats.

uGPS: whole microseconds since 1980-01-06, counting leap seconds. et: seconds of ephemeris time since J2000. gps, tai:
seconds since 1980-01-06 and 1958. dt64: timestamps without zone (no leap seconds). gpsd, jd, mjd, sorce, ...: days
since an epoch. utc, iso: strings, whose second may be 60.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import constants as K

_UNIX0 = date(1970, 1, 1)


def leap_rows() -> list[tuple[int, int, int, int]]:
    """(TAI - UTC in s, unix, ugps, offset), the last three in microseconds; unix = ugps + offset from there on."""
    out = []
    for n, day in K.LEAP_SECONDS:
        unix = (date.fromisoformat(day) - _UNIX0).days * K.US_PER_DAY
        offset = K.GPS_EPOCH_UNIX_DAYS * K.US_PER_DAY - (n - K.LEAP_SECONDS_AT_GPS_EPOCH) * 1_000_000
        out.append((n, unix, unix - offset, offset))
    return out


def leap_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(leap_rows(), "nsec int, unix long, ugps long, offset long")


def _last(column: Column, at: int, value: Callable[[tuple], int], rows: list[tuple] | None = None) -> Column:
    """Value of the last leap row whose field `at` is not above column (the first row before all): a balanced decision tree."""
    rows = rows or leap_rows()

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(value(rows[low])).cast("long")
        mid = (low + high + 1) // 2
        return F.when(column >= rows[mid][at], tree(mid, high)).otherwise(tree(low, mid - 1))

    return tree(0, len(rows) - 1)


def _to_next_leap(ugps: Column) -> Column:
    """Microseconds to the end of the next leap second (far away after the last one)."""
    ends = [r[2] for r in leap_rows()][1:] + [1 << 61]
    rows = [(r[2], e) for r, e in zip(leap_rows(), ends, strict=True)]
    return _last(ugps, 0, lambda r: r[1], rows) - ugps


def _in_leap(ugps: Column) -> Column:
    """Microseconds by which a time within a leap second lies past its begin, in (0, 1e6); 0 elsewhere."""
    return F.greatest(F.lit(0).cast("long"), 1_000_000 - _to_next_leap(ugps)) * F.when(ugps >= leap_rows()[0][2], 1).otherwise(0)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value evaluated once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def ugps_to_unix_us(ugps: Column) -> Column:
    """Within a leap second: the next whole second."""
    return ugps + _last(ugps, 2, lambda r: r[3]) - _in_leap(ugps)


def unix_us_to_ugps(unix: Column) -> Column:
    return unix - _last(unix, 1, lambda r: r[3])


def ugps_to_dt64(ugps: Column) -> Column:
    unix = ugps_to_unix_us(ugps)
    return F.timestamp_micros(unix).cast("timestamp_ntz")


def dt64_to_ugps(ts: Column) -> Column:
    ts = ts.cast("timestamp_ntz")
    return unix_us_to_ugps(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts))


def ugps_to_gpsd(ugps: Column) -> Column:
    leap = _last(ugps, 2, lambda r: (r[0] - K.LEAP_SECONDS_AT_GPS_EPOCH) * 1_000_000)
    return (ugps - leap - _in_leap(ugps)).cast("double") / float(K.US_PER_DAY)


def gpsd_to_ugps(days: Column) -> Column:
    """Rounded half to even."""
    whole = F.rint(days * float(K.US_PER_DAY)).cast("long")
    rows = [(g - (n - K.LEAP_SECONDS_AT_GPS_EPOCH) * 1_000_000, (n - K.LEAP_SECONDS_AT_GPS_EPOCH) * 1_000_000) for n, _, g, _ in leap_rows()]
    return whole + _last(whole, 0, lambda r: r[1], rows)


def _eccentric(et: Column) -> Column:
    m = K.DELTET_M0 + K.DELTET_M1 * et
    return K.DELTET_K * F.sin(m + K.DELTET_EB * F.sin(m))


def _tai_to_et(tai: Column) -> Column:
    """TAI seconds since J2000 to ephemeris time. One fixed-point step: the next would change it by less than 1e-12 s."""
    return tai + K.DELTA_T_A + _eccentric(tai + K.DELTA_T_A)


def _et_to_tai(et: Column) -> Column:
    return et - K.DELTA_T_A - _eccentric(et)


def _seconds_to_et(offset: int):
    return lambda s: _tai_to_et(s.cast("double") - float(offset))


def ugps_to_et(ugps: Column) -> Column:
    return _tai_to_et(ugps.cast("double") / 1e6 - float(K.GPS_MINUS_J2000_S))


def et_to_ugps(et: Column) -> Column:
    return F.rint((_et_to_tai(et) + float(K.GPS_MINUS_J2000_S)) * 1e6).cast("long")


def utc_to_ugps(text: Column) -> Column:
    """ISO strings `YYYY-MM-DD[T ]HH:MM:SS[.f]` or a bare date; second 60 is legal; null where the form is another."""
    shape = r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}):(\d{2})(?::(\d{2})(\.\d+)?)?)?Z?$"
    part = lambda i: F.regexp_extract(text, shape, i)
    number = lambda i: F.coalesce(F.try_to_number(F.when(part(i) == "", "0").otherwise(part(i)), F.lit("99")).cast("long"), F.lit(0))
    day = F.datediff(F.to_date(F.when(part(1) == "", F.lit(None)).otherwise(part(1))), F.lit("1970-01-01").cast("date")).cast("long")
    micros = F.rint(F.coalesce(F.when(part(5) == "", F.lit("0")).otherwise(F.concat(F.lit("0"), part(5))).cast("double"), F.lit(0.0)) * 1e6).cast("long")
    second = number(4)
    whole = day * K.US_PER_DAY + (number(2) * 3600 + number(3) * 60 + F.least(second, F.lit(59))) * 1_000_000 + micros
    return F.when(text.rlike(shape), let(whole, unix_us_to_ugps) + F.when(second == 60, 1_000_000).otherwise(0))


def ugps_to_utc(ugps: Column) -> Column:
    """`YYYY-MM-DD HH:MM:SS.ffffff`; second 60 within a leap second."""
    left = _to_next_leap(ugps)
    inside = F.when((left > 0) & (left <= 1_000_000), 1_000_000 - left)
    shown = F.when(inside.isNotNull(), ugps + left - 1_000_000 - 1_000_000 + _last(ugps, 2, lambda r: r[3])).otherwise(ugps_to_unix_us(ugps))
    text = F.date_format(F.timestamp_micros(shown).cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return F.when(inside.isNotNull(), F.concat(F.substring(text, 1, 17), F.lit("60."), F.lpad(inside.cast("string"), 6, "0"))).otherwise(text)


def ticks_to_et(ticks: Column, per_second: float = 65536.0, start_et: float = 0.0) -> Column:
    """Linear spacecraft clock."""
    return ticks / per_second + start_et


def et_to_ticks(et: Column, per_second: float = 65536.0, start_et: float = 0.0) -> Column:
    return (et - start_et) * per_second


def _days(epoch: str, sign: int):
    return lambda d: d + sign * K.EPOCH_DAYS[epoch]


#: format -> {format: function of a Column}; the driver walks it, the chain is one expression.
GRAPH: dict[str, dict[str, Callable[[Column], Column]]] = {
    "et": {
        "ugps": et_to_ugps,
        "gps": lambda c: _et_to_tai(c) + float(K.GPS_MINUS_J2000_S),
        "tai": lambda c: _et_to_tai(c) + float(K.GPS_MINUS_J2000_S - K.TAI_1958_MINUS_J2000_S),
        "utc": lambda c: let(et_to_ugps(c), ugps_to_utc),
        "iso": lambda c: let(et_to_ugps(c), ugps_to_utc),
    },
    "ugps": {"et": ugps_to_et, "dt64": ugps_to_dt64, "gpsd": ugps_to_gpsd},
    "gps": {"et": _seconds_to_et(K.GPS_MINUS_J2000_S)},
    "tai": {"et": _seconds_to_et(K.GPS_MINUS_J2000_S - K.TAI_1958_MINUS_J2000_S)},
    "utc": {"et": lambda c: let(utc_to_ugps(c), ugps_to_et)},
    "iso": {"et": lambda c: let(utc_to_ugps(c), ugps_to_et)},
    "dt64": {"ugps": dt64_to_ugps},
    "gpsd": {"ugps": gpsd_to_ugps} | {e: _days(e, -1) for e in K.EPOCH_DAYS if e not in ("gps", "tsis1")},
} | {e: {"gpsd": _days(e, 1)} for e in K.EPOCH_DAYS if e not in ("gps", "tsis1")}
GRAPH["tsis"]["tsis1"] = lambda c: c
GRAPH["tsis1"] = {"tsis": lambda c: c}
#: Formats that may be converted to themselves only by way of another: their text form is normalised.
_THROUGH = {"utc", "iso"}


def path(graph: dict, start: str, end: str) -> list[Callable[[Column], Column]]:
    """Functions along the shortest path, breadth first in order of definition."""
    for name in (start, end):
        if name not in graph:
            raise ValueError(f"unknown time format {name!r}; known: {', '.join(graph)}")
    if start == end and start not in _THROUGH:
        return []
    queue, seen = deque([(start, [])]), set()
    while queue:
        at, steps = queue.popleft()
        for to, f in graph[at].items():
            if to == end:
                return [*steps, f]
            if to not in seen:
                seen.add(to)
                queue.append((to, [*steps, f]))
    raise ValueError(f"no path from {start} to {end}")


def adapt(column: Column, from_: str | None = None, to: str | None = None) -> Column:
    """Convert between any two formats; one that is not given is ugps, but not both."""
    if from_ is None and to is None:
        raise ValueError("give from_ or to")
    steps = path(GRAPH, from_ or "ugps", to or "ugps")
    return reduce(let, steps[1:], steps[0](column)) if steps else column


def time_grid(spark: SparkSession, start: int, stop: int, cadence: int) -> DataFrame:
    """uGPS from start to before stop in even steps."""
    return spark.range(start, stop, cadence).withColumnRenamed("id", "ugps")
