"""Running values along long series, and joins of points and windows in time, without a task that holds a whole key.

A series is cut into ranges of its order (by quantiles, as many as its size asks for). Within a range, a window function
runs; what earlier ranges of the key bring along is one row for each key and range, and is joined to the range. So the
largest task is a range's, however many rows a key has. Keys of few rows (all but those of crowded()) need none of this: they
take one exchange by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranks import durable

#: Rows of a range, about, and most ranges (the bounds are an array on the driver).
ROWS_PER_RANGE, MOST_RANGES = 200_000, 4096
#: Pairs of a key that may be tried for each of its rows; keys of more are numbered, so that only pairs that meet are made.
PAIRS_PER_ROW = 64


def bounds_of(df: DataFrame, column: str, rows_per_range: int | None = None) -> list:
    """Ascending bounds that cut a numeric column into ranges of about so many rows (null and NaN aside)."""
    x = F.col(column)
    good = F.when(~F.isnan(x), x) if dict(df.dtypes)[column] in ("double", "float") else x
    n, got = df.agg(F.count(good), F.percentile_approx(good, [i / MOST_RANGES for i in range(1, MOST_RANGES)], 5 * MOST_RANGES)).first()
    ranges = min(MOST_RANGES, n // (rows_per_range or ROWS_PER_RANGE) + 1)
    return sorted({got[i * MOST_RANGES // ranges - 1] for i in range(1, ranges)}) if ranges > 1 else []


def range_of(value: Column, bounds: list) -> Column:
    """How many of the bounds a value reaches, by bisection; NaN reaches all, null none."""
    if not bounds:
        return F.lit(0)
    held, start = F.lit(bounds), F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))

    def half(s: Column, v: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        below = (s["lo"] < s["hi"]) & F.coalesce(F.get(held, mid) <= v, F.lit(False))
        return F.struct(F.when(below, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(below | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"))

    steps = F.array(*[value] * (len(bounds).bit_length() + 1)) if len(bounds) > 1 else F.array(value, value)
    return F.aggregate(steps, start, half, lambda s: s["lo"])


_OVER = {"max": F.max, "sum": F.sum}
_BOTH = {"max": F.greatest, "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))}


def same(left: list[Column], right: list[Column]) -> Column:
    """Null-safe equality of keys; true without any."""
    out = F.lit(True)
    for a, b in zip(left, right, strict=True):
        out = out & a.eqNullSafe(b)
    return out


def crowded(sides: list[DataFrame], on: list[str]) -> DataFrame | None:
    """Keys with more than ROWS_PER_RANGE rows on a side, or of two sides with more than PAIRS_PER_ROW pairs a row; None if there is none.

    The sides are read: they are durable, or cheap to read. Keys are counted exactly, within tasks before any exchange.
    """
    names = [f"_n{i}" for i in range(len(sides))]
    each = [df.select(*on, *[F.lit(int(i == k)).cast("long").alias(n) for k, n in enumerate(names)]) for i, df in enumerate(sides)]
    n = [F.col(c).cast("double") for c in names]
    many = F.greatest(*n, F.lit(0.0)) > ROWS_PER_RANGE
    if len(n) == 2:
        many = many | (n[0] * n[1] > PAIRS_PER_ROW * (n[0] + n[1]))
    rows = each[0] if len(each) == 1 else each[0].unionByName(each[1])
    keys = durable(rows.groupBy(*on).agg(*[F.sum(c).alias(c) for c in names]).where(many).select(*[F.col(c).alias(f"_k_{c}") for c in on], F.lit(True).alias("_crowded")))
    return None if keys.isEmpty() else keys


def divided(rows: DataFrame, keys: DataFrame | None, on: list[str]) -> tuple[DataFrame | None, DataFrame | None]:
    """Rows of the other keys, and rows of these; None where there can't be any."""
    if keys is None or not on:
        return (rows, None) if keys is None else (None, rows)
    meet = same([F.col(c) for c in on], [F.col(f"_k_{c}") for c in on])
    return rows.join(keys, meet, "left_anti"), rows.join(keys, meet, "left_semi")


def both(one: DataFrame | None, two: DataFrame | None) -> DataFrame:
    return one.unionByName(two) if one is not None and two is not None else one if one is not None else two


def running(rows: DataFrame, by: list[str], order: list[str], bounds: list, kind: str, value: Column, name: str, inclusive: bool = True) -> DataFrame:
    """rows with the running max or sum of a value in each key, up to the row or up to the one before it.

    order: the first column is numeric, and bounds cut its values into ranges. Ties of all of order are in any order.
    """
    last = 0 if inclusive else -1
    cut = rows.withColumns({"_v": value, "_range": range_of(F.col(order[0]), bounds)})
    own = _OVER[kind]("_v").over(Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, last))
    if not bounds:
        return cut.withColumn(name, F.coalesce(own, F.lit(0)) if kind == "sum" else own).drop("_v", "_range")
    totals = cut.groupBy(*by, "_range").agg(_OVER[kind]("_v").alias("_t"))
    before = _OVER[kind]("_t").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    carried = totals.select(*[F.col(b).alias(f"_k_{b}") for b in by], F.col("_range").alias("_r"), before.alias("_carried"))
    on = same([F.col(b) for b in by], [F.col(f"_k_{b}") for b in by]) & (F.col("_range") == F.col("_r"))
    out = cut.withColumn("_own", own).join(carried, on).withColumn(name, _BOTH[kind](F.col("_own"), F.col("_carried")))
    return out.select(*[c for c in rows.columns if c != name], name)


def _within(points: DataFrame, spans: DataFrame, on: list[str], open_start: bool) -> DataFrame:
    """Pairs of points (on, p, m) and spans (on, a, b, n; each once) with a <= p <= b, or a < p <= b: on, p, m, a, b, n.

    m, n and further columns of both go along. Points are numbered in each key by p; a span's points are then the numbers between
    the counts of points below its start and up to its stop. Only the pairs themselves become rows.
    """
    order = ["_x", "_t"]  # at equal places: counts below, then points, then counts up to and with them
    none = lambda c, df: F.lit(None).cast(df.schema[c].dataType).alias(c)
    keys = [F.col(c) for c in on]
    p_cols, s_cols = [c for c in points.columns if c not in on], [c for c in spans.columns if c not in on]
    held = points.select(*keys, F.col("p").alias("_x"), F.lit(1).alias("_t"), *p_cols, *[none(c, spans) for c in s_cols])
    first = spans.select(*keys, F.col("a").alias("_x"), F.lit(2 if open_start else 0).alias("_t"), *[none(c, points) for c in p_cols], *s_cols)
    ends = spans.select(*keys, F.col("b").alias("_x"), F.lit(3).alias("_t"), *[none(c, points) for c in p_cols], *s_cols)
    events = held.unionByName(first).unionByName(ends)
    numbered = running(events, on, order, bounds_of(events, "_x"), "sum", (F.col("_t") == 1).cast("long"), "_n")
    ranked = numbered.where("_t = 1").select(*[F.col(c).alias(f"_k_{c}") for c in on], F.col("_n").alias("_rank"), *p_cols)
    asked = numbered.where("_t <> 1").groupBy(*on, *s_cols).agg(F.min("_n").alias("_lo"), F.max("_n").alias("_hi")).where("_hi > _lo")
    wanted = asked.withColumn("_number", F.explode(F.sequence(F.col("_lo") + 1, F.col("_hi"))))
    meet = F.col("_number") == F.col("_rank")
    for c in on:
        meet = meet & (F.col(c) == F.col(f"_k_{c}"))
    return wanted.join(ranked, meet).select(*on, *p_cols, *s_cols)


def overlaps(left: DataFrame, right: DataFrame, on: list[str], held: bool = False) -> DataFrame:
    """Each two windows (start, stop) of a key that share a point or more: on, start, stop, r_start, r_stop.

    Windows that stop before they start, or have a null end, meet nothing; a null key is equal to none. Keys of few windows are
    joined, crowded ones are numbered. held: both sides are durable already.
    """
    sides = [df.select(*on, F.col("start").alias("a"), F.col("stop").alias("b")).where("a <= b") for df in (left, right)]
    sides = sides if held else [durable(s) for s in sides]  # read several times
    keys = crowded(sides, on)
    (few, many), (r_few, r_many) = (divided(s, keys, on) for s in sides)
    return both(_joined(few, r_few, on) if few is not None else None, _numbered(many, r_many, on) if many is not None else None)


def _joined(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """overlaps() by one exchange of each side."""
    right = right.select(*[F.col(c).alias(f"_k_{c}") for c in on], F.col("a").alias("r_start"), F.col("b").alias("r_stop"))
    meet = (F.col("a") <= F.col("r_stop")) & (F.col("r_start") <= F.col("b"))
    for c in on:
        meet = meet & (F.col(c) == F.col(f"_k_{c}"))
    return left.join(right, meet).select(*on, F.col("a").alias("start"), F.col("b").alias("stop"), "r_start", "r_stop")


def _numbered(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """overlaps() of series of any length.

    Either the right window starts within the left one, or the left one starts later and within the right one. Equal windows
    are matched once and repeated as often as they occur.
    """
    sides = [durable(w.groupBy(*on, "a", "b").agg(F.count(F.lit(1)).alias("n"))) for w in (left, right)]  # read several times
    a, b = sides
    starts = [s.select(*on, F.col("a").alias("p"), F.col("b").alias("q"), F.col("n").alias("m")) for s in sides]
    one = _within(starts[1], a, on, False).select(*on, F.col("a").alias("start"), F.col("b").alias("stop"), F.col("p").alias("r_start"), F.col("q").alias("r_stop"), (F.col("m") * F.col("n")).alias("_times"))
    two = _within(starts[0], b, on, True).select(*on, F.col("p").alias("start"), F.col("q").alias("stop"), F.col("a").alias("r_start"), F.col("b").alias("r_stop"), (F.col("m") * F.col("n")).alias("_times"))
    return one.unionByName(two).withColumn("_times", F.explode(F.sequence(F.lit(1).cast("long"), "_times"))).drop("_times")
