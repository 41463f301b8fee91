"""Ephemeris and attitude lookups: interpolated as-of joins over tables of samples.

state tables: object_id, ugps, x, y, z, vx, vy, vz. attitude tables: frame, ugps, q0..q3 (scalar first, frame to parent).
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyfold.functions import constants as K
from skyfold.functions.vec import NAN, Matrix, Vec, apply, product, safe_div, transpose

from .rangejoin import points_in_intervals

STATE = ["x", "y", "z", "vx", "vy", "vz"]
QUAT = ["q0", "q1", "q2", "q3"]


def spans(samples: DataFrame, key: str, values: list[str], max_gap_us: int | None) -> DataFrame:
    """Each sample with its follower as an interval [t0, t1); gaps longer than max_gap_us are not covered. The last sample covers its own time."""
    w = Window.partitionBy(key).orderBy("ugps")
    nxt = {f"{c}_1": F.lead(c).over(w) for c in ["ugps", *values]}
    rows = samples.select(key, F.col("ugps").alias("t0"), *[F.col(c).alias(f"{c}_0") for c in values], *[v.alias("t1" if c == "ugps_1" else c) for c, v in nxt.items()])
    open_ = F.col("t1").isNull() | (F.lit(max_gap_us is not None) & (F.col("t1") - F.col("t0") > F.lit(max_gap_us or 0)))
    rows = rows.withColumn("_end", open_)
    return rows.withColumns({f"{c}_1": F.when(F.col("_end"), F.col(f"{c}_0")).otherwise(F.col(f"{c}_1")) for c in values} | {"t1": F.when(F.col("_end"), F.col("t0") + 1).otherwise(F.col("t1"))}).drop("_end")


def hermite(u: Column, h: Column, p0: Column, v0: Column, p1: Column, v1: Column) -> tuple[Column, Column]:
    """Cubic value and derivative at fraction u of an interval of h seconds."""
    a = p0 * (1 + 2 * u) * (1 - u) * (1 - u) + p1 * u * u * (3 - 2 * u) + h * (v0 * u * (1 - u) * (1 - u) - v1 * u * u * (1 - u))
    b = safe_div(6 * u * (1 - u) * (p1 - p0), h) + v0 * (1 - u) * (1 - 3 * u) + v1 * u * (3 * u - 2)
    return a, b


def query_ephemeris(times: DataFrame, states: DataFrame, max_gap_us: int | None = None, bucket_us: int = 60_000_000) -> DataFrame:
    """times (object_id, ugps, any others) with x..vz by cubic Hermite interpolation, NaN where no samples enclose the time."""
    joined = points_in_intervals(times, spans(states, "object_id", STATE, max_gap_us), "ugps", "t0", "t1", bucket_us, ["object_id"], "left")
    h = (F.col("t1") - F.col("t0")).cast("double") / 1e6
    u = (F.col("ugps") - F.col("t0")).cast("double") / (F.col("t1") - F.col("t0"))
    out = []
    for a in "xyz":
        p, v = hermite(u, h, F.col(f"{a}_0"), F.col(f"v{a}_0"), F.col(f"{a}_1"), F.col(f"v{a}_1"))
        out += [(a, F.when(F.col("ugps") == F.col("t0"), F.col(f"{a}_0")).otherwise(p)), (f"v{a}", F.when(F.col("ugps") == F.col("t0"), F.col(f"v{a}_0")).otherwise(v))]
    return joined.select(*[F.col(c) for c in times.columns], *[F.coalesce(c, F.lit(NAN)).alias(n) for n, c in sorted(out, key=lambda x: STATE.index(x[0]))])


def query_attitude(times: DataFrame, attitudes: DataFrame, max_gap_us: int | None = None, bucket_us: int = 60_000_000) -> DataFrame:
    """times (frame, ugps, any others) with q0..q3 by spherical interpolation along the shorter arc, NaN outside."""
    joined = points_in_intervals(times, spans(attitudes, "frame", QUAT, max_gap_us), "ugps", "t0", "t1", bucket_us, ["frame"], "left")
    u = (F.col("ugps") - F.col("t0")).cast("double") / (F.col("t1") - F.col("t0"))
    dot = sum((F.col(f"{c}_0") * F.col(f"{c}_1") for c in QUAT[1:]), F.col("q0_0") * F.col("q0_1"))
    sign = F.when(dot < 0, -1.0).otherwise(1.0)
    angle = F.acos(F.least(F.lit(1.0), F.abs(dot)))
    flat = F.sin(angle) < 1e-9
    w0 = F.when(flat, 1 - u).otherwise(safe_div(F.sin((1 - u) * angle), F.sin(angle)))
    w1 = F.when(flat, u).otherwise(safe_div(F.sin(u * angle), F.sin(angle))) * sign
    return joined.select(*[F.col(c) for c in times.columns], *[F.coalesce(w0 * F.col(f"{c}_0") + w1 * F.col(f"{c}_1"), F.lit(NAN)).alias(c) for c in QUAT])


def nearest_within(times: DataFrame, samples: DataFrame, key: str, tolerance_us: int) -> DataFrame:
    """Discrete lookup: the sample nearest to each time, at most tolerance away (the earlier of two); none: null columns."""
    windows = samples.withColumns({"lo": F.col("ugps") - tolerance_us, "hi": F.col("ugps") + tolerance_us}).withColumnRenamed("ugps", "sample_ugps")
    near = points_in_intervals(times.withColumn("_id", F.monotonically_increasing_id()), windows, "ugps", "lo", "hi", max(1, 2 * tolerance_us), [key], "left", closed=True)
    w = Window.partitionBy("_id").orderBy(F.abs(F.col("ugps") - F.col("sample_ugps")).asc_nulls_last(), "sample_ugps")
    return near.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_id", "lo", "hi")


def frame_path(graph: dict[str, str], from_: str, to: str) -> list[tuple[str, bool]]:
    """Steps from a frame to another in a graph of child: parent; (child, True) goes up to its parent, (child, False) down from it."""
    near: dict[str, list[tuple[str, tuple[str, bool]]]] = {}
    for child, parent in graph.items():
        near.setdefault(child, []).append((parent, (child, True)))
        near.setdefault(parent, []).append((child, (child, False)))
    queue, seen = deque([(from_, [])]), {from_}
    while queue:
        at, steps = queue.popleft()
        if at == to:
            return steps
        for nxt, step in near.get(at, []):
            if nxt not in seen:
                seen.add(nxt)
                queue.append((nxt, [*steps, step]))
    raise ValueError(f"frames {from_} and {to} are not connected")


def frame_rotation(graph: dict[str, str], matrices: dict[str, Matrix], from_: str, to: str) -> Matrix:
    """Rotation expression along the path; matrices: child to parent."""
    one, zero = F.lit(1.0), F.lit(0.0)
    out: Matrix = (Vec(one, zero, zero), Vec(zero, one, zero), Vec(zero, zero, one))
    for child, upward in frame_path(graph, from_, to):
        out = product(matrices[child] if upward else transpose(matrices[child]), out)
    return out


def pixel_states(times: DataFrame, pixels: DataFrame) -> DataFrame:
    """Every time with every pixel (1-based); pixels is a small instrument table, one row a detector element."""
    return times.crossJoin(pixels)


def quality(missing_state: Column, missing_attitude: Column, miss: Column) -> Column:
    """Flags of a geolocated pixel, OR-combined."""
    bit = lambda c, name: F.when(c, K.QUALITY_FLAGS[name]).otherwise(0).cast("long")
    data = missing_state | missing_attitude
    return (
        bit(missing_state, "SPICE_ERR_MISSING_EPHEMERIS").bitwiseOR(bit(missing_attitude, "SPICE_ERR_MISSING_ATTITUDE")).bitwiseOR(bit(data, "CALC_ELLIPS_INSUFF_DATA")).bitwiseOR(bit(miss & ~data, "CALC_ELLIPS_NO_INTERSECT"))
    )


def rotate(m: Matrix, v: Vec) -> Vec:
    return apply(m, v)
