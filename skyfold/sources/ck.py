"""Attitude files of the DAF kind (C-kernels, type 3) as tables of intervals, and pointing at clock ticks.

A segment holds quaternions (reference frame to instrument, scalar first), with or without angular rates, at ticks of a spacecraft clock, and the
ticks at which intervals begin within which pointing is interpolated. Between intervals there is none, but an instance counts for
ticks around it within a tolerance. Where several segments have pointing for a tick, the one of the later file counts, and within a
file the later one; a segment that lacks rates is passed over where rates are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from skyfold.functions.vec import NAN
from skyfold.operators.rangejoin import points_in_intervals

from .spk import BATCH, summaries

SPAN = "file long, segment int, instrument int, frame int, rates boolean, t0 double, t1 double, q0 double, q1 double, q2 double, q3 double, w0 double, w1 double, w2 double, r0 double, r1 double, r2 double, r3 double, u0 double, u1 double, u2 double"
QUAT, RATE = ["q0", "q1", "q2", "q3"], ["w0", "w1", "w2"]


def _segment(words: np.ndarray, rates: bool) -> Iterator[tuple]:
    """(t0, t1, instance at t0, instance at t1) for each two neighbours within an interval, and (t, t, instance, instance) for each instance."""
    m, n = int(words[-2]), int(words[-1])
    size = 7 if rates else 4
    held = words[: size * n].reshape(n, size)
    if not rates:
        held = np.concatenate([held, np.full((n, 3), np.nan)], 1)
    ticks = words[size * n : (size + 1) * n]
    begins = words[(size + 1) * n + (n - 1) // 100 :][:m]
    own = np.searchsorted(begins, ticks, "right")  # the interval of each instance
    for i in range(n):
        yield ticks[i], ticks[i], held[i], held[i]
        if i + 1 < n and own[i] == own[i + 1]:
            yield ticks[i], ticks[i + 1], held[i], held[i + 1]


def _spans(schema: pa.Schema):
    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                file, content = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                found, order = summaries(content, b"DAF/CK")
                words = np.frombuffer(content[: len(content) // 8 * 8], order + "f8")
                rows: list[tuple] = []
                for s, (instrument, frame, kind, rates, _start, _stop, begin, end) in enumerate(found):
                    if kind == 3:
                        for t0, t1, a, b in _segment(words[begin - 1 : end].astype(float), bool(rates)):
                            rows.append((file, s, instrument, frame, bool(rates), t0, t1, *a, *b))
                            if len(rows) >= BATCH:
                                yield batch_of(rows)
                                rows = []
                if rows:
                    yield batch_of(rows)

    return run


def spans(files: DataFrame) -> DataFrame:
    """SPAN rows of files (file, content): each two neighbouring instances of an interval, q and w at t0, r and u at t1, and each instance alone (t0 = t1). Segments of other types are left out."""
    return files.select("file", "content").mapInArrow(_spans(to_arrow_schema(StructType.fromDDL(SPAN))), SPAN)


def pointing(times: DataFrame, held: DataFrame, tolerance: float = 0.0, with_rates: bool = False, bucket: float = 1e6) -> DataFrame:
    """times (instrument, tick, any others) with q0..q3, w0..w2 and tick_found; NaN where there is no pointing within the tolerance.

    Within an interval, at the tick itself: quaternions along the shorter arc, rates linearly. Else the nearest instance of a
    segment, at most tolerance away, at its own tick; the earlier of two equally near ones. Segments are asked in turn, the later first, each
    for both. with_rates: only segments that have rates. bucket is about the ticks between instances. Rows may repeat.
    """
    keys = ["instrument", "tick"]
    asked = times.select(F.col("instrument").cast("int").alias("instrument"), F.col("tick").cast("double").alias("tick")).distinct()
    own = held.where("rates") if with_rates else held
    alone = F.col("t0") == F.col("t1")
    wide = own.withColumns({"lo": F.when(alone, F.col("t0") - tolerance).otherwise(F.col("t0")), "hi": F.when(alone, F.col("t0") + tolerance).otherwise(F.col("t1"))}).drop("frame", "rates")
    met = points_in_intervals(asked, wide, "tick", "lo", "hi", bucket, ["instrument"], closed=True)
    off = F.when(alone, F.abs(F.col("tick") - F.col("t0"))).otherwise(F.lit(0.0))
    best = Window.partitionBy(*keys).orderBy(F.desc("file"), F.desc("segment"), off, "t0", "t1")
    used = met.withColumn("_n", F.row_number().over(best)).where("_n = 1")
    u = F.coalesce(F.try_divide(F.col("tick") - F.col("t0"), F.col("t1") - F.col("t0")), F.lit(0.0))
    used = used.withColumns({"_u": F.when(alone, 0.0).otherwise(u), "_dot": sum((F.col(f"q{k}") * F.col(f"r{k}") for k in (1, 2, 3)), F.col("q0") * F.col("r0"))})
    used = used.withColumns({"_angle": F.acos(F.least(F.lit(1.0), F.abs("_dot"))), "_sign": F.when(F.col("_dot") < 0, -1.0).otherwise(1.0)})
    flat = F.sin("_angle") < 1e-9
    share = lambda x: F.when(flat, x).otherwise(F.coalesce(F.try_divide(F.sin(x * F.col("_angle")), F.sin("_angle")), F.lit(0.0)))
    used = used.withColumns({"_a": share(1 - F.col("_u")), "_b": share(F.col("_u")) * F.col("_sign")})
    out = [(F.col("_a") * F.col(f"q{k}") + F.col("_b") * F.col(f"r{k}")).alias(f"_q{k}") for k in range(4)] + [(F.col(f"w{k}") * (1 - F.col("_u")) + F.col(f"u{k}") * F.col("_u")).alias(f"_w{k}") for k in range(3)]
    found = used.select(F.col("instrument").alias("_i"), F.col("tick").alias("_t"), *out, F.when(alone, F.col("t0")).otherwise(F.col("tick")).alias("_tick_found"))
    made = [*QUAT, *RATE, "tick_found"]
    joined = times.join(found, (F.col("instrument") == F.col("_i")) & (F.col("tick") == F.col("_t")), "left")
    return joined.select(*[c for c in times.columns if c not in made], *[F.coalesce(f"_{c}", F.lit(NAN)).alias(c) for c in made])


def type_three(ticks: np.ndarray, quaternions: np.ndarray, begins: np.ndarray, rates: np.ndarray | None = None) -> np.ndarray:
    """The words of a type 3 segment."""
    held = quaternions if rates is None else np.concatenate([quaternions, rates], 1)
    return np.concatenate([held.ravel(), ticks, ticks[99:-1:100], begins, begins[99:-1:100], [len(begins), len(ticks)]])
