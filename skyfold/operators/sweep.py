"""Parameter sweeps: parameter sets, their application to telemetry, and the summary of their results."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyfold.functions.vec import not_nan


ARCSEC = np.pi / 180 / 3600
#: Times (uGPS) of the two rows of a constant attitude.
CONSTANT_TIMES = (0, 2209075218000000)


@dataclass(frozen=True)
class Parameter:
    """kind: constant (a fixed attitude of three angles), offset (added to a telemetry field), time (added to times)."""

    name: str
    kind: str
    current: float = 0.0
    bounds: tuple[float, float] = (0.0, 0.0)
    sigma: float = 0.0
    units: str = ""
    field: str | None = None

    def scale(self) -> float:
        """To radians or seconds; other units stay."""
        return {"arcseconds": ARCSEC, "milliseconds": 1e-3, "microseconds": 1e-6}.get(self.units, 1.0)


@dataclass(frozen=True)
class Sweep:
    parameters: tuple[Parameter, ...]
    strategy: str = "grid"
    iterations: int = 10
    points: int = 3
    seed: int | None = None

    def with_strategy(self, strategy: str) -> Sweep:
        return replace(self, strategy=strategy)

    def with_parameter(self, which: int | str, **changes) -> Sweep:
        """One parameter, by place, name or field, with other values."""
        hit = [i for i, p in enumerate(self.parameters) if which in (i, p.name, p.field)]
        if len(hit) != 1:
            raise KeyError(f"{which!r} names {len(hit)} parameters")
        return replace(self, parameters=tuple(replace(p, **changes) if i == hit[0] else p for i, p in enumerate(self.parameters)))


AXES = ("roll", "pitch", "yaw")


def grid_values(p: Parameter, n: int) -> list[float]:
    return [float(p.current * p.scale() + d * p.scale()) for d in np.linspace(*p.bounds, n)]


def _columns(p: Parameter) -> list[str]:
    return [f"{p.name}_{a}" for a in AXES] if p.kind == "constant" else [p.name]


def parameter_sets(spark: SparkSession, sweep: Sweep) -> DataFrame:
    """param_idx and one column a parameter (three for a constant attitude), in radians or seconds.

    grid: the product of all parameters' values, the last one fastest. single: each parameter's values with all others
    at their current ones. random: normal around the current values with offsets kept within bounds, drawn on the
    driver by numpy's legacy generator in order of iteration, parameter, axis, so that a seed gives known sets.
    """
    ps = sweep.parameters
    names = [c for p in ps for c in _columns(p)]
    if sweep.strategy == "grid":
        out, stride = spark.range(sweep.points ** len(ps)).withColumnRenamed("id", "param_idx"), sweep.points ** len(ps)
        for p in ps:
            stride //= sweep.points
            value = F.element_at(F.array(*[F.lit(v) for v in grid_values(p, sweep.points)]), (F.floor(F.col("param_idx") / stride) % sweep.points + 1).cast("int"))
            out = out.withColumns({c: value for c in _columns(p)})
        return out.select("param_idx", *names)
    now = {c: p.current * p.scale() for p in ps for c in _columns(p)}
    rows = []
    if sweep.strategy == "single":
        for p in ps:
            rows += [now | dict.fromkeys(_columns(p), v) for v in grid_values(p, sweep.points)]
    elif sweep.strategy == "random":
        rng = np.random.RandomState(sweep.seed)
        for _ in range(sweep.iterations):
            rows.append({c: (p.current + float(np.clip(rng.normal(0.0, p.sigma), *p.bounds))) * p.scale() for p in ps for c in _columns(p)})
    else:
        raise ValueError(f"unknown strategy {sweep.strategy!r}")
    return spark.createDataFrame([(i, *(r[c] for c in names)) for i, r in enumerate(rows)], ", ".join(["param_idx long", *(f"`{c}` double" for c in names)]))


def constant_attitude(sets: DataFrame, name: str) -> DataFrame:
    """Two rows a set: angles at the begin and the end of all times."""
    return sets.select("param_idx", F.explode(F.array(*[F.lit(t) for t in CONSTANT_TIMES])).alias("ugps"), *[F.col(f"{name}_{a}").alias(f"angle_{x}") for a, x in zip(AXES, "xyz", strict=True)])


def apply_offset(rows: DataFrame, p: Parameter, value: Column, time: str = "ugps") -> DataFrame:
    """Telemetry with a value (radians or seconds) of a parameter applied; a field that isn't there leaves rows as they are.

    Angles are converted once, when sets are made.
    """
    if p.kind == "time":
        return rows.withColumn(time, F.col(time) + F.rint(value * 1e6).cast("long"))
    return rows.withColumn(p.field, F.col(p.field) + value) if p.field in rows.columns else rows


def expand(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every parameter set with every image pair; the sets are a small table made by the driver's configuration."""
    return pairs.crossJoin(sets)


def pair_metrics(errors: DataFrame) -> DataFrame:
    """For each set and pair: count, mean, rms, std (population; 0 of one row), min, max."""
    e = F.col("nadir_equiv_error_m")
    return errors.groupBy("param_idx", "pair_idx").agg(F.count(e).alias("n_measurements"), F.avg(e).alias("mean_error_m"), F.sqrt(F.avg(e * e)).alias("rms_error_m"), F.stddev_pop(e).alias("std_error_m"), F.min(e).alias("min_error_m"), F.max(e).alias("max_error_m"))


def set_metrics(pairs: DataFrame, threshold_m: float = 250.0) -> DataFrame:
    """For each set over its pairs: percent under the threshold, mean, best and worst rms; pairs without a number don't count."""
    e = F.col("rms_error_m")
    ok = F.when(not_nan(e), e)
    return pairs.groupBy("param_idx").agg(
        F.coalesce(F.avg(F.when(ok.isNotNull(), F.when(ok < threshold_m, 100.0).otherwise(0.0))), F.lit(0.0)).alias(f"percent_under_{int(threshold_m)}m"), F.avg(ok).alias("mean_rms_m"), F.min(ok).alias("best_pair_rms_m"), F.max(ok).alias("worst_pair_rms_m")
    )


def top_sets(metrics: DataFrame, n: int = 10) -> DataFrame:
    """The n sets of the smallest mean rms, ties by index; sets without a number come last. The rank is from 1."""
    best = metrics.orderBy(F.col("mean_rms_m").asc_nulls_last(), "param_idx").limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("mean_rms_m").asc_nulls_last(), "param_idx")))


def summary(metrics: DataFrame, need_percent: float = 39.0, threshold_m: float = 250.0) -> DataFrame:
    """One row: best and worst set, mean of all, whether any set meets the requirement, and a recommendation."""
    v, name = F.col("mean_rms_m"), f"percent_under_{int(threshold_m)}m"
    ok = F.when(not_nan(v), v)
    got = metrics.agg(
        F.min(F.struct(ok.isNull(), ok.alias("v"), "param_idx")).alias("lo"), F.max(F.struct(ok.isNotNull(), ok.alias("v"), -F.col("param_idx"))).alias("hi"), F.avg(ok).alias("mean_rms_all_m"), F.max(F.col(name)).alias("best_percent"), F.count(F.lit(1)).alias("n_sets")
    )
    met = F.coalesce(F.col("best_percent") >= need_percent, F.lit(False))
    return got.select("n_sets", F.col("lo.param_idx").alias("best_param_idx"), F.col("lo.v").alias("best_rms_m"), F.col("hi.v").alias("worst_rms_m"), "mean_rms_all_m", "best_percent", met.alias("met_threshold"), F.when(met, "use the best set").otherwise("widen the bounds or revise the calibration").alias("recommendation"))


def to_arcseconds(radians: Column) -> Column:
    return F.degrees(radians) * 3600.0


