"""Global row numbers and exact percentiles without bringing a table, or a group, into one task.

Values are dealt to buckets between approximate quantiles (BUCKETS of them, a bounded driver array). Counts of the
buckets tell the number of the first row of each; only inside a bucket are rows ordered.
"""

from __future__ import annotations

import math
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKETS = 200


def bucket_of(df: DataFrame, column: str, buckets: int = BUCKETS) -> Column:
    """Number of the bounds that a value reaches (null: 0). NaN is above all numbers."""
    got = df.agg(F.percentile_approx(column, [i / buckets for i in range(1, buckets)], 50 * buckets)).first()[0] or []
    bounds = F.lit([float(b) if isinstance(b, float) else b for b in sorted(set(got), key=lambda b: (isinstance(b, float) and math.isnan(b), b))]) if got else None
    if bounds is None:
        return F.lit(0)
    # Through an array of one, so that a column that is a long expression is evaluated once, not for each bound.
    # Never null, so that joins on it infer no filter, which would be pushed down with all of the column's expression.
    return F.coalesce(F.element_at(F.transform(F.array(F.col(column)), lambda v: F.size(F.filter(bounds, lambda b: b <= v))), 1), F.lit(0))


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """df with its rows' numbers from 0 in order of a numeric column; ties in the order of a hash of the whole row."""
    placed = df.withColumn("_bucket", bucket_of(df, order))
    counts = placed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    first = counts.withColumn("_first", F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).select("_bucket", "_first")  # BUCKETS rows
    inside = Window.partitionBy("_bucket").orderBy(order, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    out = placed.withColumn("_i", F.row_number().over(inside)).join(F.broadcast(first), "_bucket")
    return out.withColumn(name, (F.col("_first") + F.col("_i") - 1).cast("int")).select(*[c for c in df.columns if c != name], name)


def shared_folder(spark: SparkSession) -> str:
    """This session's folder for checkpoints in spark.checkpoint.dir. On a local master an own one is made where none is set."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="skyfold-"))
    return spark.sparkContext.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """df checkpointed in the shared folder: its lineage ends there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def value_counts(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """keys, _v and _c: how often each value occurs for each key, counted before any exchange.

    The counts are checkpointed: they are read several times, and a value that is a long expression would be planned anew each time.
    """
    counts = df.groupBy(*[F.col(f"`{k}`") for k in keys], F.col(column).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"), F.count(column).alias("_valid"))
    return durable(counts)


def percentiles(counts: DataFrame, shares: list[float], by: list[str] | None = None) -> DataFrame:
    """For each key (or in one row): `percentiles`, the exact ones of the values that are not null, interpolated linearly; NaN is largest.

    counts: as by value_counts(). Only the buckets that hold a rank asked for are ordered.
    """
    by = by or []
    keys = [F.col(f"`{b}`").alias(f"_k{i}") for i, b in enumerate(by)] or [F.lit(0).alias("_k0")]
    names = [f"_k{i}" for i in range(len(keys))]
    values = counts.where("_valid > 0").select(*keys, "_v", "_c").withColumn("_b", bucket_of(counts, "_v"))
    sizes = values.groupBy(*names, "_b").agg(F.sum("_c").alias("_s"))
    group = Window.partitionBy(*names)
    upto = F.sum("_s").over(group.orderBy("_b"))
    sizes = sizes.select(*names, "_b", F.sum("_s").over(group).alias("_n"), (upto - F.col("_s")).alias("_before"), upto.alias("_upto"))
    ranks = F.array(*[F.lit(float(p)) for p in shares])
    at = F.transform(ranks, lambda p, i: F.struct(i.alias("i"), F.floor(p * (F.col("_n") - 1)).alias("low"), F.ceil(p * (F.col("_n") - 1)).alias("high"), (p * (F.col("_n") - 1)).alias("x")))
    need = sizes.withColumn("_at", F.filter(at, lambda a: ((a["low"] >= F.col("_before")) & (a["low"] < F.col("_upto"))) | ((a["high"] >= F.col("_before")) & (a["high"] < F.col("_upto"))))).where("size(_at) > 0")
    near = values.join(need.select(*[F.col(n).alias(f"{n}_") for n in names], F.col("_b").alias("_b_"), "_before", "_at"), [*[F.col(n).eqNullSafe(F.col(f"{n}_")) for n in names], F.col("_b") == F.col("_b_")])
    end = F.col("_before") + F.sum("_c").over(Window.partitionBy(*names, "_b").orderBy("_v"))
    near = near.withColumn("_end", end).withColumn("_a", F.explode("_at"))
    weight = lambda r, other: F.when((F.col(f"_a.{r}") >= F.col("_end") - F.col("_c")) & (F.col(f"_a.{r}") < F.col("_end")), other)
    share = F.col("_a.x") - F.col("_a.low")
    part = F.coalesce(weight("low", 1 - share), F.lit(0.0)) + F.coalesce(weight("high", share), F.lit(0.0))
    hit = near.withColumn("_w", part).where((F.col("_w") > 0) | weight("low", F.lit(True)).isNotNull())
    each = hit.groupBy(*names, F.col("_a.i").alias("_i")).agg(F.sum(F.when(F.col("_w") > 0, F.col("_w") * F.col("_v"))).alias("_p"))
    out = each.groupBy(*names).agg(F.array_sort(F.collect_list(F.struct("_i", "_p"))).alias("_ps"))  # len(shares) rows a key
    return out.select(*[F.col(f"_k{i}").alias(b) for i, b in enumerate(by)], F.transform("_ps", lambda s: s["_p"]).alias("percentiles"))
