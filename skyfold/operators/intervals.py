"""Interval algebra of coverage windows: rows (object_id, start, stop), both ends belong to the window."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import scan
from .ranks import durable

COVERAGE_TYPES = ("SPK", "CK", "PCK")


def merge(windows: DataFrame, by: list[str]) -> DataFrame:
    """Windows of each key that overlap or touch become one: by, start, stop. A crowded key's windows are divided by time."""
    held = durable(windows.select(*by, "start", "stop"))  # read several times
    few, many = scan.divided(held, scan.crowded([held], by), by)
    return scan.both(_merge_few(few, by) if few is not None else None, _merge_many(many, by) if many is not None else None)


def _merge_few(windows: DataFrame, by: list[str]) -> DataFrame:
    """merge() by one exchange, a key in a task."""
    order = Window.partitionBy(*by).orderBy("start", F.col("stop").desc_nulls_last())
    seen = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    again = (F.row_number().over(order) > 1) & F.lag("start").over(order).eqNullSafe(F.col("start"))
    marked = windows.withColumn("_n", (~again & (seen.isNull() | (F.col("start") > seen))).cast("long"))
    marked = marked.withColumn("_i", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "_i").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_i")


def _merge_many(windows: DataFrame, by: list[str]) -> DataFrame:
    longest = durable(windows.groupBy(*by, "start").agg(F.max("stop").alias("stop")))  # also leaves no ties in the order; read several times
    bounds = scan.bounds_of(longest, "start")
    seen = scan.running(longest, by, ["start"], bounds, "max", F.col("stop"), "_b", inclusive=False)
    new = (F.col("_b").isNull() | (F.col("start") > F.col("_b"))).cast("long")
    marked = scan.running(seen, by, ["start"], bounds, "sum", new, "_i")
    return marked.groupBy(*by, "_i").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_i")


def intersect(left: DataFrame, right: DataFrame, on: list[str], held: bool = False) -> DataFrame:
    """Common parts of each pair of windows of a key; touching windows share a point. Only pairs that meet become rows. held: both sides are durable already."""
    return scan.overlaps(left, right, on, held).select(*on, F.greatest("start", "r_start").alias("start"), F.least("stop", "r_stop").alias("stop"))


def _ends(kind: str) -> tuple[Column, Column]:
    """What lies before and after all times of a type."""
    if kind in ("double", "float"):
        return F.lit(float("-inf")), F.lit(float("inf"))
    return F.lit(-(2**63)).cast("long"), F.lit(2**63 - 1).cast("long")


def complement(windows: DataFrame, by: list[str]) -> DataFrame:
    """What the windows of each key that has any leave out, from the first of all times to the last: by, start, stop."""
    merged = merge(windows, by)
    kind = dict(merged.dtypes)["stop"]
    kind = kind if kind in ("double", "float") else "long"
    first, last = _ends(kind)
    merged = durable(merged.select(*by, F.col("start").cast(kind).alias("start"), F.col("stop").cast(kind).alias("stop")))  # read several times
    before = scan.running(merged, by, ["start"], scan.bounds_of(merged, "start"), "max", F.col("stop"), "_b", inclusive=False)
    heads = before.select(*by, F.coalesce("_b", first).alias("start"), F.col("start").alias("stop"))
    tails = merged.groupBy(*by).agg(F.max("stop").alias("start")).select(*by, "start", last.alias("stop"))
    return heads.unionByName(tails)


def gaps(windows: DataFrame, requests: DataFrame, by: list[str], error: bool = False, with_request: bool = False, held: bool = False) -> DataFrame:
    """Parts of each request (by, start, stop) that its key's windows don't cover; parts without length are left out.

    A key may have several requests, that may overlap; equal ones count once. with_request adds request_start and
    request_stop. Times are whole or floating numbers; if either side has fractions, so do the gaps. A request that stops before it
    starts is an error of the whole query; with error, so is any gap. held: the windows are durable already.
    """
    kinds = {dict(df.dtypes)[c] for df in (windows, requests) for c in ("start", "stop")}
    kind = "double" if kinds & {"double", "float"} or any(k.startswith("decimal") for k in kinds) else "long"
    stop = F.when(F.col("stop") < F.col("start"), F.raise_error(F.lit("a request stops before it starts")).cast(kind)).otherwise(F.col("stop").cast(kind))
    asked = durable(requests.select(*by, F.col("start").cast(kind).alias("start"), stop.alias("stop")).distinct())
    windows = windows.select(*by, F.col("start").cast(kind).alias("start"), F.col("stop").cast(kind).alias("stop"))
    windows = windows if held else durable(windows)
    keys = scan.crowded([windows, asked], by)
    (few, many), (ask_few, ask_many) = (scan.divided(df, keys, by) for df in (windows, asked))
    got = scan.both(_free_few(few, ask_few, by, kind) if few is not None else None, _free_many(many, ask_many, by) if many is not None else None)
    asks = [F.col("start").alias("request_start"), F.col("stop").alias("request_stop")] if with_request else []
    got = got.select(*by, F.greatest("start", "r_start").alias("_low"), F.least("stop", "r_stop").alias("_high"), *asks).where("_low < _high").withColumnsRenamed({"_low": "start", "_high": "stop"})
    if error:  # in a column, not in a filter, which would be moved below joins
        text = F.concat(F.lit("a request is not covered from "), F.col("start").cast("string"), F.lit(" to "), F.col("stop").cast("string"))
        got = got.withColumn("start", F.raise_error(text).cast(kind))
    return got


def _free_few(windows: DataFrame, asked: DataFrame, by: list[str], kind: str) -> DataFrame:
    """Requests and the free times they meet: by, start, stop, r_start, r_stop. Windows and requests are exchanged once, by key."""
    order, (first, last) = Window.partitionBy(*by).orderBy("start"), _ends(kind)
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    merged = _merge_few(windows, by).withColumns({"_b": before, "_last": F.lead(F.lit(1)).over(order).isNull()})
    head = F.struct(F.coalesce("_b", first).alias("r_start"), F.col("start").alias("r_stop"))
    tail = F.struct(F.greatest("_b", "stop").alias("r_start"), last.alias("r_stop"))
    free = merged.select(*[F.col(b).alias(f"_k_{b}") for b in by], F.lit(True).alias("_has"), F.inline(F.when(F.col("_last"), F.array(head, tail)).otherwise(F.array(head))))
    pairs = asked.join(free, [F.col(b) == F.col(f"_k_{b}") for b in by], "left") if by else asked.crossJoin(free)
    bare = F.col("_has").isNull()
    meets = (F.col("r_start") <= F.col("r_stop")) & (F.col("start") <= F.col("r_stop")) & (F.col("r_start") <= F.col("stop"))
    pairs = pairs.where(bare | meets)
    return pairs.select(*by, "start", "stop", *[F.when(bare, F.col(c)).otherwise(F.col(f"r_{c}")).alias(f"r_{c}") for c in ("start", "stop")])


def _free_many(windows: DataFrame, asked: DataFrame, by: list[str]) -> DataFrame:
    bare = asked.join(windows.select(*[F.col(b).alias(f"_k_{b}") for b in by]).distinct(), [F.col(b) == F.col(f"_k_{b}") for b in by], "left_anti") if by else asked.limit(0)
    return scan.overlaps(asked, complement(windows, by), by).unionByName(bare.select(*by, "start", "stop", F.col("start").alias("r_start"), F.col("stop").alias("r_stop")))


def rollup(segments: DataFrame, by: list[str]) -> DataFrame:
    """First start and last stop of each key."""
    return segments.groupBy(*by).agg(F.min("start").alias("start"), F.max("stop").alias("stop"))


def kernel_candidates(catalog: DataFrame) -> DataFrame:
    """Segments of the kinds that have coverage."""
    return catalog.where(F.col("ktype").isin(*COVERAGE_TYPES))


def kernel_catalog(catalog: DataFrame) -> DataFrame:
    """One row a kernel: its kind and the objects in it."""
    return kernel_candidates(catalog).groupBy("file", "ktype").agg(F.sort_array(F.collect_set("object_id")).alias("object_ids"))


def object_coverage(catalog: DataFrame) -> DataFrame:
    """Merged windows of each object over all kernels."""
    return merge(kernel_candidates(catalog), ["object_id"])


def valid_window(catalog: DataFrame, object_ids: list) -> DataFrame:
    """Windows in which all objects are covered: start, stop."""
    own = object_coverage(catalog).where(F.col("object_id").isin(*object_ids))
    each = [own.where(F.col("object_id") == i).select("start", "stop") for i in object_ids]
    return reduce(lambda a, b: intersect(a, b, []), each)


def missing_objects(catalog: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted objects (object_id, null where a name has no id) without coverage, and why."""
    has = kernel_candidates(catalog).select("object_id").distinct()
    why = F.when(F.col("object_id").isNull(), "could not be resolved").otherwise("no kernel contains it")
    return wanted.join(has, "object_id", "left_anti").select("object_id", why.alias("reason"))


def pairwise_overlap(catalog: DataFrame, file_a: str, file_b: str, object_id) -> DataFrame:
    own = kernel_candidates(catalog).where(F.col("object_id") == object_id)
    a, b = (merge(own.where(F.col("file") == f).select("start", "stop"), []) for f in (file_a, file_b))
    return intersect(a, b, [])
