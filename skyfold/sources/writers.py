"""Sinks: guarded inserts, sweep results with resumable pairs, text kernels and element files, raster summaries."""

from __future__ import annotations

import json
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_behaviour(exists: bool, overwrite: bool, append: bool) -> str:
    """Save mode of a kernel table; overwrite and append together are an error, and so is an existing table without either."""
    if overwrite and append:
        raise ValueError("overwrite and append exclude each other")
    if exists and not (overwrite or append):
        raise FileExistsError("the table exists")
    return "overwrite" if overwrite else "append" if append else "errorifexists"


def append_new(rows: DataFrame, path: str, key: list[str]) -> int:
    """Append rows to a parquet table unless any of their keys is there already; returns the number written, counted after."""
    spark = rows.sparkSession
    try:
        have = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        have = rows.limit(0)
    if rows.join(have.select(*key), key, "left_semi").limit(1).count():
        raise ValueError("rows with these keys exist")
    before, new = have.count(), rows.count()
    rows.write.mode("append").parquet(path)
    after = spark.read.parquet(path).count()
    if after - before != new:
        raise RuntimeError(f"wrote {after - before} of {new} rows")
    return new


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on a local master only, an own one where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder or tempfile.mkdtemp(prefix="results-")


def write_pair_results(results: DataFrame, path: str) -> None:
    """One partition a pair, so a run that broke off goes on with the pairs that are missing."""
    results.write.mode("append").partitionBy("pair_idx").parquet(path)


def unfinished(spark: SparkSession, pairs: DataFrame, path: str) -> DataFrame:
    """Pairs without a finished partition (all, if there is none)."""
    try:
        done = spark.read.parquet(path).select("pair_idx").distinct()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return pairs
    return pairs.join(done, "pair_idx", "left_anti")


def write_with_attributes(df: DataFrame, path: str, attributes: dict) -> None:
    """A parquet table whose columns carry the attributes as metadata."""
    first = df.columns[0]
    df.withMetadata(first, {"attributes": json.dumps(attributes)}).write.mode("overwrite").parquet(path)


def attributes(df: DataFrame) -> dict:
    return json.loads(df.schema[0].metadata.get("attributes", "{}"))


def text_kernel_issues(lines: DataFrame, text: str = "value") -> DataFrame:
    """All columns and the reasons (array, not empty) of lines that a text kernel must not have.

    Over 132 characters, a double quote, characters outside 32-126 (tabs apart), or a quoted string over 80 characters.
    """
    c = F.col(text)
    strings = F.transform(F.regexp_extract_all(c, F.lit("'([^']*)'"), 1), lambda s: F.length(s) > 80)
    checks = [(F.length(c) > 132, "line over 132 characters"), (c.contains('"'), "double quote"), (c.rlike(r"[^\x20-\x7E\t]"), "not printable ASCII"), (F.exists(strings, lambda b: b), "string over 80 characters")]
    return lines.withColumn("issues", F.filter(F.array(*[F.when(cond, F.lit(msg)) for cond, msg in checks]), lambda x: x.isNotNull())).where("size(issues) > 0")


def tle_lines(elements: DataFrame) -> DataFrame:
    """The lines of an element file in order of epoch: value."""
    rows = elements.select("epoch", F.posexplode(F.array("tle_line1", "tle_line2")).alias("n", "value")).orderBy("epoch", "n")
    return rows.select("value")


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def raster_attributes(cells: DataFrame, key: str = "image_id") -> DataFrame:
    """valid_count, valid_min and valid_max of each raster; NaN is not valid."""
    v = F.when(~F.isnan("value"), F.col("value"))
    return cells.groupBy(key).agg(F.count(v).alias("valid_count"), F.min(v).alias("valid_min"), F.max(v).alias("valid_max"))


def separable(cells: DataFrame, key: str = "image_id") -> DataFrame:
    """Whether an image's coordinates are two axes (each row one latitude, each column one longitude)."""
    per_row = cells.groupBy(key, "row").agg((F.min("lat") == F.max("lat")).alias("ok"))
    per_col = cells.groupBy(key, "col").agg((F.min("lon") == F.max("lon")).alias("ok"))
    return per_row.select(key, "ok").unionByName(per_col.select(key, "ok")).groupBy(key).agg(F.bool_and("ok").alias("separable"))
