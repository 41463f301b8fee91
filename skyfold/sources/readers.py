"""Sources: telemetry, kernels' inputs, rasters, elevation tiles, two-line elements, text kernels, meta-kernels."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfold.operators.segments import keep_latest


def read_table(spark: SparkSession, path: str, fmt: str, schema: str | None = None, time: str | None = None, time_scale: float = 1.0) -> DataFrame:
    """csv (with header), parquet, json or orc; the time column may be scaled. Other formats are an error.

    Without a schema csv columns are inferred, which reads the file once more.
    """
    if fmt not in ("csv", "parquet", "json", "orc"):
        raise ValueError(f"unsupported format {fmt!r}")
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("inferSchema", schema is None)
    df = (reader.schema(schema) if schema else reader).load(path)
    return df if time is None or time_scale == 1.0 else df.withColumn(time, F.col(time) * time_scale)


def kernel_input(df: DataFrame, columns: dict[str, str] | list[str] | None = None) -> DataFrame:
    """Project, or rename and project; then only rows without null and NaN."""
    if isinstance(columns, dict):
        df = df.select(*[F.col(a).alias(b) for a, b in columns.items()])
    elif columns:
        df = df.select(*columns)
    return df.dropna("any")


def pad_missing(df: DataFrame, wanted: list[str], value: float = 0.0) -> DataFrame:
    """The wanted columns in order; one that isn't there is constant."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(value).alias(c) for c in wanted])


def drop_zero_quaternions(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.where(sum((F.col(c) for c in columns[1:]), F.col(columns[0])) != 0)


def merge_telemetry(tables: list[DataFrame], key: str = "ert") -> DataFrame:
    """Full outer join of packets on their receipt time."""
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, key, "full_outer")
    return out


def split_time(seconds: str, fraction: str, unit: float):
    """Seconds and a count of parts of one (256 or 2**32 a second)."""
    return F.col(seconds) + F.col(fraction) / unit


def date_partitions(prefix: str, first: date, last: date) -> list[str]:
    """Paths prefix/YYYYMMDD/ of all days, both ends included."""
    return [f"{prefix.rstrip('/')}/{first + timedelta(i):%Y%m%d}/" for i in range((last - first).days + 1)]


def discover(spark: SparkSession, directory: str, pattern: str = "*") -> DataFrame:
    """path and length of all files below a directory, in order of path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(directory)
    return files.select("path", "length").orderBy("path")


def read_rasters(spark: SparkSession, directory: str, parse, schema: str, pattern: str = "*") -> DataFrame:
    """Files through a user's parser: parse(path, bytes) gives dicts of schema; a file it can't read gives none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(directory)
    kinds = spark.createDataFrame([], schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kinds.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                try:
                    rows = list(parse(r["path"], r["content"]))
                except (ValueError, KeyError, OSError):
                    rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.select("path", "content").mapInArrow(run, schema)


#: Fixed form of elevation tile names: latitude, longitude, date, source, statistic, resolution (3 digits = 7.5, 15, 30 arc seconds).
TILE_NAME = r"(\d{2})([ns])(\d{3})([ew])_(\d{8})_([a-z]+)_([a-z]{3})(\d{3})"


def describe_tiles(files: DataFrame, path: str = "path") -> DataFrame:
    """path, ll_lat, ll_lon, stat, arcsec from file names; others are left out."""
    part = lambda i: F.regexp_extract(path, TILE_NAME, i)
    sign = lambda i, minus: F.when(part(i) == minus, -1.0).otherwise(1.0)
    seconds = F.when(part(8) == "075", 7.5).otherwise(F.try_to_number(part(8), F.lit("999")).cast("double") / 10)
    named = files.where(F.col(path).rlike(TILE_NAME))
    return named.select(F.col(path), (F.try_to_number(part(1), F.lit("99")).cast("double") * sign(2, "s")).alias("ll_lat"), (F.try_to_number(part(3), F.lit("999")).cast("double") * sign(4, "w")).alias("ll_lon"), part(7).alias("stat"), seconds.alias("arcsec"))


def read_tle(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Two-line elements: names in lower case, for each object and epoch the row created last."""
    df = df.select(*[F.col(f"`{c}`").alias(c.lower()) for c in df.columns])
    out = keep_latest(df, [c for c in ("norad_cat_id", "epoch") if c in df.columns], [F.col("creation_date")])
    return out.select(*columns) if columns else out


#: Fixed operators of the element query address; le and ge don't exist there.
_OPS = {"eq": "", "ne": "<>", "lt": "<", "gt": ">", "in": "", "range": ""}


def tle_query(norad_ids: list[int], predicates: dict[str, tuple[str, object]] | None = None, columns: list[str] | None = None) -> str:
    """The part of a query address after its base, from {column: (operator, value)}; without predicates the latest element."""
    parts = ["class/gp_history", f"NORAD_CAT_ID/{','.join(map(str, norad_ids))}"]
    for name, (op, value) in (predicates or {}).items():
        if op not in _OPS:
            raise ValueError(f"operator {op!r} is not supported")
        text = ",".join(map(str, value)) if op == "in" else "--".join(map(str, value)) if op == "range" else str(value)
        parts.append(f"{name.upper()}/{_OPS[op]}{text}")
    if not predicates:
        parts += ["limit/1", "orderby/EPOCH asc"]
    if columns:
        parts.append(f"predicates/{','.join(c.upper() for c in columns)}")
    return "/".join([*parts, "format/json"])


def parse_leap_seconds(text: str) -> list[tuple[int, str]]:
    """(TAI - UTC, ISO date) pairs of the DELTA_AT assignment of a leap-second text kernel."""
    months = {m: i + 1 for i, m in enumerate("JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split())}
    found = re.findall(r"(\d+),\s*@(\d{4})-([A-Z]{3})-(\d+)", text)
    return [(int(n), f"{y}-{months[m]:02d}-{int(d):02d}") for n, y, m, d in found]


def meta_kernel(path_or_text: str) -> dict:
    """Mappings and kernel lists of a meta-kernel document, lists always."""
    doc = json.loads(path_or_text) if path_or_text.lstrip().startswith("{") else json.load(open(path_or_text))
    return {"mappings": doc.get("mappings", {}), **{k: [*doc.get(k, [])] if not isinstance(doc.get(k), dict) else list(doc[k].values()) for k in ("mission_kernels", "sds_kernels")}}


class tables:
    """Temporary views over stores while a block runs: with tables(spark, {"ephemeris": path})."""

    def __init__(self, spark: SparkSession, paths: dict[str, str]):
        self.spark, self.paths = spark, paths

    def __enter__(self):
        for name, path in self.paths.items():
            self.spark.read.parquet(path).createOrReplaceTempView(name)
        return self

    def __exit__(self, *exc):
        for name in reversed(self.paths):
            self.spark.catalog.dropTempView(name)


def loaded(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables() if t.isTemporary)
