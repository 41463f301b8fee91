"""Shared plumbing: durable cut points, Bloom filters of checked size, components of a link graph."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


#: Rows that a Python worker gets at once: whole texts are large, and both sides hold a batch.
_BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package also when the session was not started from the repository."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if REPO not in paths and REPO not in os.environ.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join([REPO, *paths])
    if int(spark.conf.get(_BATCH, "10000")) > BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder for cut points: spark.checkpoint.dir, or on a local master only, an own one where it is unset."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if got:
        return got.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="skyfold-cut-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


#: Cut points of this driver that were not dropped yet.
_held: dict[str, SparkSession] = {}


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor costs no recomputation.

    Operators drop() what their result does not read. The rest is needed until the result is read; clear() deletes
    it, at the latest when the driver's interpreter ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    _held[path] = spark
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def drop(*tables: DataFrame) -> None:
    """Delete cut points that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_cut_path", None)
        if path in _held:
            _delete(_held.pop(path), path)


def clear() -> None:
    """Delete all cut points that are left. Results of operators that were not read before can't be read after."""
    while _held:
        path, spark = _held.popitem()
        if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
            _delete(spark, path)


atexit.register(clear)


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Sizes of a Bloom filter, in bits: 8 a key, between these (8 KB and 8 MB). Beyond the larger, keys are joined instead.
BLOOM_LEAST, BLOOM_MOST = 1 << 16, 1 << 26


_PIECE = 256


def _bits_of(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    k = keys.view(np.uint64)
    return tuple((words.mix(k ^ np.uint64(salt)) >> np.uint64(36)).astype(np.int64) % size for salt in (0x51ED270B, 0xA24BAED4))


def _set_bits(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for column in batch.columns:
                keys = np.ascontiguousarray((column.flatten() if pa.types.is_list(column.type) else column).drop_null().to_numpy(zero_copy_only=False).astype(np.int64))
                if len(keys):
                    held = np.zeros(size, bool) if held is None else held
                    for b in _bits_of(keys, size):
                        held[b] = True
        if held is not None:
            rows = np.packbits(held, bitorder="little").reshape(-1, _PIECE)
            some = np.flatnonzero(rows.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([rows[i].tobytes() for i in some], pa.binary())], names=["piece", "bits"])

    return run


def _union(key, table):
    rows = np.frombuffer(b"".join(table["bits"].to_pylist()), np.uint8).reshape(-1, _PIECE)
    return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.bitwise_or.reduce(rows, 0).tobytes()], pa.binary())})


def bloom(keys: DataFrame) -> np.ndarray | None:
    """Bloom filter of all columns (longs, or arrays of longs); None where more than BLOOM_MOST bits would be needed.

    keys is a cut point or cheap to read: it is counted first. Each task sends its bits once.
    """
    each = [F.size(c) if t.startswith("array") else F.lit(1) for c, t in keys.dtypes]
    n = keys.agg(F.coalesce(F.sum(sum((x.cast("long") for x in each[1:]), each[0].cast("long"))), F.lit(0))).first()[0]
    size = max(BLOOM_LEAST, 1 << int(8 * n).bit_length())
    if size > BLOOM_MOST:
        return None
    rows = keys.mapInArrow(_set_bits(size), "piece int, bits binary").groupBy("piece").applyInArrow(_union, "piece int, bits binary").collect()
    out = np.zeros((size // 8 // _PIECE, _PIECE), np.uint8)
    for piece, bits in rows:
        out[piece] = np.frombuffer(bits, np.uint8)
    return out.ravel().view(np.uint64)


def may_hold(bits: np.ndarray, keys: pa.Array) -> pa.Array:
    """Mask of the keys that the filter may hold; it is never false for one that it does."""
    k = np.ascontiguousarray(keys.to_numpy(zero_copy_only=False).astype(np.int64))
    one, two = ((bits[b >> 6] >> (b & 63).astype(np.uint64)) & np.uint64(1) for b in _bits_of(k, len(bits) * 64))
    return pa.array((one & two).astype(bool))


def divide(rows: DataFrame, key: str, keys: DataFrame, among: tuple | None = None, others: tuple | None = None) -> tuple[DataFrame, DataFrame]:
    """Two parts of rows: one that holds all rows whose key (a long, never null) is among keys, and the others.

    A Bloom filter of a checked size decides where the keys fit one: without an exchange, and a few other rows pass for
    keys. Where they don't, a join decides, exactly. Either way each row is in one part. among, others: what becomes of
    that part, a function for mapInArrow and its schema; it runs in the Python worker that divides, as every task with
    two Python operators in a row would hold two workers, and an executor's memory is that of all its workers.
    """
    bits = bloom(keys)
    if bits is None:
        flat = [keys.select((F.explode(c) if t.startswith("array") else F.col(c)).alias(key)) for c, t in keys.dtypes]
        named = flat[0]
        for more in flat[1:]:
            named = named.unionByName(more)
        named = named.distinct()
        both = [(rows.join(named, key, how).select(*rows.columns), then) for how, then in (("left_semi", among), ("left_anti", others))]
        return tuple(part.mapInArrow(*then) if then else part for part, then in both)
    held = rows.sparkSession.sparkContext.broadcast(bits)
    at = rows.columns.index(key)

    def part(wanted: bool, then: tuple | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                mask = may_hold(held.value, batch.column(at))
                yield batch.filter(mask if wanted else pc.invert(mask))

        if then is None:
            return rows.mapInArrow(run, rows.schema)
        made, schema = then
        return rows.mapInArrow(lambda batches: made(run(batches)), schema)

    return part(True, among), part(False, others)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (id, component), where component is the smallest id reachable.

    Min-label propagation with pointer jumping; the number of rounds grows with the logarithm of the longest
    chain. Every round is cut to the shared folder. Hot vertices are split by adaptive skew joins. No edges: no rows.
    """
    pairs = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).where("x <> y")
    both = cut(pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    label = cut(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("id"), F.least("x", "m").alias("c")))
    while True:
        seen = both.join(label.select(F.col("id").alias("y"), "c"), "y").groupBy("x").agg(F.min("c").alias("m"))
        step = label.join(seen, label.id == seen.x).select("id", F.least("c", "m").alias("n"), "c")
        jump = step.select(F.col("id").alias("k"), F.col("n").alias("nn"))
        new = cut(step.join(jump, step.n == jump.k, "left").select("id", F.least("n", F.coalesce("nn", "n")).alias("c"), F.col("c").alias("old")))
        done = not new.where("c <> old").limit(1).count()
        drop(label)
        label = new
        if done:
            drop(both)
            return label.select("id", F.col("c").alias("component"))
