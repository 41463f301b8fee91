"""Sharding by sampled splitters.

Records are keyed by a hash of their text. A sample of keys, each drawn with a probability in proportion to its
record's size, gives quantile boundaries of many fine ranges; the exact size of each range is then summed, overfull
ranges are subdivided (between keys, or within one hot key by a hash of doc_id), and whole ranges go to shards,
largest first to the least filled. Equal texts stay together unless they fill an eighth of a shard.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Fine ranges and sampled keys for each shard; the driver holds no more than these, and as many subdivisions.
RANGES, SAMPLES = 256, 2048
#: Equal texts stay together up to so many times the size of an even range (1/8 of a shard).
WHOLE = 32
_SIGN = np.uint64(1 << 63)


def _unsigned(x: np.ndarray) -> np.ndarray:
    return x.view(np.uint64) ^ _SIGN


class Ranges:
    """Sorted lower bounds of ranges of keys; a range may be one key, dealt by a second hash into several parts."""

    def __init__(self, bounds: np.ndarray):
        self.bounds = np.unique(np.concatenate([np.zeros(1, np.uint64), bounds]))
        self.parts = np.ones(len(self.bounds), np.int64)

    def of(self, key: np.ndarray, second: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.bounds, _unsigned(key), "right") - 1
        base = np.concatenate([[0], np.cumsum(self.parts)])
        part = ((_unsigned(second) >> np.uint64(33)).astype(np.int64) * self.parts[at]) >> 31
        return base[at] + part

    def refined(self, sizes: np.ndarray, even: float) -> Ranges:
        """Ranges over `even` split: several keys between equidistant keys (they are hashes), one key by the second hash."""
        bounds, parts = [], []
        high = np.append(self.bounds[1:], np.uint64(2**64 - 1))
        for low, top, size in zip(self.bounds.tolist(), high.tolist(), sizes.tolist(), strict=True):
            m = int(-(-size // even)) if size > 1.5 * even else 1
            if m > 1 and top - low > m:
                bounds += [low + (top - low) * i // m for i in range(m)]
                parts += [1] * m
            else:
                bounds.append(low)
                parts.append(int(-(-size // (even * WHOLE))))
        out = Ranges(np.array(bounds, np.uint64))
        out.parts = np.array(parts, np.int64)
        return out


def _deal(ranges: Ranges):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = ranges.of(batch.column(3).to_numpy(), batch.column(4).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32))], names=[*batch.schema.names, "range"])

    return run


_SLIM = "doc_id long, size long, text_crc32 long, key long, second long"


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row, by the law `bytes`: sizes near equal.

    size is the UTF-8 bytes of text plus 8; null text has none (crc32 0). slot counts from 0 in each shard without
    gaps. Equal texts lie in one shard unless their sizes together are over an eighth of a shard. Rows
    that repeat a doc_id, or have none, are rows like others; other columns are ignored. An empty table gives no rows.
    """
    common.ship(docs.sparkSession)
    text = F.col("text").cast("string")
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"), F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("key"), F.xxhash64("doc_id", F.lit(3)).alias("second"),
    )
    slim = common.cut(slim)
    total = slim.agg(F.sum("size")).first()[0] or 0
    most = RANGES * shards
    chance = F.least(F.lit(1.0), F.col("size") * (SAMPLES * shards / max(1, total)))
    luck = (F.shiftrightunsigned(F.xxhash64("key", "second", F.lit(9)), 11)).cast("double") / float(1 << 53)
    sample = slim.where(luck < chance).select("key", (F.col("size") / chance).alias("weight")).toPandas()  # SAMPLES * shards rows are expected
    keys, weights = _unsigned(sample["key"].to_numpy(np.int64)), sample["weight"].to_numpy(float)
    order = np.argsort(keys)
    keys, filled = keys[order], np.cumsum(weights[order])
    cuts = keys[np.searchsorted(filled, filled[-1] * np.arange(1, most) / most)] if len(keys) else keys
    hot = cuts[1:][cuts[1:] == cuts[:-1]]  # a key that fills more than one range gets one of its own
    ranges = Ranges(np.concatenate([cuts, hot + np.uint64(1)]))
    even = max(1.0, total / most)

    def sums(of: Ranges) -> tuple[DataFrame, np.ndarray, np.ndarray]:
        dealt = slim.mapInArrow(_deal(of), f"{_SLIM}, range int")
        size, rows = np.zeros(int(of.parts.sum()), np.int64), np.zeros(int(of.parts.sum()), np.int64)
        for r, s, n in dealt.groupBy("range").agg(F.sum("size"), F.count(F.lit(1))).collect():
            size[r], rows[r] = s, n
        return dealt, size, rows

    _, size, _ = sums(ranges)
    dealt, size, rows = sums(ranges.refined(size, even))
    shard_of, base = np.zeros(len(size), np.int32), np.zeros(len(size), np.int64)
    heap, used = [(0, s) for s in range(shards)], [0] * shards
    for r in np.argsort(-size, kind="stable").tolist():
        filled_, s = heapq.heappop(heap)
        shard_of[r], base[r] = s, used[s]
        used[s] += int(rows[r])
        heapq.heappush(heap, (filled_ + int(size[r]), s))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r = batch.column(3).to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(shard_of[r]), pa.array(base[r] + batch.column(4).to_numpy() - 1)], names=["doc_id", "size", "text_crc32", "shard", "slot"])

    within = Window.partitionBy("range").orderBy("key", "second", "doc_id", "size")
    numbered = dealt.select("doc_id", "size", "text_crc32", "range", F.row_number().over(within).cast("long").alias("n"))
    out = numbered.mapInArrow(place, "doc_id long, size long, text_crc32 long, shard int, slot long")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
