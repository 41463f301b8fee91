"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

A source's documents fall into blocks by a hash of doc_id. A source that is to be taken r times takes all its blocks
floor(r) times and further blocks in a permuted order, the last one in part and its last document in part, so the
words taken meet the target. The tree splits the exact numbers of block draws of all sources between two halves of
the output shards by a multivariate hypergeometric draw, and so on down to single shards; a shard's draws are the
next ones of each source's permuted sequence, so they are disjoint. What a document gives to the mix is what the shards
drew of it. Rows are shuffled within their shard, a large shard in several partitions that follow one another.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import common

#: Documents in a block, on average; and fewest blocks of a source.
BLOCK_ROWS, LEAST_BLOCKS = 4096, 16
#: A source column with more values than this is refused: per-source plans are made on the driver.
MOST_SOURCES = 100_000
#: Numbers of draws, of all sources and shards, that are sent to all executors; more of them are joined.
MOST_SENT = 4_000_000
#: Words of the mix in a shard, on average, between these numbers of shards; and in one partition of a shard.
SHARD_WORDS, LEAST_SHARDS, MOST_SHARDS, PART_WORDS = 8_000_000, 32, 1024, 8_000_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], share: float, most: float) -> list[float]:
    """share * sum(sizes) dealt by weight, none above most * its size; the excess is dealt anew by weight."""
    total, out, open_ = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if total * weights[i] / w > most * sizes[i]] if w else []
        if not over:
            for i in open_:
                out[i] = total * weights[i] / w if w else 0.0
            break
        for i in over:
            out[i] = most * sizes[i]
            open_.discard(i)
        total = share * sum(sizes) - sum(out[i] for i in range(len(sizes)) if i not in open_)
    return out


def split(counts: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(sources, shards) draws: exact in every row, and even over the shards up to rounding."""
    out = np.zeros((len(counts), shards), np.int64)

    def node(own: np.ndarray, low: int, high: int) -> None:
        if high - low == 1:
            out[:, low] = own
            return
        half = (high - low) // 2
        rng = np.random.Generator(np.random.PCG64([seed, low, high]))
        left = rng.multivariate_hypergeometric(own, int(round(int(own.sum()) * half / (high - low))), method="marginals") if own.sum() else own * 0
        node(left, low, low + half)
        node(own - left, low + half, high)

    if len(counts):
        node(np.asarray(counts, np.int64), 0, shards)
    return out


def plan_mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, shards: int | None = None, seed: int = 11) -> DataFrame:
    """docs with size, source_size, target, taken (words, repeats counted) and shards (one for each copy, partial last).

    Sources, by code point and null last, get the weights in turn. Null text has size 0; a source without words has
    target 0 and takes nothing. Rows of equal doc_id and text share what is left for them. No document is
    taken more than most times (most is 1 at least). Columns with the new names are replaced. An empty table gives no rows.
    shards: of the output (null: by the words of the mix).
    """
    spark = docs.sparkSession
    added = {"size", "source_size", "target", "taken", "shards"}
    keep = [c for c in docs.columns if c not in added]
    name = F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(seed)).alias("name_")
    # Columns under names of their own, not in a struct: what the caller does not select is then pruned before all joins.
    doc = docs.select(*[F.col(f"`{c}`").alias(f"rest{i}_") for i, c in enumerate(keep)], "source", name, word_count(F.col("text")).alias("size"))
    slim = common.cut(doc.select("source", "name_", "size"))
    totals = slim.groupBy("source").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows")).limit(MOST_SOURCES + 1).collect()
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    totals.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [r.n for r in totals]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share, most)
    rows = []
    for r, t in zip(totals, goal, strict=True):
        passes = int(t // r.n) if r.n else 0
        extra = int(round(t - passes * r.n)) if r.n else 0
        rows.append((r.source, r.n, float(t), passes, extra, max(LEAST_BLOCKS, -(-r.rows // BLOCK_ROWS))))
    plan = spark.createDataFrame(rows, "source string, source_size long, target double, passes int, extra long, blocks long")
    plan = plan.select(F.struct(F.col("source").isNull().alias("no"), F.coalesce("source", F.lit("")).alias("name")).alias("s"), "source_size", "target", "passes", "extra", "blocks")
    key = F.struct(F.col("source").isNull().alias("no"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("name")).alias("s")
    block = F.pmod(F.col("name_"), F.col("blocks")).alias("block")

    # The plan has MOST_SOURCES rows at most.
    placed = slim.select(key, "name_", "size").join(F.broadcast(plan), "s").select("s", block, "name_", "size", "passes", "extra")
    summed = placed.groupBy("s", "block", "passes", "extra").agg(F.sum("size").alias("n"))
    order = Window.partitionBy("s").orderBy(F.xxhash64("block", F.lit(seed + 1)), "block")
    ranked = summed.select("s", "block", "passes", "extra", "n", (F.row_number().over(order) - 1).alias("rank"), (F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    ranked = common.cut(ranked.withColumn("left", F.greatest(F.lit(0), F.least("n", F.col("extra") - F.col("before")))))

    drawn = {(r.s.no, r.s.name): (r.blocks, r.more) for r in ranked.groupBy("s").agg(F.count(F.lit(1)).alias("blocks"), F.count(F.when(F.col("left") > 0, 1)).alias("more")).collect()}
    own = [drawn.get((r[0] is None, r[0] or ""), (0, 0)) for r in rows]
    if shards is None:
        shards = max(LEAST_SHARDS, min(MOST_SHARDS, -(-int(sum(goal)) // SHARD_WORDS)))
    leaves = split(np.array([b * r[3] + m for r, (b, m) in zip(rows, own, strict=True)], np.int64), shards, seed)
    ends = spark.createDataFrame([(r[0] is None, r[0] or "", b, x.tolist()) for r, (b, _), x in zip(rows, own, np.cumsum(leaves, 1) if len(rows) else [], strict=True)], "no boolean, name string, own long, ends array<long>")
    plan = plan.join(ends.select(F.struct("no", "name").alias("s"), "own", "ends"), "s")

    part = ranked.where("left > 0 and left < n").select("s", "block", "left")
    ties = placed.join(part, ["s", "block"]).groupBy("s", "block", "left", "name_", "size").agg(F.count(F.lit(1)).alias("k"))
    inner = Window.partitionBy("s", "block").orderBy(F.xxhash64("name_", F.lit(seed + 2)), "name_", "size").rowsBetween(Window.unboundedPreceding, 0)
    ties = ties.withColumn("rest_", F.col("left") - F.sum(F.col("size") * F.col("k")).over(inner) + F.col("size") * F.col("k"))
    bits = ties.select("s", "block", "name_", F.col("size").alias("size_"), F.least("size", F.floor(F.greatest(F.lit(0), F.col("rest_")) / F.col("k"))).alias("bit"))

    own_columns = [f"rest{i}_" for i in range(len(keep))]
    out = doc.select(*own_columns, key, "name_", "size").join(F.broadcast(plan) if len(rows) * shards <= MOST_SENT else plan, "s").withColumn("block", block)
    out = out.join(ranked.select("s", "block", "rank", "left", F.col("n").alias("whole")), ["s", "block"])
    out = out.join(bits, ["s", "block", "name_"], "left")
    # A block's draws are numbers rank, rank + own, rank + 2 own .. of its source's sequence; a shard drew those between its ends.
    last = F.when(F.col("left") >= F.col("whole"), F.col("size")).otherwise(F.coalesce("bit", F.lit(0)))
    draws = F.transform(
        F.sequence(F.lit(0), F.col("passes")),
        lambda p: F.struct(F.size(F.filter("ends", lambda e: e <= p * F.col("own") + F.col("rank"))).alias("shard"), F.when(p < F.col("passes"), F.col("size")).otherwise(last).cast("long").alias("words"), (p < F.col("passes")).alias("whole")),
    )
    out = out.withColumn("draws", F.filter(draws, lambda d: (d["shard"] < F.size("ends")) & (d["whole"] | (d["words"] > 0))))
    out = out.select(*[F.col(a).alias(c) for a, c in zip(own_columns, keep, strict=True)], "size", "source_size", "target", F.aggregate("draws", F.lit(0).cast("long"), lambda n, d: n + d["words"]).alias("taken"), F.transform("draws", lambda d: d["shard"]).alias("shards"))
    out._parts_of_a_shard = max(1, -(-int(sum(goal)) // (shards * PART_WORDS)))
    return out


def draw(mixed: DataFrame) -> DataFrame:
    """The mix itself, from plan_mix(): a row for each copy, its text cut to the words taken, dealt to shards and shuffled.

    Adds shard and copy (0, 1, ...), in place of columns of these names. Only a copy that is taken in part has its text
    changed: to its first words, joined by one space. Rows of a shard are in hash order; a shard of more than
    PART_WORDS words lies in several partitions, each of them a range of that order. An empty mix gives no rows.
    """
    words = F.col("taken") - F.col("copy") * F.col("size")
    cut = F.array_join(F.slice(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""), 1, words.cast("int")), " ")
    keep = [c for c in mixed.columns if c not in ("shards", "text", "shard", "copy")]
    parts = getattr(mixed, "_parts_of_a_shard", None)
    if parts is None:
        load = mixed.agg(F.sum("taken"), F.max(F.array_max("shards"))).first()
        parts = max(1, -(-int(load[0] or 0) // ((int(load[1] or 0) + 1) * PART_WORDS)))
    rows = mixed.where("size(shards) > 0").select(*[F.col(f"`{c}`") for c in keep], "text", F.posexplode("shards").alias("copy", "shard"))
    rows = rows.select(*[F.col(f"`{c}`") for c in keep], F.when(words < F.col("size"), cut).otherwise(F.col("text")).alias("text"), "shard", "copy")
    order = F.xxhash64("shard", "doc_id", F.col("text"), "copy")
    range_ = F.floor((F.shiftrightunsigned(order, 33) * parts) / F.lit(1 << 31)).cast("int")
    # Dealt by number, not by hash: then no task gets a second shard while another has none.
    return rows.repartitionById(common.parts(mixed.sparkSession) * parts, (F.col("shard") * parts + range_).cast("int")).sortWithinPartitions("shard", F.shiftrightunsigned(order, 1), "copy")
