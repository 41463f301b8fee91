import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import WORD
from pyspark.sql import functions as F
from skyfold.llm import mixing, sharding

DATA = "/root/testdata"


def water(sizes, weights):
    """Targets by a common level, found by bisection."""
    low, high = 0.0, 1e12
    for _ in range(200):
        mid = (low + high) / 2
        if sum(min(2 * s, mid * w) for s, w in zip(sizes, weights)) < 1.5 * sum(sizes):
            low = mid
        else:
            high = mid
    return [min(2 * s, low * w) for s, w in zip(sizes, weights)]


def verify_mix(rows, out, slack=2):
    size = Counter()
    for _, text, source in rows:
        size[source] += len(WORD.findall(text or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, water([size[s] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))])))
    taken = Counter()
    assert Counter((r.doc_id, r.text, r.source) for r in out) == Counter(rows)
    for r in out:
        assert r.size == len(WORD.findall(r.text or "")) and r.source_size == size[r.source]
        assert r.target == pytest.approx(want[r.source], rel=1e-9, abs=1e-6) and 0 <= r.taken <= 2 * r.size
        assert len(r.shards) == -(-r.taken // r.size) if r.size else len(r.shards) in (0, 1, 2)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= slack for s in names), (taken, want)


def test_mix(spark):
    rows = [(i, "a b  c\n" * (i % 7), f"s{i % 5}" if i % 11 else None) for i in range(500)] + [(1000, None, "s0"), (1001, "x " * 60000, "s4"), (None, "q", "")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, taken int")
    verify_mix(rows, mixing.plan_mix(df).collect())
    assert mixing.plan_mix(df.limit(0)).count() == 0
    real = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    mixed = mixing.plan_mix(real)
    out = mixed.collect()
    verify_mix([(r.doc_id, r.text, r.source) for r in real.collect()], out)
    assert sorted(map(tuple, mixing.plan_mix(real.repartition(5)).select("doc_id", "taken", "shards").collect())) == sorted((r.doc_id, r.taken, r.shards) for r in out)
    words = Counter()
    for r in mixing.draw(mixed).collect():
        words[r.doc_id] += len(WORD.findall(r.text))
    assert words == +Counter({r.doc_id: r.taken for r in out})


def test_draw_of_odd_tables(spark, monkeypatch):
    """Columns named like the operator's, null and repeated ids, empty tables; shards in several partitions keep their hash order."""
    rows = [(i % 150 if i % 9 else None, "a b c d " * (i % 6), f"s{i % 4}", "mine", 7, 8) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, shard string, copy int, name_ int")
    mixed = mixing.plan_mix(df)
    assert Counter((r.doc_id, r.text, r.source, r.shard, r.copy, r.name_) for r in mixed.collect()) == Counter(rows)
    verify_mix([r[:3] for r in rows], mixed.collect(), slack=34)  # equal rows share what is left, to less than a word each
    out = mixing.draw(mixed).collect()
    assert sum(len(WORD.findall(r.text)) for r in out) == sum(r.taken for r in mixed.collect()) and {r.name_ for r in out} == {8}
    monkeypatch.setattr(mixing, "PART_WORDS", 10)
    monkeypatch.setattr(mixing, "SHARD_WORDS", 40)
    split = mixing.plan_mix(df)
    parts = mixing.draw(split).rdd.glom().collect()
    homes = defaultdict(set)
    for i, part in enumerate(parts):
        for r in part:
            homes[r.shard].add(i)
    assert max(map(len, homes.values())) > 1
    again = mixing.draw(split.where("true"))  # without what plan_mix knows of the shards
    key = lambda r: (str(r.doc_id), r.text, r.shard, r.copy)
    assert sorted(key(r) for part in parts for r in part) == sorted(map(key, again.collect()))
    for name in ("shard", "copy"):
        assert name in out[0].asDict() and all(isinstance(getattr(r, name), int) for r in out)
    assert mixing.draw(mixing.plan_mix(df.limit(0))).count() == 0


def test_splitting_tree():
    counts = np.array([1000, 0, 17, 300])
    got = mixing.split(counts, 7, 1)
    assert (got.sum(1) == counts).all() and got.sum(0).max() - got.sum(0).min() <= 2 and (got >= 0).all()


def verify_shards(rows, out, slack):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows)
    sizes, slots = Counter(), defaultdict(list)
    for r in out:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) <= set(range(24))
    assert max(sizes.values()) - sum(sizes.values()) / 24 <= slack
    return sizes


def test_shards(spark):
    rows = [(i, "same text" * 20) for i in range(3000)] + [(5000 + i, f"{i} " * (i % 50)) for i in range(3000)] + [(1, None), (1, None), (None, ""), (9, "é" * 5)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, shard int")
    verify_shards(rows, sharding.shard(df).collect(), 500)
    assert sharding.shard(df.limit(0)).count() == 0
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/sf0.1/documents.parquet").collect()]
    out = sharding.shard(spark.read.parquet(f"{DATA}/sf0.1/documents.parquet")).collect()
    sizes = verify_shards(real, out, 30000)
    assert len(sizes) == 24
    text = dict(real)
    homes, weight = defaultdict(set), Counter()
    for r in out:
        homes[text[r.doc_id]].add(r.shard)
        weight[text[r.doc_id]] += r.size
    assert all(len(homes[t]) == 1 or weight[t] > sum(sizes.values()) / 24 / 8 for t in homes)


def test_shards_are_dealt_evenly_to_tasks(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        mixed = mixing.plan_mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
        drawn = mixing.draw(mixed).select("shard", F.spark_partition_id().alias("task")).distinct().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len({r.shard for r in drawn}) == mixing.LEAST_SHARDS
    assert len(drawn) == len({r.shard for r in drawn}) == len({r.task for r in drawn})
