"""Interval joins, merges and gaps over series cut into many ranges, against plain statements."""

import random

import pytest
from pyspark.sql import functions as F
from skyfold.operators import intervals, scan


def rows(seed, n, keys, low, high, longest, whole=False):
    rnd = random.Random(seed)
    num = (lambda a, b: rnd.randint(int(a), int(b))) if whole else (lambda a, b: round(rnd.uniform(a, b), 2))
    out = []
    for _ in range(n):
        a = num(low, high)
        out.append((rnd.choice(keys), a, a + num(0, longest)))
    return out + out[:5]


def table(spark, data, kind):
    return spark.createDataFrame(data, f"k string, start {kind}, stop {kind}")


@pytest.mark.parametrize("kind", ["double", "long"])
def test_overlaps_of_many_ranges(spark, monkeypatch, kind):
    """A hot key, equal windows, touching and null ends: each pair once, with as few or as many ranges."""
    monkeypatch.setattr(scan, "ROWS_PER_RANGE", 20)
    whole = kind == "long"
    left = rows(1, 150, ["hot"] * 5 + ["a", "b", None], 0, 60, 8, whole)
    right = rows(2, 150, ["hot"] * 5 + ["a", "c", None], 0, 60, 3, whole) + [("hot", None, None), ("hot", 5, 4) if whole else ("hot", 5.0, 4.0)]
    got = sorted(tuple(r) for r in scan.overlaps(table(spark, left, kind), table(spark, right, kind), ["k"]).collect())
    want = sorted((k, a, b, c, d) for k, a, b in left for m, c, d in right if k is not None and k == m and None not in (c, d) and c <= d and a <= d and c <= b)
    assert got == want and len(want) > 500
    flat = [(None, a, b) for _, a, b in left][:60]
    got = scan.overlaps(table(spark, flat, kind).drop("k"), table(spark, right, kind).drop("k"), []).count()
    assert got == sum(a <= d and c <= b for _, a, b in flat for _, c, d in right if c is not None and c <= d)


def merged(data):
    out = {}
    for k, a, b in sorted(data, key=lambda r: (str(r[0]), r[1])):
        own = out.setdefault(k, [])
        if own and a <= own[-1][1]:
            own[-1][1] = max(own[-1][1], b)
        else:
            own.append([a, b])
    return out


def free(windows, q0, q1):
    at, out = q0, []
    for a, b in windows:
        if a > at and at < q1:
            out.append((at, min(a, q1)))
        at = max(at, b)
    return [x for x in [*out, (at, q1)] if x[0] < x[1]]


@pytest.mark.parametrize("size", [15, 200_000])
def test_merge_and_gaps(spark, monkeypatch, size):
    monkeypatch.setattr(scan, "ROWS_PER_RANGE", size)
    data = rows(3, 120, ["hot"] * 6 + ["a", None], 0, 200, 2)
    got = sorted(((r.k, r.start, r.stop) for r in intervals.merge(table(spark, data, "double"), ["k"]).collect()), key=str)
    assert got == sorted(((k, *w) for k, ws in merged(data).items() for w in ws), key=str)
    ask = [("hot", 0.25, 150.5), ("hot", 20.0, 30.0), ("hot", 20.0, 30.0), ("a", -5.0, 300.0), ("none", 1.0, 2.0), ("hot", 7.0, 7.0)]
    got = sorted(tuple(r) for r in intervals.gaps(table(spark, [r for r in data if r[0]], "double"), table(spark, ask, "double"), ["k"], with_request=True).select("k", "request_start", "request_stop", "start", "stop").collect())
    assert got == sorted((k, a, b, *g) for k, a, b in set(ask) for g in free(merged(data).get(k, []), a, b))


def test_gaps_of_two_requests_and_fractions(spark):
    w = table(spark, [("x", 2.0, 3.0), ("x", 22.0, 23.0)], "double")
    q = spark.createDataFrame([("x", 0, 10), ("x", 20, 30)], "k string, start long, stop long")
    assert sorted(tuple(r)[1:] for r in intervals.gaps(w, q, ["k"]).collect()) == [(0, 2), (3, 10), (20, 22), (23, 30)]
    w, q = table(spark, [("x", 2.5, 3.75)], "double"), table(spark, [("x", 0.25, 10.5)], "double")
    assert sorted(tuple(r)[1:] for r in intervals.gaps(w, q, ["k"]).collect()) == [(0.25, 2.5), (3.75, 10.5)]
    with pytest.raises(Exception, match="not covered from (0.25 to 2.5|3.75 to 10.5)"):
        intervals.gaps(w, q, ["k"], error=True).collect()
    assert intervals.gaps(w, table(spark, [("x", 2.5, 3.0)], "double"), ["k"], error=True).collect() == []
    with pytest.raises(Exception, match="stops before"):
        intervals.gaps(w, table(spark, [("x", 3.0, 2.0)], "double"), ["k"]).collect()


def test_ranges_by_bisection(spark):
    bounds = [1.0, 2.0, 2.5, 7.0, 9.0]
    values = [-1.0, 1.0, 1.5, 2.0, 2.49, 2.5, 6.0, 7.0, 9.0, 99.0, float("nan"), None]
    for k in range(len(bounds) + 1):
        got = [r.b for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").coalesce(1).orderBy("i").select(scan.range_of(F.col("v"), bounds[:k]).alias("b")).collect()]
        assert got == [sum(b <= v or v != v for b in bounds[:k]) if v is not None else 0 for v in values]


def test_one_hot_key_of_many_windows(spark):
    """Two series of one key with 100,000 windows each: the join makes no more rows than pairs."""
    n = 100_000
    one = spark.range(n).select(F.lit("k").alias("k"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 6).alias("stop"))
    two = spark.range(n).select(F.lit("k").alias("k"), (F.col("id") * 10 + 5).alias("start"), (F.col("id") * 10 + 11).alias("stop"))
    got = intervals.intersect(one, two, ["k"]).agg(F.count("*"), F.sum(F.col("stop") - F.col("start"))).first()
    assert tuple(got) == (2 * n - 1, n + (n - 1))


@pytest.mark.parametrize("what", ["merge", "intersect", "gaps"])
def test_keys_of_few_windows_are_not_cut_into_ranges(spark, monkeypatch, what):
    """One exchange by key is enough for them: no bounds are sought and nothing is numbered."""

    def no(*_):
        raise AssertionError("cut into ranges")

    monkeypatch.setattr(scan, "bounds_of", no)
    data, more = (rows(s, 80, ["a", "b", "c", None], 0, 90, 4) for s in (5, 6))
    w = table(spark, data, "double")
    if what == "merge":
        got = sorted(((r.k, r.start, r.stop) for r in intervals.merge(w, ["k"]).collect()), key=str)
        assert got == sorted(((k, *m) for k, ms in merged(data).items() for m in ms), key=str)
    elif what == "intersect":
        got = sorted(tuple(r) for r in intervals.intersect(w, table(spark, more, "double"), ["k"]).collect())
        assert got == sorted((k, max(a, c), min(b, d)) for k, a, b in data for m, c, d in more if k and k == m and a <= d and c <= b)
    else:
        ask = [("a", -1.0, 50.0), ("a", 20.0, 120.0), ("b", 3.0, 4.0), ("none", 1.0, 2.0), (None, 1.0, 2.0)]
        got = sorted((tuple(r) for r in intervals.gaps(w, table(spark, ask, "double"), ["k"]).collect()), key=str)
        assert got == sorted(((k, *g) for k, a, b in ask for g in free(merged([r for r in data if r[0]]).get(k, []), a, b)), key=str)


@pytest.mark.parametrize("size", [1, 200_000])
def test_merge_of_windows_without_ends(spark, monkeypatch, size):
    monkeypatch.setattr(scan, "ROWS_PER_RANGE", size)
    w = table(spark, [("x", 5.0, None), ("x", 5.0, None), ("y", 5.0, None), ("y", 5.0, 7.0), ("y", 6.0, 8.0)], "double")
    assert sorted(tuple(r) for r in intervals.merge(w, ["k"]).collect()) == [("x", 5.0, None), ("y", 5.0, 8.0)]
