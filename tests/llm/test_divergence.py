import random
import re
from collections import Counter, defaultdict

from skyfold.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, at_least, top):
    lower = {c: c + 32 for c in range(65, 91)}
    docs = [(lang or "", source or "", [t.translate(lower) for t in TERM.findall(text or "")]) for lang, source, text in rows]
    df, n, groups = defaultdict(Counter), defaultdict(Counter), {(a, b) for a, b, _ in docs}
    for lang, source, terms in docs:
        df[lang].update(set(terms))
        n[lang, source].update(terms)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, k in df[lang].items() if k >= at_least]
        sources = sorted(s for a, s in groups if a == lang)

        def share(counts):
            below = sum(counts[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // below for t in kept}

        p = {s: share(n[lang, s]) for s in sources}
        q = share(sum((n[lang, s] for s in sources), Counter()))
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sources:
            for part, items in (("pair", [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]), ("term", [(t, f(p[s][t], q[t])) for t in kept if n[lang, s][t] and p[s][t] > q[t]])):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, r + 1) for r, (i, v) in enumerate(items) if part == "pair" or r < top]
    return sorted(out)


def check(spark, rows, at_least=2, top=10):
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "lang string, source string, text string, term string, rank int")
    got = sorted(tuple(r) for r in divergence.audit(df, at_least, top).collect())
    assert got == plain(rows, at_least, top)
    return got


def test_against_all_terms(spark):
    rnd = random.Random(5)
    words = ["Ab", "ab", "é", "É", "straße", "中文", "x-y", "don't", "A1b", "zz", "\U0001f600", "q", "ÀB", "w\x00v"]
    rows = [(rnd.choice(["en", "de", None, ""]), rnd.choice(["a", "b", "c", "é", "Z", None, "\U0001f600"]), " ".join(rnd.choices(words, k=rnd.randrange(30)))) for _ in range(300)]
    rows += [("en", "hot", "ab " * 5000), ("en", "hot", "ab " * 5000), ("xx", "one", "alone alone"), ("xx", "two", None), ("yy", "no terms", "1 2 3"), ("yy", "none", ""), ("zz", "lone", "a a a")]
    got = check(spark, rows)
    assert [r for r in got if r[0] == "yy"] == [("yy", "no terms", "pair", "none", 0, 1), ("yy", "none", "pair", "no terms", 0, 1)]
    check(spark, rows, at_least=10, top=3)
    check(spark, rows, at_least=10**6)


def test_ties_and_repeated_rows(spark):
    check(spark, [("en", s, "b a c") for s in "abcd"] * 3 + [("en", "e", "e f g h")] * 3)


def test_small_tallies(spark, monkeypatch):
    """Terms' pairs cut into many parts, and counts sent often, give the same rows."""
    rnd = random.Random(8)
    rows = [("en", f"s{rnd.randrange(30)}", " ".join(rnd.choices("abcdefghij", k=20))) for _ in range(200)]
    table = divergence.pa.table({"lang": ["en"] * 3, "cells": divergence.pa.array([[{"source": s, "n": k} for k, s in enumerate("abc", 1)]] * 3, divergence.pa.list_(divergence.pa.struct([("source", divergence.pa.string()), ("n", divergence.pa.int64())])))})
    monkeypatch.setattr(divergence, "TALLIED", 1)
    out = [tuple(r.values()) for b in divergence._tally(iter(table.to_batches())) for r in b.to_pylist()]
    total = Counter()
    for *k, terms in out:
        total[tuple(k)] += terms
    assert len(out) > len(total) and total == {("en", "a", "b", 1, 2): 3, ("en", "a", "c", 1, 3): 3, ("en", "b", "c", 2, 3): 3}
    check(spark, rows)


def test_empty(spark):
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).collect() == []


def test_large_counts():
    """Shares by long division equal exact ones beyond 64-bit products."""
    import duckdb

    for c, n, v in ((10**13, 8 * 10**14, 10**8), (0, 10**15, 1), (0, 0, 1), (7, 7, 3), (3 * 10**12, 3 * 10**12, 1)):
        sql = divergence._share(str(c), str(n), str(v)).replace(" div ", " // ")
        assert duckdb.sql(f"SELECT {sql}").fetchall()[0][0] == 1 + 10**9 * (c + 2) // (n + 2 * v)
