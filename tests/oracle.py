"""Compare a registered query with its SQL in DuckDB: names, rows, values."""

import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else 0.0 if v == 0 else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(_value, v))
    if isinstance(v, dict):
        return tuple(map(_value, v.values()))
    return v if v is None or isinstance(v, (bool, int, str)) else str(v)


def compare(spark, query, sql, sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got = query(spark, sf_dir)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(got.columns), (names, got.columns)
    order = sorted(names)
    want = Counter(tuple(_value(r[names.index(c)]) for c in order) for r in cursor.fetchall())
    have = Counter(tuple(_value(r[c]) for c in order) for r in got.collect())
    missing, extra = list((want - have).elements())[:3], list((have - want).elements())[:3]
    assert not missing and not extra, f"{order}\nonly in SQL: {missing}\nonly in Spark: {extra}\n{sum(want.values())} and {sum(have.values())} rows"
    assert have
