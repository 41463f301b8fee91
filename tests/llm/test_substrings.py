import random

from brute import repeats
from skyfold.llm import substrings

DATA = "/root/testdata"


def check(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", None) for r in rows], "doc_id long, text string, kept_text string, rest int")
    out = substrings.remove_repeats(df, **more)
    assert out.columns == ["doc_id", "text", "rest", "kept_text", "n_words", "n_removed"]
    got = sorted(((r.doc_id, r.text), (r.n_words, r.n_removed, r.kept_text)) for r in out.collect())
    assert got == sorted(zip(rows, repeats(rows)))


def test_small_cases(spark):
    rnd = random.Random(1)
    w = [f"w{rnd.randrange(50)}" for _ in range(200)]
    rows = [(1, " ".join(w[:60])), (2, "a b c " + " ".join(w[7:27]) + "\td"), (3, " ".join(w[:60])), (4, ""), (5, " \n"), (6, "x " * 30000)]
    rows += [(7, " ".join(w[40:59])), (8, " ".join(["lead", *w[40:60], "tail"])), (9, " ".join(w)), (9, " ".join(w[100:])), (-3, " ".join(w[150:190]))]
    rows += [(20 + i, " ".join([f"z{i}", *w[60:90], f"y{i}"])) for i in range(400)]
    check(spark, rows)
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    none = spark.createDataFrame([(1, None), (None, "a")], "doc_id long, text string")
    assert sorted(r.kept_text for r in substrings.remove_repeats(none).collect()) == ["", "a"]


def test_every_document_against_brute_force(spark):
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").collect()])


def test_any_number_of_buckets(spark):
    """Numbers of more than 16 bits, too; and one bucket."""
    rnd = random.Random(2)
    w = [f"w{rnd.randrange(400)}" for _ in range(600)]
    rows = [(i, " ".join([f"a{i}", *w[i * 7 : i * 7 + 60], f"b{i}"])) for i in range(40)]
    for buckets in (1, 64, 131072):
        check(spark, rows, buckets=buckets)


def test_hot_passages(spark):
    """A passage of 40 words in most documents, at any place, is found without sending its blocks to buckets; equal rows and null ids, too."""
    rnd = random.Random(3)
    hot = [f"h{i}" for i in range(40)]
    rows = [(i if i % 50 else None, " ".join([*(f"l{i}x{k}" for k in range(rnd.randrange(40))), *hot, *(f"r{i}x{k}" for k in range(rnd.randrange(40)))])) for i in range(1, 400)]
    rows += [(500 + i % 3, " ".join(hot[:30])) for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(substrings.hot_blocks(df.selectExpr("xxhash64(doc_id, text) rk", "text"), 10, 20)) == 31
    got = sorted((r.text, r.n_words, r.n_removed, r.kept_text) for r in substrings.remove_repeats(df).collect())
    assert got == sorted((t, *x) for (_, t), x in zip(rows, repeats([(-1 if d is None else d, t) for d, t in rows])))
