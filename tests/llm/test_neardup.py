from brute import near_components
from skyfold.llm import common, neardup

DATA = "/root/testdata"


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string, band int")
    return {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.cluster(df, **more).collect()}


def test_small_cases(spark):
    base = " ".join(f"w{i}" for i in range(60))
    near = base.replace("w59", "other")
    rows = [(1, base), (2, near), (3, base.upper()), (4, None), (5, ""), (6, " \t\n"), (7, "A b"), (8, "a  B"), (9, "a b c"), (10, "x " * 40000)]
    got = run(spark, [(*r, "x", 1) for r in rows])
    assert got == near_components(rows) | {4: (0, 4), 5: (0, 5)}
    assert got[2][1] == 1 and got[8][1] == 7
    assert run(spark, []) == {}


def test_a_doc_id_with_several_texts_is_one_vertex(spark):
    """In both row orders; equal rows stay, a null doc_id is linked with nothing."""
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, a), (1, b), (2, a.replace("a59", "q")), (3, b.replace("b59", "q")), (4, a), (1, None), (5, b.replace("b0", "z")), (5, "another text of five or more words"), (6, "another text of five or more words"), (6, "another text of five or more words"), (None, a), (7, "alone")]
    n = {None: 56, 1: 56, 2: 56, 3: 56, 4: 56, 7: 1}
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string")
        got = neardup.cluster(df).collect()
        assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == sorted((str(d), "7" if d == 7 else str(d and 1), d in (1, 7)) for d, _ in rows)
        assert all(r.n_shingles in (n.get(r.doc_id, r.n_shingles), 0 if r.doc_id == 1 else 56) for r in got)


def test_every_document_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").collect()]
    assert run(spark, [(*r, "x", 1) for r in rows]) == near_components(rows)


def test_a_large_group_of_near_copies(spark):
    base = [f"w{i}" for i in range(50)]
    rows = [(i, " ".join([*base[: i % 50], f"n{i}", *base[i % 50 + 1 :]])) for i in range(300)]
    assert run(spark, [(*r, "x", 1) for r in rows]) == near_components(rows)


def test_small_blocks_and_split_buckets(spark):
    """Texts that share half their words fill common buckets; small blocks make every way of the last round run."""
    base = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join([*base, *(f"n{i // 2}x{k}" for k in range(30)), *([f"m{i}"] if i % 3 else [])])) for i in range(240)]
    assert run(spark, [(*r, "x", 1) for r in rows], block=8) == near_components(rows)
    assert run(spark, [(*r, "x", 1) for r in rows], block=100) == near_components(rows)


def test_keys_that_no_filter_holds_are_joined(spark, monkeypatch):
    monkeypatch.setattr(common, "BLOOM_MOST", 8)
    rows = [(i, " ".join(f"w{i // 3}x{k}" for k in range(40 + i % 3))) for i in range(60)]
    assert run(spark, [(*r, "x", 1) for r in rows]) == near_components(rows)


def test_cut_points_are_deleted(spark):
    before = set(common._held)
    run(spark, [(i, f"some words of a text {i // 2}", "x", 1) for i in range(40)])
    assert len(set(common._held) - before) <= 5
    common.clear()
    assert not common._held
