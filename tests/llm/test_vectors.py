import numpy as np
import pytest
from skyfold.llm import vectors


def brute(rows, least=0.93):
    good = [i for i, (_, e, label) in enumerate(rows) if label is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    out = {r[0]: (0, r[0]) for r in rows}
    links = {rows[i][0]: set() for i in good}
    by = {}
    for i in good:
        by.setdefault((rows[i][2], len(rows[i][1])), []).append(i)
    for own in by.values():
        m = np.array([rows[i][1] for i in own], np.float64)
        m /= np.abs(m).max(1)[:, None]
        m /= np.sqrt((m * m).sum(1))[:, None]
        for a, b in zip(*np.nonzero(m @ m.T >= least)):
            if a != b:
                links[rows[own[a]][0]].add(rows[own[b]][0])
    seen = set()
    for i in sorted(links):
        if i in seen:
            continue
        todo, comp = [i], set()
        while todo:
            x = todo.pop()
            if x not in comp:
                comp.add(x)
                todo += links[x]
        seen |= comp
        for x in comp:
            out[x] = (len(links[x]), min(comp))
    return out


def run(spark, rows, kind="float"):
    df = spark.createDataFrame([(*r, "x") for r in rows], f"vec_id long, embedding array<{kind}>, label int, node string")
    return {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(df).collect()}


def test_small_cases(spark):
    nan = float("nan")
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 0), (2, v, 0), (3, v, 1), (4, [2.0, 4.0, 6.0], 0), (5, None, 0), (6, [0.0, 0.0, 0.0], 0), (7, [1.0, None, 3.0], 0), (8, [nan, 1.0, 1.0], 0), (9, v, None), (10, [], 0), (11, [1.0, 2.0], 0), (12, [float("inf"), 0.0, 0.0], 0), (13, [1.0, 2.0, 3.1], 0), (14, [-1.0, 0.0, 0.0], 0)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == {}


def planted(n, seed, dim=32, labels=5, groups=150):
    """Random vectors; groups of 2 to 12 whose members lie at cosines around 0.93 of a centre; exact copies; two labels for some groups."""
    rng = np.random.default_rng(seed)
    rows = [(rng.normal(size=dim), int(rng.integers(labels))) for _ in range(n)]
    for g in range(groups):
        centre, label = rng.normal(size=dim), int(rng.integers(labels))
        for k in range(int(rng.integers(2, 13))):
            off = rng.normal(size=dim)
            off -= off @ centre / (centre @ centre) * centre
            c = rng.uniform(0.93, 1)
            rows.append((c * centre / np.sqrt(centre @ centre) + np.sqrt(1 - c * c) * off / np.sqrt(off @ off), label if g % 10 or k % 2 else (label + 1) % labels))
    rows += [rows[int(i)] for i in rng.integers(len(rows), size=n // 20)]
    rng.shuffle(rows)
    return [(i, np.float32(e).tolist(), label) for i, (e, label) in enumerate(rows)]


def recall(got, want):
    assert got.keys() == want.keys() and all(got[k][0] <= want[k][0] for k in got)
    return sum(g[0] for g in got.values()) / sum(w[0] for w in want.values())


@pytest.mark.parametrize("kind", ["float", "double"])
def test_recall_and_no_false_links(spark, kind):
    rows = planted(4000, 7)
    want = brute(rows)
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")
    found = vectors.near_duplicates(df).cache()
    got = {r.vec_id: (r.n_links, r.component_id) for r in found.collect()}
    assert sum(w[0] for w in want.values()) > 2000 and recall(got, want) >= 0.99
    assert np.mean([got[k][1] == want[k][1] for k in want]) >= 0.999
    share = vectors.audit(df, found)
    print(f"recall of the queries: {share:.4f}")
    assert 0.97 <= share <= 1
    with pytest.raises(ValueError):
        vectors.audit(df.where("vec_id < 3"), found)


def test_cosines_in_double_precision(spark):
    """Squares that overflow or vanish, and a cosine that single precision would round over the bound."""
    low = 0.93 - 2e-8
    rows = [(1, [1e300, 0.0, 1.0], 0), (2, [1e300, 0.0, 1.0], 0), (3, [1e300, 1e299, 0.0], 0), (4, [1e-200, 0.0, 0.0], 1), (5, [2e-200, 0.0, 0.0], 1), (6, [5e-324, 0.0, 0.0], 1)]
    rows += [(7, [1.0, 0.0, 0.0], 2), (8, [low, float(np.sqrt(1 - low * low)), 0.0], 2), (9, [-1.0, 0.0, 0.0], 3), (10, [-(low + 4e-8), float(np.sqrt(1 - (low + 4e-8) ** 2)), 0.0], 3)]
    got = run(spark, rows, "double")
    assert got == brute(rows)
    assert got[1] == (2, 1) and got[5] == (2, 4) and got[8] == (0, 8) and got[10] == (1, 9)


def test_repeated_and_null_ids(spark):
    """Rows of one vec_id are one vertex, also where one has no vector; a null vec_id has no links."""
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(5, a, 0), (5, b, 0), (5, None, 0), (3, a, 0), (4, b, 0), (7, b, 1), (None, a, 0), (8, a, 1), (8, a, 1)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "vec_id long, embedding array<float>, label int")
        got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in vectors.near_duplicates(df).collect())
        assert got == [("3", 1, "3", True), ("4", 1, "3", False), ("5", 0, "3", False), ("5", 1, "3", False), ("5", 1, "3", False), ("7", 0, "7", True), ("8", 1, "8", True), ("8", 1, "8", True), ("None", 0, "None", False)]


def test_many_labels_and_overfull_shards(spark, monkeypatch):
    """Labels too rare for centroids are shards of their own; overfull shards are divided."""
    rows = planted(1500, 8, labels=400)
    assert run(spark, rows) == brute(rows)
    rows = planted(2500, 9, labels=1)
    monkeypatch.setattr(vectors, "SAMPLE", 8)
    monkeypatch.setattr(vectors, "OVERFULL", 500)
    got, want = run(spark, rows), brute(rows)
    assert recall(got, want) >= 0.9


def test_a_large_group_of_copies(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=16)
    rows = [(i, base.tolist(), 0) for i in range(2000)] + [(3000 + i, (base + 0.05 * rng.normal(size=16)).tolist(), 0) for i in range(300)] + [(5000 + i, rng.normal(size=16).tolist(), 0) for i in range(1000)]
    got, want = run(spark, rows), brute(rows)
    assert sum(g[0] for g in got.values()) >= 0.99 * sum(w[0] for w in want.values()) and all(got[k][0] <= want[k][0] for k in got)


def test_dense_groups_in_range_of_each_other(spark):
    """Groups of more than an edge list (120) and than the pool of candidates, jittered, at cosine 0.95; the medoid lies elsewhere."""
    rng = np.random.default_rng(4)
    axes = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    groups = [np.sqrt(0.95) * axes[0] + np.sqrt(0.05) * axes[i] for i in (1, 2, 3)] + [np.sqrt(0.95) * axes[10] + np.sqrt(0.05) * axes[i] for i in (11, 12)]
    rows = [c + 0.004 * rng.normal(size=64) for c, n in zip(groups, (120, 120, 130, 50, 50)) for _ in range(n)]
    rows += [axes[20] + 0.06 * rng.normal(size=64) for _ in range(700)] + list(rng.normal(size=(300, 64)))
    rows = [(i, e.tolist(), 0) for i, e in enumerate(rows)]
    got, want = run(spark, rows), brute(rows)
    assert got == want, (sum(g[0] for g in got.values()), sum(w[0] for w in want.values()))


def test_links_count_for_both_ends_and_once(spark):
    """A link that one end's search meets, or that only a later common shard meets, or that both shards meet."""
    import pyarrow as pa

    e = {1: [1.0, 0.0, 0.0], 2: [1.0, 0.2, 0.0], 3: [1.0, 0.1, 0.1], 4: [0.0, 0.0, 1.0], 5: [1.0, -0.1, 0.1]}
    homes = {1: [0, 1], 2: [0, 1], 3: [1, 2], 4: [0, 2], 5: [1, 2]}
    near = {1: [3], 2: [3], 3: [1, 2], 4: [], 5: []}  # in shard 0 no edge joins 1 and 2; nothing leads to 5
    tables = []
    for shard in (0, 1):
        mine = [k for k in e if shard in homes[k]]
        table = pa.table({"node": mine, "embedding": pa.array([e[k] for k in mine], pa.list_(pa.float32())), "weight": [10 * k for k in mine], "homes": pa.array([homes[k] for k in mine], pa.list_(pa.int32())), "lists": [[near[k]] for k in mine], "crowded": [False] * len(mine)})
        tables.append(vectors._links(0.93)((pa.scalar(0), pa.scalar(3), pa.scalar(shard)), table))
    rows = pa.concat_tables(tables).to_pylist()
    found = spark.createDataFrame([(r["a"], r["b"], r["n"]) for r in rows], "a long, b long, n long")
    got = {r.a: r.n for r in vectors.tally(found).collect()}
    assert got == {1: 100, 2: 90, 3: 80, 5: 60}, got


def test_dense_group_of_several_shards(spark, monkeypatch):
    """One dense group of four times OVERFULL, with weights, beside spread vectors: every link is found, once, and none is false."""
    rng = np.random.default_rng(6)
    base = np.eye(32)[0]
    dense = [base + 0.048 * rng.normal(size=32) for _ in range(1200)]  # a part of their pairs are links
    rows = [*dense, *dense[:40], *(rng.normal(size=(600, 32)))]
    rows = [(i, e.tolist(), 0) for i, e in enumerate(rows)]
    want = brute(rows)
    share = sum(w[0] for w in want.values()) / 1240**2
    assert 0.2 < share < 0.95, share
    monkeypatch.setattr(vectors, "OVERFULL", 300)
    monkeypatch.setattr(vectors, "BLOCK", 250)
    for sample in (8, 20_000):  # one shard for all, or many that overlap
        monkeypatch.setattr(vectors, "SAMPLE", sample)
        got = run(spark, rows)
        assert got == want, (sum(g[0] for g in got.values()), sum(w[0] for w in want.values()))


def test_forest_of_batches():
    rng = np.random.default_rng(7)
    n = 400
    links = rng.integers(0, n, (2, 500))
    forest = vectors.Forest(n)
    for k in range(0, 500, 60):
        forest.add(*links[:, k : k + 60])
    again = vectors.Forest(n)
    again.add(*links)
    assert (forest.label == again.label).all() and (forest.label[links[0]] == forest.label[links[1]]).all()
    assert len(forest.edges()[0]) == n - len(set(forest.label.tolist())) and (forest.label[forest.label] == forest.label).all()
