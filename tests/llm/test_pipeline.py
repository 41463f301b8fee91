import re
from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers
import pyarrow as pa
from brute import WORD, near_components, repeats
from skyfold.llm import common, neardup, tokens
from test_mixing_sharding import water

DATA = "/root/testdata/sf0.01"


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def test_stage_by_stage(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "minhash near-dedup", "substring dedup", "source mixing", "packing"]
    toxic = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").collect() if r.toxic}

    a = stages["toxicity"](spark, docs, DATA).cache()
    before, after = set(rows(docs)), rows(a)
    assert a.columns == docs.columns and set(after) <= before
    gone = before - set(after)
    assert len([r for r in gone if r[0] in toxic]) > 0.6 * len(toxic) and len(gone) < 0.2 * len(before)

    b = stages["minhash near-dedup"](spark, a, DATA).cache()
    want = near_components([r[:2] for r in after])
    assert sorted(rows(b)) == sorted(r for r in after if want[r[0]][1] == r[0])

    c = stages["substring dedup"](spark, b, DATA).cache()
    own = rows(b)
    expect = []
    for (d, text, lang, source, n), (_, cut, kept) in zip(own, repeats([r[:2] for r in own])):
        expect.append((d, kept, lang, source, len(kept)) if cut else (d, text, lang, source, n))
    assert sorted(rows(c)) == sorted(expect)

    d = stages["source mixing"](spark, c, DATA).cache()
    size, taken, copies = Counter(), Counter(), defaultdict(list)
    for r in expect:
        size[r[3]] += len(WORD.findall(r[1]))
    for r in rows(d):
        taken[r[3]] += len(WORD.findall(r[1]))
        copies[r[0]].append(r[1])
    names = sorted(size)
    goal = water([size[s] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))])
    assert all(abs(taken[s] - g) <= 2 for s, g in zip(names, goal))
    text = {r[0]: r[1] for r in expect}
    for k, own in copies.items():
        assert len(own) <= 2
        for t in own:
            assert t == text[k] or WORD.findall(text[k])[: len(WORD.findall(t))] == WORD.findall(t)

    e = stages["packing"](spark, d, DATA).collect()
    full = Counter()
    for r in e:
        full[r.sequence_id] += r.length
    assert all(n == 4096 or n & (n - 1) == 0 for n in full.values())
    by = Counter()
    for r in e:
        by[r.doc_id] += r.length
    assert by.keys() == copies.keys()


def test_empty_and_odd_tables(spark):
    odd = spark.createDataFrame([(None, None, None, None, None, "x", 1.0), (1, None, "en", "s", 0, "x", None), (1, "", None, None, None, None, 2.0)], "doc_id long, text string, lang string, source string, n_chars long, kept_text string, score double")
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, DATA)
            assert name == "packing" or out.columns == docs.columns
            assert out.count() >= 0


def test_other_columns_pass_through_whatever_their_names(spark):
    """Columns named like all that the operators add keep their values and types through every stage but the last."""
    names = ["score", "kept_text", "n_words", "n_removed", "shard", "copy", "size", "taken", "shards", "target", "source_size", "rest", "rk", "kept", "component_id", "name_", "others_", "label", "id", "s"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 300")
    odd = docs.select(*names_first(docs, names))
    own = {r.doc_id: [r[n] for n in names] for r in odd.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, DATA)
        assert out.schema == odd.schema or [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in odd.schema], name
        got = out.collect()
        assert got and all([r[n] for n in names] == own[r.doc_id] for r in got), name
    assert corpus_pipeline.STAGES[-1][1](spark, odd, DATA).count() > 0


def names_first(docs, names):
    from pyspark.sql import functions as F

    return [*[F.concat(F.lit(f"{n} of "), "doc_id").alias(n) for n in names], *docs.columns]


def chained(df):
    """The Python operators of a plan that feed another one in the same task, which then holds two workers."""
    above, found = [], []
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = re.search(r"[A-Za-z(*]", line)
        if depth is None or line.startswith("=="):
            continue
        name = re.sub(r"^[^A-Za-z]*(\d+\) )?", "", line)
        del above[next((i for i, (d, _) in enumerate(above) if d >= depth.start()), len(above)) :]
        near = [n for _, n in above]
        near = near[max([i + 1 for i, n in enumerate(near) if "Exchange" in n.split()[0]], default=0) :]
        if re.match(r"\w*(InArrow|InPandas)", name) and any(re.match(r"\w*(InArrow|InPandas)", n) for n in near):
            found.append(name[:60])
        above.append((depth.start(), name))
    return found


def test_a_task_holds_one_python_worker(spark, monkeypatch):
    """Two in a row doubled the workers of an executor, and the pipeline ran out of its memory in near-dedup."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    twice = docs.select("text").mapInArrow(lambda b: b, "text string").where("text > 'b'").mapInArrow(lambda b: b, "text string")
    dealt = docs.select("text").mapInArrow(lambda b: b, "text string").repartition(3, "text").mapInArrow(lambda b: b, "text string")
    assert len(chained(twice)) == 1 and not chained(dealt)
    plans, cut = [], common.cut
    monkeypatch.setattr(common, "cut", lambda df: plans.append(chained(df)) or cut(df))
    for _, stage in corpus_pipeline.STAGES:
        docs = common.cut(stage(spark, docs, DATA))
    assert len(plans) > 20 and not any(plans)


def test_divided_parts_go_on_in_the_same_worker(spark, monkeypatch):
    """With a filter and with a join: the same rows as of a part that is mapped afterwards."""
    rows = spark.range(0, 3000, 1, 5).selectExpr("id", "cast(id as string) as text")
    keys = common.cut(spark.range(0, 3000, 7).selectExpr("array(id, id + 1) as k"))
    wanted = {k for i in range(0, 3000, 7) for k in (i, i + 1) if k < 3000}

    def twice(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t * 2 for t in b.column(1).to_pylist()], pa.string())], names=["id", "twice"])

    for most in (common.BLOOM_MOST, 0):
        monkeypatch.setattr(common, "BLOOM_MOST", most)
        for then in ({"among": (twice, "id long, twice string")}, {"others": (twice, "id long, twice string")}):
            parts = common.divide(rows, "id", keys, **then)
            got = [{tuple(r) for r in p.collect()} for p in parts]
            at = 0 if "among" in then else 1
            assert all(t == str(i) * 2 for i, t in got[at]) and all(t == str(i) for i, t in got[1 - at])
            ids = [{i for i, _ in g} for g in got]
            assert wanted <= ids[0] and not ids[0] & ids[1] and len(ids[0] | ids[1]) == 3000
            assert len(ids[0]) < 1.2 * len(wanted)


def test_another_operator_lets_go_of_remembered_words():
    path = public_tokenizers.path("word_bpe_49k.json")
    for run in (
        lambda: tokens.forget(),
        lambda: list(neardup._sketch_batches(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["a b c d e f"])], names=["id", "text"])]))),
    ):
        tokens.tokenizer_of(path, 1000).encode(["some words"])
        assert tokens.tokenizer_of.cache_info().currsize == 1
        run()
        assert tokens.tokenizer_of.cache_info().currsize == 0
    assert tokens.tokenizer_of(path, 1000).encode(["some words"])
    tokens.forget()
