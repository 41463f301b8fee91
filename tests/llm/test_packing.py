import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from skyfold.llm import packing, queries, tokens

DATA, PATH = "/root/testdata", P.path("word_bpe_49k.json")


def ids_of(texts):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return [[*e.ids, 2] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def verify(rows, out, most=4096, segments=512):
    want = ids_of([t for _, t in rows])
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    for (d, _), ids in zip(rows, want):
        own = sorted(pieces.pop(d), key=lambda r: r.start)
        at = 0
        for r in own:
            assert (r.start, r.doc_tokens) == (at, len(ids))
            at += r.length
            raw = np.array(ids[r.start : at], "<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(raw) and (r.ids is None or np.array(r.ids, "<u4").tobytes() == raw)
        assert at == len(ids)
    assert not pieces
    padding = 0
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= most and len(own) <= segments
        padding += 0 if at & (at - 1) == 0 else most - at
    return padding


def test_hard_texts(spark):
    rnd = random.Random(3)
    hard = ["", None, "a.", "A.B, c... it's IT'S we'll,", "é É ẖ H̱ x́.  y z\x0bq\x1cw\x85v", "<|endoftext|> <|startoftext|>x", "123 4,5. 6", "a" * 100000, "İ ß ﬁ \U0001f600,", "\t\r\n x.\n\ny,"]
    hard += ["".join(rnd.choice("aB.,' \nééH̱<|>9ẞΣ") for _ in range(80)) for _ in range(200)]
    rows = list(enumerate(hard))
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, text string, ids string, start int").repartition(3)
    assert verify(rows, packing.pack(df, PATH).collect()) == 0
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_another_tokenizer_file(spark):
    """A file that keeps white space and case is used text by text, with its own ids."""
    path = P.path("byte_bpe_50k.json")
    assert tokens.splits_at_spaces(PATH) and not tokens.splits_at_spaces(path)
    texts = ["Hello,  World.\n", None, "", "<|endoftext|> é", "a b\tc" * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    want = [[*e.ids, 2] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    got = defaultdict(list)
    for r in sorted(packing.pack(df, path, max_tokens=32).collect(), key=lambda r: r.start):
        got[r.doc_id] += r.ids
    assert [got[i] for i in range(len(texts))] == want


def test_rows_of_one_id_and_an_ended_task(spark):
    """Rows of equal doc_id are packed each on its own; a LIMIT ends tasks early and later tasks still run."""
    df = spark.createDataFrame([(1, "one two"), (1, "one two"), (1, "three"), (None, "four")], "doc_id long, text string").coalesce(1)
    assert packing.pack(df, PATH).limit(1).count() == 1
    out = packing.pack(df, PATH).collect()
    assert sorted(((str(r.doc_id), r.start, r.length, r.doc_tokens) for r in out)) == [("1", 0, 2, 2), ("1", 0, 3, 3), ("1", 0, 3, 3), ("None", 0, 2, 2)]


def test_the_query_has_loss_free_tokens(spark):
    out = queries.op2_vector_packing(spark, f"{DATA}/sf0.001").collect()
    whole, loss, segments = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in out:
        whole[r.doc_id] = r.doc_tokens
        loss[r.doc_id] += r.loss_tokens
        segments[r.sequence_id] += 1
    assert all(loss[d] == max(0, n - queries.CONTEXT) for d, n in whole.items()) and max(segments.values()) <= queries.SEGMENTS


def test_limits(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(["word"] * rnd.choice([1, 2, 3, 50, 300, 900]))) for i in range(2000)]
    df = spark.createDataFrame([(*r, rnd.randrange(100)) for r in rows], "doc_id long, text string, prompt int").repartition(2)
    out = packing.pack(df, PATH, max_tokens=256, max_segments=16, max_loss=200, loss_from="prompt").collect()
    verify(rows, out, 256, 16)
    loss = defaultdict(int)
    for r in out:
        loss[r.sequence_id] += r.loss_tokens
    assert max(loss.values()) <= 200
    skip = {r.doc_id: r.prompt for r in df.collect()}
    got = defaultdict(int)
    for r in out:
        got[r.doc_id] += r.loss_tokens
    assert all(got[d] == max(0, len(i) - skip[d]) for (d, _), i in zip(rows, ids_of([t for _, t in rows])))


def test_every_document(spark):
    df = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert verify(rows, packing.pack(df, PATH, with_ids=False).collect()) == 0
