import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from skyfold.llm import alignment, queries
from tokenizers import Tokenizer

A, B, DATA = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), "/root/testdata"


def byte_alphabet():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def tokens(texts):
    """[(A tokens, B tokens)] as (id, bytes), without tokens where the bytes are not those of the text."""
    a, b, plain = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_alphabet()
    a.encode_special_tokens = True
    out = []
    for text in texts:
        if not text:
            out.append(([], []))
            continue
        one = [(i, bytes(plain[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        two = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in ((i, b.id_to_piece(i)) for i in b.encode(text))]
        whole = (" " + text).encode()
        out.append((one, two) if b"".join(x for _, x in one) == whole == b"".join(x for _, x in two) else ([], []))
    return out


def spans(side):
    at = 0
    for i, x in side:
        yield i, at, at + len(x)
        at += len(x)


def plain(texts, by_documents=False):
    coded, links, count = tokens(texts), [], Counter()
    for one, two in coded:
        own, two_spans = [], list(spans(two))
        for i, s, e in spans(one):
            own += [(i, j) for j, t, f in two_spans if max(s, t) < min(e, f)]
        links.append(own)
        count.update(own)
    groups = []
    for one, two in coded:
        x, y, out, left, right = list(spans(one)), list(spans(two)), [], [], []
        stops = {e for _, _, e in x} & {e for _, _, e in y}
        for stop in sorted(stops):
            left, right = [i for i, s, e in x if e <= stop], [i for i, s, e in y if e <= stop]
            x, y = x[len(left) :], y[len(right) :]
            out.append((left, right))
        groups.append(";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in out))
    top = {}
    for (_, j), n in count.items():
        top[j] = max(top.get(j, 0), n)
    rows = [(len(one), len(two), g.count("|"), len(own), sum(count[p] == top[p[1]] for p in own), sum(count[p] for p in own), hashlib.sha256(g.encode()).hexdigest() if g else "") for (one, two), own, g in zip(coded, links, groups)]
    return rows, count, groups


ODD = [None, "", " ", "  a", "a  b ", "\n\n", "x\ny z", " \t x", "a▁b", "▁", "\U0001f600 一鿿\u0001  b", "don't we'll  it's", "<|endoftext|> <s> </s> <0x41> a<|endoftext|>b", "é́ ﬁ", "a" * 3000, "1234567890 12 3.5e7", "x \n y", "a  b c", "a  b", "\x1f a\x1c b"]
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def texts():
    rnd = random.Random(4)
    return [*ODD, *("".join(rnd.choice("abcdeo  \n\tABth.,é中\U0001f600'▁0 1") for _ in range(rnd.randrange(80))) for _ in range(300)), "same text twice, same text twice", "same text twice, same text twice"]


def test_against_plain_links(spark):
    got_texts = texts()
    want, count, groups = plain(got_texts)
    df = spark.createDataFrame([(i, t, 7, 1) for i, t in enumerate(got_texts)], "doc_id long, text string, n_a int, other int").repartition(3)
    out, pairs = alignment.align(df, A, B, with_groups=True)
    assert out.columns == ["doc_id", "other", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "n_best", "count_sum"]
    got = {r.doc_id: r for r in out.collect()}
    bad = [(got_texts[i][:40] if got_texts[i] else None, tuple(got[i][c] for c in COLUMNS), w) for i, w in enumerate(want) if tuple(got[i][c] for c in COLUMNS) != w]
    assert not bad and len(got) == len(want), bad[:4]
    assert [got[i].groups for i in range(len(want))] == groups
    assert {(r.a, r.b): r["count"] for r in pairs.collect()} == count
    assert sum(w[0] > 0 for w in want) > 90 and any(w[0] == 0 for w in want[4:])


def test_many_blocks_and_forgotten_words(spark, monkeypatch):
    """Blocks of few texts, and a worker that remembers few words, give the same rows."""
    some = [r.text for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()][:60]
    want, _, _ = plain(some)
    calm, hasty = (alignment.Interner(alignment.pair_of(A, B)) for _ in range(2))
    monkeypatch.setattr(alignment, "CACHE_WORDS", 50)
    for t in some + some[:20]:
        assert calm.text(t)[1] == hasty.text(t)[1]
        hasty.tidy()
    monkeypatch.setattr(alignment, "MOST_GROUPS", 10)
    hasty.tidy()
    assert not hasty.keys and hasty.text(some[0])[1] == calm.text(some[0])[1]
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 1)
    df = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in alignment.align(df, A, B)[0].collect()}
    assert got == dict(enumerate(want))


def test_text_by_text_is_equal_to_by_words():
    pair = alignment.Pair(A, B)
    assert pair.by_words
    fast, slow = alignment.Interner(pair), alignment.Interner(alignment.Pair(A, B))
    slow.pair.by_words = False
    for t in texts():
        if t:
            x, y = fast.text(t), slow.text(t)
            assert (x and x[1]) == (y and y[1]), t


def test_documents_weight_and_empty(spark):
    df = spark.createDataFrame([(1, "b b b"), (2, "b"), (3, None)], "doc_id long, text string")
    _, often = alignment.align(df, A, B)
    _, docs = alignment.align(df, A, B, weight="documents")
    assert [r["count"] for r in often.collect()] == [4] and [r["count"] for r in docs.collect()] == [2]
    out, pairs = alignment.align(df.limit(0), A, B)
    assert out.count() == 0 and pairs.count() == 0
    out, pairs = alignment.align(df.where("doc_id = 3"), A, B)
    assert [tuple(r) for r in out.collect()] == [(3, 0, 0, 0, 0, "", 0, 0)] and pairs.count() == 0
    with pytest.raises(ValueError):
        alignment.align(df, A, B, weight="words")


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()}
    want, _, _ = plain(list(docs.values()))
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in queries.op12_cross_tokenizer_alignment(spark, f"{DATA}/sf0.001").collect()}
    assert got == dict(zip(docs, want))
