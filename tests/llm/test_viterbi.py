import random

import public_tokenizers as P
from tokenizers import Tokenizer, models, pre_tokenizers
from skyfold.llm import viterbi

DATA, PATH = "/root/testdata", P.path("piece_bpe_32k.model")


def tokenizer(vocabulary):
    t = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(viterbi.MARK, "always", True)
    return t


def test_against_the_tokenizer(spark):
    t = tokenizer(viterbi.read_vocabulary(PATH))
    rnd = random.Random(2)
    texts = ["", " ", "  a", "a  b ", "\n\n", "x\ny z", "▁a▁▁b", "\U0001f600一鿿\u0001", "a" * 3000, "éé ß"]
    texts += ["".join(rnd.choice("abcde  \nABth.,é中\U0001f600") for _ in range(60)) for _ in range(300)]
    texts += [r.text for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").collect()]
    df = spark.createDataFrame([(i, x, 3) for i, x in enumerate(texts)] + [(-1, None, 3)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r.n_tokens for r in viterbi.count_tokens(df, PATH).collect()}
    want = {i: len(e.ids) for i, e in enumerate(t.encode_batch(texts))}
    assert got.pop(-1) == 0
    bad = [(texts[i][:50], got[i], want[i]) for i in want if got[i] != want[i]]
    assert not bad, (len(bad), bad[:5])
    assert viterbi.count_tokens(df.limit(0), PATH).count() == 0


def test_ties():
    vocabulary = [("<unk>", 0.0)] + [(f"<0x{b:02X}>", -50.0) for b in range(256)] + [(viterbi.MARK, -1.0), ("a", -1.0), ("b", -1.0), ("aa", -2.0), ("ab", -2.0), ("aab", -3.0), ("ba", -2.5), (viterbi.MARK + "a", -2.0)]
    t, own = tokenizer(vocabulary), viterbi.Counter(vocabulary)
    rnd = random.Random(1)
    for _ in range(500):
        text = "".join(rnd.choice("aab c") for _ in range(12)).strip() or "a"
        assert own.count(text) == len(t.encode(text).ids), text
