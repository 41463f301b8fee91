import hashlib
import random

import numpy as np
import pyarrow as pa
import xxhash
from skyfold.llm import fingerprints as fp
from skyfold.llm import words

DATA = "/root/testdata"


def one(text):
    return fp.fingerprints(*words.buffers(pa.array([text])))[0]


def text_hash(text):
    h = xxhash.xxh64(text.encode(), seed=42).intdigest()
    return h - (1 << 64) if h >> 63 else h


def brute(rows):
    rows = sorted(((d is not None, d or 0, text_hash(t or ""), d, t or "") for d, t in rows), key=lambda r: r[:3])
    out = []
    for i, (_, _, _, d, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][4]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = one(text), one(edited), one(after)
        out.append((d, len(text), hashlib.sha256(edited.encode()).hexdigest(), a.astype(">u2").tobytes().hex(), b.astype(">u2").tobytes().hex(), float((a == b).mean()), float((a == c).mean())))
    return sorted(out, key=str)


def test_rows_against_brute_force(spark):
    rnd = random.Random(1)
    rows = [(i * 7 % 1000, "".join(rnd.choice("abc é\U0001f600\n") for _ in range(rnd.randrange(200)))) for i in range(300)]
    rows += [(None, "null id"), (None, "another"), (5, None), (5, ""), (5, "tie"), (2000, "z" * 100000), (-4, "first")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, place string")
    assert sorted(map(tuple, fp.fingerprint(df).collect()), key=str) == brute(rows)
    assert fp.fingerprint(df.limit(0)).count() == 0
    alone = spark.createDataFrame([(1, "only one")], "doc_id long, text string")
    assert [tuple(r) for r in fp.fingerprint(alone).collect()] == brute([(1, "only one")])


def test_ids_that_many_rows_share(spark):
    """Most rows have no id, or one and the same, with different texts: their ranges are divided by hash."""
    rows = [(None, f"text {i} " * (i % 5)) for i in range(500)] + [(7, f"other {i}") for i in range(300)] + [(i, f"own {i}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, fp.fingerprint(df).collect()), key=str) == brute(rows)


def plain_parse(symbols, keys):
    """One level, symbol by symbol: four rounds of deterministic coin tossing, local maxima, names of phrases."""
    labels = list(symbols)
    for _ in range(4):
        new = [labels[0] & 1]
        for i in range(1, len(labels)):
            x = labels[i] ^ labels[i - 1]
            place = (8 if _ or max(symbols) < 256 else 64) if x == 0 else (x & -x).bit_length() - 1
            bit = labels[i] >> min(place, 7 if _ or max(symbols) < 256 else 63) & 1
            new.append(2 * place + bit)
        labels = new
    starts = [0] + [i for i in range(1, len(labels) - 1) if labels[i] > labels[i - 1] and labels[i] >= labels[i + 1]]
    names = []
    for a, b in zip(starts, [*starts[1:], len(symbols)]):
        h = (sum(k * pow(words._M, i, 1 << 64) for i, k in enumerate(keys[a:b])) + b - a) % (1 << 64)
        names.append(int(words.mix(np.array([h], np.uint64))[0]))
    return names


def test_fingerprints_against_a_plain_parse():
    """The fingerprint of a text restated without arrays: levels of phrases, then the least value of each slot's hash."""
    rnd = random.Random(5)
    for text in ["a", "aaaaaaaaaaaaaaaaaaaaaaaa", "the quick brown fox jumps over the lazy dog " * 6, "é\U0001f600" * 30, "".join(rnd.choice("abc \n") for _ in range(700)), "".join(chr(rnd.randrange(32, 127)) for _ in range(700))]:
        names, levels = list(text.encode()), {}
        keys = [int(words._RANDOM[c]) for c in names]
        for level in range(1, 5):
            names = keys = plain_parse(names, keys)
            levels[level] = names
        want = []
        for s in range(fp.SLOTS):
            salt = int(fp._SALT[s])
            low = min(((n >> 32) * (salt & 0xFFFFFFFF | 1) + (salt >> 32)) % (1 << 32) for n in levels[int(fp._SLOT_LEVEL[s])])
            want.append(int(words.mix(np.array([low + 1], np.uint64))[0]) >> 48 | 1)
        assert one(text).tolist() == want, text[:20]


def test_equal_substrings_share_interior_names():
    rnd = random.Random(2)
    text = lambda n: bytes(rnd.choice(b"abcdefgh ") for _ in range(n))
    shared = text(3000)
    for left in range(1, 40):
        sets = []
        for s in (shared, text(left) + shared + text(left)):
            names, at, keys = np.frombuffer(s, np.uint8), np.array([0, len(s)]), words._RANDOM[np.frombuffer(s, np.uint8)]
            levels = []
            for _ in range(4):
                names, at = fp.parse(names, at, keys)
                keys = names
                levels.append(names)
            sets.append(levels)
        for level, (a, b) in enumerate(zip(*sets)):
            lost = len(np.setdiff1d(a, b))
            assert lost <= 8, (level, lost)
        assert 2 * len(sets[0][0]) <= 3000 and 2 * len(sets[0][3]) <= len(sets[0][2])


def test_likeness_orders_documents(spark):
    out = fp.fingerprint(spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")).collect()
    long = [r for r in out if r.n_chars > 300]
    assert np.mean([r.near_edited for r in long]) > 0.25 and np.mean([r.near_next for r in long]) < 0.1
    assert np.mean([r.near_edited > r.near_next for r in long]) > 0.97
