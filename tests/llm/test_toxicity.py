import zlib

import numpy as np
from skyfold.llm import queries, toxicity
from skyfold.llm import words as W

DATA = "/root/testdata"


def test_interactions_are_learnt(spark):
    """An insult together with a group's name is toxic; either alone is not."""
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(1500):
        words = [f"w{rng.integers(300)}" for _ in range(30)]
        a, b = (rng.random(2) < 0.5).tolist()
        words += ["insult,"] * a + ["Groupname."] * b
        rng.shuffle(words)
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(a and b)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    machine = toxicity.fit(docs, spark.createDataFrame(labels[:1000], "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.score(docs, machine).collect()}
    test = range(1000, 1500)
    assert np.mean([(got[i] >= 0.5) == labels[i][1] for i in test]) > 0.95


def test_a_word_that_is_neutral_alone(spark):
    """A group's name is as frequent in clean texts as in toxic ones; beside an insult it decides."""
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(3000):
        words = [f"w{rng.integers(300)}" for _ in range(30)]
        group, insult = (rng.random(2) < (0.5, 0.4)).tolist()
        slur = not group and bool(rng.random() < 0.4)
        words += ["insult"] * insult + ["groupname"] * group + ["slur"] * slur
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int((insult and group) or slur)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    machine = toxicity.fit(docs, spark.createDataFrame(labels[:2000], "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.score(docs, machine).collect()}
    assert np.mean([(got[i] >= 0.5) == labels[i][1] for i in range(2000, 3000)]) > 0.95


def test_scores_against_the_sum_over_pairs(spark):
    """Terms and the machine's sum restated word by word and pair by pair; the hash of a term is the library's own."""
    rng = np.random.default_rng(3)
    texts = ["", " ", "One", "(Hello), hello! HELLO-world", "a ab abc abcd abcde abcdefg", "... !? é", "Ünïcode wörds; wörds", "x " * 500]
    texts += [" ".join(rng.choice(["alpha", "Beta,", "'gamma'", "delta-delta", "ε"], 12)) for _ in range(20)]
    machine = toxicity.Machine(-0.4, rng.normal(size=toxicity.SLOTS).astype(np.float32), rng.normal(0, 0.4, (toxicity.SLOTS, toxicity.FACTORS)).astype(np.float32), rng.random(toxicity.SLOTS) < 0.6)

    def expect(text):
        kinds = [set(), set(), set()]
        for word in text.encode().split():
            for _ in range(3):
                word = word[:-1] if word[-1:] and word[-1:] in b".,;:!?\"'()[]{}<>*_-" else word
                word = word[1:] if word[:1] and word[:1] in b".,;:!?\"'()[]{}<>*_-" else word
            if word:
                word = bytes(c + 32 if 65 <= c <= 90 else c for c in word)
                for k, piece in enumerate((word, word[:4], word[:6])):
                    kinds[k].add(piece)
        slots = {name(piece, k + 1) for k, own in enumerate(kinds) for piece in own}
        own = sorted(s for s in slots if machine.known[s])
        x = 1 / np.sqrt(1 + len(own))
        z = machine.bias + sum(float(machine.weights[s]) * x for s in own)
        v = machine.factors.astype(float)
        z += sum(float(v[a] @ v[b]) * x * x for i, a in enumerate(own) for b in own[i + 1 :])
        return 1 / (1 + np.exp(-z))

    def name(piece, kind):
        h = 0
        for i, c in enumerate(piece):
            h = (h + int(W._RANDOM[c]) * pow(W._M, i, 1 << 64)) % (1 << 64)
        return int(W.mix(np.array([(h + kind) % (1 << 64)], np.uint64))[0]) >> (64 - toxicity.SLOT_BITS)

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(docs, machine).collect()}
    for i, text in enumerate(texts):
        assert abs(got[i] - expect(text)) < 1e-5, text


def test_repeated_labels_and_rows(spark):
    """A doc_id with several rows in either table gives several training rows; the order of rows has no influence."""
    docs = [(i % 200, f"w{i % 7} {'bad' if i % 3 == 0 else 'good'} x{i % 11}") for i in range(400)]
    labels = [(i % 200, int(i % 200 % 3 == 0)) for i in range(300)] + [(5, None), (None, 1)]
    machines = [toxicity.fit(spark.createDataFrame(d, "doc_id long, text string"), spark.createDataFrame(x, "doc_id long, toxic int")) for d, x in ((docs, labels), (docs[::-1], labels[::-1]))]
    assert machines[0].bias == machines[1].bias and (machines[0].weights == machines[1].weights).all() and machines[0].known.any()


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None), (1, ""), (None, "x " * 50000), (2, " \n")], "doc_id long, text string")
    none = spark.createDataFrame([(1, None)], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.fit(docs, none)).collect()
    assert len(out) == 4 and all(0 <= r.score <= 1 for r in out)
    assert toxicity.score(docs.limit(0), toxicity.fit(docs, none)).count() == 0


def test_held_out_quality(spark):
    sf = f"{DATA}/sf0.1"
    out = {r.doc_id: r for r in queries.op5_toxicity_fm(spark, sf).collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) for d, r in out.items())
    held = [(out[r.doc_id].predicted, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.toxic is not None and r.doc_id in out and out[r.doc_id].held_out]
    hits = sum(p and t for p, t in held)
    assert hits / sum(p for p, _ in held) > 0.9 and hits / sum(t for _, t in held) > 0.85
