import hashlib

import pyspark.sql.types as T
from skyfold.llm import chat, queries

DATA = "/root/testdata"
HARD = ["\\### Assistant: </turn> ok", "a\\h\\\\e\\", "", "</turn", "##", "<part image 0>", "é\U0001f600 ### x", "\\", "\\\\", ": "]


def test_round_trip(spark):
    rows = [(1, i, HARD[-i - 1], t, "extra") for i, t in enumerate(HARD)] + [(2, 0, "assistant", None, "x"), (2, 0, "assistant", None, "x"), (None, None, None, None, None), (3, 5, "assistant", "x" * 100000, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(df)).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(HARD[-i - 1], t) for i, t in enumerate(HARD)]
    assert got[2].n_turns == 2 and "".join(got[2].loss_texts) == ""
    assert [(t.role, t.text) for t in got[None].turns] == [("", "")]
    assert "".join(got[3].loss_texts) == "x" * 100000
    assert sum(m.chars for m in got[1].mask) == len(got[1].formatted)
    assert chat.format_chats(df.limit(0)).count() == 0


def test_parts(spark):
    parts = [("text", "see ", None, None, None, None, None), ("image", None, "s3a://b/1.png", 100, 29, None, None), ("odd", "<part ", None, None, None, None, None), ("audio", None, "a.wav", None, None, 2.01, None), ("document", None, "d.pdf", None, None, None, 3), ("image", None, None, None, None, None, None)]
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("parts", T.ArrayType(chat.PART))])
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None), (1, 2, "assistant", [])], schema)
    r = chat.read_back(chat.format_chats(df)).collect()[0]
    assert r.formatted == "### user: see <part image 0>\\p<part audio 1><part document 2><part image 3></turn>\n### assistant: </turn>\n### assistant: </turn>\n"
    assert [tuple(a) for a in r.attachments] == [(0, 0, "image", "s3a://b/1.png", 24), (0, 1, "audio", "a.wav", 51), (0, 2, "document", "d.pdf", 3072), (0, 3, "image", None, 0)]


def test_query_against_plain_python(spark):
    want = {}
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    for c, _, role, text in sorted(rows + [(-7, 0, "user", queries.TRICKY), (-7, 1, "assistant", queries.TRICKY)], key=lambda r: r[:3]):
        n, turns, loss = want.get(c, (0, "", ""))
        want[c] = (n + 1, turns + f"{role}\n{text or ''}\n", loss + (text or "") * (role == "assistant"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.conv_id: tuple(r)[1:5] for r in queries.op1_chat_formatting(spark, f"{DATA}/sf0.001").collect()}
    assert got == {c: (n, sha(t), len(x), sha(x)) for c, (n, t, x) in want.items()}
