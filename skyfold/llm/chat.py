"""Chat formatting with typed content parts, in DataFrame functions only.

A turn is written `### role: content</turn>` and a newline. Inside roles and texts a backslash, the strings `### `,
`</turn>`, `: ` (roles only) and `<part ` are escaped, so the output can be read back exactly.

A visitor (array functions over the parts of a turn) flattens text, image, audio and document parts into the
content, in order; the k-th attachment of a turn becomes `<part kind k>` and is recorded with its reference and the
number of tokens that it expands to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed control strings and their escapes, in the order in which they are applied.
ESCAPES = [("\\", "\\\\"), ("### ", "\\h"), ("</turn>", "\\e"), ("<part ", "\\p")]
ROLE_ESCAPES = [*ESCAPES, (": ", "\\c")]
START, COLON, END = "### ", ": ", "</turn>\n"

PART = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("ref", T.StringType()),
        T.StructField("width", T.LongType()),
        T.StructField("height", T.LongType()),
        T.StructField("seconds", T.DoubleType()),
        T.StructField("pages", T.LongType()),
    ]
)
PART_SQL = "struct<kind:string,text:string,ref:string,width:bigint,height:bigint,seconds:double,pages:bigint>"


def escape(text: Column, table: list[tuple[str, str]] = ESCAPES) -> Column:
    for plain, coded in table:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column, table: list[tuple[str, str]] = ESCAPES) -> Column:
    """Pairs of backslashes first: what lies between two of them has no other backslash but those of escapes."""

    def one(piece: Column) -> Column:
        for plain, coded in table[1:]:
            piece = F.replace(piece, F.lit(coded), F.lit(plain))
        return piece

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), one), "\\")


def expanded_tokens(part: Column, patch: int, audio_rate: float, page_tokens: int) -> Column:
    """Tokens that an attachment stands for: image patches, audio frames, document pages; unknown sizes count 0."""
    image = F.ceil(part["width"] / patch) * F.ceil(part["height"] / patch)
    return F.coalesce(
        F.when(part["kind"] == "image", image).when(part["kind"] == "audio", F.ceil(part["seconds"] * audio_rate)).when(part["kind"] == "document", part["pages"] * page_tokens), F.lit(0)
    ).cast("long")


def format_chats(turns: DataFrame, patch: int = 14, audio_rate: float = 25.0, page_tokens: int = 1024, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, mask, attachments.

    turns: conv_id, turn, role, and text or parts (array of PART; used where it is not null). Other columns are
    ignored. Turns come in order of turn (null first), ties by role, then by escaped content; equal rows stay.
    Null role or text: empty. Null conv_id is one conversation. A part of unknown or null kind counts as text.
    mask has for each turn its length in the output, and where in it the loss-bearing span starts and how long it
    is (code points); attachments: turn_index, ordinal, kind, ref, tokens. An empty table gives no rows.

    The output is one string per conversation, so a conversation must fit in one task; its turns are gathered
    after being formatted, and partially on the map side. format_turns() gives the rows before that.
    """
    rows = format_turns(turns, patch, audio_rate, page_tokens, loss_role)
    got = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "content", "segment", "loss_start", "loss_chars", "attachments"))).alias("t"))
    attached = F.flatten(F.transform("t", lambda x, i: F.transform(x["attachments"], lambda a: F.struct(i.cast("long").alias("turn_index"), a["ordinal"].alias("ordinal"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    mask = F.transform("t", lambda x: F.struct(F.length(x["segment"]).alias("chars"), x["loss_start"].alias("loss_start"), x["loss_chars"].alias("loss_chars")))
    return got.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.array_join(F.transform("t", lambda x: x["segment"]), "").alias("formatted"), mask.alias("mask"), attached.alias("attachments"))


def format_turns(turns: DataFrame, patch: int = 14, audio_rate: float = 25.0, page_tokens: int = 1024, loss_role: str = "assistant") -> DataFrame:
    """Row by row: conv_id, turn, role (escaped), content, segment, loss_start, loss_chars, attachments."""
    text = F.col("text") if "text" in turns.columns else F.lit(None).cast("string")
    plain = F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text.cast("string"), F.lit("")).alias("text"), *(F.lit(None).cast(f.dataType).alias(f.name) for f in PART.fields[2:])))
    parts = F.coalesce(F.col("parts").cast(f"array<{PART_SQL}>"), plain) if "parts" in turns.columns else plain
    known = F.array(F.lit("image"), F.lit("audio"), F.lit("document"))
    media = lambda p: F.coalesce(F.array_contains(known, p["kind"]), F.lit(False))
    rows = turns.select("conv_id", "turn", escape(F.coalesce(F.col("role"), F.lit("")), ROLE_ESCAPES).alias("role"), (F.coalesce(F.col("role"), F.lit("")) == loss_role).alias("bears"), parts.alias("parts"))
    found = F.transform(F.filter("parts", media), lambda p, i: F.struct(i.cast("long").alias("ordinal"), p["kind"].alias("kind"), p["ref"].alias("ref"), expanded_tokens(p, patch, audio_rate, page_tokens).alias("tokens")))
    before = lambda i: F.size(F.filter(F.slice("parts", 1, i), media))
    piece = lambda p, i: F.when(media(p), F.concat(F.lit("<part "), p["kind"], F.lit(" "), before(i).cast("string"), F.lit(">"))).otherwise(escape(F.coalesce(p["text"], F.lit(""))))
    rows = rows.select("conv_id", "turn", "role", "bears", F.array_join(F.transform("parts", piece), "").alias("content"), found.alias("attachments"))
    head = F.concat(F.lit(START), "role", F.lit(COLON))
    return rows.select(
        "conv_id", "turn", "role", "content", F.concat(head, "content", F.lit(END)).alias("segment"), F.length(head).alias("loss_start"), F.when(F.col("bears"), F.length("content")).otherwise(0).alias("loss_chars"), "attachments"
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """From formatted and mask: conv_id, turns (role, text), and loss_texts, the spans under the loss mask, all unescaped.

    Attachments show as their placeholders in both.
    """
    pieces = formatted.withColumn("p", F.split("formatted", "</turn>\n", -1)).withColumn("pieces", F.expr("slice(p, 1, size(p) - 1)"))
    role = lambda s: F.substring_index(F.substring(s, 5, 2147483647), ": ", 1)
    rest = lambda s: s.substr(F.length(role(s)) + 7, F.length(s))
    turns = F.transform("pieces", lambda s: F.struct(unescape(role(s), ROLE_ESCAPES).alias("role"), unescape(rest(s)).alias("text")))
    spans = F.zip_with("pieces", "mask", lambda s, m: F.when(m["loss_chars"] > 0, unescape(s.substr(m["loss_start"] + 1, m["loss_chars"]))).otherwise(""))
    return pieces.select(*formatted.columns, turns.alias("turns"), spans.alias("loss_texts"))
