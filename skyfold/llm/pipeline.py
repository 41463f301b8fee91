"""A corpus pipeline of five stages over `documents`: toxicity, near-duplicates, repeated passages, source mix, packing.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns the columns of
documents; the last one returns packed pieces. Other columns, whatever their names, pass through every stage but the
last: the operators get them as one struct.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, mixing, neardup, packing, substrings, toxicity

_OTHERS = "others_"


def _held(docs: DataFrame, *own: str) -> DataFrame:
    """The columns that a stage's operator reads, and all others in one struct."""
    rest = [F.col(f"`{c}`").alias(c) for c in docs.columns if c not in own]
    return docs.select(*own, (F.struct(*rest) if rest else F.lit(None).cast("int")).alias(_OTHERS))


def _back(out: DataFrame, docs: DataFrame, own: dict) -> DataFrame:
    """The columns of docs, in their order: those of own anew, the others from the struct."""
    return out.select(*[own[c].alias(c) if c in own else F.col(_OTHERS)[c].alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold. The model learns from all labels, on their documents among docs."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine = toxicity.fit(docs.select("doc_id", "text"), labels)
    scored = toxicity.score(_held(docs, "text"), machine).where(F.col("score") < toxicity.THRESHOLD)
    return _back(scored, docs, {"text": F.col("text")})


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near-duplicates; rows without doc_id stay."""
    groups = neardup.cluster(docs.select("doc_id", "text"))
    gone = groups.where(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def _recounted(docs: DataFrame, changed) -> dict:
    """n_chars, where docs have it, of changed texts."""
    if "n_chars" not in docs.columns:
        return {}
    return {"n_chars": F.when(changed, F.char_length("text").cast("long")).otherwise(F.col(_OTHERS)["n_chars"].cast("long"))}


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 20 words or more that occur before; a text without any stays byte for byte."""
    out = substrings.remove_repeats(_held(docs, "doc_id", "text"), always_join=False).withColumn("text", F.col("kept_text"))
    return _back(out, docs, {"doc_id": F.col("doc_id"), "text": F.col("text")} | _recounted(docs, F.col("n_removed") > 0))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document that is taken twice has two rows, one that is taken in part has its first words."""
    drawn = mixing.draw(mixing.plan_mix(_held(docs, "doc_id", "text", "source")))
    return _back(drawn, docs, {c: F.col(c) for c in ("doc_id", "text", "source")} | _recounted(docs, F.lit(True)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # The executors' memory is also that of the stages before, so workers remember fewer words here.
    return packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False, cache_words=200_000).drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash near-dedup", drop_near_duplicates),
    ("substring dedup", cut_repeats),
    ("source mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The stages learn a model, sample sketches and tokenize; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
