"""The queries opN_<name> and pipeline, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, divergence, fingerprints, mixing, neardup, packing, pipeline, quality, sharding, substrings, toxicity, vectors, viterbi


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A conversation whose texts hold the template's own control strings.
TRICKY = "\\### Assistant: </turn> ok"


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    back = chat.read_back(chat.format_chats(rows.unionByName(extra)))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
coded AS (
  SELECT *, replace(replace(replace(replace(replace(role, '\', '\\'), '### ', '\h'), '</turn>', '\e'), '<part ', '\p'), ': ', '\c') AS r,
    replace(replace(replace(replace(text, '\', '\\'), '### ', '\h'), '</turn>', '\e'), '<part ', '\p') AS c FROM rows),
joined AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r, c) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r, c) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(length(r) + length(c) + 14) AS formatted_chars
  FROM coded GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars FROM joined
"""


def op3_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.cluster(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM w, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.r = links.a)
SELECT doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r) AS component_id, min(r) = doc_id AS kept FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS k FROM w, unnest(range(1, len(ws) - 18)) AS t(i) WHERE len(ws) >= 20),
dup AS (SELECT doc_id, i FROM p QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS pos FROM dup, range(20) AS r(j)),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
marked AS (SELECT words.doc_id, words.pos, word, gone.pos IS NOT NULL AS cut FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.pos = gone.pos)
SELECT documents.doc_id, count(word) AS n_words, count(CASE WHEN cut THEN 1 END) AS n_removed,
  sha256(coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT cut), '')) AS kept_sha256
FROM documents LEFT JOIN marked ON documents.doc_id = marked.doc_id GROUP BY documents.doc_id
"""


#: Leading ids of a document that bear no loss, and documents' pieces in a sequence at most.
CONTEXT, SEGMENTS = 16, 64


def op2_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first CONTEXT ids of a document bear no loss (as a prompt would); its other ids and the end do."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit(CONTEXT).alias("context"))
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), max_segments=SEGMENTS, loss_from="context", with_ids=False).drop("ids")


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def op5_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    out = toxicity.score(docs, machine)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "shards")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viterbi.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_tokens")


def op9_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


OP9_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id, vec_id AS r FROM embeddings UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON reach.r = links.a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, min(r) AS component_id, min(r) = vec_id AS kept
FROM reach GROUP BY vec_id
"""


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(table(spark, sf_dir, "documents"))


def op11_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
t AS (SELECT row, lang, source, unnest(ts) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t SEMI JOIN k ON t.lang = k.lang AND t.term = k.term GROUP BY t.lang, t.source, t.term),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (coalesce(s.total, 0) + 2 * v.v) AS p, 1 + 1000000000::HUGEINT * (k.n + 2) // (v.total + 2 * v.v) AS q
  FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  LEFT JOIN s ON s.lang = g.lang AND s.source = g.source),
x AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
    coalesce((SELECT sum((y.p - z.p) * (y.p - z.p) // (y.p + z.p)) FROM p y JOIN p z ON y.term = z.term WHERE y.lang = a.lang AND z.lang = a.lang AND y.source = a.source AND z.source = b.source), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM x)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 10
"""


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows, _ = alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.clean(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "chars_lost")


OP13_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k FROM d, unnest(range(1, len(w) - 6)) AS t(i) WHERE len(w) >= 8),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, range(8) AS r(j) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
m AS (
  SELECT doc_id, line, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words, lower(line) AS low,
    len(regexp_extract_all(line, '{quality.SYMBOLS}')) AS symbols, len(regexp_extract_all(line, '[!?]{{2,}}')) AS shouts, len(regexp_extract_all(line, '{quality.SEPARATOR}')) AS parts
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
x AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines,
    sum(CASE WHEN (parts >= 2 AND parts * 5 >= words) OR trim(low) IN ({", ".join(f"'{m}'" for m in quality.MENU)}) OR symbols * 2 > words OR shouts * 3 > words
      OR NOT regexp_matches(line, '{quality.SENTENCE}') OR regexp_matches(low, '{"|".join(quality.NOTICES)}') THEN chars ELSE 0 END) AS chars_lost FROM m GROUP BY doc_id),
b AS (
  SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(text, '{quality.SYMBOLS}')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(chars_lost, 0) AS chars_lost
  FROM d LEFT JOIN rep ON rep.doc_id = d.doc_id LEFT JOIN x ON x.doc_id = d.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * chars_lost <= 50 * word_chars AS kept, CAST(chars_lost AS BIGINT) AS chars_lost
FROM b
"""


QUERIES = {"pipeline": pipeline.run} | {f.__name__: f for f in (op1_chat_formatting, op2_vector_packing, op3_minhash_neardup, op4_substring_dedup, op5_toxicity_fm, op6_source_mixing, op7_sharding, op8_token_counts, op9_embedding_neardup, op10_fingerprints, op11_divergence_audit, op12_cross_tokenizer_alignment, op13_quality_rules)}
ORACLES: dict[str, str] = {"op1_chat_formatting": OP1_SQL, "op3_minhash_neardup": OP3_SQL, "op4_substring_dedup": OP4_SQL, "op9_embedding_neardup": OP9_SQL, "op11_divergence_audit": OP11_SQL, "op13_quality_rules": OP13_SQL}
