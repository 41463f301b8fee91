"""Cross-tokenizer alignment: which ids of one tokenizer stand for the same bytes as which ids of another.

Byte offsets where a token of A and a token of B both end cut a text's tokens into groups. A group is named by its ids,
so equal groups are one entry of a dictionary: links within a group are expanded once for each distinct group of the
corpus and multiplied by how often (or in how many documents) it occurs, and what follows for a group is joined back
by its key, once for each block of texts that holds it. No link of a text is ever a row of its own.

Blocks: a task interns the groups of a few megabytes of text at a time. A text travels as its groups' numbers within its
block (sorted, as differences), the block's dictionary as keys and frequencies.

Words: where both tokenizers always cut between a character and a following space and word, a text's tokens are those of
its words, and a worker remembers the groups of words (to a bound). Files of other kinds are used text by text.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, words
from .tokens import _BYTE_CHARS

MARK = "▁"
#: Words of a generation, of which a worker process remembers two, and groups that it numbers before it starts afresh.
CACHE_WORDS, MOST_GROUPS = 300_000, 1_000_000
#: Bytes and rows of text in a block.
BLOCK_BYTES, BLOCK_ROWS = 4 << 20, 2000
#: A space between a character and a word: both tokenizers cut in front of it.
_CUT = re.compile(r"(?<=\S) (?=\S)")


class Pair:
    """Two tokenizers: ids of a text, and the bytes of ids. A: a byte-level BPE file, B: a sentencepiece model."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        plain = {c: b for b, c in _BYTE_CHARS.items()} | {chr(b): b for b in range(256) if b not in _BYTE_CHARS}
        self.bytes_a = [b""] * (max(self.a.get_vocab(with_added_tokens=True).values(), default=-1) + 1)
        for piece, i in self.a.get_vocab(with_added_tokens=True).items():
            self.bytes_a[i] = bytes(plain[c] for c in piece) if all(c in plain for c in piece) else piece.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.len_a, self.len_b = (np.array([len(x) for x in t] or [0], np.int64) for t in (self.bytes_a, self.bytes_b))
        with open(path_a, encoding="utf-8") as f:
            d = json.load(f)
        split = d.get("pre_tokenizer") or {}
        self.by_words = d.get("normalizer") is None and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        self.by_words &= not any(MARK in p.lstrip(MARK) or " " in p for p in pieces) and [self.b.encode("a  b c"), self.b.encode("a\n")] == [
            self.b.encode("a  b") + self.b.encode("c"), self.b.encode("a") + self.b.encode("\n", out_type=int)[1:]]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a space and the text; None where the joined bytes of either are not those."""
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        whole = b" " + text.encode()
        if b"".join(map(self.bytes_a.__getitem__, a)) != whole or b"".join(map(self.bytes_b.__getitem__, b)) != whole:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)


@lru_cache(1)
def pair_of(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def link_ranges(len_a: np.ndarray, len_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each A token of two tilings of the same bytes: the first B token that overlaps it, and the one after the last."""
    end_a, end_b = np.cumsum(len_a), np.cumsum(len_b)
    return np.searchsorted(end_b, end_a - len_a, "right"), np.searchsorted(end_b - len_b, end_a, "left")


class Interner:
    """Groups of words (or of whole texts), numbered within a worker."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, tuple[bytes, str] | None] = {}  # word: numbers of its groups, their ids as text; None: its bytes differ
        self.old: dict[str, tuple[bytes, str] | None] = {}
        self.numbers: dict[bytes, int] = {}
        self.small: dict[int, int] = {}
        self.keys: list[bytes] = []
        self.texts: list[str] = []
        self.sizes: list[tuple[int, int, int]] = []

    def tidy(self) -> None:
        """Between blocks: forget words that were not met for a generation, and all if groups are too many."""
        if len(self.keys) > MOST_GROUPS:
            self.clear()
        elif len(self.known) > CACHE_WORDS:
            self.known, self.old = {}, self.known

    def number(self, a: list[int], b: list[int], links: int) -> int:
        key = len(a).to_bytes(4, "little") + np.array([*a, *b], "<i4").tobytes()
        got = self.numbers.get(key)
        if got is None:
            got = self.numbers[key] = len(self.keys)
            self.keys.append(key)
            self.texts.append(",".join(map(str, a)) + "|" + ",".join(map(str, b)))
            self.sizes.append((len(a), len(b), links))
        return got

    def groups(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the groups of two tilings of the same bytes, and their ends in bytes.

        A group of at most three tokens with ids below 2**16 is one whole number, so each kind of them is looked up once.
        """
        len_a, len_b = self.pair.len_a[a], self.pair.len_b[b]
        end_a, end_b = np.cumsum(len_a), np.cumsum(len_b)
        ends = np.intersect1d(end_a, end_b, assume_unique=True)
        stop_a, stop_b = np.searchsorted(end_a, ends) + 1, np.searchsorted(end_b, ends) + 1
        start_a, start_b = np.concatenate([[0], stop_a[:-1]]), np.concatenate([[0], stop_b[:-1]])
        n_a, n_b = stop_a - start_a, stop_b - start_b
        lo, hi = link_ranges(len_a, len_b)
        links = np.diff(np.concatenate([[0], np.cumsum(hi - lo)[stop_a - 1]]))
        out = np.zeros(len(ends), np.int64)
        low = n_a + n_b <= 3
        if max(int(a.max()), int(b.max())) >= 1 << 16:
            low[:] = False
        second = np.where(n_a == 2, a[np.minimum(start_a + 1, len(a) - 1)], np.where(n_b == 2, b[np.minimum(start_b + 1, len(b) - 1)], 0))
        code = (((n_a * 4 + n_b) << 16 | a[start_a]) << 16 | b[start_b]) << 16 | second
        kinds, first, at = np.unique(code[low], return_index=True, return_inverse=True)
        where = np.flatnonzero(low)[first]
        held = np.zeros(len(kinds), np.int64)
        for k, (c, i) in enumerate(zip(kinds.tolist(), where.tolist(), strict=True)):
            got = self.small.get(c)
            if got is None:
                got = self.small[c] = self.number(a[start_a[i] : stop_a[i]].tolist(), b[start_b[i] : stop_b[i]].tolist(), int(links[i]))
            held[k] = got
        out[low] = held[at]
        rest = np.flatnonzero(~low)
        list_a, list_b = a.tolist(), b.tolist()
        out[rest] = [self.number(list_a[p:q], list_b[r:s], n) for p, q, r, s, n in zip(*(v[rest].tolist() for v in (start_a, stop_a, start_b, stop_b, links)), strict=True)]
        return out.astype(np.int32), ends

    def entry(self, numbers: np.ndarray) -> tuple[bytes, str]:
        return numbers.tobytes(), ";".join(map(self.texts.__getitem__, numbers.tolist()))

    def learn(self, new: list[str]) -> None:
        """Words, encoded as one text; a text's last one may end in white space, which would run into the next, and is encoded alone."""
        alone = [w for w in new if not w or w[-1].isspace()]
        together = [w for w in new if w and not w[-1].isspace()]
        for part in [[w] for w in alone] + [together[k : k + 20_000] for k in range(0, len(together), 20_000)]:
            got = self.pair.encode(" ".join(part))
            if got is None:  # some word's bytes differ: find out which
                for word in part:
                    one = self.pair.encode(word)
                    self.known[word] = None if one is None else self.entry(self.groups(*one)[0])
                continue
            numbers, ends = self.groups(*got)
            stops = np.searchsorted(ends, np.cumsum([len(w.encode()) + 1 for w in part])) + 1
            flat, texts = numbers.tobytes(), list(map(self.texts.__getitem__, numbers.tolist()))
            self.known.update([(word, (flat[4 * i : 4 * j], ";".join(texts[i:j]))) for word, (i, j) in zip(part, pairwise([0, *stops.tolist()]), strict=True)])

    def missing(self, pieces: list[str]) -> list[str]:
        """Pieces that are not known, after those of the last generation are taken over."""
        new = set(pieces).difference(self.known)
        if new and self.old:
            old = self.old
            again = [w for w in new if w in old]  # an intersection would go through all of old
            self.known.update([(w, old[w]) for w in again])
            new.difference_update(again)
        return list(new)

    def text(self, text: str) -> tuple[bytes, str] | None:
        """Numbers of a text's groups (as bytes) and their ids as text; None where it has no tokens."""
        if not self.pair.by_words:
            got = self.pair.encode(text)
            return None if got is None else self.entry(self.groups(*got)[0])
        pieces = text.split(" ")
        missing = self.missing(pieces)
        if any(not p or p[0].isspace() or p[-1].isspace() for p in missing):
            pieces = _CUT.split(text)
            missing = self.missing(pieces)
        if missing:
            self.learn(missing)
        found = list(map(self.known.__getitem__, pieces))
        if None in found:  # a word's bytes differ; a text's do then, too
            return None
        return b"".join([f[0] for f in found]), ";".join([f[1] for f in found])


_interners: dict[tuple[str, str], Interner] = {}


def _interner(path_a: str, path_b: str) -> Interner:
    if (path_a, path_b) not in _interners:
        _interners.clear()
        _interners[path_a, path_b] = Interner(pair_of(path_a, path_b))
    return _interners[path_a, path_b]


_DOC = [("n_a", T.LongType()), ("n_b", T.LongType()), ("n_groups", T.LongType()), ("n_links", T.LongType()), ("groups_sha256", T.StringType())]
_NAMES = [n for n, _ in _DOC] + ["groups", "n_best", "count_sum"]


def _code(path_a: str, path_b: str, with_groups: bool, schema: pa.Schema):
    """Blocks of rows (text, rest): a row for each text, then a row for each distinct group of the block."""

    def block(interner: Interner, part: pa.RecordBatch, name: int) -> Iterator[pa.RecordBatch]:
        coded = [interner.text(t) if t else None for t in part.column(0).to_pylist()]
        sizes = np.array([len(c[0]) // 4 if c else 0 for c in coded], np.int64)
        numbers = np.frombuffer(b"".join([c[0] for c in coded if c]), np.int32)
        owner = np.repeat(np.arange(len(coded)), sizes)
        distinct, local = np.unique(numbers, return_inverse=True)
        order = np.lexsort((local, owner))
        local, owner = local[order], owner[order]
        first = np.ones(len(local), bool)
        first[1:] = (owner[1:] != owner[:-1]) | (local[1:] != local[:-1])
        freq, docs = np.bincount(local, minlength=len(distinct)), np.bincount(local[first], minlength=len(distinct))
        own = np.array([interner.sizes[g] for g in distinct.tolist()], np.int64).reshape(-1, 3)
        sums = np.zeros((len(local) + 1, 3), np.int64)
        np.cumsum(own[local], 0, out=sums[1:])
        ends = np.cumsum(sizes)
        per = sums[ends] - sums[ends - sizes]
        steps = np.diff(local, prepend=0)
        starts = np.r_[0, ends[:-1]][sizes > 0] if len(ends) else ends
        steps[starts] = local[starts]
        flat = steps.astype("<u4").tobytes()
        at = pairwise([0, *(4 * ends).tolist()])
        n = len(coded)
        texts = [c[1] if c else "" for c in coded]
        cols = {
            "rest": part.column(1), "n_a": per[:, 0], "n_b": per[:, 1], "n_groups": sizes, "n_links": per[:, 2],
            "groups_sha256": [sha256(t.encode()).hexdigest() if c else "" for t, c in zip(texts, coded, strict=True)],
            "groups": texts if with_groups else None, "steps": [flat[i:j] for i, j in at],
        }
        yield _batch(schema, n, name, cols)
        yield _batch(schema, len(distinct), name, {"local": np.arange(len(distinct)), "key": [interner.keys[g] for g in distinct.tolist()], "freq": freq, "docs": docs})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        interner, name = _interner(path_a, path_b), TaskContext.get().partitionId() << 32
        for batch in batches:
            _, offsets = words.buffers(batch.column(0))
            for i, j in words.chunks(offsets, BLOCK_BYTES, BLOCK_ROWS):
                yield from block(interner, batch.slice(i, j - i), name)
                name += 1
                interner.tidy()

    return run


def _batch(schema: pa.Schema, n: int, name: int, cols: dict) -> pa.RecordBatch:
    made = [pa.array(np.full(n, name)) if f.name == "block" else pa.nulls(n, f.type) if cols.get(f.name) is None else cols[f.name] if isinstance(cols[f.name], pa.Array) else pa.array(cols[f.name], f.type) for f in schema]
    return pa.RecordBatch.from_arrays(made, names=schema.names)


def _expand(path_a: str, path_b: str):
    """Rows (key, weight) of distinct groups: one row (key, a, b, weight) for each link in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(path_a, path_b)
        for batch in batches:
            for k in range(0, batch.num_rows, 20_000):
                part = batch.slice(k, 20_000)
                keys = part.column(0).to_pylist()
                ids = [np.frombuffer(x, "<i4") for x in keys]
                a = np.concatenate([x[1 : 1 + x[0]] for x in ids])
                b = np.concatenate([x[1 + x[0] :] for x in ids])
                lo, hi = link_ranges(pair.len_a[a], pair.len_b[b])
                group = np.repeat(np.arange(len(ids)), [x[0] for x in ids])
                left = np.repeat(np.arange(len(a)), hi - lo)
                right = np.arange(len(left)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[left]
                at = pa.array(group[left])
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), pa.array(a[left], pa.int32()), pa.array(b[right], pa.int32()), part.column(1).take(at)], names=["key", "a", "b", "weight"])

    return run


def _sum_up(out: pa.Schema):
    """One block: its texts' sums of what its groups are worth."""

    def run(key, docs: pa.Table, values: pa.Table) -> pa.Table:
        held = np.zeros((values.num_rows, 2), np.int64)
        held[values["local"].to_numpy()] = np.stack([values["best"].to_numpy(), values["total"].to_numpy()], 1)
        steps = docs["steps"].to_pylist()
        sizes = np.array([len(s) // 4 for s in steps], np.int64)
        ends = np.cumsum(sizes)
        local = np.cumsum(np.frombuffer(b"".join(steps), "<u4").astype(np.int64))
        starts = (ends - sizes)[sizes > 0]
        base = np.zeros(len(sizes), np.int64)
        base[sizes > 0] = np.where(starts > 0, local[np.maximum(starts - 1, 0)], 0)
        local -= np.repeat(base, sizes)
        sums = np.zeros((len(local) + 1, 2), np.int64)
        np.cumsum(held[local], 0, out=sums[1:])
        per = sums[ends] - sums[ends - sizes]
        more = {"n_best": pa.array(per[:, 0]), "count_sum": pa.array(per[:, 1])}
        return pa.table([more[f.name] if f.name in more else docs[f.name].combine_chunks() for f in out], schema=out)

    return run


def align(docs: DataFrame, path_a: str, path_b: str, weight: str = "frequency", with_groups: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs): every row of docs with its alignment, and the corpus's id pairs.

    documents: the columns of docs but text, then n_a, n_b (tokens), n_groups, n_links (pairs of token occurrences whose
    bytes overlap), groups_sha256 of the groups `a1,a2|b1;a3|b2,b3` (with_groups: that string itself as groups), n_best
    (links whose pair has the highest count of all pairs of its B id, ties included), count_sum (the pairs' counts summed
    over links). pairs: a, b, count, best. weight: a pair counts each link ("frequency"), or for each group each document
    that has it ("documents").

    A is read with a space in front, as B adds one. Texts that are null, empty, or whose bytes are not those of the
    tokens (B has no way to tell U+2581 from a space) have no tokens: zeros, and '' for the hash. Equal rows count each;
    a very long text is one block of its task. Columns of docs with the names of results are replaced. An empty table
    gives empty tables.
    """
    if weight not in ("frequency", "documents"):
        raise ValueError(f"weight is frequency or documents, not {weight}")
    spark = docs.sparkSession
    common.ship(spark)
    keep = [c for c in docs.columns if c not in (*_NAMES, "text")]
    rest = docs.select(F.col("text").cast("string").alias("_text"), F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in keep]).alias("rest"))
    fields = [("block", T.LongType()), ("rest", rest.schema["rest"].dataType), *_DOC, ("groups", T.StringType()), ("steps", T.BinaryType()), ("local", T.IntegerType()), ("key", T.BinaryType()), ("freq", T.LongType()), ("docs", T.LongType())]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    coded = common.cut(rest.mapInArrow(_code(path_a, path_b, with_groups, to_arrow_schema(schema)), schema))
    entries = coded.where("local is not null").select(F.col("block").alias("of"), "local", "key", F.col("freq" if weight == "frequency" else "docs").alias("weight"))
    distinct = entries.groupBy("key").agg(F.sum("weight").alias("weight"))
    links = common.cut(distinct.mapInArrow(_expand(path_a, path_b), "key binary, a int, b int, weight long"))
    counted = links.groupBy("a", "b").agg(F.sum("weight").alias("count"))
    top = counted.groupBy("b").agg(F.max("count").alias("top"))
    pairs = common.cut(counted.join(top, "b").select("a", "b", "count", (F.col("count") == F.col("top")).alias("best")))
    worth = links.join(pairs, ["a", "b"]).groupBy("key").agg(F.sum(F.col("best").cast("long")).alias("best"), F.sum("count").alias("total"))
    values = entries.drop("weight").join(worth, "key").select("of", "local", "best", "total")
    rows = coded.where("local is null").drop("local", "key", "freq", "docs")
    out = T.StructType([f for f in schema.fields if f.name in ("rest", "groups", *(n for n, _ in _DOC))] + [T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
    summed = rows.groupBy("block").cogroup(values.groupBy("of")).applyInArrow(_sum_up(to_arrow_schema(out)), out)
    made = [c for c in out.names if c != "rest" and (c != "groups" or with_groups)]
    return summed.select(*[F.col(f"rest.`{c}`").alias(c) for c in keep], *made), pairs
