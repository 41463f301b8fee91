"""Document fingerprints by locally consistent parsing.

Deterministic coin tossing turns a string of symbols into small labels that depend on a few symbols before each; the
labels' local maxima cut the string into phrases of about three symbols, and phrases are named by a hash of their
content. The names are parsed again, so that level by level phrases of about 3, 9, 27 and 81 bytes arise whose
borders depend on nearby text only: equal substrings get equal interior names at any offset. A fingerprint is 64
MinHash samples of 16 bits, drawn from the names of the three upper levels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, words

U = np.uint64
SLOTS, LEVELS = 64, 4
#: Which level each slot samples: of four slots one the second level, two the third, one the fourth.
_SLOT_LEVEL = np.array([(2, 3, 3, 4)[i % 4] for i in range(SLOTS)])
_SALT = words.mix(np.arange(1, SLOTS + 1, dtype=np.int64).astype(U) * U(0x9E3779B97F4A7C15))
_CTZ = np.array([8 if v == 0 else (v & -v).bit_length() - 1 for v in range(256)], np.uint8)
_FIRST = np.iinfo(np.int64).min


def _toss(labels: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """One round on small labels: twice the lowest differing bit's place, plus the bit; 16 and over where two are equal."""
    out = np.empty_like(labels)
    place = _CTZ[labels[1:] ^ labels[:-1]]
    out[1:] = 2 * place + ((labels[1:] >> np.minimum(place, 7)) & 1)
    out[begin] = labels[begin] & 1
    return out


def _first_toss(names: np.ndarray, begin: np.ndarray) -> np.ndarray:
    if names.dtype == np.uint8:
        return _toss(names, begin)
    v = names[1:] ^ names[:-1]
    with np.errstate(over="ignore"):
        place = np.bitwise_count((v & (~v + U(1))) - U(1))  # 64 where equal
    out = np.empty(len(names), np.uint8)
    out[1:] = 2 * place + ((names[1:] >> np.minimum(place, 63).astype(U)) & U(1)).astype(np.uint8)
    out[begin] = (names[begin] & U(1)).astype(np.uint8)
    return out


def parse(names: np.ndarray, offsets: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of one level, and each text's offset in them. keys: 64-bit names of the symbols."""
    n = len(names)
    if not n:
        return np.zeros(0, U), np.zeros(len(offsets), np.int64)
    begin = np.unique(offsets[:-1][np.diff(offsets) > 0])
    labels = _first_toss(names, begin)
    for _ in range(3):
        labels = _toss(labels, begin)
    mark = np.zeros(n, bool)
    mark[1:-1] = (labels[1:-1] > labels[:-2]) & (labels[1:-1] >= labels[2:])
    mark[begin[1:] - 1] = False
    mark[begin] = True
    at = np.flatnonzero(mark)
    with np.errstate(over="ignore"):
        c = np.zeros(n + 1, U)
        np.cumsum(keys * words.powers(words._M, n), out=c[1:])
        ends = np.append(at[1:], n)
        out = words.mix((c[ends] - c[at]) * words.powers(words._MINV, n)[at] + (ends - at).astype(U))
    return out, np.searchsorted(at, offsets)


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, SLOTS) 16-bit samples; an empty text has zeros."""
    out = np.zeros((len(offsets) - 1, SLOTS), np.uint16)
    names, at, keys = data, offsets, words._RANDOM[data]
    has = np.flatnonzero(np.diff(offsets) > 0)
    for level in range(1, LEVELS + 1):
        names, at = parse(names, at, keys)
        keys = names
        if len(names):
            x = (names >> U(32)).astype(np.uint32)
            for s in np.flatnonzero(_SLOT_LEVEL == level):
                with np.errstate(over="ignore"):
                    low = np.minimum.reduceat(x * np.uint32(_SALT[s] & U(0xFFFFFFFF) | U(1)) + np.uint32(_SALT[s] >> U(32)), at[:-1][has])
                out[has, s] = (words.mix(low.astype(U) + U(1)) >> U(48)).astype(np.uint16) | 1
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples, row by row."""
    return (a == b).mean(1)


def _chunk(rows: list[tuple]) -> pa.RecordBatch:
    """rows: (doc_id, text, next text), in order but for gaps."""
    ids, texts, after = map(list, zip(*rows, strict=True))
    follows = [i + 1 if i + 1 < len(rows) and texts[i + 1] == after[i] else None for i in range(len(rows))]
    gaps = [i for i, f in enumerate(follows) if f is None]
    for k, i in enumerate(gaps):
        follows[i] = len(rows) + k
    edited = [t[: len(t) - len(t) // 2] + a[: len(t) // 2] for t, a in zip(texts, after, strict=True)]
    own = fingerprints(*words.buffers(pa.array(texts + [after[i] for i in gaps], pa.string())))
    new = fingerprints(*words.buffers(pa.array(edited, pa.string())))
    following, own = own[follows], own[: len(rows)]
    hexed = lambda f: pa.array([x.tobytes().hex() for x in f.astype(">u2")], pa.string())
    digests = [hashlib.sha256(e.encode()).hexdigest() for e in edited]
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(list(map(len, texts)), pa.int64()), pa.array(digests, pa.string()), hexed(own), hexed(new), pa.array(likeness(own, new)), pa.array(likeness(own, following))],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size, last = [], 0, None
    for batch in batches:
        for k in range(0, batch.num_rows, 1000):
            part = batch.slice(k, 1000)
            for place, look, doc_id, text in zip(*(part.column(c).to_pylist() for c in range(4)), strict=True):
                if last is not None and last[0] == place and not last[1]:
                    held.append((last[2], last[3], text))
                    size += len(last[3])
                    if size > 1 << 19:
                        yield _chunk(held)
                        held, size = [], 0
                last = (place, look, doc_id, text)
    if held:
        yield _chunk(held)


def _place(splitters: np.ndarray, first: np.ndarray):
    """(place, look, doc_id, ord, text): a range's rows, and as look-ahead the row that follows its last one (one of a batch, where several are equal)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = np.empty(batch.num_rows, _KEY)
            key["ord"], key["h"] = (batch.column(c).to_numpy() for c in (1, 2))
            place = np.searchsorted(splitters, key, "right")
            heads = np.flatnonzero((place > 0) & (splitters[np.maximum(place - 1, 0)] == key)) if len(splitters) else np.zeros(0, np.int64)
            heads = heads[np.sort(np.unique(place[heads], return_index=True)[1])]
            begin = np.flatnonzero(key == first)[:1]
            rows = np.concatenate([np.arange(len(key)), heads, begin])
            where = np.concatenate([place, place[heads] - 1, np.full(len(begin), len(splitters))]).astype(np.int32)
            got = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(np.arange(len(rows)) >= len(key)), *got.columns], names=["place", "look", "doc_id", "ord", "h", "text"])

    return run


_KEY = np.dtype([("ord", "<i8"), ("h", "<i8")])


def _keys(rows: list) -> np.ndarray:
    return np.array([tuple(r) for r in rows], _KEY)


def fingerprint(docs: DataFrame) -> DataFrame:
    """For each row its fingerprint, and that of its edited text with the likeness to both and to the next document's.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (hex, 4 digits a sample), near_edited, near_next.
    The next document is that of the next doc_id (null first; after the last: the first); rows of equal doc_id follow
    one another in order of their text's hash. Null text is empty; an empty text's fingerprint is all zeros. Other
    columns are ignored. An empty table gives no rows.

    Rows are range-partitioned by doc_id and hash, at keys of the table itself; a row with such a key goes to both
    ranges, so that the last document of a range meets its next one without a global sort into one task. A doc_id (or
    null) that holds more than a range's share of the rows is divided by hash.
    """
    spark = docs.sparkSession
    common.ship(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("ord"), F.xxhash64(text).alias("h"), text.alias("text"))
    ranges = 4 * common.parts(spark)
    bounds = rows.agg(F.percentile_approx("ord", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0] or []
    wanted = []
    for x in sorted(set(bounds)):  # a value that is k bounds has k ranges, of equal parts of the hashes
        k = bounds.count(x)
        wanted += [(x, _FIRST + (i << 64) // k) for i in range(k)]
    held = _keys(wanted)

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The least key of each range in a task."""
        least: dict[int, tuple] = {}
        for batch in batches:
            key = np.empty(batch.num_rows, _KEY)
            key["ord"], key["h"] = (batch.column(c).to_numpy() for c in (0, 1))
            key = np.sort(key)
            place, at = np.unique(np.searchsorted(held, key, "right"), return_index=True)
            for p, i in zip(place.tolist(), at.tolist(), strict=True):
                least[p] = min(least.get(p, key[i].item()), key[i].item())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*[(p, *k) for p, k in least.items()], strict=True)] or [pa.array([], pa.int64())] * 3, names=["place", "ord", "h"])

    heads = rows.select("ord", "h").mapInArrow(ranged, "place long, ord long, h long").groupBy("place").agg(F.min(F.struct("ord", "h")).alias("k")).select("k.*").collect()
    heads = np.sort(_keys(heads))
    first, splitters = (heads[0] if len(heads) else np.zeros(1, _KEY)[0]), heads[1:]
    placed = rows.mapInArrow(_place(splitters, first), "place int, look boolean, doc_id long, ord long, h long, text string")
    dealt = placed.repartition(common.parts(spark), "place").sortWithinPartitions("place", "look", "ord", "h", "text")
    return dealt.select("place", "look", "doc_id", "text").mapInArrow(_edit, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
