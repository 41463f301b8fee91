"""Exact repeated passages by fixed-block anchors.

Every aligned block of 10 words (0, 10, 20, ... of its document) is an index entry, and every rolling window of
10 words probes the index; both travel to the bucket of their hash as packed arrays of 4 bytes a probe. A repeat
of 20 words always covers an aligned block of its other copy, so only windows around a hit block can repeat:
those are extended to 20 words, compared by 96-bit names in a second, small exchange that finds the earliest
start of each, and overlapping repeats merge into maximal ones.

Hot keys: blocks that a sample of the documents shows to be very frequent are hits at once and never sent to a bucket;
and of a window's occurrences in one task only the earliest is sent on, the others are repeats already.

Texts travel only to where their hits are; which texts have hits is tested with a Bloom filter of checked size, or by
a join where they are too many for one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common, words

U = np.uint64
#: Probes that one task gathers before it sends a packed array to each bucket.
FLUSH = 2_000_000
#: Blocks that occur so often in a sample of so many documents are hot. The result is the same with any sample.
SAMPLE, HOT = 8_000, 24
_CENSUS = 16
_SECOND = 0xD1342543DE82EF95
_SECOND_INVERSE = pow(_SECOND, -1, 2**64)
_FIRST_DOC = np.iinfo(np.int64).min
_PROBES = "bucket int, docs binary, counts binary, low binary, aligned binary"
_HITS = "home int, bucket int, docs array<long>, counts binary, bits binary"
_WINDOWS = "bucket int, docs binary, ids binary, counts binary, one binary, two binary, start binary"
_REPEATS = "home int, docs array<long>, counts binary, start binary"


def _array(values: list) -> np.ndarray:
    return np.concatenate(values) if values else np.zeros(0, U)


def _glued(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _anchors(data: np.ndarray, offsets: np.ndarray, block: int, window: int):
    """Hash, owner and word position of every rolling block in texts that have a whole window; and the texts' words."""
    _, _, names, at = words.words(data, offsets)
    ok, counts = words.inside(at, block)
    long = np.diff(at) >= window
    if len(ok):
        ok[np.repeat(~long, np.diff(at))[: len(ok)]] = False
    where = np.flatnonzero(ok)
    grams = words.rolled(names, block)[where] if len(where) else np.zeros(0, U)
    owner = np.repeat(np.arange(len(counts)), np.where(long, counts, 0))
    return grams, owner, where, names, at


def _census(block: int, window: int):
    """All rolling blocks of some texts, packed, in _CENSUS parts by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = words.buffers(batch.column(0))
            for i, j in words.chunks(offsets, 1 << 20, 4000):
                grams = np.sort(_anchors(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], block, window)[0])
                cuts = np.searchsorted(grams, np.arange(1, _CENSUS).astype(U) << U(60))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(_CENSUS, dtype=np.int32)), pa.array([x.tobytes() for x in np.split(grams, cuts)], pa.binary())], names=["part", "grams"])

    return run


def _frequent(key, table):
    grams, counts = np.unique(_glued(table["grams"], U), return_counts=True)
    return pa.table({"gram": grams[counts >= HOT].view(np.int64)})


def hot_blocks(texts: DataFrame, block: int, window: int) -> np.ndarray:
    """Sorted hashes of the blocks that occur HOT times or more in about SAMPLE documents: at most a HOT-th of those documents' blocks."""
    n = texts.count()
    some = texts.where(F.pmod(F.xxhash64("rk", F.lit(9)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / max(1, n)))).select("text")
    got = some.mapInArrow(_census(block, window), "part int, grams binary").groupBy("part").applyInArrow(_frequent, "gram long").collect()
    return np.sort(np.array([r.gram for r in got], np.int64).view(U))


class _Hot:
    """Which blocks are hot; most are told apart by their first 16 bits."""

    def __init__(self, grams: np.ndarray):
        self.grams, self.first = grams, np.zeros(1 << 16, bool)
        self.first[(grams >> U(48)).astype(np.int64)] = True

    def mask(self, grams: np.ndarray) -> np.ndarray:
        out = self.first[(grams >> U(48)).astype(np.int64)]
        if len(self.grams):
            some = np.flatnonzero(out)
            out[some] = self.grams[np.minimum(np.searchsorted(self.grams, grams[some]), len(self.grams) - 1)] == grams[some]
        return out


def _small(buckets: int):
    """The least type that holds a bucket's number: sorting by 16 bits is much faster."""
    return np.uint16 if buckets <= 1 << 16 else np.uint32


def _probe(buckets: int, homes: int, block: int, window: int, hot: _Hot):
    """Probes by bucket; documents with hot blocks are named to their home, as bucket -1 - home."""
    kind, most = _small(buckets), max(FLUSH, 32 * buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, keys, marked, size, rows = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            out = [[], [], [], [], []]
            own = np.concatenate(keys)
            bucket, row, low, aligned = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(bucket, kind="stable")
            bucket, row, low, aligned = bucket[order], row[order], low[order], aligned[order]
            new = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (row[1:] != row[:-1])])) if len(row) else np.zeros(0, np.int64)
            ends = np.append(new, len(row))
            counts = np.diff(ends).astype(np.uint32)
            first = np.flatnonzero(np.concatenate([[True], bucket[new][1:] != bucket[new][:-1]])) if len(new) else np.zeros(0, np.int64)
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(new)], strict=True) if len(first) else ():
                s, e = ends[a], ends[b]
                for to, x in zip(out, (int(bucket[s]), own[row[new[a:b]]], counts[a:b], low[s:e], np.packbits(aligned[s:e])), strict=True):
                    to.append(x if isinstance(x, int) else x.tobytes())
            near = np.unique(np.concatenate(marked)) if marked else np.zeros(0, np.int64)
            home = near % homes
            for h in np.unique(home).tolist():
                for to, x in zip(out, (-1 - h, near[home == h].tobytes(), b"", b"", b""), strict=True):
                    to.append(x)
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(x, pa.binary()) for x in out[1:])], names=["bucket", "docs", "counts", "low", "aligned"])

        for batch in batches:
            data, offsets = words.buffers(batch.column(1))
            ids = batch.column(0).to_numpy()
            for i, j in words.chunks(offsets, 1 << 20, 4000):
                grams, owner, where, _, at = _anchors(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], block, window)
                if not len(grams):
                    continue
                aligned = (where - at[owner]) % block == 0
                is_hot = hot.mask(grams)
                if is_hot.any():
                    marked.append(ids[i:j][np.unique(owner[is_hot])])
                    grams, owner, aligned = grams[~is_hot], owner[~is_hot], aligned[~is_hot]
                held.append((((grams >> U(40)) % U(buckets)).astype(kind), (owner + rows).astype(np.int32), grams.astype(np.uint32), aligned))
                keys.append(ids[i:j])
                rows += j - i
                size += len(grams)
                if size >= most:
                    yield flush()
                    held, keys, marked, size, rows = [], [], [], 0, 0
        if held:
            yield flush()
        held = keys = marked = []
        words.release()

    return run


def _hit(homes: int):
    """Of one bucket's probes, those whose block is indexed and occurs at least twice: by document, as bits in the order of its probes."""

    def run(key, table):
        docs, counts = _glued(table["docs"], np.int64), _glued(table["counts"], np.uint32).astype(np.int64)
        if key[0].as_py() < 0:  # documents with hot blocks
            docs = np.unique(docs)
            return pa.table({"home": pa.array([-1 - key[0].as_py()], pa.int32()), "bucket": pa.array([-1], pa.int32()), "docs": pa.array([docs], pa.list_(pa.int64())), "counts": pa.array([bytes(4 * len(docs))], pa.binary()), "bits": pa.array([b""], pa.binary())})
        low = _glued(table["low"], np.uint32)
        sizes = [len(x) // 4 for x in table["low"].to_pylist()]
        aligned = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(table["aligned"].to_pylist(), sizes, strict=True)])
        order = np.argsort(low, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], low[order][1:] != low[order][:-1]]))
        runs = np.diff(np.append(first, len(low)))
        hit = (runs > 1) & (np.add.reduceat(aligned[order].astype(np.int64), first) > 0)
        bits = np.zeros(len(low), np.uint8)
        bits[order] = np.repeat(hit, runs)
        begin = np.concatenate([[0], np.cumsum(counts)])[:-1]
        has = np.add.reduceat(bits.astype(np.int64), begin) > 0
        home = docs % homes
        out = [[], [], [], []]
        chosen = np.flatnonzero(has)
        chosen = chosen[np.argsort(home[chosen], kind="stable")]
        for part in np.split(chosen, np.flatnonzero(np.diff(home[chosen])) + 1):
            if len(part):
                out[0].append(int(home[part[0]]))
                out[1].append(docs[part])
                out[2].append(counts[part].astype(np.uint32).tobytes())
                out[3].append(np.packbits(bits[_spans(begin[part], counts[part])]).tobytes())
        return pa.table(
            {"home": pa.array(out[0], pa.int32()), "bucket": pa.array([key[0].as_py()] * len(out[0]), pa.int32()), "docs": pa.array(out[1], pa.list_(pa.int64())), "counts": pa.array(out[2], pa.binary()), "bits": pa.array(out[3], pa.binary())}
        )

    return run


def _spans(begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """begin[0] .. begin[0]+counts[0]-1, begin[1] .. and so on."""
    total = int(counts.sum())
    shift = np.repeat(begin - np.concatenate([[0], np.cumsum(counts)])[:-1], counts)
    return np.arange(total) + shift


def _extend(buckets: int, block: int, window: int, hot: _Hot):
    """Texts and hits of one home: names of all windows around a hit, dealt to buckets, each window's earliest occurrence only.

    The other occurrences are repeats: they stay at the home, as bucket -1 - home.
    """

    def run(key, texts, hits):
        out = [[] for _ in range(7)]
        if texts.num_rows and hits.num_rows:
            docs = hits["docs"].combine_chunks().flatten().to_numpy().view(U)
            lengths = [len(x) // 4 for x in hits["counts"].to_pylist()]
            of_bucket = np.repeat(hits["bucket"].to_numpy().astype(np.int64), lengths).astype(U)
            counts = _glued(hits["counts"], np.uint32).astype(np.int64)
            sums = np.add.reduceat(counts, np.concatenate([[0], np.cumsum(lengths)])[:-1])
            bits = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=int(n)) for x, n in zip(hits["bits"].to_pylist(), sums, strict=True)])
            begin = np.concatenate([[0], np.cumsum(counts)])[:-1]
            name = words.mix(docs ^ (of_bucket * U(0x9E3779B97F4A7C15)))
            sort = np.argsort(name)
            name = name[sort]
            data, offsets = words.buffers(texts["text"])
            keys, ids = texts["rk"].to_numpy(), texts["doc_id"].to_numpy()
            held = []
            for i, j in words.chunks(offsets, 1 << 20, 4000):
                grams, owner, where, names, at = _anchors(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], block, window)
                if not len(grams):
                    continue
                mask = np.zeros(len(names) + window + 1, np.int32)
                is_hot = hot.mask(grams)
                mask[where[is_hot]] = 1
                grams, owner, where = grams[~is_hot], owner[~is_hot], where[~is_hot]
                run_of = owner.astype(np.int64) * buckets + ((grams >> U(40)) % U(buckets)).astype(np.int64)
                order = np.argsort(run_of, kind="stable")
                first = np.flatnonzero(np.concatenate([[True], np.diff(run_of[order]) != 0])) if len(order) else np.zeros(0, np.int64)
                size = np.diff(np.append(first, len(order)))
                runs = run_of[order][first]
                wanted = words.mix(keys[i:j].view(U)[runs // buckets] ^ ((runs % buckets).astype(U) * U(0x9E3779B97F4A7C15)))
                pos = np.minimum(np.searchsorted(name, wanted), len(name) - 1)
                known = name[pos] == wanted
                mask[where[order[_spans(first[known], size[known])]]] = bits[_spans(begin[sort[pos[known]]], size[known])]
                total = np.concatenate([[0], np.cumsum(mask)])
                whole, per = words.inside(at, window)
                starts = np.flatnonzero(whole)
                starts = starts[total[starts + window - block + 1] > total[starts]]
                if not len(starts):
                    continue
                mine = np.searchsorted(at, starts, "right") - 1
                one, two = words.rolled(names, window)[starts], words.rolled(names, window, _SECOND, _SECOND_INVERSE)[starts]
                held.append((keys[i:j][mine], ids[i:j][mine], one, two.astype(np.uint32), (starts - at[mine]).astype(np.uint32)))
            if held:
                key_, id_, one, two, start = (np.concatenate(x) for x in zip(*held, strict=True))
                order = np.lexsort((start, id_, two, one))
                new = np.concatenate([[True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])])
                lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
                again = np.zeros(len(order), bool)
                again[order] = (id_[order] != id_[lead]) | (start[order] != start[lead])
                bucket = ((one >> U(40)) % U(buckets)).astype(np.int64)
                bucket[again] = -1 - key[0].as_py()
                order = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0]))
                for at_ in np.split(order, cuts[1:]):
                    new = np.flatnonzero(np.concatenate([[True], key_[at_][1:] != key_[at_][:-1]]))
                    row = (int(bucket[at_[0]]), key_[at_][new], id_[at_][new], np.diff(np.append(new, len(at_))).astype(np.uint32), one[at_], two[at_], start[at_])
                    for to, x in zip(out, row, strict=True):
                        to.append(x if isinstance(x, int) else x.tobytes())
        words.release()
        return pa.table([pa.array(out[0], pa.int32()), *(pa.array(x, pa.binary()) for x in out[1:])], names=["bucket", "docs", "ids", "counts", "one", "two", "start"])

    return run


def _earliest(homes: int):
    """Of one bucket's windows, those whose words also start earlier."""

    def run(key, table):
        counts = _glued(table["counts"], np.uint32).astype(np.int64)
        docs, ids = np.repeat(_glued(table["docs"], np.int64), counts), np.repeat(_glued(table["ids"], np.int64), counts)
        one, two, start = _glued(table["one"], U), _glued(table["two"], np.uint32), _glued(table["start"], np.uint32)
        if key[0].as_py() >= 0:  # else they are repeats already
            order = np.lexsort((start, ids, two, one))
            one, two, ids, start, docs = one[order], two[order], ids[order], start[order], docs[order]
            new = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
            lead = np.flatnonzero(new)[np.cumsum(new) - 1]
            again = np.flatnonzero((ids != ids[lead]) | (start != start[lead]))
            docs, start = docs[again], start[again]
        home = docs % homes
        order = np.lexsort((docs, home))
        docs, start, home = docs[order], start[order], home[order]
        out = [[], [], [], []]
        for part in np.split(np.arange(len(docs)), np.flatnonzero(np.diff(home)) + 1):
            if len(part):
                own = docs[part]
                new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                out[0].append(int(home[part[0]]))
                out[1].append(own[new])
                out[2].append(np.diff(np.append(new, len(own))).astype(np.uint32).tobytes())
                out[3].append(start[part].tobytes())
        return pa.table({"home": pa.array(out[0], pa.int32()), "docs": pa.array(out[1], pa.list_(pa.int64())), "counts": pa.array(out[2], pa.binary()), "start": pa.array(out[3], pa.binary())})

    return run


def _strip(schema: pa.Schema, window: int, always_join: bool):
    """Texts and repeats of one home: each text without its repeated words."""

    def run(key, texts, repeats):
        gone: dict[int, list] = {}
        for docs, counts, start in zip(*(repeats[c].to_pylist() for c in ("docs", "counts", "start")), strict=True):
            counts, start = np.frombuffer(counts, np.uint32), np.frombuffer(start, np.uint32)
            for d, s in zip(docs, np.split(start, np.cumsum(counts, dtype=np.int64)[:-1]), strict=True):
                gone.setdefault(d, []).append(s)
        kept, n_words, n_removed = [], [], []
        for rk, text in zip(texts["rk"].to_pylist(), texts["text"].to_pylist(), strict=True):
            own = (text or "").encode().split()
            n, cut = len(own), 0
            if rk in gone:
                d = np.zeros(n + 1, np.int32)
                for s in gone[rk]:
                    np.add.at(d, s, 1)
                    np.add.at(d, s + window, -1)
                keep = np.cumsum(d)[:n] == 0
                cut = n - int(keep.sum())
                own = list(compress(own, keep.tolist()))
            kept.append(b" ".join(own).decode() if cut or always_join else text)
            n_words.append(n)
            n_removed.append(cut)
        out = _rows(texts, kept, n_words, n_removed, schema)
        del kept, gone
        words.release()
        return out

    return run


def _rows(texts, kept: list, n_words: list, n_removed: list, schema: pa.Schema) -> pa.Table:
    rest = texts.column(texts.schema.get_field_index("rest")).cast(schema.field("rest").type)
    return pa.table([rest, pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], names=["rest", "kept_text", "n_words", "n_removed"])


def _whole(always_join: bool, schema: pa.Schema):
    """Texts without any repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                own = [(x or "").encode().split() for x in texts]
                kept = [b" ".join(x).decode() for x in own] if always_join else texts
                yield from _rows(part, kept, [len(x) for x in own], [0] * len(own), schema).to_batches()

    return run


def remove_repeats(docs: DataFrame, window: int = 20, always_join: bool = True, buckets: int | None = None) -> DataFrame:
    """docs (doc_id, text, any others) with kept_text, n_words and n_removed; every row stays, with all its columns.

    A word goes if a window of that many words of its document covers it and the same words also start earlier
    (in a smaller doc_id, or in the same document before). Words are runs outside [\\x20\\x09-\\x0D], unchanged in
    case. kept_text has the remaining words joined by one space; with always_join=False a text that loses nothing
    stays as it is. Null text has no words (kept_text: empty, or null where it stays). A null doc_id comes before
    all others. Rows with equal doc_id and start are not earlier than each other. Columns named like the new ones
    are replaced. An empty table gives no rows. buckets (null: the number of shuffle partitions) doesn't change the result.
    """
    spark = docs.sparkSession
    common.ship(spark)
    block = window // 2
    n = buckets or common.parts(spark)
    homes = 2 * common.parts(spark)
    added = {"kept_text", "n_words", "n_removed"}
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in added])
    keyed = docs.select(F.xxhash64(F.col("doc_id").cast("long"), F.col("text")).alias("rk"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST_DOC)).alias("doc_id"), F.col("text").cast("string").alias("text"), rest.alias("rest"))
    home = F.pmod(F.col("rk"), F.lit(homes)).cast("int")
    hot = _Hot(hot_blocks(keyed.select("rk", "text"), block, window))
    probes = keyed.select("rk", "text").mapInArrow(_probe(n, homes, block, window, hot), _PROBES)
    hits = common.cut(probes.groupBy("bucket").applyInArrow(_hit(homes), _HITS))
    near, _ = common.divide(keyed.select("rk", "doc_id", "text"), "rk", hits.select("docs"))
    windows = near.withColumn("home", home).groupBy("home").cogroup(hits.groupBy("home")).applyInArrow(_extend(n, block, window, hot), _WINDOWS)
    repeats = common.cut(windows.groupBy("bucket").applyInArrow(_earliest(homes), _REPEATS))
    common.drop(hits)
    marked = keyed.select("rk", "text", "rest")
    shape = marked.select("rest").schema
    arrow = to_arrow_schema(shape)
    result = T.StructType([*shape.fields, *(T.StructField(c, t) for c, t in (("kept_text", T.StringType()), ("n_words", T.LongType()), ("n_removed", T.LongType())))])
    some, none = common.divide(marked, "rk", repeats.select("docs"), others=(_whole(always_join, arrow), result))
    some = some.withColumn("home", home).groupBy("home").cogroup(repeats.groupBy("home")).applyInArrow(_strip(arrow, window, always_join), result)
    return none.unionByName(some).select("rest.*", "kept_text", "n_words", "n_removed")
