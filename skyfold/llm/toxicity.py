"""Toxicity by a factorization machine over hashed terms.

A term is a word (A-Z lower-cased, outer punctuation cut), the first four bytes of one, or the first six; it is
hashed to one of 2**18 slots. The model knows the slots whose share of toxic training texts differs clearly from the
overall share; and those that are neutral alone, but whose share differs among the texts that hold a slot of raised
share (a group's name beside insults), so that their pairs can be learnt. A text's value at each of its k known slots is 1 / sqrt(1 + k); every pair of slots interacts through
8 factors. The machine is trained on the driver, on a
bounded sample of labelled rows; every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, tokens, words

U = np.uint64
SLOT_BITS = 18
SLOTS = 1 << SLOT_BITS
FACTORS = 8
#: At most so many labelled rows train the model (those with the smallest hash of their doc_id).
SAMPLE = 20_000
#: A slot is known if it is in so many training texts and its toxic share is so many standard deviations off.
LEAST_TEXTS, LEAST_Z = 3, 3.0
THRESHOLD = 0.3
_PUNCT = np.zeros(256, bool)
_PUNCT[list(b".,;:!?\"'()[]{}<>*_-")] = True


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots of each text, in one array, and each text's offset in it."""
    n = len(offsets) - 1
    starts, ends, _, at = words.words(data, offsets)
    for _ in range(3):  # outer punctuation
        ok = starts < ends
        cut = np.zeros(len(starts), bool)
        cut[ok] = _PUNCT[data[ends[ok] - 1]]
        ends = ends - cut
        ok = starts < ends
        cut = np.zeros(len(starts), bool)
        cut[ok] = _PUNCT[data[starts[ok]]]
        starts = starts + cut
    owner = np.repeat(np.arange(n), np.diff(at))
    some = starts < ends
    starts, ends, owner = starts[some], ends[some], owner[some]
    with np.errstate(over="ignore"):
        c = np.zeros(len(data) + 1, U)
        np.cumsum(words._FOLDED[data] * words.powers(words._M, max(1, len(data))), out=c[1:])
        back = words.powers(words._MINV, max(1, len(data)))

        def named(e: np.ndarray, kind: int) -> np.ndarray:
            return words.mix((c[e] - c[starts]) * back[np.minimum(starts, len(data) - 1)] + U(kind)) >> U(64 - SLOT_BITS)

        slots = np.concatenate([named(ends, 1), named(np.minimum(ends, starts + 4), 2), named(np.minimum(ends, starts + 6), 3)])
    keys = np.sort((np.tile(owner, 3).astype(U) << U(SLOT_BITS)) | slots)
    if len(keys):
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    return (keys & U(SLOTS - 1)).astype(np.int64), np.searchsorted(keys, np.arange(n + 1).astype(U) << U(SLOT_BITS))


@dataclass
class Machine:
    """bias; for each slot its linear weight and its factors; slots that the model doesn't know have weight 0."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    known: np.ndarray

    def scores(self, slots: np.ndarray, edges: np.ndarray) -> np.ndarray:
        keep = self.known[slots]
        owner = np.repeat(np.arange(len(edges) - 1), np.diff(edges))[keep]
        slots = slots[keep]
        n = len(edges) - 1
        size = np.bincount(owner, minlength=n)
        x = 1 / np.sqrt(1 + size)
        line = np.bincount(owner, self.weights[slots], n) * x
        v = self.factors[slots]
        sums = np.stack([np.bincount(owner, v[:, f], n) for f in range(v.shape[1])], 1) * x[:, None]
        squares = np.bincount(owner, (v * v).sum(1), n) * x * x
        z = self.bias + line + 0.5 * ((sums * sums).sum(1) - squares)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(slots: np.ndarray, edges: np.ndarray, labels: np.ndarray, known: np.ndarray, epochs: int = 12, rate: float = 0.1, decay: float = 1e-5, seed: int = 5) -> Machine:
    """Adagrad over mini-batches of 64 texts of known slots; the same rows in the same order give the same model."""
    n = len(labels)
    rate_all = float(labels.mean()) if n else 0.0
    rng = np.random.Generator(np.random.PCG64(seed))
    w, v = np.zeros(SLOTS), rng.normal(0, 0.05, (SLOTS, FACTORS))
    gw, gv = np.full(SLOTS, 1e-6), np.full((SLOTS, FACTORS), 1e-6)
    share = min(max(rate_all, 1e-3), 1 - 1e-3)
    bias, gb = float(np.log(share / (1 - share))), 1e-6
    rows = np.split(slots, edges[1:-1]) if n else []
    for _ in range(epochs):
        order = rng.permutation(n)
        for k in range(0, n, 64):
            mine = order[k : k + 64]
            sizes = np.array([len(rows[i]) for i in mine])
            s = np.concatenate([rows[i] for i in mine]).astype(np.int64)
            owner = np.repeat(np.arange(len(mine)), sizes)
            x = 1 / np.sqrt(1 + sizes)
            xo = x[owner][:, None]
            vs = v[s]
            sums = np.zeros((len(mine), FACTORS))
            np.add.at(sums, owner, vs * xo)
            squares = np.bincount(owner, (vs * vs).sum(1), len(mine)) * x * x
            z = bias + np.bincount(owner, w[s], len(mine)) * x + 0.5 * ((sums * sums).sum(1) - squares)
            err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[mine]
            e = err[owner][:, None] * xo
            uniq, back = np.unique(s, return_inverse=True)
            dw = np.bincount(back, e[:, 0], len(uniq)) + decay * w[uniq]
            dv = np.zeros((len(uniq), FACTORS))
            np.add.at(dv, back, e * (sums[owner] - vs * xo))
            dv += decay * v[uniq]
            gw[uniq] += dw * dw
            gv[uniq] += dv * dv
            gb += float(err.sum()) ** 2
            w[uniq] -= rate * dw / np.sqrt(gw[uniq])
            v[uniq] -= rate * 0.3 * dv / np.sqrt(gv[uniq])
            bias -= rate * 0.3 * float(err.sum()) / np.sqrt(gb)
    v[~known] = 0
    return Machine(bias, w.astype(np.float32), v.astype(np.float32), known)


def _terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = words.buffers(batch.column(0))
        for i, j in words.chunks(offsets):
            slots, edges = terms(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            rows = [slots[a:b].astype(np.int32).tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column(1).slice(i, j - i), batch.column(2).slice(i, j - i)], names=["slots", "label", "ord"])


def _count(among: np.ndarray | None):
    """A task's number of texts and of toxic texts with each slot (and in all: slot -1); with a mask, of the texts that hold one of its slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, all_ = np.zeros((2, SLOTS), np.int64), [0, 0]
        for batch in batches:
            for raw, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                slots = np.frombuffer(raw, np.int32)  # distinct
                if among is None or among[slots].any():
                    both[0, slots] += 1
                    both[1, slots] += label
                    all_ = [all_[0] + 1, all_[1] + label]
        some = np.flatnonzero(both[0])
        yield pa.RecordBatch.from_arrays([pa.array([-1, *some.tolist()], pa.int32()), pa.array([all_[0], *both[0, some].tolist()]), pa.array([all_[1], *both[1, some].tolist()])], names=["slot", "texts", "toxic"])

    return run


def _distinct_slots(rows: DataFrame, among: np.ndarray | None = None) -> list:
    """(slot, raised) of the slots in LEAST_TEXTS texts or more whose toxic share is LEAST_Z deviations off that of all the texts."""
    counts = rows.mapInArrow(_count(among), "slot int, texts long, toxic long").groupBy("slot").agg(F.sum("texts").alias("texts"), F.sum("toxic").alias("toxic"))
    n, toxic = counts.where("slot < 0").agg(F.coalesce(F.sum("texts"), F.lit(0)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    share = toxic / n if n else 0.0
    if not 0 < share < 1:
        return []
    off = F.col("toxic") - F.col("texts") * share
    far = counts.where((F.col("slot") >= 0) & (F.col("texts") >= LEAST_TEXTS) & (F.abs(off) >= LEAST_Z * F.sqrt(F.col("texts") * (share * (1 - share)))))
    return far.select("slot", (off > 0).alias("raised")).collect()  # SLOTS rows at most


def _only(known: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [(x := np.frombuffer(raw, np.int32))[known[x]].tobytes() for raw in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.binary()), *batch.columns[1:]], names=batch.schema.names)

    return run


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Train on at most `sample` rows of labels (doc_id, toxic 0 or 1) that have a document; null labels are no labels.

    The sample is those with the smallest hash of doc_id, so it is the same in every run. Slots are counted, and
    chosen, on the executors; the driver gets the sample's chosen slots (not its texts). A doc_id with several rows in
    either table gives several training rows, in a fixed order.
    """
    common.ship(docs.sparkSession)
    order = F.xxhash64("doc_id", F.lit(5))
    chosen = labels.where("toxic is not null and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("label"), order.alias("ord")).orderBy("ord", "doc_id", "label").limit(sample)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "label", "ord")
    rows = common.cut(rows.mapInArrow(_terms_of, "slots binary, label int, ord long"))
    known, raised = np.zeros(SLOTS, bool), np.zeros(SLOTS, bool)
    for r in _distinct_slots(rows):
        known[r.slot], raised[r.slot] = True, r.raised
    for r in _distinct_slots(rows, raised) if raised.any() else ():
        known[r.slot] = True
    got = sorted(map(tuple, rows.mapInArrow(_only(known), "slots binary, label int, ord long").collect()), key=lambda r: (r[2], r[1], bytes(r[0])))[:sample]
    common.drop(rows)
    parts = [np.frombuffer(r[0], np.int32) for r in got]
    edges = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return train(np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64), edges, np.array([r[1] for r in got], float), known)


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """docs with score (double, 0 to 1) for every row and its whole text; null text is empty.

    Other columns stay; one named score is replaced. Neither doc_id nor any column but text has influence.
    """
    spark = docs.sparkSession
    common.ship(spark)
    held = spark.sparkContext.broadcast(machine)  # of fixed size: SLOTS * (FACTORS + 1) floats
    keep = docs.drop("score")
    rest = keep.select(F.col("text").cast("string").alias("_text"), F.struct(*[F.col(f"`{c}`") for c in keep.columns]).alias("rest"))
    schema = T.StructType([rest.schema["rest"], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        model = held.value
        for batch in batches:
            data, offsets = words.buffers(batch.column(0))
            for i, j in words.chunks(offsets):
                got = model.scores(*terms(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, j - i), pa.array(got)], names=["rest", "score"])
        words.release()

    return rest.mapInArrow(run, schema).select("rest.*", "score")
